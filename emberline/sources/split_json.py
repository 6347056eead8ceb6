"""One large JSON document read by many tasks.

A document like ``{"features": [{...}, {...}]}`` is one value and often one line, so that the JSON reader gives it to one
task. Here it is read as text cut behind every ``}``, which Spark splits like any text. Whether such a piece starts inside
a string, how deep it is nested, and how many members have ended before it follow from the pieces before it: running
sums within each split, and sums over the whole splits before (one small row per split). The pieces of a member then
meet by its number.

Documents are plain UTF-8 files, not compressed ones. A document that is no object, that ends early, or whose brackets do
not match gives no members and is reported whole by its path, as the reader of whole documents rejects it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPLIT = ["_file", "_block"]
MARK = "\x01"  # stands for the bracket that opens the wanted array; JSON texts hold no such character


def _before(total: Column) -> Column:
    """``total`` over the pieces of the same split before each."""
    return total.over(Window.partitionBy(*SPLIT).orderBy("_seq").rowsBetween(Window.unboundedPreceding, -1))


def _splits_before(total: Column) -> Column:
    """``total`` over the splits of the same file before each."""
    return total.over(Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))


def _occurrences(text: Column, *characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, "".join(characters), ""))


def _brackets(clean: Column) -> Column:
    """Brackets and marks outside of strings, of a text that starts outside; lists that open and close are left out."""
    bare = F.regexp_replace(F.regexp_replace(clean, '"[^"]*+"?', ""), rf"[^{{}}\[\]{MARK}]++", "")
    for _ in range(6):  # deeper than coordinates nest; what is left is only longer, its sum is the same
        bare = F.replace(bare, F.lit("[]"), F.lit(""))
    return bare


def _depth(brackets: Column) -> Column:
    return _occurrences(brackets, "{", "[", MARK) - _occurrences(brackets, "]")


def _pieces(spark: SparkSession, paths: str | list[str], items: str) -> DataFrame:
    """Pieces in file order with what each says by itself: quotes, and brackets if it starts outside or inside a string."""
    rows = spark.read.option("lineSep", "}").text(paths)
    rows = rows.select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.col("_metadata.file_size").alias("_size"),
        F.monotonically_increasing_id().alias("_seq"),
        F.col("value").alias("_text"),
    )
    unescaped = F.regexp_replace("_text", r"(?s)\\.", "")
    opened = F.regexp_replace(unescaped, rf'"{items}"\s*+:\s*+\[', MARK)
    return rows.select(
        "*",
        _occurrences(unescaped, '"').alias("_quotes"),
        _brackets(opened).alias("_out"),
        _brackets(F.regexp_replace(opened, r'^[^"]*+"?', "")).alias("_in"),
    )


def _placed(pieces: DataFrame, offsets: DataFrame) -> DataFrame:
    """Pieces with ``_inside`` (starts within a string), their brackets and the depth at their start."""
    quotes = F.coalesce(_before(F.sum("_quotes")), F.lit(0))
    known = pieces.join(offsets, SPLIT).withColumn("_inside", (F.col("_odd") + quotes) % 2 == 1)
    known = known.withColumn("_own", F.when(F.col("_inside"), F.col("_in")).otherwise(F.col("_out")))
    known = known.withColumn("_ends_outside", (F.col("_inside").cast("int") + F.col("_quotes")) % 2 == 0)
    known = known.withColumn("_net", _depth(F.col("_own")) - F.col("_ends_outside").cast("int"))
    return known.withColumn("_from", F.col("_depth") + F.coalesce(_before(F.sum("_net")), F.lit(0)))


def _offsets(pieces: DataFrame) -> DataFrame:
    """Per split: whether it starts within a string, and its depth there; and whether its file holds a whole document."""
    quotes = F.coalesce(_before(F.sum("_quotes")), F.lit(0))
    odd = pieces.withColumn("_odd", quotes % 2)

    def net(start: int) -> Column:
        """Depth that a split adds when it starts outside (0) or inside (1) a string."""
        inside = (F.col("_odd") + start) % 2
        outside_at_end = (inside + F.col("_quotes")) % 2 == 0
        return F.sum(F.when(inside == 1, _depth(F.col("_in"))).otherwise(_depth(F.col("_out"))) - outside_at_end.cast("int"))

    blank = F.max_by(F.col("_text").rlike(r"^\s*+$"), "_seq")
    splits = odd.groupBy(*SPLIT).agg(
        F.sum("_quotes").alias("_quotes"), net(0).alias("_net0"), net(1).alias("_net1"),
        F.sum(F.octet_length("_text") + 1).alias("_bytes"), F.first("_size").alias("_size"), blank.alias("_blank"),
    )
    parity = F.coalesce(_splits_before(F.sum("_quotes")), F.lit(0)) % 2
    splits = splits.withColumn("_odd", parity).withColumn("_net", F.expr("if(_odd = 1, _net1, _net0)"))
    whole_file = Window.partitionBy("_file")
    # the last piece has a bracket behind it unless the bytes say otherwise: then it is what follows the document
    tail = F.sum("_bytes").over(whole_file) - F.col("_size")
    blank = F.max_by("_blank", "_block").over(whole_file)
    total, quotes = F.sum("_net").over(whole_file), F.sum("_quotes").over(whole_file)
    whole = (quotes % 2 == 0) & (((tail == 0) & (total == 0)) | ((tail == 1) & (total == -1) & blank))
    return splits.select(*SPLIT, "_odd", F.coalesce(_splits_before(F.sum("_net")), F.lit(0)).alias("_depth"), whole.alias("_whole"))


def _numbered(placed: DataFrame) -> DataFrame:
    """Pieces with ``_listed`` (the wanted array is open at their end) and ``_closes`` (a member ends with them)."""
    own, start = F.col("_own"), F.col("_from")
    head = F.substring_index(own, MARK, 1)
    marked = F.contains(own, F.lit(MARK)) & (start + _depth(head) == 1)
    stays = ~F.substring(own, F.instr(own, MARK) + 1, F.length(own)).startswith("]")
    lowest = start - F.length(F.regexp_extract(own, r"^\]*+", 0))
    # Down to depth 1 every list of the document itself has ended.
    event = F.when(marked, stays).when(lowest <= 1, False)
    return placed.withColumn("_marked", marked).withColumn("_begins", marked | (lowest <= 2)).withColumn("_event", event)


def _carried(numbered: DataFrame, at_start: Column) -> DataFrame:
    listed = F.coalesce("_event", _before(F.last("_event", ignorenulls=True)), at_start)
    up_to = F.col("_from") + F.col("_net") + F.col("_ends_outside").cast("int")
    closes = listed & F.col("_ends_outside") & (up_to == 3)
    return numbered.withColumn("_member_piece", listed & (up_to >= 3)).withColumn("_closes", closes)


def read_members(spark: SparkSession, paths: str | list[str], items: str = "features") -> tuple[DataFrame, DataFrame]:
    """The objects of the array ``items`` of JSON documents, one text ``value`` each, and the ``path`` of broken documents.

    ``items`` is a plain name. Members come in no particular order; anything but objects is passed over.
    """
    pieces = _pieces(spark, paths, items)
    offsets = _offsets(pieces)
    broken = offsets.where(~F.col("_whole")).select(F.col("_file").alias("path")).distinct()
    numbered = _numbered(_placed(pieces, offsets.where("_whole")))

    # Whether the array is open where a split starts: the last thing said of it in the splits before.
    opened = numbered.groupBy(*SPLIT).agg(F.max_by("_event", F.when(F.col("_event").isNotNull(), F.col("_seq"))).alias("_last_event"))
    before = F.coalesce(_splits_before(F.last("_last_event", ignorenulls=True)), F.lit(False))
    opened = opened.select(*SPLIT, before.alias("_open"))
    carried = _carried(numbered.join(opened, SPLIT), F.col("_open"))

    ended = carried.groupBy(*SPLIT).agg(F.count_if("_closes").alias("_ended"))
    ended = ended.select(*SPLIT, F.coalesce(_splits_before(F.sum("_ended")), F.lit(0)).alias("_ended_before"))
    own = F.coalesce(_before(F.count_if("_closes")), F.lit(0))
    members = carried.join(ended, SPLIT).withColumn("_member", F.col("_ended_before") + own).where("_member_piece")

    after = F.regexp_extract("_text", rf'(?s)"{items}"\s*+:\s*+\[(.*)$', 1)
    first = F.when(F.col("_marked"), after).otherwise(F.col("_text"))
    text = F.when(F.col("_begins"), F.substring(first, F.instr(first, "{"), F.length(first))).otherwise(F.col("_text"))
    whole = members.groupBy("_file", "_member").agg(F.array_sort(F.collect_list(F.struct("_block", "_seq", F.concat(text, F.lit("}")).alias("text")))).alias("parts"))
    return whole.select(F.array_join(F.col("parts.text"), "").alias("value")), broken
