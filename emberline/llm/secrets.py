"""Secret scans by corpus-wide ownership of candidate values, in DataFrame functions only.

Patterns find candidates in whole texts. Each candidate value is hashed, and over the whole corpus its distinct
repositories and owners are counted: a value that many owners or many repositories carry is a copied example, one
that few carry and that looks random is a live credential of theirs. The bound for repositories is twice that for
owners: one or two owners may use a credential of theirs in several repositories. The base kinds (assign, access, hex) are always reported, with
that verdict; long mixed tokens outside of them are added as kind ``owned`` only where the count says live.

Offsets are code points, end exclusive. ``split`` and ``regexp_extract_all`` cut a text by the same pattern, so
a match starts after all pieces and matches before it; a running sum per text gives every start.

Defined cases: a null text is empty and has no spans; a null owner or repository is one of its own; equal rows
have equal spans; an empty table gives no rows; columns of the input come through, but for one named ``spans``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .staging import settle, staged, unused

#: Kind: (cheap pattern that every match fulfils, pattern, group that holds the value, least length of that group).
BASE = {
    "assign": (
        r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]",
        r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        2,
        12,
    ),
    "access": (r"AKIA[A-Z0-9]{14}", r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]{16}", r"[0-9a-f]+", 0, 16),
}
#: Long tokens of letters and digits; both must occur, at least three times.
MIXED = (r"[A-Za-z0-9_-]{20}", r"[A-Za-z0-9_-]{20,}", 0, 20)
KINDS = [*BASE, "owned"]
SPAN = "array<struct<start:bigint,kind:string,end:bigint,verdict:string,owners:bigint,repositories:bigint>>"


def _found(text: Column, kind: str, spec: tuple) -> Column:
    cheap, pattern, group, _ = spec
    pieces = F.transform(F.split(text, pattern, -1), lambda p: F.length(p).cast("bigint"))
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    zipped = F.arrays_zip(pieces.alias("gap"), whole.alias("whole"), value.alias("value"))
    return F.struct(F.lit(kind).alias("kind"), F.when(text.rlike(cheap), zipped).alias("found"))


def live_looking(value: Column) -> Column:
    """Three digits and three letters at least, and no character more than a third of it in a row of its kind."""
    digits = F.length(F.regexp_replace(value, r"[^0-9]", ""))
    letters = F.length(F.regexp_replace(value, r"[^A-Za-z]", ""))
    return (digits >= 3) & (letters >= 3) & ~value.rlike(r"(.)\1{5}")


def candidates(docs: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """One row per candidate and distinct text: keys, kind, start, end, hash of the value, whether it looks live."""
    text = F.coalesce(F.col("text"), F.lit(""))
    specs = {**BASE, "owned": MIXED}
    rows = docs.select(
        "doc_id",
        F.xxhash64(text).alias("text_key"),
        owner.alias("owner"),
        repository.alias("repository"),
        F.explode(F.array(*(_found(text, kind, spec) for kind, spec in specs.items()))).alias("f"),
    ).filter("f.found is not null")
    key = ["doc_id", "text_key", "owner", "repository", "kind"]
    parts = rows.select(*key[:4], "f.kind", F.posexplode("f.found").alias("nth", "m")).filter("m.whole is not null")
    parts = parts.select(*key, "nth", "m.gap", "m.whole", "m.value").distinct()
    before = Window.partitionBy(*key).orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.length("whole")).over(before)
    least = F.create_map(*(x for kind, spec in specs.items() for x in (F.lit(kind), F.lit(spec[3]))))
    return (
        parts.select(*key, (end - F.length("whole")).alias("start"), end.alias("end"), "value")
        .filter(F.length("value") >= least[F.col("kind")])
        .select(*key, "start", "end", F.sha2("value", 256).alias("hash"), live_looking(F.col("value")).alias("live"))
    )


def ownership(found: DataFrame) -> DataFrame:
    """Distinct owners and repositories of every candidate hash, each step reduced before its shuffle."""
    return (
        found.select("hash", "owner", "repository")
        .distinct()
        .groupBy("hash", "owner")
        .agg(F.count("*").alias("n"))
        .groupBy("hash")
        .agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"))
    )


def scan(docs: DataFrame, owner: Column | None = None, repository: Column | None = None, copied_from: int = 3, copied_to: int = 6) -> DataFrame:
    """``docs`` with their ``spans``, sorted by start, then kind.

    Values of ``copied_from`` owners and more, or in ``copied_to`` repositories and more, are examples.
    """
    owner = F.col("source") if owner is None else owner
    repository = F.concat_ws("/", "source", "lang") if repository is None else repository
    found = settle(candidates(docs, owner, repository))
    # read back, the counts come by a shuffle of their own, and Spark splits a value that very many texts hold
    rated = found.join(staged(ownership(found), "ownership"), "hash", "left")
    copied = (F.col("owners") >= copied_from) | (F.col("repositories") >= copied_to)
    verdict = F.when(copied, "example").when(F.col("live"), "live").otherwise("unlikely")
    rated = rated.select(
        "doc_id", "text_key", "start", "end", "kind", verdict.alias("verdict"), "owners", "repositories"
    ).distinct()
    # mixed tokens that touch a base span say nothing new: the last base end before and the first base start after
    text = Window.partitionBy("doc_id", "text_key")
    is_base = F.col("kind") != "owned"
    earlier = text.orderBy("start", F.when(is_base, 0).otherwise(1)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    later = text.orderBy(F.desc("start"), F.when(is_base, 0).otherwise(1)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    touched = rated.withColumn("ended", F.max(F.when(is_base, F.col("end"))).over(earlier)).withColumn(
        "begins", F.min(F.when(is_base, F.col("start"))).over(later)
    )
    fresh = (F.col("verdict") == "live") & (F.coalesce(F.col("ended"), F.lit(0)) <= F.col("start"))
    fresh = fresh & (F.coalesce(F.col("begins"), F.col("end")) >= F.col("end"))
    found_id, key, text_key = (unused(docs, name) for name in ("_id", "_key", "_text_key"))
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    spans = (
        touched.filter(is_base | fresh)
        .groupBy(F.col("doc_id").alias(found_id), F.col("text_key").alias(key))
        .agg(F.sort_array(F.collect_list(F.struct("start", order.alias("o"), "kind", "end", "verdict", "owners", "repositories"))).alias("spans"))
        .withColumn(
            "spans",
            F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["verdict"].alias("verdict"), s["owners"].alias("owners"), s["repositories"].alias("repositories"))),
        )
    )
    rows = docs.drop("spans").withColumn(text_key, F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    joined = rows.join(spans, rows["doc_id"].eqNullSafe(spans[found_id]) & (F.col(text_key) == F.col(key)), "left")
    return joined.drop(found_id, key, text_key).withColumn("spans", F.coalesce("spans", F.array().cast(SPAN)))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(scanned: DataFrame) -> DataFrame:
    """Texts with every span replaced by ``[secret]``, or ``[example]`` where many owners or repositories carry its value.

    Spans that overlap are taken as one, with the first one's mark. A null text stays null.
    """
    mark = lambda s: F.when(s["verdict"] == "example", "[example]").otherwise("[secret]")
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).cast("bigint").alias("at"))
    piece = lambda frm, to: F.substring(F.col("text"), frm.cast("int") + 1, (to - frm).cast("int"))
    folded = F.aggregate(
        "spans",
        start,
        lambda acc, s: F.when(s["start"] < acc["at"], F.struct(acc["parts"].alias("parts"), F.greatest(acc["at"], s["end"]).alias("at"))).otherwise(
            F.struct(F.concat(acc["parts"], F.array(piece(acc["at"], s["start"]), mark(s))).alias("parts"), s["end"].alias("at"))
        ),
        lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(F.col("text"), acc["at"].cast("int") + 1, 2147483647)),
    )
    text = F.when(F.size("spans") > 0, folded).otherwise(F.col("text"))
    return scanned.withColumn("text", text)
