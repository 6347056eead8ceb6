"""Document fingerprints: bottom-k sketches of word-shingle hashes, in DataFrame functions only.

A sketch holds the k least distinct hashes of a text's shingles in ascending order; with fewer than k shingles
it holds them all. The least of a union are among the least of its parts, so sketches of parts merge exactly.
From two sketches come estimates of resemblance (share of the union's k least that both hold), containment and
the number of distinct shingles.

Shingles are five words, words stand between ASCII white space after lower-casing. Fewer words than five, but
not none, make one shingle. Defined cases: null and blank texts have an empty sketch and the fingerprint ``''``;
two empty sketches have likeness 1, an empty and a filled one 0; the order of equal ids is that of their texts,
null ids come first; an empty table gives no rows; clashing columns (named like a result) are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

K = 128
WORDS = 5
_BLANKS = " \t\n\x0b\f\r"
_LOWEST = -(2**63)


def with_sketch(df: DataFrame, text: str, name: str, k: int = K, words: int = WORDS) -> DataFrame:
    """``df`` with the sketch of column ``text`` (array<bigint>) as ``name``."""
    clean = F.btrim(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(_BLANKS))
    hashed = F.when(clean == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(clean, r"\s+"), lambda w: F.xxhash64(w)))

    def run(h: Column) -> Column:
        n = F.size(h)
        full = F.transform(F.sequence(F.lit(0), n - words), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(words))))
        return F.when(n >= words, full).when(n > 0, F.array(F.xxhash64(h))).otherwise(h)

    # the array of one binds the hashed words to a variable, else each shingle would hash the whole text again
    shingles = F.get(F.transform(F.array(hashed), run), F.lit(0))
    return df.withColumn(name, F.slice(F.sort_array(F.array_distinct(shingles)), 1, k))


def merge(left: Column, right: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(left, right)), 1, k)


def merge_parts(parts: DataFrame, keys: list[str], sketch: str, k: int = K) -> DataFrame:
    """One sketch per key from the sketches of its parts, however many; ranks are cut to k before the shuffle."""
    hashes = parts.select(*keys, F.explode(sketch).alias("_h")).distinct()
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_h"))
    return hashes.withColumn("_r", rank).filter(F.col("_r") <= k).groupBy(*keys).agg(F.sort_array(F.collect_list("_h")).alias(sketch))


def resemblance(left: Column, right: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity of the shingle sets (0 to 1)."""

    def share(union: Column) -> Column:
        both = F.size(F.array_intersect(F.array_intersect(left, right), union))
        return F.when(F.size(union) == 0, 1.0).otherwise(both / F.greatest(F.size(union), F.lit(1)))

    # bound to a variable, the union is made once
    return F.get(F.transform(F.array(F.slice(F.sort_array(F.array_union(left, right)), 1, k)), share), F.lit(0))


def distinct_count(sketch: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else (k - 1) over the k-th hash's place in its range."""
    place = (F.element_at(sketch, k).cast("double") - float(_LOWEST)) / F.lit(2.0**64)
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise((k - 1) / place)


def containment(left: Column, right: Column, k: int = K, likeness: Column | None = None) -> Column:
    """Estimated share of the left set's shingles that the right set holds (0 to 1); ``likeness`` if known already."""
    j = resemblance(left, right, k) if likeness is None else likeness
    a, b = distinct_count(left, k), distinct_count(right, k)
    return F.when(F.size(left) == 0, 1.0).otherwise(F.least(F.lit(1.0), j * (a + b) / ((1 + j) * F.greatest(a, F.lit(1.0)))))


def text_form(sketch: Column) -> Column:
    return F.array_join(sketch.cast("array<string>"), ",")


def with_next(docs: DataFrame, columns: dict[str, Column | Callable], rows_per_range: int = 1000) -> DataFrame:
    """``docs`` with ``columns`` (or functions that add them) and, as ``next_<name>``, those of the next document by doc_id; the last one's is the first.

    Documents are dealt into ranges of doc_id whose bounds are ids of the table (quantiles; their number is all
    that the driver sees). The documents that open a range are sent to the range before as well, so each range
    knows its last one's next without a sort of the whole table in one task.
    """
    key = F.coalesce(F.col("doc_id"), F.lit(_LOWEST))
    rows, least = docs.agg(F.count("*"), F.min(key)).first()
    ranges = max(1, -(-rows // rows_per_range))
    bounds = [_LOWEST] if least is None else [least]
    if ranges > 1:
        shares = [i / ranges for i in range(1, ranges)]
        bounds = sorted({least, *docs.agg(F.percentile_approx(key, shares, max(10_000, 20 * ranges)).alias("q")).first()["q"]})
    steps = F.array(*(F.lit(2**i) for i in reversed(range(max(1, len(bounds).bit_length())))))
    table = F.lit(bounds) if len(bounds) > 1 else F.array(F.lit(bounds[0]))
    docs = docs.withColumn("_at", key)
    found = F.aggregate(steps, F.lit(0), lambda low, step: F.when(F.get(table, low + step) <= F.col("_at"), low + step).otherwise(low))
    docs = docs.withColumn("_range", found)
    own = F.struct(F.col("_range").alias("range"), F.lit(False).alias("again"))
    before = F.struct(F.pmod(F.col("_range") - 1, F.lit(len(bounds))).alias("range"), F.lit(True).alias("again"))
    places = F.when(F.get(table, F.col("_range")) == F.col("_at"), F.array(own, before)).otherwise(F.array(own))
    dealt = docs.withColumn("_place", F.explode(places)).withColumn("_range", F.col("_place.range")).withColumn("_again", F.col("_place.again"))
    dealt = dealt.drop("_place").repartition(-(-len(bounds) // 2), "_range")
    for name, value in columns.items():
        dealt = value(dealt) if callable(value) else dealt.withColumn(name, value)
    line = Window.partitionBy("_range").orderBy("_again", "_at", "text")
    dealt = dealt.withColumns({f"next_{name}": F.lead(name).over(line) for name in columns})
    return dealt.filter(~F.col("_again")).drop("_range", "_again", "_at")


def fingerprint(docs: DataFrame, k: int = K) -> DataFrame:
    """``docs`` (whole texts) with ``sketch`` and ``fingerprint``."""
    kept = docs.drop("sketch", "fingerprint")
    return with_sketch(kept, "text", "sketch", k).withColumn("fingerprint", text_form(F.col("sketch")))


def compare_edited(docs: DataFrame, k: int = K) -> DataFrame:
    """Per document: its fingerprint, that of its edited text, and its likeness to the edited and the next one.

    Edited text: the last quarter of the code points (rounded down) gives way to as many from the next document.
    """
    base = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    paired = with_next(base, {"text": F.col("text"), "sketch": lambda df: with_sketch(df, "text", "sketch", k)})
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    paired = paired.withColumn("edited", edited)
    paired = with_sketch(paired, "edited", "edited_sketch", k)
    sketch, other = F.col("sketch"), F.col("edited_sketch")
    compared = paired.select(
        "doc_id",
        n.cast("bigint").alias("n_chars"),
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        "sketch",
        "edited_sketch",
        resemblance(sketch, other, k).alias("near_edited"),
        resemblance(sketch, F.col("next_sketch"), k).alias("near_next"),
    )
    return compared.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        text_form(sketch).alias("fingerprint"),
        text_form(other).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        containment(sketch, other, k, F.col("near_edited")).alias("contained_in_edited"),
        distinct_count(sketch, k).alias("distinct_shingles"),
    )
