"""Spelling variants of a corpus's words, by PartEnum signatures of their letter multisets.

A word's letters are a binary vector with a dimension for each letter and its count so far: "noon" has n1, n2, o1, o2.
One inserted or deleted letter changes one dimension, one replaced letter two, so near words have a Hamming distance of
at most two. The dimensions are partitioned into ``PARTS`` parts by letter; of any two near words all but two parts are
equal. So each enumerated choice of ``PARTS - 2`` parts, with the letters that a word has in them, is a signature, and
near words share one at least. As letters say nothing of their order, each signature is also tied to the word without
one of its quarters: near words differ in one quarter only. Signatures meet in an equi-join whose sides Spark can split
where a key is frequent, and what meets is verified by its edit distance.

A word's form is its near word of largest count (ties: smallest in code-point order) if that has ``RATIO`` times the
word's count; its root is where forms lead in the end. Counts grow ``RATIO``-fold from form to form, so chains are short,
and pointers are doubled until none moves.

Defined cases: null and empty texts have no words; letters are A to Z, a to z and U+00C0 to U+00FF, other characters
part words; a null id takes the place of an empty text before the colon; repeated rows count as often as they occur;
long runs are words like others; further columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = r"[A-Za-zÀ-ÿ]+"
PARTS = 3
RATIO = 5
LEAST_LETTERS, LEAST_COUNT = 6, 5


def runs(docs: DataFrame, least: int = LEAST_LETTERS) -> DataFrame:
    """``doc_id`` and ``run`` for each maximal run of at least ``least`` letters, A to Z lower-cased."""
    found = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(RUN), F.lit(0))
    long = F.filter(found, lambda run: F.length(run) >= least)
    return docs.select("doc_id", F.explode(long).alias("run"))


def damaged(run: Column, doc_id: Column, every: int = 199) -> Column:
    """``run`` without one letter where the crc32 of ``<doc_id>:<run>`` is divisible by ``every``."""
    crc = F.crc32(F.encode(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run), "UTF-8"))
    at = F.pmod(crc, F.length(run)).cast("int")
    without = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(crc % every == 0, without).otherwise(run)


def counted(words: DataFrame, least: int = LEAST_LETTERS, times: int = LEAST_COUNT) -> DataFrame:
    """``word`` and its count ``n``, of at least ``least`` letters and ``times`` occurrences."""
    return words.where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= times)


def signatures(word: Column, parts: int = PARTS) -> Column:
    """All signatures of a word: each choice of all but two parts, with the word's sorted letters in each of these."""
    letters = F.split(word, "")
    of = lambda part: F.filter(letters, lambda c: F.ascii(c) % parts == part)
    own = [F.concat_ws("", F.array_sort(of(part))) for part in range(parts)]
    chosen = combinations(range(parts), parts - 2)
    return F.array(*[F.concat_ws("|", F.lit(",".join(map(str, some))), *[own[p] for p in some]) for some in chosen])


def frames(word: Column) -> Column:
    """A word without each of its quarters, and the quarter: once as the shorter (of m letters) of two near words and
    once as the longer. Their first difference is in one quarter of the shorter, and all others are equal in both."""
    n = F.length(word)

    def four(m: Column) -> list[Column]:
        whole = lambda x: F.floor(x).cast("int")
        cuts = [F.lit(0), whole(m / 4), whole(m / 2), whole(m / 2) + whole((m - whole(m / 2)) / 2), m]
        out = []
        for quarter, (begin, end) in enumerate(zip(cuts, cuts[1:])):
            stop = n - (m - end)
            frame = F.concat(F.substring(word, F.lit(1), begin), F.lit("|"), F.substring(word, stop + 1, m - end))
            rest = F.substring(word, begin + 1, stop - begin)
            out.append(F.struct(m.alias("m"), F.lit(quarter).alias("quarter"), frame.alias("frame"), rest.alias("rest")))
        return out

    return F.array(*four(n), *four(n - 1))


def near_pairs(words: DataFrame) -> DataFrame:
    """``a, a_n, b, b_n``: every two words, a before b, that differ by one inserted, deleted or replaced code point."""
    signed = words.select("word", "n", frames(F.col("word")).alias("frames"), F.explode(signatures(F.col("word"))).alias("signature"))
    framed = signed.select("word", "n", "signature", F.inline("frames"))
    keyed = framed.select("word", "n", "rest", F.xxhash64("m", "quarter", "frame", "signature").alias("key"))
    a, b = (keyed.select("key", F.col("word").alias(x), F.col("n").alias(f"{x}_n"), F.col("rest").alias(f"{x}_rest")) for x in "ab")
    # Frames are equal, so the short quarters have the distance of the words; the words are compared lest hashes collide.
    near = F.when(F.levenshtein("a_rest", "b_rest", 1) == 1, F.levenshtein("a", "b", 1) == 1).otherwise(False)
    # The planner would size the sides by the words and not by their keys, so they are not left to a broadcast.
    met = a.hint("merge").join(b, (a["key"] == b["key"]) & (F.col("a") < F.col("b")) & near)
    return met.select("a", "a_n", "b", "b_n").distinct()


def rooted(words: DataFrame) -> DataFrame:
    """``words`` with ``root``: the last of the forms that lead from a word."""
    hops = staged(words.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = hops.select(F.col("word").alias("root"), F.col("root").alias("next"))
        hops = staged(hops.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "forms")
        if hops.where("moved").isEmpty():
            return words.join(hops.drop("moved"), "word", "left").withColumn("root", F.coalesce("root", "word"))
        hops = hops.drop("moved")


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of ``words`` (``word``, ``n``; words are distinct)."""
    words = staged(words.select("word", "n"), "words")
    pairs = staged(near_pairs(words), "near-words")
    both = pairs.select(F.col("a").alias("word"), F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("form")).alias("near")).unionAll(
        pairs.select(F.col("b").alias("word"), F.struct((-F.col("a_n")).alias("less"), F.col("a").alias("form")).alias("near"))
    )
    most = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min("near").alias("near"))
    told = -F.col("near.less") >= ratio * F.col("n")
    known = words.join(most, "word", "left").select(
        "word",
        F.when(told, F.col("near.form")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(told, -F.col("near.less")).alias("form_n"),
    )
    return rooted(staged(known, "variants")).select("word", "form", "root", "n", "n_near", "form_n")
