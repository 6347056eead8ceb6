"""Benchmark decontamination by suffix arrays over shards of the training text.

Every task reads its documents in shards of bounded size. A shard's words are looked up in the benchmark's
vocabulary; a word outside of it ends every match, so only runs of known words, at least as long as the shortest
window, stay (no match is lost). Over them a word-level suffix array is built by prefix doubling, and every
suffix of every benchmark item is found in it by binary search: the range that starts with the item's window
gives all its occurrences, the neighbours of the whole suffix's place give the longest verbatim match and where
it lies. Words are compared as 64-bit hashes of their bytes.

The benchmark is taken in blocks of at most ``block_words`` words, so what is broadcast and searched at once is
bounded; with more than one block the documents are passed over once per block and written in between.

A window is 13 consecutive words of an item; an item of fewer words, but not none, is one window. Defined cases:
a null text has no words, an item without words matches nothing, repeated item ids count once per id, equal rows
get equal results, empty tables on either side give no hits, extra columns come through (those named like a
result are replaced). An item's null id is reported as the empty string.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words
from .staging import set_aside, staged

WINDOW = 13
RESULTS = ("n_words", "n_hit", "item_ids", "longest_match", "longest_item", "longest_at")
_STATE = T.StructType(
    [
        T.StructField("_n_words", T.LongType()),
        T.StructField("_hits", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("_items", T.ArrayType(T.StringType())),
        T.StructField("_longest", T.StructType([T.StructField("words", T.LongType()), T.StructField("item", T.StringType()), T.StructField("at", T.LongType())])),
    ]
)


@dataclass
class Block:
    """Benchmark items as runs of vocabulary numbers (from 1), each followed by a 0."""

    vocabulary: np.ndarray  # ascending word hashes
    items: np.ndarray  # all items' words in a row
    suffixes: np.ndarray  # where every suffix starts
    of: np.ndarray  # item number of every suffix
    lengths: np.ndarray  # words from there to the item's end
    windows: np.ndarray  # window size where a window starts there, else 0
    names: list[str]

    @classmethod
    def of_items(cls, names: list[str], item_words: list[np.ndarray], window: int) -> Block:
        vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *item_words]))
        rows = [np.append(np.searchsorted(vocabulary, w) + 1, 0) for w in item_words]
        sizes = np.array([len(w) for w in item_words], dtype=np.int64)
        items = np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64)
        begins = np.cumsum(sizes + 1) - sizes - 1
        of = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        lengths = sizes[of] - place
        size = np.minimum(sizes, window)[of]
        return cls(vocabulary, items, begins[of] + place, of, lengths, np.where(lengths >= size, size, 0), names)


def suffix_array(text: np.ndarray, suffixes: np.ndarray) -> np.ndarray:
    """``suffixes`` (places in ``text`` that no 0 precedes within a run) in the order of what follows up to a 0.

    Prefix doubling: places are ranked by 1, 2, 4, ... words; only suffixes still tied are ranked further.
    """
    rank = np.unique(np.append(text, 0), return_inverse=True)[1][:-1]  # word numbers may exceed the length that keys are made with
    order = suffixes
    span = 1
    while True:
        ahead = np.minimum(order + span, len(text) - 1)
        keys = rank[order] * np.int64(len(text) + 2) + np.where(rank[order] > 0, rank[ahead], 0)
        by = np.argsort(keys, kind="stable")
        order, keys = order[by], keys[by]
        new = np.ones(len(order), dtype=bool)
        new[1:] = keys[1:] != keys[:-1]
        group = np.cumsum(new)
        if len(order) == 0 or group[-1] == len(order):
            return order
        ranked = np.zeros_like(rank)
        ranked[order] = group
        if np.array_equal(ranked, rank):
            return order
        rank, span = ranked, span * 2


def _compare(query: np.ndarray, at: np.ndarray, text: np.ndarray, place: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(common words, sign of query against text) of runs that end at a 0, over ``limit`` words at most."""
    same, sign = np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int64)
    live = np.flatnonzero(limit > 0)
    step = 0
    while len(live):
        a, b = query[at[live] + step], text[np.minimum(place[live] + step, len(text) - 1)]
        equal = (a == b) & (a > 0)
        sign[live[~equal]] = np.sign(a - b)[~equal]
        live = live[equal]
        step += 1
        same[live] = step
        live = live[limit[live] > step]
    return same, sign


def _search(block: Block, text: np.ndarray, order: np.ndarray, at: np.ndarray, limit: np.ndarray, upper: bool) -> np.ndarray:
    """The first place in the suffix array not below each query (``upper``: above all that start with it)."""
    low, high = np.zeros(len(at), dtype=np.int64), np.full(len(at), len(order), dtype=np.int64)
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        middle = (low[open_] + high[open_]) >> 1
        _, sign = _compare(block.items, at[open_], text, order[middle], limit[open_])
        right = (sign > 0) | (upper & (sign == 0))
        low[open_[right]] = middle[right] + 1
        high[open_[~right]] = middle[~right]


def match_shard(block: Block, found: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """Matches of a block in a shard of word hashes: (starts, ends) of hit words, (text, item) pairs, longest per text."""
    none = np.zeros(0, dtype=np.int64)
    if not len(block.of) or not len(found):
        return none, none, np.zeros((0, 2), dtype=np.int64), []
    listed = np.zeros(1 << 16, dtype=bool)
    listed[(block.vocabulary >> np.uint64(48)).astype(np.int64)] = True
    number = np.zeros(len(found), dtype=np.int64)
    maybe = np.flatnonzero(listed[(found >> np.uint64(48)).astype(np.int64)])
    at = np.minimum(np.searchsorted(block.vocabulary, found[maybe]), len(block.vocabulary) - 1)
    hit = block.vocabulary[at] == found[maybe]
    number[maybe[hit]] = at[hit] + 1
    # runs of known words within a text, long enough for the shortest window
    known = number > 0
    heads = texts[:-1][texts[:-1] < len(found)]
    first = known.copy()
    first[1:] &= ~known[:-1]
    first[heads] = known[heads]
    last = known.copy()
    last[:-1] &= ~known[1:]
    tails = texts[1:][texts[1:] > 0] - 1
    last[tails] = known[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    least = int(block.windows[block.windows > 0].min())
    long = ends - starts >= least
    starts, sizes = starts[long], (ends - starts)[long]
    if not len(starts):
        return none, none, np.zeros((0, 2), dtype=np.int64), []
    # the kept runs in a row, a 0 after each; source gives their places in the shard
    begins = np.cumsum(sizes + 1) - sizes - 1
    text = np.zeros(int(sizes.sum() + len(sizes)), dtype=np.int64)
    source = np.zeros(len(text), dtype=np.int64)
    within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    where = np.repeat(begins, sizes) + within
    source[where] = np.repeat(starts, sizes) + within
    text[where] = number[source[where]]
    order = suffix_array(text, where)
    # occurrences of windows
    windows = np.flatnonzero(block.windows > 0)
    low = _search(block, text, order, block.suffixes[windows], block.windows[windows], False)
    some = low < len(order)
    same, _ = _compare(block.items, block.suffixes[windows[some]], text, order[low[some]], block.windows[windows[some]])
    windows, low = windows[some][same == block.windows[windows[some]]], low[some][same == block.windows[windows[some]]]
    high = _search(block, text, order, block.suffixes[windows], block.windows[windows], True)
    # windows of one text have one range of places: each text is written out once, whatever the number of its items
    same_text, first, of_text = np.unique(np.stack([low, block.windows[windows]], axis=1), axis=0, return_index=True, return_inverse=True)
    low, counts = same_text[:, 0], (high - low)[first]
    places = order[np.repeat(low, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)]
    hit_starts = source[places]
    hit_ends = hit_starts + np.repeat(same_text[:, 1], counts)
    row = np.searchsorted(texts, hit_starts, side="right") - 1
    in_rows = np.unique(np.stack([np.repeat(np.arange(len(low)), counts), row], axis=1), axis=0)
    in_items = np.unique(np.stack([of_text.ravel(), block.of[windows]], axis=1), axis=0)
    items = np.bincount(in_items[:, 0], minlength=len(low))
    many = items[in_rows[:, 0]]
    within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    item = in_items[np.repeat((np.cumsum(items) - items)[in_rows[:, 0]], many) + within, 1]
    pairs = np.unique(np.stack([np.repeat(in_rows[:, 1], many), item], axis=1), axis=0)
    # longest verbatim match of every suffix: the better neighbour of its place
    longest: dict[int, tuple[int, str, int]] = {}
    place = _search(block, text, order, block.suffixes, block.lengths, False)
    for neighbour in (place - 1, place):
        ok = np.flatnonzero((neighbour >= 0) & (neighbour < len(order)))
        same, _ = _compare(block.items, block.suffixes[ok], text, order[neighbour[ok]], block.lengths[ok])
        worth = same >= np.maximum(1, np.minimum(least, block.lengths[ok]))
        for i, size, spot in zip(ok[worth].tolist(), same[worth].tolist(), source[order[neighbour[ok[worth]]]].tolist()):
            r = int(np.searchsorted(texts, spot, side="right")) - 1
            candidate = (size, block.names[block.of[i]], spot - int(texts[r]))
            if r not in longest or (-size, candidate[1], candidate[2]) < (-longest[r][0], *longest[r][1:]):
                longest[r] = candidate
    return hit_starts, hit_ends, pairs, list(longest.items())


def _merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals as disjoint ones in order."""
    by = np.argsort(starts, kind="stable")
    starts, reach = starts[by], np.maximum.accumulate(ends[by])
    new = np.ones(len(starts), dtype=bool)
    new[1:] = starts[1:] > reach[:-1]
    return starts[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)] if len(starts) else reach


def item_blocks(benchmark: DataFrame, window: int, block_words: int) -> Iterator[Block]:
    """The benchmark as blocks, collected one at a time; items are dealt out by a hash of id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts, found in words.word_hashes(batch.column("text"), words.LETTERS):
                rows = [found[a:b].view(np.int64) for a, b in zip(texts[:-1], texts[1:])]
                yield pa.RecordBatch.from_arrays([batch.column("item_id").slice(at, len(rows)), pa.array(rows, pa.list_(pa.int64()))], names=["item_id", "words"])

    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    rows = rows.mapInArrow(run, "item_id string, words array<bigint>").filter(F.size("words") > 0).distinct()
    total = rows.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_words))
    for number in range(blocks):
        part = rows if blocks == 1 else rows.filter(F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks)) == number)
        held = part.orderBy("item_id", "words").toArrow()
        yield Block.of_items(held["item_id"].to_pylist(), [np.asarray(w.values.to_numpy()).view(np.uint64) for w in held["words"]], window)


def _pass(docs: DataFrame, block: Block, first: bool) -> DataFrame:
    """``docs`` with the state columns, made by the first block, extended by one block's matches."""
    shared = docs.sparkSession.sparkContext.broadcast(block)  # block_words words at most
    kept = [f for f in docs.schema.fields if f.name not in _STATE.names]
    schema = T.StructType([*kept, *_STATE.fields])
    text_at = [f.name for f in kept].index("text")
    hit_type, longest_type = pa.struct([("start", pa.int64()), ("end", pa.int64())]), pa.struct([("words", pa.int64()), ("item", pa.string()), ("at", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts, found in words.word_hashes(batch.column(text_at), words.LETTERS):
                n = len(texts) - 1
                part = batch.slice(at, n)
                starts, ends, pairs, longest = match_shard(shared.value, found, texts)
                hits: list[list] = [[] for _ in range(n)]
                items: list[list] = [[] for _ in range(n)]
                best: list[dict | None] = [None] * n
                if len(starts):
                    row = np.searchsorted(texts, starts, side="right") - 1
                    for r in np.unique(row).tolist():
                        own = row == r
                        hits[r] = [{"start": int(a - texts[r]), "end": int(b - texts[r])} for a, b in zip(*_merged(starts[own], ends[own]))]
                for r, item in pairs.tolist():
                    items[r].append(shared.value.names[item])
                for r, (size, item, spot) in longest:
                    best[r] = {"words": size, "item": item, "at": spot}
                if not first:
                    before = {name: part.column(batch.schema.get_field_index(name)).to_pylist() for name in ("_hits", "_items", "_longest")}
                    hits = [a + b for a, b in zip(before["_hits"], hits)]
                    items = [a + b for a, b in zip(before["_items"], items)]
                    best = [min((x for x in two if x), key=lambda x: (-x["words"], x["item"], x["at"]), default=None) for two in zip(before["_longest"], best)]
                columns = [pa.array(np.diff(texts), pa.int64()), pa.array(hits, pa.list_(hit_type)), pa.array(items, pa.list_(pa.string())), pa.array(best, longest_type)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *columns], names=schema.names)

    return docs.select(*(f.name for f in kept), *([] if first else _STATE.names)).mapInArrow(run, schema)


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = 500_000) -> DataFrame:
    """``docs`` with n_words, n_hit, item_ids (distinct, sorted), and the longest verbatim match with item and word place."""
    state, back = set_aside(docs.drop(*RESULTS), _STATE.names)
    for number, block in enumerate(item_blocks(benchmark, window, block_words)):
        state = _pass(state if number == 0 else staged(state, "matches"), block, number == 0)
    start = F.struct(F.lit(0).cast("bigint").alias("total"), F.lit(0).cast("bigint").alias("reach"))
    covered = F.aggregate(
        F.sort_array("_hits"),
        start,
        lambda acc, h: F.struct(
            (acc["total"] + F.greatest(F.lit(0), h["end"] - F.greatest(acc["reach"], h["start"]))).alias("total"),
            F.greatest(acc["reach"], h["end"]).alias("reach"),
        ),
        lambda acc: acc["total"],
    )
    return state.select(
        *(F.col(c).alias(back.get(c, c)) for c in state.columns if c not in _STATE.names),
        F.col("_n_words").alias("n_words"),
        F.when(F.size("_hits") == 0, F.lit(0).cast("bigint")).otherwise(covered).alias("n_hit"),
        F.sort_array(F.array_distinct("_items")).alias("item_ids"),
        F.coalesce("_longest.words", F.lit(0).cast("bigint")).alias("longest_match"),
        F.col("_longest.item").alias("longest_item"),
        F.col("_longest.at").alias("longest_at"),
    )


def contaminated(every: int = 20) -> Column:
    """At least one word in ``every`` is inside an occurrence of a benchmark window."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * every >= F.col("n_words"))


def remove(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the contaminated ones, with their own columns."""
    own, back = set_aside(docs, RESULTS)
    return matches(own, benchmark).filter(~contaminated()).select(*(F.col(c).alias(back.get(c, c)) for c in own.columns))
