"""Hard negatives of (anchor, positive) pairs by length buckets with sorted coordinate lists.

Vectors are sorted by length, longest first, and cut into buckets. A bucket keeps, for every coordinate, the order of
its rows by that coordinate of their unit vectors. An anchor that needs a score of at least t from a bucket whose
longest vector has length l needs a cosine of at least t / (|anchor| l). None can reach it where that exceeds 1, and
all shorter buckets are passed over with it. Elsewhere the cosine bounds each coordinate of a candidate: with anchor
coordinate cos(a) and cosine cos(b), between cos(a + b) and cos(a - b). The ranges of the anchor's ``FOCUS`` largest
coordinates are looked up in the sorted lists by binary search and intersected; the rows in all of them are verified
by their exact integer products. The needed score rises as a part's buckets are worked through.

1. Positives: the best rows of the anchor's own label.
2. Negatives: for each positive the best rows of other labels whose score is within a band of the positive's.

Every part yields no more rows per anchor (and positive) than are asked for; the best of these are the result. A row is
passed over only where its coordinates prove it below what is needed, so results are exact.

Defined cases: rows with a null id, label or vector, or with any null or non-finite component, take no part; of several
rows with one id that of the smallest label, then the smallest cells, counts; vectors of different lengths are
compared as if filled up with zeros; ties go to the smaller id; zero vectors score 0 with all; fewer rows than asked
for are all returned; scores beyond 64 bits are held at their ends; further columns are not read; an empty table, or
one without an anchor, gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vectors
from .staging import staged

FOCUS = 4
SMALL = 16  # buckets of a part
SLACK = 1e-9
BUCKET = "part int, bucket int, ids binary, labels binary, cells binary, lists binary"
HIT = "anchor_id bigint, of bigint, vec_id bigint, score bigint"
_HIT = pa.schema([(part.split()[0], pa.int64()) for part in HIT.split(", ")])


def lengths(cells: np.ndarray) -> np.ndarray:
    return np.sqrt((cells.astype(float) ** 2).sum(1))


def units(cells: np.ndarray) -> np.ndarray:
    size = lengths(cells)[:, None]
    return np.divide(cells, size, out=np.zeros(cells.shape), where=size > 0)


def buckets(rows: DataFrame) -> tuple[DataFrame, int]:
    """Length buckets of distinct vectors with labels, written into the shared folder, and their number of parts.

    Parts are ranges of length; equal lengths go by id, so that one common length is cut as well.
    """
    n, width = vectors.size(rows)
    count = max(1, -(-n * width // vectors.COMPONENTS))
    each = max(1, vectors.COMPONENTS // SMALL // width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number = [], 0
        for batch in [*batches, None]:
            held += [] if batch is None else [pa.Table.from_batches([batch])]
            table = pa.concat_tables(held) if held else None
            while table is not None and (table.num_rows >= each or batch is None and table.num_rows):
                some, table = table.slice(0, each).combine_chunks(), table.slice(each)
                cells = vectors.matrix(some["cells"])
                lists = np.argsort(units(cells), axis=0, kind="stable")
                arrays = [some["vec_id"].to_numpy(), some["label"].to_numpy(), cells, lists]
                row = [some["part"][0].as_py(), number, *map(vectors.put, arrays)]
                kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=[x.split()[0] for x in BUCKET.split(", ")])
                number += 1
            held = [] if table is None else [table]

    size = F.aggregate("cells", F.lit(0.0), lambda total, v: total + v.cast("double") * v.cast("double"))
    ranged = rows.withColumn("size", size).repartitionByRange(count, F.desc("size"), "vec_id").sortWithinPartitions(F.desc("size"), "vec_id")
    file = staged(ranged.withColumn("part", F.spark_partition_id()).mapInArrow(run, BUCKET), "length-buckets")
    return file, (file.agg(F.max("part")).first()[0] or 0) + 1


def feasible(q: np.ndarray, longest: float, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least cosine each anchor needs in a bucket (above 1: none can do), and whether it can be met."""
    size = lengths(q) * longest
    positive = need > 0
    cosine = np.where(positive, np.divide(need, size, out=np.full(len(q), np.inf), where=size > 0), -1.0)
    return np.clip(cosine - SLACK, -1, 1), cosine <= 1 + SLACK


def focus_ranges(unit: np.ndarray, cosine: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Focus coordinates of each anchor with the least and greatest value that a candidate can have there."""
    at = np.argsort(-np.abs(unit), axis=1, kind="stable")[:, :FOCUS]
    own, other = np.arccos(np.clip(np.take_along_axis(unit, at, 1), -1, 1)), np.arccos(cosine)[:, None]
    return at, np.cos(np.minimum(np.pi, own + other)) - SLACK, np.cos(np.maximum(0, own - other)) + SLACK


def scored(q: np.ndarray, need: np.ndarray, bucket: dict) -> tuple[np.ndarray, int]:
    """Exact scores of the candidates of each anchor, LOW for all other rows; and how many were verified."""
    width = max(q.shape[1], bucket["cells"].shape[1])
    q, cells, lists = vectors.widen(q, width), vectors.widen(bucket["cells"], width), bucket["lists"]
    out = np.full((len(q), len(cells)), vectors.LOW)
    cosine, can = feasible(q, bucket["longest"], need)
    at, low, high = focus_ranges(units(q), cosine)
    values = vectors.widen(bucket["sorted"], width)
    narrow = (low > values[0][at]) | (high < values[-1][at])  # elsewhere a list lies in its range as a whole
    whole = can & ~narrow.any(1)
    out[whole] = vectors.products(q[whole], cells)
    verified = int(whole.sum()) * len(cells)
    for i in np.flatnonzero(can & ~whole):
        seen = np.zeros(len(cells), np.uint8)
        for f in np.flatnonzero(narrow[i]):
            j = at[i, f]
            if j >= lists.shape[1]:  # a coordinate that all rows lack is 0 in all of them
                seen += np.uint8(low[i, f] <= 0 <= high[i, f])
                continue
            a, b = np.searchsorted(values[:, j], low[i, f], "left"), np.searchsorted(values[:, j], high[i, f], "right")
            seen[lists[a:b, j]] += 1
        rows = np.flatnonzero(seen == narrow[i].sum())
        out[i, rows] = vectors.products(q[i : i + 1], cells[rows])[0]
        verified += len(rows)
    return out, verified


def opened(blocks: pa.Table) -> list[dict]:
    """The buckets of a part, longest vectors first, with their greatest length and sorted unit coordinates."""
    out = sorted(vectors.records(blocks), key=lambda b: b["bucket"])
    for bucket in out:
        bucket["longest"] = float(lengths(bucket["cells"]).max())
        bucket["sorted"] = np.take_along_axis(units(bucket["cells"]), bucket["lists"].astype(np.int64), 0)
    return out


def kept(held: tuple[np.ndarray, np.ndarray], scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    new, new_ids = vectors.best(scores, ids, k)
    return vectors.best(np.hstack([held[0], new]), np.hstack([held[1], new_ids]), k)


def nothing(n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    return np.full((n, k), vectors.LOW), np.zeros((n, k), np.int64)


def best_of_label(a: dict, part: list[dict], k: int) -> pa.Table:
    """The k best other rows of each anchor's label in a part."""
    held = nothing(len(a["q"]), k)
    for bucket in part:
        scores, _ = scored(a["q"], held[0][:, -1].astype(float), bucket)
        scores[(bucket["labels"] != a["labels"][:, None]) | (bucket["ids"] == a["q_ids"][:, None])] = vectors.LOW
        held = kept(held, scores, bucket["ids"], k)
    there = held[0] > vectors.LOW
    anchors = np.repeat(a["q_ids"], there.sum(1))
    return pa.table([anchors, anchors, held[1][there], held[0][there]], schema=_HIT)


def best_in_bands(a: dict, part: list[dict], k: int) -> pa.Table:
    """For each anchor and band of scores (``low`` to ``high``, of the positive ``of``) the k best rows of other labels."""
    n, many = a["low"].shape
    held = [nothing(n, k) for _ in range(many)]
    live = a["low"] <= a["high"]
    for bucket in part:
        third = np.stack([scores[:, -1] for scores, _ in held], axis=1)
        need = np.where(live, np.maximum(a["low"], third).astype(float), np.inf).min(1)
        scores, _ = scored(a["q"], need, bucket)
        scores[bucket["labels"] == a["labels"][:, None]] = vectors.LOW
        for b in range(many):
            inside = (scores >= a["low"][:, b, None]) & (scores <= a["high"][:, b, None]) & live[:, b, None]
            held[b] = kept(held[b], np.where(inside, scores, vectors.LOW), bucket["ids"], k)
    tables = [_HIT.empty_table()]
    for b, (scores, ids) in enumerate(held):
        there = scores > vectors.LOW
        tables.append(pa.table([np.repeat(x, there.sum(1)) for x in (a["q_ids"], a["of"][:, b])] + [ids[there], scores[there]], schema=_HIT))
    return pa.concat_tables(tables)


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, share: tuple[int, int] = (50, 95)) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``rows`` has ``vec_id``, ``embedding`` and an integer ``label``; ``is_anchor`` is a condition on ``vec_id``. Negatives
    score from ``share[0]`` to ``share[1]`` hundredths of their positive.
    """
    label = F.col("label").cast("bigint").alias("label")
    clean = staged(vectors.distinct_vectors(rows.where(F.col("label").isNotNull()), keep=(label,)), "labelled-vectors")
    anchors = clean.where(is_anchor)
    n, width = vectors.size(anchors)
    groups = -(-n * width * 4 // vectors.COMPONENTS)
    if not n:
        return clean.sparkSession.createDataFrame(
            [], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
        )
    file, parts = buckets(clean)

    def pack(table: pa.Table) -> dict:
        arrays = {"q_ids": table["vec_id"].to_numpy(), "labels": table["label"].to_numpy(), "q": vectors.matrix(table["cells"])}
        return {name: vectors.put(a) for name, a in arrays.items()}

    def pack_bands(table: pa.Table) -> dict:
        pairs = table["pairs"].to_pylist()
        low, high, of = np.ones((len(pairs), positives), np.int64), np.zeros((len(pairs), positives), np.int64), np.zeros((len(pairs), positives), np.int64)
        for i, some in enumerate(pairs):
            for b, pair in enumerate(some):
                of[i, b] = pair["vec_id"]
                low[i, b], high[i, b] = -(-share[0] * pair["score"] // 100), share[1] * pair["score"] // 100
        return pack(table) | {name: vectors.put(a) for name, a in (("low", low), ("high", high), ("of", of))}

    def own_label(queries: pa.Table, blocks: pa.Table) -> pa.Table:
        part = opened(blocks)
        return pa.concat_tables([_HIT.empty_table(), *(best_of_label(a, part, positives) for a in vectors.records(queries))])

    def in_bands(queries: pa.Table, blocks: pa.Table) -> pa.Table:
        part = opened(blocks)
        return pa.concat_tables([_HIT.empty_table(), *(best_in_bands(a, part, negatives) for a in vectors.records(queries))])

    order = [F.desc("score"), F.col("vec_id")]
    asked = vectors.packed(anchors, "grp", groups, pack, "q_ids binary, labels binary, q binary")
    near = vectors.first(vectors.meet(asked, file, groups, parts, own_label, HIT), ["anchor_id"], order, positives)
    near = staged(near.select("anchor_id", "vec_id", "score"), "positives")
    pairs = near.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct(F.col("vec_id"), "score")).alias("pairs"))
    asked = vectors.packed(anchors.join(pairs, "vec_id"), "grp", groups, pack_bands, "q_ids binary, labels binary, q binary, low binary, high binary, of binary")
    found = vectors.first(vectors.meet(asked, file, groups, parts, in_bands, HIT), ["anchor_id", "of"], order, negatives)
    found = found.select("anchor_id", F.col("of").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    scores = near.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(scores, ["anchor_id", "positive_id"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
