"""Exact top-k search by inner product over a vector-approximation file.

Vectors are dealt by a hash of their ids into parts of bounded size. A part keeps, for every component, a code of
``bits`` bits: the number of its cell among cells of equal population, and the least and greatest value that each cell
holds. Codes and exact vectors are columns of their own, so that a scan of the codes reads a fraction of the bytes.

1. The codes are scanned with every query. A cell's ends bound a component, and so a score from both sides. The
   kth highest lower bound over the whole file is a score that the kth result reaches for certain.
2. The codes are scanned again. Exact vectors of a part are read from the highest upper bound down, until the next
   upper bound is below that certain score or below the part's own kth exact score. Every part yields k rows per query
   at most, of which the k best are the result.

No row is passed over unless its upper bound proves it worse than k others, so results are exact.

Defined cases: rows with a null id, a null vector, or any null or non-finite component take no part; of several rows
with one id that of the smallest cells counts; equal vectors under different ids stay apart, ties go to the smaller id;
vectors of different lengths are compared as if filled up with zeros; a query with fewer than k other rows gets them
all; scores beyond 64 bits are held at their ends; further columns are not read; an empty table, or one without a
query, gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vectors
from .staging import staged

BITS = 6
TILE = 256  # queries bounded at a time
BLOCK = "ids binary, cells binary, codes binary, least binary, most binary"
FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
BOUNDS = pa.schema([("query_id", pa.int64()), ("bound", pa.float64())])


def quantise(cells: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all components, and the least and greatest value in each cell of each dimension."""
    n, width = cells.shape
    many = 1 << bits
    codes, least, most = np.zeros((n, width), np.uint8), np.zeros((width, many), np.int64), np.zeros((width, many), np.int64)
    if n == 0:
        return codes, least, most
    for j in range(width):
        order = np.sort(cells[:, j])
        begins = np.unique(order[np.arange(many) * n // many])
        codes[:, j] = np.searchsorted(begins, cells[:, j], "right") - 1
        least[j, : len(begins)] = begins
        most[j, : len(begins)] = order[np.append(np.searchsorted(order, begins[1:], "left"), n) - 1]
    return codes, least, most


def bounds(q: np.ndarray, part: dict) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores of queries with a part's rows, from its codes alone."""
    columns = np.arange(part["codes"].shape[1])
    low, high = (part[side][columns, part["codes"]].astype(float) for side in ("least", "most"))
    q = vectors.widen(q, len(columns)).astype(float)
    low, high = vectors.widen(low, q.shape[1]), vectors.widen(high, q.shape[1])
    middle, apart = q @ ((low + high) / 2).T, np.abs(q) @ ((high - low) / 2).T
    scale = q.shape[1] * np.abs(q).max(initial=0) * max(np.abs(low).max(initial=0), np.abs(high).max(initial=0))
    apart += 0 if scale < 2.0**50 else scale * 1e-9  # beyond, floating point is not exact
    return middle - apart, middle + apart


def certain(q: np.ndarray, q_ids: np.ndarray, part: dict, k: int) -> pa.Table:
    """The k highest lower bounds of each query in a part, its own row left out."""
    out_ids, out = [], []
    for at in range(0, len(q), TILE):
        low, _ = bounds(q[at : at + TILE], part)
        low[part["ids"] == q_ids[at : at + TILE, None]] = -np.inf
        top = low if low.shape[1] <= k else np.partition(low, -k, axis=1)[:, -k:]
        there = top > -np.inf
        out_ids.append(np.repeat(q_ids[at : at + TILE], there.sum(1)))
        out.append(top[there])
    return pa.table([np.concatenate([np.zeros(0, np.int64), *out_ids]), np.concatenate([np.zeros(0), *out])], schema=BOUNDS)


def read_down(q: np.ndarray, upper: np.ndarray, part: dict, own: int, reach: float, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Scores and ids of the k best rows of a part that reach ``reach``, and how many exact vectors were read."""
    at = np.flatnonzero((upper >= reach) & (part["ids"] != own))
    at = at[np.argsort(-upper[at], kind="stable")]
    scores, ids, begin, step = np.zeros((1, 0), np.int64), np.zeros((1, 0), np.int64), 0, 4 * k
    while begin < len(at) and upper[at[begin]] >= reach:
        some = at[begin : begin + step]
        read = part["cells"][some]
        width = max(q.shape[1], read.shape[1])
        got = vectors.products(vectors.widen(q, width), vectors.widen(read, width))
        scores, ids = vectors.best(np.hstack([scores, got]), np.hstack([ids, part["ids"][some][None]]), k)
        begin, step = begin + len(some), 2 * step
        if scores[0, -1] > vectors.LOW:
            reach = max(reach, float(scores[0, -1]) * (1 - 1e-12 * np.sign(scores[0, -1])))
    there = scores[0] > vectors.LOW
    return scores[0][there], ids[0][there], begin


def verified(q: np.ndarray, q_ids: np.ndarray, reach: np.ndarray, part: dict, k: int) -> pa.Table:
    """The k best exact scores of each query in a part, as far as they can be among the k best of all."""
    out = [], [], []
    for at in range(0, len(q), TILE):
        _, upper = bounds(q[at : at + TILE], part)
        for i in range(len(upper)):
            scores, ids, _ = read_down(q[at + i : at + i + 1], upper[i], part, q_ids[at + i], reach[at + i], k)
            for column, values in zip(out, (np.full(len(ids), q_ids[at + i]), ids, scores)):
                column.append(values)
    return pa.table([np.concatenate([np.zeros(0, np.int64), *column]) for column in out], schema=FOUND)


def build(rows: DataFrame, bits: int = BITS) -> tuple[DataFrame, int]:
    """The approximation file of distinct vectors, written into the shared folder, and its number of parts."""
    n, width = vectors.size(rows)
    parts = -(-n * width // vectors.COMPONENTS)

    def pack(table: pa.Table) -> dict:
        ids, cells = table["vec_id"].to_numpy(), vectors.matrix(table["cells"])
        codes, least, most = quantise(cells, bits)
        arrays = {"ids": ids, "cells": cells, "codes": codes, "least": least, "most": most}
        return {name: vectors.put(a) for name, a in arrays.items()}

    return staged(vectors.packed(rows, "part", max(1, parts), pack, BLOCK), "va-file"), parts


def search(rows: DataFrame, is_query: Column, k: int = 5, bits: int = BITS) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k rows with the highest inner product, for every row of ``is_query``.

    ``rows`` has ``vec_id`` and ``embedding``; ``is_query`` is a condition on ``vec_id``.
    """
    clean = staged(vectors.distinct_vectors(rows), "vectors")
    file, parts = build(clean, bits)
    asked = clean.where(is_query)
    n, width = vectors.size(asked)
    groups = -(-n * width * 4 // vectors.COMPONENTS)
    if not n:
        return clean.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")

    def pack(table: pa.Table) -> dict:
        arrays = {"q_ids": table["vec_id"].to_numpy(), "q": vectors.matrix(table["cells"]), "reach": table["reach"].to_numpy()}
        return {name: vectors.put(a) for name, a in arrays.items()}

    def grouped(reach: DataFrame) -> DataFrame:
        return vectors.packed(reach, "grp", groups, pack, "q_ids binary, q binary, reach binary")

    def scan(queries: pa.Table, blocks: pa.Table) -> pa.Table:
        tables = [certain(a["q"], a["q_ids"], b, k) for a in vectors.records(queries) for b in vectors.records(blocks)]
        return pa.concat_tables([BOUNDS.empty_table(), *tables])

    def read(queries: pa.Table, blocks: pa.Table) -> pa.Table:
        tables = [verified(a["q"], a["q_ids"], a["reach"], b, k) for a in vectors.records(queries) for b in vectors.records(blocks)]
        return pa.concat_tables([FOUND.empty_table(), *tables])

    nothing = grouped(asked.withColumn("reach", F.lit(float("-inf"))))
    low = vectors.meet(nothing, file.select("part", "ids", "codes", "least", "most"), groups, parts, scan, "query_id bigint, bound double")
    kth = vectors.first(low, ["query_id"], [F.desc("bound")], k).groupBy(F.col("query_id").alias("vec_id")).agg(
        F.when(F.count("*") >= k, F.min("bound")).otherwise(F.lit(float("-inf"))).alias("reach")
    )
    known = asked.join(kth, "vec_id", "left").fillna(float("-inf"), ["reach"])
    found = vectors.meet(grouped(known), file, groups, parts, read, "query_id bigint, vec_id bigint, score bigint")
    return vectors.first(found, ["query_id"], [F.desc("score"), F.col("vec_id")], k).select("query_id", "rank", "vec_id", "score")
