"""Integer vectors in packed blocks, and the meeting of every block of queries with every block of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from io import BytesIO

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCALE = 256.0
COMPONENTS = 1 << 19  # most components of a block of rows, and of a block of queries a quarter of that
MOST_TASKS = 10_000
LOW = -(2**63)  # below every score


def distinct_vectors(rows: DataFrame, id_: str = "vec_id", vector: str = "embedding", keep: tuple[Column, ...] = ()) -> DataFrame:
    """``vec_id``, the columns ``keep`` and ``cells`` (floor(256 x) of each component x, as bigint, saturated there).

    Rows with a null id, a null vector, or a null or non-finite component are left out. Of several rows with one id the
    smallest, by ``keep`` and then by its cells, stands for all.
    """
    x = F.col(vector)
    finite = F.forall(x, lambda v: v.isNotNull() & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    cells = F.transform(x, lambda v: F.floor(F.lit(SCALE) * v.cast("double"))).alias("cells")
    sound = rows.where(F.col(id_).isNotNull() & x.isNotNull() & finite)
    one = sound.select(F.col(id_).cast("bigint").alias("vec_id"), F.struct(*keep, cells).alias("row"))
    return one.groupBy("vec_id").agg(F.min("row").alias("row")).select("vec_id", "row.*")


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Lists of integers as rows, shorter ones filled up with zeros (at least one column)."""
    chunks = [c for c in column.chunks if len(c)]
    sizes = np.concatenate([np.diff(c.offsets.to_numpy()) for c in chunks] or [np.zeros(0, int)])
    out = np.zeros((len(sizes), max(1, int(sizes.max(initial=0)))), np.int64)
    flat = [c.values.to_numpy()[c.offsets[0].as_py() : c.offsets[-1].as_py()] for c in chunks]
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.concatenate(flat or [np.zeros(0, np.int64)])
    return out


def widen(a: np.ndarray, width: int) -> np.ndarray:
    return a if a.shape[1] >= width else np.pad(a, ((0, 0), (0, width - a.shape[1])))


def put(a: np.ndarray) -> bytes:
    """An array as bytes; integers in the narrowest of 16, 32 and 64 bits."""
    if a.dtype == np.int64 and a.size:
        kind = next(k for k in (np.int16, np.int32, np.int64) if np.iinfo(k).min <= a.min() and a.max() <= np.iinfo(k).max)
        a = a.astype(kind)
    out = BytesIO()
    np.save(out, a, allow_pickle=False)
    return out.getvalue()


def take(data: bytes) -> np.ndarray:
    return np.load(BytesIO(data), allow_pickle=False)


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows; those beyond 64 bits are held at their ends."""
    most = q.shape[1] * int(np.abs(q.astype(float)).max(initial=0)) * int(np.abs(c.astype(float)).max(initial=0))
    if most < 2**53:
        return (q.astype(float) @ c.astype(float).T).astype(np.int64)
    if most < 2**62:
        return q.astype(np.int64) @ c.astype(np.int64).T
    return np.clip(q.astype(object) @ c.astype(object).T, LOW + 1, -(LOW + 1)).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores of each row and their ids, ties by smaller id; LOW where there is none.

    ``ids`` has one id per column, or one per entry.
    """
    ids = np.broadcast_to(ids, scores.shape)
    if scores.shape[1] < k:
        more = k - scores.shape[1]
        scores, ids = np.pad(scores, ((0, 0), (0, more)), constant_values=LOW), np.pad(ids, ((0, 0), (0, more)))
    if scores.shape[1] > 4 * k:  # narrow to what reaches the kth score; ties at it may make it wide again
        least = np.partition(scores, -k, axis=1)[:, -k, None]
        reach = (scores >= least) & (scores > LOW)
        at = np.argsort(~reach, axis=1, kind="stable")[:, : max(k, int(reach.sum(1).max(initial=0)))]
        scores, ids = np.take_along_axis(scores, at, 1), np.take_along_axis(ids, at, 1)
    order = np.lexsort((ids, ~scores), axis=1)[:, :k]  # ~s falls as s rises, without overflow
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def size(rows: DataFrame) -> tuple[int, int]:
    """How many vectors there are, and the most components of one."""
    n, width = rows.agg(F.count("*"), F.max(F.size("cells"))).first()
    return n, max(1, width or 0)


def packed(rows: DataFrame, key: str, count: int, pack: Callable[[pa.Table], dict], kinds: str) -> DataFrame:
    """One row of ``kinds`` for each of ``count`` groups by a hash of the id; ``pack`` makes it of a group's rows."""

    def run(table: pa.Table) -> pa.Table:
        made = {key: table[key][0].as_py()} | pack(table)
        kind = {name: pa.binary() if kind == "binary" else pa.int32() for name, kind in (c.split() for c in schema.split(", "))}
        return pa.table({name: pa.array([made[name]], type=kind[name]) for name in kind})

    schema = f"{key} int, {kinds}"
    dealt = rows.withColumn(key, F.pmod(F.xxhash64("vec_id"), F.lit(count)).cast("int"))
    return dealt.repartition(count, key).groupBy(key).applyInArrow(run, schema)


def meet(queries: DataFrame, blocks: DataFrame, groups: int, parts: int, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``run`` over every block of queries (``grp`` below ``groups``) with every block of rows (``part`` below ``parts``).

    Each pair of blocks is a step of its own: a task holds one pair at a time, nothing is broadcast, and a lost
    executor costs the pairs it had. Blocks are of bounded size, so neither side of a pair grows with the table.
    """
    tasks = max(1, min(4 * groups * parts, MOST_TASKS))
    left = queries.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).repartition(tasks, "grp", "part")
    right = blocks.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).repartition(tasks, "grp", "part")
    return left.groupBy("grp", "part").cogroup(right.groupBy("grp", "part")).applyInArrow(run, schema)


def first(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key with their ``rank``; each task passes on no more than k rows of a key."""
    at = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("rank", at).where(F.col("rank") <= k)


def records(table: pa.Table) -> Iterator[dict]:
    """The rows of a table of packed arrays, each array unpacked."""
    for row in table.to_pylist():
        yield {name: take(value) if isinstance(value, bytes) else value for name, value in row.items()}
