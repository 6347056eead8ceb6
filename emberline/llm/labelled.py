"""Bounded, balanced samples of labelled documents, and document columns beside model scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def held_out(divisor: int, remainder: int) -> Column:
    """Whether crc32 of the document's id, as text, leaves that remainder; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor == remainder, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, unseen: Column, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """(texts with their label, labelled documents per class over all rows): at most ``per_class`` ids of each class.

    Ids are taken in the order of their hash, so any share of them is a fair one. Null labels and ids are left
    out; of repeated labels the largest counts.
    """
    known = labels.filter(~unseen & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    counts = {row["label"]: row["count"] for row in known.groupBy("label").count().collect()}
    picked = [known.filter(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    ids = picked[0].unionByName(picked[1])
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(ids), "doc_id"), counts  # 2 * per_class ids at most


def collected(chosen: DataFrame, units: Callable[[pa.Array], Iterator[tuple[np.ndarray, np.ndarray]]]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(label, unit numbers, weights) of each sampled text, in an order that depends on nothing but ids and texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(units(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), pa.array([u for u, _ in found], pa.list_(pa.int64())), pa.array([w for _, w in found], pa.list_(pa.float32()))],
                names=["doc_id", "label", "units", "weights"],
            )

    rows = chosen.select("doc_id", "label", "text").mapInArrow(run, "doc_id bigint, label int, units array<bigint>, weights array<float>").toArrow()
    order = sorted(range(rows.num_rows), key=lambda i: (rows["doc_id"][i].as_py(), len(rows["units"][i])))
    return [(rows["label"][i].as_py(), rows["units"][i].values.to_numpy(), rows["weights"][i].values.to_numpy()) for i in order]


def scored(docs: DataFrame, score: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """``docs`` with ``score double`` (of column text) and ``predicted int`` in place of columns so named."""
    kept = [f for f in docs.schema.fields if f.name.lower() not in ("score", "predicted")]
    schema = T.StructType([*kept, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    at = [f.name for f in kept].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = score(batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64()), pa.array((values >= 0.5).astype(np.int32))], names=schema.names)

    return docs.select(*(f.name for f in kept)).mapInArrow(run, schema)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30.0, 30.0)))
