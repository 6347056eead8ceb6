"""Cross-sensor dedup of an endless detection stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.functions.semantics import cell_id


def dedup_stream(
    detections: DataFrame, id_column: str, delay: str = "3 hours", salts: int = 8, per_degree: int = 100
) -> DataFrame:
    """Streaming form of the per-day dedup: coarse detections pass once no fine one can still cover them.

    ``detections`` is a stream of normalised detections. Streams cannot be anti-joined, so the coarse
    side is left-joined within one day and kept where nothing matched; the watermark (``delay``, the
    latency of the feed) decides when that is final. A burning cell can hold a large share of all rows, so
    both sides are spread over ``salts`` keys: fine rows are reduced to one per cell, day and salt, and these
    few are repeated for each salt of the coarse side. Meeting several of them changes nothing, since
    coarse rows that meet any are dropped.

    Fine detections pass at once; columns are those of ``detections``. No watermark can decide on a row without
    ``acq_ts``, so it passes at once, whichever sensor it is of, and is compared with none: such a coarse row is
    kept even where a fine one covers its cell and day, and such a fine row drops nothing. The batch dedup, which
    needs the day only, drops in both cases; where the day is missing as well the two agree.
    """
    timed = detections.withColumn("_ts", F.col("acq_ts").cast("timestamp"))
    celled = timed.withColumn("_cell", cell_id(F.col("lon"), F.col("lat"), per_degree))
    fine = F.col("source").contains("VIIRS")
    coarse = F.col("source").contains("MODIS")

    salt = F.pmod(F.xxhash64(id_column), F.lit(salts)).cast("int")
    seen = (
        celled.where(fine & F.col("_ts").isNotNull())
        .select(
            F.col("_cell").alias("_fine_cell"),
            F.col("acq_date").alias("_fine_date"),
            F.col("_ts").alias("_fine_ts"),
            salt.alias("_part"),
        )
        .withWatermark("_fine_ts", delay)
        .dropDuplicatesWithinWatermark(["_fine_cell", "_fine_date", "_part"])
        .drop("_part")
        .withColumn("_fine_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    )
    waiting = (
        celled.where(coarse & F.col("_ts").isNotNull())
        .withColumn("_salt", salt)
        .withWatermark("_ts", delay)
    )
    unmatched = (
        waiting.join(
            seen,
            (F.col("_cell") == F.col("_fine_cell"))
            & (F.col("acq_date") == F.col("_fine_date"))
            & (F.col("_salt") == F.col("_fine_salt"))
            & F.col("_fine_ts").between(F.col("_ts") - F.expr("interval 1 day"), F.col("_ts") + F.expr("interval 1 day")),
            "left_outer",
        )
        .where("_fine_cell is null")
        .select(*detections.columns)
    )
    at_once = ~F.coalesce(coarse, F.lit(False)) | F.col("acq_ts").isNull()
    return detections.where(at_once).unionByName(unmatched)
