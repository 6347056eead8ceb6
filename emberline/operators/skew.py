"""Anti join that stays balanced when a few keys hold most rows of the probed side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Keys of at least so many rows are decided apart from the others.
HOT_ROWS = 500_000
# The broadcast list never holds more keys than this, whatever the data. Keys beyond it are joined by
# shuffle like any other: each of them holds less than 1/MAX_HOT_KEYS of the rows.
MAX_HOT_KEYS = 10_000


def anti_join(
    probe: DataFrame,
    seen: DataFrame,
    keys: list[str],
    hot_rows: int = HOT_ROWS,
    max_hot_keys: int = MAX_HOT_KEYS,
) -> DataFrame:
    """Rows of ``probe`` whose ``keys`` are not in ``seen`` (whose rows are distinct).

    The keys with at least ``hot_rows`` rows are looked up in ``seen`` once per key.
    Their rows are then decided by a broadcast of that short list: covered ones go, the others get a
    spread column that matches nothing, so that they travel evenly instead of to one task. Rows with a
    null key match nothing either and spread the same way. The plan is the same at every size. (Adaptive
    skew handling would not do: it splits two plain shuffles, and the reduced side is an aggregate.)
    """
    heavy = (
        probe.groupBy(*keys)
        .agg(F.count("*").alias("_rows"))
        .where(F.col("_rows") >= hot_rows)
        .orderBy(F.desc("_rows"), *keys)
        .limit(max_hot_keys)
    )
    verdicts = heavy.join(seen.withColumn("_covered", F.lit(True)), keys, "left").select(
        *keys, F.coalesce("_covered", F.lit(False)).alias("_covered")
    )
    missing = F.lit(False)
    for key in keys:
        missing = missing | F.col(key).isNull()
    # Both sides join on a fingerprint of the keys as well. Rows that cannot match carry their row number
    # instead, which sends each of them somewhere else; whatever it happens to equal, their keys do not match.
    fingerprint = F.xxhash64(*keys)
    decided = F.col("_covered").isNotNull() | missing
    routed = (
        probe.join(F.broadcast(verdicts), keys, "left")
        .where(~F.coalesce("_covered", F.lit(False)))
        .withColumn("_spread", F.when(decided, F.monotonically_increasing_id()).otherwise(fingerprint))
        .drop("_covered")
    )
    return routed.join(seen.withColumn("_spread", fingerprint), [*keys, "_spread"], "left_anti").drop("_spread")
