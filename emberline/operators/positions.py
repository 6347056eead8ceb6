"""Global row positions without a single-task sort, and the display decimation built on them."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS_PER_RANGE = 250_000
MIN_RANGES, MAX_RANGES = 8, 10_000
# Doubles name every whole number up to here; beyond it one double may stand for several order values.
_EXACT = 2.0**53


def _number(df: DataFrame, name: str) -> Column | None:
    """Column ``name`` as a double in its own order, or null where its type has none."""
    dtype, value = df.schema[name].dataType, F.col(name)
    if isinstance(dtype, T.TimestampType):
        value = F.unix_micros(value)
    elif isinstance(dtype, T.TimestampNTZType):
        value = F.unix_micros(value.cast("timestamp"))
    elif isinstance(dtype, T.DateType):
        value = F.unix_date(value)
    elif not isinstance(dtype, T.NumericType):
        return None
    return value.cast("double") + 0.0  # -0.0 becomes 0.0


def _cuts(keyed: DataFrame, column: str, n: int) -> list[float]:
    """Quantiles that cut the finite values of ``column`` into about ``n`` ranges, ascending, hot values repeated."""
    found = keyed.where(F.abs(column) < float("inf")).approxQuantile(column, [i / n for i in range(1, n)], 1.0 / (4 * n)) if n > 1 else []
    return sorted(found)


def _range_number(keyed: DataFrame, column: str, cuts: list[float], name: str) -> DataFrame:
    """Number of the range that holds each value: nulls before all others, NaN behind them, as in an ascending sort."""
    if not cuts:
        nan = F.when(F.isnan(column), 1).otherwise(0)
        return keyed.withColumn(name, F.when(F.col(column).isNull(), -1).otherwise(nan))
    splits = [float("-inf"), *cuts, float("inf")]
    binned = Bucketizer(splits=splits, inputCol=column, outputCol=name, handleInvalid="keep").transform(keyed)
    return binned.withColumn(name, F.coalesce(F.col(name).cast("int"), F.lit(-1)))


def with_position(df: DataFrame, order_by: str, *ties: str, buckets: int | None = None, name: str = "position") -> DataFrame:
    """Append the 0-based position of each row in the order of ``order_by`` (then ``ties``), ascending, nulls first.

    Rows are cut into ranges of about ``ROWS_PER_RANGE`` rows at quantiles of ``order_by``; each range is numbered
    on its own and shifted by the rows in the ranges before it. A value that spans several quantiles gets a range
    of its own, which like those of null and NaN is cut further at quantiles of the first tie, where that is a
    number or a time. The quantiles only balance the work: any cut gives the same positions. The shifts are one
    row per range.
    """
    lead = _number(df, order_by)
    if lead is None:
        raise TypeError(f"order_by must be numeric, a date or a timestamp, not {df.schema[order_by].dataType.simpleString()}")
    keyed = df.withColumn("_lead", lead)
    n = buckets or min(MAX_RANGES, max(MIN_RANGES, -(-keyed.count() // ROWS_PER_RANGE)))
    cuts = _cuts(keyed, "_lead", n)
    exact = not isinstance(df.schema[order_by].dataType, T.DecimalType)
    hot = sorted({v for v, after in zip(cuts, cuts[1:]) if exact and v == after and abs(v) < _EXACT})
    splits = sorted({*cuts, *(math.nextafter(v, math.inf) for v in hot)})
    keyed = _range_number(keyed, "_lead", splits, "_range")
    tie = _number(df, ties[0]) if ties else None
    if tie is None:
        keyed = keyed.withColumn("_part", F.lit(0))
    else:
        same = F.col("_lead").isNull() | F.isnan("_lead")
        if hot:
            same = same | F.col("_lead").isin(hot)
        keyed = keyed.withColumn("_tie", F.when(same, tie))
        keyed = _range_number(keyed, "_tie", sorted(set(_cuts(keyed, "_tie", n))), "_part")

    shifts = (
        keyed.groupBy("_range", "_part")
        .agg(F.count("*").alias("_n"))
        .select("_range", "_part", F.coalesce(F.sum("_n").over(Window.orderBy("_range", "_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_shift"))
    )
    inside = Window.partitionBy("_range", "_part").orderBy(order_by, *ties)
    return (
        keyed.withColumn("_row", F.row_number().over(inside) - 1)
        .join(shifts, ["_range", "_part"])
        .withColumn(name, F.col("_row") + F.col("_shift"))
        .select(*df.columns, name)
    )


def decimate(df: DataFrame, order_by: str, *ties: str, buckets: int | None = None) -> DataFrame:
    """Thin a hotspot view by position: every strong detection, each 3rd moderate, each 8th other."""
    strength, at = F.col("intensity"), F.col("_position")
    kept = (
        strength.isin("extreme", "high")
        | ((strength == "moderate") & (at % 3 == 0))
        | (~strength.isin("extreme", "high", "moderate") & (at % 8 == 0))
    )
    return with_position(df, order_by, *ties, buckets=buckets, name="_position").where(kept).drop("_position")
