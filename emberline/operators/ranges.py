"""Lookup of values in a table of ranges of any number and width, by bins of the ranges' own sizes.

A range is given to the bins it touches at its own level, where a bin is as wide as the range or up to twice that: two
or three bins, whatever its width. A value has one bin at each level that occurs (a few dozen; there are no more levels
than exponents of a number). Both meet in an equi-join on level and bin, in which Spark can split a bin that many
values share, and the bounds decide. No pair of a value and a far range is ever made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.operators.positions import with_position

UNBOUNDED = 5000  # level of ranges without an end: one bin for all


def _bin(value: Column, level: Column) -> Column:
    return F.when(level == UNBOUNDED, F.lit(0).cast("bigint")).otherwise(F.floor(value / F.pow(F.lit(2.0), level)))


def _sound(ranges: DataFrame, low: str, high: str) -> DataFrame:
    return ranges.where((F.col(low) < F.col(high)) & ~F.isnan(high))


def matches(values: DataFrame, ranges: DataFrame, value: str, low: str = "low", high: str = "high") -> DataFrame:
    """Every row of ``values`` with every range ``[low, high)`` that holds its ``value``; their columns differ by name.

    A null bound, or a low that is not below its high, makes a range that holds nothing; a null or NaN value is in none.
    """
    wide = F.col(high) - F.col(low)
    level = F.when(wide < 2.0**1000, F.greatest(F.ceil(F.log2(wide)), F.lit(-1000))).otherwise(UNBOUNDED).cast("int")
    levelled = _sound(ranges, low, high).withColumn("_level", level)
    levels = sorted(row["_level"] for row in levelled.select("_level").distinct().collect())  # bounded by the exponents
    binned = levelled.withColumn("_bin", F.explode(F.sequence(_bin(F.col(low), F.col("_level")), _bin(F.col(high), F.col("_level")))))
    asked = values.where(F.col(value).isNotNull() & ~F.isnan(value)).withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    asked = asked.withColumn("_bin", _bin(F.col(value), F.col("_level")))
    met = asked.join(binned, ["_level", "_bin"])
    return met.where((F.col(value) >= F.col(low)) & (F.col(value) < F.col(high))).drop("_level", "_bin")


def firsts(ranges: DataFrame, order: str, low: str = "low", high: str = "high") -> DataFrame:
    """Disjoint ranges ``[_from, _to)``, at most one between two neighbouring bounds, with the first of ``ranges`` by ``order`` as ``_first``.

    A range becomes at most two nodes per level of the tree. They are handed down in two steps, each of which turns
    a node into about the square root of the bounds at most, so no row or group grows with all of them.
    """
    told = F.struct(order, *(name for name in ranges.columns if name != order))
    apart = _sound(ranges, low, high).groupBy(F.col(low).alias("_from"), F.col(high).alias("_to")).agg(F.min(told).alias("_first"))
    bounds = apart.select(F.col("_from").alias("_bound")).union(apart.select("_to")).distinct()
    bounds = with_position(bounds, "_bound", name="_at")
    levels = bounds.count().bit_length()
    numbered = lambda bound, at, shift=0: bounds.select(F.col("_bound").alias(bound), (F.col("_at") - shift).cast("bigint").alias(at))
    placed = apart.join(numbered("_from", "_l"), "_from").join(numbered("_to", "_r"), "_to")
    placed = placed.select("_l", "_r", "_first", F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("_level"))
    placed = placed.selectExpr("_first", "_level", "shiftright(_l + shiftleft(1L, _level) - 1, _level) as _l", "shiftright(_r, _level) as _r").where("_l < _r")
    nodes = placed.select("_level", F.explode(F.expr("array_compact(array(if(_l % 2 = 1, _l, null), if(_r % 2 = 1, _r - 1, null)))")).alias("_node"), "_first")
    for level in ((levels + 1) // 2, 0):
        nodes = nodes.groupBy("_level", "_node").agg(F.min("_first").alias("_first")).withColumn("_down", F.greatest(F.col("_level") - level, F.lit(0)))
        below = F.expr("explode(sequence(shiftleft(_node, _down), shiftleft(_node + 1, _down) - 1))")
        nodes = nodes.select(F.least("_level", F.lit(level)).alias("_level"), below.alias("_node"), "_first")
    held = nodes.groupBy("_node").agg(F.min("_first").alias("_first"))
    return held.join(numbered("_from", "_node"), "_node").join(numbered("_to", "_node", 1), "_node").select("_from", "_to", "_first")


def first_match(values: DataFrame, ranges: DataFrame, id_: str, value: str, order: str, low: str = "low", high: str = "high") -> DataFrame:
    """All rows of ``values`` with the columns of the first range by ``order`` that holds their value, null for none.

    ``id_`` tells the rows apart, ``order`` the ranges. A value meets the few disjoint ranges near it, however many
    of ``ranges`` hold it.
    """
    found = matches(values.select(id_, F.col(value).alias("_value")), firsts(ranges, order, low, high), "_value", "_from", "_to")
    best = found.groupBy(id_).agg(F.min("_first").alias("_first"))
    return values.join(best, id_, "left").select(*values.columns, *[F.col(f"_first.{name}").alias(name) for name in ranges.columns])
