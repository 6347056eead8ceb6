"""Selections by place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def within_bbox(df: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """Rows inside the box, bounds included. Tables sorted by cell skip the row groups outside."""
    return df.where(F.col("lat").between(south, north) & F.col("lon").between(west, east))


def morton_order(lon: str, lat: str) -> Column:
    """Sort key by which places near each other in both directions come near each other: bits of both in turn.

    Both coordinates are cut to 16 bits over the world, half a hundredth of a degree and less; beyond it they count as
    its edge; places without coordinates come first.
    """

    def spread(name: str, low: float, span: float) -> str:
        text = f"cast(least(greatest(({name} - {low}D) / {span}D * 65535D, 0D), 65535D) as int)"
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            text = f"(({text} | shiftleft({text}, {shift})) & {mask})"
        return f"cast({text} as bigint)"

    x, y = spread(lon, -180.0, 360.0), spread(lat, -90.0, 180.0)
    return F.expr(f"if({lon} is null or {lat} is null or isnan({lon}) or isnan({lat}), null, {x} | shiftleft({y}, 1))")
