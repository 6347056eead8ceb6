"""Polygons and multipolygons as data: vertices, envelope, and selection by box."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How deep positions nest in the coordinates of each type.
DEPTHS = {"Point": 1, "LineString": 2, "MultiPoint": 2, "Polygon": 3, "MultiLineString": 3, "MultiPolygon": 4}


def vertices(geometry: Column) -> Column:
    """All positions of a shape (``type`` and raw JSON ``coordinates``), rings and parts in order; null for no shape.

    Positions that are not two or more numbers are left out; a type with other members than positions has none.
    """
    text, kind = geometry["coordinates"], geometry["type"]
    found = None
    for depth in (1, 2, 3, 4):
        nested = F.from_json(text, "array<" * depth + "double" + ">" * depth)
        flat = F.array(nested) if depth == 1 else nested
        for _ in range(depth - 2):
            flat = F.flatten(F.filter(flat, lambda part: part.isNotNull()))
        here = kind.isin(*[name for name, d in DEPTHS.items() if d == depth])
        found = F.when(here, flat) if found is None else found.when(here, flat)
    sound = lambda p: F.coalesce((F.size(p) >= 2) & F.get(p, F.lit(0)).isNotNull() & F.get(p, F.lit(1)).isNotNull(), F.lit(False))
    return F.filter(found, sound)


def with_envelope(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    """``df`` with ``n_vertices`` (0 for no shape) and the bounds ``west``, ``south``, ``east``, ``north`` of each shape.

    The text of the coordinates is parsed once per row and stays as it is.
    """
    placed = df.withColumn("_positions", vertices(F.col(geometry)))
    axis = lambda i: F.transform("_positions", lambda p: p[i])
    bounds = {"west": F.array_min(axis(0)), "south": F.array_min(axis(1)), "east": F.array_max(axis(0)), "north": F.array_max(axis(1))}
    sized = placed.withColumns({"n_vertices": F.greatest(F.size(F.coalesce("_positions", F.array().cast("array<array<double>>"))), F.lit(0)).cast("bigint"), **bounds})
    return sized.drop("_positions")


def touching_bbox(df: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """Rows whose envelope meets the box, bounds included. On a written table plain comparisons skip row groups."""
    return df.where((F.col("west") <= east) & (F.col("east") >= west) & (F.col("south") <= north) & (F.col("north") >= south))
