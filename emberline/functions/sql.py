"""The row functions as Spark SQL functions, for use from plain SQL. Spark inlines them into the query."""

from __future__ import annotations

from pyspark.sql import SparkSession

from emberline.functions import fire_weather as fw
from emberline.functions import tables
from emberline.functions.semantics import range_case

FUNCTIONS = {
    "fire_intensity": (
        "frp double", "string", f"coalesce({range_case('frp', tables.INTENSITY_RANGES, 'extreme')}, 'unknown')"
    ),
    "marker_radius": ("frp double", "int", f"coalesce({range_case('frp', tables.MARKER_RADIUS, 13)}, 4)"),
    "fwi_class": ("value double", "string", fw.fwi_class("value")),
    "ffmc": (
        "temp double, rh double, wind double, rain double, previous double default 85",
        "double",
        fw.ffmc("temp", "rh", "wind", "rain", "previous"),
    ),
    "isi": ("wind double, code double", "double", fw.isi("wind", "code")),
    "bui": ("dmc double default 20, dc double default 200", "double", fw.bui("dmc", "dc")),
    "fwi": ("spread double, buildup double", "double", fw.fwi("spread", "buildup")),
    "fwi_from_weather": (
        "temp double, rh double, wind double, rain double",
        "double",
        "if({valid}, fwi(isi(wind, ffmc(temp, rh, wind, rain)), bui()), null)".format(
            valid=fw.weather_is_valid("rh", "wind", "rain")
        ),
    ),
}


def register(spark: SparkSession) -> list[str]:
    """Create the functions for this session and return their names."""
    for name, (parameters, returns, body) in FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {name}({parameters}) returns {returns} return {body}")
    return list(FUNCTIONS)
