"""What the map shows: pruned, styled columns per layer."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions import tables
from emberline.functions.semantics import equal_lookup, plain_number, truthy_text
from emberline.operators.detections import marker_radius, visible
from emberline.operators.infrastructure import icon
from emberline.operators.perimeters import area_text


def hotspot_view(df: DataFrame, hidden: Iterable[str] = (), keep: Iterable[str] = ()) -> DataFrame:
    """Visible detections with marker colour, radius and popup texts."""
    power = F.col("frp")
    label = F.when(power != 0, F.concat(plain_number(power), F.lit(" MW"))).otherwise("N/A")
    return visible(df, hidden).select(
        *keep,
        "lon",
        "lat",
        "frp",
        F.when(power.isNull() | F.isnan(power), "N/A").otherwise(label).alias("frp_label"),
        "intensity",
        "source",
        "acq_datetime",
        "confidence",
        equal_lookup(F.col("intensity"), tables.INTENSITY_COLORS, tables.INTENSITY_COLORS["unknown"]).alias("color"),
        marker_radius("frp").alias("radius"),
    )


def fwi_view(df: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """Cells with marker colour and popup columns."""
    return df.select(
        *keep, "lon", "lat", "fwi", "risk_class", "risk_label", "temp_c", "rh_pct", "wind_kmh", "trend",
        equal_lookup(F.col("risk_class"), tables.FWI_MAP_COLORS, tables.FWI_MAP_COLORS["unknown"]).alias("color"),
    )


def perimeter_view(df: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """Perimeters with popup columns."""
    return df.select(
        *keep, "geometry", "name", area_text(F.col("hectares")).alias("area"), "country",
        F.coalesce(truthy_text(F.col("date_updated")), F.lit("N/A")).alias("updated"), "source",
    )


def infrastructure_view(df: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """Elements with icon and popup columns."""
    return df.select(*keep, "lon", "lat", "name", "type", "color", icon(F.col("type")).alias("icon"))


def place_label(name: Column, city: Column, country: Column) -> Column:
    """Non-empty parts of a place, comma separated."""
    return F.concat_ws(", ", *[F.nullif(part, F.lit("")) for part in (name, city, country)])


def leading_parts(display_name: Column, n: int) -> Column:
    """The first ``n`` comma-separated parts of a long place name."""
    return F.array_join(F.slice(F.split(display_name, ","), 1, n), ",")
