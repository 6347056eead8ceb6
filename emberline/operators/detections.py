"""Satellite fire detections: normalisation, filters, cross-sensor dedup and counts."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline.functions import tables
from emberline.functions.semantics import cell_id, equal_lookup, number_or_null, range_case, utc_literal, utc_naive
from emberline.operators import cells
from emberline.operators.skew import anti_join


def intensity(frp: str) -> Column:
    """Intensity class of a radiative power (SQL text); null (missing or unparseable) is ``unknown``."""
    return F.expr(f"coalesce({range_case(frp, tables.INTENSITY_RANGES, 'extreme')}, 'unknown')")


def marker_radius(frp: str) -> Column:
    """Marker size of a radiative power (SQL text); a missing power counts as the smallest."""
    return F.expr(f"coalesce({range_case(frp, tables.MARKER_RADIUS, 13)}, 4)")


def acquisition_text(date: str, time: str) -> Column:
    """``date HH:MMZ``, or the date alone without a time. Unpadded times are cut as they come."""
    clock = f"concat({date}, ' ', substring({time}, 1, 2), ':', substring({time}, 3), 'Z')"
    return F.expr(f"if({time} <> '', {clock}, {date})")


def acquisition_time(date: str, time: str) -> Column:
    """Typed acquisition time (UTC, zone-free); pads short times, null when it does not parse."""
    padded = f"lpad({time}, 4, '0')"
    return F.expr(f"try_cast(concat({date}, ' ', substring({padded}, 1, 2), ':', substring({padded}, 3, 2), ':00') as timestamp_ntz)")


def _number(df: DataFrame, name: str) -> Column:
    if isinstance(df.schema[name].dataType, T.StringType):
        return number_or_null(F.col(name))
    return F.col(name).cast("double")


def normalize(raw: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """Raw detections to the hotspot layer. Rows of unregistered feeds or without coordinates are left out.

    ``keep`` names raw columns (an id, say) to carry along.
    """
    labels = {name: label for name, label, _ in tables.SENSORS}
    metres = {name: resolution for name, _, resolution in tables.SENSORS}
    feed = F.col("source_name")
    return (
        raw.where(feed.isin(*labels))
        .select(
            *keep,
            _number(raw, "longitude").alias("lon"),
            _number(raw, "latitude").alias("lat"),
            equal_lookup(feed, labels, None).alias("source"),
            equal_lookup(feed, metres, None).alias("resolution_m"),
            _number(raw, "frp").alias("frp"),
            F.expr("coalesce(confidence, 'n') as confidence"),
            F.expr("coalesce(acq_date, '') as _date"),
            F.expr("coalesce(acq_time, '') as _time"),
            F.expr("if(coalesce(daynight, 'D') = 'D', 'Day', 'Night') as daynight"),
        )
        .where("lat is not null and lon is not null")
        .select(
            *keep,
            "lon",
            "lat",
            "source",
            "resolution_m",
            "frp",
            intensity("frp").alias("intensity"),
            "confidence",
            acquisition_text("_date", "_time").alias("acq_datetime"),
            "daynight",
            F.expr("try_cast(_date as date) as acq_date"),
            acquisition_time("_date", "_time").alias("acq_ts"),
        )
    )


def union_sensors(*frames: DataFrame) -> DataFrame:
    """All detections of several feeds; columns are matched by name."""
    head, *rest = frames
    for frame in rest:
        head = head.unionByName(frame)
    return head


def lookback(df: DataFrame, as_of: dt.datetime, days: int = 1) -> DataFrame:
    """Detections of the last ``days`` days (1 to 10) before ``as_of`` (UTC).

    The date bound is implied by the time bound; it is there so that a table partitioned by
    ``acq_date`` only opens the days it needs.
    """
    if not 1 <= days <= 10:
        raise ValueError("days must lie between 1 and 10")
    until = utc_naive(as_of)
    since = until - dt.timedelta(days=days)
    return df.where(
        F.col("acq_date").between(F.lit(since.date()), F.lit(until.date()))
        & (F.col("acq_ts") > utc_literal(since))
        & (F.col("acq_ts") <= utc_literal(until))
    )


def dedup_cross_sensor(
    df: DataFrame,
    keep: str = "VIIRS",
    drop: str = "MODIS",
    per_degree: int = 100,
    scope: str = "batch",
    **skew,
) -> DataFrame:
    """Drop detections of the coarse sensor in every cell the fine sensor has seen.

    Fine detections are all kept and nothing is compared within a sensor. ``scope="day"`` compares only
    detections of one day, for archives that hold many; ``"batch"`` compares the whole input.
    Only the coarse branch is joined: the others pass without a shuffle.
    """
    if scope not in ("batch", "day"):
        raise ValueError("scope must be 'batch' or 'day'")
    keys = ["_cell"] if scope == "batch" else ["_cell", "acq_date"]
    celled = df.withColumn("_cell", cell_id(F.col("lon"), F.col("lat"), per_degree))
    coarse = celled.where(F.col("source").contains(drop))
    seen = celled.where(F.col("source").contains(keep)).select(*keys).distinct()
    others = df.where(~F.coalesce(F.col("source").contains(drop), F.lit(False)))
    return others.unionByName(anti_join(coarse, seen, keys, **skew).select(*df.columns))


def dedup_by_tiles(df: DataFrame, keep: str = "VIIRS", drop: str = "MODIS", per_degree: int = 100, scope: str = "batch", **hot) -> DataFrame:
    """The rows of :func:`dedup_cross_sensor` with what the fine sensor has seen as bitmaps.

    For archives: a tile's cells are one row of 4 KB, however many detections there are, where the other way moves
    every distinct cell. For a few cells scattered over the world the distinct cells are smaller.
    """
    if scope not in ("batch", "day"):
        raise ValueError("scope must be 'batch' or 'day'")
    by = [] if scope == "batch" else ["acq_date"]
    number = cells.cell_number(F.col("lon"), F.col("lat"), per_degree)
    seen = cells.cell_sets(df.where(F.col("source").contains(keep)), number, by)
    others = df.where(~F.coalesce(F.col("source").contains(drop), F.lit(False)))
    return others.unionByName(cells.outside(df.where(F.col("source").contains(drop)), number, seen, by, **hot))


def count_by(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, sorted by value."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(column)


def visible(df: DataFrame, hidden: Iterable[str] = ()) -> DataFrame:
    """Everything but the intensities switched off; ``unknown`` cannot be switched off."""
    hidden = [name for name in hidden if name != "unknown"]
    return df.where(~F.col("intensity").isin(hidden)) if hidden else df
