"""Weather grid and fire danger: grid, lookup join, current index, forecast, trend and layers."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions import tables
from emberline.functions.fire_weather import fwi_class, fwi_color, fwi_label, fwi_over_days, weather_is_valid, with_fwi
from emberline.functions.semantics import cell_id, equal_lookup, literal
from emberline.schemas import FORECAST

# Forecast day (from 0) that decides the trend.
TREND_DAY = 3


def grid_size(bounds: tuple[float, float], step: float) -> int:
    low, high = bounds
    return max(0, math.floor((high - low) / step + 1e-9) + 1)


def grid_points(
    spark: SparkSession,
    lat: tuple[float, float] = tables.GRID_LAT,
    lon: tuple[float, float] = tables.GRID_LON,
    step: float = tables.GRID_STEP,
) -> DataFrame:
    """Sampling grid, upper bounds included, to one decimal; ``cell_no`` runs latitude first."""
    columns = grid_size(lon, step)
    number = F.col("id")
    return spark.range(grid_size(lat, step) * columns).select(
        number.alias("cell_no"),
        F.round(F.lit(float(lat[0])) + F.floor(number / F.lit(columns)) * float(step), 1).alias("lat"),
        F.round(F.lit(float(lon[0])) + (number % columns) * float(step), 1).alias("lon"),
    )


def join_grid_weather(grid: DataFrame, weather: DataFrame, id_column: str) -> DataFrame:
    """Every grid cell with its newest weather record (highest ``id_column``) and the number of records.

    Cells without weather stay, with ``n_records`` 0 and null readings. Cells are matched on whole
    tenths of a degree. Weather is reduced to one row per cell before its shuffle and the join, so a cell that
    holds a large share of the records costs no more than any other. ``id_column`` is unique; each reading is
    picked by it on its own, so that fixed-width readings are aggregated by hash.
    """
    key = cell_id(F.col("lon"), F.col("lat"), 10)
    keyed_grid = grid.withColumn("_cell", key)
    records = weather.withColumn("_cell", key)
    rest = [c for c in weather.columns if c not in ("lat", "lon", id_column)]
    newest = records.groupBy("_cell").agg(
        F.max(id_column).alias(id_column), *[F.max_by(c, id_column).alias(c) for c in rest], F.count("*").alias("n_records")
    )
    return (
        keyed_grid.join(newest, "_cell", "left")
        .select(*grid.columns, F.coalesce("n_records", F.lit(0)).alias("n_records"), id_column, *rest)
    )


def split_missing(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Responses with current readings, and those without (the errors)."""
    return responses.where("current is not null"), responses.where("current is null")


def flatten_responses(responses: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """Landed weather responses to flat readings with defaults, plus the ``days`` array of the forecast."""
    current = {
        "temp_c": "temperature_2m",
        "rh_pct": "relative_humidity_2m",
        "wind_kmh": "wind_speed_10m",
        "wind_dir_deg": "wind_direction_10m",
        "rain_mm": "precipitation",
    }
    readings = [f"coalesce(current.{field}, {literal(tables.WEATHER_DEFAULTS[name])}) as {name}" for name, field in current.items()]
    # The maximum temperatures decide how many days there are; shorter arrays read as null beyond their end.
    days = (
        "transform(daily.temperature_2m_max, (temp, i) -> struct(get(daily.time, i) as time, temp as temp,"
        " get(daily.relative_humidity_2m_min, i) as rh, get(daily.wind_speed_10m_max, i) as wind,"
        " get(daily.precipitation_sum, i) as rain)) as days"
    )
    return responses.selectExpr(*keep, "lat", "lon", *readings, "fetched_at", days)


def split_rejected(weather: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Readings the equations are defined for, and the rest."""
    valid = f"coalesce({weather_is_valid('rh_pct', 'wind_kmh', 'rain_mm')}, false)"
    return weather.where(valid), weather.where(f"not {valid}")


def with_risk(df: DataFrame) -> DataFrame:
    """Append class, label and colour of ``fwi``."""
    return df.selectExpr(
        "*",
        f"{fwi_class('fwi')} as risk_class",
        f"{fwi_label('fwi')} as risk_label",
        f"{fwi_color('fwi')} as risk_color",
    )


def _day_readings(day: str) -> str:
    """One forecast day; missing and zero readings fall back to the current ones, rain to none."""
    return (
        f"struct(coalesce({day}.time, '') as date, coalesce(nullif({day}.temp, 0D), temp_c) as temp_max,"
        f" coalesce(nullif({day}.rh, 0D), rh_pct) as rh_min, coalesce(nullif({day}.wind, 0D), wind_kmh) as wind_max,"
        f" coalesce(nullif({day}.rain, 0D), 0D) as rain)"
    )


def with_forecast(weather: DataFrame) -> DataFrame:
    """Replace ``days`` by ``forecast``: one struct per day with index, class, label and colour.

    The index is computed inside the array, so a cell and its days never part and no shuffle is needed
    to bring them together again.
    """
    readings = f"transform(days, x -> {_day_readings('x')})"
    scored = fwi_over_days(readings, "temp_max", "rh_min", "wind_max", "rain")
    forecast = (
        f"transform({scored}, d -> struct(d.day.date as date, d.fwi as fwi, {fwi_class('d.fwi')} as risk_class,"
        f" {fwi_label('d.fwi')} as risk_label, {fwi_color('d.fwi')} as color, d.day.temp_max as temp_max,"
        f" d.day.rh_min as rh_min, d.day.wind_max as wind_max, d.day.rain as rain))"
    )
    return weather.withColumn("forecast", F.coalesce(F.expr(forecast), F.array().cast(FORECAST))).drop("days")


def forecast_days(weather: DataFrame, keep: Iterable[str] = ("lat", "lon")) -> DataFrame:
    """One row per cell and forecast day (``day_i`` from 0), index computed on the long table.

    The outer form of the explode keeps Spark from filtering on the array's size first, which would build
    every array twice; cells without a forecast go right after.
    """
    keep = list(keep)
    rows = (
        weather.select(*keep, "temp_c", "rh_pct", "wind_kmh", F.posexplode_outer("days").alias("day_i", "_day"))
        .where("day_i is not null")
        .selectExpr(*keep, "day_i", f"{_day_readings('_day')} as _r")
        .select(*keep, "day_i", "_r.*")
    )
    return with_risk(with_fwi(rows, "temp_max", "rh_min", "wind_max", "rain"))


def _trend(later: str, now: str) -> str:
    return f"case when {later} > {now} * 1.2D then 'escalating' when {later} < {now} * 0.8D then 'de-escalating' else 'steady' end"


def with_trend(df: DataFrame) -> DataFrame:
    """Append ``trend``: the index on the fourth forecast day against the current one."""
    return df.selectExpr("*", f"{_trend(f'get(forecast, {TREND_DAY}).fwi', 'fwi')} as trend")


def fwi_summary(weather: DataFrame) -> DataFrame:
    """Current index, class and trend per cell, for views that do not show the forecast.

    Only the one forecast day that decides the trend is scored.
    """
    day = f"get(transform(slice(days, {TREND_DAY + 1}, 1), x -> {_day_readings('x')}), 0) as _day"
    at_day = with_fwi(weather).selectExpr("*", day).select("*", "_day.*")
    scored = with_fwi(at_day, "temp_max", "rh_min", "wind_max", "rain", name="_later")
    trended = scored.selectExpr("*", f"{_trend('_later', 'fwi')} as trend")
    return with_risk(trended.drop("_day", "_later", "date", "temp_max", "rh_min", "wind_max", "rain", "days"))


def weather_layer(weather: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """Current conditions per cell."""
    return weather.select(*keep, "lon", "lat", "temp_c", "rh_pct", "wind_kmh", "wind_dir_deg", "rain_mm", "fetched_at")


def fwi_layer(weather: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """Fire danger per cell: readings, current index and class, trend and forecast."""
    scored = with_trend(with_forecast(with_risk(with_fwi(weather))))
    return scored.select(
        *keep, "lon", "lat", "temp_c", "rh_pct", "wind_kmh", "wind_dir_deg", "rain_mm", "fwi", "risk_class",
        "risk_label", "risk_color", "trend", "forecast", "fetched_at",
    )


def max_fwi_zone(layer: DataFrame, id_column: str) -> DataFrame:
    """The cell with the highest index above 0, ties to the lowest id, as the panel shows it."""
    # The filter comes after the limit: before it, it would pull the whole index formula into the scan's filter.
    top = layer.orderBy(F.desc_nulls_last("fwi"), id_column).limit(1).where("fwi > 0")
    return top.select(
        id_column,
        "lat",
        "lon",
        "fwi",
        "risk_class",
        equal_lookup(F.col("risk_class"), tables.FWI_PANEL_LABELS, "UNKNOWN").alias("panel_label"),
        equal_lookup(F.col("risk_class"), tables.FWI_PANEL_COLORS, "#ffffff").alias("panel_color"),
    )
