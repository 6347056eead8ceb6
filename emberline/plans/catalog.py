"""Every query over the driver's tables, by name."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions import tables
from emberline.functions.fire_weather import with_fwi
from emberline.operators import detections as det
from emberline.operators import infrastructure as infra
from emberline.operators import perimeters as per
from emberline.operators import positions, ranges, shapes, status, summaries, views
from emberline.operators import weather as wx
from emberline.operators.space import within_bbox
from emberline.plans import standins
from emberline.schemas import MEXICO_JSON_FEATURE, USA_FEATURE, WEATHER_ITEM, feature_schema
from emberline.sinks.geojson import feature_text
from emberline.sources.documents import parsed
from emberline.sources.layers import flat

AS_OF = dt.datetime(2024, 1, 31)
GENERATED_AT = "2024-01-31T00:00:00+00:00"
VIEW_BOUNDS = {"west": -110.00004, "south": 18.0, "east": -95.0, "north": 28.00004}
VIEW_ZOOM = 8


def _hotspots(spark: SparkSession, sf: str) -> DataFrame:
    return det.normalize(standins.detections(spark, sf), keep=["event_id"])


def _deduped(spark: SparkSession, sf: str) -> DataFrame:
    return det.dedup_cross_sensor(_hotspots(spark, sf))


def _readings(spark: SparkSession, sf: str) -> DataFrame:
    return wx.flatten_responses(standins.weather_responses(spark, sf, spread=True), keep=["point_id"])


def _trended(spark: SparkSession, sf: str) -> DataFrame:
    return wx.fwi_summary(_readings(spark, sf))


def _perimeters(spark: SparkSession, sf: str) -> DataFrame:
    usa = per.normalize_usa(standins.usa_features(spark, sf), keep=["id"])
    mexico = per.normalize_mexico(standins.mexico_features(spark, sf), keep=["id"])
    return per.unify(usa, mexico)


def _infrastructure(spark: SparkSession, sf: str) -> DataFrame:
    return infra.normalize(standins.osm_elements(spark, sf))


def _status(spark: SparkSession, sf: str) -> DataFrame:
    return status.last_good(standins.layer_attempts(spark, sf), AS_OF)


def hotspot_normalize(spark: SparkSession, sf: str) -> DataFrame:
    raw = standins.detections(spark, sf)
    feeds = [det.normalize(raw.where(F.col("source_name") == name), keep=["event_id"]) for name, _, _ in tables.SENSORS]
    return det.union_sensors(*feeds).drop("acq_date", "acq_ts")


def hotspot_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return _deduped(spark, sf).select("event_id", "lon", "lat", "source", "frp", "intensity")


def hotspot_dedup_daily(spark: SparkSession, sf: str) -> DataFrame:
    deduped = det.dedup_cross_sensor(_hotspots(spark, sf), scope="day")
    return deduped.select("event_id", "source", "acq_datetime")


def hotspot_dedup_tiles(spark: SparkSession, sf: str) -> DataFrame:
    """The same detections as ``hotspot_dedup``, by bitmaps of the cells seen."""
    return det.dedup_by_tiles(_hotspots(spark, sf)).select("event_id", "lon", "lat", "source", "frp", "intensity")


def hotspot_dedup_tiles_daily(spark: SparkSession, sf: str) -> DataFrame:
    return det.dedup_by_tiles(_hotspots(spark, sf), scope="day").select("event_id", "source", "acq_datetime")


def frp_band_rangejoin(spark: SparkSession, sf: str) -> DataFrame:
    """Each detection with the first of the power bands that holds its power; bands overlap and leave gaps."""
    bands = standins.power_bands(spark, sf)
    return ranges.first_match(_hotspots(spark, sf).select("event_id", "frp"), bands, "event_id", "frp", "band")


def hotspot_by_intensity(spark: SparkSession, sf: str) -> DataFrame:
    return det.count_by(_deduped(spark, sf), "intensity")


def hotspot_lookback(spark: SparkSession, sf: str) -> DataFrame:
    recent = det.lookback(_hotspots(spark, sf), AS_OF, days=1)
    return recent.select("event_id", "source", "intensity", "acq_datetime")


def hotspot_world(spark: SparkSession, sf: str) -> DataFrame:
    """Detections inside the world box, per source."""
    world = within_bbox(_hotspots(spark, sf), -180.0, -90.0, 180.0, 90.0)
    return det.count_by(world, "source")


def hotspot_map_view(spark: SparkSession, sf: str) -> DataFrame:
    return views.hotspot_view(_hotspots(spark, sf), hidden=["low"], keep=["event_id"])


def hotspot_decimate(spark: SparkSession, sf: str) -> DataFrame:
    shown = det.visible(_hotspots(spark, sf), hidden=["low"])
    return positions.decimate(shown, "event_id").select("event_id", "lon", "lat", "intensity")


def fwi_components(spark: SparkSession, sf: str) -> DataFrame:
    scored = with_fwi(_readings(spark, sf), keep_components=True)
    return scored.select("point_id", *[F.round(c, 3).alias(c) for c in ("ffmc", "isi", "bui")], "fwi")


def fwi_now(spark: SparkSession, sf: str) -> DataFrame:
    return wx.with_risk(with_fwi(_readings(spark, sf))).select(
        "point_id", "lat", "lon", "fwi", "risk_class", "risk_label", "risk_color"
    )


def fwi_class_rangejoin(spark: SparkSession, sf: str) -> DataFrame:
    scored = wx.with_risk(with_fwi(_readings(spark, sf)))
    return scored.groupBy("risk_class", "risk_label", "risk_color").agg(
        F.count("*").alias("n"), F.min("fwi").alias("lowest"), F.max("fwi").alias("highest")
    )


def fwi_forecast(spark: SparkSession, sf: str) -> DataFrame:
    days = wx.forecast_days(_readings(spark, sf), keep=["point_id"])
    return days.withColumnRenamed("risk_color", "color")


def fwi_trend(spark: SparkSession, sf: str) -> DataFrame:
    readings = _readings(spark, sf).withColumn("n_days", F.size("days").cast("bigint"))
    return wx.fwi_summary(readings).select("point_id", "fwi", "n_days", "trend")


def fwi_layer(spark: SparkSession, sf: str) -> DataFrame:
    text = F.array_join(
        F.transform(
            "forecast",
            lambda d: F.concat_ws(":", d["date"], d["fwi"], d["risk_class"], d["temp_max"], d["rh_min"], d["wind_max"], d["rain"]),
        ),
        "|",
    )
    return wx.fwi_layer(_readings(spark, sf), keep=["point_id"]).withColumn("forecast", text)


def fwi_rejected(spark: SparkSession, sf: str) -> DataFrame:
    """Readings the equations are not defined for: here the stand-ins with their rain turned negative at times."""
    readings = _readings(spark, sf).withColumn(
        "rain_mm", F.when(F.col("point_id") % 7 == 0, -1.0).otherwise(F.col("rain_mm"))
    )
    accepted, rejected = wx.split_rejected(readings)

    def counted(df: DataFrame, outcome: str) -> DataFrame:
        return df.agg(F.count("*").alias("n")).select(F.lit(outcome).alias("outcome"), "n")

    return counted(accepted, "accepted").unionByName(counted(rejected, "rejected"))


def weather_layer(spark: SparkSession, sf: str) -> DataFrame:
    good, _ = wx.split_missing(standins.responses_with_gaps(spark, sf))
    return wx.weather_layer(wx.flatten_responses(good, keep=["point_id"]), keep=["point_id"])


def grid_points(spark: SparkSession, sf: str) -> DataFrame:
    """Grid cells with the number of weather records on each; cells with none are the misses."""
    joined = wx.join_grid_weather(wx.grid_points(spark), _readings(spark, sf).drop("days"), "point_id")
    return joined.select("cell_no", "lat", "lon", "n_records", (F.col("n_records") == 0).alias("missing"))


def grid_weather_join(spark: SparkSession, sf: str) -> DataFrame:
    fine = wx.grid_points(spark, step=0.1)
    joined = wx.join_grid_weather(fine, _readings(spark, sf).drop("days"), "point_id")
    return joined.where("n_records > 0").select(
        "cell_no", "lat", "lon", "n_records", "point_id", "temp_c", "rh_pct", "wind_kmh", "rain_mm"
    )


def fwi_map_view(spark: SparkSession, sf: str) -> DataFrame:
    return views.fwi_view(_trended(spark, sf), keep=["point_id"])


def max_fwi_zone(spark: SparkSession, sf: str) -> DataFrame:
    return wx.max_fwi_zone(wx.with_risk(with_fwi(_readings(spark, sf))), "point_id")


def prefire_summary(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.prefire_summary(_trended(spark, sf))


def perimeters_unified(spark: SparkSession, sf: str) -> DataFrame:
    return _perimeters(spark, sf).drop("geometry")


def _parsed_perimeters(spark: SparkSession, sf: str) -> DataFrame:
    usa = per.normalize_usa(parsed(standins.usa_lines(spark, sf), USA_FEATURE).rows, keep=["id"])
    mexico = per.normalize_mexico(parsed(standins.mexico_lines(spark, sf), MEXICO_JSON_FEATURE).rows, keep=["id"])
    return per.unify(usa, mexico)


def perimeter_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Both agencies' features from the JSON texts as they land: values typed, missing, empty and of the wrong kind."""
    return _parsed_perimeters(spark, sf).select(
        "id", "country", "name", "acres", "hectares", "date_created", "date_updated", "category", "state", "municipality",
        F.col("geometry.type").alias("shape"), F.col("geometry.coordinates").alias("coordinates"),
    )


def layer_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """The perimeter layer written as GeoJSON features and read back, with the envelope of each shape."""
    layer = _parsed_perimeters(spark, sf)
    lines = layer.select("id", feature_text(layer, "perimeters").alias("value"))
    back = flat(parsed(lines, feature_schema("perimeters")).rows, "perimeters", keep=["id"])
    return shapes.with_envelope(back).select(
        "id", "country", "name", "acres", "hectares", "date_updated", "state", F.col("geometry.type").alias("shape"),
        F.col("geometry.coordinates").alias("coordinates"), "n_vertices", "west", "south", "east", "north",
    )


def perimeter_in_view(spark: SparkSession, sf: str) -> DataFrame:
    """Perimeters whose envelope meets a box."""
    placed = shapes.with_envelope(_parsed_perimeters(spark, sf))
    return shapes.touching_bbox(placed, 40.0, -5.5, 50.0, 0.0).select("id", "country", "west", "south", "east", "north")


def weather_parse(spark: SparkSession, sf: str) -> DataFrame:
    """The weather layer from the JSON texts of the responses, some of them cut short or without current readings."""
    lines = standins.weather_lines(spark, sf)
    good, _ = wx.split_missing(parsed(lines, WEATHER_ITEM).rows)
    return wx.weather_layer(wx.flatten_responses(good, keep=["point_id"]), keep=["point_id"])


def perimeter_top200(spark: SparkSession, sf: str) -> DataFrame:
    usa = per.normalize_usa(standins.usa_features(spark, sf), keep=["id"])
    return per.top_perimeters(usa, "id").select("id", "name", "acres", "hectares")


def perimeter_first200(spark: SparkSession, sf: str) -> DataFrame:
    mexico = per.normalize_mexico(standins.mexico_features(spark, sf), keep=["id"])
    return per.first_perimeters(mexico, "id").select("id", "name", "acres", "hectares")


def perimeter_totals(spark: SparkSession, sf: str) -> DataFrame:
    return per.perimeter_totals(_perimeters(spark, sf))


def perimeter_by_country(spark: SparkSession, sf: str) -> DataFrame:
    return per.totals_by_country(_perimeters(spark, sf))


def perimeter_map_view(spark: SparkSession, sf: str) -> DataFrame:
    return views.perimeter_view(_perimeters(spark, sf), keep=["id"]).drop("geometry")


def largest_fire(spark: SparkSession, sf: str) -> DataFrame:
    top = per.largest_fire(_perimeters(spark, sf).drop("geometry"), "id", "country")
    return top.select("id", "name", "hectares", "acres", "country", "source")


def largest_fire_card(spark: SparkSession, sf: str) -> DataFrame:
    return per.fire_card(per.largest_fire(_perimeters(spark, sf), "id", "country"))


def infra_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return _infrastructure(spark, sf)


def infra_by_type(spark: SparkSession, sf: str) -> DataFrame:
    return infra.count_by_type(infra.normalize(infra.has_any_tag(standins.osm_elements(spark, sf))))


def infra_type_map(spark: SparkSession, sf: str) -> DataFrame:
    counts = infra.type_counts(_infrastructure(spark, sf))
    return counts.select("total", _entries_text(F.col("by_type")).alias("by_type"))


def infra_viewport(spark: SparkSession, sf: str) -> DataFrame:
    return infra.viewport(standins.osm_elements(spark, sf), VIEW_BOUNDS, VIEW_ZOOM, keep=["id"])


def infra_bbox(spark: SparkSession, sf: str) -> DataFrame:
    """Categorised elements inside the default region, bounds read from their text form."""
    region = within_bbox(
        infra.normalize(infra.has_any_tag(standins.osm_elements(spark, sf))), **infra.parse_bbox(tables.INFRA_BBOX)
    )
    return region.select("osm_id", "type", "lon", "lat")


def infra_map_view(spark: SparkSession, sf: str) -> DataFrame:
    return views.infrastructure_view(_infrastructure(spark, sf), keep=["osm_id"])


def active_fire_summary(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.active_fire_summary(_deduped(spark, sf), _perimeters(spark, sf), "id")


def active_fire_from_parts(spark: SparkSession, sf: str) -> DataFrame:
    """The same panel merged from the sums of each day's detections and each country's perimeters."""
    days = _deduped(spark, sf).groupBy("acq_date").agg(*summaries.detection_sums())
    countries = _perimeters(spark, sf).groupBy("country").agg(*summaries.perimeter_sums("id"))
    return summaries.active_fire_panel(summaries.merged_sums(days, countries))


def layer_last_good(spark: SparkSession, sf: str) -> DataFrame:
    return _status(spark, sf)


def layer_freshness(spark: SparkSession, sf: str) -> DataFrame:
    return status.freshness_panel(_status(spark, sf)).drop("place")


def layer_errors(spark: SparkSession, sf: str) -> DataFrame:
    return status.layer_errors(_status(spark, sf))


def layer_status_flags(spark: SparkSession, sf: str) -> DataFrame:
    return status.status_flags(_status(spark, sf))


def _entries_text(mapping) -> Column:
    return F.array_join(
        F.transform(F.map_entries(mapping), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), "|"
    )


def layer_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """Metadata of all layers in common columns."""
    hot = summaries.hotspot_metadata(_deduped(spark, sf), GENERATED_AT).select(
        F.lit("hotspots").alias("layer"), "generated_at", "source",
        F.col("total_hotspots").alias("total"), _entries_text(F.col("intensity_scale")).alias("details"),
    )
    weather = summaries.weather_metadata(standins.responses_with_gaps(spark, sf), GENERATED_AT).select(
        F.lit("weather").alias("layer"), "generated_at", "source",
        F.col("total_points").alias("total"), F.concat_ws("=", F.lit("errors"), F.col("errors").cast("string")).alias("details"),
    )
    fwi = summaries.fwi_metadata(standins.weather_responses(spark, sf), GENERATED_AT).select(
        F.lit("fwi").alias("layer"), "generated_at", "source", F.col("total_points").alias("total"),
        F.array_join(
            F.transform(F.map_entries("fwi_classes"), lambda e: F.concat_ws(":", e["key"], e["value"]["range"], e["value"]["color"])), "|"
        ).alias("details"),
    )
    fires = summaries.perimeter_metadata(_perimeters(spark, sf), GENERATED_AT).select(
        F.lit("perimeters").alias("layer"), "generated_at", F.concat_ws("; ", F.map_values("sources")).alias("source"),
        F.col("total_fires").alias("total"),
        F.expr(
            "concat('usa=', usa_fires, '|mexico=', mexico_fires, '|ha=', cast(total_hectares as decimal(30,1)))"
        ).alias("details"),
    )
    places = summaries.infrastructure_metadata(_infrastructure(spark, sf), GENERATED_AT).select(
        F.lit("infrastructure").alias("layer"), "generated_at", "source", "total",
        _entries_text(F.col("by_type")).alias("details"),
    )
    return det.union_sensors(hot, weather, fwi, fires, places)


def place_label(spark: SparkSession, sf: str) -> DataFrame:
    return standins.places(spark, sf).select(
        "id",
        views.place_label(F.col("name"), F.col("city"), F.col("country")).alias("label"),
        views.leading_parts(F.col("display_name"), 3).alias("short_name"),
        views.leading_parts(F.col("display_name"), 1).alias("search_text"),
    )


def geojson_features(spark: SparkSession, sf: str) -> DataFrame:
    layer = _deduped(spark, sf)
    return layer.select("event_id", feature_text(layer, "hotspots").alias("feature"))


_QUERIES = [
    hotspot_normalize, hotspot_dedup, hotspot_dedup_daily, hotspot_dedup_tiles, hotspot_dedup_tiles_daily, frp_band_rangejoin, hotspot_by_intensity, hotspot_lookback, hotspot_world,
    hotspot_map_view, hotspot_decimate, fwi_components, fwi_now, fwi_class_rangejoin, fwi_forecast, fwi_trend,
    fwi_layer, fwi_rejected, weather_layer, grid_points, grid_weather_join, fwi_map_view, max_fwi_zone,
    prefire_summary, perimeters_unified, perimeter_parse, layer_roundtrip, perimeter_in_view, weather_parse, perimeter_top200, perimeter_first200, perimeter_totals,
    perimeter_by_country, perimeter_map_view, largest_fire, largest_fire_card, infra_normalize, infra_by_type,
    infra_type_map, infra_viewport, infra_bbox, infra_map_view, active_fire_summary, active_fire_from_parts, layer_last_good,
    layer_freshness, layer_errors, layer_status_flags, layer_metadata, place_label, geojson_features,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {query.__name__: query for query in _QUERIES}
