"""The pipelines end to end: landed files in, complete layers out."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from emberline.functions import tables
from emberline.operators import detections as det
from emberline.operators import infrastructure as infra
from emberline.operators import perimeters as per
from emberline.operators import status, summaries
from emberline.operators import weather as wx
from emberline.operators.space import within_bbox
from emberline.session import use_all_cores
from emberline.sinks.geojson import write_empty_layer, write_layer, write_table
from emberline.sources import detections as detection_files
from emberline.sources import documents
from emberline.sources.layers import read_layer
from emberline.sources.scan import problem


def _iso(as_of: dt.datetime) -> str:
    return (as_of if as_of.tzinfo else as_of.replace(tzinfo=dt.timezone.utc)).isoformat()


def run_hotspots(spark: SparkSession, root: str, out: str, as_of: dt.datetime, scope: str = "batch") -> dict[str, str]:
    """Detections of all feeds under ``root`` to the hotspot layer at ``out``; returns what was wrong per feed."""
    scans = detection_files.read_feeds(spark, root)
    wrong = {name: found for name, scan in scans.items() if (found := problem(scan))}
    if all(scan.error for scan in scans.values()):
        write_empty_layer(spark, "hotspots", "; ".join(wrong.values()), _iso(as_of), out)
        return wrong
    raw = det.union_sensors(*(scan.rows for scan in scans.values()))
    layer = det.dedup_cross_sensor(det.normalize(raw), scope=scope)
    write_layer(layer, "hotspots", lambda table: summaries.hotspot_metadata(table, _iso(as_of)), out, "acq_date")
    return wrong


def run_weather(spark: SparkSession, landed: str, weather_out: str, fwi_out: str, as_of: dt.datetime) -> str | None:
    """Weather responses to the weather and fire danger layers; returns what was wrong, rejected lines included."""
    scan = documents.read_weather(spark, landed, keep_text=True)
    if scan.error:
        write_empty_layer(spark, "weather", scan.error, _iso(as_of), weather_out)
        write_empty_layer(spark, "fwi", scan.error, _iso(as_of), fwi_out)
        return scan.error
    # Parse the JSON once. What follows reads only the columns it needs, as often as it needs them.
    lost, counted = "_corrupt_record is not null and current is null", Observation()
    write_table(use_all_cores(scan.rows).observe(counted, F.count_if(F.expr(lost)).alias("rejected")), f"{fwi_out}/staged")
    responses = spark.read.schema(scan.rows.schema).parquet(f"{fwi_out}/staged").drop("_corrupt_record")
    rejected = counted.get["rejected"]
    good, _ = wx.split_missing(responses)
    readings = wx.flatten_responses(good)
    counts = summaries.weather_metadata(responses, _iso(as_of))
    write_layer(wx.weather_layer(readings), "weather", lambda _: counts, weather_out, rejected=lambda: rejected)
    write_layer(wx.fwi_layer(readings), "fwi", lambda table: summaries.fwi_metadata(table, _iso(as_of)), fwi_out, rejected=lambda: rejected)
    return f"{rejected} records do not parse" if rejected else None


def run_perimeters(
    spark: SparkSession, usa: str, mexico: str, out: str, as_of: dt.datetime, page: int | None = None, lines: bool = False, split: bool = False
) -> dict[str, str]:
    """Perimeters of both agencies to one layer; returns what was wrong per agency, rejected documents included.

    ``lines`` reads features landed one per line, ``split`` whole documents by many tasks each.

    ``page`` keeps the largest (USA) or first (Mexico) so many of each agency; by default all are kept.
    """
    scans = {"USA": documents.read_usa_perimeters(spark, usa, lines, split), "Mexico": documents.read_mexico_perimeters(spark, mexico, lines, split)}
    north, south = per.normalize_usa(scans["USA"].rows), per.normalize_mexico(scans["Mexico"].rows)
    if page is not None:
        north, south = per.top_perimeters(north, "name", page), per.first_perimeters(south, "name", page)
    layer = per.unify(north, south)
    write_layer(layer, "perimeters", lambda table: summaries.perimeter_metadata(table, _iso(as_of)), out)
    return {name: found for name, scan in scans.items() if (found := problem(scan))}


def run_infrastructure(
    spark: SparkSession, landed: str, out: str, as_of: dt.datetime, bbox: str = tables.INFRA_BBOX, lines: bool = False, split: bool = False
) -> str | None:
    """Map elements inside ``bbox`` to the infrastructure layer; returns what was wrong, rejected documents included."""
    scan = documents.read_elements(spark, landed, lines, split)
    found = problem(scan)
    if found and (scan.error or scan.rows.isEmpty()):
        write_empty_layer(spark, "infrastructure", found, _iso(as_of), out)
        return found
    chosen = infra.normalize(infra.has_any_tag(scan.rows))
    layer = within_bbox(chosen, **infra.parse_bbox(bbox))
    write_layer(
        layer, "infrastructure", lambda table: summaries.infrastructure_metadata(table, _iso(as_of), bbox), out
    )
    return found


def dashboard(spark: SparkSession, layers: dict[str, str], attempts: DataFrame, as_of: dt.datetime) -> dict[str, DataFrame]:
    """The panels over written layers (layer name to path) and the attempts log."""
    hotspots, perimeters = (read_layer(spark, name, layers[name]).rows for name in ("hotspots", "perimeters"))
    fwi = read_layer(spark, "fwi", layers["fwi"]).rows
    state = status.last_good(attempts, as_of)
    return {
        "active_fires": summaries.active_fire_summary(hotspots, perimeters),
        "prefire": summaries.prefire_summary(fwi),
        "top_zone": wx.max_fwi_zone(fwi.withColumn("cell", F.concat_ws(",", "lat", "lon")), "cell"),
        "freshness": status.freshness_panel(state),
        "errors": status.layer_errors(state),
    }
