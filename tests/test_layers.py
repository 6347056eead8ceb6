import datetime as dt

import pytest
from pyspark.sql import functions as F

from emberline.operators import infrastructure as infra
from emberline.operators import perimeters as per
from emberline.operators import status, summaries, views
from emberline.schemas import ATTEMPTS, MEXICO_FEATURE, OSM_ELEMENT, USA_FEATURE


def usa(spark, *rows):
    return per.normalize_usa(spark.createDataFrame([(None, r) for r in rows], USA_FEATURE))


def mexico(spark, *maps):
    return per.normalize_mexico(spark.createDataFrame([(("Polygon", "[[]]"), m) for m in maps], MEXICO_FEATURE))


def test_usa_perimeters(spark):
    rows = usa(spark, ("A", 100.0, "1", "2", "cat", "beh"), (None, None, None, None, None, None)).collect()
    assert (rows[0]["name"], rows[0]["acres"], rows[0]["hectares"], rows[0]["country"]) == ("A", 100.0, 40.5, "USA")
    assert (rows[1]["name"], rows[1]["acres"], rows[1]["hectares"], rows[1]["category"]) == ("Unknown Fire", None, 0.0, "")


def test_mexico_perimeters(spark):
    rows = mexico(
        spark,
        {"NOMBRE": "", "nombre": "lower", "INCENDIO": "third", "SUPERFICIE": "0", "superficie": "12.34"},
        {"INCENDIO": "third", "HA": "n/d", "ESTADO": "Oaxaca", "fecha": "2024"},
        {"SUPERFICIE": "10"},
    ).collect()
    assert [r["name"] for r in rows] == ["lower", "third", "Incendio Activo"]
    # A text "0" is not empty and therefore counts.
    assert [(r["hectares"], r["acres"]) for r in rows] == [(0.0, 0.0), (0.0, 0.0), (10.0, 24.7)]
    assert (rows[1]["state"], rows[1]["date_updated"], rows[1]["municipality"]) == ("Oaxaca", "2024", "")


def test_unified_totals_and_ranking(spark):
    both = per.unify(
        usa(spark, ("A", 100.0, None, None, None, None), ("B", 100.0, None, None, None, None), ("C", 1.0, None, None, None, None)),
        mexico(spark, {"nombre": "M", "HA": "7.06"}),
    )
    assert both.where("name = 'M'").first()["category"] is None
    totals = per.perimeter_totals(both).first()
    assert totals.asDict() == {"total_fires": 4, "total_hectares": 88.5, "usa_fires": 3, "mexico_fires": 1}
    assert sum(r["hectares"] for r in per.totals_by_country(both).collect()) == pytest.approx(88.5)
    assert per.largest_fire(both, "name").first()["name"] == "A"
    assert [r["name"] for r in per.top_perimeters(both, "name", 2).collect()] == ["A", "B"]
    assert [r["name"] for r in per.first_perimeters(both, "name", 2).collect()] == ["A", "B"]
    assert per.fire_card(per.largest_fire(both, "name")).first()["area"] == "41 ha"


def test_empty_and_zero_perimeters(spark):
    none = usa(spark).limit(0) if False else spark.createDataFrame([], USA_FEATURE).transform(per.normalize_usa)
    assert per.perimeter_totals(none).first()["total_hectares"] == 0.0
    zero = usa(spark, ("A", 0.0, None, None, None, None))
    assert per.largest_fire(zero, "name").count() == 0
    hot = spark.createDataFrame([], "intensity string")
    row = summaries.active_fire_summary(hot, zero, "name").first()
    assert (row["total_area"], row["largest_name"], row["situation"]) == (
        "N/A", None, "No active fire detections in current view.")
    assert summaries.active_fire_summary(hot, zero, "name", loading=True).first()["situation"].startswith("Loading")


def test_perimeter_view(spark):
    row = views.perimeter_view(usa(spark, ("A", 12345.6, None, "", None, None))).first()
    assert (row["area"], row["updated"]) == ("4,996.1 ha", "N/A")


def elements(spark, *rows):
    return spark.createDataFrame(list(rows), OSM_ELEMENT)


def test_infrastructure(spark):
    df = elements(
        spark,
        ("node", 1, 1.0, 2.0, None, {"amenity": "hospital", "power": "plant", "name": "", "name:es": "H", "phone": "", "contact:phone": "9"}),
        ("way", 2, None, None, (3.0, 4.0), {"power": "plant", "amenity": "cafe", "contact:phone": "9"}),
        ("relation", 3, 1.0, 1.0, None, {"amenity": "hospital"}),
        ("node", 4, None, 1.0, None, {"amenity": "hospital"}),
        ("way", 5, 1.0, 1.0, None, {"amenity": "hospital"}),
        ("node", 6, 0.0, 1.0, None, {"shop": "x"}),
        ("node", 7, 5.0, 1.0, None, None),
    )
    rows = {r["osm_id"]: r for r in infra.normalize(df).collect()}
    assert set(rows) == {1, 2, 6, 7}
    assert (rows[1]["type"], rows[1]["name"], rows[1]["phone"], rows[1]["icon"]) == ("Hospital", "H", "", "🏥")
    assert (rows[2]["type"], rows[2]["name"], rows[2]["lat"], rows[2]["lon"], rows[2]["phone"]) == ("Power Plant", "Power Plant", 3.0, 4.0, "9")
    assert rows[2]["osm_url"] == "https://www.openstreetmap.org/way/2"
    assert (rows[6]["type"], rows[6]["color"], rows[6]["icon"]) == ("Other", "#888888", "📍")
    assert {r["osm_id"] for r in infra.normalize(infra.has_any_tag(df)).collect()} == {1, 2}
    counts = infra.type_counts(infra.normalize(df)).first()
    assert counts["total"] == 4 and counts["by_type"] == {"Hospital": 1, "Power Plant": 1, "Other": 2}
    assert infra.type_counts(infra.normalize(df).limit(0)).first()["total"] == 0


def test_viewport(spark):
    df = elements(
        spark,
        ("node", 1, 1.0, 2.0, None, {"aeroway": "aerodrome"}),
        ("node", 2, 0.0, 2.0, None, {"amenity": "police"}),
        ("node", 3, 1.0, 2.0, None, {"amenity": "clinic"}),
        ("node", 4, 9.0, 2.0, None, {"amenity": "police"}),
        ("node", 5, 1.00004, 2.0, None, {"amenity": "police", "name:es": "P", "name:en": "E"}),
    )
    box = {"west": 0.0, "south": -1.0, "east": 5.0, "north": 1.00004}
    rows = {r["id"]: r for r in infra.viewport(df, box, 7, keep=["id"]).collect()}
    assert set(rows) == {1}  # the northern bound is rounded to 1.0000
    assert (rows[1]["name"], rows[1]["type"]) == ("Airport", "Airport")
    wider = infra.viewport(df, box | {"north": 2.0}, 7, keep=["id"]).collect()
    assert {r["id"]: r["name"] for r in wider} == {1: "Airport", 5: "P"}
    assert infra.viewport(df, box, 6).count() == 0


def test_bbox_text(spark, one):
    assert infra.parse_bbox("-118,14,-86,33") == {"west": -118.0, "south": 14.0, "east": -86.0, "north": 33.0}
    df = spark.createDataFrame([("1,2,3,4",), ("1,2",)], "b string").select(*infra.bbox_columns(F.col("b")))
    assert [tuple(r) for r in df.collect()] == [(1.0, 2.0, 3.0, 4.0), (1.0, 2.0, None, None)]


def T(hour, minute=0):
    return dt.datetime(2024, 1, 1, hour, minute, tzinfo=dt.timezone.utc)


def attempts(spark):
    rows = [
        (1, T(1), "fwi", T(1).isoformat(), None, "a"),
        (2, T(2), "fwi", None, "HTTP 503", None),
        (3, T(3), "hotspots", "garbage", None, "b"),
        (4, T(3), "weather", None, "HTTP 500", None),
        (5, T(4), "weather", T(4).isoformat(), None, "c"),
        (6, T(5), "perimeters", None, "down", None),
    ]
    return spark.createDataFrame(rows, ATTEMPTS)


def test_last_good_and_panel(spark):
    state = status.last_good(attempts(spark), T(5))
    rows = {r["layer"]: r for r in state.collect()}
    assert (rows["fwi"]["data_path"], rows["fwi"]["error"], rows["fwi"]["freshness"], rows["fwi"]["age"]) == (
        "a", "HTTP 503", "unknown", "4 hr ago")
    assert (rows["weather"]["error"], rows["weather"]["freshness"]) == (None, "amber")
    assert (rows["hotspots"]["freshness"], rows["hotspots"]["age"]) == ("red", "NaN day ago")
    assert (rows["perimeters"]["data_path"], rows["perimeters"]["age"]) == (None, "Unknown")
    panel = {r["layer"]: r for r in status.freshness_panel(state.where("layer <> 'hotspots'")).collect()}
    assert set(panel) == {"hotspots", "weather", "fwi", "perimeters"}
    assert (panel["hotspots"]["freshness"], panel["hotspots"]["dot"]) == ("unknown", "#888888")
    assert panel["weather"]["title"] == "Weather / FWI: updated 1 hr ago (expected: Hourly)"
    assert {r["message"] for r in status.layer_errors(state).collect()} == {"fwi: HTTP 503", "perimeters: down"}
    assert status.status_flags(state).first().asDict() == {"any_error": True, "all_loading": False, "layers_loading": 1}
    assert status.status_flags(state.limit(0)).first()["all_loading"]


@pytest.mark.parametrize(
    "extreme, very_high, rising, text",
    [(2, 0, 1, "2 zone(s) at EXTREME fire danger. 1 zone(s) escalating. Consider pre-positioning resources."),
     (1, 5, 0, "1 zone(s) at EXTREME fire danger. Consider pre-positioning resources."),
     (0, 3, 2, "3 zone(s) at VERY HIGH fire danger. Monitor conditions closely."),
     (0, 0, 9, "Current fire weather conditions are within manageable range.")],
)
def test_alerts(spark, extreme, very_high, rising, text):
    rows = [("extreme", "steady")] * extreme + [("very_high", "steady")] * very_high + [("low", "escalating")] * rising
    df = spark.createDataFrame(rows, "risk_class string, trend string")
    assert summaries.prefire_summary(df).first()["alert"] == text
    assert summaries.prefire_summary(df, loading=True).first()["alert"] == "Computing FWI..."


def test_situation(spark):
    hot = spark.createDataFrame([("extreme",)] * 2 + [("high",)] * 1200, "intensity string")
    row = summaries.active_fire_summary(hot, usa(spark, ("A", 100000.0, None, None, None, None)), "name").first()
    assert row["situation"] == (
        "1,202 active fire detections globally. 2 extreme-intensity detections require immediate attention. "
        "1 active fire perimeters covering 40,469 ha.")
    assert (row["badge"], row["total_area"], row["largest_name"], row["high_detections"]) == (
        "1,202 active fire detections", "40,469 ha", "A", 1200)
