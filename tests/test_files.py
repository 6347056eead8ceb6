"""Readers, sinks and whole pipelines over small files."""

import datetime as dt
import json

import pytest

from emberline.operators import perimeters as per
from emberline.plans import jobs
from emberline.schemas import ATTEMPTS, LAYER_NAMES, MODIS_COLUMNS, VIIRS_COLUMNS, layer_schema
from emberline.sinks import versions
from emberline.sinks.geojson import write_empty_layer
from emberline.sources import layers
from emberline.sources.detections import documented_columns, read_all, read_detections
from emberline.sources.documents import read_elements, read_mexico_perimeters, read_usa_perimeters, read_weather

from . import golden

NOW = dt.datetime(2026, 7, 2, 21, tzinfo=dt.timezone.utc)


def csv_text(columns, *rows):
    lines = [",".join(columns)] + [",".join(str(row.get(c, "x")) for c in columns) for row in rows]
    return "\n".join(lines) + "\n"


def hit(lat, lon, frp="12", time="0930", **more):
    return {"latitude": lat, "longitude": lon, "frp": frp, "acq_date": "2026-07-02", "acq_time": time, "confidence": "n", "daynight": "D", **more}


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


@pytest.fixture
def feeds(tmp_path):
    root = tmp_path / "firms"
    put(root / "source=VIIRS_SNPP_NRT" / "a.csv", csv_text(VIIRS_COLUMNS, hit(10, 20, 250), hit(10, 20, ""), hit("bad", 20)))
    put(root / "source=VIIRS_SNPP_NRT" / "b.csv", csv_text(VIIRS_COLUMNS, hit(11, 21)))
    put(root / "source=MODIS_NRT" / "a.csv", csv_text(MODIS_COLUMNS, hit(10.001, 20.001), hit(50, 60, "5", confidence="80")) + "1.5\n")
    return root


def test_detection_files(spark, feeds):
    rows, errors = read_all(spark, str(feeds))
    assert errors == {} and rows.count() == 7
    modis = read_detections(spark, str(feeds / "source=MODIS_NRT"), "MODIS_NRT").rows
    assert {r["confidence"] for r in modis.collect()} == {"n", "80", ""}
    assert documented_columns("MODIS_NRT") == MODIS_COLUMNS


def test_detections_with_other_columns(spark, tmp_path):
    put(tmp_path / "v" / "a.csv", "acq_time,latitude,extra,longitude\n0930,1,?,2\n")
    row = read_detections(spark, str(tmp_path / "v"), "VIIRS_SNPP_NRT").rows.first()
    assert (row["latitude"], row["longitude"], row["acq_time"], row["frp"], row["confidence"], row["daynight"]) == (
        "1", "2", "0930", "0", "n", "D")


def test_each_file_has_its_own_header(spark, tmp_path):
    put(tmp_path / "v" / "a.csv", "latitude,longitude,frp\n1,2,3\n")
    put(tmp_path / "v" / "b.csv", "longitude,latitude,frp\n20,10,30\n21,11,31\n")
    put(tmp_path / "v" / "c.csv", "Error: down\nretry\n")
    rows = read_detections(spark, str(tmp_path / "v"), "VIIRS_SNPP_NRT").rows.collect()
    assert sorted((r["latitude"], r["longitude"], r["frp"]) for r in rows) == [("1", "2", "3"), ("10", "20", "30"), ("11", "21", "31")]


def test_files_without_a_header_are_reported_beside_good_ones(spark, feeds, tmp_path):
    put(feeds / "source=VIIRS_SNPP_NRT" / "c.csv", "\nError: down\n1,2,the latitude\n")
    put(feeds / "source=VIIRS_SNPP_NRT" / "d.csv", " \n\n")
    scan = read_detections(spark, str(feeds / "source=VIIRS_SNPP_NRT"), "VIIRS_SNPP_NRT")
    assert scan.error is None and scan.rows.count() == 4
    assert [r["_corrupt_record"] for r in scan.rejects.collect()] == ["Error: down"]
    put(feeds / "source=MODIS_NRT" / "a.csv", "Error: key\nretry")
    wrong = jobs.run_hotspots(spark, str(feeds), str(tmp_path / "out"), NOW)
    assert wrong == {"VIIRS_SNPP_NRT": "1 records do not parse", "MODIS_NRT": "MODIS_NRT: Error: key"}
    assert written(spark, tmp_path / "out")[0]["total_hotspots"] == "3"


def test_weather_job_tells_of_lines_that_do_not_parse(spark, tmp_path):
    put(tmp_path / "w" / "a.json", "\n".join(json.dumps(r) for r in golden.responses()) + '\n{"lat": 1,\n{"lat": 1, "lon": 2}\n')
    paths = str(tmp_path / "w"), str(tmp_path / "weather"), str(tmp_path / "fwi")
    assert jobs.run_weather(spark, *paths, NOW) == "1 records do not parse"
    assert written(spark, tmp_path / "weather")[0]["errors"] == "2"
    assert [(r["rows"], r["rejected"]) for r in versions.manifests(spark, paths[1]).collect()] == [(8, 1)]


@pytest.mark.parametrize("body, problem", [("", "no data"), ("  \n", "no data"), ("Error: Invalid MAP_KEY", "Error: Invalid MAP_KEY")])
def test_failing_feed_is_isolated(spark, feeds, body, problem):
    for old in (feeds / "source=MODIS_NRT").iterdir():
        old.write_text(body)
    rows, errors = read_all(spark, str(feeds))
    assert rows.count() == 4 and errors == {"MODIS_NRT": f"MODIS_NRT: {problem}"}


def test_missing_folder_is_isolated(spark, tmp_path):
    scan = read_detections(spark, str(tmp_path / "nowhere"), "MODIS_NRT")
    assert scan.rows.count() == 0 and "nowhere" in scan.error
    for read in (read_weather, read_usa_perimeters, read_mexico_perimeters, read_elements):
        scan = read(spark, str(tmp_path / "nowhere"))
        assert scan.error and scan.rows.count() == 0


USA = {
    "features": [
        {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[1, 2], [3, 4], [1, 2]]]},
         "properties": {"poly_IncidentName": "Big", "poly_GISAcres": 1000, "poly_CreateDate": 1719900000000}},
        {"geometry": {"type": "MultiPolygon", "coordinates": [[[[1.5, 2], [3, 4], [1.5, 2]]]]}, "properties": {"poly_GISAcres": 10.5}},
        {"geometry": None, "properties": {}},
    ]
}
MEXICO = {"features": [{"geometry": None, "properties": {"NOMBRE": None, "nombre": "Cerro", "SUPERFICIE": 12.5, "FECHA": "x"}}]}
OSM = {
    "elements": [
        {"type": "node", "id": 1, "lat": 20.0, "lon": -100.0, "tags": {"amenity": "hospital", "name": "General"}},
        {"type": "way", "id": 2, "center": {"lat": 50.0, "lon": -100.0}, "tags": {"amenity": "police"}},
        {"type": "node", "id": 3, "lat": 20.0, "lon": -100.0, "tags": {"shop": "bakery"}},
        {"type": "way", "id": 4, "center": {"lat": 21.0, "lon": -101.0}, "tags": {"power": "plant"}},
    ]
}


@pytest.fixture
def documents(tmp_path):
    put(tmp_path / "usa" / "a.geojson", json.dumps(USA, indent=1))
    put(tmp_path / "usa" / "broken.geojson", '{"features": [')
    put(tmp_path / "mexico" / "a.geojson", json.dumps(MEXICO))
    put(tmp_path / "osm" / "a.json", json.dumps(OSM))
    put(tmp_path / "weather" / "a.json", "\n".join(json.dumps(r) for r in golden.responses()) + '\n{"lat": 1, "lon": 2}\n')
    return tmp_path


def test_perimeter_documents(spark, documents):
    scan = read_usa_perimeters(spark, str(documents / "usa"))
    shapes = ["".join(r["geometry"]["coordinates"].split()) if r["geometry"] else None for r in scan.rows.collect()]
    assert sorted(map(str, shapes)) == sorted(["[[[1,2],[3,4],[1,2]]]", "[[[[1.5,2],[3,4],[1.5,2]]]]", "None"])
    assert scan.rejects.count() == 1
    put(documents / "lines" / "a.json", "\n".join(json.dumps(f) for f in USA["features"]))
    assert read_usa_perimeters(spark, str(documents / "lines"), lines=True).rows.count() == 3
    put(documents / "cut" / "a.json", json.dumps(USA["features"][0]) + '\n{"properties": {"poly_GISAcres": 5\n{"properties": {"poly_GISAcres": "x"}}\n')
    scan = read_usa_perimeters(spark, str(documents / "cut"), lines=True)
    assert (scan.rows.count(), scan.rejects.count()) == (2, 1)


def test_area_of_a_number_zero_gives_way_and_that_of_a_text_does_not(spark, tmp_path):
    stated = [
        ('"SUPERFICIE": 0, "HA": "12.5"', 12.5), ('"SUPERFICIE": "0", "HA": "12.5"', 0.0), ('"SUPERFICIE": 0', 0.0),
        ('"SUPERFICIE": "", "superficie": "3"', 3.0), ('"SUPERFICIE": "x", "HA": 1', 0.0), ("", 0.0), ('"SUPERFICIE": 0.0, "superficie": -0.0, "HA": 4', 4.0),
        ('"SUPERFICIE": false, "superficie": [], "HA": {}', 0.0), ('"SUPERFICIE": true', 1.0), ('"SUPERFICIE": [5]', 0.0), ('"SUPERFICIE": " 6.5 "', 6.5),
        ('"SUPERFICIE": null, "superficie": 7e1', 70.0), ('"SUPERFICIE": 1, "SUPERFICIE": 2', 2.0),
    ]
    features = ", ".join(f'{{"geometry": {{"type": "Point{i}", "coordinates": []}}, "properties": {{{text}}}}}' for i, (text, _) in enumerate(stated))
    put(tmp_path / "a.json", f'{{"features": [{features}, {{"properties": null}}, {{}}]}}')
    rows = per.normalize_mexico(read_mexico_perimeters(spark, str(tmp_path)).rows).collect()
    got = {int(r["geometry"]["type"][5:]): r["hectares"] for r in rows if r["geometry"]}
    assert got == {i: area for i, (_, area) in enumerate(stated)}
    assert [(r["name"], r["hectares"], r["date_updated"]) for r in rows if not r["geometry"]] == [("Incendio Activo", 0.0, "")] * 2


def test_second_spellings_of_texts_are_taken_as_they_stand(spark, tmp_path):
    put(tmp_path / "a.json", '{"properties": {"FECHA": "", "fecha": null, "ESTADO": 0, "estado": 0, "MUNICIPIO": "m", "NOMBRE": 0, "nombre": [], "INCENDIO": 7}}')
    row = per.normalize_mexico(read_mexico_perimeters(spark, str(tmp_path), lines=True).rows).first()
    assert (row["date_updated"], row["state"], row["municipality"], row["name"]) == (None, "0", "m", "7")


def written(spark, path):
    metadata = layers.read_metadata(spark, str(path)).first()["metadata"]
    features = [json.loads(r["value"]) for r in spark.read.text(f"{versions.current(spark, str(path))}/features").collect()]
    return metadata, features


def test_hotspot_job(spark, feeds, tmp_path):
    out = tmp_path / "out"
    for _ in range(2):  # a second run replaces the first
        assert jobs.run_hotspots(spark, str(feeds), str(out), NOW) == {}
    metadata, features = written(spark, out)
    assert metadata["total_hotspots"] == "4" and json.loads(metadata["intensity_scale"])["low"] == "FRP < 10 MW"
    assert sorted((f["properties"]["source"], f["properties"]["intensity"]) for f in features) == [
        ("MODIS (Terra/Aqua)", "low"), ("VIIRS (Suomi NPP)", "extreme"), ("VIIRS (Suomi NPP)", "moderate"), ("VIIRS (Suomi NPP)", "unknown")]
    assert [f["geometry"] for f in features if f["properties"]["intensity"] == "low"] == [{"type": "Point", "coordinates": [60.0, 50.0]}]
    assert {f["properties"]["frp"] for f in features} == {250.0, None, 12.0, 5.0}
    assert layers.read_layer(spark, "hotspots", str(out)).rows.where("acq_date = date '2026-07-02'").count() == 4
    again = layers.read_features(spark, "hotspots", f"{versions.current(spark, str(out))}/features").rows
    assert again.schema == layer_schema("hotspots") and again.count() == 4


def test_hotspot_job_without_any_feed(spark, tmp_path):
    errors = jobs.run_hotspots(spark, str(tmp_path / "none"), str(tmp_path / "out"), NOW)
    assert len(errors) == 2
    metadata, features = written(spark, tmp_path / "out")
    assert features == [] and metadata["error"] and metadata["total"] == "0"


def test_weather_job(spark, documents, tmp_path):
    weather, fwi = tmp_path / "w", tmp_path / "f"
    assert jobs.run_weather(spark, str(documents / "weather"), str(weather), str(fwi), NOW) is None
    metadata, features = written(spark, weather)
    assert (metadata["total_points"], metadata["errors"]) == ("8", "1") and len(features) == 8
    metadata, features = written(spark, fwi)
    assert json.loads(metadata["fwi_classes"])["extreme"] == {"range": "30–999", "color": "#7A0000", "label": "Extreme"}
    by_cell = {tuple(f["geometry"]["coordinates"]): f["properties"] for f in features}
    for lat, lon, *_, index, cls, trend in golden.CURRENT:
        assert (by_cell[lon, lat]["fwi"], by_cell[lon, lat]["trend"]) == (index, trend)
    assert {p["fetched_at"] for p in by_cell.values()} == {"2026-07-02T20:36:48.950077+00:00"}
    restored = layers.read_features(spark, "fwi", f"{versions.current(spark, str(fwi))}/features").rows
    assert restored.schema == layer_schema("fwi")
    assert restored.selectExpr("size(forecast) n", "fetched_at is not null f").distinct().collect() == [(5, True)]


def test_perimeter_job(spark, documents, tmp_path):
    out = tmp_path / "p"
    assert jobs.run_perimeters(spark, str(documents / "usa"), str(documents / "mexico"), str(out), NOW) == {"USA": "1 records do not parse"}
    metadata, features = written(spark, out)
    assert (metadata["total_fires"], metadata["usa_fires"], metadata["mexico_fires"]) == ("4", "3", "1")
    assert float(metadata["total_hectares"]) == pytest.approx(404.7 + 4.2 + 0.0 + 12.5)
    shapes = {f["properties"]["name"]: f["geometry"] for f in features}
    assert shapes["Big"] == USA["features"][0]["geometry"] and shapes["Cerro"] is None
    back = layers.read_features(spark, "perimeters", f"{versions.current(spark, str(out))}/features").rows
    assert back.where("geometry.type = 'MultiPolygon'").count() == 1
    jobs.run_perimeters(spark, str(documents / "usa"), str(documents / "gone"), str(out), NOW, page=1)
    assert [f["properties"]["name"] for f in written(spark, out)[1]] == ["Big"]


def test_infrastructure_job(spark, documents, tmp_path):
    out = tmp_path / "i"
    assert jobs.run_infrastructure(spark, str(documents / "osm"), str(out), NOW) is None
    metadata, features = written(spark, out)
    assert metadata["total"] == "2" and json.loads(metadata["by_type"]) == {"Hospital": 1, "Power Plant": 1}
    assert {f["properties"]["osm_id"] for f in features} == {1, 4}
    assert jobs.run_infrastructure(spark, str(documents / "gone"), str(out), NOW)
    metadata, features = written(spark, out)
    assert features == [] and "gone" in metadata["error"]


@pytest.mark.parametrize("layer", LAYER_NAMES)
def test_empty_layers_keep_their_schema(spark, tmp_path, layer):
    write_empty_layer(spark, layer, "down", "2026-01-01T00:00:00+00:00", str(tmp_path / "e"))
    table = layers.read_layer(spark, layer, str(tmp_path / "e")).rows
    assert table.count() == 0 and set(table.columns) == set(layer_schema(layer).fieldNames())
    put(tmp_path / "doc" / "x.geojson", '{"type": "FeatureCollection", "metadata": {"total": 0}, "features": []}')
    assert layers.read_collection(spark, layer, str(tmp_path / "doc")).rows.count() == 0
    assert layers.read_metadata(spark, str(tmp_path / "doc"), document=True).first()["metadata"] == {"total": "0"}


def test_collection_document(spark, tmp_path):
    feature = {"type": "Feature", "geometry": {"type": "Point", "coordinates": [-118, 14]},
               "properties": {"temp_c": 28.5, "rh_pct": 76, "wind_kmh": 16.0, "wind_dir_deg": 121, "rain_mm": 0.0, "fetched_at": "2026-07-02T20:36:48.950077+00:00"}}
    put(tmp_path / "w.geojson", json.dumps({"metadata": {"generated_at": "g"}, "features": [feature, feature]}, indent=2))
    rows = layers.read_collection(spark, "weather", str(tmp_path / "w.geojson")).rows.collect()
    assert len(rows) == 2 and (rows[0]["lon"], rows[0]["lat"], rows[0]["rh_pct"]) == (-118.0, 14.0, 76.0)


def test_dashboard(spark, feeds, documents, tmp_path):
    paths = {name: str(tmp_path / f"layer_{name}") for name in LAYER_NAMES}
    jobs.run_hotspots(spark, str(feeds), paths["hotspots"], NOW)
    jobs.run_weather(spark, str(documents / "weather"), paths["weather"], paths["fwi"], NOW)
    jobs.run_perimeters(spark, str(documents / "usa"), str(documents / "mexico"), paths["perimeters"], NOW)
    log = spark.createDataFrame([(1, NOW, "fwi", NOW.isoformat(), None, paths["fwi"])], ATTEMPTS)
    panels = jobs.dashboard(spark, paths, log, NOW)
    assert panels["active_fires"].first()["largest_name"] == "Big"
    assert panels["prefire"].first()["escalating_zones"] == 4
    assert panels["top_zone"].first()["fwi"] == 14.3
    assert {r["layer"]: r["freshness"] for r in panels["freshness"].collect()}["fwi"] == "green"
    assert panels["errors"].count() == 0
