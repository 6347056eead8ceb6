import datetime as dt
import json
import uuid
from pathlib import Path

import pytest

from emberline.operators import detections as det
from emberline.operators import status
from emberline.schemas import ATTEMPTS, VIIRS_COLUMNS
from emberline.streaming import refresh
from emberline.streaming.dedup import dedup_stream

from . import golden
from .test_files import OSM, csv_text, hit, put

NOW = dt.datetime(2026, 7, 2, 21, tzinfo=dt.timezone.utc)


def clock():
    return NOW


def done(feed, *pulls):
    for pull in pulls:
        put(feed / "complete" / pull, "done")


@pytest.fixture
def out(tmp_path):
    """An output never used before: checkpoints of earlier sessions in the shared folder do not belong to it."""
    return str(tmp_path / uuid.uuid4().hex)


def test_refresh_keeps_the_last_good_snapshot(spark, tmp_path, out):
    landing = tmp_path / "landing"
    feed = landing / "hotspots"
    put(feed / "pull=01" / "source=VIIRS_SNPP_NRT" / "a.csv", csv_text(VIIRS_COLUMNS, hit(10, 20, 250)))
    put(landing / "infrastructure" / "pull=01" / "a.json", json.dumps(OSM))
    done(feed, "01"), done(landing / "infrastructure", "01")
    layers = ["hotspots", "infrastructure"]
    assert refresh.run_available_now(spark, str(landing), out, layers, clock=clock) == {}
    assert refresh.read_snapshot(spark, out, "hotspots").count() == 1
    assert refresh.read_snapshot(spark, out, "infrastructure").count() == 2

    # A failing pull changes the status, not the data.
    put(feed / "pull=02" / "source=VIIRS_SNPP_NRT" / "a.csv", "Error: Invalid key")
    put(landing / "infrastructure" / "pull=02" / "a.json", '{"elements": [')
    done(feed, "02"), done(landing / "infrastructure", "02")
    refresh.run_available_now(spark, str(landing), out, layers, clock=lambda: NOW + dt.timedelta(minutes=5))
    assert refresh.read_snapshot(spark, out, "hotspots").count() == 1
    rows = {r["layer"]: r for r in refresh.read_status(spark, out, NOW + dt.timedelta(minutes=6)).collect()}
    assert rows["hotspots"]["error"] == "VIIRS_SNPP_NRT: Error: Invalid key" and rows["hotspots"]["freshness"] == "unknown"
    assert rows["hotspots"]["age"] == "6 min ago" and rows["infrastructure"]["error"] == "infrastructure: 1 records do not parse"

    # Two pulls at once: the newest working one counts.
    put(feed / "pull=03" / "source=VIIRS_SNPP_NRT" / "a.csv", csv_text(VIIRS_COLUMNS, hit(1, 2), hit(3, 4)))
    put(feed / "pull=04" / "source=VIIRS_SNPP_NRT" / "a.csv", " \n")
    done(feed, "03", "04")
    refresh.run_available_now(spark, str(landing), out, ["hotspots"], clock=lambda: NOW + dt.timedelta(minutes=10))
    assert refresh.read_snapshot(spark, out, "hotspots").count() == 2
    row = refresh.read_status(spark, out).where("layer = 'hotspots'").first()
    assert row["error"] == "VIIRS_SNPP_NRT: no data"

    # A later success clears the error; nothing new means no new attempt.
    put(feed / "pull=05" / "source=VIIRS_SNPP_NRT" / "a.csv", csv_text(VIIRS_COLUMNS, hit(5, 6)))
    done(feed, "05")
    for minutes in (15, 20):
        refresh.run_available_now(spark, str(landing), out, ["hotspots"], clock=lambda m=minutes: NOW + dt.timedelta(minutes=m))
    row = refresh.read_status(spark, out).where("layer = 'hotspots'").first()
    assert row["error"] is None and row["generated_at"] == (NOW + dt.timedelta(minutes=15)).isoformat()


def test_refresh_of_documents(spark, tmp_path, out):
    landing = tmp_path / "landing"
    lines = "\n".join(json.dumps(r) for r in golden.responses())
    for layer in ("weather", "fwi"):
        put(landing / layer / "pull=1" / "a.json", lines)
    for layer in ("weather", "fwi", "perimeters"):
        done(landing / layer, "1")
    put(landing / "perimeters" / "pull=1" / "country=Mexico" / "a.geojson", '{"features": [{"properties": {"nombre": "Cerro"}}]}')
    assert refresh.run_available_now(spark, str(landing), out, ["weather", "fwi", "perimeters"], clock=clock) == {}
    fwi = {(r["lat"], r["lon"]): r["fwi"] for r in refresh.read_snapshot(spark, out, "fwi").collect()}
    assert fwi == {(lat, lon): index for lat, lon, *_, index, _, _ in golden.CURRENT}
    assert refresh.read_snapshot(spark, out, "weather").count() == 8
    assert refresh.read_snapshot(spark, out, "perimeters").first()["name"] == "Cerro"
    with pytest.raises(ValueError):
        refresh.start_refresh(spark, "nothing", str(landing), out)


def test_replayed_batch_gives_the_same_state(spark, tmp_path, out):
    path = tmp_path / "l" / "pull=1" / "source=VIIRS_SNPP_NRT" / "a.csv"
    put(path, csv_text(VIIRS_COLUMNS, hit(10, 20)))
    for _ in range(2):
        assert refresh.refresh_batch(spark, "hotspots", out, 0, [str(tmp_path / "l" / "pull=1")], clock) is None
    assert refresh.read_attempts(spark, out).count() == 1
    assert refresh.read_snapshot(spark, out, "hotspots").count() == 1


def test_one_dead_layer_does_not_stop_the_others(spark, tmp_path, out):
    put(tmp_path / "landing" / "hotspots" / "pull=1" / "source=VIIRS_SNPP_NRT" / "a.csv", csv_text(VIIRS_COLUMNS, hit(10, 20)))
    put(tmp_path / "landing" / "weather" / "pull=1" / "a.json", "{}")
    done(tmp_path / "landing" / "weather", "1"), done(tmp_path / "landing" / "hotspots", "1")
    blocked = Path(out) / "snapshots" / "weather"
    put(blocked, "a file where a folder should be")
    failed = refresh.run_available_now(spark, str(tmp_path / "landing"), out, ["weather", "hotspots"], clock=clock)
    assert refresh.read_snapshot(spark, out, "hotspots").count() == 1
    errors = {r["layer"] for r in refresh.read_status(spark, out).where("error is not null").collect()}
    assert "weather" in errors | set(failed)


def test_status_stream_equals_batch(spark, tmp_path):
    rows = [(i, NOW + dt.timedelta(minutes=i), ["fwi", "weather"][i % 2], None if i % 3 == 0 else f"g{i}", "x" if i % 3 == 0 else None, f"p{i}") for i in range(20)]
    log = spark.createDataFrame(rows, ATTEMPTS)
    log.repartition(3).write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(ATTEMPTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    query = (
        refresh.status_stream(stream).writeStream.outputMode("complete").format("memory").queryName("status_now")
        .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert sorted(spark.table("status_now").collect()) == sorted(status.last_good(log).collect())


def test_dedup_stream_equals_batch(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(600):
        at = start + dt.timedelta(minutes=10 * i)
        place = (1.0, 1.0) if i % 3 == 0 else ((i * 7 % 50) / 100, (i % 4) / 100)
        rows.append((i, *place, "VIIRS (Suomi NPP)" if i % 5 < 2 else "MODIS (Terra/Aqua)", at, at.date()))
    # Far later detections move the watermark past everything that counts.
    late = dt.datetime(2024, 3, 1)
    tail = [(10_000 + k, 80.0, 80.0, s, late + dt.timedelta(hours=k), (late + dt.timedelta(hours=k)).date())
            for k, s in enumerate(["VIIRS (Suomi NPP)", "MODIS (Terra/Aqua)"] * 2)]
    schema = "id int, lon double, lat double, source string, acq_ts timestamp_ntz, acq_date date"
    for n, part in enumerate([rows[:300], rows[300:], tail[:2], tail[2:]]):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"f{n}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    query = (
        dedup_stream(stream, "id", salts=3).writeStream.outputMode("append").format("parquet")
        .option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    got = {r["id"] for r in spark.read.parquet(str(tmp_path / "out")).where("id < 10000").collect()}
    batch = det.dedup_cross_sensor(spark.createDataFrame(rows, schema), scope="day")
    assert got == {r["id"] for r in batch.collect()}
    assert 0 < len(got) < 600


def test_dedup_stream_keeps_detections_without_a_time(spark, tmp_path):
    fine, coarse, at = "VIIRS (Suomi NPP)", "MODIS (Terra/Aqua)", dt.datetime(2024, 1, 1, 12)
    day, late = at.date(), dt.datetime(2024, 3, 1)
    rows = [
        (1, 1.0, 1.0, coarse, None, None), (2, 1.0, 1.0, coarse, None, day), (3, 2.0, 2.0, fine, None, None), (4, 2.0, 2.0, coarse, at, day),
        (5, 3.0, 3.0, fine, None, day), (6, 3.0, 3.0, fine, at, day), (7, 3.0, 3.0, coarse, at, day), (8, 5.0, 5.0, None, None, None),
    ]
    covered = [(9, 3.0, 3.0, coarse, None, day), (10, 6.0, 6.0, fine, None, day), (11, 6.0, 6.0, coarse, at, day)]
    tail = [(10_000 + k, 80.0, 80.0, s, late + dt.timedelta(hours=k), late.date()) for k, s in enumerate([fine, coarse] * 2)]
    schema = "id int, lon double, lat double, source string, acq_ts timestamp_ntz, acq_date date"
    for n, part in enumerate([rows + covered, tail[:2], tail[2:]]):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"f{n}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    query = (
        dedup_stream(stream, "id", salts=1).writeStream.outputMode("append").format("parquet")
        .option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    got = sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).where("id < 10000").collect())
    batch = sorted(r["id"] for r in det.dedup_cross_sensor(spark.createDataFrame(rows, schema), scope="day").collect())
    assert [i for i in got if i < 9] == batch == [1, 2, 3, 4, 5, 6, 8]
    assert [i for i in got if i >= 9] == [9, 10, 11]  # no time, no comparison: kept, as the docstring says


def test_checkpoints_of_two_outputs_differ(spark):
    first, second = (refresh.checkpoint_root(spark, out) for out in ("/o", "/p"))
    shared = spark.conf.get("spark.checkpoint.dir", None)
    assert first != second
    assert first.startswith(shared) if shared else first == "/o/checkpoints"


def test_periodic_refresh_picks_up_new_pulls(spark, tmp_path, out):
    feed = tmp_path / "landing" / "hotspots"
    put(feed / "pull=1" / "source=VIIRS_SNPP_NRT" / "a.csv", csv_text(VIIRS_COLUMNS, hit(10, 20)))
    done(feed, "1")
    query = refresh.start_refresh(spark, "hotspots", str(tmp_path / "landing"), out, interval="1 second", clock=clock)
    try:
        query.processAllAvailable()
        assert refresh.read_snapshot(spark, out, "hotspots").count() == 1
        put(feed / "pull=2" / "source=VIIRS_SNPP_NRT" / "a.csv", csv_text(VIIRS_COLUMNS, hit(1, 2), hit(3, 4), hit(5, 6)))
        done(feed, "2")
        query.processAllAvailable()
        assert refresh.read_snapshot(spark, out, "hotspots").count() == 3
    finally:
        query.stop()


def test_pull_counts_once_it_is_complete(spark, tmp_path, out):
    """Files of a pull that come over several triggers are not read before its mark, and then all of them."""
    feed = tmp_path / "landing" / "hotspots"
    source = feed / "pull=2" / "source=VIIRS_SNPP_NRT"
    put(feed / "pull=1" / "source=VIIRS_SNPP_NRT" / "a.csv", csv_text(VIIRS_COLUMNS, hit(10, 20)))
    done(feed, "1")
    for i in range(3):
        put(source / f"{i}.csv", csv_text(VIIRS_COLUMNS, hit(i, 2)))
        refresh.run_available_now(spark, str(tmp_path / "landing"), out, ["hotspots"], clock=lambda i=i: NOW + dt.timedelta(minutes=i))
        assert refresh.read_snapshot(spark, out, "hotspots").count() == 1
    done(feed, "2")
    refresh.run_available_now(spark, str(tmp_path / "landing"), out, ["hotspots"], clock=lambda: NOW + dt.timedelta(minutes=5))
    assert refresh.read_snapshot(spark, out, "hotspots").count() == 3
    put(source / "late.csv", csv_text(VIIRS_COLUMNS, hit(50, 2)))
    refresh.run_available_now(spark, str(tmp_path / "landing"), out, ["hotspots"], clock=lambda: NOW + dt.timedelta(minutes=9))
    assert refresh.read_snapshot(spark, out, "hotspots").count() == 3


def test_broken_source_leaves_the_other_and_is_logged(spark, tmp_path, out):
    pull = tmp_path / "pull=1"
    put(pull / "country=USA" / "a.geojson", '{"features": [{"properties": {"poly_IncidentName": "Big"}}]}')
    put(pull / "country=Mexico" / "a.geojson", '{"features": [')
    assert refresh.refresh_batch(spark, "perimeters", out, 0, [str(pull)], clock) is None
    assert refresh.read_snapshot(spark, out, "perimeters").first()["name"] == "Big"
    assert [r["problem"] for r in refresh.read_problems(spark, out).collect()] == ["Mexico: 1 records do not parse"]


def test_weather_pull_without_a_reading_fails(spark, tmp_path, out):
    put(tmp_path / "pull=1" / "a.json", "\n".join(json.dumps(r) for r in golden.responses()))
    put(tmp_path / "pull=2" / "a.json", "<html>down</html>")
    assert refresh.refresh_batch(spark, "weather", out, 0, [str(tmp_path / "pull=1")], clock) is None
    error = refresh.refresh_batch(spark, "weather", out, 1, [str(tmp_path / "pull=2")], lambda: NOW + dt.timedelta(minutes=5))
    assert error == "weather: 1 records do not parse"
    assert refresh.read_snapshot(spark, out, "weather").count() == 8
