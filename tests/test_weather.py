import json

import pytest
from pyspark.sql import functions as F

from emberline.functions import fire_weather as fw
from emberline.operators import weather as wx
from emberline.schemas import WEATHER_RESPONSE
from emberline.sources.documents import read_weather

from . import golden


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("weather")
    (folder / "a.json").write_text("\n".join(json.dumps(r) for r in golden.responses()) + "\n")
    return read_weather(spark, str(folder)).rows


@pytest.fixture(scope="module")
def layer(landed):
    return {(r["lat"], r["lon"]): r for r in wx.fwi_layer(wx.flatten_responses(landed)).collect()}


def test_published_values(layer):
    for (lat, lon, *_, index, cls, trend), days in zip(golden.CURRENT, golden.FORECAST):
        row = layer[lat, lon]
        assert (row["fwi"], row["risk_class"], row["trend"]) == (index, cls, trend)
        assert [(d["fwi"], d["risk_class"]) for d in row["forecast"]] == [(d[4], d[5]) for d in days]
        assert row["forecast"][0]["date"] == "2026-07-02"


def test_views_of_the_same_cells_agree(landed, layer):
    readings = wx.flatten_responses(landed)
    for row in wx.fwi_summary(readings).collect():
        full = layer[row["lat"], row["lon"]]
        assert (row["fwi"], row["trend"], row["risk_class"]) == (full["fwi"], full["trend"], full["risk_class"])
    for row in wx.forecast_days(readings).collect():
        day = layer[row["lat"], row["lon"]]["forecast"][row["day_i"]]
        assert (row["fwi"], row["rain"], row["risk_color"]) == (day["fwi"], day["rain"], day["color"])


def test_column_functions_match_the_staged_form(spark):
    grid = spark.range(2000).select(
        (F.col("id") % 45 - 5).cast("double").alias("temp_c"),
        (F.col("id") * 7 % 101).cast("double").alias("rh_pct"),
        (F.col("id") * 3 % 60).cast("double").alias("wind_kmh"),
        F.when(F.col("id") % 3 == 0, (F.col("id") % 40).cast("double") / 2).otherwise(0.0).alias("rain_mm"),
    )
    whole = fw.fwi(fw.isi("wind_kmh", f"({fw.ffmc('temp_c', 'rh_pct', 'wind_kmh', 'rain_mm')})"), fw.bui())
    scored = fw.with_fwi(grid, keep_components=True).withColumn("direct", F.expr(whole))
    assert scored.where("fwi is null or fwi <> direct").count() == 0
    assert scored.where("not ffmc between 0 and 101 or fwi < 0").count() == 0
    # At one moisture code, more wind never lowers the index.
    rising = spark.range(60).select(F.col("id").cast("double").alias("w")).withColumn(
        "i", F.expr(fw.fwi(fw.isi("w", "85D"), fw.bui()))
    )
    values = [r["i"] for r in rising.orderBy("w").collect()]
    assert values == sorted(values)


def test_buildup_index_branches(one):
    assert one(F.expr(fw.bui())) == pytest.approx(32.0)
    assert one(F.expr(fw.bui("200D", "100D"))) == pytest.approx(200 - (1 - 80 / 240) * (0.92 + (0.0114 * 200) ** 1.7))
    assert one(F.expr(fw.fwi("10D", "120D"))) > one(F.expr(fw.fwi("10D", "32D")))


@pytest.mark.parametrize("previous", [5.0, 85.0])
def test_rain_only_wets(one, previous):
    codes = [one(F.expr(fw.ffmc("10D", "90D", "0D", f"{rain}D", f"{previous}D"))) for rain in (0.0, 0.5, 1.0, 5.0, 80.0, 500.0)]
    assert codes[0] == codes[1] and codes[1:] == sorted(codes[1:], reverse=True) and 0 <= codes[-1] <= 101


def _readings(spark, daily, current=(25.0, 40.0, 12.0, 90.0, 0.0)):
    row = (14.0, -118.0, None, current, daily, None)
    return wx.flatten_responses(spark.createDataFrame([row], WEATHER_RESPONSE).drop("_corrupt_record"))


def test_zero_and_missing_days_fall_back_to_current(spark):
    daily = (["d0", "d1"], [0.0, 30.0], [None, 20.0], [0.0, 5.0], [None, 1.0])
    first, second = wx.fwi_layer(_readings(spark, daily)).first()["forecast"]
    assert (first["temp_max"], first["rh_min"], first["wind_max"], first["rain"]) == (25.0, 40.0, 12.0, 0.0)
    assert (second["temp_max"], second["rh_min"], second["wind_max"], second["rain"]) == (30.0, 20.0, 5.0, 1.0)


def test_short_or_absent_forecasts(spark):
    shorter = wx.fwi_layer(_readings(spark, (None, [30.0, 31.0, 32.0], [20.0], None, [0.0, 0.0, 0.0]))).first()
    assert [d["date"] for d in shorter["forecast"]] == ["", "", ""]
    assert [d["rh_min"] for d in shorter["forecast"]] == [20.0, 40.0, 40.0]
    assert shorter["trend"] == "steady"
    absent = wx.fwi_layer(_readings(spark, None)).first()
    assert absent["forecast"] == [] and absent["trend"] == "steady"
    assert wx.fwi_summary(_readings(spark, None)).first()["trend"] == "steady"
    assert wx.forecast_days(_readings(spark, None)).count() == 0


def test_missing_readings_take_defaults(spark):
    row = _readings(spark, None, (None, None, None, None, None)).first()
    assert (row["temp_c"], row["rh_pct"], row["wind_kmh"], row["wind_dir_deg"], row["rain_mm"]) == (20.0, 50.0, 10.0, 0.0, 0.0)


@pytest.mark.parametrize("later, now, trend", [(12.0, 10.0, "steady"), (12.1, 10.0, "escalating"), (8.0, 10.0, "steady"), (7.9, 10.0, "de-escalating")])
def test_trend_limits(spark, later, now, trend):
    df = spark.sql(
        f"select cast({now} as double) fwi, array(named_struct('fwi', 1D), named_struct('fwi', 1D), named_struct('fwi', 1D),"
        f" named_struct('fwi', cast({later} as double))) forecast"
    )
    assert wx.with_trend(df).first()["trend"] == trend


def test_invalid_readings_are_rejected(spark):
    rows = [(1, 20.0, 101.0, 5.0, 0.0), (2, 20.0, 50.0, -1.0, 0.0), (3, 20.0, 50.0, 5.0, -0.1), (4, 20.0, 50.0, 5.0, 0.0), (5, 20.0, None, 5.0, 0.0)]
    df = spark.createDataFrame(rows, "id int, temp_c double, rh_pct double, wind_kmh double, rain_mm double")
    assert {r["id"] for r in fw.with_fwi(df).where("fwi is not null").collect()} == {4}
    good, bad = wx.split_rejected(df)
    assert good.count() == 1 and bad.count() == 4


def test_grid(spark):
    cells = [(r["lat"], r["lon"]) for r in wx.grid_points(spark).orderBy("cell_no").collect()]
    assert cells == [(lat, lon) for lat in (14.0, 24.0) for lon in (-118.0, -108.0, -98.0, -88.0)]
    fine = wx.grid_points(spark, (0.0, 1.0), (0.0, 0.5), 0.1)
    assert fine.count() == 11 * 6 == wx.grid_size((0.0, 1.0), 0.1) * wx.grid_size((0.0, 0.5), 0.1)
    assert fine.agg(F.max("lat"), F.max("lon")).first() == (1.0, 0.5)


def test_grid_join_takes_the_newest_record(spark):
    weather = spark.createDataFrame(
        [(1, 14.0, -118.0, 1.0), (7, 14.04, -118.0, 7.0), (3, 14.0, -118.0, 3.0), (4, 50.0, 50.0, 4.0)],
        "id long, lat double, lon double, temp_c double",
    )
    rows = {r["cell_no"]: r for r in wx.join_grid_weather(wx.grid_points(spark), weather, "id").collect()}
    assert len(rows) == 8
    assert (rows[0]["id"], rows[0]["temp_c"], rows[0]["n_records"]) == (7, 7.0, 3)
    assert rows[1]["id"] is None and rows[1]["n_records"] == 0


def test_missing_responses_are_split_off(spark, tmp_path):
    lines = [json.dumps(r) for r in golden.responses()][:2] + ['{"lat": 1, "lon": 2}', "not json"]
    (tmp_path / "w.json").write_text("\n".join(lines))
    scan = read_weather(spark, str(tmp_path))
    good, bad = wx.split_missing(scan.rows)
    assert good.count() == 2 and bad.count() == 2
    assert scan.rejects.count() == 1


def test_max_zone(spark):
    df = wx.with_risk(spark.createDataFrame([(1, 1.0, 1.0, 31.0), (0, 0.0, 0.0, 31.0), (2, 2.0, 2.0, 3.0)], "id int, lat double, lon double, fwi double"))
    top = wx.max_fwi_zone(df, "id").first()
    assert (top["id"], top["panel_label"], top["panel_color"]) == (0, "EXTREME", "#AA0000")
    assert wx.max_fwi_zone(df.withColumn("fwi", F.lit(0.0)), "id").count() == 0
