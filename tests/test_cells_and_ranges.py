"""Cell sets as bitmaps and range lookups against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from emberline.operators import cells, ranges
from emberline.operators import detections as det


def detections(spark, n=3000, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lon, lat = rng.choice([(-179.996, -89.996), (179.999, 90.0), (0.0, 0.0), (rng.uniform(-3, 3), rng.uniform(-2, 2)), (rng.randint(-9, 9) / 100, 0.01)])
        if i % 40 == 0:
            lon, lat = rng.choice([(None, 1.0), (float("nan"), 0.0), (1e9, 0.0), (5000.5, -777.7)])
        rows.append((i, lon, lat, rng.choice(["VIIRS", "MODIS", "MODIS", None]), rng.choice(["2024-01-01", "2024-01-02", None])))
    return spark.createDataFrame(rows, "id int, lon double, lat double, source string, day string").withColumn("acq_date", F.col("day").cast("date"))


@pytest.mark.parametrize("scope", ["batch", "day"])
@pytest.mark.parametrize("hot", [{}, {"hot_rows": 20}, {"hot_rows": 1, "max_hot": 2}])
def test_dedup_by_tiles_equals_dedup_by_cells(spark, scope, hot):
    df = detections(spark)
    expected = sorted(r["id"] for r in det.dedup_cross_sensor(df, scope=scope).select("id").collect())
    assert sorted(r["id"] for r in det.dedup_by_tiles(df, scope=scope, **hot).select("id").collect()) == expected
    assert len(expected) < df.count()


def test_cell_numbers_are_dense_in_a_tile_and_apart_elsewhere(spark):
    places = [(x / 100, y / 100) for x in range(-300, 300, 7) for y in range(-150, 150, 7)] + [(-180.0, -90.0), (180.0, 90.0), (9999.0, -9999.0)]
    df = spark.createDataFrame(places, "lon double, lat double").withColumn("n", cells.cell_number(F.col("lon"), F.col("lat")))
    rows = df.select("n", F.bitmap_bucket_number("n").alias("tile"), F.bitmap_bit_position("n").alias("bit"), F.floor(F.col("lon") * 100 + 0.5).alias("x"), F.floor(F.col("lat") * 100 + 0.5).alias("y")).collect()
    assert len({r["n"] for r in rows}) == len(places) and min(r["n"] for r in rows) > 0
    assert all(r["bit"] == (r["y"] % 128) * 256 + r["x"] % 256 for r in rows)
    assert len({(r["y"] // 128, r["x"] // 256, r["tile"]) for r in rows}) == len({r["tile"] for r in rows})


def test_a_hot_tile_is_dealt_out(spark):
    probe = spark.range(4000).select("id", F.lit(1.0).alias("lon"), F.lit(2.0).alias("lat"))
    number = cells.cell_number(F.col("lon"), F.col("lat"))
    sets = cells.cell_sets(spark.createDataFrame([(1.0, 2.01)], "lon double, lat double"), number, [])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        left = cells.outside(probe, number, sets, [], hot_rows=1000)
        per_task = [len(part) for part in left.rdd.glom().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(per_task) == 4000 and max(per_task) < 2400


def brute_first(values, bands):
    out = []
    for i, v in values:
        held = [b for b in bands if v is not None and b[1] is not None and b[2] is not None and b[1] <= v < b[2]]
        out.append((i, min(held, key=lambda b: b[0])[0] if held else None))
    return sorted(out)


def test_first_match_equals_brute_force(spark):
    rng, inf = random.Random(2), float("inf")
    bands = [(i, a := rng.uniform(-100, 100), a + rng.choice([1e-9, 0.5, 3, 40, 1e5, 0, -1])) for i in range(200)]
    bands += [(300, -inf, -90.0), (301, 95.0, inf), (302, -inf, inf), (303, None, 1.0), (304, 5.0, float("nan")), (305, 1e300, 1.5e300), (306, -1.7e308, 1.7e308), (307, 0.0, 5e-324)]
    values = [(i, rng.uniform(-150, 150)) for i in range(500)] + [(600, None), (601, inf), (602, -inf), (603, 1.2e300), (604, 0.0)]
    values += [(700 + i, b[1]) for i, b in enumerate(bands[:100])] + [(900 + i, b[2]) for i, b in enumerate(bands[:100])]
    for some in (bands, bands[:200], []):
        table = spark.createDataFrame(some, "band int, low double, high double")
        rows = spark.createDataFrame([*values, (9999, float("nan"))], "id int, v double")
        got = ranges.first_match(rows, table, "id", "v", "band")
        assert got.columns == ["id", "v", "band", "low", "high"]
        assert sorted((r["id"], r["band"]) for r in got.collect()) == [*brute_first(values, some), (9999, None)]


def test_ranges_meet_values_in_an_equi_join_only(spark):
    table = spark.range(1000).select(F.col("id").alias("band"), (F.col("id") * 3.0).alias("low"), (F.col("id") * 3.0 + 2).alias("high"))
    got = ranges.matches(spark.range(3000).select("id", F.col("id").cast("double").alias("v")), table, "v")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert got.count() == 2000 and all(math.fmod(r["v"], 3) < 2 for r in got.collect())


def test_ranges_over_one_value_are_not_all_met(spark):
    table = spark.range(600).selectExpr("id as band", "cast((id * 37) % 150 as double) as low", "cast((id * 37) % 150 + 40 + id % 7 as double) as high")
    few = ranges.firsts(table, "band")
    bounds = table.select("low").union(table.select("high")).distinct().count()
    held = sorted((r["_from"], r["_to"], r["_first"]["band"]) for r in few.collect())
    assert len(held) < bounds and all(a[1] <= b[0] for a, b in zip(held, held[1:]))
    values = spark.range(800).select("id", (F.col("id") / 4).alias("v"))
    assert ranges.matches(values, table, "v").count() > 100 * 600
    assert ranges.matches(values, few, "v", "_from", "_to").count() <= 800
    rows = [(r["band"], r["low"], r["high"]) for r in table.collect()]
    got = sorted((r["id"], r["band"]) for r in ranges.first_match(values, table, "id", "v", "band").collect())
    assert got == brute_first([(i, i / 4) for i in range(800)], rows)
