import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from emberline.operators import detections as det
from emberline.operators.positions import decimate, with_position
from emberline.operators.skew import anti_join

RAW = "id long, source_name string, latitude string, longitude string, frp string, confidence string, acq_date string, acq_time string, daynight string"


def raw(spark, *rows):
    return spark.createDataFrame(list(rows), RAW)


def test_normalize(spark):
    rows = det.normalize(
        raw(
            spark,
            (1, "VIIRS_SNPP_NRT", "10.5", "-100.25", "12.3", "h", "2024-01-02", "0930", "D"),
            (2, "MODIS_NRT", "bad", "1", "5", "90", "2024-01-02", "0930", "D"),
            (3, "MODIS_NRT", "0", "1", "", None, "2024-01-02", "", "N"),
            (4, "MODIS_NRT", None, "1", "5", "90", "2024-01-02", "0930", "D"),
            (5, "OTHER", "1", "1", "5", "90", "2024-01-02", "0930", "D"),
            (6, "MODIS_NRT", "1", "1", "abc", "90", None, None, None),
        ),
        keep=["id"],
    ).collect()
    by_id = {r["id"]: r for r in rows}
    assert set(by_id) == {1, 3, 6}
    assert (by_id[1]["source"], by_id[1]["resolution_m"], by_id[1]["intensity"], by_id[1]["daynight"]) == (
        "VIIRS (Suomi NPP)", 375, "moderate", "Day")
    assert by_id[1]["acq_datetime"] == "2024-01-02 09:30Z" and by_id[1]["acq_date"] == dt.date(2024, 1, 2)
    assert (by_id[3]["frp"], by_id[3]["intensity"], by_id[3]["confidence"], by_id[3]["acq_datetime"], by_id[3]["daynight"]) == (
        None, "unknown", "n", "2024-01-02", "Night")
    assert (by_id[6]["frp"], by_id[6]["acq_datetime"], by_id[6]["acq_ts"], by_id[6]["daynight"]) == (None, "", None, "Day")


def _random_hits(n, seed=3):
    rng = random.Random(seed)
    for i in range(n):
        # A third of all rows burn in one cell.
        place = (1.0, 1.0) if rng.random() < 0.33 else (rng.randrange(300) / 100, rng.randrange(3) / 100)
        sensor = rng.choice(["VIIRS (Suomi NPP)", "MODIS (Terra/Aqua)", "OTHER"])
        yield (i, *place, sensor, dt.date(2024, 1, 1 + rng.randrange(3)))


HITS = "id int, lon double, lat double, source string, acq_date date"


def _brute(rows, scope):
    def key(r):
        cell = (math.floor(r[1] * 100 + 0.5), math.floor(r[2] * 100 + 0.5))
        return cell if scope == "batch" else (*cell, r[4])

    seen = {key(r) for r in rows if "VIIRS" in r[3]}
    return sorted(r[0] for r in rows if "MODIS" not in r[3] or key(r) not in seen)


@pytest.mark.parametrize("scope", ["batch", "day"])
@pytest.mark.parametrize("skew", [{}, {"hot_rows": 5}, {"hot_rows": 5, "max_hot_keys": 1}])
def test_dedup_equals_brute_force(spark, scope, skew):
    rows = list(_random_hits(3000))
    df = spark.createDataFrame(rows, HITS).repartition(5)
    got = det.dedup_cross_sensor(df, scope=scope, **skew)
    assert sorted(r["id"] for r in got.collect()) == _brute(rows, scope)
    assert set(got.columns) == set(df.columns)


def test_dedup_keeps_fine_rows_and_is_idempotent(spark):
    df = spark.createDataFrame(list(_random_hits(500)), HITS)
    once = det.dedup_cross_sensor(df)
    assert once.where("source like '%VIIRS%'").count() == df.where("source like '%VIIRS%'").count()
    assert det.dedup_cross_sensor(once).count() == once.count()


def test_anti_join_keeps_null_keys_and_uncovered_hot_keys(spark):
    probe = spark.createDataFrame([(None,)] * 50 + [(1,)] * 50 + [(2,)] * 50 + [(3,)] * 2, "k long")
    seen = spark.createDataFrame([(2,), (3,), (9,)], "k long")
    left = anti_join(probe, seen, ["k"], hot_rows=10).groupBy("k").count().collect()
    assert {r["k"]: r["count"] for r in left} == {None: 50, 1: 50}


def test_uncovered_hot_key_is_spread_over_tasks(spark):
    probe = spark.range(4000).select((F.col("id") * 0 + 1).alias("k"), "id").union(spark.range(100).select((F.col("id") + 5).alias("k"), "id"))
    seen = spark.range(50).select((F.col("id") + 5).alias("k"))
    before = {n: spark.conf.get(n) for n in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        left = anti_join(probe, seen, ["k"], hot_rows=1000)
        sizes = [r["count"] for r in left.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert sum(sizes) == 4050 and len(sizes) == 4 and max(sizes) < 1500


def test_dedup_plan_has_no_cross_join(spark):
    df = spark.createDataFrame(list(_random_hits(100)), HITS)
    plan = det.dedup_cross_sensor(df)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("buckets", [1, 7, None])
def test_positions_keep_null_nan_and_infinite_keys_and_split_ties(spark, buckets):
    special = [None, None, float("nan"), float("inf"), float("-inf"), -0.0, 0.0]
    keys = special + [float(i) for i in range(50)] + [5.0] * 300 + [None] * 100
    rows = [(i, key) for i, key in enumerate(keys)]
    rank = lambda k: (0, 0.0) if k is None else (2, 0.0) if k != k else (1, k + 0.0)
    expected = {i: n for n, (i, _) in enumerate(sorted(rows, key=lambda r: (rank(r[1]), r[0])))}
    df = spark.createDataFrame(rows, "id int, k double").repartition(4)
    placed = with_position(df, "k", "id", buckets=buckets)
    assert {r["id"]: r["position"] for r in placed.collect()} == expected
    assert with_position(df.limit(0), "k", "id", buckets=buckets).count() == 0


def test_lookback(spark):
    now = dt.datetime(2024, 1, 10, 12)
    times = [now, now - dt.timedelta(hours=23), now - dt.timedelta(days=1), now - dt.timedelta(days=2), now + dt.timedelta(hours=1)]
    df = spark.createDataFrame([(i, t, t.date()) for i, t in enumerate(times)], "id int, acq_ts timestamp_ntz, acq_date date")
    assert {r["id"] for r in det.lookback(df, now).collect()} == {0, 1}
    assert {r["id"] for r in det.lookback(df, now, 2).collect()} == {0, 1, 2}
    with pytest.raises(ValueError):
        det.lookback(df, now, 11)


def test_lookback_prunes_partitions(spark, tmp_path):
    days = [(dt.datetime(2024, 1, d, 5), dt.date(2024, 1, d)) for d in range(1, 20)]
    spark.createDataFrame(days, "acq_ts timestamp_ntz, acq_date date").write.partitionBy("acq_date").parquet(str(tmp_path / "t"))
    plan = det.lookback(spark.read.parquet(str(tmp_path / "t")), dt.datetime(2024, 1, 10))._jdf.queryExecution().toString()
    assert "acq_date" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_visibility(spark):
    df = spark.createDataFrame([(i,) for i in ("low", "high", "unknown")], "intensity string")
    assert {r[0] for r in det.visible(df, ["low", "unknown"]).collect()} == {"high", "unknown"}
    assert det.visible(df).count() == 3


@pytest.mark.parametrize("buckets", [1, 3, 16])
def test_positions_match_a_full_sort(spark, buckets):
    rng = random.Random(1)
    ids = rng.sample(range(10**6), 700)
    df = spark.createDataFrame([(i, f"t{i % 7}") for i in ids], "id long, tag string").repartition(6)
    got = {r["id"]: r["position"] for r in with_position(df, "id", buckets=buckets).collect()}
    assert got == {i: p for p, i in enumerate(sorted(ids))}


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "date"])
def test_positions_by_time_with_ties(spark, kind):
    start = dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(days=i % 40), i) for i in range(300)]
    df = spark.createDataFrame(rows, "t timestamp_ntz, id int").select(F.col("t").cast(kind), "id").repartition(5)
    got = {r["id"]: r["position"] for r in with_position(df, "t", "id", buckets=8).collect()}
    assert got == {i: p for p, (_, i) in enumerate(sorted(rows))}
    with pytest.raises(TypeError):
        with_position(df.withColumn("s", F.lit("a")), "s")


def test_decimation(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["extreme", "high", "moderate", "low", "unknown"])) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, intensity string").repartition(7)
    step = {"extreme": 1, "high": 1, "moderate": 3}
    expected = {i for p, (i, s) in enumerate(rows) if p % step.get(s, 8) == 0}
    assert {r["id"] for r in decimate(df, "id", buckets=5).collect()} == expected


def test_dedup_keeps_rows_without_a_source(spark):
    rows = [(1.0, 1.0, "2024-01-01", None), (1.0, 1.0, "2024-01-01", "VIIRS_SNPP_NRT")]
    frame = spark.createDataFrame(rows, "lat double, lon double, acq_date string, source string")
    assert det.dedup_cross_sensor(frame).where("source is null").count() == 1
