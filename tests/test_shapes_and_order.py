"""Envelopes of shapes, and row groups that a small box opens under either sort order."""

import glob
import random

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from emberline.operators import shapes
from emberline.operators.space import morton_order
from emberline.schemas import SHAPE, layer_schema
from emberline.sinks.geojson import write_table


def test_envelopes(spark):
    given = [
        ("Point", "[1.5, -2]", (1, 1.5, -2.0, 1.5, -2.0)),
        ("LineString", "[[1,2],[3,-4]]", (2, 1.0, -4.0, 3.0, 2.0)),
        ("Polygon", "[[[1,2],[3,4.5],[1,2]],[[9,9],[-1,0]]]", (5, -1.0, 0.0, 9.0, 9.0)),
        ("MultiPolygon", "[[[[1,2,7],[3,4]]],[[[8,-8]],[[0,0]]]]", (4, 0.0, -8.0, 8.0, 4.0)),
        ("MultiPolygon", "[[], [[]], [[[1]]], [[[1, null]]]]", (0, None, None, None, None)),
        ("Polygon", "[]", (0, None, None, None, None)),
        ("Polygon", "no list", (0, None, None, None, None)),
        ("GeometryCollection", "[[1,2]]", (0, None, None, None, None)),
        ("Polygon", None, (0, None, None, None, None)),
        (None, None, (0, None, None, None, None)),
    ]
    rows = [(i, (kind, text) if kind else None) for i, (kind, text, _) in enumerate(given)]
    df = spark.createDataFrame(rows, "id int, geometry " + SHAPE.simpleString())
    got = shapes.with_envelope(df).orderBy("id").select("n_vertices", "west", "south", "east", "north").collect()
    assert [tuple(r) for r in got] == [expected for *_, expected in given]
    inside = shapes.touching_bbox(shapes.with_envelope(df), 2.0, -9.0, 2.5, 5.0)
    assert sorted(r["id"] for r in inside.collect()) == [1, 2, 3]


def test_morton_numbers_interleave_bits(spark):
    cells = [(random.Random(i).randrange(65536), random.Random(-i).randrange(65536)) for i in range(1, 60)]
    places = [((x + 0.5) / 65535 * 360 - 180, (y + 0.5) / 65535 * 180 - 90) for x, y in cells]
    rows = spark.createDataFrame(places, "lon double, lat double").select(morton_order("lon", "lat").alias("m")).collect()
    expected = [sum((x >> b & 1) << 2 * b | (y >> b & 1) << 2 * b + 1 for b in range(16)) for x, y in cells]
    assert [r["m"] for r in rows] == expected
    edge = spark.createDataFrame([(500.0, 95.0), (180.0, 90.0), (None, 1.0), (float("nan"), 1.0), (float("inf"), 90.0)], "lon double, lat double")
    got = [r["m"] for r in edge.select(morton_order("lon", "lat").alias("m")).collect()]
    assert got == [2**32 - 1, 2**32 - 1, None, None, 2**32 - 1]


def opened(path, west, south, east, north):
    """Row groups whose statistics let them hold places of the box, and all."""
    found = total = 0
    for file in glob.glob(f"{path}/*.parquet"):
        meta = pq.ParquetFile(file).metadata
        names = meta.schema.names
        for i in range(meta.num_row_groups):
            lon, lat = (meta.row_group(i).column(names.index(name)).statistics for name in ("lon", "lat"))
            total += 1
            found += lon.min <= east and lon.max >= west and lat.min <= north and lat.max >= south
    return found, total


def test_boxes_open_fewer_row_groups_than_under_latitude_order(spark, tmp_path):
    schema = layer_schema("hotspots")
    rows = spark.range(120_000).select(
        (F.rand(1) * 360 - 180).alias("lon"), (F.rand(2) * 180 - 90).alias("lat"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in schema if f.name not in ("lon", "lat")]
    ).coalesce(1)
    spark.conf.set("parquet.block.size", "16384")
    try:
        write_table(rows, f"{tmp_path}/morton")
        rows.sortWithinPartitions(F.floor("lat"), F.floor("lon")).write.parquet(f"{tmp_path}/latitude")
    finally:
        spark.conf.unset("parquet.block.size")
    rng = random.Random(3)
    for side in (1, 5, 10, 20):
        corners = [(rng.uniform(-180, 180 - side), rng.uniform(-90, 90 - side)) for _ in range(40)]
        boxes = [(x, y, x + side, y + side) for x, y in corners]
        (morton, total), (latitude, _) = ([sum(n) for n in zip(*(opened(f"{tmp_path}/{order}", *box) for box in boxes))] for order in ("morton", "latitude"))
        print(f"{side} degrees: of {total / 40:.0f} row groups {morton / 40:.1f} in Morton order, {latitude / 40:.1f} by latitude, then longitude")
        assert total > 2000 and (morton < 0.6 * latitude if side >= 10 else morton < 4 * 40)
