"""Layers are replaced as a whole: what fails on the way leaves the version before."""

import os

import pytest
from pyspark.sql import functions as F

from emberline.operators import summaries
from emberline.schemas import LAYER_NAMES, layer_schema
from emberline.sinks import geojson, versions
from emberline.sources import layers


def points(spark, *places):
    return spark.createDataFrame([(float(x), float(y)) + (None,) * 7 for x, y in places], layer_schema("hotspots"))


def write(spark, path, *places, **more):
    return geojson.write_layer(points(spark, *places), "hotspots", lambda t: summaries.hotspot_metadata(t, "g"), str(path), **more)


def seen(spark, path):
    rows = sorted((r["lon"], r["lat"]) for r in layers.read_layer(spark, "hotspots", str(path)).rows.collect())
    return rows, layers.read_metadata(spark, str(path)).first()["metadata"]["total_hotspots"]


@pytest.mark.parametrize("step", ["write_table", "write_features", "write_metadata", "versions.commit"])
def test_a_rerun_that_fails_leaves_the_layer_before(spark, tmp_path, monkeypatch, step):
    first = write(spark, tmp_path, (1, 2))

    def fail(*_, **__):
        raise OSError("disk full")

    with monkeypatch.context() as patch:
        patch.setattr(versions if "." in step else geojson, step.rpartition(".")[2], fail)
        with pytest.raises(OSError):
            write(spark, tmp_path, (3, 4), (5, 6))
    assert seen(spark, tmp_path) == ([(1.0, 2.0)], "1")
    assert versions.current(spark, str(tmp_path)) == first
    second = write(spark, tmp_path, (3, 4), (5, 6))
    assert seen(spark, tmp_path) == ([(3.0, 4.0), (5.0, 6.0)], "2")
    # the later write leaves nothing of the failed one
    assert sorted(os.listdir(tmp_path / "versions")) == sorted(os.path.basename(p) for p in (first, second))


def test_a_plan_that_fails_while_it_is_written_leaves_the_layer_before(spark, tmp_path):
    write(spark, tmp_path, (1, 2))
    broken = points(spark, (3, 4)).withColumn("lon", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        geojson.write_layer(broken, "hotspots", lambda t: summaries.hotspot_metadata(t, "g"), str(tmp_path))
    assert seen(spark, tmp_path) == ([(1.0, 2.0)], "1")


def test_a_reader_keeps_its_version_while_a_new_one_is_written(spark, tmp_path):
    write(spark, tmp_path, (1, 2))
    held = layers.read_layer(spark, "hotspots", str(tmp_path)).rows
    write(spark, tmp_path, (3, 4))
    assert [r["lon"] for r in held.collect()] == [1.0]


def test_old_versions_expire_by_count_and_rows_are_told(spark, tmp_path):
    for i in range(5):
        write(spark, tmp_path, *[(i, n) for n in range(i)], keep=2, rejected=lambda i=i: 10 + i)
    rows = [(r["version"], r["rows"], r["rejected"]) for r in versions.manifests(spark, str(tmp_path)).collect()]
    assert rows == [(4, 3, 13), (5, 4, 14)]
    assert len(os.listdir(tmp_path / "versions")) == 2
    assert seen(spark, tmp_path)[1] == "4"
    assert versions.expire(spark, str(tmp_path), keep=1) and len(os.listdir(tmp_path / "versions")) == 1
    assert seen(spark, tmp_path)[1] == "4"


def test_a_layer_without_a_version_is_an_error_of_its_reader(spark, tmp_path):
    assert layers.read_layer(spark, "hotspots", str(tmp_path / "none")).error
    os.makedirs(tmp_path / "versions" / "0000000001-half" / "table")
    assert layers.read_layer(spark, "hotspots", str(tmp_path)).error
    assert versions.expire(spark, str(tmp_path)) == []


@pytest.mark.parametrize("layer", LAYER_NAMES)
def test_empty_layers_count_no_rows(spark, tmp_path, layer):
    geojson.write_empty_layer(spark, layer, "down", "g", str(tmp_path))
    assert [r["rows"] for r in versions.manifests(spark, str(tmp_path)).collect()] == [0]
