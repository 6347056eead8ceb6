"""Members of large JSON documents read in splits, against a parser of whole documents."""

import json
import random

import pytest

from emberline.sources.documents import read_elements, read_mexico_perimeters, read_usa_perimeters
from emberline.sources.split_json import read_members


@pytest.fixture
def tiny_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(name) for name in names]
    for name, value in zip(names, ("150", "1")):
        spark.conf.set(name, value)
    yield
    for name, value in zip(names, before):
        spark.conf.set(name, value)


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def value(rng, depth):
    kind = rng.randrange(9 if depth else 6)
    if kind < 3:
        return rng.choice(["", "}", "{", '"', "\\", '\\"', "]}{[", 'say "features": [{', "Ünï  \U0001f600", "a\nb\t}", '"features":[{"x":1}]', "\\}"])
    if kind < 6:
        return rng.choice([None, True, 0, -1.5, 10**20])
    if kind < 8:
        return {rng.choice(["a", "features", "}", "b{", "properties"]): value(rng, depth - 1) for _ in range(rng.randrange(4))}
    return [value(rng, depth - 1) for _ in range(rng.randrange(4))]


def document(rng):
    around = {name: value(rng, 3) for name in ("type", "crs", "}", "bbox", "links", "x{")}
    names = list(around) + ["features"]
    rng.shuffle(names)
    members = [{"id": i, "p": value(rng, 3)} for i in range(rng.randrange(9))]
    made = {name: members if name == "features" else around[name] for name in names}
    made |= {"links": [{"features": [{"id": "not a member"}]}, {"id": "nor this"}]}
    return made


def texts(rows):
    return sorted(json.dumps(json.loads(r["value"]), sort_keys=True) for r in rows.collect())


def test_members_equal_those_of_a_whole_parse(spark, tmp_path, tiny_splits):
    rng, expected = random.Random(11), []
    for i in range(40):
        made = document(rng)
        text = json.dumps(made, indent=rng.choice([None, None, 1]), ensure_ascii=rng.random() < 0.5)
        put(tmp_path / f"{i}.json", text + rng.choice(["", "\n", " \n\t"]))
        expected += [json.dumps(m, sort_keys=True) for m in made["features"]]
    members, broken = read_members(spark, str(tmp_path))
    assert texts(members) == sorted(expected) and broken.collect() == []


def test_one_document_is_read_by_several_tasks(spark, tmp_path, tiny_splits):
    put(tmp_path / "a.json", json.dumps({"features": [{"properties": {"poly_IncidentName": f"}}{{ {i}"}} for i in range(300)]}))
    assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 4
    scan = read_usa_perimeters(spark, str(tmp_path), split=True)
    assert sorted(r["properties"]["poly_IncidentName"] for r in scan.rows.collect()) == sorted(f"}}{{ {i}" for i in range(300))
    assert scan.rejects.count() == 0


@pytest.mark.parametrize("tail", ['{"features": [{"a": 1', '{"features": [{"a": 1}', '{"features": [{"a": 1}]', '{"features": [{"a": "}]}', '{"features": [{"a": 1}]}}', '{"features": [{"a": 1}]} x'])
def test_documents_that_end_early_are_reported_whole(spark, tmp_path, tail):
    put(tmp_path / "bad.json", tail)
    put(tmp_path / "good.json", '{"features": [{"a": 2}, null, 3, [], {"a": {}}], "type": "x"}\n')
    members, broken = read_members(spark, str(tmp_path))
    assert texts(members) == ['{"a": 2}', '{"a": {}}']
    assert [r["path"].rpartition("/")[2] for r in broken.collect()] == ["bad.json"]


def test_documents_without_members(spark, tmp_path):
    for i, text in enumerate(["", "{}", '{"features": []}', '{"features": null}', '{"features": {"a": {}}}', '{"other": [{"a": 1}]}', '{"features": [], "z": [{"a": {}}]}']):
        put(tmp_path / f"{i}.json", text)
    members, broken = read_members(spark, str(tmp_path))
    assert members.collect() == [] and broken.collect() == []


def test_typed_readers_agree_with_those_of_whole_documents(spark, tmp_path, tiny_splits):
    shape = {"type": "Polygon", "coordinates": [[[1, 2], [3, 4.5], [1, 2]]]}
    features = [{"type": "Feature", "geometry": shape if i % 3 else None, "properties": {"SUPERFICIE": 0, "superficie": "12", "NOMBRE": f"n{i}"}} for i in range(40)]
    put(tmp_path / "m.json", json.dumps({"type": "FeatureCollection", "features": features}, separators=(",", ":")))
    elements = [{"type": "node", "id": i, "lat": 1.5, "lon": 2, "tags": {"power": "}"}} for i in range(40)]
    put(tmp_path / "osm" / "o.json", json.dumps({"version": 0.6, "osm3s": {"note": "{"}, "elements": elements}))
    for read, path in ((read_mexico_perimeters, tmp_path / "m.json"), (read_elements, tmp_path / "osm")):
        whole, split = (read(spark, str(path), split=s).rows for s in (False, True))
        assert split.schema == whole.schema and whole.count() == 40
        assert sorted(r["j"] for r in split.selectExpr("to_json(struct(*)) j").collect()) == sorted(r["j"] for r in whole.selectExpr("to_json(struct(*)) j").collect())


def test_a_missing_document_is_an_error_of_its_feed(spark, tmp_path):
    scan = read_elements(spark, str(tmp_path / "none"), split=True)
    assert scan.error and scan.rows.count() == 0
