"""The active fire panel from stored sums against a scan of everything that has landed."""

import random

from emberline.operators import summaries
from emberline.schemas import layer_schema
from emberline.streaming import panels


def detections(spark, rng, n):
    rows = [(0.0, 0.0, None, None, None, rng.choice(["low", "high", "extreme", "unknown", None]), None, None, None) for _ in range(n)]
    return spark.createDataFrame(rows, layer_schema("hotspots"))


def perimeters(spark, rng, n):
    names = layer_schema("perimeters").fieldNames()
    rows = []
    for _ in range(n):
        row = {"name": rng.choice("abc"), "hectares": rng.choice([None, 0.0, 0.1, 0.2, 0.3, 7.7, 7.7]), "country": rng.choice(["USA", "Mexico"]), "source": "s"}
        rows.append(tuple(row.get(name) for name in names))
    return spark.createDataFrame(rows, layer_schema("perimeters"))


def test_panel_of_pulls_in_any_order_and_a_repeated_one(spark, tmp_path):
    rng = random.Random(9)
    pulls = {f"2024-01-0{i}": (detections(spark, rng, n), perimeters(spark, rng, n)) for i, n in enumerate((0, 3, 40, 1, 25))}
    hot = fires = None
    for left, right in pulls.values():
        hot, fires = (left, right) if hot is None else (hot.unionByName(left), fires.unionByName(right))
    whole = summaries.active_fire_summary(hot, fires, "name", "country", "source").collect()
    for order in (sorted(pulls), sorted(pulls, reverse=True), [*sorted(pulls), "2024-01-02", "2024-01-00"]):
        path = f"{tmp_path}/{'-'.join(order)[:40]}{len(order)}"
        for pull in order:
            panels.store_perimeters(pulls[pull][1], path, pull)
            panels.store_detections(pulls[pull][0], path, pull)
        assert panels.read_panel(spark, path).collect() == whole
    # a pull that is repeated with other rows counts with the new ones only
    panels.store_detections(detections(spark, rng, 2), path, "2024-01-02")
    assert panels.read_sums(spark, path).first()["total_detections"] == hot.count() - 38


def test_panel_without_a_pull(spark, tmp_path):
    row = panels.read_panel(spark, str(tmp_path)).first()
    assert (row["total_detections"], row["total_hectares"], row["largest_name"]) == (0, 0.0, None)
    assert row["situation"] == "No active fire detections in current view."
    assert panels.read_panel(spark, str(tmp_path), loading=True).first()["situation"].startswith("Loading")
