import datetime as dt

import pytest
from pyspark.sql import functions as F

from emberline.functions import semantics as sem
from emberline.functions.fire_weather import fwi_class
from emberline.operators.detections import acquisition_text, acquisition_time, intensity, marker_radius
from emberline.operators.perimeters import area_text
from emberline.operators.status import age_text, freshness
from emberline.operators.views import leading_parts, place_label

def x():
    return F.col("x")


@pytest.mark.parametrize(
    "text, expected",
    [("9.99", "low"), ("10", "moderate"), ("49.9", "moderate"), ("50", "high"), ("200", "extreme"), ("NaN", "extreme"),
     ("-3", "low"), ("", "unknown"), ("abc", "unknown"), ("12f", "unknown"), (None, "unknown")],
)
def test_intensity_limits(one, text, expected):
    assert one(intensity("try_cast(translate(x, 'dDfF', 'xxxx') as double)"), "x string", text) == expected


@pytest.mark.parametrize("frp, radius", [(None, 4), (0.0, 4), (9.9, 4), (10.0, 6), (50.0, 9), (199.9, 9), (200.0, 13)])
def test_marker_radius(one, frp, radius):
    assert one(marker_radius("x"), "x double", frp) == radius


@pytest.mark.parametrize(
    "value, expected",
    [(0.0, "low"), (4.9, "low"), (5.0, "moderate"), (12.0, "high"), (20.0, "very_high"), (30.0, "extreme"),
     (999.0, "extreme"), (-1.0, "extreme"), (float("nan"), "extreme"), (None, None)],
)
def test_fwi_class_limits(one, value, expected):
    assert one(F.expr(fwi_class("x")), "x double", value) == expected


@pytest.mark.parametrize("value, cell", [(0.125, 13), (1.005, 100), (2.675, 267), (-0.125, -12), (None, None), (float("inf"), None)])
def test_cell_index_on_ties(one, value, cell):
    # Keys follow floor(100 x + 0.5) of the binary value, the same in every engine.
    expected = cell if value in (None, float("inf")) else __import__("math").floor(value * 100.0 + 0.5)
    assert one(sem.cell_index(x()), "x double", value) == expected


def test_cell_ids_do_not_collide(spark):
    points = [(lon / 100, lat / 100) for lon in (-18000, -1, 0, 1, 18000) for lat in (-9000, -1, 0, 1, 9000)]
    ids = spark.createDataFrame(points, "lon double, lat double").select(sem.cell_id(F.col("lon"), F.col("lat"))).distinct()
    assert ids.count() == len(points)


@pytest.mark.parametrize("text, number", [("1.5", 1.5), (" 2 ", 2.0), ("1e3", 1000.0), ("12f", None), ("12d", None), ("", None), (None, None)])
def test_numbers(one, text, number):
    assert one(sem.number_or_null(x()), "x string", text) == number


@pytest.mark.parametrize("value", ["plain", "it's", "back\\slash", "a\\'b", 7, 2.5, None, float("-inf")])
def test_literals(one, value):
    assert one(F.expr(sem.literal(value))) == value


def test_falsy_fallbacks(one):
    schema = "a string, b string"
    pick = F.coalesce(sem.truthy_text(F.col("a"), F.col("b")), F.lit("none"))
    assert one(pick, schema, "", "b") == "b"
    assert one(pick, schema, None, "") == "none"
    assert one(sem.truthy_number(x()), "x double", 0.0) is None
    assert one(sem.truthy_number(x()), "x double", 3.0) == 3.0


@pytest.mark.parametrize(
    "date, time, text, typed",
    [("2024-01-02", "0104", "2024-01-02 01:04Z", dt.datetime(2024, 1, 2, 1, 4)),
     ("2024-01-02", "104", "2024-01-02 10:4Z", dt.datetime(2024, 1, 2, 1, 4)),
     ("2024-01-02", "", "2024-01-02", dt.datetime(2024, 1, 2)),
     ("never", "0104", "never 01:04Z", None)],
)
def test_acquisition(one, date, time, text, typed):
    schema = "d string, t string"
    assert one(acquisition_text("d", "t"), schema, date, time) == text
    assert one(acquisition_time("d", "t"), schema, date, time) == typed


@pytest.mark.parametrize(
    "age, light, words",
    [(3599, "green", "59 min ago"), (3600, "amber", "1 hr ago"), (21599, "amber", "5 hr ago"), (21600, "red", "6 hr ago"),
     (86399, "red", "23 hr ago"), (86400, "red", "1 day ago"), (172800, "red", "2 days ago"), (-60, "green", "-1 min ago"),
     (None, "red", "NaN day ago")],
)
def test_freshness_and_age(one, age, light, words):
    here = F.lit(True)
    assert one(freshness(here, x()), "x bigint", age) == light
    assert one(age_text(here, x()), "x bigint", age) == words
    assert one(freshness(F.lit(False), x()), "x bigint", age) == "unknown"
    assert one(age_text(F.lit(False), x()), "x bigint", age) == "Unknown"


@pytest.mark.parametrize("ha, text", [(0.0, "N/A"), (None, "N/A"), (1234.5, "1,234.5 ha"), (1234.0, "1,234 ha")])
def test_area_text(one, ha, text):
    assert one(area_text(x()), "x double", ha) == text


def test_place_texts(one):
    schema = "n string, c string, k string"
    label = place_label(F.col("n"), F.col("c"), F.col("k"))
    assert one(label, schema, "", "Oaxaca", "Mexico") == "Oaxaca, Mexico"
    assert one(label, schema, "A", None, "Mexico") == "A, Mexico"
    assert one(leading_parts(x(), 3), "x string", "a, b, c, d") == "a, b, c"
    assert one(leading_parts(x(), 3), "x string", "a") == "a"


def test_lookups(one):
    table = {"a": 1, "b": 2}
    assert one(sem.equal_lookup(x(), table, 9), "x string", "b") == 2
    assert one(sem.equal_lookup(x(), table, 9), "x string", "z") == 9
    assert one(sem.equal_lookup(x(), table, 9), "x string", None) == 9
    assert one(sem.plain_number(x()), "x double", 12.0) == "12"
    assert one(sem.plain_number(x()), "x double", 12.5) == "12.5"
