from emberline.functions.sql import register

from . import golden


def test_sql_functions(spark):
    register(spark)
    spark.createDataFrame([r[2:8] for r in golden.CURRENT], "t double, h double, w double, p double, expected double, cls string").createOrReplaceTempView("published")
    rows = spark.sql("select fwi_from_weather(t, h, w, p) i, fwi_class(fwi_from_weather(t, h, w, p)) c, expected, cls from published").collect()
    assert all((r["i"], r["c"]) == (r["expected"], r["cls"]) for r in rows)
    assert spark.sql("select fire_intensity(50), fire_intensity(null), marker_radius(9.9), round(bui(), 1), fwi_from_weather(1, 101, 1, 1)").first()[:] == (
        "high", "unknown", 4, 32.0, None)
