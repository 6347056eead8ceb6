"""Panel summaries and layer metadata: one pass over each layer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions import tables
from emberline.functions.semantics import grouped, whole


def _merge_rows(*rows: DataFrame) -> DataFrame:
    """One-row frames with different columns side by side, without a cross join."""
    head, *rest = rows
    for row in rest:
        head = head.unionByName(row, allowMissingColumns=True)
    return head.agg(*[F.max(name).alias(name) for name in head.columns])


def _filled(sentence: str, *values: Column) -> Column:
    """``sentence`` with each pair of braces filled by a text."""
    first, *rest = sentence.split("{}")
    return F.concat(F.lit(first), *[part for value, text in zip(values, rest) for part in (value, F.lit(text))])


def situation_text(detections: Column, extreme: Column, perimeters: Column, hectares: Column, loading: Column) -> Column:
    """The sentence above the active fire panel."""
    said = tables.SITUATION_TEXT
    urgent = F.when(extreme > 0, _filled(said["extreme"], extreme.cast("string"))).otherwise("")
    area = F.when(perimeters > 0, _filled(said["perimeters"], perimeters.cast("string"), grouped(whole(hectares)))).otherwise("")
    return (
        F.when(loading, said["loading"])
        .when(detections == 0, said["none"])
        .otherwise(F.concat(_filled(said["detections"], grouped(detections)), urgent, area))
    )


def detection_sums() -> list[Column]:
    """What the active fire panel needs of detections; sums of such rows are again such a row."""
    return [
        F.count("*").alias("total_detections"),
        F.count_if(F.col("intensity") == "extreme").alias("extreme_detections"),
        F.count_if(F.col("intensity") == "high").alias("high_detections"),
    ]


def perimeter_sums(*ids: str) -> list[Column]:
    """What the panel needs of perimeters: their number, areas as decimals, and the largest fire with its rank."""
    rank = F.when(F.col("hectares") > 0, F.struct((-F.col("hectares")).alias("_size"), *ids))
    return [
        F.count("*").alias("total_perimeters"),
        F.sum(F.col("hectares").cast("decimal(20,1)")).alias("_hectares"),
        F.min_by(F.struct("name", "hectares", "country", "source"), rank).alias("_largest"),
        F.min(rank).alias("_rank"),
    ]


def merged_sums(detections: DataFrame, perimeters: DataFrame) -> DataFrame:
    """Rows of :func:`detection_sums` and :func:`perimeter_sums`, of any parts in any order, as one row of both."""
    names = ("total_detections", "extreme_detections", "high_detections")
    hot = detections.agg(*[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in names])
    fires = perimeters.agg(
        F.coalesce(F.sum("total_perimeters"), F.lit(0)).alias("total_perimeters"),
        F.coalesce(F.sum("_hectares"), F.lit(0)).cast("double").alias("total_hectares"),
        F.min_by("_largest", "_rank").alias("_largest"),
    )
    return _merge_rows(hot, fires)


def active_fire_summary(hotspots: DataFrame, perimeters: DataFrame, *ids: str, loading: bool = False) -> DataFrame:
    """Counts, burned area, largest fire and the situation sentence, in one row.

    ``ids`` are perimeter columns that break ties for the largest fire.
    """
    number, area, largest, _ = perimeter_sums(*ids)
    fires = perimeters.agg(number, area, largest).withColumn("total_hectares", F.coalesce("_hectares", F.lit(0)).cast("double")).drop("_hectares")
    return active_fire_panel(_merge_rows(hotspots.agg(*detection_sums()), fires), loading)


def active_fire_panel(row: DataFrame, loading: bool = False) -> DataFrame:
    """The panel of one row of sums."""
    total = F.col("total_hectares")
    top = F.col("_largest")
    return row.select(
        "total_detections",
        "extreme_detections",
        "high_detections",
        "total_perimeters",
        "total_hectares",
        F.concat(grouped(F.col("total_detections")), F.lit(" active fire detections")).alias("badge"),
        F.when(total > 0, F.concat(grouped(whole(total)), F.lit(" ha"))).otherwise("N/A").alias("total_area"),
        top["name"].alias("largest_name"),
        F.concat(grouped(whole(top["hectares"])), F.lit(" ha")).alias("largest_area"),
        top["country"].alias("largest_country"),
        top["source"].alias("largest_source"),
        situation_text(
            F.col("total_detections"), F.col("extreme_detections"), F.col("total_perimeters"), total, F.lit(loading)
        ).alias("situation"),
    )


def alert_text(extreme: Column, very_high: Column, escalating: Column, loading: Column) -> Column:
    """The forecast alert sentence."""
    said = tables.ALERT_TEXT
    rising = F.when(escalating > 0, _filled(said["escalating"], escalating.cast("string"))).otherwise("")
    return (
        F.when(loading, said["loading"])
        .when(extreme > 0, F.concat(_filled(said["extreme"], extreme.cast("string")), rising, F.lit(said["advice"])))
        .when(very_high > 0, _filled(said["very_high"], very_high.cast("string")))
        .otherwise(said["calm"])
    )


def prefire_summary(fwi: DataFrame, loading: bool = False) -> DataFrame:
    """Zone counts, their colours and the forecast alert, in one row."""
    counts = fwi.agg(
        F.count_if(F.col("risk_class") == "extreme").alias("extreme_zones"),
        F.count_if(F.col("risk_class") == "very_high").alias("very_high_zones"),
        F.count_if(F.col("trend") == "escalating").alias("escalating_zones"),
    )
    extreme, very_high, rising = F.col("extreme_zones"), F.col("very_high_zones"), F.col("escalating_zones")
    calm = "#38A800"
    return counts.select(
        "*",
        F.when(extreme > 0, "#AA0000").otherwise(calm).alias("extreme_color"),
        F.when(very_high > 0, "#FF4400").otherwise(calm).alias("very_high_color"),
        F.when(rising > 0, "#FF8800").otherwise(calm).alias("escalating_color"),
        alert_text(extreme, very_high, rising, F.lit(loading)).alias("alert"),
    )


def _described(layer: str, generated_at: str, aggregated: DataFrame) -> DataFrame:
    texts = {"generated_at": generated_at, **tables.METADATA_TEXT[layer]}
    return aggregated.select(*[F.lit(v).alias(k) for k, v in texts.items()], "*")


def _text_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(part) for pair in values.items() for part in pair])


def hotspot_metadata(df: DataFrame, generated_at: str, lookback_days: int = 1) -> DataFrame:
    row = df.agg(F.count("*").alias("total_hotspots"))
    return _described("hotspots", generated_at, row).select(
        "*", F.lit(lookback_days).alias("lookback_days"), _text_map(tables.INTENSITY_SCALE).alias("intensity_scale")
    )


def weather_metadata(responses: DataFrame, generated_at: str, step: float = tables.GRID_STEP) -> DataFrame:
    """Points and errors of the landed responses, errors being those without current readings."""
    row = responses.agg(
        F.count("current").alias("total_points"), F.count_if(F.col("current").isNull()).alias("errors")
    )
    return _described("weather", generated_at, row).withColumn("grid_step_deg", F.lit(step))


def fwi_metadata(df: DataFrame, generated_at: str, step: float = tables.GRID_STEP) -> DataFrame:
    classes = F.create_map(
        *[
            part
            for low, high, cls, color, label in tables.FWI_CLASSES
            for part in (
                F.lit(cls),
                F.struct(F.lit(f"{low}–{high}").alias("range"), F.lit(color).alias("color"), F.lit(label).alias("label")),
            )
        ]
    )
    row = df.agg(F.count("*").alias("total_points"))
    return _described("fwi", generated_at, row).select(
        "*", classes.alias("fwi_classes"), F.lit(step).alias("grid_step_deg")
    )


def perimeter_metadata(df: DataFrame, generated_at: str) -> DataFrame:
    from emberline.operators.perimeters import perimeter_totals

    sources = tables.METADATA_TEXT["perimeters"]
    row = _described("perimeters", generated_at, perimeter_totals(df)).drop(*sources)
    return row.withColumn("sources", _text_map({"USA": sources["source_usa"], "Mexico": sources["source_mexico"]}))


def infrastructure_metadata(df: DataFrame, generated_at: str, bbox: str = tables.INFRA_BBOX) -> DataFrame:
    from emberline.operators.infrastructure import type_counts

    return _described("infrastructure", generated_at, type_counts(df)).withColumn("bbox", F.lit(bbox))
