"""The active fire panel kept up by sums: each pull leaves one small row, and the panel merges the rows when it is read.

A pull's detections and perimeters are read once, when they land. The state is a folder per pull, which a repeated pull
replaces; rows of sums merge in any order, so neither late pulls nor repeated ones change what the panel says of the
whole. An interrupted store leaves its pull out of the panel until it is repeated.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from emberline.operators import summaries
from emberline.schemas import layer_schema

DETECTIONS, PERIMETERS = "detections", "perimeters"


def _write(row: DataFrame, path: str, kind: str, pull: str) -> None:
    writer = row.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "static")
    writer.parquet(f"{path}/{kind}/pull={pull}")


def store_detections(hotspots: DataFrame, path: str, pull: str) -> None:
    """Leave the sums of one pull's detections under its name, in place of any it had."""
    _write(hotspots.agg(*summaries.detection_sums()), path, DETECTIONS, pull)


def store_perimeters(perimeters: DataFrame, path: str, pull: str) -> None:
    """The same of one pull's perimeters; ties for the largest fire go to the first name, country and source."""
    _write(perimeters.agg(*summaries.perimeter_sums("name", "country", "source")), path, PERIMETERS, pull)


def _states(spark: SparkSession, path: str, kind: str, layer: str, sums: list) -> DataFrame:
    schema = spark.createDataFrame([], layer_schema(layer)).agg(*sums).schema
    try:
        return spark.read.schema(schema).option("basePath", f"{path}/{kind}").parquet(f"{path}/{kind}")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def read_sums(spark: SparkSession, path: str) -> DataFrame:
    """One row of the sums over all stored pulls; zeros where there is none."""
    hot = _states(spark, path, DETECTIONS, "hotspots", summaries.detection_sums())
    fires = _states(spark, path, PERIMETERS, "perimeters", summaries.perimeter_sums("name", "country", "source"))
    return summaries.merged_sums(hot, fires)


def read_panel(spark: SparkSession, path: str, loading: bool = False) -> DataFrame:
    """The active fire panel over all stored pulls."""
    return summaries.active_fire_panel(read_sums(spark, path), loading)
