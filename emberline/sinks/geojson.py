"""Layer sinks: GeoJSON features as newline-delimited text, one metadata document, and a Parquet twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from emberline.operators.space import morton_order
from emberline.schemas import LAYER_PROPERTIES, POLYGON_LAYERS, layer_schema
from emberline.sinks import versions

# Rows per output file; a layer of any size is written as many files of about this length.
ROWS_PER_FILE = 5_000_000


def feature_text(df: DataFrame, layer: str) -> Column:
    """One GeoJSON feature per row; null properties are written as null."""
    properties = F.struct(*[F.col(name) for name in LAYER_PROPERTIES[layer].fieldNames() if name in df.columns])
    iso = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"
    keep_nulls = {"ignoreNullFields": "false", "timestampFormat": iso}
    if layer not in POLYGON_LAYERS:
        geometry = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
        return F.to_json(
            F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties")), keep_nulls
        )
    # Shapes are raw JSON text and are placed as such, whatever their depth; only line breaks have to go.
    numbers = F.regexp_replace("geometry.coordinates", r"\s+", "")
    shape = F.when(
        F.col("geometry").isNotNull(),
        F.concat(F.lit('{"type":"'), F.col("geometry.type"), F.lit('","coordinates":'), numbers, F.lit("}")),
    )
    return F.concat(
        F.lit('{"type":"Feature","geometry":'),
        F.coalesce(shape, F.lit("null")),
        F.lit(',"properties":'),
        F.to_json(properties, keep_nulls),
        F.lit("}"),
    )


def write_features(df: DataFrame, layer: str, path: str) -> None:
    """Replace ``path`` by the features of ``df``, one JSON document per line."""
    text = df.select(feature_text(df, layer).alias("value"))
    text.write.mode("overwrite").option("maxRecordsPerFile", ROWS_PER_FILE).option("partitionOverwriteMode", "static").text(path)


def write_table(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Replace the Parquet twin at ``path``.

    A partitioned table is rebalanced on its partition column, which splits large partitions and joins
    small ones; rows are then sorted along a Morton curve, so that bounding boxes skip row groups in both directions.
    """
    out = df.hint("rebalance", partition_by) if partition_by else df
    if {"lon", "lat"} <= set(df.columns):
        out = out.sortWithinPartitions(*([partition_by] if partition_by else []), morton_order("lon", "lat"))
    writer = out.write.mode("overwrite").option("maxRecordsPerFile", ROWS_PER_FILE).option("partitionOverwriteMode", "static")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)


def write_metadata(row: DataFrame, path: str) -> None:
    """Replace ``path`` by the one-row metadata document."""
    row.write.mode("overwrite").option("ignoreNullFields", "false").option("partitionOverwriteMode", "static").json(path)


def write_layer(
    df: DataFrame,
    layer: str,
    describe: Callable[[DataFrame], DataFrame],
    path: str,
    partition_by: str | None = None,
    rejected: Callable[[], int] | None = None,
    keep: int = versions.KEEP,
) -> str:
    """Write a layer as a new version: ``table`` (Parquet), ``features`` (GeoJSON lines), ``metadata``; returns its folder.

    The table is written first; features and metadata (``describe`` of the table) are made from it, so the layer is
    computed once, and its rows are counted while they are written. The manifest comes last: until it stands, readers
    have the version before. ``rejected`` tells after the write how many records its sources rejected. The newest
    ``keep`` versions stay.
    """
    spark = df.sparkSession
    number, folder = versions.begin(spark, path)
    place, counted = f"{path}/versions/{folder}", Observation()
    write_table(df.observe(counted, F.count("*").alias("rows")), f"{place}/table", partition_by)
    stored = spark.read.schema(df.schema).parquet(f"{place}/table")
    write_features(stored, layer, f"{place}/features")
    write_metadata(describe(stored), f"{place}/metadata")
    versions.commit(spark, path, number, folder, counted.get["rows"], rejected() if rejected else None)
    versions.expire(spark, path, keep)
    return place


def write_empty_layer(spark: SparkSession, layer: str, error: str, generated_at: str, path: str) -> None:
    """An empty but valid layer whose metadata carries ``error``."""
    empty = spark.createDataFrame([], layer_schema(layer))
    note = spark.createDataFrame([(generated_at, error, 0)], "generated_at string, error string, total bigint")
    write_layer(empty, layer, lambda _: note, path)
