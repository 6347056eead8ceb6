"""Layers as written by the sinks (the version in force), or as single GeoJSON documents."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline.schemas import LAYER_PROPERTIES, POLYGON_LAYERS, STRING, collection_schema, feature_schema, layer_schema, struct
from emberline.sinks import versions
from emberline.sources.scan import Scan, isolated, nothing_parsed


def flat(features: DataFrame, layer: str, keep: Iterable[str] = ()) -> DataFrame:
    """Parsed features as the flat table of ``layer``, beside the columns ``keep``."""
    if layer in POLYGON_LAYERS:
        place = [F.col("geometry")]
    else:
        place = [F.get("geometry.coordinates", i).alias(name) for i, name in ((0, "lon"), (1, "lat"))]
    taken = {"geometry"} if layer in POLYGON_LAYERS else {"lon", "lat"}
    rest = [F.col(f"properties.{n}").alias(n) for n in LAYER_PROPERTIES[layer].fieldNames() if n not in taken]
    return features.select(*keep, *place, *rest)


def read_collection(spark: SparkSession, layer: str, paths: str | list[str]) -> Scan:
    """A layer from whole GeoJSON documents (one task per document)."""

    def read() -> Scan:
        documents = spark.read.schema(collection_schema(feature_schema(layer))).option("multiLine", True).json(paths)
        broken = documents.where("_corrupt_record is not null and features is null").select("_corrupt_record")
        features = documents.select(F.explode_outer("features").alias("_f")).where("_f is not null").select("_f.*")
        return Scan(flat(features, layer), rejects=broken)

    return isolated(spark, layer_schema(layer), read)


def read_features(spark: SparkSession, layer: str, paths: str | list[str]) -> Scan:
    """A layer from GeoJSON features, one per line; lines that do not parse are rejects."""

    def read() -> Scan:
        schema = T.StructType([*feature_schema(layer).fields, T.StructField("_corrupt_record", STRING)])
        rows = spark.read.schema(schema).json(paths)
        lost = nothing_parsed(feature_schema(layer))
        broken = rows.where(lost).select("_corrupt_record")
        return Scan(flat(rows.where(~lost), layer), rejects=broken)

    return isolated(spark, layer_schema(layer), read)


def read_layer(spark: SparkSession, layer: str, path: str) -> Scan:
    """A layer from the Parquet twin of its version in force."""
    return isolated(spark, layer_schema(layer), lambda: Scan(spark.read.parquet(f"{versions.current(spark, path)}/table")))


def read_metadata(spark: SparkSession, path: str, document: bool = False) -> DataFrame:
    """Metadata of a layer's version in force as one text map; nested values stay JSON text.

    ``document`` reads the ``metadata`` member of a whole GeoJSON document instead of a written layer.
    """
    text_map = T.MapType(STRING, STRING)
    if document:
        return spark.read.schema(struct(metadata=text_map)).option("multiLine", True).json(path)
    lines = spark.read.text(f"{versions.current(spark, path)}/metadata")
    return lines.select(F.from_json("value", text_map).alias("metadata"))
