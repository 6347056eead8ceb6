"""JSON feeds: weather responses, perimeter collections, map elements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline.schemas import MEXICO_JSON_FEATURE, OSM_ELEMENT, USA_FEATURE, WEATHER_ITEM, WEATHER_RESPONSE, collection_schema
from emberline.sources.scan import Scan, isolated, nothing_parsed
from emberline.sources.split_json import read_members

Paths = str | list[str]


def read_weather(spark: SparkSession, paths: Paths, keep_text: bool = False) -> Scan:
    """Weather responses, one JSON document per line with ``lat``, ``lon`` and ``fetched_at`` attached.

    A line that does not parse has no ``current`` and counts as an error further on. ``keep_text`` leaves its text in
    ``_corrupt_record``, for jobs that count rejects in the pass that writes the rows.
    """

    def read() -> Scan:
        rows = spark.read.schema(WEATHER_RESPONSE).json(paths)
        broken = rows.where("_corrupt_record is not null and current is null").select("_corrupt_record")
        return Scan(rows if keep_text else rows.drop("_corrupt_record"), rejects=broken)

    return isolated(spark, WEATHER_ITEM, read)


def _exploded(spark: SparkSession, paths: Paths, item: T.StructType, items: str) -> Scan:
    """Array members of whole JSON documents as rows. A document is read by one task, its rows by all."""

    def read() -> Scan:
        documents = spark.read.schema(collection_schema(item, items)).option("multiLine", True).json(paths)
        broken = documents.where(F.col("_corrupt_record").isNotNull() & F.col(items).isNull()).select("_corrupt_record")
        rows = documents.select(F.explode_outer(items).alias("_item")).where("_item is not null").select("_item.*")
        return Scan(rows, rejects=broken)

    return isolated(spark, item, read)


def parsed(lines: DataFrame, item: T.StructType, column: str = "value") -> Scan:
    """JSON texts in ``column``, one member each, as rows beside the other columns; those that do not parse are rejects."""
    schema = T.StructType([*item.fields, T.StructField("_corrupt_record", T.StringType())])
    others = [F.col(f"`{name}`") for name in lines.columns if name != column]
    read = lines.select(*others, F.from_json(column, schema, {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("_item"))
    rows = read.select(*others, "_item.*")
    lost = nothing_parsed(item)
    return Scan(rows.where(~lost).drop("_corrupt_record"), rejects=rows.where(lost).select("_corrupt_record"))


def _lines(spark: SparkSession, paths: Paths, item: T.StructType) -> Scan:
    """The same members landed one per line: splittable, for volume. Lines that do not parse are rejects."""

    def read() -> Scan:
        rows = spark.read.schema(T.StructType([*item.fields, T.StructField("_corrupt_record", T.StringType())])).json(paths)
        lost = nothing_parsed(item)
        broken = rows.where(lost).select("_corrupt_record")
        return Scan(rows.where(~lost).drop("_corrupt_record"), rejects=broken)

    return isolated(spark, item, read)


def _split(spark: SparkSession, paths: Paths, item: T.StructType, items: str) -> Scan:
    """Array members of JSON documents of any size, each document read by many tasks."""

    def read() -> Scan:
        members, broken = read_members(spark, paths, items)
        scan = parsed(members, item)
        return Scan(scan.rows, rejects=scan.rejects.unionAll(broken))

    return isolated(spark, item, read)


def _read(spark: SparkSession, paths: Paths, item: T.StructType, items: str, lines: bool, split: bool) -> Scan:
    if lines:
        return _lines(spark, paths, item)
    return (_split if split else _exploded)(spark, paths, item, items)


# ``lines``: members landed one per line. ``split``: whole documents too large for one task.


def read_usa_perimeters(spark: SparkSession, paths: Paths, lines: bool = False, split: bool = False) -> Scan:
    return _read(spark, paths, USA_FEATURE, "features", lines, split)


def read_mexico_perimeters(spark: SparkSession, paths: Paths, lines: bool = False, split: bool = False) -> Scan:
    return _read(spark, paths, MEXICO_JSON_FEATURE, "features", lines, split)


def read_elements(spark: SparkSession, paths: Paths, lines: bool = False, split: bool = False) -> Scan:
    return _read(spark, paths, OSM_ELEMENT, "elements", lines, split)


__all__ = ["parsed", "read_elements", "read_mexico_perimeters", "read_usa_perimeters", "read_weather"]
