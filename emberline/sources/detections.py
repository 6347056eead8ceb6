"""Satellite detection files (CSV with a header)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline.functions import tables
from emberline.schemas import MODIS_COLUMNS, VIIRS_COLUMNS
from emberline.sources.scan import Scan, isolated

# What a column that the file lacks altogether stands for.
_ABSENT = {"latitude": "0", "longitude": "0", "frp": "0", "confidence": "n", "acq_date": "", "acq_time": "", "daynight": "D"}
RAW_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("source_name", *_ABSENT)])


def _first_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``_file``, its first line that is not blank, and whether that is a header. Files of blanks have no row."""
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_seq"),
        "value",
    )
    # a file's first line is in its first split, whose rows one task reads in their order
    first = lines.where((F.col("_block") == 0) & (F.trim("value") != "")).groupBy("_file").agg(F.min_by("value", "_seq").alias("_line"))
    return first.withColumn("_header", F.col("_line").contains("latitude"))


def _names(header: str) -> list[str]:
    return [name.strip().strip('"').lstrip("\ufeff") for name in header.split(",")]


def read_detections(spark: SparkSession, paths: str | list[str], source_name: str) -> Scan:
    """Detections of one feed, all values as text.

    Columns are found by the names in each file's own first line, so their order and extra columns do not matter.
    Blank files give no rows. Files that start with anything but a header, an error message say, give none either and
    are rejects: one each, its first line.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)

    def rows_under(header: str, files: DataFrame, only: bool) -> DataFrame:
        names = _names(header)
        schema = T.StructType([T.StructField(name, T.StringType()) for name in names])
        rows = spark.read.schema(schema).option("header", True).csv(paths)
        if not only:
            file = F.col("_metadata.file_path").alias("_file")
            rows = rows.select("*", file).join(files.where(F.col("_line") == header).select("_file"), "_file", "left_semi")
        # An empty field reads as null. Only the power keeps that: for it, empty means unknown.
        columns = [
            F.lit(default).alias(name)
            if name not in names
            else (F.col(name) if name in ("frp", "latitude", "longitude") else F.coalesce(name, F.lit("")).alias(name))
            for name, default in _ABSENT.items()
        ]
        return rows.select(F.lit(source_name).alias("source_name"), *columns)

    def read() -> Scan:
        files = _first_lines(spark, paths)
        # one job tells the different headers, and whether there are files without one
        told = files.agg(
            F.collect_set(F.when(F.col("_header"), F.col("_line"))).alias("headers"),
            F.count_if(~F.col("_header")).alias("others"),
            F.min(F.when(~F.col("_header"), F.col("_line"))).alias("message"),
        ).first()
        headers = sorted(told["headers"])
        if not headers:
            return Scan(spark.createDataFrame([], RAW_SCHEMA), f"{source_name}: {told['message'] or 'no data'}")
        parts = [rows_under(header, files, len(headers) == 1 and not told["others"]) for header in headers]
        messages = files.where(~F.col("_header")).select(F.col("_line").alias("_corrupt_record")) if told["others"] else None
        return Scan(reduce(DataFrame.unionByName, parts), rejects=messages)

    return isolated(spark, RAW_SCHEMA, read)


def read_feeds(spark: SparkSession, root: str) -> dict[str, Scan]:
    """A scan for each registered feed, from ``root/source=<name>``."""
    return {name: read_detections(spark, f"{root}/source={name}", name) for name, _, _ in tables.SENSORS}


def read_all(spark: SparkSession, root: str) -> tuple[DataFrame, dict[str, str]]:
    """All registered feeds in one, and the errors of those that gave nothing."""
    scans = read_feeds(spark, root)
    rows = reduce(DataFrame.unionByName, [scan.rows for scan in scans.values()])
    return rows, {name: scan.error for name, scan in scans.items() if scan.error}


def documented_columns(source_name: str) -> list[str]:
    """Columns the feed documents, in order."""
    return VIIRS_COLUMNS if "VIIRS" in source_name else MODIS_COLUMNS
