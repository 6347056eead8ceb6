"""What every reader returns, and the isolation of a failing feed."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Scan(NamedTuple):
    """Rows of a feed; ``error`` tells why there are none, ``rejects`` holds documents that did not parse."""

    rows: DataFrame
    error: str | None = None
    rejects: DataFrame | None = None


def first_line(error: BaseException) -> str:
    return (str(error).strip() or type(error).__name__).splitlines()[0]


def isolated(spark: SparkSession, schema: T.StructType, read: Callable[[], Scan]) -> Scan:
    """``read()``, or an empty scan of ``schema`` when the feed cannot be opened."""
    try:
        return read()
    except (PySparkException, OSError) as error:
        return Scan(spark.createDataFrame([], schema), first_line(error))


def nothing_parsed(item: T.StructType) -> Column:
    """Lines of which not one field of ``item`` could be read."""
    lost = F.col("_corrupt_record").isNotNull()
    for name in item.fieldNames():
        if name != "_corrupt_record":
            lost = lost & F.col(name).isNull()
    return lost


def problem(scan: Scan) -> str | None:
    """What is wrong with a feed: why it has no rows, or how many of its records were rejected."""
    if scan.error or scan.rejects is None:
        return scan.error
    rejected = scan.rejects.count()
    return f"{rejected} records do not parse" if rejected else None
