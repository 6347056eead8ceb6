"""Versions of a written layer: folders of their own, and a manifest that says which one counts.

A version is written into ``<layer>/versions/<number>-<mark>`` and counts once ``<layer>/manifest/version=<number>``
names it. The manifest row is the last thing written and appears as one file at the end of its job, so readers see the
version before or the new one, whole; whatever fails in between leaves the version before in force. Old versions, and
what failed attempts have left below them, expire by count after the new manifest stands.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from emberline.schemas import BIGINT, STRING, struct

MANIFEST = struct(folder=STRING, rows=BIGINT, rejected=BIGINT, version=BIGINT)
KEEP = 3


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """Versions of the layer at ``path`` that count or did, oldest first; fails where there is no manifest."""
    return spark.read.schema(MANIFEST).option("basePath", f"{path}/manifest").json(f"{path}/manifest").orderBy("version", "folder")


def _known(spark: SparkSession, path: str) -> list[Row]:
    try:
        return manifests(spark, path).collect()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return []
        raise


def current(spark: SparkSession, path: str) -> str:
    """Folder of the version in force."""
    newest = manifests(spark, path).orderBy(F.desc("version"), F.desc("folder")).select("folder").first()
    if newest is None:
        raise FileNotFoundError(f"{path} has no complete version")
    return f"{path}/versions/{newest['folder']}"


def begin(spark: SparkSession, path: str) -> tuple[int, str]:
    """Number, above all that were begun, and name of a version to write; the name is never used twice."""
    started = [int(name.partition("-")[0]) for name in _names(spark, f"{path}/versions")]
    number = max([0, *started, *(row["version"] for row in _known(spark, path))]) + 1
    return number, f"{number:010d}-{uuid.uuid4().hex[:8]}"


def commit(spark: SparkSession, path: str, number: int, folder: str, rows: int | None = None, rejected: int | None = None) -> None:
    """Put the version in ``folder`` in force."""
    row = spark.createDataFrame([(folder, rows, rejected)], "folder string, rows bigint, rejected bigint")
    row.coalesce(1).write.mode("append").json(f"{path}/manifest/version={number}")


def expire(spark: SparkSession, path: str, keep: int = KEEP) -> list[str]:
    """Delete all but the newest ``keep`` versions, and folders below the newest that no manifest names; their names.

    The manifest row of an old version goes before its folder.
    """
    known = sorted(_known(spark, path), key=lambda row: (row["version"], row["folder"]))
    if not known:
        return []
    kept = {row["folder"] for row in known[-keep:]}
    numbers = {row["version"] for row in known[-keep:]}
    for number in sorted({row["version"] for row in known} - numbers):
        _delete(spark, f"{path}/manifest/version={number}")
    gone = [name for name in _names(spark, f"{path}/versions") if name not in kept and name < known[-1]["folder"]]
    for name in gone:
        _delete(spark, f"{path}/versions/{name}")
    return gone


def _at(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    place, files = _at(spark, path)
    return sorted(found.getPath().getName() for found in files.listStatus(place)) if files.exists(place) else []


def _delete(spark: SparkSession, path: str) -> None:
    place, files = _at(spark, path)
    files.delete(place, True)
