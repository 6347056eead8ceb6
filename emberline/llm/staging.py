"""Where intermediate results go, so that a lost executor costs a re-read and not a re-computation."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark's own setting: shuffle files of a query go when the query has ended, not when the driver forgets the query.
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one only where that is unset (local tests)."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="emberline-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


@contextmanager
def freeing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries made inside leave no shuffle files once they have ended; while they run, all of them stand."""
    before = spark.conf.get(_FREE, None)
    spark.conf.set(_FREE, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_FREE)
        else:
            spark.conf.set(_FREE, before)


def settle(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared folder, its lineage cut."""
    shared_folder(df.sparkSession)
    with freeing_shuffles(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder, not created yet."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as compressed Parquet into the shared folder and read back, only the columns asked for.

    What is read back has no partitioning that Spark knows of, so a join with it can be split where a key is hot.
    """
    path = new_folder(df.sparkSession, name)
    with freeing_shuffles(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def few_files(df: DataFrame, rows: int, per_file: int = 20_000) -> DataFrame:
    """``df`` of at most ``rows`` rows in as few partitions as these need, two per core at least, before it is written.

    A file costs a task, and on a local file system a process forked from the executor, however few rows it has.
    """
    session = df.sparkSession
    parts = max(2 * session.sparkContext.defaultParallelism, -(-rows // per_file))
    return df.coalesce(parts) if parts < int(session.conf.get("spark.sql.shuffle.partitions")) else df


def unused(df: DataFrame, name: str) -> str:
    """``name``, or a longer one if ``df`` has a column of that name (in any case)."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def set_aside(df: DataFrame, names: list[str] | tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns named like one of ``names`` (in any case) under unused names, and the way back (new: old)."""
    clashing = {name.lower() for name in names}
    back: dict[str, str] = {}
    for column in df.columns:
        if column.lower() in clashing:
            new = unused(df, f"{column}_own")
            df = df.withColumnRenamed(column, new)
            back[new] = column
    return df, back
