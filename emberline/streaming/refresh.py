"""Periodic refresh of the layers from landing folders, keeping the last good snapshot of each.

Files land under ``<landing>/<layer>/pull=<id>/``; a pull is one complete fetch of a layer. Ids sort by time.
When all its files are there, a file ``<landing>/<layer>/complete/<id>`` (of any content but none) says so. Feeds of
several sources have a folder each inside the pull (``source=<feed>`` for detections, ``country=<USA|Mexico>`` for
perimeters). The stream carries these marks only: each trigger builds the layer from the whole folder of the newest
marked pull that works, stores it as a new snapshot and logs the attempt. A source that fails is logged as a problem
and leaves the others standing; a pull without a usable record fails and leaves the snapshot before it in force.

Every step is keyed by the batch number and overwrites its own folder, so a batch that is run again
after a failure gives the same state.
"""

from __future__ import annotations

import datetime as dt
import hashlib
from collections.abc import Callable, Iterable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import BinaryType

from emberline.functions import tables
from emberline.operators import detections as det
from emberline.operators import infrastructure as infra
from emberline.operators import perimeters as per
from emberline.operators import status
from emberline.operators import weather as wx
from emberline.operators.space import within_bbox
from emberline.schemas import ATTEMPTS, BIGINT, LAYER_NAMES, STRING, TIMESTAMP, struct
from emberline.sources import detections as detection_files
from emberline.sources import documents
from emberline.sources.scan import Scan, first_line, problem

REFRESH = "5 minutes"

PROBLEMS = struct(attempted_at=TIMESTAMP, problem=STRING)
_LISTING = struct(path=STRING, modificationTime=TIMESTAMP, length=BIGINT, content=BinaryType())

Build = Callable[[SparkSession, str, list[str]], DataFrame]
Clock = Callable[[], dt.datetime]


class FeedError(Exception):
    """A pull that holds no usable data."""


def _usable(scan: Scan, source: str, notes: list[str]) -> DataFrame | None:
    """Rows of a feed; its problem goes to ``notes``. None for a feed that is not in the pull or gave nothing but problems."""
    if scan.error and scan.error.startswith("[PATH_NOT_FOUND]"):
        return None
    found = problem(scan)
    if found:
        notes.append(found if found.startswith(source) else f"{source}: {found}")
    return None if scan.error or (found and scan.rows.isEmpty()) else scan.rows


def _some(parts: list[DataFrame | None], notes: list[str]) -> list[DataFrame]:
    found = [part for part in parts if part is not None]
    if not found:
        raise FeedError("; ".join(notes) or "no registered feed in this pull")
    return found


def _hotspots(spark: SparkSession, pull: str, notes: list[str]) -> DataFrame:
    parts = [_usable(detection_files.read_detections(spark, f"{pull}/source={name}", name), name, notes) for name, _, _ in tables.SENSORS]
    return det.dedup_cross_sensor(det.union_sensors(*[det.normalize(rows) for rows in _some(parts, notes)]))


def _readings(spark: SparkSession, pull: str, notes: list[str]) -> DataFrame:
    rows = _some([_usable(documents.read_weather(spark, pull), "weather", notes)], notes)[0]
    good, _ = wx.split_missing(rows)
    if good.isEmpty():
        raise FeedError("; ".join(notes) or "weather: no current readings")
    return wx.flatten_responses(good)


def _perimeters(spark: SparkSession, pull: str, notes: list[str]) -> DataFrame:
    usa = _usable(documents.read_usa_perimeters(spark, f"{pull}/country=USA", split=True), "USA", notes)
    mexico = _usable(documents.read_mexico_perimeters(spark, f"{pull}/country=Mexico", split=True), "Mexico", notes)
    parts = _some([None if usa is None else per.normalize_usa(usa), None if mexico is None else per.normalize_mexico(mexico)], notes)
    return parts[0] if len(parts) == 1 else per.unify(*parts)


def _infrastructure(spark: SparkSession, pull: str, notes: list[str]) -> DataFrame:
    rows = _some([_usable(documents.read_elements(spark, pull, split=True), "infrastructure", notes)], notes)[0]
    return within_bbox(infra.normalize(infra.has_any_tag(rows)), **infra.parse_bbox(tables.INFRA_BBOX))


BUILDERS: dict[str, Build] = {
    "hotspots": _hotspots,
    "weather": lambda spark, pull, notes: wx.weather_layer(_readings(spark, pull, notes)),
    "fwi": lambda spark, pull, notes: wx.fwi_layer(_readings(spark, pull, notes)),
    "perimeters": _perimeters,
    "infrastructure": _infrastructure,
}


def _utc_now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc)


def log_attempt(
    spark: SparkSession, out: str, layer: str, number: int, at: dt.datetime, error: str | None, data_path: str | None
) -> None:
    """Record one attempt in its own folder."""
    generated = None if error else at.isoformat()
    row = spark.createDataFrame([(number, at, layer, generated, error, data_path)], ATTEMPTS)
    row.drop("layer").coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(
        f"{out}/attempts/layer={layer}/batch={number}"
    )


def log_problems(spark: SparkSession, out: str, layer: str, number: int, at: dt.datetime, notes: list[str]) -> None:
    """Record the problems of single sources of a pull in a folder of their own, which a repeated batch replaces."""
    rows = spark.createDataFrame([(at, note) for note in notes], PROBLEMS)
    rows.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{out}/problems/layer={layer}/batch={number}")


def refresh_batch(
    spark: SparkSession, layer: str, out: str, batch_id: int, pulls: Iterable[str], clock: Clock = _utc_now
) -> str | None:
    """Build ``layer`` from the newest working of the folders ``pulls``; returns the error of the newest one, if any."""
    path = f"{out}/snapshots/{layer}/batch={batch_id}"
    newest_error, stored, problems = None, False, []
    for place, pull in enumerate(sorted(pulls, reverse=True)):
        notes: list[str] = []
        try:
            BUILDERS[layer](spark, pull, notes).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)
            stored = True
        except (PySparkException, FeedError) as error:
            if place == 0:
                newest_error = first_line(error)
        problems += notes
        if stored:
            break
    now = clock()
    log_problems(spark, out, layer, batch_id, now, problems)
    if stored:
        log_attempt(spark, out, layer, 2 * batch_id, now, None, path)
    if newest_error is not None:
        log_attempt(spark, out, layer, 2 * batch_id + 1, now, newest_error, None)
    return newest_error


def checkpoint_root(spark: SparkSession, out: str) -> str:
    """Folder for query checkpoints: in the shared one the cluster names, else beside the output.

    In the shared folder each output has its own part, so that jobs do not read each other's progress.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        return f"{out}/checkpoints"
    return f"{shared}/refresh/{hashlib.sha256(out.encode()).hexdigest()[:16]}"


def start_refresh(
    spark: SparkSession,
    layer: str,
    landing: str,
    out: str,
    interval: str = REFRESH,
    available_now: bool = False,
    clock: Clock = _utc_now,
) -> StreamingQuery:
    """Start the refresh of one layer. ``available_now`` works off what has landed and stops.

    The stream only lists the marks of complete pulls, one small file each; building reads the pulls themselves as
    a batch, spread over the cluster.
    """
    if layer not in BUILDERS:
        raise ValueError(f"unknown layer {layer!r}")
    landed = (
        spark.readStream.format("binaryFile")
        .schema(_LISTING)
        .load(f"{landing}/{layer}/complete")
        .select(F.element_at(F.split("path", "/"), -1).alias("pull"))
    )

    def handle(batch: DataFrame, batch_id: int) -> None:
        pulls = [f"{landing}/{layer}/pull={row['pull']}" for row in batch.collect()]
        if pulls:
            refresh_batch(batch.sparkSession, layer, out, batch_id, pulls, clock)

    writer = landed.writeStream.foreachBatch(handle).option(
        "checkpointLocation", f"{checkpoint_root(spark, out)}/{layer}"
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start()


def start_all(
    spark: SparkSession, landing: str, out: str, layers: Iterable[str] = LAYER_NAMES, **options
) -> dict[str, StreamingQuery]:
    """One independent query per layer: each has its own checkpoint and fails alone."""
    return {layer: start_refresh(spark, layer, landing, out, **options) for layer in layers}


def run_available_now(spark: SparkSession, landing: str, out: str, layers: Iterable[str] = LAYER_NAMES, **options) -> dict[str, str]:
    """Work off everything that has landed, then stop; returns the errors of queries that died."""
    queries = start_all(spark, landing, out, layers, available_now=True, **options)
    failed = {}
    for layer, query in queries.items():
        try:
            query.awaitTermination()
        except PySparkException as error:
            failed[layer] = first_line(error)
    return failed


def read_attempts(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(ATTEMPTS).option("basePath", f"{out}/attempts").parquet(f"{out}/attempts")


def read_problems(spark: SparkSession, out: str) -> DataFrame:
    """Problems of single sources, by layer and batch."""
    return spark.read.schema(struct(attempted_at=TIMESTAMP, problem=STRING, layer=STRING, batch=BIGINT)).option("basePath", f"{out}/problems").parquet(f"{out}/problems")


def read_status(spark: SparkSession, out: str, as_of: dt.datetime | None = None) -> DataFrame:
    """Status of every layer from the attempts log, with the path of its last good snapshot."""
    return status.last_good(read_attempts(spark, out), as_of)


def read_snapshot(spark: SparkSession, out: str, layer: str) -> DataFrame:
    """The last good snapshot of ``layer``."""
    row = status.last_good(read_attempts(spark, out).where(F.col("layer") == layer)).first()
    if row is None or row["data_path"] is None:
        raise FeedError(f"{layer} has no good snapshot yet")
    return spark.read.parquet(row["data_path"])


def status_stream(attempts: DataFrame) -> DataFrame:
    """The same status from a stream of attempts, for output mode ``complete``: one row of state per layer."""
    return status.last_good(attempts)
