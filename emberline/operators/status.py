"""Layer status: last good snapshot, freshness, age text, errors."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline.functions import tables
from emberline.functions.semantics import equal_lookup, utc_literal

DAY, HOUR, MINUTE = 86400, 3600, 60


def parse_time(text: Column) -> Column:
    """ISO text with offset to an instant; null when it is empty or does not parse."""
    return F.try_to_timestamp(F.nullif(text, F.lit("")))


def age_seconds(generated: Column, as_of: Column) -> Column:
    """Whole seconds (rounded down) from ``generated`` to ``as_of``; both of one timestamp type."""
    return F.timestamp_diff("SECOND", generated, as_of)


def freshness(present: Column, age: Column) -> Column:
    """Traffic light of an age in seconds. Absent is ``unknown``; present but unparseable is ``red``."""
    return (
        F.when(~present, "unknown").when(age < HOUR, "green").when(age < 6 * HOUR, "amber").otherwise("red")
    )


def age_text(present: Column, age: Column) -> Column:
    """Age in words, rounded down to minutes, hours or days."""
    minutes = F.floor(age / MINUTE)
    hours, days = F.floor(age / HOUR), F.floor(age / DAY)
    in_days = F.concat(days.cast("string"), F.when(days > 1, " days ago").otherwise(" day ago"))
    return (
        F.when(~present, "Unknown")
        .when(age.isNull(), "NaN day ago")
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min ago")))
        .when(hours < 24, F.concat(hours.cast("string"), F.lit(" hr ago")))
        .otherwise(in_days)
    )


def with_freshness(status: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Append ``age_seconds``, ``freshness`` and ``age`` of ``generated_at`` (text or timestamp) at ``as_of`` (UTC).

    A layer whose newest attempt failed (``error``) is ``unknown`` but keeps the age of its last good data.
    """
    dtype = status.schema["generated_at"].dataType
    raw = F.col("generated_at")
    if isinstance(dtype, T.StringType):
        present, when = F.coalesce(raw != "", F.lit(False)), parse_time(raw)
    else:
        present, when = raw.isNotNull(), raw
    clock = utc_literal(as_of) if isinstance(dtype, T.TimestampNTZType) else F.lit(_utc(as_of))
    aged = status.withColumn("age_seconds", age_seconds(when, clock)).withColumn("_present", present)
    age, known = F.col("age_seconds"), F.col("_present")
    failed = F.col("error").isNotNull()
    return (
        aged.withColumn("freshness", F.when(failed, "unknown").otherwise(freshness(known, age)))
        .withColumn("age", age_text(known, age))
        .drop("_present")
    )


def _utc(as_of: dt.datetime) -> dt.datetime:
    return as_of if as_of.tzinfo else as_of.replace(tzinfo=dt.timezone.utc)


def last_good(attempts: DataFrame, as_of: dt.datetime | None = None) -> DataFrame:
    """One row per layer: the newest success, and the error of the newest attempt if that one failed.

    ``attempts`` has ``attempt_id``, ``attempted_at``, ``layer``, ``generated_at``, ``error`` (null for a
    success) and optionally ``data_path``. Both picks are one aggregation, reduced before the shuffle.
    """
    carried = [c for c in ("generated_at", "data_path") if c in attempts.columns]
    ordered = F.struct("attempted_at", "attempt_id")
    good = F.col("error").isNull()
    status = attempts.groupBy("layer").agg(
        F.max_by(F.struct(*carried), F.when(good, ordered)).alias("_good"),
        F.max_by(F.struct("error"), ordered).alias("_last"),
        F.max("attempted_at").alias("attempted_at"),
    )
    status = status.select("layer", *[F.col("_good")[c].alias(c) for c in carried], F.col("_last")["error"].alias("error"), "attempted_at")
    return status if as_of is None else with_freshness(status, as_of)


def layer_registry(spark: SparkSession) -> DataFrame:
    """The four monitored layers."""
    rows = [(*row, i) for i, row in enumerate(tables.LAYER_LABELS)]
    return spark.createDataFrame(rows, "layer string, label string, icon string, expected string, place int")


def freshness_panel(status: DataFrame) -> DataFrame:
    """Monitored layers with status, age and colours; a layer never attempted is ``unknown``."""
    joined = layer_registry(status.sparkSession).join(status.select("layer", "freshness", "age"), "layer", "left")
    shown = joined.select(
        "layer",
        "label",
        "icon",
        "expected",
        F.coalesce("freshness", F.lit("unknown")).alias("freshness"),
        F.coalesce("age", F.lit("Unknown")).alias("age"),
        "place",
    )
    colors = [
        equal_lookup(F.col("freshness"), {k: v[i] for k, v in tables.FRESHNESS_COLORS.items()}, None).alias(name)
        for i, name in enumerate(("background", "dot", "text_color"))
    ]
    title = F.concat("label", F.lit(": updated "), "age", F.lit(" (expected: "), "expected", F.lit(")"))
    return shown.select("*", *colors, title.alias("title"))


def layer_errors(status: DataFrame) -> DataFrame:
    """Layers whose newest attempt failed, as shown."""
    return status.where("error is not null").select("layer", F.concat("layer", F.lit(": "), "error").alias("message"))


def status_flags(status: DataFrame, expected_layers: int = 5) -> DataFrame:
    """Whether any layer is in error, and whether all are still loading (never attempted)."""
    return status.agg(
        F.coalesce(F.bool_or(F.col("error").isNotNull()), F.lit(False)).alias("any_error"),
        (F.count("*") == 0).alias("all_loading"),
        (F.lit(expected_layers) - F.count("*")).alias("layers_loading"),
    )
