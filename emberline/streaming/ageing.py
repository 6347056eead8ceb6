"""Layer status that ages by itself: a layer turns amber and red when its time comes, attempt or none.

One row of state per layer holds its newest success and newest attempt. Each status sets a timer for the moment at
which the age of the data crosses the next limit; the timer tells the new status and sets the next one. A later attempt
replaces the timer. The stream thus carries a row only where a status changes or an attempt comes in.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from emberline.operators.status import HOUR

STATUS = "layer string, at timestamp, freshness string, error string, generated_at timestamp"
KNOWN = "generated_us bigint, good_us bigint, good_id bigint, last_us bigint, last_id bigint, error string"
LIMITS = (HOUR, 6 * HOUR)  # seconds at which data turn amber and red


class Ageing(StatefulProcessor):
    """Status rows of one layer from its attempts and from its timers."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", KNOWN)

    def close(self) -> None:
        pass

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        generated, good_us, good_id, last_us, last_id, error = self.known.get() if self.known.exists() else (None,) * 6
        for row in rows:
            place = (row["attempted_us"], row["attempt_id"])
            if last_us is None or place > (last_us, last_id):
                (last_us, last_id), error = place, row["error"]
            if row["error"] is None and (good_us is None or place > (good_us, good_id)):
                (good_us, good_id), generated = place, row["generated_us"]
        self.known.update((generated, good_us, good_id, last_us, last_id, error))
        return self._told(key, timerValues)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        return self._told(key, timerValues)

    def _told(self, key: tuple, timerValues) -> Iterator[Row]:
        """The status now, and a timer for when it changes."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        now_ms = timerValues.getCurrentProcessingTimeInMs()
        generated, _, _, _, _, error = self.known.get()
        level = "unknown"
        if generated is not None and error is None:
            age = (now_ms * 1000 - generated) // 1_000_000
            level = ("green", "amber", "red")[sum(age >= limit for limit in LIMITS)]
            ahead = [limit for limit in LIMITS if age < limit]
            if ahead:
                self.handle.registerTimer(-(-(generated + ahead[0] * 1_000_000) // 1000))
        instant = lambda us: None if us is None else dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(microseconds=us)
        yield Row(layer=key[0], at=instant(now_ms * 1000), freshness=level, error=error, generated_at=instant(generated))


def ageing_status(attempts: DataFrame) -> DataFrame:
    """Status rows from a stream of attempts (``attempt_id``, ``attempted_at``, ``layer``, ``generated_at`` as timestamp,
    ``error``), whenever a layer is attempted or its age crosses a limit. Needs the RocksDB state store.
    """
    rows = attempts.select(
        "layer", "attempt_id", "error", F.unix_micros("attempted_at").alias("attempted_us"), F.unix_micros("generated_at").alias("generated_us")
    )
    return rows.groupBy("layer").transformWithState(Ageing(), STATUS, "Update", "ProcessingTime")
