"""Layers turn amber and red with no new attempt, as the batch query says at each time."""

import datetime as dt
import time

from emberline.operators import status
from emberline.streaming.ageing import ageing_status

ATTEMPTS = "attempt_id bigint, attempted_at timestamp, layer string, generated_at timestamp, error string"


def test_status_ages_without_attempts(spark, tmp_path):
    names = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.shuffle.partitions": "2",
    }
    before = {name: spark.conf.get(name, None) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    start = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    ago = lambda seconds: start - dt.timedelta(seconds=seconds)
    later = 25
    rows = [
        (1, ago(60), "hotspots", ago(3600 - later), None),  # amber soon
        (2, ago(60), "weather", ago(6 * 3600 - later), None),  # red soon
        (3, ago(60), "fwi", ago(3600 - later), None),
        (4, ago(50), "fwi", None, "HTTP 503"),  # unknown, and stays so
        (5, ago(40), "perimeters", ago(9 * 3600), None),  # red for good
        (0, ago(70), "perimeters", ago(5), None),  # an older attempt
    ]
    spark.createDataFrame(rows, ATTEMPTS).write.parquet(f"{tmp_path}/attempts")
    stream = spark.readStream.schema(ATTEMPTS).parquet(f"{tmp_path}/attempts")
    query = ageing_status(stream).writeStream.outputMode("update").format("memory").queryName("ages").option("checkpointLocation", f"{tmp_path}/c").start()
    try:
        got, until = [], time.time() + 150
        while time.time() < until and len(got) < 6:
            time.sleep(1)
            if query.exception():
                raise query.exception()
            got = spark.table("ages").orderBy("at").collect()
    finally:
        query.stop()
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    assert len(got) == 6
    attempts = spark.createDataFrame(rows, ATTEMPTS)
    for row in got:
        batch = status.last_good(attempts, row["at"].replace(tzinfo=dt.timezone.utc)).where(f"layer = '{row['layer']}'").first()
        assert (row["freshness"], row["error"], row["generated_at"]) == (batch["freshness"], batch["error"], batch["generated_at"])
    seen = {}
    for row in got:
        seen.setdefault(row["layer"], []).append(row["freshness"])
    assert seen == {"hotspots": ["green", "amber"], "weather": ["amber", "red"], "fwi": ["unknown"], "perimeters": ["red"]}
