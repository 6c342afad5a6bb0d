"""Streaming rollups of the run log, held against the same SQL over the whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..sources.writers import scratch
from ..streaming import attempts
from ..tables import load
from .aggregates import rounded


def _log(spark, sf_dir, twice: bool):
    """The events as a folder of files in order of time, each row twice if asked."""
    path = scratch(spark, "log")
    e = load(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    if twice:
        e = e.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("copy")
    e.repartitionByRange(8, "ts").sortWithinPartitions("ts").write.parquet(path)
    return attempts.read(spark, path, e.schema)


@query("stream_deduplicated", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def _(spark, sf_dir):
    out = attempts.drained(attempts.deduplicated(_log(spark, sf_dir, True), "ts", "10 days", "event_id"), "unique")
    return out.groupBy("event_type").agg(F.count("*").alias("n"))


@query("stream_latest", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def _(spark, sf_dir):
    return attempts.latest(_log(spark, sf_dir, False), scratch(spark, "latest"), scratch(spark, "latest-progress"), ["user_id"], "event_id", 3).select("user_id", "event_id", "event_type")


@query("stream_windowed", """WITH w AS (SELECT time_bucket(INTERVAL '6 hours', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2)
SELECT start, event_type, n, total FROM w WHERE start + INTERVAL '6 hours' <= (SELECT max(ts) FROM events) - INTERVAL '1 day'""")
def _(spark, sf_dir):
    """Closed windows only: those that end at the watermark, a day before the last row, or earlier; files come in order of time, so no row is late."""
    return rounded(attempts.drained(attempts.windowed(_log(spark, sf_dir, False), "ts", "6 hours", "1 day", "value", "event_type"), "windows"), 4)
