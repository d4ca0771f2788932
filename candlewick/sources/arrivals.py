"""A feed with revisions, derived from the ``events`` table.

Per hourly bucket: a PARTIAL bar from its first half, a live COMPLETE bar when at
least two ticks were seen, and a RECONSTRUCTED bar from history whose prices are
whole numbers.  The arrival number orders them; history overtakes live bars in
thin buckets and trails them in busy ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.schema import BAR_COLUMNS
from candlewick.sources.ticks import bars_from_ticks, read_table


def _bars(events: DataFrame, price, kind: int) -> DataFrame:
    return bars_from_ticks(
        events,
        symbol=F.col("event_type"),
        ts=F.col("ts"),
        price=price,
        qty=F.get_json_object("props", "$.k"),
        order=[F.col("ts"), F.col("event_id")],
        interval="1 hour",
    ).withColumn("_kind", F.lit(kind))


def feed_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events")
    half = F.col("ts") < F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz") + F.expr("INTERVAL 30 MINUTES")
    partial = _bars(events.filter(half), F.col("value"), 1)
    complete = _bars(events, F.col("value"), 2).filter(F.col("event_count") >= 2)
    rebuilt = _bars(events, F.ceil(F.col("value") + 1), 3)
    both = partial.unionByName(complete).unionByName(rebuilt)
    kind = F.col("_kind")
    start = F.unix_seconds("interval_start")
    delay = F.when(kind == 1, 1800).when(kind == 2, 3600).otherwise(1800 * F.col("event_count") + 900)
    both = both.withColumns(
        {
            "arrival": ((start + delay) * 10 + kind).cast("long"),
            "quality_status": F.when(kind == 1, "PARTIAL").when(kind == 2, "COMPLETE").otherwise("RECONSTRUCTED"),
            "is_final": kind != 1,
            "is_backfilled": kind == 3,
        }
    )
    return both.select(*BAR_COLUMNS, "arrival")


def heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly feed telemetry: slowest reply and missed beats among the events."""
    events = read_table(spark, sf_dir, "events")
    return (
        events.groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("beat"))
        .agg(
            (F.max("value") * 10).alias("rtt_ms"),
            F.count_if(F.col("event_type") == "error").alias("misses"),
            F.count_if(F.col("event_type") == "signup").alias("signups"),
            F.count("*").alias("n"),
        )
        .withColumn(
            "reported",
            F.when(F.col("signups") == 0, "RECOVERING").when(F.col("misses") == 2, "FAILED").otherwise("HEALTHY"),
        )
        .select("beat", "rtt_ms", "misses", "reported", "n")
    )
