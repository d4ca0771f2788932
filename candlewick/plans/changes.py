"""All stage outcomes of a bar history as one transition stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.operators import adaptive as A
from candlewick.operators import price as P
from candlewick.operators import transitions as T


def decision_events(bars: DataFrame) -> DataFrame:
    made = A.decisions(bars).drop("source_timestamp", "market_snapshot_id")
    joined = made.join(bars, ["symbol", "interval_start"])
    facts = F.create_map(
        *[x for n in ("path_direction", "strength", "c", "uncertainty") for x in (F.lit(n), F.col(n).cast("string"))]
    )
    return T.stage_events(
        joined, "P03_ADAPTIVE", F.col("symbol"), F.col("rn"), T.decision_state(),
        effective_time=F.col("interval_start"), market_snapshot_id=F.col("market_snapshot_id"),
        accepted_sequence=F.col("accepted_sequence"), source_event_id=F.col("event_id"), bar=T.bar_struct(),
        facts=F.when(F.col("side").isNotNull(), facts),
    )


def price_change_events(bars: DataFrame) -> DataFrame:
    priced = P.price_events(bars).withColumnRenamed("interval_start", "event_start")
    b = bars.select("symbol", F.col("interval_start").alias("trigger_interval_start"), T.bar_struct().alias("bar"))
    joined = priced.join(b, ["symbol", "trigger_interval_start"])
    return T.stage_events(
        joined, "P04_PRICE_ENGINE", F.col("symbol"), F.col("rn"), T.price_state(),
        effective_time=F.col("event_start"), market_snapshot_id=F.col("market_snapshot_id"),
        accepted_sequence=F.col("accepted_sequence"), source_event_id=F.col("event_id"), bar=F.col("bar"),
        facts=F.create_map(F.lit("emitted"), F.col("emitted").cast("string")),
    )


def feed_events(beats: DataFrame) -> DataFrame:
    """Beats: (beat, feed_state)."""
    return T.stage_events(
        beats, "P01_MARKET_FEED", F.lit(T.GLOBAL), F.unix_seconds("beat"), T.feed_state_row(F.col("feed_state")),
        effective_time=F.col("beat"),
    )


def ingest_events(beats: DataFrame) -> DataFrame:
    """Beats: (beat, capability)."""
    return T.stage_events(
        beats, "P02_INGESTION", F.lit(T.GLOBAL), F.unix_seconds("beat"), T.ingest_state(F.col("capability")),
        effective_time=F.col("beat"),
    )


def all_events(bars: DataFrame, beats: DataFrame) -> DataFrame:
    return (
        decision_events(bars)
        .unionByName(price_change_events(bars))
        .unionByName(feed_events(beats))
        .unionByName(ingest_events(beats))
    )
