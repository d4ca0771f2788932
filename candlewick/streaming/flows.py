"""Structured Streaming flows over the same operators as the batch side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.functions import scalars as S
from candlewick.operators import adaptive as A
from candlewick.operators import gate as H
from candlewick.operators import health as U
from candlewick.operators import ingest as I
from candlewick.operators import price as P
from candlewick.operators.ingest import _GENERATION, WINDOW_LIMIT, revision_rank
from candlewick.operators.transitions import COMPARED
from candlewick.operators.volume import volume_observations
from candlewick.streaming import engines as E

#: A final bar counts as fresh this long after its interval ended.
LATENESS = f"{S.FRESHNESS_SECONDS} seconds"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def configure(spark: SparkSession) -> SparkSession:
    """Keyed state lives in RocksDB, outside the Java heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return spark


def read_bar_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def stream_bars(ticks: DataFrame, symbol: str, price: str, qty, order: list[str], interval: str = "1 minute", lateness: str = LATENESS) -> DataFrame:
    """Interval bars, each emitted once its interval can no longer change."""
    rows = ticks.select(
        F.col(symbol).cast("string").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col(price).alias("price"),
        qty.cast("long").alias("qty"), F.struct(*order).alias("ord"),
    )
    return (
        rows.withWatermark("ts", lateness)
        .groupBy("symbol", F.window("ts", interval).alias("w"))
        .agg(
            F.min_by("price", "ord").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
            F.max_by("price", "ord").alias("close"), F.sum("qty").alias("volume"), F.count("*").alias("event_count"),
        )
        .select("symbol", F.col("w.start").alias("interval_start"), F.col("w.end").alias("interval_end"), "open", "high", "low", "close", "volume", "event_count")
    )


def _bounded(df: DataFrame, lateness: str | None) -> DataFrame:
    return df.withWatermark("interval_start", lateness) if lateness else df


def stream_revisions(arrivals: DataFrame, lateness: str | None = None) -> DataFrame:
    """Best revision per bar, updated as better ones arrive (update mode).

    The state is keyed by (symbol, interval_start), so a busy symbol is spread over
    all tasks.  Every bar stays open to revision; with ``lateness`` a watermark forgets bars that
    old, and drops what lands later.
    """
    rest = [c for c in arrivals.columns if c not in ("symbol", "interval_start")]
    best = F.max_by(F.struct(*rest), F.struct(revision_rank(), F.col("arrival")))
    return (
        _bounded(arrivals, lateness)
        .groupBy("symbol", "interval_start")
        .agg(best.alias("b"))
        .select("symbol", "interval_start", "b.*")
    )


def stream_first_arrivals(arrivals: DataFrame, lateness: str | None = None) -> DataFrame:
    """Drop repeats of a bar where no revision rules are wanted; ``lateness`` bounds what is remembered."""
    if lateness:
        return _bounded(arrivals, lateness).dropDuplicatesWithinWatermark(["symbol", "interval_start"])
    return arrivals.dropDuplicates(["symbol", "interval_start"])


def stream_window(arrivals: DataFrame, limit: int = WINDOW_LIMIT) -> DataFrame:
    """The bounded window of each symbol as arrivals change it: one row per arrival, with what it evicted.

    The state of a symbol is ``limit`` bars at most, however long the stream runs.  A NULL time is never accepted.
    """
    facts = F.to_json(F.struct(*_GENERATION))
    slim = arrivals.select(
        "symbol", "interval_start", "arrival", "market_snapshot_id", F.coalesce("is_final", F.lit(False)).alias("is_final"),
        F.coalesce("is_backfilled", F.lit(False)).alias("is_backfilled"), S.model_eligible().alias("live"), facts.alias("facts"),
    )
    return _fold(slim, ["symbol"], E.BarWindow(limit))


def _fold(df: DataFrame, keys: list[str], engine: E.KeyedFold | E.BarWindow) -> DataFrame:
    return df.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=engine, outputStructType=engine.schema, outputMode="Append", timeMode="None"
    )


def stream_volume(bars: DataFrame) -> DataFrame:
    return _fold(volume_observations(bars).select("symbol", "interval_start", "v_raw"), ["symbol"], E.VolumeActivity())


def stream_decisions(bars: DataFrame) -> DataFrame:
    """Model state, stateless return shape and score in SQL, then context and decision; one row per bar, skips included."""
    refused = F.when(~A.takeable(), "INVALID_INPUT")
    obs = A.adaptive_observations(bars).select("symbol", "interval_start", "event_time", "price", "v_raw", "source_quality", refused.alias("skip_reason"))
    stepped = _fold(obs, ["symbol"], E.AdaptiveState())
    scored = A.with_capturability(A.with_return_shape(stepped))
    cols = ["symbol", "interval_start", "rn", "c", "h", "path_direction", "perturbation_magnitude", "half_gain", "half_lo", "half_hi",
            "rate_shift", "rate_lo", "rate_hi", "rate_min", "rate_max", "clipped", "data_gap", "block_start", "skip_reason"]
    return _fold(scored.select(*cols), ["symbol"], E.Decide())


def stream_gate(arrivals: DataFrame, resets: DataFrame) -> DataFrame:
    """``gate``, ``gate_detail``, ``committed`` and ``epoch`` of every arrival, as the batch gate gives them.

    Both streams have ``symbol`` and ``arrival``, the order in which they happened; a reset starts the symbol afresh.  Rows of
    a micro-batch are put in that order, so a reset must not land in a later one than the arrivals behind it.
    """
    flag = lambda name, other: F.coalesce(name, F.lit(other)) if name in arrivals.columns else F.lit(other)
    rows = arrivals.withColumns({"infer": flag("infer", True), "proven_missing": flag("proven_missing", False)})
    rows = rows.select(
        "symbol", "interval_start", "arrival", F.lit(1).alias("kind"), "market_snapshot_id", F.col("close").alias("price"), F.col("volume").cast("double").alias("v_raw"),
        F.coalesce(S.model_eligible(), F.lit(False)).alias("eligible"), "infer", "proven_missing", H.may_commit().alias("may_commit"),
    )
    both = rows.unionByName(resets.select("symbol", "arrival", F.lit(0).alias("kind")), allowMissingColumns=True)
    judged = _fold(both, ["symbol"], E.Gate())
    judged = judged.withColumnsRenamed({"last_start": "_last", "step": "_class", "gap": "_gap", "latched": "_latched"})
    return H.labelled(judged, F.col("may_commit")).drop("_last", "_class", "_gap", "_latched")


def stream_outcomes(gated: DataFrame) -> DataFrame:
    """One terminal outcome per arrival of ``stream_gate``: a decision or a typed skip, in the columns of the batch."""
    refused = F.when(~F.col("committed"), F.when(F.col("gate") == "PASS", "INVALID_INPUT").otherwise(F.col("gate")))
    obs = gated.select(
        "symbol", "interval_start", (F.unix_micros("interval_start") / F.lit(1e6)).alias("event_time"), "price", "v_raw", F.when(F.col("eligible"), 1.0).otherwise(0.0).alias("source_quality"),
        "arrival", "epoch", "market_snapshot_id", refused.alias("skip_reason"), F.col("gate_detail").alias("skip_detail"),
    )
    scored = A.with_capturability(A.with_return_shape(_fold(obs, ["symbol"], E.GatedState())))
    cols = ["symbol", "interval_start", "rn", "c", "h", "path_direction", "perturbation_magnitude", "half_gain", "half_lo", "half_hi", "rate_shift", "rate_lo", "rate_hi",
            "rate_min", "rate_max", "clipped", "data_gap", "block_start", "skip_reason", "skip_detail", "arrival", "epoch", "market_snapshot_id", "strength", "uncertainty"]
    out = _fold(scored.select(*cols), ["symbol"], E.GatedDecide())
    stepped, decided = F.col("rn").isNotNull(), F.col("side").isNotNull()
    status = F.when(decided, "ACTIONABLE").when(stepped, "INITIALIZING")
    names = ["symbol", "epoch", "interval_start", "market_snapshot_id", "side", "c", "path_direction", "emitter_position", "strength", "uncertainty", "skip_reason", "arrival"]
    return out.select(
        *names, status.alias("model_status"), A.rule_path(F.col("side")).alias("rule_path"), (F.col("rn") - 1).alias("accepted_sequence"),
        F.when(stepped & ~decided, F.concat(F.col("rn"), F.lit(f"/{A.CONTEXT + 1}"))).otherwise(F.col("skip_detail")).alias("skip_detail"),
        F.when(stepped, F.concat("symbol", F.lit(":evt:"), "rn")).otherwise(F.concat("symbol", F.lit(":host:"), "arrival")).alias("event_id"),
    )


def stream_prices(bars: DataFrame) -> DataFrame:
    """Numbers from the kernel, labels in SQL, then the two colour interpreters; one row per bar, skips included."""
    obs = P.price_observations(bars).select("symbol", "interval_start", "minutes", "close")
    numbers = _fold(obs, ["symbol"], E.PriceNumbers())
    status = F.when(F.col("skip_reason").isNull(), P.price_status())
    labelled = P.with_emission(numbers.withColumn("status", status))
    skip = F.coalesce("skip_reason", P.skip_reason(F.col("status")))
    near = (F.col("p1_zero_proximity") <= P.POLICY.zero_proximity) & (F.col("deceleration_strength") >= P.POLICY.deceleration)
    cols = ["symbol", "interval_start", "rn", "raw_color", "raw_direction", "motion", "opposing", "crossing", "usable", "status"]
    return _fold(labelled.select(*cols, skip.alias("skip_reason"), F.when(near, F.col("opposing")).alias("slowing")), ["symbol"], E.PriceColors())


def stream_transitions(events: DataFrame) -> DataFrame:
    """Stage events -> published changes."""
    compared = F.to_json(F.struct(*[F.col(f"state.{n}").alias(n) for n in COMPARED]))
    rows = events.select("stage_id", "entity_id", "position", compared.alias("compared"), F.col("state.code").alias("code"))
    return _fold(rows, ["stage_id", "entity_id"], E.Changes())


def stream_tail(live: DataFrame, stored: DataFrame, symbols: list[str] | None = None, form=str.upper) -> DataFrame:
    """The live part of a subscription: events newer than each symbol's latest stored one, each once.

    ``live`` is a stream of events (symbol, interval_start, event_id and more), ``stored`` a batch of them.  The
    latest stored event of a symbol is the state the stream starts from; a subscriber gets those rows first, from
    ``latest_by(stored)``.  A restart goes on from the checkpoint and takes no second snapshot.
    """
    chosen = S.symbol_filter(live, symbols, stored=form)
    told = I.latest_by(S.symbol_filter(stored, symbols, stored=form), ["symbol"], "interval_start").select("symbol", "interval_start", "event_id")
    engine = E.Tail(chosen.columns, chosen.schema)
    return chosen.groupBy("symbol").transformWithStateInPandas(
        statefulProcessor=engine, outputStructType=engine.schema, outputMode="Append", timeMode="None", initialState=told.groupBy("symbol")
    )


def stream_feed_watch(beats: DataFrame, every_seconds: int, lateness: str = LATENESS) -> DataFrame:
    """State of each feed at every beat (symbol, beat) and at every moment ``every_seconds`` apart that passed without one.

    Missing beats are told by an event-time timer, so they count without any row of that feed arriving, as soon as
    the other feeds' beats carry the watermark past them.
    """
    engine = E.FeedWatch(every_seconds)
    seen = (
        beats.select("symbol", "beat").withWatermark("beat", lateness).groupBy("symbol")
        .transformWithStateInPandas(statefulProcessor=engine, outputStructType=engine.schema, outputMode="Append", timeMode="EventTime")
    )
    state = I.feed_state(F.lit(None).cast("string"), F.lit(None).cast("double"), F.col("misses"))
    return seen.withColumn("feed_state", state).withColumn("component", U.feed_component(F.col("feed_state")))


def run_to_parquet(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything available, then stop; restarting continues where it ended."""
    query = (
        df.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def run_updates(df: DataFrame, path: str, checkpoint: str, mode: str = "update") -> None:
    """For update-mode flows: each micro-batch overwrites its own folder, so a
    repeated batch leaves the same rows once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(
        write
    ).start().awaitTermination()
