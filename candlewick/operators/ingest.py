"""Revisions, windows, gap fill, continuity, model path and readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlewick.functions import scalars as S
from candlewick.operators import segments as G

# Fixed values.
WINDOW_LIMIT = 64
MIN_CONTIGUOUS = 2
HEARTBEAT_MAX_RTT_MS = 1500
HEARTBEAT_MAX_MISSES = 3
GAP_FILL_MINUTES = 15


def finalized(bars: DataFrame) -> DataFrame:
    return bars.filter(F.col("is_final"))


def latest_by(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One newest row per key; of rows equal in ``order`` any one.

    The rank filter becomes a group limit in front of the shuffle: a task sends one row of each key it
    holds, so a hot key is one row per task.
    """
    newest_first = Window.partitionBy(*keys).orderBy(*[F.col(o).desc() for o in order])
    return df.withColumn("_age", F.row_number().over(newest_first)).filter(F.col("_age") == 1).drop("_age")


def last_bar(bars: DataFrame) -> DataFrame:
    return latest_by(bars, ["symbol"], "interval_start")


def last_finalized(bars: DataFrame) -> DataFrame:
    return last_bar(finalized(bars))


def bar_window(bars: DataFrame, limit: int = WINDOW_LIMIT) -> DataFrame:
    """The newest ``limit`` bars of each symbol.

    The rank filter becomes a per-task group limit before the shuffle, so no
    task receives more than ``limit`` rows of a symbol from any other.
    """
    if not 0 < limit <= WINDOW_LIMIT:
        raise ValueError(f"a window holds 1 to {WINDOW_LIMIT} bars")
    newest_first = Window.partitionBy("symbol").orderBy(F.col("interval_start").desc())
    return bars.withColumn("_age", F.row_number().over(newest_first)).filter(F.col("_age") <= limit).drop("_age")


# --- revisions ---------------------------------------------------------------


def revision_rank() -> Column:
    """PARTIAL < RECONSTRUCTED < live COMPLETE."""
    return F.when(S.model_eligible(), 2).when(F.col("is_final"), 1).otherwise(0)


def resolve_revisions(arrivals: DataFrame, arrival: str = "arrival") -> DataFrame:
    """One bar per (symbol, interval_start): best rank, then newest arrival."""
    ranked = arrivals.withColumn("_rank", revision_rank())
    return latest_by(ranked, ["symbol", "interval_start"], "_rank", arrival).drop("_rank")


_GENERATION = ("open", "high", "low", "close", "volume", "is_final", "is_backfilled", "quality_status")


def _slim(*order: Column) -> Column:
    """What revision rules look at, sortable by order."""
    return F.struct(
        *[o.alias(f"o{i}") for i, o in enumerate(order)],
        F.col("market_snapshot_id").alias("id"), S.model_eligible().alias("live"), F.struct(*_GENERATION).alias("gen"),
    )


def _supersedes(stored: Column, incoming: Column) -> Column:
    old, new = stored["gen"], incoming["gen"]
    same_id = F.coalesce((stored["id"] != "") & (stored["id"] == incoming["id"]), F.lit(False))
    same = same_id | old.eqNullSafe(new)
    downgrade = F.coalesce(old["is_final"] & ~new["is_final"], F.lit(False))
    overtaken = F.coalesce(stored["live"] & new["is_backfilled"], F.lit(False))
    return ~same & ~downgrade & ~overtaken


def _replayed(revisions: Column) -> Column:
    """Struct of the surviving revision and the number of accepted ones, oldest first."""
    start = F.struct(F.get(revisions, F.lit(0)).alias("row"), F.lit(1).alias("taken"))

    def step(acc: Column, row: Column) -> Column:
        wins = _supersedes(acc["row"], row)
        return F.struct(F.when(wins, row).otherwise(acc["row"]).alias("row"), (acc["taken"] + F.when(wins, 1).otherwise(0)).alias("taken"))

    return F.aggregate(F.slice(revisions, 2, F.greatest(F.size(revisions) - 1, F.lit(0))), start, step)


def resolve_revisions_exact(arrivals: DataFrame, arrival: str = "arrival") -> DataFrame:
    """Arrival-by-arrival replay, including the drop of a final bar whose values
    equal the stored partial (the snapshot id does not cover finality).

    The revisions of one minute are folded as slim structs; the row that survives comes back by its arrival number.
    A NULL arrival comes first; of several rows with one arrival number any one stays.
    """
    keys = ["symbol", "interval_start"]
    folded = arrivals.groupBy(*keys).agg(F.sort_array(F.collect_list(_slim(F.col(arrival)))).alias("_all"))
    winner = folded.select(*keys, _replayed(F.col("_all"))["row"]["o0"].alias("_winner"))
    return G.join_null_safe(arrivals, winner, keys).filter(F.col(arrival).eqNullSafe(F.col("_winner"))).drop("_winner").dropDuplicates(keys)


def gap_fill(store: DataFrame, history: DataFrame, as_of: Column, start: Column | None = None, end: Column | None = None, order: str | None = None):
    """Merge historical bars into the store.

    Returns ``(merged, counts)``.  Without ``start`` a symbol is filled from its last stored bar, one without bars
    from ``GAP_FILL_MINUTES`` before ``as_of``; without ``end`` until ``as_of``.  Historical rows are judged one after the other
    (by ``order``, else by their values), each against what the store and the rows before it have left.
    Counts per symbol: fetched, injected, deduplicated.
    """
    keys = ["symbol", "interval_start"]
    last = store.groupBy("symbol").agg(F.max("interval_start").alias("_last"))
    low = start if start is not None else F.coalesce("_last", as_of - F.expr(f"INTERVAL {GAP_FILL_MINUTES} MINUTES"))
    high = end if end is not None else as_of
    wanted = G.join_null_safe(history, last, ["symbol"], "left").filter((F.col("interval_start") >= low) & (F.col("interval_start") <= high))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*([order] if order else []), F.struct(*_GENERATION), "market_snapshot_id"))
    both = store.select(*store.columns, F.lit(0).alias("_nth")).unionByName(wanted.select(*store.columns, nth.alias("_nth")))
    folded = both.groupBy(*keys).agg(F.sort_array(F.collect_list(_slim(F.col("_nth")))).alias("_all"))
    stored = F.get("_all", F.lit(0))["o0"] == 0
    done = _replayed(F.col("_all"))
    folded = folded.select(
        *keys, done["row"]["o0"].alias("_winner"),
        (F.size("_all") - stored.cast("int")).alias("fetched"), (done["taken"] - stored.cast("int")).alias("injected"),
    )
    merged = G.join_null_safe(both, folded.select(*keys, "_winner"), keys).filter("_nth = _winner").select(*store.columns)
    counts = (
        folded.groupBy("symbol")
        .agg(F.sum("fetched").alias("fetched"), F.sum("injected").alias("injected"))
        .filter("fetched > 0")
        .withColumn("deduplicated", F.col("fetched") - F.col("injected"))
    )
    return merged, counts


# --- continuity --------------------------------------------------------------


def continuity_class(prev: Column, curr: Column, step_seconds: int = 60) -> Column:
    step = step_seconds * 1_000_000
    elapsed = F.unix_micros(curr) - F.unix_micros(prev)
    return (
        F.when(~S.minute_aligned(curr), "unaligned")
        .when(prev.isNull(), "first")
        .when(elapsed == 0, "duplicate")
        .when(elapsed < 0, "regression")
        .when(F.pmod(elapsed, F.lit(60_000_000)) != 0, "unaligned")
        .when(elapsed == step, "normal")
        .otherwise("irregular")
    )


def elapsed_seconds(prev: Column, curr: Column) -> Column:
    return F.when(
        S.minute_aligned(curr) & prev.isNotNull(), (F.unix_micros(curr) - F.unix_micros(prev)) / F.lit(1_000_000.0)
    ).otherwise(F.lit(0.0))


def classify_continuity(bars: DataFrame, step_seconds: int = 60, layout: G.Layout | None = None) -> DataFrame:
    """Class and elapsed seconds against the previous bar of the symbol."""
    layout = layout or G.Layout.of(["symbol"])
    laid = G.lay_out(bars, layout, 1)
    laid = laid.withColumn("_prev", F.lag("interval_start").over(layout.window)).filter(~F.col("halo"))
    return laid.withColumns(
        {
            "continuity": continuity_class(F.col("_prev"), F.col("interval_start"), step_seconds),
            "elapsed_s": elapsed_seconds(F.col("_prev"), F.col("interval_start")),
        }
    ).drop("_prev", "_k", "seg", "halo")


def classify_arrivals(arrivals: DataFrame, arrival: str = "arrival", layout: G.Layout | None = None) -> DataFrame:
    """Continuity of every arrival against the last bar accepted before it.

    The last accepted start is the running maximum over earlier eligible,
    aligned arrivals: anything later than it is accepted, nothing else is.
    """
    layout = (layout or G.Layout.of(["symbol"])).along(["symbol"], arrival)
    eligible = S.model_eligible() & S.minute_aligned("interval_start")
    laid = G.lay_out(arrivals, layout, 0).filter(~F.col("halo"))
    laid = G.carry_max(laid, layout, "last_accepted", F.when(eligible, F.col("interval_start")), inclusive=False)
    return laid.withColumns(
        {
            "continuity": continuity_class(F.col("last_accepted"), F.col("interval_start")),
            "elapsed_s": elapsed_seconds(F.col("last_accepted"), F.col("interval_start")),
        }
    ).drop("_k", "seg", "halo", "rn")


def model_path(arrivals: DataFrame, arrival: str = "arrival", layout: G.Layout | None = None) -> DataFrame:
    """Bars offered to the models: eligible, aligned, strictly later than before.

    Irregular gaps stay; duplicates, regressions and corrected finals of an
    already forwarded minute do not.
    """
    eligible = arrivals.filter(S.model_eligible())
    seen = classify_arrivals(eligible, arrival, layout)
    return seen.filter(F.col("continuity").isin("first", "normal", "irregular"))


def has_eligible_between(bars: DataFrame, ranges: DataFrame, layout: G.Layout | None = None) -> DataFrame:
    """Flag ranges (symbol, from, to) that hold an eligible bar strictly inside.

    The last eligible start before ``to`` decides, so one ordered pass over the
    union answers all ranges; no range join is needed.
    """
    marks = bars.filter(S.model_eligible()).select(
        "symbol", F.col("interval_start").alias("_at"), F.lit(1).alias("_kind"), F.col("interval_start").alias("_hit"),
        F.lit(None).cast("timestamp").alias("from"),
    )
    asks = ranges.select(
        "symbol", F.col("to").alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast("timestamp").alias("_hit"), "from"
    )
    both = marks.unionByName(asks).withColumn("_pos", F.unix_micros("_at") * 2 + F.col("_kind"))
    layout = (layout or G.Layout.of(["symbol"])).along(["symbol"], "_pos")
    laid = G.lay_out(both, layout, 0)
    found = G.carry_last(laid, layout, {"_last": F.col("_hit")}, inclusive=False)
    return found.filter(F.col("_kind") == 0).select(
        "symbol", "from", F.col("_at").alias("to"),
        F.coalesce(F.col("_last") > F.col("from"), F.lit(False)).alias("has_eligible"),
    )


# --- readiness ---------------------------------------------------------------


def contiguous_finalized(arrivals: DataFrame, n: int = MIN_CONTIGUOUS, order: str = "arrival") -> DataFrame:
    """Per symbol: do the last ``n`` final bars have strictly increasing starts?"""
    newest_first = Window.partitionBy("symbol").orderBy(F.col(order).desc())
    tail = (
        finalized(arrivals)
        .withColumn("_age", F.row_number().over(newest_first))
        .filter(F.col("_age") <= n)
        .withColumn("_older", F.lead("interval_start").over(newest_first))
    )
    return tail.groupBy("symbol").agg(
        (
            (F.count("*") >= n)
            & F.bool_and(F.col("_older").isNull() | (F.col("interval_start") > F.col("_older")))
        ).alias("contiguous")
    )


def infer_ready(bars: DataFrame, as_of: Column, order: str = "interval_start") -> DataFrame:
    """Per symbol readiness of a resolved store at ``as_of``."""
    last = last_finalized(bars).select(
        "symbol", (S.model_eligible() & S.live_fresh(as_of)).alias("last_ok"), "interval_start"
    )
    return (
        G.join_null_safe(contiguous_finalized(bars, MIN_CONTIGUOUS, order), last, ["symbol"])
        .select("symbol", F.col("interval_start").alias("last_final"), (F.col("contiguous") & F.col("last_ok")).alias("infer_ready"))
    )


def infer_ready_all(bars: DataFrame, symbols: DataFrame, as_of: Column) -> DataFrame:
    """One flag: a configured symbol without a ready window blocks everyone."""
    ready = symbols.join(infer_ready(bars, as_of), "symbol", "left")
    return ready.agg(
        F.count("*").alias("configured"),
        F.count_if(F.coalesce("infer_ready", F.lit(False))).alias("ready"),
        F.coalesce(F.bool_and(F.coalesce("infer_ready", F.lit(False))), F.lit(True)).alias("infer"),
    )


def feed_state(state: Column, pong_rtt_ms: Column, misses: Column) -> Column:
    return (
        F.when(state == "RECOVERING", "RECOVERING")
        .when(pong_rtt_ms > HEARTBEAT_MAX_RTT_MS, "FAILED")
        .when(misses >= HEARTBEAT_MAX_MISSES, "FAILED")
        .when(state == "FAILED", "FAILED")
        .otherwise("HEALTHY")
    )


def observable(state: Column) -> Column:
    return F.coalesce(state.isin("HEALTHY", "DEGRADED", "RECOVERING"), F.lit(False))


def capability(state: Column, infer: Column, filling: Column) -> Column:
    return (
        F.when(filling | (state == "RECOVERING"), "RECOVERING")
        .when(~observable(state), "NOT_READY")
        .when(infer, "OBSERVE_INFER")
        .otherwise("OBSERVE_ONLY")
    )


def readiness(state: Column, infer: Column) -> Column:
    observe = observable(state)
    return F.struct(
        observe.alias("ready"),
        observe.alias("observe"),
        infer.alias("infer"),
        F.when(~observe, "feed not ready")
        .when(~infer, "observable; inference gated on data quality")
        .otherwise(state)
        .alias("message"),
    )
