"""Gates in front of the models and per-arrival outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewick.functions import scalars as S
from candlewick.operators import adaptive as A
from candlewick.operators import price as P
from candlewick.operators import segments as G
from candlewick.operators import volume as V
from candlewick.operators.ingest import continuity_class


def duration_text(seconds: Column) -> Column:
    """Whole seconds as ``1h2m3s``."""
    whole = F.abs(seconds).cast("long")
    h, m, s = F.floor(whole / 3600), F.floor(F.pmod(whole, F.lit(3600)) / 60), F.pmod(whole, F.lit(60))
    text = (
        F.when(h > 0, F.format_string("%dh%dm%ds", h, m, s))
        .when(m > 0, F.format_string("%dm%ds", m, s))
        .otherwise(F.format_string("%ds", s))
    )
    return F.concat(F.when(seconds < 0, "-").otherwise(""), text)


def continuity_detail(kind: Column, last: Column, current: Column) -> Column:
    elapsed = F.when(kind.isin("first", "duplicate") | last.isNull(), F.lit(0)).otherwise(
        F.unix_seconds(current) - F.unix_seconds(last)
    )
    aligned = F.when(S.minute_aligned(current), elapsed).otherwise(F.lit(0))
    return F.concat(
        kind, F.lit(" last="), S.utc_text(last), F.lit(" current="), S.utc_text(current), F.lit(" elapsed="), duration_text(aligned)
    )


def with_reset_epoch(arrivals: DataFrame, resets: DataFrame, order: str = "arrival", layout: G.Layout | None = None) -> DataFrame:
    """Add ``epoch``: the latest reset of the symbol at or before each arrival.

    ``resets`` holds (symbol, ``order``); everything after a reset starts afresh.
    """
    marks = resets.select("symbol", (F.col(order) * 2).alias("_pos"), F.col(order).alias("_reset"))
    rows = arrivals.withColumn("_pos", F.col(order) * 2 + 1)
    both = rows.unionByName(marks, allowMissingColumns=True)
    layout = (layout or G.Layout.of(["symbol"])).along(["symbol"], "_pos")
    laid = G.lay_out(both, layout, 0)
    carried = G.carry_last(laid, layout, {"epoch": F.col("_reset")})
    return carried.filter(F.col("_reset").isNull()).select(*arrivals.columns, F.coalesce("epoch", F.lit(0)).alias("epoch"))


def gate(arrivals: DataFrame, order: str = "arrival", layout: G.Layout | None = None) -> DataFrame:
    """Decide for every arrival whether it reaches the models.

    Optional boolean columns: ``infer`` (default true) and ``proven_missing`` (an
    eligible bar is known to be lost before this one); optional ``epoch``
    restarts a symbol.  Adds ``gate`` (PASS or a skip reason), ``gate_detail`` and
    ``committed``: the row passed and its numbers can be stepped.
    """
    have = set(arrivals.columns)
    arrivals = arrivals.withColumns(
        {c: F.lit(d) for c, d in (("infer", True), ("proven_missing", False)) if c not in have}
    )
    keys = ["symbol", "epoch"] if "epoch" in have else ["symbol"]
    layout = (layout or G.Layout.of(keys)).along(keys, order)
    laid = G.lay_out(arrivals, layout, 0).drop("halo")
    # A lost bar is only noticed on an irregular step, and what it latches skips
    # every later row, so the running maximum needs no knowledge of the latch.
    laid = G.carry_max(laid, layout, "_last", F.when(may_commit(), F.col("interval_start")), inclusive=False)
    kind = continuity_class(F.col("_last"), F.col("interval_start"))
    laid = laid.withColumn("_class", kind)
    gap = F.col("infer") & S.model_eligible() & (F.col("_class") == "irregular") & F.col("proven_missing")
    laid = laid.withColumn("_gap", gap)
    laid = G.carry_max(laid, layout, "_latched", F.when(F.col("_gap"), 1), inclusive=False)
    laid = laid.withColumn("_latched", F.col("_latched") == 1)
    return labelled(laid, may_commit()).drop("_last", "_class", "_gap", "_latched", "rn", "_k", "seg")


def labelled(df: DataFrame, fit: Column) -> DataFrame:
    """``gate``, ``gate_detail`` and ``committed`` from the last committed time ``_last``, the step from it ``_class``, a
    proven gap ``_gap`` and the latch ``_latched``."""
    reason = (
        F.when(F.col("_latched"), "STATE_DISCONTINUOUS")
        .when(~F.col("infer"), "INFER_OFF")
        .when(~eligible(df), "NOT_MODEL_ELIGIBLE")
        .when(F.col("_class").isin("duplicate", "regression"), "DUPLICATE_OR_REGRESSION")
        .when(F.col("_class") == "unaligned", "INVALID_INPUT")
        .when(F.col("_gap"), "INPUT_GAP")
        .otherwise("PASS")
    )
    detail = continuity_detail(F.col("_class"), F.col("_last"), F.col("interval_start"))
    df = df.withColumn("gate", reason)
    return df.withColumns(
        {
            "gate_detail": F.when(F.col("gate") == "STATE_DISCONTINUOUS", "INPUT_GAP")
            .when(F.col("gate").isin("DUPLICATE_OR_REGRESSION", "INVALID_INPUT"), detail)
            .when(F.col("gate") == "INPUT_GAP", F.concat(detail, F.lit(" proven_missing_eligible"))),
            "committed": (F.col("gate") == "PASS") & fit,
        }
    )


def eligible(df: DataFrame) -> Column:
    """Model eligibility, where it has been judged before as a column."""
    return F.col("eligible") if "eligible" in df.columns else S.model_eligible()


def may_commit() -> Column:
    """An arrival that changes the models if it passes: inference is on, the bar is eligible, aligned and readable."""
    numbers = S.finite("close") & S.finite(F.col("volume").cast("double"))
    return F.coalesce(F.col("infer") & S.model_eligible() & S.minute_aligned("interval_start") & numbers, F.lit(False))


def decision_outcomes(gated: DataFrame) -> DataFrame:
    """One terminal outcome per arrival: a decision or a typed skip, never both."""
    keys = ["symbol", "epoch"] if "epoch" in gated.columns else ["symbol"]
    key = [*keys, "interval_start"]
    accepted = gated.filter("committed")
    made = A.decisions(accepted, G.Layout.of(keys))
    made = made.select(
        *key, "market_snapshot_id", "side", "c", "path_direction", "model_status", "emitter_position", "rule_path",
        "strength", "uncertainty", "skip_reason", "skip_detail", "accepted_sequence", "event_id",
    )
    skipped = gated.filter(~F.col("committed")).select(
        *key,
        "market_snapshot_id",
        "arrival",
        F.when(F.col("gate") == "PASS", "INVALID_INPUT").otherwise(F.col("gate")).alias("skip_reason"),
        F.col("gate_detail").alias("skip_detail"),
        F.concat(F.col("symbol"), F.lit(":host:"), F.col("arrival")).alias("event_id"),
    )
    arrivals = accepted.select(*key, "arrival")
    return G.join_null_safe(made, arrivals, key).unionByName(skipped, allowMissingColumns=True)


def joint_commit(gated: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Decisions and prices over the committed rows; volume on every passed row, which only grow in time."""
    keys = ["symbol", "epoch"] if "epoch" in gated.columns else ["symbol"]
    accepted = gated.filter("committed")
    passed = gated.filter(F.col("gate") == "PASS")
    layout = G.Layout.of(keys)
    return A.decisions(accepted, layout), P.price_events(accepted, layout), V.volume_events(passed, layout)
