"""The same operators over short segments and over bars without a symbol.

Short segments make every history cross many borders; the checks are those of the plain queries.  Without a
symbol means that one of the symbols is NULL: its rows are a history of their own like any other.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from candlewick.catalog import adaptive, changes, host, ingest, price, streaming, volume
from candlewick.catalog.helpers import pick, plain, r
from candlewick.functions import scalars as S
from candlewick.operators import adaptive as A
from candlewick.operators import gate as H
from candlewick.operators import ingest as I
from candlewick.operators import price as P
from candlewick.operators import transitions as T
from candlewick.operators import volume as V
from candlewick.operators.segments import Layout
from candlewick.plans import changes as C
from candlewick.sources.arrivals import feed_arrivals
from candlewick.sources.ticks import event_bars

KEY = ["symbol", "interval_start"]
SHORT = Layout.of(["symbol"], rows=64)
NAMELESS = "click"


def nameless(df):
    return df.withColumn("symbol", F.when(F.col("symbol") != NAMELESS, F.col("symbol")))


def volumes(bars, layout=None):
    return plain(V.volume_events(bars, layout).select(*KEY, "raw_color", "indicator", "transition"))


def prices(bars, layout=None):
    return plain(P.emissions(bars, layout).select(*KEY, "raw_color", "color", "debounced"))


def decided(bars, layout=None):
    return pick(A.decisions(bars, layout), *KEY, "rn", "c:9", "side", "emitter_position", "forward_half_life:7", "ref_alpha:9", "model_health")


def gated(arrivals, layout=None):
    return plain(H.gate(arrivals, layout=layout).select(*KEY, "arrival", "gate", "gate_detail", "committed"))


def outcomes(arrivals):
    o = H.decision_outcomes(H.gate(arrivals))
    kind = S.outcome_kind(F.col("side"), F.col("skip_reason"))
    return plain(o.select(*KEY, "arrival", kind.alias("kind"), "side", r("c"), "emitter_position", "skip_reason", "skip_detail", "accepted_sequence"))


def path(arrivals, layout=None):
    return plain(I.model_path(arrivals, layout=layout).select(*KEY, "arrival", "continuity"))


def changed(spark, d):
    events = C.all_events(event_bars(spark, d), changes.beats(spark, d))
    c = T.transitions(events, Layout.of(["stage_id", "entity_id"], rows=64))
    return plain(
        c.select(*changes.KEY, "sequence", "transition_id", "position", "effective_time", "market_snapshot_id", "accepted_sequence",
                 F.col("previous.code").alias("prev_code"), "current.code", *[F.col(f"current.{n}").alias(n) for n in T.COMPARED])
    )


def resets(spark, d):
    """Epochs and the gate of every epoch, over short segments."""
    a = host.flagged(spark, d)
    marks = a.filter(F.col("interval_start") >= F.lit("2024-01-15").cast("timestamp")).groupBy("symbol").agg(F.min("arrival").alias("arrival"))
    g = H.gate(H.with_reset_epoch(a, marks, layout=SHORT), layout=Layout.of(["symbol", "epoch"], rows=64))
    o = H.decision_outcomes(g)
    return plain(o.select(*KEY, "arrival", "epoch", "side", r("c"), "skip_reason", "accepted_sequence"))


def filled(spark, d):
    live, history = ingest.split_store(spark, d)
    merged, _ = I.gap_fill(nameless(live), nameless(history), F.lit(ingest.FILL_AS_OF).cast("timestamp"), order="arrival")
    return plain(merged.select(*KEY, *ingest.FACTS))


def exact(spark, d):
    a = nameless(feed_arrivals(spark, d))
    return plain(I.resolve_revisions_exact(a).select(*KEY, "arrival", *ingest.FACTS))


QUERIES = {
    "volume_short_segments": lambda s, d: volumes(event_bars(s, d), SHORT),
    "price_short_segments": lambda s, d: prices(event_bars(s, d), SHORT),
    "decisions_short_segments": lambda s, d: decided(event_bars(s, d), SHORT),
    "gate_short_segments": lambda s, d: gated(host.flagged(s, d), SHORT),
    "model_path_short_segments": lambda s, d: path(feed_arrivals(s, d), SHORT),
    "transitions_short_segments": changed,
    "reset_short_segments": resets,
    "volume_null_symbol": lambda s, d: volumes(nameless(event_bars(s, d))),
    "price_null_symbol": lambda s, d: prices(nameless(event_bars(s, d))),
    "decisions_null_symbol": lambda s, d: decided(nameless(event_bars(s, d))),
    "gate_null_symbol": lambda s, d: gated(nameless(host.flagged(s, d))),
    "outcomes_null_symbol": lambda s, d: outcomes(nameless(host.flagged(s, d))),
    "model_path_null_symbol": lambda s, d: path(nameless(feed_arrivals(s, d))),
    "gap_fill_null_symbol": filled,
    "resolve_exact_null_symbol": exact,
}


def _without(sql: str) -> str:
    return f"SELECT CASE WHEN symbol <> '{NAMELESS}' THEN symbol END AS symbol, * EXCLUDE (symbol) FROM ({sql})"


_PLAIN = {
    "volume": volume.ORACLE["volume_confirm"],
    "price": price.ORACLE["price_debounce"],
    "decisions": streaming.ORACLE["stream_models_decisions"],
    "gate": host.ORACLE["gate_skip"],
    "outcomes": host.ORACLE["joint_outcomes"],
    "model_path": ingest.ORACLE["model_path"],
    "transitions": changes.ORACLE["transitions"],
    "reset": host.ORACLE["reset_symbol"],
    "gap_fill": ingest.ORACLE["gap_fill_merge"],
    "resolve_exact": ingest.ORACLE["resolve_revisions_exact"],
}
ORACLE = {name: sql if name.endswith("_short_segments") else _without(sql) for name, sql in ((n, _PLAIN[n.rsplit("_", 2)[0]]) for n in QUERIES)}
