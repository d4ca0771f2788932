"""Registered streaming queries: run to the end of the input, then read the sink."""

from __future__ import annotations

from pyspark.sql import functions as F

from candlewick.catalog import host
from candlewick.catalog.changes import beats
from candlewick.catalog.helpers import pick, plain, r
from candlewick.catalog.sources import scratch
from candlewick.catalog.sqltext import adaptive_cte, arrivals_cte, bars_cte, beats_cte, confirm_cte, policy_cte, price_cte, resolved_cte, volume_cte
from candlewick.functions import scalars as S
from candlewick.operators import adaptive as A
from candlewick.operators import price as P
from candlewick.operators import volume as V
from candlewick.operators import ingest as I
from candlewick.operators.ingest import latest_by
from candlewick.operators.tails import tail
from candlewick.plans import changes as C
from candlewick.session import stage
from candlewick.sources.arrivals import feed_arrivals
from candlewick.sources.ticks import event_bars, read_table
from candlewick.streaming import flows as L

KEY = ["symbol", "interval_start"]
FILES = 8
#: Days of the month at which the replayed input is cut into arrival slices.
CUTS = (11, 21)


def replay(spark, df, slices=None, day="interval_start"):
    """Land a frame as files in slice order and read it back as a stream."""
    path, df = scratch(spark, "landing"), stage(df)  # computed once, not once a slice
    d = F.dayofmonth(day)
    slices = slices or [d < CUTS[0], (d >= CUTS[0]) & (d < CUTS[1]), d >= CUTS[1]]
    for keep in slices:
        df.filter(keep).repartition(FILES).write.mode("append").parquet(path)
    return L.read_bar_stream(L.configure(spark), path, df.schema, FILES)


def collected(spark, flow, run=L.run_to_parquet, mode="append"):
    path = scratch(spark, "sink")
    run(flow, path, f"{path}-checkpoint", mode)
    return spark.read.parquet(path)


def ticks(spark, d):
    schema = read_table(spark, d, "events").schema
    return L.configure(spark).readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", FILES).parquet(d)


def _hourly(spark, d):
    return L.stream_bars(ticks(spark, d), "event_type", "value", F.get_json_object("props", "$.k"), ["ts", "event_id"], "1 hour")


def bars(spark, d):
    return plain(collected(spark, _hourly(spark, d)).select(*KEY, "open", "high", "low", "close", "volume", "event_count"))


def volume_from_ticks(spark, d):
    flow = _hourly(spark, d).withColumns({"source_timestamp": F.lit(""), "market_snapshot_id": F.lit("")})
    return pick(collected(spark, L.stream_volume(flow)), *KEY, "rn", "v_n:9", "interval_mean:9", "raw_color", "indicator", "transition")


def revisions(spark, d):
    a = feed_arrivals(spark, d)
    seen = collected(spark, L.stream_revisions(replay(spark, a)), L.run_updates, "update")
    last = latest_by(seen, KEY, "batch")
    return plain(last.select(*KEY, "arrival", "close", "volume", "quality_status"))


def bar_window(limit):
    """Every arrival's effect on the bounded window of its symbol, in slices by arrival."""

    def run(spark, d):
        a, at = feed_arrivals(spark, d), F.col("arrival")
        low, high = a.approxQuantile("arrival", [0.3, 0.6], 0.0)
        got = collected(spark, L.stream_window(replay(spark, a, [at < low, (at >= low) & (at < high), at >= high]), limit))
        return plain(got.select(*KEY, "arrival", "accepted", "evicted", "held"))

    return run


def first_arrivals(spark, d):
    b = event_bars(spark, d)
    twice = b.unionByName(b)
    return plain(collected(spark, L.stream_first_arrivals(replay(spark, twice))).select(*KEY, "close", "volume"))


def decisions(spark, d):
    got = collected(spark, L.stream_decisions(replay(spark, event_bars(spark, d))))
    return pick(got, *KEY, "rn", "c:9", "side", "emitter_position", "forward_half_life:7", "ref_alpha:9", "model_health")


def gated_outcomes(spark, d):
    """Arrivals and resets, landed together in slices by arrival: gate, models and decisions of every epoch."""
    a = host.flagged(spark, d)
    marks = a.filter(F.col("interval_start") >= F.lit("2024-01-15").cast("timestamp")).groupBy("symbol").agg(F.min("arrival").alias("arrival"))
    low, high = a.approxQuantile("arrival", [0.3, 0.6], 0.0)
    at = F.col("arrival")
    slices = [at < low, (at >= low) & (at < high), at >= high]
    both = a.withColumn("is_reset", F.lit(False)).unionByName(marks.withColumn("is_reset", F.lit(True)), allowMissingColumns=True)
    rows = replay(spark, both, slices)
    flow = L.stream_outcomes(L.stream_gate(rows.filter("NOT is_reset"), rows.filter("is_reset")))
    return plain(collected(spark, flow).select(*KEY, "arrival", "epoch", "side", r("c"), "skip_reason", "accepted_sequence"))


def prices(spark, d):
    got = collected(spark, L.stream_prices(replay(spark, event_bars(spark, d))))
    return plain(got.select(*KEY, "status", "skip_reason", "raw_color", "color", "cockpit_color", "refined_state", "turn_candidate", "candidate_age", "persistence_count"))


def late_rows(spark, d):
    """History that lands after newer bars: every row of it becomes a typed skip."""
    b = event_bars(spark, d)
    day = F.dayofmonth("interval_start")
    got = collected(spark, L.stream_volume(replay(spark, b, [day >= CUTS[0], day < CUTS[0]])))
    return plain(got.select(*KEY, "skip_reason", r("v_n"), "indicator"))


def transitions(spark, d):
    events = C.feed_events(beats(spark, d))
    flow = L.stream_transitions(replay(spark, events, day="effective_time"))
    return collected(spark, flow).select("stage_id", "entity_id", "position", "sequence", "transition_id", "prev_code", "code")


CUT = "2024-01-20 00:00:00"
FRESH = "2024-01-19 12:00:00"


def _tail(events, value):
    at = F.col("interval_start")
    stored = events.filter(at < F.lit(CUT).cast("timestamp"))
    live = events.filter(at >= F.lit(FRESH).cast("timestamp"))  # overlaps what was stored
    live = live.join(latest_by(stored, ["symbol"], "interval_start").select("symbol", F.col("interval_start").alias("_upto")), "symbol")
    live = live.filter(at >= F.col("_upto")).drop("_upto")
    return plain(tail(stored, live).select(*KEY, "event_id", "phase", value.alias("value")))


def tail_decisions(spark, d):
    e = A.decisions(event_bars(spark, d)).select(*KEY, "event_id", F.coalesce("side", "skip_reason").alias("v"))
    return _tail(e, F.col("v"))


def tail_price(spark, d):
    e = P.price_events(event_bars(spark, d)).select("symbol", F.col("trigger_interval_start").alias("interval_start"), "event_id", "status")
    return _tail(e, F.col("status"))


def tail_volume(spark, d):
    e = V.volume_events(event_bars(spark, d)).select(*KEY, "event_id", "indicator")
    return _tail(e, F.col("indicator"))


def tail_limited(spark, d):
    """The first 20 events a late subscriber to two symbols receives."""
    e = V.volume_events(event_bars(spark, d)).select(*KEY, "event_id", "indicator")
    at = F.col("interval_start")
    stored, live = e.filter(at < F.lit(CUT).cast("timestamp")), e.filter(at >= F.lit(CUT).cast("timestamp"))
    return plain(tail(stored, live, ["click", "VIEW"], 20, str.lower).select(*KEY, "phase", "indicator"))


def live_tail(symbols=None):
    """Subscription at two quarters of the time; bars land in two parts and the stream is stopped between them."""

    def run(spark, d):
        b, at = stage(event_bars(spark, d)), F.unix_micros("interval_start")  # read by every part
        low, high = b.agg(F.min(at), F.max(at)).first()
        upto = lambda quarters: low + (high - low) * quarters // 4
        event = lambda v: v.withColumn("event_id", F.concat("symbol", F.lit(":volume:"), "rn")).select(*KEY, "event_id", "indicator")
        stored = event(V.volume_events(b.filter(at < upto(2))))
        landing, sink = scratch(spark, "landing"), scratch(spark, "sink")
        for part in (at < upto(3), at >= upto(3)):
            b.filter(part).repartition(FILES).write.mode("append").parquet(landing)
            live = event(L.stream_volume(L.read_bar_stream(L.configure(spark), landing, b.schema, FILES)))
            L.run_to_parquet(L.stream_tail(live, stored, symbols, str.lower), sink, f"{sink}-checkpoint")
        first = latest_by(S.symbol_filter(stored, symbols, stored=str.lower), ["symbol"], "interval_start").withColumn("phase", F.lit(0))
        return plain(first.unionByName(spark.read.parquet(sink).withColumn("phase", F.lit(1))))

    return run


def feed_watch(spark, d):
    """Bars as heartbeats of their symbols, one due every hour."""
    beats = event_bars(spark, d, "1 minute").select("symbol", F.col("interval_end").alias("beat"))
    return plain(collected(spark, L.stream_feed_watch(replay(spark, beats, day="beat"), 3600, "90 seconds")))


QUERIES = {
    "tail_volume_live": live_tail(),
    "tail_volume_live_chosen": live_tail(["click", "VIEW"]),
    "stream_feed_watch": feed_watch,
    "stream_bars": bars,
    "stream_volume_from_ticks": volume_from_ticks,
    "stream_dedup_revisions": revisions,
    "stream_dedup_first": first_arrivals,
    "stream_bar_window": bar_window(64),
    "stream_bar_window_short": bar_window(2),
    "stream_models_decisions": decisions,
    "stream_models_prices": prices,
    "stream_gated_outcomes": gated_outcomes,
    "late_or_duplicate": late_rows,
    "stream_transitions": transitions,
    "tail_decisions": tail_decisions,
    "tail_price": tail_price,
    "tail_volume": tail_volume,
    "tail_volume_limited": tail_limited,
}

_CLOSED = f"""{bars_cte('all_bars')}, bars AS (SELECT * FROM all_bars WHERE interval_end <= (SELECT max(ts) - INTERVAL 90 SECONDS FROM events))"""
_VOL = f"WITH RECURSIVE {bars_cte()}, {volume_cte()}, {confirm_cte()}"
_TAIL = f"""WHERE interval_start >= TIMESTAMP '{CUT}' OR n = 1"""


def _tailed(inner: str) -> str:
    return f"""e AS ({inner}), k AS (SELECT *, CASE WHEN interval_start < TIMESTAMP '{CUT}' THEN row_number() OVER (PARTITION BY symbol, interval_start < TIMESTAMP '{CUT}' ORDER BY interval_start DESC) END AS n FROM e)
  SELECT symbol, interval_start, event_id, CASE WHEN interval_start < TIMESTAMP '{CUT}' THEN 0 ELSE 1 END AS phase, value FROM k {_TAIL}"""



def _windowed(limit: int) -> str:
    """Replay of the window, one arrival of every symbol a step; the held bars are a list."""
    return f"""WITH RECURSIVE {arrivals_cte()},
queue AS (SELECT symbol, interval_start, arrival, market_snapshot_id AS id, is_final AS fin, is_backfilled AS rep, quality_status = 'COMPLETE' AS live,
    row_number() OVER (PARTITION BY symbol ORDER BY arrival, interval_start) AS k FROM arrivals),
slim AS (SELECT *, {{'s': interval_start, 'id': id, 'fin': fin, 'live': live}} AS bar FROM queue),
steps AS (
  SELECT symbol, k, interval_start, arrival, true AS accepted, NULL::TIMESTAMP AS evicted, [bar] AS bars FROM slim WHERE k = 1
  UNION ALL
  SELECT symbol, k, interval_start, arrival, taken, CASE WHEN len(put) > {limit} THEN put[1].s END, CASE WHEN len(put) > {limit} THEN put[2:] ELSE put END
  FROM (SELECT *, CASE WHEN taken THEN list_sort(list_append(list_filter(bars, lambda x: x.s <> interval_start), bar)) ELSE bars END AS put
    FROM (SELECT n.symbol, n.k, n.interval_start, n.arrival, n.bar, w.bars,
        len(list_filter(w.bars, lambda x: x.s = n.interval_start AND (x.id = n.id OR (x.fin AND NOT n.fin) OR (x.live AND n.rep)))) = 0 AS taken
      FROM steps w JOIN slim n ON n.symbol = w.symbol AND n.k = w.k + 1)))
SELECT symbol, interval_start, arrival, accepted, evicted, len(bars) AS held FROM steps"""


def _live(where: str) -> str:
    return f"""{_VOL}, e AS (SELECT v.symbol, v.interval_start, v.symbol || ':volume:' || v.rn AS event_id, c.color AS indicator FROM vol v LEFT JOIN conf c ON c.symbol = v.symbol AND c.rn = v.rn),
  m AS (SELECT min(epoch_us(interval_start)) AS low, max(epoch_us(interval_start)) AS high FROM e),
  k AS (SELECT e.*, CASE WHEN epoch_us(interval_start) < low + (high - low) * 2 // 4 THEN 0 ELSE 1 END AS phase FROM e, m WHERE {where})
  SELECT symbol, interval_start, event_id, indicator, phase FROM k QUALIFY phase = 1 OR row_number() OVER (PARTITION BY symbol, phase ORDER BY interval_start DESC) = 1"""


_WATCH = f"""WITH {bars_cte('b0', unit='minute')}, b AS (SELECT symbol, interval_end AS beat, lead(interval_end) OVER (PARTITION BY symbol ORDER BY interval_end) AS next FROM b0),
  w AS (SELECT max(beat) - INTERVAL 90 SECONDS AS wm FROM b),
  t AS (SELECT symbol, unnest(generate_series(beat, coalesce(next - INTERVAL 1 MICROSECOND, greatest(wm, beat)), INTERVAL 1 HOUR)) AS "at", beat FROM b, w),
  n AS (SELECT symbol, "at", CAST((epoch_us("at") - epoch_us(beat)) // 3600000000 AS BIGINT) AS misses FROM t)
  SELECT symbol, "at", misses, CASE WHEN misses >= {I.HEARTBEAT_MAX_MISSES} THEN 'FAILED' ELSE 'HEALTHY' END AS feed_state, CASE WHEN misses >= {I.HEARTBEAT_MAX_MISSES} THEN 'UNAVAILABLE' ELSE 'HEALTHY' END AS component FROM n"""


ORACLE = {
    "tail_volume_live": _live("true"),
    "tail_volume_live_chosen": _live("symbol IN ('click', 'view')"),
    "stream_feed_watch": _WATCH,
    "stream_bar_window": _windowed(64),
    "stream_bar_window_short": _windowed(2),
    "stream_bars": f"WITH {_CLOSED} SELECT symbol, interval_start, open, high, low, close, volume, event_count FROM bars",
    "stream_volume_from_ticks": f"""WITH RECURSIVE {_CLOSED}, {volume_cte()}, {confirm_cte()} SELECT v.symbol, v.interval_start, v.rn, round(v_n, 9) AS v_n, round(interval_mean, 9) AS interval_mean, v.raw_color,
  c.color AS indicator, c.transition FROM vol v LEFT JOIN conf c ON c.symbol = v.symbol AND c.rn = v.rn""",
    "stream_dedup_revisions": f"WITH {resolved_cte()} SELECT symbol, interval_start, arrival, close, volume, quality_status FROM store",
    "stream_dedup_first": f"WITH {bars_cte()} SELECT symbol, interval_start, close, volume FROM bars",
    "stream_models_decisions": f"""WITH RECURSIVE {bars_cte()}, {adaptive_cte()} SELECT symbol, interval_start, rn, round(c, 9) AS c, side, emitter_position, round(half, 7) AS forward_half_life, round(alpha, 9) AS ref_alpha, model_health FROM dec""",
    "stream_models_prices": f"""WITH RECURSIVE {bars_cte()}, {price_cte()}, {policy_cte()}, st AS (
    SELECT b.*, CASE WHEN x.rn IS NOT NULL THEN 'EMITTED' WHEN b.rn <= 15 THEN 'WARMUP_DERIVATIVE' WHEN b.rn <= 45 THEN 'WARMUP_F4' ELSE 'F4_FIT_UNAVAILABLE' END AS status
    FROM pb b LEFT JOIN em x ON b.symbol = x.symbol AND b.rn = x.rn + 1)
  SELECT b.symbol, b.interval_start, b.status, CASE WHEN b.status <> 'EMITTED' THEN b.status END AS skip_reason, raw_color, color, cockpit_color, refined_state, CASE WHEN candidate = '' THEN 'NONE' ELSE candidate END AS turn_candidate,
  CAST(candidate_age AS BIGINT) AS candidate_age, CAST(persistence_count AS BIGINT) AS persistence_count FROM st b LEFT JOIN em x ON b.symbol = x.symbol AND b.rn = x.rn + 1""",
    "stream_gated_outcomes": host.ORACLE["reset_symbol"],
    "late_or_duplicate": f"""WITH RECURSIVE {bars_cte('b0')}, bars AS (SELECT * FROM b0 WHERE day(interval_start) >= {CUTS[0]}), {volume_cte()}, {confirm_cte()}
  SELECT v.symbol, v.interval_start, NULL::VARCHAR AS skip_reason, round(v_n, 9) AS v_n, c.color AS indicator FROM vol v LEFT JOIN conf c ON c.symbol = v.symbol AND c.rn = v.rn
  UNION ALL SELECT symbol, interval_start, 'DUPLICATE_OR_REGRESSION', NULL, NULL FROM b0 WHERE day(interval_start) < {CUTS[0]}""",
    "stream_transitions": f"""WITH {beats_cte()}, g AS (SELECT *, lag(feed_state) OVER (ORDER BY beat) AS prev_code FROM beats), c AS (SELECT *, row_number() OVER (ORDER BY beat) AS sequence FROM g WHERE prev_code IS DISTINCT FROM feed_state)
  SELECT 'P01_MARKET_FEED' AS stage_id, 'GLOBAL' AS entity_id, CAST(epoch(beat) AS BIGINT) AS position, sequence, 'P01_MARKET_FEED:GLOBAL:' || sequence AS transition_id, prev_code, feed_state AS code FROM c""",
    "tail_decisions": f"WITH RECURSIVE {bars_cte()}, {adaptive_cte()}, " + _tailed("SELECT symbol, interval_start, symbol || ':evt:' || rn AS event_id, coalesce(side, 'INITIALIZING') AS value FROM dec"),
    "tail_price": f"WITH {bars_cte()}, " + _tailed("SELECT symbol, interval_start, symbol || ':price:' || row_number() OVER w AS event_id, CASE WHEN row_number() OVER w <= 15 THEN 'WARMUP_DERIVATIVE' WHEN row_number() OVER w <= 45 THEN 'WARMUP_F4' ELSE 'EMITTED' END AS value FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY interval_start)"),
    "tail_volume": f"{_VOL}, " + _tailed("SELECT v.symbol, v.interval_start, v.symbol || ':volume:' || v.rn AS event_id, c.color AS value FROM vol v LEFT JOIN conf c ON c.symbol = v.symbol AND c.rn = v.rn"),
    "tail_volume_limited": f"""{_VOL}, e AS (SELECT v.symbol, v.interval_start, c.color AS indicator FROM vol v LEFT JOIN conf c ON c.symbol = v.symbol AND c.rn = v.rn WHERE v.symbol IN ('click', 'view')),
  k AS (SELECT *, CASE WHEN interval_start < TIMESTAMP '{CUT}' THEN 0 ELSE 1 END AS phase FROM e)
  SELECT symbol, interval_start, phase, indicator FROM k QUALIFY phase = 1 OR row_number() OVER (PARTITION BY symbol, phase ORDER BY interval_start DESC) = 1 ORDER BY phase, interval_start, symbol LIMIT 20""",
}
