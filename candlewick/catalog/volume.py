"""Registered volume queries and their checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from candlewick.catalog.helpers import pick, plain, r
from candlewick.catalog.sqltext import bars_cte, confirm_cte, volume_cte
from candlewick.functions import scalars as S
from candlewick.operators import volume as V
from candlewick.operators.ingest import latest_by
from candlewick.operators.segments import Layout
from candlewick.sources.ticks import event_bars, shipment_bars

KEY = ["symbol", "interval_start"]


def _features(*cols):
    return lambda spark, d: pick(V.volume_features(event_bars(spark, d)), *KEY, *cols)


def _events(*cols):
    return lambda spark, d: pick(V.volume_events(event_bars(spark, d)), *KEY, *cols)


def flagship(spark, d):
    """Latest activity outcome per symbol over hourly event bars."""
    events = V.volume_events(event_bars(spark, d)).select(*KEY, "rn", "v_n", "interval_mean", "raw_color", "phase", "indicator", "transition", "status")
    last = latest_by(events, ["symbol"], "interval_start")
    return plain(last.select(*KEY, "rn", r("v_n"), r("interval_mean"), "raw_color", "phase", "indicator", "transition", "status"))


def session_reset(spark, d):
    bars = event_bars(spark, d, "1 minute").withColumn("session", F.date_format("interval_start", "yyyy-MM-dd"))
    layout = Layout.of(["symbol", "session"])
    return plain(V.volume_events(bars, layout).select(*KEY, "session", "rn", "raw_color", "indicator", "transition"))


def shipments(spark, d):
    """Volume only: without lineage, no price is aggregated or hashed, and no id is carried through the layout."""
    bars = shipment_bars(spark, d).withColumns({"source_timestamp": F.lit(""), "market_snapshot_id": F.lit("")})
    return plain(V.volume_events(bars).select(*KEY, r("v_n"), r("interval_mean"), "indicator", "transition"))


def quantity_export(spark, d):
    f = V.volume_features(event_bars(spark, d))
    f = f.withColumn("q", S.quantity(F.col("v_n"), F.col("vn_status")))
    return plain(f.select(*KEY, r(F.col("q.value"), 9, "value"), F.col("q.status").alias("status")))


def volume_event(spark, d):
    e = V.volume_events(event_bars(spark, d))
    return plain(
        e.select(
            *KEY, "event_id", "accepted_sequence", "interval_end", "source_timestamp", "market_snapshot_id", "v_raw",
            r("v_n"), "vn_status", r("v1"), "v1_status", r("v2"), "v2_status", r("interval_mean"), "mean_status",
            r("predicted_next_vn"), "status", "reason", "raw_color", "indicator", "transition", "phase", "confidence", "domain_state",
        )
    )


def stretched_rank(spark, d):
    """Whether three bars still carry a parabola when the first of their gaps grows by powers of ten."""
    w = Window.partitionBy("symbol").orderBy("interval_start")
    minutes = lambda n: (F.unix_micros(F.lag("interval_start", n).over(w)) - F.unix_micros("interval_start")) / F.lit(60_000_000.0)
    b = event_bars(spark, d).select(*KEY, minutes(2).alias("tau0"), minutes(1).alias("tau1")).filter("tau0 IS NOT NULL")
    b = b.withColumn("power", F.explode(F.sequence(F.lit(0), F.lit(9)))).withColumn("tau0", F.col("tau0") * F.pow(F.lit(10.0), F.col("power")))
    return plain(b.select(*KEY, "power", V.full_rank(F.col("tau0"), F.col("tau1")).alias("full")))


QUERIES = {
    "flagship_latest_activity": flagship,
    "volume_obs": lambda spark, d: plain(V.volume_observations(event_bars(spark, d))),
    "rolling_median15": _features("median15"),
    "v_n": _features("v_n:9"),
    "interval_mean15": _features("interval_mean:9", "mean_status"),
    "v1_v2": _features("v1:9", "v2:9", "v1_status"),
    "v1_v2_rank": stretched_rank,
    "volume_point": _features("predicted_next_vn:9"),
    "volume_phase": _features("phase"),
    "volume_raw_color": _features("raw_color"),
    "volume_status": _features("status", "reason"),
    "volume_confirm": _events("raw_color", "indicator", "transition"),
    "volume_event": volume_event,
    "volume_session_reset": session_reset,
    "volume_shipments_daily": shipments,
    "quantity_export": quantity_export,
}

_BASE = f"WITH RECURSIVE {bars_cte()}, {volume_cte()}"
_STATUS = "CASE reason WHEN 'AVAILABLE' THEN 'AVAILABLE' WHEN 'MATURING_FEATURES' THEN 'MATURING' ELSE 'INVALID' END"
_ready = lambda col, first: f"CASE WHEN rn < {first} THEN 'INSUFFICIENT' WHEN {col} IS NOT NULL THEN 'AVAILABLE' ELSE 'UNDEFINED' END"


def _sql(cols: str) -> str:
    return f"{_BASE} SELECT symbol, interval_start, {cols} FROM vol"


_SESSION_BARS = f"""{bars_cte('b0', unit='minute')},
bars AS (SELECT * EXCLUDE (symbol), symbol || '/' || strftime(interval_start, '%Y-%m-%d') AS symbol FROM b0)"""
_SHIP = f"""
bars AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS symbol, date_trunc('day', l_shipdate) AS interval_start,
         CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS volume, NULL AS interval_end, NULL AS source_timestamp, NULL AS market_snapshot_id
  FROM lineitem GROUP BY ALL)"""

# The least root lies above the cutoff exactly where the polynomial is still negative and on its first rise there.
_RANK = f"""WITH {bars_cte()}, t AS (SELECT symbol, interval_start, (epoch_us(lag(interval_start, 2) OVER w) - epoch_us(interval_start)) / 6e7 AS a0, (epoch_us(lag(interval_start, 1) OVER w) - epoch_us(interval_start)) / 6e7 AS b
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY interval_start)),
p AS (SELECT symbol, interval_start, CAST(power AS INTEGER) AS power, CAST(a0 * pow(10.0, power) AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b FROM t, range(10) AS r(power) WHERE a0 IS NOT NULL),
e AS (SELECT *, 3 + a**2 + a**4 + b**2 + b**4 AS e1, (b - a)**2 * (1 + (a + b)**2 + (a * b)**2) + a**2 + a**4 + b**2 + b**4 AS e2, ((b - a) * a * b)**2 AS e3 FROM p),
n AS (SELECT *, list_reduce(list_prepend(e1, list_transform(range(80), lambda i: 0.0::DOUBLE)), lambda x, y: x - (x * x * x - e1 * x * x + e2 * x - e3) / (3 * x * x - 2 * e1 * x + e2)) AS top FROM e),
c AS (SELECT *, pow(3 * 2.220446049250313e-16, 2) * top AS x FROM n)
SELECT symbol, interval_start, power, ((x - e1) * x + e2) * x - e3 < 0 AND (3 * x - 2 * e1) * x + e2 > 0 AND x < e1 / 3 AS "full" FROM c"""

ORACLE = {
    "v1_v2_rank": _RANK,
    "flagship_latest_activity": f"""{_BASE}, {confirm_cte()}
SELECT v.symbol, v.interval_start, v.rn, round(v_n, 9) AS v_n, round(interval_mean, 9) AS interval_mean, v.raw_color, phase,
       c.color AS indicator, c.transition, {_STATUS} AS status
FROM vol v LEFT JOIN conf c ON c.symbol = v.symbol AND c.rn = v.rn
QUALIFY row_number() OVER (PARTITION BY v.symbol ORDER BY v.interval_start DESC) = 1""",
    "volume_obs": f"WITH {bars_cte()} SELECT symbol, interval_start, interval_end, source_timestamp, market_snapshot_id, CAST(volume AS DOUBLE) AS v_raw FROM bars",
    "rolling_median15": _sql("median15"),
    "v_n": _sql("round(v_n, 9) AS v_n"),
    "interval_mean15": _sql(f"round(interval_mean, 9) AS interval_mean, {_ready('interval_mean', 15)} AS mean_status"),
    "v1_v2": _sql(f"round(v1, 9) AS v1, round(v2, 9) AS v2, {_ready('v1', 3)} AS v1_status"),
    "volume_point": _sql("round(v_n, 9) AS predicted_next_vn"),
    "volume_phase": _sql("phase"),
    "volume_raw_color": _sql("raw_color"),
    "volume_status": _sql(f"{_STATUS} AS status, reason"),
    "volume_confirm": f"""{_BASE}, {confirm_cte()}
SELECT v.symbol, v.interval_start, v.raw_color, c.color AS indicator, c.transition
FROM vol v LEFT JOIN conf c ON c.symbol = v.symbol AND c.rn = v.rn""",
    "volume_event": f"""{_BASE}, {confirm_cte()}
SELECT v.symbol, v.interval_start, v.symbol || ':volume:' || v.rn AS event_id, v.rn AS accepted_sequence, interval_end, source_timestamp,
       market_snapshot_id, v_raw, round(v_n, 9) AS v_n, {_ready('v_n', 15).replace('rn <', 'v.rn <')} AS vn_status,
       round(v1, 9) AS v1, {_ready('v1', 3).replace('rn <', 'v.rn <')} AS v1_status, round(v2, 9) AS v2, {_ready('v2', 3).replace('rn <', 'v.rn <')} AS v2_status,
       round(interval_mean, 9) AS interval_mean, {_ready('interval_mean', 15).replace('rn <', 'v.rn <')} AS mean_status,
       round(v_n, 9) AS predicted_next_vn, {_STATUS} AS status, reason, v.raw_color, c.color AS indicator, c.transition, phase,
       CASE WHEN v.raw_color IS NOT NULL THEN 'HIGH' END AS confidence,
       CASE WHEN v.raw_color IS NOT NULL THEN 'CAUSAL_LOCAL_VOLUME' END AS domain_state
FROM vol v LEFT JOIN conf c ON c.symbol = v.symbol AND c.rn = v.rn""",
    "volume_session_reset": f"""WITH RECURSIVE {_SESSION_BARS}, {volume_cte()}, {confirm_cte()}
SELECT split_part(v.symbol, '/', 1) AS symbol, v.interval_start, split_part(v.symbol, '/', 2) AS session, v.rn, v.raw_color,
       c.color AS indicator, c.transition
FROM vol v LEFT JOIN conf c ON c.symbol = v.symbol AND c.rn = v.rn""",
    "volume_shipments_daily": f"""WITH RECURSIVE {_SHIP}, {volume_cte()}, {confirm_cte()}
SELECT v.symbol, v.interval_start, round(v_n, 9) AS v_n, round(interval_mean, 9) AS interval_mean, c.color AS indicator, c.transition
FROM vol v LEFT JOIN conf c ON c.symbol = v.symbol AND c.rn = v.rn""",
    "quantity_export": _sql(f"round(v_n, 9) AS value, {_ready('v_n', 15)} AS status"),
}
