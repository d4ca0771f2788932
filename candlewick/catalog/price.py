"""Registered price queries and their checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from candlewick.catalog.helpers import pick, plain, r
from candlewick.catalog.sqltext import bars_cte, policy_cte, price_cte
from candlewick.functions import scalars as S
from candlewick.operators import price as P
from candlewick.operators.segments import Layout
from candlewick.sources.ticks import event_bars

KEY = ["symbol", "interval_start"]


def _numbers(*cols, emitted=True):
    def run(spark, d):
        df, _ = P.price_numbers(event_bars(spark, d))
        return pick(df.filter("emitted") if emitted else df, *KEY, *cols)

    return run


def _emissions(*cols):
    return lambda spark, d: pick(P.emissions(event_bars(spark, d)), *KEY, *cols)


def reasons(spark, d):
    e = P.emissions(event_bars(spark, d))
    return plain(e.select(*KEY, S.join_pipe(F.col("reason_codes")).alias("reasons"), S.join_pipe(F.col("cockpit_reasons")).alias("cockpit_reasons")))


def event_rows(spark, d):
    e = P.price_events(event_bars(spark, d))
    return plain(
        e.select(
            *KEY, "trigger_interval_start", "source_timestamp", "market_snapshot_id", "status", "emitted", "accepted_sequence",
            "skip_reason", "domain_exit", "event_id", r("emission.projected_p", 7, "projected_p"), F.col("emission.color").alias("color"),
            F.col("cockpit.cockpit_color").alias("cockpit_color"), F.col("cockpit.refined_state").alias("refined_state"),
        )
    )


def minute_segments(spark, d):
    bars = event_bars(spark, d, "1 minute")
    e = P.emissions(bars, Layout.of(["symbol"], rows=128))
    return pick(e, *KEY, "p1:6", "projected_p:5", "raw_color", "color", "cockpit_color", "persistence_count", "candidate_age", "refined_state")


_PROJECTED = ("projected_p:7", "projected_p1:8", "projected_p2:9")
QUERIES = {
    "price_minutes": lambda s, d: plain(P.price_observations(event_bars(s, d)).select(*KEY, "minutes")),
    "p1_p2": _numbers("p1:9", "p2:11", emitted=False),
    "jp": _numbers("jp:11"),
    "f4_fit": _numbers("fit_1:9", "fit_2:8", "fit_3:7", "condition_number:7"),
    "affine_projection": _numbers(*_PROJECTED),
    "cover_check": _numbers("local_distance:6", "first_exit_time:3", "exit_dimension", "domain_exit"),
    "stability_numbers": _numbers("max_real_eigenvalue:6", "perturbation_amplification:7"),
    "price_status": _numbers("status", "accepted_sequence", emitted=False),
    "price_phase": _emissions("trajectory_phase"),
    "turning_tendency": _emissions("turning_tendency"),
    "price_confidence": _emissions("confidence_state", "domain_state", "stability_state"),
    "price_raw_color": _emissions("raw_color"),
    "price_debounce": _emissions("raw_color", "color", "debounced"),
    "price_emission": _emissions("p:6", "p1:9", *_PROJECTED, "delta_projected_p:7", "delta_projected_p1:8", "delta_projected_p2:9", "current_direction",
                                 "current_acceleration", "projected_direction", "projected_acceleration", "trajectory_phase", "color"),
    "price_reasons": reasons,
    "cockpit_motion": _emissions("motion"),
    "cockpit": _emissions("refined_state", "p1_zero_proximity:7", "deceleration_strength:6", "persistence_state", "persistence_count", "turn_candidate",
                          "candidate_age", "raw_direction", "cockpit_color", "direct_change"),
    "price_event": event_rows,
    "emissions_minute_segmented": minute_segments,
}

_BASE = f"WITH RECURSIVE {bars_cte()}, {price_cte()}"
# Results are reported on the bar after the evaluated one.
_TRIGGER = "pb b ON b.symbol = x.symbol AND b.rn = x.rn + 1"


def _round(*specs: str) -> str:
    out = []
    for spec in specs:
        name, _, digits = spec.partition(":")
        out.append(f"round({name}, {digits}) AS {name}" if digits else name)
    return ", ".join(out)


def _px(*specs: str) -> str:
    return f"{_BASE} SELECT x.symbol, b.interval_start, {_round(*specs)} FROM px x JOIN {_TRIGGER}"


def _em(cols: str, base: str | None = None) -> str:
    return f"{base or _BASE}, {policy_cte()} SELECT x.symbol, b.interval_start, {cols} FROM em x JOIN {_TRIGGER}"


_LOW = "confidence_state = 'LOW'"
_STATUS = "CASE WHEN b.rn <= 15 THEN 'WARMUP_DERIVATIVE' WHEN b.rn <= 45 THEN 'WARMUP_F4' ELSE 'EMITTED' END"
_SIGNS = """CASE WHEN p1 > 0.0035332071428566536 THEN 'UP' WHEN p1 < -0.0035332071428566536 THEN 'DOWN' ELSE 'NEAR_ZERO' END AS current_direction,
  CASE WHEN p2 > 0 THEN 'POSITIVE' WHEN p2 < 0 THEN 'NEGATIVE' ELSE 'ZERO' END AS current_acceleration,
  CASE WHEN projected_p1 > 0.0035332071428566536 THEN 'UP' WHEN projected_p1 < -0.0035332071428566536 THEN 'DOWN' ELSE 'NEAR_ZERO' END AS projected_direction,
  CASE WHEN projected_p2 > 0 THEN 'POSITIVE' WHEN projected_p2 < 0 THEN 'NEGATIVE' ELSE 'ZERO' END AS projected_acceleration"""

ORACLE = {
    "price_minutes": f"WITH {bars_cte()} SELECT symbol, interval_start, epoch_ms(interval_start) / 60000.0::DOUBLE AS minutes FROM bars",
    "p1_p2": f"{_BASE} SELECT b.symbol, b.interval_start, round(p1, 9) AS p1, round(p2, 11) AS p2 FROM pb b LEFT JOIN pder x ON x.symbol = b.symbol AND x.rn = b.rn - 1",
    "jp": _px("jp:11"),
    "f4_fit": f"{_BASE} SELECT x.symbol, b.interval_start, round(k1, 9) AS fit_1, round(k2, 8) AS fit_2, round(k3, 7) AS fit_3, round(condition_number, 7) AS condition_number FROM pfit x JOIN {_TRIGGER}",
    "affine_projection": _px(*_PROJECTED),
    "cover_check": _px("local_distance:6", "first_exit_time:3", "exit_dimension", "domain_exit"),
    "stability_numbers": _px("max_real_eigenvalue:6", "perturbation_amplification:7"),
    "price_status": f"{_BASE} SELECT b.symbol, b.interval_start, {_STATUS} AS status, greatest(b.rn - 1, 1) AS accepted_sequence FROM pb b",
    "price_phase": _em("trajectory_phase"),
    "turning_tendency": _em("turning_tendency"),
    "price_confidence": _em("confidence_state, domain_state, stability_state"),
    "price_raw_color": _em("raw_color"),
    "price_debounce": _em("raw_color, color, held AS debounced"),
    "price_emission": _em(_round("p:6", "p1:9", *_PROJECTED) + ", round(projected_p - p, 7) AS delta_projected_p, round(projected_p1 - p1, 8) AS delta_projected_p1, "
                          f"round(projected_p2 - p2, 9) AS delta_projected_p2, {_SIGNS}, trajectory_phase, color"),
    "price_reasons": _em(f"""concat_ws('|', trajectory_phase, CASE WHEN turning_tendency NOT IN ('NONE', trajectory_phase) THEN turning_tendency END, CASE WHEN domain_exit THEN 'DOMAIN_EXIT' END,
  CASE WHEN {_LOW} THEN 'LOW_CONFIDENCE' END, CASE WHEN max_real_eigenvalue > 0 THEN 'POSITIVE_MAX_REAL_EIGENVALUE' END, CASE WHEN held THEN 'DIRECT_REVERSAL_DEBOUNCE' END) AS reasons,
  concat_ws('|', motion, CASE WHEN crossing <> '' THEN 'PROJECTED_P1_' || crossing || '_CROSS' WHEN candidate <> '' THEN 'PERSISTENT_DECELERATION|PROJECTED_P1_ZERO_APPROACH' END,
  CASE WHEN direct_change THEN 'CURRENT_P1_DIRECTION_CROSS' END, CASE WHEN raw_direction = 'NEAR_ZERO' AND motion <> 'NEAR_STATIONARY' THEN 'NEAR_STATIONARY' END) AS cockpit_reasons"""),
    "cockpit_motion": _em("motion"),
    "cockpit": _em("refined_state, round(p1_zero_proximity, 7) AS p1_zero_proximity, round(deceleration_strength, 6) AS deceleration_strength, "
                   "CASE WHEN opposing = '' THEN 'NONE' ELSE opposing || '_DECELERATION' END AS persistence_state, persistence_count, "
                   "CASE WHEN candidate = '' THEN 'NONE' ELSE candidate END AS turn_candidate, candidate_age, raw_direction, cockpit_color, direct_change"),
    "price_event": f"""{_BASE}, {policy_cte()} SELECT b.symbol, CASE WHEN b.rn > 45 THEN a.interval_start ELSE b.interval_start END AS interval_start, b.interval_start AS trigger_interval_start,
  strftime(CASE WHEN b.rn > 45 THEN a.interval_start ELSE b.interval_start END, '%Y-%m-%dT%H:%M:%SZ') AS source_timestamp, s.market_snapshot_id, {_STATUS} AS status, b.rn > 45 AS emitted,
  greatest(b.rn - 1, 1) AS accepted_sequence, nullif({_STATUS}, 'EMITTED') AS skip_reason, coalesce(domain_exit, false) AS domain_exit, b.symbol || ':price:' || b.rn AS event_id,
  round(projected_p, 7) AS projected_p, color, cockpit_color, refined_state
  FROM pb b JOIN bars s ON s.symbol = b.symbol AND s.interval_start = b.interval_start
  LEFT JOIN pb a ON a.symbol = b.symbol AND a.rn = b.rn - 1 LEFT JOIN em x ON x.symbol = b.symbol AND x.rn = b.rn - 1""",
    "emissions_minute_segmented": _em(_round("p1:6", "projected_p:5") + ", raw_color, color, cockpit_color, persistence_count, candidate_age, refined_state",
                                      f"WITH RECURSIVE {bars_cte('bars', unit='minute')}, {price_cte()}"),
}
