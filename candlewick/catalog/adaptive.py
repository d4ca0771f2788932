"""Registered adaptive-model queries and their checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from candlewick.catalog.helpers import pick, plain, r
from candlewick.catalog.sqltext import adaptive_cte, arrivals_cte, bars_cte
from candlewick.functions import scalars as S
from candlewick.operators import adaptive as A
from candlewick.operators.segments import Layout
from candlewick.sources.arrivals import feed_arrivals
from candlewick.sources.ticks import event_bars

KEY = ["symbol", "interval_start"]


def _steps(*cols):
    return lambda spark, d: pick(A.adaptive_steps(event_bars(spark, d))[0], *KEY, *cols)


def _decisions(*cols):
    return lambda spark, d: pick(A.decisions(event_bars(spark, d)), *KEY, *cols)


def capturability(spark, d):
    steps, _ = A.adaptive_steps(event_bars(spark, d))
    return plain(steps.filter(~F.col("halo")).select(*KEY, "h", r("q_g"), r("q_s"), r("q_r"), r("c"), S.join_pipe(F.col("capture_reasons")).alias("reasons")))


def capturability_stale(spark, d):
    """The same shapes judged one minute later and with a closed market."""
    steps, _ = A.adaptive_steps(event_bars(spark, d))
    judged = A.with_capturability(steps.filter(~F.col("halo")), F.col("event_time") + 60, F.col("symbol") != "error")
    return plain(judged.select(*KEY, "h", r("c"), S.join_pipe(F.col("capture_reasons")).alias("reasons")))


def decisions_split(spark, d):
    """The same decisions computed from short segments joined by carried state."""
    bars = event_bars(spark, d, "1 minute")
    layout = Layout.of(["symbol"], rows=1100)
    return pick(A.decisions(bars, layout), *KEY, "c:7", "side", "emitter_position", "forward_half_life:6", "ref_alpha:8", "model_health")


def checks(spark, d):
    df = A.decisions(event_bars(spark, d))
    return df.groupBy("valid", "model_status").agg(F.count("*").alias("n"))


def samples(spark, d):
    cols = ("tau", "sample_level", "sample_velocity", "sample_uncertainty", "sample_strength", "sample_persistence", "sample_reversal")
    return pick(A.forward_samples(A.decisions(event_bars(spark, d))), *KEY, "sample", *[f"{c}:6" for c in cols])


def admitted(spark, d):
    """Every arrival in order, with the reason why the model refuses it: times that repeat or go back."""
    arrivals = feed_arrivals(spark, d)
    obs = A.adaptive_observations(arrivals, ["arrival"])
    return plain(A.admission(obs, "arrival").select("symbol", "interval_start", "arrival", "skip_reason"))


QUERIES = {
    "adaptive_obs": lambda s, d: plain(A.adaptive_observations(event_bars(s, d)).select(*KEY, "event_time", "price", "v_raw", "source_quality")),
    "adaptive_admit": admitted,
    "ref_scale": _steps("reference:9", "scale:9"),
    "kinematics": _steps("level:9", "velocity:9", "acceleration:9", "curvature:9"),
    "innovation": _steps("residual:9", "innovation:9"),
    "volume_influence": _steps("volume_reference:8", "volume_influence:9"),
    "perturbation": _steps("perturbation_class", "perturbation_magnitude:9", "perturbation_multiplier:9"),
    "coherence": _steps("coherence:8"),
    "strength": _steps("strength:9"),
    "persistence": _steps("persistence:9"),
    "uncertainty": _steps("uncertainty:9"),
    "reversal": _steps("reversal:9"),
    "return_shape": _steps("forward_interval:7", "terminal_displacement:6", "max_displacement:6", "path_direction"),
    "capturability": capturability,
    "capturability_stale": capturability_stale,
    "half_life": _decisions("forward_half_life:7", "observation_half_life:7", "terminal_decay:9"),
    "param_update": _decisions("ref_alpha:9"),
    "forward_samples": samples,
    "model_health": _decisions("model_health"),
    "context15": _decisions("prior_median_c:9", "prior_min_c:9", "prior_max_c:9", "prior_range_c:9", "prior_c:9", "delta_c:9", "up_count", "down_count", "flat_count", "direction_balance"),
    "decide": _decisions("side", "rule_path", "c:9"),
    "emitter_position": _decisions("side", "emitter_position"),
    "decision_warmup": _decisions("model_status", "skip_reason", "skip_detail", "accepted_sequence"),
    "adaptive_step": _decisions("event_id", "signal_id", "decision_id", "side", "c:9", "level:8", "strength:9", "coherence:8", "persistence:9", "uncertainty:9", "reversal:9", "forward_half_life:7", "ref_alpha:9", "model_health"),
    "score_checks": checks,
    "decisions_minute_segmented": decisions_split,
    "state_hash": lambda s, d: A.decisions(event_bars(s, d)).agg(F.count("*").alias("n"), F.count_if(F.col("state_hash").rlike("^[0-9A-F]{64}$")).alias("well_formed")),
}

_BASE = f"WITH RECURSIVE {bars_cte()}, {adaptive_cte()}"


def _sql(cols: str) -> str:
    return f"{_BASE} SELECT symbol, interval_start, {cols} FROM dec"


def _rounded(**named: int) -> str:
    return ", ".join(f"round({c}, {n}) AS {c}" for c, n in named.items())


_REASONS = """concat_ws('|', CASE WHEN reversal > 0.5 THEN 'REVERSAL_PROPENSITY_HIGH' END, CASE WHEN uncertainty > 0.5 THEN 'UNCERTAINTY_HIGH' END,
  CASE WHEN mx = 0 THEN 'ZERO_GEOMETRY' END) AS reasons"""
_RULE = f"CASE side WHEN 'BUY' THEN '{A.RULES['BUY']}' WHEN 'SELL' THEN '{A.RULES['SELL']}' WHEN 'HOLD' THEN '{A.RULES['HOLD']}' END AS rule_path"

ORACLE = {
    "adaptive_obs": f"WITH {bars_cte()} SELECT symbol, interval_start, epoch_us(interval_start) / 1e6 AS event_time, close AS price, CAST(volume AS DOUBLE) AS v_raw, 1.0::DOUBLE AS source_quality FROM bars",
    "adaptive_admit": f"""WITH RECURSIVE {arrivals_cte()},
queue AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY arrival) AS k FROM arrivals),
walk AS (
  SELECT symbol, 0::BIGINT AS k, NULL::TIMESTAMP AS before, NULL::TIMESTAMP AS last FROM (SELECT DISTINCT symbol FROM queue)
  UNION ALL
  SELECT q.symbol, q.k, w.last, greatest(q.interval_start, w.last) FROM walk w JOIN queue q ON q.symbol = w.symbol AND q.k = w.k + 1)
SELECT q.symbol, q.interval_start, q.arrival, CASE WHEN q.interval_start <= w.before THEN 'DUPLICATE_OR_REGRESSION' END AS skip_reason
FROM walk w JOIN queue q USING (symbol, k)""",
    "ref_scale": _sql("round(ref, 9) AS reference, round(scale, 9) AS scale"),
    "kinematics": _sql(_rounded(level=9, velocity=9, acceleration=9, curvature=9)),
    "innovation": _sql(_rounded(residual=9, innovation=9)),
    "volume_influence": _sql("round(volref, 8) AS volume_reference, round(influence, 9) AS volume_influence"),
    "perturbation": _sql("class AS perturbation_class, round(q, 9) AS perturbation_magnitude, round(mult, 9) AS perturbation_multiplier"),
    "coherence": _sql(_rounded(coherence=8)),
    "strength": _sql(_rounded(strength=9)),
    "persistence": _sql(_rounded(persistence=9)),
    "uncertainty": _sql(_rounded(uncertainty=9)),
    "reversal": _sql(_rounded(reversal=9)),
    "return_shape": _sql("round(len, 7) AS forward_interval, round(term, 6) AS terminal_displacement, round(mx, 6) AS max_displacement, path_direction"),
    "capturability": _sql(f"1 AS h, {_rounded(q_g=9, q_s=9, q_r=9, c=9)}, {_REASONS}"),
    "capturability_stale": _sql(f"""CASE WHEN len >= 60 AND symbol <> 'error' THEN 1 ELSE 0 END AS h, round(CASE WHEN len >= 60 AND symbol <> 'error' THEN c ELSE 0 END, 9) AS c,
  concat_ws('|', CASE WHEN symbol = 'error' THEN 'MARKET_INELIGIBLE' END, CASE WHEN reversal > 0.5 THEN 'REVERSAL_PROPENSITY_HIGH' END,
  CASE WHEN len < 60 THEN 'SHAPE_STALE' END, CASE WHEN uncertainty > 0.5 THEN 'UNCERTAINTY_HIGH' END, CASE WHEN mx = 0 THEN 'ZERO_GEOMETRY' END) AS reasons"""),
    "half_life": _sql("round(half, 7) AS forward_half_life, round(half, 7) AS observation_half_life, round(pow(2.0::DOUBLE, -len / half), 9) AS terminal_decay"),
    "param_update": _sql("round(alpha, 9) AS ref_alpha"),
    "forward_samples": f"""{_BASE}, pts AS (SELECT *, unnest(range(1, 9)) AS i FROM dec), p2 AS (SELECT *, len * pow(i / 8.0, 1.8) AS tau, pow(2.0::DOUBLE, -tau / half) AS decay FROM pts)
  SELECT symbol, interval_start, CAST(i AS INTEGER) AS sample, round(tau, 6) AS tau, round(level + velocity * tau + 0.5 * acceleration * tau * tau, 6) AS sample_level,
  round(velocity * decay, 6) AS sample_velocity, round(least(1, uncertainty + (1 - decay) * 0.15), 6) AS sample_uncertainty, round(strength * decay, 6) AS sample_strength,
  round(persistence * decay, 6) AS sample_persistence, round(least(1, reversal + (1 - decay) * 0.1), 6) AS sample_reversal FROM p2""",
    "model_health": _sql("model_health"),
    "context15": _sql("round(prior_median_c, 9) AS prior_median_c, round(prior_min_c, 9) AS prior_min_c, round(prior_max_c, 9) AS prior_max_c, round(prior_max_c - prior_min_c, 9) AS prior_range_c, "
                      "round(prior_c, 9) AS prior_c, round(c - prior_c, 9) AS delta_c, up_count, down_count, flat_count, up_count - down_count AS direction_balance"),
    "decide": _sql(f"side, {_RULE}, round(c, 9) AS c"),
    "emitter_position": _sql("side, emitter_position"),
    "decision_warmup": _sql("CASE WHEN side IS NULL THEN 'INITIALIZING' ELSE 'ACTIONABLE' END AS model_status, CASE WHEN side IS NULL THEN 'INITIALIZING' END AS skip_reason, "
                            "CASE WHEN side IS NULL THEN rn || '/16' END AS skip_detail, rn - 1 AS accepted_sequence"),
    "adaptive_step": _sql("symbol || ':evt:' || rn AS event_id, symbol || ':sig:' || rn AS signal_id, CASE WHEN side IS NOT NULL THEN symbol || ':dec:' || rn END AS decision_id, side, "
                          + _rounded(c=9, level=8, strength=9, coherence=8, persistence=9, uncertainty=9, reversal=9)
                          + ", round(half, 7) AS forward_half_life, round(alpha, 9) AS ref_alpha, model_health"),
    "score_checks": f"{_BASE} SELECT true AS valid, CASE WHEN side IS NULL THEN 'INITIALIZING' ELSE 'ACTIONABLE' END AS model_status, count(*) AS n FROM dec GROUP BY ALL",
    "decisions_minute_segmented": f"""WITH RECURSIVE {bars_cte('bars', unit='minute')}, {adaptive_cte()}
  SELECT symbol, interval_start, round(c, 7) AS c, side, emitter_position, round(half, 6) AS forward_half_life, round(alpha, 8) AS ref_alpha, model_health FROM dec""",
    "state_hash": f"WITH {bars_cte()} SELECT count(*) AS n, count(*) AS well_formed FROM bars",
}
