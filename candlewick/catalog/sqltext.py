"""Shared pieces of the DuckDB statements that check the Spark queries."""

from __future__ import annotations

SHA = "sha256(printf('%s|%s|%s|%.8f|%.8f|%.8f|%.8f|%d', symbol, source, source_timestamp, open, high, low, close, volume))"
RFC = "strftime(interval_start, '%Y-%m-%dT%H:%M:%SZ')"


def bars_cte(name: str = "bars", symbol: str = "event_type", unit: str = "hour", price: str = "value", where: str = "") -> str:
    """``name`` = OHLCV bars over ``events`` with lineage columns."""
    return f"""
{name}_ohlc AS (
  SELECT CAST({symbol} AS VARCHAR) AS symbol, date_trunc('{unit}', ts) AS interval_start,
         arg_min({price}, ts) AS open, max({price}) AS high, min({price}) AS low, arg_max({price}, ts) AS close,
         CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS volume, count(*) AS event_count
  FROM events {where} GROUP BY ALL),
{name}_src AS (
  SELECT *, interval_start + INTERVAL 1 {unit} AS interval_end, {RFC} AS source_timestamp, 'CSV' AS source FROM {name}_ohlc),
{name} AS (SELECT *, {SHA} AS market_snapshot_id FROM {name}_src)"""


def arrivals_cte() -> str:
    """``arrivals`` = the feed with revisions (see sources/arrivals.py)."""
    return f"""{bars_cte('p0', where="WHERE ts < date_trunc('hour', ts) + INTERVAL 30 MINUTE")},
{bars_cte('c0')},
{bars_cte('r0', price='ceil(value + 1)')},
arrivals AS (
  SELECT *, 'PARTIAL' AS quality_status, false AS is_final, false AS is_backfilled,
         CAST((epoch(interval_start) + 1800) * 10 + 1 AS BIGINT) AS arrival FROM p0
  UNION ALL
  SELECT *, 'COMPLETE', true, false, CAST((epoch(interval_start) + 3600) * 10 + 2 AS BIGINT) FROM c0 WHERE event_count >= 2
  UNION ALL
  SELECT *, 'RECONSTRUCTED', true, true,
         CAST((epoch(interval_start) + 1800 * event_count + 900) * 10 + 3 AS BIGINT) FROM r0)"""


def resolved_cte() -> str:
    return f"""{arrivals_cte()},
ranked AS (
  SELECT *, CASE WHEN is_final AND quality_status = 'COMPLETE' AND NOT is_backfilled THEN 2 WHEN is_final THEN 1 ELSE 0 END AS rk
  FROM arrivals),
store AS (
  SELECT * EXCLUDE (rk, pick) FROM (
    SELECT *, row_number() OVER (PARTITION BY symbol, interval_start ORDER BY rk DESC, arrival DESC) AS pick FROM ranked)
  WHERE pick = 1)"""


def volume_cte(bars: str = "bars") -> str:
    """``vol`` = volume features and colours over a bars relation."""
    return f"""
vol0 AS (SELECT symbol, interval_start, interval_end, source_timestamp, market_snapshot_id, CAST(volume AS DOUBLE) AS v_raw,
         row_number() OVER (PARTITION BY symbol ORDER BY interval_start) AS rn FROM {bars}),
vol1 AS (SELECT *, CASE WHEN rn >= 15 THEN quantile_disc(v_raw, 0.5) OVER (PARTITION BY symbol ORDER BY interval_start ROWS BETWEEN 14 PRECEDING AND CURRENT ROW) END AS median15 FROM vol0),
vol2 AS (SELECT *, CASE WHEN median15 > 0 THEN v_raw / median15 END AS v_n FROM vol1),
vol3 AS (SELECT *, count(v_n) OVER w15 AS mean_rows, avg(v_n) OVER w15 AS mean0,
         lag(v_n) OVER w AS y1, lag(v_n, 2) OVER w AS y0,
         epoch_us(lag(interval_start) OVER w) / 6e7 - epoch_us(interval_start) / 6e7 AS x1,
         epoch_us(lag(interval_start, 2) OVER w) / 6e7 - epoch_us(interval_start) / 6e7 AS x0
  FROM vol2 WINDOW w AS (PARTITION BY symbol ORDER BY interval_start),
                   w15 AS (PARTITION BY symbol ORDER BY interval_start ROWS BETWEEN 14 PRECEDING AND CURRENT ROW)),
vol4 AS (SELECT *, CASE WHEN mean_rows = 15 THEN mean0 END AS interval_mean,
         -- Lagrange form of the parabola through three points, derivatives at zero
         CASE WHEN y0 IS NOT NULL AND y1 IS NOT NULL AND v_n IS NOT NULL THEN
           y0 * (-x1) / (x0 * (x0 - x1)) + y1 * (-x0) / (x1 * (x1 - x0)) + v_n * (-(x0 + x1)) / (x0 * x1) END AS v1,
         CASE WHEN y0 IS NOT NULL AND y1 IS NOT NULL AND v_n IS NOT NULL THEN
           2 * (y0 / (x0 * (x0 - x1)) + y1 / (x1 * (x1 - x0)) + v_n / (x0 * x1)) END AS v2
  FROM vol3),
vol AS (SELECT *,
         CASE WHEN interval_mean IS NULL THEN NULL WHEN interval_mean >= 1.1 THEN 'GREEN' WHEN interval_mean <= 0.9 THEN 'RED' ELSE 'AMBER' END AS raw_color,
         CASE WHEN v1 IS NULL THEN NULL WHEN abs(v1) <= 1e-12 THEN 'ACTIVITY_STATIONARY'
              WHEN v1 > 0 AND v2 > 1e-12 THEN 'ACTIVITY_INCREASING_ACCELERATING' WHEN v1 > 0 THEN 'ACTIVITY_INCREASING_DECELERATING'
              WHEN v2 < -1e-12 THEN 'ACTIVITY_DECREASING_ACCELERATING' ELSE 'ACTIVITY_DECREASING_DECELERATING' END AS phase,
         CASE WHEN v_n IS NOT NULL AND v1 IS NOT NULL AND interval_mean IS NOT NULL THEN 'AVAILABLE'
              WHEN rn >= 15 AND v_n IS NULL THEN 'UNDEFINED_VN' ELSE 'MATURING_FEATURES' END AS reason
  FROM vol4)"""


def confirm_cte() -> str:
    """``conf`` = colour confirmation replayed row by row (needs RECURSIVE)."""
    return """
valid AS (SELECT symbol, rn, raw_color, row_number() OVER (PARTITION BY symbol ORDER BY rn) AS k FROM vol WHERE raw_color IS NOT NULL),
conf AS (
  SELECT symbol, rn, k, raw_color AS color, '' AS pending, 'STABLE' AS transition FROM valid WHERE k = 1
  UNION ALL
  SELECT v.symbol, v.rn, v.k,
         CASE WHEN v.raw_color = c.color OR v.raw_color = c.pending THEN v.raw_color ELSE 'AMBER' END,
         CASE WHEN v.raw_color = c.color OR v.raw_color = c.pending THEN '' ELSE v.raw_color END,
         CASE WHEN v.raw_color = c.color THEN 'STABLE' WHEN v.raw_color = c.pending THEN 'CONFIRMED_' || v.raw_color
              ELSE 'PENDING_' || v.raw_color END
  FROM conf c JOIN valid v ON v.symbol = c.symbol AND v.k = c.k + 1)"""


def adaptive_cte(bars: str = "bars") -> str:
    """``dec`` = the adaptive model replayed row by row (needs RECURSIVE)."""
    sign = lambda x: f"CASE WHEN {x} > 1e-15 THEN 1 WHEN {x} < -1e-15 THEN -1 ELSE 0 END"
    clip = lambda x, lo, hi: f"least(greatest({x}, {lo}), {hi})"
    columns = (
        "symbol rn interval_start market_snapshot_id event_time ref scale volref level velocity acceleration curvature residual innovation influence "
        "q mult class coherence strength persistence uncertainty reversal half alpha gap clipped hit"
    ).split()
    step = f"""
  SELECT symbol, o_rn AS rn, o_start AS interval_start, o_snap AS market_snapshot_id, o_time AS event_time,
    CASE WHEN o_rn = 1 THEN price ELSE p_ref + 0.05 * (price - p_ref) END AS ref,
    CASE WHEN o_rn = 1 THEN 1.0 ELSE greatest(1e-4, 0.95 * p_scale + 0.05 * abs(price - ref)) END AS scale,
    0.95 * p_volref + 0.05 * vol AS volref,
    (price - ref) / greatest(scale, 1e-8) AS level,
    CASE WHEN o_rn = 1 THEN 1.0 ELSE greatest(0, o_time - p_time) END AS dt,
    (level - p_level) / (greatest(1e-6, dt) + 1e-8) AS v_free, {clip('v_free', -50, 50)} AS velocity,
    (velocity - p_velocity) / (greatest(1e-6, dt) + 1e-8) AS a_free, {clip('a_free', -200, 200)} AS acceleration,
    acceleration / pow(1 + velocity * velocity, 1.5) AS k_free, {clip('k_free', -200, 200)} AS curvature,
    level - (p_level + p_velocity * dt) AS residual,
    sqrt(residual * residual / greatest(dt + 1e-8, 1e-8)) AS innovation,
    {clip('ln(1 + vol / greatest(volref, 1e-8)) + ln(1 + greatest(vol, 0)) / 10', 0, 3)} AS influence,
    {clip('innovation / (1 + innovation)', 0, 1)} AS q, {clip('1 + q * 0.5', 0.8, 1.5)} AS mult,
    {sign('p_level')} AS s1, CASE WHEN s1 <> 0 THEN s1 ELSE {sign('p_velocity')} END AS sd,
    {sign('residual')} AS e1, CASE WHEN e1 <> 0 THEN e1 ELSE {sign('(velocity - p_velocity)')} END AS ed,
    CASE WHEN q <= sqrt(1e-8) THEN 'NONE' WHEN sd = 0 OR ed = 0 THEN 'STRUCTURAL/UNKNOWN' WHEN ed = sd THEN 'REINFORCING'
         WHEN ({sign('velocity')}) = -sd THEN 'REVERSING' ELSE 'CONTRADICTING' END AS class,
    class NOT IN ('NONE', 'REINFORCING') AS adverse,
    abs(level) + abs(velocity) + 0.8 * abs(acceleration) + 0.7 * influence AS den,
    CASE WHEN den <= 1e-8 THEN 0 ELSE {clip('abs(level + velocity + 0.8 * acceleration + 0.7 * influence) / (den + 1e-8)', 0, 1)} END AS coherence,
    1 / (1 + exp(-(-0.25 + 0.8 * influence + 0.35 * abs(velocity) + 0.2 * abs(acceleration) + coherence - 1.1 * p_uncertainty))) AS strength,
    {clip("(CASE WHEN velocity * p_velocity >= 0 THEN 1 ELSE 0 END) - 0.25 * least(1, abs(acceleration) / (1 + abs(acceleration))) - (CASE WHEN adverse THEN 0.4 ELSE 0 END)", 0, 1)} AS agreement,
    0.8 * p_persistence + 0.2 * agreement AS persistence,
    1 / (1 + exp(-(innovation + 0.8 * (1 - coherence) + CASE WHEN class = 'STRUCTURAL/UNKNOWN' THEN 0.8 ELSE 0 END + 0.5 * least(1, abs(residual)) - 1))) AS uncertainty,
    1 / (1 + exp(-(CASE WHEN velocity * acceleration < 0 THEN 1 ELSE 0 END + CASE WHEN adverse THEN 0.8 ELSE 0 END + 0.7 * (1 - persistence)
         + 0.8 * least(1, abs(level) / 4) + 0.6 * uncertainty - 1.2))) AS reversal,
    {clip("p_half * " + clip('1 + persistence * strength * 0.2', 1, 1.35) + " * " + clip('1 - 0.35 * uncertainty', 0.5, 1) + " * CASE WHEN adverse THEN 0.75 ELSE 1 END", 15, 900)} AS half,
    p_alpha + {clip('0.005 * greatest(0.2, 1 - uncertainty) * greatest(0.5, strength) * mult', 1e-4, 0.05)} * (strength - uncertainty) * 0.1 AS a_prop,
    {clip('a_prop', 0.001, 0.2)} AS alpha,
    p_gap OR (o_rn > 1 AND dt > 5) AS gap, p_clipped OR v_free <> velocity OR a_free <> acceleration OR k_free <> curvature AS clipped,
    p_hit OR alpha <> a_prop AS hit"""
    prior = ", ".join(f"{c} AS p_{c}" for c in columns if c not in ("symbol", "interval_start", "market_snapshot_id", "event_time"))
    keep = ", ".join(columns)
    return f"""
obs AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY interval_start) AS o_rn, interval_start AS o_start, market_snapshot_id AS o_snap,
        epoch_us(interval_start) / 1e6 AS o_time, close AS price, CAST(volume AS DOUBLE) AS vol FROM {bars}),
adp AS (
  SELECT {keep} FROM ({step}
    FROM (SELECT *, NULL::DOUBLE AS p_time, 0::DOUBLE AS p_ref, 1::DOUBLE AS p_scale, 1::DOUBLE AS p_volref, 0::DOUBLE AS p_level, 0::DOUBLE AS p_velocity,
                 0.15::DOUBLE AS p_uncertainty, 0::DOUBLE AS p_persistence, 120::DOUBLE AS p_half, 0.05::DOUBLE AS p_alpha,
                 false AS p_gap, false AS p_clipped, false AS p_hit FROM obs WHERE o_rn = 1) f)
  UNION ALL
  SELECT {keep} FROM ({step}
    FROM (SELECT symbol, event_time AS p_time, {prior} FROM adp) a JOIN obs o USING (symbol) WHERE o.o_rn = a.p_rn + 1) g),
shape AS (SELECT *,
    {clip('60 * (0.7 + 0.6 * persistence) * (0.7 + 0.6 * strength) * (1.1 - 0.8 * uncertainty) * (1 - 0.35 * q)', 10, 600)} AS len,
    list_transform(range(1, 9), lambda i: level + velocity * (len * pow(i / 8.0, 1.8)) + 0.5 * acceleration * pow(len * pow(i / 8.0, 1.8), 2) - level) AS moves,
    moves[8] AS term, list_max(list_transform(moves, lambda m: abs(m))) AS mx,
    CASE WHEN term > 0 THEN 'UPWARD' WHEN term < 0 THEN 'DOWNWARD' ELSE 'FLAT' END AS path_direction,
    CASE WHEN mx = 0 THEN 0 ELSE abs(term) / mx END AS q_g, pow(strength * coherence * persistence, 1 / 3.0::DOUBLE) AS q_s,
    sqrt((1 - uncertainty) * (1 - reversal)) AS q_r, q_g * q_s * q_r AS c FROM adp),
ctx AS (SELECT *, CASE WHEN rn > 15 THEN quantile_disc(c, 0.5) OVER w END AS prior_median_c, lag(c) OVER (PARTITION BY symbol ORDER BY rn) AS prior_c,
    CASE WHEN rn > 15 THEN min(c) OVER w END AS prior_min_c, CASE WHEN rn > 15 THEN max(c) OVER w END AS prior_max_c,
    count(*) FILTER (path_direction = 'UPWARD') OVER w AS up_count, count(*) FILTER (path_direction = 'DOWNWARD') OVER w AS down_count,
    count(*) FILTER (path_direction = 'FLAT') OVER w AS flat_count FROM shape
    WINDOW w AS (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING)),
dec0 AS (SELECT *, CASE WHEN rn <= 15 THEN NULL WHEN path_direction = 'UPWARD' AND c >= prior_median_c AND up_count >= down_count THEN 'BUY'
    WHEN path_direction = 'DOWNWARD' AND c >= prior_median_c AND down_count >= up_count THEN 'SELL' ELSE 'HOLD' END AS side FROM ctx),
dec AS (SELECT *, CASE WHEN side IS NULL THEN NULL ELSE coalesce(last_value(CASE side WHEN 'BUY' THEN 'LONG' WHEN 'SELL' THEN 'SHORT' END IGNORE NULLS)
    OVER (PARTITION BY symbol ORDER BY rn), 'FLAT') END AS emitter_position,
    CASE WHEN gap THEN 'DEGRADED_DATA' WHEN clipped OR hit THEN 'DEGRADED_NUMERICAL' WHEN q > 0.7 THEN 'PERTURBED' ELSE 'HEALTHY' END AS model_health FROM dec0)"""


def price_cte(bars: str = "bars", terms: int = 36) -> str:
    """``px`` = price numbers per evaluated bar, by normal equations, Cramer's rule,
    power series and the closed cubic formula (needs RECURSIVE)."""
    det = "({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"

    def d3(*m: str) -> str:
        return det.format(**dict(zip("abcdefghi", m)))

    den = d3("n", "s1", "s2", "s1", "s2", "s3", "s2", "s3", "s4")
    num_b = d3("n", "t0", "s2", "s1", "t1", "s3", "s2", "t2", "s4")
    num_a = d3("n", "s1", "t0", "s1", "s2", "t1", "s2", "s3", "t2")
    ridge = ("31", "30 * c12", "30 * c13", "30 * c12", "31", "30 * c23", "30 * c13", "30 * c23", "31")

    def solve(k: int) -> str:
        m = list(ridge)
        for row in range(3):
            m[row * 3 + k] = f"j{row + 1}"
        return f"{d3(*m)} / {d3(*ridge)}"

    value = lambda t: f"list_sum(list_transform(a, lambda x, i: x * pow({t}, i - 1)))"
    slope = lambda t: f"list_sum(list_transform(a[2:], lambda x, i: x * i * pow({t}, i - 1)))"
    bend = lambda t: f"list_sum(list_transform(a[3:], lambda x, i: x * (i + 1) * i * pow({t}, i - 1)))"
    return f"""
pb AS (SELECT symbol, interval_start, epoch_ms(interval_start) / 60000.0::DOUBLE AS m, close AS y,
       row_number() OVER (PARTITION BY symbol ORDER BY interval_start) AS rn FROM {bars}),
pspan AS (SELECT *, m - lag(m, 14) OVER (PARTITION BY symbol ORDER BY rn) AS span FROM pb),
psum AS (SELECT a.symbol, a.rn, any_value(a.y) AS y, any_value(a.span) AS span, 15.0::DOUBLE AS n, sum(u) AS s1, sum(u * u) AS s2, sum(u * u * u) AS s3, sum(u * u * u * u) AS s4,
    sum(w) AS t0, sum(w * u) AS t1, sum(w * u * u) AS t2
  FROM (SELECT a.symbol, a.rn, a.y, a.span, (b.m - a.m) / a.span AS u, b.y - a.y AS w FROM pspan a JOIN pspan b
        ON a.symbol = b.symbol AND b.rn BETWEEN a.rn - 14 AND a.rn WHERE a.rn >= 15) a GROUP BY a.symbol, a.rn),
pder AS (SELECT symbol, rn, y AS p, {num_b} / {den} / span AS p1, 2 * {num_a} / {den} / span / span AS p2 FROM psum),
pjp AS (SELECT *, p2 - lag(p2) OVER (PARTITION BY symbol ORDER BY rn) AS jp FROM pder),
pfrm AS (SELECT a.symbol, a.rn, any_value(a.p) AS p, any_value(a.p1) AS p1, any_value(a.p2) AS p2, any_value(a.jp) AS jp,
    avg(b.p) AS m1, avg(b.p1) AS m2, avg(b.p2) AS m3, avg(b.jp) AS mj,
    stddev_pop(b.p) AS d1, stddev_pop(b.p1) AS d2, stddev_pop(b.p2) AS d3, min(b.p) AS l1, max(b.p) AS h1, min(b.p1) AS l2, max(b.p1) AS h2, min(b.p2) AS l3, max(b.p2) AS h3,
    covar_pop(b.p, b.p1) / d1 / d2 AS c12, covar_pop(b.p, b.p2) / d1 / d3 AS c13, covar_pop(b.p1, b.p2) / d2 / d3 AS c23,
    30 * covar_pop(b.p, b.jp) / d1 AS j1, 30 * covar_pop(b.p1, b.jp) / d2 AS j2, 30 * covar_pop(b.p2, b.jp) / d3 AS j3
  FROM pjp a JOIN pjp b ON a.symbol = b.symbol AND b.rn BETWEEN a.rn - 29 AND a.rn WHERE a.rn >= 45 GROUP BY a.symbol, a.rn),
pfit AS (SELECT *, {solve(0)} / d1 AS k1, {solve(1)} / d2 AS k2, {solve(2)} / d3 AS k3, mj - k1 * m1 - k2 * m2 - k3 * m3 AS k0,
    sqrt((c12 * c12 + c13 * c13 + c23 * c23) / 3) AS pp, acos(least(1, greatest(-1, c12 * c13 * c23 / (pp * pp * pp)))) / 3 AS phi,
    sqrt(greatest(1 + 2 * pp * cos(phi), 1) / least(1 + 2 * pp * cos(phi + 2 * pi() / 3), 1)) AS condition_number,
    -k2 - k3 * k3 / 3 AS e_p, -2 * k3 * k3 * k3 / 27 - k2 * k3 / 3 - k1 AS e_q, e_q * e_q / 4 + e_p * e_p * e_p / 27 AS e_d,
    CASE WHEN e_d > 0 THEN cbrt(-e_q / 2 + sqrt(e_d)) + cbrt(-e_q / 2 - sqrt(e_d)) END AS e_z,
    CASE WHEN e_d > 0 THEN greatest(e_z, -e_z / 2) + k3 / 3
         ELSE 2 * sqrt(-e_p / 3) * cos(acos(least(1, greatest(-1, 3 * e_q / (2 * e_p) * sqrt(-3 / e_p)))) / 3) + k3 / 3 END AS max_real_eigenvalue
  FROM pfrm),
pser AS (
  SELECT symbol, rn, v, 0 AS k, k1, k2, k3, CASE WHEN v = 0 THEN k0 ELSE 0 END AS kc,
         CASE v WHEN 0 THEN [p, p1, p2 / 2] WHEN 1 THEN [1.0::DOUBLE, 0, 0] WHEN 2 THEN [0.0::DOUBLE, 1, 0] ELSE [0.0::DOUBLE, 0, 0.5] END AS a
  FROM pfit, (SELECT unnest(range(0, 4)) AS v)
  UNION ALL
  SELECT symbol, rn, v, k + 1, k1, k2, k3, kc,
         list_append(a, ((CASE WHEN k = 0 THEN kc ELSE 0 END) + k1 * a[k + 1] + k2 * (k + 1) * a[k + 2] + k3 * (k + 2) * (k + 1) * a[k + 3]) / ((k + 3) * (k + 2) * (k + 1)))
  FROM pser WHERE k < {terms}),
pend AS (SELECT *, {value('1.0')} AS y0, {slope('1.0')} AS y1, {bend('1.0')} AS y2 FROM pser WHERE k = {terms}),
pamp AS (SELECT symbol, rn, max(sqrt(y0 * y0 + y1 * y1 + y2 * y2)) AS perturbation_amplification FROM pend WHERE v > 0 GROUP BY ALL),
pgrid AS (SELECT symbol, rn, g, {value('(g / 10.0)')} AS z0, {slope('(g / 10.0)')} AS z1, {bend('(g / 10.0)')} AS z2 FROM pend, (SELECT unnest(range(0, 11)) AS g) WHERE v = 0),
pexit AS (SELECT t.symbol, t.rn, max(sqrt(pow((z0 - m1) / d1, 2) + pow((z1 - m2) / d2, 2) + pow((z2 - m3) / d3, 2))) AS local_distance,
    min(g) FILTER (z0 < l1 - 1e-12 OR z0 > h1 + 1e-12 OR z1 < l2 - 1e-13 OR z1 > h2 + 1e-13 OR z2 < l3 - 1e-15 OR z2 > h3 + 1e-15) AS first_g,
    arg_min(concat_ws('|', CASE WHEN z0 < l1 - 1e-12 OR z0 > h1 + 1e-12 THEN 'P' END, CASE WHEN z1 < l2 - 1e-13 OR z1 > h2 + 1e-13 THEN 'P1' END,
      CASE WHEN z2 < l3 - 1e-15 OR z2 > h3 + 1e-15 THEN 'P2' END), g)
      FILTER (z0 < l1 - 1e-12 OR z0 > h1 + 1e-12 OR z1 < l2 - 1e-13 OR z1 > h2 + 1e-13 OR z2 < l3 - 1e-15 OR z2 > h3 + 1e-15) AS exit_dimension
  FROM pgrid t JOIN pfit f ON f.symbol = t.symbol AND f.rn = t.rn GROUP BY ALL),
px AS (SELECT f.*, e.y0 AS projected_p, e.y1 AS projected_p1, e.y2 AS projected_p2, perturbation_amplification, local_distance, first_g / 10.0::DOUBLE AS first_exit_time, exit_dimension,
    first_g IS NOT NULL AS domain_exit
  FROM pfit f JOIN (SELECT * FROM pend WHERE v = 0) e ON e.symbol = f.symbol AND e.rn = f.rn JOIN pamp m ON m.symbol = f.symbol AND m.rn = f.rn
  JOIN pexit q ON q.symbol = f.symbol AND q.rn = f.rn)"""


def policy_cte() -> str:
    """``em`` = emission labels and the two state machines, replayed row by row."""
    eps = "0.0035332071428566536"
    return f"""
lab0 AS (SELECT *, CASE WHEN abs(p1) <= {eps} THEN CASE WHEN projected_p1 > {eps} THEN 'TURNING_UP' WHEN projected_p1 < -{eps} THEN 'TURNING_DOWN' ELSE 'NEAR_STATIONARY' END
    WHEN p1 > {eps} AND projected_p1 <= -{eps} THEN 'TURNING_DOWN' WHEN p1 < -{eps} AND projected_p1 >= {eps} THEN 'TURNING_UP'
    WHEN p1 > 0 THEN CASE WHEN p2 > 0 THEN 'UP_ACCELERATING' ELSE 'UP_DECELERATING' END
    ELSE CASE WHEN p2 > 0 THEN 'DOWN_DECELERATING' ELSE 'DOWN_ACCELERATING' END END AS trajectory_phase,
  CASE WHEN p1 > {eps} AND projected_p1 <= -{eps} THEN 'TURNING_DOWN' WHEN p1 < -{eps} AND projected_p1 >= {eps} THEN 'TURNING_UP'
    WHEN p1 > {eps} AND p2 < 0 AND projected_p1 < p1 THEN 'DETERIORATING_TOWARD_TURN' WHEN p1 < -{eps} AND p2 > 0 AND projected_p1 > p1 THEN 'RECOVERING_TOWARD_TURN'
    WHEN p2 * projected_p2 < 0 THEN 'PROJECTED_P2_REVERSAL' ELSE 'NONE' END AS turning_tendency,
  CASE WHEN domain_exit THEN 'LOW' WHEN condition_number <= 7.835779770603297 AND max_real_eigenvalue <= 0.42217565243576405 AND perturbation_amplification <= 2.2423650649621742 THEN 'HIGH'
    WHEN condition_number <= 13.040323846425492 AND max_real_eigenvalue <= 0.6449378901835623 AND perturbation_amplification <= 2.6637448484678754 THEN 'MEDIUM' ELSE 'LOW' END AS confidence_state,
  CASE WHEN domain_exit THEN 'OUT_OF_DOMAIN' ELSE 'IN_DOMAIN' END AS domain_state,
  CASE WHEN max_real_eigenvalue > 0 THEN 'LOCALLY_EXPANSIVE' ELSE 'STABLE' END AS stability_state,
  CASE WHEN p1 > {eps} THEN 'UP' WHEN p1 < -{eps} THEN 'DOWN' ELSE 'NEAR_ZERO' END AS raw_direction,
  CASE WHEN abs(p1) <= {eps} THEN 'NEAR_STATIONARY' WHEN p1 > {eps} THEN CASE WHEN p2 > 0 AND projected_p1 >= p1 THEN 'UP_ACCELERATING' WHEN p2 < 0 AND projected_p1 < p1 THEN 'UP_DECELERATING' ELSE 'UP_STABLE' END
    WHEN p2 < 0 AND projected_p1 <= p1 THEN 'DOWN_ACCELERATING' WHEN p2 > 0 AND projected_p1 > p1 THEN 'DOWN_DECELERATING' ELSE 'DOWN_STABLE' END AS motion,
  abs(projected_p1) / greatest(abs(p1), abs(projected_p1), {eps}) AS p1_zero_proximity,
  (CASE WHEN p1 > {eps} THEN greatest(0, p1 - projected_p1) WHEN p1 < -{eps} THEN greatest(0, projected_p1 - p1) ELSE 0 END) / greatest(abs(p1), {eps}) AS deceleration_strength,
  CASE WHEN p1 > {eps} AND p2 < 0 AND projected_p1 < p1 THEN 'DOWN' WHEN p1 < -{eps} AND p2 > 0 AND projected_p1 > p1 THEN 'UP' ELSE '' END AS opposing,
  CASE WHEN p1 > {eps} AND projected_p1 <= 0 THEN 'DOWN' WHEN p1 < -{eps} AND projected_p1 >= 0 THEN 'UP' ELSE '' END AS crossing FROM px),
lab AS (SELECT *, CASE WHEN confidence_state = 'LOW' THEN 'AMBER' WHEN trajectory_phase IN ('UP_ACCELERATING', 'TURNING_UP') AND projected_p1 > {eps} THEN 'GREEN'
    WHEN trajectory_phase IN ('DOWN_ACCELERATING', 'TURNING_DOWN') AND projected_p1 < -{eps} THEN 'RED' ELSE 'AMBER' END AS raw_color,
  CASE WHEN crossing <> '' THEN crossing WHEN opposing <> '' AND p1_zero_proximity <= 0.9 AND deceleration_strength >= 0.05 THEN opposing ELSE '' END AS candidate,
  row_number() OVER (PARTITION BY symbol ORDER BY rn) AS e FROM lab0),
fold AS (
  SELECT symbol, 0::BIGINT AS e, '' AS color, '' AS pending, false AS held, '' AS opp, 0 AS opp_n, '' AS cand, 0 AS cand_n, '' AS cockpit, false AS direct FROM (SELECT DISTINCT symbol FROM lab)
  UNION ALL
  SELECT l.symbol, l.e,
    CASE WHEN ((f.color = 'GREEN' AND l.raw_color = 'RED') OR (f.color = 'RED' AND l.raw_color = 'GREEN')) AND f.pending <> l.raw_color THEN 'AMBER' ELSE l.raw_color END,
    CASE WHEN ((f.color = 'GREEN' AND l.raw_color = 'RED') OR (f.color = 'RED' AND l.raw_color = 'GREEN')) AND f.pending <> l.raw_color THEN l.raw_color ELSE '' END,
    ((f.color = 'GREEN' AND l.raw_color = 'RED') OR (f.color = 'RED' AND l.raw_color = 'GREEN')) AND f.pending <> l.raw_color,
    l.opposing, CASE WHEN l.opposing = '' THEN 0 WHEN l.opposing = f.opp THEN f.opp_n + 1 ELSE 1 END,
    l.candidate, CASE WHEN l.candidate = '' THEN 0 WHEN l.candidate = f.cand THEN f.cand_n + 1 ELSE 1 END,
    CASE WHEN l.raw_direction = 'NEAR_ZERO' OR l.candidate <> '' OR (f.cockpit = 'GREEN' AND l.raw_direction = 'DOWN') OR (f.cockpit = 'RED' AND l.raw_direction = 'UP') THEN 'AMBER'
         WHEN l.raw_direction = 'DOWN' THEN 'RED' ELSE 'GREEN' END,
    l.candidate = '' AND ((f.cockpit = 'GREEN' AND l.raw_direction = 'DOWN') OR (f.cockpit = 'RED' AND l.raw_direction = 'UP'))
  FROM fold f JOIN lab l ON l.symbol = f.symbol AND l.e = f.e + 1),
em AS (SELECT l.*, f.color, f.held, f.opp_n AS persistence_count, f.cand_n AS candidate_age, f.cockpit AS cockpit_color, f.direct AS direct_change,
    CASE WHEN l.raw_direction = 'NEAR_ZERO' THEN 'NEAR_STATIONARY' WHEN l.candidate <> '' THEN 'TURN_' || l.candidate || '_CANDIDATE' WHEN f.direct THEN 'DIRECTION_CHANGE_TRANSITION' ELSE l.motion END AS refined_state
  FROM lab l JOIN fold f ON f.symbol = l.symbol AND f.e = l.e)"""


def beats_cte() -> str:
    return """beats0 AS (
  SELECT date_trunc('hour', ts) AS beat, max(value) * 10 AS rtt_ms, count(*) FILTER (event_type = 'error') AS misses,
         count(*) FILTER (event_type = 'signup') AS signups, count(*) AS n FROM events GROUP BY ALL),
beats1 AS (SELECT *, CASE WHEN signups = 0 THEN 'RECOVERING' WHEN misses = 2 THEN 'FAILED' ELSE 'HEALTHY' END AS reported FROM beats0),
beats AS (SELECT *, CASE WHEN reported = 'RECOVERING' THEN 'RECOVERING' WHEN rtt_ms > 1500 OR misses >= 3 OR reported = 'FAILED' THEN 'FAILED'
                         ELSE 'HEALTHY' END AS feed_state,
  CASE WHEN misses = 1 OR feed_state = 'RECOVERING' THEN 'RECOVERING' WHEN feed_state = 'FAILED' THEN 'NOT_READY' WHEN n >= 10 THEN 'OBSERVE_INFER' ELSE 'OBSERVE_ONLY' END AS capability
  FROM beats1)"""


STATE = (
    "kind feed_state capability side skip_reason model_status emitter_position pricing_status color trajectory_phase domain_state confidence_state domain_exit"
).split()


def changes_cte() -> str:
    """``chg`` = transitions of all four stages over hourly bars (needs RECURSIVE)."""
    def row(**given: str) -> str:
        return ", ".join(f"{given.get(n, 'false' if n == 'domain_exit' else 'NULL::VARCHAR')} AS {n}" for n in STATE)

    different = " OR ".join(f"{n} IS DISTINCT FROM lag({n}) OVER w" for n in STATE)
    status = "CASE WHEN b.rn <= 15 THEN 'WARMUP_DERIVATIVE' WHEN b.rn <= 45 THEN 'WARMUP_F4' ELSE 'EMITTED' END"
    return f"""{bars_cte()}, {adaptive_cte()}, {price_cte()}, {policy_cte()}, {beats_cte()},
evs AS (
  SELECT 'P03_ADAPTIVE' AS stage_id, symbol AS entity_id, rn AS position, interval_start AS effective_time, market_snapshot_id, rn - 1 AS accepted_sequence, interval_start AS bar_start,
    CASE WHEN side IS NULL THEN 'SKIP:INITIALIZING' ELSE 'DECISION:' || side END AS code,
    {row(kind="CASE WHEN side IS NULL THEN 'SKIP' ELSE 'DECISION' END", side="side", skip_reason="CASE WHEN side IS NULL THEN 'INITIALIZING' END",
         model_status="CASE WHEN side IS NULL THEN 'INITIALIZING' ELSE 'ACTIONABLE' END", emitter_position="emitter_position")} FROM dec
  UNION ALL
  SELECT 'P04_PRICE_ENGINE', b.symbol, b.rn, CASE WHEN b.rn > 45 THEN a.interval_start ELSE b.interval_start END, s.market_snapshot_id, greatest(b.rn - 1, 1), b.interval_start,
    CASE WHEN b.rn > 45 THEN 'EMITTED:' || color ELSE 'SKIP:' || {status} END,
    {row(kind="'PRICING'", pricing_status=status, color="color", trajectory_phase="trajectory_phase", domain_state="domain_state", confidence_state="confidence_state",
         skip_reason=f"nullif({status}, 'EMITTED')", domain_exit="coalesce(domain_exit, false)")}
  FROM pb b JOIN bars s ON s.symbol = b.symbol AND s.interval_start = b.interval_start
  LEFT JOIN pb a ON a.symbol = b.symbol AND a.rn = b.rn - 1 LEFT JOIN em x ON x.symbol = b.symbol AND x.rn = b.rn - 1
  UNION ALL
  SELECT 'P01_MARKET_FEED', 'GLOBAL', CAST(epoch(beat) AS BIGINT), beat, NULL, 0, NULL, feed_state, {row(kind="'FEED'", feed_state="feed_state")} FROM beats
  UNION ALL
  SELECT 'P02_INGESTION', 'GLOBAL', CAST(epoch(beat) AS BIGINT), beat, NULL, 0, NULL, capability, {row(kind="'INGESTION'", capability="capability")} FROM beats),
diff AS (SELECT *, lag(code) OVER w AS prev_code, lag(kind) OVER w AS prev_kind, lag(side) OVER w AS prev_side, lag(color) OVER w AS prev_color,
    {", ".join(f"{n} IS DISTINCT FROM lag({n}) OVER w AS chg_{n}" for n in STATE)},
    lag(position) OVER w IS NULL OR {different} AS changed
  FROM evs WINDOW w AS (PARTITION BY stage_id, entity_id ORDER BY position)),
chg AS (SELECT *, row_number() OVER (PARTITION BY stage_id, entity_id ORDER BY position) AS sequence,
    stage_id || ':' || entity_id || ':' || row_number() OVER (PARTITION BY stage_id, entity_id ORDER BY position) AS transition_id FROM diff WHERE changed)"""
