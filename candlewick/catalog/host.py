"""Registered gate, joint-commit, reset, health, golden and dictionary queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from candlewick.catalog.changes import beats
from candlewick.catalog.helpers import pick, plain, r
from candlewick.catalog.sqltext import adaptive_cte, arrivals_cte, bars_cte, beats_cte, confirm_cte, price_cte, volume_cte
from candlewick.functions import scalars as S
from candlewick.operators import adaptive as A
from candlewick.operators import dictionary as D
from candlewick.operators import gate as H
from candlewick.operators import golden as X
from candlewick.operators import health as L
from candlewick.operators import price as P
from candlewick.operators import volume as V
from candlewick.operators.ingest import latest_by
from candlewick.session import stage
from candlewick.sources.arrivals import feed_arrivals
from candlewick.sources.ticks import event_bars, read_table

KEY = ["symbol", "interval_start"]


def flagged(spark, d, reset=False):
    """Arrivals with readiness and loss flags, and some unreadable closes, taken from the bars themselves."""
    a = feed_arrivals(spark, d).withColumns(
        {
            "infer": F.col("volume") > 20,
            "proven_missing": (F.col("event_count") >= 6) & (F.col("interval_start") > F.lit("2024-01-22").cast("timestamp")),
            "close": F.when((F.col("high") > 200) | (F.col("low") < 0.5), F.lit(float("nan"))).otherwise(F.col("close")),
        }
    )
    if not reset:
        return a
    resets = a.filter(F.col("interval_start") >= F.lit("2024-01-15").cast("timestamp")).groupBy("symbol").agg(F.min("arrival").alias("arrival"))
    return H.with_reset_epoch(a, resets)


def gate_rows(spark, d):
    g = H.gate(flagged(spark, d))
    return plain(g.select(*KEY, "arrival", "gate", "gate_detail", "committed"))


def outcomes(spark, d):
    o = H.decision_outcomes(H.gate(flagged(spark, d)))
    kind = S.outcome_kind(F.col("side"), F.col("skip_reason"))
    return plain(o.select(*KEY, "arrival", kind.alias("kind"), "side", r("c"), "emitter_position", "skip_reason", "skip_detail", "accepted_sequence"))


def joint(spark, d):
    """Outcomes of the three models per symbol that sent anything; a symbol may have none at all."""
    gated = stage(H.gate(flagged(spark, d)))
    decided, priced, volumes = H.joint_commit(gated)
    counts = [
        df.groupBy("symbol").agg(F.count("*").alias(name), F.max(column).alias(f"last_{name}"))
        for df, name, column in ((decided, "decisions", "rn"), (priced, "prices", "rn"), (volumes, "volumes", "rn"))
    ]
    found = gated.filter(F.col("symbol").isNotNull()).select("symbol").distinct()
    for c in counts:
        found = found.join(c, "symbol", "left")
    return found.na.fill(0)


def reset_rows(spark, d):
    o = H.decision_outcomes(H.gate(flagged(spark, d, reset=True)))
    return plain(o.select(*KEY, "arrival", "epoch", "side", r("c"), "skip_reason", "accepted_sequence"))


def statuses(spark, d):
    return L.symbol_status(H.gate(flagged(spark, d)))


def component(spark, d):
    return L.component_health(statuses(spark, d))


def report(spark, d):
    return L.health_report(component(spark, d), beats(spark, d).select("beat", "feed_state"))


def latest(spark, d):
    """Last decision, price and volume outcome of every symbol."""
    bars = event_bars(spark, d)
    dec = A.decisions(bars).select(*KEY, F.lit("decision").alias("stream"), "event_id", F.coalesce("side", "skip_reason").alias("value"))
    pri = P.price_events(bars).select("symbol", F.col("trigger_interval_start").alias("interval_start"), F.lit("price").alias("stream"), "event_id", "status")
    vol = V.volume_events(bars).select(*KEY, F.lit("volume").alias("stream"), "event_id", "indicator")
    return plain(latest_by(dec.union(pri).union(vol), ["symbol", "stream"], "interval_start"))


def same_bar(spark, d):
    """Decision and volume outcomes caused by the same published bar."""
    bars = event_bars(spark, d)
    a = A.decisions(bars).select(*KEY, "market_snapshot_id", "side").alias("a")
    b = V.volume_events(bars).select(*KEY, "market_snapshot_id", "indicator").alias("b")
    pairs = a.join(b, S.same_initiating_bar("a", "b"))
    return pairs.groupBy("side", "indicator").agg(F.count("*").alias("n"))


def golden_numbers(spark, d):
    """Hourly features recomputed from half-cent prices and volumes, against the originals."""
    bars = event_bars(spark, d)
    want = V.volume_features(bars)
    bumped = bars.withColumn("volume", F.when(F.col("event_count") == 1, F.col("volume") + 1).otherwise(F.col("volume")))
    got = V.volume_features(bumped)
    return X.numeric_diff(got, want, KEY, {"v_raw": 0.0, "v_n": 0.01, "interval_mean": 0.01}).select(
        "field", "compared", "exact", "outside", r("max_abs"), r("mean_abs"), r("max_rel"), "readiness_mismatch", "unmatched"
    )


def _colored_twice(spark, d):
    bars = event_bars(spark, d)
    bumped = bars.withColumn("volume", F.when(F.col("event_count") == 1, F.col("volume") + 1).otherwise(F.col("volume")))
    return V.volume_events(bumped), V.volume_events(bars)


def golden_labels(spark, d):
    got, want = _colored_twice(spark, d)
    return X.category_diff(got, want, KEY, ["raw_color", "indicator", "transition", "phase"])


def golden_label_rows(spark, d):
    got, want = _colored_twice(spark, d)
    return plain(X.category_mismatches(got, want, KEY, ["raw_color", "indicator", "transition", "phase"]))


def near(spark, d):
    f = V.volume_features(event_bars(spark, d))
    return plain(X.near_threshold(f, KEY, "interval_mean", [0.9, 1.1], 0.01).select(*KEY, r("interval_mean"), "threshold"))


def tolerance(spark, d):
    b = event_bars(spark, d)
    close = F.col("close")
    return b.agg(
        F.count_if(S.within_tolerance(close, close * (1 + 2.0**-52), 0.0)).alias("one_step"),
        F.count_if(S.within_tolerance(close, close * (1 + 2.0**-40), 0.0)).alias("far"),
        F.count_if(S.within_tolerance(close, close + 0.4, 0.5)).alias("inside_abs"),
        F.count_if(S.within_tolerance(-close, close, 0.0)).alias("opposite"),
        F.count("*").alias("n"),
    )


def terms(spark, d):
    """A term table grown from the labels that actually occur in the feed and its volume outcomes."""
    v = V.volume_events(event_bars(spark, d)).select("raw_color", "indicator", "transition", "phase", "status")
    cells = F.array(*[F.struct(F.lit(c).alias("family"), F.col(c).alias("term")) for c in v.columns])
    seen = v.select(F.inline(cells)).filter(F.col("term").isNotNull()).distinct()
    own = F.concat(F.upper("family"), F.lit("."), F.col("term"))
    filled = F.concat(F.lit("label of "), F.col("family"))
    return seen.select(
        own.alias("id"), "term", F.initcap("term").alias("display"),
        F.when(F.col("family") == "phase", "PHASE").otherwise("STATE").alias("type"),
        F.lit("VOLUME_ENGINE").alias("component"),
        F.when(F.col("term") != "STABLE", filled).otherwise("").alias("plain_meaning"),
        filled.alias("scientific_meaning"), filled.alias("tooltip"), filled.alias("popover_title"), filled.alias("popover_body"),
        F.lit("ACTIVE").alias("lifecycle_status"), F.lit("PERSIST").alias("persistence_policy"),
        (F.col("family") == "indicator").alias("presentation_only"),
        F.when(F.col("family") == "indicator", F.array(F.concat(F.lit("RAW_COLOR."), F.col("term")))).otherwise(F.array().cast("array<string>")).alias("canonical_source_ids"),
        F.when(F.col("term").startswith("CONFIRMED_"), F.array(F.concat(F.lit("TRANSITION.PENDING_"), F.substring("term", 11, 20)), F.lit("TRANSITION.LOST"))).otherwise(F.array().cast("array<string>")).alias("related_terms"),
        F.when(F.col("term") == "GREEN", F.array(F.lit("ACTIVE_HIGH"))).otherwise(F.array().cast("array<string>")).alias("aliases"),
    )


def annotated(spark, d):
    v = V.volume_events(event_bars(spark, d))
    named = F.when(F.col("indicator") == "GREEN", "ACTIVE_HIGH").otherwise(F.col("indicator"))
    values = v.select(F.inline(F.array(F.struct(named.alias("value")), F.struct(F.col("transition").alias("value")), F.struct(F.col("symbol").alias("value")), F.struct(F.col("status").alias("value")))))
    found = D.annotate_events(values.filter(F.col("value").isNotNull()), terms(spark, d))
    return found.groupBy("value", "term_id", "display", "finding").agg(F.count("*").alias("n"))


def batch_admit(spark, d):
    """Non-finite closes never reach the model: here every zero-range bar has none."""
    b = event_bars(spark, d).withColumn("close", F.when(F.col("high") == F.col("low"), F.lit(float("nan"))).otherwise(F.col("close")))
    g = H.gate(b.withColumn("arrival", F.unix_seconds("interval_start")))
    o = H.decision_outcomes(g)
    return o.groupBy("symbol", "skip_reason").agg(F.count("*").alias("n"))


QUERIES = {
    "gate_skip": gate_rows,
    "joint_outcomes": outcomes,
    "joint_commit": joint,
    "reset_symbol": reset_rows,
    "invalid_input_skips": batch_admit,
    "symbol_status": statuses,
    "component_health": component,
    "health_report": report,
    "latest_per_symbol": latest,
    "same_initiating_bar": same_bar,
    "golden_numeric_diff": golden_numbers,
    "golden_category_diff": golden_labels,
    "golden_category_mismatches": golden_label_rows,
    "golden_near_threshold": near,
    "ulp_tolerance": tolerance,
    "annotate_events": annotated,
    "dictionary_checks": lambda s, d: D.dictionary_checks(terms(s, d)),
}


def _gated(epoch: str = "0") -> str:
    """``gated`` = gates replayed arrival by arrival with an explicit latch."""
    return f"""{arrivals_cte()},
flag0 AS (SELECT *, volume > 20 AS infer, event_count >= 6 AND interval_start > TIMESTAMP '2024-01-22' AS proven, high > 200 OR low < 0.5 AS bad,
  quality_status = 'COMPLETE' AS eligible FROM arrivals),
flag1 AS (SELECT *, {epoch} AS epoch FROM flag0),
queue AS (SELECT *, row_number() OVER (PARTITION BY symbol, epoch ORDER BY arrival) AS k FROM flag1),
walk AS (
  SELECT symbol, epoch, 0::BIGINT AS k, NULL::TIMESTAMP AS prev, NULL::TIMESTAMP AS last, false AS disc, '' AS gate FROM (SELECT DISTINCT symbol, epoch FROM queue)
  UNION ALL
  SELECT symbol, epoch, k, prev, CASE WHEN gate = 'PASS' AND NOT bad THEN interval_start ELSE prev END, disc0 OR gate = 'INPUT_GAP', gate FROM (
    SELECT q.*, w.last AS prev, w.disc AS disc0,
      CASE WHEN w.disc THEN 'STATE_DISCONTINUOUS' WHEN NOT q.infer THEN 'INFER_OFF' WHEN NOT q.eligible THEN 'NOT_MODEL_ELIGIBLE'
           WHEN q.interval_start <= w.last THEN 'DUPLICATE_OR_REGRESSION' WHEN w.last IS NOT NULL AND q.interval_start - w.last > INTERVAL 1 MINUTE AND q.proven THEN 'INPUT_GAP' ELSE 'PASS' END AS gate
    FROM walk w JOIN queue q ON q.symbol = w.symbol AND q.epoch = w.epoch AND q.k = w.k + 1)),
gated0 AS (SELECT q.*, w.prev, w.gate, w.gate = 'PASS' AND NOT q.bad AS committed,
    epoch(q.interval_start) - epoch(w.prev) AS dt FROM walk w JOIN queue q ON q.symbol = w.symbol AND q.epoch = w.epoch AND q.k = w.k),
gated AS (SELECT *, CASE WHEN gate = 'STATE_DISCONTINUOUS' THEN 'INPUT_GAP' WHEN gate IN ('DUPLICATE_OR_REGRESSION', 'INPUT_GAP') THEN
    CASE WHEN dt = 0 THEN 'duplicate' WHEN dt < 0 THEN 'regression' ELSE 'irregular' END || ' last=' || strftime(prev, '%Y-%m-%dT%H:%M:%SZ') || ' current=' || {"strftime(interval_start, '%Y-%m-%dT%H:%M:%SZ')"}
    || ' elapsed=' || CASE WHEN dt = 0 THEN '0s' ELSE CASE WHEN dt < 0 THEN '-' ELSE '' END || CAST(abs(dt) // 3600 AS BIGINT) || 'h' || CAST(abs(dt) % 3600 // 60 AS BIGINT) || 'm' || CAST(abs(dt) % 60 AS BIGINT) || 's' END
    || CASE WHEN gate = 'INPUT_GAP' THEN ' proven_missing_eligible' ELSE '' END END AS gate_detail FROM gated0)"""


_OUT = f"WITH RECURSIVE {_gated()}, accepted AS (SELECT * FROM gated WHERE committed), {adaptive_cte('accepted')}"
_SKIP = "CASE WHEN g.gate <> 'PASS' THEN g.gate ELSE 'INVALID_INPUT' END"
_EPOCH = """coalesce(CASE WHEN arrival >= min(CASE WHEN interval_start >= TIMESTAMP '2024-01-15' THEN arrival END) OVER (PARTITION BY symbol)
  THEN min(CASE WHEN interval_start >= TIMESTAMP '2024-01-15' THEN arrival END) OVER (PARTITION BY symbol) END, 0)"""
_STATUS0 = f"""WITH RECURSIVE {_gated()}, agg AS (SELECT symbol, count(*) FILTER (committed) AS accepted, bool_or(gate IN ('INPUT_GAP', 'STATE_DISCONTINUOUS')) AS disc,
  count(*) FILTER (gate = 'PASS' AND NOT committed) AS errors, arg_max(infer, arrival) AS infer, arg_max(gate, arrival) FILTER (gate <> 'PASS') AS last_skip FROM gated GROUP BY symbol),
st AS (SELECT symbol, accepted, last_skip, accepted || '/16' AS warmup,
  CASE WHEN disc THEN 'discontinuous' WHEN NOT infer AND accepted > 0 THEN 'paused' WHEN errors > 0 THEN 'error' WHEN accepted = 0 THEN 'cold' WHEN accepted < 16 THEN 'initializing' ELSE 'ready' END AS status,
  CASE WHEN disc THEN 'discontinuous' WHEN NOT infer AND accepted > 0 THEN 'paused' WHEN errors > 0 THEN 'error' WHEN accepted = 0 THEN 'cold' WHEN accepted <= 45 THEN 'initializing' ELSE 'ready' END AS pricing_status FROM agg),
comp AS (
  SELECT 'model' AS name, CASE WHEN bool_or(status = 'error') AND bool_and(status IN ('error', 'discontinuous')) THEN 'UNAVAILABLE:error' WHEN bool_or(status IN ('error', 'discontinuous')) THEN 'DEGRADED:discontinuous'
    WHEN bool_or(status IN ('initializing', 'cold', 'paused')) THEN 'DEGRADED:initializing' ELSE 'HEALTHY:adaptive' END AS v FROM st
  UNION ALL
  SELECT 'pricing', CASE WHEN bool_or(pricing_status = 'error') AND bool_and(pricing_status IN ('error', 'discontinuous')) THEN 'UNAVAILABLE:error' WHEN bool_or(pricing_status IN ('error', 'discontinuous')) THEN 'DEGRADED:discontinuous'
    WHEN bool_and(pricing_status = 'cold') THEN 'DEGRADED:cold' WHEN bool_or(pricing_status = 'paused') AND NOT bool_or(pricing_status IN ('initializing', 'cold')) THEN 'DEGRADED:paused'
    WHEN bool_or(pricing_status IN ('initializing', 'cold', 'paused')) THEN 'DEGRADED:initializing' ELSE 'HEALTHY:expm' END FROM st)"""
_TWO = f"""WITH RECURSIVE {bars_cte()}, {volume_cte()}, {confirm_cte()},
want AS (SELECT v.*, c.color AS indicator, c.transition FROM vol v LEFT JOIN conf c ON c.symbol = v.symbol AND c.rn = v.rn),
bumped AS (SELECT * REPLACE (CASE WHEN event_count = 1 THEN volume + 1 ELSE volume END AS volume) FROM bars),"""
_TWICE = _TWO + volume_cte("bumped").replace("vol", "wol").replace("wolume", "volume") + "," + confirm_cte().replace("FROM vol ", "FROM wol ").replace("valid", "walid").replace("conf ", "wonf ") + """,
got AS (SELECT v.*, c.color AS indicator, c.transition FROM wol v LEFT JOIN wonf c ON c.symbol = v.symbol AND c.rn = v.rn)"""
_LABELS = ("raw_color", "indicator", "transition", "phase")


def _number_row(field: str, tol: float) -> str:
    return f"""SELECT '{field}' AS field, count(g.{field} - w.{field}) AS compared, count(*) FILTER (g.{field} = w.{field}) AS exact, count(*) FILTER (abs(g.{field} - w.{field}) > {tol}) AS outside,
  round(max(abs(g.{field} - w.{field})), 9) AS max_abs, round(avg(abs(g.{field} - w.{field})), 9) AS mean_abs, round(max(abs(g.{field} - w.{field}) / nullif(abs(w.{field}), 0)), 9) AS max_rel,
  0::BIGINT AS readiness_mismatch, 0::BIGINT AS unmatched FROM got g JOIN want w ON g.symbol = w.symbol AND g.rn = w.rn"""


_TERMS = f"""WITH RECURSIVE {bars_cte()}, {volume_cte()}, {confirm_cte()},
ev AS (SELECT v.symbol, v.raw_color, c.color AS indicator, c.transition, v.phase, CASE reason WHEN 'AVAILABLE' THEN 'AVAILABLE' WHEN 'MATURING_FEATURES' THEN 'MATURING' ELSE 'INVALID' END AS status
       FROM vol v LEFT JOIN conf c ON c.symbol = v.symbol AND c.rn = v.rn),
lab AS (SELECT 'raw_color' AS family, raw_color AS term FROM ev UNION SELECT 'indicator', indicator FROM ev UNION SELECT 'transition', transition FROM ev UNION SELECT 'phase', phase FROM ev UNION SELECT 'status', status FROM ev),
terms AS (SELECT upper(family) || '.' || term AS id, family, term FROM lab WHERE term IS NOT NULL)"""

ORACLE = {
    "gate_skip": f"WITH RECURSIVE {_gated()} SELECT symbol, interval_start, arrival, gate, gate_detail, committed FROM gated",
    "joint_outcomes": f"""{_OUT} SELECT g.symbol, g.interval_start, g.arrival, CASE WHEN d.side IS NOT NULL THEN 'DECISION' ELSE 'SKIP' END AS kind, d.side, round(d.c, 9) AS c, d.emitter_position,
  CASE WHEN NOT g.committed THEN {_SKIP} WHEN d.side IS NULL THEN 'INITIALIZING' END AS skip_reason,
  CASE WHEN NOT g.committed THEN gate_detail WHEN d.side IS NULL THEN d.rn || '/16' END AS skip_detail, d.rn - 1 AS accepted_sequence
  FROM gated g LEFT JOIN dec d ON g.committed AND d.symbol = g.symbol AND d.interval_start = g.interval_start""",
    "joint_commit": f"""WITH RECURSIVE {_gated()} SELECT symbol, count(*) FILTER (committed) AS decisions, count(*) FILTER (committed) AS last_decisions, count(*) FILTER (committed) AS prices,
  count(*) FILTER (committed) AS last_prices, count(*) FILTER (gate = 'PASS') AS volumes, count(*) FILTER (gate = 'PASS') AS last_volumes FROM gated GROUP BY symbol""",
    "reset_symbol": f"""WITH RECURSIVE {_gated(_EPOCH)}, accepted AS (SELECT * REPLACE (symbol || '/' || epoch AS symbol) FROM gated WHERE committed), {adaptive_cte('accepted')}
  SELECT g.symbol, g.interval_start, g.arrival, g.epoch, d.side, CASE WHEN d.rn > 15 OR d.rn <= 15 THEN round(d.c, 9) END AS c, CASE WHEN NOT g.committed THEN {_SKIP} WHEN d.side IS NULL THEN 'INITIALIZING' END AS skip_reason,
  d.rn - 1 AS accepted_sequence FROM gated g LEFT JOIN dec d ON g.committed AND d.symbol = g.symbol || '/' || g.epoch AND d.interval_start = g.interval_start""",
    "invalid_input_skips": f"""WITH {bars_cte()}, o AS (SELECT symbol, high <> low AS ok, row_number() OVER (PARTITION BY symbol, high <> low ORDER BY interval_start) AS rn FROM bars)
  SELECT symbol, CASE WHEN NOT ok THEN 'INVALID_INPUT' WHEN rn <= 15 THEN 'INITIALIZING' END AS skip_reason, count(*) AS n FROM o GROUP BY ALL""",
    "symbol_status": f"{_STATUS0} SELECT symbol, accepted, last_skip, warmup, status, pricing_status FROM st",
    "component_health": f"{_STATUS0} SELECT name, split_part(v, ':', 1) AS state, split_part(v, ':', 2) AS detail FROM comp",
    "health_report": f"""{_STATUS0}, {beats_cte()}, x AS (SELECT CASE arg_max(feed_state, beat) WHEN 'FAILED' THEN 'UNAVAILABLE' WHEN 'RECOVERING' THEN 'DEGRADED' ELSE 'HEALTHY' END AS feed,
   (SELECT split_part(v, ':', 1) FROM comp WHERE name = 'model') AS model, (SELECT split_part(v, ':', 1) FROM comp WHERE name = 'pricing') AS pricing, (SELECT split_part(v, ':', 2) FROM comp WHERE name = 'pricing') AS detail FROM beats)
  SELECT feed, model, pricing, CASE WHEN model = 'UNAVAILABLE' THEN 'UNAVAILABLE' WHEN feed <> 'HEALTHY' THEN feed WHEN model = 'DEGRADED' OR pricing = 'UNAVAILABLE' OR (pricing = 'DEGRADED' AND detail IN ('discontinuous', 'error')) THEN 'DEGRADED' ELSE 'HEALTHY' END AS state FROM x""",
    "latest_per_symbol": f"""WITH RECURSIVE {bars_cte()}, {adaptive_cte()}, {volume_cte()}, {confirm_cte()}, a AS (
  SELECT symbol, interval_start, 'decision' AS stream, symbol || ':evt:' || rn AS event_id, coalesce(side, 'INITIALIZING') AS value FROM dec
  UNION ALL SELECT symbol, interval_start, 'price', symbol || ':price:' || row_number() OVER (PARTITION BY symbol ORDER BY interval_start), 'EMITTED' FROM bars
  UNION ALL SELECT v.symbol, v.interval_start, 'volume', v.symbol || ':volume:' || v.rn, c.color FROM vol v LEFT JOIN conf c ON c.symbol = v.symbol AND c.rn = v.rn)
  SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY symbol, stream ORDER BY interval_start DESC) = 1""",
    "same_initiating_bar": f"""WITH RECURSIVE {bars_cte()}, {adaptive_cte()}, {volume_cte()}, {confirm_cte()}
  SELECT d.side, c.color AS indicator, count(*) AS n FROM dec d LEFT JOIN conf c ON c.symbol = d.symbol AND c.rn = d.rn GROUP BY ALL""",
    "golden_numeric_diff": f"{_TWICE} {_number_row('v_raw', 0.0)} UNION ALL {_number_row('v_n', 0.01)} UNION ALL {_number_row('interval_mean', 0.01)}",
    "golden_category_diff": _TWICE + " UNION ALL ".join(f" SELECT '{f}' AS field, count(*) FILTER (g.{f} IS NOT DISTINCT FROM w.{f}) AS exact, count(*) AS total FROM got g JOIN want w ON g.symbol = w.symbol AND g.rn = w.rn" for f in _LABELS),
    "golden_category_mismatches": _TWICE + " UNION ALL ".join(f" SELECT g.symbol, g.interval_start, '{f}' AS field, g.{f} AS got, w.{f} AS want FROM got g JOIN want w ON g.symbol = w.symbol AND g.rn = w.rn WHERE g.{f} IS DISTINCT FROM w.{f}" for f in _LABELS),
    "golden_near_threshold": f"""WITH {bars_cte()}, {volume_cte()} SELECT symbol, interval_start, round(interval_mean, 9) AS interval_mean, CASE WHEN abs(interval_mean - 0.9) <= 0.01 THEN 0.9::DOUBLE ELSE 1.1::DOUBLE END AS threshold
  FROM vol WHERE abs(interval_mean - 0.9) <= 0.01 OR abs(interval_mean - 1.1) <= 0.01""",
    "ulp_tolerance": f"WITH {bars_cte()} SELECT count(*) AS one_step, count(*) FILTER (close = 0) AS far, count(*) AS inside_abs, count(*) FILTER (close = 0) AS opposite, count(*) AS n FROM bars",
    "annotate_events": f"""{_TERMS}, names AS (SELECT term AS name, id, term FROM terms WHERE family <> 'indicator' UNION SELECT 'ACTIVE_HIGH', id, term FROM terms WHERE family <> 'indicator' AND term = 'GREEN'),
  one AS (SELECT name, count(*) AS k, min(id) AS id, min(term) AS term FROM names GROUP BY name),
  vals AS (SELECT CASE WHEN indicator = 'GREEN' THEN 'ACTIVE_HIGH' ELSE indicator END AS value FROM ev WHERE indicator IS NOT NULL UNION ALL SELECT transition FROM ev WHERE transition IS NOT NULL UNION ALL SELECT symbol FROM ev UNION ALL SELECT status FROM ev)
  SELECT value, CASE WHEN k = 1 THEN id END AS term_id, CASE WHEN k = 1 THEN upper(term[1]) || lower(term[2:]) END AS display, CASE WHEN k = 1 THEN 'KNOWN' WHEN k > 1 THEN 'REVIEW' ELSE 'MISSING' END AS finding, count(*) AS n
  FROM vals LEFT JOIN one ON name = value GROUP BY ALL""",
    "dictionary_checks": f"""{_TERMS} SELECT id, 'missing required meaning fields' AS problem FROM terms WHERE term = 'STABLE' UNION ALL SELECT id, 'invalid type' FROM terms WHERE family = 'phase'
  UNION ALL SELECT id, 'related term does not resolve: TRANSITION.LOST' FROM terms WHERE term LIKE 'CONFIRMED\\_%' ESCAPE '\\'
  UNION ALL SELECT id, 'related term does not resolve: TRANSITION.PENDING_' || term[11:] FROM terms WHERE term LIKE 'CONFIRMED\\_%' ESCAPE '\\' AND NOT EXISTS (SELECT 1 FROM terms t WHERE t.id = 'TRANSITION.PENDING_' || terms.term[11:])
  UNION ALL SELECT id, 'canonical source does not resolve: RAW_COLOR.' || term FROM terms WHERE family = 'indicator' AND NOT EXISTS (SELECT 1 FROM terms t WHERE t.id = 'RAW_COLOR.' || terms.term)""",
}
