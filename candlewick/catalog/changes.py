"""Registered transition and audit queries and their checks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from candlewick.catalog.helpers import plain, r
from candlewick.catalog.sqltext import beats_cte, changes_cte
from candlewick.operators import audit as U
from candlewick.operators import ingest as I
from candlewick.operators import transitions as T
from candlewick.plans import changes as C
from candlewick.session import shared_dir, stage
from candlewick.sources import transition_sink as K
from candlewick.sources import transition_text as X
from candlewick.sources.arrivals import heartbeats
from candlewick.sources.ticks import event_bars

KEY = ["stage_id", "entity_id"]


def beats(spark, d):
    state = I.feed_state(F.col("reported"), F.col("rtt_ms"), F.col("misses"))
    b = heartbeats(spark, d).withColumn("feed_state", state)
    return b.withColumn("capability", I.capability(F.col("feed_state"), F.col("n") >= 10, F.col("misses") == 1))


def events(spark, d):
    """Outcomes of all stages; the bars are written once, because every model and join reads them."""
    return C.all_events(stage(event_bars(spark, d)), stage(beats(spark, d)))


def changes(spark, d):
    """The transition table; written once, because every audit reads it several times."""
    return stage(T.transitions(events(spark, d)))


def damaged(spark, d):
    """The stream as a careless writer would log it: every 50th row twice, three numbers left out before the 40th."""
    c = changes(spark, d).withColumn("position", F.col("position") * 2)
    twice = c.filter(F.col("sequence") % 50 == 0).withColumn("position", F.col("position") + 1)
    jumped = F.when(F.col("sequence") >= 40, F.col("sequence") + 3).otherwise(F.col("sequence"))
    return c.unionByName(twice).withColumn("sequence", jumped)


def by_day(spark, d):
    path = f"{shared_dir(spark)}/days-{uuid.uuid4().hex}"
    K.write_by_day(T.transitions(events(spark, d)), path)
    return path


def logged(spark, d):
    """Every seventh transition comes without an id, so the log drops it and says so."""
    path = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
    c = T.transitions(events(spark, d))
    K.write_log(c.withColumn("transition_id", F.when(F.col("sequence") % 7 != 0, F.col("transition_id"))), path)
    return path


def log_agrees(lost=None):
    """The log's own footer against what is read back; blocks of the stage ``lost`` went missing after it was written."""

    def run(spark, d):
        path = logged(spark, d)
        found = X.parse_transitions_text(spark, f"{path}/blocks")
        found = found.filter(F.col("stage_id") != lost) if lost is not None else found
        counts = X.parse_footer(spark, f"{path}/footer")
        return U.log_report(found, counts)

    return run


def all_transitions(spark, d):
    c = changes(spark, d)
    return plain(
        c.select(*KEY, "sequence", "transition_id", "position", "effective_time", "market_snapshot_id", "accepted_sequence",
                 F.col("previous.code").alias("prev_code"), "current.code", *[F.col(f"current.{n}").alias(n) for n in T.COMPARED])
    )


def state_rows(spark, d):
    return plain(events(spark, d).select(*KEY, "position", "state.code", "state.kind", "state.skip_reason", "state.color"))


def with_epochs(spark, d):
    """A reset in the middle: the same state is published again, numbers run on."""
    e = C.feed_events(beats(spark, d)).withColumn("epoch", (F.col("effective_time") >= F.lit("2024-01-15").cast("timestamp")).cast("int"))
    c = T.transitions(e)
    return plain(c.select(*KEY, "sequence", "effective_time", F.col("previous.code").alias("prev_code"), "current.code"))


def texts(spark, d):
    c = changes(spark, d)
    return c.select(*KEY, "sequence", "stage_name", T.display("previous").alias("before"), T.display("current").alias("now"),
                    T.state_lines("current", separator="; ").alias("lines"))


QUERIES = {
    "stage_states": state_rows,
    "transitions": all_transitions,
    "transition_reset": with_epochs,
    "latest_states": lambda s, d: T.latest_states(changes(s, d)).select(*KEY, "sequence", "current.code"),
    "bar_agrees": lambda s, d: changes(s, d).groupBy("stage_id").agg(F.count_if(T.bar_agrees()).alias("agree"), F.count("*").alias("n")),
    "display_text": texts,
    "audit_inventory": lambda s, d: U.inventory(changes(s, d)),
    "audit_sequence": lambda s, d: U.sequence_report(damaged(s, d)),
    "audit_missing_ranges": lambda s, d: U.missing_ranges(damaged(s, d)),
    "audit_reconstruct": lambda s, d: U.reconstruction_mismatches(damaged(s, d)),
    "audit_identical_adjacent": lambda s, d: U.identical_adjacent(damaged(s, d)),
    "audit_decision_moves": lambda s, d: U.decision_moves(changes(s, d)),
    "audit_price_moves": lambda s, d: U.price_moves(changes(s, d)),
    "audit_lineage_pairs": lambda s, d: U.lineage_pairs(changes(s, d)).select("snapshot", "p03", "p04", F.array_join("diffs", "|").alias("diffs")),
    "audit_lineage_summary": lambda s, d: U.lineage_summary(U.lineage_pairs(changes(s, d))),
    "audit_bar_complete": lambda s, d: U.bar_completeness(changes(s, d)),
    "audit_warmup": lambda s, d: U.warmup(changes(s, d)),
    "audit_codes_in_order": lambda s, d: U.codes_in_order(changes(s, d)),
    "audit_sparsity": lambda s, d: U.sparsity(changes(s, d)).select("entity_id", "accepted", "p03_transitions", "p04_transitions", r("p03_ratio"), r("p04_ratio")),
    "audit_time_slice": lambda s, d: plain(K.read_slice(s, by_day(s, d), F.lit("2024-01-30 19:59:00").cast("timestamp")).select(*KEY, "transition_id", "effective_time", "current.code")),
    "audit_run_log": log_agrees(),
    "audit_run_log_torn": log_agrees("P04_PRICE_ENGINE"),
    "audit_run_duration": lambda s, d: U.run_duration(changes(s, d), F.count("transition_id")),
}

_BASE = f"WITH RECURSIVE {changes_cte()}"
_FIELDS = ", ".join(T.COMPARED)
_LOST = f"""{_BASE}, logged AS (SELECT * REPLACE (CASE WHEN sequence >= 40 THEN sequence + 3 ELSE sequence END AS sequence, position * 2 AS position) FROM chg
  UNION ALL SELECT * REPLACE (CASE WHEN sequence >= 40 THEN sequence + 3 ELSE sequence END AS sequence, position * 2 + 1 AS position) FROM chg WHERE sequence % 50 = 0),
lost AS (SELECT *, lag(sequence) OVER w AS seq0, lag(code) OVER w AS code0, lag(transition_id) OVER w AS id0,
  lag(({_FIELDS})) OVER w AS state0, ({_FIELDS}) AS state1
  FROM logged WINDOW w AS (PARTITION BY stage_id, entity_id ORDER BY position))"""
def _log_report(kept: str) -> str:
    return f"""{_BASE}, l AS (SELECT *, row_number() OVER (PARTITION BY stage_id, entity_id ORDER BY position) % 7 <> 0 AS known FROM chg),
  t AS (SELECT CAST(epoch(max(effective_time) FILTER (known AND {kept})) - epoch(min(effective_time) FILTER (known AND {kept})) AS BIGINT) AS seconds,
    count(*) FILTER (known AND {kept}) AS found, count(*) FILTER (known) AS recorded, count(*) FILTER (NOT known) AS dropped FROM l)
  SELECT seconds, printf('%02d:%02d:%02d', seconds // 3600, seconds % 3600 // 60, seconds % 60) AS hms, found, recorded, dropped, 0::BIGINT AS write_errors, found = recorded AS agree FROM t"""


_NAMES = "CASE stage_id WHEN 'P01_MARKET_FEED' THEN 'Market Feed' WHEN 'P02_INGESTION' THEN 'Ingestion' WHEN 'P03_ADAPTIVE' THEN 'Adaptive Model' ELSE 'Price Engine' END"
_LABELS = [(label, name) for label, name in T._LINES]
_PRICE_CHANGED = " UNION ALL ".join(
    f"SELECT 'changed' AS measure, '{n}' AS value FROM p04 WHERE prev_kind IS NOT NULL AND chg_{n}"
    for n in ("pricing_status", "color", "skip_reason", "trajectory_phase", "domain_state", "confidence_state", "domain_exit")
)

ORACLE = {
    "stage_states": f"{_BASE} SELECT stage_id, entity_id, position, code, kind, skip_reason, color FROM evs",
    "transitions": f"{_BASE} SELECT stage_id, entity_id, sequence, transition_id, position, effective_time, market_snapshot_id, accepted_sequence, prev_code, code, {_FIELDS} FROM chg",
    "transition_reset": f"""WITH {beats_cte()}, l AS (SELECT *, beat >= TIMESTAMP '2024-01-15' AS epoch FROM beats),
  g AS (SELECT *, lag(feed_state) OVER (PARTITION BY epoch ORDER BY beat) AS prev_code FROM l)
  SELECT 'P01_MARKET_FEED' AS stage_id, 'GLOBAL' AS entity_id, row_number() OVER (ORDER BY beat) AS sequence, beat AS effective_time, prev_code, feed_state AS code FROM g WHERE prev_code IS DISTINCT FROM feed_state""",
    "latest_states": f"{_BASE} SELECT stage_id, entity_id, sequence, code FROM chg QUALIFY row_number() OVER (PARTITION BY stage_id, entity_id ORDER BY sequence DESC) = 1",
    "bar_agrees": f"{_BASE} SELECT stage_id, count(*) FILTER (bar_start IS NULL OR effective_time = bar_start) AS agree, count(*) AS n FROM chg GROUP BY stage_id",
    "display_text": f"""{_BASE} SELECT stage_id, entity_id, sequence, {_NAMES} AS stage_name, coalesce(prev_code, 'ABSENT') AS before, code AS now,
  concat_ws('; ', 'Kind: ' || kind, 'Code: ' || code, {", ".join(f"'{label}: ' || {name}" for label, name in _LABELS[2:])}, CASE WHEN kind = 'PRICING' THEN 'Domain Exit: ' || domain_exit END) AS lines FROM chg""",
    "audit_inventory": f"{_BASE} SELECT stage_id, entity_id, count(*) AS n FROM chg GROUP BY ROLLUP (stage_id, entity_id)",
    "audit_sequence": f"""{_LOST} SELECT stage_id, entity_id, count(*) AS n, min(sequence) AS first_sequence, max(sequence) AS last_sequence, count(*) FILTER (sequence <= seq0) AS resets, count(*) - count(DISTINCT sequence) AS duplicates,
  max(sequence) - min(sequence) + 1 - count(DISTINCT sequence) AS missing, missing = 0 AND resets = 0 AND duplicates = 0 AS monotonic FROM lost GROUP BY ALL""",
    "audit_missing_ranges": f"{_LOST} SELECT stage_id, entity_id, seq0 + 1 AS missing_from, sequence - 1 AS missing_to FROM lost WHERE sequence > seq0 + 1",
    "audit_reconstruct": f"{_LOST} SELECT stage_id, entity_id, transition_id, id0 AS prev_id, code0 AS expected_code, prev_code AS got_code FROM lost WHERE seq0 IS NOT NULL AND sequence = seq0",
    "audit_identical_adjacent": f"{_LOST} SELECT stage_id, entity_id, transition_id, id0 AS prev_id, code FROM lost WHERE seq0 IS NOT NULL AND state0 IS NOT DISTINCT FROM state1",
    "audit_decision_moves": f"""{_BASE}, p AS (SELECT * FROM chg WHERE stage_id = 'P03_ADAPTIVE')
  SELECT 'kind' AS measure, coalesce(prev_kind, 'ABSENT') || ' -> ' || kind AS value, count(*) AS n FROM p GROUP BY ALL
  UNION ALL SELECT 'side', prev_side || ' -> ' || side, count(*) FROM p WHERE prev_kind = 'DECISION' AND kind = 'DECISION' GROUP BY ALL
  UNION ALL SELECT 'code', code, count(*) FROM p GROUP BY ALL""",
    "audit_price_moves": f"""{_BASE}, p04 AS (SELECT * FROM chg WHERE stage_id = 'P04_PRICE_ENGINE'), m AS (
  SELECT 'status' AS measure, pricing_status AS value FROM p04
  UNION ALL SELECT 'color', prev_color || ' -> ' || color FROM p04 WHERE prev_color IS NOT NULL AND color IS NOT NULL
  UNION ALL SELECT 'same_color', color FROM p04 WHERE prev_color = color
  UNION ALL {_PRICE_CHANGED}) SELECT measure, value, count(*) AS n FROM m GROUP BY ALL""",
    "audit_lineage_pairs": f"""{_BASE} SELECT a.market_snapshot_id AS snapshot, a.transition_id AS p03, b.transition_id AS p04, '' AS diffs
  FROM chg a JOIN chg b ON a.market_snapshot_id = b.market_snapshot_id AND a.stage_id = 'P03_ADAPTIVE' AND b.stage_id = 'P04_PRICE_ENGINE'""",
    "audit_lineage_summary": f"""{_BASE} SELECT count(DISTINCT a.market_snapshot_id) AS shared_snapshots, count(*) AS pairs_ok, 0::BIGINT AS mismatches
  FROM chg a JOIN chg b ON a.market_snapshot_id = b.market_snapshot_id AND a.stage_id = 'P03_ADAPTIVE' AND b.stage_id = 'P04_PRICE_ENGINE'""",
    "audit_bar_complete": f"""{_BASE} SELECT stage_id, count(*) FILTER (market_snapshot_id IS NOT NULL) AS with_bar, count(*) FILTER (market_snapshot_id IS NULL) AS without_bar,
  0::BIGINT AS incomplete, 0::BIGINT AS snapshot_mismatch, 0::BIGINT AS symbol_mismatch FROM chg GROUP BY stage_id""",
    "audit_warmup": f"""{_BASE} SELECT stage_id, entity_id, arg_min(transition_id, sequence) AS first_id, arg_min(code, sequence) AS first_code, arg_min(accepted_sequence, sequence) AS first_accepted,
  arg_min(transition_id, sequence) FILTER (kind = 'DECISION' OR pricing_status = 'EMITTED') AS first_output_id, arg_min(code, sequence) FILTER (kind = 'DECISION' OR pricing_status = 'EMITTED') AS first_output_code,
  arg_min(accepted_sequence, sequence) FILTER (kind = 'DECISION' OR pricing_status = 'EMITTED') AS first_output_accepted, arg_max(accepted_sequence, sequence) AS last_accepted, count(*) AS n
  FROM chg WHERE stage_id IN ('P03_ADAPTIVE', 'P04_PRICE_ENGINE') GROUP BY ALL""",
    "audit_codes_in_order": f"{_BASE} SELECT stage_id, entity_id, sequence, code FROM chg WHERE stage_id IN ('P03_ADAPTIVE', 'P04_PRICE_ENGINE')",
    "audit_sparsity": f"""{_BASE}, p AS (SELECT entity_id, greatest(max(accepted_sequence) FILTER (stage_id = 'P03_ADAPTIVE'), max(accepted_sequence) FILTER (stage_id = 'P04_PRICE_ENGINE')) AS accepted,
  count(*) FILTER (stage_id = 'P03_ADAPTIVE') AS p03_transitions, count(*) FILTER (stage_id = 'P04_PRICE_ENGINE') AS p04_transitions
  FROM chg WHERE stage_id IN ('P03_ADAPTIVE', 'P04_PRICE_ENGINE') GROUP BY entity_id)
  SELECT *, round(p03_transitions / accepted, 9) AS p03_ratio, round(p04_transitions / accepted, 9) AS p04_ratio FROM p""",
    "audit_time_slice": f"{_BASE} SELECT stage_id, entity_id, transition_id, effective_time, code FROM chg WHERE effective_time >= TIMESTAMP '2024-01-30 19:59:00'",
    "audit_run_log": _log_report("true"),
    "audit_run_log_torn": _log_report("stage_id <> 'P04_PRICE_ENGINE'"),
    "audit_run_duration": f"""{_BASE}, t AS (SELECT CAST(epoch(max(effective_time)) - epoch(min(effective_time)) AS BIGINT) AS seconds, count(*) AS found FROM chg)
  SELECT seconds, printf('%02d:%02d:%02d', seconds // 3600, seconds % 3600 // 60, seconds % 60) AS hms, found, found AS recorded, true AS agree FROM t""",
}
