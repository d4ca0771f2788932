"""Audits over a table of transitions.  Plain joins, windows and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewick.operators import segments as G
from candlewick.operators.transitions import COMPARED

KEY = ["stage_id", "entity_id"]
PRICE_FIELDS = ["pricing_status", "color", "skip_reason", "trajectory_phase", "domain_state", "confidence_state", "domain_exit"]
BAR_FIELDS = (
    "symbol market_snapshot_id interval_start interval_end open high low close volume source source_timestamp quality_status"
).split()


def inventory(changes: DataFrame) -> DataFrame:
    """Counts per stage and entity with stage totals and a grand total."""
    return changes.rollup(*KEY).agg(F.count("*").alias("n"))


def neighbours(changes: DataFrame, layout: G.Layout | None = None) -> DataFrame:
    """Every row with the one before it in log order (``position``)."""
    layout = (layout or G.Layout.of(KEY)).along(KEY, "position")
    laid = G.lay_out(changes, layout, 1)
    before = F.lag(F.struct("transition_id", "sequence", "current")).over(layout.window)
    return laid.withColumn("before", before).filter(~F.col("halo")).drop("halo", "_k", "seg", "rn")


def sequence_report(changes: DataFrame, layout: G.Layout | None = None) -> DataFrame:
    """First, last, missing, duplicate and reset sequence numbers per key."""
    pairs = neighbours(changes, layout)
    numbers = changes.groupBy(*KEY, "sequence").agg(F.count("*").alias("copies"))
    distinct = numbers.groupBy(*KEY).agg(F.count("*").alias("distinct_n"), F.count_if(F.col("copies") > 1).alias("duplicates"))
    report = pairs.groupBy(*KEY).agg(
        F.count("*").alias("n"),
        F.min_by("sequence", "position").alias("first_sequence"),
        F.max_by("sequence", "position").alias("last_sequence"),
        F.count_if(F.col("sequence") <= F.col("before.sequence")).alias("resets"),
    )
    # Numbers of the first..last range that never occur.
    inside = (
        numbers.join(report.select(*KEY, "first_sequence", "last_sequence"), KEY)
        .filter(F.col("sequence").between(F.col("first_sequence"), F.col("last_sequence")))
        .groupBy(*KEY)
        .agg(F.count("*").alias("_inside"))
    )
    span = F.greatest(F.col("last_sequence") - F.col("first_sequence") + 1, F.lit(0))
    return (
        report.join(distinct, KEY)
        .join(inside, KEY, "left")
        .withColumn("missing", span - F.coalesce("_inside", F.lit(0)))
        .withColumn("monotonic", (F.col("resets") == 0) & (F.col("duplicates") == 0) & (F.col("missing") == 0))
        .drop("_inside", "distinct_n")
    )


def missing_ranges(changes: DataFrame, layout: G.Layout | None = None) -> DataFrame:
    """Gaps between consecutive numbers, as (from, to)."""
    pairs = neighbours(changes, layout)
    return pairs.filter(F.col("sequence") > F.col("before.sequence") + 1).select(
        *KEY, (F.col("before.sequence") + 1).alias("missing_from"), (F.col("sequence") - 1).alias("missing_to")
    )


def reconstruction_mismatches(changes: DataFrame, layout: G.Layout | None = None) -> DataFrame:
    """Rows whose recorded previous state is not the state recorded before."""
    pairs = neighbours(changes, layout).filter(F.col("before").isNotNull())
    return pairs.filter(~F.col("previous").eqNullSafe(F.col("before.current"))).select(
        *KEY, "transition_id", F.col("before.transition_id").alias("prev_id"),
        F.col("before.current.code").alias("expected_code"), F.col("previous.code").alias("got_code"),
    )


def identical_adjacent(changes: DataFrame, layout: G.Layout | None = None) -> DataFrame:
    pairs = neighbours(changes, layout).filter(F.col("before").isNotNull())
    same = F.lit(True)
    for name in COMPARED:
        same = same & F.col(f"current.{name}").eqNullSafe(F.col(f"before.current.{name}"))
    return pairs.filter(same).select(*KEY, "transition_id", F.col("before.transition_id").alias("prev_id"), "current.code")


def decision_moves(changes: DataFrame) -> DataFrame:
    """Kind and side matrices, code counts and rows without a bar, as (measure, value, n)."""
    p03 = changes.filter(F.col("stage_id") == "P03_ADAPTIVE")
    both = (F.col("previous.kind") == "DECISION") & (F.col("current.kind") == "DECISION")
    measures = F.array(
        F.struct(F.lit("kind").alias("measure"), F.concat(F.coalesce("previous.kind", F.lit("ABSENT")), F.lit(" -> "), F.col("current.kind")).alias("value")),
        F.struct(F.lit("side").alias("measure"), F.when(both, F.concat("previous.side", F.lit(" -> "), "current.side")).alias("value")),
        F.struct(F.lit("code").alias("measure"), F.col("current.code").alias("value")),
        F.struct(F.lit("no_bar").alias("measure"), F.when(F.col("bar").isNull(), "true").alias("value")),
    )
    return (
        p03.select(F.inline(measures)).filter(F.col("value").isNotNull()).groupBy("measure", "value").agg(F.count("*").alias("n"))
    )


def price_moves(changes: DataFrame) -> DataFrame:
    """Status counts, colour moves, same-colour changes and changed fields."""
    p04 = changes.filter(F.col("stage_id") == "P04_PRICE_ENGINE")
    color0, color1 = F.col("previous.color"), F.col("current.color")
    rows = [
        F.struct(F.lit("status").alias("measure"), F.coalesce("current.pricing_status", "current.code").alias("value")),
        F.struct(F.lit("color").alias("measure"), F.concat(color0, F.lit(" -> "), color1).alias("value")),
        F.struct(F.lit("same_color").alias("measure"), F.when(color0 == color1, color1).alias("value")),
    ]
    for name in PRICE_FIELDS:
        changed = F.col("previous.kind").isNotNull() & ~F.col(f"previous.{name}").eqNullSafe(F.col(f"current.{name}"))
        rows.append(F.struct(F.lit("changed").alias("measure"), F.when(changed, name).alias("value")))
    return (
        p04.select(F.inline(F.array(*rows))).filter(F.col("value").isNotNull()).groupBy("measure", "value").agg(F.count("*").alias("n"))
    )


def lineage_pairs(changes: DataFrame) -> DataFrame:
    """Decision and price transitions caused by the same bar, with differing fields.

    The join key is the snapshot id together with nothing else: a bar causes at
    most one transition per stage, so groups stay tiny.
    """
    snap = F.coalesce("bar.market_snapshot_id", "market_snapshot_id")
    left = changes.filter(F.col("stage_id") == "P03_ADAPTIVE").select(
        snap.alias("snapshot"), F.col("transition_id").alias("p03"), F.col("bar").alias("a"), F.col("market_snapshot_id").alias("corr_a"), F.col("entity_id").alias("ent_a"))
    right = changes.filter(F.col("stage_id") == "P04_PRICE_ENGINE").select(
        snap.alias("snapshot"), F.col("transition_id").alias("p04"), F.col("bar").alias("b"), F.col("market_snapshot_id").alias("corr_b"), F.col("entity_id").alias("ent_b"))
    diffs = [F.when(~F.col(f"a.{n}").eqNullSafe(F.col(f"b.{n}")), n) for n in BAR_FIELDS]
    diffs += [
        F.when(~F.col("corr_a").eqNullSafe(F.col("a.market_snapshot_id")), "p03_corr_vs_bar"),
        F.when(~F.col("corr_b").eqNullSafe(F.col("b.market_snapshot_id")), "p04_corr_vs_bar"),
        F.when(~F.col("ent_a").eqNullSafe(F.col("ent_b")), "entity"),
    ]
    pairs = left.join(right, "snapshot")
    lost = F.col("a").isNull() | F.col("b").isNull()
    return pairs.select(
        "snapshot", "p03", "p04",
        F.when(lost, F.array(F.lit("missing_bar"))).otherwise(F.array_compact(F.array(*diffs))).alias("diffs"),
    )


def lineage_summary(pairs: DataFrame) -> DataFrame:
    return pairs.agg(
        F.countDistinct("snapshot").alias("shared_snapshots"),
        F.count_if(F.size("diffs") == 0).alias("pairs_ok"),
        F.count_if(F.size("diffs") > 0).alias("mismatches"),
    )


def bar_completeness(changes: DataFrame) -> DataFrame:
    """Per stage: bars with missing fields and bars that contradict their event."""
    has = F.col("bar").isNotNull()
    lacking = F.lit(False)
    for name in BAR_FIELDS:
        lacking = lacking | F.col(f"bar.{name}").isNull()
    snap = F.coalesce(F.col("bar.market_snapshot_id") != F.col("market_snapshot_id"), F.lit(False))
    symbol = (F.col("entity_id") != "GLOBAL") & F.coalesce(F.col("bar.symbol") != F.col("entity_id"), F.lit(False))
    return changes.groupBy("stage_id").agg(
        F.count_if(has).alias("with_bar"),
        F.count_if(~has).alias("without_bar"),
        F.count_if(has & lacking).alias("incomplete"),
        F.count_if(has & snap).alias("snapshot_mismatch"),
        F.count_if(has & symbol).alias("symbol_mismatch"),
    )


def warmup(changes: DataFrame) -> DataFrame:
    """First rows, first decision / emission, last accepted, distinct code changes per key."""
    models = changes.filter(F.col("stage_id").isin("P03_ADAPTIVE", "P04_PRICE_ENGINE"))
    first = (F.col("current.kind") == "DECISION") | (F.col("current.pricing_status") == "EMITTED")
    at = F.when(first, F.col("sequence"))
    return models.groupBy(*KEY).agg(
        F.min_by("transition_id", "sequence").alias("first_id"),
        F.min_by("current.code", "sequence").alias("first_code"),
        F.min_by("accepted_sequence", "sequence").alias("first_accepted"),
        F.min_by("transition_id", at).alias("first_output_id"),
        F.min_by("current.code", at).alias("first_output_code"),
        F.min_by("accepted_sequence", at).alias("first_output_accepted"),
        F.max_by("accepted_sequence", "sequence").alias("last_accepted"),
        F.count("*").alias("n"),
    )


def codes_in_order(changes: DataFrame) -> DataFrame:
    """The ordered codes as rows: (key, sequence, code)."""
    models = changes.filter(F.col("stage_id").isin("P03_ADAPTIVE", "P04_PRICE_ENGINE"))
    return models.select(*KEY, "sequence", "current.code")


def sparsity(changes: DataFrame) -> DataFrame:
    """Transitions per accepted row and entity."""
    models = changes.filter(F.col("stage_id").isin("P03_ADAPTIVE", "P04_PRICE_ENGINE"))
    p03, p04 = F.col("stage_id") == "P03_ADAPTIVE", F.col("stage_id") == "P04_PRICE_ENGINE"
    counted = models.groupBy("entity_id").agg(
        F.greatest(
            F.max_by("accepted_sequence", F.when(p03, F.col("sequence"))), F.max_by("accepted_sequence", F.when(p04, F.col("sequence")))
        ).alias("accepted"),
        F.count_if(p03).alias("p03_transitions"),
        F.count_if(p04).alias("p04_transitions"),
    )
    ratio = lambda c: F.when(F.col("accepted") != 0, F.col(c) / F.col("accepted"))
    return counted.withColumns({"p03_ratio": ratio("p03_transitions"), "p04_ratio": ratio("p04_transitions")})


def time_slice(changes: DataFrame, start: Column) -> DataFrame:
    return changes.filter(F.col("effective_time") >= start)


def run_duration(changes: DataFrame, recorded: Column) -> DataFrame:
    """Run length and recorded versus found row count."""
    seconds = F.unix_seconds(F.max("effective_time")) - F.unix_seconds(F.min("effective_time"))
    return changes.agg(
        seconds.alias("seconds"),
        F.format_string(
            "%02d:%02d:%02d", F.floor(seconds / 3600), F.floor(F.pmod(seconds, F.lit(3600)) / 60), F.pmod(seconds, F.lit(60))
        ).alias("hms"),
        F.count("*").alias("found"),
        recorded.alias("recorded"),
    ).withColumn("agree", F.col("found") == F.col("recorded"))


def log_report(found: DataFrame, footer: DataFrame) -> DataFrame:
    """Run length, rows read back, and the footer's own counts; ``footer`` is the one row of ``parse_footer``."""
    recorded = F.first("written").alias("recorded"), F.first("dropped").alias("dropped"), F.first("write_errors").alias("write_errors")
    seconds = run_duration(found, F.lit(0)).drop("recorded", "agree")
    both = seconds.unionByName(footer.agg(*recorded), allowMissingColumns=True)
    names = ["seconds", "hms", "found", "recorded", "dropped", "write_errors"]
    one = both.agg(*[F.first(n, ignorenulls=True).alias(n) for n in names])
    return one.withColumn("agree", F.col("found").eqNullSafe(F.col("recorded")))
