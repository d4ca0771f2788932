"""Price trajectory: status, phase, confidence, colours and the cockpit view."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewick.functions import scalars as S
from candlewick.operators import segments as G
from candlewick.operators import price_kernel as K
from candlewick.operators.kernels import run_segments
from candlewick.session import stage


@dataclass(frozen=True)
class PricePolicy:
    """Fixed values of the emission and cockpit policy."""

    epsilon: float = 0.0035332071428566536
    condition: tuple[float, float] = (7.835779770603297, 13.040323846425492)
    eigenvalue: tuple[float, float] = (0.42217565243576405, 0.6449378901835623)
    amplification: tuple[float, float] = (2.2423650649621742, 2.6637448484678754)
    debounce: bool = True
    zero_proximity: float = 0.9
    deceleration: float = 0.05
    persistence_rows: int = 1
    low_confidence_amber: bool = False
    domain_exit_amber: bool = False


POLICY = PricePolicy()
_SIX = ("p", "p1", "p2", "projected_p", "projected_p1", "projected_p2")


def price_observations(bars: DataFrame, extra: list[str] | None = None) -> DataFrame:
    return bars.select(
        *(extra or []),
        "symbol",
        "interval_start",
        "source_timestamp",
        "market_snapshot_id",
        "source",
        (F.unix_millis("interval_start") / F.lit(60_000.0)).alias("minutes"),
        "close",
    )


def price_numbers(bars: DataFrame, layout: G.Layout | None = None) -> tuple[DataFrame, G.Layout]:
    """Kernel output per triggering bar, plus its status."""
    layout = layout or G.Layout.of(["symbol"])
    laid = G.lay_out(price_observations(bars, [k for k in layout.keys if k != "symbol"]), layout, K.HALO)
    df = run_segments(laid, layout.groups, "rn", K.price_kernel, K.FIELDS)
    prev = F.lag(F.struct("interval_start", "source_timestamp")).over(layout.window)
    df = df.withColumn("_active", prev).filter(~F.col("halo"))
    return (
        df.withColumns(
            {
                "status": price_status(),
                "active_interval_start": F.col("_active.interval_start"),
                "active_source_timestamp": F.col("_active.source_timestamp"),
                "accepted_sequence": F.greatest(F.col("rn") - 1, F.lit(1)),
            }
        )
        .withColumn("emitted", F.col("status").isin("EMITTED", "RK45_FAILURE"))
        .drop("_active", "halo"),
        layout,
    )


def price_status() -> Column:
    ready = F.col("p1").isNotNull() & F.col("p2").isNotNull()
    return (
        F.when(~ready, "WARMUP_DERIVATIVE")
        .when(~F.col("fit_ready"), "WARMUP_F4")
        .when(~F.col("fitted"), "F4_FIT_UNAVAILABLE")
        .when(F.col("projected"), "EMITTED")
        .otherwise("RK45_FAILURE")
    )


def skip_reason(status: Column) -> Column:
    return F.when(status == "EMITTED", None).when(status == "RK45_FAILURE", "PROJECTION_FAILURE").otherwise(status)


def usable(df: DataFrame) -> Column:
    ok = F.col("projected")
    for name in _SIX:
        ok = ok & S.finite(name)
    return ok


def price_phase(p1: Column, p2: Column, projected: Column, eps: float) -> Column:
    still = F.abs(p1) <= eps
    return (
        F.when(still & (projected > eps), "TURNING_UP")
        .when(still & (projected < -eps), "TURNING_DOWN")
        .when(still, "NEAR_STATIONARY")
        .when((p1 > eps) & (projected <= -eps), "TURNING_DOWN")
        .when((p1 < -eps) & (projected >= eps), "TURNING_UP")
        .when((p1 > 0) & (p2 > 0), "UP_ACCELERATING")
        .when(p1 > 0, "UP_DECELERATING")
        .when(p2 > 0, "DOWN_DECELERATING")
        .otherwise("DOWN_ACCELERATING")
    )


def turning_tendency(p1: Column, p2: Column, projected1: Column, projected2: Column, eps: float) -> Column:
    return (
        F.when((p1 > eps) & (projected1 <= -eps), "TURNING_DOWN")
        .when((p1 < -eps) & (projected1 >= eps), "TURNING_UP")
        .when((p1 > eps) & (p2 < 0) & (projected1 < p1), "DETERIORATING_TOWARD_TURN")
        .when((p1 < -eps) & (p2 > 0) & (projected1 > p1), "RECOVERING_TOWARD_TURN")
        .when(p2 * projected2 < 0, "PROJECTED_P2_REVERSAL")
        .otherwise("NONE")
    )


def confidence(policy: PricePolicy) -> Column:
    def under(i: int) -> Column:
        return (
            (F.col("condition_number") <= policy.condition[i])
            & (F.col("max_real_eigenvalue") <= policy.eigenvalue[i])
            & (F.col("perturbation_amplification") <= policy.amplification[i])
        )

    return F.when(F.col("domain_exit"), "LOW").when(under(0), "HIGH").when(under(1), "MEDIUM").otherwise("LOW")


def price_raw_color(policy: PricePolicy) -> Column:
    phase, ahead = F.col("trajectory_phase"), F.col("projected_p1")
    return (
        F.when(F.col("confidence_state") == "LOW", "AMBER")
        .when(phase.isin("UP_ACCELERATING", "TURNING_UP") & (ahead > policy.epsilon), "GREEN")
        .when(phase.isin("DOWN_ACCELERATING", "TURNING_DOWN") & (ahead < -policy.epsilon), "RED")
        .otherwise("AMBER")
    )


def motion_state(p1: Column, p2: Column, ahead: Column, eps: float) -> Column:
    return (
        F.when(F.abs(p1) <= eps, "NEAR_STATIONARY")
        .when((p1 > eps) & (p2 > 0) & (ahead >= p1), "UP_ACCELERATING")
        .when((p1 > eps) & (p2 < 0) & (ahead < p1), "UP_DECELERATING")
        .when(p1 > eps, "UP_STABLE")
        .when((p2 < 0) & (ahead <= p1), "DOWN_ACCELERATING")
        .when((p2 > 0) & (ahead > p1), "DOWN_DECELERATING")
        .otherwise("DOWN_STABLE")
    )


def with_emission(df: DataFrame, policy: PricePolicy = POLICY) -> DataFrame:
    """Policy labels that depend on the row alone (emitted rows only)."""
    eps = policy.epsilon
    p1, p2, a1, a2 = (F.col(c) for c in ("p1", "p2", "projected_p1", "projected_p2"))
    df = df.withColumn("usable", usable(df))
    good = F.col("usable")
    df = df.withColumns(
        {
            "trajectory_phase": F.when(good, price_phase(p1, p2, a1, eps)).otherwise("UNCERTAIN"),
            "turning_tendency": F.when(good, turning_tendency(p1, p2, a1, a2, eps)).otherwise("NONE"),
            "domain_state": F.when(~good, "INVALID").when(F.col("domain_exit"), "OUT_OF_DOMAIN").otherwise("IN_DOMAIN"),
            "stability_state": F.when(~good, "INVALID")
            .when(F.col("max_real_eigenvalue") > 0, "LOCALLY_EXPANSIVE")
            .otherwise("STABLE"),
            "confidence_state": F.when(good, confidence(policy)).otherwise("INVALID"),
            "delta_projected_p": F.col("projected_p") - F.col("p"),
            "delta_projected_p1": a1 - p1,
            "delta_projected_p2": a2 - p2,
            "current_direction": S.direction3(p1, eps),
            "current_acceleration": S.accel_sign(p2),
            "projected_direction": S.direction3(a1, eps),
            "projected_acceleration": S.accel_sign(a2),
        }
    )
    df = df.withColumn("raw_color", F.when(good, price_raw_color(policy)).otherwise("INVALID"))
    scale = F.greatest(F.abs(p1), F.abs(a1), F.lit(eps))
    raw_direction = S.direction3(p1, eps)
    toward = F.when(raw_direction == "UP", F.greatest(F.lit(0.0), p1 - a1)).when(
        raw_direction == "DOWN", F.greatest(F.lit(0.0), a1 - p1)
    ).otherwise(0.0)
    return df.withColumns(
        {
            "raw_direction": F.when(good, raw_direction).otherwise("INVALID"),
            "motion": F.when(good, motion_state(p1, p2, a1, eps)),
            "p1_zero_proximity": F.when(good, F.abs(a1) / scale),
            "deceleration_strength": F.when(good, toward / F.greatest(F.abs(p1), F.lit(eps))),
            "opposing": F.when(good & (p1 > eps) & (p2 < 0) & (a1 < p1), "DOWN").when(
                good & (p1 < -eps) & (p2 > 0) & (a1 > p1), "UP"
            ),
            "crossing": F.when(good & (p1 > eps) & (a1 <= 0), "DOWN").when(good & (p1 < -eps) & (a1 >= 0), "UP"),
        }
    )


def _opposite(before: Column, now: Column, up: str, down: str) -> Column:
    return F.coalesce(((before == "GREEN") & (now == down)) | ((before == "RED") & (now == up)), F.lit(False))


def _odd_in_run(flag: Column, last_break: Column) -> Column:
    """A flip is held back only if the flip before it was shown: odd places of a run."""
    return flag & (F.pmod(F.col("em") - last_break, F.lit(2)) == 1)


def _with_runs(df: DataFrame, layout: G.Layout, shown: str, run: str, flips: Callable[[Column, Callable[[str], Column]], Column], needs: list[str], out: tuple[str, str, str]) -> DataFrame:
    """Over the emitted rows: is a row a flip against the one before, which was the last that is none, where did its run begin.

    ``flips(before, now)`` judges the previous row's ``shown`` against columns of the current one (``needs``); a run
    is a stretch of equal non-NULL ``run`` values.  Positions are numbers ``em`` of emitted rows.  A segment reports
    its first and last emitted row and its last positions in one summary row; what its first emitted
    row is can be told from the summary of the segments before.
    """
    w, own = layout.window, F.col("emitted")
    flag, calm, begun = out
    flips_ = lambda before, now: F.coalesce(flips(before, now), F.lit(False))
    starts = lambda now, before: now.isNotNull() & ~now.eqNullSafe(before)
    here = F.when(own, F.struct(F.col(shown).alias("shown"), F.col(run).alias("run")))
    df = df.withColumns({"_in": F.count_if(own).over(G.so_far(w)), "_p": F.last(here, ignorenulls=True).over(G.before(w))})
    later = own & F.col("_p").isNotNull()
    at = F.when(own, F.col("rn"))
    first = F.struct(*[F.col(c) for c in dict.fromkeys([*needs, run])])
    ends = df.groupBy(*layout.groups).agg(
        F.count_if(own).alias("n"),
        F.min_by(first, at).alias("first"),
        F.max_by(F.struct(F.col(shown).alias("shown"), F.col(run).alias("run")), at).alias("last"),
        F.max(F.when(later & ~flips_(F.col("_p.shown"), F.col), F.col("_in"))).alias("calm"),
        F.max(F.when(later & starts(F.col(run), F.col("_p.run")), F.col("_in"))).alias("begun"),
    )
    along, some = G.along_segments(layout), F.col("n") > 0
    ends = ends.withColumns({"_off": F.coalesce(F.sum("n").over(along), F.lit(0)), "_prev": F.last(F.when(some, F.col("last")), ignorenulls=True).over(along)})
    calm_first = some & ~flips_(F.col("_prev.shown"), lambda c: F.col(f"first.{c}"))
    run_first = some & starts(F.col(f"first.{run}"), F.col("_prev.run"))
    ends = ends.withColumns(
        {
            "_calm_end": F.coalesce(F.col("_off") + F.col("calm"), F.when(calm_first, F.col("_off") + 1)),
            "_begun_end": F.coalesce(F.col("_off") + F.col("begun"), F.when(run_first, F.col("_off") + 1)),
        }
    )
    carried = ends.select(
        *layout.groups, "_off", "_prev",
        F.last("_calm_end", ignorenulls=True).over(along).alias("_calm0"), F.last("_begun_end", ignorenulls=True).over(along).alias("_begun0"),
    )
    df = df.join(carried, layout.groups)
    df = df.withColumns({"em": F.col("_off") + F.col("_in"), "_p": F.coalesce("_p", "_prev")})
    df = df.withColumns({flag: own & flips_(F.col("_p.shown"), F.col), "_starts": own & starts(F.col(run), F.col("_p.run"))})
    return df.withColumns(
        {
            calm: F.coalesce(F.last(F.when(own & ~F.col(flag), F.col("em")), ignorenulls=True).over(G.so_far(w)), F.col("_calm0")),
            begun: F.coalesce(F.last(F.when(F.col("_starts"), F.col("em")), ignorenulls=True).over(G.so_far(w)), F.col("_begun0")),
        }
    ).drop("_in", "_p", "_off", "_prev", "_calm0", "_begun0", "_starts")


def with_colors(rows: DataFrame, layout: G.Layout, policy: PricePolicy = POLICY) -> DataFrame:
    """Debounced colour and cockpit state over the emitted rows of each symbol; other rows only pass.

    The remembered state of both interpreters reduces to positions of run starts:
    how long the same opposing direction, the same turn candidate, or an unbroken
    chain of direct GREEN/RED flips has lasted.
    """
    df = _with_runs(
        rows, layout, "raw_color", "opposing", lambda before, now: F.lit(policy.debounce) & _opposite(before, now("raw_color"), "GREEN", "RED"),
        ["raw_color"], ("_flip", "_calm", "_opp_from"),
    )
    held = _odd_in_run(F.col("_flip"), F.col("_calm"))
    df = df.withColumns(
        {
            "debounced": held,
            "color": F.when(held, "AMBER").otherwise(F.col("raw_color")),
            "persistence_count": F.when(F.col("opposing").isNotNull(), F.col("em") - F.col("_opp_from") + 1).otherwise(0),
        }
    )
    slowing = (
        F.col("opposing").isNotNull()
        & (F.col("persistence_count") >= policy.persistence_rows)
        & (F.col("p1_zero_proximity") <= policy.zero_proximity)
        & (F.col("deceleration_strength") >= policy.deceleration)
    )
    df = df.withColumn("candidate", F.coalesce("crossing", F.when(slowing, F.col("opposing"))))
    caution = (
        (F.lit(policy.low_confidence_amber) & (F.col("confidence_state") == "LOW"))
        | (F.lit(policy.domain_exit_amber) & (F.col("domain_state") == "OUT_OF_DOMAIN"))
    )
    base = (
        F.when(~F.col("usable"), "INVALID")
        .when((F.col("raw_direction") == "NEAR_ZERO") | F.col("candidate").isNotNull() | caution, "AMBER")
        .when(F.col("raw_direction") == "DOWN", "RED")
        .otherwise("GREEN")
    )
    df = df.withColumn("_base", base)
    df = _with_runs(
        df, layout, "_base", "candidate", lambda before, now: now("candidate").isNull() & _opposite(before, now("raw_direction"), "UP", "DOWN"),
        ["candidate", "raw_direction"], ("_turn", "_steady", "_cand_from"),
    )
    direct = _odd_in_run(F.col("_turn"), F.col("_steady"))
    near_zero = F.col("raw_direction") == "NEAR_ZERO"
    has = F.col("candidate").isNotNull()
    df = df.withColumns(
        {
            "direct_change": direct,
            "candidate_age": F.when(has, F.col("em") - F.col("_cand_from") + 1).otherwise(0),
            "turn_candidate": F.coalesce("candidate", F.lit("NONE")),
            "persistence_state": F.coalesce(F.concat(F.col("opposing"), F.lit("_DECELERATION")), F.lit("NONE")),
            "cockpit_color": F.when(direct & (F.col("_base") != "INVALID"), "AMBER").otherwise(F.col("_base")),
            "refined_state": F.when(~F.col("usable"), "INVALID")
            .when(near_zero, "NEAR_STATIONARY")
            .when(has, F.concat(F.lit("TURN_"), F.col("candidate"), F.lit("_CANDIDATE")))
            .when(direct, "DIRECTION_CHANGE_TRANSITION")
            .when(caution, "UNCERTAIN")
            .otherwise(F.col("motion")),
            "reason_codes": F.when(
                F.col("usable"),
                S.unique_in_order(
                    F.col("trajectory_phase"),
                    F.when(F.col("turning_tendency") != "NONE", F.col("turning_tendency")),
                    F.when(F.col("domain_exit"), "DOMAIN_EXIT"),
                    F.when(F.col("confidence_state") == "LOW", "LOW_CONFIDENCE"),
                    F.when(F.col("stability_state") == "LOCALLY_EXPANSIVE", "POSITIVE_MAX_REAL_EIGENVALUE"),
                    F.when(F.col("debounced"), "DIRECT_REVERSAL_DEBOUNCE"),
                ),
            )
            .when(F.col("projected"), F.array(F.lit("NONFINITE_TRAJECTORY")))
            .otherwise(F.array(F.lit("RK_FAILURE"))),
            "cockpit_reasons": F.when(
                F.col("usable"),
                S.unique_in_order(
                    F.col("motion"),
                    F.when(F.col("crossing").isNotNull(), F.concat(F.lit("PROJECTED_P1_"), F.col("crossing"), F.lit("_CROSS"))),
                    F.when(F.col("crossing").isNull() & has, "PERSISTENT_DECELERATION"),
                    F.when(F.col("crossing").isNull() & has, "PROJECTED_P1_ZERO_APPROACH"),
                    F.when(direct, "CURRENT_P1_DIRECTION_CROSS"),
                    F.when(F.lit(policy.low_confidence_amber) & (F.col("confidence_state") == "LOW"), "LOW_CONFIDENCE"),
                    F.when(F.lit(policy.domain_exit_amber) & (F.col("domain_state") == "OUT_OF_DOMAIN"), "DOMAIN_CAUTION"),
                    F.when(near_zero, "NEAR_STATIONARY"),
                ),
            )
            .when(F.col("projected"), F.array(F.lit("NONFINITE_TRAJECTORY")))
            .otherwise(F.array(F.lit("RK_FAILURE"))),
        }
    )
    return df.drop("seg", "em", *[c for c in df.columns if c.startswith("_")])


EMISSION = [
    "p", "p1", "p2", "projected_p", "projected_p1", "projected_p2", "delta_projected_p", "delta_projected_p1",
    "delta_projected_p2", "current_direction", "current_acceleration", "projected_direction", "projected_acceleration",
    "trajectory_phase", "turning_tendency", "domain_state", "stability_state", "confidence_state", "raw_color", "color",
    "reason_codes", "condition_number", "max_real_eigenvalue", "perturbation_amplification",
]
COCKPIT = [
    "refined_state", "p1_zero_proximity", "deceleration_strength", "persistence_state", "persistence_count",
    "turn_candidate", "candidate_age", "raw_direction", "cockpit_color", "cockpit_reasons",
]


def colored(bars: DataFrame, layout: G.Layout | None, policy: PricePolicy) -> tuple[DataFrame, list[str]]:
    """All rows, with colours on the emitted ones.  The numbers are written once: summaries and rows read them."""
    numbers, layout = price_numbers(bars, layout)
    return with_colors(with_emission(stage(numbers), policy), layout, policy), list(layout.keys)


def emissions(bars: DataFrame, layout: G.Layout | None = None, policy: PricePolicy = POLICY) -> DataFrame:
    """Emitted rows with policy colours and cockpit."""
    return colored(bars, layout, policy)[0].filter("emitted")


def price_events(bars: DataFrame, layout: G.Layout | None = None, policy: PricePolicy = POLICY) -> DataFrame:
    """One price outcome per bar: a typed skip, or an emission with cockpit.

    ``interval_start`` and ``source_timestamp`` are those of the evaluated
    (previous) bar for emissions; the snapshot id and source stay those of the
    triggering bar, whose own start is ``trigger_interval_start``.
    """
    rows, keys = colored(bars, layout, policy)
    base = [
        *keys, "interval_start", "source_timestamp", "market_snapshot_id", "source", "status", "emitted", "projected",
        "domain_exit", "active_interval_start", "active_source_timestamp", "accepted_sequence", "exit_dimension",
        "first_exit_time", "local_distance", "rn",
    ]
    own = F.col("emitted")
    both = rows.select(
        *base, F.when(own, F.struct(*EMISSION)).alias("emission"), F.when(own, F.struct(*COCKPIT)).alias("cockpit")
    )
    return both.withColumns(
        {
            "trigger_interval_start": F.col("interval_start"),
            "interval_start": F.when(own, F.col("active_interval_start")).otherwise(F.col("interval_start")),
            "source_timestamp": F.when(own, F.col("active_source_timestamp")).otherwise(F.col("source_timestamp")),
            "skip_reason": skip_reason(F.col("status")),
            "event_id": F.concat(F.col("symbol"), F.lit(":price:"), F.col("rn")),
        }
    )
