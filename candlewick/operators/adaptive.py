"""Adaptive state model and BUY/SELL/HOLD decisions.

The model looks sequential, but every remembered quantity is one of three kinds:

* an exponential average (reference, scale, volume reference, persistence), whose
  memory fades by a constant factor per row;
* the previous row's value (level, velocity, uncertainty);
* a clamped product or sum (half-life, adaptation rate), and chains of
  ``clamp(m * x)`` / ``clamp(x + d)`` steps are again one such step.

Steps of each kind compose into one step of the same kind, so all running values of a
block come from parallel scans (doubling) instead of a loop over rows.

A history can be cut too.  A segment is started ``WARM_ROWS`` rows early; by then
a difference in the starting averages has shrunk by 0.95**1024 < 1e-22, below
the resolution of a double.  The clamped chains are kept as *composed steps from
the segment start* and joined with the segment's true starting value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlewick.functions import scalars as S
from candlewick.operators import segments as G
from candlewick.operators.kernels import Block, run_segments
from candlewick.session import stage

# Model constants.
REF_ALPHA = 0.05
MIN_SCALE = 1e-4
VOLUME_ALPHA = 0.05
PERSISTENCE_ALPHA = 0.2
DT_FLOOR = 1e-6
VELOCITY_BOUND = 50.0
ACCELERATION_BOUND = 200.0
CURVATURE_BOUND = 200.0
EPSILON = 1e-8
DIRECTION_EPSILON = 1e-15
VOLUME_INFLUENCE_MAX = 3.0
STRENGTH = {"bias": -0.25, "mass": 0.8, "velocity": 0.35, "acceleration": 0.2, "coherence": 1.0, "uncertainty": 1.1}
CHANNELS = {"displacement": 1.0, "velocity": 1.0, "acceleration": 0.8, "volume": 0.7}
UNCERTAINTY = {"innovation": 1.0, "incoherence": 0.8, "unknown": 0.8, "data_quality": 1.0, "instability": 0.5}
REVERSAL = {"oppose": 1.0, "contradict": 0.8, "low_persistence": 0.7, "extreme": 0.8, "uncertainty": 0.6}
MULTIPLIER = (0.8, 1.5)
QUALITY_FLOOR = 0.5
HALF_LIFE = (120.0, 15.0, 900.0)
REINFORCE = (1.0, 1.35)
CONTRADICT = (0.5, 1.0)
RATE = (0.05, 0.001, 0.2)
LEARNING = (0.005, 1e-4, 0.05)
INTERVAL = (60.0, 10.0, 600.0)
SAMPLES = 8
SAMPLE_EXPONENT = 1.8
GAP_SECONDS = 5.0
INITIAL_UNCERTAINTY = 0.15
CONTEXT = 15
WARM_ROWS = 1024
CLASSES = ["NONE", "REINFORCING", "CONTRADICTING", "REVERSING", "STRUCTURAL/UNKNOWN"]
RULES = {
    "BUY": "UPWARD_AND_PRIOR_DIRECTION_AGREEMENT_AND_C_GE_PRIOR_MEDIAN",
    "SELL": "DOWNWARD_AND_PRIOR_DIRECTION_AGREEMENT_AND_C_GE_PRIOR_MEDIAN",
    "HOLD": "AFFIRM_POSITION_STATE_TRANSITION_PREDICATE_NOT_SATISFIED",
}

STATE_FIELDS = [
    *[
        T.StructField(n, T.DoubleType())
        for n in (
            "reference scale volume_reference level velocity acceleration curvature residual innovation volume_influence "
            "perturbation_magnitude perturbation_multiplier coherence strength persistence uncertainty reversal "
            "half_gain half_lo half_hi rate_shift rate_lo rate_hi rate_min rate_max"
        ).split()
    ],
    T.StructField("perturbation_class", T.StringType()),
    T.StructField("clipped", T.LongType()),
    T.StructField("data_gap", T.BooleanType()),
]


def _sign(v: np.ndarray) -> np.ndarray:
    return np.where(v > DIRECTION_EPSILON, 1, np.where(v < -DIRECTION_EPSILON, -1, 0))


def _sigmoid(v: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1.0 / (1.0 + np.exp(-v))


def _scan(maps: list[np.ndarray], position: np.ndarray, compose) -> list[np.ndarray]:
    """Composition of the maps of a segment's rows up to each row; a map is one value of each array.

    ``position`` counts the rows of the segment before a row.  By doubling: after step d a row holds the
    composition of the last 2 d rows, so the number of passes is the logarithm of the longest segment.
    """
    maps, reach = [m.copy() for m in maps], 1
    longest = int(position.max(initial=0))
    while reach <= longest:
        later = np.flatnonzero(position >= reach)
        for held, value in zip(maps, compose([m[later - reach] for m in maps], [m[later] for m in maps])):
            held[later] = value
        reach *= 2
    return maps


def _affine(first: list[np.ndarray], then: list[np.ndarray]) -> tuple:
    """x -> a x + b."""
    return first[0] * then[0], then[0] * first[1] + then[1]


def _floored(first: list[np.ndarray], then: list[np.ndarray]) -> tuple:
    """x -> max(lo, a x + b), a >= 0."""
    return (*_affine(first[:2], then[:2]), np.maximum(then[2], then[0] * first[2] + then[1]))


def _clamped_product(first: list[np.ndarray], then: list[np.ndarray]) -> tuple:
    """x -> min(hi, max(lo, gain x)), gain > 0."""
    return first[0] * then[0], np.clip(first[1] * then[0], then[1], then[2]), np.clip(first[2] * then[0], then[1], then[2])


def _clamped_sum(first: list[np.ndarray], then: list[np.ndarray]) -> tuple:
    """x -> min(hi, max(lo, x + shift)), with the extremes of the unclamped path."""
    return (
        first[0] + then[0], np.clip(first[1] + then[0], then[1], then[2]), np.clip(first[2] + then[0], then[1], then[2]),
        np.minimum(first[3], first[0] + then[3]), np.maximum(first[4], first[0] + then[4]),
    )


def _faded(values: np.ndarray, alpha: float, restart: np.ndarray, position: np.ndarray, initial: float, x: float) -> np.ndarray:
    """Exponential average per segment; ``initial`` is the value before a first row,
    ``x`` the value to continue from where the block does not begin with one."""
    keep = np.full(len(values), 1.0 - alpha)
    gain, shift = _scan([keep, alpha * values], position, _affine)
    first = restart[np.arange(len(values)) - position]
    return gain * np.where(first, initial, x) + shift


def _gap_and_scale(price: np.ndarray, restart: np.ndarray, position: np.ndarray, ref: float, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Reference minus price, and scale.

    In differences of prices: at a constant price the gap only shrinks, and no rounding of the reference enters.
    """
    keep = 1.0 - REF_ALPHA
    moved = np.empty(len(price))
    moved[1:] = price[:-1] - price[1:]
    moved[position == 0] = ref - price[position == 0]
    fixed = restart & (position == 0)  # a history begins at its own price with scale one
    gap = _scan([np.where(position == 0, 0.0, keep), np.where(fixed, 0.0, keep * moved)], position, _affine)[1]
    a, b, lo = _scan(
        [np.where(fixed, 0.0, 0.95), np.where(fixed, 1.0, 0.05 * np.abs(gap)), np.where(fixed, 1.0, MIN_SCALE)], position, _floored
    )
    return gap, np.maximum(lo, a * scale + b)


def _composed_products(m: np.ndarray, position: np.ndarray, lo: float, hi: float):
    """x -> min(hi_t, max(lo_t, gain_t * x)) after each row since the segment start."""
    return _scan([m, np.full(len(m), lo), np.full(len(m), hi)], position, _clamped_product)


def _composed_sums(d: np.ndarray, position: np.ndarray, lo: float, hi: float):
    """The additive counterpart, with the extremes of the unclamped path."""
    return _scan([d, np.full(len(d), lo), np.full(len(d), hi), np.minimum(d, 0.0), np.maximum(d, 0.0)], position, _clamped_sum)


#: What one row leaves behind for the next one.
CARRIED = ("reference", "scale", "volume_reference", "level", "velocity", "uncertainty", "persistence", "event_time")
FRESH = {
    "reference": 0.0, "scale": 1.0, "volume_reference": 1.0, "level": 0.0, "velocity": 0.0,
    "uncertainty": INITIAL_UNCERTAINTY, "persistence": 0.0, "event_time": 0.0,
}


def adaptive_kernel(block: Block, carried: dict[str, float] | None = None) -> dict[str, np.ndarray]:
    """All per-row state of complete segments.

    With ``carried`` the block is one piece of a single history that continues
    from those values.
    """
    past = carried or FRESH
    price, volume, at = block.floats("price"), block.floats("v_raw"), block.floats("event_time")
    quality, true_first = np.clip(block.floats("source_quality"), 0, 1), block.ints("rn") == 1
    start = (block.position == 0) & (carried is None)
    own = ~block.mask("halo")
    own_first = own & (block.lag(own.astype("float64"), 0.0) == 0)
    row = np.arange(block.rows)
    own_position = np.where(own, row - np.maximum.accumulate(np.where(own_first, row, 0)), 0)

    away, scale = _gap_and_scale(price, start, block.position, past["reference"], past["scale"])
    reference = price + away
    volume_reference = _faded(volume, VOLUME_ALPHA, start, block.position, FRESH["volume_reference"], past["volume_reference"])
    gap = np.where(start, 1.0, np.maximum(0.0, at - block.lag(at, past["event_time"])))
    dt = np.maximum(DT_FLOOR, gap) + EPSILON

    level = -away / np.maximum(scale, EPSILON)
    prev_level = block.lag(level, past["level"])
    free = (level - prev_level) / dt
    velocity = np.clip(free, -VELOCITY_BOUND, VELOCITY_BOUND)
    clipped = (np.abs(free) > VELOCITY_BOUND).astype("int64")
    prev_velocity = block.lag(velocity, past["velocity"])
    free = (velocity - prev_velocity) / dt
    acceleration = np.clip(free, -ACCELERATION_BOUND, ACCELERATION_BOUND)
    clipped += np.abs(free) > ACCELERATION_BOUND
    free = acceleration / (1.0 + velocity * velocity) ** 1.5
    curvature = np.clip(free, -CURVATURE_BOUND, CURVATURE_BOUND)
    clipped += np.abs(free) > CURVATURE_BOUND

    residual = level - (prev_level + prev_velocity * gap)
    innovation = np.sqrt(residual * residual / np.maximum(gap + EPSILON, EPSILON))
    influence = np.clip(
        np.log1p(volume / np.maximum(volume_reference, EPSILON)) + np.log1p(np.maximum(volume, 0.0)) / 10.0,
        0.0,
        VOLUME_INFLUENCE_MAX,
    )

    q = np.clip(innovation / (1.0 + innovation), 0.0, 1.0)
    multiplier = np.clip(1.0 + q * (MULTIPLIER[1] - 1.0), *MULTIPLIER)
    state = _sign(prev_level)
    state = np.where(state == 0, _sign(prev_velocity), state)
    evidence = _sign(residual)
    evidence = np.where(evidence == 0, _sign(velocity - prev_velocity), evidence)
    against = evidence == -state
    kind = np.where(against, np.where(_sign(velocity) == -state, 3, 2), 1)
    kind = np.where((state == 0) | (evidence == 0), 4, kind)
    kind = np.where(q <= np.sqrt(EPSILON), 0, kind)
    kind = np.where(quality < QUALITY_FLOOR, 4, kind)
    adverse = kind >= 2

    channels = {"displacement": level, "velocity": velocity, "acceleration": acceleration, "volume": influence}
    signed = sum(CHANNELS[name] * v for name, v in channels.items())
    weight = sum(CHANNELS[name] * np.abs(v) for name, v in channels.items())
    coherence = np.where(weight <= EPSILON, 0.0, np.clip(np.abs(signed) / (weight + EPSILON), 0.0, 1.0))

    uncertainty = _sigmoid(
        UNCERTAINTY["innovation"] * innovation
        + UNCERTAINTY["incoherence"] * (1.0 - coherence)
        + UNCERTAINTY["unknown"] * (kind == 4)
        + UNCERTAINTY["data_quality"] * (1.0 - quality)
        + UNCERTAINTY["instability"] * np.minimum(1.0, np.abs(residual))
        - 1.0
    )
    strength = _sigmoid(
        STRENGTH["bias"]
        + STRENGTH["mass"] * influence
        + STRENGTH["velocity"] * np.abs(velocity)
        + STRENGTH["acceleration"] * np.abs(acceleration)
        + STRENGTH["coherence"] * coherence
        - STRENGTH["uncertainty"] * block.lag(uncertainty, past["uncertainty"])
    )
    penalty = np.minimum(1.0, np.abs(acceleration) / (1.0 + np.abs(acceleration)))
    agreement = np.clip((velocity * prev_velocity >= 0.0) - penalty * 0.25 - np.where(adverse, 0.4, 0.0), 0.0, 1.0)
    persistence = _faded(agreement, PERSISTENCE_ALPHA, start, block.position, FRESH["persistence"], past["persistence"])
    reversal = _sigmoid(
        REVERSAL["oppose"] * (velocity * acceleration < 0.0)
        + REVERSAL["contradict"] * adverse
        + REVERSAL["low_persistence"] * (1.0 - persistence)
        + REVERSAL["extreme"] * np.minimum(1.0, np.abs(level) / 4.0)
        + REVERSAL["uncertainty"] * uncertainty
        - 1.2
    )

    step = np.clip(1.0 + persistence * strength * 0.2, *REINFORCE) * np.clip(1.0 - uncertainty * 0.35, *CONTRADICT)
    step = np.where(adverse, step * 0.75, step)
    half = _composed_products(step, own_position, HALF_LIFE[1], HALF_LIFE[2])
    eta = LEARNING[0] * np.maximum(0.2, 1.0 - uncertainty) * np.maximum(0.5, strength) * multiplier
    rate = _composed_sums(np.clip(eta, LEARNING[1], LEARNING[2]) * (strength - uncertainty) * 0.1, own_position, RATE[1], RATE[2])

    return {
        "reference": reference,
        "scale": scale,
        "volume_reference": volume_reference,
        "level": level,
        "velocity": velocity,
        "acceleration": acceleration,
        "curvature": curvature,
        "residual": residual,
        "innovation": innovation,
        "volume_influence": influence,
        "perturbation_magnitude": q,
        "perturbation_multiplier": multiplier,
        "coherence": coherence,
        "strength": strength,
        "persistence": persistence,
        "uncertainty": uncertainty,
        "reversal": reversal,
        "half_gain": half[0],
        "half_lo": half[1],
        "half_hi": half[2],
        "rate_shift": rate[0],
        "rate_lo": rate[1],
        "rate_hi": rate[2],
        "rate_min": rate[3],
        "rate_max": rate[4],
        "perturbation_class": np.array(CLASSES, dtype=object)[kind],
        "clipped": clipped,
        "data_gap": ~true_first & (gap > GAP_SECONDS),
    }


# --- Spark side ---------------------------------------------------------------


def adaptive_observations(bars: DataFrame, extra: list[str] | None = None) -> DataFrame:
    return bars.select(
        *(extra or []),
        "symbol",
        "interval_start",
        "source_timestamp",
        "market_snapshot_id",
        (F.unix_micros("interval_start") / F.lit(1e6)).alias("event_time"),
        F.col("close").alias("price"),
        F.col("volume").cast("double").alias("v_raw"),
        F.when(S.model_eligible(), 1.0).otherwise(0.0).alias("source_quality"),
    )


def takeable() -> Column:
    return S.finite("price") & S.finite("v_raw") & F.col("interval_start").isNotNull()


def admission(obs: DataFrame, order: str, layout: G.Layout | None = None) -> DataFrame:
    """``skip_reason`` for observations in any order: time must increase along ``order``.

    Only readable rows later than all accepted before them are taken; the last accepted time thus is a running maximum.
    """
    layout = (layout or G.Layout.of(["symbol"])).along(["symbol"], order)
    laid = G.lay_out(obs, layout, 0).filter(~F.col("halo"))
    laid = G.carry_max(laid, layout, "_last", F.when(takeable(), F.col("interval_start")), inclusive=False)
    late = F.col("_last").isNotNull() & (F.col("interval_start") <= F.col("_last"))
    return laid.withColumn("skip_reason", F.when(~takeable(), "INVALID_INPUT").when(late, "DUPLICATE_OR_REGRESSION")).drop("_last", "_k", "seg", "halo", "rn")


def _path(tau: Column) -> Column:
    """Projected displacement from the current level after ``tau``."""
    level, v, a = F.col("level"), F.col("velocity"), F.col("acceleration")
    return (level + v * tau + F.lit(0.5) * a * tau * tau) - level


def sample_fractions() -> list[float]:
    return [float((i / SAMPLES) ** SAMPLE_EXPONENT) for i in range(1, SAMPLES + 1)]


def with_return_shape(df: DataFrame) -> DataFrame:
    p, s, u, q = (F.col(c) for c in ("persistence", "strength", "uncertainty", "perturbation_magnitude"))
    length = (
        F.lit(INTERVAL[0]) * (F.lit(0.7) + F.lit(0.6) * p) * (F.lit(0.7) + F.lit(0.6) * s)
        * (F.lit(1.1) - F.lit(0.8) * u) * (F.lit(1.0) - F.lit(0.35) * q)
    )
    df = df.withColumn("forward_interval", S.clamp(length, INTERVAL[1], INTERVAL[2]))
    moves = [F.abs(_path(F.col("forward_interval") * F.lit(f))) for f in sample_fractions()]
    df = df.withColumns(
        {
            "terminal_displacement": _path(F.col("forward_interval") * F.lit(1.0)),
            "max_displacement": F.greatest(*moves),
            "state_support_ratio": (s * p) / F.greatest(F.lit(EPSILON), u + F.col("reversal")),
        }
    )
    term = F.col("terminal_displacement")
    return df.withColumn(
        "path_direction", F.when(term > 0, "UPWARD").when(term < 0, "DOWNWARD").otherwise("FLAT")
    )


def with_capturability(df: DataFrame, evaluated_at: Column | None = None, market_eligible: Column | None = None) -> DataFrame:
    """Quality factors, hard eligibility and the score C."""
    evaluated_at = evaluated_at if evaluated_at is not None else F.col("event_time")
    current = evaluated_at <= F.col("event_time") + F.col("forward_interval")
    open_market = F.coalesce(market_eligible, F.lit(True)) if market_eligible is not None else F.lit(True)
    flat = F.col("max_displacement") == 0
    df = df.withColumns(
        {
            "h": F.when(current & open_market, 1).otherwise(0),
            "q_g": F.when(flat, 0.0).otherwise(F.abs("terminal_displacement") / F.col("max_displacement")),
            "q_s": F.pow(F.col("strength") * F.col("coherence") * F.col("persistence"), F.lit(1.0 / 3.0)),
            "q_r": F.sqrt((F.lit(1.0) - F.col("uncertainty")) * (F.lit(1.0) - F.col("reversal"))),
            "capture_reasons": F.array_sort(
                S.unique_in_order(
                    F.when(flat, "ZERO_GEOMETRY"),
                    F.when(F.col("uncertainty") > 0.5, "UNCERTAINTY_HIGH"),
                    F.when(F.col("reversal") > 0.5, "REVERSAL_PROPENSITY_HIGH"),
                    F.when(~current, "SHAPE_STALE"),
                    F.when(~open_market, "MARKET_INELIGIBLE"),
                )
            ),
        }
    )
    return df.withColumn("c", F.col("h") * (F.col("q_g") * F.col("q_s") * F.col("q_r")))


def score_checks(df: DataFrame) -> Column:
    """True where every score is finite and inside its domain."""
    ok = F.col("h").isin(0, 1) & F.col("c").between(0.0, 1.0)
    for name in ("c", "q_g", "q_s", "q_r", "strength", "coherence", "persistence", "uncertainty", "reversal", "state_support_ratio"):
        ok = ok & S.finite(name)
    return ok


def with_context(df: DataFrame, layout: G.Layout) -> DataFrame:
    """Statistics over the previous 15 completed rows, current row excluded."""
    w = layout.window
    prior = w.rowsBetween(-CONTEXT, -1)
    direction = F.col("path_direction")
    df = df.withColumns(
        {
            "_c15": F.sort_array(F.collect_list("c").over(prior)),
            "prior_c": F.lag("c").over(w),
            "up_count": F.count_if(direction == "UPWARD").over(prior),
            "down_count": F.count_if(direction == "DOWNWARD").over(prior),
            "flat_count": F.count_if(direction == "FLAT").over(prior),
        }
    )
    full = F.size("_c15") == CONTEXT
    return df.withColumns(
        {
            "prior_median_c": F.when(full, F.get("_c15", F.lit(CONTEXT // 2))),
            "prior_min_c": F.when(full, F.get("_c15", F.lit(0))),
            "prior_max_c": F.when(full, F.get("_c15", F.lit(CONTEXT - 1))),
            "prior_range_c": F.when(full, F.get("_c15", F.lit(CONTEXT - 1)) - F.get("_c15", F.lit(0))),
            "delta_c": F.col("c") - F.col("prior_c"),
            "direction_balance": F.col("up_count") - F.col("down_count"),
        }
    ).drop("_c15")


def decide() -> Column:
    good = (F.col("h") == 1) & (F.col("c") >= F.col("prior_median_c"))
    up, down = F.col("up_count"), F.col("down_count")
    return (
        F.when((F.col("path_direction") == "UPWARD") & good & (up >= down), "BUY")
        .when((F.col("path_direction") == "DOWNWARD") & good & (down >= up), "SELL")
        .otherwise("HOLD")
    )


def rule_path(side: Column) -> Column:
    return F.when(side == "BUY", RULES["BUY"]).when(side == "SELL", RULES["SELL"]).when(side == "HOLD", RULES["HOLD"])


def _segment_ends(df: DataFrame, layout: G.Layout) -> DataFrame:
    """One row per segment: its composed steps, flags and last traded side."""
    final = F.max_by(
        F.struct("half_gain", "half_lo", "half_hi", "rate_shift", "rate_lo", "rate_hi", "rate_min", "rate_max"), "rn"
    )
    traded = F.when(F.col("side").isin("BUY", "SELL"), F.col("rn"))
    return (
        df.groupBy(*layout.groups)
        .agg(
            final.alias("_f"),
            F.bool_or("data_gap").alias("gap"),
            (F.sum("clipped") > 0).alias("clip"),
            F.max_by("side", traded).alias("last_side"),
        )
        .select(*layout.groups, "_f.*", "gap", "clip", "last_side")
    )


def _segment_starts(ends: DataFrame, layout: G.Layout) -> DataFrame:
    """Starting half-life, rate, flags and side of every segment.

    A streaming pass over one summary row per segment; the state is five scalars.
    """
    schema = T.StructType(
        [ends.schema[k] for k in layout.groups]
        + [T.StructField(n, T.DoubleType()) for n in ("half0", "rate0")]
        + [T.StructField(n, T.BooleanType()) for n in ("gap0", "clip0", "hit0")]
        + [T.StructField("side0", T.StringType())]
    )
    names = schema.fieldNames()
    fresh = (HALF_LIFE[0], RATE[0], False, False, False, None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, fresh
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                if row["_k"] != key:
                    key, state = row["_k"], fresh
                half, rate, gap, clip, hit, side = state
                out.append((key, row["seg"], *state))
                left = rate + row["rate_min"] < RATE[1] or rate + row["rate_max"] > RATE[2]
                state = (
                    min(row["half_hi"], max(row["half_lo"], row["half_gain"] * half)),
                    min(row["rate_hi"], max(row["rate_lo"], rate + row["rate_shift"])),
                    gap or bool(row["gap"]),
                    clip or bool(row["clip"]),
                    hit or left,
                    row["last_side"] or side,
                )
            yield pd.DataFrame(out, columns=names)

    return ends.repartition("_k").sortWithinPartitions(*layout.groups).mapInPandas(run, schema)


def adaptive_steps(bars: DataFrame, layout: G.Layout | None = None) -> tuple[DataFrame, G.Layout]:
    """Model state per accepted bar, before the cross-segment values are joined.

    Rows marked ``halo`` are the 15 context rows in front of a segment.
    """
    layout = layout or G.Layout.of(["symbol"])
    obs = adaptive_observations(bars, [k for k in layout.keys if k != "symbol"])
    # The model takes readable rows, the first of each time: stepped in the order of their times, a repeated one is the
    # only one that fails to increase.
    laid = G.lay_out(obs.filter(takeable()), layout, WARM_ROWS, first_of_each=True)
    stepped = run_segments(laid, layout.groups, "rn", adaptive_kernel, STATE_FIELDS)
    near = F.col("rn") > F.col("seg") * layout.rows - CONTEXT
    stepped = stepped.filter(~F.col("halo") | near)
    return with_capturability(with_return_shape(stepped)), layout


def decisions(bars: DataFrame, layout: G.Layout | None = None) -> DataFrame:
    """One decision or initializing skip per accepted bar."""
    steps, layout = adaptive_steps(bars, layout)
    df = with_context(steps, layout).filter(~F.col("halo"))
    warm = F.col("rn") > CONTEXT
    df = df.withColumns({"side": F.when(warm, decide()), "valid": score_checks(df)}).drop("halo")
    df = stage(df)
    starts = _segment_starts(_segment_ends(df, layout), layout)
    df = df.join(starts, layout.groups)
    w = layout.window
    run = G.so_far(w)
    traded = F.when(F.col("side").isin("BUY", "SELL"), F.col("side"))
    df = df.withColumns(
        {
            "forward_half_life": F.least("half_hi", F.greatest(F.col("half_lo"), F.col("half_gain") * F.col("half0"))),
            "ref_alpha": F.least("rate_hi", F.greatest(F.col("rate_lo"), F.col("rate0") + F.col("rate_shift"))),
            "_gap": F.col("gap0") | F.bool_or("data_gap").over(run),
            "_clip": F.col("clip0") | (F.sum("clipped").over(run) > 0),
            "_hit": F.col("hit0")
            | (F.col("rate0") + F.col("rate_min") < RATE[1])
            | (F.col("rate0") + F.col("rate_max") > RATE[2]),
            "_side": F.coalesce(F.last(traded, ignorenulls=True).over(run), F.col("side0")),
        }
    )
    df = df.withColumns(
        {
            "observation_half_life": F.col("forward_half_life"),
            "model_health": F.when(~F.col("valid"), "INVALID")
            .when(F.col("_gap"), "DEGRADED_DATA")
            .when(F.col("_clip") | F.col("_hit"), "DEGRADED_NUMERICAL")
            .when(F.col("perturbation_magnitude") > 0.7, "PERTURBED")
            .otherwise("HEALTHY"),
            "terminal_decay": F.pow(F.lit(2.0), -F.col("forward_interval") / F.col("forward_half_life")),
            "emitter_position": F.when(F.col("side").isNull(), None)
            .when(F.col("_side") == "BUY", "LONG")
            .when(F.col("_side") == "SELL", "SHORT")
            .otherwise("FLAT"),
            "rule_path": rule_path(F.col("side")),
            "model_status": F.when(F.col("side").isNull(), "INITIALIZING").otherwise("ACTIONABLE"),
            "skip_reason": F.when(F.col("side").isNull(), "INITIALIZING"),
            "skip_detail": F.when(F.col("side").isNull(), F.concat(F.col("rn"), F.lit(f"/{CONTEXT + 1}"))),
            "accepted_sequence": F.col("rn") - 1,
            "event_id": F.concat(F.col("symbol"), F.lit(":evt:"), F.col("rn")),
            "signal_id": F.concat(F.col("symbol"), F.lit(":sig:"), F.col("rn")),
            "decision_id": F.when(F.col("side").isNotNull(), F.concat(F.col("symbol"), F.lit(":dec:"), F.col("rn"))),
            "model_version": F.lit("0.2"),
        }
    ).drop("_gap", "_clip", "_hit", "_side", "half0", "rate0", "gap0", "clip0", "hit0", "side0")
    return df.withColumn("state_hash", state_hash())


HASHED = (
    "acceleration curvature forward_half_life level observation_half_life persistence reversal strength uncertainty velocity"
).split()


def state_hash() -> Column:
    """Upper-hex SHA-256 over the ten state numbers; comparable within one run only."""
    text = F.to_json(F.struct(*[F.col(n).alias("reversal_propensity" if n == "reversal" else n) for n in HASHED]))
    return F.upper(F.sha2(text, 256))


def forward_samples(df: DataFrame) -> DataFrame:
    """The eight projected points of every decision row, one row each."""
    points = F.array(*[F.struct(F.lit(i + 1).alias("i"), F.lit(f).alias("f")) for i, f in enumerate(sample_fractions())])
    tau = F.col("p.f") * F.col("forward_interval")
    decay = F.pow(F.lit(2.0), -tau / F.greatest(F.lit(EPSILON), F.col("forward_half_life")))
    return (
        df.withColumn("p", F.explode(points))
        .withColumn("decay", decay)
        .select(
            "symbol",
            "interval_start",
            F.col("p.i").alias("sample"),
            tau.alias("tau"),
            (F.col("level") + _path(tau)).alias("sample_level"),
            (F.col("velocity") * F.col("decay")).alias("sample_velocity"),
            S.clamp(F.col("uncertainty") + (1.0 - F.col("decay")) * 0.15, 0.0, 1.0).alias("sample_uncertainty"),
            S.clamp(F.col("strength") * F.col("decay"), 0.0, 1.0).alias("sample_strength"),
            S.clamp(F.col("persistence") * F.col("decay"), 0.0, 1.0).alias("sample_persistence"),
            S.clamp(F.col("reversal") + (1.0 - F.col("decay")) * 0.1, 0.0, 1.0).alias("sample_reversal"),
        )
    )
