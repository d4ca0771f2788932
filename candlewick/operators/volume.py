"""Volume activity: rolling median ratio, derivatives, colours and hysteresis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewick.functions import scalars as S
from candlewick.operators import segments as G

# Fixed values of the activity recipe.
RAW_WINDOW = 15
MEAN_WINDOW = 15
FIT_POINTS = 3
UPPER = 1.1
LOWER = 0.9
EPSILON = 1e-12
DOUBLE_STEP = 2.220446049250313e-16
HALO = RAW_WINDOW - 1 + MEAN_WINDOW - 1


def volume_observations(bars: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Lineage plus ``v_raw``; everything downstream reads only these columns."""
    return bars.select(
        *(extra or []),
        "symbol",
        "interval_start",
        "interval_end",
        "source_timestamp",
        "market_snapshot_id",
        F.col("volume").cast("double").alias("v_raw"),
    )


def with_activity(obs: DataFrame, layout: G.Layout) -> DataFrame:
    """Median, V_N, interval mean and V1/V2 over segmented, numbered rows."""
    w = layout.window
    last15, last3 = G.last_rows(w, RAW_WINDOW), G.last_rows(w, FIT_POINTS)
    raw = F.col("v_raw")
    usable = F.when(S.finite(raw), raw)

    obs = obs.withColumn("_win", F.sort_array(F.collect_list(usable).over(last15)))
    median = F.when((F.col("rn") >= RAW_WINDOW) & (F.size("_win") == RAW_WINDOW), F.get("_win", F.lit(7)))
    obs = obs.withColumn("median15", median).drop("_win")
    obs = obs.withColumn("v_n", S.finite_or_null(F.when(F.col("median15") > 0, raw / F.col("median15"))))

    # count() skips NULLs, so one unavailable V_N poisons the whole mean.
    obs = obs.withColumns(
        {
            "_mean_rows": F.count("v_n").over(G.last_rows(w, MEAN_WINDOW)),
            "_mean": F.avg("v_n").over(G.last_rows(w, MEAN_WINDOW)),
            "_fit_rows": F.count("v_n").over(last3),
            "_y1": F.lag("v_n", 1).over(w),
            "_y0": F.lag("v_n", 2).over(w),
            "_t1": F.lag("interval_start", 1).over(w),
            "_t0": F.lag("interval_start", 2).over(w),
        }
    )
    obs = obs.withColumn("interval_mean", S.finite_or_null(F.when(F.col("_mean_rows") == MEAN_WINDOW, F.col("_mean"))))
    minutes = lambda t: (F.unix_micros(t) - F.unix_micros("interval_start")) / F.lit(60_000_000.0)
    obs = obs.withColumns({"_tau0": minutes(F.col("_t0")), "_tau1": minutes(F.col("_t1"))})
    tau0, tau1 = F.col("_tau0"), F.col("_tau1")
    obs = obs.withColumn("_full", (tau0 < tau1) & (tau1 < 0) & full_rank(tau0, tau1))
    # Newton form of the parabola through the three points, at tau = 0.
    f01 = (F.col("_y1") - F.col("_y0")) / (tau1 - tau0)
    f12 = (F.col("v_n") - F.col("_y1")) / (-tau1)
    a = (f12 - f01) / (-tau0)
    ready = (F.col("rn") >= FIT_POINTS) & (F.col("_fit_rows") == FIT_POINTS) & F.col("_full")
    return obs.withColumns(
        {"v1": S.finite_or_null(F.when(ready, f12 - a * tau1)), "v2": S.finite_or_null(F.when(ready, a * 2.0))}
    ).drop("_y1", "_y0", "_t1", "_t0", "_tau0", "_tau1", "_mean", "_full")


def full_rank(tau0: Column, tau1: Column) -> Column:
    """Whether the parabola's design at times (tau0, tau1, 0) has three singular values above 3 * eps * the largest.

    Their squares are the roots of x^3 - e1 x^2 + e2 x - e3, whose coefficients are sums of squares (of entries, of
    minors, of the determinant) and so lose nothing to cancellation.  Near the cutoff the least root is vanishing beside
    the others: it is e3 / e2 there, and the largest solves x^2 - e1 x + e2.
    """
    s0, s1, d = tau0 * tau0, tau1 * tau1, tau1 - tau0
    e1 = F.lit(3.0) + s0 + s0 * s0 + s1 + s1 * s1
    e2 = d * d * (F.lit(1.0) + (tau0 + tau1) * (tau0 + tau1) + s0 * s1) + s0 + s0 * s0 + s1 + s1 * s1
    largest = (e1 + F.sqrt(F.greatest(e1 * e1 - 4.0 * e2, F.lit(0.0)))) / 2.0
    return F.try_divide(d * d * s0 * s1, e2) > F.lit((FIT_POINTS * DOUBLE_STEP) ** 2) * largest


def _status(value: str, first_row: int) -> Column:
    return (
        F.when(F.col("rn") < first_row, "INSUFFICIENT")
        .when(F.col(value).isNotNull(), "AVAILABLE")
        .otherwise("UNDEFINED")
    )


def volume_phase(v1: Column, v2: Column) -> Column:
    return (
        F.when(v1.isNull() | v2.isNull(), None)
        .when(F.abs(v1) <= EPSILON, "ACTIVITY_STATIONARY")
        .when((v1 > 0) & (v2 > EPSILON), "ACTIVITY_INCREASING_ACCELERATING")
        .when(v1 > 0, "ACTIVITY_INCREASING_DECELERATING")
        .when(v2 < -EPSILON, "ACTIVITY_DECREASING_ACCELERATING")
        .otherwise("ACTIVITY_DECREASING_DECELERATING")
    )


def raw_color(activity: Column) -> Column:
    return (
        F.when(activity.isNull(), None)
        .when(activity >= UPPER, "GREEN")
        .when(activity <= LOWER, "RED")
        .otherwise("AMBER")
    )


def confirm_color(df: DataFrame, layout: G.Layout) -> DataFrame:
    """Two-observation hysteresis as a function of the last three valid raw colours.

    A repeated raw colour is always shown as it is.  A changed one is shown
    AMBER.  Whether the row before was itself waiting for confirmation decides
    only between the PENDING/CONFIRMED and STABLE texts, and it was waiting
    exactly when its own colour had just changed.  So no per-key loop is needed;
    ``carry_previous_two`` finds the two earlier valid rows however far back they are.
    """
    df = G.carry_previous_two(df, layout, F.col("raw_color"), "_p1", "_p2")
    return label_confirmation(df, F.col("_p1"), F.col("_p2")).drop("_p1", "_p2")


def label_confirmation(df: DataFrame, p1: Column, p2: Column) -> DataFrame:
    raw = F.col("raw_color")
    was_waiting = p1.isNotNull() & p2.isNotNull() & (p1 != p2)
    repeated = p1.isNull() | (raw == p1)
    return df.withColumns(
        {
            "indicator": F.when(raw.isNotNull(), F.when(repeated, raw).otherwise("AMBER")),
            "transition": F.when(raw.isNull(), None)
            .when(p1.isNull(), "STABLE")
            .when((raw == p1) & (raw != "AMBER") & was_waiting, F.concat(F.lit("CONFIRMED_"), raw))
            .when(raw == p1, "STABLE")
            .when((raw == "AMBER") & was_waiting, "STABLE")
            .otherwise(F.concat(F.lit("PENDING_"), raw)),
        }
    )


def volume_features(bars: DataFrame, layout: G.Layout | None = None) -> DataFrame:
    """Features, statuses, phase and raw colour for every bar.

    Extra layout keys (for example a session) restart the history.
    """
    layout = layout or G.Layout.of(["symbol"])
    extra = [k for k in layout.keys if k != "symbol"]
    obs = volume_observations(bars, extra)
    feats = with_activity(G.lay_out(obs, layout, HALO), layout).filter(~F.col("halo")).drop("halo")
    feats = feats.withColumns(
        {
            "predicted_next_vn": F.col("v_n"),
            "vn_status": _status("v_n", RAW_WINDOW),
            # Readiness of fits and means counts rows, not available values.
            "v1_status": _status("v1", FIT_POINTS),
            "v2_status": _status("v2", FIT_POINTS),
            "mean_status": _status("interval_mean", MEAN_WINDOW),
            "phase": volume_phase(F.col("v1"), F.col("v2")),
            "raw_color": raw_color(F.col("interval_mean")),
        }
    )
    all_there = (
        (F.col("vn_status") == "AVAILABLE") & (F.col("v1_status") == "AVAILABLE") & (F.col("mean_status") == "AVAILABLE")
    )
    feats = feats.withColumn(
        "reason",
        F.when(all_there, "AVAILABLE")
        .when(F.col("vn_status") == "UNDEFINED", "UNDEFINED_VN")
        .when((F.col("v1_status") == "UNDEFINED") & (F.col("_fit_rows") == FIT_POINTS), "UNDEFINED_DERIVATIVE")
        .when((F.col("mean_status") == "UNDEFINED") & (F.col("_mean_rows") == MEAN_WINDOW), "UNDEFINED_INTERVAL_MEAN")
        .otherwise("MATURING_FEATURES"),
    )
    return feats.withColumn(
        "status",
        F.when(F.col("reason") == "AVAILABLE", "AVAILABLE")
        .when(F.col("reason") == "MATURING_FEATURES", "MATURING")
        .otherwise("INVALID"),
    ).drop("_fit_rows", "_mean_rows")


def volume_events(bars: DataFrame, layout: G.Layout | None = None) -> DataFrame:
    """One volume outcome per bar: features, confirmed colour, envelope fields."""
    layout = layout or G.Layout.of(["symbol"])
    df = confirm_color(volume_features(bars, layout), layout)
    valid = F.col("raw_color").isNotNull()
    return df.withColumns(
        {
            "accepted_sequence": F.col("rn"),
            "event_id": F.concat(F.col("symbol"), F.lit(":volume:"), F.col("rn")),
            "confidence": F.when(valid, "HIGH"),
            "domain_state": F.when(valid, "CAUSAL_LOCAL_VOLUME"),
        }
    )
