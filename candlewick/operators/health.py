"""Per-symbol model status and component roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
ACTIONABLE_AFTER = 16
PRICE_WARMUP = 45


def symbol_status(gated: DataFrame) -> DataFrame:
    """Status per symbol after all its arrivals; ``infer`` is judged at the last one."""
    df = gated.groupBy("symbol").agg(
        F.count_if("committed").alias("accepted"),
        F.bool_or(F.col("gate").isin("INPUT_GAP", "STATE_DISCONTINUOUS")).alias("disc"),
        F.count_if((F.col("gate") == "PASS") & ~F.col("committed")).alias("errors"),
        F.max_by("infer", "arrival").alias("infer"),
        F.max_by(F.when(F.col("gate") != "PASS", F.col("gate")), F.when(F.col("gate") != "PASS", F.col("arrival"))).alias("last_skip"),
    )

    def status(warm_until: Column) -> Column:
        return (
            F.when(F.col("disc"), "discontinuous")
            .when(~F.col("infer") & (F.col("accepted") > 0), "paused")
            .when(F.col("errors") > 0, "error")
            .when(F.col("accepted") == 0, "cold")
            .when(F.col("accepted") < warm_until, "initializing")
            .otherwise("ready")
        )

    return df.select(
        "symbol",
        "accepted",
        "last_skip",
        F.concat(F.col("accepted"), F.lit(f"/{ACTIONABLE_AFTER}")).alias("warmup"),
        status(F.lit(ACTIONABLE_AFTER)).alias("status"),
        status(F.lit(PRICE_WARMUP + 1)).alias("pricing_status"),
    )


def _any(column: str, *values: str) -> Column:
    return F.coalesce(F.bool_or(F.col(column).isin(*values)), F.lit(False))


def component_health(statuses: DataFrame) -> DataFrame:
    """Model and pricing components from the symbol statuses (one row each)."""
    flags = statuses.agg(
        F.count("*").alias("n"),
        *[
            expr.alias(f"{prefix}_{name}")
            for prefix, column in (("m", "status"), ("p", "pricing_status"))
            for name, expr in (
                ("disc", _any(column, "discontinuous")),
                ("err", _any(column, "error")),
                ("init", _any(column, "initializing", "cold")),
                ("pause", _any(column, "paused")),
                ("failed", F.coalesce(F.bool_and(F.col(column).isin("error", "discontinuous")), F.lit(False))),
                ("cold", F.coalesce(F.bool_and(F.col(column).isin("cold", "off")), F.lit(False))),
            )
        ],
    )
    f = F.col
    model = (
        F.when(f("m_err") & f("m_failed"), "UNAVAILABLE:error")
        .when(f("m_disc") | f("m_err"), "DEGRADED:discontinuous")
        .when(f("m_init") | f("m_pause"), "DEGRADED:initializing")
        .otherwise("HEALTHY:adaptive")
    )
    pricing = (
        F.when(f("p_err") & f("p_failed"), "UNAVAILABLE:error")
        .when(f("p_disc") | f("p_err"), "DEGRADED:discontinuous")
        .when(f("p_cold"), "DEGRADED:cold")
        .when(f("p_pause") & ~f("p_init"), "DEGRADED:paused")
        .when(f("p_init") | f("p_pause"), "DEGRADED:initializing")
        .otherwise("HEALTHY:expm")
    )
    rows = F.array(
        F.struct(F.lit("model").alias("name"), model.alias("v")), F.struct(F.lit("pricing").alias("name"), pricing.alias("v"))
    )
    parts = flags.select(F.explode(rows).alias("r")).select("r.name", F.split("r.v", ":").alias("v"))
    return parts.select("name", F.get("v", F.lit(0)).alias("state"), F.get("v", F.lit(1)).alias("detail"))


def feed_component(feed_state: Column) -> Column:
    return (
        F.when(feed_state == "FAILED", "UNAVAILABLE")
        .when(feed_state.isin("DEGRADED", "RECOVERING"), "DEGRADED")
        .otherwise("HEALTHY")
    )


def health_report(components: DataFrame, feed_state: DataFrame) -> DataFrame:
    """Overall state: the feed's, lowered by the model; pricing can only degrade a healthy report."""
    # One aggregate over both inputs; each fills its own columns.
    empty = F.lit(None).cast("string")
    told = components.select("name", "state", "detail", F.lit(None).cast("timestamp").alias("beat"), empty.alias("feed_state"))
    beats = feed_state.select(empty.alias("name"), empty.alias("state"), empty.alias("detail"), "beat", "feed_state")
    of = lambda name, c: F.max(F.when(F.col("name") == name, F.col(c)))
    one = told.unionByName(beats).agg(
        feed_component(F.max_by("feed_state", "beat")).alias("feed"),
        of("model", "state").alias("model"), of("pricing", "state").alias("pricing"), of("pricing", "detail").alias("detail"),
    )
    after_model = (
        F.when(F.col("model") == "UNAVAILABLE", "UNAVAILABLE")
        .when((F.col("model") == "DEGRADED") & (F.col("feed") == "HEALTHY"), "DEGRADED")
        .otherwise(F.col("feed"))
    )
    pulls = (F.col("pricing") == "UNAVAILABLE") | (
        (F.col("pricing") == "DEGRADED") & F.col("detail").isin("discontinuous", "error")
    )
    return one.withColumn("after_model", after_model).select(
        "feed",
        "model",
        "pricing",
        F.when((F.col("after_model") == "HEALTHY") & pulls, "DEGRADED").otherwise(F.col("after_model")).alias("state"),
    )
