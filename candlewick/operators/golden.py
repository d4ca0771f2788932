"""Comparing computed rows with recorded ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.functions import scalars as S


def _joined(got: DataFrame, want: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    g = got.select(*keys, F.lit(True).alias("_g"), *[F.col(f).alias(f"_g_{f}") for f in fields])
    w = want.select(*keys, F.lit(True).alias("_w"), *[F.col(f).alias(f"_w_{f}") for f in fields])
    return g.join(w, keys, "full_outer")


def numeric_diff(got: DataFrame, want: DataFrame, keys: list[str], tolerances: dict[str, float]) -> DataFrame:
    """Per field: compared, exact, outside tolerance, largest and mean differences, readiness mismatches.

    One full outer join, one unpivot, one aggregation; rows present on one side
    only count as unmatched.
    """
    both = _joined(got, want, keys, list(tolerances))
    cells = F.array(
        *[
            F.struct(F.lit(f).alias("field"), F.col(f"_g_{f}").cast("double").alias("g"), F.col(f"_w_{f}").cast("double").alias("w"), F.lit(t).alias("tol"))
            for f, t in tolerances.items()
        ]
    )
    long = both.select("_g", "_w", F.inline(cells))
    matched = F.col("_g") & F.col("_w")
    ready = matched & F.col("g").isNotNull() & F.col("w").isNotNull()
    gap = F.abs(F.col("g") - F.col("w"))
    long = long.withColumns(
        {
            "ready": F.coalesce(ready, F.lit(False)),
            "gap": F.when(ready, gap),
            "rel": F.when(ready & (F.col("w") != 0), gap / F.abs("w")),
            "ok": S.within_tolerance(F.col("g"), F.col("w"), F.col("tol"), ulps=0),
        }
    )
    return long.groupBy("field").agg(
        F.count_if("ready").alias("compared"),
        F.count_if(F.col("ready") & (F.col("gap") == 0)).alias("exact"),
        F.count_if(F.col("ready") & ~F.col("ok")).alias("outside"),
        F.max("gap").alias("max_abs"),
        F.max("rel").alias("max_rel"),
        F.avg("gap").alias("mean_abs"),
        F.count_if(F.coalesce(matched, F.lit(False)) & (F.col("g").isNull() != F.col("w").isNull())).alias("readiness_mismatch"),
        F.count_if(~F.coalesce(matched, F.lit(False))).alias("unmatched"),
    )


def category_diff(got: DataFrame, want: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Per field: equal labels out of all matched rows."""
    both = _joined(got, want, keys, fields).filter(F.col("_g") & F.col("_w"))
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_g_{f}").eqNullSafe(F.col(f"_w_{f}")).alias("same")) for f in fields])
    return both.select(F.inline(cells)).groupBy("field").agg(F.count_if("same").alias("exact"), F.count("*").alias("total"))


def category_mismatches(got: DataFrame, want: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    both = _joined(got, want, keys, fields).filter(F.col("_g") & F.col("_w"))
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_g_{f}").cast("string").alias("got"), F.col(f"_w_{f}").cast("string").alias("want")) for f in fields])
    return both.select(*keys, F.inline(cells)).filter(~F.col("got").eqNullSafe(F.col("want")))


def near_threshold(df: DataFrame, keys: list[str], value: str, thresholds: list[float], band: float) -> DataFrame:
    """Rows whose value lies within ``band`` of a decision threshold."""
    close = [F.when(F.abs(F.col(value) - t) <= band, F.lit(float(t))) for t in thresholds]
    return df.select(*keys, value, F.coalesce(*close).alias("threshold")).filter(F.col("threshold").isNotNull())
