"""Shaping results so that both engines print the same values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def r(column: str | Column, digits: int = 9, alias: str | None = None) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c, digits).alias(alias or (column if isinstance(column, str) else "value"))


def plain(df: DataFrame) -> DataFrame:
    """Zone-less timestamps, as the parquet files and the checks have them."""
    return df.select(
        *[F.col(f"`{n}`").cast("timestamp_ntz").alias(n) if t == "timestamp" else F.col(f"`{n}`") for n, t in df.dtypes]
    )


def pick(df: DataFrame, *specs: str) -> DataFrame:
    """Select by name; ``name:digits`` rounds."""
    chosen = []
    for spec in specs:
        name, _, digits = spec.partition(":")
        chosen.append(r(name, int(digits)) if digits else F.col(name))
    return plain(df.select(*chosen))
