"""Interval bars from raw ticks, and loaders for the driver tables."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.functions import scalars as S
from candlewick.schema import BAR_COLUMNS
from candlewick.session import prepare


def with_bar_fields(
    df: DataFrame,
    *,
    source: str,
    interval: str = "1 minute",
    label: str = "1Min",
    quality: Column | None = None,
    final: Column | None = None,
    backfilled: Column | None = None,
) -> DataFrame:
    """Fill the derived bar fields; ``interval_start``/OHLCV must be present."""
    have = set(df.columns)
    defaults = {
        "instrument_id": F.col("symbol"),
        "instrument_type": S.instrument_type("symbol"),
        "tradable": S.tradable("symbol"),
        "interval": F.lit(label),
        "interval_end": F.col("interval_start") + F.expr(f"INTERVAL {interval}"),
        "event_count": F.lit(0).cast("long"),
        "source_timestamp": S.utc_text("interval_start"),
        "receipt_time": F.lit(None).cast("timestamp"),
        "source": F.lit(source),
        "quality_status": quality if quality is not None else F.lit("COMPLETE"),
        "is_final": final if final is not None else F.lit(True),
        "is_backfilled": backfilled if backfilled is not None else F.lit(False),
        "source_transition": F.lit(False),
    }
    df = df.withColumns({k: v for k, v in defaults.items() if k not in have})
    df = df.withColumn(
        "market_snapshot_id",
        S.snapshot_id(
            *(F.col(c) for c in ("symbol", "source", "source_timestamp", "open", "high", "low", "close", "volume"))
        ),
    )
    return df.select(*BAR_COLUMNS, *[c for c in df.columns if c not in BAR_COLUMNS and c in have])


_WHOLE_NUMBERS = {"bigint", "int", "smallint", "tinyint", "timestamp", "timestamp_ntz"}


def order_key(ticks: DataFrame, order: list[Column]) -> Column:
    """One comparable value for the tick order.

    One or two whole-number columns become a single number, which a hash aggregate
    can update in place; anything else is a struct and costs two sorts.
    """
    kinds = [t for _, t in ticks.select(*order).dtypes]
    if len(order) > 2 or not set(kinds) <= _WHOLE_NUMBERS:
        return F.struct(*order)
    numbers = [F.unix_micros(c.cast("timestamp")) if "timestamp" in t else c.cast("long") for c, t in zip(order, kinds)]
    if len(numbers) == 1:
        return numbers[0]
    # The factor exceeds the range of a long, so the pair keeps its order.
    return numbers[0].cast("decimal(18,0)") * F.lit(Decimal(20_000_000_000_000_000_000)) + numbers[1].cast("decimal(20,0)")


def bars_from_ticks(
    ticks: DataFrame,
    *,
    symbol: Column,
    ts: Column,
    price: Column,
    qty: Column,
    order: list[Column],
    interval: str = "1 minute",
    source: str = "CSV",
) -> DataFrame:
    """OHLCV per symbol and tumbling interval: one partial-aggregated shuffle."""
    rows = ticks.select(
        symbol.cast("string").alias("symbol"),
        ts.cast("timestamp").alias("ts"),
        price.cast("double").alias("price"),
        qty.cast("long").alias("qty"),
        order_key(ticks, order).alias("ord"),
    )
    bars = (
        rows.groupBy("symbol", F.window("ts", interval).alias("w"))
        .agg(
            F.min_by("price", "ord").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", "ord").alias("close"),
            F.sum("qty").alias("volume"),
            F.count("*").alias("event_count"),
        )
        .select("symbol", F.col("w.start").alias("interval_start"), "open", "high", "low", "close", "volume", "event_count")
    )
    return with_bar_fields(bars, source=source, interval=interval, label=interval)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def event_bars(
    spark: SparkSession, sf_dir: str, interval: str = "1 hour", symbol: str = "event_type", source: str = "CSV"
) -> DataFrame:
    """Bars over the driver's ``events`` table."""
    events = read_table(spark, sf_dir, "events")
    return bars_from_ticks(
        events,
        symbol=F.col(symbol),
        ts=F.col("ts"),
        price=F.col("value"),
        qty=F.get_json_object("props", "$.k"),
        order=[F.col("ts"), F.col("event_id")],
        interval=interval,
        source=source,
    )


def shipment_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars per supplier over ``lineitem`` (unit price, shipped quantity)."""
    items = read_table(spark, sf_dir, "lineitem")
    return bars_from_ticks(
        items,
        symbol=F.col("l_suppkey"),
        ts=F.col("l_shipdate"),
        price=F.col("l_extendedprice") / F.col("l_quantity"),
        qty=F.col("l_quantity"),
        order=[F.col("l_orderkey"), F.col("l_linenumber")],  # one day per bar, so the date adds nothing
        interval="1 day",
    )
