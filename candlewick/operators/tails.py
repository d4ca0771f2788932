"""Catch-up reads: the latest outcome per symbol first, then everything newer."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.functions import scalars as S
from candlewick.operators.ingest import bar_window, finalized, latest_by


def tail(
    stored: DataFrame, live: DataFrame, symbols: Sequence[str] | None = None, max_events: int | None = None, form: Callable[[str], str] = str.upper
) -> DataFrame:
    """``stored`` is what existed at connection time, ``live`` what arrived since.

    A live event whose id was already sent as the latest one is not sent again.
    Columns: those of the events plus ``phase`` (0 catch-up, 1 live).
    """
    first = latest_by(S.symbol_filter(stored, symbols, stored=form), ["symbol"], "interval_start").withColumn("phase", F.lit(0))
    newer = S.symbol_filter(live, symbols, stored=form)
    newer = newer.join(first.select("event_id"), "event_id", "left_anti").select(*live.columns).withColumn("phase", F.lit(1))
    both = first.unionByName(newer)
    # A top-k request: each task keeps its own first rows before they are merged.
    return both.orderBy("phase", "interval_start", "symbol").limit(max_events) if max_events else both


def tail_bars(
    stored: DataFrame, live: DataFrame, symbols: Sequence[str] | None = None, max_bars: int | None = None, form: Callable[[str], str] = str.upper
) -> DataFrame:
    """Final bars of the stored window, oldest first, then the live ones; at most ``max_bars`` in all.

    A live bar that the window already holds is not sent again.
    """
    first = finalized(bar_window(S.symbol_filter(stored, symbols, stored=form))).withColumn("phase", F.lit(0))
    sent = first.select("symbol", "interval_start", "market_snapshot_id")
    newer = finalized(S.symbol_filter(live, symbols, stored=form)).join(sent, sent.columns, "left_anti").select(*live.columns)
    both = first.unionByName(newer.withColumn("phase", F.lit(1)))
    return both.orderBy("phase", "interval_start", "symbol").limit(max_bars) if max_bars else both
