"""Row-wise column functions.  Everything here stays inside codegen."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewick.schema import LABELS, STAGES

FRESHNESS_SECONDS = 90
LIVE_SOURCES = ("ALPACA_IEX", "ALPACA_TEST")


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def finite(value: Column | str) -> Column:
    """True for an ordinary number; NULL, NaN and infinities are not finite."""
    v = _c(value)
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))


def finite_or_null(value: Column | str) -> Column:
    return F.when(finite(value), _c(value))


def clamp(value: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(value, F.lit(lo)), F.lit(hi))


def sigmoid(value: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-value))


def snapshot_id(
    symbol: Column, source: Column, source_ts: Column, o: Column, h: Column, l: Column, c: Column, volume: Column
) -> Column:
    return F.sha2(
        F.format_string("%s|%s|%s|%.8f|%.8f|%.8f|%.8f|%d", symbol, source, source_ts, o, h, l, c, volume), 256
    )


def utc_text(ts: Column | str) -> Column:
    """RFC 3339 text in UTC with trailing fraction zeros removed."""
    t = _c(ts)
    whole = F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.pmod(F.unix_micros(t), F.lit(1_000_000))
    fraction = F.rtrim(F.lit("0"), F.lpad(micros.cast("string"), 6, "0"))
    return F.when(t.isNull(), F.lit("N/A")).otherwise(
        F.concat(whole, F.when(micros > 0, F.concat(F.lit("."), fraction)).otherwise(F.lit("")), F.lit("Z"))
    )


def dedup_key(symbol: Column | str, interval_start: Column | str) -> Column:
    return F.concat_ws("|", _c(symbol), utc_text(interval_start))


def data_age(interval_start: Column | str, as_of: Column) -> Column:
    """Seconds from interval start to ``as_of``; 0 where the start is absent."""
    return F.coalesce(
        (F.unix_micros(as_of) - F.unix_micros(_c(interval_start))) / F.lit(1_000_000.0), F.lit(0.0)
    )


def instrument_type(symbol: Column | str) -> Column:
    return F.when(F.coalesce(_c(symbol), F.lit("")) != "", F.lit("STOCK"))


def tradable(symbol: Column | str) -> Column:
    return F.coalesce(_c(symbol), F.lit("")) != ""


def valid_ohlc(o: Column, h: Column, l: Column, c: Column) -> Column:
    positive = F.lit(True)
    for v in (o, h, l, c):
        positive = positive & v.isNotNull() & ~F.isnan(v) & (v > 0)
    ordered = (h >= l) & (h >= o) & (h >= c) & (l <= o) & (l <= c)
    return F.coalesce(positive & ordered, F.lit(False))


def quality_of(message_type: Column, backfilled: Column) -> Column:
    return (
        F.when(backfilled, F.lit("RECONSTRUCTED"))
        .when(message_type == "u", F.lit("PARTIAL"))
        .otherwise(F.lit("COMPLETE"))
    )


def final_of(message_type: Column, backfilled: Column) -> Column:
    return F.coalesce(backfilled | (message_type != "u"), F.lit(True))


def parse_volume(text: Column | str) -> Column:
    """Whole number, else a non-negative decimal truncated; NULL means unreadable."""
    t = _c(text)
    whole = F.when(t.rlike(r"^[+-]?[0-9]+$"), t.try_cast("long"))
    decimal = t.try_cast("double")
    return (
        F.when(t == "", F.lit(0).cast("long"))
        .when(whole >= 0, whole)
        .when(whole.isNull() & (decimal >= 0) & (decimal < F.lit(9.2e18)), F.floor(decimal).cast("long"))
    )


def parse_time(text: Column | str, allow_local_t: bool = False) -> Column:
    """RFC 3339 with offset, or ``yyyy-MM-dd HH:mm:ss`` read as UTC."""
    t = F.trim(_c(text))
    rfc = F.when(
        t.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"),
        # Spark keeps microseconds: drop any finer digits before parsing.
        F.regexp_replace(t, r"(\.\d{6})\d+", "$1").try_cast("timestamp"),
    )
    plain = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"), t.try_cast("timestamp"))
    if not allow_local_t:
        return F.coalesce(rfc, plain)
    local = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$"), t.try_cast("timestamp"))
    return F.coalesce(rfc, plain, local)


def minute_aligned(ts: Column | str) -> Column:
    return F.coalesce(F.pmod(F.unix_micros(_c(ts)), F.lit(60_000_000)) == 0, F.lit(False))


def model_eligible() -> Column:
    return F.coalesce(
        F.col("is_final") & (F.col("quality_status") == "COMPLETE") & ~F.col("is_backfilled"), F.lit(False)
    )


def live_fresh(as_of: Column, lateness_seconds: int = FRESHNESS_SECONDS) -> Column:
    late = F.unix_micros(as_of) - F.unix_micros("interval_end")
    return (
        F.when(~F.coalesce(F.col("source").isin(*LIVE_SOURCES), F.lit(False)), F.lit(True))
        .when(F.col("interval_end").isNull(), F.lit(False))
        .otherwise(late <= F.lit(lateness_seconds * 1_000_000))
    )


def normalize_symbol(text: Column | str) -> Column:
    t = F.upper(F.trim(_c(text)))
    return F.when(t != "", t)


def symbol_filter(df: DataFrame, symbols: Sequence[str] | None, column: str = "symbol", stored: Callable[[str], str] = str.upper) -> DataFrame:
    """Keep the requested symbols; an empty request keeps everything.

    ``stored`` is the form in which symbols were normalised at ingest.  The request is brought to it, so the
    bare column is compared and the filter reaches the scan.
    """
    wanted = list(dict.fromkeys(stored(s.strip()) for s in (symbols or [])))
    if "" in wanted:
        raise ValueError("symbol must be non-empty")
    return df.filter(F.col(column).isin(*wanted)) if wanted else df


def split_symbols(text: Column | str) -> Column:
    """Comma list -> ordered distinct upper-case symbols."""
    parts = F.transform(F.split(_c(text), ","), lambda s: F.upper(F.trim(s)))
    return F.array_distinct(F.filter(parts, lambda s: s != ""))


def to_unix_ms(ts: Column | str) -> Column:
    return F.coalesce(F.unix_millis(_c(ts)), F.lit(0).cast("long"))


def from_unix_ms(ms: Column | str) -> Column:
    return F.when(_c(ms) > 0, F.timestamp_millis(_c(ms)))


def quantity(value: Column, status: Column) -> Column:
    """Value+status pair; the value shows only when AVAILABLE."""
    return F.struct(F.when(status == "AVAILABLE", value).alias("value"), status.alias("status"))


def quantity_text(value: Column, status: Column) -> Column:
    return (
        F.when(status == "AVAILABLE", value.cast("string"))
        .when(status.isin("UNDEFINED", "INSUFFICIENT"), status)
        .otherwise(F.lit("UNAVAILABLE"))
    )


def direction3(value: Column, epsilon: float) -> Column:
    return F.when(value > epsilon, "UP").when(value < -epsilon, "DOWN").otherwise("NEAR_ZERO")


def accel_sign(value: Column) -> Column:
    return F.when(value > 0, "POSITIVE").when(value < 0, "NEGATIVE").otherwise("ZERO")


def unique_in_order(*items: Column) -> Column:
    """Array of the non-NULL items, first occurrence kept."""
    return F.array_distinct(F.array_compact(F.array(*items)))


def join_pipe(items: Column) -> Column:
    return F.array_join(items, "|")


def enum_code(label: Column | str, family: str) -> Column:
    """Wire number of a label, 0 for anything unknown."""
    pairs = [F.lit(x) for i, name in enumerate(LABELS[family], start=1) for x in (name, i)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), _c(label)), F.lit(0))


def stage_name(stage_id: Column | str) -> Column:
    pairs = [F.lit(x) for kv in STAGES.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), _c(stage_id)), _c(stage_id))


def same_initiating_bar(left: str, right: str) -> Column:
    """Join condition: both sides were caused by the same published bar."""
    same = F.lit(True)
    for name in ("symbol", "market_snapshot_id", "interval_start"):
        same = same & (F.col(f"{left}.{name}") == F.col(f"{right}.{name}"))
    return same


def outcome_kind(decision: Column, skip: Column) -> Column:
    return (
        F.when(decision.isNotNull() & skip.isNull(), "DECISION")
        .when(skip.isNotNull() & decision.isNull(), "SKIP")
    )


def within_tolerance(got: Column, want: Column, abs_tol: float, ulps: int = 16) -> Column:
    """Equal, or close in absolute terms, or within ``ulps`` representable steps.

    A step at magnitude m is at least m * 2^-53, so the relative form below
    never accepts a pair that is further apart than ``ulps`` steps.
    """
    gap = F.abs(got - want)
    step = F.greatest(F.abs(got), F.abs(want)) * F.lit(2.0**-53)
    same_sign = F.signum(got) == F.signum(want)
    return F.coalesce((got == want) | (gap <= abs_tol) | (same_sign & (gap <= step * ulps)), F.lit(False))
