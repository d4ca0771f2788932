"""Canonical bar schema and the label sets every operator shares."""

from __future__ import annotations

from pyspark.sql import types as T

BAR = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("instrument_id", T.StringType()),
        T.StructField("instrument_type", T.StringType()),
        T.StructField("tradable", T.BooleanType()),
        T.StructField("interval", T.StringType()),
        T.StructField("interval_start", T.TimestampType()),
        T.StructField("interval_end", T.TimestampType()),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("volume", T.LongType()),
        T.StructField("event_count", T.LongType()),
        T.StructField("source_timestamp", T.StringType()),
        T.StructField("receipt_time", T.TimestampType()),
        T.StructField("source", T.StringType()),
        T.StructField("quality_status", T.StringType()),
        T.StructField("is_final", T.BooleanType()),
        T.StructField("is_backfilled", T.BooleanType()),
        T.StructField("source_transition", T.BooleanType()),
        T.StructField("market_snapshot_id", T.StringType()),
    ]
)
BAR_COLUMNS = [f.name for f in BAR.fields]

# Label sets, in their wire-number order (position + 1 is the code).
LABELS: dict[str, list[str]] = {
    "instrument_type": ["STOCK", "ETF", "INDEX"],
    "quality_status": ["COMPLETE", "DEGRADED", "STALE", "PARTIAL", "RECONSTRUCTED", "INVALID"],
    "feed_state": ["HEALTHY", "DEGRADED", "FAILED", "RECOVERING"],
    "component_state": ["HEALTHY", "DEGRADED", "UNAVAILABLE"],
    "side": ["BUY", "SELL", "HOLD"],
    "path_direction": ["UPWARD", "DOWNWARD", "FLAT"],
    "emitter_position": ["FLAT", "LONG", "SHORT"],
    "model_status": ["INITIALIZING", "ACTIONABLE"],
    "skip_reason": [
        "INFER_OFF",
        "NOT_MODEL_ELIGIBLE",
        "INITIALIZING",
        "DUPLICATE_OR_REGRESSION",
        "INPUT_GAP",
        "QUEUE_OVERFLOW",
        "TIMEOUT",
        "INVALID_INPUT",
        "ENGINE_ERROR",
        "ENGINE_PANIC",
        "STATE_DISCONTINUOUS",
    ],
    "pricing_status": [
        "WARMUP_DERIVATIVE",
        "WARMUP_F4",
        "F4_FIT_UNAVAILABLE",
        "EMITTED",
        "RK45_FAILURE",
    ],
    "pricing_skip_reason": [
        "WARMUP_DERIVATIVE",
        "WARMUP_F4",
        "F4_FIT_UNAVAILABLE",
        "PROJECTION_FAILURE",
        "NUMERICALLY_UNSTABLE",
        "INVALID_INPUT",
        "TIMEOUT",
        "ENGINE_ERROR",
        "ENGINE_PANIC",
        "ANALYTIC_TIME_TERM_UNSUPPORTED",
    ],
    "volume_status": ["MATURING", "AVAILABLE", "INVALID", "ENGINE_ERROR"],
    "volume_quantity_status": ["INSUFFICIENT", "AVAILABLE", "UNDEFINED"],
    "volume_skip_reason": ["MATURING", "INVALID", "ENGINE_ERROR"],
    "volume_indicator": ["GREEN", "AMBER", "RED"],
    "volume_transition": [
        "STABLE",
        "PENDING_GREEN",
        "PENDING_AMBER",
        "PENDING_RED",
        "CONFIRMED_GREEN",
        "CONFIRMED_AMBER",
        "CONFIRMED_RED",
    ],
    "volume_phase": [
        "ACTIVITY_STATIONARY",
        "ACTIVITY_INCREASING_ACCELERATING",
        "ACTIVITY_INCREASING_DECELERATING",
        "ACTIVITY_DECREASING_ACCELERATING",
        "ACTIVITY_DECREASING_DECELERATING",
    ],
    "volume_confidence": ["HIGH"],
    "volume_domain_state": ["CAUSAL_LOCAL_VOLUME"],
}

# Stage names used by the transition stream.
STAGES: dict[str, str] = {
    "P01_MARKET_FEED": "Market Feed",
    "P02_INGESTION": "Ingestion",
    "P03_ADAPTIVE": "Adaptive Model",
    "P04_PRICE_ENGINE": "Price Engine",
}
