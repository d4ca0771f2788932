"""State-change events: one row whenever a stage's meaningful state differs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewick.functions import scalars as S
from candlewick.operators import segments as G

COMPARED = (
    "kind feed_state capability side skip_reason model_status emitter_position pricing_status color trajectory_phase "
    "domain_state confidence_state domain_exit"
).split()
GLOBAL = "GLOBAL"
CONTRACT = "1.1"


def state_struct(code: Column, **fields: Column) -> Column:
    """A full state; unnamed fields are empty."""
    parts = [code.alias("code")]
    for name in COMPARED:
        empty = F.lit(False) if name == "domain_exit" else F.lit(None).cast("string")
        value = fields.get(name)
        if name == "domain_exit" and value is not None:
            value = F.coalesce(value, F.lit(False))
        parts.append((value if value is not None else empty).alias(name))
    return F.struct(*parts)


def decision_state() -> Column:
    made = F.col("side").isNotNull()
    code = F.when(made, F.concat(F.lit("DECISION:"), F.col("side"))).when(
        F.col("skip_reason").isNotNull(), F.concat(F.lit("SKIP:"), F.col("skip_reason"))
    )
    return state_struct(
        code,
        kind=F.when(made, "DECISION").when(F.col("skip_reason").isNotNull(), "SKIP"),
        side=F.col("side"),
        skip_reason=F.when(~made, F.col("skip_reason")),
        model_status=F.col("model_status"),
        emitter_position=F.when(made, F.col("emitter_position")),
    )


def price_state() -> Column:
    color, skip, status = F.col("emission.color"), F.col("skip_reason"), F.col("status")
    code = (
        F.when(color.isNotNull(), F.concat(status, F.lit(":"), color))
        .when(skip.isNotNull(), F.concat(F.lit("SKIP:"), skip))
        .otherwise(status)
    )
    return state_struct(
        code,
        kind=F.lit("PRICING"),
        pricing_status=status,
        color=color,
        trajectory_phase=F.col("emission.trajectory_phase"),
        domain_state=F.col("emission.domain_state"),
        confidence_state=F.col("emission.confidence_state"),
        skip_reason=skip,
        domain_exit=F.col("domain_exit"),
    )


def feed_state_row(feed_state: Column) -> Column:
    return state_struct(feed_state, kind=F.lit("FEED"), feed_state=feed_state)


def ingest_state(capability: Column) -> Column:
    return state_struct(capability, kind=F.lit("INGESTION"), capability=capability)


def bar_struct(prefix: str = "") -> Column:
    names = "symbol market_snapshot_id interval_start interval_end open high low close volume source source_timestamp quality_status".split()
    return F.struct(*[F.col(f"{prefix}{n}").alias(n) for n in names])


def stage_events(df: DataFrame, stage: str, entity: Column, position: Column, state: Column, **columns: Column) -> DataFrame:
    """Normalise one stage's outcomes: (stage_id, entity_id, position, state, ...)."""
    defaults = {
        "effective_time": F.lit(None).cast("timestamp"),
        "market_snapshot_id": F.lit(None).cast("string"),
        "accepted_sequence": F.lit(0).cast("long"),
        "source_event_id": F.lit(None).cast("string"),
        "bar": F.lit(None).cast(
            "struct<symbol:string,market_snapshot_id:string,interval_start:timestamp,interval_end:timestamp,open:double,high:double,"
            "low:double,close:double,volume:bigint,source:string,source_timestamp:string,quality_status:string>"
        ),
        "facts": F.lit(None).cast("map<string,string>"),
    }
    return df.select(
        F.lit(stage).alias("stage_id"),
        F.coalesce(F.when(entity != "", entity), F.lit(GLOBAL)).alias("entity_id"),
        position.cast("long").alias("position"),
        state.alias("state"),
        *[columns.get(name, value).alias(name) for name, value in defaults.items()],
    )


def _compared(state: str) -> Column:
    return F.struct(*[F.col(f"{state}.{name}") for name in COMPARED])


def transitions(events: DataFrame, layout: G.Layout | None = None) -> DataFrame:
    """Keep the rows whose state differs from the previous one of the same key.

    Dropping unchanged rows never changes what "previous" means, so a lag over all
    rows is exact.  With an ``epoch`` column the first row of an epoch always
    counts and has no previous state, while the sequence numbers run on.
    """
    epochs = "epoch" in events.columns
    keys = ["stage_id", "entity_id", *(["epoch"] if epochs else [])]
    present = events.filter(F.col("state.kind").isNotNull() | F.col("state.code").isNotNull())
    layout = (layout or G.Layout.of(keys)).along(keys, "position")
    laid = G.lay_out(present, layout, 1)
    laid = laid.withColumn("previous", F.lag("state").over(layout.window)).filter(~F.col("halo")).drop("halo", "_k", "seg", "rn")
    changed = laid.filter(F.col("previous").isNull() | ~_compared("state").eqNullSafe(_compared("previous")))
    order = layout.along(["stage_id", "entity_id"], "position")
    numbered = G.number_rows(changed, order).drop("_k").withColumnRenamed("rn", "sequence")
    return numbered.withColumnRenamed("state", "current").withColumns(
        {
            "transition_id": F.concat_ws(":", "stage_id", "entity_id", F.col("sequence")),
            "stage_name": S.stage_name("stage_id"),
            "reason_code": F.coalesce(
                "current.side", "current.color", "current.skip_reason", "current.capability", "current.feed_state", "current.pricing_status"
            ),
            "contract_version": F.lit(CONTRACT),
            "effective_time": F.coalesce("effective_time", "bar.interval_start"),
        }
    )


def latest_states(changes: DataFrame) -> DataFrame:
    return changes.groupBy("stage_id", "entity_id").agg(
        F.max("sequence").alias("sequence"), F.max_by("current", "sequence").alias("current")
    )


def bar_agrees() -> Column:
    """The initiating bar matches the event it is attached to."""
    bar = F.col("bar")
    differs = (
        F.coalesce(F.col("market_snapshot_id") != bar["market_snapshot_id"], F.lit(False))
        | F.coalesce(F.col("effective_time") != bar["interval_start"], F.lit(False))
        | F.coalesce((F.col("entity_id") != GLOBAL) & (F.col("entity_id") != bar["symbol"]), F.lit(False))
    )
    return bar.isNull() | ~differs


_LINES = [
    ("Kind", "kind"), ("Code", "code"), ("Feed State", "feed_state"), ("Capability", "capability"), ("Decision", "side"),
    ("Skip Reason", "skip_reason"), ("Model Status", "model_status"), ("Emitter", "emitter_position"),
    ("Pricing Status", "pricing_status"), ("Color", "color"), ("Trajectory Phase", "trajectory_phase"),
    ("Domain State", "domain_state"), ("Confidence State", "confidence_state"),
]


def state_lines(state: str, indent: str = "", separator: str = "\n") -> Column:
    """Readable lines of a state, ``ABSENT`` where there is none."""
    s = F.col(state)
    lines = [F.when(s[name].isNotNull(), F.concat(F.lit(f"{indent}{label}: "), s[name])) for label, name in _LINES]
    lines.append(
        F.when(s["kind"] == "PRICING", F.concat(F.lit(f"{indent}Domain Exit: "), s["domain_exit"].cast("string")))
    )
    return F.when(s.isNull() | s["kind"].isNull(), F.lit(f"{indent}ABSENT")).otherwise(F.concat_ws(separator, *lines))


def display(state: str) -> Column:
    return F.coalesce(F.col(f"{state}.code"), F.col(f"{state}.kind"), F.lit("ABSENT"))
