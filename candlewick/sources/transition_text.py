"""The readable transition log: writing blocks, and reading them back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.functions import scalars as S
from candlewick.operators.transitions import CONTRACT, state_lines
from candlewick.session import prepare

# The layout of the log.
RULE = "-" * 70
BANNER = "=" * 70
TITLE = "STAGE TRANSITION"
BLOCK_START = f"{RULE}\n{TITLE}\n{RULE}\n"
INDENT = "    "


def _na(value: Column) -> Column:
    return F.when(F.coalesce(F.trim(value), F.lit("")) == "", F.lit("N/A")).otherwise(value)


def short_number(value: Column) -> Column:
    """Shortest decimal text: plain between 1e-4 and 1e21, otherwise with exponent."""
    text = value.cast("string")
    fixed = F.regexp_replace(value.cast("decimal(38,16)").cast("string"), r"\.?0+$", "")
    mantissa = F.regexp_replace(F.substring_index(text, "E", 1), r"\.0$", "")
    exponent = F.substring_index(text, "E", -1).try_cast("int")
    scientific = F.concat(mantissa, F.format_string("e%s%02d", F.when(exponent < 0, "-").otherwise("+"), F.abs(exponent)))
    plain = text.contains("E") & (F.abs(value) >= 1e-4) & (F.abs(value) < 1e21)
    return (
        F.when(plain, fixed).when(text.contains("E"), scientific).otherwise(F.regexp_replace(text, r"\.0$", ""))
    )


def _field(label: str, width: int, value: Column) -> Column:
    return F.concat(F.lit(f"{label}:".ljust(width)), value)


def _bar_lines() -> Column:
    b = F.col("bar")
    rows = [
        ("Symbol", _na(b["symbol"])),
        ("Market Snapshot ID", _na(b["market_snapshot_id"])),
        ("Interval Start", S.utc_text(b["interval_start"])),
        ("Interval End", S.utc_text(b["interval_end"])),
        *[(n.title(), short_number(b[n])) for n in ("open", "high", "low", "close")],
        ("Volume", b["volume"].cast("string")),
        ("Source", _na(b["source"])),
        ("Source Timestamp", _na(b["source_timestamp"])),
        ("Quality", _na(b["quality_status"])),
    ]
    lines = F.concat_ws("\n", *[_field(f"{INDENT}{label}", 25, value) for label, value in rows])
    return F.when(b.isNull(), f"{INDENT}N/A").otherwise(lines)


def blocks(changes: DataFrame, keep: Column | None = None) -> DataFrame:
    """One text block per transition, in the single column ``value``; NULL where ``keep`` is false."""
    facts = F.array_join(F.transform(F.map_entries("facts"), lambda e: F.concat(F.lit(INDENT), e["key"], F.lit(": "), e["value"])), "\n")
    accepted = F.when((F.col("accepted_sequence") == 0) & F.col("source_event_id").isNull(), "N/A").otherwise(F.col("accepted_sequence").cast("string"))
    parts = [
        F.lit(f"{RULE}\n{TITLE}\n{RULE}\n"),
        _field("Transition ID", 20, F.col("transition_id")),
        _field("Sequence", 20, F.col("sequence").cast("string")),
        F.lit(""),
        _field("Stage ID", 20, F.col("stage_id")),
        _field("Stage Name", 20, F.col("stage_name")),
        _field("Entity", 20, F.col("entity_id")),
        F.lit(""),
        _field("Effective Time", 20, S.utc_text("effective_time")),
        _field("Published Time", 20, F.lit("N/A")),
        F.lit("\nPrevious State:"),
        state_lines("previous", INDENT),
        F.lit("\nCurrent State:"),
        state_lines("current", INDENT),
        F.lit("\nInitiating Bar:"),
        _bar_lines(),
        F.lit("\nTransition Facts:"),
        F.when(F.size(F.map_keys("facts")) > 0, facts).otherwise(f"{INDENT}N/A"),
        F.lit("\nCorrelation:"),
        _field(f"{INDENT}Market Snapshot ID", 24, _na(F.col("market_snapshot_id"))),
        _field(f"{INDENT}Accepted Sequence", 24, accepted),
        _field(f"{INDENT}Source Event ID", 24, _na(F.col("source_event_id"))),
        F.lit("\nReason:"),
        F.concat(F.lit(INDENT), _na(F.col("reason_code"))),
        F.lit(f"\n{RULE}"),
    ]
    text = F.concat_ws("\n", *parts)
    return changes.select((text if keep is None else F.when(keep, text)).alias("value"))


def write_transitions_text(changes: DataFrame, path: str) -> None:
    """Blocks in parallel part files; header and footer with the row count beside them."""
    blocks(changes).write.mode("overwrite").text(f"{path}/blocks")
    spark = changes.sparkSession
    counted = spark.read.text(f"{path}/blocks", lineSep=BLOCK_START).filter(F.col("value").startswith("\nTransition ID"))
    footer = counted.agg(
        F.concat(
            F.lit(f"{BANNER}\nSTAGE TRANSITION DIAGNOSTIC COMPLETE\n{BANNER}\n\nTransitions Written:  "),
            F.count("*").cast("string"),
            F.lit(f"\nTransitions Dropped:  0\nWrite Errors:         0\n\n{BANNER}"),
        ).alias("value")
    )
    footer.write.mode("overwrite").text(f"{path}/footer")
    header = F.lit(f"{BANNER}\nSTAGE TRANSITION DIAGNOSTIC\n{BANNER}\n\nContract Version:   {CONTRACT}\n\n{BANNER}\n")
    spark.range(1).select(header.alias("value")).write.mode("overwrite").text(f"{path}/header")


def _section(title: str) -> Column:
    """Indented lines below a title as a map of label -> text."""
    body = F.regexp_extract("value", rf"(?m)^{title}:\n((?:    .*\n?)+)", 1)
    lines = F.filter(F.split(body, "\n"), lambda x: x.contains(":"))
    pairs = F.transform(
        lines,
        lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("v")),
    )
    return F.map_from_entries(pairs)


def parse_transitions_text(spark: SparkSession, path: str) -> DataFrame:
    """Rows from written blocks: the file is split at block starts by the reader itself."""
    raw = prepare(spark).read.text(path, lineSep=BLOCK_START)
    block = raw.filter(F.col("value").contains("Transition ID:"))
    head = lambda label: F.trim(F.regexp_extract("value", rf"(?m)^{label}:(.*)$", 1))
    known = lambda c: F.when((c != "") & (c != "N/A"), c)
    parsed = block.select(
        head("Transition ID").alias("transition_id"),
        known(head("Sequence")).try_cast("long").alias("sequence"),
        head("Stage ID").alias("stage_id"),
        head("Stage Name").alias("stage_name"),
        head("Entity").alias("entity_id"),
        S.parse_time(known(head("Effective Time"))).alias("effective_time"),
        _section("Previous State").alias("previous"),
        _section("Current State").alias("current"),
        _section("Initiating Bar").alias("bar"),
        _section("Transition Facts").alias("facts"),
        _section("Correlation").alias("correlation"),
        F.trim(F.regexp_extract("value", r"(?m)^Reason:\n    (.*)$", 1)).alias("reason_code"),
    )
    return parsed.withColumn("bar", F.when(F.size("bar") > 0, F.col("bar")))


def parse_footer(spark: SparkSession, path: str) -> DataFrame:
    text = prepare(spark).read.text(path, wholetext=True)
    count = lambda label: F.regexp_extract("value", rf"{label}:\s+(\d+)", 1).try_cast("long")
    return text.select(
        count("Transitions Written").alias("written"), count("Transitions Dropped").alias("dropped"), count("Write Errors").alias("write_errors")
    )
