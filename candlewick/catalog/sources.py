"""Registered source and sink queries: data goes out of Spark and comes back in."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from candlewick.catalog.changes import changes
from candlewick.catalog.helpers import plain
from candlewick.catalog.sqltext import bars_cte, changes_cte
from candlewick.session import shared_dir
from candlewick.sources import feeds as E
from candlewick.sources import transition_text as X
from candlewick.sources.ticks import event_bars

KEY = ["symbol", "interval_start"]
OUT = [*KEY, "interval_end", "open", "high", "low", "close", "volume", "event_count", "source", "source_timestamp", "quality_status", "is_final", "is_backfilled", "market_snapshot_id"]


def scratch(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def csv_round_trip(spark, d):
    bars = event_bars(spark, d, "1 minute")
    path = scratch(spark, "bars")
    text = F.date_format("interval_start", "yyyy-MM-dd HH:mm:ss").alias("timestamp")
    bars.select("symbol", text, "open", "high", "low", "close", "volume").write.partitionBy("symbol").option("header", True).csv(path)
    symbol = F.regexp_extract(F.col("_metadata.file_path"), r"symbol=([^/]+)/", 1)
    return plain(E.read_bars_csv(spark, f"{path}/*", symbol, validate=True).select(*OUT))


def feed_frames(spark, d):
    """Hourly frames of messages; odd ones mixed in by the values themselves."""
    b = event_bars(spark, d, "1 minute")
    num = lambda c: F.col(c).cast("string")
    kind = F.when(F.col("volume") < 30, "u").when(F.col("volume") > 97, "status").otherwise("b")
    volume = F.when(F.col("close") < 20, F.concat(F.lit('"'), num("volume"), F.lit('"'))).when(F.col("close") > 150, F.concat(num("volume"), F.lit(".5"))).otherwise(num("volume"))
    open_ = F.when((F.col("close") > 40) & (F.col("close") < 45), F.concat(F.lit('"'), num("open"), F.lit('"'))).otherwise(num("open"))
    high = F.when((F.col("close") > 50) & (F.col("close") < 55), F.lit("")).otherwise(F.concat(F.lit(',"h":'), num("high")))
    message = F.concat(
        F.lit('{"T":"'), kind, F.lit('","S":"'), F.col("symbol"), F.lit('","o":'), open_, high, F.lit(',"l":'), num("low"), F.lit(',"c":'), num("close"),
        F.lit(',"v":'), volume, F.lit(',"t":"'), F.col("source_timestamp"), F.lit('","n":'), num("event_count"), F.lit("}"),
    )
    return b.groupBy("symbol", F.date_trunc("hour", "interval_start").alias("h")).agg(
        F.concat(F.lit("["), F.array_join(F.collect_list(message), ","), F.lit("]")).alias("value")
    ).select("value")


def history_pages(spark, d):
    """Daily pages with hourly bars of every symbol."""
    b = event_bars(spark, d)
    bar = F.struct(F.col("source_timestamp").alias("t"), F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c"), F.col("volume").alias("v"), F.col("event_count").alias("n"))
    days = b.groupBy("symbol", F.date_trunc("day", "interval_start").alias("day")).agg(F.collect_list(bar).alias("bars"))
    page = F.to_json(F.struct(F.map_from_arrays(F.array("symbol"), F.array("bars")).alias("bars"), F.when(F.dayofmonth("day") < 15, F.concat("symbol", F.lit("-next"))).alias("next_page_token")))
    return days.select(page.alias("value"))


def log_round_trip(spark, d):
    path = scratch(spark, "transitions")
    X.write_transitions_text(changes(spark, d), path)
    p = X.parse_transitions_text(spark, f"{path}/blocks")
    get = lambda m, k: F.try_element_at(F.col(m), F.lit(k))
    return plain(
        p.select(
            "transition_id", "sequence", "stage_id", "entity_id", "effective_time", get("previous", "Code").alias("prev_code"), get("current", "Code").alias("code"),
            get("current", "Emitter").alias("emitter_position"), get("current", "Domain Exit").alias("domain_exit"), get("bar", "Market Snapshot ID").alias("snapshot"),
            get("bar", "Close").alias("close"), get("correlation", "Accepted Sequence").alias("accepted"), "reason_code",
        )
    )


def log_footer(spark, d):
    path = scratch(spark, "transitions")
    X.write_transitions_text(changes(spark, d), path)
    return X.parse_footer(spark, f"{path}/footer")


QUERIES = {
    "read_bars_csv": csv_round_trip,
    "decode_feed_json": lambda s, d: plain(E.decode_feed_json(feed_frames(s, d), "ALPACA_IEX").select(*OUT)),
    "decode_history_json": lambda s, d: plain(E.decode_history_json(history_pages(s, d), "ALPACA_IEX").select(*OUT)),
    "history_next_pages": lambda s, d: E.next_pages(history_pages(s, d)).groupBy("next_page_token").agg(F.count("*").alias("pages")),
    "parse_transitions_text": log_round_trip,
    "write_transitions_text": log_footer,
}

_MIN = bars_cte("b0", unit="minute")
_COLS = "symbol, interval_start, interval_end, open, high, low, close, volume, event_count, source, source_timestamp, quality_status, is_final, is_backfilled"
_SNAP = "sha256(printf('%s|%s|%s|%.8f|%.8f|%.8f|%.8f|%d', symbol, source, source_timestamp, open, high, low, close, volume)) AS market_snapshot_id"

ORACLE = {
    "read_bars_csv": f"""WITH {_MIN}, b AS (SELECT symbol, interval_start, interval_end, open, high, low, close, volume, 0::BIGINT AS event_count, 'CSV' AS source,
  strftime(interval_start, '%Y-%m-%d %H:%M:%S') AS source_timestamp, 'COMPLETE' AS quality_status, true AS is_final, false AS is_backfilled FROM b0 WHERE low > 0)
  SELECT {_COLS}, {_SNAP} FROM b""",
    "decode_feed_json": f"""WITH {_MIN}, b AS (SELECT * REPLACE ('ALPACA_IEX' AS source), CASE WHEN volume < 30 THEN 'PARTIAL' ELSE 'COMPLETE' END AS quality_status, volume >= 30 AS is_final, false AS is_backfilled
  FROM b0 WHERE volume <= 97 AND low > 0 AND NOT (close > 40 AND close < 45) AND NOT (close > 50 AND close < 55)) SELECT {_COLS}, {_SNAP} FROM b""",
    "decode_history_json": f"""WITH {bars_cte('b0')}, b AS (SELECT * REPLACE ('ALPACA_IEX' AS source, interval_start + INTERVAL 1 MINUTE AS interval_end), 'RECONSTRUCTED' AS quality_status, true AS is_final, true AS is_backfilled
  FROM b0 WHERE low > 0) SELECT {_COLS}, {_SNAP} FROM b""",
    "history_next_pages": f"""WITH {bars_cte('b0')}, d AS (SELECT DISTINCT symbol, date_trunc('day', interval_start) AS day FROM b0)
  SELECT symbol || '-next' AS next_page_token, count(*) AS pages FROM d WHERE day(day) < 15 GROUP BY symbol""",
    "parse_transitions_text": f"""WITH RECURSIVE {changes_cte()} SELECT transition_id, sequence, stage_id, entity_id, effective_time, prev_code, c.code, emitter_position,
  CASE WHEN kind = 'PRICING' THEN CAST(domain_exit AS VARCHAR) END AS domain_exit, c.market_snapshot_id AS snapshot, regexp_replace(CAST(b.close AS VARCHAR), '\\.0$', '') AS close,
  CASE WHEN c.market_snapshot_id IS NULL THEN 'N/A' ELSE CAST(accepted_sequence AS VARCHAR) END AS accepted, coalesce(side, color, skip_reason, capability, feed_state, pricing_status) AS reason_code
  FROM chg c LEFT JOIN bars b ON b.market_snapshot_id = c.market_snapshot_id""",
    "write_transitions_text": f"WITH RECURSIVE {changes_cte()} SELECT count(*) AS written, 0::BIGINT AS dropped, 0::BIGINT AS write_errors FROM chg",
}
