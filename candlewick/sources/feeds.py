"""Bars from CSV files, live feed frames and history responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.functions import scalars as S
from candlewick.schema import BAR_COLUMNS
from candlewick.session import prepare
from candlewick.sources.ticks import with_bar_fields

CSV_SCHEMA = "timestamp string, open double, high double, low double, close double, volume long"


def _require(value: Column, message: str) -> Column:
    return F.when(value.isNull(), F.raise_error(F.lit(message))).otherwise(value)


def read_bars_csv(
    spark: SparkSession, path: str, symbol: str | Column | None = None, validate: bool = False, source: str = "CSV"
) -> DataFrame:
    """Final COMPLETE bars from CSV files with a checked header; a bad row aborts.

    Without ``symbol`` the file name up to the first ``_`` or ``.`` is the symbol.
    ``validate`` drops rows with impossible prices, as the live feed does.
    """
    raw = (
        prepare(spark)
        .read.schema(CSV_SCHEMA)
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .csv(path)
    )
    if symbol is None:
        name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/_.]+)[^/]*$", 1)
        symbol = F.upper(name)
    elif isinstance(symbol, str):
        symbol = F.lit(symbol)
    volume = F.when(F.col("volume") >= 0, F.col("volume"))
    df = raw.select(
        symbol.alias("symbol"),
        _require(S.parse_time("timestamp"), "unreadable bar timestamp").alias("interval_start"),
        *[_require(F.col(c), f"missing {c}").alias(c) for c in ("open", "high", "low", "close")],
        _require(volume, "missing or negative volume").alias("volume"),
        F.col("timestamp").alias("source_timestamp"),
    )
    if validate:
        df = df.filter(S.valid_ohlc(*(F.col(c) for c in ("open", "high", "low", "close"))))
    return with_bar_fields(df, source=source)


def _number(message: Column, key: str) -> Column:
    """A JSON number; quoted text does not count."""
    quoted = message.rlike(rf'"{key}"\s*:\s*"')
    return F.when(~quoted, F.get_json_object(message, f"$.{key}").try_cast("double"))


def decode_feed_json(frames: DataFrame, source: str, text: str = "value", receipt: Column | None = None) -> DataFrame:
    """Bars out of frames that hold a JSON array of messages.

    Type ``b`` is a final bar, ``u`` an updated partial one; other messages and
    unreadable bars are left out.
    """
    m = F.col("_m")
    messages = frames.select(*[c for c in frames.columns if c != text], F.explode(F.from_json(text, "array<string>")).alias("_m"))
    kind = F.get_json_object(m, "$.T")
    volume_text = F.when(m.rlike(r'"v"\s*:\s*null'), F.lit("")).otherwise(F.get_json_object(m, "$.v"))
    decoded = messages.filter(kind.isin("b", "u")).select(
        F.get_json_object(m, "$.S").alias("symbol"),
        S.parse_time(F.get_json_object(m, "$.t")).alias("interval_start"),
        *[_number(m, k).alias(c) for k, c in (("o", "open"), ("h", "high"), ("l", "low"), ("c", "close"))],
        S.parse_volume(volume_text).alias("volume"),
        F.coalesce(S.parse_volume(F.get_json_object(m, "$.n")), F.lit(0)).alias("event_count"),
        F.get_json_object(m, "$.t").alias("source_timestamp"),
        (receipt if receipt is not None else F.lit(None).cast("timestamp")).alias("receipt_time"),
        kind.alias("_kind"),
    )
    no = F.lit(False)
    return with_bar_fields(
        _readable(decoded),
        source=source,
        quality=S.quality_of(F.col("_kind"), no),
        final=S.final_of(F.col("_kind"), no),
    ).select(*BAR_COLUMNS)


def _readable(df: DataFrame) -> DataFrame:
    ok = S.valid_ohlc(*(F.col(c) for c in ("open", "high", "low", "close")))
    return df.filter((F.col("symbol") != "") & F.col("interval_start").isNotNull() & F.col("volume").isNotNull() & ok)


HISTORY_SCHEMA = "bars map<string, array<string>>, next_page_token string"
HISTORY_BAR = "t string, o double, h double, l double, c double, v long, n long"


def decode_history_json(responses: DataFrame, source: str, text: str = "value", receipt: Column | None = None) -> DataFrame:
    """RECONSTRUCTED, backfilled bars out of history responses (one page per row).

    A page that is no JSON object stops the job, as does one whose bars are not lists by symbol; a single
    unreadable bar is left out.
    """
    page = F.from_json(text, HISTORY_SCHEMA)
    told = F.get_json_object(text, "$.bars")
    broken = F.get_json_object(text, "$").isNull() | (told.isNotNull() & page["bars"].isNull())
    checked = F.when(F.col(text).isNotNull() & broken, F.raise_error(F.lit("unreadable history page"))).otherwise(page)
    pages = responses.select(checked.alias("_p"))
    by_symbol = pages.select(F.explode("_p.bars").alias("symbol", "_bars"))
    b = by_symbol.select("symbol", F.explode("_bars").alias("_b")).select("symbol", F.from_json("_b", HISTORY_BAR).alias("b"))
    decoded = b.select(
        "symbol",
        S.parse_time(F.col("b.t")).alias("interval_start"),
        *[F.col(f"b.{k}").alias(c) for k, c in (("o", "open"), ("h", "high"), ("l", "low"), ("c", "close"))],
        F.when(F.col("b.v") >= 0, F.col("b.v")).alias("volume"),
        F.coalesce("b.n", F.lit(0)).alias("event_count"),
        F.col("b.t").alias("source_timestamp"),
        (receipt if receipt is not None else F.lit(None).cast("timestamp")).alias("receipt_time"),
    )
    yes = F.lit(True)
    return with_bar_fields(
        _readable(decoded), source=source, quality=F.lit("RECONSTRUCTED"), final=yes, backfilled=yes
    ).select(*BAR_COLUMNS)


def next_pages(responses: DataFrame, text: str = "value") -> DataFrame:
    """Continuation tokens still to be fetched."""
    token = F.from_json(text, HISTORY_SCHEMA)["next_page_token"]
    return responses.select(token.alias("next_page_token")).filter(F.coalesce(token, F.lit("")) != "")
