"""Corpus pipeline: each stage works on what its predecessor kept.

The stages return the columns of ``documents``; the last one returns the pieces of the
packed sequences.  Documents without any letter are rejected, and the language found
replaces the given one; lines that many documents share go; of each group of
near-duplicates one document stays; sources are brought to their target weights by
whole copies; the result is packed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candlewick.llm import langid, line_dedup, mixing, packing, shingle_join
from candlewick.llm.common import BLANKS, staged, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LAST = 2**63 - 1  # a NULL id ranks behind all others


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language, which becomes their ``lang``; NULL, empty and letterless texts go.

    Ids and repeated rows play no part: every row is judged by its own text.  An empty table stays empty.
    """
    model = langid.learn(docs.filter(~langid.held_out(F.col("doc_id"))))
    found = langid.predict(docs, model, ("doc_id", "text", "source", "n_chars"))
    return found.filter(F.col("lang_pred") != langid.UNKNOWN).withColumnRenamed("lang_pred", "lang").select(COLUMNS)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that five documents or more share, but for the one of largest id; every document stays.

    A NULL text becomes an empty one.  Rows of one id or of NULL id are documents of their own; among holders without
    any id a line stays everywhere.  ``n_chars`` is counted anew.
    """
    out = line_dedup.shared_line_drop(docs, carry=("lang", "source"))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(COLUMNS)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per component of near-duplicates the document of least id; texts without words all stay.

    A NULL id ranks behind all others; of equal ids the least hash of the text counts, and of rows that repeat a
    document, the least source.  Texts that the line dedup has emptied have no words and stay.
    """
    found = shingle_join.near_components(docs)
    rank = F.coalesce("doc_id", F.lit(LAST))
    chosen = found.filter("comp IS NOT NULL").groupBy("comp").agg(F.min(F.struct(rank.alias("id"), "text_key")).alias("first"))
    chosen = chosen.select(F.col("first.id").alias("id"), F.col("first.text_key").alias("text_key"), F.lit(True).alias("chosen")).distinct()
    keyed = docs.select(*COLUMNS, rank.alias("id"), F.xxhash64("text").alias("text_key"))
    joined = keyed.join(chosen, ["id", "text_key"], "left")
    blank = F.length(F.trim(F.coalesce("text", F.lit("")), F.lit(BLANKS))) == 0
    first = F.row_number().over(Window.partitionBy("id", "text_key").orderBy("source"))
    # of rows that repeat a document one stays as well
    return joined.withColumn("first", first).filter(blank | (F.col("chosen") & (F.col("first") == 1))).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, copies as rows.

    Documents without words take one copy.  Rows that repeat a document (id and text) are one row with the copies of
    all of them; a NULL source is a source of its own.  No document appears more often than twice its rows.
    """
    copies = mixing.mix(docs).groupBy("doc_id", "text_key").agg(F.sum("copies").alias("copies"))
    copies = copies.select(F.coalesce("doc_id", F.lit(LAST)).alias("id"), "text_key", F.col("copies").cast("int").alias("copies"))
    keyed = docs.select(*COLUMNS, F.coalesce("doc_id", F.lit(LAST)).alias("id"), F.xxhash64("text").alias("text_key"))
    first = F.row_number().over(Window.partitionBy("id", "text_key").orderBy("source"))
    # rows that repeat a document are one row, with the copies of all of them
    once = keyed.withColumn("first", first).filter("first = 1").join(copies, ["id", "text_key"])
    return once.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select(COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens; copies of a document are documents of their own."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", keep_languages),
    ("line_dedup", drop_shared_lines),
    ("ngram_jaccard", keep_one_of_each_group),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: no SQL for the operators inside; tests compare run() with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir))
    return docs
