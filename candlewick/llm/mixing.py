"""Mixing sources to target token counts by entropy balancing.

Among all document rates between 0 and ``max_ratio`` that give each source its
target, those closest to 1 in relative entropy are w = min(max_ratio, exp(lambda x)),
x being the document's size over its source's mean size.  One lambda per source
solves the convex dual; Newton steps on it, kept inside a shrinking bracket, are
aggregations over (source, size) cells.  Rates are then rounded to whole copies.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candlewick.llm.common import staged, table

WEIGHTS = (3, 1, 2)
SHARE, MAX_RATIO = 1.5, 2.0
STEPS, TOLERANCE = 60, 1e-6
BUCKETS, BUCKET_ROWS = 256, 1 << 14  # of a cell: so many at least, and one for so many documents of the table


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def source_key(source: Column) -> Column:
    """Sorts by code point with NULL last, and joins NULL with NULL."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, max_ratio: float = MAX_RATIO) -> DataFrame:
    """(skey, source_size, documents, smallest, target) from (skey, size, n) cells; one row per source.

    The caps are filled like water: sources in the order of cap over weight; the level is
    what remains, over the weights that remain, at the first source that stays below its cap.
    """
    per = sizes.groupBy("skey").agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size"),
        F.sum("n").alias("documents"),
        F.min(F.when(F.col("size") > 0, F.col("size"))).alias("smallest"),
    )
    choice = F.array(*[F.lit(float(w)) for w in weights])
    ranked = per.withColumn("weight", F.element_at(choice, (F.row_number().over(Window.orderBy("skey")) - 1) % len(weights) + 1))
    ranked = ranked.withColumn("cap", max_ratio * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    before = Window.orderBy("ratio", "skey").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    ranked = ranked.withColumns(
        {
            "left_size": share * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
            "left_weight": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        }
    )
    ranked = ranked.withColumn("level", F.col("left_size") / F.col("left_weight"))
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "skey", "level"))).over(whole)["level"]
    ranked = ranked.withColumn("level", level)
    below = F.col("level") * F.col("weight")
    return ranked.select("skey", "source_size", "documents", "smallest", F.coalesce(F.least("cap", below), F.col("cap")).alias("target"))


def balance(cells: DataFrame, sources: DataFrame, max_ratio: float = MAX_RATIO) -> DataFrame:
    """Sources with their lambda.

    A target of zero takes nothing and one at the cap takes ``max_ratio`` of everything; no lambda is sought there.
    A source that STEPS steps leave unsolved is an error.  The state is written in each step, so that its size is known and
    Spark broadcasts it where it is below the session's threshold.
    """
    mean = F.col("source_size") / F.col("documents")
    least = F.col("smallest") / mean  # smallest x
    free = (F.col("target") > 0) & (F.col("target") < max_ratio * F.col("source_size") * (1 - 1e-12))
    state = staged(
        sources.withColumns(
            {
                "mean": mean,
                "open": F.coalesce(free, F.lit(False)),
                "low": F.least(F.lit(0.0), F.log(F.col("target") / F.col("source_size")) / least),
                "high": F.log(F.lit(max_ratio)) / least,
                "lambda": F.lit(0.0),
            }
        )
    )
    x = F.col("size") / F.col("mean")
    raw = F.exp(F.least(F.col("lambda") * x, F.lit(50.0)))
    tokens = F.col("n") * F.col("size")
    for _ in range(STEPS):
        if not state.filter("open").limit(1).count():
            break
        sums = (
            cells.join(state.filter("open").select("skey", "mean", "lambda"), "skey")
            .groupBy("skey")
            .agg(F.sum(tokens * F.least(raw, F.lit(max_ratio))).alias("got"), F.sum(F.when(raw < max_ratio, tokens * x * raw).otherwise(0.0)).alias("slope"))
        )
        gap = F.col("got") - F.col("target")
        newton = F.col("lambda") - gap / F.col("slope")
        moved = state.join(sums, "skey", "left")
        moved = moved.withColumns({"low": F.when(F.col("open") & (gap < 0), F.col("lambda")).otherwise(F.col("low")), "high": F.when(F.col("open") & (gap > 0), F.col("lambda")).otherwise(F.col("high"))})
        inside = (F.col("slope") > 0) & (newton > F.col("low")) & (newton < F.col("high"))
        done = (F.abs(gap) <= TOLERANCE * F.col("target")) | (F.col("high") - F.col("low") <= 1e-14 * F.abs(F.col("high")))
        step = F.when(inside, newton).otherwise((F.col("low") + F.col("high")) / 2)
        moved = moved.withColumns({"lambda": F.when(F.col("open") & ~done, step).otherwise(F.col("lambda")), "open": F.col("open") & ~F.coalesce(done, F.lit(True))})
        state = staged(moved.drop("got", "slope"))
    else:
        if unsolved := state.filter("open").count():
            raise RuntimeError(f"{unsolved} sources have no solution after {STEPS} steps")
    return state


def _rates(cells: DataFrame, state: DataFrame, max_ratio: float) -> DataFrame:
    x = F.col("size") / F.col("mean")
    solved = F.least(F.exp(F.least(F.col("lambda") * x, F.lit(50.0))), F.lit(max_ratio))
    at_cap = F.col("target") >= max_ratio * F.col("source_size") * (1 - 1e-12)
    rate = F.when(F.col("size") == 0, F.lit(1.0)).when(F.col("target") <= 0, F.lit(0.0)).when(at_cap, F.lit(max_ratio)).otherwise(solved)
    return cells.join(state.select("skey", "source_size", "target", "mean", "lambda"), "skey").withColumn("rate", rate)


def cell_copies(cells: DataFrame, state: DataFrame, max_ratio: float = MAX_RATIO) -> DataFrame:
    """Whole copies of all documents of a (source, size) cell.

    Along increasing sizes the running sum of rates is rounded, so a source misses its target by
    about one document; single copies of fitting sizes then take up most of what is missed.
    """
    # A source's cells are its distinct sizes: at most as many as its longest text has words.
    upto = Window.partitionBy("skey").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(F.col("n") * F.col("rate")).over(upto)
    rated = _rates(cells, state, max_ratio).withColumn("upto", F.floor(total + 0.5))
    rated = rated.withColumn("copies", F.col("upto") - F.coalesce(F.lag("upto").over(Window.partitionBy("skey").orderBy("size")), F.lit(0)))
    most = F.floor(F.lit(max_ratio)) * F.col("n")
    out = staged(rated.withColumn("copies", F.least(F.greatest("copies", F.lit(0)), most)).select("skey", "size", "n", "source_size", "target", "copies"))
    for _ in range(3):
        missing = out.groupBy("skey").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("missing"))
        both = out.join(missing, "skey")
        fits = (F.col("size") > 0) & (F.col("size") < 2 * F.abs("missing")) & F.when(F.col("missing") > 0, F.col("copies") < most).otherwise(F.col("copies") > 0)
        pick = both.filter(fits).groupBy("skey").agg(
            F.min(F.struct(F.abs(F.col("size") - F.abs("missing")).alias("off"), "size")).alias("pick"), F.first(F.signum("missing")).alias("sign")
        )
        pick = pick.select("skey", F.col("pick.size").alias("size"), F.col("sign").cast("long").alias("sign"))
        out = staged(out.join(pick, ["skey", "size"], "left").withColumn("copies", F.col("copies") + F.coalesce("sign", F.lit(0))).drop("sign"))
    return out


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_ratio: float = MAX_RATIO) -> DataFrame:
    """(doc_id, text_key, skey, size, source_size, target, copies, taken), a row per row of ``docs``.

    Needs doc_id, text and source; other columns are ignored.  NULL text has size 0; documents
    of size 0 take one copy of no words.  A NULL source is a source of its own.  Documents of equal
    source and size are told apart by a hash of their id, so reruns agree; equal rows are
    interchangeable; text_key is a hash of the text.  An empty table gives no rows.  Targets that STEPS Newton steps do not
    reach within TOLERANCE stop the job.
    """
    sized = staged(docs.select("doc_id", F.xxhash64("text").alias("text_key"), source_key(F.col("source")).alias("skey"), word_count(F.col("text")).alias("size")))
    buckets = max(BUCKETS, -(-sized.count() // BUCKET_ROWS))
    sized = sized.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(buckets)).cast("int"))
    fine = sized.groupBy("skey", "size", "bucket").agg(F.count(F.lit(1)).alias("n"))
    cells = staged(fine.groupBy("skey", "size").agg(F.sum("n").alias("n")))
    state = balance(cells, staged(source_targets(cells, weights, share, max_ratio)), max_ratio)
    copies = cell_copies(cells, state, max_ratio)
    # Ranks inside a cell: the cell's buckets are numbered by running sums, documents inside a bucket by a window.
    order = Window.partitionBy("skey", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = fine.withColumn("offset", F.coalesce(F.sum("n").over(order), F.lit(0))).drop("n")
    offsets = offsets.join(copies, ["skey", "size"])
    rank = F.row_number().over(Window.partitionBy("skey", "size", "bucket").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id", "text_key"))
    ranked = sized.withColumn("rank", rank).join(offsets, ["skey", "size", "bucket"])
    each = F.floor(F.col("copies") / F.col("n"))
    extra = F.col("copies") - each * F.col("n")
    own = each + F.when(F.col("offset") + F.col("rank") <= extra, 1).otherwise(0)
    return ranked.select("doc_id", "text_key", "skey", "size", "source_size", "target", own.cast("int").alias("copies"), (own * F.col("size")).cast("long").alias("taken"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
