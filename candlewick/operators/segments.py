"""Splitting long ordered histories so that no task ever holds one whole key.

A per-symbol window over an unbounded history puts a hot symbol in one task.
Instead the rows are put in order once, and every symbol is cut into *segments* of
consecutive rows:

* rows are range-partitioned and sorted by (key, time), so ranges split a hot key as they
  split the rest, and written in that order; per (key, range) the number of rows is
  one row of a small frame, whose sums along the key turn places within ranges
  into exact positions ``rn``;
* positions turn into segments of ``rows`` rows, and the last ``halo`` rows of a
  segment are copied in front of the next one, so that bounded frames (last 3,
  15, 30 rows) see exactly what an uncut window would see;
* unbounded running state (last accepted label, last break of a run) crosses
  segment borders through one summary row per segment.

There is one layout for every size.  Keys and order values may be NULL: NULL keys
are a key of their own, NULL order values come first.  ``_k`` holds the key values in a
struct, which is never NULL, so that windows, sums and joins per segment share one
exchange of the rows.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from candlewick.session import stage

SEGMENT_ROWS = 65_536


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys meet NULL keys."""
    other = right.select(*[F.col(k).alias(f"_j_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_j_{k}")) for k in keys])
    return left.join(other, same, how).drop(*[f"_j_{k}" for k in keys])


@dataclass(frozen=True)
class Layout:
    """How the rows of a key are spread over tasks."""

    keys: tuple[str, ...]
    ts: str
    rows: int = SEGMENT_ROWS

    @staticmethod
    def of(keys: list[str], ts: str = "interval_start", rows: int = SEGMENT_ROWS) -> Layout:
        return Layout(tuple(keys), ts, rows)

    def along(self, keys: list[str], ts: str) -> Layout:
        """The same sizes for another key or order of the same rows."""
        return replace(self, keys=tuple(keys), ts=ts)

    @property
    def groups(self) -> list[str]:
        return ["_k", "seg"]

    @property
    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.groups).orderBy("rn")


def in_ranges(df: DataFrame, layout: Layout, first_of_each: bool = False) -> DataFrame:
    """Rows in order over the partitions.  ``first_of_each`` keeps one row of each key and time; of equal times the smaller
    snapshot id comes first."""
    tie = [c for c in ("market_snapshot_id",) if c in df.columns and c != layout.ts]
    tasks = task_count(df)
    if not first_of_each:
        return df.repartitionByRange(tasks, *layout.keys, layout.ts, *tie).sortWithinPartitions(*layout.keys, layout.ts, *tie)
    # rows of one key and time lie in one range, so this window needs no exchange of its own
    ranged = df.repartitionByRange(tasks, *layout.keys, layout.ts)
    nth = F.row_number().over(Window.partitionBy(*layout.keys, layout.ts).orderBy(*(tie or [layout.ts])))
    return ranged.withColumn("_nth", nth).filter("_nth = 1").drop("_nth").sortWithinPartitions(*layout.keys, layout.ts)


def number_rows(df: DataFrame, layout: Layout, first_of_each: bool = False) -> DataFrame:
    """Exact 1-based position ``rn`` of every row within its key, and the key as ``_k``."""
    placed = in_ranges(df, layout, first_of_each).withColumns({"_range": F.spark_partition_id(), "_place": F.monotonically_increasing_id()})
    held = stage(placed.withColumn("_k", F.struct(*layout.keys)))
    along = Window.partitionBy("_k").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    runs = held.groupBy("_k", "_range").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(along), F.lit(0)) - F.col("_first") + 1
    # written, so that its size is known: where it is small, the join broadcasts it
    runs = stage(runs.select("_k", "_range", before.alias("_shift")))
    return held.join(runs, ["_k", "_range"]).withColumn("rn", F.col("_place") + F.col("_shift")).drop("_range", "_place", "_shift")


def task_count(df: DataFrame) -> int:
    """Width of a shuffle.  Named explicitly where work per byte is high, because
    adaptive execution would merge such partitions by their size alone."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def lay_out(df: DataFrame, layout: Layout, halo: int, first_of_each: bool = False) -> DataFrame:
    """Add ``_k``, ``rn``, ``seg`` and ``halo``; rows arrive partitioned by key and segment."""
    rows = layout.rows
    numbered = number_rows(df.drop("_k"), layout, first_of_each)
    own = F.floor((F.col("rn") - 1) / F.lit(rows))
    # a row is read by its own segment, and by all that begin within the next ``halo`` rows
    last = F.floor((F.col("rn") - 1 + halo) / F.lit(rows))
    placed = F.transform(F.sequence(own, last), lambda seg: F.struct(seg.alias("seg"), (seg != own).alias("halo")))
    return numbered.select("*", F.inline(placed)).repartition(task_count(df), *layout.groups)


def last_rows(w: WindowSpec, n: int) -> WindowSpec:
    """The current row and the ``n - 1`` before it."""
    return w.rowsBetween(-(n - 1), 0)


def so_far(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def before(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, -1)


def along_segments(layout: Layout) -> WindowSpec:
    """Earlier segments of the same key; one summary row each."""
    return Window.partitionBy("_k").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)


def carry_last(df: DataFrame, layout: Layout, values: dict[str, Column], inclusive: bool = True) -> DataFrame:
    """Running "latest non-NULL value" over the whole key.

    ``values`` maps an output name to the expression that is remembered.  With
    ``inclusive=False`` the current row's own value is not seen.  At most one halo
    row per segment may still be present.
    """
    frame = so_far(layout.window) if inclusive else before(layout.window)
    # A halo row was judged without its own predecessor; its true value arrives
    # with the summary of the segment it belongs to.
    own = ~F.col("halo") if "halo" in df.columns else F.lit(True)
    tagged = df.withColumns({f"_v_{name}": F.when(own, expr) for name, expr in values.items()})
    inside = {name: F.last(f"_v_{name}", ignorenulls=True).over(frame) for name in values}
    spent = [f"_v_{name}" for name in values]
    ends = tagged.filter(own).groupBy(*layout.groups).agg(
        *[
            F.max_by(f"_v_{name}", F.when(F.col(f"_v_{name}").isNotNull(), F.col("rn"))).alias(f"_e_{name}")
            for name in values
        ]
    )
    along = along_segments(layout)
    carried = ends.select(
        *layout.groups, *[F.last(f"_e_{name}", ignorenulls=True).over(along).alias(f"_c_{name}") for name in values]
    )
    return (
        tagged.join(carried, layout.groups, "left")
        .withColumns({name: F.coalesce(expr, F.col(f"_c_{name}")) for name, expr in inside.items()})
        .drop(*spent, *[f"_c_{name}" for name in values])
    )


def carry_max(df: DataFrame, layout: Layout, out: str, value: Column, inclusive: bool = True) -> DataFrame:
    """Running maximum over the whole key."""
    frame = so_far(layout.window) if inclusive else before(layout.window)
    tagged = df.withColumn("_v", value)
    inside = F.max("_v").over(frame)
    ends = tagged.groupBy(*layout.groups).agg(F.max("_v").alias("_e"))
    carried = ends.select(*layout.groups, F.max("_e").over(along_segments(layout)).alias("_c"))
    return (
        tagged.join(carried, layout.groups, "left")
        .withColumn(out, F.greatest(inside, F.col("_c")))
        .drop("_v", "_c")
    )


def carry_previous_two(df: DataFrame, layout: Layout, value: Column, out1: str, out2: str) -> DataFrame:
    """The two latest non-NULL values strictly before each row, however far back."""
    w = before(layout.window)
    df = df.withColumn("_v", value)
    df = df.withColumn("_in1", F.last("_v", ignorenulls=True).over(w))
    seen = F.when(F.col("_v").isNotNull(), F.struct(F.col("_in1").alias("v")))
    inner = df.withColumn("_in2", F.last(seen, ignorenulls=True).over(w))
    at_value = F.when(F.col("_v").isNotNull(), F.col("rn"))
    ends = df.groupBy(*layout.groups).agg(
        F.max_by("_v", at_value).alias("_e1"), F.max_by("_in1", at_value).alias("_e2")
    )
    along = along_segments(layout)
    ends = ends.withColumn("_c1", F.last("_e1", ignorenulls=True).over(along))
    older = F.when(F.col("_e1").isNotNull(), F.struct(F.coalesce("_e2", "_c1").alias("v")))
    carried = ends.withColumn("_c2", F.last(older, ignorenulls=True).over(along)).select(*layout.groups, "_c1", "_c2")
    return (
        inner.join(carried, layout.groups, "left")
        .withColumns(
            {
                out1: F.coalesce("_in1", "_c1"),
                out2: F.when(F.col("_in2").isNull(), F.col("_c2.v")).otherwise(F.coalesce("_in2.v", "_c1")),
            }
        )
        .drop("_v", "_in1", "_in2", "_c1", "_c2")
    )
