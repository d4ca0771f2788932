"""Nearest neighbours through vantage-point trees, one per shard of the vectors.

A tree's node holds a vantage point and the range of distances from it to either
child.  By the triangle inequality a child cannot hold anything nearer than
``bound``; it is skipped if ``factor * bound`` exceeds the k-th distance so far.
Factor 1 is exact, larger ones skip more.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlewick.llm.common import table, width

K = 10
FACTOR = 1.6  # recall 1.0 against brute force on 513 queries among 51,282 vectors; at factor 3 as well
LEAF = 128
SHARD_VALUES, LEAST_ROWS = 1 << 22, 256  # components of all vectors of a shard; a tree is one cell of a row
QUERIES_AT_ONCE = 256
PAIRS = 1 << 14  # distances measured at once


def build_tree(ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF) -> dict[str, np.ndarray]:
    """Arrays of a tree in which a node's points are the range [start, stop) of one permutation.

    The first point of an inner node's range is its vantage point; the rest is halved by rank of
    distance, so equal vectors split as well as others.
    """
    order = np.argsort(ids, kind="stable")
    nodes: list[list[float]] = []  # start, stop, left, right, then least and largest distance left and right
    random = np.random.default_rng(7)
    todo = [(0, len(order), -1, 0)]
    while todo:
        start, stop, parent, side = todo.pop()
        number = len(nodes)
        if parent >= 0:
            nodes[parent][2 + side] = number
        nodes.append([start, stop, -1, -1, 0.0, 0.0, 0.0, 0.0])
        if stop - start <= leaf:
            continue
        pick = start + int(random.integers(stop - start))
        order[[start, pick]] = order[[pick, start]]
        rest = order[start + 1 : stop]
        far = np.sqrt(((vectors[rest].astype(np.float64) - vectors[order[start]].astype(np.float64)) ** 2).sum(axis=1))
        by = np.argsort(far, kind="stable")
        order[start + 1 : stop], far = rest[by], far[by]
        half = len(far) // 2
        nodes[number][4:] = [far[0], far[half - 1], far[half], far[-1]]
        middle = start + 1 + half
        todo += [(start + 1, middle, number, 0), (middle, stop, number, 1)]
    return {"ids": ids[order], "vectors": vectors[order], "nodes": np.array(nodes, np.float64).reshape(-1, 8)}


class Search:
    """k nearest of a block of queries in one tree; its own leaf first, ties to the smaller id."""

    def __init__(self, tree: dict[str, np.ndarray], k: int, factor: float):
        self.ids, self.vectors, self.k, self.factor = tree["ids"], tree["vectors"].astype(np.float64), k, factor
        self.norms = (self.vectors**2).sum(axis=1)
        self.nodes = tree["nodes"]

    def run(self, query_ids: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        self.queries, self.query_ids = queries.astype(np.float64), query_ids
        self.query_norms = (self.queries**2).sum(axis=1)
        self.best = np.full((len(queries), self.k), np.inf)
        self.found = np.full((len(queries), self.k), np.iinfo(np.int64).max)
        self.home = np.full(len(queries), -1)
        if len(self.nodes):
            self._home(0, np.arange(len(queries)))
            self._visit(0, np.arange(len(queries)))
        return self.best, self.found

    def _far(self, rows: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Exact distances, a query and a vector each."""
        return np.sqrt(((self.queries[rows] - self.vectors[places]) ** 2).sum(axis=1))

    def _offer(self, rows: np.ndarray, start: int, stop: int) -> None:
        """Vectors of a leaf.  A matrix product with a margin for its rounding rules out most of them; the others are measured."""
        if not len(rows):
            return
        most = self.best[rows, -1]
        size = self.norms[start:stop]
        square = self.query_norms[rows][:, None] + size - 2.0 * (self.queries[rows] @ self.vectors[start:stop].T)
        margin = 1e-9 * (self.query_norms[rows][:, None] + size)
        i, j = np.nonzero((square - margin <= (most * most)[:, None]) & (self.ids[start:stop] != self.query_ids[rows][:, None]))
        if not len(i):
            return
        far = np.concatenate([self._far(rows[i[at : at + PAIRS]], start + j[at : at + PAIRS]) for at in range(0, len(i), PAIRS)])
        at, place = np.unique(i, return_inverse=True)
        # what was found before and what is new, by query
        query = np.concatenate([np.repeat(np.arange(len(at)), self.k), place])
        far = np.concatenate([self.best[rows[at]].ravel(), far])
        ids = np.concatenate([self.found[rows[at]].ravel(), self.ids[start + j]])
        by = np.lexsort((ids, far, query))
        first = np.searchsorted(query[by], np.arange(len(at)))
        keep = by[first[:, None] + np.arange(self.k)]
        self.best[rows[at]], self.found[rows[at]] = far[keep], ids[keep]

    def _bounds(self, number: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How near the left and the right child can hold anything, by the triangle inequality."""
        low = self.nodes[number, 4:]
        far = self._far(rows, np.full(len(rows), int(self.nodes[number, 0])))
        return np.maximum(np.maximum(low[0] - far, far - low[1]), 0), np.maximum(np.maximum(low[2] - far, far - low[3]), 0)

    def _home(self, number: int, rows: np.ndarray) -> None:
        """The leaf that each query would lie in, searched first: it gives a k-th distance to prune by."""
        start, stop, left, right = self.nodes[number, :4].astype(int)
        if left < 0:
            self.home[rows] = number
            self._offer(rows, start, stop)
            return
        near, other = self._bounds(number, rows)
        for child, mine in ((left, near <= other), (right, near > other)):
            if mine.any():
                self._home(child, rows[mine])

    def _visit(self, number: int, rows: np.ndarray) -> None:
        """The rest of the tree, every node once for all queries that need it."""
        start, stop, left, right = self.nodes[number, :4].astype(int)
        if left < 0:
            self._offer(rows[self.home[rows] != number], start, stop)
            return
        bounds = self._bounds(number, rows)
        self._offer(rows, start, start + 1)
        for child, bound in zip((left, right), bounds):
            near = self.factor * bound <= self.best[rows, -1] * (1 + 1e-9)
            if near.any():
                self._visit(child, rows[near])


def usable(vector) -> object:
    """Not NULL, not zero, every component finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def vantage_trees(vectors: DataFrame, shards: int) -> DataFrame:
    """(dim, shard, tree) from (vec_id, embedding); shards are dealt by a hash of the id."""

    def build(key, rows):
        dim = key[0].as_py()
        ids = rows.column("vec_id").to_numpy()
        tree = build_tree(ids, _matrix(rows.column("embedding"), dim))
        out = io.BytesIO()
        np.savez(out, **tree)
        return pa.table({"dim": pa.array([dim], pa.int32()), "shard": pa.array([key[1].as_py()], pa.int32()), "tree": pa.array([out.getvalue()], pa.binary())})

    keyed = vectors.select(F.size("embedding").alias("dim"), F.expr(f"CAST(pmod(xxhash64(vec_id), {shards}) AS INT)").alias("shard"), "vec_id", "embedding")
    return keyed.groupBy("dim", "shard").applyInArrow(build, "dim int, shard int, tree binary")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, factor: float = FACTOR, shard_values: int = SHARD_VALUES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for every query row, itself excepted.

    ``vectors`` and ``queries`` have vec_id and embedding (float or double arrays); other columns are
    ignored.  Rows without id and vectors that are NULL, zero or hold a NULL or non-finite component
    take no part; vectors of another length are no candidates.  Of queries with equal ids the least
    vector counts.  Equal distances go to the smaller id.  Fewer candidates than k are all returned.
    """
    spark = vectors.sparkSession
    take = lambda df: df.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    vectors, queries = take(vectors), take(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    n, values = vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("embedding")), F.lit(0))).first()
    # as many shards as tasks where that leaves a few hundred rows each, more where a shard would outgrow a task
    shards = max(1, min(width(spark), -(-n // LEAST_ROWS)), -(-values // shard_values))
    none = lambda kind: F.lit(None).cast(kind)
    kind = vectors.schema["embedding"].dataType
    trees = vantage_trees(vectors, shards).select("dim", "shard", F.lit(0).alias("kind"), "tree", none("long").alias("vec_id"), F.lit(None).cast(kind).alias("embedding"))
    # the stated query set meets every shard
    asked = queries.select(
        F.size("embedding").alias("dim"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), none("binary").alias("tree"), "vec_id", "embedding"
    )
    both = trees.unionByName(asked).repartition(width(spark), "dim", "shard").sortWithinPartitions("dim", "shard", "kind")
    out = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def search(batches):
        held, tree = None, None
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            kinds = batch.column(2).to_pylist()
            at = 0
            while at < len(keys):
                if kinds[at] == 0:
                    held, tree = keys[at], dict(np.load(io.BytesIO(batch.column(3)[at].as_py())))
                    at += 1
                    continue
                stop = at
                while stop < len(keys) and stop - at < QUERIES_AT_ONCE and keys[stop] == keys[at] and kinds[stop] == 1:
                    stop += 1
                if keys[at] == held:  # else no vector of that length is in the shard
                    part = batch.slice(at, stop - at)
                    ids = part.column(4).to_numpy()
                    far, found = Search(tree, k, factor).run(ids, _matrix(part.column(5), keys[at][0]))
                    ok = np.isfinite(far)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, ok.sum(axis=1))), pa.array(found[ok]), pa.array(far[ok])], schema=out)
                at = stop

    found = both.mapInArrow(search, T.StructType.fromDDL("query_id long, vec_id long, score double"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 100 == 0))
