"""Removal of lines that many documents share, by a sharded minimal perfect hash.

1. Every line gets a key (blanks stripped, A-Z lowered).  Keys of ``min_chars``
   code points or more become a 64-bit hash, once per document.
2. Per (hash, block of documents) the documents are counted and the largest id is
   kept; a second sum over the blocks gives the counts of the whole corpus.  A
   line in a third of all documents thus arrives as one row per block.
3. Per shard of hashes a minimal perfect hash is built over *all* distinct line
   hashes; it indexes compact arrays: 32-bit fingerprints, counts, largest ids.
4. The blocks' distinct hashes run through their shard's arrays.  Since each of
   them is a member, the fingerprint is a guard and the answer exact.
5. Hits, one per (block, line), meet the documents of the block; a document
   drops the lines found there unless it holds the largest id.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlewick.llm.common import BLANKS, lower_ascii, map_rows, staged, table, width

MIN_CHARS, MIN_DOCS = 40, 5
SHARD_KEYS = 1 << 18
LEVELS = 40


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    """64-bit finaliser; one salt per level."""
    x = x.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys.

    Level by level, keys that fall alone on a bit claim it and the others move
    on.  A key's index is the number of claimed bits before its own.
    """

    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.bits = np.unpackbits(words.view(np.uint8), bitorder="little").astype(bool)
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.rank = np.concatenate([[0], np.cumsum(self.bits, dtype=np.int64)])

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 2.0) -> PerfectHash:
        sizes, parts, left = [], [], np.unique(keys.astype(np.uint64))
        while len(left):
            if len(sizes) >= LEVELS:
                raise ValueError("no perfect hash found: keys are not distinct")
            size = max(64, int(gamma * len(left)))
            at = (_mix(left, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            parts.append(alone)
            left = left[~alone[at]]
        bits = np.concatenate(parts) if parts else np.zeros(0, bool)
        packed = np.packbits(bits, bitorder="little")
        words = np.zeros(-(-len(packed) // 8), np.uint64)
        words.view(np.uint8)[: len(packed)] = packed
        return cls(np.array(sizes, np.int64), words)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Index per key, -1 where no level claims it (then it is no member)."""
        keys = keys.astype(np.uint64)
        found = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            at = (_mix(keys[left], level) % np.uint64(size)).astype(np.int64) + self.starts[level]
            hit = self.bits[at]
            found[left[hit]] = self.rank[at[hit]]
            left = left[~hit]
            if not len(left):
                break
        return found


def _fingerprint(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys, 1_000) >> np.uint64(32)).astype(np.uint32)


def pack_shard(keys: np.ndarray, counts: np.ndarray, largest: np.ndarray) -> bytes:
    """Arrays of one shard: level sizes, bits, then fingerprint, count and largest id by index."""
    phf = PerfectHash.build(keys)
    at = phf.index(keys)
    arrays = [np.empty(len(keys), np.uint32), np.empty(len(keys), np.uint32), np.empty(len(keys), np.int64)]
    for array, values in zip(arrays, (_fingerprint(keys.astype(np.uint64)), np.minimum(counts, 2**32 - 1), largest)):
        array[at] = values
    head = struct.pack("<3q", len(phf.sizes), len(phf.words), len(keys))
    return b"".join([head, phf.sizes.tobytes(), phf.words.tobytes(), arrays[2].tobytes(), arrays[0].tobytes(), arrays[1].tobytes()])


class Shard:
    def __init__(self, blob: bytes):
        levels, words, n = struct.unpack_from("<3q", blob)
        at = 24
        self.phf = PerfectHash(np.frombuffer(blob, np.int64, levels, at), np.frombuffer(blob, np.uint64, words, at + 8 * levels))
        at += 8 * (levels + words)
        self.largest = np.frombuffer(blob, np.int64, n, at)
        self.prints = np.frombuffer(blob, np.uint32, n, at + 8 * n)
        self.counts = np.frombuffer(blob, np.uint32, n, at + 12 * n)

    def probe(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, largest id) per key; count 0 for keys that are no members."""
        keys = keys.astype(np.uint64)
        at = self.phf.index(keys)
        known = at >= 0
        known[known] = self.prints[at[known]] == _fingerprint(keys[known])
        count, largest = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        count[known], largest[known] = self.counts[at[known]], self.largest[at[known]]
        return count, largest


def line_hashes(text, min_chars: int):
    """Hash per line; NULL for lines whose key is too short."""
    key = lambda line: lower_ascii(F.trim(line, F.lit(BLANKS)))
    return F.transform(F.split(text, "\n", -1), lambda line: F.when(F.char_length(key(line)) >= min_chars, F.xxhash64(key(line))))


def line_shards(pairs: DataFrame, shards: int) -> DataFrame:
    """(shard, blob) from (hash, documents, largest) rows, one per block and hash."""
    totals = (
        pairs.withColumn("shard", F.expr(f"CAST(pmod(hash, {shards}) AS INT)"))
        .groupBy("shard", "hash")
        .agg(F.sum("documents").alias("documents"), F.max("largest").alias("largest"))
    )

    def build(key, rows):
        get = lambda c: rows.column(c).to_numpy()
        blob = pack_shard(get("hash").view(np.uint64), get("documents"), get("largest"))
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "blob": pa.array([blob], pa.binary())})

    return totals.groupBy("shard").applyInArrow(build, "shard int, blob binary")


def _probe(batches, min_docs: int):
    """Rows come sorted by (shard, kind): the arrays first, then the blocks' hashes."""
    out = pa.schema([("block", pa.int32()), ("hash", pa.int64()), ("largest", pa.int64())])
    held, shard = None, None
    for batch in batches:
        shards = batch.column(0).to_numpy()
        edges = np.concatenate([[0], np.flatnonzero(np.diff(shards)) + 1, [batch.num_rows]]) if batch.num_rows else [0]
        for a, b in zip(edges[:-1], edges[1:]):
            part = batch.slice(a, b - a)
            if held != shards[a]:
                held, shard, part = shards[a], Shard(part.column(4)[0].as_py()), part.slice(1)
            if part.num_rows:
                keys = part.column(3).to_numpy()
                count, largest = shard.probe(keys.view(np.uint64))
                heavy = np.flatnonzero(count >= min_docs)
                if len(heavy):
                    yield pa.RecordBatch.from_arrays([part.column(2).take(pa.array(heavy)), pa.array(keys[heavy]), pa.array(largest[heavy])], schema=out)


def shared_line_drop(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, shard_keys: int = SHARD_KEYS, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped, *carry) per row of ``docs`` (needs doc_id and text; columns not carried are ignored).

    A NULL text is one empty line.  Rows with equal ids are separate documents
    and keep or lose a line alike.  A NULL id never is the largest; lines found
    only in documents without id stay.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.struct(F.lit(0).alias("_"), *carry).alias("carried"))
    # Documents are grouped into blocks, so that a line of a third of all documents is one row per block.
    blocks = max(64, 4 * width(spark))
    block = F.expr(f"CAST(pmod(xxhash64(doc_id), {blocks}) AS INT)")
    pairs = staged(
        docs.select(block.alias("block"), "doc_id", F.explode(F.array_distinct(F.array_compact(line_hashes(F.col("text"), min_chars)))).alias("hash"))
        .groupBy("block", "hash")
        .agg(F.count(F.lit(1)).alias("documents"), F.max("doc_id").alias("largest"))
        .withColumn("largest", F.coalesce("largest", F.lit(-(2**63))))
    )
    # Row counts of the staged table bound the distinct hashes, hence the size of a shard's arrays.
    shards = max(4 * width(spark), -(-pairs.count() // shard_keys))
    index = line_shards(pairs, shards)
    shard = F.expr(f"CAST(pmod(hash, {shards}) AS INT)")
    none = lambda kind: F.lit(None).cast(kind)
    probes = pairs.select(shard.alias("shard"), F.lit(1).alias("kind"), "block", "hash", none("binary").alias("blob"))
    arrays = index.select("shard", F.lit(0).alias("kind"), none("int").alias("block"), none("long").alias("hash"), "blob")

    hits = arrays.unionByName(probes).repartition(width(spark), "shard").sortWithinPartitions("shard", "kind").mapInArrow(lambda batches: _probe(batches, min_docs), "block int, hash long, largest long")
    out = _apply(docs.withColumn("block", block), hits, min_chars)
    return out.select("doc_id", "text", "n_lines", "n_dropped", *[F.col(f"carried.{c}").alias(c) for c in carry])


def _apply(docs: DataFrame, hits: DataFrame, min_chars: int) -> DataFrame:
    """Documents meet the hits of their block: hits first, then texts, one after the other."""
    none = lambda kind: F.lit(None).cast(kind)
    left = hits.select("block", F.lit(0).alias("kind"), none("long").alias("doc_id"), none("string").alias("text"), "hash", "largest", none(docs.schema["carried"].dataType).alias("carried"))
    right = docs.select("block", F.lit(1).alias("kind"), "doc_id", "text", none("long").alias("hash"), none("long").alias("largest"), "carried")
    both = left.unionByName(right).repartition(width(docs.sparkSession), "block").sortWithinPartitions("block", "kind")
    both = both.select("block", "kind", "doc_id", "text", "hash", "largest", F.when(F.col("kind") == 1, line_hashes(F.col("text"), min_chars)).alias("hashes"), "carried")
    kind = T.StructType([*T.StructType.fromDDL("doc_id long, text string, n_lines long, n_dropped long").fields, docs.schema["carried"]])

    def rows(stream):
        at, largest_of = None, {}
        for block, is_doc, doc_id, text, hash_, largest, hashes, carried in stream:
            if block != at:
                at, largest_of = block, {}
            if not is_doc:
                largest_of[hash_] = largest
                continue
            lines = text.split("\n")
            kept = [line for line, h in zip(lines, hashes) if not _loses(largest_of.get(h) if h is not None else None, doc_id)]
            yield doc_id, "\n".join(kept), len(lines), len(lines) - len(kept), carried

    return map_rows(both, rows, kind)


def _loses(largest: int | None, doc_id: int | None) -> bool:
    return largest is not None and largest != -(2**63) and doc_id != largest


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_line_drop(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH doc AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
line AS (SELECT doc_id, generate_subscripts(lines, 1) AS i, unnest(lines) AS line FROM doc),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM line),
heavy AS (SELECT key, max(doc_id) AS largest FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT k.*, h.key IS NOT NULL AND k.doc_id <> h.largest AS gone FROM keyed k LEFT JOIN heavy h USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
