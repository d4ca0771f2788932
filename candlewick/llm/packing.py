"""Packing token sequences into fixed windows by best-fit decreasing.

Tokens are counted and cut where the text lies; only lengths and checksums are
shuffled.  Full windows stand alone.  What is left of each document goes to one of
many shards of a few thousand pieces, each packed on its own: longest piece first,
into the open window whose remaining capacity is the smallest that suffices.  A
segment tree over the capacities 1..1024 finds that window in ten steps.
"""

from __future__ import annotations

import base64
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.llm.common import map_rows, table

WINDOW = 1024
SHARD_DOCS = 4096
TOKENIZER = "byte_bpe_50k"
SPECIAL = "<|"


class CapacityTree:
    """Open windows by remaining capacity; finds the tightest that still fits."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.best = [0] * (2 * self.size)  # number of open windows below each node
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, capacity: int, window: int) -> None:
        self.open[capacity].append(window)
        self._count(capacity, 1)

    def _count(self, capacity: int, step: int) -> None:
        node = self.size + capacity
        while node:
            self.best[node] += step
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(capacity, window) with the smallest capacity of at least ``need``, removed from the tree."""
        node, best = self.size + need, self.best
        if not best[node]:
            # climb until a right neighbour holds something, then go down to its left-most leaf
            while node > 1 and (node & 1 or not best[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node *= 2
                if not best[node]:
                    node += 1
        capacity = node - self.size
        self._count(capacity, -1)
        return capacity, self.open[capacity].pop()


def best_fit(lengths: list[int], window: int = WINDOW) -> tuple[list[int], list[int]]:
    """Window number and offset per piece; ``lengths`` must be in decreasing order."""
    tree, windows, offsets, used = CapacityTree(window), [], [], 0
    for length in lengths:
        found = tree.take(length)
        if found is None:
            capacity, number = window, used
            used += 1
        else:
            capacity, number = found
        windows.append(number)
        offsets.append(window - capacity)
        if capacity > length:
            tree.add(capacity - length, number)
    return windows, offsets


def encoder(tokenizer: str = TOKENIZER):
    """text -> token ids.  ``tokenizer`` is a file name of the public set or a path without suffix.

    Two libraries read the same vocabulary; the quicker one encodes ordinary
    text, the other one texts that may hold a special token's string.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    place = lambda suffix: tokenizer + suffix if "/" in tokenizer else public_tokenizers.path(tokenizer + suffix)
    with open(place(".tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    quick = tiktoken.Encoding(tokenizer, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    full = Tokenizer.from_file(place(".json"))

    def encode(text: str) -> list[int]:
        if SPECIAL in text:
            return full.encode(text, add_special_tokens=False).ids
        return quick.encode_ordinary(text)

    return encode


def token_windows(docs: DataFrame, window: int = WINDOW, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, doc_tokens, crcs): one checksum per full window and one for the rest, if any."""

    def rows(stream):
        import numpy as np

        encode = encoder(tokenizer)
        for doc_id, text in stream:
            ids = np.append(np.asarray(encode(text), dtype="<u4"), np.uint32(0)).astype("<u4")
            yield doc_id, len(ids), [zlib.crc32(ids[a : a + window].tobytes()) for a in range(0, len(ids), window)]

    return map_rows(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), rows, "doc_id long, doc_tokens long, crcs array<long>")


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, window: int = WINDOW, tokenizer: str = TOKENIZER, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """One row per piece of each document: its place in the document and in a sequence.

    A NULL or empty text is the single end token.  Rows with equal or NULL ids are
    packed one by one.  Sequence ids are unique, not consecutive.  An empty table
    gives no rows.
    """
    # A shard holds about shard_docs rows whatever the table's size, as rows are dealt by a hash of id and length.
    shards = max(1, -(-docs.count() // shard_docs))
    tokens = token_windows(docs, window, tokenizer)
    shard = F.expr(f"CAST(pmod(xxhash64(doc_id, doc_tokens, crcs), {shards}) AS LONG)")

    def run(key, rows):
        rows = rows.sort_by([("doc_tokens", "descending"), ("doc_id", "ascending"), ("first", "ascending")])
        ids, totals, crcs = (rows.column(c).to_pylist() for c in ("doc_id", "doc_tokens", "crcs"))
        order = sorted((i for i, n in enumerate(totals) if n % window), key=lambda i: -(totals[i] % window))
        numbers, offsets = best_fit([totals[i] % window for i in order], window)
        base, used = key[0].as_py() << 36, max(numbers, default=-1) + 1
        out = []
        for i, number, offset in zip(order, numbers, offsets):
            rest = totals[i] % window
            out.append((ids[i], totals[i] - rest, rest, crcs[i][-1], totals[i], base + number, offset))
        for doc_id, total, own in zip(ids, totals, crcs):
            for j in range(total // window):
                out.append((doc_id, j * window, window, own[j], total, base + used, 0))
                used += 1
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, zip(*out) if out else [[]] * 7)})

    return tokens.withColumn("first", F.element_at("crcs", 1)).groupBy(shard.alias("shard")).applyInArrow(run, PIECES)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
