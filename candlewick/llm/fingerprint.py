"""Lempel-Ziv phrase fingerprints.

A text is parsed into dictionary phrases: each phrase is the longest one met before
plus one code point.  The set of phrases is hashed, and a minimum-hash signature of
it is the fingerprint; the share of equal slots estimates the likeness of the sets,
which behaves like likeness under compression.
"""

from __future__ import annotations

import gc
import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candlewick.llm.common import map_rows, staged, table, width

SLOTS = 64
STEP = 1 << 12  # phrases hashed at once
_MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15  # odd, hence invertible modulo 2**64
INVERSE = pow(BASE, -1, 1 << 64)
_random = np.random.default_rng(20)
SCALE = (_random.integers(0, 2**63, SLOTS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
SHIFT = _random.integers(0, 2**63, SLOTS, dtype=np.uint64)


class Phrases:
    """Phrase ends of a text, parsed piece by piece; the last pieces can be taken back."""

    def __init__(self):
        self.root: dict = {}
        self.node = self.root
        self.ends: list[int] = []
        self.read = 0

    def feed(self, text: str, undo: list | None = None) -> None:
        root, node, ends = self.root, self.node, self.ends
        for i, c in enumerate(text, self.read + 1):
            following = node.get(c)
            if following is None:
                node[c] = {}
                if undo is not None:
                    undo.append((node, c))
                ends.append(i)
                node = root
            else:
                node = following
        self.node, self.read = node, self.read + len(text)

    def trial(self, text: str) -> list[int]:
        """All phrase ends as if ``text`` came next; an unfinished phrase at the end counts."""
        node, read, n, undo = self.node, self.read, len(self.ends), []
        self.feed(text, undo)
        ends = self.ends + ([self.read] if self.node is not self.root else [])
        self.node, self.read = node, read
        del self.ends[n:]
        for parent, c in undo:
            parent.pop(c, None)
        return ends


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64) if n else out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def phrase_hashes(text: str, ends: list[int]) -> np.ndarray:
    """Hash of every phrase from sums of c * BASE**i, shifted back to the phrase's start."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * _powers(BASE, len(codes)), out=sums[1:])
    end = np.asarray(ends, np.int64)
    start = np.concatenate([[0], end[:-1]]) if len(end) else end
    value = (sums[end] - sums[start]) * _powers(INVERSE, len(codes) + 1)[start]
    return _mix(value + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def signature(hashes: np.ndarray) -> bytes:
    """One byte per slot: the low bits of the least hash under each of SLOTS maps."""
    if not len(hashes):
        return bytes(SLOTS)
    least = np.full(SLOTS, _MASK, np.uint64)
    for at in range(0, len(hashes), STEP):
        part = hashes[at : at + STEP] * SCALE[:, None] + SHIFT[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    return (_mix(least) & np.uint64(0xFF)).astype(np.uint8).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Estimated likeness of the phrase sets; chance agreement of one in 256 is taken out."""
    equal = sum(x == y for x, y in zip(a, b)) / SLOTS
    return max(0.0, (equal - 1 / 256) / (1 - 1 / 256))


def fingerprint(text: str) -> bytes:
    phrases = Phrases()
    return signature(phrase_hashes(text, phrases.trial(text)))


def edited(text: str, following: str) -> str:
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def _both(text: str, following: str) -> tuple[bytes, bytes, str]:
    """Fingerprints of the text and of its edited form; their common start is parsed once."""
    k = len(text) // 4
    head, phrases = text[: len(text) - k], Phrases()
    phrases.feed(head)
    other = head + following[:k]
    own = signature(phrase_hashes(text, phrases.trial(text[len(head) :])))
    return own, signature(phrase_hashes(other, phrases.trial(following[:k]))), other


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _row(doc_id, text: str, mine: bytes, changed: bytes, other: str, following: bytes) -> tuple:
    digest = hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, len(text), digest, mine.hex(), changed.hex(), likeness(mine, changed), likeness(mine, following)


def _inner(pending: tuple, following: bytes) -> tuple:
    doc_id, n, digest, mine, changed, near, following_near = _row(*pending, following)
    return "row", doc_id, None, n, *map(bytes.fromhex, (digest, mine, changed)), [near, following_near]


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of each document, of its edited text, and likeness to both it and the next document.

    Documents are ordered by doc_id (NULL first), then by a hash of the text; the last one is followed by the first.
    NULL text is empty; empty texts have the all-zero fingerprint and equal each other.  A table
    of one row is followed by itself; an empty one gives no rows.  Other columns are ignored.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]  # short keys: a sample of them goes to the driver
    placed = texts.repartitionByRange(width(spark), *order).sortWithinPartitions(*order).select("doc_id", "text")

    def rows(stream):
        """Every document of a sorted partition but the last, which is handed on with its text, as is the first one."""
        gc.disable()  # the parse makes many small dictionaries and no cycles
        previous = pending = None
        for doc_id, text in stream:
            if previous is None:
                yield ("first", doc_id, text, *[None] * 5)
            else:
                mine, changed, other = _both(previous[1], text)
                if pending is not None:
                    yield _inner(pending, mine)
                pending = (*previous, mine, changed, other)
            previous = (doc_id, text)
        if previous is not None:
            if pending is not None:
                yield _inner(pending, fingerprint(previous[1]))
            yield ("last", *previous, *[None] * 5)
        gc.enable()

    out = staged(map_rows(placed, rows, "kind string, doc_id long, text string, n_chars long, digest binary, mine binary, changed binary, near array<double>"))
    inner = out.filter("kind = 'row'").select(
        "doc_id", "n_chars", F.lower(F.hex("digest")).alias("edited_sha256"), F.lower(F.hex("mine")).alias("fingerprint"),
        F.lower(F.hex("changed")).alias("edited_fingerprint"), F.col("near")[0].alias("near_edited"), F.col("near")[1].alias("near_next"),
    )
    return inner.unionByName(_seams(out.filter("kind != 'row'").select("kind", "doc_id", "text")))


def _seams(ends: DataFrame) -> DataFrame:
    """The last document of each partition with the first of the next one, the very last with the very first.

    ``ends`` holds two rows per partition.
    """
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("kind")]  # of one document both first and last, first comes first
    w = Window.orderBy(*order)
    every = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    near = ends.withColumns({"following": F.coalesce(F.lead("text").over(w), F.first("text").over(every))}).filter("kind = 'last'")

    def rows(stream):
        for doc_id, text, following in stream:
            mine, changed, other = _both(text, following)
            yield _row(doc_id, text, mine, changed, other, fingerprint(following))

    return map_rows(near.select("doc_id", "text", "following").repartition(width(ends.sparkSession)), rows, OUT)


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
