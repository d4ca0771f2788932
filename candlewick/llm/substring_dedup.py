"""Removal of repeated lines, paragraphs and passages by hashing normalised words.

Every line of at least ``unit_words`` words is a unit, and so is every paragraph (lines up to a blank one);
their normalised words give a digest.  Besides, passages that repeat inside lines: all windows of ``WINDOW_WORDS``
words are hashed and of each ``PICK`` windows in a row the least hashes are taken, so two
copies of a passage give the same windows wherever they stand.  Windows taken overlap; those of a
passage leave out less than ``PICK`` words at either end.  Digests are grouped over the corpus.  The
occurrence of the lowest rank (doc_id, then position) stays; removed are later units, and words
that only later occurrences cover in runs of at least ``RUN_WORDS``: every repeat of
``RUN_WORDS + 2 * (PICK - 1)`` words or more is found.  Offsets refer to the original text.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlewick.llm.common import map_rows, rows_in, table, width

WINDOW_WORDS = 10
PICK = 6  # at most WINDOW_WORDS, so that windows taken leave no word between them
RUN_WORDS = 25
UNIT_WORDS = WINDOW_WORDS  # of the query: shorter lines (headings, stock phrases, single words) are no repeats of their own
RECORDS = 1 << 19
SENT = 1 << 16  # records per Arrow batch
BUCKET_CHARS = 1 << 23  # text per bucket; about as many records as a task holds before it settles them
WORD = re.compile(r"[^ \t\n\x0b\x0c\r]+")
_U = np.uint64
_RECORD = np.dtype([("digest", "<u8"), ("doc", "<i8"), ("key", "<i8"), ("at", "<i4")])
NO_ID = 2**63 - 1  # rank of documents without id: the last


def _mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    x = x + _U((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Words:
    """text -> a 64-bit hash per word (case folded, outer punctuation off, kept if nothing is left), words per line."""

    KEPT = 300_000

    def __init__(self):
        import xxhash

        self.known, self.hash = {}, xxhash.xxh3_64_intdigest

    def _new(self, word: str) -> int:
        bare = word.casefold()
        core = bare.strip(".,;:!?\"'()[]{}«»„“”‚‘’…")
        h = self.hash((core or bare).encode("utf-8", "surrogatepass"))
        self.known[word] = h
        return h

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > self.KEPT:
            self.known.clear()
        get, new = self.known.get, self._new
        lines = [WORD.findall(line) for line in text.split("\n")]
        codes = np.array([h if (h := get(w)) is not None else new(w) for line in lines for w in line], _U)
        return codes, np.array([len(line) for line in lines], np.int64)


def _picked(grams: np.ndarray) -> np.ndarray:
    """Positions of the least of each PICK hashes in a row; they depend on nothing but these."""
    n = len(grams) - PICK + 1
    if n < 1:
        return np.flatnonzero(grams == grams.min()) if len(grams) else np.zeros(0, np.int64)
    least = np.minimum.reduce([grams[d : n + d] for d in range(PICK)])
    taken = np.zeros(len(grams), bool)
    for d in range(PICK):
        taken[d : n + d] |= grams[d : n + d] == least
    return np.flatnonzero(taken)


def _units(lines: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, end word) of the lines that hold words and of the paragraphs of several, by place; those of ``least`` words or more."""
    full = np.concatenate([[0], (lines > 0).astype(np.int8), [0]])
    stops = np.cumsum(lines)
    starts = stops - lines
    first, last = np.flatnonzero(np.diff(full) == 1), np.flatnonzero(np.diff(full) == -1) - 1
    several = last > first
    starts = np.concatenate([starts[lines > 0], starts[first[several]]])
    stops = np.concatenate([stops[lines > 0], stops[last[several]]])
    long = stops - starts >= least
    starts, stops = starts[long], stops[long]
    order = np.argsort(starts, kind="stable")
    return starts[order], stops[order]


def windows(codes: np.ndarray, lines: np.ndarray, unit_words: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(digest, first word, end word) of a text's units, then of its windows; the number of units."""
    n = len(codes)
    base = 0xD6E8FEB86659FD93
    powers = np.cumprod(np.concatenate([[_U(1)], np.full(n, base, _U)]), dtype=_U)
    inverse = np.cumprod(np.concatenate([[_U(1)], np.full(n, pow(base, -1, 1 << 64), _U)]), dtype=_U)
    sums = np.concatenate([[_U(0)], np.cumsum(codes * powers[:n], dtype=_U)])

    def digest(starts, stops, salt):
        return _mix((sums[stops] - sums[starts]) * inverse[starts] + (stops - starts).astype(_U), salt)

    starts, stops = _units(lines, unit_words)
    units = digest(starts, stops, 3)
    every = np.arange(max(n - WINDOW_WORDS + 1, 0))
    grams = digest(every, every + WINDOW_WORDS, 2)
    at = _picked(grams)
    return np.concatenate([units, grams[at]]), np.concatenate([starts, at]), np.concatenate([stops, at + WINDOW_WORDS]), len(units)


def _covered(starts: np.ndarray, stops: np.ndarray, n: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, stops, -1)
    return np.cumsum(edge[:-1]) > 0


def _runs(cover: np.ndarray) -> list[tuple[int, int]]:
    change = np.flatnonzero(np.diff(np.concatenate([[0], cover.astype(np.int8), [0]])))
    return list(zip(change[::2], change[1::2]))


def removed(text: str, codes: np.ndarray, lines: np.ndarray, late: np.ndarray, unit_words: int = 1) -> list[tuple[int, int]]:
    """Code point spans to remove, given the numbers of units and windows that are later occurrences."""
    _, starts, stops, n_units = windows(codes, lines, unit_words)
    hit = np.unique(late)
    units = hit[hit < n_units]
    cover = _covered(starts[units], stops[units], len(codes))
    for a, b in _runs(_covered(starts[hit], stops[hit], len(codes))):
        if b - a >= RUN_WORDS:
            cover[a:b] = True
    runs = _runs(cover)
    if not runs:
        return []
    places = [m.span() for m in WORD.finditer(text)]
    return [(places[a][0], places[b - 1][1]) for a, b in runs]


def _emit(buckets: int, unit_words: int):
    def rows(stream):
        words, held, n = Words(), [], 0
        for doc, key, text in stream:
            digest = windows(*words(text), unit_words)[0]
            if len(digest):
                part = np.empty(len(digest), _RECORD)
                part["digest"], part["doc"], part["key"], part["at"] = digest, doc, key, np.arange(len(digest))
                held.append(part)
                n += len(part)
            if n > RECORDS:
                yield from _settle(np.concatenate(held), buckets)
                held, n = [], 0
        if held:
            yield from _settle(np.concatenate(held), buckets)

    return rows


def _later(records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted records and which of them have an earlier one of their digest."""
    records = records[np.lexsort((records["at"], records["key"], records["doc"], records["digest"]))]
    late = np.zeros(len(records), bool)
    late[1:] = records["digest"][1:] == records["digest"][:-1]
    # rows that repeat a document are no later occurrence of themselves
    same = late.copy()
    for name in ("doc", "key", "at"):
        same[1:] &= records[name][1:] == records[name][:-1]
    if same.any():
        first = np.maximum.accumulate(np.where(~late, np.arange(len(records)), 0))
        late &= np.any([records[name] != records[name][first] for name in ("doc", "key", "at")], axis=0)
    return records, late


def _settle(records: np.ndarray, buckets: int):
    """A task's records: the first of each digest goes on to its bucket, the others are late already."""
    records, late = _later(records)
    ahead = np.concatenate([[True], records["digest"][1:] != records["digest"][:-1]])
    lead = records[ahead]
    bucket = ((lead["digest"] >> _U(32)) * _U(buckets)) >> _U(32)
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    for a, b in zip(cut, np.append(cut[1:], len(lead))):
        yield int(bucket[a]), None, None, lead[a:b].tobytes()
    for doc, key, at in _by_doc(records[late]):
        # by document, not by text: copies of one text go to many buckets
        yield int(_mix(np.array([doc ^ key], np.int64).view(_U))[0] % _U(buckets)), doc, key, at


def _by_doc(records: np.ndarray):
    """(doc, key, packed numbers) per document; rows that repeat a document say the same once."""
    if len(records):
        records = records[np.lexsort((records["at"], records["key"], records["doc"]))]
        doc, key = records["doc"], records["key"]
        cut = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])]))
        for a, b in zip(cut, np.append(cut[1:], len(records))):
            yield int(doc[a]), int(key[a]), np.unique(records["at"][a:b]).astype("<i4").tobytes()


def _each(records: np.ndarray) -> tuple[np.ndarray, ...]:
    """(doc, key, at) columns, by document, equal rows once."""
    order = np.lexsort((records["at"], records["key"], records["doc"]))
    columns = [records[name][order] for name in ("doc", "key", "at")]
    new = np.ones(len(order), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return tuple(c[new] for c in columns)


def _unpacked(rows: list[tuple[int, int, np.ndarray]]) -> tuple[np.ndarray, ...]:
    """The same columns from (doc, key, numbers) rows."""
    lengths = [len(at) for _, _, at in rows]
    doc, key = (np.repeat(np.array([r[i] for r in rows], "<i8"), lengths) for i in (0, 1))
    return doc, key, np.concatenate([at for _, _, at in rows])


def late_windows(docs: DataFrame, unit_words: int = 1) -> DataFrame:
    """(doc, key, at): a row per unit or window of the documents (doc, key, text) that occurs earlier elsewhere.

    A task holds one bucket of records at a time; buckets grow in number with the text, not in size.  A row is one
    record: rows that gather a document's records per bucket would grow with documents times buckets.
    """
    spark = docs.sparkSession
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(4 * width(spark), chars // BUCKET_CHARS)
    emitted = map_rows(docs, _emit(buckets, unit_words), "bucket int, doc long, key long, packed binary")
    dealt = emitted.repartition(width(spark), "bucket").sortWithinPartitions("bucket")
    out = pa.schema([("doc", pa.int64()), ("key", pa.int64()), ("at", pa.int32())])

    def sent(columns):
        for a in range(0, len(columns[0]), SENT):
            yield pa.RecordBatch.from_arrays([pa.array(c[a : a + SENT]) for c in columns], schema=out)

    def meet(batches):
        def close():
            records, late = _later(np.concatenate(held))
            yield from sent(_each(records[late]))

        bucket_at, held, rows, n = None, [], [], 0
        for bucket, doc, key, packed in rows_in(batches):
            if bucket != bucket_at and held:
                yield from close()
                held = []
            bucket_at = bucket
            if doc is None:
                held.append(np.frombuffer(packed, _RECORD))
                continue
            rows.append((doc, key, np.frombuffer(packed, "<i4")))
            n += len(rows[-1][2])
            if n > SENT:
                yield from sent(_unpacked(rows))
                rows, n = [], 0
        if held:
            yield from close()
        if rows:
            yield from sent(_unpacked(rows))

    return dealt.mapInArrow(meet, T.StructType.fromDDL("doc long, key long, at int"))


def drop_repeats(docs: DataFrame, unit_words: int = 1) -> DataFrame:
    """(doc_id, text, removed array<struct<start, end>>), a row per row of ``docs`` (needs doc_id and text).

    ``text`` is what stays, ``removed`` the spans of the original.  NULL text is empty.  Rows of equal id and
    text count as one document and keep or lose the same parts; other rows of equal id are documents of their
    own, by a hash of the text.  NULL ids rank last.  An empty table gives no rows.  Lines and paragraphs of fewer than
    ``unit_words`` words go only as parts of longer repeats; at 1 every repeated line goes, even of a single word.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    no_id = F.col("doc_id").isNull()
    key = F.when(no_id, F.xxhash64("text", F.lit(NO_ID))).otherwise(F.xxhash64("text"))
    keyed = texts.select("doc_id", "text", F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), key.alias("key"))
    # dealt before they are grouped: partial lists of each task would grow in number with documents times tasks
    late = late_windows(keyed.select("doc", "key", "text"), unit_words).repartition("doc", "key")
    late = late.groupBy("doc", "key").agg(F.collect_list("at").alias("at"))  # a document's own
    both = keyed.join(late, ["doc", "key"], "left").select("doc_id", "text", "at")

    def rows(stream):
        words = Words()
        for doc_id, text, at in stream:
            spans = removed(text, *words(text), np.array(at, np.int64), unit_words) if at else []
            kept, done = [], 0
            for a, b in spans:
                kept.append(text[done:a])
                done = b
            yield doc_id, "".join(kept) + text[done:] if spans else text, [{"start": a, "end": b} for a, b in spans]

    return map_rows(both, rows, "doc_id long, text string, removed array<struct<start: int, end: int>>")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeats(table(spark, sf_dir, "documents"), UNIT_WORDS)
    return out.select("doc_id", F.size("removed").cast("long").alias("n_removed"), "removed", "text")
