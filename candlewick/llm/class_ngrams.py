"""Language-model scores from Brown's class-based n-grams.

Exchange clustering puts every word met twice or more into one of CLASSES classes:
in each round half of the words, by hash, are tried in every class, and each goes
where the likelihood of its neighbours given the class gains most.  The neighbours
told apart are the FREQUENT most frequent words, a text's border and all others, so
that a round needs the words' counts but not the corpus.  Words met once and words
never met share a class of their own: once left out, the former are the latter.

A text's probability is the product of P(class | class before) * P(word | class),
with the border as first and last class.  Transitions are smoothed towards the
classes' shares; the class of rare words is given, after Good and Turing, the mass of
unseen words and that of words met once.

Texts are read once, into blocks that hold a dictionary of their distinct words and
the texts as numbers in it.  What the corpus knows of a word meets a block as one
row per distinct word.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from candlewick.llm.common import map_rows, rows_in, staged, table, width, written

CLASSES, FREQUENT, ROUNDS = 64, 512, 6
BORDER, RARE = CLASSES, CLASSES + 1  # two more classes
KINDS = CLASSES + 2
OTHER = FREQUENT + 1  # contexts on a side: the frequent words, the border, all others
SIDE = FREQUENT + 2
ADDED = 0.1  # of the base score
PRIOR = float(KINDS)  # pseudo-transitions out of every class
BLOCK_TOKENS = 1 << 20
HELD = 1 << 21  # context counts that a task keeps before it sends them, or merges them
PACK_WORDS = 1 << 14
STRIP = 1 << 13  # context counts times classes compared at once


def held_out(doc_id):
    """crc32 of the id as text, modulo 10, is 0; a NULL id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def _squeezed(values: np.ndarray) -> bytes:
    return zlib.compress(values.tobytes(), 1)


def _opened(cell: bytes, kind) -> np.ndarray:
    return np.frombuffer(zlib.decompress(cell), kind)


BLOCKS = "block long, words binary, counts binary, ids binary, absent binary, held binary, lengths binary, tokens binary"


def blocks(docs: DataFrame) -> DataFrame:
    """A row per block of consecutive documents: hashes of its distinct words, their counts in training texts, and the
    documents' ids, parts and lengths with the words of all of them as positions in the dictionary."""

    def rows(stream):
        number, part = 0, -1
        words, texts, tokens = None, [], 0

        def close():
            numbers = np.concatenate([x[2] for x in texts])
            counts = np.bincount(np.concatenate([x[2] for x in texts if not x[1]] or [np.zeros(0, np.uint32)]), minlength=len(words))
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
            ids = np.array([0 if x[0] is None else x[0] for x in texts], np.int64)
            absent, held = (np.array(x, np.uint8) for x in ([x[0] is None for x in texts], [x[1] for x in texts]))
            lengths = np.array([len(x[2]) for x in texts], np.int64)
            yield part << 31 | number, hashes.tobytes(), counts.tobytes(), ids.tobytes(), absent.tobytes(), held.tobytes(), lengths.tobytes(), _squeezed(numbers)

        for doc_id, held, text, part in stream:
            if words is None:
                words = defaultdict()
                words.default_factory = words.__len__
            pieces = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z, and the six ASCII blanks
            texts.append((doc_id, held, np.fromiter(map(words.__getitem__, pieces), np.uint32, len(pieces))))
            tokens += len(pieces) + 1
            if tokens >= BLOCK_TOKENS:
                yield from close()
                words, texts, tokens, number = None, [], 0, number + 1
        if texts:
            yield from close()

    doc_id = F.col("doc_id").cast("long")
    read = docs.select(doc_id.alias("doc_id"), held_out(F.col("doc_id")).alias("held"), F.coalesce("text", F.lit("")).alias("text"), F.spark_partition_id().cast("long").alias("part"))
    return map_rows(read, rows, BLOCKS, 1)


def _arrays(df: DataFrame, make, schema: str) -> DataFrame:
    """``make`` maps rows to tuples of equally long arrays, which become rows."""
    kind = T.StructType.fromDDL(schema)

    def run(batches):
        for columns in make(rows_in(batches, 1)):
            for at in range(0, len(columns[0]), 1 << 15):
                yield pa.RecordBatch.from_arrays([pa.array(c[at : at + (1 << 15)]) for c in columns], names=kind.names)

    return df.mapInArrow(run, kind)


def vocabulary(read: DataFrame) -> DataFrame:
    """(word, n): hash and count of every word of the training texts."""

    def make(stream):
        for words, counts in stream:
            words, counts = np.frombuffer(words, np.int64), np.frombuffer(counts, np.int64)
            yield words[counts > 0], counts[counts > 0]

    return _arrays(read.select("words", "counts"), make, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _merged(words: np.ndarray, context: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums per distinct (word, context), in that order."""
    names, number = np.unique(words, return_inverse=True)
    key, back = np.unique(number * (2 * SIDE) + context, return_inverse=True)
    return names[key // (2 * SIDE)], key % (2 * SIDE), np.bincount(back, weights=n, minlength=len(key)).astype(np.int64)


def _cut(words: np.ndarray, context: np.ndarray, n: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """Cells of the entries between the cuts ``at``."""
    for i, (a, b) in enumerate(zip(at[:-1], at[1:])):
        if b > a:
            yield i, _squeezed(words[a:b]), _squeezed(context[a:b].astype(np.uint16)), _squeezed(n[a:b].astype(np.uint32 if n[a:b].max() < 1 << 32 else np.uint64))


def _counts(cell: bytes, entries: int) -> np.ndarray:
    raw = zlib.decompress(cell)
    return np.frombuffer(raw, np.uint32 if len(raw) == 4 * entries else np.uint64).astype(np.int64)


def contexts(read: DataFrame, frequent: list[int], tokens: int) -> DataFrame:
    """(class, words, contexts, counts) packs: for each word met twice or more how often each context stands left (or,
    SIDE higher, right) of it, with its first class.  Tasks merge what they have read before they send it."""
    buckets = max(width(read.sparkSession), -(-tokens // HELD))
    known = np.sort(np.array(frequent, np.int64))

    def send(stream):
        held, size = [], 0

        def flush():
            words, context, n = _merged(*(np.concatenate(x) for x in zip(*held)))
            bucket = ((words.view(np.uint64) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            yield from _cut(words[order], context[order], n[order], np.searchsorted(bucket[order], np.arange(buckets + 1)))

        for words, out, lengths, numbers in stream:
            words = np.frombuffer(words, np.int64)
            at = np.minimum(np.searchsorted(known, words), max(0, len(known) - 1))
            context = np.where(known[at] == words, at, OTHER) if len(known) else np.full(len(words), OTHER)
            context = np.append(context, FREQUENT)  # the border's number is behind the dictionary
            line = with_borders(_opened(numbers, np.uint32), np.frombuffer(lengths, np.int64), np.frombuffer(out, np.uint8) == 0, len(words))
            inner = np.flatnonzero(line != len(words))
            key = line[inner] * (2 * SIDE)
            key, n = np.unique(np.concatenate([key + context[line[inner - 1]], key + SIDE + context[line[inner + 1]]]), return_counts=True)
            held.append((words[key // (2 * SIDE)], key % (2 * SIDE), n))
            size += len(key)
            if size >= HELD:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    cells = "words binary, contexts binary, counts binary"
    sent = map_rows(read.select("words", "held", "lengths", "tokens"), send, f"bucket int, {cells}", 16)
    sent = sent.repartition(buckets, "bucket").sortWithinPartitions("bucket")

    def pack(stream):
        at, held, size = None, [], 0

        def close():
            words, context, n = _merged(*(np.concatenate(x) for x in zip(*held)))
            start = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]]))
            sizes = np.diff(np.append(start, len(words)))
            often = np.add.reduceat(n, start) > 2  # each occurrence counts left and right
            keep = np.repeat(often, sizes)
            words, context, n = words[keep], context[keep], n[keep]
            sizes = sizes[often]
            edge = np.append(0, np.cumsum(sizes))
            for a in range(0, len(sizes), PACK_WORDS):
                b = min(a + PACK_WORDS, len(sizes))
                for _, *cell in _cut(words, context, n, edge[[a, b]]):
                    first = first_classes(words[edge[a] : edge[b]], context[edge[a] : edge[b]], n[edge[a] : edge[b]])
                    yield first.tobytes(), *cell

        for bucket, words, context, n in stream:
            if bucket != at and held:
                yield from close()
                held, size = [], 0
            at = bucket
            words, context = _opened(words, np.int64), _opened(context, np.uint16).astype(np.int64)
            held.append((words, context, _counts(n, len(words))))
            size += len(words)
            if size >= 4 * HELD:
                held = [_merged(*(np.concatenate(x) for x in zip(*held)))]
                size = len(held[0][0])
        if held:
            yield from close()

    return map_rows(sent, pack, f"class binary, {cells}", 16)


def with_borders(numbers: np.ndarray, lengths: np.ndarray, use: np.ndarray, border: int) -> np.ndarray:
    """The words of the texts marked by ``use``, one behind the other, with the border before, between and behind them."""
    start = np.cumsum(lengths) - lengths
    out = np.full(int(lengths[use].sum()) + int(use.sum()) + 1, border, np.int64)
    fill = np.ones(len(out), bool)
    fill[np.append(0, np.cumsum(lengths[use] + 1))] = False
    out[fill] = numbers[np.repeat(use, lengths)] if len(start) else numbers
    return out


def _starts(words: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]])) if len(words) else np.zeros(0, np.int64)


def first_classes(words: np.ndarray, context: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A class by the word's most frequent neighbour, frequent ones only; without any, by the word's hash."""
    start = _starts(words)
    told = np.where(context % SIDE < FREQUENT, n, 0) * (4 * SIDE) + context
    most = np.maximum.reduceat(told, start) if len(start) else start
    spread = (words[start].view(np.uint64) >> np.uint64(7)).astype(np.int64)
    return np.where(most >= 4 * SIDE, most % (4 * SIDE) * 7919, spread).astype(np.int64).__mod__(CLASSES).astype(np.uint8)


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def exchanged(cls: np.ndarray, words: np.ndarray, context: np.ndarray, n: np.ndarray, sums: np.ndarray, turn: int) -> np.ndarray:
    """New classes of the words: those whose hash has the turn's parity go where the log likelihood
    sum f(n(class, context)) - 2 f(n(class)), f(x) = x log x, gains most; all others stay.  ``sums``: contexts by classes."""
    start = _starts(words)
    sizes = np.diff(np.append(start, len(words)))
    moving = np.flatnonzero((words[start] & 1) == (turn & 1))
    cls, total, done = cls.copy(), sums[:SIDE].sum(axis=0), _f(sums)
    edge = np.append(0, np.cumsum(sizes[moving]))
    at = 0
    while at < len(moving):
        stop = max(at + 1, int(np.searchsorted(edge, edge[at] + STRIP, side="right")) - 1)
        some = moving[at:stop]
        rows = np.repeat(start[some] - edge[at:stop] + edge[at], sizes[some]) + np.arange(edge[stop] - edge[at])
        own, many = np.repeat(cls[some], sizes[some]), n[rows].astype(np.float64)
        cell, before, line = sums[context[rows]], done[context[rows]], np.arange(len(rows))
        cell[line, own] -= many  # its own class without it
        before[line, own] = _f(cell[line, own])
        gain = np.add.reduceat(_f(cell + many[:, None]) - before, edge[at:stop] - edge[at])
        mine = np.add.reduceat(many, edge[at:stop] - edge[at]) / 2
        rest = np.repeat(total[None, :], len(some), axis=0)
        rest[np.arange(len(some)), cls[some]] -= mine
        gain -= 2 * (_f(rest + mine[:, None]) - _f(rest))
        cls[some] = gain.argmax(axis=1)
        at = stop
    return cls


def clustered(packs: DataFrame, rounds: int, forget: Callable[[], None] | None = None) -> DataFrame:
    """(word, n, cls) by exchange; ``forget`` deletes the packs' files.  A round reads the packs, writes them with their new classes and the sums of classes by
    contexts (a table of fixed size) that the next round starts from."""
    spark = packs.sparkSession
    cells = "class binary, words binary, contexts binary, counts binary"

    def step(sums, turn):
        sent = None if sums is None else spark.sparkContext.broadcast(sums)

        def rows(stream):
            added = np.zeros((2 * SIDE, CLASSES), np.int64)
            for cls, words, context, n in stream:
                own, w = np.frombuffer(cls, np.uint8), _opened(words, np.int64)
                c, k = _opened(context, np.uint16).astype(np.int64), _counts(n, len(w))
                if sent is not None:
                    own = exchanged(own, w, c, k, sent.value, turn)
                np.add.at(added, (c, np.repeat(own, np.diff(np.append(_starts(w), len(w))))), k)
                yield own.tobytes(), words, context, n, None, None
            for slot in range(CLASSES):
                if added[:, slot].any():
                    yield None, None, None, None, slot, _squeezed(added[:, slot])

        return rows

    def add(stream):
        sums: dict[int, np.ndarray] = {}
        for slot, cell in stream:
            sums[slot] = sums.get(slot, 0) + _opened(cell, np.int64)
        for slot, total in sums.items():
            yield slot, total.tobytes()

    kind, sums = f"{cells}, slot int, sums binary", None
    held = packs
    for turn in range(rounds + 1):
        held, drop = written(map_rows(held.select("class", "words", "contexts", "counts"), step(sums, turn), kind, 16))
        if forget is not None:
            forget()  # its successor is written
        forget, sums = drop, np.zeros((2 * SIDE, CLASSES), np.float64)
        parts = held.filter("slot IS NOT NULL").select("slot", "sums").repartition(CLASSES, "slot")
        for slot, cell in map_rows(parts, add, "slot int, sums binary").collect():  # CLASSES rows of 8 KB
            sums[:, slot] = np.frombuffer(cell, np.int64)
        held = held.filter("slot IS NULL")

    def make(stream):
        for cls, words, context, n in stream:
            w = _opened(words, np.int64)
            start = _starts(w)
            if len(start):
                yield w[start], np.add.reduceat(_counts(n, len(w)), start) // 2, np.frombuffer(cls, np.uint8).astype(np.int32)

    return _arrays(held.select("class", "words", "contexts", "counts"), make, "word long, n long, cls int")


def transitions(counts: np.ndarray, once: int, twice: int) -> np.ndarray:
    """log10 P(class | class before) from counts[before, class], smoothed; each row of probabilities sums to 1."""
    counts = counts.astype(np.float64)
    counts[:, RARE] *= 1 + 2 * twice / max(once, 1)  # unseen words stand where those met once do, and these come again
    share = (counts.sum(axis=0) + 1) / (counts.sum() + KINDS)
    return np.log10((counts + PRIOR * share) / (counts.sum(axis=1, keepdims=True) + PRIOR))


def scores(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity), a row per row of ``docs``.

    Tokens are words between the six ASCII blanks, A-Z lowered, and one end.  Counts, classes and transitions come from
    the texts that are not held out.  ``score`` is the log10 probability of the text by the classes, ``base_score`` by
    single words.  ``docs`` has doc_id and text; other columns are ignored.  NULL and empty texts have the end alone; a
    NULL id is held out; repeated rows are learned and scored as often as they are there.  With nothing to learn from all
    words are unknown.  An empty table gives no rows.  Words are 64-bit hashes: two words of one hash would be one.
    """
    spark = docs.sparkSession
    read, drop_read = written(blocks(docs))
    words = staged(vocabulary(read))
    stats = words.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"), F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice")).first()

    def learned(stream):
        for (held,) in stream:
            yield (int((np.frombuffer(held, np.uint8) == 0).sum()),)

    ends = map_rows(read.select("held"), learned, "n long").agg(F.sum("n")).first()[0] or 0
    once, twice = stats["once"], stats["twice"]
    total, kinds = (stats["total"] or 0) + ends, stats["kinds"] + (ends > 0)
    frequent = [r["word"] for r in words.orderBy(F.col("n").desc(), "word").limit(FREQUENT).collect()]
    packs, drop_packs = written(contexts(read, frequent, total))
    classes = staged(clustered(packs, rounds, drop_packs))
    sizes = np.ones(KINDS)
    for r in classes.groupBy("cls").agg(F.sum("n").alias("n")).collect():
        sizes[r["cls"]] = r["n"]
    # Good and Turing: what unseen words and words met once share, in the class of rare words
    unseen = (once + 1) / (once + 2 * twice + 2) if once else 1.0
    known = classes.unionByName(words.filter("n = 1").select("word", "n", F.lit(RARE).alias("cls")))

    def places(stream):
        for block, names in stream:
            names = np.frombuffer(names, np.int64)
            yield np.full(len(names), block), np.arange(len(names), dtype=np.int32), names

    asked = _arrays(read.select("block", "words"), places, "block long, place int, word long")
    # one number per word: its count, and its class in the low bits
    fact = (F.coalesce("n", F.lit(0)) * 256 + F.coalesce("cls", F.lit(RARE))).alias("fact")
    told = asked.join(known, "word", "left").select("block", "place", fact)
    texts = F.struct("ids", "absent", "held", "lengths", "tokens").alias("texts")
    whole = read.select("block", texts)
    # the words of a block come first, its texts behind them
    meet = told.unionByName(whole, allowMissingColumns=True).repartition(width(spark), "block")
    meet = meet.sortWithinPartitions("block", F.col("place").asc_nulls_last())
    base_of = lambda n: np.log10((n + ADDED) / (total + ADDED * (kinds + 1)))
    end_base = float(base_of(np.float64(ends)))
    kind = T.StructType.fromDDL("doc_id long, held_out boolean, n_tokens long, n_known long, base double, emitted double, line binary, pairs binary")
    schema = to_arrow_schema(kind)

    def read_blocks(batches):
        pairs, facts = np.zeros(KINDS * KINDS, np.int64), []
        for batch in batches:
            names, last = batch.schema.names, 0
            fact, whole = batch.column(names.index("fact")), batch.column(names.index("texts"))
            for at in np.flatnonzero(whole.is_valid().to_numpy(zero_copy_only=False)).tolist():
                facts.append(fact.slice(last, at - last).to_numpy())
                yield scored(whole[at].as_py(), np.concatenate(facts), pairs)
                facts, last = [], at + 1
            facts.append(fact.slice(last).to_numpy())
        if pairs.any():
            yield pa.RecordBatch.from_pylist([{"pairs": _squeezed(pairs)}], schema=schema)

    def scored(cells, facts, pairs):
        """Rows of a block's texts with all but the transitions, whose counts are added to ``pairs``."""
        ids, absent, held, lengths = (np.frombuffer(cells[c], k) for c, k in (("ids", np.int64), ("absent", np.uint8), ("held", np.uint8), ("lengths", np.int64)))
        numbers, n, cls = _opened(cells["tokens"], np.uint32), facts >> 8, facts & 255
        emitted = np.log10(np.where(cls != RARE, n / sizes[cls], np.where(n > 0, (1 - unseen) / max(once, 1), unseen)))
        start, sums = np.cumsum(lengths) - lengths, []
        for value in (base_of(n), emitted, (n > 0).astype(np.int64)):
            run = value[numbers]
            per = np.zeros(len(lengths), run.dtype)
            if len(run):
                per[lengths > 0] = np.add.reduceat(run, start[lengths > 0])
            sums.append(per)
        line = cls[numbers].astype(np.uint8)
        train = with_borders(line, lengths, held == 0, BORDER)
        pairs += np.bincount(train[:-1] * KINDS + train[1:], minlength=KINDS * KINDS)
        lines = [zlib.compress(line[a : a + k].tobytes(), 1) for a, k in zip(start.tolist(), lengths.tolist())]
        columns = [
            pa.array(ids, mask=absent.astype(bool)), pa.array(held.astype(bool)), pa.array(lengths + 1), pa.array(sums[2] + (ends > 0)), pa.array(sums[0] + end_base),
            pa.array(sums[1]), pa.array(lines, pa.binary()), pa.nulls(len(ids), pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    lines = staged(meet.mapInArrow(read_blocks, kind))
    drop_read()

    def add(stream):
        sums = np.zeros(KINDS * KINDS, np.int64)
        for (cell,) in stream:
            sums += _opened(cell, np.int64)
        yield (sums.tobytes(),)

    counts = np.zeros(KINDS * KINDS, np.int64)
    for (cell,) in map_rows(lines.filter("pairs IS NOT NULL").select("pairs").coalesce(64), add, "sums binary").collect():  # 64 rows of 35 KB at most
        counts += np.frombuffer(cell, np.int64)
    moves = transitions(counts.reshape(KINDS, KINDS), once, twice).ravel()

    def finish(stream):
        for doc_id, held, tokens, met, base, emitted, line in stream:
            path = np.full(tokens + 1, BORDER, np.int64)
            path[1:-1] = np.frombuffer(zlib.decompress(line), np.uint8)
            score = emitted + float(moves[path[:-1] * KINDS + path[1:]].sum())
            yield doc_id, held, tokens, met, total, base, score, 10 ** (-score / tokens)

    rest = lines.filter("pairs IS NULL").drop("pairs")
    return map_rows(rest, finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def op11_class_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"))
