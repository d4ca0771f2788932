"""Exact Jaccard join of word-shingle sets by PartEnum signatures, and its components.

A document is the set of its hashed shingles.  Sizes are cut into bands of ratio
1/J; sets of similarity J or more lie in the same or adjacent bands, and every
band (with the one below) has one level: a partition of the hash domain into n
parts.  A set emits signatures at its own level and at the next one.

Let k bound the symmetric difference of a set with any partner at the level.  At
most k parts differ, so a set with more than k non-empty parts shares at least
(number of non-empty parts - k) equal non-empty parts with each partner.  Under any
common order of part contents, the first k + 1 of either side then have one in
common: these are the enumerated signatures.  Parts that consist of passages of a
large share of the corpus come last, and before that parts of more shingles come first.
Sets with k non-empty parts or fewer emit all of them, and besides the first
|s| - ceil(J |s|) + 1 shingles by hash: if two partners share no equal non-empty
part, both are such sets, and these prefixes meet.

Equal signatures make candidate pairs along stars, never all pairs of a group;
pairs are verified on the whole sets.  A second round tests what the stars left
open: members of a group that are still in different components.  Groups of one
leader form a cell, whose members are compared as bits inside tasks; those with a partner that
bits cannot rule out bring their whole sets, and a task emits the links of a
spanning forest of what it has verified, fewer than there are members.
"""

from __future__ import annotations

import hashlib
import zlib
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlewick.llm.common import ROWS_OUT, map_rows, rows_in, staged, table, width

WORDS = 5
NUM, DEN = 75, 100  # similarity as a fraction
SPREAD = 1.5  # parts per difference to be tolerated
SKETCH_BITS = 17
SLICES = 16
RECORDS = 1 << 18  # signatures held by a task at once
BUCKET_RECORDS = 1 << 19  # aimed at per bucket
FILTER_BITS = 24
BLOCK = 8192  # members of a cell compared in one task
BLOCK_SHINGLES = 1 << 22  # of all members, where whole sets are compared
SETS_OUT = 64  # sets sent at once
FINER = 3  # bits of a parity, as a power of two more, where sets are at hand
_U = np.uint64


def _mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    x = x + _U((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BASE = 0x9E3779B97F4A7C15  # odd, hence invertible modulo 2**64
_BLANK = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_POWERS: dict[int, np.ndarray] = {}
CHUNK = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    """At least n powers of ``base``; kept up to the longest text piece met."""
    kept = _POWERS.get(base)
    if kept is None or len(kept) < n:
        factors = np.full(max(n, 1 << 14), base, _U)
        factors[0] = 1
        kept = _POWERS[base] = np.cumprod(factors, dtype=_U)
    return kept[:n]


def word_hashes(raw: bytes) -> np.ndarray:
    """64-bit hash per word between blanks, from running sums of byte * base**position."""
    data = np.frombuffer(raw, np.uint8)
    blank = np.ones(len(data) + 2, bool)
    blank[1:-1] = _BLANK[data]
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    start, end = edge[::2], edge[1::2]
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * _powers(_BASE, len(data)), out=sums[1:])
    inverse = _powers(pow(_BASE, -1, 1 << 64), len(data) + 1)
    return _mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(_U))


class Shingler:
    """text -> sorted distinct 64-bit shingle hashes; A-Z lowered, words between the six ASCII blanks."""

    def __init__(self, words: int = WORDS):
        self.words = words

    def _codes(self, text: str) -> np.ndarray:
        raw = text.encode("utf-8", "surrogatepass").lower()  # of bytes: A-Z only
        if len(raw) <= CHUNK:
            return word_hashes(raw)
        # long texts piece by piece, cut behind a blank
        parts, at = [], 0
        while at < len(raw):
            stop = at + CHUNK
            while stop < len(raw) and not _BLANK[raw[stop - 1]]:
                stop += 1
            parts.append(word_hashes(raw[at:stop]))
            at = stop
        return np.concatenate(parts)

    def __call__(self, text: str | None) -> np.ndarray:
        codes = self._codes(text) if text else np.zeros(0, _U)
        if not len(codes):
            return codes
        n = max(len(codes) - self.words + 1, 1)
        used = min(self.words, len(codes))
        total = np.full(n, used, _U)
        for i in range(used):
            total = total * _U(0xD6E8FEB86659FD93) + codes[i : i + n]
        return np.unique(_mix(total, 1))


def digest(shingles: np.ndarray) -> int:
    """Class of equal sets: a signed 64-bit hash of the sorted shingles."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


class Bands:
    """Bands of set sizes and the level of each: its largest size, tolerated difference, number of parts."""

    def __init__(self, num: int = NUM, den: int = DEN):
        self.num, self.den = num, den
        self.high: list[int] = []

    def level(self, band: int) -> tuple[int, int]:
        while len(self.high) <= band:
            low = self.high[-1] + 1 if self.high else 1
            self.high.append(max(low, low * self.den // self.num))
        high = self.high[band]
        return high, int(SPREAD * (2 * high * (self.den - self.num) // (self.den + self.num) + 1)) + 1

    def band(self, size: int) -> int:
        b = 0
        while self.level(b)[0] < size:
            b += 1
        return b

    def tolerated(self, size: int, band: int) -> int:
        """Largest symmetric difference with a partner at the level of ``band``."""
        gap = self.den - self.num
        return min(size * gap // self.num, (size + self.level(band)[0]) * gap // (self.den + self.num))


def signatures(shingles: np.ndarray, weight: np.ndarray, bands: Bands) -> np.ndarray:
    """64-bit signatures of a non-empty set.  ``weight``: how frequent each shingle is, coarsely."""
    size, out = len(shingles), []
    own = bands.band(size)
    for band in (own, own + 1):
        k, parts = bands.tolerated(size, band), bands.level(band)[1]
        mixed = _mix(shingles, 101 + band)
        order = np.argsort(mixed)
        mixed = mixed[order]
        part = ((mixed >> _U(32)) * _U(parts)) >> _U(32)  # in order, as the hashes are
        start = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1])
        sig = _mix(np.add.reduceat(_mix(mixed, 11), start) + part[start], 1001 + band)
        if len(sig) > k:
            # contents of a frequent shingle last, then larger contents first: they are the more selective ones
            frequent = np.minimum.reduceat(weight[order], start).astype(_U)
            larger = np.minimum(np.diff(np.append(start, size)), 63).astype(_U)
            rank = (frequent << _U(58)) | ((_U(63) - larger) << _U(52)) | (sig >> _U(12))
            sig = sig[rank <= np.partition(rank, k)[k]]
        else:
            prefix = size - -(-size * bands.num // bands.den) + 1
            sig = np.concatenate([sig, _mix(shingles[:prefix], 5001 + band)])
        out.append(sig)
    return np.concatenate(out)


def parity(shingles: np.ndarray, finer: int = 0) -> np.ndarray:
    """Bits that are 1 where an odd number of shingles falls; about one to two bits a shingle, 2**finer times as many if wished."""
    bits = 1 << min(24, max(6, int(len(shingles)).bit_length()) + finer)
    odd = np.bincount((shingles >> _U(40)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def may_be_similar(a: np.ndarray, size_a: int, b: np.ndarray, size_b: int, num: int, den: int) -> bool:
    """False only if parities prove too large a difference: every differing shingle flips at most one bit."""
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum()) * (den + num) <= (den - num) * (size_a + size_b)


def similar(a: np.ndarray, b: np.ndarray, num: int = NUM, den: int = DEN) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return den * both >= num * (len(a) + len(b) - both)


def _weight(sketch: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    return sketch[(shingles >> _U(64 - SKETCH_BITS)).astype(np.int64)]


def scan(docs: DataFrame, words: int) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, text_key, n, cls) per document, and by how many powers of two each of 2**17 hash buckets of shingles exceeds the median one.

    The sketch has a fixed size; tasks add up their own and the sums are merged by slices.
    """
    size, cut = 1 << SKETCH_BITS, (1 << SKETCH_BITS) // SLICES

    def rows(stream):
        shingler, sums, held, n = Shingler(words), np.zeros(size, np.int64), [], 0
        for doc_id, text, text_key in stream:
            shingles = shingler(text)
            yield doc_id, text_key, len(shingles), digest(shingles) if len(shingles) else None, None, None
            held.append((shingles >> _U(64 - SKETCH_BITS)).astype(np.int64))
            n += len(shingles)
            if n > RECORDS:
                sums += np.bincount(np.concatenate(held), minlength=size)
                held, n = [], 0
        if held:
            sums += np.bincount(np.concatenate(held), minlength=size)
        for i in range(SLICES):
            yield None, None, None, None, i, zlib.compress(sums[i * cut : (i + 1) * cut].tobytes(), 1)

    both = staged(map_rows(docs.select("doc_id", "text", F.xxhash64("text")), rows, "doc_id long, text_key long, n long, cls long, slice int, counts binary"))

    def add(stream):
        sums: dict[int, np.ndarray] = {}
        for i, counts in stream:
            sums[i] = sums.get(i, 0) + np.frombuffer(zlib.decompress(counts), np.int64)
        for i, total in sums.items():
            yield i, np.log2(total + 1).astype(np.uint8).tobytes()

    merged = map_rows(both.filter("slice IS NOT NULL").select("slice", "counts").repartition(SLICES, "slice"), add, "slice int, counts binary")
    sketch = np.zeros(size, np.uint8)
    for i, counts in merged.collect():  # 128 KB in all
        sketch[i * cut : (i + 1) * cut] = np.frombuffer(counts, np.uint8)
    # what stands out of the bucket's usual fill
    sketch = np.maximum(sketch.astype(np.int16) - int(np.median(sketch)) - 1, 0).astype(np.uint8)
    return both.filter("slice IS NULL").select("doc_id", "text_key", "n", "cls"), sketch


_PAIR = np.dtype([("sig", "<u4"), ("cls", "<i8")])


def groups(docs: DataFrame, sketch: np.ndarray, shingle_total: int, words: int, num: int, den: int) -> DataFrame:
    """(gid, cls, leader): the classes that share a signature, with a leader each.

    A task first settles its own groups: one class stands for them in the exchange, so a signature
    of very many documents is a record per task there.
    """
    spark = docs.sparkSession
    buckets = max(width(spark), -(-int(0.7 * shingle_total) // BUCKET_RECORDS))
    sent = spark.sparkContext.broadcast(sketch)

    def leaders(sig: np.ndarray, cls: np.ndarray):
        """Distinct (sig, cls) by sig, where each sig begins, its least class and its number of classes."""
        order = np.argsort(sig)
        sig, cls = sig[order], cls[order]
        again = np.zeros(len(sig), bool)
        again[1:] = sig[1:] == sig[:-1]
        again[:-1] |= again[1:]
        if again.any():  # only signatures met several times need their classes in order
            rows = np.flatnonzero(again)
            cls[rows] = cls[rows][np.lexsort((cls[rows], sig[rows]))]
            new = np.ones(len(sig), bool)
            new[1:] = (sig[1:] != sig[:-1]) | (cls[1:] != cls[:-1])
            sig, cls = sig[new], cls[new]
        start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.zeros(0, np.int64)
        return sig, cls, start, np.diff(np.append(start, len(sig)))

    def emit(stream):
        shingler, bands, freq = Shingler(words), Bands(num, den), sent.value
        sigs, classes, n, seen = [], [], 0, set()

        def flush():
            sig = np.concatenate(sigs)
            cls = np.repeat(np.array(classes, np.int64), [len(s) for s in sigs])
            sig, cls, start, sizes = leaders(sig, cls)
            lead = cls[start]
            many = sizes > 1
            if many.any():
                rows = np.repeat(many, sizes)
                yield from _blocks(sig[rows], cls[rows], np.repeat(lead, sizes)[rows])
            sig, bucket = sig[start], (sig[start] >> _U(32)) * _U(buckets) >> _U(32)
            cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))  # sig is sorted, so bucket is
            for a, b in zip(cut, np.append(cut[1:], len(sig))):
                block = np.empty(b - a, _PAIR)
                # within a bucket the low 32 bits tell signatures apart well enough: pairs are verified anyway
                block["sig"], block["cls"] = (sig[a:b] & _U(0xFFFFFFFF)).astype(np.uint32), lead[a:b]
                yield int(bucket[a]), block.tobytes(), None, None, None

        for (text,) in stream:
            shingles = shingler(text)
            if not len(shingles):
                continue
            cls = digest(shingles)
            if cls in seen:  # an equal set of this task has spoken for it
                continue
            seen.add(cls)
            if len(seen) > RECORDS:
                seen.clear()
            sigs.append(signatures(shingles, _weight(freq, shingles), bands))
            classes.append(cls)
            n += len(sigs[-1])
            if n > RECORDS:
                yield from flush()
                sigs, classes, n = [], [], 0
        if sigs:
            yield from flush()

    def _blocks(sig, cls, lead, step=1 << 15):
        # groups settled in the task; any bucket will do, their own keeps the spread even
        for a in range(0, len(sig), step):
            b = a + step
            yield int(int(sig[a] >> _U(32)) * buckets >> 32), None, sig[a:b].tobytes(), cls[a:b].tobytes(), lead[a:b].tobytes()

    emitted = map_rows(docs.select("text"), emit, "bucket int, block binary, sig binary, cls binary, lead binary")
    dealt = emitted.repartition(width(spark), "bucket").sortWithinPartitions("bucket")
    out = pa.schema([("gid", pa.int64()), ("cls", pa.int64()), ("leader", pa.int64())])

    def batch(gid, cls, lead):
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64) if x.dtype == _U else x) for x in (gid, cls, lead)], schema=out)

    def meet(batches):
        at, held = None, []

        def close():
            records = np.concatenate(held)
            gid = records["sig"].astype(_U) | (_U(at) << _U(32))
            gid, cls, start, sizes = leaders(gid, records["cls"])
            rows = np.repeat(sizes > 1, sizes)
            if rows.any():
                yield batch(_mix(gid[rows], 3), cls[rows], np.repeat(cls[start], sizes)[rows])

        for bucket, block, sig, cls, lead in rows_in(batches):
            if bucket != at and held:
                yield from close()
                held = []
            at = bucket
            if block is not None:
                held.append(np.frombuffer(block, _PAIR))
            else:
                # a task's own group: the same group id as in the exchange, so that the second round sees it whole
                full = np.frombuffer(sig, _U)
                own = (full & _U(0xFFFFFFFF)) | ((((full >> _U(32)) * _U(buckets)) >> _U(32)) << _U(32))
                yield batch(_mix(own, 3), np.frombuffer(cls, np.int64), np.frombuffer(lead, np.int64))
        if held:
            yield from close()

    return dealt.mapInArrow(meet, T.StructType.fromDDL("gid long, cls long, leader long"))


def _position(doc_id, bits: int = FILTER_BITS):
    return F.pmod(F.xxhash64(doc_id), F.lit(1 << bits)).cast("int")


def _picked(docs: DataFrame, keepers: DataFrame, classes: DataFrame, words: int, what, kind: str, size: int = ROWS_OUT) -> DataFrame:
    """(cls, *kind) from ``what(shingles)`` for the classes named.  ``keepers``: (cls, doc_id), a document per class.

    A bitmap of fixed size tells which documents may be needed, so that texts are never shuffled; what is
    built for others in vain (few, if any) meets nothing.
    """
    word = F.shiftright(_position(F.col("doc_id")), 6)
    bit = F.expr(f"shiftleft(1L, CAST(pmod(xxhash64(doc_id), {1 << FILTER_BITS}) AS INT) & 63)")
    needed = classes.distinct().join(keepers, "cls")
    held = needed.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # 4 MB at most
    bitmap = np.zeros((1 << FILTER_BITS) // 64, np.int64)
    bitmap[held.column("word").to_numpy()] = held.column("bits").to_numpy()
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)

    def build(stream):
        shingler, bits, done = Shingler(words), sent.value.view(np.uint64), set()
        for text, at in stream:
            if int(bits[at >> 6]) >> (at & 63) & 1:
                shingles = shingler(text)
                if len(shingles) and (cls := digest(shingles)) not in done:
                    done.add(cls)
                    yield cls, *what(shingles)

    return staged(map_rows(docs.select("text", _position(F.col("doc_id")).alias("at")), build, f"cls long, {kind}", size))


def _meet(pairs: DataFrame, found: DataFrame, names: list[str], test) -> DataFrame:
    """The pairs that pass ``test(*names of a, *names of b)``."""
    side = lambda key: found.select(F.col("cls").alias(key), *[F.col(n).alias(f"{n}_{key}") for n in names])
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", *[f"{n}_a" for n in names], *[f"{n}_b" for n in names])

    def keep(stream):
        for a, b, *rest in stream:
            if test(*rest):
                yield a, b

    return map_rows(both, keep, "a long, b long").distinct()


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls")))


def _parities(docs: DataFrame, keepers: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    return _picked(docs, keepers, classes, words, lambda s: (len(s), parity(s).tobytes()), "n long, odd binary")


def _close(pairs: DataFrame, odd: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs that parities of a bit or two a shingle cannot rule out."""

    def close(n_a, odd_a, n_b, odd_b):
        return may_be_similar(np.frombuffer(odd_a, np.uint8), n_a, np.frombuffer(odd_b, np.uint8), n_b, num, den)

    return staged(_meet(pairs, odd, ["n", "odd"], close))


def _similar(docs: DataFrame, keepers: DataFrame, pairs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Pairs whose whole sets are similar."""

    def alike(set_a, set_b):
        return similar(np.frombuffer(set_a, _U), np.frombuffer(set_b, _U), num, den)

    sets = _picked(docs, keepers, _ends(pairs), words, lambda s: (s.tobytes(),), "shingles binary", SETS_OUT)
    return _meet(pairs, sets, ["shingles"], alike)


def verified(docs: DataFrame, keepers: DataFrame, pairs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets are similar."""
    odd = _parities(docs, keepers, _ends(pairs), words)
    return _similar(docs, keepers, _close(pairs, odd, num, den), words, num, den)


def close_in_block(comp, n, odd, left, num: int, den: int):
    """Pairs of places in a block, of different components, that sizes and parities leave; ``left`` marks
    those of the first of two blocks (all, if it meets itself).  Compared as bit matrices, a strip at a time."""
    widths = np.array([len(x) for x in odd])
    itself = left.all()
    for width_a in np.unique(widths[left]):
        a = np.flatnonzero((widths == width_a) & left)
        for width_b in np.unique(widths if itself else widths[~left]):
            b = np.flatnonzero(widths == width_b) if itself else np.flatnonzero((widths == width_b) & ~left)
            # within one block either side is the first of a pair once, between two blocks only the low one is
            small, large = (a, b) if width_a < width_b else (b, a)
            if itself and width_b < width_a or n[small].max() * den < n[large].min() * num and width_a != width_b:
                continue
            # a row per set, folded to the narrower of the two
            words = min(width_a, width_b) // 8
            rows_a, rows_b = (
                np.bitwise_xor.reduce(np.frombuffer(b"".join(odd[i] for i in side), _U).reshape(len(side), -1, words), axis=1) for side in (a, b)
            )
            strip = max(1, (1 << 20) // max(1, rows_b.size))
            for at in range(0, len(a), strip):
                i = a[at : at + strip]
                flips = np.bitwise_count(rows_a[at : at + strip, None, :] ^ rows_b[None, :, :]).sum(axis=2, dtype=np.int64)
                ok = flips * (den + num) <= (den - num) * (n[i][:, None] + n[b][None, :])
                ok &= np.minimum(n[i][:, None], n[b][None, :]) * den >= np.maximum(n[i][:, None], n[b][None, :]) * num
                ok &= comp[i][:, None] != comp[b][None, :]
                if itself and width_a == width_b:
                    ok &= i[:, None] < b[None, :]
                x, y = np.nonzero(ok)
                if len(x):
                    yield i[x], b[y]


def _cells(shared: DataFrame, comps: DataFrame) -> DataFrame:
    """(lead, cls, comp): the members of groups that hold several components, once for all groups of one least class."""
    placed = shared.select("gid", "cls").distinct().join(comps, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    split = placed.groupBy("gid").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("cls").alias("lead")).filter("low <> high")
    return staged(placed.join(split.select("gid", "lead"), "gid").select("lead", "cls", "comp").distinct())


def _in_blocks(members: DataFrame, payload: str, look, schema: str) -> DataFrame:
    """Rows of ``look(cls, comp, n, payload, left)`` for each block of a cell with itself, and for each two blocks.

    Cells are dealt into blocks of bounded numbers of members and of shingles by a hash.
    """
    spark = members.sparkSession
    blocks = members.groupBy("lead").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    placed = members.join(blocks, "lead").withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("lead", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "cls", "comp", "n", payload)
    dealt = placed.repartition(width(spark), "lead", "low", "high").sortWithinPartitions("lead", "low", "high", "cls")

    def rows(stream):
        for (lead, low, _), block in groupby(stream, key=lambda r: r[:3]):
            held = list(block)
            if len(held) > 1:
                own, cls, comp, n = (np.array([r[i] for r in held], np.int64) for i in (3, 4, 5, 6))
                yield from look(lead, cls, comp, n, [r[7] for r in held], own == low)

    return map_rows(dealt, rows, schema)


def _flagged(members: DataFrame, num: int, den: int) -> DataFrame:
    """(lead, cls): members (lead, cls, comp, n, odd) with a partner in another component that parities leave."""

    def look(lead, cls, comp, n, odd, left):
        close = np.zeros(len(cls), bool)
        for i, j in close_in_block(comp, n, odd, left, num, den):
            close[i] = close[j] = True
        for c in cls[close].tolist():
            yield lead, c

    return _in_blocks(members, "odd", look, "lead long, cls long").distinct()


def _forest(members: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) between members (lead, cls, comp, n, shingles) of different components whose sets are similar: of each
    block so many as join its components as all similar pairs would."""

    def look(lead, cls, comp, n, sets, left):
        sets = [np.frombuffer(x, _U) for x in sets]
        parent: dict[int, int] = {}

        def root(c: int) -> int:
            while c in parent:
                parent[c] = parent.get(parent[c], parent[c])
                c = parent[c]
            return c

        for i, j in close_in_block(comp, n, [parity(x, FINER).tobytes() for x in sets], left, num, den):
            for x, y in zip(i.tolist(), j.tolist()):
                one, two = root(int(comp[x])), root(int(comp[y]))
                if one != two and similar(sets[x], sets[y], num, den):
                    parent[one] = two
                    yield int(min(cls[x], cls[y])), int(max(cls[x], cls[y]))

    return _in_blocks(members, "shingles", look, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(cls, comp) with comp the least class reachable, for every class on an edge (a, b).

    Each step takes the least label among the neighbours and then the label of that label; the
    number of steps grows with the logarithm of the longest path.
    """
    both = staged(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = staged(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("comp")).withColumnRenamed("a", "cls"))
    while True:
        least = both.join(labels, both["b"] == labels["cls"]).groupBy("a").agg(F.min("comp").alias("near"))
        nearer = labels.join(least, labels["cls"] == least["a"]).select("cls", "comp", F.least("comp", "near").alias("next"))
        jump = labels.select(F.col("cls").alias("to"), F.col("comp").alias("far"))
        moved = staged(nearer.join(jump, nearer["next"] == jump["to"], "left").select("cls", F.col("comp").alias("before"), F.least("next", F.coalesce("far", "next")).alias("comp")))
        changed = moved.filter("comp <> before").limit(1).count()
        labels = moved.select("cls", "comp")
        if not changed:
            return labels


def near_components(docs: DataFrame, words: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """(doc_id, text_key, n_shingles, cls, comp, component_id), a row per row of ``docs`` (needs doc_id and text).

    Documents link when den * |intersection| >= num * |union| of their sets of distinct word shingles;
    with fewer words than a shingle the whole sequence is one.  Component ids are the least doc_id
    reachable.  NULL, empty or blank texts have no shingles and stand alone (NULL class).  Equal texts
    share a class, similar ones the component's least class, comp.  text_key is a hash of the text.  A NULL id counts as larger than all others.  An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found, sketch = scan(docs, words)
    keepers = staged(found.filter("cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n")))
    total = keepers.agg(F.sum("n")).first()[0] or 0
    shared = staged(groups(docs, sketch, total, words, num, den))
    size = keepers.select("cls", "n")

    def candidates(raw: DataFrame) -> DataFrame:
        """Distinct pairs whose sizes allow the similarity."""
        slim = raw.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
        sized = slim.join(size.select(F.col("cls").alias("a"), F.col("n").alias("n_a")), "a").join(size.select(F.col("cls").alias("b"), F.col("n").alias("n_b")), "b")
        return staged(sized.filter(F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num).select("a", "b"))

    first = candidates(shared.select(F.col("leader").alias("a"), F.col("cls").alias("b")))
    edges = staged(verified(docs, keepers, first, words, num, den))
    comps = components(edges)
    # second round: groups with members in several components
    cells = _cells(shared, comps)
    odd = _parities(docs, keepers, cells.select("cls"), words)
    close = staged(cells.join(_flagged(cells.join(odd, "cls"), num, den), ["lead", "cls"]))
    sets = _picked(docs, keepers, close.select("cls"), words, lambda s: (len(s), s.tobytes()), "n long, shingles binary", SETS_OUT)
    found_later = staged(_forest(close.join(sets, "cls"), num, den))
    if found_later.limit(1).count():
        comps = components(edges.union(found_later))
    smallest = comps.join(keepers, "cls").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    by_class = keepers.select("cls", F.col("doc_id").alias("own")).join(comps, "cls", "left").join(smallest, "comp", "left")
    by_class = by_class.select("cls", F.coalesce("comp", "cls").alias("comp"), F.coalesce("component_id", "own").alias("component_id"))
    full = found.join(by_class, "cls", "left")
    return full.select("doc_id", "text_key", F.col("n").alias("n_shingles"), "cls", "comp", F.coalesce("component_id", "doc_id").alias("component_id"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
