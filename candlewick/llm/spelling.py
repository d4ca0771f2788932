"""Spelling variants through k-d trees over letter counts.

One inserted, deleted or replaced code point changes the counts of a word's letters by
one or two in all, so near words lie within L1 distance one (lengths that differ
by one) or two (equal lengths).  Words are kept by length.  The planes of each
length's tree, fitted on a bounded sample, cut its words into cells, each word
goes to the cells that its ball may touch, and inside a cell a k-d tree with tight
boxes answers the range search.  Of what it finds the order of letters decides.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import groupby, islice

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.llm.common import map_rows, staged, table, width

MIN_LETTERS, MIN_COUNT, TIMES = 6, 5, 5
DAMAGE = 199
SAMPLE = 1 << 15  # words that the planes are fitted on, of all lengths together
CELL_WORDS = 1 << 14
LEAF = 24
HELD = 1 << 18  # distinct words that a task counts at once
ASKED = 1 << 12  # words searched at once
PAIRS = 1 << 18  # pairs verified at once
DIMS = 32
_LOWER = {c: c + 32 for c in range(65, 91)}


def damaged(word: str, crc: int) -> str:
    """The run without one code point, where DAMAGE divides its hash."""
    if crc % DAMAGE:
        return word
    at = crc % len(word)
    return word[:at] + word[at + 1 :]


def word_counts(docs: DataFrame, least: int = MIN_LETTERS) -> DataFrame:
    """(word, n) over all documents, of words of ``least`` code points or more; tasks send sums."""
    run = re.compile(f"[A-Za-zÀ-ÿ]{{{least},}}")  # a maximal run, or one too short to count

    def rows(stream):
        held: dict[str, int] = defaultdict(int)
        for doc_id, text in stream:
            prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
            for word, n in Counter(run.findall(text.translate(_LOWER))).items():
                word = damaged(word, zlib.crc32(word.encode(), prefix))
                if len(word) >= least:
                    held[word] += n
            if len(held) >= HELD:
                yield from held.items()
                held.clear()
        yield from held.items()

    texts = docs.filter("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_rows(texts, rows, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def codes_of(words: list[str]) -> np.ndarray:
    """Code points, a row per word; the words are of one length."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)


def letter_counts(codes: np.ndarray) -> np.ndarray:
    """Counts of a to z, and of the other letters in six classes: merging letters never makes a distance larger."""
    plain = (codes >= 97) & (codes < 123)
    place = np.where(plain, codes - np.uint32(97), 26 + codes % np.uint32(6)).astype(np.intp)
    counts, row = np.zeros((len(codes), DIMS), np.int32), np.arange(len(codes))
    for column in place.T:
        counts[row, column] += 1
    return counts


def plane(points: np.ndarray) -> tuple[int, int] | None:
    """(letter, t): the most even split into counts up to t and above; None if all points are equal."""
    best = None
    for letter in np.flatnonzero(points.max(axis=0) > points.min(axis=0)):
        below = np.cumsum(np.bincount(points[:, letter]))[:-1]
        below = np.where(below == 0, len(points) * 2, below)
        uneven = np.abs(2 * below - len(points))
        t = int(uneven.argmin())
        if best is None or uneven[t] < best[0]:
            best = (int(uneven[t]), int(letter), t)
    return best and best[1:]


Node = tuple[int, int, int, int]  # letter, t, below, above; below -1: a cell, whose number is in t


def planes(points: np.ndarray, words: int, cell_words: int = CELL_WORDS) -> list[Node]:
    """The upper part of the tree of one length: planes over a sample of its ``words``; the leaves are the cells."""
    nodes: list[Node] = []
    scale, cells = words / max(1, len(points)), 0

    def grow(part: np.ndarray) -> int:
        nonlocal cells
        number = len(nodes)
        split = plane(part) if len(part) > 1 and len(part) * scale > cell_words else None
        nodes.append((0, cells, -1, -1))
        if split is None:
            cells += 1
        else:
            below = part[:, split[0]] <= split[1]
            nodes[number] = (*split, grow(part[below]), grow(part[~below]))
        return number

    grow(points)
    return nodes


def cells_near(nodes: list[Node], points: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) for every cell whose box a point's ball of L1 radius ``reach`` touches."""
    rows, cells = [], []
    # distance spent per letter so far, for the letters that planes of the path have used
    todo = [(0, np.arange(len(points)), np.zeros(points.shape, np.int32))]
    while todo:
        number, row, spent = todo.pop()
        letter, t, below, above = nodes[number]
        if below < 0:
            rows.append(row)
            cells.append(np.full(len(row), t))
            continue
        value = points[row, letter]
        for child, away in ((below, np.maximum(value - t, 0)), (above, np.maximum(t + 1 - value, 0))):
            gone = spent.copy()
            gone[:, letter] = np.maximum(gone[:, letter], away)
            near = gone.sum(axis=1) <= reach
            if near.any():
                todo.append((child, row[near], gone[near]))
    return np.concatenate(rows), np.concatenate(cells)


class Tree:
    """k-d tree over letter counts with tight boxes."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.order = points, np.arange(len(points))
        self.nodes: list[tuple[int, int, int, np.ndarray, np.ndarray]] = []  # start, stop, second child, least, largest
        self._grow(0, len(points), leaf)

    def _grow(self, start: int, stop: int, leaf: int) -> int:
        number, own = len(self.nodes), self.points[self.order[start:stop]]
        self.nodes.append((start, stop, -1, own.min(axis=0), own.max(axis=0)))
        split = plane(own) if stop - start > leaf else None
        if split is not None:
            below = own[:, split[0]] <= split[1]
            rows = self.order[start:stop]
            self.order[start:stop] = np.concatenate([rows[below], rows[~below]])
            middle = start + int(below.sum())
            self._grow(start, middle, leaf)
            second = self._grow(middle, stop, leaf)
            self.nodes[number] = (*self.nodes[number][:2], second, *self.nodes[number][3:])
        return number

    def within(self, asked: np.ndarray, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows of ``asked``, rows of the tree) at L1 distance up to ``reach``, in portions."""
        todo = [(0, np.arange(len(asked)))]
        while todo:
            number, row = todo.pop()
            start, stop, second, least, largest = self.nodes[number]
            value = asked[row]
            row = row[(np.maximum(least - value, 0) + np.maximum(value - largest, 0)).sum(axis=1) <= reach]
            if not len(row):
                continue
            if second >= 0:
                todo += [(number + 1, row), (second, row)]
                continue
            own = self.order[start:stop]
            for at in range(0, len(own), LEAF):  # a leaf of equal points may be a long one
                part = own[at : at + LEAF]
                near = np.abs(asked[row][:, None, :] - self.points[part][None, :, :]).sum(axis=2) <= reach
                i, j = np.nonzero(near)
                if len(i):
                    yield row[i], part[j]


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows differ by exactly one code point; rows of ``b`` are as long as those of ``a``, or one longer."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    rows = np.arange(len(a))
    # the first place where they part; behind it the longer one goes on as the shorter does
    same = np.concatenate([a == b[:, :-1], np.zeros((len(a), 1), bool)], axis=1)
    place = same.argmin(axis=1)
    later = np.arange(a.shape[1])[None, :] >= place[:, None]
    return ((a == b[:, 1:]) | ~later).all(axis=1) & (place[rows] <= a.shape[1])


class Tally:
    """Number of near words and the most frequent one (ties: least) per row of a list of words."""

    def __init__(self, words: list[str]):
        self.words, self.near = words, np.zeros(len(words), np.int64)
        self.best: dict[int, tuple[int, str]] = {}

    def add(self, rows: np.ndarray, others: np.ndarray, names: list[str], counts: np.ndarray) -> None:
        np.add.at(self.near, rows, 1)
        for i, j in zip(rows.tolist(), others.tolist()):
            found = (-int(counts[j]), names[j])
            if i not in self.best or found < self.best[i]:
                self.best[i] = found

    def rows(self) -> Iterator[tuple]:
        for i in np.flatnonzero(self.near):
            negative, form = self.best[int(i)]
            yield self.words[i], int(self.near[i]), -negative, form


def fitted(words: DataFrame, cell_words: int) -> dict[int, list[Node]]:
    """Planes for each length that has more words than a cell; the sample is of SAMPLE words at most."""
    sizes = {r["length"]: r["words"] for r in words.groupBy(F.length("word").alias("length")).agg(F.count(F.lit(1)).alias("words")).collect()}
    sample = defaultdict(list)
    for (word,) in words.select("word").orderBy(F.xxhash64("word"), "word").limit(SAMPLE).collect():
        sample[len(word)].append(word)
    none = np.zeros((0, DIMS), np.int32)
    return {n: planes(letter_counts(codes_of(sample[n])) if n in sample else none, size, cell_words) for n, size in sizes.items()}


def near_words(words: DataFrame, cell_words: int = CELL_WORDS) -> DataFrame:
    """(word, n_near, form_n, form) for the distinct words of ``words`` (word, n) that have a near word."""
    spark = words.sparkSession
    sent = spark.sparkContext.broadcast(fitted(words, cell_words))  # at most two nodes per sampled word, and one per length

    def deal(stream):
        """A word is a member of its cell, asks the cells of its length, and those of words one longer."""
        held: dict[int, list[tuple[str, int]]] = defaultdict(list)

        def flush(length):
            rows, trees = held.pop(length), sent.value
            points = letter_counts(codes_of([w for w, _ in rows]))
            home, cell = cells_near(trees[length], points, 0)
            for i, c in zip(home.tolist(), cell.tolist()):
                yield length, c, 0, *rows[i]
            for other, reach in ((length, 2), (length + 1, 1)):
                if other in trees:
                    near, cell = cells_near(trees[other], points, reach)
                    for i, c in zip(near.tolist(), cell.tolist()):
                        yield other, c, 1 + other - length, *rows[i]

        for word, n in stream:
            held[len(word)].append((word, n))
            if len(held[len(word)]) >= ASKED:
                yield from flush(len(word))
        for length in sorted(held):
            yield from flush(length)

    dealt = map_rows(words.select("word", "n"), deal, "length int, cell int, role int, word string, n long")
    order = ["length", "cell"]
    dealt = dealt.repartition(width(spark), *order).sortWithinPartitions(*order, "role", "word")

    def search(stream):
        for _, cell in groupby(stream, key=lambda r: r[:2]):
            members, tree = None, None
            for role, part in groupby(cell, key=lambda r: r[2]):
                if role == 0:
                    rows = list(part)
                    names, counts = [r[3] for r in rows], np.array([r[4] for r in rows], np.int64)
                    codes = codes_of(names)
                    tree, members = Tree(letter_counts(codes)), Tally(names)
                elif tree is not None:  # else no word of that cell is there
                    yield from asked(part, role, tree, codes, names, counts, members)
            if members is not None:
                yield from members.rows()

    def asked(part, role, tree, codes, names, counts, members):
        while rows := list(islice(part, ASKED)):
            own, n = [r[3] for r in rows], np.array([r[4] for r in rows], np.int64)
            mine, tally = codes_of(own), Tally(own)
            held, size = [], 0

            def settle():
                i, j = (np.concatenate(x) for x in zip(*held))
                ok = one_edit(mine[i], codes[j])
                i, j = i[ok], j[ok]
                tally.add(i, j, names, counts)
                if role == 2:  # words one longer hear of it here; equal lengths meet from both sides
                    members.add(j, i, own, n)

            for found in tree.within(letter_counts(mine), 3 - role):
                held.append(found)
                size += len(found[0])
                if size >= PAIRS:
                    settle()
                    held, size = [], 0
            if held:
                settle()
            yield from tally.rows()

    found = map_rows(dealt, search, "word string, near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("n"), "form"))
    found = found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("best"))
    return found.select("word", "n_near", (-F.col("best.n")).alias("form_n"), F.col("best.form").alias("form"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for the words with a form: the last of the chain.  Each step doubles the reach, so a chain of
    k forms, where k is at most the logarithm of the largest count, takes log k steps."""
    reached = staged(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = reached.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        joined = reached.join(ahead, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved"))
        reached = staged(joined)
        if not reached.filter("moved").limit(1).count():
            return reached.select("word", "root")


def variants(docs: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, times: int = TIMES, cell_words: int = CELL_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n), a row per distinct word of the texts.

    Words are maximal runs of Latin letters, A-Z lowered, one in 199 with a letter left out by its hash, of at least
    ``min_letters`` code points and ``min_count`` occurrences.  Two are near if one inserted, deleted or replaced code
    point makes one the other.  The form is the near word of largest n (ties: least in code-point order) if it has
    ``times`` the word's n or more.  ``docs`` has doc_id and text, other columns are ignored.  NULL, empty and letterless
    texts have no words; a NULL id counts as an empty one in the hash; repeated rows count as often as they are there.
    An empty table gives no rows.
    """
    words = staged(word_counts(docs, min_letters).filter(F.col("n") >= min_count))
    near = near_words(words, cell_words)
    full = words.join(near, "word", "left")
    stands = F.col("form_n") >= times * F.col("n")
    full = staged(full.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(stands, F.col("form")).alias("form"), F.when(stands, F.col("form_n")).alias("form_n")))
    out = full.join(roots(full.filter("form IS NOT NULL")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))
