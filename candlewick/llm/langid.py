"""Language identification with spans for mixed text.

Counts of hashed character n-grams per language are learned from labelled
documents.  A word's script (by ranges of code points) narrows the languages that
may score at all; n-gram log odds score the rest.  The best labelling of a text's
words under a penalty for every switch of language (Viterbi) gives spans, and the
language with most letters is the prediction.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlewick.llm.common import map_rows, table

BITS = 16
FEATURES = 1 << BITS
SWITCH = 12.0
DAMPING = 0.35  # overlapping n-grams are not independent
SCRIPT_SHARE = 0.01
LONG_PIECE, CHUNK = 48, 24
CACHE = 300_000
DOCS_AT_ONCE = 128
UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")
# First code point of the common scripts' ranges.
SCRIPT_STARTS = [0x0000, 0x0370, 0x0400, 0x0530, 0x0590, 0x0600, 0x0700, 0x0900, 0x0980, 0x0A00, 0x0A80, 0x0B00, 0x0B80, 0x0C00, 0x0C80,
                 0x0D00, 0x0D80, 0x0E00, 0x0E80, 0x0F00, 0x1000, 0x10A0, 0x1100, 0x1200, 0x1780, 0x1E00, 0x1F00, 0x2000, 0x3040, 0x3100,
                 0x3400, 0xA000, 0xAC00, 0xD7B0, 0xF900, 0xFB00]
# Ranges that belong to one script carry the number of its first range.
SAME_SCRIPT = {0x1E00: 0x0000, 0x1F00: 0x0370, 0xF900: 0x3400, 0x1100: 0xAC00}
SCRIPTS = len(SCRIPT_STARTS)


def script_of(letter: str) -> int:
    start = SCRIPT_STARTS[bisect_right(SCRIPT_STARTS, ord(letter)) - 1]
    return bisect_right(SCRIPT_STARTS, SAME_SCRIPT.get(start, start)) - 1


def pieces_of(text: str) -> list[str]:
    """Blank-separated pieces; very long ones (scripts without spaces) in chunks."""
    pieces = text.split()
    if pieces and max(map(len, pieces)) > LONG_PIECE:
        pieces = [p[i : i + CHUNK] for p in pieces for i in range(0, len(p), CHUNK if len(p) > LONG_PIECE else len(p))]
    return pieces


def words_in(piece: str) -> list[str]:
    return [w for w in LETTERS.findall(piece.lower()) if any(map(str.isalpha, w))]


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all words at once, as (feature, number of its word): runs of two to four
    characters of the word in its frame, and the word itself."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = np.frombuffer(("^" + "$^".join(words) + "$").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    start = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    owner = np.repeat(np.arange(len(words)), lengths)
    left = np.repeat(start + lengths, lengths) - np.arange(len(codes))  # characters to the end of the word
    base, found, owners = np.uint64(0x9E3779B97F4A7C15), [], []
    run = np.zeros(len(codes), np.uint64)
    for n in range(1, 5):
        run[: len(codes) - n + 1] = run[: len(codes) - n + 1] * base + codes[n - 1 :]
        if n > 1:
            whole = np.flatnonzero(left >= n)
            found.append(run[whole] + np.uint64(n))
            owners.append(owner[whole])
    place = np.arange(len(codes)) - np.repeat(start, lengths)
    powers = np.cumprod(np.full(int(lengths.max()), base, np.uint64), dtype=np.uint64)
    found.append(np.add.reduceat(codes * powers[place], start))
    owners.append(np.arange(len(words)))
    x = np.concatenate(found)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    return (x & np.uint64(FEATURES - 1)).astype(np.int64), np.concatenate(owners)


@dataclass
class Model:
    """Log likelihoods by feature and language, and the scripts each language uses."""

    langs: list[str]
    weights: np.ndarray  # FEATURES x languages
    allowed: np.ndarray  # scripts x languages

    @classmethod
    def fit(cls, langs: list[str], counts: np.ndarray) -> Model:
        """``counts``: languages x (FEATURES + SCRIPTS)."""
        grams, letters = counts[:, :FEATURES].astype(float), counts[:, FEATURES:].astype(float)
        logs = np.log((grams + 0.1) / (grams.sum(axis=1, keepdims=True) + 0.1 * FEATURES))
        weights = (logs - logs.mean(axis=0)).T * DAMPING if len(langs) else np.zeros((FEATURES, 0))
        share = letters / np.maximum(letters.sum(axis=1, keepdims=True), 1)
        return cls(langs, weights.astype(np.float32), (share >= SCRIPT_SHARE).T)


class Scorer:
    """A score row per piece, kept for pieces met before; row 0 is for pieces without letters."""

    def __init__(self, model: Model):
        self.model = model
        self.table = np.zeros((CACHE + 1, len(model.langs)), np.float32)
        self.letters = np.zeros(CACHE + 1, np.int64)
        self.known: dict[str, int] = {}
        self.used = 1

    def learn(self, pieces: set[str]) -> None:
        """Score rows for pieces not met before, all at once."""
        new = [p for p in pieces if p not in self.known]
        if self.used + len(new) > len(self.letters):
            self.known.clear()
            self.used, new = 1, list(pieces)
            if len(new) >= len(self.letters):  # texts of more distinct pieces than are kept otherwise
                self.table = np.zeros((len(new) + 1, self.table.shape[1]), np.float32)
                self.letters = np.zeros(len(new) + 1, np.int64)
        words, owner, scripts = [], [], []
        for i, piece in enumerate(new):
            for word in words_in(piece):
                words.append(word)
                owner.append(i)
                scripts.append(script_of(word[0]))
        at, of = features(words)
        owner = np.array(owner, np.int64)
        allowed = self.model.allowed[np.array(scripts, np.int64)] if words else np.zeros((0, len(self.model.langs)), bool)
        some = allowed.any(axis=1) if words else np.zeros(0, bool)
        letters = np.bincount(owner, weights=[len(w) for w in words], minlength=len(new)).astype(np.int64) if words else np.zeros(len(new), np.int64)
        end = self.used + len(new)
        for lang in range(len(self.model.langs)):
            own = np.bincount(of, weights=self.model.weights[at, lang], minlength=len(words))
            own = np.where(some, own + np.where(allowed[:, lang], 0.0, -50.0), 0.0)
            self.table[self.used : end, lang] = np.bincount(owner, weights=own, minlength=len(new)) if words else 0.0
        self.letters[self.used : end] = letters
        self.known.update((p, self.used + i if letters[i] else 0) for i, p in enumerate(new))
        self.used = end

    def score(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        at = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
        return self.table[at].astype(np.float64), self.letters[at]


def viterbi(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Labelling with the largest sum of scores less ``switch`` per change of label.

    If no stretch of words gains more than one switch by leaving the best single
    label, that label is the optimum; else the recursion is run.
    """
    n, k = scores.shape
    best = int(scores.sum(axis=0).argmax())
    gain = np.zeros((n + 1, k))
    np.cumsum(scores - scores[:, best : best + 1], axis=0, out=gain[1:])
    if (gain - np.minimum.accumulate(gain, axis=0)).max(initial=0.0) <= switch:
        return np.full(n, best)
    back = np.zeros((n, k), np.int32)
    value, own = scores[0].copy(), np.arange(k)
    for t in range(1, n):
        top = int(value.argmax())
        moved = value[top] - switch
        change = value < moved
        back[t] = np.where(change, top, own)
        value = np.where(change, moved, value) + scores[t]
    labels = np.empty(n, np.int64)
    labels[-1] = value.argmax()
    for t in range(n - 1, 0, -1):
        labels[t - 1] = back[t, labels[t]]
    return labels


def identify(text: str | None, pieces: list[str], scorer: Scorer) -> tuple[str, float, list[tuple[int, int, str]]]:
    """(language, share of letters it labels, spans); the scorer has learnt the pieces."""
    langs = scorer.model.langs
    if not pieces or not langs:
        return UNKNOWN, 0.0, []
    scores, letters = scorer.score(pieces)
    total = int(letters.sum())
    if not total:
        return UNKNOWN, 0.0, []
    labels = viterbi(scores)
    votes = np.bincount(labels, weights=letters, minlength=len(langs))
    first = int(votes.argmax())
    cuts = np.flatnonzero(np.diff(labels)) + 1
    starts = [0]
    if len(cuts):
        # where in the text the pieces at the cuts begin
        places, at, wanted = {}, 0, set(cuts.tolist())
        for i, piece in enumerate(pieces):
            at = text.index(piece, at)
            if i in wanted:
                places[i] = at
            at += len(piece)
        starts += [places[i] for i in cuts.tolist()]
    spans = [(a, b, langs[labels[i]]) for a, b, i in zip(starts, [*starts[1:], len(text)], [0, *cuts.tolist()])]
    return langs[first], float(votes[first] / total), spans


def held_out(doc_id):
    return F.coalesce(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame) -> Model:
    """Model of the texts and labels of ``docs`` (columns text and lang); NULLs are passed over.

    Each task adds up its own words; a dense table of fixed size per language is what comes back.
    """

    def rows(stream):
        sums: dict[str, np.ndarray] = {}
        words: dict[str, Counter] = {}

        def flush():
            for lang, counter in words.items():
                own = sums.setdefault(lang, np.zeros(FEATURES + SCRIPTS, np.int64))
                found, times = [], []
                for piece, n in counter.items():
                    for word in words_in(piece):
                        found.append(word)
                        times.append(n)
                        own[FEATURES + script_of(word[0])] += n * len(word)
                at, of = features(found)
                if found:
                    own[:FEATURES] += np.bincount(at, weights=np.array(times)[of], minlength=FEATURES).astype(np.int64)
                counter.clear()

        for lang, text in stream:
            words.setdefault(lang, Counter()).update(pieces_of(text))
            if sum(map(len, words.values())) > CACHE:
                flush()
        flush()
        for lang, own in sorted(sums.items()):
            for at in np.flatnonzero(own).tolist():
                yield lang, at, int(own[at])

    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    # FEATURES + SCRIPTS rows per language at most
    got = map_rows(labelled, rows, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(got.column("lang").to_pylist()))
    counts = np.zeros((len(langs), FEATURES + SCRIPTS), np.int64)
    number = {lang: i for i, lang in enumerate(langs)}
    lang_at = np.array([number[x] for x in got.column("lang").to_pylist()], np.int64)
    counts[lang_at, got.column("feature").to_numpy()] = got.column("n").to_numpy()
    return Model.fit(langs, counts)


def predict(docs: DataFrame, model: Model, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``carry`` columns, lang_pred, score, spans array<struct<start, end, lang>>; a row per row of ``docs``.

    Only the text counts.  NULL, empty or letterless text gives ``und``, score 0 and no spans.
    The model, of a fixed size per language, travels with the task's code.
    """
    def rows(stream):
        scorer = Scorer(model)
        while held := list(islice(stream, DOCS_AT_ONCE)):
            pieces = [pieces_of(row[0] or "") for row in held]
            scorer.learn(set().union(*pieces))
            for (text, *carried), own in zip(held, pieces):
                lang, score, spans = identify(text, own, scorer)
                yield *carried, lang, score, [{"start": a, "end": b, "lang": x} for a, b, x in spans]

    found = T.StructType.fromDDL("lang_pred string, score double, spans array<struct<start: int, end: int, lang: string>>")
    return map_rows(docs.select("text", *carry), rows, T.StructType([*docs.select(*carry).schema.fields, *found.fields]))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs, learn(docs.filter(~held_out(F.col("doc_id")))))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
