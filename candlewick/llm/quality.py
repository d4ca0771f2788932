"""Quality and toxicity by co-training two views of a document.

One linear classifier sees the text (hashed words and word shapes), the other the
page's metadata (source, language, length, URL parts).  Over some rounds each adds
its most confident labels for unlabelled documents to the other's training rows.
Held-back labelled rows calibrate either view and weigh them against each other;
the combination scores every document.

Fitting uses samples of bounded size (``LABELLED``, ``POOL`` rows, chosen by a hash of
the id); scoring covers everything.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.llm.common import map_rows, table

LABELLED, POOL = 6_000, 6_000
ROUNDS, ADDED = 4, 0.05  # share of the pool exchanged per round and class
TEXT_BITS, META_BITS = 15, 12
TARGETS = ("quality", "toxic")
CACHE = 300_000
_CORE = re.compile(r"[^\W_]+")


class TextFeatures:
    """Present words (weight falls slowly with their number), and shares of word shapes."""

    size = 2 << TEXT_BITS

    def __init__(self):
        self.known: dict[str, tuple[int, int]] = {}

    def _new(self, piece: str) -> tuple[int, int]:
        mask = (1 << TEXT_BITS) - 1
        low = piece.lower()
        core = "".join(_CORE.findall(low)) or low
        shape = re.sub(r"(.)\1+", r"\1", re.sub(r"[^\W\d_]", "a", re.sub(r"\d", "0", low[:64])))
        pair = (zlib.crc32(core.encode("utf-8", "surrogatepass")) & mask, (zlib.crc32(shape.encode("utf-8", "surrogatepass")) & mask) + mask + 1)
        self.known[piece] = pair
        return pair

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        pieces = text.split()
        if not pieces:
            return np.zeros(0, np.int32), np.zeros(0, np.float32)
        if len(self.known) > CACHE:
            self.known.clear()
        get, new = self.known.get, self._new
        both = np.array([p if (p := get(w)) is not None else new(w) for w in pieces], np.int32)
        words = np.unique(both[:, 0])
        shapes, counts = np.unique(both[:, 1], return_counts=True)
        weight = np.full(len(words), 1 / np.sqrt(1 + len(words) / 200), np.float32)
        return np.concatenate([words, shapes]), np.concatenate([weight, (4 * counts / len(pieces)).astype(np.float32)])


def meta_features(source, lang, n_chars, url) -> tuple[np.ndarray, np.ndarray]:
    parts = [f"source={source}", f"lang={lang}", f"length={int(n_chars or 0).bit_length()}"]
    if url:
        scheme, _, rest = url.partition("://")
        host, *path = rest.partition("?")[0].split("#")[0].split("/")
        parts += [f"scheme={scheme}", f"host={host}", f"domain={'.'.join(host.split('.')[-2:])}", f"depth={len(path)}", f"query={'?' in url}"]
    at = np.unique([zlib.crc32(p.encode("utf-8", "surrogatepass")) & ((1 << META_BITS) - 1) for p in parts]).astype(np.int32)
    return at, np.ones(len(at), np.float32)


@dataclass
class Rows:
    """Sparse rows in one piece: feature numbers, values, and where each row begins."""

    at: np.ndarray
    value: np.ndarray
    start: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[np.ndarray, np.ndarray]]) -> Rows:
        join = lambda i, kind: np.concatenate([r[i] for r in rows]) if rows else np.zeros(0, kind)
        return cls(join(0, np.int32), join(1, np.float32), np.concatenate([[0], np.cumsum([len(r[0]) for r in rows])]).astype(np.int64))

    def __len__(self) -> int:
        return len(self.start) - 1

    def dot(self, weights: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(weights[self.at] * self.value)])
        return sums[self.start[1:]] - sums[self.start[:-1]]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Linear:
    """Logistic regression by full-batch Adam; starts from where it stands."""

    size: int
    weights: np.ndarray = field(init=False)
    bias: float = 0.0

    def __post_init__(self):
        self.weights = np.zeros(self.size)

    def fit(self, rows: Rows, y: np.ndarray, steps: int = 80, rate: float = 0.15, decay: float = 1e-3) -> None:
        if not len(y):
            return
        owner = np.repeat(np.arange(len(rows)), np.diff(rows.start))
        first, second = np.zeros(self.size + 1), np.zeros(self.size + 1)
        for t in range(1, steps + 1):
            off = (_sigmoid(rows.dot(self.weights) + self.bias) - y) / len(y)
            grad = np.append(np.bincount(rows.at, weights=rows.value * off[owner], minlength=self.size) + decay * self.weights, off.sum())
            first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
            step = rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-6)
            self.weights -= step[:-1]
            self.bias -= step[-1]

    def margin(self, rows: Rows) -> np.ndarray:
        return rows.dot(self.weights) + self.bias


def _calibrate(columns: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Weights and bias of a small logistic regression (Newton steps, ridge)."""
    x = np.stack([*columns, np.ones(len(y))], axis=1)
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-2] * len(columns) + [1e-4])
    for _ in range(30):
        p = _sigmoid(x @ w)
        w -= np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-6)[:, None]) + ridge, x.T @ (p - y) + ridge @ w)
    return w


@dataclass
class View:
    linear: Linear
    scale: np.ndarray = field(default_factory=lambda: np.array([1.0, 0.0]))

    def logit(self, rows: Rows) -> np.ndarray:
        return self.scale[0] * self.linear.margin(rows) + self.scale[1]


@dataclass
class CoTrained:
    text: View
    meta: View
    mix: np.ndarray

    def score(self, text_logit, meta_logit):
        return _sigmoid(self.mix[0] * text_logit + self.mix[1] * meta_logit + self.mix[2])


def co_train(text: Rows, meta: Rows, y: np.ndarray, pool_text: Rows, pool_meta: Rows, rounds: int = ROUNDS, added: float = ADDED) -> CoTrained:
    """Views exchange the labels they are surest of, as far as rows held back bear them out; every fourth labelled row is held back and calibrates."""
    hold = np.arange(len(y)) % 4 == 3 if len(y) >= 40 else np.zeros(len(y), bool)
    pick = lambda rows, mask: Rows.of([(rows.at[a:b], rows.value[a:b]) for a, b, m in zip(rows.start[:-1], rows.start[1:], mask) if m])
    views = {"text": View(Linear(TextFeatures.size)), "meta": View(Linear(1 << META_BITS))}
    known = {"text": pick(text, ~hold), "meta": pick(meta, ~hold)}
    held_back = {"text": pick(text, hold), "meta": pick(meta, hold)}
    pools = {"text": pool_text, "meta": pool_meta}
    taught: dict[str, dict[int, float]] = {"text": {}, "meta": {}}  # pool row -> label given by the other view
    prior = float(y.mean()) if len(y) else 0.5
    for turn in range(rounds + 1):
        for name, view in views.items():
            own = taught[name]
            extra = np.isin(np.arange(len(pools[name])), list(own))
            rows, more = known[name], pick(pools[name], extra)
            both = Rows(np.concatenate([rows.at, more.at]), np.concatenate([rows.value, more.value]), np.concatenate([rows.start, rows.start[-1] + more.start[1:]]))
            view.linear.fit(both, np.concatenate([y[~hold], [own[i] for i in np.flatnonzero(extra)]]), steps=80 if turn == 0 else 25)
        if turn == rounds or not len(pool_text):
            break
        for name, other in (("text", "meta"), ("meta", "text")):
            margin = views[name].linear.margin(pools[name])
            order = np.argsort(margin, kind="stable")
            seen = views[name].linear.margin(held_back[name])
            # per class in proportion to the labels, and only if labels given so surely are right on the rows held back
            for label, ends, share, sign, needed in ((0.0, order, 1 - prior, -1, 1 - prior / 4), (1.0, order[::-1], prior, 1, 0.9)):
                sure = ends[: int(added * share * len(ends))]
                if len(sure):
                    alike = y[hold][sign * seen >= sign * margin[sure[-1]]]
                    if len(alike) >= 5 and (alike == label).mean() >= needed:
                        taught[other].update((int(i), label) for i in sure)
    at = hold if hold.any() else np.ones(len(y), bool)
    if at.any() and 0 < y[at].mean() < 1:
        for name, rows in (("text", text), ("meta", meta)):
            views[name].scale = _calibrate([views[name].linear.margin(pick(rows, at))], y[at])
        logits = [views["text"].logit(pick(text, at)), views["meta"].logit(pick(meta, at))]
        mix = _calibrate(logits, y[at])
    else:
        mix = np.array([1.0, 0.0, 0.0])
    return CoTrained(views["text"], views["meta"], mix)


def _sample(df: DataFrame, rows: int) -> DataFrame:
    """About ``rows`` rows, chosen by a hash of the id: the same ones in every run."""
    n = df.count()
    return df if n <= rows else df.filter(F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(1 << 30)) < int(rows / n * (1 << 30)))


def _features(docs: DataFrame, labels: DataFrame, pages: DataFrame):
    """Features of the few sampled documents, on the driver."""
    ids = F.broadcast(labels)  # LABELLED or POOL rows
    few = docs.join(ids, "doc_id")
    urls = pages.join(F.broadcast(labels.select("doc_id").distinct()), "doc_id").groupBy("doc_id").agg(F.min("url").alias("url"))

    def rows(stream):
        words = TextFeatures()
        for doc_id, text, source, lang, n_chars, *y in stream:
            at, value = words(text)
            yield doc_id, at.tobytes(), value.tobytes(), source, lang, n_chars, *y

    names = [c for c in labels.columns if c != "doc_id"]
    cols = ["doc_id", F.coalesce("text", F.lit("")).alias("text"), "source", "lang", "n_chars", *names]
    kind = "doc_id long, at binary, value binary, source string, lang string, n_chars long" + "".join(f", {c} int" for c in names)
    got = map_rows(few.select(*cols), rows, kind).join(F.broadcast(urls), "doc_id", "left").orderBy(F.xxhash64("doc_id", F.lit(9)), "doc_id", "at").collect()
    text = Rows.of([(np.frombuffer(r.at, np.int32), np.frombuffer(r.value, np.float32)) for r in got])
    meta = Rows.of([meta_features(r.source, r.lang, r.n_chars, r.url) for r in got])
    return text, meta, {c: np.array([getattr(r, c) for r in got], float) for c in names}


def fit(docs: DataFrame, labels: DataFrame, pages: DataFrame, labelled: int = LABELLED, pool: int = POOL) -> dict[str, CoTrained]:
    """One co-trained pair per target.  NULL labels and ids are passed over; of repeated labels the largest counts."""
    labels = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull())
    labels = labels.groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"), F.max("toxic").cast("int").alias("toxic"))
    text, meta, y = _features(docs, _sample(labels, labelled), pages)
    ids = docs.filter(F.col("doc_id").isNotNull()).select("doc_id")
    others = _sample(ids, pool).distinct().join(labels, "doc_id", "left_anti")
    pool_text, pool_meta, _ = _features(docs, others, pages)
    return {t: co_train(text, meta, y[t], pool_text, pool_meta) for t in TARGETS}


def score(docs: DataFrame, pages: DataFrame, models: dict[str, CoTrained]) -> DataFrame:
    """(doc_id, quality_score, toxic_score), a row per row of ``docs``; models, of fixed size, travel with the task's code.

    NULL text has no words, NULL metadata is a value of its own.  Documents without page have no URL.
    """
    def by_text(stream):
        words = TextFeatures()
        for doc_id, text, source, lang, n_chars in stream:
            rows = Rows.of([words(text)])
            yield doc_id, source, lang, n_chars, *(float(models[t].text.logit(rows)[0]) for t in TARGETS)

    def by_both(stream):
        known = {}
        for doc_id, source, lang, n_chars, url, *logits in stream:
            key = (source, lang, int(n_chars or 0).bit_length(), url)
            if key not in known:
                if len(known) > 50_000:
                    known.clear()
                rows = Rows.of([meta_features(source, lang, n_chars, url)])
                known[key] = [float(models[t].meta.logit(rows)[0]) for t in TARGETS]
            yield doc_id, *(float(models[t].score(a, b)) for t, a, b in zip(TARGETS, logits, known[key]))

    slim = map_rows(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "source", "lang", F.col("n_chars").cast("long")), by_text,
                    "doc_id long, source string, lang string, n_chars long, q double, t double")
    urls = pages.groupBy("doc_id").agg(F.min("url").alias("url"))
    return map_rows(slim.join(urls, "doc_id", "left").select("doc_id", "source", "lang", "n_chars", "url", "q", "t"), by_both, "doc_id long, quality_score double, toxic_score double")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "url")
    models = fit(docs, table(spark, sf_dir, "labels"), pages)
    keep = (F.col("quality_score") >= 0.5) & (F.col("toxic_score") < 0.5)
    return score(docs, pages, models).withColumn("keep", keep)
