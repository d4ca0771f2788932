"""Class n-grams, spelling variants and lexical search against plain versions."""

import math
import zlib
from collections import Counter, defaultdict
from itertools import pairwise

import numpy as np
import pytest
import regex
from cases import AWKWARD, documents

from candlewick.llm import class_ngrams, lexical_search, spelling

SF = "/root/testdata/sf0.001"
LOWER = {c: c + 32 for c in range(65, 91)}


def pairs_of(spark, sf=SF):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def same(got, want):
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, map(tuple, want)))


# class-based n-grams


def plain_base(rows):
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    split = lambda x: [*regex.findall(r"[^\x20\x09-\x0D]+", (x or "").translate(LOWER)), None]
    counts = Counter(w for i, x in rows if not held(i) for w in split(x))
    total, kinds = counts.total(), len(counts)
    for i, x in rows:
        words = split(x)
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in words)
        yield i, held(i), len(words), sum(w in counts for w in words), total, round(base, 6)


def contract(rows):
    return [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows]


@pytest.fixture(scope="module")
def scored(spark):
    return class_ngrams.op11_class_ngrams(spark, SF).collect()


def test_class_ngrams_contract_and_held_out_perplexity(spark, scored):
    same(contract(scored), plain_base(pairs_of(spark)))
    held = [r for r in scored if r.held_out]
    tokens = sum(r.n_tokens for r in held)
    assert len(held) > 10 and sum(r.score for r in held) > sum(r.base_score for r in held) + 0.2 * tokens
    assert all(r.score < 0 and abs(math.log10(r.perplexity) + r.score / r.n_tokens) < 1e-9 for r in scored)


def test_class_ngrams_awkward(spark):
    rows = [*AWKWARD, (20, None), (20, None), (30, "one two\x0bthree four ÀÉ"), (31, "one two\x0bthree ONE")]
    got = class_ngrams.scores(documents(spark, rows), rounds=2).collect()
    same(contract(got), plain_base([r[:2] for r in rows]))
    assert all(math.isfinite(r.score) for r in got)
    assert class_ngrams.scores(documents(spark, [])).collect() == []
    # nothing to learn from: every id is held out
    alone = class_ngrams.scores(documents(spark, [(None, "a b"), (None, None)])).collect()
    same(contract(alone), plain_base([(None, "a b"), (None, None)]))
    assert all(math.isfinite(r.score) for r in alone)


def test_class_ngrams_blocks_do_not_matter(spark, scored, monkeypatch):
    monkeypatch.setattr(class_ngrams, "BLOCK_TOKENS", 3_000)
    monkeypatch.setattr(class_ngrams, "HELD", 2_000)
    monkeypatch.setattr(class_ngrams, "PACK_WORDS", 50)
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(5, "doc_id")
    again = {r.doc_id: r for r in class_ngrams.scores(docs).collect()}
    assert len(again) == len(scored) and all(abs(again[r.doc_id].score - r.score) < 1e-6 * abs(r.score) for r in scored)


def plain_exchange(cls, words, context, n, sums, turn):
    """The same round, word by word, from whole likelihoods: per word the classes that are as good as any."""
    f = lambda x: x * math.log(x) if x > 0 else 0.0
    value = lambda m: sum(map(f, m.ravel().tolist())) - 2 * sum(map(f, m[: class_ngrams.SIDE].sum(axis=0).tolist()))
    out = []
    for i, word in enumerate(dict.fromkeys(words.tolist())):
        mine = words == word
        tried = []
        for to in range(class_ngrams.CLASSES):
            m = sums.copy()
            m[context[mine], cls[i]] -= n[mine]
            without = value(m)
            m[context[mine], to] += n[mine]
            tried.append(value(m) - without)
        out.append({k for k, v in enumerate(tried) if v > max(tried) - 1e-9} if word & 1 == turn & 1 else {int(cls[i])})
    return out


def test_exchange_round(monkeypatch):
    monkeypatch.setattr(class_ngrams, "CLASSES", 4)
    monkeypatch.setattr(class_ngrams, "STRIP", 7)
    random = np.random.default_rng(3)
    words, side = random.integers(0, 30, 400), class_ngrams.SIDE
    left, right = random.choice([0, 1, 2, 512, 513], 400), random.choice([0, 1, 3, 512, 513], 400) + side
    words, context, n = class_ngrams._merged(np.tile(words, 2), np.concatenate([left, right]), np.ones(800))
    cls = random.integers(0, 4, len(np.unique(words))).astype(np.uint8)
    sums = np.zeros((2 * side, 4))
    np.add.at(sums, (context, np.repeat(cls, np.unique(words, return_counts=True)[1])), n)
    for turn in (0, 1):
        got = class_ngrams.exchanged(cls, words, context, n, sums, turn).tolist()
        assert all(k in best for k, best in zip(got, plain_exchange(cls, words, context, n, sums, turn), strict=True))


def test_transitions_are_distributions():
    counts = np.random.default_rng(1).integers(0, 50, (class_ngrams.KINDS, class_ngrams.KINDS))
    assert np.allclose((10 ** class_ngrams.transitions(counts, 40, 10)).sum(axis=1), 1)
    assert np.allclose((10 ** class_ngrams.transitions(np.zeros_like(counts), 0, 0)).sum(axis=1), 1)


def test_borders():
    line = class_ngrams.with_borders(np.array([5, 6, 7, 8]), np.array([2, 0, 1, 1]), np.array([True, True, False, True]), 9)
    assert line.tolist() == [9, 5, 6, 9, 9, 8, 9]
    assert class_ngrams.with_borders(np.array([5]), np.array([1]), np.array([False]), 9).tolist() == [9]


# spelling variants


def plain_variants(rows, least=6, count=5, times=5):
    n = Counter()
    for i, text in rows:
        for w in regex.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            n[w if h % 199 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    n = {w: k for w, k in n.items() if len(w) >= least and k >= count}
    holes, near = defaultdict(set), {w: set() for w in n}
    for w in n:
        for p in range(len(w)):
            holes[w[:p] + "\0" + w[p + 1 :]].add(w)
            if (x := w[:p] + w[p + 1 :]) in n:
                near[w].add(x)
                near[x].add(w)
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    best = {w: min(((-n[x], x) for x in near[w]), default=(0, None)) for w in n}
    form = {w: x for w, (k, x) in best.items() if x and -k >= times * n[w]}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        yield w, form.get(w), root, n[w], len(near[w]), n.get(form.get(w))


@pytest.mark.parametrize("cell_words", [spelling.CELL_WORDS, 60])
def test_variants_whole_table(spark, cell_words):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = spelling.variants(docs, cell_words=cell_words).collect()
    same(got, plain_variants(pairs_of(spark, "/root/testdata/sf0.01")))
    assert any(r.form and r.root != r.form for r in got) or any(r.form for r in got)


def test_variants_awkward(spark, monkeypatch):
    monkeypatch.setattr(spelling, "ASKED", 3)
    monkeypatch.setattr(spelling, "LEAF", 2)
    monkeypatch.setattr(spelling, "PAIRS", 2)
    # anagrams, accents that share a class, chains, ties of n, one very long word
    words = {"abcdef": 130, "abcdeg": 26, "abcdegh": 5, "bacdef": 5, "fedcba": 9, "étéété": 7, "étéétè": 40, "zzzzzz": 10, "zzzzzy": 50, "zzzzzx": 50, "x" * 3_000: 6, "x" * 2_999: 30}
    rows = [*AWKWARD, (40, " ".join(" ".join([w] * k) for w, k in words.items())), (40, "abcdef ABCDEF"), (41, "÷×÷×÷× " * 5), (42, "short only")]
    got = spelling.variants(documents(spark, rows)).collect()
    want = list(plain_variants([r[:2] for r in rows]))
    same(got, want)
    by = {r.word: r for r in got}
    assert by["zzzzzz"].form == "zzzzzx" and by["x" * 3_000].form == "x" * 2_999
    assert spelling.variants(documents(spark, [])).collect() == []


def test_one_edit():
    codes = lambda *w: spelling.codes_of(list(w))
    assert spelling.one_edit(codes("abc", "abc", "abc", "abc"), codes("abd", "abc", "bac", "xbc")).tolist() == [True, False, False, True]
    long = ["abcd", "xabc", "axbc", "aabc", "abxd", "bcad"]
    assert spelling.one_edit(codes(*["abc"] * 6), codes(*long)).tolist() == [True, True, True, True, False, False]


def test_planes_lose_no_neighbour():
    random = np.random.default_rng(5)
    points = random.integers(0, 3, (400, spelling.DIMS)).astype(np.int32)
    points[:, 4:] = 0
    nodes = spelling.planes(points[:100], 400, 20)
    home = dict(zip(*spelling.cells_near(nodes, points, 0)))
    for reach in (1, 2):
        rows, cells = spelling.cells_near(nodes, points, reach)
        visited = set(zip(rows.tolist(), cells.tolist()))
        near = np.abs(points[:, None] - points[None]).sum(axis=2) <= reach
        assert all((i, home[j]) in visited for i, j in np.argwhere(near).tolist())
        found = {(i, j) for a, b in spelling.Tree(points, 4).within(points, reach) for i, j in zip(a.tolist(), b.tolist())}
        assert found == set(map(tuple, np.argwhere(near).tolist()))


# lexical search


def plain_ranking(docs, items, top=50):
    term = regex.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    split = lambda x: term.findall((x or "").translate(LOWER))
    counts = [(i, Counter(split(x))) for i, x in docs]
    counts = [(i, c) for i, c in counts if c]
    total, length = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = defaultdict(set)
    for i, x in items:
        asked[i] |= set(split(x))
    for item, terms in asked.items():
        found = []
        for i, c in counts:
            m = 100 - 50 + (50 * c.total() * total) // length
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0))
        for rank, (score, none, i) in enumerate(sorted(found)[:top], 1):
            yield item, rank, None if none else i, -score


@pytest.mark.parametrize("block, chunk", [(lexical_search.BLOCK, lexical_search.CHUNK_POSTINGS), (4, 300)])
def test_ranking_whole_table(spark, monkeypatch, block, chunk):
    monkeypatch.setattr(lexical_search, "BLOCK", block)
    monkeypatch.setattr(lexical_search, "CHUNK_POSTINGS", chunk)
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    same(lexical_search.op13_lexical_search(spark, SF).collect(), plain_ranking(pairs_of(spark), items))


def test_ranking_awkward(spark):
    docs = [*AWKWARD, *[(i, "tie of words") for i in range(100, 170)], (99, "tie OF words"), (None, "tie of words")]
    asked = [(1, "word tie"), (1, "WORD; line, table"), (2, None), (3, ""), (None, "漢字かな жук"), (4, "nowhere"), (5, "end " * 500)]
    items = spark.createDataFrame([(i, x, "q", 1) for i, x in asked], "item_id long, text string, term string, w long")
    got = lexical_search.ranked(documents(spark, docs), items).collect()
    same(got, plain_ranking([r[:2] for r in docs], asked))
    assert [r.doc_id for r in sorted(got, key=lambda r: r.rank) if r.item_id == 1 and r.rank > 47][-1] < 150
    assert lexical_search.ranked(documents(spark, []), items).collect() == []
    assert lexical_search.ranked(documents(spark, docs), items.limit(0)).collect() == []


def test_walks_equal_sums():
    random = np.random.default_rng(2)
    for _ in range(40):
        n = int(random.integers(1, 3_000))
        shard = lexical_search.Shard(np.arange(n) * 3, random.integers(1, 300, n), n, 150 * n)
        terms = []
        for i in range(int(random.integers(1, 12))):
            held = np.sort(random.choice(n, int(random.integers(1, n + 1)), replace=False)).astype(np.uint32)
            shard.add(bytes([i]), held, random.integers(1, 9, len(held)).astype(np.uint32))
            terms.append((bytes([i]), int(random.integers(0, 5_000))))
        total = np.zeros(n, np.int64)
        for t, w in terms:
            held, counts = shard.raw[t]
            total[held] += w * ((1_000_000_000 * counts.astype(np.int64)) // (1000 * counts.astype(np.int64) + shard.norm[held]))
        order = [i for i in np.lexsort((np.arange(n), -total)) if total[i] > 0][:50]
        ids, scores = shard.search(terms)
        assert ids.tolist() == [3 * i for i in order] and scores.tolist() == total[order].tolist()
        assert all(a >= b for a, b in pairwise(scores.tolist()))
