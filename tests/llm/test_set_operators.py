"""Neighbours, mixing, packing, repeats, joins and classifiers against plain versions."""

import itertools
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from cases import AWKWARD, documents
from pyspark.sql import functions as F

from candlewick.llm import mixing, neighbours, packing, quality, shingle_join, substring_dedup
from candlewick.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


# neighbours


def plain_nearest(vectors, queries, k):
    out = {}
    for q, qv in queries:
        far = sorted((float(np.sqrt(((np.array(v, float) - np.array(qv, float)) ** 2).sum())), i) for i, v in vectors if i != q and len(v) == len(qv))
        out[q] = far[:k]
    return out


def test_neighbours_exact_with_factor_one(spark):
    random = np.random.default_rng(8)
    rows = [(int(i), [float(np.float32(x)) for x in random.normal(size=6)], 0) for i in range(700)]
    rows += [(1000 + i, rows[3][1], 0) for i in range(200)]  # many equal vectors: ties by id
    odd = [(2000, None, 0), (2001, [0.0] * 6, 0), (2002, [1.0, None, 1.0, 1.0, 1.0, 1.0], 0), (2003, [float("nan")] + [1.0] * 5, 0), (2004, [float("inf")] + [1.0] * 5, 0), (None, [1.0] * 6, 0), (2005, [1.0, 2.0], 0)]
    df = spark.createDataFrame([(i, v, s, "x", "y") for i, v, s in rows + odd], "vec_id long, embedding array<float>, score int, rank string, shard string")
    got = neighbours.nearest(df, df.filter("vec_id % 100 = 0 OR vec_id = 2005"), 10, 1.0, shard_values=800).collect()
    want = plain_nearest([r[:2] for r in rows], [r[:2] for r in rows if r[0] % 100 == 0], 10)
    found = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        found[r.query_id].append((r.score, r.vec_id))
    assert set(found) == set(want)
    for q in want:
        assert [i for _, i in found[q]] == [i for _, i in want[q]]
        assert np.allclose([s for s, _ in found[q]], [s for s, _ in want[q]], rtol=1e-12)
    assert neighbours.nearest(df.limit(0), df).collect() == [] and neighbours.nearest(df, df.limit(0)).collect() == []


def test_neighbours_recall(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    want = plain_nearest(list(zip(df.vec_id, df.embedding)), [(i, v) for i, v in zip(df.vec_id, df.embedding) if i % 100 == 0], 10)
    got = QUERIES["op2_nearest"](spark, SF).collect()
    hits = sum(r.vec_id in {i for _, i in want[r.query_id]} for r in got)
    assert len(got) == 10 * len(want) and hits / len(got) >= 0.9


# mixing


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, target, active = share * sum(sizes.values()), {}, set(names)
    while active:
        level = left / sum(weight[s] for s in active)
        over = {s for s in active if level * weight[s] > most * sizes[s]}
        if not over:
            target.update({s: level * weight[s] for s in active})
            break
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        active -= over
    return target


def test_mixing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("source", F.expr("CASE WHEN doc_id % 3 = 0 THEN 'src0' WHEN doc_id % 40 = 1 THEN NULL ELSE source END"))
    full = mixing.mix(docs).join(docs.select("doc_id", "source", "text"), "doc_id").toPandas()
    assert (full["size"] == [len((t or "").encode().split()) for t in full.text]).all()
    sizes = full.groupby("source", dropna=False)["size"].sum().to_dict()
    sizes = {None if s is None or s != s else s: v for s, v in sizes.items()}
    want = plain_targets(sizes)
    key = [None if s is None or s != s else s for s in full.source]
    assert np.allclose(full.target, [want[s] for s in key], rtol=1e-9)
    assert (full.source_size == [sizes[s] for s in key]).all()
    assert (full.taken <= 2 * full["size"]).all() and (full.taken == full.copies * full["size"]).all()
    taken = full.groupby("skey").agg(taken=("taken", "sum"), target=("target", "first"))
    assert ((taken.taken - taken.target).abs() <= 0.02 * taken.target + 5).all()
    again = mixing.mix(docs.repartition(5)).toPandas()
    assert sorted(zip(again.doc_id, again.taken)) == sorted(zip(full.doc_id, full.taken))


def test_mixing_rates_are_the_entropy_optimum(spark):
    """For one free source the rates equal min(2, exp(lambda x)) with lambda found by bisection."""
    random = np.random.default_rng(9)
    sizes = random.integers(1, 60, 400)
    cells = spark.createDataFrame([("0a", int(s), int(n)) for s, n in Counter(sizes.tolist()).items()], "skey string, size long, n long")
    for share in (0.3, 1.0, 1.7):
        sources = mixing.source_targets(cells, (1,), share)
        state = mixing.balance(cells, sources)
        rates = {r["size"]: r.rate for r in mixing._rates(cells, state, 2.0).collect()}
        low, high, x = -60.0, 60.0, sizes / sizes.mean()
        for _ in range(200):
            middle = (low + high) / 2
            low, high = (middle, high) if (sizes * np.minimum(2, np.exp(np.clip(middle * x, -50, 50)))).sum() < share * sizes.sum() else (low, middle)
        assert all(abs(rates[s] - min(2, np.exp(low * s / sizes.mean()))) < 1e-5 for s in set(sizes.tolist()))


def test_mixing_awkward(spark):
    got = mixing.mix(documents(spark, AWKWARD)).collect()
    assert len(got) == len(AWKWARD) and all(r.taken <= 2 * r["size"] for r in got)
    assert mixing.mix(documents(spark, [])).collect() == []
    empty = mixing.mix(documents(spark, [(1, None), (2, "")])).collect()
    assert [(r["size"], r.taken) for r in empty] == [(0, 0)] * 2


def test_mixing_plan_is_native(spark):
    text = mixing.mix(documents(spark, AWKWARD))._jdf.queryExecution().toString()
    assert "Python" not in text and "Arrow" not in text and "Pandas" not in text


# packing


def test_packing_rebuilds_every_document(spark):
    rows = [*AWKWARD, (50, "<|endoftext|> special")]
    got = packing.pack(documents(spark, rows), shard_docs=4).collect()
    encode = packing.encoder()
    want = Counter()
    for doc_id, text, *_ in rows:
        ids = np.append(np.array(encode(text or ""), "<u4"), 0).astype("<u4")
        for a in range(0, len(ids), 1024):
            want[(doc_id, a, len(ids[a : a + 1024]), zlib.crc32(ids[a : a + 1024].tobytes()), len(ids))] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    windows = defaultdict(list)
    for r in got:
        windows[r.sequence_id].append((r.offset, r.length))
    for own in windows.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(own[-1]) <= 1024
    assert packing.pack(documents(spark, [])).collect() == []


def test_packing_takes_the_tightest_window():
    random = np.random.default_rng(10)
    for _ in range(50):
        lengths = sorted(random.integers(1, 1025, 60).tolist(), reverse=True)
        windows, offsets = packing.best_fit(lengths)
        free, plain = [], []
        for n in lengths:
            fitting = [(c, -i) for i, c in enumerate(free) if c >= n]
            if fitting:
                c = min(fitting)[0]
                free[free.index(c)] -= n
            else:
                free.append(1024 - n)
            plain.append(sorted(free))
        used = defaultdict(int)
        for n, w, o in zip(lengths, windows, offsets):
            assert used[w] == o
            used[w] += n
        assert sorted(1024 - v for v in used.values()) == plain[-1]


def test_tokenizers_agree():
    from tokenizers import Tokenizer
    import public_tokenizers

    full, encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.encoder()
    random = np.random.default_rng(11)
    letters = list("abc  \n\t'sé漢\U0001f600.,1") + [" the", "  ", "\r\n", "'ll", " ", " "]
    for text in ["".join(random.choice(letters, random.integers(0, 60))) for _ in range(500)]:
        assert encode(text) == full.encode(text, add_special_tokens=False).ids


# repeats


def test_repeats(spark):
    random = np.random.default_rng(12)
    words = ["".join(random.choice(list("abcdefgh"), 6)) for _ in range(5000)]
    say = lambda n: [str(w) for w in random.choice(words, n)]
    passages = [say(60) for _ in range(12)]
    rows, planted = [], []
    for i in range(60):
        body = say(int(random.integers(30, 200)))
        if i % 3 == 0:
            p = passages[i // 3 % 12]
            at = int(random.integers(0, len(body)))
            body = body[:at] + p + body[at:]
            planted.append((i, p))
        rows.append((i, " ".join(body)))
    got = {r.doc_id: r for r in substring_dedup.drop_repeats(documents(spark, rows)).collect()}
    seen = set()
    for i, p in planted:
        text, first = rows[i][1], tuple(p) not in seen
        seen.add(tuple(p))
        assert bool(got[i].removed) == (not first), i
        for a, b in (tuple(s) for s in got[i].removed):
            assert len(text[a:b].split()) >= 25 and text[a:b] in " ".join(p)
    clean = set(range(60)) - {i for i, _ in planted}
    assert all(got[i].text == rows[i][1] and not got[i].removed for i in clean)


def test_repeats_awkward(spark):
    long = " ".join(f"w{i}" for i in range(400))
    rows = [*AWKWARD, (60, long), (61, long), (61, long), (62, "start " + long.upper() + "!"), (None, long)]
    got = substring_dedup.drop_repeats(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    by_id = defaultdict(list)
    for r in got:
        by_id[r.doc_id].append(r)
    assert by_id[60][0].text == long and len({r.text for r in by_id[61]}) == 1 and len(by_id[61][0].text.split()) < 40
    assert len(by_id[62][0].text.split()) < 40
    assert substring_dedup.drop_repeats(documents(spark, [])).collect() == []


def test_repeated_lines_and_paragraphs(spark):
    random = np.random.default_rng(21)
    word = lambda: "".join(random.choice(list("abcdefgh"), 8))
    say = lambda n: " ".join(word() for _ in range(n))
    lines = [say(n) for n in range(1, 31)]
    rows = [(i, "\n".join([say(9), lines[i % 30] if i < 30 else f"  {lines[i % 30].upper()}. ", say(12)])) for i in range(90)]
    paragraph = [word() for _ in range(20)]
    for i, step in enumerate((4, 5, 7, 20)):  # wrapped in another way each time
        wrapped = [" ".join(paragraph[a : a + step]) for a in range(0, 20, step)]
        rows.append((100 + i, "\n".join([say(8), "", *wrapped, " ", say(8)])))
    for r in substring_dedup.drop_repeats(documents(spark, rows)).collect():
        text = rows[r.doc_id][1] if r.doc_id < 90 else rows[r.doc_id - 10][1]
        parts = text.split("\n")
        if r.doc_id < 30 or r.doc_id == 100:
            assert r.text == text and not r.removed, r.doc_id
        else:
            assert r.text.split() == (parts[0] + " " + parts[-1]).split() and len(r.removed) == 1, r.doc_id


def test_every_long_passage_is_found(spark):
    random = np.random.default_rng(22)
    words = ["".join(random.choice(list("abcdefgh"), 8)) for _ in range(20_000)]
    say = lambda n: [str(w) for w in random.choice(words, n)]
    rows, planted = [], {}
    for length in range(35, 61):
        for _ in range(40):
            passage = say(length)
            for _ in range(2):
                rows.append((len(rows), " ".join(say(int(random.integers(1, 40))) + passage + say(int(random.integers(1, 40))))))
            planted[len(rows) - 1] = " ".join(passage)
    for r in substring_dedup.drop_repeats(documents(spark, rows)).collect():
        spans = [rows[r.doc_id][1][a:b] for a, b in r.removed]
        assert len(spans) == (r.doc_id in planted), r.doc_id
        for cut in spans:
            assert cut in planted[r.doc_id] and len(cut.split()) >= len(planted[r.doc_id].split()) - 10


@pytest.mark.parametrize("doc_id", [None, 70])
def test_rows_of_no_or_equal_id_lose_only_their_own_repeats(spark, doc_id):
    say = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    passage = say("p", 60)
    rows = [(1, passage), (doc_id, f"{passage}\n{say('a', 60)}"), (doc_id, f"{say('b', 60)}\n{say('c', 60)}"), (doc_id, f"{say('q', 60)}\n{say('d', 9)}"), (doc_id, f"{say('q', 60)}\n{say('e', 9)}")]
    got = sorted(r.text.strip() for r in substring_dedup.drop_repeats(documents(spark, rows)).collect())
    q = [say("q", 60) in text for text in got]
    assert sum(q) == 1 and len(got) == 5  # one of the equal passages at equal places stays
    assert {passage, say("a", 60), rows[2][1]} <= set(got)
    assert {text.split()[-1] for text in got} == {"p59", "a59", "c59", "d8", "e8"}


def plain_repeats(rows, least):
    """Spans to remove by the definition: units and windows as tuples of words, the earliest of each stays."""
    words, parts = substring_dedup.Words(), []
    for doc, text in rows:
        codes, lines = words(text)
        _, starts, stops, n_units = substring_dedup.windows(codes, lines, least)
        bare = [w.casefold().strip(".,;:!?") or w.casefold() for w in text.split()]
        parts.append([(i < n_units, tuple(bare[a:b]), a, b) for i, (a, b) in enumerate(zip(starts, stops))])
    first = {}
    for (doc, text), found in sorted(zip(rows, parts), key=lambda x: x[0][0]):
        for at, (unit, key, _, _) in enumerate(found):
            first.setdefault((unit, key), (doc, at))
    out = {}
    for (doc, text), found in zip(rows, parts):
        late = [(unit, a, b) for at, (unit, key, a, b) in enumerate(found) if first[unit, key] != (doc, at)]
        gone = {i for unit, a, b in late if unit for i in range(a, b)}
        covered = sorted({i for _, a, b in late for i in range(a, b)})
        for _, run in itertools.groupby(enumerate(covered), lambda x: x[1] - x[0]):
            run = [i for _, i in run]
            gone |= set(run) if len(run) >= substring_dedup.RUN_WORDS else set()
        out[doc] = [w for i, w in enumerate(text.split()) if i not in gone]
    return out


@pytest.mark.parametrize("least", [1, 10])
def test_repeats_equal_the_plain_version(spark, least):
    random = np.random.default_rng(31)
    vocabulary = [f"w{i}" for i in range(3_000)]
    say = lambda n: " ".join(random.choice(vocabulary, n))
    shared = [say(int(n)) for n in random.integers(1, 70, 40)]
    rows = []
    for i in random.permutation(300):
        parts = [shared[random.integers(40)] if random.random() < 0.5 else say(int(random.integers(0, 30))) for _ in range(random.integers(1, 9))]
        rows.append((int(i), str(random.choice(["\n", "\n\n", " "])).join(parts)))
    rows += [(1000 + i, rows[0][1]) for i in range(200)]  # many copies
    want = plain_repeats(rows, least)
    assert sum(len(w) for w in want.values()) < sum(len(t.split()) for _, t in rows)
    for r in substring_dedup.drop_repeats(documents(spark, rows).repartition(9), least).collect():
        assert r.text.split() == want[r.doc_id], r.doc_id


def test_short_lines_stay_where_units_have_a_least_length(spark):
    stock = ["All rights reserved.", "x"]
    line = " ".join(f"n{i}" for i in range(10))
    rows = [(i, "\n".join([*stock, f"own{i}", line])) for i in range(5)]
    got = {r.doc_id: r.text.strip() for r in substring_dedup.drop_repeats(documents(spark, rows), 10).collect()}
    assert got[0] == rows[0][1] and all(got[i] == "\n".join([*stock, f"own{i}"]) for i in range(1, 5))


def test_late_records_do_not_grow_in_number_with_the_buckets(spark, monkeypatch):
    random = np.random.default_rng(33)
    vocabulary = [f"w{i}" for i in range(20_000)]
    say = lambda n: " ".join(random.choice(vocabulary, n))
    shared = [say(400) for _ in range(5)]
    rows = [(i, f"{say(50)}\n{shared[i % 5]}") for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(40)]  # copies
    words = substring_dedup.Words()
    found = [substring_dedup.windows(*words(text), 10)[0] for _, text in rows]
    want = sum(map(len, found)) - len(np.unique(np.concatenate(found)))
    docs = documents(spark, rows).select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("key"), "text").repartition(9)
    seen = []
    for chars in (substring_dedup.BUCKET_CHARS, 1_000, 100):
        monkeypatch.setattr(substring_dedup, "BUCKET_CHARS", chars)
        seen.append(sorted(map(tuple, substring_dedup.late_windows(docs, 10).collect())))
    assert [len(late) for late in seen] == [want] * 3
    assert seen[0] == seen[1] == seen[2] and len(set(seen[0])) == want


# n-gram Jaccard join


def plain_components(rows):
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set()))
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        least[root(i)].append(doc_id)
    return [(doc_id, len(sets[i]), min(least[root(i)])) for i, (doc_id, _) in enumerate(rows)]


def test_signatures_lose_no_pair():
    random = np.random.default_rng(13)
    bands = shingle_join.Bands()
    for _ in range(3000):
        size = int(random.choice([1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 16, 25, 40, 90]))
        a = random.integers(0, 2**64, size, dtype=np.uint64)
        out, more = int(random.integers(0, size // 4 + 1)), int(random.integers(0, size // 3 + 1))
        b = np.concatenate([a[out:], random.integers(0, 2**64, more, dtype=np.uint64)])
        a, b = np.unique(a), np.unique(b)
        if shingle_join.similar(a, b):
            weight = lambda s: (s % np.uint64(3)).astype(np.uint8)
            assert len(np.intersect1d(shingle_join.signatures(a, weight(a), bands), shingle_join.signatures(b, weight(b), bands)))


@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_chains_and_copies(spark, seed):
    random = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(3000)]
    rows, number = [], 0
    common = [str(w) for w in random.choice(words, 40)]
    for _ in range(25):
        text = [str(w) for w in random.choice(words, int(random.integers(3, 120)))]
        if random.random() < 0.5:
            text += common
        for _ in range(int(random.integers(1, 9))):
            number += 1
            rows.append((number, " ".join(text)))
            if len(text) > 10 and random.random() < 0.8:  # drifts away step by step
                text[int(random.integers(len(text)))] = "edit%d" % number
    random.shuffle(rows)
    rows = [(int(i), t) for i, t in rows]
    got = shingle_join.near_components(documents(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(plain_components(rows))


def test_open_pairs_of_all_widths_in_blocks(spark, monkeypatch):
    """Parities of sizes on both sides of a power of two, dealt into blocks of about four."""
    monkeypatch.setattr(shingle_join, "BLOCK", 4)
    random = np.random.default_rng(5)
    whole = np.unique(random.integers(0, 2**63, 300).astype(np.uint64))
    sets = [random.permutation(whole[:150])[:size] for size in [*range(58, 70), *range(118, 138)]]
    sets += [np.concatenate([whole[:size], random.integers(0, 2**63, 3).astype(np.uint64)]) for size in [*range(58, 70), *range(118, 138)]]
    sets = {int(c): np.unique(s) for c, s in zip(random.permutation(len(sets)), sets)}
    rows = [(1, c, c, len(s), bytearray(shingle_join.parity(s).tobytes()), bytearray(s.tobytes())) for c, s in sets.items()]
    members = spark.createDataFrame(rows, "lead long, cls long, comp long, n long, odd binary, shingles binary")
    for num, den in ((75, 100), (20, 100)):  # the second lets widths differ by a factor of four
        close, links = set(), []
        for a, b in itertools.combinations(sorted(sets), 2):
            small, large = sorted((len(sets[a]), len(sets[b])))
            odd = [shingle_join.parity(sets[c]) for c in (a, b)]
            if small * den >= large * num and shingle_join.may_be_similar(odd[0], len(sets[a]), odd[1], len(sets[b]), num, den):
                close.add((a, b))
            if shingle_join.similar(sets[a], sets[b], num, den):
                links.append((a, b))
        assert sum(shingle_join.parity(sets[a]).size != shingle_join.parity(sets[b]).size for a, b in close) > 20
        flagged = shingle_join._flagged(members.drop("shingles"), num, den)
        assert {tuple(r) for r in flagged.collect()} == {(1, c) for pair in close for c in pair}
        found = [tuple(r) for r in shingle_join._forest(members.drop("odd"), num, den).collect()]
        assert set(found) <= set(links) and joined(found) == joined(links)


def joined(links):
    """Least member reachable from each."""
    least = {c: c for pair in links for c in pair}
    for _ in least:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    return least


def test_components_awkward(spark):
    rows = [r[:2] for r in AWKWARD if r[0] is not None]
    got = shingle_join.near_components(documents(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(plain_components(rows))
    assert shingle_join.near_components(documents(spark, [])).collect() == []
    none = shingle_join.near_components(documents(spark, [(None, "one two three four five six"), (7, "one two three four five six"), (None, None)])).collect()
    assert sorted((r.component_id is None, r.component_id or 0) for r in none) == [(False, 7), (False, 7), (True, 0)]


def test_components_of_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = QUERIES["op10_ngram_jaccard"](spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted(plain_components(rows))


# quality


def test_quality(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op4_quality"](spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    both = got.join(labels, "doc_id").toPandas()
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    rank = lambda s, y: np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]])
    assert rank(both.quality_score.values, both.quality.values) > 0.9
    assert rank(both.toxic_score.values, both.toxic.values) > 0.85


def test_quality_generalises(spark):
    """Fitted without every third labelled document, the scores still rank those."""
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    pages = spark.read.parquet(f"{sf}/pages.parquet").select(F.col("page_id").alias("doc_id"), "url")
    models = quality.fit(docs, labels.filter("doc_id % 3 <> 0"), pages)
    held = quality.score(docs.filter("doc_id % 3 = 0"), pages, models).join(labels, "doc_id").toPandas()
    rank = lambda s, y: np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]])
    assert rank(held.quality_score.values, held.quality.values) > 0.9
    assert rank(held.toxic_score.values, held.toxic.values) > 0.9


def test_quality_awkward(spark):
    docs = documents(spark, AWKWARD)
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 1), (5, 1, 1), (None, 1, 0), (6, None, 0)], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([(4, "http://a.example/x?y"), (4, None), (None, "z")], "doc_id long, url string")
    models = quality.fit(docs, labels, pages)
    got = quality.score(docs, pages, models).collect()
    assert len(got) == len(AWKWARD) and all(0 <= r.quality_score <= 1 and 0 <= r.toxic_score <= 1 for r in got)
    none = quality.fit(docs.limit(0), labels, pages)
    assert quality.score(docs.limit(0), pages, none).collect() == []
