"""The pipeline against a plain version of its stages."""

from collections import Counter, defaultdict

import numpy as np
from cases import AWKWARD, LINE, documents
from test_set_operators import plain_components, plain_targets
from test_text_operators import plain_lines

import corpus_pipeline
from candlewick.llm import packing

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus(seed=3):
    random = np.random.default_rng(seed)
    vocabulary = {lang: ["".join(random.choice(list(letters), 5)) for _ in range(300)] for lang, letters in (("en", "abcdefgh"), ("de", "rstuvwxyz"))}
    rows = []
    for i in range(100, 180):
        lang = "en" if i % 3 else "de"
        words = [str(w) for w in random.choice(vocabulary[lang], int(random.integers(8, 90)))]
        text = " ".join(words)
        if i % 5 == 0:
            text += "\n" + LINE
        rows.append((i, text, lang, f"src{i % 4}"))
        if i % 7 == 0:
            rows.append((i + 1000, text, lang, "src0"))  # exact copy
        if i % 11 == 0:
            rows.append((i + 2000, text + " tail", lang, None))  # near copy
    return rows + [(500, "123 !!", "en", "src1"), (501, None, "en", "src1")]


def test_stages(spark, tmp_path):
    rows = corpus()
    documents(spark, rows).select(COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, str(tmp_path)).cache()
        kept[name] = docs.collect()
        if name != "packing":
            assert docs.columns == COLUMNS, name
    assert sorted(r.doc_id for r in kept["language_id"]) == sorted(r[0] for r in rows if r[0] not in (500, 501))
    assert all(r.lang == ("en" if r.doc_id % 1000 % 3 else "de") for r in kept["language_id"] if r.doc_id < 1000)
    lines = plain_lines([(r.doc_id, r.text) for r in kept["language_id"]])
    assert sorted((r.doc_id, r.text, r.n_chars) for r in kept["line_dedup"]) == sorted((i, t, len(t)) for i, t, _, _ in lines)
    components = plain_components([(r.doc_id, r.text) for r in kept["line_dedup"]])
    assert sorted(r.doc_id for r in kept["ngram_jaccard"]) == sorted(i for i, _, c in components if i == c)
    sizes, taken = defaultdict(int), defaultdict(int)
    words = {r.doc_id: len((r.text or "").split()) for r in kept["ngram_jaccard"]}
    for r in kept["ngram_jaccard"]:
        sizes[r.source] += words[r.doc_id]
    for r in kept["mixing"]:
        taken[r.source] += words[r.doc_id]
    assert max(Counter(r.doc_id for r in kept["mixing"]).values()) <= 2
    for source, target in plain_targets(dict(sizes)).items():
        assert abs(taken[source] - target) <= 0.05 * target + 20
    encode, want = packing.encoder(), Counter()
    for r in kept["mixing"]:
        want[(r.doc_id, len(encode(r.text)) + 1)] += 1
    assert Counter((r.doc_id, r.doc_tokens) for r in kept["packing"] if r.start == 0) == want


def test_awkward_rows_and_empty_tables(spark):
    for rows in (AWKWARD, []):
        docs = documents(spark, rows)
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, "")
            assert docs.count() >= 0, name


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
