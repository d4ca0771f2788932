"""Line dedup, PII, fingerprints and language id against plain versions."""

import hashlib
import itertools
import re
from collections import defaultdict

import numpy as np
import pytest
from cases import AWKWARD, LINE, documents

import __spark_entry__ as entry
from candlewick.llm import fingerprint, langid, line_dedup, pii
from candlewick.llm.queries import ORACLE, QUERIES
from oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, name):
    problems, rows, _, _ = compare(spark, name, QUERIES[name], ORACLE[name], SF)
    assert not problems and rows > 0


def test_registered():
    assert {f"op{i}_" for i in range(1, 14)} == {re.match(r"op\d+_", n)[0] for n in QUERIES}
    assert "pipeline" in entry.queries() and set(QUERIES) <= set(entry.queries())


# line dedup


def plain_lines(rows):
    holders, blanks = defaultdict(list), " \t\n\x0b\x0c\r"
    key = lambda line: line.strip(blanks).translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)}))
    for doc_id, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= 40:
                holders[k].append(doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = []
        for x in lines:
            ids = holders.get(key(x), [])
            known = [i for i in ids if i is not None]
            if len(ids) < 5 or not known or doc_id == max(known):
                kept.append(x)
        out.append((doc_id, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def test_line_dedup_awkward(spark):
    rows = [r[:2] for r in AWKWARD]
    got = line_dedup.shared_line_drop(documents(spark, AWKWARD), shard_keys=1).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain_lines(rows)))
    assert sum(r.n_dropped for r in got) == 7
    assert line_dedup.shared_line_drop(documents(spark, [])).collect() == []
    alone = [(None, LINE)] * 6
    assert [r.n_dropped for r in line_dedup.shared_line_drop(documents(spark, alone)).collect()] == [0] * 6


def test_perfect_hash_is_minimal_and_guarded():
    keys = np.random.default_rng(1).integers(0, 2**64, 20_000, dtype=np.uint64)
    phf = line_dedup.PerfectHash.build(keys)
    assert sorted(phf.index(keys)) == list(range(len(np.unique(keys))))
    shard = line_dedup.Shard(line_dedup.pack_shard(keys, np.arange(len(keys)), np.arange(len(keys)) * 3))
    count, largest = shard.probe(keys)
    assert (count == np.arange(len(keys))).all() and (largest == 3 * count).all()
    other = np.random.default_rng(2).integers(0, 2**64, 20_000, dtype=np.uint64)
    assert (shard.probe(other)[0] > 0).sum() <= 2
    assert len(line_dedup.PerfectHash.build(np.zeros(0, np.uint64)).index(keys[:3])) == 3


# PII


def plain_pii(text):
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    out = []
    for k, (kind, pattern) in enumerate(patterns.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            doubled = [2 * int(d) if i % 2 else int(d) for i, d in enumerate(reversed(digits))]
            fine = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else None,
                "card": 14 <= len(digits) <= 19 and sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0,
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if fine:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_pii_base_equals_plain_patterns():
    random = np.random.default_rng(3)
    letters = list("a.@b-%1234567890 +()\n4ü") + ["4111 1111 1111 1111", "1.2.3.4", "x@y.zz", "+1 (743) 555-3824", "@a.b@c.d", "256.1.1.1.1.1.1"]
    for _ in range(4000):
        text = "".join(random.choice(letters, random.integers(0, 40)))
        assert pii.base_spans(text) == plain_pii(text), text


@pytest.mark.parametrize(
    "text, kind, value",
    [
        ("write to jоhn@exаmple.com now", "email", "jоhn@exаmple.com"),
        ("write to john [at] example [dot] com now", "email", "john [at] example [dot] com"),
        ("write to john.doe (AT) example dot co dot uk.", "email", "john.doe (AT) example dot co dot uk"),
        ("mail john at example dot org today", "email", "john at example dot org"),
        ("call plus one two one two five five five zero one two three now", "phone", "plus one two one two five five five zero one two three"),
        ("card four one one one 1111 1111 one one one one ok", "card", "four one one one 1111 1111 one one one one"),
        ("host ten: １９２.168.0.1 up", "ip", "１９２.168.0.1"),
        ("host 10 dot 0 dot 0 dot 7 up", "ip", "10 dot 0 dot 0 dot 7"),
        ("mail jo​hn@exam​ple.com", "email", "jo​hn@exam​ple.com"),
    ],
)
def test_pii_disguised(text, kind, value):
    plain = pii.base_spans(text)
    found = pii.disguised_spans(text, plain)
    assert (kind, value) in [(pii.KINDS[k], text[a:b]) for a, k, b in found]
    assert all(0 <= a < b <= len(text) for a, _, b in found)


@pytest.mark.parametrize(
    "text, kind, value",
    [
        ("call +1 415 555 26 seven one now", "phone", "+1 415 555 26 seven one"),
        ("call +1 415 555 two six 71 now", "phone", "+1 415 555 two six 71"),
        ("call plus 1 415 555 2671 now", "phone", "plus 1 415 555 2671"),
        ("mail name at firma.it today", "email", "name at firma.it"),
        ("mail " + "n" * 150 + " [at] firma.it today", "email", "n" * 150 + " [at] firma.it"),
    ],
)
def test_pii_disguises_at_any_clue(text, kind, value):
    found = pii.disguised_spans(text, pii.base_spans(text))
    assert (kind, value) in [(pii.KINDS[k], text[a:b]) for a, k, b in found]


def test_pii_leaves_prose_alone():
    for text in ("He looked at one or two dots at home. One, two, three!", "das ist ein Punkt. Naïve café – dot", "five six" * 3, ""):
        assert pii.disguised_spans(text, []) == []


def test_pii_awkward(spark):
    rows = [*AWKWARD, (20, "a@b.cc " * 20_000), (21, "1" * 50_000 + ".1.1.1"), (22, "one two " * 20_000)]
    got = pii.pii_spans(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r.spans for r in got}
    assert len(by_id[20]) == 20_000 and by_id[1] == [] and by_id[2] == []
    assert pii.pii_spans(documents(spark, [])).collect() == []


# fingerprints


def plain_phrases(text):
    seen, word = set(), ""
    for c in text:
        word += c
        if word not in seen:
            seen.add(word)
            word = ""
    return seen | ({word} if word else set())


def test_phrases_are_those_of_the_plain_parse():
    random = np.random.default_rng(5)
    for _ in range(300):
        text = "".join(random.choice(list("abcdé\U0001f600"), random.integers(0, 200)))
        cut = int(random.integers(0, len(text) + 1))
        phrases = fingerprint.Phrases()
        phrases.feed(text[:cut])
        phrases.trial("zzzabab" * 3)  # taken back
        ends = phrases.trial(text[cut:])
        got = [text[a:b] for a, b in zip([0, *ends[:-1]], ends)]
        assert set(got) == plain_phrases(text) and "".join(got) == text
        hashes = fingerprint.phrase_hashes(text, ends)
        assert len(set(hashes.tolist())) == len(set(got))
        assert len(fingerprint.signature(hashes)) == fingerprint.SLOTS


def test_fingerprints_awkward(spark):
    rows = [*AWKWARD, (30, "same text here"), (31, "same text here")]
    got = sorted(fingerprint.fingerprints(documents(spark, rows)).collect(), key=lambda r: (r.doc_id is not None, r.doc_id))
    assert len(got) == len(rows)
    ordered = sorted(((i, t or "") for i, t, *_ in rows), key=lambda r: (r[0] is not None, r[0]))  # equal ids have equal texts here
    for (_, text), (_, following), row in zip(ordered, ordered[1:] + ordered[:1], got):
        other = fingerprint.edited(text, following)
        mine, changed = fingerprint.fingerprint(text), fingerprint.fingerprint(other)
        assert row.edited_sha256 == hashlib.sha256(other.encode()).hexdigest()
        assert (row.fingerprint, row.edited_fingerprint) == (mine.hex(), changed.hex())
        assert row.near_edited == fingerprint.likeness(mine, changed) and row.near_next == fingerprint.likeness(mine, fingerprint.fingerprint(following))
    assert fingerprint.fingerprints(documents(spark, [])).collect() == []
    one = fingerprint.fingerprints(documents(spark, [(1, "abcdefgh")])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_fingerprints_tell_edits_from_other_documents(spark):
    got = QUERIES["op6_fingerprint"](spark, SF).toPandas()
    assert (got.near_edited > got.near_next).mean() > 0.97


# language id


def test_viterbi_is_optimal():
    random = np.random.default_rng(6)
    for n, k in [(1, 2), (5, 3), (7, 2), (6, 3)]:
        for _ in range(60):
            scores = random.normal(0, 2, (n, k))
            value = lambda path: sum(scores[i, x] for i, x in enumerate(path)) - 1.5 * sum(a != b for a, b in zip(path, path[1:]))  # noqa: E731, B023
            best = max(map(value, itertools.product(range(k), repeat=n)))
            assert abs(value(langid.viterbi(scores, 1.5).tolist()) - best) < 1e-9


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = QUERIES["op8_language_id"](spark, SF).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(got) == docs.count() and len(held) > 20
    assert (held.lang == held.lang_pred).mean() > 0.95
    assert got.score.between(0, 1).all()


def test_language_spans_and_awkward(spark):
    en = "the house and the garden with many of those things that people would like to see again "
    de = "der Hund und die Katze gehen mit einem anderen Tier durch den großen Wald nach Hause "
    ru = "это простой русский текст о том как люди живут в больших городах "
    model = langid.learn(documents(spark, [(i, t * 3, lang) for i, (t, lang) in enumerate([(en, "en"), (de, "de"), (ru, "ru")])] + [(9, None, "en"), (10, en, None)]))
    assert model.langs == ["de", "en", "ru"]
    rows = [*AWKWARD, (40, en * 2 + de * 2 + ru)]
    got = {r.doc_id: r for r in langid.predict(documents(spark, rows), model).collect()}
    mixed = got[40]
    assert [s.lang for s in mixed.spans] == ["en", "de", "ru"]
    assert abs(mixed.spans[1].start - 2 * len(en)) < 12 and mixed.spans[-1].end == len(rows[-1][1])
    for doc_id in (1, 2, 3, 13):
        assert got[doc_id].lang_pred == "und" and got[doc_id].score == 0 and got[doc_id].spans == []
    assert got[12].lang_pred in model.langs
    assert langid.predict(documents(spark, []), model).collect() == []
    empty = langid.learn(documents(spark, []))
    assert {r.lang_pred for r in langid.predict(documents(spark, AWKWARD), empty).collect()} == {"und"}
