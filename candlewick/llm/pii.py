"""Personal data with exact source offsets, plain or disguised.

Plain identifiers are found by the four base patterns.  For disguised ones, places
that look disguised (homoglyphs, foreign digits, invisible characters, spelled
digits, "at"/"dot" wording) are cut out as windows.  Small transducers rewrite a
window and remember the source interval of every character they write; the base
patterns run over the rewritten text and the spans found are mapped back.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.llm.common import map_rows, table

KINDS = ["email", "ip", "card", "phone"]
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match can only begin where a run of digits begins, which keeps the search linear
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")

Span = tuple[int, int, int]  # start, kind number, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = 2 * d if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _octets(match: str) -> bool:
    return all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in match.split("."))


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that pass its test."""
    found: list[Span] = []
    if "@" in text:
        end = 0
        for m in DOMAIN.finditer(text):
            start = m.start()
            while start > end and text[start - 1] in LOCAL:
                start -= 1
            if start < m.start():
                end = m.end()
                found.append((start, 0, end))
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if _octets(m[0])]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


# Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {
    **dict(zip("аеорсухіјѕԁһԛԝАВЕКМНОРСТУХІЈЅ", "aeopcyxijsdhqwABEKMHOPCTYXIJS")),
    **dict(zip("οανικρυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "oavikpuxABEZHIKMNOPTYX")),
    **{chr(0xFF01 + i): chr(0x21 + i) for i in range(94)},
    **{chr(zero + d): str(d) for zero in (0x0660, 0x06F0, 0x0966, 0x09E6, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6) for d in range(10)},
    "\u207a": "+", "\ufe62": "+", "\ufe6b": "@", "\u2024": ".", "\u3002": ".", "\u2010": "-", "\u2011": "-", "\u2012": "-", "\u2013": "-", "\u2212": "-", "\u00a0": " ", "\u2009": " ",
}
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
DIGIT_WORDS = {
    word: str(d)
    for d, words in enumerate(
        ["zero null zéro cero", "one eins un uno", "two zwei deux dos", "three drei trois tres", "four vier quatre cuatro", "five fünf cinq cinco",
         "six sechs seis", "seven sieben sept siete", "eight acht huit ocho", "nine neun neuf nueve"]
    )
    for word in words.split()
}
_WORD = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_OPEN, _SHUT = r"[\[({<]", r"[\])}>]"
_AT, _DOT = "at|arroba|aroba|@", r"dot|punkt|punto|point|\."
_GAP = r"[ \t]{0,3}"
_TOP = r"(?:\.[\w-]{1,64}){0,8}\.[a-z]{2,24}\b"
#: places worth rewriting, apart from homoglyphs
CLUE = re.compile(
    rf"{_OPEN}{_GAP}(?:{_AT}|{_DOT}){_GAP}{_SHUT}|(?<=\w)[ \t]{{1,3}}dot[ \t]{{1,3}}(?=\w)|(?<=\w)[ \t]{{1,3}}at[ \t]{{1,3}}[\w-]{{1,64}}{_TOP}"
    rf"|\b(?:{_WORD})[\W_]{{1,3}}(?:(?:{_WORD})\b|[0-9+])|[0-9+][\W_]{{0,3}}\b(?:{_WORD})\b|\bplus[ \t]{{1,3}}(?:(?:{_WORD})\b|[0-9])", re.IGNORECASE
)
GLYPH = re.compile("[" + re.escape("".join(HOMOGLYPHS) + INVISIBLE) + "]+")
MARGIN = 96
BLANK = re.compile(r"[ \t\n\x0b\x0c\r]")
#: one transducer step: what is rewritten, in order of preference
STEP = re.compile(
    rf"(?P<at>{_GAP}{_OPEN}{_GAP}(?:{_AT}){_GAP}{_SHUT}{_GAP}|(?<=\w)[ \t]{{1,3}}at[ \t]{{1,3}}(?=[\w-]+(?:[ \t]{{1,3}}dot[ \t]|{_GAP}{_OPEN}{_GAP}(?:{_DOT})|{_TOP})))"
    rf"|(?P<dot>{_GAP}{_OPEN}{_GAP}(?:{_DOT}){_GAP}{_SHUT}{_GAP}|(?<=\w)[ \t]{{1,3}}dot[ \t]{{1,3}}(?=\w))"
    rf"|(?P<plus>\bplus[ \t]{{1,3}}(?=(?:{_WORD}|[0-9])\b))"
    rf"|(?P<digit>\b(?:{_WORD})\b)(?P<gap>[ \t\n,-]{{1,3}}(?=(?:{_WORD}|[0-9])\b))?"
    rf"|(?P<glyph>[{re.escape(''.join(HOMOGLYPHS))}])|(?P<none>[{INVISIBLE}]+)",
    re.IGNORECASE,
)


def normalise(text: str, start: int, end: int) -> tuple[str, list[int], list[int], list[bool]]:
    """Rewritten window; per written character its source interval and whether it was rewritten."""
    # first the glyphs, since disguised wording may itself hold them; one character each, so offsets stay
    plain = "".join(HOMOGLYPHS.get(c, c) for c in text[start:end])
    out, begins, ends, changed = [], [], [], []
    at = 0

    def copy(upto: int) -> None:
        for i in range(at, upto):
            out.append(plain[i])
            begins.append(start + i)
            ends.append(start + i + 1)
            changed.append(plain[i] != text[start + i])

    for m in STEP.finditer(plain):
        kind = m.lastgroup if m.lastgroup != "gap" else "digit"
        new = {"at": "@", "dot": ".", "plus": "+", "none": ""}.get(kind)
        if kind == "digit":
            new = DIGIT_WORDS.get(m["digit"].lower())
        if new is None:  # a glyph that maps to itself
            continue
        copy(m.start())
        if new:
            # digit words keep their own extent; the gap behind them is dropped
            stop = m.end("digit") if kind == "digit" else m.end()
            out.append(new)
            begins.append(start + m.start())
            ends.append(start + stop)
            changed.append(True)
        elif out:
            changed[-1] = True
        at = m.end()
    copy(len(plain))
    return "".join(out), begins, ends, changed


def windows(text: str) -> Iterator[tuple[int, int]]:
    """Merged surroundings of all clues; linear in the text."""
    spots = [m.span() for m in CLUE.finditer(text)]
    if not text.isascii():
        spots = sorted(spots + [m.span() for m in GLYPH.finditer(text)])
    blanks = [m.start() for m in BLANK.finditer(text)] if spots else []
    open_at = None
    for a, b in spots:
        # as far as the tokens that the margin would cut
        a, b = bisect_right(blanks, a - MARGIN), bisect_left(blanks, b + MARGIN)
        a, b = blanks[a - 1] + 1 if a else 0, blanks[b] if b < len(blanks) else len(text)
        if open_at is None:
            open_at = [a, b]
        elif a <= open_at[1]:
            open_at[1] = max(open_at[1], b)
        else:
            yield tuple(open_at)
            open_at = [a, b]
    if open_at:
        yield tuple(open_at)


def disguised_spans(text: str, plain: list[Span]) -> list[Span]:
    """Spans that only show after rewriting; those inside a plain span of their kind are left out."""
    found = set()
    for start, end in windows(text):
        new, begins, ends, changed = normalise(text, start, end)
        for a, kind, b in base_spans(new):
            if any(changed[a:b]):
                span = (begins[a], kind, ends[b - 1])
                if not any(k == kind and s <= span[0] and span[2] <= e for s, k, e in plain):
                    found.add(span)
    return sorted(found)


def pii_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) with spans array<struct<kind, start, end, base, value>> by start, then kind.

    Offsets are code points, ends exclusive.  ``base`` tells plain from disguised.  A
    NULL or empty text has no spans; repeated rows and NULL ids give a row each; other
    columns are ignored.
    """

    def rows(stream):
        for doc_id, text in stream:
            plain = base_spans(text)
            every = [(s, k, e, True) for s, k, e in plain] + [(s, k, e, False) for s, k, e in disguised_spans(text, plain)]
            yield doc_id, [{"kind": KINDS[k], "start": s, "end": e, "base": b, "value": text[s:e]} for s, k, e, b in sorted(every)]

    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return map_rows(texts, rows, "doc_id long, spans array<struct<kind: string, start: int, end: int, base: boolean, value: string>>")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    plain = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(plain, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return pii_spans(table(spark, sf_dir, "documents")).select(
        "doc_id", *map(count, KINDS), F.sha2(listed(plain).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans")
    )
