"""Small tables with the awkward rows every operator must take."""

from pyspark.sql import types as T

# names that operators use inside, as extra columns
CLASH = ["block", "hash", "shard", "kind", "rank", "size", "bucket", "cls", "n", "a", "b", "largest", "copies", "spans", "doc", "at"]
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("text", "lang", "source")], T.StructField("n_chars", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in CLASH]
)


def documents(spark, rows):
    """rows: (doc_id, text[, lang[, source]])."""
    full = []
    for r in rows:
        doc_id, text, lang, source = (*r, *[None] * (4 - len(r)))
        full.append((doc_id, text, lang, source, len(text) if text is not None else None, *["x"] * len(CLASH)))
    return spark.createDataFrame(full, SCHEMA)


LINE = "This very line stands in many of the documents of this little table."
AWKWARD = [
    (1, None, None, None),
    (2, "", "en", "s1"),
    (3, "   \n\t\n", "en", None),
    (4, "Word", "en", "s2"),
    (5, f"{LINE}\nand more of the text\n  {LINE.upper()}\t", "en", "s1"),
    (6, f"{LINE}\nother words", "en", "s1"),
    (7, LINE, "de", "s2"),
    (8, f"{LINE}\n{LINE}", "de", "s2"),
    (9, f"a\n{LINE}\nb", None, "s3"),
    (9, f"a\n{LINE}\nb", None, "s3"),
    (None, f"no id\n{LINE}", "fr", "s3"),
    (10, "word " * 30_000, "en", "s1"),
    (11, "x" * 200_000, "en", "s1"),
    (12, "àéîõü ßß 漢字かな жук \U0001f600 é​ end", "fr", "s4"),
    (13, "12 34 -- 56 !! ??", "en", "s4"),
]
