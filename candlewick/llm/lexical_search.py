"""Ranked lexical search by a hybrid of term-at-a-time and document-at-a-time.

Documents are cut into shards of bounded numbers of postings.  For an item and a
shard, the short posting lists are summed at once into accumulators, which from
then on are one list with a bound of its own.  That list and the long ones are
walked in document order, block by block: a block whose bounds add up to less
than the score needed is passed over, in the others only documents of the lists
that could reach it are scored, and the weaker lists are probed for those alone.

A term's weight depends on the whole corpus, so postings are written first, and
weights are made from their lengths.  Only terms that an item may ask for get
postings: a bitmap of fixed size, however many items there are, tells which.
"""

from __future__ import annotations

import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candlewick.llm.common import map_rows, staged, table, width

TOP = 50
CHUNK_POSTINGS, CHUNK_DOCS = 1 << 20, 1 << 16
SLOT_POSTINGS = 1 << 21  # postings that a task searches at once, on average
FILTER_BITS = 24
BLOCK = 512  # documents of a block in the walk
SHORT_SHARE = 32  # lists of at most one in so many documents are short
CACHE = 1 << 20
# what is no term: ASCII but for digits and letters; A-Z are lowered
_CODES = bytes(c if c >= 0x80 else c + 32 if 65 <= c <= 90 else c if chr(c).isalnum() else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_CODES).split(b" ") if text else []


def counted(text: str | None) -> Counter:
    counts = Counter(terms_of(text))
    del counts[b""]
    return counts


def _position(term: bytes) -> int:
    return zlib.crc32(term) & ((1 << FILTER_BITS) - 1)


def asked_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, at): the distinct terms of each item; rows of equal item_id are one item."""

    def rows(stream):
        for item_id, text in stream:
            for term in counted(text):
                yield item_id, term, _position(term)

    return map_rows(items.select(F.col("item_id").cast("long").alias("item_id"), "text"), rows, "item_id long, term binary, at int").distinct()


def bitmap(asked: DataFrame) -> np.ndarray:
    """One bit per residue of a term's hash, 2 MB whatever the number of items."""
    bit = F.expr("shiftleft(1L, at & 63)")
    held = asked.select(F.shiftright("at", 6).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # 4 MB at most
    bits = np.zeros((1 << FILTER_BITS) // 64, np.int64)
    bits[held.column("word").to_numpy()] = held.column("bits").to_numpy()
    return bits


POSTINGS = "chunk long, term binary, n long, docs binary, counts binary, n_docs long, n_terms long"


def postings(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """Chunks of documents.  A chunk has a row per term (ordinals of its documents and occurrences there) and a row
    without term: ids and lengths of the documents by ordinal, ascending ids, and the sums over all documents read."""
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def rows(stream):
        wanted: dict[bytes, bool] = {}
        lists: dict[bytes, tuple[array, array]] = {}
        ids: list[int | None] = []
        lengths, part, held = array("q"), -1, 0
        n_docs = n_terms = number = 0
        bitmap = sent.value.view(np.uint64)

        def flush():
            # NULL ids rank last; equal ids stay in the order read
            order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, i))
            place = np.empty(len(ids), np.uint32)
            place[order] = np.arange(len(ids), dtype=np.uint32)
            chunk = part << 31 | number
            last = (1 << 63) - 1
            own = np.array([last if ids[i] is None else ids[i] for i in order], np.int64)
            yield chunk, None, held, own.tobytes(), np.frombuffer(lengths, np.int64)[order].tobytes(), n_docs, n_terms
            for term, (at, tf) in lists.items():
                at, tf = place[np.frombuffer(at, np.uint32)], np.frombuffer(tf, np.uint32)
                by = np.argsort(at)
                yield chunk, term, len(at), at[by].tobytes(), tf[by].tobytes(), None, None

        for doc_id, text, part in stream:
            words = counted(text)
            if not words:
                continue
            n = words.total()
            n_docs, n_terms, mine = n_docs + 1, n_terms + n, len(ids)
            for term, tf in words.items():
                asked = wanted.get(term)
                if asked is None:
                    if len(wanted) >= CACHE:
                        wanted.clear()
                    at = _position(term)
                    asked = wanted[term] = bool(int(bitmap[at >> 6]) >> (at & 63) & 1)
                if asked:
                    found = lists.get(term)
                    if found is None:
                        found = lists[term] = (array("I"), array("I"))
                    found[0].append(mine)
                    found[1].append(tf)
                    held += 1
                    if len(ids) == mine:
                        ids.append(doc_id)
                        lengths.append(n)
            if held >= CHUNK_POSTINGS or len(ids) >= CHUNK_DOCS:
                yield from flush()
                lists, ids, lengths, held, n_docs, n_terms, number = {}, [], array("q"), 0, 0, 0, number + 1
        if n_docs:
            yield from flush()

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.spark_partition_id().cast("long").alias("part"))
    return map_rows(read, rows, POSTINGS)


class Walk:
    """A list of ordinals and scores, in ascending order, with its greatest score in every block."""

    def __init__(self, docs: np.ndarray, scores: np.ndarray, blocks: int):
        self.docs, self.scores = docs, scores
        self.edges = np.searchsorted(docs, np.arange(blocks + 1) * BLOCK)
        self.most = np.zeros(blocks, np.int64)
        full = np.flatnonzero(self.edges[1:] > self.edges[:-1])
        if len(full):
            self.most[full] = np.maximum.reduceat(scores, self.edges[full])


class Shard:
    """The postings of a chunk, searched for one item after the other."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, total_docs: int, total_terms: int):
        self.ids, self.blocks = ids, -(-len(ids) // BLOCK)
        self.norm = 20 * (100 - 50 + (50 * lengths * total_docs) // total_terms)
        self.raw: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        self.lists: dict[bytes, Walk] = {}

    def add(self, term: bytes, docs: np.ndarray, counts: np.ndarray) -> None:
        self.raw[term] = docs, counts

    def _list(self, term: bytes, weight: int) -> Walk:
        if term not in self.lists:
            docs, counts = self.raw[term]
            docs, counts = docs.astype(np.int64), counts.astype(np.int64)
            self.lists[term] = Walk(docs, weight * ((1_000_000_000 * counts) // (1000 * counts + self.norm[docs])), self.blocks)
        return self.lists[term]

    def accumulated(self, short: list[Walk]) -> Walk:
        """The short lists summed per document, term at a time."""
        docs = np.concatenate([x.docs for x in short])
        by = np.argsort(docs, kind="stable")
        docs, scores = docs[by], np.concatenate([x.scores for x in short])[by]
        start = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]]))
        return Walk(docs[start], np.add.reduceat(scores, start), self.blocks)

    def search(self, terms: list[tuple[bytes, int]], top: int = TOP) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the best documents with a score above 0, best first, equal scores by ascending ordinal."""
        lists = [self._list(t, w) for t, w in terms if w > 0 and t in self.raw]
        short = [x for x in lists if len(x.docs) * SHORT_SHARE <= len(self.ids)]
        walks, least = [x for x in lists if len(x.docs) * SHORT_SHARE > len(self.ids)], 1
        if short:
            sums = self.accumulated(short)
            walks.append(sums)
            if len(sums.scores) >= top:  # so many documents have this score at least
                least = max(least, int(np.partition(sums.scores, -top)[-top]))
        best, found = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not walks:
            return self.ids[found], best
        bounds = np.array([x.most for x in walks])
        total = bounds.sum(axis=0)
        for block in np.flatnonzero(total >= least):
            if total[block] < least:  # more is needed by now
                continue
            docs, scores = self._block(int(block), [walks[i] for i in np.argsort(-bounds[:, block], kind="stable")], least)
            if len(docs):
                best, found = np.concatenate([best, scores]), np.concatenate([found, docs])
                keep = np.lexsort((found, -best))[:top]
                best, found = best[keep], found[keep]
                if len(best) == top:  # later documents lose ties
                    least = max(least, int(best[-1]) + 1)
        return self.ids[found], best

    @staticmethod
    def _block(block: int, walks: list[Walk], least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents of a block with ``least`` or more.  ``walks`` by falling bound."""
        left = np.cumsum([x.most[block] for x in walks][::-1])[::-1]  # what a list and those behind it can add
        scores, met = np.zeros(BLOCK, np.int64), np.zeros(BLOCK, bool)
        candidates = None
        for x, bound in zip(walks, left):
            a, b = x.edges[block], x.edges[block + 1]
            if bound >= least and candidates is None:
                at = x.docs[a:b] - block * BLOCK
                scores[at] += x.scores[a:b]
                met[at] = True
                continue
            # a document only in this and weaker lists falls short: those met so far are all there are
            candidates = np.flatnonzero(met) if candidates is None else candidates
            candidates = candidates[scores[candidates] + bound >= least]
            if not len(candidates) or not bound:
                break
            if a < b:
                own = candidates + block * BLOCK
                at = np.minimum(a + np.searchsorted(x.docs[a:b], own), b - 1)
                hit = x.docs[at] == own
                scores[candidates[hit]] += x.scores[at[hit]]
        candidates = np.flatnonzero(met) if candidates is None else candidates
        candidates = candidates[scores[candidates] >= least]
        return candidates + block * BLOCK, scores[candidates]


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` best documents of every item, equal scores by ascending doc_id.

    ``docs`` has doc_id and text, ``items`` item_id and text; other columns are ignored.  Every row of ``docs`` is a
    document, also where ids or texts repeat; a NULL id ranks behind all others.  Rows of equal item_id (NULL
    included) are one item with the terms of all of them.  NULL and empty texts have no terms: such documents do not
    count, such items have no rows.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    asked = staged(asked_terms(items))
    index = staged(postings(docs, bitmap(asked)))
    sums = index.agg(F.sum("n_docs"), F.sum("n_terms"), F.sum(F.when(F.col("term").isNull(), F.col("n")))).first()
    total_docs, total_terms, held = (int(x or 0) for x in sums)
    lengths = index.filter("term IS NOT NULL").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log((F.lit(2.0 * total_docs) + 2) / (2 * F.col("df") + 1))).cast("long")
    weighed = asked.join(lengths, "term").select("item_id", F.struct("term", weight.alias("w")).alias("term"))
    whole = weighed.groupBy("item_id").agg(F.collect_list("term").alias("terms"))
    # every slot of chunks meets the stated items
    slots = max(width(spark), -(-held // SLOT_POSTINGS))
    none = lambda kind: F.lit(None).cast(kind)
    chunks = index.select(
        F.pmod(F.xxhash64("chunk"), F.lit(slots)).alias("slot"), F.when(F.col("term").isNull(), 0).otherwise(1).alias("kind"), "chunk", "term", "docs", "counts",
        none("long").alias("item_id"), none("array<struct<term: binary, w: bigint>>").alias("terms"),
    )
    asking = whole.select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))).alias("slot"), F.lit(2).alias("kind"), none("long").alias("chunk"), none("binary").alias("term"),
        none("binary").alias("docs"), none("binary").alias("counts"), "item_id", "terms",
    )
    both = chunks.unionByName(asking).repartition(slots, "slot").sortWithinPartitions("slot", "kind", "chunk")

    def rows(stream) -> Iterator[tuple]:
        at, shards = None, {}
        for slot, kind, chunk, term, docs, counts, item_id, terms in stream:
            if slot != at:
                at, shards = slot, {}
            if kind == 0:
                shards[chunk] = Shard(np.frombuffer(docs, np.int64), np.frombuffer(counts, np.int64), total_docs, total_terms)
            elif kind == 1:
                shards[chunk].add(term, np.frombuffer(docs, np.uint32), np.frombuffer(counts, np.uint32))
            else:
                asked = [(x["term"], x["w"]) for x in terms]
                for shard in shards.values():
                    ids, scores = shard.search(asked, top)
                    for doc_id, score in zip(ids.tolist(), scores.tolist()):
                        yield item_id, doc_id, score

    found = map_rows(both, rows, "item_id long, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc()))
    best = found.withColumn("rank", rank).filter(F.col("rank") <= top)
    unknown = F.lit((1 << 63) - 1)
    return best.select("item_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("doc_id") != unknown, F.col("doc_id")).alias("doc_id"), "score")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH terms AS (
    SELECT doc_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM documents
), counts AS (SELECT doc_id, text, term, count(*) AS tf FROM terms GROUP BY ALL
), lengths AS (SELECT doc_id, text, sum(tf)::BIGINT AS n FROM counts GROUP BY ALL
), totals AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM lengths
), asked AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark
), weights AS (
    SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM counts, totals GROUP BY term, big_n
), scored AS (
    SELECT item_id, doc_id, text, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * big_n) // big_l)))))::BIGINT AS score
    FROM asked JOIN weights USING (term) JOIN counts USING (term) JOIN lengths USING (doc_id, text), totals
    GROUP BY item_id, doc_id, text
), ranks AS (
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranks WHERE rank <= 50
"""
