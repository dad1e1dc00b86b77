"""Ranked lexical search: range-maximum tables over posting lists, best-first document intervals, summed maxima as bounds."""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

TOP = 10
#: Query terms that one pass over the documents looks for: items go in blocks of about so many, in order of their ids.
BLOCK_TERMS = 1 << 18
#: Documents (and postings) of which one index is made at a time.
SHARD, SHARD_POSTINGS = 8192, 1 << 21
#: Intervals of so few documents are scored as a whole, and so many intervals leave the queue at a time.
LEAF, WAVE = 24, 128

#: Bytes to term bytes: signs and white space part terms, A-Z are lowered. All bytes of characters beyond ASCII belong to terms.
_FOLD = bytes(b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))

HITS = "item_id long, doc_id long, score long"


def terms_of(text: bytes) -> list[bytes]:
    """The maximal stretches of letters and figures (all characters beyond ASCII count as such) of a UTF-8 text, A-Z lowered."""
    return text.translate(_FOLD).split()


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def counted(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """doc_id, n (terms in the document), terms (their numbers in the given list, ascending) and tfs; one row per document with at least one term."""
    numbers = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(terms)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = numbers.value
        for batch in batches:
            text = batch.column(1).cast(pa.binary())
            ids, ns, found, tfs = [], [], [], []
            for doc_id, one in zip(batch.column(0).to_pylist(), text, strict=True):
                words = terms_of(one.as_py() or b"")
                if words:
                    hits = sorted((known[w], c) for w, c in Counter(words).items() if w in known)
                    ids.append(doc_id)
                    ns.append(len(words))
                    found.append([t for t, _ in hits])
                    tfs.append([c for _, c in hits])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(found, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], names=["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<long>")


class Shard:
    """An index of some documents: posting lists with impacts, one after the other by term, and over them a sparse table of the places of range maxima.

    Documents are numbered by size, so that those of an interval have much the same norm.
    """

    def __init__(self, doc_ids: list, n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray, corpus: tuple[int, int], n_terms: int):
        count, length = corpus
        order = np.argsort(n, kind="stable")
        self.n, self.n_terms = len(n), n_terms
        self.doc_ids = [doc_ids[i] for i in order]
        starts = np.cumsum(sizes) - sizes
        sizes = sizes[order]
        # postings by document, then by term
        at = np.repeat(starts[order] - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(terms))
        self.doc_terms, tf = terms[at], tfs[at]
        self.ends = np.concatenate([[0], np.cumsum(sizes)])
        doc = np.repeat(np.arange(self.n), sizes)
        m = 25 + 75 * n[order] * count // length
        self.doc_impacts = 1_000_000_000 * tf // (1000 * tf + 8 * m[doc])
        by_term = np.argsort(self.doc_terms, kind="stable")
        self.docs, self.impacts = doc[by_term].astype(np.int32), self.doc_impacts[by_term]
        self.keys = self.doc_terms[by_term].astype(np.int64) * self.n + self.docs
        lists = np.bincount(self.doc_terms, minlength=n_terms)
        self.first = np.concatenate([[0], np.cumsum(lists)])
        # sparse table: level k holds the place of the largest impact of 2**k postings
        levels, size = int(lists.max(initial=1)).bit_length(), len(self.docs)
        self.best = np.zeros((levels, size), np.int32)
        self.best[0] = np.arange(size)
        for k in range(levels - 1):
            left, right = self.best[k, : size - (1 << k)], self.best[k, 1 << k :]
            self.best[k + 1, : len(left)] = np.where(self.impacts[right] > self.impacts[left], right, left)
        self.flat = self.best.ravel()

    def maxima(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Place of the largest impact of the postings lo to hi - 1, for each of many ranges, none of them empty."""
        level = np.frexp((hi - lo).astype(np.float64))[1].astype(np.int64) - 1
        row = level * len(self.docs)
        left, right = self.flat[row + lo], self.flat[row + hi - (1 << level)]
        return np.where(self.impacts[right] > self.impacts[left], right, left)

    def search(self, terms: np.ndarray, weights: np.ndarray, top: Top) -> tuple[int, int]:
        """Puts into top all documents that may be among its best. (documents scored, intervals made.)

        An interval of documents is bounded by the sum over the terms of weight times its largest impact in the interval. The intervals of
        largest bounds leave the queue first. Each is split at the document whose one contribution is the largest; that document is scored, and
        what lies left and right of it goes back. It ends when no bound reaches the top's last score.
        """
        held = self.first[terms + 1] > self.first[terms]
        terms, weights = terms[held], weights[held]
        if not len(terms):
            return 0, 0
        of_term = np.zeros(self.n_terms, np.int64)
        of_term[terms] = weights
        scored = made = 0
        # for each interval in the queue: (-bound, number, a, b, split, terms' numbers, lo, hi)
        queue: list[tuple] = []

        def push(a: np.ndarray, b: np.ndarray, owner: np.ndarray, term: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
            """Intervals a to b - 1; owner, term, lo, hi: their posting ranges that aren't empty, ordered by owner."""
            nonlocal made
            if not len(owner):
                return
            place = self.maxima(lo, hi)
            part = weights[term] * self.impacts[place]
            starts = np.concatenate([[0], np.nonzero(owner[1:] != owner[:-1])[0] + 1])
            stops = np.append(starts[1:], len(owner))
            bound, largest = np.add.reduceat(part, starts), np.maximum.reduceat(part, starts)
            where = np.nonzero(part == np.repeat(largest, stops - starts))[0]
            split = self.docs[place[where[np.searchsorted(where, starts)]]]
            least = top.least()
            for i in np.nonzero((bound >= least) & (bound > 0))[0].tolist():
                s, e, o = starts[i], stops[i], owner[starts[i]]
                heapq.heappush(queue, (-int(bound[i]), made, int(a[o]), int(b[o]), int(split[i]), term[s:e], lo[s:e], hi[s:e]))
                made += 1

        all_terms = np.arange(len(terms))
        push(np.array([0]), np.array([self.n]), np.zeros(len(terms), np.int64), all_terms, self.first[terms], self.first[terms + 1])
        while queue and -queue[0][0] >= top.least():
            wave = [heapq.heappop(queue) for _ in range(min(WAVE, len(queue)))]
            wave = [x for x in wave if -x[0] >= top.least()]
            small, large = [x for x in wave if x[3] - x[2] <= LEAF], [x for x in wave if x[3] - x[2] > LEAF]
            ranges = [(x[2], x[3]) for x in small] + [(x[4], x[4] + 1) for x in large]
            scored += self._score(ranges, of_term, top)
            if large:
                a, b, split = (np.array([x[i] for x in large]) for i in (2, 3, 4))
                sizes = [len(x[5]) for x in large]
                owner, term = np.repeat(np.arange(len(large)), sizes), np.concatenate([x[5] for x in large])
                lo, hi = np.concatenate([x[6] for x in large]), np.concatenate([x[7] for x in large])
                mid = np.searchsorted(self.keys, terms[term].astype(np.int64) * self.n + split[owner])
                past = mid + ((mid < hi) & (self.docs[np.minimum(mid, len(self.docs) - 1)] == split[owner]))
                left, right = lo < mid, past < hi
                two = [np.concatenate(x) for x in ((a, split + 1), (split, b), (owner[left], owner[right] + len(large)), (term[left], term[right]), (lo[left], past[right]), (mid[left], hi[right]))]
                push(*two)
        return scored, made

    def _score(self, ranges: list[tuple[int, int]], of_term: np.ndarray, top: Top) -> int:
        """Scores all documents of some ranges from their own postings."""
        docs = np.concatenate([np.arange(a, b) for a, b in ranges]) if len(ranges) > 1 else np.arange(*ranges[0])
        sizes = self.ends[docs + 1] - self.ends[docs]
        firsts = np.cumsum(sizes) - sizes
        at = np.repeat(self.ends[docs] - firsts, sizes) + np.arange(int(sizes.sum()))
        sums = np.concatenate([[0], np.cumsum(of_term[self.doc_terms[at]] * self.doc_impacts[at])])
        scores = sums[firsts + sizes] - sums[firsts]
        for i in np.nonzero((scores > 0) & (scores >= top.least()))[0].tolist():
            top.add(int(scores[i]), self.doc_ids[docs[i]])
        return len(docs)


class Top:
    """The best of the documents added so far: highest scores first, equal ones by ascending id, null ids last."""

    def __init__(self, most: int):
        self.most, self.heap = most, []

    def least(self) -> int:
        """Scores below it are not among the best."""
        return self.heap[0][0] if len(self.heap) == self.most else 1

    def add(self, score: int, doc_id: int | None) -> None:
        entry = (score, doc_id is not None, -(doc_id or 0))
        if len(self.heap) < self.most:
            heapq.heappush(self.heap, entry)
        elif entry > self.heap[0]:
            heapq.heapreplace(self.heap, entry)

    def rows(self) -> list[tuple[int | None, int]]:
        return [(-minus if there else None, score) for score, there, minus in self.heap]


def searched(index: DataFrame, items: list[tuple[int, list[int], list[int]]], corpus: tuple[int, int], n_terms: int, most: int, shard: int = SHARD) -> DataFrame:
    """HITS: for each task the best of its documents for each item (item_id, terms' numbers, weights times repeats)."""
    queries = index.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = [(i, np.array(t, np.int64), np.array(w, np.int64), Top(most)) for i, t, w in queries.value]
        parts: list[pa.RecordBatch] = []

        def index_and_search() -> None:
            ids = [x for p in parts for x in p.column(0).to_pylist()]
            n = np.concatenate([p.column(1).to_numpy() for p in parts])
            sizes = np.concatenate([p.column(2).value_lengths().to_numpy() for p in parts]).astype(np.int64)
            terms, tfs = (np.concatenate([p.column(c).flatten().to_numpy() for p in parts]) for c in (2, 3))
            there = Shard(ids, n, sizes, terms, tfs, corpus, n_terms)
            for _, t, w, top in wanted:
                there.search(t, w, top)
            parts.clear()

        rows = postings = 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                ends = np.cumsum(batch.column(2).slice(at).value_lengths().to_numpy())
                take = max(1, min(shard - rows, int(np.searchsorted(ends, SHARD_POSTINGS - postings, side="right")), len(ends)))
                parts.append(batch.slice(at, take))
                rows, postings, at = rows + take, postings + int(ends[take - 1]), at + take
                if rows >= shard or postings >= SHARD_POSTINGS or at < batch.num_rows:
                    index_and_search()
                    rows = postings = 0
        if parts:
            index_and_search()
        out = [(i, d, s) for i, _, _, top in wanted for d, s in top.rows()]
        cols = list(zip(*out, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["item_id", "doc_id", "score"])

    return index.select("doc_id", "n", "terms", "tfs").mapInArrow(run, HITS)


def _blocks(queries: DataFrame, most: int) -> Iterator[list[tuple[int, dict[bytes, int]]]]:
    """Items as (number, term counts), in blocks of about `most` terms; the driver holds one block at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [Counter(terms_of(x.as_py() or b"")) for x in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([list(c) for c in counts], pa.list_(pa.binary())), pa.array([list(c.values()) for c in counts], pa.list_(pa.int64()))], names=["item_id", "terms", "counts"])

    read = queries.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(run, "item_id long, terms array<binary>, counts array<long>")
    block, size = [], 0
    for r in stored(read, "items").orderBy("item_id").toLocalIterator():
        block.append((r["item_id"], {bytes(t): c for t, c in zip(r["terms"], r["counts"], strict=True)}))
        size += len(r["terms"])
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


def ranked_search(docs: DataFrame, queries: DataFrame, most: int = TOP, block_terms: int = BLOCK_TERMS, shard: int = SHARD) -> DataFrame:
    """item_id, rank, doc_id, score: the `most` highest-scoring documents of docs (doc_id, text) for each row of queries (item_id, text).

    One pass over the texts keeps, for each document, its number of terms and its counts of the queries' terms; partial aggregation
    gives the corpus statistics. The index is parted by documents, so postings are never shuffled: each task makes indexes of at most `shard`
    documents and searches them for all items, carrying each item's best scores from one index to the next, so that later ones are
    pruned by what earlier ones found. The tasks' answers, `most` rows per item and task, are ranked by a window. What
    is broadcast is a block of items with about block_terms terms; more items are searched in further blocks.

    Null text or text without terms: no document, and no hits for such an item. Null doc_ids rank after others of equal score; rows that
    repeat a doc_id are documents of their own. Rows that repeat an item_id are ranked as separate items, numbered apart only by their hits.
    Empty tables: no rows.
    """
    spark, out = docs.sparkSession, None
    for block in _blocks(queries, block_terms):
        terms = sorted({t for _, counts in block for t in counts})
        index = stored(counted(docs, terms), "counted", "zstd")
        total = index.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
        frequency = {r["term"]: r["df"] for r in index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).toLocalIterator()}
        w = {i: weight(total["n"], df) for i, df in frequency.items()}
        number = {t: i for i, t in enumerate(terms)}
        # an item's place in the block tells rows that repeat an item_id apart
        items = [(k, [number[t] for t in counts if number[t] in w], [c * w[number[t]] for t, c in counts.items() if number[t] in w]) for k, (_, counts) in enumerate(block)]
        hits = stored(searched(index, items, (total["n"], total["length"]), len(terms), most, shard), "hits")
        order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        best = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
        named = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(block)], "_item long, _id long")
        best = best.join(F.broadcast(named), F.col("item_id") == F.col("_item")).select(F.col("_id").alias("item_id"), "rank", "doc_id", "score")
        out = best if out is None else out.unionByName(best)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out


#: What DuckDB answers for ranked_search of benchmark in documents.
SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
c AS (SELECT count(*) AS n, sum(len(words))::BIGINT AS l FROM d WHERE len(words) > 0),
p AS (SELECT r, any_value(doc_id) AS doc_id, any_value(len(words)) AS n, term, count(*) AS tf FROM (SELECT r, doc_id, words, unnest(words) AS term FROM d) GROUP BY r, term),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
i AS (SELECT p.r, p.doc_id, p.term, floor(1000 * ln((2 * c.n + 2)::DOUBLE / (2 * f.df + 1)))::BIGINT * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (100 - 75 + (75 * p.n * c.n) // c.l))) AS part FROM p JOIN f USING (term), c WHERE p.term IN (SELECT term FROM q)),
s AS (SELECT item_id, doc_id, sum(part)::BIGINT AS score FROM q JOIN i USING (term) GROUP BY item_id, r, doc_id)
SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""
