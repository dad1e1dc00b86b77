"""Nearest neighbours by inner product: a forest of random-projection trees, one priority queue, exact reranking."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, wide, with_group

TREES = 8
#: Distinct vectors that the splits are fitted on, at most: those with the smallest hash of their id.
SAMPLE = 16_384
#: Vectors in a leaf, about, while the sample allows for as many leaves.
LEAF = 1024
#: Share of all leaves of the forest that a query's queue takes. Vectors without structure need so much for a recall of 0.9.
SEARCH_SHARE = 0.14
#: Rows of either side that one task compares at a time.
BLOCK_ROWS = 4096


@dataclass
class Forest:
    """planes[t][n] and cuts[t][n] of inner node n (children 2n+1, 2n+2) of tree t; longest: the largest norm."""

    planes: np.ndarray
    cuts: np.ndarray
    depth: int
    longest: float

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """Data vectors with one more coordinate that makes all norms equal, so that nearness by angle is nearness by inner product."""
        x = x / self.longest
        return np.concatenate([x, np.sqrt(np.maximum(0.0, 1 - (x * x).sum(1, keepdims=True)))], axis=1)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each data vector in each tree, numbered through the forest: trees by rows."""
        x = self.lifted(x)
        out = np.empty((len(self.planes), len(x)), np.int64)
        for t, (planes, cuts) in enumerate(zip(self.planes, self.cuts, strict=True)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + ((x * planes[node]).sum(1) > cuts[node])
            out[t] = node - (2**self.depth - 1) + t * 2**self.depth
        return out

    def search(self, q: np.ndarray, most: int) -> list[int]:
        """The first most leaves from one queue over all trees: nodes come by the smallest margin on their path, the largest first."""
        q = np.append(q / np.linalg.norm(q), 0.0)
        margins = self.planes @ q - self.cuts
        inner = 2**self.depth - 1
        queue = [(-math.inf, t, 0) for t in range(len(self.planes))]
        heapq.heapify(queue)
        out: list[int] = []
        while queue and len(out) < most:
            key, t, n = heapq.heappop(queue)
            if n >= inner:
                out.append(n - inner + t * (inner + 1))
                continue
            m = float(margins[t, n])
            heapq.heappush(queue, (max(key, m), t, 2 * n + 1))
            heapq.heappush(queue, (max(key, -m), t, 2 * n + 2))
        return out


def fit_forest(sample: np.ndarray, rows: int, longest: float, trees: int = TREES, leaf: int = LEAF, seed: int = 0) -> Forest:
    """Random directions, each cut at the sample's median in its node."""
    depth = max(0, min(math.ceil(math.log2(max(1, rows) / leaf)) if rows > leaf else 0, int(math.log2(max(1, len(sample) / 16)))))
    inner, dims = 2**depth - 1, sample.shape[1] + 1
    rng = np.random.default_rng(seed)
    forest = Forest(rng.normal(size=(trees, max(1, inner), dims)), np.zeros((trees, max(1, inner))), depth, longest)
    forest.planes /= np.linalg.norm(forest.planes, axis=2, keepdims=True)
    x = forest.lifted(sample)
    for t in range(trees):
        node = np.zeros(len(x), np.int64)
        for level in range(depth):
            m = (x * forest.planes[t][node]).sum(1)
            for n in range(2**level - 1, 2 ** (level + 1) - 1):
                if (here := m[node == n]).size:
                    forest.cuts[t, n] = np.median(here)
            node = 2 * node + 1 + (m > forest.cuts[t][node])
    return forest


def matrix(column) -> np.ndarray:
    """A list column of equally long vectors as rows of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def exact_top(queries: pa.Table, members: pa.Table, most: int) -> pa.Table:
    """For each query of a leaf its most nearest members with a score of at least the query's floor: (query, vec, score)."""
    out_q, out_v, out_s = [], [], []
    if queries.num_rows and members.num_rows:
        q, x = matrix(queries["vector"]), matrix(members["vector"])
        ids, qs, floor = members["rep"].to_numpy(), queries["query"].to_numpy(), queries["floor"].to_numpy(zero_copy_only=False)
        rough, longest = q @ x.T, np.sqrt((x * x).sum(1).max())
        for i in range(len(q)):
            s = rough[i]
            at = np.nonzero(s >= floor[i] - 1e-6 * max(1.0, abs(floor[i])))[0] if np.isfinite(floor[i]) else np.arange(len(s))
            if len(at) > most:  # all that may be among the best: equal scores are told apart by their ids
                slack = 1e-12 * longest * np.sqrt(q[i] @ q[i])
                at = at[s[at] >= -np.partition(-s[at], most - 1)[most - 1] - slack]
            exact = (x[at] * q[i]).sum(1)
            order = np.lexsort((ids[at], -exact))[:most]
            out_q.append(np.full(len(order), qs[i]))
            out_v.append(ids[at][order])
            out_s.append(exact[order])
    cat = lambda parts, kind: pa.array(np.concatenate(parts) if parts else np.empty(0), kind)
    return pa.table({"query": cat(out_q, pa.int64()), "vec": cat(out_v, pa.int64()), "score": cat(out_s, pa.float64())})


def usable(vector: Column, dims: int | None = None) -> Column:
    """Not null, no null or non-finite component, not all zero (and of that many dimensions)."""
    x = vector.cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    out = vector.isNotNull() & finite & F.exists(x, lambda v: v != 0)
    return F.coalesce(out if dims is None else out & (F.size(vector) == dims), F.lit(False))


def compare(visits: DataFrame, members: DataFrame, most: int) -> DataFrame:
    """exact_top of each leaf, in blocks: a leaf of many members or queries becomes several groups, each of about BLOCK_ROWS a side."""
    q_blocks = visits.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("qn"))
    m_blocks = members.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("mn"))
    blocks = F.broadcast(stored(q_blocks.join(m_blocks, "leaf"), "blocks"))  # a row for each leaf: at most TREES * SAMPLE / 16
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = visits.join(blocks, "leaf").withColumn("qb", F.pmod(F.xxhash64("query"), "qn").cast("int")).withColumn("mb", every(F.col("mn")))
    right = members.join(blocks, "leaf").withColumn("mb", F.pmod(F.xxhash64("rep"), "mn").cast("int")).withColumn("qb", every(F.col("qn")))
    keys = ["leaf", "qb", "mb"]

    def block(q: pa.Table, m: pa.Table) -> pa.Table:
        return exact_top(q, m, most)

    return left.select(*keys, "query", "vector", "floor").groupBy(*keys).cogroup(right.select(*keys, "rep", "vector").groupBy(*keys)).applyInArrow(block, "query long, vec long, score double")


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, trees: int = TREES, share: float = SEARCH_SHARE, leaf: int = LEAF, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of vectors(vec_id, embedding) with is_query, its k nearest found among all other rows.

    Equal vectors are indexed once; of each such group only the k + 1 smallest ids can be among a query's k nearest, so only
    they come back. The forest is fitted on a bounded sample and every distinct vector is sent to its leaf in
    each tree. A query takes leaves from one priority queue over all trees; the first ones give a floor for its scores, and in the
    others only what reaches the floor comes back. Scores are inner products of the original vectors in double precision; ties
    go to the smaller vec_id. Fewer than k other rows: all of them.

    Vectors that are null, zero, or hold a null or non-finite component take no part, neither do those of another length than
    most, nor null ids. Rows that repeat a vec_id count once each among the candidates of others. Empty table: no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("is_query")).where(F.col("vec_id").isNotNull())
    common = rows.where(usable(F.col("vector"))).groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    dims = common[0]["d"] if common else 0
    key = F.concat(F.hex(F.xxhash64(F.lit(1), "vector")), F.hex(F.xxhash64("vector", F.lit(2))))
    rows = stored(rows.where(usable(F.col("vector"), dims)).withColumn("key", key), "vectors")
    known = stored(with_group(rows.select("vec_id", "key", "is_query"), "key", rep=F.min("vec_id"), asked=F.max("is_query")), "groups")
    reps = known.where(F.col("vec_id") == F.col("rep")).select("rep", "asked", F.col("key").alias("_key")).distinct()
    distinct = stored(rows.join(reps, (F.col("key") == F.col("_key")) & (F.col("vec_id") == F.col("rep"))).select("rep", "asked", "vector").dropDuplicates(["rep"]), "distinct")
    size = distinct.agg(F.count(F.lit(1)).alias("n"), F.max(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, v: a + v * v))).alias("longest")).first()
    few = distinct.orderBy(F.xxhash64("rep")).limit(sample).select("vector").toPandas()["vector"]
    data = np.stack([np.asarray(v) for v in few]) if len(few) else np.zeros((0, max(1, dims)))
    forest = fit_forest(data, size["n"], size["longest"] or 1.0, trees, leaf)
    shared = spark.sparkContext.broadcast(forest)
    leaves = trees * 2**forest.depth
    most = min(leaves, max(2 * trees, math.ceil(share * leaves)))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = shared.value.leaves(matrix(batch.column(1)))
                for row in at:
                    yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), batch.column(0), batch.column(1)], names=["leaf", "rep", "vector"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.search(q, most) for q in matrix(batch.column(1))]
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
            values = np.concatenate(found) if found else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int64)))], names=["query", "vector", "leaves"])

    members = distinct.select("rep", "vector").mapInArrow(index, "leaf long, rep long, vector array<double>")
    asked = stored(wide(distinct.where("asked").select(F.col("rep").alias("query"), "vector"), "query").mapInArrow(ask, "query long, vector array<double>, leaves array<bigint>"), "asked")
    first = asked.select(F.explode(F.slice("leaves", 1, trees)).alias("leaf"), "query", "vector", F.lit(float("-inf")).alias("floor"))
    near = stored(compare(first, members, k + 1), "near")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec")
    seen = near.distinct()
    floors = seen.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).groupBy("query").agg(F.when(F.count(F.lit(1)) > k, F.min("score")).otherwise(float("-inf")).alias("floor"))
    rest = asked.where(F.size("leaves") > trees).select(F.explode(F.slice("leaves", trees + 1, most)).alias("leaf"), "query", "vector")
    more = compare(rest.join(stored(floors, "floors"), "query"), members, k + 1)
    tops = near.unionByName(more).distinct().withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).select("query", "vec", "score")
    by_id = Window.partitionBy("rep").orderBy("vec_id")
    ids = known.withColumn("r", F.row_number().over(by_id)).where(F.col("r") <= k + 1).select(F.col("rep").alias("vec"), "vec_id")
    queries = known.where("is_query").select(F.col("vec_id").alias("query_id"), F.col("rep").alias("query"))
    found = queries.join(tops, "query").join(ids, "vec").where(F.col("vec_id") != F.col("query_id"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
