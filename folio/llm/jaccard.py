"""N-gram Jaccard self-join with adaptive multi-match prefixes, and the components of its links."""

from __future__ import annotations

import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, drop_stored, free_names, stored, with_ids
from .text import new_key, portions, windows, word_hashes

WORDS, PERCENT = 5, 75
#: Cells of the table of shingle counts (a power of two in these bounds, about one for each eight bytes of text), and of one row of it on its way.
LEAST_CELLS, MOST_CELLS, BLOCK = 1 << 20, 1 << 24, 1 << 16
#: Prefixes are lengthened by one of these numbers of shingles, which is also how many shared ones they then require.
LENGTHS = (1, 2, 4, 8)
#: What a verified candidate costs, in prefix shingles looked up.
VERIFY = 40
#: Sets of one shingle whose pairs are looked at one by one.
FEW = 64
#: Sets of one shingle that are ordered in one group; more frequent shingles are dealt over groups of about as many.
ORDERED = 4096


def shingles(texts: list[bytes], k: int = WORDS, key: int = 0) -> list[np.ndarray]:
    """The sorted distinct shingles of each text: of k words each, of the whole sequence where there are fewer, none without words."""
    flat, each = word_hashes([t.lower() for t in texts], key)
    whole = windows(flat, k)
    out, at = [], 0
    for n in each.tolist():
        h = whole[at : at + n - k + 1].copy() if n >= k else windows(flat[at : at + n], n, seed=n) if n else np.empty(0, np.uint64)
        h.sort()
        out.append(h[np.concatenate([[True], h[1:] != h[:-1]])] if n else h)
        at += n
    return out


def set_key(s: np.ndarray) -> int:
    """A hash of a whole set, for any 64-bit numbers; 0 for none."""
    import xxhash

    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())))) or 1 if len(s) else 0


def counted(docs: DataFrame, cells: int, key: int) -> DataFrame:
    """Rows of two kinds from docs(id, doc_id, text, digest): the same with the size n and the key of each text's set, and blocks of the table of counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(cells, np.int32)
        names = ["id", "doc_id", "text", "digest", "n", "key", "block", "counts"]
        for batch in batches:
            for first, part in portions(batch.column(2)):
                sets = shingles(part, key=key)
                np.add.at(table, (np.concatenate(sets) & np.uint64(cells - 1)).astype(np.int64), np.int32(1))
                own = [c.slice(first, len(sets)) for c in batch.columns]
                nulls = pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())
                yield pa.RecordBatch.from_arrays([*own, pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) for s in sets], pa.int64()), *nulls], names=names)
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64()]
        for b in range(cells // BLOCK):
            if (c := table[b * BLOCK : (b + 1) * BLOCK]).any():
                yield pa.RecordBatch.from_arrays([*(pa.nulls(1, k) for k in kinds), pa.array([b], pa.int32()), pa.array([zlib.compress(c.tobytes(), 1)], pa.binary())], names=names)

    return docs.select("id", "doc_id", "text", "digest").mapInArrow(run, "id long, doc_id long, text binary, digest string, n long, key long, block int, counts binary")


def ranks(counts: np.ndarray, mean: float) -> np.ndarray:
    """The power of two that tells how often the shingles of each cell occur beyond what falls into any cell; 0 where that may be chance (4 standard deviations)."""
    over = counts - mean
    return np.where(over > 4 * np.sqrt(mean) + 4, np.ceil(np.log2(np.maximum(over, 0) + 2)), 0).astype(np.uint8)


def rank_table(blocks: DataFrame, cells: int, mean: float) -> np.ndarray:
    """ranks of the whole table; a task adds up the blocks that are its own, and one byte for each cell goes to the driver."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, c in zip(batch["block"], batch["counts"], strict=True):
                c = np.frombuffer(zlib.decompress(c), np.int32).astype(np.int64)
                sums[b] = sums[b] + c if b in sums else c
        for b, c in sums.items():
            yield pd.DataFrame({"block": pd.Series([b], dtype="int32"), "ranks": [zlib.compress(ranks(c, mean).tobytes(), 1)]})

    out = np.zeros(cells, np.uint8)
    for r in blocks.repartition("block").mapInPandas(add, "block int, ranks binary").toLocalIterator():
        out[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(zlib.decompress(r["ranks"]), np.uint8)
    return out


def prefix(s: np.ndarray, rank_of: np.ndarray) -> tuple[np.ndarray, int, np.ndarray]:
    """(the prefix of a set, the number of shared shingles it requires, the prefix's ranks).

    Shingles are in one order for all sets: by rank, then by hash. A partner shares at
    least need = PERCENT % of the set, so of any two partners the first size - need + l shingles share l at least. The l
    of least cost is taken: shingles to look up, and candidates to verify, which are at most the other
    occurrences of the prefix's shingles divided by l.
    """
    n = len(s)
    need = -(-PERCENT * n // 100)
    rank = rank_of[(s & np.uint64(len(rank_of) - 1)).astype(np.int64)]
    by = np.lexsort((s, rank))
    tokens, rank = s[by], rank[by]
    others = np.cumsum(np.where(rank > 0, 2.0**rank, 0.1))
    best, chosen = np.inf, 1
    for l in LENGTHS:  # noqa: E741
        if l > need:
            break
        size = n - need + l
        cost = size + others[size - 1] * (1 + VERIFY / l)
        if cost < best:
            best, chosen = cost, l
    return tokens[: n - need + chosen], chosen, rank[: n - need + chosen]


def index(docs: DataFrame, rank_of, hot_rank: int, secret: int) -> DataFrame:
    """(token, node, n, l, size, at, hot): the prefixes of docs(text) by their set keys, with the prefix's size, each token's place in it and
    whether its rank is hot_rank at least; sets that occur again in a task are left out there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = set()
        for batch in batches:
            for _, part in portions(batch.column(0)):
                tokens, hot, rows = [], [], []
                for s in shingles(part, key=secret):
                    if not len(s) or (key := set_key(s)) in done:
                        continue
                    if len(done) > 100_000:
                        done.clear()
                    done.add(key)
                    t, l, rank = prefix(s, rank_of.value)  # noqa: E741
                    tokens.append(t)
                    hot.append(rank >= hot_rank)
                    rows.append((key, len(s), l, len(t)))
                if tokens:
                    each = [len(t) for t in tokens]
                    cols = [np.repeat(np.array(c, k), each) for c, k in zip(zip(*rows, strict=True), (np.int64, np.int32, np.int32, np.int32), strict=True)]
                    place = np.concatenate([np.arange(m, dtype=np.int32) for m in each])
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (np.concatenate(tokens).view(np.int64), *cols, place, np.concatenate(hot))], names=["token", "node", "n", "l", "size", "at", "hot"])

    return docs.select("text").mapInArrow(run, "token long, node long, n int, l int, size int, at int, hot boolean")


def similar_size(a: Column, b: Column) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT


def shared_needed(a: Column, b: Column) -> Column:
    """Shingles that sets of these sizes share at least when they are similar: ceil(PERCENT (a + b) / (100 + PERCENT))."""
    return F.floor((PERCENT * (a + b) + 99 + PERCENT) / (100 + PERCENT))


SIDE = ["token", "node", "n", "l", "size", "at", "left", "many_here", "c"]


def side(df: DataFrame, s: str, *more: str) -> DataFrame:
    return df.select(*[F.col(x).alias(x + s) for x in [*SIDE, *more]])


def columns(s: str) -> dict[str, Column]:
    return {k: F.col(k + s) for k in SIDE}


def prefix_needed(x: dict[str, Column], y: dict[str, Column]) -> Column:
    """Prefix shingles that two similar sets share at least, the smaller requirement or more.

    Of the two, all shingles of the prefix that ends first in the common order are decided: the other set has those that
    its own prefix has. So what the sets share beyond the shared prefix shingles is in the rest of that set.
    """
    return shared_needed(x["n"], y["n"]) - F.greatest(x["n"] - x["size"], y["n"] - y["size"])


def may_match(x: dict[str, Column], y: dict[str, Column]) -> Column:
    """Whether a shared prefix shingle can be one of the first that two similar sets share.

    The k-th shared shingle leaves k - 1 before it and no more than the rest of either set; k goes up to the smaller requirement.
    """
    place = F.least(x["n"] - x["at"], y["n"] - y["at"]) >= shared_needed(x["n"], y["n"]) - F.least(x["l"], y["l"]) + 1
    return similar_size(x["n"], y["n"]) & place


def ends(*more: Column) -> list[Column]:
    """(a, b, needs) of a joined pair of sides _x and _y, and more columns."""
    return [F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b"), prefix_needed(columns("_x"), columns("_y")).alias("needs"), *more]


def enough(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """(a, b) of the distinct pairs(a, b, needs) whose prefixes share as many shingles as they need; held(node, tokens): the prefixes."""
    sides = pairs.join(held.select(F.col("node").alias("a"), F.col("tokens").alias("ta")), "a").join(held.select(F.col("node").alias("b"), F.col("tokens").alias("tb")), "b")
    return sides.where(F.size(F.array_intersect("ta", "tb")) >= F.col("needs")).select("a", "b")


def _verifier(key: int):
    """Keeps the pairs whose texts have the similarity; their words are hashed anew, under a key of its own, so that what one key took for alike is not taken so twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held = OrderedDict(), 0

        def of(node: int, text) -> np.ndarray:
            nonlocal held
            s = known.get(node)
            if s is None:
                s = known[node] = shingles([text.as_buffer().to_pybytes()], key=key)[0]
                held += s.nbytes
                while held > 32 << 20 and len(known) > 1:
                    held -= known.popitem(last=False)[1].nbytes
            return s

        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = np.zeros(len(a), bool)
            for i in range(len(a)):
                x, y = of(a[i], batch.column(2)[i]), of(b[i], batch.column(3)[i])
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = 100 * both >= PERCENT * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:2]], names=["a", "b"])

    return run


def verified(pairs: DataFrame, sets: DataFrame, texts: DataFrame, key: int) -> DataFrame:
    """The pairs(a, b) of set keys whose whole texts have the similarity; sets(key, row) names a row of texts(id, text) for each key."""
    pairs = stored(pairs, "pairs")
    nodes = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
    ids = stored(nodes.join(sets, "key").select("key", F.col("row").alias("id")), "nodes")
    text = stored(with_ids(texts, ids, "id", "inner").select("key", "text"), "texts", "zstd")
    one = pairs.join(text.select(F.col("key").alias("a"), F.col("text").alias("ta")), "a")
    both = one.join(text.select(F.col("key").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")
    links = stored(both.mapInArrow(_verifier(key), "a long, b long"), "links")
    for old in (pairs, ids, text):
        drop_stored(old)
    return links


def star(rows: DataFrame) -> DataFrame:
    """Distinct (a, b, needs): each set beside the first one of its shingle and the one before it.

    The sets with the least shingles that few others have come first: of a group of edited copies those nearest to the original.
    Hot shingles are ordered in groups, whose first ones are then set beside the first of all.
    """
    order = [(F.col("size") - F.col("many_here")), F.desc("n"), "node"]
    here, all_ = Window.partitionBy("token", "salt").orderBy(*order), Window.partitionBy("token").orderBy(*order)
    item = F.struct("node", "n", "l", "size")
    near = rows.select("token", "hot", "many_here", "node", "n", "l", "size", F.first(item).over(here).alias("head"), F.lag(item).over(here).alias("prev"))
    heads = near.where(F.col("hot") & F.col("prev").isNull()).select("node", "n", "size", F.first(item).over(all_).alias("o"))
    near = near.select("node", "n", "size", F.explode(F.array_distinct(F.array("head", "prev"))).alias("o")).unionByName(heads)
    near = near.where(F.col("o").isNotNull() & (F.col("o.node") != F.col("node")) & similar_size(F.col("n"), F.col("o.n")))
    needs = prefix_needed({"n": F.col("n"), "size": F.col("size")}, {"n": F.col("o.n"), "size": F.col("o.size")})
    return near.select(F.least("node", "o.node").alias("a"), F.greatest("node", "o.node").alias("b"), needs.alias("needs")).distinct()


def across_few(rows: DataFrame) -> DataFrame:
    """Distinct (a, b, needs) of different components that share a prefix shingle of FEW sets at most, and as many shingles of any kind as the smaller requirement."""
    x, y = side(rows, "_x"), side(rows, "_y")
    met = x.join(y, (F.col("token_x") == F.col("token_y")) & (F.col("c_x") < F.col("c_y")) & may_match(columns("_x"), columns("_y")))
    pairs = met.select(*ends(F.least("l_x", "l_y").alias("l"), F.least("many_here_x", "many_here_y").alias("beside")))
    found = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), *[F.first(x).alias(x) for x in ("needs", "l", "beside")])
    return found.where(F.col("shared") + F.col("beside") >= F.col("l")).select("a", "b", "needs")


def across_many(rows: DataFrame) -> DataFrame:
    """Distinct (a, b, needs) of different components that share prefix shingles of more than FEW sets only.

    A pair is nominated at the first shingle that it shares: what stands before it in either prefix is not in both sets, so they share no
    more than the rest of either (room), and of their prefixes no more than the frequent shingles that are left. First the best sets
    of components meet, so that hopeless components don't; then the sets of the smaller component are read first, and a pair comes out of
    the join only at its first shared shingle and if it shares enough of them.
    """
    # a set that cannot even reach the smallest one it may link with has no partner there
    room = F.col("n") - F.col("at")
    reach = F.floor(room * (100 + PERCENT) / PERCENT) - F.col("n")
    first = rows.where(reach >= F.greatest(F.col("smallest"), F.ceil(F.col("n") * PERCENT / 100)))
    there = first.groupBy("token", "c").agg(F.max(room).alias("room"), F.min("n").alias("low"), F.max("n").alias("high"), F.max(F.col("n") - F.col("size")).alias("rest"), F.max("left").alias("left"), F.count(F.lit(1)).alias("sets"))
    a, b = (there.select(*[F.col(x).alias(x + s) for x in there.columns]) for s in ("_a", "_b"))
    sizes = (F.col("high_a") * 100 >= F.col("low_b") * PERCENT) & (F.col("high_b") * 100 >= F.col("low_a") * PERCENT)
    needed = shared_needed(F.col("low_a"), F.col("low_b"))
    hopeful = (F.least("room_a", "room_b") >= needed) & (F.least("left_a", "left_b") >= needed - F.greatest("rest_a", "rest_b"))
    met = a.join(b, (F.col("token_a") == F.col("token_b")) & (F.col("c_a") < F.col("c_b")) & sizes & hopeful)
    swap = F.col("sets_a") > F.col("sets_b")
    met = met.select(F.col("token_a").alias("t"), F.when(swap, F.col("c_b")).otherwise(F.col("c_a")).alias("small"), F.when(swap, F.col("c_a")).otherwise(F.col("c_b")).alias("large"))
    lists = rows.groupBy("node").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "token"))), lambda r: r["token"]).alias("frequent"))
    first = first.join(stored(lists.join(first.select("node").distinct(), "node", "left_semi"), "lists"), "node")
    x, y = side(first, "_x", "frequent"), side(first, "_y", "frequent")
    one = met.join(x, (F.col("t") == F.col("token_x")) & (F.col("small") == F.col("c_x")))
    needs = prefix_needed(columns("_x"), columns("_y"))
    room = F.least(F.col("n_x") - F.col("at_x"), F.col("n_y") - F.col("at_y")) >= shared_needed(F.col("n_x"), F.col("n_y"))
    left = (F.least("left_x", "left_y") >= needs) & similar_size(F.col("n_x"), F.col("n_y"))
    shared = F.array_intersect("frequent_x", "frequent_y")
    both = one.join(y, (F.col("t") == F.col("token_y")) & (F.col("large") == F.col("c_y")) & room & left & (F.size(shared) >= needs) & (F.get(shared, F.lit(0)) == F.col("t")))
    return both.select(*ends())


def classified(docs: DataFrame) -> DataFrame:
    """One row for each row of docs(doc_id, text, digest): doc_id, digest, n, and keeper(none, doc_id, digest), the first document of its component (none: without doc_id).

    The steps of near_duplicates, which see texts by their sets and rows by a number of their own.
    """
    spark, key, other = docs.sparkSession, new_key(), new_key()
    measured = docs.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("text")).alias("bytes")).first()
    cells = min(MOST_CELLS, max(LEAST_CELLS, 1 << ((measured["bytes"] or 0) // 8).bit_length()))
    numbered = docs.select(F.monotonically_increasing_id().alias("id"), "doc_id", "text", "digest")
    first = stored(counted(numbered, cells, key), "sets", "zstd")
    known, texts = first.where(F.col("block").isNull()).select("id", "doc_id", "digest", "n", "key"), first.where(F.col("block").isNull()).select("id", "text")
    total = known.agg(F.sum("n")).first()[0] or 0
    rank_of = spark.sparkContext.broadcast(rank_table(first.where(F.col("block").isNotNull()).select("block", "counts"), cells, total / cells))
    keeper = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    sets = stored(known.where("key <> 0").groupBy("key").agg(F.min(keeper).alias("keeper"), F.min("id").alias("row")), "classes")

    # a shingle is hot if its rank tells of more than a few hundredths of the rows; its sets are dealt over groups
    hot = max(ORDERED, measured["rows"] // 256)
    found = index(texts, rank_of, hot.bit_length(), key).withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("node"), F.lit(max(1, measured["rows"] // hot)))).otherwise(F.lit(0)))
    here = Window.partitionBy("token", "salt")
    found = found.withColumn("lo", F.min("node").over(here)).withColumn("hi", F.max("node").over(here)).where("hot or lo < hi").drop("lo", "hi")
    # copies of a set from several tasks are one
    shared = found.dropDuplicates(["token", "salt", "node"])
    shared = shared.withColumn("many", F.col("hot") | (F.count(F.lit(1)).over(here) > FEW)).withColumn("smallest", F.when(F.col("hot"), F.lit(0)).otherwise(F.min("n").over(here)))
    shared = stored(shared, "shared")
    node, many = Window.partitionBy("node"), F.col("many").cast("int")
    from_here = node.orderBy("at").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = stored(shared.withColumn("many_here", F.sum(many).over(node)).withColumn("left", F.sum(many).over(from_here)), "rows")
    drop_stored(shared)
    held = stored(rows.groupBy("node").agg(F.collect_list("token").alias("tokens")), "held")
    links = verified(enough(star(rows), held), sets, texts, other)

    groups = stored(components(links), "components")
    placed = rows.join(groups, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
    mixed = placed.select("*", F.min("c").over(here).alias("lo"), F.max("c").over(here).alias("hi")).where("hot or lo < hi").drop("lo", "hi")
    mixed = stored(mixed, "mixed")
    drop_stored(rows)
    more = across_few(mixed.where(~F.col("many"))).unionByName(across_many(mixed.where("many"))).distinct()
    more = verified(enough(more, held), sets, texts, other)
    drop_stored(mixed)

    nodes = stored(components(links.unionByName(more)), "components")
    least = sets.join(nodes, F.col("key") == F.col("node")).groupBy("component").agg(F.min("keeper").alias("least"))
    named = stored(nodes.join(least, "component").select(F.col("node").alias("key"), "least"), "named")
    named = stored(sets.join(named, "key", "left").select("key", F.coalesce("least", "keeper").alias("keeper")), "named")
    out = with_ids(known.where("key <> 0"), named, "key", "inner").select("doc_id", "digest", "n", "keeper")
    return out.unionByName(known.where("key = 0").select("doc_id", "digest", "n", keeper.alias("keeper")))


def plain(docs: DataFrame, digest: Column) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"), digest.alias("digest"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id (the smallest doc_id that links reach).

    Texts are lower-cased (A-Z); a set holds the distinct shingles of WORDS words. Two documents link when their sets'
    Jaccard similarity is PERCENT % or more. Equal sets are one node, so copies cost nothing more.

    1. All shingles are counted into a table whose size follows the corpus within bounds; frequent ones sort last in every set.
    2. Each set's prefix, lengthened by its own estimated candidate cost, is indexed; shingles of one node only fall out.
    3. Within a shingle each node is paired with the first one and with the one before it (star): linear, and enough to join
       large groups. Pairs that share too few prefix shingles fall out, the others are verified on whole texts.
    4. All remaining pairs of nodes that share prefix shingles and lie in different components are counted and
       verified likewise (across_few, across_many); within a component no pair can change the result.

    Sets are compared by 64-bit hashes of shingles, under secret keys drawn for each run. Null or empty texts have no shingles and link with nothing. Each row is a document of
    its own: rows that repeat a doc_id may have different texts, and a null doc_id links others too; its component_id
    is null where no doc_id is reached. Rows that repeat doc_id and text each have their row. Empty table: no rows.
    """
    named = classified(plain(docs, F.lit(None).cast("string")))
    return named.select("doc_id", F.col("n").alias("n_shingles"), F.col("keeper.doc_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one document of each component, that of the smallest doc_id (null last), then of the smallest SHA-256; all columns of docs, in
    its order. Rows that repeat its doc_id and text stay, as do all rows without words."""
    digest, id_ = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    named = classified(plain(docs, digest)).where("n > 0")
    own = F.col("doc_id").eqNullSafe(F.col("keeper.doc_id")) & (F.col("digest") == F.col("keeper.digest"))
    i, d = free_names(docs, "_id", "_digest")
    gone = stored(named.where(~own).select(id_.alias(i), F.col("digest").alias(d)).distinct(), "gone")
    return with_ids(docs.withColumn(i, id_).withColumn(d, digest), gone, [i, d], "left_anti").select(*docs.columns)
