"""Prefix trie of conversations by truncation peeling: from the deepest turn upward, ended conversations join surviving nodes, the last turn goes, equal prefixes meet."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, wide, with_ids

#: Depths at which a group of conversations may be dealt to one task, which peels all that lies deeper; above them nodes are peeled level by level.
FIRST_BASE = 4
#: Turns beyond the base that one group may have in a task; larger groups go to the next base, twice as deep.
MOST_TURNS = 1_000_000
#: Ids of which one row of a node's list of ended conversations is made, and bytes of a prefix's key (of a chain of SHA-256).
IDS_A_ROW, KEY = 4096, 16
ROOT = b"\0" * KEY

STEP = "struct<k: binary, b: long>"
NODES = "key binary, parent binary, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved long"


# ---- conversations as paths


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, n (from 1, by turn, null first; ties by role, then text), digest, bytes. Null role or text counts as empty, rows without conv_id don't count."""
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    size = F.octet_length("role").cast("string")
    digest = F.unhex(F.sha2(F.concat(size, F.lit(":"), "role", "text"), 256))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text"))
    return rows.select("conv_id", place.alias("n"), digest.alias("digest"), F.octet_length("text").cast("long").alias("bytes"))


def rebuilt(turns: DataFrame, every: int = 5, most: int = 9) -> DataFrame:
    """conv_id, steps: each conversation with its first h turns taken from conversation conv_id - conv_id % every (all if it has fewer, none if there is none); h is the unsigned crc32 of the decimal id, modulo most.

    turns: a stored table (conv_id, n, digest, bytes). steps: digests and bytes in order; empty for a conversation without any.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    step = F.struct("n", "digest", "bytes")
    own = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.when(F.col("n") > h, step))).alias("own"))
    heads = turns.where(F.col("n") < most).groupBy("conv_id").agg(F.array_sort(F.collect_list(step)).alias("head")).select(F.col("conv_id").alias("_base"), "head")
    joined = own.withColumn("_base", F.col("conv_id") - F.col("conv_id") % every).join(heads, "_base", "left")
    head = F.slice(F.coalesce("head", F.array().cast("array<struct<n:int,digest:binary,bytes:long>>")), F.lit(1), F.greatest(h, F.lit(0)).cast("int"))
    return joined.select("conv_id", F.transform(F.concat(head, "own"), lambda s: F.struct(s["digest"].alias("digest"), s["bytes"].alias("bytes"))).alias("steps"))


def with_paths(conversations: DataFrame) -> DataFrame:
    """conv_id, path: for each depth of a conversation (conv_id, steps) the key of its prefix and the bytes of its last text. A key is the first KEY bytes of SHA-256 over the key above and the turn's digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            steps = batch.column(1)
            flat = steps.flatten()
            keys, at = [], 0
            digests = flat.field("digest").to_pylist()
            for size in steps.value_lengths().to_pylist():
                key = ROOT
                for d in digests[at : at + size]:
                    key = hashlib.sha256(key + d).digest()[:KEY]
                    keys.append(key)
                at += size
            struct = pa.StructArray.from_arrays([pa.array(keys, pa.binary()), flat.field("bytes").cast(pa.int64())], names=["k", "b"])
            ends = pa.array(np.concatenate([[0], np.cumsum(steps.value_lengths().to_numpy())]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, struct)], names=["conv_id", "path"])

    return conversations.select("conv_id", "steps").mapInArrow(run, f"conv_id long, path array<{STEP}>")


# ---- peeling


def _peeled(path: list, rows: list[tuple]) -> Iterator[tuple]:
    """Nodes below a base, deepest first, then (last) what they bring to the base.

    rows: (path beyond the base as (keys, bytes), conv_id, n_convs) of conversations that end at different nodes. Yields (key, parent's key,
    depth beyond the base, conv_id, n_convs, n_children, n_leaves, saved).
    """
    by_end: dict[int, list] = {}
    for row in rows:
        by_end.setdefault(len(row[0][0]), []).append(row)
    depth = max(by_end)
    surviving: dict[bytes, list] = {}  # key: [path, conv_id, n_convs, n_children, n_leaves, saved]
    while depth:
        for p, conv, n in by_end.get(depth, ()):  # newly ended conversations join the nodes of this depth
            node = surviving.setdefault(p[0][depth - 1], [p, conv, 0, 0, 0, 0])
            node[1], node[2] = min(node[1], conv), node[2] + n
        above: dict[bytes, list] = {}
        for key, (p, conv, n, children, leaves, saved) in surviving.items():
            leaves, saved = leaves or 1, saved + (n - 1) * p[1][depth - 1]
            parent = p[0][depth - 2] if depth > 1 else path
            yield key, parent, depth, conv, n, children, leaves, saved
            node = above.setdefault(parent, [p, conv, 0, 0, 0, 0])  # without its last turn
            node[1], node[2], node[3], node[4], node[5] = min(node[1], conv), node[2] + n, node[3] + 1, node[4] + leaves, node[5] + saved
        surviving, depth = above, depth - 1
    [(_, conv, n, children, leaves, saved)] = surviving.values()
    yield None, None, 0, conv, n, children, leaves, saved


def _peel_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (base key, base, path, conv_id, n_convs), ordered by base key, to NODES; a row without a key brings its sums to the base, whose key is in `parent`."""
    names = ["key", "parent", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved"]
    kinds = [pa.binary(), pa.binary(), *[pa.int64()] * 6]

    def out(at: bytes, base: int, rows: list):
        found = []
        for key, parent, depth, *rest in _peeled(at, rows):
            found.append((key, at if key is None else parent, base + depth, *rest))
            if len(found) == 10_000:
                yield batch_of(found)
                found = []
        if found:
            yield batch_of(found)

    def batch_of(found: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names=names)

    now, base, rows = None, 0, []
    for batch in batches:
        for key, b, path, conv, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != now:
                if rows:
                    yield from out(now, base, rows)
                now, base, rows = key, b, []
            rows.append((([s["k"] for s in path], [s["b"] for s in path]), conv, n))
    if rows:
        yield from out(now, base, rows)


def _bases(ends: DataFrame, first: int, most: int) -> DataFrame:
    """ends (path, ...) with base: the least depth first, 2 first, 4 first ... below the path's length whose group has at most `most` turns beyond it; null where there is none."""
    length = F.size("path")
    depths = F.filter(F.transform(F.sequence(F.lit(0), F.lit(24)), lambda i: (F.lit(first) * F.pow(F.lit(2), i)).cast("int")), lambda d: d < length)
    each = ends.select("key", F.explode(F.transform(depths, lambda d: F.struct(d.alias("depth"), F.element_at("path", d)["k"].alias("at"), (length - d).alias("turns")))).alias("g")).select("key", "g.*")
    large = stored(each.groupBy("at").agg(F.sum("turns").alias("turns")).where(F.col("turns") > most).select("at"), "large")
    blocked = stored(with_ids(each, large, "at").groupBy("key").agg(F.max("depth").alias("blocked")), "blocked")
    base = F.filter(depths, lambda d: d > F.coalesce("blocked", F.lit(0)))
    out = with_ids(ends, blocked, "key", "left")
    return out.withColumn("base", F.when(F.size(base) > 0, F.element_at(base, 1))).drop("blocked")


def _list_digests(members: DataFrame) -> DataFrame:
    """key, ends_sha256 of members(key, conv_id): SHA-256 over the ids, ascending, joined by commas.

    The ids are put in order over the whole table, so a node that a third of the conversations end at lies in many tasks, which join
    them to rows of up to IDS_A_ROW ids. A digest is read from front to back: one task takes a node's rows in turn and holds no more than one.
    """
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows, a = [], 0
            for b in range(1, len(keys) + 1):
                if b == len(keys) or keys[b] != keys[a] or b - a == IDS_A_ROW:
                    rows.append((keys[a], ids[a], ",".join(map(str, ids[a:b]))))
                    a = b
            cols = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int64(), pa.string()), strict=True)], names=["key", "least", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = None, None, []
        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key != now:
                    if state:
                        done.append((now, state.hexdigest()))
                    now, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if len(done) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["key", "ends_sha256"])
                done = []
        if state:
            done.append((now, state.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["key", "ends_sha256"])

    rows = members.repartitionByRange(n, "key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(joined, "key binary, least long, ids string")
    return rows.repartition(n, "key").sortWithinPartitions("key", "least").select("key", "ids").mapInArrow(digests, "key binary, ends_sha256 string")


EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def prefix_trie(conversations: DataFrame, first_base: int = FIRST_BASE, most_turns: int = MOST_TURNS) -> DataFrame:
    """The trie of conversations(conv_id, steps), a row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Equal conversations meet first, by partial aggregation. Those with more turns than a base are dealt by their prefix at the base, and each
    task peels its groups from their deepest turn up to the base; a group of more than most_turns turns goes to the next base, twice as
    deep. What the groups bring to their bases, and the shorter conversations, is peeled level by level with Spark's grouping,
    whose partial aggregation takes prefixes that most conversations share. Each level yields its nodes as it is grouped.

    A conversation's path, 24 bytes a turn, is held by one row; a prefix is known by 128 bits of SHA-256. A parent's smallest member comes by a join at the end;
    the parents with the most children, at most 512, by a broadcast. No conversations: no rows, not even the root's.
    """
    paths = stored(with_paths(conversations), "paths", "zstd")
    tail = F.when(F.size("path") == 0, F.lit(bytearray(ROOT))).otherwise(F.element_at("path", F.when(F.size("path") == 0, 1).otherwise(-1))["k"])
    members = paths.select(tail.alias("key"), "conv_id", "path")
    ends = stored(members.groupBy("key").agg(F.first("path").alias("path"), F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")), "ends", "zstd")
    ends = stored(_bases(ends, first_base, most_turns), "ends", "zstd")
    digests = stored(_list_digests(members.select("key", "conv_id")), "digests")

    # below the bases: each group in one task
    deep = ends.where(F.col("base").isNotNull())
    beyond = F.slice("path", F.col("base") + 1, F.size("path") - F.col("base"))
    dealt = wide(deep.select(F.element_at("path", F.col("base"))["k"].alias("at"), F.col("base").cast("long").alias("base"), beyond.alias("path"), "conv_id", "n_convs"), "at").sortWithinPartitions("at")
    peeled = stored(dealt.mapInArrow(_peel_groups, NODES), "peeled", "zstd")
    parts = [peeled.where(F.col("key").isNotNull())]

    # the bases' own paths, and the levels above them
    above = deep.select(F.slice("path", F.lit(1), F.col("base")).alias("path"), F.element_at("path", F.col("base"))["k"].alias("at")).groupBy("at").agg(F.first("path").alias("path"))
    brought = peeled.where(F.col("key").isNull()).select(F.col("parent").alias("at"), "conv_id", "n_convs", "n_children", "n_leaves", "saved")
    bases = brought.join(above, "at").select("path", "conv_id", "n_convs", "n_children", "n_leaves", "saved")
    none = F.lit(0).cast("long")
    short = ends.where(F.col("base").isNull()).select("path", "conv_id", "n_convs", none.alias("n_children"), none.alias("n_leaves"), none.alias("saved"))
    waiting = stored(short.unionByName(bases).withColumn("depth", F.size("path")), "waiting", "zstd")
    depth = waiting.agg(F.max("depth")).first()[0]
    nodes = None
    while depth is not None and depth >= 0:
        rows = waiting.where(F.col("depth") == depth).drop("depth")
        if nodes is not None:  # nodes without their last turn
            kept = nodes.select(F.slice("path", F.lit(1), F.lit(depth)).alias("path"), "conv_id", "n_convs", F.lit(1).cast("long").alias("n_children"), "n_leaves", "saved")
            rows = rows.unionByName(kept)
        key = F.lit(bytearray(ROOT)) if depth == 0 else F.element_at("path", depth)["k"]
        sums = [F.first("path").alias("path"), F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")]]
        own = F.lit(0) if depth == 0 else F.element_at("path", depth)["b"]
        level = rows.groupBy(key.alias("key")).agg(*sums).withColumns({"n_leaves": F.when(F.col("n_leaves") == 0, 1).otherwise(F.col("n_leaves")), "saved": F.col("saved") + (F.col("n_convs") - 1) * own})
        nodes = stored(level, "level", "zstd")
        parent = F.lit(None).cast("binary") if depth == 0 else F.lit(bytearray(ROOT)) if depth == 1 else F.element_at("path", depth - 1)["k"]
        parts.append(nodes.select("key", parent.alias("parent"), F.lit(depth).cast("long").alias("depth"), "conv_id", "n_convs", "n_children", "n_leaves", "saved"))
        depth -= 1
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return _with_parents(stored(whole, "nodes", "zstd"), digests)


def _with_parents(nodes: DataFrame, digests: DataFrame) -> DataFrame:
    """nodes with their parents' conv_id and the digests of the conversations that end there."""
    n = nodes.count()
    own = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children").where(F.col("n_children") > 0)
    large = F.col("n_children") >= max(2, n / 512)  # children are nodes, so at most 512 nodes have so many
    many = own.where(large).select("parent", F.col("parent_conv_id").alias("_many"))
    rest = own.where(~large).select("parent", F.col("parent_conv_id").alias("_few"))
    joined = nodes.join(F.broadcast(many), "parent", "left")
    under = joined.where(F.col("_many").isNotNull() | F.col("parent").isNull()).withColumn("_few", F.lit(None).cast("long"))
    other = joined.where(F.col("_many").isNull() & F.col("parent").isNotNull()).join(rest, "parent", "left")
    found = under.unionByName(other).join(digests, "key", "left")
    return found.select("conv_id", "depth", F.coalesce("_many", "_few").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, first_base: int = FIRST_BASE, most_turns: int = MOST_TURNS) -> DataFrame:
    """prefix_trie of the rebuilt conversations of a table (conv_id, turn, role, text). Rows that repeat conv_id and turn are turns of their own, ordered by role and text."""
    turns = stored(ordered_turns(conversations), "turns", "zstd")
    return prefix_trie(stored(rebuilt(turns), "rebuilt", "zstd"), first_base, most_turns)


#: What DuckDB answers for conversation_trie of conversations: every prefix of every conversation is written out, and every node joined to all above it. crc32 goes bit by bit.
SQL = """
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, xor(list_reduce(flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, 4294967295::BIGINT), 4294967295) % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)),
s AS (SELECT c.conv_id, 0 AS part, t.n, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 5 AND t.n <= c.h UNION ALL SELECT c.conv_id, 1, t.n, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.n > c.h),
r AS (SELECT conv_id, row_number() OVER w AS depth, strlen(text) AS bytes, sha256(to_json(list([role, text]) OVER w)::VARCHAR) AS key FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY part, n ROWS UNBOUNDED PRECEDING)),
p AS (SELECT conv_id, depth, bytes, key, coalesce(lag(key) OVER (PARTITION BY conv_id ORDER BY depth), 'root') AS parent, lead(key) OVER (PARTITION BY conv_id ORDER BY depth) IS NULL AS ends FROM r
  UNION ALL SELECT conv_id, 0, 0, 'root', NULL, NOT EXISTS (SELECT 1 FROM r WHERE r.conv_id = c.conv_id) FROM c),
n AS (SELECT key, any_value(parent) AS parent, any_value(depth) AS depth, any_value(bytes) AS bytes, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends)), sha256('')) AS ends_sha256 FROM p GROUP BY key),
k AS (SELECT parent AS key, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY parent),
u AS (SELECT DISTINCT a.key AS top, b.key AS below FROM p a JOIN p b ON a.conv_id = b.conv_id AND a.depth <= b.depth),
v AS (SELECT u.top AS key, count(*) FILTER (WHERE k.key IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.bytes)::BIGINT AS saved_tokens FROM u JOIN n ON n.key = u.below LEFT JOIN k ON k.key = u.below GROUP BY u.top)
SELECT n.conv_id, n.depth::BIGINT AS depth, m.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, v.n_leaves, v.saved_tokens, n.ends_sha256
FROM n JOIN v USING (key) LEFT JOIN k USING (key) LEFT JOIN n m ON m.key = n.parent
"""
