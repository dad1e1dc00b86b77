"""Prefix trie, best-fit packing and ranked search against plain loops over small tables."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.llm import best_fit, prefix_trie, queries, ranked

# ---- prefix trie


@pytest.fixture(scope="module")
def conversations(spark):
    """Copies, shared first turns, nulls, missing bases, one long conversation and its branches, repeated turns and rows, an extra column."""
    rng, rows = random.Random(5), []
    for c in range(60):
        for t in range(rng.randint(1, 7)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"shared {t}" if rng.random() < 0.7 else f"own {c} ü"))
    for c in (100, 101, 103):
        rows += [(c, t, "user", f"long {t}" if t < 30 or c == 100 else f"branch {c}") for t in range(45)]
    rows += [(203, None, None, None), (203, None, "b", ""), (203, 1, "user", None), (-7, 0, "x", "yé"), (-7, 0, "x", "yé"), (None, 1, "a", "b"), (205, 0, "u", ""), (206, 3, "u", "x" * 5000)]
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "conv_id long, turn long, role string, text string, depth int").repartition(3).persist()


def trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        paths[c] = tuple(own.get(base, [])[:h] + turns[h:])
    nodes = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            nodes[p[:d]].append(c)
    children = defaultdict(set)
    for p in nodes:
        if p:
            children[p[:-1]].add(p)

    def sums(p):
        below = [sums(k) for k in children[p]]
        own_bytes = (len(nodes[p]) - 1) * len(p[-1][1].encode()) if p else 0
        return sum(b[0] for b in below) or 1, sum(b[1] for b in below) + own_bytes

    out = []
    for p, members in nodes.items():
        leaves, saved = sums(p)
        ends = ",".join(map(str, sorted(c for c in members if paths[c] == p)))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(children[p]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("first_base", "most_turns"), [(4, 1_000_000), (1, 6), (32, 1_000_000), (2, 60)])
def test_trie(conversations, first_base, most_turns):
    got = prefix_trie.conversation_trie(conversations, first_base, most_turns).collect()
    assert sorted(map(tuple, got), key=repr) == trie([tuple(r)[:4] for r in conversations.collect()])


def test_trie_of_nothing(conversations):
    assert prefix_trie.conversation_trie(conversations.limit(0)).count() == 0
    assert prefix_trie.conversation_trie(conversations.where("conv_id is null")).count() == 0


def test_list_digests_of_many_rows(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "IDS_A_ROW", 7)
    members = spark.range(-20, 500).select(F.when(F.col("id") % 3 == 0, F.lit(bytearray(b"a"))).otherwise(F.lit(bytearray(b"b"))).alias("key"), F.col("id").alias("conv_id"))
    want = {k: hashlib.sha256(",".join(str(i) for i in range(-20, 500) if (i % 3 == 0) == (k == b"a")).encode()).hexdigest() for k in (b"a", b"b")}
    assert {bytes(r["key"]): r["ends_sha256"] for r in prefix_trie._list_digests(members).collect()} == want


# ---- best-fit packing


def test_word_tokens():
    tokens, rng = best_fit.Tokens(best_fit.vocabulary_path()), random.Random(2)
    whole = tokens.whole
    letters = "abcdefghijklmnopqrstuvwxyzABCÀÉßñöÿıİ0123456789'’.,;!?<|>-_ \t\n\x0b\x85\xa0 中е́Σς😀\x1c"
    for text in ["", " ", "<|endoftext|>don't<|startoftext|> x", "I'LL", "ÅÅ", *("".join(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(1500))]:
        assert np.frombuffer(tokens.ids(text), "<u4").tolist() == [*whole.encode(text, add_special_tokens=False).ids, 0], text


def test_open_bins():
    bins = best_fit.OpenBins(10, 2)
    assert [bins.add(s) for s in (6, 7)] == [(0, 0), (1, 0)]
    assert bins.add(3) == (1, 7)  # the least room that takes it; full, so it closes
    assert bins.add(8) == (2, 0)
    assert bins.add(9) == (3, 0)  # both are open: the fullest, 2, closes
    assert bins.add(2) == (0, 6) and bins.add(2) == (0, 8)
    assert bins.open() == [(3, 9)] and bins.n == 1
    rng = random.Random(1)
    bins, fills, alive = best_fit.OpenBins(50, 5), {}, []
    for _ in range(3000):
        size = rng.randint(1, 50)
        fits = [b for b in alive if 50 - fills[b] >= size]
        b, offset = bins.add(size)
        if fits:
            assert b in fits and fills[b] == max(fills[x] for x in fits) == offset
        else:
            if len(alive) == 5:
                fullest = max(fills[x] for x in alive)
                gone = [x for x in alive if x not in {i for i, _ in bins.open()} and x != b]
                assert [fills[x] for x in gone] == [fullest]
                alive.remove(gone[0])
            assert offset == 0
            alive.append(b)
        fills[b] = offset + size
        alive = [x for x in alive if fills[x] < 50]
        assert sorted(alive) == sorted(i for i, _ in bins.open())


def checked(got, docs, length):
    tokens = best_fit.Tokens(best_fit.vocabulary_path())
    want = Counter()
    for doc_id, text in docs:
        ids = np.frombuffer(tokens.ids(text or ""), "<u4")
        for k, at in enumerate(range(0, len(ids), length)):
            part = ids[at : at + length]
            want[doc_id, k, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= length
    return len(by), sum(r["length"] for r in got)


@pytest.mark.parametrize(("length", "open_bins", "run", "stream"), [(2048, 4096, 4096, 1 << 17), (64, 4, 16, 10), (256, 8, 16, 20)])
def test_best_fit(docs, rows, length, open_bins, run, stream):
    more = docs.unionByName(docs.limit(30).withColumn("doc_id", F.lit(None).cast("long")))
    got = best_fit.pack_best_fit(more, length=length, open_bins=open_bins, run=run, stream=stream).collect()
    sequences, tokens = checked(got, [(r["doc_id"], r["text"]) for r in more.select("doc_id", "text").collect()], length)
    if length == 2048:
        assert sequences <= 1.02 * tokens / length + 1


def test_best_fit_query_and_empty(spark, empty):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sequences, tokens = checked(queries.op12_best_fit(spark, sf).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()], 2048)
    assert sequences <= 1.02 * tokens / 2048 + 1
    assert best_fit.pack_best_fit(empty).count() == 0


# ---- ranked search


def ranking(docs, items, most):
    words = lambda t: [w.decode() for w in ranked.terms_of((t or "").encode())]
    there = [(i, Counter(words(t))) for i, t in docs if words(t)]
    n, length = len(there), sum(sum(c.values()) for _, c in there)
    df = Counter(w for _, c in there for w in c)
    out = []
    for item, text in items:
        scores = []
        for doc_id, c in there:
            m = 25 + 75 * sum(c.values()) * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 8 * m)) for w in words(text) if w in c)
            if score > 0:
                scores.append((-score, doc_id is None, doc_id))
        out += [(item, k + 1, d, -s) for k, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:most])]
    return sorted(out, key=repr)


def test_terms():
    assert ranked.terms_of("Ünder_Score it's A1-b2 c".encode()) == ["Ünder".encode(), b"score", b"it", b"s", b"a1", "b2 c".encode()]


@pytest.mark.parametrize(("shard", "block_terms"), [(8192, 1 << 18), (7, 40), (30, 1)])
def test_ranked_search(spark, docs, rows, shard, block_terms):
    more = docs.unionByName(docs.limit(9).withColumn("doc_id", F.lit(None).cast("long")))
    items = [(i, t) for i, t in rows if i in (1, 2, 6, 60)] + [(7, None), (8, "?!"), (9, "one one two"), (10, "LOOP loop"), (11, "unseen")]
    got = ranked.ranked_search(more, spark.createDataFrame(items, "item_id long, text string"), block_terms=block_terms, shard=shard).collect()
    assert sorted(map(tuple, got), key=repr) == ranking([(r["doc_id"], r["text"]) for r in more.select("doc_id", "text").collect()], items, 10)


def test_intervals_are_pruned():
    """On documents of which few hold an item's terms, most are never scored, and the best are those of a full scan."""
    rng = np.random.default_rng(4)
    n_docs, n_terms = 4000, 300
    sizes = rng.integers(5, 30, n_docs)
    terms = np.concatenate([np.sort(rng.choice(n_terms, s, replace=False, p=(w := 1 / np.arange(1, n_terms + 1)) / w.sum())) for s in sizes])
    tfs = rng.integers(1, 5, len(terms))
    n = sizes + rng.integers(0, 200, n_docs)
    index = ranked.Shard(list(range(n_docs)), n, sizes, terms, tfs, (n_docs, int(n.sum())), n_terms)
    starts = np.cumsum(sizes) - sizes
    for _ in range(10):
        query = rng.choice(np.arange(100, n_terms), 6, replace=False)
        weights = rng.integers(1000, 9000, 6)
        of = dict(zip(query.tolist(), weights.tolist(), strict=True))
        top = ranked.Top(10)
        scored, _ = index.search(query, weights, top)
        m = 25 + 75 * n * n_docs // n.sum()
        full = sorted((-sum(of.get(int(terms[j]), 0) * int(1_000_000_000 * tfs[j] // (1000 * tfs[j] + 8 * m[d])) for j in range(starts[d], starts[d] + sizes[d])), d) for d in range(n_docs))
        assert sorted(top.rows(), key=lambda x: (-x[1], x[0])) == [(d, -s) for s, d in full[:10]]
        assert scored < 0.5 * n_docs


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op13_ranked_search"])
def test_sql(spark, name):
    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    found = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    want = [tuple(r) for r in found.fetchall()]
    got = [tuple(r[c] for c in columns) for r in queries.queries()[name](spark, sf).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("of", ["docs", "items"])
def test_ranked_search_of_nothing(spark, docs, empty, of):
    items = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert ranked.ranked_search(empty if of == "docs" else docs, items if of == "docs" else items.limit(0)).count() == 0
