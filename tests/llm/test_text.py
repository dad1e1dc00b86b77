"""WARC, mixing, neighbours, toxicity, URLs and packing against brute force, round trips and invariants."""

import base64
import gzip
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from folio.llm import mixing, neighbours, packing, toxicity, url_filter, warc
from pyspark.sql import functions as F


def sha1(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


@pytest.fixture(scope="module")
def pages(spark):
    big = "<p>" + "x" * 70_000 + "\r\n\r\nWARC/1.1\r\n" + "</p>"
    rows = [(1, "http://a.com/x", "same"), (2, "http://a.com/y", "same"), (3, None, "other é"), (4, "http://b.org/ \r\n", None), (5, "http://b.org/z", ""), (6, "http://c.net/", big), (7, "http://c.net/2", big)]
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload string")


def test_warc_round_trip(pages):
    manifest, folder = warc.archive_pages(pages, chunk_bytes=1 << 14)
    chunks = warc.read_warc(manifest, folder, chunk_bytes=1 << 14).collect()
    whole = defaultdict(bytes)
    for c in sorted(chunks, key=lambda c: (c["record_id"], c["chunk_no"])):
        whole[c["record_id"]] += bytes(c["chunk"])
        assert len(c["chunk"]) <= 1 << 14
        assert c["digest_so_far"] == sha1(whole[c["record_id"]]) and c["bytes_so_far"] == len(whole[c["record_id"]])
    last = {c["record_id"]: c for c in chunks if c["last"]}
    html = {r["page_id"]: (r["html"] or "").encode() for r in pages.collect()}
    assert {i: (c["record_type"], c["refers_to"]) for i, c in last.items()} == {1: ("revisit", 2), 2: ("response", None), 3: ("response", None), 4: ("revisit", 5), 5: ("response", None), 6: ("revisit", 7), 7: ("response", None)}
    for i, c in last.items():
        assert c["declared_digest"] == sha1(html[i]) and c["declared_bytes"] == len(html[i])
        assert whole[i] == (html[i] if c["record_type"] == "response" else b"")
    assert last[7]["chunk_no"] > 3


def test_warc_files_are_gzip_members(pages):
    manifest, folder = warc.archive_pages(pages)
    names = {r["archive"] for r in manifest.collect()}
    data = b"".join(gzip.open(f"{folder.removeprefix('file://')}/{n}").read() for n in names)
    assert len(re.findall(rb"WARC-Record-ID: <urn:page:\d>", data)) == 7
    assert warc.archive_pages(pages.limit(0))[0].count() == 0


def test_warc_least_bytes(pages):
    kinds = {r["record_id"]: r["record_type"] for r in warc.page_records(pages, least_bytes=1).collect()}
    assert kinds[4] == kinds[5] == "response" and kinds[1] == "revisit"


def targets(sizes, weights=(1, 2, 3), most=3.0):
    """Shares by weight, what exceeds a cap shared anew, step by step."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    got, free, left = dict.fromkeys(names, 0.0), set(names), float(sum(sizes.values()))
    while left > 1e-9 and free:
        total = sum(w[s] for s in free)
        for s in free:
            got[s] += left * w[s] / total
        left = sum(max(0.0, got[s] - most * sizes[s]) for s in names)
        free -= {s for s in names if got[s] >= most * sizes[s]}
        got = {s: min(got[s], most * sizes[s]) for s in names}
    return got


def test_mixing(docs, empty):
    rows = mixing.mix(docs, seed=1).collect()
    source_rows = docs.collect()
    sizes = defaultdict(int)
    for r in source_rows:
        sizes[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    expected = targets(sizes)
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((r["doc_id"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))) for r in source_rows)
    taken = defaultdict(int)
    for r in rows:
        assert r["target"] == pytest.approx(expected[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
        assert abs(r["copies"] - r["target"] / max(1, r["source_size"])) < 1 or r["size"] == 0
        taken[r["source"]] += r["taken"]
    longest = max(r["size"] for r in rows)
    assert all(abs(taken[s] - expected[s]) <= longest for s in sizes)
    again = mixing.mix(docs.repartition(9), seed=1).collect()
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, again), key=repr)
    assert mixing.mix(empty).count() == 0
    # repeated rows share their copies, and none is lost
    more = docs.unionByName(docs.where("doc_id in (3, 12, 40)")).withColumn("doc_id", F.when(F.col("doc_id") < 9, None).otherwise(F.col("doc_id")))
    copies, want = mixing.mix_documents(more), Counter()
    for r in mixing.mix(more).collect():
        want[r["doc_id"]] += r["copies"]
    assert Counter(r["doc_id"] for r in copies.collect()) == +want and copies.columns == docs.columns


def test_mixing_levels_and_expectation(spark):
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "b").otherwise("a").alias("source"), F.repeat(F.lit("w "), (F.col("id") % 7 + 1).cast("int")).alias("text"))
    runs = [mixing.mix(df, seed=s) for s in range(3)]
    for run in runs:
        for r in run.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
            assert abs(r["taken"] - r["target"]) <= 7
    assert runs[0].select("copies", "doc_id").exceptAll(runs[1].select("copies", "doc_id")).count() > 100


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 16)) * rng.uniform(0.5, 2, (1500, 1))
    x[100:160] = x[100]
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    rows += [(5000, None), (5020, [0.0] * 16), (5040, [float("nan")] * 16), (5060, [None] + [1.0] * 15), (5080, [float("inf")] + [1.0] * 15), (5100, [1.0, 2.0]), (None, [1.0] * 16)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_neighbours(vectors):
    got = neighbours.nearest(vectors, F.col("vec_id") % 20 == 0, k=20, leaf=64, share=0.35).collect()
    ids, x = zip(*[(r["vec_id"], np.array(r["embedding"], float)) for r in vectors.collect() if r["vec_id"] is not None and r["vec_id"] < 1500], strict=True)
    ids, x = np.array(ids), np.stack(x)
    by = defaultdict(list)
    for r in got:
        by[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(by) == {i for i in ids if i % 20 == 0}
    hit = 0
    for q, found in by.items():
        s = x @ x[ids == q][0]
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 21)) and q not in [v for _, v, _ in found]
        assert all(score == pytest.approx(s[ids == v][0]) for _, v, score in found)
        assert [(-score, v) for _, v, score in found] == sorted((-score, v) for _, v, score in found)
        order = [v for v in ids[np.lexsort((ids, -s))] if v != q][:20]
        hit += len(set(order) & {v for _, v, _ in found})
    assert hit >= 0.9 * 20 * len(by)
    assert sorted(v for _, v, _ in by[100])[:20] == list(range(101, 121))
    few = neighbours.nearest(vectors.where("vec_id < 6"), F.col("vec_id") == 0).collect()
    assert len(few) == 5
    assert neighbours.nearest(vectors.limit(0), F.lit(True)).count() == 0


def test_decoder():
    words = b" ".join([b"the idiot was a stupid moron and a loser", b"this is that it was the sea and a house", b"trash clown scum"] * 50)
    restorer = toxicity.Restorer(toxicity.character_model(toxicity.gram_counts(words)))
    for disguised, word in (("1d10t", "idiot"), ("st.u.p.i.d", "stupid"), ("m0r0n!!", "moron"), ("looooser", "loser"), ("tr@sh", "trash"), ("cl0wn,", "clown"), ("s c u m", "scum")):
        assert word in restorer.words(disguised), (disguised, restorer.words(disguised))
    assert restorer.words("house") == ["house"] and restorer.words("") == []


def exhaustive(x, model, at=0, state=0, text=""):
    """The least (cost, reading) of all paths through the lattice."""
    if at == len(x):
        return (float(model[state * toxicity.SYMBOLS]) if state % toxicity.SYMBOLS else 0.0), text
    best = None
    for emitted, cost in toxicity.options(x, at):
        if emitted == "" or emitted == " " and state % toxicity.SYMBOLS == 0:
            rest, own = exhaustive(x, model, at + 1, state, text), cost
        else:
            cell = state * toxicity.SYMBOLS + toxicity.symbol(emitted)
            rest, own = exhaustive(x, model, at + 1, cell % toxicity.STATES, text + emitted), cost + float(model[cell])
        if best is None or own + rest[0] < best[0]:
            best = own + rest[0], rest[1]
    return best


def test_decoder_finds_the_likeliest(monkeypatch):
    rng = random.Random(11)
    words = b" ".join(rng.choice([b"idiot", b"stupid", b"loose", b"bad", b"table", b"six", b"letters"]) for _ in range(3000))
    model = toxicity.character_model(toxicity.gram_counts(words))
    tokens = ["".join(rng.choice("abdis01345!*-. |") for _ in range(rng.randint(1, 6))) for _ in range(150)] + ["st*p*d", "1d!0t", "sss", "*", "-"]
    for dense in (toxicity.DENSE, 0):
        monkeypatch.setattr(toxicity, "DENSE", dense)
        for x in tokens:
            if x.count("*") > 2:
                continue
            cost, reading = toxicity.likeliest(x, model)
            best, _ = exhaustive(x, model)
            assert abs(cost - best) < 1e-4, (x, reading)
    assert toxicity.decode("st*p1d", model) == "stupid"
    assert len(toxicity.decode("a1" * 50_000, model)) > 1000


def test_toxicity(spark):
    rng = random.Random(0)
    clean = ["sea", "house", "tree", "river", "stone", "light", "paper", "green", "bread", "music"]
    bad = {"idiot": ["idiot", "1d10t", "i d i o t", "IDIOT!!"], "scum": ["scum", "5cum", "s.c.u.m"]}
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice(clean) for _ in range(20)]
        toxic = i % 4 == 0
        if toxic:
            words[5] = rng.choice(bad[rng.choice(list(bad))])
        rows.append((i, " ".join(words), "x"))
        labels.append((i, int(toxic)))
    rows += [(1000, None, "x"), (1001, "", "x")]
    labels += [(None, 1), (1, None), (77777, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, y string")
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, table).collect()}
    held = [r for r in got.values() if r["held_out"] and r["doc_id"] < 600]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got.values())
    assert sum(r["predicted"] == (r["doc_id"] % 4 == 0) for r in held) >= 0.95 * len(held)
    assert got[1000]["predicted"] == got[1001]["predicted"] == 0 and 0 <= got[1000]["score"] <= 1
    left = toxicity.drop_toxic(docs, table)
    assert left.columns == docs.columns and {1000, 1001} <= {r["doc_id"] for r in left.collect()}
    nothing = toxicity.score_toxicity(docs, table.limit(0)).collect()
    assert len(nothing) == 602 and not any(r["predicted"] for r in nothing)
    assert toxicity.score_toxicity(docs.limit(0), table).count() == 0


def test_urls(spark):
    urls = {1: "http://A.Example.com/en/7x?q", 2: "https://example.com/en/8", 3: "http://x.net/de/1#f", 4: "http://example.net/de/88", 5: "http://notnet/de/", 6: None, 7: "no scheme/en/", 8: "http://host", 9: "http://b.org/es/1", 10: "http://example.com?x/en/"}
    df = spark.createDataFrame(list(urls.items()), "page_id long, url string").withColumn("verdict", F.lit("clash"))
    got = {r["page_id"]: r for r in url_filter.filter_urls(df).collect()}
    assert {i: (r["host"], r["path"], r["rule"]) for i, r in got.items()} == {
        1: ("a.example.com", "/en/7x", "example.com/en/7"), 2: ("example.com", "/en/8", "com/en/"), 3: ("x.net", "/de/1", "net/de/"), 4: ("example.net", "/de/88", "example.net/de/8"), 5: ("notnet", "/de/", None),
        6: ("", "", None), 7: ("", "", None), 8: ("host", "", None), 9: ("b.org", "/es/1", "org/es/"), 10: ("example.com", "", None),
    }
    assert [got[i]["verdict"] for i in (1, 2, 3, 4, 9)] == ["allow", "block", "allow", "block", "block"]
    assert all(r["verdict"] in ("allow", "block") for r in got.values())
    labelled = spark.createDataFrame([(f"win{i}.casino.com", f"/bet/{i}", "block") for i in range(40)] + [(f"news{i}.org", f"/story/{i}", "allow") for i in range(40)], "host string, path string, verdict string")
    test = spark.createDataFrame([(1, "http://win77.casino.com/bet/5"), (2, "http://news78.org/story/9")], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in url_filter.filter_urls(test, [], labelled).collect()} == {1: "block", 2: "allow"}
    assert url_filter.filter_urls(df.limit(0)).count() == 0


def test_tokens_are_those_of_the_tokenizer(rows):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(packing.vocabulary_path())
    tokens = packing.Tokens(packing.vocabulary_path())
    odd = ["a  b", "a   b", " a", "a ", "a \n \nb", "x\n b  \n\n c", "it's  'll", "\t a  b", "<|endoftext|> x", "a <|endoftext|>b<|endoftext|><|endoftext|> \n c", "<|endoftext", " <|endoftext|>", "é\x1c y", "a\x1c\x1d b", "日本 語", "1 23,4"]
    for t in [t or "" for _, t in rows] + odd:
        assert np.frombuffer(tokens.ids(t), "<u4").tolist() == reference.encode(t, add_special_tokens=False).ids + [packing.END_ID]


def test_packing(docs, rows, empty):
    got = packing.pack(docs).collect()
    tokens = packing.Tokens(packing.vocabulary_path())
    pieces = defaultdict(list)
    for r in got:
        pieces[r["sequence_id"]].append(r)
    for seq in pieces.values():
        seq.sort(key=lambda r: r["offset"])
        at = 0
        for r in seq:
            assert r["offset"] == at
            at += r["length"]
        assert at <= packing.LENGTH
    expected = Counter()
    for i, t in rows:
        ids = tokens.ids(t or "")
        for a in range(0, len(ids), 8192):
            part = ids[a : a + 8192]
            expected[i, a // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == expected
    total = sum(r["length"] for r in got)
    assert sum(packing.padded(sum(r["length"] for r in s), packing.LENGTH) for s in pieces.values()) <= 1.1 * total + packing.LENGTH
    assert packing.pack(empty).count() == 0


def test_plan_covers_every_piece():
    rng = random.Random(2)
    for n in (1, 5, 300, 4000):
        lengths = Counter(min(64, int(rng.expovariate(1 / 20)) + 1) for _ in range(n))
        seen, fill = defaultdict(list), Counter()
        for s, lo, hi, first, copies, _ in packing.plan(dict(lengths), 64):
            seen[s].append((lo, hi))
            assert (hi - lo) % copies == 0
            for k in range((hi - lo) // copies):
                fill[first + k] += s * copies
        for s, n_s in lengths.items():
            spans = sorted(seen[s])
            assert spans[0][0] == 0 and spans[-1][1] == n_s and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
        assert max(fill.values()) <= 64
        assert sum(packing.padded(v, 64) for v in fill.values()) <= sum(fill.values()) * (1.02 if n >= 300 else 2) + 64
