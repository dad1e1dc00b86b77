"""Exact, near, passage and byte-string deduplication against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

from folio.llm import exact_dedup, jaccard, mixing, substring_index, suffix_dedup, text, toxicity
from folio.llm.common import components
from pyspark.sql import functions as F

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def test_exact(docs, rows, empty):
    got = exact_dedup.exact_groups(docs).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got) == Counter((i, max(groups[t or ""]), len(groups[t or ""]), i == max(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    assert exact_dedup.exact_groups(empty).count() == 0
    left = exact_dedup.exact_dedup(docs)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(max(g) for g in groups.values())


def test_exact_without_repeated_rows(docs):
    once = docs.dropDuplicates(["doc_id"])
    left = exact_dedup.exact_dedup(once).collect()
    best = {}
    for r in once.collect():
        t = r["text"] or ""
        best[t] = max(best.get(t, -1), r["doc_id"])
    assert sorted(r["doc_id"] for r in left) == sorted(best.values())


def test_exact_hot_group(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    got = {r["doc_id"]: r for r in exact_dedup.exact_groups(df).collect()}
    assert got[0]["keep_id"] == 2997 and got[0]["group_size"] == 1000 and got[1]["group_size"] == 1 and sum(r["kept"] for r in got.values()) == 2001


def shingle_sets(rows):
    out = {}
    for i, t in rows:
        w = WORD.findall((t or "").encode().lower())
        out[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    return out


def linked(sets):
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_near_duplicates(docs, rows, empty):
    sets = shingle_sets(rows)
    expected = linked(sets)
    got = jaccard.near_duplicates(docs).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == Counter((i, len(sets[i]), expected[i]) for i, _ in rows)
    assert jaccard.near_duplicates(empty).count() == 0
    left = jaccard.one_of_each(docs)
    assert left.columns == docs.columns
    assert {r["doc_id"] for r in left.collect()} == set(expected.values())


def test_many_edited_copies(spark, monkeypatch):
    """Copies of one text with a few edits each: pairs are similar or not by the number of edits, and none may be lost; with small
    bounds, so that shingles are many and hot. Beside them, texts that share a line, and rows without a doc_id of their own."""
    rng = random.Random(5)
    monkeypatch.setattr(jaccard, "FEW", 6)
    monkeypatch.setattr(jaccard, "ORDERED", 40)
    words = lambda n: [f"v{rng.randrange(10**7)}" for _ in range(n)]
    base, line, rows = words(100), words(12), []
    for i in range(200):
        edited = list(base)
        for _ in range(rng.randint(0, 7)):
            edited[rng.randrange(100)] = f"x{rng.randrange(60)}"
        rows.append((i, " ".join(edited)))
    rows += [(1000 + i, " ".join(line + words(rng.randint(0, 9)))) for i in range(120)]
    # a chain whose middle has no doc_id, one whose end repeats another's, the largest doc_id, and copies without any
    for chain, ids in ((words(80), (2001, None, 2003)), (words(80), (1005, 2005, 2006)), (words(80), ((1 << 63) - 1, 2008, 2007)), (words(80), (None, None, None))):
        for k, i in enumerate(ids):
            rows.append((i, " ".join(chain[: 80 - 8 * k])))
    rows += [rows[-1], (None, "")]
    expected = linked(shingle_sets(enumerate(t for _, t in rows)))
    groups = defaultdict(list)
    for place, root in expected.items():
        groups[root].append(rows[place][0])
    named = {root: min((i for i in ids if i is not None), default=None) for root, ids in groups.items()}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = jaccard.near_duplicates(df)
    sizes = shingle_sets(enumerate(t for _, t in rows))
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == Counter((rows[p][0], len(sizes[p]), named[root]) for p, root in expected.items())
    left = Counter((r["doc_id"], r["text"]) for r in jaccard.one_of_each(df).collect())
    first = {root: min(((rows[p][0] is None, rows[p][0] or 0, hashlib.sha256(rows[p][1].encode()).hexdigest(), rows[p]) for p, r in expected.items() if r == root), key=lambda x: x[:3])[3] for root in groups}
    assert set(left) == set(first.values())


def test_words_are_hashed_in_parts(monkeypatch):
    texts = [b"one two  three", b"", b" \t", b"x" * 9000 + b" two " + b"one " * 500, b"three"]
    whole, each = text.word_hashes(texts)
    assert each.tolist() == [len(WORD.findall(t)) for t in texts]
    monkeypatch.setattr(text, "PART", 7)
    again, each_again = text.word_hashes(texts)
    assert (whole == again).all() and (each == each_again).all() and whole[0] != whole[1] and whole[0] == whole[5] and whole[2] == whole[-1]


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 200), (200, 150)] + [(300, 300 + k) for k in range(1, 40)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(1, 61)) and got[150] == got[200] == 100 and all(got[300 + k] == 300 for k in range(40))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def without_repeats(rows):
    seen, out = {}, {}
    for i, t in sorted(set(rows), key=lambda r: r[0]):
        words = WORD.findall((t or "").encode())
        gone = [False] * len(words)
        for j in range(len(words) - 19):
            key = tuple(words[j : j + 20])
            if key in seen:
                gone[j : j + 20] = [True] * 20
            else:
                seen[key] = i
        out[i] = (len(words), sum(gone), b" ".join(w for w, g in zip(words, gone, strict=True) if not g))
    return out


def test_passages(docs, rows, empty):
    expected = without_repeats(rows)
    for batches in (1, 3):
        got = substring_index.remove_repeats(docs, batches).collect()
        assert len(got) == len(rows)
        assert {(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == {(i, n, k, hashlib.sha256(b).hexdigest()) for i, (n, k, b) in expected.items()}
    texts = {r["doc_id"]: r["kept_text"] for r in substring_index.remove_repeats(docs, with_text=True).collect()}
    assert texts == {i: b.decode() for i, (_, _, b) in expected.items()}
    assert substring_index.remove_repeats(empty).count() == 0


def test_index_compacts(spark):
    rows = [(i, " ".join(f"{'same' if i % 2 else i}{j}" for j in range(40))) for i in range(8)]
    index = substring_index.FingerprintIndex(spark, fan_in=2)
    texts = spark.createDataFrame(rows, "id long, text string")
    removed = {}
    for i in range(8):
        cut = substring_index.dedup_batch(index, texts.where(f"id = {i}"), texts.where(f"id <= {i}"))
        removed |= {r["id"]: r["n_removed"] for r in cut.collect()}
    assert removed == {3: 40, 5: 40, 7: 40}
    assert [len(level) for level in index.levels] == [0, 0, 0, 1]


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(500):
        s = [rng.randint(0, rng.choice([1, 2, 5])) for _ in range(rng.randint(0, 50))]
        assert suffix_dedup.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])
    for s in ([1] * 300, [1, 2, 3] * 100, list(range(300)), list(range(300, 0, -1))):
        assert suffix_dedup.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def test_byte_strings(docs, rows, empty):
    count = Counter()
    for _, t in rows:
        b = (t or "").encode()
        count.update(b[j : j + 200] for j in range(len(b) - 199))
    expected = Counter()
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - 199):
            if count[b[j : j + 200]] > 1:
                gone[j : j + 200] = b"\1" * 200
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        expected[i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()] += 1
    got = suffix_dedup.remove_repeated_bytes(docs).collect()
    assert Counter(tuple(r) for r in got) == expected
    assert suffix_dedup.remove_repeated_bytes(empty).count() == 0
    kept = suffix_dedup.remove_repeated_bytes(docs, with_bytes=True).collect()
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in kept)


def removed_bytes(texts):
    """(n_removed, n_spans, sha256 of the rest) of each text."""
    count = Counter(t[j : j + 200] for t in texts for j in range(len(t) - 199))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for j in range(len(t) - 199):
            if count[t[j : j + 200]] > 1:
                gone[j : j + 200] = b"\1" * 200
        out.append((sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return out


def test_bytes_around_a_frequent_passage(spark, monkeypatch):
    """Each document's own bytes around a passage make as many strings of one gram as documents; they may not meet in one group."""
    rng = random.Random(8)
    letters = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    passage, before = letters(240), [letters(60) for _ in range(20)]
    # some pairs share what stands before the passage too; some hold a part of it that is long enough, or is not
    texts = [(before[i % 20] if i % 5 == 0 else letters(60)) + (passage if i % 7 else passage[: rng.randint(150, 230)]) + letters(60) for i in range(240)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(suffix_dedup, "MOST_RUNS", 20)
    seen = []
    small_groups = suffix_dedup.small_groups
    monkeypatch.setattr(suffix_dedup, "small_groups", lambda runs: seen.append((runs, small_groups(runs))) or seen[-1][1])
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeated_bytes(df).collect()}
    assert got == dict(enumerate(removed_bytes([t.encode() for t in texts])))
    most = [d.where("h is not null").groupBy("h").count().agg(F.max("count")).first()[0] for d in seen[0]]
    assert most[0] > 100 and most[1] <= 20


def test_words_around_a_frequent_phrase(spark, monkeypatch):
    """Each document's own words around a phrase make as many runs of one fingerprint as documents; they may not meet in one group."""
    rng = random.Random(9)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    phrase, before = words(26), [words(12) for _ in range(20)]
    texts = [" ".join([before[i % 20] if i % 5 == 0 else words(12), phrase if i % 7 else " ".join(phrase.split()[: rng.randint(9, 25)]), words(12)]) for i in range(240)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(substring_index, "MOST_RUNS", 20)
    seen = []
    small_groups = substring_index.small_groups
    monkeypatch.setattr(substring_index, "small_groups", lambda runs: seen.append((runs, small_groups(runs))) or seen[-1][1])
    expected = without_repeats(rows)
    got = substring_index.remove_repeats(df).collect()
    assert {(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == {(i, n, k, hashlib.sha256(b).hexdigest()) for i, (n, k, b) in expected.items()}
    most = [max(d.where("h is not null").groupBy("h").count().agg(F.max("count")).first()[0] or 0 for d in side) for side in ([r for r, _ in seen], [g for _, (g, _) in seen])]
    assert most[0] > 50 and most[1] <= 20


def test_documents_without_an_id_of_their_own(spark):
    """Texts with a null or repeated doc_id neither share what they lose nor hide each other's repeats."""
    rng = random.Random(10)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    a, b, c, whole = words(40), words(40), words(40), words(60)
    texts = [(1, f"{words(9)} {a} {words(5)}"), (2, whole), (3, f"{c} {words(30)}"), (7, whole), (7, f"{words(30)} {c}"), (7, words(90)), (8, f"{words(3)} {a}"), (8, f"{words(50)} {words(50)}")]
    texts += [(None, f"{b} {words(20)}"), (None, f"{b} {words(30)}"), (None, f"{words(10)} {a}"), (None, words(80)), (None, whole)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = suffix_dedup.remove_repeated_bytes(df).collect()
    expected = Counter((i, len(t), *r) for (i, t), r in zip(texts, removed_bytes([t.encode() for _, t in texts]), strict=True))
    assert Counter(tuple(r) for r in got) == expected
    order = sorted(texts, key=lambda r: (r[0] is None, r[0] or 0, hashlib.sha256(r[1].encode()).hexdigest()))
    cut = without_repeats([(place, t) for place, (_, t) in enumerate(order)])
    expected = Counter((order[place][0], n, k, hashlib.sha256(rest).hexdigest()) for place, (n, k, rest) in cut.items())
    for batches in (1, 2):
        assert Counter(tuple(r) for r in substring_index.remove_repeats(df, batches).collect()) == expected


#: Two words of one length that a sum of bytes times powers of a public base takes for one.
ALIKE = "mmmmmmmmmmmmmmmmmmmm", "jnrerjnpsmjmpolnhimm"


def test_words_made_to_collide(spark):
    a, b = ALIKE
    docs = spark.createDataFrame([(1, " ".join([a] * 6)), (2, " ".join([b] * 6)), (3, " ".join(f"w{i}" for i in range(23)) + f" {a}"), (4, " ".join(f"w{i}" for i in range(3)) + f" {b} " + " ".join(f"v{i}" for i in range(3, 23)))], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(docs).collect()} == {i: i for i in (1, 2, 3, 4)}
    swapped = spark.createDataFrame([(1, " ".join([a, b] * 12)), (2, " ".join([b, b] * 12))], "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in substring_index.remove_repeats(swapped).collect()}
    assert got == {1: 22, 2: 23}  # only what each repeats of itself


def test_word_hashes_under_keys():
    words = sorted({bytes(x) for n in (1, 2, 7, 8, 9, 15, 16, 17, 63, 64, 65, 70) for x in ([97] * n, [98] + [97] * (n - 1), [97] * (n - 1) + [98], [97] * (n // 2) + [99] + [97] * (n - n // 2 - 1))})
    seen = set()
    for key in (0, 1, text.new_key()):
        h, _ = text.word_hashes([b" ".join(words)], key)
        again, _ = text.word_hashes([b"\n".join(words[:5]), b" \t ".join(words[5:])], key)
        assert len(set(h.tolist())) == len(words) and (h == again).all()
        seen |= set(h.tolist())
    assert len(seen) == 3 * len(words)


def test_index_leaves_no_tables(spark, docs):
    tables = lambda: {r["tableName"] for r in spark.sql("SHOW TABLES").collect()}
    before = tables()
    substring_index.remove_repeats(docs).count()
    assert tables() == before


def test_columns_of_the_stages_own_names(spark, docs):
    """Columns named like those that the stages add come back as they were."""
    named = docs.select("*", *[F.lit(f"own{i}").alias(c) for i, c in enumerate(("_id", "_digest", "_score", "_n", "_copies", "_ROWS", "__id"))])
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    for out in (exact_dedup.exact_dedup(named), jaccard.one_of_each(named), mixing.mix_documents(named), toxicity.drop_toxic(named, labels)):
        assert out.columns == named.columns
        kept = out.select(*named.columns[-7:]).distinct().collect()
        assert [tuple(r) for r in kept] == [tuple(f"own{i}" for i in range(7))]
