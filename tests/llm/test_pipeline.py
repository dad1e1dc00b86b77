"""The stages of the pipeline, each against its own input, on the smallest tables."""

import re
from collections import Counter

import corpus_pipeline
from folio.llm import mixing, packing, toxicity
from folio.llm.common import stored

DIR = "/root/testdata/sf0.001"


WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def sum_by_source(rows):
    out = Counter()
    for source, n in rows:
        out[source] += n
    return dict(out)


def one_of_each(texts):
    """The smallest id of each component of documents whose sets of shingles are 75 % alike, by comparing all; those without words stay."""
    sets = {}
    for i, t in texts.items():
        w = WORD.findall((t or "").encode().lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return sorted(i for i in sets if not sets[i] or top(i) == i)


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, DIR), "test")
        seen[name] = (before, docs)
        if name != "packing":
            assert docs.columns == before.columns
    before, after = seen["toxicity"]
    scores = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(before, labels).collect()}
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(i for i, x in scores.items() if x < 0.5)
    before, after = seen["exact dedup"]
    best = {}
    for r in before.collect():
        best[r["text"]] = max(best.get(r["text"], -1), r["doc_id"])
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(best.values())
    before, after = seen["n-gram Jaccard join"]
    assert sorted(r["doc_id"] for r in after.collect()) == one_of_each({r["doc_id"]: r["text"] for r in before.collect()})
    before, after = seen["mixing"]
    assert max(Counter(r["doc_id"] for r in after.collect()).values()) <= 3
    words = lambda df: sum_by_source((r["source"], len(WORD.findall((r["text"] or "").encode()))) for r in df.collect())
    targets = {r["source"]: r["target"] for r in mixing.mix(before).select("source", "target").distinct().collect()}
    taken, there = words(after), words(before)
    longest = max(len(WORD.findall((r["text"] or "").encode())) for r in before.collect())
    assert all(abs(taken.get(s, 0) - t) <= longest for s, t in targets.items()) and targets.keys() == there.keys()
    before, after = seen["packing"]
    tokens = packing.Tokens(packing.vocabulary_path())
    assert sum(r["length"] for r in after.collect()) == sum(len(tokens.ids(r["text"] or "")) // 4 for r in before.collect())


def test_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))
