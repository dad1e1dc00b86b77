"""The model of the URL filter against a plain loop, on its labelled table and through the query."""

import math

import numpy as np
import pytest

from folio.llm import queries, url_filter


def grams(url):
    """The n-grams of a url by their dimension, the hash worked one number at a time."""
    found = set()
    for n in range(url_filter.SHORTEST, url_filter.LONGEST + 1):
        for i in range(len(url) - n + 1):
            h = n
            for byte in url[i : i + n]:
                h = (h ^ byte) * 0x100000001B3 % (1 << 64)
                h ^= h >> 29
            found.add(h % url_filter.DIMENSIONS)
    return found


def plain_fit(urls, labels, rounds, rate=0.5, l2=1e-4):
    at = [grams(u) for u in urls]
    w, b, seen, seen_b = dict.fromkeys(set().union(*at), 0.0), 0.0, {}, 1e-8
    for _ in range(rounds):
        g, gb = {d: l2 * v for d, v in w.items()}, 0.0
        for own, y in zip(at, labels, strict=True):
            x = 1 / math.sqrt(len(own))
            e = (1 / (1 + math.exp(-(sum(w[d] for d in own) * x + b))) - y) / len(urls)
            gb += e
            for d in own:
                g[d] += e * x
        for d, v in g.items():
            seen[d] = seen.get(d, 1e-8) + v * v
            w[d] -= rate * v / math.sqrt(seen[d])
        seen_b += gb * gb
        b -= rate * gb / math.sqrt(seen_b)
    return w, b


def table():
    rows = url_filter.labelled_urls()
    return url_filter.joined([h.encode() for h, _, _ in rows], [p.encode() for _, p, _ in rows]), np.array([v == "block" for _, _, v in rows], float)


def test_fit_is_that_of_a_plain_loop():
    urls, labels = table()
    urls, labels = [*urls[:12], *urls[-12:], b"", b"^a$"], np.array([*labels[:12], *labels[-12:], 0, 1])
    urls = [u for u in urls if len(u) >= url_filter.SHORTEST]
    labels = labels[: len(urls)]
    w, b = url_filter.fit(urls, labels, rounds=15)
    want, want_b = plain_fit(urls, labels.tolist(), 15)
    assert b == pytest.approx(want_b, abs=1e-9) and all(w[d] == pytest.approx(v, abs=1e-9) for d, v in want.items())
    assert set(np.nonzero(w)[0].tolist()) <= set(want)
    for u, p in zip(urls, url_filter.predict(urls, w, b), strict=True):
        own = grams(u)
        assert p == pytest.approx(1 / (1 + math.exp(-(sum(want[d] for d in own) / math.sqrt(len(own)) + want_b))), abs=1e-9)


def test_held_out_urls():
    """Every fifth URL is left out in turn: most are told apart by what the others teach."""
    urls, labels = table()
    right = 0
    for k in range(5):
        held = np.arange(len(urls)) % 5 == k
        w, b = url_filter.fit([u for u, h in zip(urls, held, strict=True) if not h], labels[~held])
        right += int(((url_filter.predict([u for u, h in zip(urls, held, strict=True) if h], w, b) >= 0.5) == labels[held]).sum())
    assert len(urls) == 70 and right >= 0.8 * len(urls)


def test_query(spark):
    """Rules by a plain loop, all other verdicts by the fitted model, over a whole table."""
    sf = "/root/testdata/sf0.001"
    w, b = url_filter.fit(*table())
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r["page_id"]: r for r in queries.queries()["op9_url_filter"](spark, sf).collect()}
    assert got.keys() == urls.keys()
    for i, url in urls.items():
        rest = url.partition("://")[2] if "://" in (url or "") else ""
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, path = rest[:cut].lower(), rest[cut:].partition("#")[0].partition("?")[0]
        fits = [(len(r), r, v) for v, r in url_filter.RULES if (host == (of := r.partition("/")[0]) or host.endswith("." + of)) and path.startswith("/" + r.partition("/")[2])]
        verdict = max(fits)[2] if fits else "block" if url_filter.predict(url_filter.joined([host.encode()], [path.encode()]), w, b)[0] >= 0.5 else "allow"
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, max(fits)[1] if fits else None, verdict)
