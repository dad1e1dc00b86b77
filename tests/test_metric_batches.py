"""Distances and word error rates of many pairs at once, beside whole tables."""

import random

import pytest
from test_metrics import plain

from folio.functions import metrics


def copies(rng, n, sizes):
    for _ in range(n):
        a = "".join(rng.choice("abcdefghijé😀 ") for _ in range(rng.choice(sizes)))
        b = list(a)
        for _ in range(rng.choice([1, 3, 9])):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randint(0, 1)] = rng.choice(["", "z", "ab", " "])
        yield "".join(b), a


def test_narrow_bands_leave_no_whole_tables(monkeypatch):
    """Noisy copies go through the band alone, and their distances are those of the whole table."""
    monkeypatch.setattr(metrics, "TOGETHER", 1)
    pairs = [(f"<{b}>", f"[{a}]") for b, a in copies(random.Random(5), 25, [380, 400, 450])]  # nothing is shared at either end
    want = [plain(*p) for p in pairs]
    for name in ("sequence_distance", "_columns"):
        monkeypatch.setattr(metrics, name, lambda *_: pytest.fail("whole table"))
    assert metrics.text_distances(pairs) == want


def test_lines_with_digits_for_letters_need_no_table(monkeypatch):
    truths = ["look, a pool\tof oil", "l", "  oo  ", "Löwe 😀 lol", "none"] * 3
    pairs = [(t.translate(str.maketrans("lo", "10")), t) for t in truths]
    want = [(plain(*p), plain(p[0].split(), p[1].split()) / len(p[1].split())) for p in pairs]
    for name in ("sequence_distance", "_columns", "_band", "bounds"):
        monkeypatch.setattr(metrics, name, lambda *_: pytest.fail("not together"))
    assert list(zip(metrics.text_distances(pairs), metrics.word_rates(pairs), strict=True)) == want


def test_word_rates(monkeypatch):
    monkeypatch.setattr(metrics, "_PAIRS", 50)
    rng = random.Random(6)
    pairs = [None, ("", ""), (" ", "\t"), ("a", " "), (" ", "a"), ("a b", "b a"), ("ab", "a "), ("a ", "ab"), ("x　y", "z y"), ("a\x1cb", "a b")]
    for k in range(600):
        t = "".join(rng.choice("abé \t😀") for _ in range(rng.choice([0, 1, 2, 5, 12, 30])))
        pairs.append(("".join(rng.choice("ab é") if rng.random() < 0.15 or k % 4 == 0 else c for c in t), t))
    rate = lambda p, t: (1.0 if p else 0.0) if not t else plain(p, t) / len(t)
    assert metrics.word_rates(pairs) == [None if p is None else rate(p[0].split(), p[1].split()) for p in pairs]
