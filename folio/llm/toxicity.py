"""Toxicity of whole texts: a noisy-channel decoder undoes disguises, then the restored words are scored."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import free_names, stored, with_ids
from .text import portions

# The character model: symbol 0 is a word's end, 1 to 26 are a to z, 27 is any other letter.
SYMBOLS, ORDER, OTHER = 28, 4, 27
CELLS, STATES = SYMBOLS**ORDER, SYMBOLS ** (ORDER - 1)
#: Cells of the count table that travel in one row.
BLOCK = 4096

#: Letters that a disguise may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i"}
#: Marks that may be put between letters.
BETWEEN = " -._*~"
#: Costs (negative log probabilities) of the channel.
AS_LETTER, AS_END, DROP_MARK, KEEP_MARK, DROP_REPEAT, DROP_THIRD, ANY_LETTER = 0.7, 3.0, 1.0, 0.7, 4.0, 0.3, 4.0
#: States from which a step is taken on arrays.
DENSE = 400

DECORATION = ".,;:|!?*#$%&\"'()[]{}<>«»…-_=+~/\\"
DISGUISED = re.compile(r"[0-9@$!|+(€£¡]|(.)\1\1|\w[-._*~]+\w")
SPACED = re.compile(r"(?:(?<=\s)|^)[^\s\x00-\x20](?:[ \t]+[^\s\x00-\x20]){2,}(?=\s|$)")

#: Labelled rows that the classifier is fitted on, at most (the smallest by a hash of doc_id), and words it weighs.
MOST_LABELLED, MOST_WORDS = 20_000, 1024

_CODES = np.full(256, OTHER, np.int32)
_CODES[:128] = 0
_CODES[65:91] = _CODES[97:123] = np.arange(1, 27)


def gram_counts(data: bytes) -> np.ndarray:
    """Counts of each sequence of ORDER symbols in a text of words, each ended by symbol 0."""
    codes = _CODES[np.frombuffer(b"\n" * (ORDER - 1) + data + b"\n", np.uint8)]
    # a letter of several bytes is one symbol; several ends are one end
    keep = np.ones(len(codes), bool)
    raw = np.frombuffer(b"\n" * (ORDER - 1) + data + b"\n", np.uint8)
    keep[(raw & 0xC0) == 0x80] = False
    keep[ORDER:] &= ~((codes[ORDER:] == 0) & (codes[ORDER - 1 : -1] == 0))
    codes = codes[keep]
    at = np.zeros(len(codes) - ORDER + 1, np.int32)
    for j in range(ORDER):
        at = at * SYMBOLS + codes[j : len(codes) - ORDER + 1 + j]
    return np.bincount(at, minlength=CELLS)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(CELLS, np.int64)
    for batch in batches:
        for _, part in portions(batch.column(0)):
            total += gram_counts(b"\n".join(part))
    full = [b for b in range(0, CELLS, BLOCK) if total[b : b + BLOCK].any()]
    yield pa.RecordBatch.from_arrays([pa.array([b // BLOCK for b in full], pa.int32()), pa.array([total[b : b + BLOCK].tobytes() for b in full], pa.binary())], names=["block", "counts"])


def _add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for b, c in zip(batch["block"], batch["counts"], strict=True):
            c = np.frombuffer(c, np.int64)
            sums[b] = sums[b] + c if b in sums else c
    yield pd.DataFrame({"block": pd.Series(list(sums), dtype="int32"), "counts": [c.tobytes() for c in sums.values()]})


def character_counts(docs: DataFrame) -> np.ndarray:
    """Counts of all ORDER-grams of characters over every text of docs: CELLS figures, whatever docs' size.

    Each task counts its texts into one table; the tables are added block by block (a task holds the sums of its blocks).
    """
    parts = docs.select("text").mapInArrow(_count, "block int, counts binary")
    total = np.zeros(CELLS, np.int64)
    for r in parts.repartition("block").mapInPandas(_add, "block int, counts binary").collect():
        c = np.frombuffer(r["counts"], np.int64)
        total[r["block"] * BLOCK : r["block"] * BLOCK + len(c)] += c
    return total


def character_model(counts: np.ndarray) -> np.ndarray:
    """-log P(symbol | the ORDER - 1 before it), shorter contexts mixed in by Witten-Bell weights; float32 of CELLS."""
    p = np.full(SYMBOLS, 1 / SYMBOLS)
    for order in range(1, ORDER + 1):
        c = counts.reshape(SYMBOLS ** (ORDER - order), SYMBOLS**order).sum(0).reshape(-1, SYMBOLS).astype(float)
        n, kinds = c.sum(1, keepdims=True), (c > 0).sum(1, keepdims=True)
        w = np.where(n > 0, n / (n + np.maximum(kinds, 1)), 0)
        shorter = p.reshape(-1, SYMBOLS) if order > 1 else p.reshape(1, SYMBOLS)
        p = w * c / np.maximum(n, 1) + (1 - w) * np.tile(shorter, (len(c) // len(shorter), 1))
    return -np.log(np.maximum(p, 1e-12)).astype(np.float32).ravel()


def options(x: str, at: int) -> list[tuple[str, float]]:
    """What the characters x[at] may stand for: (letters emitted, cost); " " ends a word."""
    c = x[at]
    before = x[at - 1] if at else ""
    if c in LEET:
        out = [(letter, AS_LETTER) for letter in LEET[c]] + [(" ", AS_END)]
        if c == before:
            out.append(("", DROP_REPEAT if x[at - 2 : at] != c * 2 else DROP_THIRD))
        return out
    if c in BETWEEN:
        return [("", DROP_MARK), (" ", KEEP_MARK)] + ([(chr(k), ANY_LETTER) for k in range(97, 123)] if c == "*" else [])
    if not c.isalpha():
        return [(" ", 0.0)]
    out = [(c, 0.0)]
    if c == before:
        run = 1
        while at - run >= 0 and x[at - run] == c or x[at : at + run + 1] == c * (run + 1):
            run += 1
            if run > 2:
                break
        out.append(("", DROP_THIRD if run > 2 else DROP_REPEAT))
    return out


def symbol(c: str) -> int:
    return 0 if c == " " else ord(c) - 96 if "a" <= c <= "z" else OTHER


def _step(states: dict[int, tuple], x: str, at: int, model: np.ndarray) -> dict[int, tuple]:
    """One character further: each state's cheapest (cost, (before, letters)); the letters of a reading are linked backwards."""
    nxt: dict[int, tuple] = {}
    for emitted, cost in options(x, at):
        for state, (sum_, out) in states.items():
            if emitted == "" or emitted == " " and state % SYMBOLS == 0:
                new, total, text = state, sum_ + cost, out
            else:
                cell = state * SYMBOLS + symbol(emitted)
                new, total, text = cell % STATES, sum_ + cost + float(model[cell]), (out, emitted)
            if new not in nxt or total < nxt[new][0]:
                nxt[new] = (total, text)
    return nxt


def _dense_step(states: dict[int, tuple], x: str, at: int, model: np.ndarray) -> dict[int, tuple]:
    """The same for very many states: a table of all states' costs; for each letter the cheapest of those that differ in their oldest symbol."""
    costs = np.full(STATES, np.inf)
    costs[list(states)] = [s[0] for s in states.values()]
    best, came, letter = np.full(STATES, np.inf), np.zeros(STATES, np.int64), [""] * STATES
    table, old = costs.reshape(SYMBOLS, -1), model.reshape(SYMBOLS, STATES // SYMBOLS, SYMBOLS)
    for emitted, cost in options(x, at):
        if emitted in ("", " "):
            stays = np.arange(STATES) if emitted == "" else np.arange(0, STATES, SYMBOLS)
            for i in stays[costs[stays] + cost < best[stays]].tolist():
                best[i], came[i], letter[i] = costs[i] + cost, i, ""
            if emitted == "":
                continue
        k = symbol(emitted)
        sums = table + old[:, :, k]
        if emitted == " ":
            sums[:, ::SYMBOLS] = np.inf  # an end after an end stays
        first = sums.argmin(0)
        total = sums[first, np.arange(sums.shape[1])] + cost
        for tail in np.nonzero(total < best.reshape(-1, SYMBOLS)[:, k])[0].tolist():
            i = tail * SYMBOLS + k
            best[i], came[i], letter[i] = total[tail], first[tail] * (STATES // SYMBOLS) + tail, emitted
    out = {}
    for i in np.nonzero(np.isfinite(best))[0].tolist():
        text = states[int(came[i])][1]
        out[i] = (float(best[i]), (text, letter[i]) if letter[i] else text)
    return out


def likeliest(x: str, model: np.ndarray) -> tuple[float, str]:
    """(cost, reading) of a lower-case string: Viterbi over the whole lattice of its options under the character model. A state is the last ORDER - 1 symbols."""
    states: dict[int, tuple] = {0: (0.0, None)}
    for at in range(len(x)):
        states = (_dense_step if len(states) > DENSE else _step)(states, x, at, model)
    cost, out = min(((cost + (float(model[state * SYMBOLS]) if state % SYMBOLS else 0.0), out) for state, (cost, out) in states.items()), key=lambda s: s[0])
    letters = []
    while out is not None:
        out, emitted = out
        letters.append(emitted)
    return cost, "".join(reversed(letters))


def decode(x: str, model: np.ndarray) -> str:
    return likeliest(x, model)[1]


def plain(token: str) -> str:
    return token.strip(DECORATION)


class Restorer:
    """Texts to sets of hashed words (of those in kept, if given), each distinct token decoded once for as long as it is remembered."""

    #: Bytes of tokens remembered, about; then the memory starts anew.
    MOST = 48 << 20

    def __init__(self, model: np.ndarray, kept=None):
        self.model, self.kept, self.seen, self.held = model, kept, {}, 0

    def readings(self, token: str) -> list[str]:
        low = token.lower()
        core = plain(low)
        words = [core] if core else []
        # one or two marks at an end may be letters, more are decoration
        ends = low.strip(".,;:?\"'()[]{}<>«»…|").rstrip("!")
        ends = re.sub(r"^([!*#$%&=+~/\\_-])\1{2,}|([!*#$%&=+~/\\_-])\2{2,}$", "", ends)
        if DISGUISED.search(ends) and any(c.isalpha() for c in ends):
            words += decode(ends, self.model).split(" ")
        return words

    def spaced(self, text: str) -> list[str]:
        """Readings of letters spaced out; also without the first or the last of them, which may be a word of its own."""
        out = []
        for run in SPACED.finditer(text):
            low = re.sub(r"\s+", " ", run[0].lower())
            for part in (low, low[2:], low[:-2], low[2:-2]):
                out += decode(part, self.model).split(" ")
        return [w for w in out if w]

    def words(self, text: str) -> list[str]:
        """All words of a text as they stand and as they are restored."""
        return [w for t in set(text.split()) for w in self.readings(t) if w] + self.spaced(text)

    def features(self, text: str) -> np.ndarray:
        found: set[int] = set()
        seen, kept = self.seen, self.kept
        for t in set(text.split()):
            ids = seen.get(t)
            if ids is None:
                if self.held >= self.MOST:
                    seen.clear()
                    self.held = 0
                ids = tuple(word_id(w) for w in self.readings(t) if w)
                if kept is not None:
                    ids = tuple(i for i in ids if i in kept)
                seen[t] = ids
                self.held += 160 + len(t) + (48 + 48 * len(ids) if ids else 0)
            if ids:
                found.update(ids)
        found.update(i for i in map(word_id, self.spaced(text)) if kept is None or i in kept)
        out = np.fromiter(found, np.int64, len(found))
        out.sort()
        return out


def word_id(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode()) >> 1


def _hashed(column: pa.Array, restorer: Restorer) -> Iterator[np.ndarray]:
    """The features of a column's texts (null: those of an empty one), one text at a time."""
    for t in column:
        raw = t.as_buffer()
        yield restorer.features(raw.to_pybytes().decode("utf-8", "replace") if raw is not None else "")


def word_counts(marked: DataFrame, model) -> DataFrame:
    """(word, df, df1): texts of marked(text, y) that hold each hashed word, and those of them with y = 1. Tasks add up their own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, parts, size = Restorer(model.value), [], 0

        def summed() -> pa.RecordBatch:
            ids, y = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            word, at = np.unique(ids, return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array(word), pa.array(np.bincount(at, minlength=len(word))), pa.array(np.bincount(at, y, len(word)).astype(np.int64))], names=["word", "df", "df1"])

        for batch in batches:
            for f, label in zip(_hashed(batch.column(0), restorer), batch.column(1).to_numpy(), strict=True):
                parts.append((f, np.full(len(f), label)))
                size += len(f)
                if size > 1_000_000:
                    yield summed()
                    parts, size = [], 0
        if size:
            yield summed()

    return marked.select("text", "y").mapInArrow(run, "word long, df long, df1 long").groupBy("word").agg(F.sum("df").alias("df"), F.sum("df1").alias("df1"))


def known_words(marked: DataFrame, model, vocabulary: np.ndarray) -> DataFrame:
    """(words, y) of marked(text, y): the places in vocabulary of each text's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model.value, set(vocabulary.tolist()))
        for batch in batches:
            found = [np.searchsorted(vocabulary, f) for f in _hashed(batch.column(0), restorer)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int64())), batch.column(1)], names=["words", "y"])

    return marked.select("text", "y").mapInArrow(run, "words array<bigint>, y int")


def held_out(doc_id) -> F.Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


def fit_words(at: list[np.ndarray], y: np.ndarray, words: int, rounds: int = 300, l2: float = 2e-3) -> tuple[np.ndarray, float]:
    """Weights of the vocabulary's words and a bias: logistic regression by gradient steps scaled per word; at: each text's words."""
    w, b = np.zeros(words), 0.0
    if not len(y):
        return w, -4.0
    row, col = np.repeat(np.arange(len(at)), [len(a) for a in at]), np.concatenate(at).astype(np.int64)
    rate = y.mean()
    b = float(np.log((rate + 1e-3) / (1 - rate + 1e-3)))
    g2, gb2 = np.full(len(w), 1e-8), 1e-8
    for _ in range(rounds):
        z = np.bincount(row, w[col], len(y)) + b
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        g, gb = np.bincount(col, e[row], len(w)) + l2 * w / max(1, words), e.sum()
        g2 += g * g
        gb2 += gb * gb
        w -= 0.3 * g / np.sqrt(g2)
        b -= 0.3 * gb / np.sqrt(gb2)
    return w, b


def scored(docs: DataFrame, labels: DataFrame, name: str) -> DataFrame:
    """docs(doc_id, text, ...) with one more column of that name, the score: the model is fitted on docs and labels as score_toxicity describes it."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(character_model(character_counts(docs)))
    usable = labels.select(F.col("doc_id").cast("long").alias("_id"), (F.col("toxic") > 0).cast("int").alias("y")).where(F.col("_id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("_id")))
    usable = stored(usable, "labels")
    told = docs.select(F.col("doc_id").cast("long").alias("_id"), "text")
    counts = stored(word_counts(with_ids(told, usable, "_id", "inner"), model).where("df >= 3"), "counts")
    rows = usable.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("n1")).first()
    rate = F.lit(max(rows["n1"] or 0, 1) / max(rows["n"], 1))
    p = (F.col("df1") + 0.5 * rate) / (F.col("df") + 0.5)
    gain = F.col("df1") * F.log(F.greatest(p, F.lit(1e-9)) / rate) + (F.col("df") - F.col("df1")) * F.log(F.greatest(1 - p, F.lit(1e-9)) / F.greatest(1 - rate, F.lit(1e-9)))
    vocabulary = np.sort(counts.orderBy(gain.desc(), "word").limit(MOST_WORDS).select("word").toPandas()["word"].to_numpy(np.int64))
    few = usable.orderBy(F.xxhash64("_id"), "_id", "y").limit(MOST_LABELLED)
    sample = known_words(told.join(F.broadcast(few), "_id"), model, vocabulary).toPandas()
    weights = spark.sparkContext.broadcast((vocabulary, *fit_words([np.asarray(r, np.int64) for r in sample["words"]], sample["y"].to_numpy(float), len(vocabulary))))

    at = docs.columns.index("text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, w, b = weights.value
        weight = dict(zip(vocabulary.tolist(), w.tolist(), strict=True))
        restorer = Restorer(model.value, weight)
        for batch in batches:
            z = np.array([b + sum(weight[i] for i in f.tolist()) for f in _hashed(batch.column(at), restorer)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))), pa.float64())], names=[*batch.schema.names, name])

    return docs.mapInArrow(score, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted.

    1. Character ORDER-grams are counted over all texts (a table of fixed size) and give the character model.
    2. Each text's tokens that look disguised (digits or signs among letters, letters three times, marks between letters,
       letters spaced out) are decoded by Viterbi; a text's features are its words as they stand and as restored.
    3. Word counts by label over all labelled rows outside the held-out fifth choose the MOST_WORDS words that tell most (by
       the likelihood ratio); their weights are fitted on at most MOST_LABELLED of these rows, those whose doc_id
       has the smallest hash. 4. Every text is scored by the model; score >= 0.5 predicts 1.

    Null and empty texts are scored by the bias. Labels with a null doc_id or toxic are left out; rows that repeat a
    doc_id count as often as they stand. No usable labels: all scores are low. Empty table: no rows.
    """
    out = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels, "score")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that score_toxicity predicts 1 for, each judged by its own text whatever its doc_id; all columns of docs, in its order."""
    [name] = free_names(docs, "_score")
    return scored(docs, labels, name).where(F.col(name) < 0.5).select(*docs.columns)
