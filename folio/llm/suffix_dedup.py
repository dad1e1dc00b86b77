"""Removal of byte strings that occur more than once, by suffix arrays of grouped candidates."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hot_keys, stored, with_group, with_ids
from .text import least_places, mixed, portions

#: Bytes of a repeated string, and of the grams of which the one with the least hash stands for a window.
LENGTH, GRAM = 200, 96
_BASE = 0x9E3779B97F4A7C15
_UNIT = 1 << 20
#: Runs of one gram that one task compares by a suffix array; the windows of a gram with more meet by a hash of the whole window first.
MOST_RUNS = 1000


def suffix_array(s: list[int]) -> list[int]:
    """The suffix array of a list of integers, in linear time and without recursion.

    First suffixes are grouped by their first symbol and the groups refined, the largest first: for each suffix of a group the previous
    suffix of a smaller group is found by pointers, and those so reached move, by how many of the group point to them,
    into groups of their own just above the one they were in. In the end a group holds the suffixes of one longest
    Lyndon prefix. Then the order is read off from the smallest suffix upwards: what stands before a placed suffix takes the
    next place of its group, and so does what its pointers lead to, until one that is placed already.
    """
    n = len(s)
    if not n:
        return []
    members: list[list[int]] = []
    group = [0] * n
    by: dict[int, list[int]] = defaultdict(list)
    for i, c in enumerate(s):
        by[c].append(i)
    for c in sorted(by):
        for i in by[c]:
            group[i] = len(members)
        members.append(by[c])
    down = list(range(-1, len(members) - 1))
    up = [*range(1, len(members)), -1]
    done, prev = bytearray(n), [-1] * n
    g = len(members) - 1
    order = []  # final groups, the largest first
    while g >= 0:
        own = [i for i in members[g] if group[i] == g]
        own.sort()
        for i in own:
            done[i] = 1
        reached: dict[int, int] = {}
        for i in own:
            p = i - 1
            while p >= 0 and done[p]:
                p = prev[p]
            prev[i] = p
            if p >= 0:
                reached[p] = reached.get(p, 0) + 1
        members[g] = own
        if own:
            order.append(g)
        moves: dict[tuple[int, int], list[int]] = defaultdict(list)
        for p, k in reached.items():
            moves[group[p], k].append(p)
        for h, k in sorted(moves, reverse=True) if len(moves) > 1 else moves:
            # inserted just above h: the sets with more pointers, which come first here, end up higher
            new, above = len(members), up[h]
            members.append(moves[h, k])
            for p in moves[h, k]:
                group[p] = new
            down.append(h)
            up.append(above)
            up[h] = new
            if above >= 0:
                down[above] = new
        g = down[g]
    start, at = [0] * len(members), 0
    for g in reversed(order):
        start[g] = at
        at += len(members[g])
    out = [-1] * n
    placed = bytearray(n)

    def place(j: int) -> None:
        while j >= 0 and not placed[j]:
            out[start[group[j]]] = j
            start[group[j]] += 1
            placed[j] = 1
            j = prev[j]

    place(n - 1)  # what stands before the empty suffix
    for i in range(n):
        place(out[i] - 1)
    return out


def repeated_windows(strings: list[bytes], length: int = LENGTH) -> list[set[int]]:
    """For each of the distinct strings the offsets of its windows that also start elsewhere in any of them.

    Windows that agree are neighbours in the suffix array of the joined strings, once the suffixes with a separator in
    their window are left out.
    """
    symbols: list[int] = []
    starts, owner = [], []
    for i, x in enumerate(strings):
        starts.append(len(symbols))
        symbols.extend([b + 1 for b in x])
        symbols.append(0)
        owner.extend([i if len(x) - o >= length else -1 for o in range(len(x) + 1)])
    joined = b"\0".join(strings) + b"\0"
    out: list[set[int]] = [set() for _ in strings]
    before = None
    for a in suffix_array(symbols):
        i = owner[a]
        if i < 0:
            continue
        window = joined[a : a + length]
        if before is not None and before[0] == window:
            out[i].add(a - starts[i])
            out[before[2]].add(before[1] - starts[before[2]])
        before = (window, a, i)
    return out


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, base, np.uint64)]))


class Grams:
    """Hashes of all grams (of width bytes) of a text from running sums of its bytes times powers of a base (modulo 2**64)."""

    def __init__(self, width: int = GRAM):
        self.width = width
        self.up = self.back = np.empty(0, np.uint64)

    def of(self, data: bytes) -> np.ndarray:
        n, w = len(data), self.width
        if n >= len(self.up):
            self.up, self.back = _powers(_BASE, max(n, _UNIT)), _powers(pow(_BASE, -1, 1 << 64), max(n, _UNIT))
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum((np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)) * self.up[:n], out=sums[1:])
            return mixed((sums[w:] - sums[:-w]) * self.back[: n - w + 1])


def window_runs(data: bytes, grams: Grams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begins, ends, hash): the windows of data by the gram that stands for them; each run of windows [begin, end) has one."""
    h = grams.of(data)
    p = least_places(h, LENGTH - GRAM + 1)
    cut = np.concatenate([[0], np.nonzero(p[1:] != p[:-1])[0] + 1, [len(p)]])
    return cut[:-1], cut[1:], h[p[cut[:-1]]].view(np.int64)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grams = Grams()
    for batch in batches:
        for first, part in portions(batch.column(1)):
            runs = [window_runs(t, grams) if len(t) >= LENGTH else None for t in part]
            rows = [0 if r is None else len(r[0]) for r in runs]
            if sum(rows):
                some = [r for r in runs if r is not None]
                ids = np.repeat(batch.column(0).slice(first, len(part)).to_numpy(), rows)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([r[2] for r in some])), pa.array(ids), pa.array(np.concatenate([r[0] for r in some]).astype(np.int32))], names=["h", "id", "at"])


RUNS = "k long, h long, id long, at int, n int, bytes binary, copies int"


def _merged(rows: list[tuple[int, bytes, int, int, int]]) -> pa.RecordBatch:
    """RUNS of a portion's (h, bytes, id, at, n). Of equal ones one goes to the others of its h (copies tells of more); the rest are known to be repeated."""
    names, kinds = [c.split()[0] for c in RUNS.split(", ")], [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32()]
    rows.sort(key=lambda r: (r[0], r[1]))
    done = []
    for (h, data), same in groupby(rows, key=lambda r: (r[0], r[1])):
        same = list(same)
        for j, (_, _, id_, at, n) in enumerate(same):
            k = h if j == 0 else (id_ * _BASE + at) % (1 << 64) - (1 << 63)
            done.append((k, h if j == 0 else None, id_, at, n, data if j == 0 else None, len(same)))
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*done, strict=True), kinds, strict=True)], names=names)


def _nominated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """RUNS of the marked grams, merged in portions."""
    grams, rows, held = Grams(), [], 0
    for batch in batches:
        ids, text, places = (batch.column(i) for i in range(3))
        for i in range(batch.num_rows):
            data = text[i].as_buffer().to_pybytes()
            if len(data) < LENGTH:
                continue
            begins, ends, h = window_runs(data, grams)
            id_ = ids[i].as_py()
            for j in np.nonzero(np.isin(begins, places[i].values.to_numpy()))[0].tolist():
                a, b = int(begins[j]), int(ends[j])
                piece = data[a : b - 1 + LENGTH]
                rows.append((int(h[j]), piece, id_, a, b - a))
                held += len(piece) + 100
            if held > 24 << 20:
                yield _merged(rows)
                rows, held = [], 0
    if rows:
        yield _merged(rows)


def _hashed_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(w, id, run, at): all windows of runs (id, at, bytes) by a hash of the whole window."""
    whole = Grams(LENGTH)
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, runs = (batch.column(i).to_numpy() for i in range(2))
        hashes = [whole.of(x.as_buffer().to_pybytes()) for x in batch.column(2)]
        n = [len(h) for h in hashes]
        at = np.concatenate([a + np.arange(k, dtype=np.int32) for a, k in zip(runs.tolist(), n, strict=True)]).astype(np.int32)
        cols = [np.concatenate(hashes).view(np.int64), np.repeat(ids, n), np.repeat(runs, n), at]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["w", "id", "run", "at"])


def _single_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """RUNS of one window each, with its own hash for h: those of runs (id, at, bytes) that start at places, merged in portions."""
    rows, held = [], 0
    for batch in batches:
        for id_, run, data, windows in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for w in windows:
                a = w["at"] - run
                rows.append((w["w"], data[a : a + LENGTH], id_, w["at"], 1))
            held += len(windows) * (LENGTH + 100)
            if held > 24 << 20:
                yield _merged(rows)
                rows, held = [], 0
    if rows:
        yield _merged(rows)


def small_groups(runs: DataFrame) -> DataFrame:
    """RUNS in which equal windows that weren't merged still share h, but no task compares more than MOST_RUNS runs of one gram.

    The runs at the edges of a passage hold each document's own bytes, so a gram of a frequent passage has about as many different
    strings as documents. The windows of such a gram part: they are counted by a hash of the whole window (partial
    aggregation for frequent ones), and those that met go on as strings of LENGTH bytes under that hash, merged in portions. So a
    group holds the copies of one window, one for each portion, and bytes still decide. runs is stored; it is read several times.
    """
    crowded = stored(runs.where("h is not null").groupBy("h").agg(F.count(F.lit(1)).alias("runs")).where(F.col("runs") > MOST_RUNS).select("h"), "crowded")
    rest = with_ids(runs.where("h is not null"), crowded, "h", "left_anti").select(*runs.columns).unionByName(runs.where("h is null"))
    if crowded.isEmpty():
        return rest
    parted = stored(with_ids(runs.where("h is not null"), crowded, "h").select("id", "at", "bytes", "n", "copies"), "parted", "zstd")
    windows = stored(parted.select("id", "at", "bytes").mapInArrow(_hashed_windows, "w long, id long, run int, at int"), "windows")
    met = with_group(windows, "w", times=F.count(F.lit(1))).where("times > 1")
    places = met.groupBy("id", F.col("run").alias("at")).agg(F.collect_list(F.struct("w", F.col("at").alias("at"))).alias("windows"))
    single = parted.select("id", "at", "bytes").join(places, ["id", "at"]).select("id", "at", "bytes", "windows").mapInArrow(_single_windows, RUNS)
    # runs merged before are repeated as a whole
    whole = parted.where("copies > 1").select(F.xxhash64("id", "at").alias("k"), F.lit(None).cast("long").alias("h"), "id", "at", "n", F.lit(None).cast("binary").alias("bytes"), "copies")
    return rest.unionByName(single).unionByName(whole)


def _spans(windows: list[int], at: int) -> list[tuple[int, int]]:
    """[begin, end) byte spans that sorted window starts cover."""
    out: list[tuple[int, int]] = []
    for w in windows:
        if out and w + at <= out[-1][1]:
            out[-1] = (out[-1][0], w + at + LENGTH)
        else:
            out.append((w + at, w + at + LENGTH))
    return out


def meeting(groups: list[list[bytes]], whole: Grams) -> list[list[tuple[int, int] | None]]:
    """For each string of each group the (first, last) of its windows whose hash stands twice in the group, or None: no other windows can be equal."""
    strings = [x for g in groups for x in g]
    n = np.array([len(x) for x in strings])
    starts, windows = np.cumsum(n) - n, n - LENGTH + 1
    owner = np.repeat(np.arange(len(strings)), windows)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    group = np.repeat(np.arange(len(groups), dtype=np.uint64), [len(g) for g in groups])
    with np.errstate(over="ignore"):
        key = whole.of(b"".join(strings))[starts[owner] + offset] ^ (group[owner] * np.uint64(_BASE))
    order = np.argsort(key)
    same = np.nonzero(key[order[1:]] == key[order[:-1]])[0]
    twice = np.zeros(len(key), bool)
    twice[order[same]] = twice[order[same + 1]] = True
    at = np.nonzero(twice)[0]
    have, first = np.unique(owner[at], return_index=True)
    last = np.append(first[1:], len(at)) - 1 if len(at) else first
    found: list[tuple[int, int] | None] = [None] * len(strings)
    for i, f, z in zip(have.tolist(), offset[at[first]].tolist() if len(at) else [], offset[at[last]].tolist() if len(at) else [], strict=True):
        found[i] = (f, z)
    each = iter(found)
    return [[next(each) for _ in g] for g in groups]


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, begin, end) spans of repeated windows, from runs sorted by (h, bytes). Groups are looked at some megabyte at a time; what can meet in
    one, cut to what can meet, goes into its suffix array."""
    whole = Grams(LENGTH)
    current, strings, occurrences = None, [], []
    pending: list[tuple[list[bytes], list[list[tuple]]]] = []
    held = 0
    rows: list[tuple[int, int, int]] = []

    def settle() -> None:
        nonlocal held
        for (strings, occurrences), spans in zip(pending, meeting([g for g, _ in pending], whole) if pending else [], strict=True):
            cut: dict[bytes, list[int]] = defaultdict(list)
            for i, span in enumerate(spans):
                if span:
                    cut[strings[i][span[0] : span[1] + LENGTH]].append(i)
            for (data, same), offsets in zip(cut.items(), repeated_windows(list(cut)), strict=True):
                every = sorted(offsets) if len(same) == 1 else range(len(data) - LENGTH + 1)
                for i in same:
                    if len(occurrences[i]) == 1 and occurrences[i][0][3] == 1 and every:
                        id_, at = occurrences[i][0][:2]
                        rows.extend((id_, a, b) for a, b in _spans(every, at + spans[i][0]))
        pending.clear()
        held = 0

    def close() -> None:
        nonlocal held
        for occ in occurrences:
            if len(occ) > 1 or occ[0][3] > 1:
                rows.extend((id_, at, at + n - 1 + LENGTH) for id_, at, n, _ in occ)
        if len(strings) > 1:
            pending.append((strings, occurrences))
            held += sum(map(len, strings))
            if held > _UNIT // 2:
                settle()

    def out() -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32())], names=["id", "begins", "ends"])

    for batch in batches:
        for h, id_, at, n, data, copies in zip(*(batch.column(c).to_pylist() for c in ("h", "id", "at", "n", "bytes", "copies")), strict=True):
            if h is None:
                rows.append((id_, at, at + n - 1 + LENGTH))
                continue
            if h != current:
                close()
                current, strings, occurrences = h, [], []
            if not strings or strings[-1] != data:
                strings.append(data)
                occurrences.append([])
            occurrences[-1].append((id_, at, n, copies))
        if len(rows) > 20_000:
            yield out()
            rows = []
    close()
    settle()
    if rows:
        yield out()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for i in range(batch.num_rows):
            data, kept, at, removed, spans = batch.column(1)[i].as_buffer().to_pybytes(), [], 0, 0, 0
            for s in batch.column(2)[i].as_py():
                a, b = s["begins"], min(s["ends"], len(data))
                if a > at or not spans:
                    kept.append(data[at:a])
                    spans += 1
                    removed += b - a
                elif b > at:
                    removed += b - at
                at = max(at, b)
            kept.append(data[at:])
            rows.append((batch.column(0)[i].as_py(), removed, spans, b"".join(kept)))
        if rows:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["id", "n_removed", "n_spans", "kept"])


def remove_repeated_bytes(docs: DataFrame, with_bytes: bool = False) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and with_bytes: kept).

    Every byte goes that a string of LENGTH bytes covers which also starts anywhere else, in the same document too. A window's gram
    of least hash stands for it: equal windows have the same, so only windows whose gram occurs more than once are
    nominated. The runs of nominated windows with one gram meet as byte strings; runs whose strings are equal are repeated as
    a whole, and different strings of one gram go into one suffix array (suffix_array), in which equal windows
    are neighbours. Nothing is decided by a hash. Equal runs of a task are merged before the shuffle, so a passage that
    very many documents hold reaches its group once per task; grams that still have very many runs are parted by window (small_groups).

    Documents with equal texts of LENGTH bytes or more lose everything; one of them is compared with the others. Null
    texts are empty. Each row is a document of its own, whatever its doc_id (null or repeated): rows are numbered once, in a stored copy of
    the table, and known by that number. Repeated rows lose everything too. Empty table: no rows. n_spans counts maximal removed runs.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    numbered = docs.select(F.monotonically_increasing_id().alias("id"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = stored(numbered.select("*", F.octet_length("text").cast("long").alias("n"), F.sha2("text", 256).alias("sha")), "texts", "zstd")
    texts, sums = rows.select("id", "text"), rows.select("id", "doc_id", "n", "sha")
    known = with_group(rows.where(F.col("n") >= LENGTH).select("id", "sha"), "sha", first=F.min("id"), size=F.count(F.lit(1)))
    copied = stored(known.where("size > 1").select("id", "first"), "copies")
    # of copies the first is compared, and dropped again in the end
    originals = with_ids(texts, stored(copied.where("id <> first").select("id"), "copy_ids"), "id", "left_anti")
    anchors = originals.mapInArrow(_anchors, "h long, id long, at int")
    hot = stored(hot_keys(anchors, "h").select(F.col("h").alias("hot")), "hot")
    marked = anchors.join(F.broadcast(hot), F.col("h") == F.col("hot"), "left")
    # a frequent gram needs no count; as the summary's figures may be too high, it may nominate in vain, which does no harm
    key = F.when(F.col("hot").isNull(), F.col("h")).otherwise(F.xxhash64("id", "at"))
    counted = marked.select(key.alias("k"), "id", "at", F.col("hot").isNotNull().alias("sure")).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("k")))
    places = stored(counted.where("sure or n > 1").groupBy("id").agg(F.sort_array(F.collect_set("at")).alias("places")), "places", "zstd")
    nominated = with_ids(originals, stored(places.select("id"), "ids"), "id").join(places.hint("merge"), "id").select("id", "text", "places")
    runs = small_groups(stored(nominated.mapInArrow(_nominated, RUNS), "runs", "zstd"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = runs.repartition(n, "k").sortWithinPartitions("h", "bytes").select("h", "id", "at", "n", "bytes", "copies").mapInArrow(_resolve, "id long, begins int, ends int")
    spans = stored(found.groupBy("id").agg(F.sort_array(F.collect_set(F.struct("begins", "ends"))).alias("spans")), "spans", "zstd")
    losing = with_ids(originals, stored(spans.select("id"), "ids"), "id").join(spans.hint("merge"), "id").select("id", "text", "spans")
    cut = losing.mapInArrow(_cut, "id long, n_removed long, n_spans long, kept binary")
    cut = cut.select("id", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha"), *(["kept"] if with_bytes else []))
    out = sums.join(copied.select("id", F.lit(True).alias("copy")), "id", "left").join(cut, "id", "left")
    columns = [
        "doc_id",
        F.col("n").alias("n_bytes"),
        F.when(F.col("copy"), F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy"), F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(F.col("copy"), F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"),
    ]
    if not with_bytes:
        return out.select(*columns)
    return out.join(texts, "id").select(*columns, F.when(F.col("copy"), F.lit(b"")).otherwise(F.coalesce("kept", "text")).alias("kept"))
