"""Removal of repeated passages against a log-structured index of fingerprints of all earlier documents."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_stored, hot_keys, new_path, stored, with_group, with_ids
from .text import least_places, mixed, new_key, portions, word_hashes

#: Words of a window, and of the grams of which the one with the least hash is the window's fingerprint.
WINDOW, GRAM = 20, 8
#: Runs of the index that are merged into one, and batches that a whole table is worked in: the last one meets history as a merged run.
FAN_IN, BATCHES = 2, 3
#: Runs of one fingerprint that one task verifies together; the windows of a fingerprint with more are grouped one by one.
MOST_RUNS = 1000


def _two(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = a * np.uint64(0x9FB21C651E98DF25) ^ b
        x ^= x >> np.uint64(29)
        return x * np.uint64(0xD6E8FEB86659FD93)


def grams_of(flat: np.ndarray) -> np.ndarray:
    """Hashes of all grams of GRAM = 8 words, from pairs of pairs of pairs."""
    for step in (1, 2, 4):
        flat = _two(flat[:-step], flat[step:])
    return mixed(flat)


def fingerprints(grams: np.ndarray) -> np.ndarray:
    """For each window of words the place of its fingerprint: the leftmost of its grams with the least hash."""
    return least_places(grams, WINDOW - GRAM + 1)


def windows_of(grams: np.ndarray) -> np.ndarray:
    """Hashes of all windows of WINDOW = 20 words: three grams cover one."""
    last = WINDOW - GRAM
    return mixed(_two(_two(grams[:-last], grams[GRAM : len(grams) - last + GRAM]), grams[last:]))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, sha = [], []
        for t in batch.column(0):
            words = t.as_buffer().to_pybytes().split()
            n.append(len(words))
            sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(sha, pa.string()), *batch.columns], names=["n", "sha", *batch.schema.names])


def _anchors(key: int):
    """(h, id, at) of the fingerprints of texts (id, text), words hashed under key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in portions(batch.column(1)):
                flat, each = word_hashes(part, key)
                if len(flat) < WINDOW:
                    continue
                # windows of all documents at once; those that reach beyond their document are left out
                begins = np.cumsum(each) - each
                row = np.repeat(np.arange(len(part)), each)
                starts = np.arange(len(flat) - WINDOW + 1)
                starts = starts[starts + WINDOW <= (begins + each)[row[: len(starts)]]]
                if not len(starts):
                    continue
                grams = grams_of(flat)
                p, row = fingerprints(grams)[starts], row[starts]
                new = np.concatenate([[True], (p[1:] != p[:-1]) | (row[1:] != row[:-1])])
                p, row = p[new], row[new]
                ids = batch.column(0).slice(first, len(part)).to_numpy()[row]
                yield pa.RecordBatch.from_arrays([pa.array(grams[p].view(np.int64)), pa.array(ids), pa.array((p - begins[row]).astype(np.int32))], names=["h", "id", "at"])

    return run


class FingerprintIndex:
    """Sorted immutable runs of fingerprints (h, id, at), each bucketed and sorted by h in the shared folder.

    A new batch becomes a run too, so that matching it with history merges sorted buckets without a shuffle. Fingerprints so
    frequent that one bucket would be overfull (hot_keys, at most HOT_KEYS a run, whose list is kept) lie aside in a
    part that isn't bucketed. compact() merges FAN_IN runs of a level into one of the next, so that n
    batches leave a logarithmic number of runs and each fingerprint is rewritten as often; the merged runs are dropped. Words are hashed under a
    secret key of the index. drop() removes its runs.
    """

    def __init__(self, spark: SparkSession, buckets: int | None = None, fan_in: int = FAN_IN):
        self.spark, self.fan_in, self.key = spark, fan_in, new_key()
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[tuple[DataFrame, DataFrame, list[int]]]] = []
        self.names: dict[int, str] = {}

    def _run(self, anchors: DataFrame) -> tuple[DataFrame, DataFrame, list[int]]:
        """(cold fingerprints, hot ones, hot keys) of a stored table or a union of such; it is read three times."""
        name = f"folio_run_{uuid.uuid4().hex}"
        hot = [r["h"] for r in hot_keys(anchors, "h").collect()]
        aside = stored(anchors.where(F.col("h").isin(hot)), "hot")
        cold = anchors.where(~F.col("h").isin(hot)).repartition(self.buckets, "h")
        cold.write.bucketBy(self.buckets, "h").sortBy("h").option("path", new_path(self.spark, "run")).saveAsTable(name)
        run = self.spark.table(name)
        self.names[id(run)] = name
        return run, aside, hot

    def runs(self) -> list[tuple[DataFrame, DataFrame, list[int]]]:
        return [r for level in self.levels for r in level]

    def add(self, docs: DataFrame) -> DataFrame:
        """Indexes docs(id, text) as one run. Returns (id, new, places): the fingerprints of docs that occur twice in docs or in
        an earlier run (new), and those that they meet there (not new)."""
        anchors = stored(docs.select("id", F.col("text").cast("binary").alias("text")).mapInArrow(_anchors(self.key), "h long, id long, at int"), "anchors")
        run, aside, hot = self._run(anchors)
        drop_stored(anchors)
        counts = run.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
        found = [aside.select("id", "at", F.lit(True).alias("new")), run.join(counts.where("n > 1").select("h"), "h", "left_semi").select("id", "at", F.lit(True).alias("new"))]
        for old, old_aside, old_hot in self.runs():
            found.append(old.join(counts.select("h"), "h", "left_semi").select("id", "at", F.lit(False).alias("new")))
            found.append(run.join(old.select("h"), "h", "left_semi").select("id", "at", F.lit(True).alias("new")))
            # on either side a key may be among the hot ones, which are few
            found.append(run.where(F.col("h").isin(old_hot)).select("id", "at", F.lit(True).alias("new")))
            found.append(old.where(F.col("h").isin(hot)).select("id", "at", F.lit(False).alias("new")))
            met = [r["h"] for r in run.where(F.col("h").isin(old_hot)).select("h").distinct().collect()] + [h for h in hot if h in set(old_hot)]
            found.append(old_aside.where(F.col("h").isin(met)).select("id", "at", F.lit(False).alias("new")))
        out = found[0]
        for part in found[1:]:
            out = out.unionByName(part)
        out = stored(out.groupBy("id", "new").agg(F.sort_array(F.collect_set("at")).alias("places")), "places")
        self.levels = self.levels or [[]]
        self.levels[0].append((run, aside, hot))
        self.compact()
        return out

    def drop(self) -> None:
        """Removes all runs, files and tables."""
        for run, aside, _ in self.runs():
            name = self.names.pop(id(run))
            drop_stored(run)
            drop_stored(aside)
            self.spark.sql(f"DROP TABLE {name}")
        self.levels = []

    def compact(self) -> None:
        """Merges the runs of each level that holds FAN_IN of them into one run of the next level."""
        for i in range(len(self.levels)):
            if len(self.levels[i]) >= self.fan_in:
                merged, parts = None, self.levels[i]
                for run, aside, _ in parts:
                    both = run.select("h", "id", "at").unionByName(aside)
                    merged = both if merged is None else merged.unionByName(both)
                new = self._run(merged)
                for run, aside, _ in parts:  # immutable runs go as a whole; the new one holds all their rows
                    name = self.names.pop(id(run))
                    drop_stored(run)
                    drop_stored(aside)
                    self.spark.sql(f"DROP TABLE {name}")
                self.levels[i] = []
                if i + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[i + 1].append(new)


def _runs_of_windows(key: int):
    """For each run of windows with one marked fingerprint: (h, id, at, n, hashes); runs whose windows all stand earlier in this task's portion have no h and no hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h", "id", "at", "n", "hashes", "new"]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            rows.sort(key=lambda r: (r[1], r[4], r[2], r[0], r[3]))  # h, hashes, id: the first of equal ones goes on
            done = []
            for _, same in groupby(rows, key=lambda r: (r[1], r[4])):
                first = None
                for at, h, id_, n, packed, new in same:
                    if first is None:
                        first = (id_, at)
                        done.append((h, id_, at, n, packed, new))
                    elif new and first != (id_, at):  # a repeated row stands at the same place
                        done.append((None, id_, at, n, None, new))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)

        rows: list[tuple] = []
        for batch in batches:
            ids, text, places, new = (batch.column(i) for i in range(4))
            for i in range(batch.num_rows):
                flat, _ = word_hashes([text[i].as_buffer().to_pybytes()], key)
                if len(flat) < WINDOW:
                    continue
                all_grams = grams_of(flat)
                p = fingerprints(all_grams)
                starts = np.concatenate([[0], np.nonzero(p[1:] != p[:-1])[0] + 1, [len(p)]])
                marked = np.nonzero(np.isin(p[starts[:-1]], places[i].values.to_numpy()))[0]
                if not len(marked):
                    continue
                grams, packed = all_grams.view(np.int64)[p[starts[marked]]].tolist(), windows_of(all_grams).tobytes()
                id_, is_new = ids[i].as_py(), new[i].as_py()
                for h, a, b in zip(grams, starts[marked].tolist(), starts[marked + 1].tolist(), strict=True):
                    rows.append((a, h, id_, b - a, packed[8 * a : 8 * b], is_new))
                if len(rows) > 100_000:
                    yield out(rows)
                    rows = []
        if rows:
            yield out(rows)

    return run


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, at, mask) of new runs, by sorted (h, id, at): bit j tells that window at + j occurs earlier."""
    current, seen = None, {}
    for batch in batches:
        out = []
        for h, id_, at, n, packed, new in zip(*(batch.column(c).to_pylist() for c in ("h", "id", "at", "n", "hashes", "new")), strict=True):
            if h != current:
                current, seen = h, {}
            mask = 0
            for j in range(n):
                if seen.setdefault(packed[8 * j : 8 * j + 8], (id_, at + j)) != (id_, at + j):
                    mask |= 1 << j
            if mask and new:
                out.append((id_, at, mask))
        if out:
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32())], names=["id", "at", "mask"])


def _single_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(w, id, at, new): all windows of runs (id, at, hashes, new)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, runs = (batch.column(i).to_numpy() for i in range(2))
        hashes = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(2)]
        n = [len(h) for h in hashes]
        at = np.concatenate([a + np.arange(k) for a, k in zip(runs.tolist(), n, strict=True)]).astype(np.int32)
        cols = [np.concatenate(hashes), np.repeat(ids, n), at, np.repeat(batch.column(3).to_numpy(zero_copy_only=False), n)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["w", "id", "at", "new"])


def small_groups(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(runs of fingerprints that have MOST_RUNS at most, masks (id, at, mask) of the others' windows that occur earlier).

    Runs at the edge of a shared passage hold each document's own words, so a frequent fingerprint has about as many different runs
    as documents. Its windows are grouped by their own hash: the first place of each comes from partial aggregation for
    frequent ones (with_group), so no task gathers the fingerprint. runs is stored; it is read several times.
    """
    known, open_ = runs.where("h is null"), runs.where("h is not null")
    crowded = stored(open_.groupBy("h").agg(F.count(F.lit(1)).alias("runs")).where(F.col("runs") > MOST_RUNS).select("h"), "crowded")
    rest = with_ids(open_, crowded, "h", "left_anti").select(*runs.columns)
    masks = known.select("id", "at", F.expr("cast(shiftleft(1, n) - 1 as int)").alias("mask"))
    if crowded.isEmpty():
        return rest, masks
    windows = stored(with_ids(open_, crowded, "h").select("id", "at", "hashes", "new").mapInArrow(_single_windows, "w long, id long, at int, new boolean"), "windows")
    placed = with_group(windows, "w", first=F.min(F.struct("id", "at")))
    later = placed.where(F.col("new") & (F.struct("id", "at") != F.col("first")))
    return rest, masks.unionByName(later.select("id", "at", F.lit(1).alias("mask")))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words that stay: (id, removed, text that stays)."""
    for batch in batches:
        rows = []
        for i in range(batch.num_rows):
            words = batch.column(1)[i].as_buffer().to_pybytes().split()
            step = np.zeros(len(words) + WINDOW + 1, np.int32)
            for r in batch.column(2)[i].as_py():
                for j in range(r["mask"].bit_length()):
                    if r["mask"] >> j & 1 and r["at"] + j + WINDOW <= len(words):
                        step[r["at"] + j] += 1
                        step[r["at"] + j + WINDOW] -= 1
            gone = np.cumsum(step)[: len(words)] > 0
            rest = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
            rows.append((batch.column(0)[i].as_py(), int(gone.sum()), rest))
        if rows:
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int64(), pa.int64(), pa.binary()], strict=True)], names=["id", "n_removed", "rest"])


def dedup_batch(index: FingerprintIndex, batch: DataFrame, everything: DataFrame, with_text: bool = False) -> DataFrame:
    """(id, n_removed, kept_sha[, kept_text]) of the documents of batch(id, text) that lose words; batch becomes a run of index.

    Fingerprints that match another occurrence only nominate windows. Of each nominated window, in the batch and in the
    documents of everything(id, text) that it meets in history, the words are read again and hashed as a whole; a window is
    removed if that hash also stands at an earlier place. ids of later batches are larger.
    """
    places = index.add(batch)
    # all words of history stand before all words of the batch
    text = with_ids(everything, stored(places.select("id").distinct(), "ids"), "id")
    marked = text.join(places.hint("merge"), "id").select("id", F.col("text").cast("binary").alias("text"), "places", "new")
    runs, known = small_groups(stored(marked.mapInArrow(_runs_of_windows(index.key), "h long, id long, at int, n int, hashes binary, new boolean"), "runs"))
    n = int(batch.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    later = runs.repartition(n, "h").sortWithinPartitions("h", "id", "at").select("h", "id", "at", "n", "hashes", "new").mapInArrow(_later, "id long, at int, mask int")
    later = later.unionByName(known)
    masks = stored(later.groupBy("id").agg(F.collect_list(F.struct("at", "mask")).alias("masks")), "masks")
    losing = with_ids(batch, stored(masks.select("id"), "ids"), "id").join(masks.hint("merge"), "id")
    cut = losing.select("id", F.col("text").cast("binary").alias("text"), "masks").mapInArrow(_cut, "id long, n_removed long, rest binary")
    kept = [F.sha2("rest", 256).alias("kept_sha")] + ([F.col("rest").cast("string").alias("kept_text")] if with_text else [])
    return cut.select("id", "n_removed", *kept)


def remove_repeats(docs: DataFrame, batches: int = BATCHES, with_text: bool = False) -> DataFrame:
    r"""One row for each row of docs: doc_id, n_words, n_removed, kept_sha256 (and with_text: kept_text).

    Words are [^\x20\x09-\x0D]+. A word goes if a window of WINDOW words covers it whose words also start earlier: in
    an earlier document, or in the same one. Documents stand in the order of doc_id (null last), then of their text's SHA-256: rows with
    one doc_id (or none) and different texts are different documents. They are worked in batches by their place in that order, each matched with the index of all
    earlier ones (FingerprintIndex). Equal windows have equal fingerprints, so none is missed; matches are verified by a
    64-bit hash of the whole window, within equal 64-bit fingerprints unless these are frequent (small_groups).

    Documents with the same words as an earlier one lose everything (from WINDOW words on) and aren't indexed. Null texts
    have no words. Rows that repeat doc_id and text are one document and fare alike. Empty
    table: no rows. Kept words are joined by one space.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    spark = docs.sparkSession
    # a stored copy in the order of documents, in which rows are numbered once; equal rows are dealt by where they stood
    order = [F.col("doc_id").asc_nulls_last(), F.col("raw").asc(), F.col("row").asc()]
    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.monotonically_increasing_id().alias("row"))
    dealt = raw.withColumn("raw", F.sha2("text", 256)).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    numbered = dealt.select("text", F.monotonically_increasing_id().alias("id"), "doc_id", "raw")
    rows = stored(numbered.mapInArrow(_sums, "n long, sha string, text binary, id long, doc_id long, raw string"), "texts", "zstd")
    texts, sums = rows.select("id", "text"), rows.select("id", "doc_id", "raw", "n", "sha")
    placed = with_group(sums.where(F.col("n") >= WINDOW), "sha", first=F.min(F.struct("id", "doc_id", "raw")))
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("raw") == F.col("first.raw"))
    placed = stored(placed.select("id", "doc_id", "n", "sha", F.col("first.id").alias("first"), same.alias("same")), "places")
    index, parts, low = FingerprintIndex(spark), [], None
    cuts = sums.agg(F.expr(f"percentile_approx(id, array({', '.join(str(i / batches) for i in range(1, batches))}), 1000)")).first()[0] if batches > 1 else []
    originals = with_ids(texts, stored(placed.where("id <> first").select("id"), "copy_ids"), "id", "left_anti")
    for high in [*sorted(set(cuts or [])), (1 << 63) - 1]:
        span = F.col("id") <= high if low is None else (F.col("id") <= high) & (F.col("id") > low)
        parts.append(stored(dedup_batch(index, originals.where(span), originals.where(F.col("id") <= high), with_text), "cut"))
        low = high
    index.drop()
    cut = parts[0]
    for part in parts[1:]:
        cut = cut.unionByName(part)
    few = sums.where(F.col("n") < WINDOW).select("id", "doc_id", "n", "sha", F.lit(False).alias("copy"))
    own = placed.where("same").select("id", "doc_id", "n", "sha", F.lit(False).alias("copy"), "first").join(cut.withColumnRenamed("id", "first"), "first", "left").drop("first")
    copies = placed.where("not same").select("id", "doc_id", "n", "sha", F.lit(True).alias("copy"))
    out = own.unionByName(few, allowMissingColumns=True).unionByName(copies, allowMissingColumns=True)
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    columns = [
        "doc_id",
        F.col("n").alias("n_words"),
        F.when(F.col("copy"), F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy"), nothing).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"),
    ]
    if not with_text:
        return out.select(*columns)
    whole = texts.select("id", F.regexp_replace(F.trim(F.regexp_replace(F.col("text").cast("string"), r"[\x20\x09-\x0D]+", " ")), "^ | $", "").alias("text"))
    return out.join(whole, "id").select(*columns, F.when(F.col("copy"), F.lit("")).otherwise(F.coalesce("kept_text", "text")).alias("kept_text"))
