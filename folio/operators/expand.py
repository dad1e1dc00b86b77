"""Expansion, sampling, naming and splitting of tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.draw import draw
from ..sources.shared import kept


def expand_per_template(df: DataFrame, copies: int) -> DataFrame:
    """copies rows of each row of df(source_idx, …), with copy and out_idx in the order source by source."""
    if copies < 1:
        raise ValueError("copies must be 1 or more")
    return df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).withColumn("out_idx", (F.col("source_idx") * copies + F.col("copy")).cast("long"))


def ranked(df: DataFrame, order: list[Column], name: str = "row_idx", partitions: int | None = None) -> DataFrame:
    """df with a dense row number from 0 in the given total order, without one task that sees all rows.

    Rows are dealt by ranges and numbered within each; the counts of the ranges before are added.
    """
    dealt = _dealt(df, order, partitions)
    counts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    # one row for each range
    return dealt.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_before", "_at")


def _dealt(df: DataFrame, order: list[Column], partitions: int | None = None) -> DataFrame:
    """df dealt by ranges of the order, with the range (_part) and the place in it (_at); written once, since ranges are sampled and all uses must see the same ones."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    id_ = F.monotonically_increasing_id()
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order).select("*", id_.alias("_id"))
    return kept(dealt, "ranges").withColumns({"_part": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_id")


def sample_with_replacement(spark: SparkSession, df: DataFrame, rows: int, total: int, seed: int | None) -> DataFrame:
    """total draws with replacement from df(source_idx from 0 to rows - 1, …): out_idx and the drawn row; None: a new seed each time."""
    if rows < 1:
        raise ValueError("there are no sources")
    if seed is None:
        seed = spark.range(1).select(F.floor(F.rand() * (1 << 31))).first()[0]
    drawn = spark.range(total).select(F.col("id").alias("out_idx"), (draw(seed, F.col("id")) % rows).alias("source_idx"))
    return drawn.join(df, "source_idx")


def documents_by_zones(spark: SparkSession, n: int, base_seed: int, zones: DataFrame) -> DataFrame:
    """Every zone for each of n numbered documents; zones are a form's few rows."""
    return number_documents(spark, n, base_seed).crossJoin(F.broadcast(zones))


def number_documents(spark: SparkSession, n: int, base_seed: int) -> DataFrame:
    """(doc_no, seed, stem, image_path): seed base + i, doc_%06d of i + 1."""
    stem = F.format_string("doc_%06d", F.col("id") + 1)
    return spark.range(n).select(F.col("id").alias("doc_no"), (F.col("id") + base_seed).alias("seed"), stem.alias("stem"), F.concat(stem, F.lit(".png")).alias("image_path"))


def compute_once(requests: DataFrame, fn: Callable[[DataFrame], DataFrame], content: str = "content", effect: str = "effect", params: str = "params", refresh: str = "refresh") -> DataFrame:
    """fn over each distinct request once, joined back; rows with refresh are computed themselves.

    fn takes a table with content, effect, params and a column key, and returns key and its results.
    """
    key = F.concat_ws(":", F.substring(F.sha2(F.col(content), 256), 1, 16), F.col(effect), F.col(params))
    keyed = requests.withColumn("key", key)
    own = keyed.where(F.coalesce(F.col(refresh), F.lit(False)))
    rest = keyed.where(~F.coalesce(F.col(refresh), F.lit(False)))
    once = fn(rest.dropDuplicates(["key"]).select(content, effect, params, "key"))
    again = fn(own.dropDuplicates(["key"]).select(content, effect, params, "key"))
    return rest.join(once, "key").unionByName(own.join(again, "key"))


def name_outputs(df: DataFrame, mode: str = "per_template") -> DataFrame:
    """df(stem, out_idx, …) with name: a counter of three digits per stem in output order, or of four digits over all for random_sample.

    Two levels, so that a stem which most rows share is numbered by many tasks: ranges of (stem, out_idx) are numbered stem by stem, and what
    a stem has in the ranges before is added.
    """
    if mode == "random_sample":
        return df.withColumn("name", F.format_string("%04d", "out_idx"))
    dealt = _dealt(df, [F.col("stem"), F.col("out_idx")])
    pieces = dealt.groupBy("_part", "stem").agg(F.count(F.lit(1)).alias("_n"))
    # only stems that lie in more than one range have rows before a piece: at most two pieces for each range
    several = pieces.groupBy("stem").agg(F.sort_array(F.collect_list(F.struct("_part", "_n"))).alias("_pieces")).where(F.size("_pieces") > 1)
    sums = F.transform("_pieces", lambda x, i: F.struct(x["_part"].alias("_part"), F.aggregate(F.slice("_pieces", F.lit(1), i), F.lit(0).cast("long"), lambda a, y: a + y["_n"]).alias("_before")))
    before = several.select(F.col("stem").alias("_stem"), F.explode(sums).alias("_b")).select("_stem", F.col("_b._part").alias("_in"), "_b._before")
    numbered = dealt.withColumn("_k", F.row_number().over(Window.partitionBy("_part", "stem").orderBy("_at")) - 1)
    joined = numbered.join(F.broadcast(before), F.col("stem").eqNullSafe(F.col("_stem")) & (F.col("_part") == F.col("_in")), "left")
    return joined.select(*df.columns, F.format_string("%s_%03d", "stem", F.col("_k") + F.coalesce("_before", F.lit(0))).alias("name"))


def in_input_order(df: DataFrame, by: str = "out_idx") -> DataFrame:
    return df.orderBy(by)


def preview_rows(df: DataFrame, k: int = 8, by: str = "out_idx") -> DataFrame:
    """The first k outputs."""
    return df.orderBy(by).limit(k)


#: Bits of a draw that one counting pass looks at.
BITS = 11


def threshold(drawn: DataFrame, rank: int, key: str) -> Column:
    """A condition that holds for exactly the first `rank` rows of drawn(_draw, key, …) in the order of (_draw, key), found by counting, not by sorting.

    Each pass counts the rows by some more leading bits of the draw, with partial aggregation; the driver sees 2**BITS counts. The keys that share
    the last draw, some rows in four billion, are taken in order. Rows that repeat that draw's last key cannot be told apart by it: those are ranked.
    """
    left, prefix, known = rank, 0, 0
    while known < 32:
        bits = min(BITS, 32 - known)
        here = drawn.where(F.shiftright("_draw", 32 - known) == prefix) if known else drawn
        cells = here.groupBy(F.shiftright("_draw", 32 - known - bits).alias("cell")).agg(F.count(F.lit(1)).alias("n")).collect()
        for r in sorted(cells):
            prefix = r["cell"]
            if left < r["n"]:
                break
            left -= r["n"]
        else:
            return F.lit(True)  # no more rows than that
        known += bits
    below, keys = F.col("_draw") < prefix, drawn.where(F.col("_draw") == prefix).groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(key)
    for r in keys.toLocalIterator():
        if left < r["n"]:
            break
        left -= r["n"]
    before = F.lit(False) if r[key] is None else F.col(key).isNull() | (F.col(key) < F.lit(r[key]))
    if left:
        raise RepeatedKey(r[key])
    return below | ((F.col("_draw") == prefix) & before)


class RepeatedKey(Exception):
    """The threshold falls among rows of one key."""


def split(df: DataFrame, val_ratio: float, test_ratio: float, seed: int, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(train, val, test) of exact sizes by a seeded shuffle of the rows: test and val have 1 row at least, as long as there are rows.

    The shuffle is never carried out: thresholds of the draws are found by counting (threshold), and each part is a filter over df. Where a
    threshold falls among rows that repeat a key, all rows are ranked instead.
    """
    n = df.count()
    n_test, n_val = max(1, int(n * test_ratio)), max(1, int(n * val_ratio))
    drawn = df.withColumn("_draw", draw(seed, F.col(key)))
    try:
        test, both = (F.coalesce(threshold(drawn.select("_draw", key), k, key), F.lit(False)) for k in (n_test, n_test + n_val))
    except RepeatedKey:
        rows, at = ranked(drawn, [F.col("_draw"), F.col(key)], "_rank").drop("_draw"), F.col("_rank")
        return rows.where(at >= n_test + n_val).drop("_rank"), rows.where((at >= n_test) & (at < n_test + n_val)).drop("_rank"), rows.where(at < n_test).drop("_rank")
    return drawn.where(~both).drop("_draw"), drawn.where(both & ~test).drop("_draw"), drawn.where(test).drop("_draw")


def check_split(train: DataFrame, val: DataFrame, test: DataFrame, whole: DataFrame) -> dict[str, int]:
    """Rows that two parts share, and rows that the parts lack or have too many: all 0 for a right split."""
    everything = train.unionAll(val).unionAll(test)
    return {
        "train_val": train.intersect(val).count(),
        "train_test": train.intersect(test).count(),
        "val_test": val.intersect(test).count(),
        "missing": whole.exceptAll(everything).count(),
        "extra": everything.exceptAll(whole).count(),
    }
