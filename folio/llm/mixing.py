"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import MOST_BROADCAST, SPACES, free_names, let, stored

#: Documents that one reduction step pairs in sequence, on average; its residual goes to the next level.
FAN_IN = 128
#: No source gives more than this many times its words.
MOST_COPIES = 3


def n_words(text: Column) -> Column:
    r"""Number of [^\x20\x09-\x0D]+ in text; null: 0."""
    plain = F.trim(F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     "))
    return F.when(plain == "", F.lit(0)).otherwise(F.size(F.split(plain, " +"))).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = MOST_COPIES) -> DataFrame:
    """(source, n_docs, source_size, target) from sizes(source, size).

    Sources in code point order (null last) have the weights in turn and share all words by weight; what exceeds most
    times a source's own words is shared again among the others by weight until nothing exceeds. That end state is a
    water level: sources sorted by cap over weight are capped while their cap lies below the level that the rest would
    get. One row per source: the windows over all sources see the mixing table only, never documents.
    """
    per = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % len(weights)
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_level = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before, everything = by_level.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    caps, ws = F.coalesce(F.sum("cap").over(before), F.lit(0.0)), F.coalesce(F.sum("w").over(before), F.lit(0.0))
    per = per.withColumn("level", (F.sum("source_size").over(everything) - caps) / (F.sum("w").over(everything) - ws))
    # the level is that of the first source which its cap does not bind
    per = per.withColumn("level", F.min(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct((F.col("cap") / F.col("w")).alias("at"), F.col("level").alias("level")))).over(everything)["level"])
    target = F.least(F.col("cap"), F.coalesce(F.col("level"), F.lit(0.0)) * F.col("w"))
    return per.select("source", "n_docs", "source_size", target.alias("target"))


def chance(*keys: Column) -> Column:
    """A repeatable draw from [0, 1) that depends on the keys alone."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 11).cast("double") / F.lit(float(1 << 53))


def pair(a: Column, b: Column, draw: Column) -> Column:
    """Moves mass between two fractional items so that words stay: (a.p, b.p), of which one at least becomes 0 or 1.

    Items are structs with words m > 0 and probability p. Raising a by u/a.m lowers b by u/b.m. The way is drawn so
    that both expectations stay.
    """
    up = F.least((1 - a["p"]) * a["m"], b["p"] * b["m"])  # words from b to a
    down = F.least(a["p"] * a["m"], (1 - b["p"]) * b["m"])
    goes_up = draw * (up + down) < down
    a_up = F.when((1 - a["p"]) * a["m"] <= b["p"] * b["m"], F.lit(1.0)).otherwise(a["p"] + b["p"] * b["m"] / a["m"])
    b_up = F.when(b["p"] * b["m"] <= (1 - a["p"]) * a["m"], F.lit(0.0)).otherwise(b["p"] - (1 - a["p"]) * a["m"] / b["m"])
    a_down = F.when(a["p"] * a["m"] <= (1 - b["p"]) * b["m"], F.lit(0.0)).otherwise(a["p"] - (1 - b["p"]) * b["m"] / a["m"])
    b_down = F.when((1 - b["p"]) * b["m"] <= a["p"] * a["m"], F.lit(1.0)).otherwise(b["p"] + a["p"] * a["m"] / b["m"])
    return F.struct(F.when(goes_up, a_up).otherwise(a_down).alias("a"), F.when(goes_up, b_up).otherwise(b_down).alias("b"))


#: tie tells rows of one doc_id and size apart, where many are alike.
ITEM = "struct<doc_id:bigint,m:bigint,p:double,tie:bigint>"


def whole(p: Column) -> Column:
    return (p <= 0) | (p >= 1)


def fold(items: Column, seed: int, level: int) -> Column:
    """struct(done array<ITEM>, left ITEM): a block's items paired one after the other; left is the one still fractional, or null."""
    start = F.struct(F.expr(f"cast(array() as array<{ITEM}>)").alias("done"), F.expr(f"cast(null as {ITEM})").alias("left"))

    def item(x: Column, p: Column) -> Column:
        return F.struct(x["doc_id"].alias("doc_id"), x["m"].alias("m"), p.alias("p"), x["tie"].alias("tie"))

    def settle(acc: Column, a: Column, b: Column) -> Column:
        a_whole, b_whole = whole(a["p"]), whole(b["p"])
        done = F.when(a_whole & b_whole, F.array(a, b)).when(a_whole, F.array(a)).otherwise(F.array(b))
        left = F.when(a_whole & b_whole, F.expr(f"cast(null as {ITEM})")).when(a_whole, b).otherwise(a)
        return F.struct(F.concat(acc["done"], done).alias("done"), left.alias("left"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["left"]
        both = let(pair(a, x, chance(F.lit(seed), F.lit(level), a["doc_id"], a["tie"], x["doc_id"], x["m"], x["tie"])), lambda p: settle(acc, item(a, p["a"]), item(x, p["b"])))
        alone = F.when(whole(x["p"]), F.struct(F.concat(acc["done"], F.array(x)).alias("done"), a.alias("left"))).when(a.isNull(), F.struct(acc["done"].alias("done"), x.alias("left")))
        return alone.otherwise(both)

    return F.aggregate(items, start, step)


def settle_last(items: Column, seed: int) -> Column:
    """array<ITEM>, all whole: the last block of a source, sorted by words, the longest first.

    The longer half is folded; its residual is rounded by a draw, and the words by which that misses are moved to the
    items of the shorter half, one after the other, each of which is then rounded too. So the source misses its
    target by about one of its shortest items, not one of its longest.
    """
    half = F.ceil(F.size(items) / 2).cast("int")
    error = f"struct<done:array<{ITEM}>,over:double>"

    def drawn(x: Column, p: Column) -> Column:
        return F.when(chance(F.lit(seed), F.lit("last"), x["doc_id"], x["m"], x["tie"]) < p, F.lit(1.0)).otherwise(F.lit(0.0))

    def rounded(done: Column, over: Column, x: Column, p: Column) -> Column:
        return let(drawn(x, p), lambda up: F.struct(F.concat(done, F.array(F.struct(x["doc_id"].alias("doc_id"), x["m"].alias("m"), up.alias("p"), x["tie"].alias("tie")))).alias("done"), (over + (up - x["p"]) * x["m"]).alias("over")).cast(error))

    def step(acc: Column, x: Column) -> Column:
        p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), x["p"] - acc["over"] / x["m"]))
        return rounded(acc["done"], acc["over"], x, p)

    def rest(f: Column) -> Column:
        start = F.when(f["left"].isNull(), F.struct(f["done"].alias("done"), F.lit(0.0).alias("over")).cast(error)).otherwise(rounded(f["done"], F.lit(0.0), f["left"], f["left"]["p"]))
        return F.aggregate(F.slice(items, half + 1, F.size(items)), start, step)["done"]

    return let(fold(F.slice(items, 1, half), seed, -1), rest)


def mix(docs: DataFrame, seed: int = 0, weights: tuple[float, ...] = (1, 2, 3), most: float = MOST_COPIES) -> DataFrame:
    """One row for each row of docs: doc_id, source, size, source_size, target, copies, taken (= copies * size).

    A source that is to give ratio = target / source_size of its words takes floor(ratio) copies of each document, and
    one more of some, chosen by pivotal dependent rounding: two documents with fractional probabilities exchange mass,
    words for words, in a random direction until one probability is 0 or 1, so that the words taken stay on target.
    Blocks of about FAN_IN documents of a source (split by a hash, so a source of any share of the rows fills many)
    are folded at once and their residuals, one each, meet in blocks of the next level: a reduction tree whose height
    is the logarithm of the largest source. The last block also rounds the last residual (settle_last): a source's words
    taken differ from its target by about a short document. Draws depend on seed, doc_ids and sizes;
    where more than FAN_IN rows share both, also on the rows' places in the files, so that such rows are spread over blocks too. Reruns agree.

    Null source is a source of its own, the last. Null or empty texts have size 0 and floor(ratio) copies. Rows that
    repeat a doc_id are mixed as separate documents. A null doc_id is kept. Empty table: no rows.
    """
    sizes = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", n_words(F.col("text")).alias("size"), F.monotonically_increasing_id().alias("tie")), "sizes")
    if sizes.groupBy("doc_id", "size").count().where(F.col("count") > FAN_IN).isEmpty():
        sizes = sizes.withColumn("tie", F.lit(0).cast("long"))
    targets = stored(source_targets(sizes, weights, most), "targets")
    largest = targets.agg(F.max("n_docs")).first()[0] or 0
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    per = targets.select("source", "target", "source_size", "n_docs", F.floor(ratio + 1e-12).alias("base"), F.greatest(F.lit(0.0), ratio - F.floor(ratio + 1e-12)).alias("p"))
    level, blocks = 0, F.ceil(F.col("n_docs") / FAN_IN)
    there = per.withColumnRenamed("source", "_s")
    rows = sizes.join(there, sizes["source"].eqNullSafe(F.col("_s"))).drop("_s")
    fixed, moving = F.col("size") == 0, ["source", "target", "source_size", "n_docs", "base"]
    whole_rows = rows.where(fixed).select("doc_id", *moving, F.col("size").alias("m"), F.lit(0.0).alias("p"))
    rows = rows.where(~fixed).select("doc_id", *moving, F.col("size").alias("m"), "p", "tie")
    parts = [whole_rows]
    most_left = largest
    while True:
        last = most_left <= FAN_IN
        key = F.lit(0) if last else F.pmod(F.xxhash64(F.lit(level), "doc_id", "m", "tie"), F.ceil(F.col("n_docs") / F.lit(float(FAN_IN) ** (level + 1))))
        order = (-F.col("m")) if last else F.xxhash64(F.lit(seed), "doc_id", "tie")
        items = F.sort_array(F.collect_list(F.struct(order.alias("h"), "doc_id", "m", "p", "tie")))
        grouped = rows.withColumn("_b", key).groupBy(*moving, "_b").agg(items.alias("items"))
        plain = F.transform("items", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["m"].alias("m"), x["p"].alias("p"), x["tie"].alias("tie")))
        if last:
            parts.append(grouped.select(*moving, F.explode(settle_last(plain, seed)).alias("x")).select("x.doc_id", *moving, "x.m", "x.p"))
            break
        folded = stored(grouped.select(*moving, fold(plain, seed, level).alias("f")), f"level{level}")
        parts.append(folded.select(*moving, F.explode("f.done").alias("x")).select("x.doc_id", *moving, "x.m", "x.p"))
        rows = folded.where(F.col("f.left").isNotNull()).select("f.left.doc_id", *moving, "f.left.m", "f.left.p", "f.left.tie")
        most_left, level = math.ceil(most_left / FAN_IN), level + 1
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    copies = F.col("base") + F.when(F.col("p") >= 1, 1).otherwise(0)
    return out.select("doc_id", "source", F.col("m").alias("size"), "source_size", "target", copies.cast("long").alias("copies"), (copies * F.col("m")).cast("long").alias("taken"))


def mix_documents(docs: DataFrame, seed: int = 0, weights: tuple[float, ...] = (1, 2, 3), most: float = MOST_COPIES) -> DataFrame:
    """docs with each row as often as its copies say; all columns of docs, in its order.

    The copies are joined by doc_id, source and size. Rows that repeat all of these share their copies: in the order of a hash of
    their texts each takes its whole share, and the first ones take one more until all are given.
    """
    i, so, si, su, ro, n, c, k = free_names(docs, "_id", "_source", "_size", "_sum", "_rows", "_n", "_copies", "_k")
    key = [F.col("doc_id").alias(i), F.col("source").alias(so), F.col("size").alias(si)]
    drawn = stored(mix(docs, seed, weights, most).groupBy(*key).agg(F.sum("copies").alias(su), F.count(F.lit(1)).alias(ro)), "copies")
    sized = docs.withColumn(n, n_words(F.col("text")))
    on = sized["doc_id"].cast("long").eqNullSafe(F.col(i)) & sized["source"].eqNullSafe(F.col(so)) & (sized[n] == F.col(si))
    small = drawn.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    joined = sized.join(F.broadcast(drawn) if small else drawn.hint("merge"), on)
    own = joined.where(F.col(ro) == 1).withColumn(c, F.col(su).cast("int"))
    if not drawn.where(F.col(ro) > 1).isEmpty():
        place = F.row_number().over(Window.partitionBy(i, so, si).orderBy(F.xxhash64("text"))) - 1
        share = F.floor(F.col(su) / F.col(ro)) + (place < F.col(su) % F.col(ro)).cast("int")
        own = own.unionByName(joined.where(F.col(ro) > 1).withColumn(c, share.cast("int")))
    return own.where(F.col(c) > 0).withColumn(k, F.explode(F.sequence(F.lit(1), F.col(c)))).select(*docs.columns)
