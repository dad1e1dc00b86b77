"""What several operators share: tables in the shared folder, hot keys, representatives, components."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space and words as the byte-level contracts define them.
SPACES = r"[\x20\x09-\x0D]+"

#: Counters of the heavy-hitter summary. Its answer, and so each broadcast built from it, has at most HOT_KEYS rows.
COUNTERS, HOT_KEYS = 4096, 512

_own_folder: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; a folder of this process's own where that is unset, as in tests, on a local master only."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there.rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folder:
        _own_folder[app] = "file://" + tempfile.mkdtemp(prefix="folio-")
    return _own_folder[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Writes df once to the shared folder and reads it back: the lineage ends there, and lost executors cost nothing that was written."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Deletes the files of a table made by stored() that no later step reads."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once for each row."""
    return F.transform(F.array(value), body)[0]


def free_names(df: DataFrame, *names: str) -> list[str]:
    """names, with as many underscores before each as it takes to be none of df's columns (which Spark compares without case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def wide(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt over as many tasks as the session's shuffles have, by keys or evenly."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys) if keys else df.repartition(n)


def hot_keys(df: DataFrame, key: str, least_share: float = 1 / 512) -> DataFrame:
    """Keys that may hold at least least_share of df's rows: (key, about).

    The summary is Misra-Gries in the form of Spark's approx_top_k: each task keeps COUNTERS counters and
    only these are merged. Every key above the share is found (its error is below rows * 4 / COUNTERS);
    rarer keys may come along, so counts must be verified. At most HOT_KEYS rows. Null keys are left out.
    """
    top = df.where(F.col(key).isNotNull()).agg(F.expr(f"approx_top_k(`{key}`, {HOT_KEYS}, {COUNTERS})").alias("top"), F.count("*").alias("rows"))
    one = top.select(F.explode("top").alias("t"), "rows")
    return one.where(F.col("t.count") >= F.greatest(F.lit(2), F.col("rows") * least_share)).select(F.col("t.item").alias(key), F.col("t.count").alias("about"))


def with_group(rows: DataFrame, key: str, **aggregates: Column) -> DataFrame:
    """rows plus aggregates over the rows of equal key, without a task that gathers a hot key.

    Heavy hitters get their exact figures by a partial aggregation and a broadcast of at most HOT_KEYS rows; for all
    other keys, each with a small share of the rows, the figures are joined after an ordinary shuffle. rows should be
    narrow and stored: it is read four times. Null keys get null figures.
    """
    names = list(aggregates)
    found = stored(hot_keys(rows, key).select(F.col(key).alias("_hot")), "hot")
    hot = rows.join(F.broadcast(found), F.col(key) == F.col("_hot"), "left_semi").groupBy(F.col(key).alias("_hot")).agg(*[c.alias(f"_g_{n}") for n, c in aggregates.items()])
    hot = stored(hot, "winners")
    marked = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    done = marked.where(F.col("_hot").isNotNull()).select(*rows.columns, *[F.col(f"_g_{n}").alias(n) for n in names])
    rest = marked.where(F.col("_hot").isNull()).select(*rows.columns)
    group = Window.partitionBy(key)
    rest = rest.select(*rows.columns, *[c.over(group).alias(n) for n, c in aggregates.items()])
    return done.unionByName(rest)


#: Ids up to this number are broadcast; more are joined after a shuffle.
MOST_BROADCAST = 500_000


def with_ids(rows: DataFrame, ids: DataFrame, on: str | list[str], how: str = "left_semi") -> DataFrame:
    """rows joined to ids, a stored table with the columns on (and few narrow others): a broadcast where a count shows at most MOST_BROADCAST rows, else a shuffle."""
    small = ids.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    return rows.join(F.broadcast(ids) if small else ids.hint("merge"), on, how)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of edges(a, b): component is the smallest node that links reach.

    Alternating large-star and small-star steps (Kiveris et al. 2014), each written to the shared folder; a
    logarithmic number of rounds. Partial aggregation keeps a node with very many links from gathering in one task:
    a star step needs only each node's smallest neighbour, joined back to the links. No links: no rows.
    """
    e = stored(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stored(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
        # large star: neighbours above a node go to the smallest of its neighbourhood
        large = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b")).distinct()
        e1 = stored(large, "links")
        # small star: neighbours below a node, and the node, go to the smallest of them
        low2 = stored(e1.groupBy("a").agg(F.min("b").alias("m")), "least")
        down = e1.join(low2, "a")
        small = down.select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b")).unionByName(low2.select("a", F.col("m").alias("b"))).distinct()
        e2 = stored(small, "links")
        now = e2.agg(F.count("*").alias("n"), F.sum(F.hash("a", "b").cast("long")).alias("h"), F.countDistinct("a").alias("d")).first()
        for old in (e, low, e1, low2):
            drop_stored(old)
        e = e2
        if (now["n"], now["h"]) == before and now["n"] == now["d"]:
            break
        before = (now["n"], now["h"])
    out = e.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component")
    roots = e.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return out.unionByName(roots)


def tasks_for(rows: int, each: int) -> int:
    return max(1, math.ceil(rows / each))
