"""Exact deduplication with a heavy-hitter split, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, stored, with_group, with_ids


def unchanged(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def exact_groups(docs: DataFrame, normalise=unchanged) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their normalised UTF-8 has the same SHA-256; normalise maps the text column (null text: as
    normalise says, by default empty). Of equal texts the largest doc_id stays. Misra-Gries finds the frequent digests;
    their winners, verified by exact aggregation, are broadcast (at most HOT_KEYS rows) and decide their rows on the map
    side. The other digests are grouped after an ordinary shuffle of narrow rows.

    Ties: rows that repeat the winning doc_id are all marked kept here (exact_dedup keeps one of them). A null doc_id
    loses to any other; a group of null doc_ids alone has a null keep_id and is kept. Empty table: no rows.
    """
    narrow = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(normalise(F.col("text")), 256).alias("text_sha256")), "digests")
    groups = with_group(narrow, "text_sha256", keep_id=F.max("doc_id"), group_size=F.count(F.lit(1)))
    return groups.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def exact_dedup(docs: DataFrame, normalise=unchanged) -> DataFrame:
    """docs without the rows whose equal text stays elsewhere; all columns of docs, in its order.

    Rows that repeat doc_id and text are one document and come out once (of their other columns, one row's are
    taken). Null doc_ids with equal texts come out once as well.
    """
    i, d = free_names(docs, "_id", "_digest")
    groups = stored(exact_groups(docs, normalise), "groups")
    repeated = groups.where("kept").groupBy("text_sha256", "doc_id").count().where("count > 1").limit(1).count() > 0
    marked = docs.withColumn(d, F.sha2(normalise(F.col("text")), 256)).withColumn(i, F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    named = groups.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias(i), F.col("text_sha256").alias(d), "kept")
    if repeated:
        kept = stored(named.where("kept").select(i, d).distinct(), "kept")
        return with_ids(marked, kept, [i, d]).dropDuplicates([i, d]).select(*docs.columns)
    gone = stored(named.where(~F.col("kept")).select(i, d), "gone")
    return with_ids(marked, gone, [i, d], "left_anti").select(*docs.columns)


#: What DuckDB answers for exact_groups on documents.
SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
