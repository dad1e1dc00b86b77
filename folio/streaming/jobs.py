"""Streams in place of polling: annotations as they arrive, the latest status of jobs, quality over time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType

from ..operators.regions import full_text
from ..operators.validate import region_fault
from ..schema import GROUND_TRUTH
from ..sources.annotations import json_columns, judged_files
from ..sources.files import by_tasks, listing, read_whole, tasks


def stream_annotations(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of (reason, raw, image_path, text, full_text, n_regions, n_faults) from JSON-lines files that arrive in folder; a line that is no annotation has a reason, and itself as raw."""
    schema = StructType([*GROUND_TRUTH.fields, StructField("_corrupt_record", StringType())])
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)
    parsed = F.from_json("value", schema, {"columnNameOfCorruptRecord": "_corrupt_record"})
    one = json_columns(lambda n: F.col("j")[n])
    known = lines.where(F.trim("value") != "").select("value", parsed.alias("j")).select("value", *[c.alias(n) for n, c in one.items()])
    faults = F.size(F.filter("regions", lambda r: region_fault(r["box"], r["confidence"]).isNotNull()))
    values = {"image_path": F.col("image_path"), "text": F.col("text"), "full_text": full_text(F.col("regions"), F.col("text")), "n_regions": F.size("regions"), "n_faults": faults}
    good = F.col("reason").isNull()
    return known.select("reason", F.when(~good, F.col("value")).alias("raw"), *[F.when(good, c).alias(n) for n, c in values.items()])


#: Whole files of a micro-batch of Spark's file source: each has a fixed cost of a second or two, and its log of files is rewritten every ten of them.
FILES = 50_000


def stream_ground_truth(spark: SparkSession, folder: str, files_per_batch: int = FILES) -> DataFrame:
    """A stream of judged_ground_truth: whole files of either kind, and others, as they arrive in folder (or in its parts, key=value).

    Each micro-batch is one look at the folder: tasks list it, the stream's state drops the names that were seen before, and tasks read the
    new files. The driver holds no names. A stream without end should have a trigger with an interval, since a look costs as much as the listing.
    Where tasks can't open the folder's scheme, Spark's file source takes files_per_batch files at a time, without empty ones.
    """
    if by_tasks(folder):
        looks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("numPartitions", 1).load()
        new = listing(looks, folder).dropDuplicates(["path"])
        return judged_files(read_whole(new).select("path", F.col("content").cast("string").alias("value")))
    files = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder, wholetext=True)
    return judged_files(files.select(F.col("_metadata.file_path").alias("path"), "value"))


def halves_to_end(stream: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Runs a stream with a column reason over what is there now; returns (good rows, rejects) of all runs so far, from Parquet under path.

    Each micro-batch is judged once and written once, parted into its two outputs, in a folder of its number: one that is
    repeated after a failure replaces what it had written. A further call goes on from the checkpoint. Spark makes a split of every
    32 small files: a task takes many splits, so that neither tasks nor written files grow with them.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        batch.coalesce(tasks(batch.sparkSession)).withColumn("rejected", F.col("reason").isNotNull()).write.mode("overwrite").partitionBy("rejected").parquet(f"{path}/out/epoch={epoch}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    schema = StructType([*stream.schema.fields, StructField("epoch", IntegerType()), StructField("rejected", BooleanType())])
    rows = stream.sparkSession.read.schema(schema).parquet(f"{path}/out")
    return rows.where("not rejected").select(*stream.columns), rows.where("rejected").select(*stream.columns)


#: Groups that jobs are dealt to: a call of Python has a fixed cost of some milliseconds, which a group pays once for all of its jobs.
GROUPS = 512
JOB = "job string, us long, seq long, status string, progress double"
_HELD = pa.schema([("job", pa.string()), ("us", pa.int64()), ("seq", pa.int64()), ("status", pa.string()), ("progress", pa.float64()), ("deadline", pa.int64())])


def _latest(rows: pd.DataFrame) -> pd.DataFrame:
    """Of each job its last row in the order of (us, seq), of equal ones the first, with the largest progress of all."""
    most = rows.groupby("job", dropna=False, sort=False)["progress"].transform("max")
    return rows.assign(progress=most).sort_values(["us", "seq"], ascending=False, kind="stable").drop_duplicates("job")


def job_states(events: DataFrame, delay: str, expiry_seconds: int, job: str = "job_id", groups: int = GROUPS) -> DataFrame:
    """A stream of (job, ts, seq, status, progress, expired) of events(job, ts, seq, status, progress), for update mode: a row whenever a job's state changes.

    A job's state is its last event in the order of (ts, seq), whatever order events arrive in, and the largest progress. A job without
    an event for expiry_seconds, by the watermark (delay behind the latest event), gives a last row with expired and is forgotten, so
    state holds no more than the jobs of that time. Events behind the watermark are dropped. The states of a group of jobs, dealt by a hash
    of the job, are one table in Arrow's format, written anew when any of them changes; its timer is the first of theirs. A stream that
    goes on from a checkpoint needs the same number of groups.
    """
    kind = dict(events.dtypes)[job]
    name = F.col(job).cast("string")
    watched = events.withWatermark("ts", delay).select(F.pmod(F.xxhash64(name), F.lit(groups)).alias("part"), name.alias("job"), "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("seq").cast("long").alias("seq"), "status", F.col("progress").cast("double").alias("progress"))

    def follow(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark, fields = state.getCurrentWatermarkMs(), _HELD.names[:-1]
        held = pa.ipc.open_stream(state.get[0]).read_pandas() if state.exists else _HELD.empty_table().to_pandas()
        rows = None
        for b in () if state.hasTimedOut else batches:
            if len(b):
                rows = _latest(b[fields] if rows is None else pd.concat([rows, b[fields]]))
        left, out = held, []
        if rows is not None:
            seen = held["job"].isin(rows["job"])
            left = held[~seen]
            both = pd.concat([held.loc[seen, fields].assign(new=False), rows.assign(new=True)]) if seen.any() else rows.assign(new=True)
            both = _latest(both.assign(own=both["progress"]))
            same = (both["own"] == both["progress"]) | (both["own"].isna() & both["progress"].isna())
            both["deadline"] = (both["us"] // 1000 + expiry_seconds * 1000).clip(lower=mark + 1)
            out.append(both.loc[both["new"] | ~same, fields].assign(expired=False))
        late = left["deadline"] < mark
        out.append(left.loc[late, fields].assign(expired=True))
        left = left[~late] if rows is None else both[_HELD.names] if late.all() else pd.concat([left[~late], both[_HELD.names]])
        if len(left):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, _HELD) as writer:
                writer.write_table(pa.Table.from_pandas(left, _HELD, preserve_index=False))
            state.update((sink.getvalue().to_pybytes(),))
            state.setTimeoutTimestamp(max(int(left["deadline"].min()), mark))
        elif state.exists:
            state.remove()
        yield from (o for o in out if len(o))

    states = watched.groupBy("part").applyInPandasWithState(follow, f"{JOB}, expired boolean", "held binary", "update", GroupStateTimeout.EventTimeTimeout)
    return states.select(F.col("job").cast(kind).alias(job), F.timestamp_micros("us").alias("ts"), "seq", "status", "progress", "expired")


def latest_status(events: DataFrame, job: str = "job_id") -> DataFrame:
    """(job, status, progress) of events(job, ts, seq, status, progress): the last status and the largest progress. In a stream one state row per job, for update mode."""
    return events.groupBy(job).agg(F.max_by("status", F.struct("ts", "seq")).alias("status"), F.max("progress").alias("progress"))


def windowed_quality(events: DataFrame, size: str, delay: str, *keys: str) -> DataFrame:
    """(window_start, keys, mean_value, n) of events(ts, value) by tumbling windows; in a stream a window closes once the watermark passes it, and later rows are dropped."""
    out = events.withWatermark("ts", delay) if events.isStreaming else events
    out = out.groupBy(F.window("ts", size).alias("w"), *keys).agg(F.avg("value").alias("mean_value"), F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("window_start"), *keys, "mean_value", "n")


def run_to_end(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now into Parquet under path and returns it; update mode keeps, for each micro-batch, what changed."""
    spark = stream.sparkSession

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/epoch={epoch}")

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(StructType([*stream.schema.fields, StructField("epoch", IntegerType())])).parquet(f"{path}/out")
