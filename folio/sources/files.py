"""Files listed and read by tasks: the driver holds neither their names nor their contents, and a task reads many of them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of contents that a batch holds on its way out of a task.
FLUSH = 16 << 20
LISTED = "path string, length long, modificationTime timestamp"


def by_tasks(folder: str) -> bool:
    """Whether tasks can open the folder's scheme; Spark's readers know more of them."""
    try:
        fs.FileSystem.from_uri(folder)
    except (pa.ArrowException, OSError, ValueError):
        return False
    return True


def tasks(spark: SparkSession) -> int:
    return 4 * spark.sparkContext.defaultParallelism


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, modificationTime) of the folder's own files and of those in its parts (folders below it that are named key=value, each listed by a task), as Spark's
    readers find them: names that begin with an underscore or a dot are passed over; a missing folder raises when it is read."""
    if not by_tasks(folder):
        return spark.read.format("binaryFile").load(folder).select("path", "length", "modificationTime")
    return listing(spark.createDataFrame([("",)], "below string").coalesce(1), folder)


def listing(looks: DataFrame, folder: str) -> DataFrame:
    """listed, once for each row of looks, a table or a stream, where tasks can open the folder's scheme."""
    base = folder.rstrip("/")

    def entries(deep: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store, root = fs.FileSystem.from_uri(base)
            left = [below for batch in batches for below in batch.column(0).to_pylist()]
            while left:
                below = left.pop()
                if store.get_file_info(f"{root}{below}").type != fs.FileType.Directory:
                    raise FileNotFoundError(f"{base}{below} does not exist")
                found = [x for x in store.get_file_info(fs.FileSelector(f"{root}{below}")) if x.base_name[:1] not in ("_", ".") and (x.is_file or "=" in x.base_name)]
                if deep:
                    left += [f"{below}/{x.base_name}" for x in found if not x.is_file]
                for at in range(0, len(found), 10_000):
                    some = found[at : at + 10_000]
                    columns = [
                        pa.array([f"{below}/{x.base_name}" for x in some], pa.string()), pa.array([x.is_file for x in some], pa.bool_()),
                        pa.array([x.size or 0 for x in some], pa.int64()), pa.array([x.mtime_ns // 1000 if x.mtime_ns else None for x in some], pa.timestamp("us", "UTC")),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["below", "is_file", "length", "modificationTime"])

        return run

    kind = "below string, is_file boolean, length long, modificationTime timestamp"
    top = looks.select(F.lit("").alias("below")).mapInArrow(entries(False), kind)
    parts = top.where("not is_file").select("below").repartition(tasks(looks.sparkSession), "below").mapInArrow(entries(True), kind)
    return top.unionByName(parts).where("is_file").select(F.concat(F.lit(base), "below").alias("path"), "length", "modificationTime")


def mapped(files: DataFrame, read, schema: str, names: list[str], kinds: list[pa.DataType]) -> DataFrame:
    """Rows that read(path, stream of its bytes) gives, as tuples or none, for each of files(path, length); batches are cut by the sizes of their files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        rows, size, stores = [], 0, {}
        for batch in batches:
            for path, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                folder, _, name = path.rpartition("/")
                if folder not in stores:
                    stores = {folder: fs.FileSystem.from_uri(folder)}
                store, root = stores[folder]
                with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    row = read(path, stream)
                if row is None:
                    continue
                rows.append(row)
                size += sum(len(x) for x in row if isinstance(x, bytes)) + length
                if size > FLUSH:
                    yield out()
                    rows, size = [], 0
        if rows:
            yield out()

    spread = files.select("path", "length").repartition(tasks(files.sparkSession), "path")
    return spread.mapInArrow(run, schema)


def contents(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of the folder's files, each read whole; in schemes that tasks can't open empty files are missing, since Spark's readers pass over them."""
    if not by_tasks(folder):
        return spark.read.format("binaryFile").load(folder).select("path", "content")
    return read_whole(listed(spark, folder))


def read_whole(files: DataFrame) -> DataFrame:
    """(path, content) of files(path, length), a table or a stream."""
    return mapped(files, lambda path, stream: (path, stream.read()), "path string, content binary", ["path", "content"], [pa.string(), pa.binary()])


def part_of(name: Column, n: int, copy: Column | int = 0) -> Column:
    """name in one of the parts of a folder that is to get about n files: some 2,000 to a part. A copy of a name, numbered from 1, gets a part that no other copy of it has."""
    parts = n // 2000 + 1
    part = F.pmod(F.xxhash64(name), F.lit(parts)) + (copy if isinstance(copy, Column) else F.lit(copy)) * F.lit(parts)
    return F.concat(F.lit("part="), part.cast("string"), F.lit("/"), name)
