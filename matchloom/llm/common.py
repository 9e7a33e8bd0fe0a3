"""What the operators share: reading documents, the shared folder, written tables and flat files in it."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words as every contract here defines them, for JVM regular expressions.
WORD, SPACE = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z only: lower() would also fold other letters."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores before it until df has no such column."""
    used = {c.lower() for c in df.columns}
    while name.lower() in used:
        name = f"_{name}"
    return name


#: Bounds of an Arrow batch, the same for every operator: a plan made earlier is run with what the session says then.
BATCH_ROWS, BATCH_BYTES = 1024, 4 << 20
#: A worker that holds more memory than this at the end of a task gives up what it keeps for the next one.
KEPT_MB = 450


def small_batches(spark: SparkSession) -> None:
    """Whole texts are large, so batches are bounded by bytes; a longer text is a batch of its own."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


_emptied: list[Callable[[], None]] = []
_stage: int | None = None


def kept(cache):
    """cache, a dictionary of this worker process, which is emptied when the worker enters another stage or holds too much."""
    _emptied.append(cache.clear)
    return cache


def empty_caches() -> None:
    """Also gives freed memory back to the system, which the JVM beside the worker may need."""
    import ctypes
    import gc

    import pyarrow as pa

    for clear in _emptied:
        clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:
        pass  # another C library, which does this by itself


def held_mb() -> int:
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") >> 20


def enter_task() -> None:
    global _stage
    from pyspark import TaskContext

    context = TaskContext.get()
    now = context.stageId() if context else None
    if now != _stage:
        _stage = now
        empty_caches()


def leave_task() -> None:
    if not os.path.exists("/proc/self/statm") or held_mb() > KEPT_MB:
        empty_caches()


def tidy(run: Callable[[Iterator], Iterable]) -> Callable[[Iterator], Iterator]:
    """run over the batches of a task, with what the worker keeps bounded by stage and by memory."""

    def inner(batches: Iterator) -> Iterator:
        enter_task()
        try:
            yield from run(batches)
        finally:
            leave_task()

    return inner


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. An own one only where there is none and the master is local: elsewhere executors could not read it."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="matchloom-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, scratch: Scratch | None = None) -> DataFrame:
    """df as a table in the shared folder: lineage ends here, and a lost executor costs one reread."""
    spark = df.sparkSession
    path = scratch.dir(name) if scratch else fresh_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Folders of one operator's drafts, which go when its result is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def dir(self, name: str) -> str:
        self.paths.append(fresh_dir(self.spark, name))
        return self.paths[-1]

    def clear(self) -> None:
        """Through Spark's own file systems, so that any shared store will do."""
        jvm = self.spark._jvm
        for path in self.paths:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        self.paths.clear()


def rows_with(df: DataFrame, key: Column, wanted: DataFrame, name: str) -> DataFrame:
    """Rows of df whose key, a long, is one of wanted's only column. The keys go to the workers as sorted arrays in files, so no row of df is exchanged."""
    spark = df.sparkSession
    small_batches(spark)
    path, buckets = fresh_dir(spark, name), int(spark.conf.get("spark.sql.shuffle.partitions"))

    def sort_keys(group, table):
        import numpy as np
        import pyarrow as pa

        write_flat(f"{path}/keys-{group[0].as_py()}", np.unique(table["key"].to_numpy()).astype("<i8").tobytes())
        return pa.table({"bucket": pa.array([group[0].as_py()], pa.int32())})

    bucket_of = lambda c: F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int")
    bucketed = wanted.toDF("key").select(bucket_of(F.col("key")).alias("bucket"), "key")
    found = {r["bucket"] for r in bucketed.groupBy("bucket").applyInArrow(sort_keys, "bucket int").collect()}  # a row a bucket

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        lists: dict = {}
        for batch in batches:
            keys, bucket = (batch.column(i).to_numpy() for i in (0, 1))
            keep = np.zeros(len(keys), bool)
            for b in np.unique(bucket).tolist():
                if b in found:
                    if b not in lists:
                        lists[b] = map_flat(f"{path}/keys-{b}", "<i8")
                    own = bucket == b
                    at = np.minimum(np.searchsorted(lists[b], keys[own]), len(lists[b]) - 1)
                    keep[own] = lists[b][at] == keys[own]
            if keep.any():
                yield pa.RecordBatch.from_arrays(batch.columns[2:], names=batch.schema.names[2:]).filter(pa.array(keep))

    columns = [F.col(f"`{c}`") for c in df.columns]
    first, second = free_name(df, "key"), free_name(df, "bucket")
    return df.select(key.alias(first), bucket_of(key).alias(second), *columns).mapInArrow(tidy(run), df.schema)


def small_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A bounded driver-made table as a literal: no RDD and no Python worker reads it."""
    import json

    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_flat(uri: str, data: bytes) -> None:
    """Puts a whole file in place at once: a second attempt of a task replaces it by the same bytes."""
    files, path = _filesystem(uri)
    files.create_dir(os.path.dirname(path), recursive=True)
    own = f"{path}.{uuid.uuid4().hex}.part"
    with files.open_output_stream(own) as out:
        out.write(data)
    files.move(own, path)


def map_flat(uri: str, dtype):
    """The file as a read-only array in mapped memory. From a remote store it is fetched into an unlinked local file, so that nothing stays behind."""
    import numpy as np

    files, path = _filesystem(uri)
    if urlsplit(uri).scheme in ("", "file"):
        return np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path) else np.empty(0, dtype)
    with tempfile.TemporaryFile() as local:
        with files.open_input_stream(path) as source:
            while block := source.read(1 << 22):
                local.write(block)
        local.flush()
        return np.memmap(local, dtype=dtype, mode="r") if local.tell() else np.empty(0, dtype)
