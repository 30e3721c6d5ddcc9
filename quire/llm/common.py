"""Shared pieces: staged tables in the cluster's shared folder, Arrow batches cut to bounded chunks."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bytes of text handled at once inside a task; longer single texts are handled alone.
CHUNK_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a fresh one in local mode only."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        known = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", known)
    return known.rstrip("/")


#: Has Spark delete a query's shuffle files at its end. It would else do so when the driver's memory runs short, which a large table may not bring about.
FREES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files behind. Only for writes: a DataFrame that is collected twice would be computed twice."""
    before = spark.conf.get(FREES, None)
    spark.conf.set(FREES, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREES) if before is None else spark.conf.set(FREES, before)


def written(df: DataFrame, path: str) -> DataFrame:
    spark = df.sparkSession
    with freed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}/{name}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there and a lost executor costs nothing."""
    return written(df, stage_path(df.sparkSession, name))


@contextmanager
def held(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """A staged table that is deleted at the end: for large ones, which nothing reads after the block."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    try:
        yield written(df, path)
    finally:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at.getParent(), True)


def small_batches(spark: SparkSession, size: int = 1 << 20) -> None:
    """Has Spark hand rows to Python in batches of about `size` bytes, unless the session says otherwise. Larger ones are cut into chunks
    there anyway, and the JVM's buffers for them, which it keeps, would take hundreds of MB an executor."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark.conf.get(key, None):
        spark.conf.set(key, str(size))


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def buckets_for(spark: SparkSession) -> int:
    """Hash ranges that packed rows are dealt to: a power of two, about four a shuffle partition."""
    return 1 << max(6, (4 * shuffle_partitions(spark) - 1).bit_length())


def lowest(df: DataFrame, key: Column, rows: int) -> DataFrame:
    """At most `rows` rows: those of the lowest hash ranges of key that hold no more together. A bounded sample that sends only
    its own rows to the driver, however many tasks there are (a sort with limit sends that many from each task)."""
    part = F.pmod(F.xxhash64(key, F.lit(17)), F.lit(1 << 14))
    counts = df.groupBy(part.alias("p")).count().toPandas().sort_values("p")
    held = int((counts["count"].cumsum() <= rows).sum())
    if not held:  # one range alone holds more
        return df.filter(part == int(counts["p"].iloc[0])).limit(rows) if len(counts) else df.limit(0)
    return df.filter(part <= int(counts["p"].iloc[held - 1]))


def running(rows: DataFrame, by: list[str], sums: list[str]) -> DataFrame:
    """rows with, for each column of `sums`, <name>_to: its sum over all rows up to this one in the order of `by`. Ranges of that order (column
    part) are summed on their own, each after what the ones before it hold."""
    held = stage(rows.repartitionByRange(shuffle_partitions(rows.sparkSession), *by).withColumn("part", F.spark_partition_id()), "ordered")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    before = held.groupBy("part").agg(*(F.sum(s).alias(s) for s in sums)).select("part", *(F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(f"{s}_before") for s in sums))
    own = Window.partitionBy("part").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    return held.join(F.broadcast(before), "part").select(*held.columns, *((F.sum(s).over(own) + F.col(f"{s}_before")).alias(f"{s}_to") for s in sums))


def by_score(rows: DataFrame) -> DataFrame:
    """score, good, bad, good_to, bad_to, part: of each distinct score, the rows (score, good) of each kind with it, and up to it."""
    kinds = rows.groupBy("score").agg(F.sum(F.col("good").cast("long")).alias("good"), F.sum((~F.col("good")).cast("long")).alias("bad"))
    return running(kinds, ["score"], ["good", "bad"])


def text_rows(docs: DataFrame, *more: str) -> DataFrame:
    """Only the columns that an operator reads; a null text counts as empty."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most `limit` bytes of text, or one row."""
    import numpy as np

    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        size = np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64)
        ends, lo = np.cumsum(size), 0
        while lo < len(ends):
            hi = max(lo + 1, int(np.searchsorted(ends, limit + (ends[lo - 1] if lo else 0), side="right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def tidy(batches: Iterator) -> Iterator:
    """The same batches; what the task freed goes back to the system at its end, as Spark keeps the worker for further tasks."""
    yield from batches
    give_back()


def give_back() -> None:
    """Hands freed memory of this process back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def chunk_rows(iterator: Iterator, work):
    """mapInArrow body: `work` turns one chunk into a record batch (or None)."""

    def each():
        for chunk in chunks(iterator):
            out = work(chunk)
            if out is not None and out.num_rows:
                yield out

    return tidy(each())
