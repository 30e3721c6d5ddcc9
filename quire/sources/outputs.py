"""Sinks. Spark's commit protocol makes each write appear whole or not at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.urls import cache_key


def write_pages(pages: DataFrame, path: str) -> None:
    """Raw pages, a folder a work; a rewrite replaces only the works it holds."""
    pages.write.partitionBy("novel_slug").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def write_books(books: DataFrame, path: str, version: int = 0, files: int | None = None) -> None:
    """Books packed into few files, sorted by work and file name, so that the footers' statistics tell where a book can be. A later version
    of a book stands beside the earlier one and is the one that is read."""
    rows = books.select("novel_slug", "book_file", F.lit(version).cast("long").alias("version"), "text")
    n = files or max(1, int(books.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows.repartitionByRange(n, "novel_slug", "book_file").sortWithinPartitions("novel_slug", "book_file").write.mode("append").parquet(path)


def read_books(spark: SparkSession, path: str, novel_slug: str | None = None, book_file: str | None = None) -> DataFrame:
    """novel_slug, book_file, text of the latest version of each book; of one work or book only what may hold it is scanned."""
    rows = spark.read.parquet(path)
    for column, value in (("novel_slug", novel_slug), ("book_file", book_file)):
        rows = rows.filter(F.col(column) == value) if value is not None else rows
    latest = rows.groupBy("novel_slug", "book_file").agg(F.max("version").alias("version"))
    return rows.join(latest, ["novel_slug", "book_file", "version"]).select("novel_slug", "book_file", "text")


#: Folders that archived pages are dealt to by the hash of their key.
BUCKETS = 64


def bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def write_archive(pages: DataFrame, path: str) -> None:
    """Raw pages (url, html, others) by cache key: dealt to folders by its hash, sorted by it, with a Bloom filter of the keys in each file."""
    rows = pages.withColumn("cache_key", cache_key(F.col("url"))).withColumn("bucket", bucket(F.col("cache_key")))
    rows = rows.repartition(BUCKETS, "bucket").sortWithinPartitions("bucket", "cache_key")
    rows.write.partitionBy("bucket").mode("append").option("parquet.bloom.filter.enabled#cache_key", "true").parquet(path)


def archived(spark: SparkSession, path: str, url: str) -> DataFrame:
    """The stored pages of one URL: one folder is read, and of its files only those whose filter and statistics may hold the key."""
    key = spark.range(1).select(cache_key(F.lit(url)).alias("k"), bucket(cache_key(F.lit(url))).alias("b")).first()
    return spark.read.parquet(path).filter((F.col("bucket") == key.b) & (F.col("cache_key") == key.k)).drop("bucket")


def append_report(report: DataFrame, path: str) -> None:
    report.write.mode("append").json(path)


def read_raw_pages(spark, path: str) -> DataFrame:
    """Stored HTML files, one page a file; unreadable ones count as missing."""
    files = spark.read.option("ignoreCorruptFiles", "true").text(path, wholetext=True)
    return files.select(F.col("_metadata.file_name").alias("cache_key"), F.col("value").alias("html"))
