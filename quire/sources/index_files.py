"""Stored chapter indexes: tolerant reading and writing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ENTRY = "array<struct<index:bigint,url:string,title:string,source_id:string>>"


def load_index(raw: DataFrame, *keys: str) -> DataFrame:
    """Entries of stored JSON arrays in column raw; anything missing, malformed, no list or empty gives no rows."""
    listed = raw.filter(F.startswith(F.ltrim("raw"), F.lit("[")))
    rows = listed.select(*keys, F.posexplode(F.from_json("raw", ENTRY)).alias("pos", "e"))
    return rows.select(*keys, "pos", F.col("e.index").alias("idx"), "e.url", "e.title", "e.source_id").filter("idx is not null and url is not null")


def save_index(index: DataFrame, path: str) -> None:
    index.select(F.col("idx").alias("index"), "url", "title", "source_id").write.mode("overwrite").json(path)


def read_index(spark, path: str) -> DataFrame:
    rows = spark.read.schema("index bigint, url string, title string, source_id string").option("mode", "DROPMALFORMED").json(path)
    return rows.withColumnRenamed("index", "idx")


# ---- a store of versions: what is damaged is never read, and what has no valid version is known ------------------------------
STORED = "version bigint, n bigint, mark bigint, raw string"


def save_version(index: DataFrame, path: str, version: int, *keys: str) -> None:
    """Adds a version of the indexes of the works that `index` (keys, idx, url, title, source_id) holds: a row a work, its entries as the JSON
    array that load_index() reads, with their number and a mark of the text."""
    entry = F.struct(F.col("idx").alias("index"), "url", "title", "source_id")
    raw = F.to_json(F.array_sort(F.collect_list(entry)), {"ignoreNullFields": "false"})
    rows = index.groupBy(*keys).agg(F.count("*").alias("n"), raw.alias("raw"))
    rows.select(*keys, F.lit(version).cast("long").alias("version"), "n", F.xxhash64("raw").alias("mark"), "raw").write.mode("append").parquet(path)


def last_valid(stored: DataFrame, *keys: str) -> DataFrame:
    """keys, version, idx, url, title, source_id of each work's latest version that is whole: its mark fits, and all its entries can be read."""
    read = F.from_json("raw", ENTRY)
    whole = F.filter(F.coalesce(read, F.expr(f"cast(array() as {ENTRY})")), lambda e: e["index"].isNotNull() & e["url"].isNotNull())
    valid = stored.filter(F.xxhash64("raw") == F.col("mark")).withColumn("entries", whole).filter((F.col("n") > 0) & (F.size("entries") == F.col("n")))
    latest = valid.groupBy(*keys).agg(F.max_by(F.struct("version", "entries"), "version").alias("v"))
    rows = latest.select(*keys, "v.version", F.explode("v.entries").alias("e"))
    return rows.select(*keys, "version", F.col("e.index").alias("idx"), "e.url", "e.title", "e.source_id")


def read_store(spark, path: str, schema: str, *keys: str) -> DataFrame:
    """last_valid() of a store; schema: the DDL of its keys."""
    return last_valid(spark.read.schema(f"{schema}, {STORED}").parquet(path), *keys)


def completed(found: DataFrame, rebuilt: DataFrame, *keys: str) -> DataFrame:
    """The works' stored indexes, and for works without one the rows of `rebuilt`, as version 0."""
    missing = rebuilt.join(found.select(*keys).distinct(), [*keys], "left_anti").withColumn("version", F.lit(0).cast("long"))
    return found.unionByName(missing.select(found.columns))
