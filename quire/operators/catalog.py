"""Lookups, guards and reports over the site catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_works(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("novel_slug").agg(F.min("ord").alias("first_ord"))


def sites_for_work(catalog: DataFrame, slug: str, enabled_only: bool = False) -> DataFrame:
    rows = catalog.filter(F.col("novel_slug") == slug)
    return (rows.filter("enabled") if enabled_only else rows).orderBy("ord")


def lookup(jobs: DataFrame, catalog: DataFrame) -> DataFrame:
    """Each job's catalog rows by (novel_slug, adapter_key)."""
    return jobs.join(catalog, ["novel_slug", "adapter_key"])


def unknown_references(jobs: DataFrame, catalog: DataFrame) -> DataFrame:
    """Jobs whose key matches nothing, with the known keys of their work."""
    known = catalog.groupBy("novel_slug").agg(F.array_join(F.sort_array(F.collect_set("adapter_key")), ", ").alias("known_keys"))
    missing = jobs.join(catalog, ["novel_slug", "adapter_key"], "left_anti")
    return missing.join(known, "novel_slug", "left").withColumn("known_keys", F.coalesce("known_keys", F.lit("")))


def guarded(jobs: DataFrame, catalog: DataFrame) -> DataFrame:
    """Jobs with status accepted, or refused as all their catalog rows are disabled."""
    on = catalog.groupBy("novel_slug", "adapter_key").agg(F.max("enabled").alias("enabled"))
    return jobs.join(on, ["novel_slug", "adapter_key"]).withColumn("status", F.when(F.col("enabled"), "accepted").otherwise("refused: disabled"))


def duplicate_keys(catalog: DataFrame, *key: str) -> DataFrame:
    return catalog.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def overridden(jobs: DataFrame, catalog: DataFrame) -> DataFrame:
    """Catalog rows as a job sees them: its own use_browser, where given, replaces the catalog's."""
    mine = jobs.select("job_id", "novel_slug", "adapter_key", F.col("use_browser").alias("job_browser"))
    return mine.join(catalog, ["novel_slug", "adapter_key"]).withColumn("use_browser", F.coalesce("job_browser", "use_browser")).drop("job_browser")
