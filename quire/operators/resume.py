"""Resuming: what exists, what is pending, what a second pass changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.sources.staging import staged

#: Fixed value: the name of a separate file, in any case.
NAME = r"(?i)^Chapter\s+([0-9]+)(?:[^0-9].*)?\.pdf$"


def existing_chapters(manifest: DataFrame) -> DataFrame:
    """novel_slug, idx of separate files, read from their names."""
    n = F.nullif(F.regexp_extract("book_file", NAME, 1), F.lit("")).cast("long")
    return manifest.select("novel_slug", n.alias("idx")).filter("idx is not null").distinct()


def skip_existing(groups: DataFrame, manifest: DataFrame) -> DataFrame:
    """Groups whose file exists are left out."""
    return groups.join(manifest.select("novel_slug", "book_file").distinct(), ["novel_slug", "book_file"], "left_anti")


def planned(chapters: DataFrame, done: DataFrame) -> DataFrame:
    """Chapters with state pending or skipped."""
    have = done.select("novel_slug", "idx").distinct().withColumn("_d", F.lit(True))
    return chapters.join(have, ["novel_slug", "idx"], "left").withColumn("state", F.when(F.col("_d"), "skipped").otherwise("pending")).drop("_d")


def complete_only(parts: DataFrame) -> DataFrame:
    return parts.filter("present = expected")


def first_submissions(rows: DataFrame, by: str, *others: str) -> DataFrame:
    """Of rows with equal `by`, or then with equal others, the first in order of event_id, per work."""
    for keys in ([by], list(others)):
        order = Window.partitionBy("work", *keys).orderBy("event_id")
        rows = rows.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")
    return rows


def accepted_submissions(rows: DataFrame, *keys: str) -> DataFrame:
    """What a sequential rule accepts per work: in order of event_id, each row whose `keys` (index, URL) no accepted row has had before.

    In rounds: a row that is the first of those left in each of its keys is accepted, and rows that share a key with an accepted one
    go. A round takes minima and joins, never a work or a chain of collisions in one task; each settles at least the first row of every
    chain, and a chain of n rows takes n / 2 rounds at most. Null is a key value like others.
    """
    every = [c for c in rows.columns if c not in ("work", *keys, "event_id")]
    # Of rows alike in all keys only the first can be accepted.
    first = rows.groupBy("work", *keys).agg(F.min_by(F.struct("event_id", *every), "event_id").alias("_f")).select("work", *keys, "_f.*")
    left, out = staged(first), None
    while True:
        best = left
        for k in keys:
            low = left.groupBy(F.col("work").alias("_w"), F.col(k).alias("_k")).agg(F.min("event_id").alias(f"_{k}"))
            best = best.join(low, F.col("work").eqNullSafe(F.col("_w")) & F.col(k).eqNullSafe(F.col("_k"))).drop("_w", "_k")
        for k in keys:
            best = best.filter(F.col("event_id") == F.col(f"_{k}"))
        best = staged(best.select(left.columns))
        out = best if out is None else out.unionByName(best)
        for k in keys:
            gone = best.select(F.col("work").alias("_w"), F.col(k).alias("_k"))
            left = left.join(gone, F.col("work").eqNullSafe(F.col("_w")) & F.col(k).eqNullSafe(F.col("_k")), "left_anti")
        left = staged(left)
        if left.isEmpty():
            return out.select(rows.columns)


def second_pass(attempts: DataFrame) -> DataFrame:
    """One row a chapter: a later success replaces a failure and counts as rescued."""
    ok = F.col("classification").isin("success", "cache")
    rank = F.struct(ok.alias("ok"), F.when(ok, -F.col("event_id")).otherwise(F.col("event_id")).alias("e"))
    g = attempts.groupBy("run_id", "work", "idx").agg(F.max_by("classification", rank).alias("outcome"), F.min_by("classification", "event_id").alias("first"), F.count("*").alias("attempts"))
    return g.withColumn("rescued", F.col("outcome").isin("success", "cache") & ~F.col("first").isin("success", "cache"))
