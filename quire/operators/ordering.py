"""Orders of any length, in two levels: no task holds a whole key.

Rows are split into slices, which are ranges of (key, order): a key that holds most of all rows lies in many slices, and a slice
holds about as many rows as any other. What a row needs from the rows before it comes from its own slice, by a window, and from a summary of
the key's earlier slices, which has one row a key and slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quire.sources.staging import staged

SLICE = "_slice"


def sliced(df: DataFrame, *by: str, slices: int | None = None) -> DataFrame:
    """df with SLICE, the number of its range of `by`; rows equal in all of `by` share one. Staged, as bounds of ranges are drawn from a
    sample and would differ if they were drawn again. slices: how many; as many as shuffle partitions if not given."""
    n = slices or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return staged(df.repartitionByRange(n, *by).withColumn(SLICE, F.spark_partition_id()))


def within(keys: tuple[str, ...], order: tuple[str, ...]) -> WindowSpec:
    """The rows of a key in one slice, in order."""
    return Window.partitionBy(*keys, SLICE).orderBy(*order)


def earlier(keys: tuple[str, ...]) -> WindowSpec:
    """Of a summary with a row for each key and slice: the earlier slices of the key."""
    return Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)


def with_summary(rows: DataFrame, summary: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Rows with the columns of their key's and slice's summary; null keys are keys like others."""
    s = summary.select(*(F.col(k).alias(f"_s_{k}") for k in (*keys, SLICE)), *(c for c in summary.columns if c not in (*keys, SLICE)))
    same: Column = F.lit(True)
    for k in (*keys, SLICE):
        same = same & F.col(k).eqNullSafe(F.col(f"_s_{k}"))
    return rows.join(s, same).drop(*(f"_s_{k}" for k in (*keys, SLICE)))


def placed(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], name: str, slices: int | None = None) -> DataFrame:
    """df with `name`, the place (from 1) of each row in its key's order; without keys, in the order of all rows.

    Rows move once, to their slice, where their number in the slice's order is written with them; only the counts of keys and slices are
    looked at again, and a row's place is its number, less the rows of other keys before its own, plus those of its key in earlier slices.
    """
    own = keys or ("_all",)
    n = slices or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = (df if keys else df.withColumn("_all", F.lit(0))).repartitionByRange(n, *own, *order).sortWithinPartitions(*own, *order)
    # The id counts a partition's rows in its lower 33 bits.
    rows = staged(rows.withColumns({SLICE: F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    sizes = rows.groupBy(*own, SLICE).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(earlier(own)), F.lit(0)) - F.col("_first") + 1).drop("_n", "_first")
    found = with_summary(rows, before, own).withColumn(name, F.col("_at") + F.col("_before"))
    return found.drop("_at", "_before", SLICE, *(() if keys else own))
