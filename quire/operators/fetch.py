"""Analysis of fetch logs: pacing, cooldowns, challenge streaks, delays, outcomes, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.ordering import SLICE, earlier, sliced, with_summary, within

#: Fixed values of the fetch policy.
HOST_FLOOR_S, COOLDOWN_S = 3.0, 60
STREAK, ROLLING, ROLLING_TRIP = 5, 20, 9
DELAY_FLOOR, DELAY_FACTOR, DELAY_CEILING = 2.0, 1.5, 30.0
BACKOFF_BASE, BACKOFF_FACTOR, BACKOFF_CAP, JITTER = 5.0, 3.0, 120.0, 0.15
RETRY_BUDGET = 2
LADDER = ("plain", "headers", "browser", "browser_fresh")

ORDER = ("ts", "event_id")


def seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def network(log: DataFrame) -> DataFrame:
    """Without cache hits and 429s."""
    return log.filter(~F.col("classification").isin("cache", "rate_limited"))


def too_close(log: DataFrame, floor: float = HOST_FLOOR_S, slices: int | None = None) -> DataFrame:
    """Navigations to a host within `floor` seconds of the one before; cache reads are none."""
    rows = sliced(log.filter("classification <> 'cache'"), "host", *ORDER, slices=slices)
    last = rows.groupBy("host", SLICE).agg(F.max(micros(F.col("ts"))).alias("_last"))
    carried = last.withColumn("_carried", F.max("_last").over(earlier(("host",)))).drop("_last")
    before = F.coalesce(F.lag(micros(F.col("ts"))).over(within(("host",), ORDER)), F.col("_carried"))
    found = with_summary(rows, carried, ("host",)).withColumn("gap_us", micros(F.col("ts")) - before)
    return found.filter(F.col("gap_us") < floor * 1e6).drop("_carried", SLICE)


def in_cooldown(log: DataFrame, slices: int | None = None) -> DataFrame:
    """Navigations before the latest end of the host's earlier cooldowns."""
    end = F.when(F.col("classification") == "rate_limited", micros(F.col("ts")) + F.coalesce("retry_after", F.lit(COOLDOWN_S)) * 1_000_000)
    rows = sliced(log.filter("classification <> 'cache'").withColumn("end", end), "host", *ORDER, slices=slices)
    latest = rows.groupBy("host", SLICE).agg(F.max("end").alias("_end"))
    carried = latest.withColumn("_carried", F.max("_end").over(earlier(("host",)))).drop("_end")
    own = F.max("end").over(within(("host",), ORDER).rowsBetween(Window.unboundedPreceding, -1))
    found = with_summary(rows, carried, ("host",)).withColumn("until", F.greatest(own, "_carried"))
    return found.filter(micros(F.col("ts")) < F.col("until")).drop("_carried", SLICE)


def streaks(log: DataFrame, slices: int | None = None) -> DataFrame:
    """network() with streak (challenges in a row, this one included) and rolling (challenges in the last ROLLING).

    A slice's summary is its streak at the end, whether it is all one streak, and its last results; those of earlier slices give the streak
    and the results that it begins with.
    """
    key = ("run_id",)
    rows = sliced(network(log).withColumn("bad", (F.col("classification") == "challenge").cast("int")), *key, *ORDER, slices=slices)
    order = within(key, ORDER)
    rows = rows.withColumns({"_at": F.row_number().over(order), "island": F.sum(1 - F.col("bad")).over(order)})
    rows = rows.withColumn("_own", F.sum("bad").over(Window.partitionBy(*key, SLICE, "island").orderBy(*ORDER)))
    rows = rows.withColumn("_near", F.sum("bad").over(order.rowsBetween(-(ROLLING - 1), 0)))
    left = F.count("*").over(Window.partitionBy(*key, SLICE)) - F.col("_at")  # rows behind this one in its slice
    ends = rows.withColumn("_left", left).filter(F.col("_left") < ROLLING).groupBy(*key, SLICE).agg(
        F.max_by("_own", "_at").alias("_streak"), (F.max("island") == 0).alias("_whole"), F.transform(F.array_sort(F.collect_list(F.struct("_at", "bad"))), lambda x: x["bad"]).alias("_bits")
    )
    # A streak begins anew in each slice that isn't all challenges; those that are add to it.
    slices_of = Window.partitionBy(*key).orderBy(SLICE)
    ends = ends.withColumn("_island", F.sum(F.when(F.col("_whole"), 0).otherwise(1)).over(slices_of))
    ends = ends.withColumn("_sum", F.sum("_streak").over(Window.partitionBy(*key, "_island").orderBy(SLICE)))
    ends = ends.withColumn("_streak_in", F.coalesce(F.lag("_sum").over(slices_of), F.lit(0)))
    bits = F.flatten(F.collect_list("_bits").over(slices_of.rowsBetween(-ROLLING, -1)))
    ends = ends.withColumn("_bits_in", F.coalesce(bits, F.expr("cast(array() as array<int>)"))).select(*key, SLICE, "_streak_in", "_bits_in")
    found = with_summary(rows, ends, key)
    streak = F.col("_own") + F.when((F.col("island") == 0) & (F.col("bad") == 1), F.col("_streak_in")).otherwise(0)
    # The first rows of a slice also look back at the results before it.
    back = F.least(F.size("_bits_in"), F.greatest(ROLLING - F.col("_at"), F.lit(0)))
    older = F.aggregate(F.slice("_bits_in", F.size("_bits_in") - back + 1, back), F.lit(0), lambda a, x: a + x)
    rolling = F.col("_near") + F.when(back > 0, older).otherwise(0)
    return found.withColumns({"streak": streak, "rolling": rolling}).drop("_at", "_own", "_near", "_streak_in", "_bits_in", SLICE)


def trips(log: DataFrame, slices: int | None = None) -> DataFrame:
    """The first row of each armed run at which its breaker trips."""
    hit = streaks(log, slices).filter(F.col("armed") & ((F.col("streak") >= STREAK) | (F.col("rolling") >= ROLLING_TRIP)))
    first = F.min_by(F.struct("event_id", "streak", "rolling"), F.struct(*ORDER))
    return hit.groupBy("run_id").agg(first.alias("f")).select("run_id", "f.event_id", "f.streak", "f.rolling")


def effective_delay(base: Column, blocks: Column) -> Column:
    """The delay after so many blocks; it has settled after a dozen."""
    start = F.least(base, F.lit(DELAY_CEILING))
    steps = F.when(blocks > 0, F.sequence(F.lit(1), F.least(blocks, F.lit(12)).cast("int"))).otherwise(F.expr("cast(array() as array<int>)"))
    return F.aggregate(steps, start, lambda d, _: F.when(d >= DELAY_CEILING, d).when(d < DELAY_FLOOR, F.lit(DELAY_FLOOR)).otherwise(F.least(d * DELAY_FACTOR, F.lit(DELAY_CEILING))))


def backoff(k: Column) -> Column:
    return F.least(F.lit(BACKOFF_CAP), BACKOFF_BASE * F.pow(F.lit(BACKOFF_FACTOR), k - 1))


def attempts(log: DataFrame) -> DataFrame:
    """attempt number of each chapter in its run, and the strategy it would use."""
    w = Window.partitionBy("run_id", "work", "idx").orderBy(*ORDER)
    rows = log.withColumn("attempt", F.row_number().over(w))
    return rows.withColumn("strategy", F.element_at(F.array(*map(F.lit, LADDER)), F.least("attempt", F.lit(len(LADDER)))))


def rate_limit_outcomes(log: DataFrame) -> DataFrame:
    """Of chapters first answered by 429: the outcome within the retry budget."""
    first = attempts(log).filter(F.col("attempt") <= 1 + RETRY_BUDGET)
    g = first.groupBy("run_id", "work", "idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("attempt", "classification"))), lambda x: x["classification"]).alias("c"))
    other = F.filter("c", lambda x: x != "rate_limited")
    return g.filter(F.get("c", F.lit(0)) == "rate_limited").select("run_id", "work", "idx", F.when(F.size(other) > 0, F.get(other, F.lit(0))).otherwise("failed").alias("outcome"))


def terminal(log: DataFrame) -> DataFrame:
    """One state for each chapter of a run."""
    a = attempts(log)
    has = lambda *c: F.max(F.col("classification").isin(*c))
    g = a.groupBy("run_id", "work", "idx").agg(
        has("success").alias("ok"), F.min_by("classification", F.struct(*ORDER)).alias("first"), has("cache").alias("cached"), has("not_found").alias("gone"), has("extraction_failed").alias("empty"), F.count("*").alias("n"),
        F.min_by("strategy", F.when(F.col("classification") == "success", F.struct(*ORDER))).alias("cleared_by"),
    )
    state = (
        F.when(F.col("first") == "cache", "skipped").when(F.col("first") == "success", "written").when(F.col("ok"), "rescued").when(F.col("gone"), "not_found")
        .when(F.col("empty"), "extraction_failed").when(F.col("n") > len(LADDER), "rescue_exhausted").otherwise("failed")
    )
    return g.select("run_id", "work", "idx", state.alias("state"), "n", F.when(state == "rescued", F.col("cleared_by")).alias("cleared_by"))


def reports(log: DataFrame) -> DataFrame:
    """A row for each run and work: range, counts and sorted lists of ids by state, and what cleared the rescued ones."""
    t = terminal(log)
    ids = lambda *s: F.sort_array(F.collect_set(F.when(F.col("state").isin(*s), F.col("idx"))))
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("cleared_by").isNotNull(), F.struct("idx", "cleared_by")))))
    return t.groupBy("run_id", "work").agg(
        F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.count_if(F.col("state") == "written").alias("written"), F.count_if(F.col("state") == "skipped").alias("skipped"), ids("rescued").alias("rescued"),
        ids("failed", "rescue_exhausted", "not_found").alias("failed"), ids("rescue_exhausted").alias("exhausted"), ids("extraction_failed").alias("empty"), pairs.alias("cleared"),
    )
