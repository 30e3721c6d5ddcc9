"""Continuous forms: page ingestion, submission dedup, result folding, and the breaker with keyed state.

Each runs what is there (availableNow) and returns what it wrote; checkpoints and outputs lie in the shared folder.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quire.operators import body, fetch
from quire.sources.staging import shared_folder


def folder(spark: SparkSession) -> str:
    """A new folder below the one that all executors share."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def source(spark: SparkSession, sf_dir: str, name: str, files_a_batch: int = 8) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    files = path if is_folder(spark, path) else sf_dir
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch)
    return (reader if files == path else reader.option("pathGlobFilter", f"{name}.parquet")).parquet(files)


def is_folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def settle(stream: DataFrame, at: str, mode: str = "append") -> DataFrame:
    spark = stream.sparkSession
    stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def ingest_pages(pages: DataFrame, at: str, closed: bool = False) -> DataFrame:
    """New pages to chapters; a rerun on the same folder takes only new files."""
    return settle(body.extract(pages, closed), at)


def submissions(log: DataFrame, at: str) -> DataFrame:
    """Each (work, idx) once, however late or long after its first: the keys held as state are bounded by the chapters."""
    return settle(log.dropDuplicates(["work", "idx"]), at)


FOLDED = ["run_id", "work", "idx", "event_id", "classification"]
#: So many parts of one level become one of the next.
FANOUT = 4


def folded(rows: DataFrame) -> DataFrame:
    """One row a chapter: a success before a failure, the earliest of equals."""
    rank = F.struct((~F.col("classification").isin("success", "cache")).alias("bad"), "event_id")
    best = rows.groupBy("run_id", "work", "idx").agg(F.min_by(F.struct("event_id", "classification"), rank).alias("b"))
    return best.select("run_id", "work", "idx", "b.event_id", "b.classification")


def level_of(batch: int) -> int:
    """The level of the part that a batch writes: how often FANOUT divides the number of batches so far."""
    n, level = batch + 1, 0
    while n % FANOUT == 0:
        n, level = n // FANOUT, level + 1
    return level


def live(parts: dict[int, int], last: int) -> list[int]:
    """Of parts (batch to level), those that together hold batches 0 to `last`: the latest, and before what it covers the latest again."""
    out = []
    while last >= 0:
        if last in parts:
            out.append(last)
            last -= FANOUT ** parts[last]
        else:
            last -= 1
    return out


def fold_results(log: DataFrame, at: str) -> DataFrame:
    """Results folded into one row a chapter. A batch writes one part: its own rows folded, and with every FANOUT-th batch the parts before it
    that are of lower levels. So a row is written again only as often as its level rises, and the bytes of a batch don't follow the whole.
    A part that a repeated batch writes replaces its own."""
    spark = log.sparkSession

    def upsert(batch: DataFrame, number: int) -> None:
        level, rows = level_of(number), batch.select(*FOLDED)
        known = {b: v for b, v in parts_of(spark, at).items() if b < number}
        for b in live(known, number - 1):
            if b > number - FANOUT**level:
                rows = rows.unionByName(part(spark, at, b, known[b]))
        folded(rows).write.mode("overwrite").parquet(f"{at}/fold-{number}-{level}")

    log.writeStream.foreachBatch(upsert).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    known = parts_of(spark, at)
    rows = spark.createDataFrame([], log.select(*FOLDED).schema)
    for b in live(known, max(known, default=-1)):
        rows = rows.unionByName(part(spark, at, b, known[b]))
    return folded(rows)


def part(spark: SparkSession, at: str, batch: int, level: int) -> DataFrame:
    return spark.read.parquet(f"{at}/fold-{batch}-{level}")


def parts_of(spark: SparkSession, at: str) -> dict[int, int]:
    """The whole parts written so far, batch to level."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{at}/fold-*/_SUCCESS")
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return dict(tuple(map(int, s.getPath().getParent().getName().split("-")[1:])) for s in found or ())


BREAKER = "run_id string, event_id bigint, streak bigint, rolling bigint"


def walked(run: str, rows: list[list], streak: int, recent: str, tripped: bool) -> tuple[list[tuple], int, str, bool]:
    """Rows (ts, event_id, bad, armed) of a run in order: where it trips, and its streak, last results and latch afterwards."""
    found = []
    for _, event, bad, armed in rows:
        streak = streak + 1 if bad else 0
        recent = (recent + "01"[bad])[-fetch.ROLLING :]
        if armed and not tripped and (streak >= fetch.STREAK or recent.count("1") >= fetch.ROLLING_TRIP):
            tripped = True
            found.append((run, event, streak, recent.count("1")))
    return found, streak, recent, tripped


def breaker(log: DataFrame, at: str, delay_s: int = 3600) -> DataFrame:
    """run_id, event_id, streak, rolling of the row at which each armed run trips.

    Rows wait in the run's state until the watermark (the latest time seen less delay_s) has passed them, so rows that come late by no more
    than that are walked in their order. What still waits at the end is walked from the stored state. A run that has tripped keeps no rows.
    """
    spark = log.sparkSession

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak, recent, tripped, waiting = state.get if state.exists else (0, "", False, "[]")
        rows = json.loads(waiting)
        for f in frames:
            rows += [] if tripped else zip(f["us"].tolist(), f["event_id"].tolist(), f["bad"].tolist(), f["armed"].tolist(), strict=True)
        rows.sort(key=lambda r: (r[0], r[1]))
        passed = state.getCurrentWatermarkMs() * 1000
        due = next((i for i, r in enumerate(rows) if r[0] >= passed), len(rows))
        found, streak, recent, tripped = walked(key[0], rows[:due], streak, recent, tripped)
        rows = [] if tripped else rows[due:]
        state.update((streak, recent, tripped, json.dumps(list(map(list, rows)))))
        if rows:
            state.setTimeoutTimestamp(max(rows[0][0], passed) // 1000 + 1)
        yield pd.DataFrame(found, columns=["run_id", "event_id", "streak", "rolling"])

    rows = fetch.network(log).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", f"{delay_s} seconds")
    rows = rows.select("run_id", "event_id", "ts", fetch.micros(F.col("ts")).alias("us"), F.coalesce("armed", F.lit(False)).alias("armed"), (F.col("classification") == "challenge").cast("int").alias("bad"))
    out = rows.groupBy("run_id").applyInPandasWithState(step, BREAKER, "streak int, recent string, tripped boolean, waiting string", "append", GroupStateTimeout.EventTimeTimeout)
    done = settle(out, at)

    def rest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [x for r in f.itertuples() for x in walked(r.run_id, json.loads(r.waiting), r.streak, r.recent, r.tripped)[0]]
            yield pd.DataFrame(found, columns=["run_id", "event_id", "streak", "rolling"])

    if not any_batch(spark, at):
        return done
    states = spark.read.format("statestore").load(f"{at}/state").select("key.*", "value.groupState.*")
    return done.unionByName(states.filter("not tripped").select("run_id", "streak", "recent", "tripped", "waiting").mapInPandas(rest, BREAKER))


def any_batch(spark: SparkSession, at: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{at}/state/commits/[0-9]*")
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p))
