from pyspark.sql import functions as F

from quire.plans import registry
from quire.streaming import streams


def test_submissions_over_more_files_and_days_than_one_batch(spark, tmp_path):
    # 20 files of 10 days each, the newest read first: 8 files a batch.
    for i in range(20):
        day = 10 * (i * 7 % 20)
        rows = spark.range(6).select((F.col("id") + 6 * i).alias("event_id"), (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.lit(day))).alias("ts"), F.col("id").alias("user_id"), F.lit("view").alias("event_type"))
        rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    source = streams.source(spark, str(tmp_path), "events")
    log = source.select("ts", F.lit("w").alias("work"), (F.col("event_id") % 50).alias("idx"))
    got = sorted(r.idx for r in streams.submissions(log, f"{tmp_path}/at").select("idx").collect())
    assert got == list(range(50))
    rows = registry.queries()["stream_submission_dedup"](spark, str(tmp_path)).collect()
    want = {((f"w{e % 6 % 20}"), 1 + e % 40) for e in range(120)}
    assert len(rows) == len(want) and {(r.work, r.idx) for r in rows} == want


def test_folding_again_without_new_files_and_from_nothing(spark, tmp_path):
    kind = "run_id string, work string, idx long, event_id long, classification string"
    rows = [("r", "w", i % 7, i, "success" if i % 3 else "challenge") for i in range(40)]
    for part in range(2):
        spark.createDataFrame(rows[part::2], kind).repartition(9).write.mode("append").parquet(f"{tmp_path}/log.parquet")
        log = streams.source(spark, str(tmp_path), "log")
        first = sorted(map(tuple, streams.fold_results(log, f"{tmp_path}/at").collect()))
        assert first == sorted(map(tuple, streams.fold_results(log, f"{tmp_path}/at").collect()))
    assert [(r[2], r[3], r[4]) for r in first] == [(i, min(e for e in range(40) if e % 7 == i and e % 3), "success") for i in range(7)]
    spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/none.parquet")
    assert streams.fold_results(streams.source(spark, str(tmp_path), "none"), f"{tmp_path}/other").collect() == []


def log_files(spark, path, rows, files):
    kind = "run_id string, event_id long, second long, armed boolean, classification string"
    for k in range(files):
        df = spark.createDataFrame(rows[k::1] if files == 1 else rows[k], kind)
        df.withColumn("ts", F.timestamp_seconds("second")).drop("second").coalesce(1).write.mode("append").parquet(path)


def test_breaker_over_many_batches_with_rows_out_of_order(spark, tmp_path):
    import random

    rng = random.Random(3)
    rows = [(f"r{i % 4}", i, 1_700_000_000 + i // 2, i % 4 != 3, "challenge" if rng.random() < 0.35 or 900 < i < 960 and i % 4 == 1 else "success") for i in range(2000)]
    late = sorted(rows, key=lambda r: r[2] + rng.randint(0, 60))  # up to a minute late
    log_files(spark, f"{tmp_path}/log.parquet", [late[k * 200 : k * 200 + 200] for k in range(10)], 10)
    log = streams.source(spark, str(tmp_path), "log", files_a_batch=1)
    got = sorted(map(tuple, streams.breaker(log, f"{tmp_path}/at", delay_s=120).collect()))
    from quire.operators import fetch

    want = sorted((r.run_id, r.event_id, r.streak, r.rolling) for r in fetch.trips(spark.read.parquet(f"{tmp_path}/log.parquet")).collect())
    assert got == want and len(want) == 3
    assert sorted(map(tuple, streams.breaker(log, f"{tmp_path}/at", delay_s=120).collect())) == want  # again, without new files


def test_pages_over_many_batches_and_again(spark, tmp_path):
    from quire.operators import body

    for k in range(10):
        rows = [(10 * k + i, f"https://h.org/{k}", f"<h1>T{i}</h1><article><p>A sentence that stays, number {i}.</p></article>") for i in range(5)]
        spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/pages.parquet")
    pages = streams.source(spark, str(tmp_path), "pages", files_a_batch=3)
    want = sorted(map(str, body.extract(spark.read.parquet(f"{tmp_path}/pages.parquet")).collect()))
    for _ in range(2):
        assert sorted(map(str, streams.ingest_pages(pages, f"{tmp_path}/at").collect())) == want


def test_folds_write_about_what_comes(spark, tmp_path):
    kind = "run_id string, work string, idx long, event_id long, classification string"
    for k in range(11):
        rows = [("r", f"w{k}", i, 100 * k + i, "success" if i % 3 else "challenge") for i in range(50)] + [("r", "w0", i, 10_000 + 100 * k + i, "success") for i in range(5)]
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log.parquet")
    log = streams.source(spark, str(tmp_path), "log", files_a_batch=1)
    got = sorted(map(tuple, streams.fold_results(log, f"{tmp_path}/at").collect()))
    assert got == sorted(map(tuple, streams.folded(spark.read.parquet(f"{tmp_path}/log.parquet")).collect())) and len(got) == 550
    parts = streams.parts_of(spark, f"{tmp_path}/at")
    assert parts == {b: streams.level_of(b) for b in range(11)} and streams.live(parts, 10) == [10, 9, 8, 7, 3]
    # Batches 0, 1, 2 and 8, 9, 10 write their own rows only.
    assert [streams.part(spark, f"{tmp_path}/at", b, 0).count() for b in (1, 2, 8, 9, 10)] == [55] * 5
