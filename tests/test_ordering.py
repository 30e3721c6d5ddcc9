"""Two-level orders against plain windows, with a host that holds nine rows in ten."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.operators import books, fetch, ordering


@pytest.fixture(scope="module")
def log(spark):
    i = F.col("id")
    rows = spark.range(3000).select(
        i.alias("event_id"), (F.timestamp_seconds(F.floor(i * 7 % 3000 / 3) * 2 + 1_700_000_000)).alias("ts"),
        F.when(i % 10 < 9, "hot").when(i % 20 == 9, "cold").alias("host"), F.when(i % 10 < 9, "r1").when(i % 20 == 9, "r2").alias("run_id"), (i % 3 > 0).alias("armed"),
        F.when((i * 7 % 3000).between(900, 1100), "challenge").when(F.xxhash64(i) % 5 == 0, "rate_limited").when(F.xxhash64(i) % 7 == 1, "cache").when(F.xxhash64(i) % 3 == 0, "challenge").otherwise("success").alias("classification"),
        F.when(i % 4 == 0, i % 50).cast("int").alias("retry_after"),
    )
    rows.persist().count()
    return rows


def plain_streaks(log):
    w = Window.partitionBy("run_id").orderBy("ts", "event_id")
    rows = fetch.network(log).withColumn("bad", (F.col("classification") == "challenge").cast("int")).withColumn("island", F.sum(1 - F.col("bad")).over(w))
    rows = rows.withColumn("streak", F.sum("bad").over(Window.partitionBy("run_id", "island").orderBy("ts", "event_id")))
    return rows.withColumn("rolling", F.sum("bad").over(w.rowsBetween(-19, 0)))


@pytest.mark.parametrize("slices", [1, 7, 40])
def test_streaks(log, slices):
    columns = ["event_id", "streak", "rolling"]
    got, want = (sorted(map(tuple, d.select(columns).collect())) for d in (fetch.streaks(log, slices), plain_streaks(log)))
    assert got == want and max(r[1] for r in got) > 19


@pytest.mark.parametrize("slices", [1, 7, 40])
def test_pacing_and_cooldowns(log, slices):
    w = Window.partitionBy("host").orderBy("ts", "event_id")
    rows = log.filter("classification <> 'cache'").withColumn("t", fetch.micros(F.col("ts")))
    close = rows.withColumn("gap", F.col("t") - F.lag("t").over(w)).filter("gap < 3000000").select("event_id", "gap").collect()
    assert sorted(map(tuple, fetch.too_close(log, slices=slices).select("event_id", "gap_us").collect())) == sorted(map(tuple, close)) and close
    end = F.when(F.col("classification") == "rate_limited", F.col("t") + F.coalesce("retry_after", F.lit(60)) * 1_000_000)
    cool = rows.withColumn("e", end).withColumn("until", F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))).filter("t < until").select("event_id").collect()
    assert sorted(r.event_id for r in fetch.in_cooldown(log, slices).collect()) == sorted(r.event_id for r in cool) and cool


@pytest.mark.parametrize("slices", [1, 7, 40])
def test_places(log, slices):
    w = Window.partitionBy("host").orderBy("ts", "event_id")
    want = sorted((r.event_id, r.n) for r in log.withColumn("n", F.row_number().over(w)).collect())
    assert sorted((r.event_id, r.n) for r in ordering.placed(log, ("host",), ("ts", "event_id"), "n", slices).collect()) == want
    whole = log.withColumn("n", F.row_number().over(Window.orderBy("ts", "event_id"))).collect()
    assert sorted((r.event_id, r.n) for r in ordering.placed(log, (), ("ts", "event_id"), "n", slices).collect()) == sorted((r.event_id, r.n) for r in whole)
    assert ordering.placed(log.filter("event_id < 0"), (), ("ts",), "n", slices).collect() == []


def test_a_hot_host_is_split(log):
    sizes = ordering.sliced(log, "host", "ts", "event_id", slices=20).groupBy("host", ordering.SLICE).count().collect()
    assert max(r["count"] for r in sizes) < 0.12 * 3000 and sum(r["count"] for r in sizes) == 3000


def test_no_window_holds_a_work(log):
    rows = log.select(F.col("host").alias("novel_slug"), F.col("event_id").alias("page_id"))
    plan = books.numbered(rows, "page_id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1 and "row_number" not in plan  # over counts of slices only


def test_many_hosts_are_numbered(spark):
    from quire.plans import views

    hosts = spark.range(100_010).select((F.col("id") * 3).alias("p"), F.concat(F.lit("h"), "id").alias("host"))
    out = ordering.placed(hosts, (), ("p", "host"), "ord")
    assert out.filter(F.col("ord") != F.col("p") / 3 + 1).count() == 0 and out.count() == 100_010
    assert "100000" not in views.TOC + views.CATALOG


def sequential(rows):
    seen, out = set(), set()
    for work, idx, url, event in sorted(rows, key=lambda r: r[3]):
        if (work, "i", idx) not in seen and (work, "u", url) not in seen:
            seen |= {(work, "i", idx), (work, "u", url)}
            out.add(event)
    return out


def test_chained_collisions_are_accepted_as_a_loop_would(spark):
    import random

    from quire.operators import resume

    rng = random.Random(5)
    chain = [("w", i // 2, (i + 1) // 2, i) for i in range(30)]  # each row shares its index with the next, its URL with the one before
    mixed = [(rng.choice(["a", "b", None]), rng.choice([None, *range(12)]), rng.choice([None, *range(9)]), 100 + i) for i in range(300)]
    rows = chain + mixed
    df = spark.createDataFrame(rows, "work string, idx long, url long, event_id long")
    assert {r.event_id for r in resume.accepted_submissions(df, "idx", "url").collect()} == sequential(rows)
    assert resume.accepted_submissions(df.filter("event_id < 0"), "idx", "url").collect() == []


def test_the_last_whole_version_of_an_index_is_read(spark, tmp_path):
    from quire.sources import index_files as store

    index = lambda works, n: spark.createDataFrame([(w, i, f"u{w}{i}", None if i % 2 else "t", None) for w in works for i in range(1, n + 1)], "work string, idx long, url string, title string, source_id string")
    path = f"{tmp_path}/store"
    store.save_version(index("abc", 3), path, 1, "work")
    store.save_version(index("ab", 4), path, 2, "work")
    found = store.read_store(spark, path, "work string", "work")
    assert sorted((r.work, r.version, r.idx) for r in found.collect()) == [("a", 2, i) for i in range(1, 5)] + [("b", 2, i) for i in range(1, 5)] + [("c", 1, i) for i in range(1, 4)]
    rows = spark.read.parquet(path)
    damaged = rows.withColumn("raw", F.when((F.col("work") == "a") & (F.col("version") == 2), F.expr("substring(raw, 1, 20)")).when(F.col("work") == "c", "[]").otherwise(F.col("raw")))
    left = store.last_valid(damaged, "work")
    assert {(r.work, r.version) for r in left.collect()} == {("a", 1), ("b", 2)}
    whole = store.completed(left, index("abc", 2), "work")
    assert {(r.work, r.version) for r in whole.collect()} == {("a", 1), ("b", 2), ("c", 0)} and whole.count() == 3 + 4 + 2


def test_books_are_packed_and_read_back_by_pruned_scans(spark, tmp_path):
    from quire.sources import outputs

    path = f"{tmp_path}/books"
    books = spark.range(400).select(F.format_string("w%02d", F.col("id") % 20).alias("novel_slug"), F.format_string("f%03d", "id").alias("book_file"), F.concat(F.lit("text "), "id").alias("text"))
    outputs.write_books(books, path, version=1, files=4)
    outputs.write_books(books.filter("id < 5").withColumn("text", F.lit("new")), path, version=2, files=1)
    assert len(list((tmp_path / "books").glob("*.parquet"))) <= 5
    assert [r.text for r in outputs.read_books(spark, path, "w07", "f027").collect()] == ["text 27"]
    assert [r.text for r in outputs.read_books(spark, path, "w03", "f003").collect()] == ["new"]
    assert outputs.read_books(spark, path).count() == 400 and outputs.read_books(spark, path, "w03").count() == 20
    plan = outputs.read_books(spark, path, "w07", "f027")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(novel_slug,w07)" in plan and "EqualTo(book_file,f027)" in plan


def test_a_point_read_of_the_archive_touches_one_folder(spark, tmp_path):
    from quire.sources import outputs

    path = f"{tmp_path}/archive"
    pages = spark.range(500).select(F.concat(F.lit("https://h.org/"), "id").alias("url"), F.concat(F.lit("<p>"), "id").alias("html"))
    outputs.write_archive(pages, path)
    found = outputs.archived(spark, path, "https://h.org/321")
    assert [r.html for r in found.collect()] == ["<p>321"] and outputs.archived(spark, path, "https://h.org/none").collect() == []
    assert len(found.select(F.input_file_name().alias("f")).distinct().collect()) == 1
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(cache_key," in plan
    assert spark.read.parquet(path).count() == 500
