"""Fetch-log analysis."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.functions import urls
from quire.operators import body, fetch as ops, quality
from quire.operators.toc import anchors

from .body_queries import EXTRACTED, PAGES
from .registry import query
from .views import FETCH_LOG, fetch_log, table, with_views

NET = "net AS (SELECT *, (classification = 'challenge')::INT AS bad FROM fetch_log_v WHERE classification NOT IN ('cache','rate_limited'))"
STREAKS = """st0 AS (SELECT *, sum(1 - bad) OVER (PARTITION BY run_id ORDER BY ts, event_id) AS island FROM net),
streaks AS (SELECT *, sum(bad) OVER (PARTITION BY run_id, island ORDER BY ts, event_id) AS streak, sum(bad) OVER (PARTITION BY run_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS rolling FROM st0)"""
LOG = with_views(FETCH_LOG, NET, STREAKS)
ATTEMPTS = """att AS (SELECT *, row_number() OVER (PARTITION BY run_id, work, idx ORDER BY ts, event_id) AS attempt FROM fetch_log_v), att2 AS (SELECT *, (['plain','headers','browser','browser_fresh'])[least(attempt, 4)] AS strategy FROM att)"""
TERMINAL = """tm0 AS (SELECT run_id, work, idx, bool_or(classification = 'success') AS ok, arg_min(classification, attempt) AS first, bool_or(classification = 'not_found') AS gone, bool_or(classification = 'extraction_failed') AS empty, count(*) AS n, arg_min(strategy, attempt) FILTER (classification = 'success') AS means FROM att2 GROUP BY 1, 2, 3),
tm AS (SELECT *, CASE WHEN first = 'cache' THEN 'skipped' WHEN first = 'success' THEN 'written' WHEN ok THEN 'rescued' WHEN gone THEN 'not_found' WHEN empty THEN 'extraction_failed' WHEN n > 4 THEN 'rescue_exhausted' ELSE 'failed' END AS state FROM tm0)"""
FULL = with_views(FETCH_LOG, ATTEMPTS, TERMINAL)


@query(with_views(FETCH_LOG) + "SELECT event_id, host, gap_us FROM (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY host ORDER BY ts, event_id) AS gap_us FROM fetch_log_v WHERE classification <> 'cache') WHERE gap_us < 3000000")
def host_pacing_audit(spark, sf_dir):
    return ops.too_close(fetch_log(spark, sf_dir)).select("event_id", "host", "gap_us")


@query(with_views(FETCH_LOG) + """SELECT event_id, host FROM (SELECT *, max(e) OVER (PARTITION BY host ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS until FROM (SELECT *, CASE WHEN classification = 'rate_limited' THEN epoch_us(ts) + coalesce(retry_after, 60) * 1000000 END AS e FROM fetch_log_v WHERE classification <> 'cache')) WHERE epoch_us(ts) < until""")
def cooldown_violations(spark, sf_dir):
    return ops.in_cooldown(fetch_log(spark, sf_dir)).select("event_id", "host")


@query(LOG + "SELECT event_id, run_id, streak FROM streaks")
def challenge_streak(spark, sf_dir):
    return ops.streaks(fetch_log(spark, sf_dir)).select("event_id", "run_id", "streak")


@query(LOG + "SELECT event_id, run_id, rolling FROM streaks")
def challenge_rolling_rate(spark, sf_dir):
    return ops.streaks(fetch_log(spark, sf_dir)).select("event_id", "run_id", "rolling")


@query(LOG + "SELECT run_id, event_id, streak, rolling FROM streaks WHERE armed AND (streak >= 5 OR rolling >= 9) QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) = 1")
def breaker_trip_point(spark, sf_dir):
    return ops.trips(fetch_log(spark, sf_dir))


@query(LOG + "SELECT run_id, classification, count(*) AS n FROM net GROUP BY 1, 2")
def network_only(spark, sf_dir):
    return ops.network(fetch_log(spark, sf_dir)).groupBy("run_id", "classification").agg(F.count("*").alias("n"))


@query(
    with_views(FETCH_LOG).replace("WITH", "WITH RECURSIVE", 1).rstrip()
    + """, b AS (SELECT work, run_id, CAST(count(*) FILTER (classification = 'challenge') AS INT) % 15 AS blocks, (min(event_id) % 40) * 1.0 AS base FROM fetch_log_v GROUP BY 1, 2),
d AS (SELECT work, run_id, blocks, 0 AS k, CAST(least(base, 30.0) AS DOUBLE) AS delay FROM b UNION ALL SELECT work, run_id, blocks, k + 1, CASE WHEN delay >= 30 THEN delay WHEN delay < 2 THEN 2.0 ELSE least(delay * 1.5, 30.0) END FROM d WHERE k < blocks)
SELECT work, run_id, blocks, round(delay, 6) AS delay FROM d WHERE k = blocks"""
)
def effective_delay(spark, sf_dir):
    b = fetch_log(spark, sf_dir).groupBy("work", "run_id").agg((F.count_if(F.col("classification") == "challenge") % 15).cast("int").alias("blocks"), ((F.min("event_id") % 40) * 1.0).cast("double").alias("base"))
    return b.select("work", "run_id", "blocks", F.round(ops.effective_delay(F.col("base"), F.col("blocks")), 6).alias("delay"))


@query(with_views(FETCH_LOG, ATTEMPTS) + """SELECT event_id, attempt, least(120.0, 5 * 3.0 ** (attempt - 1)) AS expected, gap_us, gap_us BETWEEN 850000 * least(120.0, 5 * 3.0 ** (attempt - 1)) AND 1150000 * least(120.0, 5 * 3.0 ** (attempt - 1)) AS in_band FROM (SELECT *, lead(epoch_us(ts)) OVER (PARTITION BY run_id, work, idx ORDER BY ts, event_id) - epoch_us(ts) AS gap_us FROM att) WHERE gap_us IS NOT NULL""")
def backoff_expected(spark, sf_dir):
    w = Window.partitionBy("run_id", "work", "idx").orderBy(*ops.ORDER)
    a = ops.attempts(fetch_log(spark, sf_dir)).withColumn("gap_us", F.lead(ops.micros(F.col("ts"))).over(w) - ops.micros(F.col("ts"))).filter("gap_us is not null")
    e = ops.backoff(F.col("attempt"))
    return a.select("event_id", F.col("attempt").cast("long").alias("attempt"), e.alias("expected"), "gap_us", F.col("gap_us").between(850000 * e, 1150000 * e).alias("in_band"))


@query(with_views(FETCH_LOG, ATTEMPTS) + "SELECT event_id, attempt, strategy FROM att2")
def attempt_numbering(spark, sf_dir):
    return ops.attempts(fetch_log(spark, sf_dir)).select("event_id", F.col("attempt").cast("long").alias("attempt"), "strategy")


@query(with_views(FETCH_LOG, ATTEMPTS) + """SELECT run_id, work, idx, coalesce(arg_min(classification, attempt) FILTER (classification <> 'rate_limited'), 'failed') AS outcome FROM att WHERE attempt <= 3 GROUP BY 1, 2, 3 HAVING arg_min(classification, attempt) = 'rate_limited'""")
def rate_limit_outcome(spark, sf_dir):
    return ops.rate_limit_outcomes(fetch_log(spark, sf_dir))


@query(FULL + "SELECT run_id, work, idx, state, n FROM tm")
def terminal_state(spark, sf_dir):
    return ops.terminal(fetch_log(spark, sf_dir)).select("run_id", "work", "idx", "state", "n")


REPORT = """rep AS (SELECT run_id, work, min(idx) AS first_idx, max(idx) AS last_idx, count(*) FILTER (state = 'written') AS written, count(*) FILTER (state = 'skipped') AS skipped, coalesce(list(idx ORDER BY idx) FILTER (state = 'rescued'), []) AS rescued,
 coalesce(list(idx ORDER BY idx) FILTER (state IN ('failed','rescue_exhausted','not_found')), []) AS failed, coalesce(list(idx ORDER BY idx) FILTER (state = 'rescue_exhausted'), []) AS exhausted, coalesce(list(idx ORDER BY idx) FILTER (state = 'extraction_failed'), []) AS empty,
 coalesce(array_to_string(list(idx || '=' || means ORDER BY idx) FILTER (state = 'rescued'), ','), '') AS cleared FROM tm GROUP BY 1, 2)"""


@query(FULL.rstrip() + ", " + REPORT + " SELECT * FROM rep")
def run_report(spark, sf_dir):
    r = ops.reports(fetch_log(spark, sf_dir))
    return r.withColumn("cleared", F.array_join(F.transform(F.array_sort(F.map_entries("cleared")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ","))


@query(FULL.rstrip() + ", " + REPORT + " SELECT run_id, count(*) AS reports, count(*) FILTER (len(list_intersect(rescued, failed)) > 0) AS overlaps, count(*) FILTER (NOT list_has_all(failed, exhausted)) AS strays FROM rep GROUP BY 1")
def run_report_invariants(spark, sf_dir):
    r = ops.reports(fetch_log(spark, sf_dir))
    return r.groupBy("run_id").agg(F.count("*").alias("reports"), F.count_if(F.size(F.array_intersect("rescued", "failed")) > 0).alias("overlaps"), F.count_if(F.size(F.array_except("exhausted", "failed")) > 0).alias("strays"))


@query(FULL + "SELECT run_id, coalesce(means, 'none') AS cleared_by, count(*) AS submitted, count(*) FILTER (state = 'rescued') AS completed, max(n) AS most_attempts FROM (SELECT * EXCLUDE (means), CASE WHEN state = 'rescued' THEN means END AS means FROM tm) WHERE first NOT IN ('cache','success') GROUP BY 1, 2")
def rescue_metrics(spark, sf_dir):
    t = ops.terminal(fetch_log(spark, sf_dir)).filter(~F.col("state").isin("skipped", "written"))
    return t.groupBy("run_id", F.coalesce("cleared_by", F.lit("none")).alias("cleared_by")).agg(F.count("*").alias("submitted"), F.count_if(F.col("state") == "rescued").alias("completed"), F.max("n").alias("most_attempts"))


@query(r"SELECT lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#]+)', 1)) AS host, count(*) AS n, sum(strlen(html)) AS bytes, round(avg(strlen(html) / 1024.0), 6) AS avg_kb, max(strlen(html)) AS most FROM pages GROUP BY 1")
def fetch_size_time_stats(spark, sf_dir):
    size = F.octet_length("html").cast("long")
    return table(spark, sf_dir, "pages").groupBy(urls.host_key(F.col("url")).alias("host")).agg(F.count("*").alias("n"), F.sum(size).alias("bytes"), F.round(F.avg(size / 1024.0), 6).alias("avg_kb"), F.max(size).alias("most"))


@query(with_views(PAGES, EXTRACTED) + r"""SELECT host, count(*) AS pages, count(*) FILTER (n_p > 3 OR n_links > 10) AS good FROM (SELECT lower(regexp_extract(e.url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#]+)', 1)) AS host, len(paragraphs) AS n_p, len(regexp_extract_all(p.html, '<a\b[^>]*href="([^"]*)"[^>]*>([\s\S]*?)</a>', 1)) AS n_links FROM extracted e JOIN pages p USING (page_id)) GROUP BY 1""")
def extraction_judge(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    links = anchors(p, "page_id").groupBy("page_id").agg(F.count("*").alias("n_links"))
    e = body.extract(p).select("page_id", urls.host_key(F.col("url")).alias("host"), F.size("paragraphs").alias("n_p")).join(links, "page_id", "left")
    return e.groupBy("host").agg(F.count("*").alias("pages"), F.count_if((F.col("n_p") > 3) | (F.coalesce("n_links", F.lit(0)) > 10)).alias("good"))


@query(with_views(FETCH_LOG) + "SELECT run_id, work, list(idx ORDER BY idx)[1:20] AS preview, count(*) > 20 AS more FROM (SELECT DISTINCT run_id, work, idx FROM fetch_log_v WHERE classification NOT IN ('success','cache')) GROUP BY 1, 2")
def failed_preview_topk(spark, sf_dir):
    f = fetch_log(spark, sf_dir).filter(quality.failure_tag(F.col("classification")).isNotNull() & ~F.col("classification").isin("success", "cache"))
    ids = F.sort_array(F.collect_set("idx"))
    return f.groupBy("run_id", "work").agg(F.slice(ids, 1, 20).alias("preview"), (F.size(ids) > 20).alias("more"))
