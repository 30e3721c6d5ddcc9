"""Page classification."""

from pyspark.sql import functions as F

from quire.functions.scripts import assigned_object, repair_escapes
from quire.operators import quality as ops
from quire.operators.quality import ASSIGNED as ASSIGNED_TO
from quire.operators.toc import CHAPTER_INFO

from .registry import query
from .views import FETCH_LOG, HTML, fetch_log, html_pages, table, with_views

ANY = lambda marks: "(" + " OR ".join(f"contains(lower(html), '{m}')" for m in marks) + ")"
JSON_OK = r"""(TRY_CAST(nullif(regexp_extract(html, '<script id="__NEXT_DATA__"[^>]*>([\s\S]*?)</script>', 1), '') AS JSON) IS NOT NULL AND NOT regexp_full_match(trim(regexp_extract(html, '<script id="__NEXT_DATA__"[^>]*>([\s\S]*?)</script>', 1)), '|\{\s*\}|\[\s*\]|null|false|0'))"""
BODY_RE = ops.BODY.replace("'", "''")
BODY_OK = rf"(length(trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '{BODY_RE}', 1), '<[^>]+>', ' ', 'g'),'&lt;','<'),'&gt;','>'),'&quot;','\"'),'&#39;',''''),'&nbsp;',' '),'&copy;','©'),'&middot;','·'),'&amp;','&'), '\s+', ' ', 'g'))) >= 20)"
ASSIGNED = "contains(html, 'g_data.chapInfo = {')"
REAL = f"({JSON_OK} OR {ASSIGNED} OR {BODY_OK})"
GARBLED = "(length(html) >= 200 AND length(html) - length(replace(html, chr(65533), '')) >= 32 AND length(html) - length(replace(html, chr(65533), '')) > 0.02 * length(html))"


def assigned(spark, sf_dir):
    """page_id, payload and contents of the assigned chapter payload."""
    p = html_pages(spark, sf_dir).filter(F.contains("html", F.lit(ASSIGNED_TO))).select("page_id", assigned_object(F.col("html"), ASSIGNED_TO).alias("payload"))
    return p.withColumn("info", F.from_json(repair_escapes(F.col("payload")), CHAPTER_INFO))


def classified(spark, sf_dir):
    return ops.classified(html_pages(spark, sf_dir))


@query(with_views(HTML) + f"SELECT page_id, {ANY(ops.STRONG)} AS strong, {ANY(ops.AMBIENT)} AS ambient FROM html_v")
def interstitial_markers(spark, sf_dir):
    h = F.col("html")
    return html_pages(spark, sf_dir).select("page_id", ops.has_any(h, ops.STRONG).alias("strong"), ops.has_any(h, ops.AMBIENT).alias("ambient"))


@query(with_views(HTML) + f"SELECT page_id, {JSON_OK} AS has_json FROM html_v")
def has_json_payload(spark, sf_dir):
    return html_pages(spark, sf_dir).select("page_id", ops.has_json_payload(F.col("html")).alias("has_json"))


@query(with_views(HTML) + f"SELECT page_id, {ASSIGNED} AS has_assignment FROM html_v")
def has_assignment_payload(spark, sf_dir):
    return classified(spark, sf_dir).select("page_id", "has_assignment")


@query(with_views(HTML) + f"SELECT page_id, {BODY_OK} AS has_body FROM html_v")
def has_populated_body(spark, sf_dir):
    return html_pages(spark, sf_dir).select("page_id", ops.has_populated_body(F.col("html")).alias("has_body"))


@query(with_views(HTML) + f"SELECT page_id, {REAL} AS real FROM html_v")
def has_real_payload(spark, sf_dir):
    return classified(spark, sf_dir).select("page_id", "real")


@query(with_views(HTML) + f"SELECT page_id FROM html_v WHERE NOT {REAL} AND ({ANY(ops.STRONG)} OR {ANY(ops.AMBIENT)})")
def blocked_page_filter(spark, sf_dir):
    return classified(spark, sf_dir).filter("blocked").select("page_id")


@query(with_views(HTML) + f"SELECT page_id FROM html_v WHERE {GARBLED}")
def garbled_page_filter(spark, sf_dir):
    return html_pages(spark, sf_dir).filter(ops.is_garbled(F.col("html"))).select("page_id")


STATUS = "(ARRAY[200,404,410,429,500,503,403,418])[1 + page_id // 8 % 8]"


@query(with_views(HTML) + f"""SELECT page_id, CASE WHEN {REAL} THEN 'success' WHEN {ANY(ops.STRONG)} OR {ANY(ops.AMBIENT)} THEN 'challenge' WHEN {STATUS} IN (404,410) THEN 'not_found' WHEN {STATUS} = 429 THEN 'rate_limited' WHEN {STATUS} >= 500 THEN 'transient'
WHEN {STATUS} = 403 THEN 'challenge' WHEN {STATUS} >= 400 THEN 'error' ELSE 'success' END AS class FROM html_v""")
def response_classification(spark, sf_dir):
    status = F.get(F.array(*map(F.lit, (200, 404, 410, 429, 500, 503, 403, 418))), (F.floor(F.col("page_id") / 8) % 8).cast("int"))
    return classified(spark, sf_dir).select("page_id", ops.response_class(status, F.col("real"), F.col("blocked")).alias("class"))


# Messages as a fetch log would hold them, from the events.
MESSAGE = """CASE classification WHEN 'not_found' THEN CASE WHEN event_id % 2 = 0 THEN 'GET failed: HTTP 404' ELSE 'gone (HTTP 410)' END WHEN 'challenge' THEN 'blocked (http 403) by ' || host WHEN 'transient' THEN CASE event_id % 3 WHEN 0 THEN 'Target page has been closed' WHEN 1 THEN 'Failed to launch: Executable doesn''t exist' ELSE 'timeout' END ELSE 'code 4041' END"""


def messages(spark, sf_dir):
    i, c = F.col("event_id"), F.col("classification")
    m = (
        F.when(c == "not_found", F.when(i % 2 == 0, "GET failed: HTTP 404").otherwise("gone (HTTP 410)"))
        .when(c == "challenge", F.concat(F.lit("blocked (http 403) by "), "host"))
        .when(c == "transient", F.when(i % 3 == 0, "Target page has been closed").when(i % 3 == 1, "Failed to launch: Executable doesn't exist").otherwise("timeout"))
        .otherwise("code 4041")
    )
    return fetch_log(spark, sf_dir).withColumn("message", m)


@query(with_views(FETCH_LOG, f"m AS (SELECT event_id, {MESSAGE} AS message FROM fetch_log_v)") + r"""SELECT event_id, CASE WHEN regexp_matches(message, '\bHTTP (404|410)\b') THEN 'not_found' WHEN contains(lower(message), 'failed to launch') THEN 'engine_missing' WHEN contains(message, 'has been closed') THEN 'page_closed'
WHEN regexp_matches(lower(message), '\bhttp\s*(403|404)\b') THEN 'permanent' ELSE 'other' END AS category FROM m""")
def error_message_category(spark, sf_dir):
    return messages(spark, sf_dir).select("event_id", ops.error_category(F.col("message")).alias("category"))


RETRY = "CASE event_id % 5 WHEN 0 THEN ' ' || event_id % 90 || ' ' WHEN 1 THEN 'Wed, 21 Oct 2026 07:28:00 GMT' WHEN 2 THEN '-5' WHEN 3 THEN '1.5' END"


@query(f"SELECT event_id, CASE WHEN s > 0 THEN s END AS seconds FROM (SELECT event_id, TRY_CAST(trim({RETRY}) AS DOUBLE) AS s FROM events)")
def retry_after_parse(spark, sf_dir):
    i = F.col("event_id")
    raw = F.when(i % 5 == 0, F.concat(F.lit(" "), i % 90, F.lit(" "))).when(i % 5 == 1, "Wed, 21 Oct 2026 07:28:00 GMT").when(i % 5 == 2, "-5").when(i % 5 == 3, "1.5")
    return table(spark, sf_dir, "events").select("event_id", ops.retry_after(raw).alias("seconds"))


@query(with_views(FETCH_LOG) + "SELECT event_id, CASE WHEN classification IN ('challenge','rate_limited','not_found') THEN classification ELSE 'transient' END AS tag FROM fetch_log_v WHERE classification NOT IN ('success','cache')")
def last_failure_tag(spark, sf_dir):
    return fetch_log(spark, sf_dir).filter(~F.col("classification").isin("success", "cache")).select("event_id", ops.failure_tag(F.col("classification")).alias("tag"))
