"""Page classification: markers, payloads, garbled text, response classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.scripts import assigned_object, repair_escapes
from quire.functions.text import strip_tags
from quire.operators.toc import CHAPTER_INFO, next_data

#: Fixed value: what a payload page assigns its chapter to.
ASSIGNED = "g_data.chapInfo"

#: Marks of interstitial pages; ambient ones count only where no content is.
STRONG = ("just a moment", "cf-browser-verification", "cf_chl_opt", "_cf_chl_")
AMBIENT = ("challenge-platform", "cf-mitigated", "managed-challenge")
#: Classes and ids of body containers.
BODY = r"""(?i)<(?:div|section|article|main)\b[^>]*(?:class=["'](?:[^"']* )?(?:cha-words|cha-content|m-read|txt|chapter-content|read-content|novel-content|chapter-body|entry-content)[ "']|class=["'][^"']*ChapterContent_(?:content|container)|id=["'](?:article|chapter-content)["'])[^>]*>([\s\S]*?)</(?:div|section|article|main)>"""
MIN_BODY = 20
MIN_GARBLED_LENGTH, MIN_GARBLED, GARBLED_SHARE = 200, 32, 0.02


def has_any(html: Column, marks: tuple[str, ...]) -> Column:
    low, out = F.lower(html), F.lit(False)
    for m in marks:
        out = out | F.contains(low, F.lit(m))
    return out


def has_json_payload(html: Column) -> Column:
    """A payload script that parses to something that isn't empty."""
    raw = F.trim(F.regexp_extract(html, r'<script id="__NEXT_DATA__"[^>]*>([\s\S]*?)</script>', 1))
    return F.contains(html, F.lit("__NEXT_DATA__")) & F.coalesce(next_data(html).isNotNull(), F.lit(False)) & ~raw.rlike(r"^(?:|\{\s*\}|\[\s*\]|null|false|0)$")


def has_assigned_payload(html: Column) -> Column:
    """A script assigns a chapter that has contents."""
    info = F.from_json(repair_escapes(assigned_object(html, ASSIGNED)), CHAPTER_INFO)
    return F.when(F.contains(html, F.lit(ASSIGNED)), F.coalesce(F.size(info["contents"]) > 0, F.lit(False))).otherwise(False)


def classified(pages: DataFrame) -> DataFrame:
    """Pages with what they hold (has_json, has_assignment, has_body; real: any), their marks (strong, ambient), and blocked. No shuffle."""
    h = F.col("html")
    p = pages.withColumns({"strong": has_any(h, STRONG), "ambient": has_any(h, AMBIENT), "has_json": has_json_payload(h), "has_assignment": has_assigned_payload(h), "has_body": has_populated_body(h)})
    p = p.withColumn("real", F.col("has_json") | F.col("has_assignment") | F.col("has_body"))
    return p.withColumn("blocked", ~F.col("real") & (F.col("strong") | F.col("ambient")))


def has_populated_body(html: Column) -> Column:
    """A known container with enough text; an empty shell doesn't count."""
    return F.length(strip_tags(F.regexp_extract(html, BODY, 1))) >= MIN_BODY


def is_garbled(html: Column) -> Column:
    bad = F.length(html) - F.length(F.replace(html, F.lit("�"), F.lit("")))
    return (F.length(html) >= MIN_GARBLED_LENGTH) & (bad >= MIN_GARBLED) & (bad > GARBLED_SHARE * F.length(html))


def response_class(status: Column, real: Column, blocked: Column) -> Column:
    return (
        F.when(real, "success").when(blocked, "challenge").when(status.isin(404, 410), "not_found").when(status == 429, "rate_limited")
        .when(status >= 500, "transient").when(status == 403, "challenge").when(status >= 400, "error").otherwise("success")
    )


def error_category(message: Column) -> Column:
    low = F.lower(message)
    return (
        F.when(message.rlike(r"\bHTTP (404|410)\b"), "not_found")
        .when(F.contains(low, F.lit("executable doesn't exist")) | F.contains(low, F.lit("failed to launch")), "engine_missing")
        .when(F.contains(low, F.lit("has been closed")) | F.contains(low, F.lit("page closed")), "page_closed")
        .when(low.rlike(r"\bhttp\s*(403|404)\b"), "permanent")
        .otherwise("other")
    )


def retry_after(value: Column) -> Column:
    """Seconds above zero, else null; dates are null."""
    n = F.trim(value).try_cast("double")
    return F.when(n > 0, n)


def failure_tag(classification: Column) -> Column:
    return F.when(classification.isin("challenge", "rate_limited", "not_found"), classification).otherwise("transient")
