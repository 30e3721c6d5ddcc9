"""Site profiles: a key to the functions that turn a site's pages into chapters and its index pages into chapter indexes.

An index function takes index pages with their catalog row (ord, novel_slug, url, html, chapter_count, url_template, book_id, base_url) and
gives ord, idx, url, title, source_id, error: the chapters of each, or one row with an error. An extract function takes pages
(page_id, url, html, maybe number), and whether only closed character references count, and gives page_id, url, title, paragraphs, degraded, failed.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.scripts import assigned_object, repair_escapes
from quire.functions.text import title_only
from quire.operators import body, toc

Step = Callable[[DataFrame], DataFrame]
Extract = Callable[[DataFrame, bool], DataFrame]
INDEX = ["ord", "idx", "url", "title", "source_id", "error"]


class Profile(NamedTuple):
    extract: Extract
    index: Step | None = None


PROFILES: dict[str, Profile] = {}


def register(key: str, index: Step | None = None) -> Callable[[Extract], Extract]:
    def add(f: Extract) -> Extract:
        if key in PROFILES:
            raise ValueError(f"profile {key} is registered twice")
        PROFILES[key] = Profile(f, index)
        return f

    return add


def profile(key: str) -> Profile:
    if key not in PROFILES:
        raise KeyError(f"no profile {key}; known: {', '.join(sorted(PROFILES))}")
    return PROFILES[key]


def link_index(pages: DataFrame) -> DataFrame:
    """Chapters 1 to n of a site whose index page links to them: n is the catalog's count, or the highest that the links tell."""
    counted = toc.resolved(pages)
    chapters = toc.gapfree_of(counted).select("ord", "idx", F.col("chapter_url").alias("url"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("source_id"), F.lit(None).cast("string").alias("error"))
    none = counted.filter("status <> 'ok' or n_chapters < 1").select("ord", *(F.lit(None).cast(t).alias(c) for c, t in zip(INDEX[1:5], ("long", "string", "string", "string"), strict=True)), F.lit("no chapter count").alias("error"))
    return chapters.unionByName(none)


def payload_index(pages: DataFrame) -> DataFrame:
    """Chapters that an index page lists in its JSON payload, or in the book that its script assigns."""
    first = toc.next_data(F.col("html"))["props"]["pageProps"]["data"].dropFields("chapterInfo")
    second = F.from_json(repair_escapes(assigned_object(F.col("html"), "g_data.book")), toc.BOOK)
    found = pages.withColumn("d", F.when(toc.next_data(F.col("html")).isNotNull(), first).otherwise(second))
    own = found.select(F.col("ord").alias("page_id"), F.coalesce(F.nullif(F.col("d.bookInfo.bookId"), F.lit("")), F.col("book_id"), F.lit("")).alias("book_id"), F.rtrim("base_url", F.lit("/")).alias("base_url"), F.coalesce("d.volumeItems", F.expr("array()")).alias("volumes"), F.col("d").isNull().alias("missing"))
    listed = toc.flattened(own).select(F.col("page_id").alias("ord"), "idx", F.col("chapter_url").alias("url"), F.col("name").alias("title"), F.col("chapter_id").alias("source_id"))
    # Whether a page lists any valid chapter is told by its own payload, so no join asks for it.
    valid = F.exists(F.flatten(F.transform("volumes", lambda v: F.coalesce(v["chapterItems"], F.expr("array()")))), toc.valid_item)
    error = F.when(F.col("missing"), "no supported payload").otherwise("empty chapter list")
    none = own.filter(~valid).select(F.col("page_id").alias("ord"), *(F.lit(None).cast(t).alias(c) for c, t in zip(INDEX[1:5], ("long", "string", "string", "string"), strict=True)), error.alias("error"))
    return listed.withColumn("error", F.lit(None).cast("string")).unionByName(none)


@register("profile_a", index=link_index)
def articles(pages: DataFrame, closed: bool = False) -> DataFrame:
    """Pages whose text lies in the page itself; a column `number`, if there is one, says which chapter a page is."""
    number = F.col("number") if "number" in pages.columns else F.lit(None).cast("long")
    return body.chapters_of(pages.select("page_id", "url", "html", number.alias("number")), closed=closed)


@register("profile_b", index=payload_index)
def payloads(pages: DataFrame, closed: bool = False) -> DataFrame:
    """Pages whose text lies in a JSON payload, else in an assigned one, else in the page itself."""
    p = body.by_precedence(pages.select("page_id", "url", "html"), closed)
    p = p.withColumn("title", title_only(F.coalesce("title", F.lit(""))))
    return p.select("page_id", "url", "title", "paragraphs", body.is_degraded(F.col("title")).alias("degraded"), (F.size("paragraphs") == 0).alias("failed"))


def extract_by_profile(pages: DataFrame, key_column: str = "adapter_key", closed: bool = False) -> DataFrame:
    """Each page by the profile that its key names, and `status`: ok, empty, or unknown profile (with no title and no paragraphs)."""
    unknown = pages.filter(F.col(key_column).isNull() | ~F.col(key_column).isin(*PROFILES))
    none = F.expr("cast(array() as array<string>)")
    out = unknown.select("page_id", "url", F.lit("").alias("title"), none.alias("paragraphs"), F.lit(True).alias("degraded"), F.lit(True).alias("failed"), F.lit("unknown profile").alias("status"))
    for key, own in sorted(PROFILES.items()):
        rows = own.extract(pages.filter(F.col(key_column) == key), closed)
        out = out.unionByName(rows.withColumn("status", F.when(F.col("failed"), "empty").otherwise("ok")))
    return out


def index_by_profile(pages: DataFrame, key_column: str = "adapter_key") -> DataFrame:
    """ord, idx, url, title, source_id, error: each index page by the profile that its catalog row names. What goes wrong is a row."""
    unknown = pages.filter(F.col(key_column).isNull() | ~F.col(key_column).isin(*(k for k, p in PROFILES.items() if p.index)))
    out = unknown.select("ord", *(F.lit(None).cast(t).alias(c) for c, t in zip(INDEX[1:5], ("long", "string", "string", "string"), strict=True)), F.lit("unknown profile").alias("error"))
    for key, own in sorted(PROFILES.items()):
        if own.index:
            out = out.unionByName(own.index(pages.filter(F.col(key_column) == key)).select(*INDEX))
    return out
