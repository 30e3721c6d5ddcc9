"""Tables of contents: links, counts, generated indexes, payloads, and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import strip_tags
from quire.functions.urls import path_of

ANCHOR = r'<a\b[^>]*href="([^"]*)"[^>]*>([\s\S]*?)</a>'
MIN_CHAPTERS = 10
#: Schemas of payloads, as DDL.
CHAPTER_INFO = "chapterId string, chapterIndex bigint, chapterName string, contents array<struct<content:string>>"
BOOK = "bookInfo struct<bookId:string,bookName:string,chapterCnt:bigint,chapterNum:bigint>, volumeItems array<struct<volumeName:string,chapterItems:array<struct<chapterIndex:string,chapterId:string,chapterName:string>>>>"
NEXT_DATA = (
    "props struct<pageProps:struct<data:struct<bookInfo:struct<bookId:string,bookName:string,chapterCnt:bigint,chapterNum:bigint>,volumeItems:array<struct<volumeName:string,chapterItems:array<struct<chapterIndex:string,chapterId:string,chapterName:string>>>>,"
    "chapterInfo:struct<chapterId:string,chapterIndex:bigint,chapterName:string,contents:array<struct<content:string>>>>>>"
)


def anchors(pages: DataFrame, *keep: str) -> DataFrame:
    """Every link of a page with its text, in order: pos, href, text."""
    hrefs, texts = F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(1)), F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(2))
    both = pages.withColumns({"_h": hrefs, "_t": texts})
    return both.select(*keep, F.posexplode(F.arrays_zip("_h", "_t")).alias("pos", "a")).select(*keep, "pos", F.col("a._h").alias("href"), strip_tags(F.col("a._t")).alias("text"))


def link_number(href: Column, index_url: Column) -> Column:
    """N of links to {path of the index}/chapter-N, else null."""
    prefix = F.concat(F.rtrim(path_of(index_url), F.lit("/")), F.lit("/chapter-"))
    rest = F.when(F.startswith(F.lower(href), F.lower(prefix)), F.substring(href, F.length(prefix) + 1, F.length(href)))
    return F.nullif(F.regexp_extract(rest, "^([0-9]+)(?:[/?#].*)?$", 1), F.lit("")).cast("long")


def discovered(toc: DataFrame) -> DataFrame:
    """ord, by_link, by_text: the highest chapter number of links and of their texts."""
    a = anchors(toc, "ord", "url")
    text_number = F.nullif(F.regexp_extract("text", r"(?i)\bChapter\s+([0-9]+)\b", 1), F.lit("")).cast("long")
    a = a.withColumns({"by_link": link_number(F.col("href"), F.col("url")), "by_text": F.when(text_number >= 1, text_number)})
    return a.groupBy("ord").agg(F.max("by_link").alias("by_link"), F.max("by_text").alias("by_text"))


def resolved(toc: DataFrame) -> DataFrame:
    """toc with discovered, n_chapters and status: the catalog's count, else the discovered one, else no_count."""
    out = toc.join(discovered(toc), "ord", "left").withColumn("discovered", F.coalesce("by_link", "by_text"))
    out = out.withColumn("n_chapters", F.coalesce("chapter_count", "discovered"))
    return out.withColumn("status", F.when(F.col("n_chapters").isNull(), "no_count").otherwise("ok"))


def chapter_url(url: Column, template: Column, n: Column) -> Column:
    return F.coalesce(F.replace(template, F.lit("{n}"), n.cast("string")), F.concat(F.rtrim(url, F.lit("/")), F.lit("/chapter-"), n.cast("string")))


def gapfree(toc: DataFrame) -> DataFrame:
    """One row for each chapter 1..n_chapters: no gap is possible."""
    return gapfree_of(resolved(toc))


def gapfree_of(counted: DataFrame) -> DataFrame:
    rows = counted.filter("status = 'ok' and n_chapters >= 1")
    rows = rows.select("ord", "novel_slug", "url", "url_template", F.explode(F.sequence(F.lit(1).cast("long"), "n_chapters")).alias("idx"))
    return rows.withColumn("chapter_url", chapter_url(F.col("url"), F.col("url_template"), F.col("idx")))


def warnings(toc: DataFrame) -> DataFrame:
    r = resolved(toc)
    differs = F.when(F.col("chapter_count").isNotNull() & F.col("discovered").isNotNull() & (F.col("chapter_count") != F.col("discovered")), F.concat(F.lit("override "), "chapter_count", F.lit(" differs from discovered "), "discovered"))
    few = F.when(F.col("n_chapters") < MIN_CHAPTERS, F.concat(F.lit("suspiciously few chapters: "), "n_chapters"))
    return r.select("ord", F.explode(F.array_compact(F.array(differs, few))).alias("warning"))


def gaps(chapters: DataFrame) -> DataFrame:
    """Per work: breaks of the sequence, and the first ten indexes after one."""
    before = F.lag("idx").over(Window.partitionBy("novel_slug").orderBy("idx", "doc_id", "rep"))
    broken = chapters.withColumn("before", before).filter(F.col("before").isNotNull() & (F.col("idx") != F.col("before") + 1))
    return broken.groupBy("novel_slug").agg(F.count("*").alias("n_gaps"), F.slice(F.sort_array(F.collect_list("idx")), 1, 10).alias("first_gaps"))


def next_data(html: Column) -> Column:
    """The parsed page payload; null if absent or malformed."""
    raw = F.regexp_extract(html, r'<script id="__NEXT_DATA__"[^>]*>([\s\S]*?)</script>', 1)
    return F.from_json(F.nullif(raw, F.lit("")), NEXT_DATA)


def valid_item(item: Column) -> Column:
    """Whether an entry of a payload's volumes is a chapter: a whole number and an id that isn't empty."""
    return F.coalesce(item["chapterIndex"].try_cast("bigint").isNotNull() & (F.coalesce(item["chapterId"], F.lit("")) != ""), F.lit(False))


def flattened(books: DataFrame) -> DataFrame:
    """page, volume and chapter of every entry of a payload's volumes; a volume without entries is empty."""
    v = books.select("page_id", "book_id", "base_url", F.posexplode("volumes").alias("volume", "v"))
    c = v.select("page_id", "book_id", "base_url", "volume", F.posexplode("v.chapterItems").alias("pos", "c"))
    idx = F.expr("try_cast(c.chapterIndex AS BIGINT)")
    rows = c.select("page_id", "book_id", "base_url", "volume", "pos", idx.alias("idx"), F.col("c.chapterId").alias("chapter_id"), F.col("c.chapterName").alias("raw_name"))
    valid = rows.filter(F.col("idx").isNotNull() & (F.coalesce("chapter_id", F.lit("")) != ""))
    return valid.withColumns({
        "name": F.coalesce(F.nullif(F.trim(F.coalesce("raw_name", F.lit(""))), F.lit("")), F.concat(F.lit("Chapter "), "idx")),
        "chapter_url": F.concat("base_url", F.lit("/story/"), "book_id", F.lit("/"), "chapter_id"),
    })
