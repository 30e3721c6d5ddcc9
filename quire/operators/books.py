"""Ranges, groups, names and texts of books."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import chapter_heading, chapter_raw_text, safe_filename, ws_collapse
from quire.operators.ordering import placed

#: Fixed values of the heading rules.
MOST_HEADING = 500
HEADING_LINE = r"(?i)^Chapter\s+[0-9]+:\s*.*?\.\s*$"
MERGED_QUOTE = r"(?i)^(Chapter\s+[0-9]+:\s*[^\"'“‘\n]+)\s+([\"'“‘].*)"
MERGED_SENTENCE = r"(?i)^(Chapter\s+[0-9]+:\s*.+?)\s+([A-Z][^.]+\.\s+.*)"
HEADING_ONLY = r"(?is)^Chapter\s+[0-9]+:\s*.*?\.?\s*$"
PAGE_BREAK = "\f\n\n"


def numbered(rows: DataFrame, order: str) -> DataFrame:
    """idx: the place of each row in its work's order. A work may hold most of all rows."""
    return placed(rows, ("novel_slug",), (order,), "idx")


def clamped(jobs: DataFrame, chapters: DataFrame) -> DataFrame:
    """Jobs with their range cut to what the work has, and whether that changed it."""
    have = chapters.groupBy("novel_slug").agg(F.min("idx").alias("lo"), F.max("idx").alias("hi"))
    j = jobs.join(have, "novel_slug").withColumns({"first": F.greatest("start", "lo"), "last": F.least(F.coalesce("end", "hi"), "hi")})
    return j.withColumn("changed", (F.col("first") != F.col("start")) | (F.col("last") != F.coalesce("end", "last"))).drop("lo", "hi")


def in_range(jobs: DataFrame, chapters: DataFrame) -> DataFrame:
    """Chapters of each job's range; jobs are few beside chapters."""
    return jobs.join(chapters, "novel_slug").filter(F.col("idx").between(F.col("first"), F.col("last")))


def with_part(chapters: DataFrame, size: int, *keys: str, place: str | None = None) -> DataFrame:
    """part: the consecutive group by position, not by index. place: a column that holds the position already (as numbered() gives it)."""
    if place is None:
        found = placed(chapters, keys, ("idx", *[c for c in ("doc_id", "rep") if c in chapters.columns]), "_place")
        return found.withColumn("part", F.floor((F.col("_place") - 1) / max(1, size)).cast("long")).drop("_place")
    return chapters.withColumn("part", F.floor((F.col(place) - 1) / max(1, size)).cast("long"))


def group_key(mode: Column, idx: Column, part: Column) -> Column:
    return F.when(mode == "separate", idx).when(mode == "chunked", part).otherwise(F.lit(0).cast("long"))


def file_name(mode: Column, slug: Column, heading: Column, first: Column, last: Column) -> Column:
    return (
        F.when(mode == "separate", F.concat(safe_filename(heading), F.lit(".pdf")))
        .when(mode == "chunked", F.concat(slug, F.lit("_Chapters_"), first, F.lit("-"), last, F.lit(".pdf")))
        .otherwise(F.concat(slug, F.lit("_All_Chapters.pdf")))
    )


def assemble(chapters: DataFrame, size: int, place: str | None = None) -> DataFrame:
    """novel_slug, part, book_file, n_chapters, n_chars, text. A book is one value: bounded by its `size` chapters."""
    raw = with_part(chapters, size, "novel_slug", place=place).select("novel_slug", "part", "idx", chapter_raw_text(F.col("idx"), F.col("title"), F.col("paragraphs")).alias("raw"))
    books = raw.groupBy("novel_slug", "part").agg(
        F.count("*").alias("n_chapters"), F.sum(F.length("raw")).alias("n_chars"), F.min("idx").alias("a"), F.max("idx").alias("b"), F.array_sort(F.collect_list(F.struct("idx", "raw"))).alias("c")
    )
    name = F.concat("novel_slug", F.lit("_Chapters_"), "a", F.lit("-"), "b", F.lit(".txt"))
    return books.select("novel_slug", "part", name.alias("book_file"), "n_chapters", "n_chars", F.array_join(F.transform("c", lambda x: x["raw"]), PAGE_BREAK).alias("text"))


def pages_of(text: Column) -> Column:
    return F.filter(F.split(text, "\f", -1), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")) != "")


def paragraphs_of(page: Column) -> Column:
    return F.filter(F.transform(F.split(page, "\n\n", -1), ws_collapse), lambda p: p != "")


def is_heading(text: Column) -> Column:
    t = F.trim(text)
    return (F.length(t) <= MOST_HEADING) & t.rlike(HEADING_LINE)


def split_merged(text: Column) -> Column:
    """(kind, text) parts of a paragraph: a heading with its final dot and the body merged into it, or the text as it is."""
    pair = lambda p: F.array(
        F.struct(F.lit("heading").alias("kind"), F.regexp_replace(F.rtrim(F.regexp_extract(text, p, 1)), r"([^.])$", "$1.").alias("text")), F.struct(F.lit("body").alias("kind"), F.regexp_extract(text, p, 2).alias("text"))
    )
    whole = F.array(F.struct(F.when(is_heading(text), "heading").otherwise("body").alias("kind"), text.alias("text")))
    short = lambda p: F.length(F.regexp_extract(text, p, 1)).between(1, MOST_HEADING)
    return F.when(is_heading(text), whole).when(short(MERGED_QUOTE), pair(MERGED_QUOTE)).when(short(MERGED_SENTENCE), pair(MERGED_SENTENCE)).otherwise(whole)


def is_heading_only(page: Column) -> Column:
    lines = F.filter(F.transform(F.split(page, "\n", -1), lambda x: F.trim(x)), lambda x: x != "")
    return (F.size(lines) == 1) & F.coalesce(F.get(lines, F.lit(0)).rlike(HEADING_ONLY), F.lit(False))


def expected_and_present(chapters: DataFrame, present: DataFrame) -> DataFrame:
    """Each part's expected and present number of chapters."""
    have = present.select("novel_slug", "idx", "doc_id", "rep", F.lit(1).alias("_have"))
    return chapters.join(have, ["novel_slug", "idx", "doc_id", "rep"], "left").groupBy("novel_slug", "part").agg(F.count("*").alias("expected"), F.count("_have").alias("present"))


def heading_of(rows: DataFrame) -> Column:
    return chapter_heading(F.col("idx"), F.col("title"))
