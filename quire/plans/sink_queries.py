"""Sinks written and read back: archive, books, reports; and element rows of pages."""

import uuid

from pyspark.sql import functions as F

from quire.operators import books, fetch
from quire.operators.nodes import nodes
from quire.sources import outputs
from quire.sources.staging import shared_folder

from .book_queries import BOOKS
from .fetch_queries import FULL
from .registry import query
from .views import CHAPTERS, chapters, fetch_log, table, with_views


def folder(spark):
    return f"{shared_folder(spark)}/sink-{uuid.uuid4().hex}"


@query("SELECT page_id, substr(sha256(url), 1, 24) || '.html' AS cache_key, length(html) AS n_chars FROM pages")
def page_archive_roundtrip(spark, sf_dir):
    """All pages written to the archive by key, and read back."""
    path = folder(spark)
    outputs.write_archive(table(spark, sf_dir, "pages"), path)
    return spark.read.parquet(path).select("page_id", "cache_key", F.length("html").cast("long").alias("n_chars"))


@query("SELECT p.page_id, p.html FROM pages p WHERE url = (SELECT max(url) FROM pages)")
def page_archive_point_read(spark, sf_dir):
    """The stored pages of one URL, the last in order."""
    path, pages = folder(spark), table(spark, sf_dir, "pages")
    outputs.write_archive(pages, path)
    return outputs.archived(spark, path, pages.agg(F.max("url")).first()[0]).select("page_id", "html")


@query(
    with_views(CHAPTERS, BOOKS)
    + "SELECT novel_slug, novel_slug || '_Chapters_' || a || '-' || b || '.txt' AS book_file, CASE WHEN part % 2 = 0 THEN length(text) + 4 ELSE length(text) END AS text_chars FROM books"
)
def book_sink_roundtrip(spark, sf_dir):
    """All books written, every other one again with four more characters, and the latest of each read back."""
    path, made = folder(spark), books.assemble(chapters(spark, sf_dir), 10)
    outputs.write_books(made, path, version=1)
    outputs.write_books(made.filter("part % 2 = 0").withColumn("text", F.concat("text", F.lit(" end"))), path, version=2)
    return outputs.read_books(spark, path).select("novel_slug", "book_file", F.length("text").alias("text_chars"))


@query(FULL + "SELECT run_id, work, count(*) FILTER (state = 'written') AS written, count(*) FILTER (state = 'skipped') AS skipped FROM tm GROUP BY 1, 2")
def run_report_roundtrip(spark, sf_dir):
    """Run reports appended as JSON and read back."""
    path = folder(spark)
    outputs.append_report(fetch.reports(fetch_log(spark, sf_dir)).select("run_id", "work", "written", "skipped"), path)
    return spark.read.schema("run_id string, work string, written bigint, skipped bigint").json(path)


BARE = r"regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script>', '', 'g')"


@query(f"""SELECT page_id, tag, n FROM (SELECT page_id, unnest(['a', 'b', 'h1', 'p']) AS tag, unnest([len(regexp_extract_all(t, '<a[ >]')), len(regexp_extract_all(t, '<b>')), len(regexp_extract_all(t, '<h1>')), len(regexp_extract_all(t, '<p>'))]) AS n
FROM (SELECT page_id, {BARE} AS t FROM pages)) WHERE n > 0""")
def element_counts(spark, sf_dir):
    """How many links, bold texts, headings and paragraphs each page's element rows hold."""
    rows = nodes(table(spark, sf_dir, "pages")).filter(F.col("tag").isin("a", "b", "h1", "p"))
    return rows.groupBy("page_id", "tag").agg(F.count("*").alias("n"))
