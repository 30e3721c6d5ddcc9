"""Ranges, groups, names and texts of books."""

from pyspark.sql import functions as F

from quire.functions.text import chapter_heading, chapter_raw_text
from quire.operators import books as ops
from quire.sources.staging import staged

from .registry import query
from .text_queries import HEADING_OF, SAFE, d_ws
from .views import CHAPTERS, chapters, with_views

# Jobs: for each work one range inside, one to be cut, one outside and one open at the end.
JOBS = """jobs AS (SELECT novel_slug, k AS job_id, CASE k WHEN 0 THEN 3 WHEN 1 THEN -5 WHEN 2 THEN 100000 ELSE 10 END AS start, CASE k WHEN 0 THEN 12 WHEN 1 THEN 100000 WHEN 2 THEN 100010 END AS "end", CASE k WHEN 0 THEN 'separate' WHEN 1 THEN 'chunked' ELSE 'single' END AS mode, 4 AS chunk_size
 FROM (SELECT DISTINCT novel_slug FROM chapters_v), (SELECT unnest([0,1,2,3]) AS k))"""
CLAMPED = """clamped AS (SELECT j.*, greatest(start, lo) AS first, least(coalesce("end", hi), hi) AS last FROM jobs j JOIN (SELECT novel_slug, min(idx) AS lo, max(idx) AS hi FROM chapters_v GROUP BY 1) USING (novel_slug))"""
SELECTED = """selected AS (SELECT j.job_id, j.mode, c.*, (row_number() OVER (PARTITION BY j.novel_slug, j.job_id ORDER BY c.idx, c.doc_id, c.rep) - 1) // 4 AS part FROM clamped j JOIN chapters_v c ON j.novel_slug = c.novel_slug AND c.idx BETWEEN j.first AND j.last)"""
ALL = with_views(CHAPTERS, JOBS, CLAMPED, SELECTED)
RAW = f"array_to_string(list_prepend({HEADING_OF}, paragraphs), chr(10) || chr(10))"
BOOKS = f"books AS (SELECT novel_slug, part, min(idx) AS a, max(idx) AS b, string_agg({RAW}, chr(12) || chr(10) || chr(10) ORDER BY idx, doc_id, rep) AS text, count(*) AS n FROM (SELECT *, (row_number() OVER (PARTITION BY novel_slug ORDER BY idx, doc_id, rep) - 1) // 10 AS part FROM chapters_v) GROUP BY 1, 2)"
PAGES = "book_pages AS (SELECT novel_slug, part, page FROM (SELECT novel_slug, part, unnest(string_split(text, chr(12))) AS page FROM books) WHERE trim(regexp_replace(page, '\\s+', ' ', 'g')) <> '')"


def jobs(spark, sf_dir):
    w = chapters(spark, sf_dir).select("novel_slug").distinct().select("novel_slug", F.explode(F.array(*map(F.lit, range(4)))).alias("job_id"))
    k = F.col("job_id")
    return w.select("novel_slug", "job_id", F.when(k == 0, 3).when(k == 1, -5).when(k == 2, 100000).otherwise(10).cast("long").alias("start"), F.when(k == 0, 12).when(k == 1, 100000).when(k == 2, 100010).cast("long").alias("end"), F.when(k == 0, "separate").when(k == 1, "chunked").otherwise("single").alias("mode"))


def selected(spark, sf_dir):
    c = chapters(spark, sf_dir)
    return ops.with_part(ops.in_range(ops.clamped(jobs(spark, sf_dir), c), c), 4, "novel_slug", "job_id")


def named(spark, sf_dir):
    """Selected chapters with their group and the name of its file."""
    s = selected(spark, sf_dir).withColumn("grp", ops.group_key(F.col("mode"), F.col("idx"), F.col("part")))
    g = s.groupBy("novel_slug", "job_id", "mode", "grp").agg(F.min("idx").alias("a"), F.max("idx").alias("b"), F.count("*").alias("n"), F.min_by(chapter_heading(F.col("idx"), F.col("title")), F.struct("idx", "doc_id", "rep")).alias("heading"))
    return g.withColumn("book_file", ops.file_name(F.col("mode"), F.col("novel_slug"), F.col("heading"), F.col("a"), F.col("b")))


NAMED = f"""named AS (SELECT novel_slug, job_id, mode, grp, n, a, b, CASE mode WHEN 'separate' THEN {SAFE('heading')} || '.pdf' WHEN 'chunked' THEN novel_slug || '_Chapters_' || a || '-' || b || '.pdf' ELSE novel_slug || '_All_Chapters.pdf' END AS book_file FROM
 (SELECT novel_slug, job_id, mode, CASE mode WHEN 'separate' THEN idx WHEN 'chunked' THEN part ELSE 0 END AS grp, count(*) AS n, min(idx) AS a, max(idx) AS b, arg_min({HEADING_OF}, struct_pack(idx, doc_id, rep)) AS heading FROM selected GROUP BY 1, 2, 3, 4))"""


def book_pages(spark, sf_dir):
    b = ops.assemble(chapters(spark, sf_dir), 10)
    return b.select("novel_slug", "part", F.posexplode(ops.pages_of(F.col("text"))).alias("page_no", "page"))


@query(with_views(CHAPTERS, JOBS, CLAMPED) + """SELECT novel_slug, job_id, first, last, first <> start OR last <> coalesce("end", last) AS changed FROM clamped""")
def range_clamp(spark, sf_dir):
    return ops.clamped(jobs(spark, sf_dir), chapters(spark, sf_dir)).select("novel_slug", "job_id", "first", "last", "changed")


@query(ALL + "SELECT novel_slug, job_id, idx, doc_id, rep FROM selected UNION ALL SELECT novel_slug, job_id, -1, NULL, NULL FROM jobs j WHERE NOT EXISTS (SELECT 1 FROM selected s WHERE s.novel_slug = j.novel_slug AND s.job_id = j.job_id)")
def range_filter(spark, sf_dir):
    s = staged(selected(spark, sf_dir).select("novel_slug", "job_id", "idx", "doc_id", "rep"))  # asked twice
    outside = jobs(spark, sf_dir).join(s, ["novel_slug", "job_id"], "left_anti").select("novel_slug", "job_id", F.lit(-1).cast("long").alias("idx"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("int").alias("rep"))
    return s.unionByName(outside)


@query(ALL + "SELECT novel_slug, job_id, idx, doc_id, rep, part FROM selected")
def chunk_assign(spark, sf_dir):
    return selected(spark, sf_dir).select("novel_slug", "job_id", "idx", "doc_id", "rep", "part")


@query(ALL + "SELECT novel_slug, job_id, mode, CASE mode WHEN 'separate' THEN idx WHEN 'chunked' THEN part ELSE 0 END AS grp, count(*) AS n FROM selected GROUP BY 1, 2, 3, 4")
def book_grouping(spark, sf_dir):
    return selected(spark, sf_dir).groupBy("novel_slug", "job_id", "mode", ops.group_key(F.col("mode"), F.col("idx"), F.col("part")).alias("grp")).agg(F.count("*").alias("n"))


@query(ALL.rstrip() + ", " + NAMED + " SELECT novel_slug, job_id, grp, book_file FROM named")
def book_file_name(spark, sf_dir):
    return named(spark, sf_dir).select("novel_slug", "job_id", "grp", "book_file")


@query(with_views(CHAPTERS, BOOKS) + "SELECT novel_slug, part, n AS n_chapters, length(text) AS text_chars, novel_slug || '_Chapters_' || a || '-' || b || '.txt' AS book_file FROM books")
def book_assemble(spark, sf_dir):
    return ops.assemble(chapters(spark, sf_dir), 10).select("novel_slug", "part", "n_chapters", F.length("text").alias("text_chars"), "book_file")


@query(with_views(CHAPTERS, BOOKS, PAGES) + "SELECT novel_slug, part, count(*) AS n_pages, sum(length(page)) AS n_chars FROM book_pages GROUP BY 1, 2")
def page_split(spark, sf_dir):
    return book_pages(spark, sf_dir).groupBy("novel_slug", "part").agg(F.count("*").alias("n_pages"), F.sum(F.length("page")).alias("n_chars"))


PARAS = f"book_paras AS (SELECT novel_slug, part, text FROM (SELECT novel_slug, part, {d_ws('t')} AS text FROM (SELECT novel_slug, part, unnest(string_split(page, chr(10) || chr(10))) AS t FROM book_pages)) WHERE text <> '')"


def book_paragraphs(spark, sf_dir):
    return book_pages(spark, sf_dir).select("novel_slug", "part", F.explode(ops.paragraphs_of(F.col("page"))).alias("text"))


@query(with_views(CHAPTERS, BOOKS, PAGES, PARAS) + "SELECT novel_slug, part, text FROM book_paras")
def paragraph_split(spark, sf_dir):
    return book_paragraphs(spark, sf_dir)


@query(with_views(CHAPTERS, BOOKS, PAGES, PARAS) + rf"SELECT novel_slug, part, text FROM book_paras WHERE length(text) <= 500 AND regexp_matches(text, '{ops.HEADING_LINE}')")
def heading_classify(spark, sf_dir):
    return book_paragraphs(spark, sf_dir).filter(ops.is_heading(F.col("text")))


MERGED = """merged AS (SELECT doc_id, rep, idx, CASE WHEN doc_id % 3 = 0 THEN 'Chapter ' || idx || ': ' || title || ' "Quoted," said they.' WHEN doc_id % 3 = 1 THEN 'Chapter ' || idx || ': ' || title || ' Then it went on. And on.' ELSE 'Chapter ' || idx || ': ' || title || '.' END AS text FROM chapters_v WHERE title <> '')"""


def merged(spark, sf_dir):
    label = F.concat(F.lit("Chapter "), "idx", F.lit(": "), "title")
    t = F.when(F.col("doc_id") % 3 == 0, F.concat(label, F.lit(' "Quoted," said they.'))).when(F.col("doc_id") % 3 == 1, F.concat(label, F.lit(" Then it went on. And on."))).otherwise(F.concat(label, F.lit(".")))
    return chapters(spark, sf_dir).filter("title <> ''").select("doc_id", "rep", "idx", t.alias("text"))


QUOTE, SENTENCE = ops.MERGED_QUOTE.replace("'", "''"), ops.MERGED_SENTENCE.replace("'", "''")
SPLIT = rf"""split AS (SELECT doc_id, rep, text, length(text) <= 500 AND regexp_matches(trim(text), '{ops.HEADING_LINE}') AS whole, regexp_extract(text, '{QUOTE}', 1) AS q1, regexp_extract(text, '{QUOTE}', 2) AS q2, regexp_extract(text, '{SENTENCE}', 1) AS s1, regexp_extract(text, '{SENTENCE}', 2) AS s2 FROM merged)"""


@query(
    with_views(CHAPTERS, MERGED, SPLIT)
    + r"""SELECT doc_id, rep, unnest(CASE WHEN whole THEN ['heading'] WHEN q1 <> '' OR s1 <> '' THEN ['heading', 'body'] ELSE ['body'] END) AS kind, unnest(CASE WHEN whole THEN [text] WHEN q1 <> '' THEN [regexp_replace(rtrim(q1), '([^.])$', '\1.'), q2] WHEN s1 <> '' THEN [regexp_replace(rtrim(s1), '([^.])$', '\1.'), s2] ELSE [text] END) AS text FROM split"""
)
def merged_heading_split(spark, sf_dir):
    return merged(spark, sf_dir).select("doc_id", "rep", F.explode(ops.split_merged(F.col("text"))).alias("p")).select("doc_id", "rep", "p.kind", "p.text")


SINGLE = "single AS (SELECT novel_slug, idx, doc_id, rep, CASE WHEN doc_id % 5 = 0 THEN 'Chapter ' || idx || ': ' || title || chr(10) || ' ' ELSE array_to_string(paragraphs, chr(10)) END AS page FROM chapters_v)"


@query(with_views(CHAPTERS, SINGLE) + rf"SELECT novel_slug, idx, doc_id, rep FROM single WHERE NOT coalesce((len(list_filter(list_transform(string_split(page, chr(10)), lambda x: trim(x)), lambda x: x <> '')) = 1 AND regexp_matches(list_filter(list_transform(string_split(page, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1], '{ops.HEADING_ONLY}')), false)")
def heading_only_page_drop(spark, sf_dir):
    page = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("Chapter "), "idx", F.lit(": "), "title", F.lit("\n "))).otherwise(F.array_join("paragraphs", "\n"))
    return chapters(spark, sf_dir).withColumn("page", page).filter(~ops.is_heading_only(F.col("page"))).select("novel_slug", "idx", "doc_id", "rep")


@query(ALL + "SELECT novel_slug, job_id, part, count(*) AS n FROM selected WHERE doc_id % 4 <> 0 GROUP BY 1, 2, 3")
def present_members_only(spark, sf_dir):
    s = selected(spark, sf_dir)
    present = s.filter("doc_id % 4 <> 0").select("novel_slug", "job_id", "idx", "doc_id", "rep")
    return s.join(present, ["novel_slug", "job_id", "idx", "doc_id", "rep"], "left_semi").groupBy("novel_slug", "job_id", "part").agg(F.count("*").alias("n"))
