"""Resume, anti-joins and merges."""

from pyspark.sql import functions as F

from quire.functions.text import chapter_heading, safe_filename
from quire.operators import books
from quire.operators import resume as ops

from .book_queries import ALL, CLAMPED, JOBS, NAMED, SELECTED, named, selected
from .registry import query
from .text_queries import HEADING_OF, SAFE
from .toc_queries import TOCS
from .views import CHAPTERS, FETCH_LOG, chapters, fetch_log, toc, with_views

MANIFEST = f"manifest AS (SELECT DISTINCT novel_slug, {SAFE(HEADING_OF)} || '.pdf' AS book_file FROM chapters_v WHERE doc_id % 10 = 0)"
SKIPPED = "done AS (SELECT DISTINCT novel_slug, CAST(regexp_extract(book_file, '^Chapter\\s+([0-9]+)', 1) AS BIGINT) AS idx FROM manifest)"
FILES = ALL.rstrip() + ", " + NAMED + ", have AS (SELECT DISTINCT novel_slug, book_file FROM named WHERE a % 3 = 0) "


def manifest(spark, sf_dir):
    """Separate files that exist already: one chapter in ten."""
    c = chapters(spark, sf_dir).filter("doc_id % 10 = 0")
    return c.select("novel_slug", F.concat(safe_filename(chapter_heading(F.col("idx"), F.col("title"))), F.lit(".pdf")).alias("book_file")).distinct()


@query(with_views(CHAPTERS, MANIFEST, SKIPPED) + "SELECT novel_slug, idx, doc_id, rep FROM chapters_v c WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.novel_slug = c.novel_slug AND d.idx = c.idx)")
def resume_separate(spark, sf_dir):
    c = chapters(spark, sf_dir).select("novel_slug", "idx", "doc_id", "rep")
    return c.join(ops.existing_chapters(manifest(spark, sf_dir)), ["novel_slug", "idx"], "left_anti")


@query(FILES + "SELECT novel_slug, job_id, grp, book_file FROM named n WHERE mode = 'chunked' AND NOT EXISTS (SELECT 1 FROM have h WHERE h.novel_slug = n.novel_slug AND h.book_file = n.book_file)")
def resume_chunked(spark, sf_dir):
    n = named(spark, sf_dir)
    return ops.skip_existing(n.filter("mode = 'chunked'"), n.filter("a % 3 = 0")).select("novel_slug", "job_id", "grp", "book_file")


@query(FILES + "SELECT novel_slug, job_id, book_file FROM named n WHERE mode = 'single' AND NOT EXISTS (SELECT 1 FROM have h WHERE h.novel_slug = n.novel_slug AND h.book_file = n.book_file)")
def resume_single(spark, sf_dir):
    n = named(spark, sf_dir)
    return ops.skip_existing(n.filter("mode = 'single'"), n.filter("a % 3 = 0")).select("novel_slug", "job_id", "book_file")


@query(with_views(CHAPTERS, MANIFEST, SKIPPED) + "SELECT novel_slug, idx, doc_id, rep, CASE WHEN d.idx IS NULL THEN 'pending' ELSE 'skipped' END AS state FROM chapters_v c LEFT JOIN done d USING (novel_slug, idx)")
def pending_work_plan(spark, sf_dir):
    return ops.planned(chapters(spark, sf_dir).select("novel_slug", "idx", "doc_id", "rep"), ops.existing_chapters(manifest(spark, sf_dir)))


@query(with_views(CHAPTERS, "parts AS (SELECT novel_slug, part, count(*) AS expected, count(*) FILTER (doc_id % 9 <> 0) AS present FROM (SELECT *, (row_number() OVER (PARTITION BY novel_slug ORDER BY idx, doc_id, rep) - 1) // 5 AS part FROM chapters_v) GROUP BY 1, 2)") + "SELECT novel_slug, part, expected FROM parts WHERE expected = present")
def complete_groups_only(spark, sf_dir):
    c = books.with_part(chapters(spark, sf_dir), 5, "novel_slug").select("novel_slug", "idx", "doc_id", "rep", "part")
    return ops.complete_only(books.expected_and_present(c, c.filter("doc_id % 9 <> 0"))).select("novel_slug", "part", "expected")


@query(with_views(FETCH_LOG, "s0 AS (SELECT *, event_id % 37 AS url FROM fetch_log_v), s1 AS (SELECT * FROM s0 QUALIFY row_number() OVER (PARTITION BY work, idx ORDER BY event_id) = 1)") + "SELECT work, idx, event_id FROM s1 QUALIFY row_number() OVER (PARTITION BY work, url ORDER BY event_id) = 1")
def submission_dedup(spark, sf_dir):
    return ops.first_submissions(fetch_log(spark, sf_dir).withColumn("url", F.col("event_id") % 37), "idx", "url").select("work", "idx", "event_id")


#: The rule row by row: what each work has seen so far, and whether its next row is new in both.
SEQUENTIAL = with_views(FETCH_LOG).replace("WITH", "WITH RECURSIVE", 1).rstrip() + """,
q0 AS (SELECT work, idx, event_id % 37 AS url, event_id, row_number() OVER (PARTITION BY work ORDER BY event_id) AS i FROM fetch_log_v),
walk AS (SELECT DISTINCT work, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS indexes, CAST([] AS BIGINT[]) AS urls, false AS accepted, CAST(NULL AS BIGINT) AS idx, CAST(NULL AS BIGINT) AS event_id FROM q0
  UNION ALL SELECT w.work, q.i, CASE WHEN a THEN list_append(w.indexes, q.idx) ELSE w.indexes END, CASE WHEN a THEN list_append(w.urls, q.url) ELSE w.urls END, a, q.idx, q.event_id
  FROM walk w JOIN q0 q ON q.work = w.work AND q.i = w.i + 1, LATERAL (SELECT NOT list_contains(w.indexes, q.idx) AND NOT list_contains(w.urls, q.url) AS a))
SELECT work, idx, event_id FROM walk WHERE accepted"""


@query(SEQUENTIAL)
def submission_acceptance(spark, sf_dir):
    """Submissions accepted one after the other, by index and URL at once."""
    return ops.accepted_submissions(fetch_log(spark, sf_dir).select("work", "idx", (F.col("event_id") % 37).alias("url"), "event_id"), "idx", "url").select("work", "idx", "event_id")


PASSES = """g AS (SELECT run_id, work, idx, count(*) AS attempts, arg_min(classification, event_id) AS first, bool_or(classification IN ('success','cache')) AS ok, arg_min(classification, event_id) FILTER (classification IN ('success','cache')) AS good, arg_max(classification, event_id) AS last FROM fetch_log_v GROUP BY 1, 2, 3)"""


@query(with_views(FETCH_LOG) + """SELECT run_id, work, idx FROM fetch_log_v WHERE classification IN ('challenge','transient','rate_limited','not_found','extraction_failed') EXCEPT SELECT run_id, work, idx FROM fetch_log_v WHERE classification IN ('not_found','extraction_failed')""")
def retry_eligible(spark, sf_dir):
    f = fetch_log(spark, sf_dir)
    k = ["run_id", "work", "idx"]
    failed = f.filter(~F.col("classification").isin("success", "cache")).select(*k)
    return failed.distinct().join(f.filter(F.col("classification").isin("not_found", "extraction_failed")), k, "left_anti")


@query(with_views(FETCH_LOG, PASSES) + "SELECT run_id, work, idx, attempts, CASE WHEN ok THEN good ELSE last END AS outcome, ok AND first NOT IN ('success','cache') AS rescued FROM g")
def second_pass_merge(spark, sf_dir):
    return ops.second_pass(fetch_log(spark, sf_dir)).select("run_id", "work", "idx", "attempts", "outcome", "rescued")


@query(with_views(CHAPTERS) + "SELECT novel_slug, idx, doc_id, CASE WHEN doc_id % 3 = 0 THEN 'rescued' ELSE 'primary' END AS origin FROM chapters_v WHERE rep = 0")
def fold_rescued_content(spark, sf_dir):
    c = chapters(spark, sf_dir).filter("rep = 0").select("novel_slug", "idx", "doc_id")
    both = c.filter("doc_id % 3 <> 0").withColumn("origin", F.lit("primary")).unionByName(c.filter("doc_id % 3 = 0 or doc_id % 5 = 0").withColumn("origin", F.lit("rescued")))
    # The primary content of a chapter goes before a rescued one.
    return both.groupBy("novel_slug", "idx", "doc_id").agg(F.min("origin").alias("origin"))


@query(TOCS + "SELECT ord, idx, 'stored' AS origin FROM (SELECT ord, unnest([1,2]) AS idx FROM toc_v WHERE ord % 4 = 1) UNION ALL SELECT ord, idx, 'rebuilt' FROM generated WHERE ord % 4 <> 1")
def index_reuse(spark, sf_dir):
    from quire.operators.toc import gapfree
    from quire.sources.index_files import load_index

    t = toc(spark, sf_dir)
    raw = t.select("ord", F.when(F.col("ord") % 4 == 1, '[{"index":1,"url":"a"},{"index":2,"url":"b"}]').when(F.col("ord") % 4 == 2, "{oops").alias("raw"))
    stored = load_index(raw, "ord").select("ord", "idx", F.lit("stored").alias("origin"))
    rebuilt = gapfree(t).select("ord", "idx", F.lit("rebuilt").alias("origin")).join(stored.select("ord").distinct(), "ord", "left_anti")
    return stored.unionByName(rebuilt)


@query(with_views(FETCH_LOG) + "SELECT run_id, classification || ' on ' || host AS warning, min(event_id) AS first_event FROM fetch_log_v WHERE classification NOT IN ('success','cache') GROUP BY 1, 2")
def warning_dedup(spark, sf_dir):
    f = fetch_log(spark, sf_dir).filter(~F.col("classification").isin("success", "cache"))
    return f.groupBy("run_id", F.concat("classification", F.lit(" on "), "host").alias("warning")).agg(F.min("event_id").alias("first_event"))
