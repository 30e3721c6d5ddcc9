"""URL functions and tables of contents."""

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.functions import urls
from quire.functions.profiles import index_by_profile
from quire.operators import toc as ops

from .registry import query
from .views import CATALOG, CHAPTERS, HTML, TOC, catalog, chapters, html_pages, table, toc, with_views

HOST = r"lower(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#]+)', 1))"
ORIGIN = r"regexp_extract({0}, '^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+)', 1)"
LINKS = r"""links AS (SELECT *, unnest(regexp_extract_all(html, '<a\b[^>]*href="([^"]*)"[^>]*>([\s\S]*?)</a>', 1)) AS href, unnest(regexp_extract_all(html, '<a\b[^>]*href="([^"]*)"[^>]*>([\s\S]*?)</a>', 2)) AS text FROM toc_v),
found AS (SELECT ord, max(CASE WHEN starts_with(href, '/novel/' || ord || '/chapter-') THEN TRY_CAST(substr(href, length('/novel/' || ord || '/chapter-') + 1) AS BIGINT) END) AS by_link, max(TRY_CAST(regexp_extract(text, '(?i)\bChapter\s+([0-9]+)\b', 1) AS BIGINT)) AS by_text FROM links GROUP BY 1),
resolved AS (SELECT t.*, coalesce(by_link, by_text) AS discovered, coalesce(chapter_count, by_link, by_text) AS n_chapters FROM toc_v t LEFT JOIN found USING (ord)),
generated AS (SELECT ord, novel_slug, url, url_template, unnest(range(1, n_chapters + 1)) AS idx FROM resolved WHERE n_chapters >= 1)"""
TOCS = with_views(CATALOG, TOC, LINKS)


@query(rf"SELECT page_id, {ORIGIN.format('url')} || '/a/c?x=1' AS up, {ORIGIN.format('url')} || '/p' AS rooted, CASE WHEN url LIKE 'https:%' THEN 'https' ELSE 'http' END || '://cdn.example.com/i' AS other, regexp_replace(url, '#.*$', '') || '#top' AS same FROM pages")
def url_absolutize(spark, sf_dir):
    base = F.concat(urls.origin(F.col("url")), F.lit("/a/b/"))
    to = lambda b, h: urls.absolutize(b, F.lit(h))
    return table(spark, sf_dir, "pages").select("page_id", to(base, "../c?x=1").alias("up"), to(F.col("url"), "/p").alias("rooted"), to(F.col("url"), "//cdn.example.com/i").alias("other"), to(F.col("url"), "#top").alias("same"))


@query("SELECT page_id, regexp_replace(url, '#.*$', '') AS url FROM pages")
def url_defrag(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.defragment(F.col("url")).alias("url"))


@query(f"SELECT page_id, {HOST.format('url')} AS host FROM pages")
def host_key(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.host_key(F.col("url")).alias("host"))


@query(f"SELECT page_id, nullif({ORIGIN.format('url')}, '') AS origin, nullif({ORIGIN.format('substr(url, 3)')}, '') AS broken FROM pages")
def url_origin(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.origin(F.col("url")).alias("origin"), urls.origin(F.expr("substring(url, 3)")).alias("broken"))


@query(r"""SELECT page_id, generate_subscripts(h, 1) - 1 AS pos, unnest(h) AS href, trim(regexp_replace(unnest(t), '\s+', ' ', 'g')) AS text FROM (SELECT page_id, regexp_extract_all(html, '<a\b[^>]*href="([^"]*)"[^>]*>([\s\S]*?)</a>', 1) AS h,
 regexp_extract_all(html, '<a\b[^>]*href="([^"]*)"[^>]*>([\s\S]*?)</a>', 2) AS t FROM pages)""")
def anchor_extract(spark, sf_dir):
    return ops.anchors(table(spark, sf_dir, "pages"), "page_id")


@query(TOCS + "SELECT ord, href, CASE WHEN starts_with(href, '/novel/' || ord || '/chapter-') THEN TRY_CAST(substr(href, length('/novel/' || ord || '/chapter-') + 1) AS BIGINT) END AS n FROM links")
def chapter_link_number(spark, sf_dir):
    return ops.anchors(toc(spark, sf_dir), "ord", "url").select("ord", "href", ops.link_number(F.col("href"), F.col("url")).alias("n"))


@query(TOCS + "SELECT ord, by_link FROM found")
def max_chapter_discovery(spark, sf_dir):
    return ops.discovered(toc(spark, sf_dir)).select("ord", "by_link")


@query(TOCS + "SELECT ord, coalesce(by_link, by_text) AS discovered FROM found WHERE by_link IS NULL")
def link_text_fallback(spark, sf_dir):
    return ops.discovered(toc(spark, sf_dir)).filter("by_link is null").select("ord", F.coalesce("by_link", "by_text").alias("discovered"))


@query(TOCS + "SELECT ord, n_chapters, CASE WHEN n_chapters IS NULL THEN 'no_count' ELSE 'ok' END AS status FROM resolved")
def chapter_count_resolve(spark, sf_dir):
    return ops.resolved(toc(spark, sf_dir)).select("ord", "n_chapters", "status")


@query(TOCS + "SELECT ord, idx FROM generated")
def gapfree_chapter_index(spark, sf_dir):
    return ops.gapfree(toc(spark, sf_dir)).select("ord", "idx")


@query(TOCS + "SELECT ord, idx, coalesce(replace(url_template, '{n}', CAST(idx AS VARCHAR)), url || '/chapter-' || idx) AS chapter_url FROM generated")
def chapter_url_template(spark, sf_dir):
    return ops.gapfree(toc(spark, sf_dir)).select("ord", "idx", "chapter_url")


@query(TOCS + """SELECT ord, 'override ' || chapter_count || ' differs from discovered ' || discovered AS warning FROM resolved WHERE chapter_count <> discovered
UNION ALL SELECT ord, 'suspiciously few chapters: ' || n_chapters FROM resolved WHERE n_chapters < 10""")
def toc_warnings(spark, sf_dir):
    return ops.warnings(toc(spark, sf_dir))


@query(with_views(HTML) + r"""SELECT page_id, json_extract_string(j, '$.props.pageProps.data.chapterInfo.chapterId') AS chapter_id, TRY_CAST(json_extract_string(j, '$.props.pageProps.data.chapterInfo.chapterIndex') AS BIGINT) AS chapter_index
FROM (SELECT page_id, TRY_CAST(nullif(regexp_extract(html, '<script id="__NEXT_DATA__"[^>]*>([\s\S]*?)</script>', 1), '') AS JSON) AS j FROM html_v)""")
def next_data_payload(spark, sf_dir):
    info = F.col("j.props.pageProps.data.chapterInfo")
    return html_pages(spark, sf_dir).withColumn("j", ops.next_data(F.col("html"))).select("page_id", info["chapterId"].alias("chapter_id"), info["chapterIndex"].alias("chapter_index"))


# One book a host, as a JSON payload: volumes of at most 20 pages, some entries broken.
BOOKS = rf"""bk0 AS (SELECT {HOST.format('url')} AS host, page_id, row_number() OVER (PARTITION BY {HOST.format('url')} ORDER BY page_id) AS i FROM pages),
bk1 AS (SELECT host, (i-1)//20 AS vol, array_to_string(list('{{"chapterIndex":' || CASE WHEN page_id % 11 = 0 THEN '"x"' ELSE CAST(i AS VARCHAR) END || ',"chapterId":"' || CASE WHEN page_id % 13 = 0 THEN '' ELSE 'c' || page_id END || '","chapterName":' || CASE WHEN page_id % 5 = 0 THEN 'null' ELSE '"Name ' || page_id || '"' END || '}}' ORDER BY i), ',') AS items FROM bk0 GROUP BY 1, 2),
books_v AS (SELECT host, '{{"props":{{"pageProps":{{"data":{{"bookInfo":{{"bookId":"' || CASE WHEN length(host) % 3 = 0 THEN '' ELSE 'b' || length(host) END || '","chapterCnt":' || CASE WHEN length(host) % 2 = 0 THEN 0 ELSE length(host) END || ',"chapterNum":7}},"volumeItems":[' || array_to_string(list('{{"volumeName":"v","chapterItems":[' || items || ']}}' ORDER BY vol), ',') || ',{{"volumeName":"none","chapterItems":null}}]}}}}}}}}' AS payload FROM bk1 GROUP BY 1)"""
ENTRIES = r"""entries AS (SELECT host, coalesce(nullif(json_extract_string(payload, '$.props.pageProps.data.bookInfo.bookId'), ''), 's' || length(host)) AS book_id, vj, unnest(CAST(json_extract(vj, '$.chapterItems') AS JSON[])) AS cj
  FROM (SELECT host, payload, unnest(CAST(json_extract(payload, '$.props.pageProps.data.volumeItems') AS JSON[])) AS vj FROM books_v) WHERE json_type(json_extract(vj, '$.chapterItems')) = 'ARRAY')"""


def books(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", urls.host_key(F.col("url")).alias("host"))
    i = F.row_number().over(Window.partitionBy("host").orderBy("page_id"))
    item = F.concat(
        F.lit('{"chapterIndex":'), F.when(F.col("page_id") % 11 == 0, '"x"').otherwise(F.col("i").cast("string")), F.lit(',"chapterId":"'), F.when(F.col("page_id") % 13 == 0, "").otherwise(F.concat(F.lit("c"), "page_id")),
        F.lit('","chapterName":'), F.when(F.col("page_id") % 5 == 0, "null").otherwise(F.concat(F.lit('"Name '), "page_id", F.lit('"'))), F.lit("}"),
    )
    ordered = lambda k, v: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(k).alias("k"), F.col(v).alias("v")))), lambda x: x["v"]), ",")
    vols = p.withColumn("i", i).withColumn("item", item).groupBy("host", F.floor((F.col("i") - 1) / 20).alias("vol")).agg(ordered("i", "item").alias("items"))
    vols = vols.withColumn("v", F.concat(F.lit('{"volumeName":"v","chapterItems":['), "items", F.lit("]}")))
    n = F.length("host")
    return vols.groupBy("host").agg(ordered("vol", "v").alias("vs")).select(
        "host",
        F.concat(
            F.lit('{"props":{"pageProps":{"data":{"bookInfo":{"bookId":"'), F.when(n % 3 == 0, "").otherwise(F.concat(F.lit("b"), n)), F.lit('","chapterCnt":'), F.when(n % 2 == 0, 0).otherwise(n),
            F.lit(',"chapterNum":7},"volumeItems":['), "vs", F.lit(',{"volumeName":"none","chapterItems":null}]}}}}'),
        ).alias("payload"),
    )


def parsed_books(spark, sf_dir):
    b = books(spark, sf_dir).withColumn("d", F.from_json("payload", ops.NEXT_DATA)["props"]["pageProps"]["data"])
    return b.select(
        F.col("host").alias("page_id"), F.coalesce(F.nullif(F.col("d.bookInfo.bookId"), F.lit("")), F.concat(F.lit("s"), F.length("host"))).alias("book_id"), F.lit("https://site.example.com").alias("base_url"),
        F.col("d.volumeItems").alias("volumes"), F.coalesce(F.nullif(F.col("d.bookInfo.chapterCnt"), F.lit(0)), F.nullif(F.col("d.bookInfo.chapterNum"), F.lit(0)), F.lit(0)).alias("expected"),
    )


@query(with_views(BOOKS, ENTRIES) + "SELECT host, json_extract_string(cj, '$.chapterId') AS chapter_id FROM entries")
def toc_flatten(spark, sf_dir):
    v = parsed_books(spark, sf_dir).select(F.col("page_id").alias("host"), F.explode("volumes").alias("v"))
    return v.select("host", F.explode("v.chapterItems").alias("c")).select("host", F.col("c.chapterId").alias("chapter_id"))


@query(with_views(BOOKS, ENTRIES) + """SELECT host, idx, coalesce(name, 'Chapter ' || idx) AS name, 'https://site.example.com/story/' || book_id || '/' || id AS chapter_url FROM (SELECT host, book_id, TRY_CAST(json_extract_string(cj, '$.chapterIndex') AS BIGINT) AS idx, json_extract_string(cj, '$.chapterId') AS id, json_extract_string(cj, '$.chapterName') AS name FROM entries) WHERE idx IS NOT NULL AND id <> ''""")
def toc_row_validity(spark, sf_dir):
    return ops.flattened(parsed_books(spark, sf_dir)).select(F.col("page_id").alias("host"), "idx", "name", "chapter_url")


@query(with_views(BOOKS) + """SELECT host, coalesce(nullif(json_extract_string(payload, '$.props.pageProps.data.bookInfo.bookId'), ''), 's' || length(host)) AS book_id, CASE WHEN length(host) % 2 = 0 THEN 7 ELSE length(host) END AS expected FROM books_v""")
def toc_book_id_resolve(spark, sf_dir):
    return parsed_books(spark, sf_dir).select(F.col("page_id").alias("host"), "book_id", "expected")


@query(TOCS + "SELECT novel_slug, ord, idx, row_number() OVER (PARTITION BY novel_slug ORDER BY idx, ord) AS pos FROM generated")
def toc_sort(spark, sf_dir):
    return ops.gapfree(toc(spark, sf_dir)).select("novel_slug", "ord", "idx", F.row_number().over(Window.partitionBy("novel_slug").orderBy("idx", "ord")).cast("long").alias("pos"))


@query(with_views(CHAPTERS) + """SELECT novel_slug, count(*) AS n_gaps, list(idx ORDER BY idx)[1:10] AS first_gaps FROM (SELECT *, lag(idx) OVER (PARTITION BY novel_slug ORDER BY idx, doc_id, rep) AS b FROM chapters_v) WHERE b IS NOT NULL AND idx <> b + 1 GROUP BY 1""")
def chapter_gap_detection(spark, sf_dir):
    return ops.gaps(chapters(spark, sf_dir))


@query(with_views(BOOKS, ENTRIES) + """SELECT b.host, CASE WHEN length(b.host) % 2 = 0 THEN 7 ELSE length(b.host) END AS expected, coalesce(n, 0) AS found FROM books_v b LEFT JOIN (SELECT host, count(*) AS n FROM entries WHERE TRY_CAST(json_extract_string(cj, '$.chapterIndex') AS BIGINT) IS NOT NULL AND json_extract_string(cj, '$.chapterId') <> '' GROUP BY 1) USING (host)
WHERE coalesce(n, 0) <> CASE WHEN length(b.host) % 2 = 0 THEN 7 ELSE length(b.host) END""")
def expected_count_check(spark, sf_dir):
    b = parsed_books(spark, sf_dir)
    n = ops.flattened(b).groupBy("page_id").agg(F.count("*").alias("n"))
    out = b.join(n, "page_id", "left").select(F.col("page_id").alias("host"), "expected", F.coalesce("n", F.lit(0)).alias("found"))
    return out.filter("expected <> 0 and found <> expected")


@query(TOCS + "SELECT ord, novel_slug FROM toc_v WHERE ord NOT IN (SELECT ord FROM generated)")
def empty_toc_report(spark, sf_dir):
    t = toc(spark, sf_dir)
    return t.join(ops.gapfree(t).select("ord"), "ord", "left_anti").select("ord", "novel_slug")


@query(with_views(CHAPTERS) + "SELECT novel_slug, count(*) AS n, min(idx) AS first_idx, max(idx) AS last_idx FROM chapters_v GROUP BY 1")
def toc_summary(spark, sf_dir):
    return chapters(spark, sf_dir).groupBy("novel_slug").agg(F.count("*").alias("n"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"))


# Escapes that scripts allow and JSON does not: a backslash before each of the texts' spaces.
@query(r"""SELECT doc_id, regexp_replace(replace(text, ' ', '\ '), '\\([^"\\/bfnrtu]|$)', '\1', 'g') AS repaired FROM documents""")
def js_escape_repair(spark, sf_dir):
    from quire.functions.scripts import repair_escapes

    return table(spark, sf_dir, "documents").select("doc_id", repair_escapes(F.replace(F.col("text"), F.lit(" "), F.lit("\\ "))).alias("repaired"))


@query(
    with_views(CATALOG, BOOKS)
    + """SELECT c.ord, CASE WHEN c.ord % 3 = 0 AND b.payload IS NOT NULL THEN 'next_data' WHEN c.ord % 3 = 1 AND b.payload IS NOT NULL THEN 'assignment' ELSE 'error' END AS source FROM catalog_v c LEFT JOIN books_v b USING (host)"""
)
def toc_source_choice(spark, sf_dir):
    c = catalog(spark, sf_dir).join(books(spark, sf_dir), "host", "left")
    first = F.from_json(F.when(F.col("ord") % 3 == 0, F.col("payload")), ops.NEXT_DATA)["props"]["pageProps"]["data"]["volumeItems"]
    second = F.from_json(F.when(F.col("ord") % 3 == 1, F.col("payload")).otherwise("{broken"), ops.NEXT_DATA)["props"]["pageProps"]["data"]["volumeItems"]
    return c.select("ord", F.when(first.isNotNull(), "next_data").when(second.isNotNull(), "assignment").otherwise("error").alias("source"))


INDEX_LINES = """lines AS (SELECT ord, CASE WHEN ord % 6 = 0 THEN '{"bad' WHEN ord % 6 = 1 THEN '{"index":1}' WHEN ord % 6 = 2 THEN '[]' ELSE '[{"index":1,"url":"' || url || '","title":"a"},{"index":2,"url":"' || url || '","title":null}]' END AS raw FROM catalog_v)"""


@query(with_views(CATALOG, INDEX_LINES) + "SELECT ord, unnest([1, 2]) AS idx FROM lines WHERE ord % 6 NOT IN (0, 1, 2)")
def chapter_index_load(spark, sf_dir):
    raw = F.when(F.col("ord") % 6 == 0, '{"bad').when(F.col("ord") % 6 == 1, '{"index":1}').when(F.col("ord") % 6 == 2, "[]").otherwise(F.concat(F.lit('[{"index":1,"url":"'), "url", F.lit('","title":"a"},{"index":2,"url":"'), "url", F.lit('","title":null}]')))
    from quire.sources.index_files import load_index

    return load_index(catalog(spark, sf_dir).select("ord", raw.alias("raw")), "ord").select("ord", "idx")


DATA_OF = "substr(payload, 30, length(payload) - 32)"


def index_pages(spark, sf_dir):
    """An index page for each enabled catalog row: links, a JSON payload, or (every other of these) a book that a script assigns."""
    c = catalog(spark, sf_dir).filter("enabled")
    linked = toc(spark, sf_dir).filter("adapter_key = 'profile_a'")
    listed = c.filter("ord > 0 and adapter_key = 'profile_b'").join(books(spark, sf_dir), "host")
    book = F.concat(F.lit("<script>g_data.book = "), F.expr(DATA_OF), F.lit(";</script>"))
    page = F.concat(F.lit('<script id="__NEXT_DATA__" type="application/json">'), "payload", F.lit("</script>"))
    listed = listed.withColumn("html", F.when(F.col("ord") % 4 == 1, book).otherwise(page)).drop("payload")
    pages = linked.unionByName(listed.select(linked.columns)).unionByName(c.filter("ord < 0").withColumn("html", F.lit("")).select(linked.columns))
    return pages.withColumns({"book_id": F.concat(F.lit("s"), F.length("host")), "base_url": F.lit("https://site.example.com/")})


@query(
    with_views(CATALOG, TOC, LINKS, BOOKS, ENTRIES)
    + """SELECT g.ord, g.idx, coalesce(replace(g.url_template, '{n}', CAST(g.idx AS VARCHAR)), g.url || '/chapter-' || g.idx) AS url, NULL AS title, NULL AS source_id, NULL AS error FROM generated g JOIN resolved r USING (ord) WHERE r.adapter_key = 'profile_a'
UNION ALL SELECT ord, NULL, NULL, NULL, NULL, 'no chapter count' FROM resolved WHERE adapter_key = 'profile_a' AND coalesce(n_chapters, 0) < 1
UNION ALL SELECT c.ord, e.idx, 'https://site.example.com/story/' || e.book_id || '/' || e.id, coalesce(e.name, 'Chapter ' || e.idx), e.id, NULL FROM catalog_v c
  JOIN (SELECT host, book_id, TRY_CAST(json_extract_string(cj, '$.chapterIndex') AS BIGINT) AS idx, json_extract_string(cj, '$.chapterId') AS id, json_extract_string(cj, '$.chapterName') AS name FROM entries) e USING (host)
  WHERE c.enabled AND c.ord > 0 AND c.adapter_key = 'profile_b' AND e.idx IS NOT NULL AND e.id <> ''
UNION ALL SELECT ord, NULL, NULL, NULL, NULL, 'empty chapter list' FROM catalog_v c WHERE enabled AND ord > 0 AND adapter_key = 'profile_b'
  AND NOT EXISTS (SELECT 1 FROM entries e WHERE e.host = c.host AND TRY_CAST(json_extract_string(cj, '$.chapterIndex') AS BIGINT) IS NOT NULL AND json_extract_string(cj, '$.chapterId') <> '')
UNION ALL SELECT ord, NULL, NULL, NULL, NULL, 'unknown profile' FROM catalog_v WHERE enabled AND ord < 0"""
)
def chapter_index_by_profile(spark, sf_dir):
    """The index of each enabled catalog row by its profile: links or payloads to rows, and what goes wrong as rows."""
    return index_by_profile(index_pages(spark, sf_dir)).select("ord", "idx", "url", "title", "source_id", "error")


@query(TOCS + """SELECT ord, idx, version FROM (SELECT g.ord, g.idx, r.n_chapters AS n, CASE WHEN g.ord % 2 = 0 AND g.ord % 3 <> 0 AND r.n_chapters > 1 THEN 2 WHEN g.ord % 5 <> 0 THEN 1 ELSE 0 END AS version FROM generated g JOIN resolved r USING (ord))
WHERE version <> 2 OR idx < n""")
def index_store_last_valid(spark, sf_dir):
    """Two versions of every index are stored, some are then damaged; each work is read from its last valid one, or built anew."""
    from quire.sources import index_files as store
    from quire.sources.staging import shared_folder

    path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    none = F.lit(None).cast("string")
    built = ops.gapfree(toc(spark, sf_dir)).select("ord", "idx", F.col("chapter_url").alias("url"), none.alias("title"), none.alias("source_id"))
    store.save_version(built, path, 1, "ord")
    last = built.groupBy("ord").agg(F.max("idx").alias("n"))
    store.save_version(built.filter("ord % 2 = 0").join(last, "ord").filter("idx < n").drop("n"), path, 2, "ord")
    hurt = ((F.col("version") == 1) & (F.col("ord") % 5 == 0)) | ((F.col("version") == 2) & (F.col("ord") % 3 == 0))
    stored = spark.read.parquet(path).withColumn("raw", F.when(hurt, F.expr("substring(raw, 1, length(raw) - 3)")).otherwise(F.col("raw")))
    return store.completed(store.last_valid(stored, "ord"), built, "ord").select("ord", "idx", "version")
