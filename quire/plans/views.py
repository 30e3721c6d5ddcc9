"""The inputs that the registered queries bind to, as DataFrames and as the same DuckDB common table expressions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import urls
from quire.operators.ordering import placed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- chapters_v: documents as chapters -------------------------------------------------------------------------------
def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    d = d.select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"), F.explode(F.when(F.col("doc_id") % 13 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("rep"))
    d = d.withColumn("rn", F.row_number().over(Window.partitionBy("source").orderBy("doc_id", "rep")).cast("long"))
    d = d.withColumn("idx", (F.col("rn") + F.floor((F.col("rn") - 1) / 9)).cast("long"))
    d = d.withColumn("tt", F.trim(F.regexp_extract("text", r"^[^ \n\t]+(?:[ \n\t]+[^ \n\t]+){0,3}", 0)))
    label, by = F.concat(F.lit("Chapter "), F.col("idx").cast("string")), F.col("doc_id") % 4
    d = d.withColumn("title", F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.col("tt"))).withColumn(
        "raw_heading",
        F.when(F.col("doc_id") % 7 == 0, label)
        .when(by == 0, F.concat(label, F.lit(": "), F.col("tt")))
        .when(by == 1, F.concat(label, F.lit(" - "), F.col("tt")))
        .when(by == 2, F.concat(label, F.lit(" "), F.col("tt")))
        .otherwise(F.concat(F.col("source"), F.lit(" - "), label, F.lit(": "), F.col("tt"), F.lit(" | Example Reader"))),
    )
    none = F.expr("cast(array() as array<string>)")
    first = F.when(F.col("doc_id") % 6 == 0, F.array(F.lit("Translator: Someone"))).when(F.col("doc_id") % 6 == 1, F.array(F.concat(label, F.lit(": "), F.col("tt")))).otherwise(none)
    last = F.when(F.col("doc_id") % 5 == 0, F.array(F.lit("Next chapter"), F.lit("* * *"))).when(F.col("doc_id") % 5 == 1, F.array(F.lit("Please login to leave a comment."))).otherwise(none)
    return d.select(F.col("source").alias("novel_slug"), "idx", "doc_id", "rep", "title", "raw_heading", F.concat(first, F.split("text", "\n"), last).alias("paragraphs"))


CHAPTERS = r"""
cd0 AS (SELECT doc_id, source, coalesce(text,'') AS text, unnest(CASE WHEN doc_id % 13 = 0 THEN [0,1] ELSE [0] END) AS rep FROM documents),
cd1 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, rep) AS rn FROM cd0),
cd2 AS (SELECT *, rn + (rn-1)//9 AS idx, trim(regexp_extract(text, '^[^ \n\t]+(?:[ \n\t]+[^ \n\t]+){0,3}')) AS tt FROM cd1),
chapters_v AS (SELECT source AS novel_slug, CAST(idx AS BIGINT) AS idx, doc_id, rep, CASE WHEN doc_id % 7 = 0 THEN '' ELSE tt END AS title,
  CASE WHEN doc_id % 7 = 0 THEN 'Chapter ' || idx WHEN doc_id % 4 = 0 THEN 'Chapter ' || idx || ': ' || tt WHEN doc_id % 4 = 1 THEN 'Chapter ' || idx || ' - ' || tt
       WHEN doc_id % 4 = 2 THEN 'Chapter ' || idx || ' ' || tt ELSE source || ' - Chapter ' || idx || ': ' || tt || ' | Example Reader' END AS raw_heading,
  list_concat(list_concat(CASE WHEN doc_id % 6 = 0 THEN ['Translator: Someone'] WHEN doc_id % 6 = 1 THEN ['Chapter ' || idx || ': ' || tt] ELSE [] END, string_split(text, chr(10))),
              CASE WHEN doc_id % 5 = 0 THEN ['Next chapter','* * *'] WHEN doc_id % 5 = 1 THEN ['Please login to leave a comment.'] ELSE [] END) AS paragraphs FROM cd2)"""


# ---- fetch_log_v: events as a fetch log ------------------------------------------------------------------------------
def fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fetch_log_of(table(spark, sf_dir, "events"))


def fetch_log_of(e: DataFrame) -> DataFrame:
    u, i = F.col("user_id"), F.col("event_id")
    kind = (
        F.when(F.col("event_type") == "view", "success")
        .when(F.col("event_type") == "click", F.when(i % 2 == 0, "cache").otherwise("success"))
        .when(F.col("event_type") == "error", "challenge")
        .when(F.col("event_type") == "signup", "transient")
        .otherwise(F.when(i % 3 == 0, "rate_limited").when(i % 3 == 1, "not_found").otherwise("extraction_failed"))
    )
    e = e.withColumn("classification", kind)
    status = F.when(F.col("classification") == "challenge", 403).when(F.col("classification") == "transient", 503).when(F.col("classification") == "rate_limited", 429).when(F.col("classification") == "not_found", 404).when(F.col("classification") != "cache", 200)
    return e.select(
        i, "ts", F.concat(F.lit("r"), u % 5).alias("run_id"), F.concat(F.lit("h"), u % 3, F.lit(".example.com")).alias("host"), F.concat(F.lit("w"), u % 20).alias("work"),
        (1 + i % 40).alias("idx"), (u % 5 < 3).alias("armed"), "classification", status.alias("status"),
        F.when((F.col("classification") == "rate_limited") & (i % 2 == 0), 30 + i % 60).alias("retry_after"),
    )


FETCH_LOG = """
fl0 AS (SELECT *, CASE event_type WHEN 'view' THEN 'success' WHEN 'click' THEN CASE WHEN event_id % 2 = 0 THEN 'cache' ELSE 'success' END WHEN 'error' THEN 'challenge' WHEN 'signup' THEN 'transient'
  ELSE CASE event_id % 3 WHEN 0 THEN 'rate_limited' WHEN 1 THEN 'not_found' ELSE 'extraction_failed' END END AS classification FROM events),
fetch_log_v AS (SELECT event_id, ts, 'r' || user_id % 5 AS run_id, 'h' || user_id % 3 || '.example.com' AS host, 'w' || user_id % 20 AS work, 1 + event_id % 40 AS idx, user_id % 5 < 3 AS armed, classification,
  CASE classification WHEN 'challenge' THEN 403 WHEN 'transient' THEN 503 WHEN 'rate_limited' THEN 429 WHEN 'not_found' THEN 404 WHEN 'cache' THEN NULL ELSE 200 END AS status,
  CASE WHEN classification = 'rate_limited' AND event_id % 2 = 0 THEN 30 + event_id % 60 END AS retry_after FROM fl0)"""


# ---- catalog_v: hosts of pages as a catalog, and three rows for the error reports --------------------------------------
def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = table(spark, sf_dir, "pages").select("page_id", urls.host_key(F.col("url")).alias("host")).groupBy("host").agg(F.min("page_id").alias("p"))
    c = placed(hosts, (), ("p", "host"), "ord")
    c = c.select(
        "ord", F.concat(F.lit("w"), F.col("ord") % 20).alias("novel_slug"), F.when(F.col("ord") % 2 == 0, "profile_a").otherwise("profile_b").alias("adapter_key"), "host",
        F.concat(F.lit("https://"), F.col("host"), F.lit("/novel/"), F.col("ord")).alias("url"), (~(F.col("host").startswith("spam") | F.contains("host", F.lit("pills")))).alias("enabled"),
        F.when(F.col("ord") % 4 == 0, F.concat(F.lit("https://"), F.col("host"), F.lit("/c/{n}"))).alias("url_template"), F.when(F.col("ord") % 5 == 0, 12).cast("long").alias("chapter_count"), (F.col("ord") % 3 == 0).alias("use_browser"),
    )
    # Rows that hold what the error reports are about have numbers below zero, which no host has.
    extra = spark.sql("""SELECT * FROM VALUES (-1L,'w1','profile_z','z.example.com','https://z.example.com/novel/1',true,CAST(NULL AS STRING),CAST(NULL AS BIGINT),false),
      (-2L,'w2','profile_z','z.example.com','https://z.example.com/novel/2',false,NULL,NULL,true), (-3L,'w1','profile_z','z.example.com','https://z.example.com/novel/1b',true,NULL,7L,false)
      AS t(ord,novel_slug,adapter_key,host,url,enabled,url_template,chapter_count,use_browser)""")
    return c.unionByName(extra)


CATALOG = r"""
ch0 AS (SELECT lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#]+)', 1)) AS host, min(page_id) AS p FROM pages GROUP BY 1),
ch1 AS (SELECT host, row_number() OVER (ORDER BY p, host) AS ord FROM ch0),
catalog_v AS (SELECT ord, 'w' || ord % 20 AS novel_slug, CASE WHEN ord % 2 = 0 THEN 'profile_a' ELSE 'profile_b' END AS adapter_key, host, 'https://' || host || '/novel/' || ord AS url,
  NOT (starts_with(host, 'spam') OR contains(host, 'pills')) AS enabled, CASE WHEN ord % 4 = 0 THEN 'https://' || host || '/c/{n}' END AS url_template, CASE WHEN ord % 5 = 0 THEN 12 END AS chapter_count, ord % 3 = 0 AS use_browser FROM ch1
  UNION ALL VALUES (-1,'w1','profile_z','z.example.com','https://z.example.com/novel/1',true,NULL,NULL,false), (-2,'w2','profile_z','z.example.com','https://z.example.com/novel/2',false,NULL,NULL,true),
  (-3,'w1','profile_z','z.example.com','https://z.example.com/novel/1b',true,NULL,7,false))"""


# ---- toc_v: an index page for each enabled catalog row -----------------------------------------------------------------
def toc(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir).filter(F.col("enabled") & (F.col("ord") > 0))
    n = F.array(*(F.lit(i).cast("long") for i in (1, 2, 3)), *(F.col("ord") + i for i in (6, 7, 8)))
    href = F.when(F.col("ord") % 3 == 0, F.lit("/about")).otherwise(F.lit(None))
    link = lambda i: F.concat(F.lit('<li><a href="'), F.coalesce(href, F.concat(F.lit("/novel/"), F.col("ord"), F.lit("/chapter-"), i)), F.lit('">Chapter '), i, F.lit("</a></li>"))
    body = F.when(F.col("ord") % 9 == 0, "").otherwise(F.array_join(F.transform(n, link), ""))
    return c.withColumn("html", F.concat(F.lit("<ul>"), body, F.lit("</ul>")))


TOC = """
toc_v AS (SELECT *, '<ul>' || CASE WHEN ord % 9 = 0 THEN '' ELSE array_to_string(list_transform([1,2,3,ord+6,ord+7,ord+8],
  lambda i: '<li><a href="' || CASE WHEN ord % 3 = 0 THEN '/about' ELSE '/novel/' || ord || '/chapter-' || i END || '">Chapter ' || i || '</a></li>'), '') END || '</ul>' AS html
  FROM catalog_v WHERE enabled AND ord > 0)"""


# ---- html_v: stored pages turned into the page shapes that the extraction rules are about -------------------------------
def html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages dressed by page_id: plain articles, blocked pages, empty shells, garbled pages, JSON payloads and assignments."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    body = F.regexp_replace(F.regexp_extract("html", r"<article>([\s\S]*?)</article>", 1), r'["\\]', "'")
    head = F.regexp_extract("html", r"<h1>([^<]*)</h1>", 1)
    p = p.withColumns({"body": body, "head": F.regexp_replace(head, r'["\\]', "'"), "k": F.col("page_id") % 8})
    n = (F.col("page_id") + 1).cast("string")
    contents = F.concat(F.lit('[{"content":"<p>'), F.col("head"), F.lit('</p>"},null,{"content":"Report this comment"},{"content":"'), F.regexp_replace("body", r"<[^>]*>|[\t-\r]", " "), F.lit('"}]'))
    chapter = F.concat(F.lit('{"chapterId":"c'), n, F.lit('","chapterIndex":'), n, F.lit(',"chapterName":"Chapter '), n, F.lit(": "), F.col("head"), F.lit('","contents":'), contents, F.lit("}"))
    dressed = (
        F.when(F.col("k") == 0, F.concat(F.lit('<title>Just a moment...</title><script src="/cdn-cgi/challenge-platform/x"></script><div id="article"> </div>'), F.lit("")))
        .when(F.col("page_id") % 16 == 9, F.concat(F.lit('<div id="article"><p>Chapter\u200c '), n, F.lit(": "), F.col("head"), F.lit("</p> between <p></p>"), F.col("body"), F.lit('</div><meta property="og:title" content="Not this">')))
        .when(F.col("k") == 1, F.concat(F.lit('<h1>Chapter '), n, F.lit(": "), F.col("head"), F.lit('</h1><div id="article"><subtxt>mark</subtxt><p>Translator: X</p><p>just a moment, '), F.col("head"), F.lit("</p>"), F.col("body"), F.lit('</div><script src="challenge-platform"></script>')))
        .when(F.col("k") == 2, F.concat(F.lit('<script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"data":{"chapterInfo":'), chapter, F.lit("}}}}</script>")))
        .when(F.col("k") == 3, F.concat(F.lit("<script>g_data.chapInfo = "), chapter, F.lit(';</script><div class="cha-words"></div><script src="managed-challenge"></script>')))
        .when(F.col("k") == 4, F.concat(F.lit("<h1>Chapter "), n, F.lit('</h1><main class="x"><p>Short</p></main><div class="cha-words"><p>'), F.col("head"), F.lit("</p><p>Login to comment</p><p>"), F.regexp_replace("body", "<[^>]*>", " "), F.lit("</p></div>")))
        .when(F.col("k") == 5, F.concat(F.col("html"), F.repeat(F.lit("�"), (F.floor(F.length("html") / 30) + 40).cast("int"))))
        .when(F.col("k") == 6, F.lit('<script id="__NEXT_DATA__">{}</script><p>cf-mitigated</p>'))
        .otherwise(F.col("html"))
    )
    return p.select("page_id", "url", dressed.alias("html"))


HTML = r"""
hp0 AS (SELECT page_id, url, html, regexp_replace(regexp_extract(html, '<article>([\s\S]*?)</article>', 1), '["\\]', '''', 'g') AS body, regexp_replace(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '["\\]', '''', 'g') AS head,
  page_id % 8 AS k, CAST(page_id + 1 AS VARCHAR) AS n FROM pages),
hp1 AS (SELECT *, '{"chapterId":"c' || n || '","chapterIndex":' || n || ',"chapterName":"Chapter ' || n || ': ' || head || '","contents":' ||
  '[{"content":"<p>' || head || '</p>"},null,{"content":"Report this comment"},{"content":"' || regexp_replace(body, '<[^>]*>|[\t-\r]', ' ', 'g') || '"}]' || '}' AS chapter FROM hp0),
html_v AS (SELECT page_id, url, CASE WHEN page_id % 16 = 9 THEN '<div id="article"><p>Chapter' || chr(8204) || ' ' || n || ': ' || head || '</p> between <p></p>' || body || '</div><meta property="og:title" content="Not this">' ELSE CASE k
  WHEN 0 THEN '<title>Just a moment...</title><script src="/cdn-cgi/challenge-platform/x"></script><div id="article"> </div>'
  WHEN 1 THEN '<h1>Chapter ' || n || ': ' || head || '</h1><div id="article"><subtxt>mark</subtxt><p>Translator: X</p><p>just a moment, ' || head || '</p>' || body || '</div><script src="challenge-platform"></script>'
  WHEN 2 THEN '<script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"data":{"chapterInfo":' || chapter || '}}}}</script>'
  WHEN 3 THEN '<script>g_data.chapInfo = ' || chapter || ';</script><div class="cha-words"></div><script src="managed-challenge"></script>'
  WHEN 4 THEN '<h1>Chapter ' || n || '</h1><main class="x"><p>Short</p></main><div class="cha-words"><p>' || head || '</p><p>Login to comment</p><p>' || regexp_replace(body, '<[^>]*>', ' ', 'g') || '</p></div>'
  WHEN 5 THEN html || repeat(chr(65533), length(html) // 30 + 40)
  WHEN 6 THEN '<script id="__NEXT_DATA__">{}</script><p>cf-mitigated</p>'
  ELSE html END END AS html FROM hp1)"""


# ---- rich_v: stored pages as sites write them: comments, nesting, quotes, references, labels far from their titles -------------
#: A plain word or more of a page's heading, for texts whose form the statement must know.
PLAIN = "coalesce(nullif(trim(regexp_replace(regexp_replace(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '&[a-z]+;|[^A-Za-z ]', ' ', 'g'), ' +', ' ', 'g')), ''), 'Word')"


def rich_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages dressed by page_id % 8, with the chapter number that an index would give and an adapter key by page_id // 8 % 3."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    p = p.withColumns({"body": F.regexp_extract("html", r"<article>([\s\S]*?)</article>", 1), "number": F.col("page_id") + 1, "k": F.col("page_id") % 8})
    plain = F.regexp_replace(F.regexp_replace(F.regexp_extract("html", "<h1>([^<]*)</h1>", 1), "&[a-z]+;|[^A-Za-z ]", " "), " +", " ")
    p = p.withColumn("w", F.coalesce(F.nullif(F.trim(plain), F.lit("")), F.lit("Word")))
    shapes = (
        "<!-- <h1>Chapter 99: Commented</h1> --><h1 class=x>Chapter <strong>{n}</strong>: {w}&#8217;s &hellip;</h1><div id='article'>{body}</div>",
        "<span class='big chapter'>Chapter {n}: <span>{w}</span> tail words</span><article>{body}</article>",
        '<meta content="Chapter {n}: {w}" property="og:novel:chapter_name"><div class="entry-content"><div><p>{w} one &mdash; two and three</p></div><p>after the nested one, {w}</p></div>',
        '<div class="cha-words"><p>{w}&#x2019;s first words</p><div class="in"><p>Inner words of {w}</p></div><p>Last words, past the inner part</p></div><h1>{w}</h1>',
        '<script>g_data.book = {{"a":"}}"}};g_data.chapInfo = {{"chapterName":"Chapter {n}: {w}\\ end.","contents":[{{"content":"<p>It&rsquo;s\\ {w} &lt;3</p>"}},{{"content":"Report it"}},null]}};</script><div class="cha-words"></div>',
        "<div><b>{long}Chapter {n}</b><i>{w}</i></div><main><p>Main words stay here, {w}</p></main>",
        "<article><p>short</p></article><p>Good text outside of it, {w}</p>",
        "{html}",
    )
    fields = {"n": F.col("number").cast("string"), "w": F.col("w"), "body": F.col("body"), "html": F.col("html"), "long": F.repeat(F.lit("a long label "), 30)}
    dressed = None
    for k, shape in enumerate(shapes):
        parts = re.split(r"\{(n|w|body|html|long)\}", shape.replace("{{", "\x01").replace("}}", "\x02"))
        text = F.concat(*(fields[x] if i % 2 else F.lit(x.replace("\x01", "{").replace("\x02", "}")) for i, x in enumerate(parts)))
        dressed = F.when(F.col("k") == k, text) if dressed is None else dressed.when(F.col("k") == k, text)
    key = F.get(F.array(*map(F.lit, ("profile_a", "profile_b", "profile_z"))), (F.floor(F.col("page_id") / 8) % 3).cast("int"))
    return p.select("page_id", "url", "number", key.alias("adapter_key"), dressed.alias("html"))


def with_views(*views: str) -> str:
    return "WITH " + ",".join(views) + "\n"
