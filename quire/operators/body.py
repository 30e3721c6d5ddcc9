"""Paragraphs: extraction, noise, duplicates, and whole chapters by site profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.scripts import assigned_object, repair_escapes
from quire.functions.text import HEADING, is_degraded, let, markup_to_text, strip_tags, ws_collapse
from quire.operators import trees
from quire.operators.quality import ASSIGNED
from quire.operators.titles import CONTAINERS, NO_TEXTS, with_candidates, with_title
from quire.operators.toc import CHAPTER_INFO, next_data

#: Snippets of page chrome, by profile.
NOISE = (
    "contact", "dmca", "privacy policy", "reader mode", "report chapter", "table of contents", "bookmark", "login", "register", "comment", "discussion",
    "next chapter", "previous chapter", "want to read more chapters", "text to speech", "add to library", "load more comments", "use arrow keys",
)
JUNK = ("comment", "discussion", "login", "reader mode", "swipe", "report", "reader setting", "previous chapter", "next chapter")
#: Where a payload page that has no payload keeps its text and its title, as (kind, name).
FALLBACK = (("part", "ChapterContent_content"), ("part", "ChapterContent_container"), ("div", "cha-words"), ("div", "cha-content"), ("part", "ChapterContent"), ("tag", "article"), ("tag", "main"))
TITLES = (("part", "ChapterContent_title"), ("tag", "h1"), ("class", "cha-tit"), ("class", "chapter-title"))
CREDIT = r"(?i)^(translator|tl|editor|ed|proofreader|pr)\s*[:\-]\s*\S+"
OPEN_P = r"(?i)<p(?:[ \t-\r][^>]*)?>"
CLOSED_P = r"(?is)</p[ \t-\r]*>.*$"


def drop_markers(html: Column) -> Column:
    for tag in ("subtxt", "script", "style", "nav"):
        html = F.regexp_replace(html, rf"(?is)<{tag}\b.*?</{tag}>", "")
    return html


def paragraphs(html: Column, closed: bool = False) -> Column:
    """Texts of the <p> elements in order, and nothing that stands between them; an open <p> ends where the next begins."""
    parts = F.split(drop_markers(html), OPEN_P, -1)
    inner = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda t: strip_tags(F.regexp_replace(t, CLOSED_P, ""), closed))
    return F.filter(inner, lambda t: t != "")


def noise_reason(text: Column, heading: Column, collapsed: bool = False) -> Column:
    """The first rule that drops a paragraph; null if it stays. collapsed: its white space is collapsed already."""

    def of(t: Column, low: Column) -> Column:
        snippet = F.lit(False)
        for s in NOISE:
            snippet = snippet | F.contains(low, F.lit(s))
        return (
            F.when(t == "", "empty").when(low == F.trim(F.lower(heading)), "heading").when(t.rlike("^" + HEADING.replace(r"(?i)\b", "(?i)")), "chapter label").when(t.rlike(CREDIT), "credit")
            .when(t.rlike(r"^[^\p{L}\p{N}]+$"), "no letters").when(F.length(t) < 4, "very short").when((F.length(t) < 12) & ~t.rlike("^[\"']"), "short").when(snippet, "chrome")
        )

    return let(text if collapsed else ws_collapse(text), lambda t: let(F.lower(t), lambda low: of(t, low)))


def is_junk(text: Column) -> Column:
    def of(low: Column) -> Column:
        out = F.lit(False)
        for s in JUNK:
            out = out | F.contains(low, F.lit(s))
        return out

    return let(F.lower(text), of)


def noise_counts(chapters: DataFrame, heading: Column) -> DataFrame:
    """novel_slug, reason, n: how many paragraphs each rule drops, of each work, and in all (null). Only counts leave a chapter."""
    reasons = F.filter(F.transform("paragraphs", lambda t: noise_reason(t, heading)), lambda r: r.isNotNull())
    each = chapters.select("novel_slug", F.explode(reasons).alias("reason")).groupBy("novel_slug", "reason").agg(F.count("*").alias("n"))
    return each.cube("novel_slug", "reason").agg(F.sum("n").alias("n"))


def each_paragraph(chapters: DataFrame, *more: str) -> DataFrame:
    return chapters.select("novel_slug", "idx", "doc_id", "rep", *more, F.posexplode("paragraphs").alias("pos", "text"))


def without_repeats(a: Column) -> Column:
    """A paragraph equal to the one before goes. The array is walked once, so it is also computed once."""
    return F.aggregate(
        a,
        F.struct(F.lit(None).cast("string").alias("last"), F.expr("cast(array() as array<string>)").alias("out")),
        lambda s, x: F.when(x.eqNullSafe(s["last"]), s).otherwise(F.struct(x.alias("last"), F.concat(s["out"], F.array(x)).alias("out"))),
        lambda s: s["out"],
    )


def distinct_chapters(chapters: DataFrame) -> DataFrame:
    """Chapters whose paragraphs differ from the chapter before. Every dropped one equals the kept one, so the row before will do."""
    order = Window.partitionBy("novel_slug").orderBy("idx", "doc_id", "rep")
    print_ = F.sha2(F.to_json("paragraphs"), 256)
    c = chapters.withColumn("_h", print_)
    return c.withColumn("_b", F.lag("_h").over(order)).filter(F.col("_b").isNull() | (F.col("_b") != F.col("_h"))).drop("_h", "_b")


def heading_line(number: Column, title: Column) -> Column:
    """The line that a paragraph must not repeat."""
    label = F.concat(F.lit("Chapter "), number.cast("string"))
    return F.when(is_degraded(title), F.concat(label, F.lit("."))).otherwise(F.concat(label, F.lit(": "), title, F.lit(".")))


def with_kept(rows: DataFrame) -> DataFrame:
    """Parsed pages with `number` and `title`, and `kept`: the shown paragraphs that are no noise, as (id, text), in order."""
    p = rows.withColumn("_heading", F.coalesce(heading_line(F.col("number"), F.col("title")), F.lit("")))
    shown = F.transform(F.filter(trees.tagged("p"), lambda e: e["shown"]), lambda e: F.struct(e["id"].alias("id"), trees.shown_text_of(e).alias("text")))
    return p.withColumn("kept", F.filter(shown, lambda x: noise_reason(x["text"], F.col("_heading"), collapsed=True).isNull())).drop("_heading")


def with_container(rows: DataFrame) -> DataFrame:
    """Rows of with_kept() and `container`: (score, rank, id, last) of the one with the most kept text, the earliest selector and element of
    equals; null if none has any."""

    def ranked(rank: int, selector: tuple[str, str]) -> Column:
        return F.transform(trees.chosen(selector, "_boxes"), lambda e: F.struct(F.lit(rank).alias("rank"), e["id"].alias("id"), e["last"].alias("last")))

    each = [ranked(rank, s) for rank, s in enumerate(CONTAINERS)]
    size = lambda c: F.aggregate(trees.inside(F.col("kept"), c), F.lit(0).cast("long"), lambda a, x: a + F.length(x["text"]))
    scored = F.transform(F.concat(*each), lambda c: F.struct((-size(c)).alias("less"), c["rank"].alias("rank"), c["id"].alias("id"), c["last"].alias("last")))
    best = F.array_min(F.filter(scored, lambda c: c["less"] < 0))
    p = rows.withColumn("_boxes", trees.boxes("article", "main")).withColumn("_c", best).drop("_boxes")
    return p.withColumn("container", F.when(F.col("_c").isNotNull(), F.struct((-F.col("_c.less")).alias("score"), "_c.rank", "_c.id", "_c.last"))).drop("_c")


def with_paragraphs(rows: DataFrame) -> DataFrame:
    """Rows of with_container() and `paragraphs`: the kept ones of the container, of the whole page if none has any, without repeats."""
    own = F.when(F.col("container").isNotNull(), trees.inside(F.col("kept"), F.col("container"))).otherwise(F.col("kept"))
    return rows.withColumn("paragraphs", without_repeats(F.transform(own, lambda x: x["text"])))


def told(rows: DataFrame, *others: str) -> DataFrame:
    """The others, title, paragraphs, degraded, failed. As rows of a generator: a filter on them isn't pushed down into the extraction, which
    would then run once for the filter and once for the rows that pass it."""
    found = F.struct("title", "paragraphs", is_degraded(F.col("title")).alias("degraded"), (F.size("paragraphs") == 0).alias("failed"))
    return rows.select(*others, F.inline(F.array(found)))


def chapters_of(pages: DataFrame, index: DataFrame | None = None, closed: bool = False) -> DataFrame:
    """Pages of any nesting (page_id, html, others) to their other columns, title, paragraphs, degraded, failed.

    The chapter that a page is stands in its column `number`, or in the index (page_id, number), of which every page then has one row. Titles
    and paragraphs come from one parse: the best candidate's title; the paragraphs of the best container, of the whole page if
    none has any that stay; noise and consecutive repeats are gone. A page without paragraphs has failed.
    """
    if index is not None:
        pages = index.select("page_id", "number").join(pages.drop("number"), "page_id", "left")
    found = with_title(with_candidates(trees.parsed(pages, closed)), F.col("number"))
    out = with_paragraphs(with_container(with_kept(found)))
    others = [c for c in pages.columns if c not in ("html", "number", "title", "paragraphs", "degraded", "failed")]
    return told(out, *others)


def with_dom(rows: DataFrame) -> DataFrame:
    """Parsed pages and `dom`: title and paragraphs of a payload page without payload. Of each selector only the first element counts;
    the first container that a page has, the first title that isn't empty."""
    first = lambda s: F.get(trees.chosen(s, "_boxes"), F.lit(0))
    p = rows.withColumn("_boxes", trees.boxes("article", "main", "h1")).withColumn("_root", F.coalesce(*map(first, FALLBACK)))
    texts = F.transform(trees.inside(trees.tagged("p"), F.col("_root")), trees.text_of)
    title = F.coalesce(*(F.nullif(trees.text_of(first(s)), F.lit("")) for s in TITLES))
    kept = F.filter(texts, lambda t: (t != "") & ~is_junk(t))
    return p.withColumn("dom", F.when(F.col("_root").isNotNull(), F.struct(title.alias("title"), kept.alias("paragraphs")))).drop("_root", "_boxes")


def dom_chapters(pages: DataFrame, closed: bool = False) -> DataFrame:
    """page_id, title, paragraphs of payload pages without payload that have a container with paragraphs that stay."""
    found = with_dom(trees.parsed(pages.select("page_id", "html"), closed))
    return found.filter(F.size("dom.paragraphs") > 0).select("page_id", "dom.title", "dom.paragraphs")


def article_paragraphs(pages: DataFrame, title: Column, closed: bool = False) -> DataFrame:
    """Flat pages: the paragraphs of the article that stay, those of the whole page if it has none. No shuffle; the whole page is read
    only where the article gives nothing."""
    article = F.regexp_extract(F.coalesce("html", F.lit("")), r"<(?:article|main)\b[^>]*>([\s\S]*?)</(?:article|main)>", 1)
    stays = lambda found: F.filter(found, lambda t: noise_reason(t, title, collapsed=True).isNull())
    own = pages.withColumn("_own", stays(paragraphs(article, closed)))
    return own.withColumn("kept", F.when(F.size("_own") > 0, F.col("_own")).otherwise(stays(paragraphs(F.coalesce("html", F.lit("")), closed)))).drop("_own")


def extract(pages: DataFrame, closed: bool = False) -> DataFrame:
    """Flat pages to chapters: page_id, url, title, paragraphs (noise and repeats gone), degraded, failed. A page whose text lies in a payload
    gives the payload's. With `closed` only character references that end in a semicolon count."""
    title = F.coalesce(F.nullif(strip_tags(F.regexp_extract("html", r"<h1\b[^>]*>([\s\S]*?)</h1>", 1), closed), F.lit("")), strip_tags(F.regexp_extract("html", r"<title\b[^>]*>([\s\S]*?)</title>", 1), closed))
    p = pages.withColumns({"title": title, "_payload": F.when(F.contains("html", F.lit("__NEXT_DATA__")) | F.contains("html", F.lit(ASSIGNED)), payload(F.col("html"), closed))})
    p = article_paragraphs(p, F.col("title"), closed)
    out = p.withColumn("paragraphs", F.when(F.size("_payload.paragraphs") > 0, F.col("_payload.paragraphs")).otherwise(without_repeats(F.col("kept"))))
    out = out.withColumn("title", F.when(F.size("_payload.paragraphs") > 0, F.coalesce("_payload.title", F.lit(""))).otherwise(F.col("title")))
    return told(out, "page_id", "url")


def json_paragraphs(info: Column, closed: bool = False) -> Column:
    texts = F.transform(F.filter(info["contents"], lambda c: c.isNotNull()), lambda c: markup_to_text(c["content"], closed))
    return F.filter(texts, lambda t: (t != "") & ~is_junk(t))


def chapter_payloads(html: Column, closed: bool = False) -> tuple[Column, Column]:
    """(title, paragraphs) of the JSON payload and of the assigned one, as arrays that are empty where there is none."""
    infos = next_data(html)["props"]["pageProps"]["data"]["chapterInfo"], F.from_json(repair_escapes(assigned_object(html, ASSIGNED)), CHAPTER_INFO)
    told = lambda info: F.struct(info["chapterName"].alias("title"), json_paragraphs(info, closed).alias("paragraphs"))
    return tuple(F.transform(F.array_compact(F.array(info)), told) for info in infos)


def payload(html: Column, closed: bool = False) -> Column:
    """(title, paragraphs) of the first payload that has paragraphs that stay; null if none has."""
    return F.get(F.filter(F.concat(*chapter_payloads(html, closed)), lambda x: F.size(x["paragraphs"]) > 0), F.lit(0))


def by_precedence(pages: DataFrame, closed: bool = False) -> DataFrame:
    """Payload pages (page_id, html, others) to their other columns, source, title, paragraphs: of the JSON payload, the assignment and the page
    itself, the first with paragraphs that stay. Each page is parsed once, and only if no payload has any."""
    json_, assigned = chapter_payloads(F.col("html"), closed)
    stays = lambda found: F.get(F.filter(found, lambda x: F.size(x["paragraphs"]) > 0), F.lit(0))
    p = pages.withColumns({"_json": stays(json_), "_assigned": stays(assigned)})
    p = p.withColumn("html", F.when(F.col("_json").isNull() & F.col("_assigned").isNull(), F.col("html")))
    p = with_dom(trees.parsed(p, closed))
    source = F.when(F.col("_json").isNotNull(), "next_data").when(F.col("_assigned").isNotNull(), "assignment").when(F.size("dom.paragraphs") > 0, "dom").otherwise("none")
    found = F.coalesce("_json", "_assigned", "dom")
    others = [c for c in pages.columns if c not in ("html", "source", "title", "paragraphs")]
    return p.withColumns({"source": source, "_found": found}).select(*others, "source", "_found.title", F.coalesce("_found.paragraphs", F.expr(NO_TEXTS)).alias("paragraphs"))
