"""Title candidates and the best title of a page, from its element tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import HEADING, heading_number, heading_rest, strip_invisible, title_suffix_trim
from quire.operators import trees

#: Where titles are looked for, in order.
SOURCES = ("span", "meta_name", "heading", "container", "title", "og_title", "twitter_title", "merged")
RANK = {name: rank for rank, name in enumerate(SOURCES)}
#: How many headings of a page and lines of a container count, and the longest line.
MOST_HEADINGS, MOST_LINES, LONGEST_LINE = 30, 10, 300
#: Body containers in order of preference, as (kind, name).
CONTAINERS = (
    ("id", "article"), ("tag", "article"), ("id", "chapter-content"), ("class", "chapter-content"), ("class", "entry-content"),
    ("class", "read-content"), ("class", "novel-content"), ("class", "chapter-body"), ("class", "chapter"), ("tag", "main"),
)
#: Elements whose bare label is merged with what follows, and the longest text that may follow.
LABELS = ("strong", "span", "b", "p", "h1", "h2", "h3", "h4", "h5", "h6")
LONGEST_FOLLOWER = 200
NO_TEXTS = "cast(array() as array<string>)"


def meta(*keys: str, name: str) -> Column:
    """The content of the first <meta> that has `name` in the first of these attributes that any has."""

    def first(key: str) -> Column:
        return F.get(F.filter("elements", lambda e: (e["tag"] == "meta") & F.coalesce(trees.attribute(e, key) == name, F.lit(False))), F.lit(0))

    tags = map(first, keys)
    return F.array_compact(F.array(trees.attribute(F.coalesce(*tags), "content")))


def container_lines() -> Column:
    """Of the first <p> and <div> (the column _lines) of each body container (of the column _boxes), the short ones that speak of a chapter."""
    each = [F.transform(trees.chosen(s, "_boxes"), lambda c: F.transform(F.slice(trees.inside(F.col("_lines"), c), 1, MOST_LINES), trees.text_of)) for s in CONTAINERS]
    return F.filter(F.flatten(F.concat(*each)), lambda t: F.contains(F.lower(t), F.lit("chapter")) & (F.length(t) <= LONGEST_LINE))


def merged_headings() -> Column:
    """Labels that end in a bare "Chapter N", merged with the text that follows them. It is left out if it is empty, too long or a heading itself."""
    labels = F.transform(trees.tagged(*LABELS), lambda e: F.struct(e.alias("e"), trees.text_of(e).alias("raw")))
    # Most labels don't even hold the word; only those that do are read further.
    spoken = F.transform(F.filter(labels, lambda x: F.contains(F.lower(x["raw"]), F.lit("chapter"))), lambda x: F.struct(x["e"].alias("e"), strip_invisible(x["raw"]).alias("text")))
    bare = F.filter(spoken, lambda x: heading_number(x["text"]).isNotNull() & (heading_rest(x["text"]) == ""))
    both = F.transform(bare, lambda x: F.struct(heading_number(x["text"]).alias("n"), strip_invisible(trees.follower(x["e"])).alias("next")))
    fits = F.filter(both, lambda x: (x["next"] != "") & (F.length(x["next"]) <= LONGEST_FOLLOWER) & ~x["next"].rlike(HEADING))
    return F.transform(fits, lambda x: F.concat(F.lit("Chapter "), x["n"].cast("string"), F.lit(": "), x["next"]))


def with_candidates(parsed: DataFrame) -> DataFrame:
    """Parsed pages with `candidates`: array of (rank, pos, text), the first of equal texts, without empty ones."""
    lines = F.transform(trees.tagged("p", "div"), lambda e: F.struct(e["id"].alias("id"), e["lo"].alias("lo"), e["hi"].alias("hi")))
    parsed = parsed.withColumns({"_lines": lines, "_boxes": trees.boxes("article", "main")})
    spans = F.filter("_boxes", lambda e: (e["tag"] == "span") & trees.has_class(e, "chapter"))
    sources = {
        "span": F.transform(spans, trees.text_of),
        "meta_name": meta("property", name="og:novel:chapter_name"),
        "heading": F.transform(F.slice(trees.tagged("h1", "h2", "h3", "h4", "h5", "h6"), 1, MOST_HEADINGS), trees.text_of),
        "container": container_lines(),
        "title": F.transform(F.slice(trees.tagged("title"), 1, 1), trees.text_of),
        "og_title": meta("property", "name", name="og:title"),
        "twitter_title": meta("property", "name", name="twitter:title"),
        "merged": merged_headings(),
    }

    def ranked(name: str, texts: Column) -> Column:
        return F.transform(texts, lambda t, i: F.struct(F.lit(RANK[name]).alias("rank"), i.alias("pos"), strip_invisible(t).alias("text")))

    found = F.concat(*(ranked(name, texts) for name, texts in sources.items()))
    p = parsed.withColumn("_all", F.filter(found, lambda c: c["text"] != "")).withColumn("_texts", F.transform("_all", lambda c: c["text"]))
    first = F.filter("_all", lambda c, i: F.array_position("_texts", c["text"]) == i + 1)
    return p.withColumn("candidates", first).drop("_all", "_texts", "_lines", "_boxes")


def with_title(rows: DataFrame, fallback: Column | None = None) -> DataFrame:
    """Rows of with_candidates() with number and title: of the first candidate with both, else of the first with a number, else the
    fallback number (or null) and an empty title."""
    read = F.transform(
        "candidates",
        lambda c: F.struct(c["rank"].alias("rank"), c["pos"].alias("pos"), heading_number(c["text"]).alias("number"), title_suffix_trim(heading_rest(c["text"])).alias("title")),
    )
    known = F.filter(read, lambda c: c["number"].isNotNull())
    ordered = F.transform(known, lambda c: F.struct((c["title"] == "").alias("e"), c["rank"].alias("rank"), c["pos"].alias("pos"), c["number"].alias("number"), c["title"].alias("title")))
    p = rows.withColumn("_best", F.array_min(ordered))
    number = F.coalesce("_best.number", fallback) if fallback is not None else F.col("_best.number")
    return p.withColumns({"number": number, "title": F.coalesce("_best.title", F.lit(""))}).drop("_best")


def candidates(pages: DataFrame, closed: bool = False) -> DataFrame:
    """page_id, rank, pos, text of every candidate title of the pages."""
    return with_candidates(trees.parsed(pages.select("page_id", "html"), closed)).select("page_id", F.inline("candidates"))


def best(pages: DataFrame, fallback: bool = False, closed: bool = False) -> DataFrame:
    """page_id, number, title of each page that has a numbered candidate; with `fallback` of all pages, the others with their own
    column `number` and an empty title."""
    own = pages.select("page_id", "html", *([F.col("number").alias("_own")] if fallback else []))
    found = with_title(with_candidates(trees.parsed(own, closed)), F.col("_own") if fallback else None)
    return found.select("page_id", "number", "title").filter(F.lit(fallback) | F.col("number").isNotNull())


def split_headings(pages: DataFrame, closed: bool = False) -> DataFrame:
    """page_id, heading: the labels of the pages that are merged with what follows."""
    return trees.parsed(pages.select("page_id", "html"), closed).select("page_id", F.explode(merged_headings()).alias("heading"))
