"""Expected values of the rules, on literal inputs."""

import pytest
from pyspark.sql import functions as F

from quire.functions import text, urls
from quire.functions.scripts import repair_escapes
from quire.operators import body, books, fetch, nodes, quality, titles, toc
from quire.sources import index_files, outputs


def one(spark, column, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("url", "host"),
    [("https://Example.COM/a", "example.com"), ("http://example.com:8080/x", "example.com:8080"), ("https://u@h.org?q", "h.org"), ("//x", "")],
)
def test_host_key(spark, url, host):
    assert one(spark, urls.host_key(F.col("u")), u=url) == host


@pytest.mark.parametrize(
    ("base", "href", "want"),
    [
        ("https://h.org/a/b", "c", "https://h.org/a/c"), ("https://h.org/a/b/", "../c", "https://h.org/a/c"), ("https://h.org", "x", "https://h.org/x"),
        ("https://h.org/a#f", "#g", "https://h.org/a#g"), ("http://h.org/a", "//k.org/z", "http://k.org/z"), ("http://h.org/a", "mailto:x", "mailto:x"),
    ],
)
def test_absolutize(spark, base, href, want):
    assert one(spark, urls.absolutize(F.col("b"), F.col("h")), b=base, h=href) == want


def test_strings(spark):
    assert one(spark, text.strip_invisible(F.col("t")), t="Reverend‌Title  x﻿") == "Reverend Title x"
    assert one(spark, text.chapter_heading(F.col("i"), F.col("t")), i=3, t=" The Test ") == "Chapter 3: The Test."
    assert one(spark, text.chapter_heading(F.col("i"), F.col("t")), i=3, t=" ") == "Chapter 3."
    assert one(spark, text.safe_filename(F.col("t")), t='a:b*?"<x>|/\\c') == "a_b_x_c"
    assert one(spark, text.safe_filename(F.col("t")), t=" ") == "untitled"
    assert one(spark, text.title_only(F.col("t")), t="Chapter 12 – Dawn...") == "Dawn"
    assert one(spark, text.entity_decode(text.entity_escape(F.col("t"))), t="a &lt; <b> & c") == "a &lt; <b> & c"
    assert one(spark, repair_escapes(F.col("t")), t='{"a":"x\\ y\\n"}') == '{"a":"x y\\n"}'


@pytest.mark.parametrize("f", [text.ws_collapse, text.strip_invisible, text.safe_filename])
def test_twice_is_once(spark, sf_dir, f):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(f(F.col("text")).alias("t"))
    assert d.filter(f(F.col("t")) != F.col("t")).count() == 0


def test_noise(spark):
    rows = [("Translator: Someone", "credit"), ("* * *", "no letters"), ("é", "very short"), ("short one", "short"), ('"Go on."', None), ("Chapter 5: X y z", "chapter label"), ("Please login here now", "chrome"), ("A plain sentence stays.", None), ("", "empty"), ("The Head Line", "heading")]
    got = spark.createDataFrame(rows, "t string, want string").select("t", "want", body.noise_reason(F.col("t"), F.lit("the head line")).alias("r")).collect()
    assert [(r.t, r.r) for r in got] == rows


def test_headings(spark):
    yes, no = ["Chapter 1: A title.", "chapter 22:  x ."], ["Chapter 1.", "Chapter 1: no dot", "Chapter 1: " + "x" * 500 + "."]
    for t, want in [(t, True) for t in yes] + [(t, False) for t in no]:
        assert one(spark, books.is_heading(F.col("t")), t=t) is want, t
    parts = one(spark, books.split_merged(F.col("t")), t='Chapter 4: Night... "Who goes there?"')
    assert [(p.kind, p.text) for p in parts] == [("heading", "Chapter 4: Night..."), ("body", '"Who goes there?"')]


def test_backoff_and_delay(spark):
    got = spark.range(1, 6).select(fetch.backoff(F.col("id")).alias("b")).collect()
    assert [r.b for r in got] == [5, 15, 45, 120, 120]
    got = spark.range(0, 9).select(fetch.effective_delay(F.lit(0.0), F.col("id")).alias("d")).collect()
    assert [r.d for r in got][:4] == [0, 2, 3, 4.5] and got[-1].d == 30


def test_retry_after_and_classes(spark):
    got = spark.createDataFrame([("12",), (" 1.5 ",), ("-1",), ("Wed, 21 Oct",), (None,)], "v string").select(quality.retry_after(F.col("v")).alias("s")).collect()
    assert [r.s for r in got] == [12, 1.5, None, None, None]
    rows = [(200, True, True, "success"), (200, False, True, "challenge"), (410, False, False, "not_found"), (429, False, False, "rate_limited"), (502, False, False, "transient"), (403, False, False, "challenge"), (418, False, False, "error"), (200, False, False, "success")]
    got = spark.createDataFrame(rows, "s int, r boolean, b boolean, want string").select(quality.response_class(F.col("s"), F.col("r"), F.col("b")).alias("c"), "want").collect()
    assert all(r.c == r.want for r in got)


def test_empty_shell_is_no_body(spark):
    assert not one(spark, quality.has_populated_body(F.col("h")), h='<div id="article"> </div>challenge-platform')
    assert one(spark, quality.has_populated_body(F.col("h")), h='<div id="article"><p>just a moment, they said to us</p></div>')


def test_gap_free_index(spark):
    links = "".join(f'<a href="/novel/x/chapter-{i}">Chapter {i}</a>' for i in (1, 2, 3, 48, 49, 50))
    rows = [(1, "x", "https://h.org/novel/x", None, None, links)]
    t = spark.createDataFrame(rows, "ord long, novel_slug string, url string, url_template string, chapter_count long, html string")
    assert [r.idx for r in toc.gapfree(t).orderBy("idx").collect()] == list(range(1, 51))


def test_nodes(spark):
    html = '<div id="a"><p>one<p>two <b>bold</b><br></div><script>var t="</p>";g = {"a":"}\\"x"};</script><img src="q">'
    p = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")
    rows = nodes.nodes(p).orderBy("node_id").collect()
    assert [(r.tag, r.parent_id, r.end_id) for r in rows] == [("div", -1, 4), ("p", 0, 1), ("p", 0, 4), ("b", 2, 3), ("br", 2, 4), ("script", -1, 5), ("img", -1, 6)]
    assert rows[1].own_text == "one" and rows[5].own_text == ""
    assert {r.page_id: r.payload for r in nodes.assignment(p, "g").collect()} == {1: '{"a":"}\\"x"}', 2: None}


def test_split_headings(spark):
    p = spark.createDataFrame([(1, "<div><b>Chapter 4</b><i>The Fall</i></div><div><b>Chapter 5</b><i>Chapter 6</i></div>")], "page_id long, html string")
    assert [r.heading for r in titles.split_headings(p).collect()] == ["Chapter 4: The Fall"]


def test_sinks_read_back(spark, tmp_path):
    index = spark.createDataFrame([(1, "u1", None, "s"), (2, "u2", "t", None)], "idx long, url string, title string, source_id string")
    index_files.save_index(index, f"{tmp_path}/index")
    assert sorted(map(tuple, index_files.read_index(spark, f"{tmp_path}/index").collect())) == sorted(map(tuple, index.collect()))
    pages = spark.createDataFrame([("w1", "a", "<p>"), ("w2", "b", "<q>")], "novel_slug string, url string, html string")
    outputs.write_pages(pages, f"{tmp_path}/pages")
    outputs.write_pages(pages.filter("novel_slug = 'w2'").withColumn("html", F.lit("new")), f"{tmp_path}/pages")
    assert sorted((r.novel_slug, r.html) for r in spark.read.parquet(f"{tmp_path}/pages").collect()) == [("w1", "<p>"), ("w2", "new")]
    done = spark.createDataFrame([("w1", "f1", "text\nmore")], "novel_slug string, book_file string, text string")
    outputs.write_books(done, f"{tmp_path}/books")
    assert [r.text for r in spark.read.parquet(f"{tmp_path}/books").collect()] == ["text\nmore"]
    outputs.append_report(spark.createDataFrame([("r1", 3)], "run_id string, written long"), f"{tmp_path}/reports")
    outputs.append_report(spark.createDataFrame([("r2", 4)], "run_id string, written long"), f"{tmp_path}/reports")
    assert spark.read.json(f"{tmp_path}/reports").count() == 2


def test_profiles():
    from quire.functions.profiles import PROFILES, profile, register

    assert {"profile_a", "profile_b"} <= PROFILES.keys()
    with pytest.raises(KeyError, match="profile_a"):
        profile("nope")
    with pytest.raises(ValueError, match="profile_a"):
        register("profile_a")(lambda pages: pages)


def test_titles_with_invisible_characters_and_more_than_thirty_spans(spark):
    from quire.operators import titles

    html = "".join(f'<span class="chapter">Part {i}</span>' for i in range(40)) + "<h1>Chapter‌ 12‍: The End</h1>"
    p = spark.createDataFrame([(1, html)], "page_id long, html string")
    assert titles.candidates(p).count() == 41
    assert [tuple(r) for r in titles.best(p).collect()] == [(1, 12, "The End")]


def test_names_in_any_case_and_paths_of_any_length(spark):
    from quire.functions import urls
    from quire.operators import resume

    files = spark.createDataFrame([("w", "CHAPTER 7 - x.PDF"), ("w", "chapter 8.pdf"), ("w", "other.pdf")], "novel_slug string, book_file string")
    assert sorted(r.idx for r in resume.existing_chapters(files).collect()) == [7, 8]
    path = "/a" * 10_050 + "/../b"
    assert spark.createDataFrame([(path,)], "p string").select(urls.collapse_dots(F.col("p"))).first()[0] == "/a" * 10_049 + "/b"


def best_of(spark, html, number=None):
    p = spark.createDataFrame([(1, html)], "page_id long, html string")
    p = p.withColumn("number", F.lit(number).cast("long")) if number else p
    return [(r.number, r.title) for r in titles.best(p, fallback=bool(number)).collect()]


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ('<div id="article"><p>Chapter‌ 9: The Gate</p><p>Text that follows.</p></div>', [(9, "The Gate")]),
        ('<div id="article">' + "<p>x</p>" * 10 + "<p>Chapter 9: Too late</p></div>", []),
        ('<div class="chapter"><p>Chapter 9: ' + "x" * 300 + "</p></div>", []),
        ("<div><strong>Chapter 4</strong> The Fall</div>", [(4, "The Fall")]),
        ("<div><span>Read Chapter 4</span><i></i>The <b>Fall</b></div>", [(4, "The")]),
        ("<h2>Chapter 4</h2><p>" + "x" * 201 + "</p>", [(4, "")]),
        ("<h2>Chapter 4</h2><div>" + "x" * 301 + "</div>", [(4, "")]),
        ("<h1>Chapter <b>5</b>: A <i>b</i></h1>", [(5, "A b")]),
        ("<p>nothing</p>", []),
    ],
)
def test_titles(spark, html, want):
    assert best_of(spark, html) == want


def test_fallback_number(spark):
    assert best_of(spark, "<p>nothing</p>", 7) == [(7, "")] and best_of(spark, "<h1>Chapter 3: X</h1>", 7) == [(3, "X")]


def test_only_paragraphs_count(spark):
    html = "<p>one <b>bold</b> word</p> advert <div>more</div><P class='x'>two<p>three</p><pre>no</pre><p/>"
    assert one(spark, body.paragraphs(F.col("h")), h=html) == ["one bold word", "two", "three"]


def test_chapters_of(spark):
    text = "A sentence that stays <b>in</b> order here."
    rows = [
        (1, f"<h1>Chapter 1: Go</h1><article><p>Short</p></article><div class='chapter-body x'><p>{text}</p><p>{text}</p><p>Chapter 1: Go</p></div>"),
        (2, f"<div><p>{text}</p>loose words</div>"), (3, "<article><p>Short</p></article>"), (4, None),
        (5, f"<main><article><p>{text}</p></article></main>"),
    ]
    p = spark.createDataFrame(rows, "page_id long, html string")
    got = body.chapters_of(p, p.select("page_id", F.col("page_id").alias("number"))).orderBy("page_id").collect()
    plain = "A sentence that stays in order here."
    assert [(r.title, r.paragraphs, r.degraded, r.failed) for r in got] == [("Go", [plain], False, False), ("", [plain], True, False), ("", [], True, True), ("", [], True, True), ("", [plain], True, False)]


def test_payload_page_without_payload(spark):
    html = "<h1></h1><h3 class='cha-tit'>The <i>Name</i></h3><div class='cha-words'><p>Kept.</p><p>Login first</p></div><article><p>Later.</p></article>"
    p = spark.createDataFrame([(1, html)], "page_id long, html string")
    assert [(r.title, r.paragraphs) for r in body.dom_chapters(p).collect()] == [("The Name", ["Kept."])]


@pytest.mark.parametrize(
    ("script", "want"),
    [
        ("g = {'a': '}', b: {c: \"\\\"}\"}}; x", "{'a': '}', b: {c: \"\\\"}\"}}"), ("g = {", None), ('g = {"a', None), ("h = {}", None), ("g", None), (None, None),
        ("g = {'" + "\\'x" * 50_000 + "'}", "{'" + "\\'x" * 50_000 + "'}"),
    ],
)
def test_assignment(spark, script, want):
    p = spark.createDataFrame([(1, script)], "page_id long, html string")
    assert [r.payload for r in nodes.assignment(p, "g").collect()] == [want]
