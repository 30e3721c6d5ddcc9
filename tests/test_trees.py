"""Element trees, character references, profiles: expected values on literal pages."""

import html as stdlib_html
from html.entities import html5

import pytest
from pyspark.sql import functions as F

from quire.functions import entities
from quire.functions.profiles import extract_by_profile, index_by_profile
from quire.operators import body, titles, trees


def pages_of(spark, *texts):
    return spark.createDataFrame([(i, f"https://h.org/{i}", t) for i, t in enumerate(texts)], "page_id long, url string, html string")


def test_every_name_and_odd_numbers(spark):
    texts = [f"a&{k} b" for k in html5] + [f"x&{k}y;" for k in html5]
    texts += [f"&#{n};&#x{n:x} " for n in (0, 1, 8, 9, 10, 11, 13, 31, 38, 65, 127, 128, 129, 146, 159, 160, 8217, 0xD800, 0xFDD0, 0xFFFE, 0x1F600, 0x10FFFF, 0x10FFFD, 0x110000, 10**20)]
    texts += ["", "&", "&&", "&;", "&#;", "&#x;", "&amp;lt;", "&notit; &notin;", "&copyx", "&" + "a" * 40 + ";", "&CounterClockwiseContourIntegral;", "&é; &lt", "no reference", "&#00065;b"]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string").withColumn("d", entities.decode(F.col("t")))
    assert [(r.t, r.d) for r in df.collect() if r.d != (r.t and stdlib_html.unescape(r.t))] == []


def test_paragraphs_and_titles_hold_no_references(spark):
    p = pages_of(spark, "<h1>Chapter 2: It&#8217;s &hellip;</h1><p>It&#8217;s late&hellip; she said &mdash; and &#x2019;twas so</p>")
    assert [r.paragraphs for r in body.extract(p).collect()] == [["It’s late… she said — and ’twas so"]]
    assert [r.paragraphs for r in body.chapters_of(p.withColumn("number", F.lit(2))).collect()] == [["It’s late… she said — and ’twas so"]]
    assert [r.title for r in titles.best(p).collect()] == ["It’s …"]


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<!-- <h1>Chapter 99: Commented</h1> --><h1>Chapter 3: Real</h1>", (3, "Real")),
        ("<script>'<h1>Chapter 98: Quoted</h1>'</script><h1>Chapter 3: Real</h1>", (3, "Real")),
        ('<span class="chapter">Chapter 5: <span>Nested</span> tail words</span>', (5, "Nested tail words")),
        ("<span class='big chapter'>Chapter 5: Single quotes</span>", (5, "Single quotes")),
        ('<meta content="Chapter 6: Before" property="og:novel:chapter_name">', (6, "Before")),
        ("<meta content='Chapter 7: By name' name=og:title>", (7, "By name")),
        ('<meta name="og:title" content="Chapter 1: no"><meta property="og:title" content="Chapter 8: Property first">', (8, "Property first")),
        ("<div><b>" + "long words " * 60 + "Chapter 9</b><i>The Label</i></div>", (9, "The Label")),
        ("<div><b>Chapter 4</b><!-- x -->The Fall</div>", (4, "The Fall")),
        ("<b>Chapter 4</b> loose text", (4, "loose text")),
    ],
)
def test_titles_from_the_tree(spark, html, want):
    assert [(r.number, r.title) for r in titles.best(pages_of(spark, html)).collect()] == [want]


def test_pieces_are_stored_once_however_deep(spark):
    depth = 400
    p = pages_of(spark, "<div>" * depth + "<p>one <b>two</b></p>three" + "</div>" * depth, "", None, "<p>a<p>b<br>c</p><nav>hidden <p>too</nav>")
    rows = {r.page_id: r for r in trees.parsed(p).collect()}
    assert [x.text for x in rows[0].pieces] == ["one", "two", "three"] and len(rows[0].elements) == depth + 2
    assert rows[1].pieces == rows[1].elements == rows[2].pieces == rows[2].elements == []
    assert [(e.tag, e.shown) for e in rows[3].elements] == [("p", True), ("p", True), ("br", True), ("nav", False), ("p", False)]
    out = trees.parsed(p).select("page_id", F.transform(trees.tagged("p"), trees.text_of).alias("t")).collect()
    assert {r.page_id: r.t for r in out}[0] == ["one two"]


def test_one_parse_and_no_shuffle(spark):
    plan = body.chapters_of(pages_of(spark, "<p>x</p>").withColumn("number", F.lit(1)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan


TEXT = "A sentence that stays in order here."
CHAPTER = '{"chapterName":"Chapter 4: Named.","contents":[{"content":"<p>It&rsquo;s\\ so</p>"},null,{"content":"Login here"}]}'


def test_payload_before_assignment_before_page(spark):
    data = '<script id="__NEXT_DATA__">{"props":{"pageProps":{"data":{"chapterInfo":{"chapterName":"Chapter 1: J","contents":[{"content":"%s"}]}}}}}</script>'
    assigned = f'<script>g_data.book = {{"a":"}}"}}; g_data.chapInfo = {CHAPTER};</script><script>{{</script>'
    dom = f'<h1>Page</h1><div class="cha-words"><p>{TEXT}</p><div><p>Nested.</p></div><p>After.</p></div>'
    p = pages_of(spark, data % "Json" + assigned + dom, data % "Login" + assigned + dom, assigned.replace("It&rsquo;s\\ so", "Report") + dom, dom, "<div>none</div>", "<main><p>Login</p></main>", None)
    out = {r.page_id: (r.source, r.title, r.paragraphs) for r in body.by_precedence(p).collect()}
    assert out[0] == ("next_data", "Chapter 1: J", ["Json"]) and out[1] == ("assignment", "Chapter 4: Named.", ["It’s so"])
    assert out[2] == out[3] == ("dom", "Page", [TEXT, "Nested.", "After."])
    assert [out[i][0] for i in (4, 5, 6)] == ["none"] * 3 and out[4][2] == out[5][2] == []
    rows = extract_by_profile(p.withColumn("adapter_key", F.when(F.col("page_id") < 5, "profile_b").when(F.col("page_id") == 5, "nope"))).collect()
    got = {r.page_id: (r.title, r.status) for r in rows}
    assert len(rows) == 7 and got[0] == ("J", "ok") and got[1] == ("Named", "ok") and got[4] == ("", "empty") and got[5] == got[6] == ("", "unknown profile")


def test_the_flagship_asks_the_whole_page_and_the_payload(spark):
    p = pages_of(spark, f"<article><p>short</p></article><p>{TEXT}</p>", f"<article><p>{TEXT}</p></article><p>Other good sentence.</p>", f"<script>g_data.chapInfo = {CHAPTER}</script>")
    out = {r.page_id: (r.title, r.paragraphs) for r in body.extract(p).collect()}
    assert out[0][1] == [TEXT] and out[1][1] == [TEXT] and out[2] == ("Chapter 4: Named.", ["It’s so"])


def test_index_by_profile(spark):
    book = '{"bookInfo":{"bookId":"","chapterCnt":2},"volumeItems":[{"chapterItems":[{"chapterIndex":"2","chapterId":"b","chapterName":null},{"chapterIndex":"x","chapterId":"c"},{"chapterIndex":1,"chapterId":"a","chapterName":"One"}]},{"chapterItems":null}]}'
    link = '<a href="/n/x/chapter-3">Chapter 3</a>'
    rows = [
        (1, "profile_a", link), (2, "profile_a", ""), (3, "profile_b", f"<script>g_data.book = {book};</script>"), (4, "profile_b", "<p>"), (5, "profile_b", '<script>g_data.book = {"volumeItems":[]}</script>'),
        (6, "zzz", ""), (7, None, ""),
    ]
    p = spark.createDataFrame([(o, k, "w", "https://h.org/n/x", h, None, None, "bk", "https://b.org/") for o, k, h in rows], "ord long, adapter_key string, novel_slug string, url string, html string, chapter_count long, url_template string, book_id string, base_url string")
    out = {}
    for r in index_by_profile(p).collect():
        out.setdefault(r.ord, set()).add((r.idx, r.url, r.title, r.error))
    assert out[1] == {(i, f"https://h.org/n/x/chapter-{i}", None, None) for i in (1, 2, 3)} and out[2] == {(None, None, None, "no chapter count")}
    assert out[3] == {(2, "https://b.org/story/bk/b", "Chapter 2", None), (1, "https://b.org/story/bk/a", "One", None)}
    assert out[4] == {(None, None, None, "no supported payload")} and out[5] == {(None, None, None, "empty chapter list")}
    assert out[6] == out[7] == {(None, None, None, "unknown profile")}
