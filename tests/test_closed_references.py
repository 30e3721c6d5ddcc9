"""Queries on pages whose titles are cut inside a character reference, against their statements: a reference without its semicolon is text."""

import duckdb
import pytest

from quire.plans import registry

from .test_queries import plain

QUERIES = [
    "entity_decode",
    "markup_to_text",
    "json_contents_paragraphs",
    "assignment_contents_paragraphs",
    "pages_to_books",
    "stream_page_ingest",
    "title_candidates",
    "best_title_pick",
    "split_heading_merge",
    "best_container",
    "whole_page_fallback",
    "dom_fallback_paragraphs",
    "site_profile_extraction",
    "profile_extraction",
]


@pytest.fixture(scope="module")
def cut_pages(tmp_path_factory):
    at = tmp_path_factory.mktemp("cut")
    cut = "regexp_replace(html, '(<title>|<h1>)[^<]*', '\\1Words &amp;&amp; it&#39;s &#39 &lt so &amp;&amp', 'g')"
    duckdb.sql(f"copy (select page_id, url, {cut} as html from '/root/testdata/sf0.001/pages.parquet' order by page_id limit 64) to '{at}/pages.parquet'")
    return str(at)


@pytest.mark.parametrize("name", QUERIES)
def test_unclosed_references_are_text(spark, cut_pages, name):
    df = registry.queries()[name](spark, cut_pages)
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{cut_pages}/pages.parquet'")
    rel = con.sql(registry.oracle_sql()[name])
    order = [list(rel.columns).index(c) for c in df.columns]
    want = sorted(tuple(plain(r[i]) for i in order) for r in rel.fetchall())
    assert want and sorted(tuple(plain(v) for v in r) for r in df.collect()) == want
