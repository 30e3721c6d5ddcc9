"""Sources and catalog operators."""

from pyspark.sql import functions as F

from quire.functions import urls
from quire.operators import catalog as ops

from .registry import query
from .views import CATALOG, catalog, table, with_views

JOBS = """jobs AS (SELECT ord AS job_id, novel_slug, CASE WHEN ord % 7 = 0 THEN 'profile_q' ELSE adapter_key END AS adapter_key, CASE WHEN ord % 2 = 0 THEN true END AS use_browser FROM catalog_v WHERE ord > 0 OR ord = -2)"""


def jobs(spark, sf_dir):
    """One job for each catalog row, some with an unknown key and some with an override."""
    c = catalog(spark, sf_dir).filter("ord > 0 or ord = -2")
    return c.select(F.col("ord").alias("job_id"), "novel_slug", F.when(F.col("ord") % 7 == 0, "profile_q").otherwise(F.col("adapter_key")).alias("adapter_key"), F.when(F.col("ord") % 2 == 0, True).alias("use_browser"))


@query("SELECT page_id, url, length(html) AS n_chars FROM pages WHERE html IS NOT NULL")
def page_archive_scan(spark, sf_dir):
    return table(spark, sf_dir, "pages").filter("html is not null").select("page_id", "url", F.length("html").cast("long").alias("n_chars"))


@query("SELECT page_id, substr(sha256(url), 1, 24) || '.html' AS cache_key FROM pages")
def url_cache_key(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.cache_key(F.col("url")).alias("cache_key"))


@query(with_views(CATALOG) + "SELECT * FROM catalog_v")
def catalog_scan(spark, sf_dir):
    return catalog(spark, sf_dir).orderBy("ord")


@query(with_views(CATALOG) + "SELECT novel_slug, min(ord) AS first_ord FROM catalog_v GROUP BY 1")
def catalog_distinct_works(spark, sf_dir):
    return ops.distinct_works(catalog(spark, sf_dir)).orderBy("first_ord")


@query(with_views(CATALOG) + "SELECT ord, adapter_key, host, enabled FROM catalog_v WHERE novel_slug = 'w2'")
def catalog_sites_for_work(spark, sf_dir):
    return ops.sites_for_work(catalog(spark, sf_dir), "w2").select("ord", "adapter_key", "host", "enabled")


@query(with_views(CATALOG) + "SELECT ord, adapter_key, host FROM catalog_v WHERE novel_slug = 'w2' AND enabled")
def catalog_enabled_sites(spark, sf_dir):
    return ops.sites_for_work(catalog(spark, sf_dir), "w2", enabled_only=True).select("ord", "adapter_key", "host")


@query(with_views(CATALOG, JOBS) + "SELECT j.job_id, c.ord, c.url FROM jobs j JOIN catalog_v c USING (novel_slug, adapter_key)")
def catalog_point_lookup(spark, sf_dir):
    return ops.lookup(jobs(spark, sf_dir).drop("use_browser"), catalog(spark, sf_dir)).select("job_id", "ord", "url")


@query(
    with_views(CATALOG, JOBS)
    + """SELECT job_id, j.novel_slug, j.adapter_key, coalesce(k.known, '') AS known_keys FROM jobs j LEFT JOIN (SELECT novel_slug, string_agg(DISTINCT adapter_key, ', ' ORDER BY adapter_key) AS known FROM catalog_v GROUP BY 1) k USING (novel_slug)
WHERE NOT EXISTS (SELECT 1 FROM catalog_v c WHERE c.novel_slug = j.novel_slug AND c.adapter_key = j.adapter_key)"""
)
def unknown_reference_report(spark, sf_dir):
    return ops.unknown_references(jobs(spark, sf_dir), catalog(spark, sf_dir)).select("job_id", "novel_slug", "adapter_key", "known_keys")


@query(with_views(CATALOG, JOBS) + "SELECT job_id, CASE WHEN bool_or(c.enabled) THEN 'accepted' ELSE 'refused: disabled' END AS status FROM jobs j JOIN catalog_v c USING (novel_slug, adapter_key) GROUP BY 1")
def disabled_site_guard(spark, sf_dir):
    return ops.guarded(jobs(spark, sf_dir), catalog(spark, sf_dir)).select("job_id", "status")


@query(with_views(CATALOG) + "SELECT novel_slug, adapter_key, count(*) AS n FROM catalog_v GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_key_check(spark, sf_dir):
    return ops.duplicate_keys(catalog(spark, sf_dir), "novel_slug", "adapter_key")


@query(with_views(CATALOG, JOBS) + "SELECT job_id, ord, coalesce(j.use_browser, c.use_browser) AS use_browser FROM jobs j JOIN catalog_v c USING (novel_slug, adapter_key)")
def job_override_projection(spark, sf_dir):
    return ops.overridden(jobs(spark, sf_dir), catalog(spark, sf_dir)).select("job_id", "ord", "use_browser")
