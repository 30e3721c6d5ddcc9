from pyspark.sql import functions as F

from quire.operators import body


def test_a_page_of_many_paragraphs_is_whole(spark):
    pages = spark.range(1).select(F.repeat(F.lit("<p>a</p>"), 60_000).alias("html"))
    assert pages.select(F.size(body.paragraphs(F.col("html"))).alias("n")).first().n == 60_000
