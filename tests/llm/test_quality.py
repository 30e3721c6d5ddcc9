import re

import numpy as np
import pyarrow as pa
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    at = {}
    for i in range(len(words) - 7):
        at.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {k for v in at.values() if len(v) > 1 for i in v for k in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_counts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    odd = [None, "", "\n\n \n", "a b c d e f g h " * 3, "é😀 | # x y\n|\n|\n", "w" * 50_000, "x " * 30_000]
    docs = docs.unionByName(spark.createDataFrame([(-i, t) for i, t in enumerate(odd, 1)], docs.schema))
    want = {r.doc_id: brute(r.text or "") for r in docs.collect()}
    got = {r.doc_id: tuple(r[k] for k in quality.COUNTS) for r in quality.statistics(docs.withColumn("features", F.lit(1))).collect()}
    assert got == want


@given(st.lists(st.text(alphabet="ab \n\t|é", max_size=80), min_size=1, max_size=5))
def test_any_text(texts):
    m = quality.measure(pa.array(texts))
    assert [tuple(int(m[k][i]) for k in quality.COUNTS) for i in range(len(texts))] == [brute(t) for t in texts]


def test_the_forest_finds_bad_rows_that_pass_the_base_rules(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    measured = quality.judge(docs, labels).filter("not base_failed").filter(~quality.calibrating())  # labels that the threshold has not seen
    out = measured.join(labels, "doc_id").select("quality", "kept").toPandas()
    good, bad = out[out.quality == 1], out[out.quality == 0]
    assert len(bad) > 50 and bad.kept.mean() < 0.1 and good.kept.mean() > 0.97


def test_without_labels_only_base_rules_drop(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, " ".join(f"w{i}" for i in range(40))), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None)], "doc_id long, quality int")
    assert sorted((r.doc_id, r.kept) for r in quality.judge(docs, labels).collect()) == [(1, False), (2, False), (2, True)]
    assert quality.judge(docs.filter("doc_id > 9"), labels).collect() == []


def test_outliers_are_isolated_sooner():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 3))
    forest = quality.grow(x, 50, 128, 1)
    assert quality.anomaly(forest, np.array([[9.0, 9, 9]]))[0] > quality.anomaly(forest, x).mean() + 0.1


def test_threshold_and_draws_come_from_all_rows(spark):
    rng = np.random.default_rng(2)
    score, good = np.round(rng.random(30_000), 4), rng.random(30_000) < 0.5
    score[good] /= 2
    rows = spark.createDataFrame(list(zip(score.tolist(), good.tolist(), strict=True)), "score double, good boolean")
    assert quality.calibrated(rows, 0.3) == quality.calibrate(score, good, 0.3)
    assert quality.calibrated(rows.filter("good"), 0.3) == quality.calibrated(rows.limit(0), 0.3) == 1.0
    wide = spark.range(30_000).select(F.col("id").alias("doc_id"), F.array_repeat(F.col("id").cast("double"), len(quality.FEATURES)).alias("features"))
    found = quality.draws(wide, 200, 256)
    assert [x.shape for x in found] == [(256, len(quality.ISOLATED))] * 200
    assert len(np.unique(np.concatenate(found)[:, 0])) > 20_000  # of 30,000; at most 8,192 before
    assert [len(x) for x in quality.draws(wide.limit(5), 3, 256)] == [5] * 3
