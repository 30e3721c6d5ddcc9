import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import ann


def brute(ids, x, queries, k):
    out = {}
    for i in queries:
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), float(d[j])) for j in order]
    return out


@pytest.mark.parametrize("table", ["sf0.001", "sf0.1"])
def test_recall(spark, table):
    rows = spark.read.parquet(f"/root/testdata/{table}/embeddings.parquet")
    p = rows.orderBy("vec_id").toPandas()
    ids, x = p.vec_id.to_numpy(), np.array(p.embedding.tolist(), dtype=float)
    want = brute(ids, x, np.flatnonzero(ids % 20 == 0), 10)
    got = {}
    for r in ann.nearest(rows, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got.keys() == want.keys() and all(len(v) == 10 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / (10 * len(want)) >= 0.9
    scores = dict(v for q in want for v in [((q, i), s) for i, s in want[q]])
    assert all(abs(scores[q, i] - s) < 1e-12 for q in got for i, s in got[q] if (q, i) in scores)


def test_odd_vectors_and_ties(spark):
    good = [(i, [1.0, float(i // 3)]) for i in range(9)]
    odd = [(100, None), (101, []), (102, [0.0, 0.0]), (103, [1.0, None]), (104, [float("nan"), 1.0]), (105, [float("inf"), 1.0]), (106, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (0, [1.0, 0.0])]
    rows = spark.createDataFrame(good + odd, "vec_id long, embedding array<double>").withColumn("id", F.lit("x"))
    got = [(r.rank, r.vec_id, r.score) for r in ann.nearest(rows, F.col("vec_id") == 0, k=4).orderBy("rank").collect()]
    assert got == [(1, 1, 0.0), (2, 2, 0.0), (3, 3, 1.0), (4, 4, 1.0)]
    assert len(ann.nearest(rows, F.col("vec_id") == 0, k=20).collect()) == 8
    assert ann.nearest(rows.filter(F.lit(False)), F.lit(True)).collect() == []


def test_blocks_of_a_large_leaf(spark):
    rows = spark.range(600).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), (F.col("id") < 2).cast("double")).alias("embedding"))
    got = [r.vec_id for r in ann.nearest(rows, F.col("vec_id") == 5, k=3, block_rows=50).orderBy("rank").collect()]
    assert got == [2, 3, 4]


def test_repeated_ids_take_one_place(spark):
    rows = [(0, [1.0, 0.0])] + [(1, [1.0, 0.001 * i]) for i in range(1, 13)] * 2 + [(i, [1.0, 0.1 * i]) for i in range(2, 8)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [r.vec_id for r in ann.nearest(docs, F.col("vec_id") == 0, k=5).orderBy("rank").collect()]
    assert got == [1, 2, 3, 4, 5]


def test_recall_beyond_the_last_doubling_of_leaves(spark):
    size = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").selectExpr("size(embedding) as n").first().n
    rng = np.random.default_rng(8)
    x, ids = rng.normal(size=(6000, size)), np.arange(6000)
    rows = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    want = brute(ids, x, np.flatnonzero(ids % 60 == 0), 10)
    got = {}
    for r in ann.nearest(rows, F.col("vec_id") % 60 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = sum(len(got[q] & {i for i, _ in want[q]}) for q in want)
    print("recall", hits / (10 * len(want)))
    assert hits / (10 * len(want)) >= 0.9


def test_parts_and_blocks_change_nothing(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(500, 6)), np.repeat(rng.normal(size=(1, 6)), 300, axis=0)])  # a leaf of copies
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = []
    for more in ({}, {"block_rows": 40, "query_rows": 30}, {"query_rows": 7}):
        out = ann.nearest(rows, F.col("vec_id") % 2 == 0, **more).collect()
        found.append(sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in out))
    assert found[0] == found[1] == found[2] and len(found[0]) == 4000
