import numpy as np
from pyspark.sql import functions as F

from quire.llm import quality, ranking

SF = "/root/testdata/sf0.1"


def test_held_out_rows_are_told_apart(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    out = ranking.score(docs, labels).filter("held_out").join(labels.filter("quality is not null"), "doc_id").toPandas()
    good, bad = out[out.quality == 1], out[out.quality == 0]
    assert len(bad) > 100 and (bad.predicted == 0).mean() > 0.97 and (good.predicted == 1).mean() > 0.99
    rank = out.score.rank()
    area = (rank[out.quality == 1].sum() - len(good) * (len(good) + 1) / 2) / len(good) / len(bad)
    assert area > 0.995


def test_labels_of_the_held_out_fold_change_nothing(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(ranking.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, other = ({r.doc_id: r.score for r in ranking.score(docs, t).collect()} for t in (labels, turned))
    assert one == other


def test_newton_finds_the_weights_of_known_preferences():
    rng = np.random.default_rng(1)
    a, b, true = rng.normal(size=(20_000, 3)), rng.normal(size=(20_000, 3)), np.array([1.0, -2.0, 0.0])
    wins = rng.random(20_000) < 1 / (1 + np.exp(-(a - b) @ true))
    top, low, n = np.where(wins[:, None], a, b), np.where(wins[:, None], b, a), np.arange(20_000)
    assert np.abs(ranking.learn(top, low, n, n) - true).max() < 0.1


def test_every_row_is_in_pairs_and_ties_share_a_side():
    win, lose = ranking.pairs(5, 3, 4, 0)
    assert np.bincount(win, minlength=5).min() >= 4 and np.bincount(lose, minlength=3).min() >= 4
    assert ranking.threshold(np.array([0.0, 0, 1, 1]), np.array([False, False, True, True])) == 0.5
    assert ranking.threshold(np.array([1.0, 1, 1]), np.array([True, False, True])) == 1.0


def test_edge_cases(spark):
    good, bad = "A plain sentence of words. " * 3, "w### x%%% y&&& " * 5
    rows = [(i, good + "word " * (i % 7) if i % 2 else bad + "z### " * (i % 5)) for i in range(200)]
    odd = [(1001, None), (1001, ""), (None, "x"), (1002, good), (1002, good), (1003, "w " * 400_000), (1004, "q" * 200_000)]
    docs = spark.createDataFrame([(i, t, "s", 9) for i, t in rows + odd], "doc_id long, text string, quality string, features int")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows] + [(0, 0), (3, None), (None, 1)], "doc_id long, quality int")
    out = ranking.score(docs, labels).collect()
    assert len(out) == len(rows) + len(odd) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    assert all(r.predicted == r.doc_id % 2 for r in out if r.doc_id is not None and r.doc_id < 200)
    assert len({r.score for r in out if r.doc_id == 1001}) == 1 and len({r.score for r in out if r.doc_id == 1002}) == 1
    assert {(r.score, r.predicted) for r in ranking.score(docs, labels.filter("quality = 1")).collect()} == {(0.5, 1)}
    assert ranking.score(docs.filter("doc_id < 0"), labels).collect() == []
    assert len(ranking.score(docs, labels.filter("doc_id < 0")).collect()) == len(out)


def test_the_model_comes_from_all_rows(spark):
    rng = np.random.default_rng(3)
    x, good = np.round(rng.normal(size=(12_000, len(quality.FEATURES))), 2), rng.random(12_000) < 0.5
    x[good] += 0.5
    rows = spark.createDataFrame([(i, f, g) for i, (f, g) in enumerate(zip(x.tolist(), good.tolist(), strict=True))], "doc_id long, features array<double>, good boolean")
    assert all(np.allclose(a, b) for a, b in zip(ranking.exact_knots(rows, 8), ranking.knots_of(x, 8), strict=True))
    scored = spark.createDataFrame(list(zip(x[:, 0].tolist(), good.tolist(), strict=True)), "score double, good boolean")
    assert ranking.best_threshold(scored) == ranking.threshold(x[:, 0], good)
    pairs = ranking.preferences(rows, 4).toPandas()
    win, lose = (np.array(pairs[k].tolist()) for k in ("win", "lose"))
    assert len(pairs) == 48_000 and {tuple(f) for f in win} == {tuple(f) for f in x[good]} and {tuple(f) for f in lose} == {tuple(f) for f in x[~good]}  # 4,096 of each kind before
    knots, n = ranking.knots_of(x, 3), np.arange(len(win))
    stored = spark.createDataFrame(pairs)
    assert np.allclose(ranking.learned(stored, knots), ranking.learn(ranking.hinges(win, knots), ranking.hinges(lose, knots), n, n), atol=1e-6)
