import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, targets, keep, rounds=200):
    """rows: (doc_id, source, lang, topic, words) by plain dictionaries: the probability of every cell."""
    cells = Counter()
    for _, *cell, n in rows:
        cells[tuple(cell)] += n
    total = sum(cells.values())
    w = {c: n / total for c, n in cells.items()}
    wants = []
    for k, m in enumerate(mixing.MARGINALS):
        have = defaultdict(float)
        for c, n in cells.items():
            have[c[k]] += n
        wants.append(mixing.shares(pd.Series(have), targets[m]).to_dict())
    for _ in range(rounds):
        for k in range(3):
            now = defaultdict(float)
            for c in w:
                now[c[k]] += w[c]
            w = {c: w[c] * wants[k][c[k]] / now[c[k]] if now[c[k]] else w[c] for c in w}
    factor = {c: w[c] * total / n if n else 1.0 for c, n in cells.items()}
    low, high = 0.0, 1e9
    for _ in range(300):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(n * min(1, mid * factor[c]) for c, n in cells.items()) < keep * total else (low, mid)
    return {c: min(1.0, high * factor[c]) for c in cells}


@pytest.mark.parametrize("most_cells", [100_000, 3])
def test_equals_brute_force(spark, most_cells, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    if most_cells == 3:  # in Spark: few cells and rounds
        docs = docs.filter("source in ('src1', 'src2')")
        whole = mixing.probabilities
        monkeypatch.setattr(mixing, "probabilities", lambda *a, **b: whole(*a, rounds=3, **b))
    out = mixing.mix_sources(docs, most_cells=most_cells).collect()
    assert len(out) == docs.count() and all(r._words == len(WORD.findall(r.text)) for r in out)
    want = brute([(r.doc_id, r.source, r.lang, r._topic, r._words) for r in out], mixing.TARGETS, 0.8, 3 if most_cells == 3 else 200)
    assert np.allclose([r._probability for r in out], [want[r.source, r.lang, r._topic] for r in out], rtol=1e-4)
    words = np.array([r._words for r in out])
    assert np.isclose((words * [r._probability for r in out]).sum(), 0.8 * words.sum(), rtol=1e-6)
    assert all(r._sampled or r._probability < 1 for r in out) and not any(r._sampled and r._probability == 0 for r in out)


def test_marginals_fit_the_targets():
    rng = np.random.default_rng(0)
    cells = pd.DataFrame([(s, x, t, int(rng.integers(1, 900))) for s in "abc" for x in ("en", None) for t in range(3)], columns=[*mixing.MARGINALS, "words"])
    w = mixing.rake(cells, {"source": {"a": 0.6, "zz": 0.3}, "lang": {"en": 0.25}, "topic": 0.0}, 300, 1e-12)
    assert np.allclose(pd.Series(w).groupby(cells["topic"]).sum(), 1 / 3) and np.isclose(w[cells["lang"] == "en"].sum(), 0.25)
    assert np.isclose(w[cells["source"] == "a"].sum(), 0.6) and np.isclose(w.sum(), 1)


def test_nulls_empty_texts_and_clashing_names(spark):
    rows = [(1, "a b c ddddd", None, None, "t"), (1, "a b c ddddd", None, None, "t"), (None, None, "s", "en", "u"), (3, "", "s", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, topic string")
    out = mixing.mix_sources(docs).collect()
    assert len(out) == 4 and all(0 <= r._probability <= 1 for r in out)
    assert mixing.sample(docs).columns == docs.columns
    assert mixing.mix_sources(docs.filter(F.lit(False))).collect() == []


def test_topics():
    words, topic = mixing.topics(pa.array(["hello hello world", None, "a b"]))
    assert words.tolist() == [3, 0, 2] and topic[1] == topic[2] == 0 and topic[0] == mixing.topics(pa.array(["HELLO"]))[1][0]
