import itertools
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from quire.llm import toxicity as t

INSULTS = ["idiot", "worthless", "clown", "stupid"]


def sentences(n, seed):
    rng = np.random.default_rng(seed)
    syllables = ["an", "the", "re", "ou", "ing", "sta", "er", "on", "wha", "ti"]
    out = []
    for i in range(n):
        words = ["".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(12)]
        if i % 2:
            words[int(rng.integers(12))] = INSULTS[i // 2 % 4]
        out.append((i, " ".join(words), i % 2))
    return out


def direct(x, y):
    """The kernel by its definition."""
    total = 0.0
    for (i, j, k), (a, b, c) in itertools.product(t.triples(len(x)), t.triples(len(y))):
        if (x[i], x[j], x[k]) == (y[a], y[b], y[c]):
            total += t.DECAY ** (k - i + c - a)
    return total / t.norm(len(x)) / t.norm(len(y))


def test_kernel_and_its_collapse():
    words, marks = ["idiot", "idixot", "cat", "a"], ["idiot", "clown"]
    k = t.kernel(words, marks)
    codes = lambda w: list(t.letters([w])[0])
    assert np.allclose(k, [[direct(codes(w), codes(m)) for m in marks] for w in words])
    table = t.collapse(marks, np.array([2.0, -1.0]))
    assert np.allclose(t.table_scores(words, table), k @ [2.0, -1.0], atol=1e-5)
    assert k[1, 0] > 0.4 > k[2, 0]


def test_held_out_sentences(spark):
    rows = sentences(600, 1)
    docs = spark.createDataFrame([(i, x, "label") for i, x, _ in rows], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    out = {r.doc_id: r for r in t.score(docs, labels).collect()}
    held = [(out[i].predicted, y) for i, _, y in rows if out[i].held_out]
    assert len(held) > 60 and np.mean([p == y for p, y in held]) > 0.97
    kept = t.clean(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in out.items() if r.predicted == 0}


def test_spellings():
    rows = sentences(600, 2)
    s = t.Scorer(t.fit([x for _, x, _ in rows], np.array([bool(y) for *_, y in rows])))
    assert (s.scores(["an i.d.i.o.t here", "i d i o t", "what a cloown", "STUPID!"]) > 0.5).all()
    assert (s.scores(["", "the ring", "x" * 5000]) < 0.5).all()


def test_no_labels_nulls_and_rows_alike(spark):
    docs = spark.createDataFrame([(1, None), (1, None), (None, "a"), (2, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None), (1, 1)], "doc_id long, toxic int")
    out = t.score(docs, labels).collect()
    assert len(out) == 4 and all(r.score == 0 and r.predicted == 0 for r in out)
    assert t.score(docs.filter(F.lit(False)), labels).collect() == []


def test_kernel_values_are_made_in_small_blocks():
    rng = np.random.default_rng(5)
    words = ["".join(map(chr, rng.integers(97, 123, 20))) for _ in range(600)]
    tracemalloc.start()
    t.kernel(words, words[:160])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80e6  # 1 MB of results, 30 MB of the landmarks' triples, and a block's
