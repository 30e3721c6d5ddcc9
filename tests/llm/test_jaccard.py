import random
import re
import time

import numpy as np
from pyspark.sql import functions as F

from quire.llm import common, graph, jaccard

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, k, percent):
    """rows: (doc_id, text) by number; size and least reachable doc_id of each."""
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        shared = {}
        for x in s:
            for j in holders[x]:
                if j > i:
                    shared[j] = shared.get(j, 0) + 1
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                parent[root(j)] = root(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows))


def run(docs, **more):
    return sorted(map(tuple, jaccard.digest(jaccard.classes(docs, **more)).collect()))


def test_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert run(docs.repartition(3).withColumn("n_shingles", F.lit(1))) == brute(rows, 4, 85)


def test_edited_copies_of_all_sizes_and_odd_texts(spark, monkeypatch):
    rng = random.Random(5)
    rows, texts = [], []
    for n in [*range(1, 30), 40, 60, 90, 150, 300]:
        base = [f"w{rng.randrange(400)}" for _ in range(n)]
        for edits in range(6):
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(len(w))] = f"x{rng.randrange(9)}"
            texts.append(" ".join(w[: len(w) - edits % 2]))
    rows = [(1000 - i, t) for i, t in enumerate(texts)] + [(0, None), (1, ""), (2, "A b"), (3, "a\tB"), (3, "a b"), (4, "é" * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    monkeypatch.setattr(jaccard, "CELL", 3)
    assert run(docs) == brute(rows, 4, 85)
    assert run(docs, words=5, percent=80) == brute(rows, 5, 80)


def test_deduplicate(spark):
    t = " ".join(map(str, range(50)))
    rows = [(5, t, "a"), (2, t + " z", "b"), (2, t + " z", "b"), (9, "other text", "c"), (7, None, "d"), (7, None, "d"), (8, "", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    got = jaccard.deduplicate(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id, r.key) for r in got.collect()) == [(2, "b"), (7, "d"), (7, "d"), (8, "e"), (9, "c")]
    assert run(docs.filter("doc_id > 99").select("doc_id", "text")) == []


def test_bound_is_never_below_the_overlap():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 2**63, 60).astype(np.uint64) * np.uint64(2)) for _ in range(40)]
    sets += [np.unique(np.concatenate([s[:57], rng.integers(0, 2**63, 2).astype(np.uint64)])) for s in sets[:20]]
    got = {frozenset(p) for p in jaccard.links(sets, 80)}
    assert got == {frozenset((i, 40 + i)) for i in range(20)}


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(400 + i, 401 + i) for i in range(40)]
    parent = {x: x for p in pairs for x in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    want = sorted((x, root(x)) for p in [set(p) for p in pairs if p[0] != p[1]] for x in p)
    got = graph.components(spark.createDataFrame(pairs, "a long, b long"))
    assert sorted(map(tuple, got.collect())) == sorted(set(want))


def test_disk_is_given_back(spark, tmp_path, monkeypatch):
    """Staged writes leave no shuffle files, and the signatures and sets, which are as large as the texts, are gone at the end."""
    files = lambda: {f for f in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}
    monkeypatch.setattr(common, "shared_folder", lambda _: str(tmp_path))
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(i, f"{text} {i}" if i % 2 else f"{i} other {i} words {i} here {i}") for i in range(40)], "doc_id long, text string")
    out = common.stage(jaccard.deduplicate(docs), "out")
    left = {p.name for p in tmp_path.glob("*/*")}
    assert out.count() == 21 and not left & {"index", "points"} and {"rows", "members", "out"} <= left
    before = files()
    common.stage(docs.repartition(3), "dealt")
    until = time.time() + 20
    while files() - before and time.time() < until:  # Spark deletes them in the background
        time.sleep(0.2)
    assert files() <= before and spark.conf.get(common.FREES, None) in (None, "false")
