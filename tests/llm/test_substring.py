import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quire.llm import substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, size):
    """rows: (doc_id, text), unique ids."""
    words = {i: WORD.findall(t or "") for i, t in rows}
    seen, out = set(), {}
    for i in sorted(words):
        w, gone = words[i], set()
        for s in range(len(w) - size + 1):
            key = tuple(w[s : s + size])
            if key in seen:
                gone.update(range(s, s + size))
            seen.add(key)
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def run(docs, **more):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.digest(substring.remove_repeats(docs, **more)).collect()}


def test_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert run(docs.repartition(5).withColumn("n_words", F.lit(1))) == brute(rows, 20)


def test_random_small_alphabet_and_odd_texts(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 40)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "x " * 5000), (203, "x " * 25), (204, " ".join(f"é{i}" for i in range(30))), (205, "\n".join(f"é{i}" for i in range(30))), (-5, "x " * 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    for size in (8, 20):
        assert run(docs, window=size) == brute(rows, size)
    assert run(docs, window=8, group_rows=1, map_bits=18) == brute(rows, 8)
    assert run(docs, window=10, group_rows=5, task_rows=50) == brute(rows, 10)


def test_prefixes_are_lengthened_until_their_groups_fit():
    h = np.repeat(np.arange(1, 41, dtype=np.uint64), 1)
    start = np.arange(20)
    short = substring.prefix_keys(h, start, 20, [])
    longer = substring.prefix_keys(h, start, 20, [np.sort(short[:3])])
    assert (longer[3:] == short[3:]).all() and not np.isin(longer[:3], short).any()
    longest = substring.prefix_keys(h, start, 20, [np.sort(short[:3]), np.sort(longer[:1])])
    assert longest[0] not in (longer[0], short[0]) and (longest[1:] == longer[1:]).all()


def test_depths_are_common_prefixes():
    h = np.array([1, 2, 3, 4, 5, 6, 7, 8, 9, 1, 2, 3, 4, 5, 6, 7, 8, 0], np.uint64)
    h = substring.mix(h)
    columns = substring.letters(h, np.array([0, 9, 1]), 8)
    order = substring.by_letters(columns, np.array([0, 9, 1], np.uint64))
    assert sorted(substring.depths(columns[:, order], 8).tolist()) == [0, 0, 8]
    assert sorted(substring.depths(substring.letters(h, np.array([0, 9]), 9), 9).tolist()) == [0, 8]


def test_rows_alike(spark):
    t = " ".join(map(str, range(40)))
    docs = spark.createDataFrame([(1, t), (1, t), (1, t + " z"), (None, t)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_removed) for r in substring.remove_repeats(docs).collect())
    assert got in ([(0, 40), (1, 0), (1, 0), (1, 40)], [(0, 40), (1, 0), (1, 40), (1, 40)])
    assert substring.remove_repeats(docs.filter("doc_id > 5")).collect() == []


def test_rows_alike_in_one_task(spark):
    t, u = " ".join(map(str, range(40))), " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, t), (1, t), (2, t), (3, u), (3, u), (3, u)], "doc_id long, text string").coalesce(1)
    got = sorted((r.doc_id, r.n_removed) for r in substring.remove_repeats(docs).collect())
    assert got == [(1, 0), (1, 0), (2, 40), (3, 0), (3, 0), (3, 0)]


def test_cover():
    assert substring.covered(6, np.array([1, 2]), 3).tolist() == [False, True, True, True, True, False]


def suffix_batches(texts, bits):
    batch = pa.RecordBatch.from_pydict({"_id": np.arange(len(texts)), "text": texts, "_key": np.arange(len(texts)) * 7})
    every = np.full(1 << 15, 255, np.uint8)  # a bitmap that lets all suffixes through
    return list(substring.suffixes(iter([batch]), 20, bits, 18, every, []))


def test_work_of_a_flush_does_not_grow_with_the_ranges():
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(400)) for _ in range(40)]
    texts += [texts[0], texts[1] + " and more", "short"]
    found = set()
    for bits in (6, 12, 20, 30):
        batches = suffix_batches(texts, bits)
        total = sum(int(np.sum(b.column("n").to_numpy())) for b in batches)
        assert len(batches) < 10 and total == (400 - 19) * 42 + 2
        rows = pa.Table.from_batches(batches).sort_by([("bucket", "ascending"), ("packed", "ascending"), ("known", "ascending")]).to_batches(max_chunksize=1000)
        got = [r for b in substring.trees(iter(rows), 20) for r in b.to_pylist()]
        found.add(tuple(sorted((r["_id"], r["_key"], int(s)) for r in got for s in np.frombuffer(r["starts"], np.int32))))
    assert found == {tuple((i, i * 7, s) for i in (40, 41) for s in range(381))}


def test_rows_of_ranges_are_read_back_whole():
    rng = np.random.default_rng(4)
    bucket = np.sort(rng.integers(0, 9, 3000) ** 3).astype(np.int32)
    doc, pos, columns = rng.integers(0, 50, 3000), rng.integers(0, 1000, 3000), rng.integers(0, 2**63, (3, 3000)).astype(np.uint64)
    order = np.lexsort((pos, doc, bucket))
    doc, pos, columns = doc[order], pos[order], columns[:, order]
    ids, keys = np.arange(50) * 3, np.arange(50) * -5
    for least in (1, 300, 10**6):
        out = []
        for b in substring.range_rows(False, bucket, doc, pos, columns, ids, keys, least):
            for at, (i, k, d, p, known, c) in substring.range_parts(b, 20):
                assert not known.any()
                out += zip([at] * len(d), i[d].tolist(), k[d].tolist(), p.tolist(), *c.tolist(), strict=True)
        want = sorted(zip(bucket.tolist(), ids[doc].tolist(), keys[doc].tolist(), pos.tolist(), *columns.tolist(), strict=True))
        assert sorted(out) == want
