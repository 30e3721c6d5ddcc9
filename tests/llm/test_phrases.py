import re
from collections import Counter

import duckdb
import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from quire.llm import phrases, queries

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, least=100, longest=5, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOW)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    found = {g: a for g, a in f.items() if len(g[1]) > 1 and a >= least}
    gone = set()
    for (lang, w), a in found.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                if (part := (lang, w[i : i + k])) != (lang, w) and a >= found[part]:
                    gone.add(part)
    out = {}
    for (lang, w), a in found.items():
        if (lang, w) not in gone:
            score, _, left, right = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return {(lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, own in out.items() for i, (s, a, p, left, right) in enumerate(sorted(own)[:top], 1)}


def got(docs, **how):
    return {tuple(r) for r in phrases.collocations(docs, **how).collect()}


def test_equal_to_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.lang, r.text) for r in docs.collect()]
    want = brute(rows)
    assert got(docs) == want and len(want) > 50
    assert got(docs, least=7, top=300, map_bits=12) == brute(rows, 7, 5, 300)  # a bitmap at its bound changes nothing


def test_equal_to_the_statement(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    assert got(spark.read.parquet(f"{sf_dir}/documents.parquet")) == set(con.sql(queries.OP12_PHRASES).fetchall())


def test_edge_cases(spark):
    rows = [("en", "a b\tc d e f, " * 150), ("en", "A B C! " * 60), (None, "x y " * 200), ("und", "x y z. " * 100), ("en", None), ("fr", ""), ("de", "é é é é\vé é " * 120)]
    rows += [("en", "A B C! " * 60), ("xx", "w" * 70_000 + " q"), ("en", "b c,b c;c d:c d!" * 100), ("en", "k\x0b l \x85 m\n" * 150)]
    docs = spark.createDataFrame([(lang, t, "p", 1) for lang, t in rows], "lang string, text string, phrase string, n int").repartition(3)
    assert got(docs) == brute(rows)
    assert got(docs, least=10, top=3) == brute(rows, 10, 5, 3)
    assert got(docs.filter("n > 1")) == set()


@given(st.lists(st.tuples(st.integers(1, 2**62), st.integers(1, 2**62), st.integers(1, 2**62)), min_size=1, max_size=9))
def test_stripes_add_up(rows):
    prefix, following, n = (np.array([r[i] % 5 + 1 for r in rows], np.uint64) for i in range(3))
    want = Counter()
    for p, w, t in zip(prefix.tolist(), following.tolist(), n.tolist(), strict=True):
        want[p, w] += t
    p, w, t = phrases.added(prefix, following, n.astype(np.int64))
    assert dict(zip(zip(p.tolist(), w.tolist(), strict=True), t.tolist(), strict=True)) == want


def test_scores_pass_64_bits(spark):
    rows = [(10**15, 9 * 10**17, 10**15 + 7, 3 * 10**15), (100, 200, 100, 150), (7, 10**15, 11, 13)]
    df = spark.createDataFrame(rows, "a long, n long, l long, r long")
    out = df.select(phrases.quotient(df.a, df.n, df.l, df.r).alias("q")).collect()
    assert [r.q for r in out] == [1000 * a * n // (left * right) for a, n, left, right in rows]
