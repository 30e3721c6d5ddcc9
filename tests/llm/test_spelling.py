import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from quire.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute_words(rows):
    found = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            found[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: n for w, n in found.items() if len(w) >= 6 and n >= 5}


def brute(rows):
    n = brute_words(rows)
    near = {w: set() for w in n}
    holes = {}
    for w in n:
        for v in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            holes.setdefault(v, []).append(w)
    for own in holes.values():
        for a in own:
            near[a] |= {b for b in own if spelling.one_edit(a, b)}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return out


def got(docs):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(docs).collect()}


def test_equal_to_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows)
    assert got(docs) == want and sum(1 for w in want if w[1]) > 10


def test_every_kind_of_edit_at_every_place(spark):
    base = "abcdef"
    words = {base, "abdcef", "aabcdef", "abcdeff", "ébcdef", "abc×def"}
    words |= {base[:i] + c + base[i + k :] for i in range(7) for k in (0, 1) for c in "axzÿ"}
    words |= {"qqqqqq" + "q" * i for i in range(40)} | {"w" * 700, "w" * 701, "w" * 350 + "v" + "w" * 349, "w" * 32, "w" * 33, "w" * 34, "w" * 31 + "v"}
    rows = [(i, f"{w} {w.upper() if w.isascii() else w}\t{w}! {w}1{w}") for i, w in enumerate(sorted(words))]
    rows += [(100 + i, "abcdef " * 40) for i in range(3)] + [(900, "abcdex " * 900), (None, "abcdef"), (None, None), (901, ""), (901, ""), (902, "a" * 90_000)]
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, word string")
    want = brute(rows)
    assert got(docs) == want and {len(w[0]) for w in want} >= {6, 32, 33, 34, 700, 701}
    assert spelling.variants(docs.filter("doc_id < 0")).collect() == []


def test_chains_of_forms_end_at_the_root(spark):
    words = ["aaaaaa", "aaaaab", "aaaabb", "aaabbb", "aabbbb"]
    text = " ".join(f"{w} " * (5 * 6**i) for i, w in enumerate(words))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    out = {r.word: r for r in spelling.variants(docs).collect()}
    assert set(words) <= set(out) and {out[w].root for w in words} == {"aabbbb"} and out["aabbbb"].form is None


@given(st.lists(st.binary(max_size=90), min_size=1, max_size=20), st.binary(max_size=9))
def test_crc32_of_spans(parts, before):
    data = np.frombuffer(b"".join(parts), np.uint8)
    end = np.cumsum([len(p) for p in parts])
    state = np.full(len(parts), zlib.crc32(before), np.uint32)
    assert spelling.crc32(state, data, end - [len(p) for p in parts], end).tolist() == [zlib.crc32(before + p) for p in parts]


@given(st.text("ab", min_size=1, max_size=7), st.text("ab", min_size=1, max_size=7))
def test_one_edit(a, b):
    holes = lambda x: {x[:i] + x[i + 1 :] for i in range(len(x))}
    swaps = {a[:i] + c + a[i + 1 :] for i in range(len(a)) for c in "ab"} - {a}
    assert spelling.one_edit(a, b) == (b in holes(a) or a in holes(b) or b in swaps)
