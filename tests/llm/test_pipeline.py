"""Each stage of the pipeline on its own input, against brute force."""

import hashlib

import corpus_pipeline
from pyspark.sql import functions as F
from quire.llm import mixing, pii, toxicity

from .test_bpe import expected
from .test_jaccard import brute as linked
from .test_pii import CARD, EMAIL, IP, PHONE, luhn


def personal(text):
    yield from EMAIL.finditer(text)
    yield from (m for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split(".")))
    yield from (m for m in CARD.finditer(text) if luhn("".join(filter(str.isdigit, m[0]))))
    yield from (m for m in PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15)


def test_stages(spark, tmp_path):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, rows, names = docs.columns, {r.doc_id: r for r in docs.collect()}, [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "pii", "mixing", "bpe"]
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, docs, sf_dir)
        assert name == "bpe" or out.columns == columns
        out.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        got = {r.doc_id: r for r in out.collect()}
        if name == "toxicity":
            labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
            want = {r.doc_id for r in toxicity.score(docs, labels).collect() if r.predicted == 0}
            toxic = {r.doc_id for r in labels.filter("toxic = 1").collect()}
            assert got.keys() == want and len(toxic & want) <= 0.5 * len(toxic)  # some forty toxic rows to learn from
        elif name == "near_duplicates":
            want = {c for _, _, c in linked([(i, r.text) for i, r in rows.items()], 5, 80)}
            assert got.keys() == want and 0 < len(want) < len(rows)
        elif name == "pii":
            assert got.keys() == rows.keys()
            for i, r in rows.items():
                found = list(personal(r.text))
                assert (got[i].text == r.text) == (not found), i
                assert not any(m[0] in got[i].text for m in found if len(m[0]) > 6), i
        elif name == "mixing":
            drawn = {r.doc_id for r in mixing.mix_sources(docs).collect() if r._sampled}
            assert got.keys() == drawn and 0.5 * len(rows) < len(drawn) < len(rows)
        else:
            want = {i: (n, a, b) for i, n, a, b in expected([(i, r.text) for i, r in rows.items()])}
            digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
            assert {i: (len(r.ids), digest(" ".join(map(str, r.ids))), digest(r.decoded)) for i, r in got.items()} == want
            continue
        for r in got.values():
            assert name == "pii" or r == rows[r.doc_id]
        docs, rows = out, got


def test_kinds_of_spans():
    assert pii.KINDS == ("email", "ip", "card", "phone")


def test_stages_with_odd_rows_and_clashing_names(spark, tmp_path):
    words = " ".join(f"w{i}" for i in range(300))
    rows = [(1, words, None, "s"), (1, words, None, "s"), (2, None, "en", None), (None, "", "en", "s"), (3, words.replace("w", "v ") * 200, "fr", "t"), (4, "a@b.co and " + words[:50], "en", "t")]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text"))
    odd = plain
    for name in ("_key", "_row", "_topic", "_words", "pii_spans", "key", "full", "row", "toxic"):
        odd = odd.withColumn(name, F.lit(name))
    labels = spark.createDataFrame([(1, None, 0), (4, 1, None)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (odd, odd.filter("doc_id > 99")):
        for name, step in corpus_pipeline.STAGES[:-1]:
            before = docs.count()
            docs = corpus_pipeline.stage(step(spark, docs, str(tmp_path)), name)
            assert docs.columns == odd.columns
            assert all(r[c] == c for r in docs.collect() for c in ("_key", "_row", "_topic", "_words", "pii_spans", "key", "full", "row", "toxic"))
            assert docs.count() == before - (name == "near_duplicates" and before > 0) or name == "mixing"
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()
