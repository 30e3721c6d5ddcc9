import hashlib

import pytest
from tokenizers import Tokenizer

from quire.llm import bpe
from quire.llm.queries import tokenizer_path

ODD = [
    (1, None),
    (2, ""),
    (3, "Hello<|endoftext|>World <|startoftext|>x"),
    (4, "ΑΣ ΟΔΟΣ İstanbul it's we'LL a\x1cb\x85c   é ﬁ Ǆ １２ ½ 日本語 😀😀 힣 \x00 ~~!!\x7f"),
    (5, "a" * 3000),
    (6, "<|endoftext|"),
    (7, "ſ K Å"),
    (7, "ſ K Å"),
    (None, "x y"),
]


def expected(rows):
    t = Tokenizer.from_file(tokenizer_path())
    t.no_padding()
    t.no_truncation()
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        said = " ".join(map(str, ids)), t.decode(ids, skip_special_tokens=False)
        yield (i, len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in said))


def test_equals_the_library(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = spark.createDataFrame(ODD, docs.schema).unionByName(docs)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = bpe.digest(docs.withColumn("ids", docs.doc_id), tokenizer_path())
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, expected(rows)))


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED_WORDS", 4)
    v = bpe.Vocabulary(open(tokenizer_path(), encoding="utf-8").read())
    text = " ".join(f"word{i % 7} it's {i}" for i in range(40))
    t = Tokenizer.from_file(tokenizer_path())
    assert list(memoryview(v.encode(text.encode())).cast("i")) == t.encode(text, add_special_tokens=False).ids


def test_stored_ids_decode_alike(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id < 30")
    both = bpe.encode(docs, tokenizer_path(), decoded=True)
    again = bpe.decode(bpe.encode(docs, tokenizer_path()), tokenizer_path())
    assert sorted(both.collect()) == sorted(again.collect())


def test_empty_table(spark):
    assert bpe.digest(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path()).collect() == []


@pytest.mark.parametrize("pair", [b"zq", b"qz"])
def test_a_forced_cut_is_in_no_token(pair):
    v = bpe.Vocabulary(open(tokenizer_path(), encoding="utf-8").read())
    inside = any(pair.decode() in t.removesuffix(v.suffix) for t in v.vocab)
    assert v.cut[pair[0], pair[1]] == (not inside)
