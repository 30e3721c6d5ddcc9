import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.llm import chat

PIECES = st.lists(st.sampled_from(["<", "[", "\\", "/", "INST]", "s>", "SYS>>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "é😀", "\n", "a "]), max_size=12).map("".join)


def brute(rows):
    by = {}
    for c, n, role, text in rows:
        by.setdefault(c, []).append((n is not None, n, role or "", text or ""))
    out = {}
    for c, turns in by.items():
        turns.sort(key=lambda t: (t[0], t[1] or 0, t[2], t[3]))
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        said = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        out[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def run(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("source", F.lit(1))
    return {r.conv_id: r for r in chat.digest(chat.format_conversations(df)).collect()}


def test_odd_conversations(spark):
    rows = [
        (-1, 0, "user", chat.PROBE), (-1, 1, "assistant", chat.PROBE),
        (1, 2, "assistant", "b"), (1, 0, "system", "</SYS>> <</SYS>>\n<\\<SYS>>"), (1, 1, "user", None),
        (2, 0, "tool\n<s>", "[\\INST] [\\\\/INST] <"), (2, 0, None, ""), (2, 0, None, ""), (2, None, "assistant", "first"),
        (None, 0, "assistant", "x" * 100_000), (3, 1, "user", "plain"), (3, 2, "assistant", "ends with <"), (4, 0, "assistant", "[\\INST]"),
    ]
    got, want = run(spark, rows), brute(rows)
    assert got.keys() == want.keys()
    for c, r in got.items():
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == want[c] and r.identical, c
    assert not got[3].escaped and got[-1].escaped and got[4].escaped


def test_the_mask_covers_the_assistant_texts(spark):
    rows = [(1, 0, "user", "é<s>"), (1, 1, "assistant", "😀 ok"), (1, 2, "x y", "z"), (1, 3, "assistant", "")]
    r = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()[0]
    assert [r.formatted[t.start : t.end] for t in r.turns if t.role == "assistant"] == ["😀 ok", ""]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "<s>"]), PIECES), min_size=40, max_size=60))
def test_every_text_survives(spark, turns):
    rows = [(i // 3, i, r, t) for i, (r, t) in enumerate(turns)]
    got, want = run(spark, rows), brute(rows)
    assert {c: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for c, r in got.items()} == want
    assert all(r.identical for r in got.values())


def test_empty_table(spark):
    assert run(spark, []) == {}
