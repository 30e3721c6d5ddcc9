"""Language-model scores from a log-frequency Bloom filter.

Training documents give counts of words and word pairs. A count c has the level 1 + floor(log2 c); the filter holds an n-gram once
for each level up to its own. Its level is read back by probing level 1, 2, ... until one is missing, which errs upwards
only, and rarely. The filter is cut into hash ranges, each as large as its own counted n-grams ask for (six bits a mark, at
least), so that the error rate stays the same whatever the input. No part is broadcast or reaches the driver: the texts' tokens go
in blocks, each block sends its distinct n-grams with their training counts to the ranges that own them in one packed
shuffle, and a range counts them, builds its part and answers each block with levels, and with exact counts of words.

The model interpolates pair and word estimates: P(w|v) = PAIR * low(vw) / high(v) + (1 - PAIR) * (low(w) + 0.5) / (N + 0.5 (V + 1)),
where low and high are the least and largest count of the level read. As low <= c <= high, the estimates sum to 1 at most.
The base score is exact.

Edge cases: null and empty texts are the end token alone; without training rows N = V = 0; a null doc_id isn't held
out; repeated rows each keep their result and count each; a text longer than a chunk is a chunk of its own and is scored whole; other
columns, whatever their names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common
from .hashing import U, join, mix, pack, unpack, word_hashes, words_of

PAIR, PROBES, MOST_LEVELS = 0.15, 3, 48
END, START = U(0x8A5CD789635D2DFF), U(0x121FD2155C472F97)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, word hash and pair hash of every token: the words and an end for each text."""
    w = words_of(texts, lower=True)
    h = word_hashes(w)
    rows = len(texts)
    token = np.full(len(h) + rows, END, U)
    row = np.empty(len(h) + rows, np.int64)
    at = np.arange(len(h)) + w.row
    token[at], row[at] = h, w.row
    row[w.first[1:] + np.arange(rows)] = np.arange(rows)
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[w.first[:-1] + np.arange(rows)] = START
    return row, token, join(before, token)


def blocks(batches: Iterator[pa.RecordBatch], bits: int, kind: pa.DataType, flush: int = 500_000) -> Iterator[pa.RecordBatch]:
    """Map side: blocks of about `flush` tokens. For each, the texts as places in its sorted distinct words (kind 0), and for each hash range
    the distinct words (kind 1) and pairs (kind 2) with their counts in training texts."""
    held: list[tuple] = []
    number = TaskContext.get().partitionId() << 33

    def emit() -> Iterator[pa.RecordBatch]:
        token, pair, size, out = (np.concatenate([h[i] for h in held]) for i in range(4))
        ids = pa.concat_arrays([h[4] for h in held])
        held.clear()
        train = np.repeat(~out, size)
        words, at = np.unique(token, return_inverse=True)
        one = [pa.array([0], pa.int32()), pa.array([len(words)], pa.int32()), pa.array([pack(words, True)], pa.binary()), pa.array([pack(at.astype(np.int32))], pa.binary())]
        cut = pa.array([0, len(size)], pa.int32())
        lists = [pa.ListArray.from_arrays(cut, a) for a in (ids, pa.array(out), pa.array(size.astype(np.int32)))]
        yield block_rows(pa.array([hash((number >> 33, number)) % (1 << bits)], pa.int32()), pa.array([number]), *one, *lists)
        for n_gram, (keys, place) in enumerate(((words, at), np.unique(pair, return_inverse=True)), 1):
            times = np.bincount(place[train], minlength=len(keys)).astype(np.uint32)
            edge = np.searchsorted(keys >> U(64 - bits), np.arange((1 << bits) + 1, dtype=U))
            live = np.flatnonzero(np.diff(edge))
            spans = [(int(edge[i]), int(edge[i + 1])) for i in live]
            n = len(live)
            columns = [live.astype(np.int32), np.full(n, number), np.full(n, n_gram, np.int32), np.array([hi - lo for lo, hi in spans], np.int32)]
            blobs = [pa.array([f(lo, hi) for lo, hi in spans], pa.binary()) for f in (lambda lo, hi: pack(keys[lo:hi], True), lambda lo, hi: pack(times[lo:hi]))]
            yield block_rows(*map(pa.array, columns), *blobs, *(pa.nulls(n, pa.list_(t)) for t in (kind, pa.bool_(), pa.int32())))

    for chunk in common.chunks(batches):
        row, token, pair = tokens(chunk.column(1))
        size = np.bincount(row, minlength=chunk.num_rows)
        held.append((token, pair_key(pair), size, np.asarray(chunk.column(2).to_numpy(zero_copy_only=False), bool), chunk.column(0).take(pa.array(np.arange(chunk.num_rows)))))  # a copy: a slice would keep the whole batch
        if sum(len(h[0]) for h in held) >= flush:
            yield from emit()
            number += 1
    if held:
        yield from emit()


def block_rows(*columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), ["bucket", "block", "kind", "n", "keys", "times", "ids", "held", "sizes"])


def answers(batches: Iterator[pa.RecordBatch], part_bits: int) -> Iterator[pa.RecordBatch]:
    """The hash ranges of one task, which come sorted, one after the other: texts pass; for each block's n-grams the levels (and
    counts of words) in their order; N and V as kind 3."""
    last, parts = None, []
    for whole in batches:
        types = [f.type for f in whole.schema][6:]
        for at in range(0, whole.num_rows, 64):
            b = whole.slice(at, 64)
            texts = pc.equal(b.column(2), 0)
            if pc.any(texts).as_py():
                yield b.filter(texts)
            rest = b.filter(pc.invert(texts))
            for bucket, block, kind, n, k, t in zip(*(rest.column(i).to_pylist() for i in range(6)), strict=True):
                if bucket != last and parts:
                    yield answered(last, parts, part_bits, types)
                    parts = []
                last = bucket
                parts.append((kind, block, n, k, t))
        del whole, b, rest
    if parts:
        yield answered(last, parts, part_bits, types)


def answered(bucket: int, parts: list[tuple], part_bits: int, types: list[pa.DataType]) -> pa.RecordBatch:
    found = {}
    for kind in (1, 2):
        mine = [p for p in parts if p[0] == kind]
        if mine:
            key, at = np.unique(np.concatenate([unpack(k, n, U, True) for _, _, n, k, _ in mine]), return_inverse=True)
            times = np.concatenate([unpack(t, n, np.uint32) for _, _, n, _, t in mine])
            found[kind] = [p[1:3] for p in mine], key, at.astype(np.int32), np.bincount(at, weights=times, minlength=len(key)).astype(np.int64)
    parts.clear()
    key, count = (np.concatenate([f[i][f[3] > 0] for f in found.values()]) for i in (1, 3))
    bits = part_size(count) + part_bits
    bitmap = filled(key, count, bucket, bits, part_bits)
    out = []
    for kind, (mine, key, at, count) in found.items():
        level = levels(bitmap, key, bits, part_bits, bucket).astype(np.uint8)[at]
        exact = count[at] if kind == 1 else None
        lo = 0
        for block, n in mine:
            out.append((bucket, block, kind, n, pack(level[lo : lo + n]), pack(exact[lo : lo + n]) if kind == 1 else None))
            lo += n
    if 1 in found:
        count = found[1][3]
        # N as the block, V as n.
        out.append((bucket, int(count.sum()), 3, int((count > 0).sum()), None, None))
    columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)]
    return block_rows(*columns, *(pa.nulls(len(out), t) for t in types))


def part_size(count: np.ndarray) -> int:
    """Bits of a place in a part that holds n-grams of these counts: six bits a mark or more."""
    marks = int((1 + np.floor(np.log2(count))).sum()) if len(count) else 0
    return max(6, (6 * marks).bit_length())


def positions(key: np.ndarray, level: int, probe: int, bits: int, part_bits: int) -> np.ndarray:
    """Where an n-gram's level is marked: in the part that the key's top bits name."""
    inside_part = mix(key + U(level * 0x9E3779B97F4A7C15 + probe * 0xC2B2AE3D27D4EB4F & (2**64 - 1))) >> U(64 - (bits - part_bits))
    return (((key >> U(64 - part_bits)) << U(bits - part_bits)) | inside_part).astype(np.int64)


def filled(key: np.ndarray, count: np.ndarray, part: int, bits: int, part_bits: int) -> np.ndarray:
    """One part of the filter as packed bits."""
    size = 1 << (bits - part_bits)
    marks = np.zeros(size, bool)
    level = 1
    while len(key):
        for probe in range(PROBES):
            marks[positions(key, level, probe, bits, part_bits) - part * size] = True
        level += 1
        more = count >= 1 << (level - 1)
        key, count = key[more], count[more]
    return np.packbits(marks)


def levels(bitmap: np.ndarray, key: np.ndarray, bits: int, part_bits: int, part: int = 0) -> np.ndarray:
    """The level of each n-gram by repeated membership probes; 0: not held. The bitmap begins with the given part."""
    out, live = np.zeros(len(key), np.int64), np.arange(len(key))
    begin = part << (bits - part_bits)
    for level in range(1, MOST_LEVELS):
        for probe in range(PROBES):
            at = positions(key[live], level, probe, bits, part_bits) - begin
            live = live[(bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0]
        if not len(live):
            break
        out[live] = level
    return out


def pair_key(pair: np.ndarray) -> np.ndarray:
    return mix(pair ^ U(0xD1B54A32D192ED03))


def probabilities(before_level: np.ndarray, level: np.ndarray, both: np.ndarray, total: int, distinct: int) -> np.ndarray:
    low = np.where(level > 0, 2.0 ** (level - 1), 0.0)
    high = 2.0**before_level - 1
    word = (low + 0.5) / (total + 0.5 * (distinct + 1))
    seen = np.where((both > 0) & (high > 0), np.minimum(2.0 ** (both - 1) / np.maximum(high, 1.0), 1.0), 0.0)
    return PAIR * seen + (1 - PAIR) * np.minimum(word, 1.0)


def scored(block: pa.Table, total: int, distinct: int) -> pa.Table:
    """The texts of one block from its row of texts and the answers of all hash ranges."""
    order = np.lexsort((block.column("bucket").to_numpy(), block.column("kind").to_numpy()))
    rows = block.select(["kind", "n", "keys", "times"]).take(pa.array(order))
    _, n, keys, times = (rows.column(i)[0].as_py() for i in range(4))
    held = block.take(pa.array(order[:1]))
    ids, out, size = (held.column(c).combine_chunks().flatten() for c in ("ids", "held", "sizes"))
    size = size.to_numpy().astype(np.int64)
    words, at = unpack(keys, n, U, True), unpack(times, int(size.sum()), np.int32)
    answer = [r for r in rows.slice(1).to_pylist() if r["kind"] in (1, 2)]
    word_level, pair_level = (np.concatenate([unpack(r["keys"], r["n"], np.uint8) for r in answer if r["kind"] == k]).astype(np.int64) for k in (1, 2))
    count = np.concatenate([unpack(r["times"], r["n"], np.int64) for r in answer if r["kind"] == 1])[at]
    # A text's first token follows the start, which stands as often as the end.
    first = np.cumsum(size) - size
    token, level = words[at], word_level[at]
    before, before_level = np.empty_like(token), np.empty_like(level)
    before[1:], before_level[1:] = token[:-1], level[:-1]
    before[first], before_level[first] = START, word_level[np.searchsorted(words, END)]
    _, place = np.unique(pair_key(join(before, token)), return_inverse=True)
    del token, before
    p = probabilities(before_level, level, pair_level[place], total, distinct)
    base = np.add.reduceat(np.log10(count + 0.5), first) - size * np.log10(total + 0.5 * (distinct + 1))
    known = np.add.reduceat((count > 0).astype(np.int64), first)
    columns = [ids, out, size, known, np.full(len(size), total), base, np.add.reduceat(np.log10(p), first)]
    return pa.table(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def score(docs: DataFrame, frequent_words: int = 1 << 17) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text.

    frequent_words has no effect any more: every word meets its exact count in the hash range that owns it.
    """
    spark = docs.sparkSession
    part_bits = common.buckets_for(spark).bit_length() - 1
    rows = common.text_rows(docs, held_out().alias("held_out"))
    kind = rows.schema["doc_id"].dataType
    arrow = to_arrow_type(kind)
    shape = f"bucket int, block bigint, kind int, n int, keys binary, times binary, ids array<{kind.simpleString()}>, held array<boolean>, sizes array<int>"

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return common.tidy(blocks(batches, part_bits, arrow))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return common.tidy(answers(batches, part_bits))

    dealt = rows.mapInArrow(spread, shape).repartition(common.shuffle_partitions(spark), "bucket").sortWithinPartitions("bucket")
    built = common.stage(dealt.mapInArrow(answer, shape), "answers")
    size = built.filter("kind = 3").agg(F.coalesce(F.sum("block"), F.lit(0)).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("v")).first()
    total, distinct = int(size["n"]), int(size["v"])

    def finish(block: pa.Table) -> pa.Table:
        return scored(block, total, distinct)

    result = f"doc_id {kind.simpleString()}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return built.filter("kind < 3").groupBy("block").applyInArrow(finish, result)
