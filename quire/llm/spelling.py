"""Spelling variants by a trie that is walked as a table.

Words are runs of letters of whole texts, counted over all documents. The vocabulary's prefixes are the nodes of a trie, which is a
distributed table of edges (depth, parent, letter, child); an edge also tells which lengths remain below the child, which
letters follow it, and how often the word that ends there occurs. A second trie holds the words read backwards.

States (word, position, node, edits) walk it level by level, each level being one join with the edges of its depth. A state without an edit
stands at the node of the word's own prefix; it may take an edge of another letter in place of its next letter, or before it, and then has
one edit; from there only the word's own letters lead on. States of one edit that reach the end of a word with no letters left make
that word a neighbour. A deleted letter is an inserted one seen from the shorter word, so links go both ways at the end. An
edit lies in the second half of a word, where the forward trie is thin, or else in the first, which the backward trie reads
last. So no state begins near a root, where each word would meet the whole alphabet at every node.

Words over TRIE letters, of which there are few, don't walk: of two with one edit between them, deleting one letter from one or both
leaves equal texts, so the hashes of all such texts are joined and the pairs are verified.

Edge cases: a null or empty text has no words; a null doc_id counts as empty text in the hash that chooses typos; repeated rows
count each; of near words alike in n the least in code-point order is the form; a text or run of any length is read whole; an empty table
gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .hashing import LOWER, U, bytes_of, group_starts, join, mix, spans, word_hashes

#: Fixed values of the contract: a run is misspelt where this divides its hash; bounds of words and forms.
MISSPELT, LEAST_LETTERS, LEAST_TIMES, FORM_TIMES = 199, 6, 5, 5
TRIE = 32
_BASE, _ODD = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = (c >> np.uint32(1)) ^ np.where(c & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return c


_CRC = _crc_table()


def crc32(state: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The crc32 of byte spans that follow texts of the given crc32, letter by letter for all spans at once."""
    out = state.astype(np.uint32)
    size = end - start
    for i in np.flatnonzero(size > 64):
        out[i] = zlib.crc32(data[start[i] : end[i]].tobytes(), int(out[i]))
    short = np.flatnonzero(size <= 64)
    short = short[np.argsort(-size[short], kind="stable")]
    live, c, at = size[short], ~out[short], start[short]
    for p in range(int(live[0]) if len(live) else 0):
        n = int(np.searchsorted(-live, -p, side="left"))
        c[:n] = _CRC[(c[:n] ^ data[at[:n] + p]) & np.uint32(255)] ^ (c[:n] >> np.uint32(8))
    out[short] = ~c
    return out


def letter_runs(data: np.ndarray) -> np.ndarray:
    """Which bytes (of A-Z in lower case) belong to letters: a-z, and U+00C0 to U+00FF, which are all that begin with 0xC3."""
    lead = data == 0xC3
    solid = ((data >= 0x61) & (data <= 0x7A)) | lead
    solid[1:] |= lead[:-1]
    return solid


def counted(chunk: pa.RecordBatch) -> pa.RecordBatch | None:
    """word, n of one chunk of doc_id (as text) and text, with its typos, without words that are too short."""
    data, at = bytes_of(chunk.column(1))
    data = LOWER[data]
    w = spans(data, at, letter_runs(data))
    if not len(w.start):
        return None
    h = word_hashes(w)
    key = join(h, mix(w.row.astype(U)))
    order = np.argsort(key, kind="stable")
    first = group_starts(key[order])
    rep, times = order[first], np.diff(np.append(first, len(order)))
    begun = np.array([zlib.crc32(f"{i or ''}:".encode()) for i in chunk.column(0).to_pylist()], dtype=np.uint32)
    crc = crc32(begun[w.row[rep]], data, w.start[rep], w.end[rep])
    typo = crc % np.uint32(MISSPELT) == 0
    raw = data.tobytes()
    words, n = [], []
    for i, c, t in zip(rep[typo].tolist(), crc[typo].tolist(), times[typo].tolist(), strict=True):
        run = raw[w.start[i] : w.end[i]].decode()
        cut = c % len(run)
        if len(run) > LEAST_LETTERS:
            words.append((run[:cut] + run[cut + 1 :]).encode())
            n.append(t)
    # The same run of several documents of the chunk is one row.
    rep, times = rep[~typo], times[~typo]
    leads = np.concatenate([[0], np.cumsum(data == 0xC3)])
    enough = w.end[rep] - w.start[rep] - (leads[w.end[rep]] - leads[w.start[rep]]) >= LEAST_LETTERS
    rep, times = rep[enough], times[enough]
    if len(rep):
        order = np.argsort(h[rep], kind="stable")
        first = group_starts(h[rep[order]])
        words += [raw[a:b] for a, b in zip(w.start[rep[order[first]]].tolist(), w.end[rep[order[first]]].tolist(), strict=True)]
        n += np.add.reduceat(times[order], first).tolist()
    return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], ["word", "n"])


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n, size (code points) of all words that are long and frequent enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return common.chunk_rows(batches, counted)

    rows = common.text_rows(docs).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")
    words = rows.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return words.filter(F.col("n") >= LEAST_TIMES).withColumn("size", F.length("word"))


def letter(text: str | Column, at: str | Column) -> Column:
    """The letter at a place (from 0); empty past the end."""
    return F.substring(text, F.lit(1) + at, F.lit(1))


def node(back: Column, prefix: Column) -> Column:
    return F.xxhash64(back, prefix)


def bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int"))


def letter_bit(one: Column) -> Column:
    """One of 63 bits for a letter; several letters may share a bit, which only lets more through."""
    return bit(F.pmod(F.ascii(one), F.lit(63)))


def both_ways(words: DataFrame) -> DataFrame:
    """back, spelt (the word as its trie reads it), word, n, size."""
    ways = F.explode(F.array(F.struct(F.lit(False).alias("back"), F.col("word").alias("spelt")), F.struct(F.lit(True).alias("back"), F.reverse("word").alias("spelt"))))
    return words.select(ways.alias("w"), "word", "n", "size").select("w.back", "w.spelt", "word", "n", "size")


def edges(read: DataFrame) -> DataFrame:
    """depth, parent, letter, child, lengths (bit r: a word ends r letters below the child), follows (bits of the letters that
    lead on from it), n (of the word that ends at the child, or null). Only edges below the depth at which states begin."""
    steps = read.select("back", "spelt", "n", "size", F.explode(F.sequence(F.lit(LEAST_LETTERS // 2), F.col("size") - 1)).alias("depth"))
    below = F.col("size") - F.col("depth") - 1
    steps = steps.select(
        "depth",
        node(F.col("back"), F.substring("spelt", F.lit(1), F.col("depth"))).alias("parent"),
        letter("spelt", F.col("depth")).alias("letter"),
        node(F.col("back"), F.substring("spelt", F.lit(1), F.col("depth") + 1)).alias("child"),
        bit(below).alias("lengths"),
        F.when(below > 0, letter_bit(letter("spelt", F.col("depth") + 1))).otherwise(F.lit(0).cast("long")).alias("follows"),
        F.when(below == 0, F.col("n")).alias("n"),
    )
    return steps.groupBy("depth", "parent", "letter").agg(
        F.min("child").alias("child"), F.bit_or("lengths").alias("lengths"), F.bit_or("follows").alias("follows"), F.max("n").alias("n")
    )


def beginning(read: DataFrame, depth: int) -> DataFrame:
    """The states without an edit at this depth, once for each edit that they may make here: replace the next letter or insert one.
    Replaced letters grow, so that each pair comes once; an inserted letter differs from the next, so it has one place."""
    start = F.when(F.col("back"), F.col("size") - F.floor(F.col("size") / 2)).otherwise(F.floor(F.col("size") / 2))
    here = read.filter((F.lit(depth) >= start) & (F.lit(depth) <= F.col("size")) & (F.col("size") <= TRIE))
    edit = F.explode(F.array(F.lit(1), F.lit(0))).alias("skips")
    states = here.select("back", "spelt", "word", "n", "size", node(F.col("back"), F.substring("spelt", F.lit(1), F.lit(depth))).alias("node"), edit)
    return states.filter((F.col("skips") == 0) | (F.col("size") > depth)).select(
        "back", "word", "n", "node", F.lit(0).alias("edits"), F.substring("spelt", F.lit(1), F.lit(depth)).alias("done"), letter("spelt", F.lit(depth)).alias("next"),
        F.substring("spelt", F.lit(depth + 1) + F.col("skips"), F.col("size")).alias("rest"), "skips",
    )


def step(states: DataFrame, own: DataFrame) -> DataFrame:
    """One level: the states that follow an edge, with one edit each; where a word ends, near_n tells how often it occurs."""
    e = own.select("parent", F.col("letter").alias("taken"), "child", "lengths", "follows", F.col("n").alias("near_n"))
    fits = (F.col("edits") == 1) & (F.col("taken") == F.col("next"))
    fits |= (F.col("edits") == 0) & F.when(F.col("skips") == 1, F.col("taken") > F.col("next")).otherwise(F.col("taken") != F.col("next"))
    left = F.length("rest")
    leads = F.col("lengths").bitwiseAND(bit(left)) != 0
    leads &= (left == 0) | (F.col("follows").bitwiseAND(letter_bit(F.substring("rest", 1, 1))) != 0)
    return states.join(e, (F.col("node") == F.col("parent")) & fits & leads).select(
        "back", "word", "n", F.col("child").alias("node"), F.lit(1).alias("edits"), F.concat("done", "taken").alias("done"), F.substring("rest", 1, 1).alias("next"),
        F.substring("rest", F.lit(2), F.greatest(left - 1, F.lit(0))).alias("rest"), F.lit(1).alias("skips"), F.when(left == 0, F.col("near_n")).alias("near_n"),
    )


def walked(words: DataFrame) -> list[DataFrame]:
    """word, n, near, near_n of the pairs that the tries find, a table for each level."""
    read = common.stage(both_ways(words.filter(F.col("size") <= TRIE + 1)), "words")
    own = common.stage(edges(read).sortWithinPartitions("depth"), "edges")
    deepest = read.agg(F.max("size")).first()[0] or 0
    found, on = [], None
    for depth in range(LEAST_LETTERS // 2, deepest):
        states = beginning(read, depth)
        states = states.unionByName(on) if on is not None else states
        made = common.stage(step(states, own.filter(F.col("depth") == depth)), "states")
        ends = made.filter("near_n is not null").withColumn("near", F.when(F.col("back"), F.reverse("done")).otherwise(F.col("done")))
        half = F.floor(F.length("word") / 2)
        # What both tries find is the forward one's: there the edit lies behind the first half.
        again = F.col("back") & (F.substring("word", F.lit(1), half) == F.substring("near", F.lit(1), half))
        found.append(ends.filter(~again).select("word", "n", "near", "near_n"))
        on = made.filter("near_n is null").drop("near_n")
    return found


def rolled(word: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The letters of a word, and hashes of it and of all texts that lack one of its letters (one for each run of equal letters)."""
    x = np.array(list(map(ord, word)), dtype=U) * U(_ODD)
    power = np.multiply.accumulate(np.concatenate([np.ones(1, U), np.full(len(x), _BASE, U)]))
    head = np.concatenate([np.zeros(1, U), np.cumsum(x * power[:-1])])
    tail = head[-1] - head  # of the letters from each place on, at their powers
    inverse = U(pow(_BASE, -1, 1 << 64))
    last = np.append(x[1:] != x[:-1], True)
    at = np.flatnonzero(last)
    return x, np.array([head[-1]]), head[at] + tail[at + 1] * inverse


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one letter is inserted, deleted or replaced."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    p = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[p + 1 :] == b[p + 1 :] if len(a) == len(b) else a[p:] == b[p + 1 :] if len(a) < len(b) else a[p + 1 :] == b[p:]


def long_pairs(words: DataFrame) -> DataFrame:
    """word, n, near, near_n of the pairs of words over TRIE letters, each pair once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for word in b.column(0).to_pylist():
                _, whole, less = rolled(word)
                keys = np.concatenate([whole, less])
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.repeat(len(word) - np.array([0, 1]), [1, len(less)]).astype(np.int32)), pa.array(np.full(len(keys), b_hash(word), np.int64))], ["key", "size", "id"])

    big = words.filter(F.col("size") > TRIE).select("word", "n")
    keys = big.mapInArrow(run, "key bigint, size int, id bigint")
    pairs = keys.alias("a").join(keys.alias("b"), ["key", "size"]).filter("a.id < b.id").select(F.col("a.id").alias("one"), F.col("b.id").alias("two")).distinct()
    ids = big.mapInArrow(numbered, "word string, n bigint, id bigint")
    full = pairs.join(ids.select(F.col("id").alias("one"), "word", "n"), "one").join(ids.select(F.col("id").alias("two"), F.col("word").alias("near"), F.col("n").alias("near_n")), "two")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([one_edit(x, y) for x, y in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)], pa.bool_()))

    return full.select("word", "n", "near", "near_n").mapInArrow(verified, "word string, n bigint, near string, near_n bigint")


def b_hash(word: str) -> int:
    """A 63-bit number for a long word."""
    raw = word.encode()
    return zlib.crc32(raw) << 31 ^ zlib.crc32(raw[::-1])


def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([b_hash(w) for w in b.column(0).to_pylist()], pa.int64())], ["word", "n", "id"])


def neighbours(words: DataFrame) -> DataFrame:
    """word, near, near_n: both ways, each pair of words with one edit between them once."""
    found = [*walked(words), long_pairs(words)]
    one = found[0]
    for more in found[1:]:
        one = one.unionByName(more)
    ways = F.explode(F.array(F.struct("word", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n"))))
    return one.select(ways.alias("w")).select("w.*")


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the end of each chain of forms. A form is FORM_TIMES as frequent, so no chain is longer than 27 words, and five
    doublings reach its end."""
    now = common.stage(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(5):
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = common.stage(now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
    return now


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the vocabulary."""
    words = common.stage(vocabulary(docs), f"vocabulary-{uuid.uuid4().hex}")
    near = neighbours(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    joined = words.join(near, "word", "left").withColumn("form_n", -F.col("best.less"))
    is_form = F.col("form_n") >= FORM_TIMES * F.col("n")
    told = joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, F.col("form_n")).alias("form_n"))
    told = common.stage(told, "forms")
    ends = roots(told.filter("form is not null"))
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
