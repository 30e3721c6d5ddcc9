"""Collocations by stripes: for each phrase, a counter of the words that follow it.

Words are counted for each language first. Then, for phrases of one word, two, up to one less than the longest: every task counts, for
each frequent phrase (prefix) that its texts hold, the words that follow it and under REST all occurrences that no longer frequent
phrase can go on from (at the end of a piece, or before an infrequent rest). These stripes are merged elementwise by hash range. A
merged stripe gives the counts of the phrases one word longer, the prefix's own total, and its largest count, which tells whether a longer
phrase subsumes the prefix. A stripe is cut in SEGMENTS by the hash of the next word, so that one of a very frequent prefix, which holds a
large part of all words, lies in several ranges; totals and maxima of segments are added up afterwards.

Only prefixes that are frequent are counted, as a longer phrase is never more frequent than its parts. A bitmap tells them; it has
sixteen bits a frequent phrase up to `map_bits`. A false hit, more often if the bitmap is at its bound, only makes rows that fall away, as
frequencies are exact and rows of infrequent prefixes meet no phrase.

A phrase keeps the counts of its first and last words, as those of all shorter parts are known when it is built, so every cut
is scored without a search. Scores are whole numbers by division in steps that no product of 38 digits leaves.

Edge cases: a null or empty text has no words; a null lang counts as `und`, together with a lang of that name; repeated rows count each; equal
scores, counts and cuts are told apart as documented at best(); texts and words are read whole, whatever their length; an empty table gives no
rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .hashing import LOWER, U, bytes_of, group_starts, join, mix, pack, spans, unpack, word_hashes

#: Fixed values of the contract: what ends a piece, what parts words.
ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
SEGMENTS, REST = 16, U(0)


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_END = _class(ENDS)
_SOLID = ~_class(ENDS + BLANKS)


def tokens(chunk: pa.RecordBatch) -> tuple:
    """Of the words of a chunk of lang and text: their spans, ids (of word and language) and whether the next one is of the same piece."""
    data, at = bytes_of(chunk.column(1))
    data = LOWER[data]
    w = spans(data, at, _SOLID[data])
    lang = np.array([zlib.crc32(x.encode()) << 32 ^ zlib.adler32(x.encode()) for x in chunk.column(0).to_pylist()], dtype=U)
    ids = mix(word_hashes(w) ^ mix(lang)[w.row]) | U(1)  # never REST
    ended = np.cumsum(_END[data], dtype=np.int64)[w.start] if len(w.start) else np.zeros(0, np.int64)
    same = (w.row[1:] == w.row[:-1]) & (ended[1:] == ended[:-1])
    return w, ids, same


def word_counts(batches: Iterator[pa.RecordBatch], flush: int = 400_000) -> Iterator[pa.RecordBatch]:
    """lang, id, word, n of about `flush` words at a time, and the number of all words of each lang under a null word."""
    held: dict[str, list] = {}
    size = 0

    def emit() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            key, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[2] for p in parts])
            words = pa.concat_arrays([p[1] for p in parts])
            order = np.argsort(key, kind="stable")
            first = group_starts(key[order])
            n = np.add.reduceat(n[order], first)
            words = pa.concat_arrays([words.take(pa.array(order[first])), pa.nulls(1, pa.string())])
            ids = np.append(key[order[first]], REST).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words)), pa.array(ids), words, pa.array(np.append(n, n.sum()))], ["lang", "id", "word", "n"])
        held.clear()

    for chunk in common.chunks(batches):
        w, ids, _ = tokens(chunk)
        if not len(ids):
            continue
        raw, langs = w.data.tobytes(), chunk.column(0).to_pylist()
        order = np.argsort(ids, kind="stable")
        first = group_starts(ids[order])
        rep, n = order[first], np.diff(np.append(first, len(order)))
        own = np.array([hash(x) for x in langs])[w.row[rep]]
        for lang in sorted(set(langs)):
            mine = np.flatnonzero(own == hash(lang))
            if len(mine):
                words = [raw[a:b] for a, b in zip(w.start[rep[mine]].tolist(), w.end[rep[mine]].tolist(), strict=True)]
                held.setdefault(lang, []).append((ids[rep[mine]], pa.array(words, pa.binary()).cast(pa.string()), n[mine]))
        size += len(ids)
        if size >= flush:
            yield from emit()
            size = 0
    yield from emit()


def in_bits(bitmap: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether the bits of a bitmap of 64-bit cells hold the keys."""
    place = key >> U(64 - (len(bitmap) * 64 - 1).bit_length())
    return (bitmap[(place >> U(6)).astype(np.int64)] >> (place & U(63))) & U(1) > 0


def bitmap_of(phrases: DataFrame, n: int, map_bits: int) -> np.ndarray:
    """A bitmap of the n ids of phrases: sixteen bits each, 2**map_bits at most. That many bits are also all that reach the driver."""
    bits = min(map_bits, max(12, (16 * n).bit_length()))
    place = F.call_function("shiftrightunsigned", F.col("id"), F.lit(64 - bits))
    cell, one = F.shiftrightunsigned(place, 6).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))
    out = np.zeros(1 << (bits - 6), U)
    found = phrases.groupBy(cell.alias("cell")).agg(F.bit_or(one).alias("mask")).toPandas()
    out[found["cell"].to_numpy()] = found["mask"].to_numpy(np.int64).view(U)
    return out


def stripes(batches: Iterator[pa.RecordBatch], size: int, bitmap: np.ndarray, bits: int, flush: int = 1_500_000) -> Iterator[pa.RecordBatch]:
    """Map side: stripes of the prefixes of size - 1 words, as sorted (prefix, next word) with counts, in packed rows for each hash range."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def emit() -> Iterator[pa.RecordBatch]:
        prefix, following = (np.concatenate([h[i] for h in held]) for i in (0, 1))
        held.clear()
        prefix, following, n = added(prefix, following, np.ones(len(prefix), np.int64))
        owner = mix(prefix + (following >> U(60)) * U(0x9E3779B97F4A7C15)) >> U(64 - bits)
        order = np.argsort(owner, kind="stable")
        prefix, following, n, owner = prefix[order], following[order], n[order], owner[order]
        at = group_starts(owner)
        cuts = list(zip(at.tolist(), np.append(at[1:], len(owner)).tolist(), strict=True))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(owner[at].astype(np.int64)),
                pa.array([b - a for a, b in cuts], pa.int32()),
                pa.array([pack(prefix[a:b], True) for a, b in cuts], pa.binary()),
                pa.array([pack(following[a:b]) for a, b in cuts], pa.binary()),
                pa.array([pack(n[a:b].astype(np.uint32)) for a, b in cuts], pa.binary()),
            ],
            ["bucket", "n", "prefixes", "words", "times"],
        )

    for chunk in common.chunks(batches):
        _, one, same = tokens(chunk)
        prefix, whole = one, np.ones(len(one), bool)
        for k in range(1, size - 1):
            prefix, whole = join(prefix[:-1], one[k:]), whole[:-1] & same[k - 1 :]
        good = whole & in_bits(bitmap, prefix)
        goes_on = np.zeros(len(good), bool)
        if len(good) > 1:
            # The rest after the first word must be frequent too, and of the same piece.
            goes_on[:-1] = good[:-1] & good[1:] & same[size - 2 : size - 2 + len(good) - 1]
        following = np.zeros(len(good), U)
        at = np.flatnonzero(goes_on)
        following[at] = one[at + size - 1]
        held.append((prefix[good], following[good]))
        if sum(len(h[0]) for h in held) >= flush:
            yield from emit()
    if sum(len(h[0]) for h in held):
        yield from emit()


def added(prefix: np.ndarray, following: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stripes added up elementwise: sorted by prefix and next word, each once, with its sum."""
    order = np.lexsort((following, prefix))
    prefix, following = prefix[order], following[order]
    first = group_starts(prefix, following)
    return prefix[first], following[first], np.add.reduceat(n[order], first) if len(first) else n


def merged(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The hash ranges of one task, which come sorted, one after the other."""
    last, parts = None, []
    for whole in batches:
        for at in range(0, whole.num_rows, 64):
            b = whole.slice(at, 64)
            for bucket, *row in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if bucket != last and parts:
                    yield told(parts, least)
                    parts = []
                last = bucket
                parts.append(row)
    if parts:
        yield told(parts, least)


def told(parts: list, least: int) -> pa.RecordBatch:
    """Of the merged stripes of one range: the frequent phrases (prefix, next word, id, n), and under a null id each stripe segment's
    total and largest count."""
    prefix = np.concatenate([unpack(p, n, U, True) for n, p, _, _ in parts])
    following = np.concatenate([unpack(w, n, U) for n, _, w, _ in parts])
    times = np.concatenate([unpack(t, n, np.uint32) for n, _, _, t in parts]).astype(np.int64)
    parts.clear()
    prefix, following, times = added(prefix, following, times)
    often = np.flatnonzero((times >= least) & (following != REST))
    at = group_starts(prefix)
    total = np.add.reduceat(times, at)
    most = np.maximum.reduceat(np.where(following != REST, times, 0), at)
    ids = pa.concat_arrays([pa.array(join(prefix[often], following[often]).view(np.int64)), pa.nulls(len(at), pa.int64())])
    columns = [np.concatenate([a[often].view(np.int64), b]) for a, b in ((prefix, prefix[at].view(np.int64)), (following, most), (times, total))]
    return pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1]), ids, pa.array(columns[2])], ["prefix", "next", "id", "n"])


def frequent(rows: DataFrame, before: DataFrame, words: DataFrame, size: int, tokens_in_all: int, least: int, map_bits: int) -> tuple[DataFrame, DataFrame]:
    """The frequent phrases of `size` words from those of one less, and of the latter id, total and largest (count of a longer phrase)."""
    spark = rows.sparkSession
    bitmap = spark.sparkContext.broadcast(bitmap_of(before, before.count(), map_bits))
    # Ranges hold about a million words' stripes at most, and four of them or more make a task.
    bits = max(common.buckets_for(spark), tokens_in_all >> 20).bit_length() - 1

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return common.tidy(stripes(batches, size, bitmap.value, bits))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return common.tidy(merged(batches, least))

    packed = rows.mapInArrow(spread, "bucket bigint, n int, prefixes binary, words binary, times binary")
    tasks = max(common.shuffle_partitions(spark), (1 << bits) // 4)
    dealt = packed.repartition(tasks, "bucket").sortWithinPartitions("bucket")
    found = common.stage(dealt.mapInArrow(merge, "prefix bigint, next bigint, id bigint, n bigint"), "stripes")
    totals = found.filter("id is null").groupBy(F.col("prefix").alias("id")).agg(F.sum("n").alias("total"), F.max("next").alias("largest"))
    longer = found.filter("id is not null").withColumnRenamed("n", "a")
    heads = before.select(F.col("id").alias("prefix"), "lang", F.col("phrase").alias("head"), "lefts").join(totals.select(F.col("id").alias("prefix"), "total"), "prefix")
    last = words.select(F.col("id").alias("next"), F.col("phrase").alias("word"))
    made = longer.join(heads, "prefix").join(last, "next").withColumn("phrase", F.concat_ws(" ", "head", "word"))
    tail = F.expr("substring(phrase, instr(phrase, ' ') + 1)")
    tails = before.select("lang", F.col("phrase").alias("tail"), F.col("id").alias("tail_id"), F.col("a").alias("tail_a"), "rights")
    out = made.withColumn("tail", tail).join(tails, ["lang", "tail"]).select(
        "id", "lang", "phrase", "a",
        F.concat("lefts", F.array("total")).alias("lefts"), F.concat("rights", F.array("tail_a")).alias("rights"), "tail_id",
    )
    return common.stage(out, "phrases"), totals


def whole(x: Column) -> Column:
    return x.cast("decimal(38,0)")


def quotient(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 * a * n / (left * right)) by floors of floors: 1000 a = q left + r, then (q n + floor(r n / left)) / right. With a <= left no
    product passes 1000 n or left n, so 38 digits hold it for any 64-bit counts."""
    div = lambda x, y: F.call_function("div", whole(x), whole(y))
    scaled = whole(a) * whole(F.lit(1000))
    q = div(scaled, left)
    r = whole(scaled) - whole(q) * whole(left)
    return div(whole(q) * whole(n) + whole(div(whole(r) * whole(n), left)), right)


def best(found: DataFrame, top: int, parts: int = 64) -> DataFrame:
    """Each lang's first `top` phrases by score and count, both descending, then by phrase in byte order. Hash parts of a lang
    give their first ones before the lang's own order is made, so that order holds parts * top rows at most."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = found.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    first = part.withColumn("_at", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("_at") <= top).drop("_at", "part")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, map_bits: int = 27) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` phrases of 2 to `longest` words of each lang that occur `least` times."""
    common.small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return common.tidy(word_counts(batches))

    counted = rows.mapInArrow(count, "lang string, id bigint, word string, n bigint").groupBy("lang", "word").agg(F.min("id").alias("id"), F.sum("n").alias("a"))
    counted = common.stage(counted.filter((F.col("a") >= least) | F.col("word").isNull()), "words")
    sizes = counted.filter("word is null").select("lang", F.col("a").alias("n"))
    tokens_in_all = int(sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    none = F.expr("cast(array() as array<bigint>)")
    words = counted.filter("word is not null").select("id", "lang", F.col("word").alias("phrase"), "a", none.alias("lefts"), none.alias("rights"), F.lit(None).cast("long").alias("tail_id"))
    before, found = words, []
    for size in range(2, longest + 1):
        phrases, totals = frequent(rows, before, words, size, tokens_in_all, least, map_bits)
        if size > 2:
            found[-1] = judged(found[-1], totals, phrases)
        found.append(phrases)
        before = phrases
    found[-1] = found[-1].drop("tail_id")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    k = F.size("lefts")
    cuts = F.transform(
        F.sequence(F.lit(1), k),
        lambda i: F.struct(
            quotient(F.col("a"), F.col("n"), F.element_at("lefts", i), F.element_at("rights", k + 1 - i)).alias("score"),
            i.alias("k"),
            F.element_at("lefts", i).alias("l"),
            F.element_at("rights", k + 1 - i).alias("r"),
        ),
    )
    scored = every.join(sizes, "lang").withColumn("cut", F.array_min(cuts))
    return best(scored.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score"), top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def judged(phrases: DataFrame, totals: DataFrame, longer: DataFrame) -> DataFrame:
    """The phrases that no longer one subsumes. A longer one has at most their count, and if one of any length has it, so has one
    that is longer by a single word, behind (the stripe's largest count) or in front."""
    front = longer.groupBy(F.col("tail_id").alias("id")).agg(F.max("a").alias("front"))
    known = phrases.drop("tail_id").join(totals.select("id", "largest"), "id", "left").join(front, "id", "left")
    return known.filter(F.greatest(F.coalesce("largest", F.lit(0)), F.coalesce("front", F.lit(0))) < F.col("a")).drop("largest", "front")
