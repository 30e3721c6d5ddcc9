"""Substring removal by prefix-partitioned suffix trees.

The suffixes of the corpus are its word positions with at least `window` words after them in their document. They are read in letters of
LETTER words. Suffixes are split by prefixes of variable length: one letter, and as long as a prefix holds more suffixes than
`group_rows`, another one. Groups of one prefix are packed by hash into ranges, and ranges into tasks of about `task_rows` suffixes, as counted, so the
memory of a task doesn't depend on the input. In a range the suffixes are sorted by their letters; the common prefixes of neighbours in
that order are the tree, whose internal nodes that lie `window` words deep or more hold what repeats. Every suffix below such a node but
the first (least doc_id, then least position) starts a repeat. The tree is cut at that depth, as all below repeats, however it goes on;
chained starts give the maximal repeats, whose words go.

Suffixes that can't repeat give no leaf: equal windows have the same anchor, the 6-word run of least hash, and a bitmap of
fixed size tells the anchors that occur once (a false hit only costs work). A task sends on only the first of the suffixes that it
holds under one deep node; it knows the others to be repeats. So a passage that a third of all documents hold costs one row a task.

Edge cases: null and empty texts have no words; rows alike in doc_id and text count as one document and share its result;
rows that share only doc_id are told apart by a hash of the text; a null doc_id comes last; a text longer than a chunk is read alone and
whole; other columns, whatever their names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .hashing import U, group_starts, inside, mix, pack, unpack, windows, word_hashes, words_of

ANCHOR, WINDOW, LETTER = 6, 20, 4
#: Suffixes that a task must hold of a range to pack them by themselves.
PACKED = 512
#: Suffixes in one Arrow batch of rows that aren't packed.
BATCH = 1 << 15
_POSITION = (1 << 26) - 1  # low bits of a sort key that hold a word's position in its chunk


def anchors(h: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the windows inside one row, the hash of each one's anchor, and the anchor's position."""
    start = np.flatnonzero(inside(row, size))
    if not len(start):
        return start, np.zeros(0, U), start
    grams = windows(h, ANCHOR)
    low = (grams & ~U(_POSITION)) | (np.arange(len(grams), dtype=U) & U(_POSITION))
    span, reach = 1, size - ANCHOR + 1
    while 2 * span <= reach:
        low, span = np.minimum(low[: len(low) - span], low[span:]), span * 2
    rest = reach - span
    low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
    base = start & ~_POSITION
    at = base + (low[start] & U(_POSITION)).astype(np.int64)
    at += np.where(at < start, _POSITION + 1, 0)
    return start, mix(grams[at]), at


def once_or_more(batches: Iterator[pa.RecordBatch], size: int, bits: int, flush: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Map side of the anchor counts: for each hash range, the distinct anchors and how often each was seen."""
    held: list[np.ndarray] = []

    def emit() -> Iterator[pa.RecordBatch]:
        keys = np.sort(np.concatenate(held))
        held.clear()
        first = group_starts(keys)
        times = np.diff(np.append(first, len(keys)))
        keys = keys[first]
        yield dealt(keys, np.minimum(times, 2**31 - 1).astype(np.int32), bits)

    for chunk in common.chunks(batches):
        w = words_of(chunk.column(1))
        _, key, at = anchors(word_hashes(w), w.row, size)
        if len(at):
            new = np.ones(len(at), bool)
            new[1:] = at[1:] != at[:-1]
            held.append(key[new])
        if sum(map(len, held)) >= flush:
            yield from emit()
    if held:
        yield from emit()


def dealt(keys: np.ndarray, times: np.ndarray, bits: int) -> pa.RecordBatch:
    """Sorted keys with counts as one packed row for each range of `bits` top bits."""
    cut = np.searchsorted(keys >> U(64 - bits), np.arange((1 << bits) + 1, dtype=U))
    live = np.flatnonzero(np.diff(cut))
    spans = [(int(cut[i]), int(cut[i + 1])) for i in live]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(live.astype(np.int32)),
            pa.array([b - a for a, b in spans], pa.int32()),
            pa.array([pack(keys[a:b], True) for a, b in spans], pa.binary()),
            pa.array([pack(times[a:b]) for a, b in spans], pa.binary()),
        ],
        ["bucket", "n", "keys", "times"],
    )


DEALT = "bucket int, n int, keys binary, times binary"


def merged(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """All dealt rows of a task added up: sorted keys, total counts."""
    keys, times = [np.zeros(0, U)], [np.zeros(0, np.int64)]
    for b in batches:
        for n, k, t in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            keys.append(unpack(k, n, U, True))
            times.append(unpack(t, n, np.int32).astype(np.int64))
    key, time = np.concatenate(keys), np.concatenate(times)
    order = np.argsort(key, kind="stable")
    key, time = key[order], time[order]
    first = group_starts(key)
    return key[first], np.add.reduceat(time, first) if len(first) else time


def count_bitmap(dealt_rows: DataFrame, bits: int, map_bits: int, more_than: int, heavy_from: int) -> tuple[np.ndarray, np.ndarray]:
    """A bitmap (2**map_bits bits, the size limit of what reaches the driver) of the keys counted more than `more_than` times, and
    the keys counted more than heavy_from times (fewer than all occurrences / heavy_from)."""
    spark = dealt_rows.sparkSession

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, time = merged(batches)
        heavy = key[time > heavy_from]
        key = key[time > more_than]
        part = key >> U(64 - bits)
        for i in np.unique(part):
            at = (key[part == i] >> U(64 - map_bits)) & U((1 << (map_bits - bits)) - 1)
            bitmap = np.zeros(1 << (map_bits - bits), bool)
            bitmap[at.astype(np.int64)] = True
            own = heavy[heavy >> U(64 - bits) == i]
            packed = pa.Codec("zstd").compress(pa.py_buffer(np.packbits(bitmap)), asbytes=True)
            yield pa.RecordBatch.from_arrays([pa.array([int(i)], pa.int32()), pa.array([packed], pa.binary()), pa.array([own.tobytes()], pa.binary())], ["part", "bitmap", "heavy"])

    # Staged, so that the counts, which are large, leave the disk at once.
    parts = common.stage(dealt_rows.repartition(common.shuffle_partitions(spark), "bucket").mapInArrow(reduce, "part int, bitmap binary, heavy binary"), "bitmap")
    whole, heavy, step = np.zeros(1 << (map_bits - 3), np.uint8), [], 1 << (map_bits - bits - 3)
    for r in parts.toLocalIterator():
        whole[r.part * step : (r.part + 1) * step] = np.frombuffer(pa.Codec("zstd").decompress(bytes(r.bitmap), decompressed_size=step, asbytes=True), np.uint8)
        heavy.append(np.frombuffer(bytes(r.heavy), U))
    return whole, np.sort(np.concatenate(heavy)) if heavy else np.zeros(0, U)


def in_bitmap(bitmap: np.ndarray, key: np.ndarray, map_bits: int) -> np.ndarray:
    at = (key >> U(64 - map_bits)).astype(np.int64)
    return (bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0


def letters(h: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """The first `size` words after each start as letters of 32 bits, two to a column (columns, starts)."""
    one = windows(h, LETTER) >> U(32)
    last = windows(h, size % LETTER) >> U(32) if size % LETTER else None
    out = [one[start + k] for k in range(0, size - LETTER + 1, LETTER)] + ([last[start + size - size % LETTER]] if last is not None else [])
    out += [np.zeros(len(start), U)] * (len(out) % 2)
    return np.stack([(a << U(32)) | b for a, b in zip(out[::2], out[1::2], strict=True)])


def letter_columns(size: int) -> int:
    return -(-(-(-size // LETTER)) // 2)


def by_letters(columns: np.ndarray, place: np.ndarray) -> np.ndarray:
    return np.lexsort((place, *columns[::-1]))


def depths(columns: np.ndarray, size: int) -> np.ndarray:
    """Of sorted suffixes: how many words each has in common with the one before it (0 for the first), counted in letters, `size` at most."""
    depth = np.zeros(columns.shape[1], np.int64)
    live = np.ones(max(0, len(depth) - 1), bool)
    for c in columns:
        for shift in (U(32), U(0)):
            half = (c >> shift) & U(0xFFFFFFFF)
            live &= half[1:] == half[:-1]
            depth[1:] += LETTER * live
    return np.minimum(depth, size)


def prefix_keys(h: np.ndarray, start: np.ndarray, size: int, long: list[np.ndarray]) -> np.ndarray:
    """The hash of each suffix's prefix: a letter, and one more as long as the prefix is one of the sorted long ones of its length."""
    key = windows(h, min(LETTER, size))[start]
    live = np.arange(len(start))
    for k, over in enumerate(long, 2):
        at = np.minimum(np.searchsorted(over, key[live]), len(over) - 1) if len(over) else live
        live = live[over[at] == key[live]] if len(over) else live[:0]
        if not len(live):
            break
        key[live] = mix(windows(h, min(k * LETTER, size))[start[live]] + U(k))
    return key


def live_suffixes(batches: Iterator[pa.RecordBatch], size: int, map_bits: int, bitmap: np.ndarray):
    """Chunks with their words, word hashes and the starts of suffixes that may repeat."""
    for chunk in common.chunks(batches):
        w = words_of(chunk.column(1))
        h = word_hashes(w)
        start, anchor, _ = anchors(h, w.row, size)
        yield chunk, w, h, start[in_bitmap(bitmap, anchor, map_bits)]


def prefix_counts(batches: Iterator[pa.RecordBatch], size: int, bits: int, map_bits: int, bitmap: np.ndarray, long: list[np.ndarray], flush: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Map side of the prefix counts: for each hash range, the distinct prefixes and how many suffixes each holds."""
    held: list[np.ndarray] = []

    def emit() -> pa.RecordBatch:
        keys = np.sort(np.concatenate(held))
        held.clear()
        first = group_starts(keys)
        return dealt(keys[first], np.diff(np.append(first, len(keys))).astype(np.int32), bits)

    for _, _, h, start in live_suffixes(batches, size, map_bits, bitmap):
        if len(start):
            held.append(prefix_keys(h, start, size, long))
        if sum(map(len, held)) >= flush:
            yield emit()
    if held:
        yield emit()


def long_prefixes(counts: DataFrame, more_than: int) -> tuple[np.ndarray, int]:
    """The prefixes of more suffixes than that (fewer than all suffixes / more_than), and the number of all suffixes."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, time = merged(batches)
        yield pa.RecordBatch.from_arrays([pa.array([key[time > more_than].tobytes()], pa.binary()), pa.array([int(time.sum())])], ["long", "n"])

    got = counts.repartition(common.shuffle_partitions(counts.sparkSession), "bucket").mapInArrow(lambda b: common.tidy(reduce(b)), "long binary, n bigint").collect()
    return np.sort(np.concatenate([np.zeros(0, U), *(np.frombuffer(bytes(r.long), U) for r in got)])), sum(r.n for r in got)


def suffixes(batches: Iterator[pa.RecordBatch], size: int, bits: int, map_bits: int, bitmap: np.ndarray, long: list[np.ndarray], flush: int = 1_200_000) -> Iterator[pa.RecordBatch]:
    """Map side of the trees: for each range of prefixes, the first suffix under every deep node that the task holds; and for each document the
    starts of those known to repeat. Rows: bucket, documents (id, key), and packed document number, position, letters."""
    held: list[tuple[np.ndarray, ...]] = []
    ids: list[np.ndarray] = []
    keys: list[np.ndarray] = []

    def emit() -> Iterator[pa.RecordBatch]:
        prefix, columns, doc, pos = (np.concatenate(c, axis=-1) for c in zip(*held, strict=True))
        all_ids, all_keys = np.concatenate(ids), np.concatenate(keys)
        for a in (held, ids, keys):
            a.clear()
        by = np.lexsort((all_keys, all_ids))
        fresh = np.zeros(len(by), bool)
        fresh[group_starts(all_ids[by], all_keys[by])] = True
        rank = np.empty(len(by), np.int64)
        rank[by] = np.cumsum(fresh) - 1  # rows alike in doc_id and text share one
        place = (rank[doc].astype(U) << U(32)) | pos.astype(U)
        order = by_letters(columns, place)
        prefix, columns, doc, pos, place = (a[..., order] for a in (prefix, columns, doc, pos, place))
        first = depths(columns, size) < size
        head = np.flatnonzero(first)
        # The first one's place again, from a row alike, is no repeat: it shares what becomes of the first.
        repeat = place != np.repeat(place[head], np.diff(np.append(head, len(place))))
        bucket = (prefix >> U(64 - bits)).astype(np.int32)
        for known, chosen in ((False, first), (True, repeat)):
            b, d, p, c = (a[..., chosen] for a in (bucket, doc, pos, columns))
            # Repeats known here go by document, so that their starts stay together.
            b = (d % (1 << bits)).astype(np.int32) if known else b
            order = np.lexsort((p, d, b))
            yield from range_rows(known, *(a[..., order] for a in (b, d, p, c)), all_ids, all_keys)

    docs = 0
    for chunk, w, h, start in live_suffixes(batches, size, map_bits, bitmap):
        if len(start):
            row = w.row[start]
            held.append((prefix_keys(h, start, size, long), letters(h, start, size), row.astype(np.int64) + docs, start - w.first[row]))
        ids.append(np.asarray(chunk.column(0), dtype=np.int64).copy())
        keys.append(np.asarray(chunk.column(2), dtype=np.int64).copy())
        docs += chunk.num_rows
        if sum(len(x[0]) for x in held) >= flush:
            yield from emit()
            docs = 0
    if held:
        yield from emit()


def range_rows(known: bool, bucket: np.ndarray, doc: np.ndarray, pos: np.ndarray, columns: np.ndarray, all_ids: np.ndarray, all_keys: np.ndarray, least: int = PACKED) -> Iterator[pa.RecordBatch]:
    """One row for each range of suffixes sorted by range, document and position. Ranges of `least` suffixes or more are packed one by one; all
    smaller ones are laid out at once, so the work is that of the suffixes however many ranges there are."""
    cut = np.append(group_starts(bucket), len(bucket))
    sizes = np.diff(cut)
    head = group_starts(bucket, doc)
    number = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(doc))))
    first = np.searchsorted(head, cut)  # the first document of each range
    number -= np.repeat(first[:-1], sizes)
    ids, keys, docs = all_ids[doc[head]], all_keys[doc[head]], np.diff(first)
    number, pos = number.astype(np.int32), pos.astype(np.int32)
    large = np.flatnonzero(sizes >= least)
    for at in range(0, len(large), 256):
        some = large[at : at + 256]
        spans = [(slice(cut[i], cut[i + 1]), slice(first[i], first[i + 1])) for i in some.tolist()]
        blobs = (
            [pack(ids[d]) for _, d in spans], [pack(keys[d]) for _, d in spans], [pack(number[r], True) for r, _ in spans],
            [pack(pos[r]) for r, _ in spans], [b"" if known else pack(columns[:, r].reshape(-1)) for r, _ in spans],
        )
        yield row_batch(bucket[cut[some]], True, known, sizes[some], docs[some], [pa.array(x, pa.binary()) for x in blobs])
    small = sizes < least
    if small.any():
        at, who, n, d = np.repeat(small, sizes), np.repeat(small, docs), sizes[small], docs[small]
        letter = np.zeros((0, len(columns)), U) if known else np.ascontiguousarray(columns[:, at].T)
        data = [(ids[who], d), (keys[who], d), (number[at], n), (pos[at], n), (letter, 0 * n if known else n)]
        rows = row_batch(bucket[cut[:-1][small]], False, known, n, d, [laid_out(x, of) for x, of in data])
        step = np.append(group_starts(np.cumsum(n) // BATCH), len(n)).tolist()
        for lo, hi in zip(step[:-1], step[1:], strict=True):
            yield rows.slice(lo, hi - lo)


def laid_out(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Values as one array of bytes for each run of the given sizes."""
    ends = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes * values[:1].nbytes, out=ends[1:])
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])


def row_batch(bucket: np.ndarray, packed: bool, known: bool, n: np.ndarray, docs: np.ndarray, blobs: list[pa.Array]) -> pa.RecordBatch:
    flags = [pa.array(np.full(len(bucket), x)) for x in (packed, known)]
    names = ["bucket", "packed", "known", "n", "docs", "ids", "keys", "doc", "pos", "letters"]
    return pa.RecordBatch.from_arrays([pa.array(bucket), *flags, pa.array(n.astype(np.int32)), pa.array(docs.astype(np.int32)), *blobs], names)


def solid(col: pa.Array, kind: type) -> np.ndarray:
    """The bytes of all rows of a column of binaries as one array."""
    if not len(col):
        return np.zeros(0, kind)
    col = col.cast(pa.binary())
    ends = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].copy().view(kind) if data is not None else np.zeros(0, kind)


Part = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def range_parts(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, Part]]:
    """The rows of range_rows, sorted by range: bucket, and ids, keys, documents (places in ids), positions, known and letters. Rows that aren't
    packed are read a run at a time."""
    wide = letter_columns(size)
    bucket, packed, known, n, docs = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
    if not len(bucket):
        return
    cut = group_starts(bucket, packed.astype(np.int8), known.astype(np.int8))
    cut = np.append(cut, len(bucket)).tolist()
    for lo, hi in zip(cut[:-1], cut[1:], strict=True):
        if not packed[lo]:
            ids, keys, doc, pos, letter = (solid(batch.column(i).slice(lo, hi - lo), k) for i, k in zip(range(5, 10), (np.int64, np.int64, np.int32, np.int32, U), strict=True))
            before = np.cumsum(docs[lo:hi], dtype=np.int64) - docs[lo:hi]
            yield int(bucket[lo]), (ids, keys, doc + np.repeat(before, n[lo:hi]), pos.astype(np.int64), np.full(len(pos), known[lo]), letter.reshape(-1, wide).T)
            continue
        for r in range(lo, hi):
            ids, keys, doc, pos, letter = (batch.column(i)[r].as_py() for i in range(5, 10))
            m, d = int(n[r]), int(docs[r])
            yield (
                int(bucket[r]),
                (
                    unpack(ids, d, np.int64), unpack(keys, d, np.int64), unpack(doc, m, np.int32, True).astype(np.int64), unpack(pos, m, np.int32).astype(np.int64),
                    np.full(m, known[r]), np.zeros((wide, 0), U) if known[r] else unpack(letter, m * wide, U).reshape(wide, m),
                ),
            )


SUFFIXES = "bucket int, packed boolean, known boolean, n int, docs int, ids binary, keys binary, doc binary, pos binary, letters binary"


def trees(batches: Iterator[pa.RecordBatch], size: int, flush: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The ranges of one task, which come sorted, one tree after the other. Rows: document, packed starts of repeats."""
    last, parts, held = None, [], []

    def emit() -> Iterator[pa.RecordBatch]:
        ids, keys, starts = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.lexsort((starts, keys, ids))
        ids, keys, starts = ids[order], keys[order], starts[order]
        cut = np.append(group_starts(ids, keys), len(ids))
        for lo in range(0, len(cut) - 1, 4096):
            spans = list(zip(cut[lo : lo + 4096].tolist(), cut[lo + 1 : lo + 4097].tolist(), strict=False))
            who = cut[lo : lo + len(spans)]
            yield pa.RecordBatch.from_arrays([pa.array(ids[who]), pa.array(keys[who]), pa.array([starts[a:b].tobytes() for a, b in spans], pa.binary())], ["_id", "_key", "starts"])

    for whole in batches:
        for bucket, part in range_parts(whole, size):
            if bucket != last and parts:
                held.append(tree(parts, size))
                parts = []
                if sum(len(x[2]) for x in held) >= flush:
                    yield from emit()
            last = bucket
            parts.append(part)
    if parts:
        held.append(tree(parts, size))
    if held:
        yield from emit()


def tree(parts: list[Part], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one range: doc_id, key and start of every repeat."""
    ids, keys, docs, poss, certain, columns = zip(*parts, strict=True)
    before = np.cumsum([0, *map(len, ids[:-1])])
    all_ids, all_keys, pos, sure = (np.concatenate(x) for x in (ids, keys, poss, certain))
    doc = np.concatenate([d + b for d, b in zip(docs, before.tolist(), strict=True)])
    order = np.lexsort((all_keys, all_ids))
    fresh = np.zeros(len(order), bool)
    fresh[group_starts(all_ids[order], all_keys[order])] = True
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(fresh) - 1
    all_ids, all_keys, doc = all_ids[order][fresh], all_keys[order][fresh], rank[doc]
    place = (doc.astype(U) << U(32)) | pos.astype(U)
    leaf, column = place[~sure], np.concatenate(columns, axis=1)
    by = by_letters(column, leaf)
    leaf = leaf[by]
    head = np.flatnonzero(depths(column[:, by], size) < size)
    lead = np.repeat(leaf[head], np.diff(np.append(head, len(leaf))))  # rows alike in doc_id and text meet here as one place
    hit = np.unique(np.concatenate([place[sure], leaf[leaf != lead]]))
    owner = (hit >> U(32)).astype(np.int64)
    return all_ids[owner], all_keys[owner], (hit & U(0xFFFFFFFF)).astype(np.int32)


def covered(n: int, starts: np.ndarray, size: int) -> np.ndarray:
    """Which of n words some repeated window covers."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + size, n), -1)
    return np.cumsum(edge[:n]) > 0


def remove_repeats(docs: DataFrame, window: int = WINDOW, map_bits: int = 27, group_rows: int = 1 << 18, task_rows: int = 1 << 21) -> DataFrame:
    """doc_id, n_words, n_removed, kept (text: the kept words joined by one space), repeats (array of first, end: maximal
    runs of removed words). window: at least ANCHOR words.

    map_bits sets the bitmap of repeated anchors, 16 MB by default whatever the input.
    """
    spark = docs.sparkSession
    bits = max(6, (common.shuffle_partitions(spark) - 1).bit_length())
    last = F.lit(2**63 - 1)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), last).alias("_id"), text.alias("text"), F.xxhash64(text).alias("_key"))
    counts = rows.mapInArrow(lambda batches: common.tidy(once_or_more(batches, window, bits)), DEALT)
    sent = spark.sparkContext.broadcast(count_bitmap(counts, bits, map_bits, 1, 1 << 62)[0])
    long: list[np.ndarray] = []
    total = 0
    # Prefixes are lengthened until each holds group_rows suffixes at most, or is a whole window.
    for _ in range(-(-window // LETTER)):
        now = list(long)
        over, total = long_prefixes(rows.mapInArrow(lambda batches, now=now: common.tidy(prefix_counts(batches, window, bits, map_bits, sent.value, now)), DEALT), group_rows)
        if not len(over):
            break
        long.append(over)
    known = spark.sparkContext.broadcast(long)
    tasks = max(1, -(-total // task_rows))
    range_bits = max(6, min(30, (total // (2 * group_rows)).bit_length()))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return common.tidy(suffixes(batches, window, range_bits, map_bits, sent.value, known.value))

    dealt_out = rows.mapInArrow(spread, SUFFIXES).repartition(tasks, "bucket").sortWithinPartitions("bucket", "packed", "known")
    starts = dealt_out.mapInArrow(lambda batches: common.tidy(trees(batches, window)), "_id bigint, _key bigint, starts binary")
    marked = starts.groupBy("_id", "_key").agg(F.collect_list("starts").alias("_starts"))
    joined = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), last).alias("_id"), text.alias("text"), F.xxhash64(text).alias("_key")).join(marked, ["_id", "_key"], "left")

    def cut(chunk: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for t, found in zip(chunk.column(1).cast(pa.binary()).to_pylist(), chunk.column(2).to_pylist(), strict=True):
            words = t.split()
            if not found:
                out.append((len(words), 0, b" ".join(words).decode("utf-8", "replace"), []))
                continue
            gone = covered(len(words), np.concatenate([np.frombuffer(f, np.int32) for f in found]).astype(np.int64), window)
            edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
            kept = b" ".join([x for x, g in zip(words, gone.tolist(), strict=True) if not g])
            out.append((len(words), int(gone.sum()), kept.decode("utf-8", "replace"), [{"first": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)]))
        n, removed, kept, spans = zip(*out, strict=True)
        kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
        return pa.RecordBatch.from_arrays([chunk.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, kind)], ["doc_id", "n_words", "n_removed", "kept", "repeats"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return common.chunk_rows(batches, cut)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.select("doc_id", "text", "_starts").mapInArrow(run, f"doc_id {kind}, n_words bigint, n_removed bigint, kept string, repeats array<struct<first:int,end:int>>")


def digest(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), F.size("repeats").cast("long").alias("n_repeats"))
