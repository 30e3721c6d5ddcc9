"""n-gram Jaccard join by count vectors in packed R-trees, exact.

A document is its set of distinct shingles of `words` consecutive words. Its point counts the shingles in each of 32 groups
of hashes; two sets share at most the sum of their coordinates' minima, and a box of points bounds all points in it
by its upper corner. Within a cell of documents, an R-tree packed by sorting is followed from its root: pairs of nodes, then of points,
whose bound reaches the overlap that the threshold asks for. Survivors are verified on the whole sets.

One tree over all points prunes little, as points of unrelated documents lie close together. So a directory forms
the cells first, without loss: hash ranges cut each set into more blocks than two linked sets can differ in, so they agree in a whole
block. Documents that agree in a block are chained, and each connected chain is a cell. Cells of more than CELL documents are
cut into parts, so that no group grows in one task: see true_roots. Inside a group links are followed from one
document to the next, so copies cost one check each and not one for each pair, yet no link between components is lost.

Edge cases: null and empty texts have no shingles and are linked with nothing; a text of fewer words is one shingle;
repeated rows and rows with equal doc_id are rows of their own; of null ids any other is less; columns other than
doc_id and text are ignored; an empty table gives no rows; a text of any length is one set, hashed in pieces, and must fit in a task; ties of equal ids fall to
the first row read, and change nothing but `root`. deduplicate keeps all columns, whatever their names, of one row of each component.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .graph import components
from .hashing import U, chained_to, group_starts, inside, join, mix, pack, unpack, windows, word_hashes, words_of
from .substring import DEALT, count_bitmap, dealt, in_bitmap

GROUP_BITS, CELL, FAN = 5, 256, 8
MARKS = 1 << 24  # bits of the bitmap of documents in cells
#: A shingle of more documents than this is left out of the first blocks; a bitmap of fixed size tells which. Any set of
#: shingles could be left out without losing a link; it steers work only.
COMMON = 8


def shingles(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of all distinct shingles, sorted by both."""
    w = words_of(texts, lower=True)
    h = word_hashes(w)
    n = np.diff(w.first)
    rows, hashes = [], []
    for size in range(1, words + 1):
        at = np.flatnonzero(inside(w.row, size))
        if size < words:
            at = at[n[w.row[at]] == size]  # the whole text
        rows.append(w.row[at])
        hashes.append(mix(windows(h, size)[at] + U(size)))
    row, key = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    first = group_starts(row, key)
    return row[first], key[first]


def differing(n: np.ndarray, percent: int) -> np.ndarray:
    """The most shingles in which a set of n and a linked one of n or more can differ."""
    larger = n * 100 // percent
    return (n + larger) * (100 - percent) // (100 + percent)


def level_of(n: np.ndarray, percent: int) -> np.ndarray:
    """log2 of the number of blocks: some more than differing() + 1."""
    return np.ceil(np.log2(1.3 * (differing(n, percent) + 1))).astype(np.int64)


def blocks(row: np.ndarray, key: np.ndarray, count: np.ndarray, percent: int, tag: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and signature of the filled blocks of each set, and which sets have too few to be sure of a common one. A pair takes
    the level of its smaller set, so a set has the level of each size that a smaller linked one may have. row and key may
    lack shingles, as long as all sets lack the same ones; count has them all."""
    out_row, out_sig = [np.zeros(0, np.int64)], [np.zeros(0, U)]
    most = level_of(count, percent)
    least = level_of(-(-count * percent // 100), percent)
    bound = differing(count, percent)
    spread = mix(key)
    hard = np.zeros(len(count), bool)
    for level in range(1, int(most.max(initial=0)) + 1):
        has = (least <= level) & (level <= most) & (bound > 0)
        own = has[row]
        r, k, s = row[own], key[own], spread[own]
        filled = np.zeros(len(count), np.int64)
        if len(r):
            block = k >> U(64 - level)
            at = group_starts(r, block)
            out_row.append(r[at].astype(np.int64))
            out_sig.append(mix(np.add.reduceat(s, at) + mix(block[at] + (U(level + 64 * tag) << U(54)))))
            filled = np.bincount(r[at], minlength=len(count))
        hard |= has & (filled <= bound)
    return np.concatenate(out_row), np.concatenate(out_sig), hard


def signatures(row: np.ndarray, key: np.ndarray, count: np.ndarray, percent: int, common_: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row and signature of what two linked sets are sure to share at least once. First the blocks without common shingles
    (passages of many documents would chain them all); for sets that these leave too few blocks, also the blocks of whole
    sets; and for those where these are too few, single shingles: the least of a set's hashes, of which any two
    linked sets share one."""
    rare = np.ones(len(key), bool) if common_ is None else ~common_
    first = blocks(row[rare], key[rare], count, percent, 0)
    own = first[2][row]
    second = blocks(row[own], key[own], np.where(first[2], count, 0), percent, 1)
    place = np.arange(len(row)) - np.searchsorted(row, np.arange(len(count)))[row]
    prefix = count - -(-count * percent // 100) + 1
    own = second[2][row] & (place < prefix[row])
    third = row[own].astype(np.int64), join(key[own], np.full(own.sum(), 77, U))
    return np.concatenate([first[0], second[0], third[0]]), np.concatenate([first[1], second[1], third[1]])


INDEX = "cid bigint, doc_id {kind}, key bigint, n bigint, c1 bigint, c2 bigint, local bigint, bucket int, size int, rows binary, sigs binary"
_NAMES = ["cid", "doc_id", "key", "n", "c1", "c2", "local", "bucket", "size", "rows", "sigs"]
FLUSH = 1_000_000  # hashes that a task holds before it sends them on


def counted(batches: Iterator[pa.RecordBatch], words: int, bits: int, flush: int = FLUSH) -> Iterator[pa.RecordBatch]:
    """Map side of the document counts of shingles."""
    held: list[np.ndarray] = []

    def emit() -> pa.RecordBatch:
        keys = np.sort(np.concatenate(held))
        held.clear()
        first = group_starts(keys)
        return dealt(keys[first], np.diff(np.append(first, len(keys))).astype(np.int32), bits)

    for chunk in common.chunks(batches):
        held.append(shingles(chunk.column(1), words)[1])
        if sum(map(len, held)) >= flush:
            yield emit()
    if sum(map(len, held)):
        yield emit()


def index(batches: Iterator[pa.RecordBatch], words: int, percent: int, bits: int, often: np.ndarray, map_bits: int, flush: int = FLUSH) -> Iterator[pa.RecordBatch]:
    """For each document its number, size, class (hash of the whole set) and `local`: the first document that the task knows it to be
    chained to. For each hash range the packed signatures, each once, under the local document that they lead to."""
    base = TaskContext.get().partitionId() << 33
    rows_held: list[list[pa.Array]] = []
    held: list[tuple[np.ndarray, np.ndarray]] = []
    seen: set[tuple[int, int]] = set()
    number = 0  # of documents sent

    def batch(columns: list[pa.Array]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, kinds, strict=True)], _NAMES)

    def emit() -> Iterator[pa.RecordBatch]:
        row, sig = (np.concatenate(x) for x in zip(*held, strict=True))
        one = [pa.concat_arrays(c) for c in zip(*rows_held, strict=True)]
        rows = len(one[0])
        for a in (held, rows_held, seen):
            a.clear()
        local = chained_to(sig, row, rows)
        nothing = pa.nulls(rows)
        yield batch([pa.array(base + number + np.arange(rows)), *one, pa.array(base + number + local), *[nothing] * 4])
        order = np.argsort(sig, kind="stable")
        order = order[group_starts(sig[order])]
        row, sig = local[row[order]] + number, sig[order]
        cut = np.searchsorted(sig >> U(64 - bits), np.arange((1 << bits) + 1, dtype=U))
        for bucket in np.flatnonzero(np.diff(cut)).tolist():
            lo, hi = int(cut[bucket]), int(cut[bucket + 1])
            by = np.argsort(row[lo:hi], kind="stable")
            own = [[base], *[None] * 6, [bucket], [hi - lo], [pack(row[lo:hi][by], True)], [pack(sig[lo:hi][by])]]
            yield batch([pa.nulls(1) if x is None else pa.array(x) for x in own])

    for chunk in common.chunks(batches):
        kinds = [pa.int64(), chunk.column(0).type, *[pa.int64()] * 5, pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        rows = chunk.num_rows
        row, key = shingles(chunk.column(1), words)
        count = np.bincount(row, minlength=rows)
        c1, c2 = np.zeros(rows, U), np.zeros(rows, U)
        at = group_starts(row)
        if len(at):
            c1[row[at]] = mix(np.add.reduceat(mix(key), at))
            c2[row[at]] = mix(np.add.reduceat(mix(key ^ U(0x5851F42D4C957F2D)), at))
        copy = pa.array(np.arange(rows))  # a slice would keep the whole batch
        before = sum(len(h[0]) for h in rows_held)
        rows_held.append([chunk.column(0).take(copy), chunk.column(2).take(copy), pa.array(count.astype(np.int64)), pa.array(c1.view(np.int64)), pa.array(c2.view(np.int64))])
        fresh = np.zeros(rows, bool)
        for i, c in enumerate(zip(c1.tolist(), c2.tolist(), strict=True)):
            if count[i] and c not in seen:
                seen.add(c)
                fresh[i] = True
        own = fresh[row]
        r, sig = signatures(row[own], key[own], np.where(fresh, count, 0), percent, in_bitmap(often, key[own], map_bits))
        held.append((r + before, sig))
        if sum(len(r) for r, _ in held) >= flush:
            yield from emit()
            number += before + rows
    if held:
        yield from emit()


def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with one signature are chained. The rows come sorted by hash range, of which one at a time is unpacked; each
    document of the task is sent once, with the first one that it is chained to."""
    nodes, tops = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for parts in ranges(batches):
        row = np.concatenate([unpack(r, n, np.int64, True) + base for base, n, r, _ in parts])
        sig = np.concatenate([unpack(s, n, U) for _, n, _, s in parts])
        order = np.argsort(sig, kind="stable")
        row, sig = row[order], sig[order]
        at = group_starts(sig)
        lead = np.repeat(row[at], np.diff(np.append(at, len(row))))
        own = lead != row
        nodes.append(row[own])
        tops.append(lead[own])
        if sum(map(len, nodes)) > FLUSH:
            nodes, tops = ([x] for x in forest(np.concatenate(nodes), np.concatenate(tops)))
    node, top = forest(np.concatenate(nodes), np.concatenate(tops))
    yield pa.RecordBatch.from_arrays([pa.array(top), pa.array(node)], ["a", "b"])


def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, int, bytes, bytes]]]:
    """The packed rows of one hash range after the other."""
    last, parts = None, []
    for whole in batches:
        for bucket, *part in zip(*(whole.column(c).to_pylist() for c in ("bucket", "cid", "size", "rows", "sigs")), strict=True):
            if bucket != last and parts:
                yield parts
                parts = []
            last = bucket
            parts.append(part)
    if parts:
        yield parts


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the links a-b but the least of each component, and that least one."""
    name, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    link = np.arange(len(a))
    top = chained_to(np.concatenate([link, link]), at, len(name))
    own = top != np.arange(len(name))
    return name[own], name[top[own]]


class Tree(NamedTuple):
    """A packed R-tree: points in leaf order, and for each level, from the leaves up, upper corners and least sizes of FAN children."""

    order: np.ndarray
    high: list[np.ndarray]
    small: list[np.ndarray]


def pack_tree(points: np.ndarray) -> Tree:
    """Packed by sorting on the most spread coordinates in turn (sort-tile-recursive)."""

    def tile(rows: np.ndarray, axes: list[int]) -> np.ndarray:
        if len(rows) <= FAN or not axes:
            return rows
        rows = rows[np.argsort(points[rows, axes[0]], kind="stable")]
        slabs = max(2, round((len(rows) / FAN) ** (1 / len(axes))))
        return np.concatenate([tile(part, axes[1:]) for part in np.array_split(rows, slabs)])

    order = tile(np.arange(len(points)), np.argsort(-points.std(axis=0))[:3].tolist())
    high, small = points[order], points[order].sum(axis=1)
    highs, smalls = [], []
    while True:
        at = np.arange(0, len(high), FAN)
        high, small = np.maximum.reduceat(high, at), np.minimum.reduceat(small, at)
        highs.append(high)
        smalls.append(small)
        if len(high) == 1:
            return Tree(order, highs, smalls)


def candidates(points: np.ndarray, percent: int) -> np.ndarray:
    """Symmetric matrix of the point pairs whose summed coordinate minima reach the overlap asked for. Pairs of nodes are followed from
    the root down as long as their corners can hold such a pair."""
    tree = pack_tree(points)
    near = np.zeros((1, 2), np.int64)
    for level in range(len(tree.high) - 1, -1, -1):
        high, small = tree.high[level], tree.small[level]
        near = near[reaches(high, small, near, percent)]
        below = len(tree.high[level - 1]) if level else len(points)
        child = near[:, :, None] * FAN + np.arange(FAN)
        a, b = np.broadcast_arrays(child[:, 0, :, None], child[:, 1, None, :])
        near = np.stack([a.reshape(-1), b.reshape(-1)], axis=1)
        near = near[(near[:, 1] < below) & (near[:, 0] <= near[:, 1])]
    own = points[tree.order]
    near = tree.order[near[reaches(own, own.sum(axis=1), near, percent)]]
    out = np.zeros((len(points), len(points)), bool)
    out[near[:, 0], near[:, 1]] = out[near[:, 1], near[:, 0]] = True
    return out


def reaches(high: np.ndarray, small: np.ndarray, pairs: np.ndarray, percent: int) -> np.ndarray:
    out = np.zeros(len(pairs), bool)
    for lo in range(0, len(pairs), 1 << 14):
        a, b = pairs[lo : lo + (1 << 14)].T
        out[lo : lo + (1 << 14)] = np.minimum(high[a], high[b]).sum(axis=1) * (100 + percent) >= percent * (small[a] + small[b])
    return out


def points_of(sets: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.bincount((s >> U(64 - GROUP_BITS)).astype(np.int64), minlength=1 << GROUP_BITS) for s in sets])


def links(sets: list[np.ndarray], percent: int, joined: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """A spanning forest of the true links: from each document reached, all candidates not reached yet are verified. Documents with
    one number in `joined` are known to be connected: they aren't compared, and whoever reaches one reaches all."""
    near = candidates(points_of(sets), percent)
    group = np.arange(len(sets)) if joined is None else np.unique(joined, return_inverse=True)[1]
    size = np.array([len(s) for s in sets])
    free = np.ones(len(sets), bool)
    while free.any():
        queue = np.flatnonzero(group == group[free.argmax()]).tolist()
        free[queue] = False
        while queue:
            i = queue.pop()
            other = np.flatnonzero(free & near[i])
            if not len(other):
                continue
            flat = np.concatenate([sets[j] for j in other])
            at = np.minimum(np.searchsorted(sets[i], flat), size[i] - 1)
            both = np.add.reduceat((sets[i][at] == flat).astype(np.int64), np.concatenate([[0], np.cumsum(size[other])[:-1]]))
            for j in other[both * 100 >= percent * (size[i] + size[other] - both)].tolist():
                if free[j]:
                    found = np.flatnonzero(group == group[j]).tolist()
                    free[found] = False
                    queue += found
                    yield i, j


def join_cell(table: pa.Table, percent: int) -> pa.Table:
    cid, first = np.unique(table.column("cid").to_numpy(), return_index=True)  # rows alike in doc_id and text come more than once
    chosen = table.take(pa.array(first))
    sets = [np.frombuffer(s, U) for s in chosen.column("shingles").to_pylist()]
    pairs = np.array(list(links(sets, percent, chosen.column("joined").to_numpy())), dtype=np.int64).reshape(-1, 2)
    node, top = forest(cid[pairs[:, 0]], cid[pairs[:, 1]])
    return pa.table({"a": top, "b": node})


def true_roots(points: DataFrame, percent: int) -> DataFrame:
    """node, root of every set that is linked within its cell (points: cell, parts, cid, shingles, counts, n). A cell of up to CELL sets meets in one
    group. A larger one meets in parts of about CELL; then one set of each component found meets others of such, as
    long as that is more than one group. At last, all sets of different components that stand in different parts meet,
    if the upper corners of the parts can hold a link: a group of near copies, however large, has become one component by then."""

    def meet(rows: DataFrame, *group: str) -> DataFrame:
        return common.stage(rows.groupBy(*group).applyInArrow(lambda t: join_cell(t, percent), "a bigint, b bigint"), "links")

    def slot(parts: Column) -> Column:
        return F.pmod(F.xxhash64("cid"), parts).cast("int")

    found = meet(points.select("cell", slot(F.col("parts")).alias("part"), "cid", "shingles", F.col("cid").alias("joined")), "cell", "part")
    large = points.filter("parts > 1").drop("parts")
    if large.isEmpty():
        return components(found)

    def rooted(links_: DataFrame) -> DataFrame:
        roots = large.select("cell", "cid").join(components(links_), F.col("cid") == F.col("node"), "left")
        return common.stage(roots.select("cell", "cid", F.coalesce("root", "cid").alias("root")), "roots")

    while True:
        now = rooted(found)
        heads = now.filter("cid = root")
        many = heads.groupBy("cell").agg(F.count("*").alias("heads")).filter("heads > 1").select("cell", F.ceil(F.col("heads") / CELL).cast("int").alias("parts"))
        most = many.agg(F.max("parts")).first()[0]
        if most is None:
            return components(found)
        rest = large.join(heads.select("cid"), "cid").join(many, "cell")
        more = meet(rest.select("cell", slot(F.col("parts")).alias("part"), "cid", "shingles", F.col("cid").alias("joined")), "cell", "part")
        found = found.unionByName(more)
        if more.isEmpty():
            break
        if most == 1:
            now = rooted(found)
            break
    # Parts: a large component has parts of its own, small ones share.
    sizes = now.groupBy("cell", "root").agg(F.count("*").alias("size"))
    open_ = sizes.groupBy("cell").agg(F.count("*").alias("roots"), F.sum(F.when(F.col("size") < CELL, F.col("size"))).alias("small")).filter("roots > 1")
    home = F.when(F.col("size") >= CELL, F.col("root"))
    part = F.xxhash64("cell", F.coalesce(home, F.lit(-1)), F.pmod(F.xxhash64(F.when(home.isNotNull(), F.col("cid")).otherwise(F.col("root"))), F.ceil(F.coalesce(F.when(home.isNotNull(), F.col("size")), F.col("small")) / CELL)))
    placed = large.join(now.join(sizes, ["cell", "root"]).join(open_, "cell").select("cid", "root", home.alias("home"), part.alias("part")), "cid")
    placed = common.stage(placed, "placed")
    corner = [F.max(F.col("counts")[g]).alias(f"c{g}") for g in range(1 << GROUP_BITS)]
    boxes = placed.groupBy("cell", "part").agg(F.first("home").alias("home"), F.min("n").alias("least"), *corner)
    other = boxes.select("cell", *[F.col(c).alias(f"o_{c}") for c in boxes.columns if c != "cell"])
    bound = sum((F.least(F.col(f"c{g}"), F.col(f"o_c{g}")) for g in range(1 << GROUP_BITS)), F.lit(0))
    fits = bound * (100 + percent) >= percent * (F.col("least") + F.col("o_least"))
    alone = (F.col("part") == F.col("o_part")) & F.col("home").isNotNull()
    pairs = boxes.join(other, "cell").filter(F.col("part") <= F.col("o_part")).filter(~alone & fits & ~F.coalesce(F.col("home") == F.col("o_home"), F.lit(False)))
    pairs = pairs.select(F.xxhash64("part", "o_part").alias("pair"), F.explode(F.array_distinct(F.array("part", "o_part"))).alias("part"))
    return components(found.unionByName(meet(placed.join(pairs, "part").select("pair", "cid", "shingles", F.col("root").alias("joined")), "pair")))


def bitmap_of(keys: DataFrame) -> np.ndarray:
    """A bitmap of MARKS bits (2 MB) of keys, made of 64-bit words in Spark."""
    at = F.col("key").bitwiseAND(F.lit(MARKS - 1))
    words = keys.select(F.shiftright(at, 6).cast("int").alias("w"), F.expr("shiftleft(1L, cast(key & 63 AS INT))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    out = np.zeros(MARKS >> 6, np.int64)
    out[words["w"].to_numpy(dtype=np.int64)] = words["b"].to_numpy(dtype=np.int64)
    return out


def classes(docs: DataFrame, words: int = 4, percent: int = 85, map_bits: int = 27) -> DataFrame:
    """One row for each row of docs: doc_id, key (hash of doc_id and text), cid (its number), n_shingles, component_id
    (least doc_id reachable), root (equal in a component)."""
    spark = docs.sparkSession
    bits = common.buckets_for(spark).bit_length() - 1
    parts = common.shuffle_partitions(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("doc_id", "text").alias("key"))
    counts = rows.mapInArrow(lambda batches: common.tidy(counted(batches, words, bits)), DEALT)
    often = spark.sparkContext.broadcast(count_bitmap(counts, bits, map_bits, COMMON, 1 << 62)[0])
    common.give_back()
    indexed = rows.mapInArrow(lambda batches: common.tidy(index(batches, words, percent, bits, often.value, map_bits)), INDEX.format(kind=kind))
    with common.held(indexed, "index") as found:  # the signatures are as large as the texts, and done with once they are chained
        one = common.stage(found.filter(F.col("n").isNotNull()).select("cid", "doc_id", "key", "n", "c1", "c2", "local"), "rows")
        # Documents with equal sets are one class, which its first document stands for.
        sets = one.filter("n > 0").groupBy("c1", "c2").agg(F.min("cid").alias("rep"), F.min("doc_id").alias("least_id"), F.min_by("key", "cid").alias("key"))
        known = common.stage(one.filter("n > 0").join(sets.select("c1", "c2", "rep"), ["c1", "c2"]).select("cid", "rep"), "classes")
        # Linked documents share many blocks and are found once in each task: so a quarter of the tasks, which take one hash range at a time.
        sent_on = found.filter(F.col("sigs").isNotNull()).select("cid", "bucket", "size", "rows", "sigs").repartition(max(1, parts // 4), "bucket").sortWithinPartitions("bucket")
        raw = sent_on.mapInArrow(lambda batches: common.tidy(chained(batches)), "a bigint, b bigint").unionByName(one.filter("cid <> local").select(F.col("local").alias("a"), F.col("cid").alias("b")))
        side = lambda c: known.select(F.col("cid").alias(c), F.col("rep").alias(f"rep_{c}"))
        chains = raw.join(side("a"), "a").join(side("b"), "b").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
        members = common.stage(components(chains).select(F.col("node").alias("rep"), F.col("root").alias("cell")), "members")
    parts_of = members.groupBy("cell").agg(F.ceil(F.count("*") / CELL).cast("int").alias("parts"))
    wanted = members.join(parts_of, "cell").join(sets.select("rep", "key"), "rep")

    sent = spark.sparkContext.broadcast(bitmap_of(wanted.select("key")))
    common.give_back()

    def hashed(chunk: pa.RecordBatch) -> pa.RecordBatch:
        at = np.asarray(chunk.column(2), dtype=np.int64) & (MARKS - 1)
        chunk = chunk.filter(pa.array((sent.value[at >> 6].view(U) >> (at & 63).astype(U)) & U(1) > 0))
        row, key = shingles(chunk.column(1), words)
        cut = np.searchsorted(row, np.arange(chunk.num_rows + 1))
        sets = [key[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
        counts = points_of(sets).astype(np.int32).tolist() if sets else []
        return pa.RecordBatch.from_arrays([chunk.column(2), pa.array([k.tobytes() for k in sets], pa.binary()), pa.array(counts, pa.list_(pa.int32())), pa.array(np.diff(cut))], ["key", "shingles", "counts", "n"])

    # Only sets of documents in cells move (and a few that the bitmap takes for such); texts stay where they are.
    points = rows.mapInArrow(lambda batches: common.chunk_rows(batches, hashed), "key bigint, shingles binary, counts array<int>, n bigint").join(wanted.withColumnRenamed("rep", "cid"), "key")
    with common.held(points.select("cell", "parts", "cid", "shingles", "counts", "n"), "points") as points:
        roots = true_roots(points, percent)
    labelled = known.join(roots, F.col("rep") == F.col("node"), "left").select("cid", F.coalesce("root", "rep").alias("root"))
    least = labelled.select("cid", "root").join(one.select("cid", "doc_id"), "cid").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    answer = labelled.join(least, "root")
    return one.join(answer, "cid", "left").select(
        "doc_id", "key", "cid", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.coalesce("root", "cid").alias("root")
    )


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_shingles", "component_id")


def deduplicate(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The documents, with all their columns, of which one of each component stays: that of least doc_id."""
    found = classes(docs, words, percent)
    first = found.groupBy("root").agg(F.min_by(F.struct("key", "n_shingles"), F.struct(F.col("doc_id").isNull(), "doc_id", "cid")).alias("f"))
    times = found.groupBy("key").agg(F.count("*").alias("times"))
    keep = first.select(F.col("f.key").alias("key"), (F.col("f.n_shingles") > 0).alias("full")).distinct().join(times, "key")
    # Rows that are alike in doc_id and text have one key; of those with shingles one stays, the same in every run.
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.xxhash64("doc_id", "text").alias("key")).join(keep, "key")
    alone = (F.col("times") == 1) | ~F.col("full")
    chosen = whole.filter(~alone).groupBy("key").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return whole.filter(alone).select("row.*").unionByName(chosen.select("row.*"))
