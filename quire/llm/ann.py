"""Approximate nearest neighbours: a forest of random-projection trees searched through one shared priority queue.

Trees are grown on a bounded sample; each inner node splits the sample's vectors at the median of a random direction. All rows
are sent to one leaf of every tree. A query walks down all trees at once: a single priority queue holds the branches not
taken, nearest splitting plane first, and gives the next leaf until `visits` leaves are found. Rows and queries meet by leaf, where
distances are exact on the original vectors in double precision; the best of each leaf are merged.
Rows and queries of each leaf are counted. The rows of a leaf are cut into blocks of about `block_rows` by a hash and its queries into parts of
about `query_rows`; every part meets every block in a group of its own, so neither a leaf of copies nor one that all queries visit fills
a task. Leaves that no query visits are not sent.

Unstructured vectors (independent normal components) have no near clusters: `visits` is set for a recall of 0.9 on such.

Edge cases: rows whose vec_id is null are neither queries nor candidates; vectors that are null, empty, zero or hold null or non-finite components take no part, nor do those whose
length differs from the commonest; of rows with the same vec_id the nearest counts; ties go to the smaller vec_id;
with fewer candidates than k all found are returned; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .hashing import group_starts


def usable(df: DataFrame, id_column: str, vector: str) -> DataFrame:
    """id and v (array of double) of the vectors that take part."""
    v = F.col("v")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return (
        df.select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
        .filter(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0))
        .filter(fine & F.exists(v, lambda x: x != 0))
    )


def grow(x: np.ndarray, trees: int, leaves: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Complete trees of `leaves` leaves: directions (trees, nodes, dim) and cuts (trees, nodes), children of i: 2i+1, 2i+2."""
    rng = np.random.default_rng(seed)
    inner = leaves - 1
    ways, cuts = rng.normal(size=(trees, inner, x.shape[1])), np.zeros((trees, inner))
    for t in range(trees):
        own = {0: np.arange(len(x))}
        for i in range(inner):
            rows = own.pop(i)
            p = x[rows] @ ways[t, i]
            cuts[t, i] = np.median(p) if len(p) else 0.0
            own[2 * i + 1], own[2 * i + 2] = rows[p < cuts[t, i]], rows[p >= cuts[t, i]]
    return ways, cuts


def leaves_of(x: np.ndarray, forest: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The leaf of each vector in each tree (vectors, trees)."""
    ways, cuts = forest
    inner = cuts.shape[1]
    out = np.zeros((len(x), len(cuts)), np.int32)
    for t in range(len(cuts)):
        side = (x @ ways[t].T >= cuts[t]) if inner else None
        at = np.zeros(len(x), np.int32)
        for _ in range(int(np.log2(inner + 1))):
            at = 2 * at + 1 + side[np.arange(len(x)), at]
        out[:, t] = at - inner
    return out


def search(q: np.ndarray, forest: tuple[np.ndarray, np.ndarray], visits: int) -> list[tuple[int, int]]:
    """The (tree, leaf) pairs that one query visits, by the shared priority queue."""
    ways, cuts = forest
    inner = cuts.shape[1]
    off = np.einsum("tnd,d->tn", ways, q) - cuts
    gap = np.abs(off) / np.maximum(np.linalg.norm(ways, axis=2), 1e-12)
    queue, found = [(0.0, t, 0) for t in range(len(cuts))], []
    while queue and len(found) < visits:
        far, t, i = heapq.heappop(queue)
        while i < inner:
            right = off[t, i] >= 0
            heapq.heappush(queue, (max(far, gap[t, i]), t, 2 * i + 1 + (not right)))
            i = 2 * i + 1 + int(right)
        found.append((t, i - inner))
    return found


def matrix(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    blobs = col.to_pylist()
    return np.frombuffer(b"".join(blobs)).reshape(len(blobs), -1)


def vectors(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column(1).flatten(), dtype=float).reshape(batch.num_rows, -1)


def nearest(
    rows: DataFrame, is_query: Column, id_column: str = "vec_id", vector: str = "embedding", k: int = 10, trees: int = 24,
    most_leaves: int = 32, visits: int = 44, sample_rows: int = 10_000, block_rows: int = 4096,
    query_rows: int = 16384,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row for which is_query holds.

    The forest is grown on at most sample_rows vectors, those of lowest hash, on the driver; every row is indexed.
    """
    spark = rows.sparkSession
    flagged = common.stage(usable(rows, id_column, vector).withColumn("n", F.size("v")), "vectors")
    sizes = flagged.groupBy("n").count().orderBy(F.desc("count"), "n").limit(1).collect()
    dim, total = (sizes[0]["n"], sizes[0]["count"]) if sizes else (1, 0)
    base = flagged.filter(F.col("n") == dim).select("id", "v")
    sample = common.lowest(base, F.col("id"), sample_rows).toPandas().sort_values("id")["v"].tolist()
    leaves = 1
    while leaves < most_leaves and leaves * 200 < total:
        leaves *= 2
    x = np.array(sample, dtype=float).reshape(-1, dim)
    sent = spark.sparkContext.broadcast(grow(x, trees, leaves))

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(trees * leaves, np.int64)
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                at = leaves_of(vectors(whole.slice(lo, 2000)), sent.value) + leaves * np.arange(trees)
                n += np.bincount(at.reshape(-1), minlength=len(n))
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n).astype(np.int32)), pa.array(n[n > 0])], ["cell", "n"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                b = whole.slice(lo, 2000)
                v = vectors(b)
                at = leaves_of(v, sent.value)
                blobs = pa.array([r.tobytes() for r in v], pa.binary())
                for t in range(at.shape[1]):
                    yield pa.RecordBatch.from_arrays([pa.array(at[:, t] + np.int32(t * leaves)), b.column(0), blobs], ["cell", "id", "blob"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                b = whole.slice(lo, 500)
                v = vectors(b)
                hits = [search(q, sent.value, visits) for q in v]
                cells = pa.array([[t * leaves + leaf for t, leaf in h] for h in hits], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([q.tobytes() for q in v], pa.binary()), cells], ["id", "blob", "cells"])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if left.num_rows and right.num_rows:
            qs, ids, v = left.column("id").to_numpy(), right.column("id").to_numpy(), matrix(right.column("blob"))
            order = np.argsort(ids, kind="stable")
            ids, v = ids[order], v[order]
            head = group_starts(ids)
            ids = ids[head]
            for qid, q in zip(qs, matrix(left.column("blob")), strict=True):
                # The nearest row of each id, before the cut to k: repeated rows take one place.
                d = np.minimum.reduceat(np.sqrt(((v - q) ** 2).sum(axis=1)), head)
                d[ids == qid] = np.inf
                near = np.flatnonzero(d <= np.partition(d, min(k, len(d)) - 1)[min(k, len(d)) - 1])
                near = near[np.lexsort((ids[near], d[near]))][:k]
                near = near[np.isfinite(d[near])]
                out.append((np.full(len(near), qid), ids[near], d[near]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"query_id": columns[0].astype(np.int64), "vec_id": columns[1].astype(np.int64), "score": columns[2]})

    kind = "cell int, id bigint, blob binary"
    queries = base.join(queries_of(rows, is_query, id_column), "id", "left_semi").select("id", "v")
    hits = common.stage(queries.mapInArrow(visit, "id bigint, blob binary, cells array<int>"), "hits")
    visits_of = hits.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("n"))
    blocks, parts = (cuts_of(n, trees * leaves, size) for n, size in ((base.mapInArrow(load, "cell int, n bigint"), block_rows), (visits_of, query_rows)))
    each_block, each_part = (F.explode(F.sequence(F.lit(0), n - 1)) for n in (blocks, parts))
    placed = base.mapInArrow(place, kind).filter(parts > 0).withColumn("block", F.pmod(F.xxhash64("id", "blob"), blocks).cast("int")).withColumn("part", each_part)
    visited = hits.select(F.explode("cells").alias("cell"), "id", "blob").filter(blocks > 0)
    visited = visited.withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "id", "blob"), parts).cast("int")).withColumn("block", each_block)
    keys = ["cell", "block", "part"]
    found = visited.groupBy(keys).cogroup(placed.groupBy(keys)).applyInArrow(meet, "query_id bigint, vec_id bigint, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def queries_of(rows: DataFrame, is_query: Column, id_column: str) -> DataFrame:
    return rows.filter(is_query).select(F.col(id_column).cast("long").alias("id")).distinct()


def cuts_of(counts: DataFrame, cells: int, size: int) -> Column:
    """Of column cell: into how many pieces of about `size` what `counts` (cell, n) tells of it is to be cut, 0 if it holds nothing.
    One number for each leaf of the forest reaches the driver."""
    n = [0] * cells
    for r in counts.groupBy("cell").agg(F.sum("n").alias("n")).collect():
        n[r.cell] = -(-r.n // size)
    return F.element_at(F.array(*map(F.lit, n)), F.col("cell") + 1)
