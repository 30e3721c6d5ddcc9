"""Quality rules with an isolation forest on rule statistics.

Every document gets statistics of its whole text in one pass. Documents that fail a base rule go. An isolation forest,
grown on the rest without their labels (each tree on its own draw from all of it, as the method has it), isolates documents by random splits: anomalous ones are isolated after few.
A document is dropped if its anomaly score exceeds a threshold calibrated on labelled rows so that at most `max_good_loss` of those
labelled good go. Half of the labelled rows (calibrating()) set the threshold, so the others can measure it.

The forest splits on ISOLATED only. Digits, repeated lines and repeated words tell pages with figures or quotations
from others more than bad ones from good, and repetition is what the base rules are for.

Edge cases: a null or empty text has no words and fails the base rule; labels that are null don't count, of several
for a document the best counts; without labelled rows of both kinds the threshold is 1 and only base rules drop; equal scores share
one side of the threshold; repeated rows each keep their result; a text longer than a chunk is measured alone and whole; other columns,
whatever their names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common
from .hashing import SPACE, U, inside, join, mix, windows, word_hashes, words_of

FEATURES = ("words", "word_length", "symbols", "dup_lines", "repeats", "digits", "upper", "punctuation", "distinct", "bars", "line_words", "short_words")
ISOLATED = [i for i, name in enumerate(FEATURES) if name not in ("dup_lines", "repeats", "digits")]
#: Fixed values of the base rules.
SYMBOLS, MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WINDOW = b"#*$%&|<>", 20, 30, 8


def _per_row(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[at[1:]] - total[at[:-1]]


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL, _DIGIT, _UPPER = _class(SYMBOLS), _class(b"0123456789"), _class(bytes(range(0x41, 0x5B)))
_PUNCTUATION, _BAR = _class(b"!?.,;:-'\"()"), _class(b"|")


def repeated_words(h: np.ndarray, row: np.ndarray, rows: int, size: int) -> np.ndarray:
    """Of each row: words in windows of `size` words that the row holds twice or more."""
    if len(h) < size:
        return np.zeros(rows, np.int64)
    ok = np.flatnonzero(inside(row, size))
    key = join(windows(h, size)[ok], mix(row[ok].astype(U)))
    order = np.argsort(key)
    k = key[order]
    same = np.zeros(len(k), bool)
    same[1:] = k[1:] == k[:-1]
    same[:-1] |= same[1:]
    hit = ok[order[same]]
    edge = np.bincount(hit, minlength=len(h) + 1) - np.bincount(hit + size, minlength=len(h) + 1)[: len(h) + 1]
    covered = np.cumsum(edge[: len(h)]) > 0
    return np.bincount(row[covered], minlength=rows)


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counts and features of whole texts."""
    w = words_of(texts)
    rows = len(texts)
    h = word_hashes(w)
    data, at = w.data, np.concatenate([[0], np.cumsum(np.asarray(texts.cast(pa.binary()).to_pandas().str.len(), dtype=np.int64))]) if rows else np.zeros(1, np.int64)
    n_words = np.diff(w.first)
    solid = ~SPACE[data]
    chars = _per_row(solid & ((data & 0xC0) != 0x80), at)
    symbols = _per_row(_SYMBOL[data], at)
    lines = [[x for x in t.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")] for t in texts.cast(pa.binary()).to_pylist()]
    n_lines = np.array([len(x) for x in lines], np.int64)
    dup = n_lines - np.array([len(set(x)) for x in lines], np.int64)
    repeats = repeated_words(h, w.row, rows, REPEAT_WINDOW)
    key = np.sort(join(h, mix(w.row.astype(U)))) if len(h) else h
    order = np.argsort(join(h, mix(w.row.astype(U)))) if len(h) else np.zeros(0, np.int64)
    first = np.ones(len(h), bool)
    first[1:] = key[1:] != key[:-1]
    distinct = np.bincount(w.row[order[first]], minlength=rows) if len(h) else np.zeros(rows, np.int64)
    short = np.bincount(w.row[(w.end - w.start) <= 3], minlength=rows) if len(h) else np.zeros(rows, np.int64)
    safe, safe_chars = np.maximum(n_words, 1), np.maximum(chars, 1)
    features = np.stack(
        [
            np.log1p(n_words), chars / safe, symbols / safe_chars, dup / np.maximum(n_lines, 1), repeats / safe,
            _per_row(_DIGIT[data], at) / safe_chars, _per_row(_UPPER[data], at) / safe_chars, _per_row(_PUNCTUATION[data], at) / safe_chars,
            distinct / safe, _per_row(_BAR[data], at) / safe, np.log1p(safe / np.maximum(n_lines, 1)), short / safe,
        ], axis=1,
    )
    return {"n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeats, "features": features}


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, features (array of double in the order of FEATURES) and base_failed."""

    def work(chunk: pa.RecordBatch) -> pa.RecordBatch:
        m = measure(chunk.column(1))
        flat = pa.array(m["features"].ravel())
        features = pa.ListArray.from_arrays(pa.array(np.arange(chunk.num_rows + 1, dtype=np.int32) * len(FEATURES)), flat)
        return pa.RecordBatch.from_arrays([chunk.column(0), *(pa.array(m[k].astype(np.int64)) for k in COUNTS), features], ["doc_id", *COUNTS, "features"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return common.chunk_rows(batches, work)

    rows = common.text_rows(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"doc_id {kind}, {', '.join(f'{k} bigint' for k in COUNTS)}, features array<double>")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def grow(x: np.ndarray, trees: int, sample: int, seed: int) -> tuple[np.ndarray, ...]:
    """An isolation forest on draws of `sample` rows of x."""
    rng = np.random.default_rng(seed)
    sample = min(sample, len(x))
    return grown((x[rng.choice(len(x), sample, replace=False)] for _ in range(trees)), sample, rng)


def grown(draws: Iterable[np.ndarray], sample: int, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
    """A tree on each draw of `sample` rows, as flat arrays: feature (-1: leaf), cut, left child (right is the next), path length at leaves."""
    limit = int(np.ceil(np.log2(max(sample, 2)))) + 2
    feature, cut, left, length, roots = [], [], [], [], []

    def add() -> int:
        for a, v in ((feature, -1), (cut, 0.0), (left, 0), (length, 0.0)):
            a.append(v)
        return len(feature) - 1

    for draw in draws:
        root = add()
        roots.append(root)
        todo = [(root, draw, 0)]
        while todo:
            node, own, depth = todo.pop()
            low, high = own.min(0), own.max(0)
            free = np.flatnonzero(high > low)
            if depth >= limit or len(own) <= 1 or not len(free):
                length[node] = depth + average_path(len(own))
                continue
            f = int(rng.choice(free))
            at = float(rng.uniform(low[f], high[f]))
            a, b = add(), add()
            feature[node], cut[node], left[node] = f, at, a
            goes = own[:, f] < at
            todo += [(a, own[goes], depth + 1), (b, own[~goes], depth + 1)]
    return np.array(roots), np.array(feature), np.array(cut), np.array(left), np.array(length), np.array([average_path(sample)])


def average_path(n: int) -> float:
    """The mean path of an unsuccessful search in a binary search tree of n keys."""
    return 0.0 if n <= 1 else 2.0 * (np.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n if n > 2 else 1.0


def anomaly(forest: tuple[np.ndarray, ...], x: np.ndarray) -> np.ndarray:
    """2^(-mean path / average path): near 1 for anomalies, about 0.5 or less for the rest."""
    roots, feature, cut, left, length, norm = forest
    total = np.zeros(len(x))
    for root in roots:
        node = np.full(len(x), root)
        live = np.flatnonzero(feature[node] >= 0)
        while len(live):
            at = node[live]
            node[live] = left[at] + (x[live, feature[at]] >= cut[at])
            live = live[feature[node[live]] >= 0]
        total += length[node]
    return 2.0 ** (-total / len(roots) / max(norm[0], 1e-9))


def calibrate(score: np.ndarray, good: np.ndarray, max_good_loss: float) -> float:
    """The threshold with the most balanced accuracy of those that drop at most max_good_loss of the good rows."""
    if not len(score) or good.all() or not good.any():
        return 1.0
    cuts = np.unique(score)
    lost = 1 - np.searchsorted(np.sort(score[good]), cuts, side="right") / good.sum()
    caught = 1 - np.searchsorted(np.sort(score[~good]), cuts, side="right") / (~good).sum()
    gain = np.where(lost <= max_good_loss, caught - lost, -1.0)
    return float(cuts[gain.argmax()])


def calibrating() -> Column:
    """The labelled rows that set the threshold."""
    return F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(3)), F.lit(2)) == 0


def draws(passing: DataFrame, trees: int, rows: int) -> list[np.ndarray]:
    """For each tree, features of `rows` rows drawn from all that pass (all, if fewer): those of its lowest hashes. What reaches the driver doesn't
    grow with the table."""
    n = passing.count()
    if not n:
        return []
    # Twice what is wanted lies below this bound, so few rows are sorted.
    bound = F.lit(-(1 << 63) + min((1 << 64) - 1, (1 << 64) * 2 * rows // n))
    hashes = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), F.xxhash64("doc_id", t, F.lit(17)).alias("h")))
    drawn = passing.select("doc_id", "features", F.inline(F.filter(hashes, lambda x: x["h"] <= bound)))
    first = drawn.withColumn("n", F.row_number().over(Window.partitionBy("tree").orderBy("h", "doc_id", "features"))).filter(F.col("n") <= rows)
    found = first.select("tree", "n", "features").toPandas().sort_values(["tree", "n"])
    return [np.array(own["features"].tolist(), dtype=float).reshape(-1, len(FEATURES))[:, ISOLATED] for _, own in found.groupby("tree")]


def calibrated(scored: DataFrame, max_good_loss: float) -> float:
    """calibrate() over all rows (score, good) of a table."""
    rows = common.by_score(scored)
    n = rows.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).first()
    if not n.good or not n.bad:
        return 1.0
    lost, caught = 1 - F.col("good_to") / F.lit(n.good), 1 - F.col("bad_to") / F.lit(n.bad)
    gain = F.when(lost <= max_good_loss, caught - lost).otherwise(-1.0)
    return float(-rows.select(F.max(F.struct(gain.alias("gain"), (-F.col("score")).alias("least"))).alias("best")).first().best.least)


def judge(docs: DataFrame, labels: DataFrame, trees: int = 200, tree_rows: int = 256, max_good_loss: float = 0.01) -> DataFrame:
    """statistics() with anomaly (double) and kept. Each of the forest's trees is grown on `tree_rows` rows drawn from all documents that pass
    the base rules, which bounds what reaches the driver; all calibrating rows set the threshold, and everything is scored."""
    spark = docs.sparkSession
    rows = common.stage(statistics(docs), "statistics")
    passing = rows.filter(~F.col("base_failed")).select("doc_id", "features")
    found = draws(passing, trees, tree_rows)
    forest = grown(found, len(found[0]), np.random.default_rng(7)) if found else None
    sent = spark.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return common.tidy(map(with_anomaly, batches))

    def with_anomaly(b: pa.RecordBatch) -> pa.RecordBatch:
        own = b.column(b.schema.get_field_index("features"))
        f = np.asarray(own.flatten(), dtype=float).reshape(-1, len(FEATURES))[:, ISOLATED]
        score = anomaly(sent.value, f) if sent.value is not None else np.zeros(len(f))
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(score)], [*b.schema.names, "anomaly"])

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    scored = common.stage(rows.mapInArrow(run, f"{kind}, anomaly double"), "scored")
    marks = labels.select("doc_id", F.col("quality").alias("_q")).filter("_q is not null").groupBy("doc_id").agg(F.max("_q").alias("_q"))
    known = scored.filter(~F.col("base_failed")).filter(calibrating()).join(marks, "doc_id").select(F.col("anomaly").alias("score"), (F.col("_q") == 1).alias("good"))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") <= calibrated(known, max_good_loss)))


def digest(judged: DataFrame) -> DataFrame:
    return judged.select("doc_id", *COUNTS, "base_failed", "kept", "anomaly")
