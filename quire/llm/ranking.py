"""Quality scores by Bradley-Terry ranking of documents in preference pairs.

Every document gets the statistics of its whole text that `quality` measures. Of labelled rows, all of them outside the held-out fold, each
good one is preferred to some bad ones and each bad one is beaten by some good ones. A document's score is linear in hinges of its statistics (each cut into steps at
quantiles, exact over all rows that form pairs), and the weights minimise the logistic loss of the pairs' score differences: P(a beats b) = 1 / (1 + exp(s(b) - s(a))).
Each Newton step sums slope and curvature over all pairs in Spark tasks; weights are rounded, as the order of such sums varies.

The threshold is a quantile of the scores of labelled rows that formed no pair: the one that tells most bad ones from good ones, midway
to the next score. The score returned is the probability of a score difference to the threshold, shifted so that the threshold
itself has `cut` (0.3).

Edge cases: a null or empty text has statistics of zero and is scored like any other; labels that are null don't count, of several for a
document the best counts; without labelled rows of both kinds every score is 0.5; texts alike have equal scores; repeated rows each
keep their result; a text longer than a chunk is measured alone and whole; a null doc_id isn't held out and matches no label; other
columns, whatever their names, are ignored, and so are labels, lang, source and doc_id in a score; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common, quality

BLOCK = 4096


class Model(NamedTuple):
    knots: list[np.ndarray]
    weights: np.ndarray
    threshold: float


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def knots_of(x: np.ndarray, steps: int) -> list[np.ndarray]:
    """Of each statistic, the distinct quantiles at which its hinges begin and end."""
    return [np.unique(np.quantile(x[:, f], np.linspace(0, 1, steps + 1))) for f in range(x.shape[1])]


def hinges(x: np.ndarray, knots: list[np.ndarray]) -> np.ndarray:
    """Of each statistic and step between knots, how far up the step the value lies, 0 to 1."""
    parts = [np.clip((x[:, f, None] - k[None, :-1]) / np.diff(k)[None], 0.0, 1.0) for f, k in enumerate(knots)]
    return np.concatenate(parts, axis=1)


def pairs(good: int, bad: int, each: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Winner and loser of each preference pair, as places among the good and the bad rows: each row in `each` pairs at least."""
    rng = np.random.default_rng(seed)
    win = np.concatenate([np.repeat(np.arange(good), each), rng.integers(0, good, bad * each)])
    lose = np.concatenate([rng.integers(0, bad, good * each), np.repeat(np.arange(bad), each)])
    return win, lose


def slopes(d: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slope and curvature of the pairs' likelihood, summed over their differences d."""
    miss = 1 / (1 + np.exp(np.clip(d @ w, -40, 40)))
    return d.T @ miss, (d * (miss * (1 - miss))[:, None]).T @ d


def newton(total: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], width: int, n: int, ridge: float, rounds: int) -> np.ndarray:
    """Weights of least logistic loss, where total(w) has the sums of slopes() over all n pairs."""
    w = np.zeros(width)
    for _ in range(rounds):
        slope, curve = total(w)
        step = np.linalg.solve(curve / n + ridge * np.eye(width), slope / n - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(good: np.ndarray, bad: np.ndarray, win: np.ndarray, lose: np.ndarray, ridge: float = 1e-4, rounds: int = 30) -> np.ndarray:
    """The weights from pairs of rows in memory, in blocks."""

    def total(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts = [slopes(good[win[lo : lo + BLOCK]] - bad[lose[lo : lo + BLOCK]], w) for lo in range(0, len(win), BLOCK)]
        return sum(a for a, _ in parts), sum(b for _, b in parts)

    return newton(total, good.shape[1], len(win), ridge, rounds)


def threshold(score: np.ndarray, good: np.ndarray) -> float:
    """The quantile of the scores that best tells both kinds, midway to the score below it; of equals, the middle one."""
    cuts = np.unique(score)
    lost = np.searchsorted(np.sort(score[good]), cuts) / good.sum()
    caught = np.searchsorted(np.sort(score[~good]), cuts) / (~good).sum()
    best = np.flatnonzero(caught - lost >= (caught - lost).max() - 1e-12)
    at = int(best[len(best) // 2])
    return float(cuts[at] if not at else (cuts[at] + cuts[at - 1]) / 2)


def best_threshold(rows: DataFrame) -> float:
    """threshold() over all rows (score, good) of a table."""
    cuts = common.by_score(rows)
    n = cuts.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).first()
    gain = (F.col("bad_to") - F.col("bad")) / F.lit(n.bad) - (F.col("good_to") - F.col("good")) / F.lit(n.good)
    cuts = common.stage(cuts.select("score", "part", gain.alias("gain")), "gains")
    best = cuts.filter(F.col("gain") >= cuts.agg(F.max("gain")).first()[0] - 1e-12)
    parts = sorted(best.groupBy("part").agg(F.count("*").alias("held")).collect())  # one row a range
    left = sum(r.held for r in parts) // 2
    for part, held in parts:
        if left < held:
            break
        left -= held
    place = F.row_number().over(Window.partitionBy("part").orderBy("score"))
    at = best.filter(F.col("part") == part).withColumn("n", place).filter(F.col("n") == left + 1).first().score
    below = cuts.filter(F.col("score") < at).agg(F.max("score")).first()[0]
    return float(at if below is None else (at + below) / 2)


def exact_knots(rows: DataFrame, steps: int) -> list[np.ndarray]:
    """knots_of() over all rows (features) of a table: values are counted and the wanted ranks read off the running counts."""
    n, width = rows.count(), len(quality.FEATURES)
    at = np.linspace(0, 1, steps + 1) * (n - 1)
    ranks = sorted({int(r) for r in (*np.floor(at), *np.ceil(at))})
    values = rows.select(F.posexplode("features").alias("f", "v")).groupBy("f", "v").agg(F.count("*").alias("held"))
    up_to = F.col("held_to") - F.col("f").cast("long") * n  # every statistic has n values
    own = F.filter(F.array(*map(F.lit, ranks)), lambda r: (r < up_to) & (r >= up_to - F.col("held")))
    found = common.running(values, ["f", "v"], ["held"]).select("f", "v", F.explode(own).alias("r")).collect()
    value = {(x.f, x.r): x.v for x in found}
    low, high = np.floor(at).astype(int).tolist(), np.ceil(at).astype(int).tolist()
    return [np.unique([value[f, a] + (value[f, b] - value[f, a]) * (x - a) for a, b, x in zip(low, high, at.tolist(), strict=True)]) for f in range(width)]


def preferences(rows: DataFrame, each: int) -> DataFrame:
    """win, lose: the features of the pairs that all rows (doc_id, features, good) form, `each` a row, with opponents of any number."""
    keyed = rows.select("good", "features", F.xxhash64("doc_id", "features", F.lit(5)).alias("h"), F.lit(1).alias("one"))
    placed = common.running(keyed, ["good", "h", "features"], ["one"])
    bad = rows.filter(~F.col("good")).count()
    good = rows.count() - bad
    # Bad rows come first in the order.
    placed = common.stage(placed.select("good", "features", "h", (F.col("one_to") - 1 - F.when(F.col("good"), bad).otherwise(0)).alias("i")), "placed")
    count = F.when(F.col("good"), bad).otherwise(good).cast("long")
    asked = placed.select("good", "features", F.explode(F.transform(F.sequence(F.lit(1), F.lit(each)), lambda k: F.pmod(F.xxhash64("h", "i", k), count))).alias("j"))
    other = placed.select((~F.col("good")).alias("good"), F.col("features").alias("other"), F.col("i").alias("j"))
    win, lose = F.when(F.col("good"), F.col("features")), F.when(F.col("good"), F.col("other"))
    return asked.join(other, ["good", "j"]).select(win.otherwise(F.col("other")).alias("win"), lose.otherwise(F.col("features")).alias("lose"))


def matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=float).reshape(-1, len(quality.FEATURES))


def learned(pairs_: DataFrame, knots: list[np.ndarray], ridge: float = 1e-4, rounds: int = 30) -> np.ndarray:
    """The weights from all pairs (win, lose) of a stored table: a Newton step is a job, whose sums alone reach the driver."""
    width = sum(len(k) - 1 for k in knots)

    def total(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            slope, curve = np.zeros(width), np.zeros((width, width))
            for b in batches:
                for lo in range(0, b.num_rows, BLOCK):
                    part = b.slice(lo, BLOCK)
                    a, c = slopes(hinges(matrix(part.column(0)), knots) - hinges(matrix(part.column(1)), knots), w)
                    slope += a
                    curve += c
            yield pa.RecordBatch.from_arrays([pa.array([slope.tobytes()], pa.binary()), pa.array([curve.tobytes()], pa.binary())], ["slope", "curve"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            slope, curve = np.zeros(width), np.zeros(width * width)
            for b in batches:
                for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    slope += np.frombuffer(x)
                    curve += np.frombuffer(y)
            yield pa.RecordBatch.from_arrays([pa.array([slope.tobytes()], pa.binary()), pa.array([curve.tobytes()], pa.binary())], ["slope", "curve"])

        found = pairs_.mapInArrow(work, "slope binary, curve binary").repartition(8).mapInArrow(add, "slope binary, curve binary").collect()
        return sum(np.frombuffer(r.slope) for r in found), sum(np.frombuffer(r.curve).reshape(width, width) for r in found)

    return newton(total, width, pairs_.count(), ridge, rounds)


def fit(known: DataFrame, steps: int, each: int) -> Model | None:
    """The model of all rows (doc_id, features, good, calibrates); those marked in `calibrates` set the threshold, the others form the pairs."""
    held = {(r.good, r.calibrates) for r in known.select("good", "calibrates").distinct().collect()}
    if not {(True, False), (False, False)} <= held:
        return None
    learns = known.filter(~F.col("calibrates"))
    knots = exact_knots(learns, steps)
    w = np.round(learned(common.stage(preferences(learns, each), "pairs"), knots), 6)

    def with_score(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(hinges(matrix(b.column(0)), knots) @ w), b.column(1)], ["score", "good"])

    own = known.filter("calibrates") if {(True, True), (False, True)} <= held else learns
    scored = own.select("features", "good").mapInArrow(lambda batches: common.tidy(map(with_score, batches)), "score double, good boolean")
    return Model(knots, w, best_threshold(scored))


def probability(model: Model | None, x: np.ndarray, cut: float) -> np.ndarray:
    if model is None:
        return np.full(len(x), 0.5)
    difference = hinges(x, model.knots) @ model.weights - model.threshold
    return 1 / (1 + np.exp(-np.clip(difference + np.log(cut / (1 - cut)), -40, 40)))


def training_rows(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, features, good, calibrates: all labelled rows outside the held-out fold."""
    marks = labels.select("doc_id", F.col("quality").alias("_q")).filter("_q is not null").groupBy("doc_id").agg((F.max("_q") > 0).alias("good"))
    return rows.filter(~held_out()).select("doc_id", "features").join(marks, "doc_id").withColumn("calibrates", quality.calibrating())


def score(docs: DataFrame, labels: DataFrame, steps: int = 8, each: int = 4, cut: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= cut) of every whole text. All labelled rows outside the held-out fold are learned
    from; half of them form pairs, `each` a row. Only sums, knots and the model reach the driver."""
    rows = common.stage(quality.statistics(docs).select("doc_id", "features"), "statistics")
    model = fit(common.stage(training_rows(rows, labels), "known"), steps, each)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def with_score(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(probability(sent.value, matrix(b.column(1)), cut))], ["doc_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return common.tidy(map(with_score, batches))

    out = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
