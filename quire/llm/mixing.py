"""Mixing sources to target weights: iterative proportional fitting, then sampling by calibrated probabilities.

The corpus is summed to cells of (source, lang, topic) with their words as weight. Raking scales the cells to one marginal
after the other until all three fit; the factor of a cell is its raked share over its own. Documents of a cell are sampled
with probability min(1, s * factor), where s gives the wanted share of words, and by a hash of doc_id, so a
rerun draws the same ones. A document's weight, factor / probability, corrects what the limit of 1 cuts off.

The documents hold no topic. One is derived from the words: each word of five bytes or more falls into one of TOPICS classes by
its hash, and the commonest class of a text, the least of equals, is its topic.

Cells are few (values of the three columns); up to `most_cells` they are raked on the driver, beyond in Spark.

Edge cases: null source or lang is a value of its own; a null or empty text has no words and topic 0; a cell without
words has factor 1; values without a target keep their part of what the targets leave; a target for an absent value is left
out and the rest scaled; a null doc_id is hashed like any value; repeated rows are drawn alike; a text longer than a chunk is counted
alone and whole; other columns pass, but those named like ADDED are replaced by the results (not by sample()); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .common import stage
from .hashing import U, word_hashes, words_of

TOPICS = 8
HALVINGS = 60
MARGINALS = ("source", "lang", "topic")
ADDED = ("_topic", "_words", "_weight", "_probability", "_sampled")


def topics(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Number of words and topic of each text."""
    w = words_of(texts, lower=True)
    rows = len(texts)
    long = (w.end - w.start) >= 5
    kind = (word_hashes(w)[long] % U(TOPICS)).astype(np.int64)
    table = np.bincount(w.row[long].astype(np.int64) * TOPICS + kind, minlength=rows * TOPICS).reshape(rows, TOPICS)
    return np.diff(w.first), table.argmax(axis=1)


def tagged(docs: DataFrame) -> DataFrame:
    """docs with _topic (int) and _words (long)."""

    def work(chunk: pa.RecordBatch) -> pa.RecordBatch:
        words, topic = topics(chunk.column(chunk.schema.get_field_index("text")))
        return pa.RecordBatch.from_arrays([*chunk.columns, pa.array(topic.astype(np.int32)), pa.array(words.astype(np.int64))], [*chunk.schema.names, "_topic", "_words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return common.chunk_rows(batches, work)

    kind = T.StructType([*docs.schema.fields, T.StructField("_topic", T.IntegerType()), T.StructField("_words", T.LongType())])
    return docs.mapInArrow(run, kind)


def shares(present: pd.Series, target: dict | float) -> pd.Series:
    """Target shares of a marginal's values. present: their words. A number t asks for shares as present ** t."""
    total = present.sum() or 1.0
    if not isinstance(target, dict):
        want = np.where(present > 0, (present / total) ** target, 0.0)
        return pd.Series(want / (want.sum() or 1.0), index=present.index)
    given = pd.Series({v: target[v] for v in present.index if v in target and present[v] > 0}, dtype=float)
    rest = present[[v not in target for v in present.index]]
    left = max(0.0, 1.0 - given.sum()) if rest.sum() else 0.0
    want = pd.concat([given / given.sum() * (1 - left) if given.sum() else given, rest / (rest.sum() or 1.0) * (left if given.sum() else 1.0)])
    return want.reindex(present.index).fillna(0.0)


def rake(cells: pd.DataFrame, targets: dict, rounds: int, tolerance: float) -> np.ndarray:
    """Raked weights (they sum to 1) of cells with columns of MARGINALS and words."""
    total = float(cells["words"].sum())
    w = cells["words"].to_numpy(dtype=float) / (total or 1.0)
    codes, wants = {}, {}
    for m in MARGINALS:
        codes[m], values = pd.factorize(cells[m], use_na_sentinel=False)
        present = pd.Series(np.bincount(codes[m], weights=cells["words"], minlength=len(values)), index=[None if pd.isna(v) else v for v in values])
        wants[m] = shares(present, targets[m]).to_numpy()
    for _ in range(rounds):
        worst = 0.0
        for m in MARGINALS:
            now = np.bincount(codes[m], weights=w, minlength=len(wants[m]))
            scale = np.where(now > 0, wants[m] / np.where(now > 0, now, 1.0), 1.0)
            worst = max(worst, np.abs(now - wants[m])[now > 0].max(initial=0.0))
            w = w * scale[codes[m]]
        if worst < tolerance:
            break
    return w


def rake_in_spark(cells: DataFrame, targets: dict, rounds: int, tolerance: float) -> DataFrame:
    """The same for more cells than a driver should hold: cells with column raked."""
    total = cells.agg(F.sum("words")).first()[0] or 1
    out = cells.withColumn("raked", F.col("words") / total)
    wants = {}
    for m in MARGINALS:
        present = cells.groupBy(m).agg(F.sum("words").alias("p")).filter("p > 0")
        target = targets[m]
        if isinstance(target, dict):
            listed = F.coalesce(*[F.when(F.col(m).eqNullSafe(F.lit(v)), F.lit(float(x))) for v, x in target.items()], F.lit(None).cast("double"))
            present = present.withColumn("g", listed)
            s = present.agg(F.coalesce(F.sum("g"), F.lit(0.0)).alias("g"), F.coalesce(F.sum(F.when(F.col("g").isNull(), F.col("p"))), F.lit(0)).alias("r")).first()
            left = max(0.0, 1.0 - s["g"]) if s["r"] else 0.0
            want = F.when(F.col("g").isNotNull(), F.col("g") / F.lit(s["g"] or 1.0) * (1 - left)).otherwise(F.col("p") / F.lit(float(s["r"] or 1)) * F.lit(left if s["g"] else 1.0))
        else:
            power = F.pow(F.col("p") / total, F.lit(float(target)))
            want = power / F.lit(present.agg(F.sum(power)).first()[0] or 1.0)
        wants[m] = stage(present.select(F.col(m).alias("_v"), want.alias("_w")), "wants")
    for _ in range(rounds):
        worst = 0.0
        for m in MARGINALS:
            now = out.groupBy(F.col(m).alias("_m")).agg(F.sum("raked").alias("_n")).filter("_n > 0")
            scale = stage(now.join(wants[m], F.col("_m").eqNullSafe(F.col("_v"))).select("_m", (F.col("_w") / F.col("_n")).alias("_f"), F.abs(F.col("_w") - F.col("_n")).alias("_d")), "scale")
            worst = max(worst, scale.agg(F.max("_d")).first()[0] or 0.0)
            out = out.join(scale, F.col(m).eqNullSafe(F.col("_m")), "left").withColumn("raked", F.col("raked") * F.coalesce("_f", F.lit(1.0))).drop("_m", "_f", "_d")
        out = stage(out, "cells")
        if worst < tolerance:
            break
    return out


def level(words: np.ndarray, factor: np.ndarray, keep: float) -> float:
    """s with sum(words * min(1, s * factor)) = keep * sum(words), or as near as possible."""
    low, high = 0.0, 1.0 / max(factor[factor > 0].min(initial=1.0), 1e-12)
    for _ in range(HALVINGS):
        mid = (low + high) / 2
        if (words * np.minimum(1.0, mid * factor)).sum() < keep * words.sum():
            low = mid
        else:
            high = mid
    return high


def probabilities(rows: DataFrame, targets: dict, keep: float, rounds: int = 200, tolerance: float = 1e-9, most_cells: int = 100_000) -> DataFrame:
    """source, lang, topic, words, factor, probability of every cell of rows (source, lang, topic, words)."""
    spark = rows.sparkSession
    cells = stage(rows.groupBy(*MARGINALS).agg(F.sum("words").alias("words")), "cells")
    if cells.limit(most_cells + 1).count() <= most_cells:
        p = cells.orderBy(*MARGINALS).toPandas()
        words = p["words"].to_numpy(dtype=float)
        own = words / (words.sum() or 1.0)
        factor = np.where(own > 0, rake(p, targets, rounds, tolerance) / np.where(own > 0, own, 1.0), 1.0)
        s = level(words, factor, keep) if len(p) else 0.0
        rows_ = [(*(None if pd.isna(p.at[i, m]) else p.at[i, m] for m in ("source", "lang")), int(p.at[i, "topic"]), int(words[i]), float(factor[i]), float(min(1.0, s * factor[i]))) for i in range(len(p))]
        return spark.createDataFrame(rows_, "source string, lang string, topic int, words bigint, factor double, probability double")
    raked = rake_in_spark(cells, targets, rounds, tolerance)
    total = cells.agg(F.sum("words")).first()[0] or 1
    scaled = stage(raked.withColumn("factor", F.when(F.col("words") > 0, F.col("raked") * total / F.col("words")).otherwise(1.0)), "factors")
    low, high = 0.0, 1.0 / max(scaled.filter("factor > 0").agg(F.min("factor")).first()[0] or 1.0, 1e-12)
    for _ in range(HALVINGS):
        mid = (low + high) / 2
        got = scaled.agg(F.sum(F.col("words") * F.least(F.lit(1.0), F.col("factor") * mid))).first()[0] or 0.0
        low, high = (mid, high) if got < keep * total else (low, mid)
    return scaled.select(*MARGINALS, "words", "factor", F.least(F.lit(1.0), F.col("factor") * high).alias("probability"))


def draw(doc_id: Column, seed: int) -> Column:
    """A uniform number in [0, 1) that depends on doc_id and seed only."""
    return F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)


#: Targets in production: even out sources by the square root of their share, fix the languages, even topics.
TARGETS = {"source": 0.5, "lang": {"en": 0.5, "fr": 0.2, "de": 0.15, "es": 0.15}, "topic": 0.0}


def mix_sources(docs: DataFrame, targets: dict | None = None, keep: float = 0.8, seed: int = 1, most_cells: int = 100_000) -> DataFrame:
    """docs with all columns, and _topic, _words, _weight (double), _probability (double), _sampled (boolean)."""
    out = drawn(docs, targets, keep, seed, most_cells)
    return out.select(*(F.col("_row").getField(c).alias(c) if c != "text" else F.col("text") for c in docs.columns if c not in ADDED), *ADDED)


def drawn(docs: DataFrame, targets: dict | None = None, keep: float = 0.8, seed: int = 1, most_cells: int = 100_000) -> DataFrame:
    """text, _row (struct of the other columns) and ADDED. The user's columns travel in one, so that their names can't clash."""
    packed = docs.select("text", F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("_row"))
    rows = tagged(packed)
    names = [F.col("_row").getField(c).cast("string").alias(c) for c in ("source", "lang")]
    cells = probabilities(tagged(packed.select("text", "_row")).select(*names, F.col("_topic").alias("topic"), F.col("_words").alias("words")), targets or TARGETS, keep, most_cells=most_cells)
    cells = cells.select(*(F.col(c).alias(f"_c_{c}") for c in ("source", "lang", "topic", "factor")), F.col("probability").alias("_probability"))
    same = F.col("_row.source").cast("string").eqNullSafe(F.col("_c_source")) & F.col("_row.lang").cast("string").eqNullSafe(F.col("_c_lang")) & (F.col("_topic") == F.col("_c_topic"))
    joined = rows.join(cells, same, "left").withColumn("_weight", F.when(F.col("_probability") > 0, F.col("_c_factor") / F.col("_probability")).otherwise(0.0))
    return joined.withColumn("_sampled", draw(F.col("_row.doc_id"), seed) < F.col("_probability")).select("text", "_row", *ADDED)


def sample(docs: DataFrame, **more) -> DataFrame:
    """The sampled documents with their columns."""
    return drawn(docs, **more).filter("_sampled").select(*(F.col("_row").getField(c).alias(c) if c != "text" else F.col("text") for c in docs.columns))


def digest(mixed: DataFrame) -> DataFrame:
    return mixed.select("doc_id", "source", "lang", F.col("_topic").alias("topic"), F.col("_words").alias("n_words"), F.col("_probability").alias("probability"), F.col("_weight").alias("weight"), F.col("_sampled").alias("sampled"))
