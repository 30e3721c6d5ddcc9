"""Toxicity by a support vector machine over a gapped subsequence string kernel with Nyström landmarks.

Kernel of two words: every triple of letters that both hold in order, within `SPAN` letters and possibly with others in
between, adds decay^(span in one + span in the other); the sum is divided by a norm of each word's length. Words are bounded by
"^" and "$", and count in lower case. So an insult with letters put in or left out keeps most of its value.

A sentence is as toxic as its most toxic word (also when spelt with spaces or signs between the letters). Landmark words are
those that stand out in toxic labelled sentences, and ordinary ones. The Nyström map whitens a word's kernel values
against the landmarks; a linear machine with squared hinge loss learns on it, in rounds that pick each toxic
sentence's worst word and the clean sentences' hardest words. As the kernel is a product of explicit triple weights, the
machine collapses into one table of triple weights, by which all words are scored.

Edge cases: null and empty texts have the lowest margin; words over SPLIT letters are scored in overlapping pieces; labels
that are null don't count, of several for a document toxic counts; without both classes of labels every score is 0; texts alike are one row
of the sample, toxic if one of them is; equal scores share a verdict; repeated rows each keep their result; a text longer than a chunk is
scored alone and whole; an empty table gives no rows;
other columns are ignored, and so are labels, lang, source and doc_id in a score.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

DECAY, SPAN, SPLIT, CODES = 0.7, 6, 20, 64
REMEMBERED_WORDS = 250_000
_SPACED = re.compile(r"(?<!\S)(?:\w[ .*_-]){2,}\w(?!\w)")


def letters(words: list[str]) -> np.ndarray:
    """The words of one length as a matrix of letter codes below CODES, with their bounds."""
    points = np.array([list(map(ord, w)) for w in words], dtype=np.int64).reshape(len(words), -1)
    codes = np.where((points >= 97) & (points < 123), points - 96, np.where((points >= 48) & (points < 58), points - 21, 39 + points % 25))
    return np.pad(codes, ((0, 0), (1, 1)), constant_values=((0, 0), (37, 38)))


def triples(n: int) -> Iterator[tuple[int, int, int]]:
    for i in range(n - 2):
        for k in range(i + 2, min(n, i + SPAN + 1)):
            for j in range(i + 1, k):
                yield i, j, k


def norm(n: int) -> float:
    return float(np.sqrt(sum(DECAY ** (2 * (k - i)) for i, _, k in triples(n)))) or 1.0


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse triple weights of the words: word, triple, weight (already divided by the norm)."""
    rows, cols, vals = [], [], []
    for n, at, c in by_length(words):
        scale = norm(n)
        for i, j, k in triples(n):
            rows.append(at)
            cols.append(c[:, i] * CODES * CODES + c[:, j] * CODES + c[:, k])
            vals.append(np.full(len(at), DECAY ** (k - i) / scale))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(vals)


def by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    size = np.array([len(w) for w in words])
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        yield int(n) + 2, at, letters([words[i] for i in at])


def collapse(landmarks: list[str], weights: np.ndarray) -> np.ndarray:
    """The table of triple weights of a weighted sum of landmarks."""
    row, col, val = features(landmarks)
    return np.bincount(col, weights=val * weights[row], minlength=CODES**3).astype(np.float32)


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Kernel values, a column for each landmark."""
    lr, lc, lv = features(landmarks)
    used, pos = np.unique(lc, return_inverse=True)
    table = np.zeros((len(used) + 1, len(landmarks)))
    np.add.at(table, (pos, lr), lv)
    out = np.zeros((len(words), len(landmarks)))
    for lo in range(0, len(words), 32):  # in blocks, as each triple spreads over all landmarks
        row, col, val = features(words[lo : lo + 32])
        at = np.minimum(np.searchsorted(used, col), len(used) - 1) if len(used) else col
        hit = used[at] == col if len(used) else np.zeros(len(col), bool)
        np.add.at(out, lo + row[hit], val[hit, None] * table[at[hit]])
    return out


def table_scores(words: list[str], table: np.ndarray) -> np.ndarray:
    """The machine's value for words of at most SPLIT letters."""
    out = np.zeros(len(words), np.float32)
    # In blocks, as a word takes some hundred numbers meanwhile.
    for n, at, c in ((n, lo + at, c) for lo in range(0, len(words), 8192) for n, at, c in by_length(words[lo : lo + 8192])):
        scale, total = norm(n), np.zeros(len(at), np.float32)
        pair = {(i, j): c[:, i] * (CODES * CODES) + c[:, j] * CODES for i in range(n) for j in range(i + 1, min(n, i + SPAN))}
        for i, j, k in triples(n):
            total += np.float32(DECAY ** (k - i) / scale) * table[pair[i, j] + c[:, k]]
        out[at] = total
    return out


def pieces(word: str) -> list[str]:
    """What of a word is scored: itself, its letters and digits alone if it holds signs, in overlapping pieces if long."""
    out = []
    for w in {word, "".join(filter(str.isalnum, word))}:
        if len(w) <= SPLIT:
            out += [w] if w else []
        else:
            out += [w[i : i + SPLIT] for i in range(0, len(w) - SPLIT // 2, SPLIT // 2)]
    return out


def words_of(text: str) -> set[str]:
    low = text.lower()
    return {*low.split(), *("".join(filter(str.isalnum, m)) for m in _SPACED.findall(low))}


def word_scores(words: list[str], table: np.ndarray) -> np.ndarray:
    cut = [pieces(w) for w in words]
    flat = [p for c in cut for p in c]
    if not flat:
        return np.full(len(words), -np.inf)
    scores, out = table_scores(flat, table), np.full(len(words), -np.inf)
    np.maximum.at(out, np.repeat(np.arange(len(words)), [len(c) for c in cut]), scores)
    return out


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 10.0) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss, by Newton steps on the rows inside the margin."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(x1.shape[1]), np.eye(x1.shape[1])
    ridge[-1, -1] = 1e-3
    for step in range(60):
        own = y * (x1 @ w) < 1
        cx = x1[own] * (c * weight[own])[:, None]
        new = np.linalg.solve(ridge + cx.T @ x1[own], cx.T @ y[own])
        if np.allclose(new, w, atol=1e-6):
            break
        w = new if step < 20 else 0.5 * (w + new)
    return w[:-1], float(w[-1])


def fit(texts: list[str], toxic: np.ndarray, landmarks: int = 160, hard: int = 4000, rounds: int = 4) -> tuple[np.ndarray, float, float] | None:
    """The table of triple weights, and slope and offset of the probability of a sentence's margin."""
    if not toxic.any() or toxic.all():
        return None
    # Each text as the places of its words in the vocabulary: sets of the words themselves would hold a word once a text.
    place: dict[str, int] = {}
    found = [np.array([place.setdefault(p, len(place)) for p in {p for w in words_of(t) for p in pieces(w)}], np.int32) for t in texts]
    vocabulary = sorted(place)
    moved = np.empty(len(place), np.int32)
    moved[[place[w] for w in vocabulary]] = np.arange(len(place))
    members = [np.sort(moved[f]) for f in found]
    number = {w: i for i, w in enumerate(vocabulary)}
    del place, found
    n_bad, n_good = int(toxic.sum()), int((~toxic).sum())
    counts = lambda kind: np.bincount(np.concatenate([m for m, t in zip(members, toxic, strict=True) if t == kind]), minlength=len(vocabulary)).astype(float)
    a, b = counts(True), counts(False)
    stands_out = (a / n_bad - b / n_good) / np.sqrt((a + b + 1) / (n_bad + n_good))
    ranked = np.argsort(-stands_out, kind="stable")
    rng = np.random.default_rng(11)
    clean_words = np.flatnonzero(b > 0)
    plain = rng.choice(clean_words, min(landmarks // 4, len(clean_words)), replace=False)
    marks = [vocabulary[i] for i in dict.fromkeys([*ranked[: landmarks - len(plain)].tolist(), *plain.tolist()])]
    gram = kernel(marks, marks)
    values, vectors = np.linalg.eigh(gram)
    kept = values > 1e-6 * values[-1]
    white = vectors[:, kept] / np.sqrt(values[kept])

    strong = np.array([number[w] for w in explaining([{vocabulary[i] for i in m.tolist()} for m, t in zip(members, toxic, strict=True) if t], [vocabulary[i] for i in ranked.tolist() if a[i] >= 3 and a[i] / n_bad > 20 * b[i] / n_good])], np.int64)
    score = stands_out.copy()
    chosen_good = rng.choice(clean_words, min(hard, len(clean_words)), replace=False)
    table = None
    for r in range(rounds):
        worst = np.array([m[score[m].argmax()] for m, t in zip(members, toxic, strict=True) if t and len(m)])
        pos, times = np.unique(np.concatenate([worst, strong]), return_counts=True)
        times = np.maximum(times, np.minimum(a[pos], 20))
        if r:
            top = clean_words[np.argsort(-score[clean_words], kind="stable")[:hard]]
            chosen_good = np.unique(np.concatenate([chosen_good, top]))
        neg = np.setdiff1d(chosen_good, pos)
        rows = np.concatenate([pos, neg])
        y = np.concatenate([np.ones(len(pos)), -np.ones(len(neg))])
        # A clean word weighs by the clean sentences that hold it, a toxic one by the sentences that chose it.
        weight = np.concatenate([np.minimum(times, 20), np.minimum(1 + np.log1p(b[neg]), 10)]) / np.sqrt(len(rows))
        w, _ = svm(kernel([vocabulary[i] for i in rows], marks) @ white, y, weight)
        table = collapse(marks, white @ w)
        score = table_scores(vocabulary, table).astype(float)
    margin = np.array([score[m].max() if len(m) else score.min() for m in members])
    slope, offset = logistic(margin, toxic)
    return table, slope, offset


def explaining(sets: list[set[str]], words: list[str], least: int = 3) -> list[str]:
    """Of words in falling order of suspicion, those that a twentieth of the toxic sentences hold, or
    `least` which no word before explains."""
    holders: dict[str, list[int]] = {w: [] for w in words}
    for i, s in enumerate(sets):
        for w in s & holders.keys():
            holders[w].append(i)
    explained, out = np.zeros(len(sets), bool), []
    for w in words:
        if (~explained[holders[w]]).sum() >= least or len(holders[w]) >= 0.05 * len(sets):
            out.append(w)
            explained[holders[w]] = True
    return out


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Probability of a margin, by Newton steps with a slight ridge."""
    mean, std = x.mean(), x.std() or 1.0
    z, w = np.stack([(x - mean) / std, np.ones(len(x))], axis=1), np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag([1e-2, 1e-9])
        step = np.linalg.solve(h, z.T @ (y - p) - np.array([1e-2, 0]) * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / std), float(w[1] - w[0] * mean / std)


class Scorer:
    """Scores sentences; remembers the values of recent words."""

    def __init__(self, model):
        self.table, self.slope, self.offset = model
        self.known: dict[str, float] = {}

    def margins(self, texts: list[str]) -> np.ndarray:
        sets = [words_of(t) for t in texts]
        new = list({w for s in sets for w in s if w not in self.known})
        if len(self.known) + len(new) > REMEMBERED_WORDS:
            self.known.clear()
            new = list({w for s in sets for w in s})
        self.known.update(zip(new, word_scores(new, self.table).tolist(), strict=True))
        known = self.known
        return np.array([max([known[w] for w in s], default=-np.inf) for s in sets])

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(texts) + self.offset, -40, 40)))


_scorers: dict[str, Scorer] = {}


def scores_of(sent, key: str, texts: list[str | None]) -> np.ndarray:
    """Inside a task: the scores by the broadcast model, whose scorer the worker keeps."""
    if sent.value is None:
        return np.zeros(len(texts))
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = Scorer(sent.value)
    return _scorers[key].scores([t or "" for t in texts])


def training_rows(docs: DataFrame, labels: DataFrame, rows: int, chars: int) -> DataFrame:
    """text, toxic: the labelled documents of lowest hash, `rows` toxic and twice as many clean ones, outside the held-out fold. Whole texts only, of
    at most `chars` characters."""
    marks = labels.select("doc_id", F.col("toxic").alias("_t")).filter("_t is not null").groupBy("doc_id").agg(F.max("_t").alias("_t"))
    fold = docs.select("doc_id", "text").filter(~held_out()).filter(F.length("text").between(1, chars)).withColumn("_h", F.xxhash64("text"))
    # The rows are chosen by id and hash alone; only the chosen ones' texts are then fetched.
    light = fold.select("doc_id", "_h").join(marks, "doc_id").groupBy("_h").agg(F.min("doc_id").alias("doc_id"), F.max("_t").alias("_t"))
    first = lambda t, n: common.lowest(light.filter(F.col("_t") == t), F.col("_h"), n)
    wanted = first(1, rows).unionByName(first(0, 2 * rows))
    return fold.join(F.broadcast(wanted), ["doc_id", "_h"]).dropDuplicates(["_h"]).select("text", (F.col("_t") == 1).alias("toxic"))


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Inside the one task that holds the whole sample: the fitted model as a row, or no row."""
    texts: list[str] = []
    toxic: list[bool] = []
    for batch in batches:
        texts += batch.column(0).to_pylist()
        toxic += batch.column(1).to_pylist()
    model = fit(texts, np.asarray(toxic, dtype=bool)) if texts else None
    if model is not None:
        yield pa.RecordBatch.from_arrays([pa.array([model[0].tobytes()], pa.binary()), pa.array([model[1]]), pa.array([model[2]])], ["weights", "slope", "shift"])


def train(docs: DataFrame, labels: DataFrame, sample_rows: int, sample_chars: int) -> tuple:
    """The broadcast model and its key. It is fitted in one task on at most 3 * sample_rows labelled texts of at most
    sample_chars characters each; only the model (1 MB) reaches the driver."""
    sample = training_rows(docs, labels, sample_rows, sample_chars).repartition(1)
    found = sample.mapInArrow(lambda batches: common.tidy(fitted(batches)), "weights binary, slope double, shift double").collect()
    model = (np.frombuffer(found[0].weights, np.float32), found[0].slope, found[0].shift) if found else None
    return docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex


def score(docs: DataFrame, labels: DataFrame, sample_rows: int = 1500, sample_chars: int = 8000) -> DataFrame:
    """doc_id, held_out, score, predicted for every whole text."""
    sent, key = train(docs, labels, sample_rows, sample_chars)

    def work(chunk: pa.RecordBatch) -> pa.RecordBatch:
        scores = scores_of(sent, key, chunk.column(1).to_pylist())
        return pa.RecordBatch.from_arrays([chunk.column(0), chunk.column(2), pa.array(scores)], ["doc_id", "held_out", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return common.chunk_rows(batches, work)

    rows = common.text_rows(docs, held_out().alias("held_out"))
    out = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def clean(docs: DataFrame, labels: DataFrame, sample_rows: int = 1500, sample_chars: int = 8000) -> DataFrame:
    """The documents, with all their columns, whose score is below 0.5."""
    sent, key = train(docs, labels, sample_rows, sample_chars)

    def work(chunk: pa.RecordBatch) -> pa.RecordBatch:
        texts = chunk.column(chunk.schema.get_field_index("text")).to_pylist()
        return chunk.filter(pa.array(scores_of(sent, key, texts) < 0.5))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return common.chunk_rows(batches, work)

    return docs.mapInArrow(run, docs.schema)
