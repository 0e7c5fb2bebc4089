"""Quality classifier by Bradley-Terry ranking: scores of documents learnt from preference pairs.

Every pair holds a document of label 1 and one of label 0. The chance that the first is preferred is the logistic
function of the difference of two scores, which are linear in features of the text, so the weights come from a
logistic loss on differences of features (Newton steps, a ridge term; the optimum is unique). The threshold is a
quantile of the training documents' scores: the share of label 0 among all training labels lies below it. A score is
the logistic function of a document's distance from that quantile, shifted to be ``cut`` there.

The fit uses a bounded sample: for each label the ``MAX_LABELLED`` ids with the smallest digests, whatever the
input's size, and ``PARTNERS`` pairs for each of them. Ids are chosen from the labels alone; only their texts are read
for the fit. Shares of labels are counted over all training labels. Every document is scored.

Defined results: a null or empty text has features of nothing and a score; a null id is hashed as "" for the split,
and is in no training row, nor are rows without a label; an id with both labels takes part with both; of repeated
training ids the row with the least features counts once; repeated rows are scored each; without training labels of
both kinds all scores are the share of label 1 among them (1/2 without any); an empty table gives an empty one; very
long texts are read whole; columns other than id and text, and the labels' id and label, are not read.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import workers_ready

MAX_LABELLED = 10_000  # training ids of each label, at most
PARTNERS = 8  # pairs for each training id
RIDGE = 1e-3  # per pair
STEPS = 60
SEED = 11
SPREAD = 6.0  # standardised features are held within this

#: Bytes of each kind; what remains after deleting them gives their count
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = bytes(range(48, 58))
_MARKS = b"#*$%&|<>"
_POINTS = b".,;:?"
_BASE = 19


def features(text: str | None) -> list[float]:
    """Measures of a whole text: lengths, kinds of characters, repeated words and lines, and its worst line."""
    t = text or ""
    raw = t.encode()
    words = t.split()
    n, size = len(words), len(raw)
    lines = [x for x in t.split("\n") if x and not x.isspace()]
    per_word, per_byte, per_line = 1 / max(n, 1), 1 / max(size, 1), 1 / max(len(lines), 1)

    def count(kind: bytes, of: bytes = raw) -> int:
        return len(of) - len(of.translate(None, kind))

    marks = count(_MARKS)
    worst = max((count(_MARKS + b"!", x) / len(x) for x in (line.encode() for line in lines)), default=0.0) if marks or b"!" in raw else 0.0
    seen = Counter(words)
    upper, lower = count(_UPPER), count(_LOWER)
    return [
        math.log1p(n), math.log1p(size), len(t) * per_word, math.log1p(max(map(len, seen), default=0)),
        marks * per_word, raw.count(b"|") * per_word, raw.count(b"!") * per_word, worst,
        upper * per_byte, upper / (upper + lower + 1), count(_DIGIT) * per_byte, count(_POINTS) * per_word,
        (size - upper - lower) * per_byte, len(seen) * per_word, max(seen.values(), default=0) * per_word,
        sum(map(str.__eq__, words, words[1:])) * per_word, len(set(lines)) * per_line, math.log1p(n * per_line),
        sum(c for w, c in seen.items() if len(w) <= 3) * per_word,
    ]


class Model:
    """Standardisation of features, weights of them and of their squares, and the quantile that scores ``cut``."""

    def __init__(self, middle: np.ndarray, spread: np.ndarray, weights: np.ndarray, quantile: float, cut: float, constant: float | None = None):
        self.middle, self.spread, self.weights, self.quantile, self.cut, self.constant = middle, spread, weights, quantile, cut, constant

    def inputs(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.middle) / self.spread, -SPREAD, SPREAD)
        return np.concatenate([z, z * z], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return (self.inputs(x) * self.weights).sum(axis=1)  # row by row, so that copies score alike in any batch

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = np.clip(self.raw(x) - self.quantile, -700, 700)
        # at the quantile itself exactly cut, so that the threshold takes it in
        return np.where(z >= 0, np.maximum(self.cut, 1 / (1 + (1 - self.cut) / self.cut * np.exp(-z))), 1 / (1 + (1 - self.cut) / self.cut * np.exp(-z)))


def bradley_terry(differences: np.ndarray, ridge: float = RIDGE, steps: int = STEPS) -> np.ndarray:
    """Weights that minimise the mean of log(1 + exp(-w.d)) over preferred-minus-other rows d, plus ridge * |w|^2 / 2."""
    n, k = differences.shape
    w = np.zeros(k)

    def loss(w):
        return np.logaddexp(0, -differences @ w).mean() + ridge * (w @ w) / 2

    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(differences @ w, -700, 700)))  # chance of the pair's other order
        gradient = -(differences.T @ p) / n + ridge * w
        if np.abs(gradient).max() < 1e-10:
            break
        step = np.linalg.solve((differences.T * (p * (1 - p))) @ differences / n + ridge * np.eye(k), gradient)
        size = 1.0
        while (after := loss(w - size * step)) > now and size > 1e-6:
            size /= 2
        if after > now:
            break
        w, now = w - size * step, after
    return w


def pairs(n_good: int, n_bad: int, partners: int = PARTNERS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Rows of label 1 and of label 0 that meet: each row of either label meets ``partners`` of the other."""
    rng = np.random.default_rng(seed)
    good = np.concatenate([np.repeat(np.arange(n_good), partners), rng.integers(n_good, size=n_bad * partners)])
    bad = np.concatenate([rng.integers(n_bad, size=n_good * partners), np.repeat(np.arange(n_bad), partners)])
    return good, bad


def fit(good: np.ndarray, bad: np.ndarray, share_bad: float, cut: float = 0.7) -> Model:
    """A model of feature rows of label 1 and of label 0; share_bad is that of label 0 in all training labels."""
    x = np.concatenate([good, bad])
    weight = np.concatenate([np.full(len(good), (1 - share_bad) / len(good)), np.full(len(bad), share_bad / len(bad))])
    middle = weight @ x
    spread = np.sqrt(weight @ (x - middle) ** 2)
    m = Model(middle, np.where(spread > 1e-12, spread, 1.0), np.zeros(2 * x.shape[1]), 0.0, cut)
    i, j = pairs(len(good), len(bad))
    m.weights = bradley_terry(m.inputs(good)[i] - m.inputs(bad)[j])
    raw = m.raw(x)
    order = np.argsort(raw, kind="stable")
    below = np.cumsum(weight[order])
    at = int(np.searchsorted(below, share_bad * (1 + 1e-12), side="right"))
    # half way to the next score, so that no training row lies on the threshold
    upper = raw[order[min(at, len(raw) - 1)]]
    m.quantile = float((raw[order[max(at - 1, 0)]] + upper) / 2)
    return m


def held_out(id_col: str, fold: int = 4, part: int = 2):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % fold == part


def _feature_rows(rows: DataFrame) -> DataFrame:
    """(key, x) of rows (key, text)."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            x = np.array([features(t) for t in b.column(1).to_pylist()], dtype=np.float64).reshape(-1, _BASE)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * _BASE, pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], ["key", "x"])

    return rows.mapInArrow(run, "key long, x array<double>")


def learn(docs: DataFrame, labels: DataFrame, cut: float = 0.7, id_col: str = "doc_id", text: str = "text", label: str = "quality",
          max_labelled: int = MAX_LABELLED) -> Model:
    workers_ready(docs.sparkSession)
    marks = labels.select(F.col(id_col).cast("long").alias("key"), F.col(label).cast("int").alias("label"))
    marks = marks.where(F.col("key").isNotNull() & F.col("label").isin(0, 1) & ~held_out("key"))
    count = {r["label"]: r["n"] for r in marks.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows
    total = sum(count.values())
    if len(count) < 2:
        return Model(None, None, None, 0.0, cut, count.get(1, 0) / total if total else 0.5)
    by_digest = [F.xxhash64("key"), F.col("key")]
    chosen = [marks.where(F.col("label") == v).distinct().orderBy(*by_digest).limit(max_labelled) for v in (0, 1)]
    chosen = F.broadcast(chosen[0].unionByName(chosen[1]))  # 2 * max_labelled rows of two numbers
    keys = chosen.select("key").distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    rows = _feature_rows(texts.join(F.broadcast(keys), "key", "left_semi"))
    rows = rows.groupBy("key").agg(F.min("x").alias("x")).join(chosen, "key").orderBy("label", "key").collect()
    x, y = np.array([r["x"] for r in rows]).reshape(-1, _BASE), np.array([r["label"] for r in rows])
    if not (y == 1).any() or not (y == 0).any():  # labels of absent documents
        return Model(None, None, None, 0.0, cut, count[1] / total)
    return fit(x[y == 1], x[y == 0], count[0] / total, cut)


def quality_scores(docs: DataFrame, labels: DataFrame, cut: float = 0.7, id_col: str = "doc_id", text: str = "text",
                   label: str = "quality") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; predicted is 1 from ``cut`` on."""
    import pyarrow as pa

    model = learn(docs, labels, cut, id_col, text, label)

    def run(batches):
        for b in batches:
            x = np.array([features(t) for t in b.column(2).to_pylist()], dtype=np.float64).reshape(-1, _BASE)
            s = model.scores(x)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= model.cut).astype(np.int32))],
                                             ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
