"""Quality classifier learned from positives and unlabelled text.

A small network minimises the non-negative unbiased risk: with positives P, unlabelled
documents U and the class prior, prior * R+(P) + max(0, R-(U) - prior * R-(P)). Rows
labelled as bad are not used but for the prior, the share of good rows among the labelled
ones of the training folds. Features are rates of a text as a whole: bytes by class and
punctuation mark, pairs of neighbouring classes, shapes and repetition of words and lines.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, in_fold, text_bytes, whole_text
from .phrases import hashed_words

# Bounds of the samples that the classifier is fitted on.
POSITIVES = 8_000
UNLABELLED = 16_000
FOLDS, HELD_OUT = 3, 1
HIDDEN, ROUNDS, RATE = 16, 300, 0.01
CHUNK_BYTES = 1 << 21

_KIND = np.full(256, 7, np.uint8)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 0, 1, 2, 3
_KIND[[9, 11, 12, 13, 32]], _KIND[10] = 4, 5
_KIND[[33, 39, 44, 46, 58, 59, 63]] = 6  # marks of ordinary prose
KINDS = 8
_MARK = np.full(256, 32, np.uint8)
_MARKS = [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]
_MARK[_MARKS] = np.arange(len(_MARKS))
FEATURES = KINDS + len(_MARKS) + KINDS * KINDS + 10


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of features for each text; offsets start at 0. An empty text has zeros."""
    n, size = len(offsets) - 1, np.diff(offsets)
    out = np.zeros((n, FEATURES), np.float32)
    if not len(data):
        return out
    per = 1 / np.maximum(size, 1)[:, None]
    row = np.repeat(np.arange(n), size)
    kind = _KIND[data].astype(np.int64)
    count = np.bincount(row * KINDS + kind, minlength=n * KINDS).reshape(n, -1)
    out[:, :KINDS] = count * per
    marks = np.flatnonzero(_MARK[data] < 32)
    at = KINDS + len(_MARKS)
    marked = np.bincount(row[marks] * len(_MARKS) + _MARK[data[marks]], minlength=n * len(_MARKS)).reshape(n, -1)
    out[:, KINDS:at] = np.sqrt(marked * per)
    same = row[1:] == row[:-1]
    pair = (row[1:] * KINDS + kind[:-1]) * KINDS + kind[1:]
    pairs = np.bincount(pair[same], minlength=n * KINDS * KINDS).reshape(n, -1)
    out[:, at : at + KINDS * KINDS] = np.sqrt(pairs * per)
    at += KINDS * KINDS
    hashes, begin, _ = hashed_words(data, offsets)
    owner = row[begin]
    words = np.bincount(owner, minlength=n)
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (o[1:] != o[:-1])] if len(h) else np.zeros(0, bool)
    distinct = np.bincount(o[new], minlength=n)
    breaks = np.flatnonzero(data == 10)
    edges = np.unique(np.r_[offsets[:-1][size > 0], breaks[np.diff(np.r_[breaks, len(data)]) > 1] + 1])
    edges = edges[edges < len(data)]
    # Lines by the sum of their words' hashes.
    line_of = np.searchsorted(edges, begin, "right") - 1
    sums = np.zeros(len(edges), np.uint64)
    np.add.at(sums, line_of, hashes)
    line_row = row[edges]
    lines = np.bincount(line_row, minlength=n)
    order = np.lexsort((sums, line_row))
    h, o = sums[order], line_row[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (o[1:] != o[:-1])]
    own_lines = np.bincount(o[new], minlength=n)
    out[:, at] = words * per[:, 0]
    out[:, at + 1] = distinct / np.maximum(words, 1)
    out[:, at + 2] = np.log1p(words) / 10
    out[:, at + 3] = (lines - own_lines) / np.maximum(lines, 1)
    out[:, at + 4] = np.log1p(lines) / 10
    # Distinct words against what a text of this length has.
    out[:, at + 5] = np.log1p(distinct) / np.log1p(np.maximum(words, 1))
    out[:, at + 6] = np.log1p(size) / 10
    # Words that repeat the last one or the one before, and distinct pairs of words.
    for lag in (1, 2):
        again = (hashes[lag:] == hashes[:-lag]) & (owner[lag:] == owner[:-lag])
        out[:, at + 6 + lag] = np.sqrt(np.bincount(owner[lag:][again], minlength=n) / np.maximum(words, 1))
    both, o = hashes[1:] * np.uint64(3) + hashes[:-1], owner[1:]
    both, o = both[o == owner[:-1]], o[o == owner[:-1]]
    order = np.lexsort((both, o))
    both, o = both[order], o[order]
    new = np.r_[True, (both[1:] != both[:-1]) | (o[1:] != o[:-1])] if len(both) else np.zeros(0, bool)
    out[:, at + 9] = np.bincount(o[new], minlength=n) / np.maximum(words - 1, 1)
    return out


def batch_features(column: pa.Array) -> np.ndarray:
    data, offsets = text_bytes(column)
    parts = [features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in batches_of(offsets, CHUNK_BYTES)]
    return np.concatenate(parts) if parts else np.zeros((0, FEATURES), np.float32)


class Network:
    """One hidden layer over standardised features; ``logit`` of the probability of label 1."""

    def __init__(self, mean, spread, weights):
        self.mean, self.spread, self.weights = mean, spread, weights

    def logit(self, x):
        w, b, v, c = self.weights
        z = np.clip((x - self.mean) / self.spread, -8, 8)
        return np.tanh(z @ w + b) @ v + c

    def score(self, x):
        return 1 / (1 + np.exp(-np.clip(self.logit(x).astype(float), -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 5) -> Network:
    """Minimise the non-negative risk of the sigmoid loss by Adam over the whole sample.

    The loss is bounded, so an error in the prior moves no more documents than its size.
    """
    both = np.concatenate([positive, unlabelled])
    mean, spread = both.mean(0), both.std(0) + 1e-3
    p, u = (np.clip((x - mean) / spread, -8, 8) for x in (positive, unlabelled))
    rng = np.random.default_rng(seed)
    weights = [rng.normal(0, 1 / np.sqrt(FEATURES), (FEATURES, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), np.zeros(())]
    weights = [w.astype(np.float32) for w in weights]
    first, second = [np.zeros_like(x) for x in weights], [np.zeros_like(x) for x in weights]

    def back(x, slope):
        """Gradients of the loss from its slope at every logit."""
        hidden = np.tanh(x @ weights[0] + weights[1])
        inner = np.outer(slope, weights[2]) * (1 - hidden**2)
        return [x.T @ inner, inner.sum(0), hidden.T @ slope, slope.sum()]

    def logits(x):
        return np.tanh(x @ weights[0] + weights[1]) @ weights[2] + weights[3]

    for step in range(1, ROUNDS + 1):  # the prior is a plain number, so all stays in single precision
        sp, su = 1 / (1 + np.exp(-logits(p))), 1 / (1 + np.exp(-logits(u)))
        # Risk of the unlabelled as bad, less what its good share adds: never below 0.
        if su.mean() >= prior * sp.mean():
            grads = [a + b for a, b in zip(back(p, -2 * prior * sp * (1 - sp) / len(p)), back(u, su * (1 - su) / len(u)), strict=True)]
        else:
            grads = back(p, -prior * sp * (1 - sp) / len(p))
        for k, g in enumerate(grads):
            g = g + 1e-4 * weights[k]
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            weights[k] = weights[k] - np.float32(RATE) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Network(mean.astype(np.float32), spread.astype(np.float32), [w.astype(np.float32) for w in weights])


def sampled(docs: DataFrame, ids: DataFrame, most: int) -> DataFrame:
    """(doc_id, text) of the ``most`` first of ``ids`` in hash order that are in ``docs``; one text where an id repeats."""
    chosen = ids.where(F.col("doc_id").isNotNull()).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.join(F.broadcast(chosen), "doc_id", "left_semi")  # at most ``most`` ids
    return rows.groupBy("doc_id").agg(F.min(whole_text()).alias("text"))


def _feature_rows(docs: DataFrame) -> np.ndarray:
    def run(batches):
        for batch in batches:
            rows = [x.tobytes() for x in batch_features(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["x"])

    found = docs.select("text").mapInArrow(run, "x binary").collect()
    return np.frombuffer(b"".join(sorted(r["x"] for r in found)), np.float32).reshape(-1, FEATURES)


def learn(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT) -> Network | None:
    """Classifier from the training folds' labels and unlabelled texts; None without positives.

    Labels that contradict each other for an id are left out.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~in_fold(folds, held_out))
    rows = rows.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("quality").alias("__q")).where("q = __q")
    good, total = rows.agg(F.sum(F.col("q").cast("long")), F.count("*")).first()
    if not good:
        return None
    positive = _feature_rows(sampled(docs, rows.where("q = 1"), POSITIVES))
    unlabelled = _feature_rows(sampled(docs, docs, UNLABELLED))
    if not len(positive) or not len(unlabelled):
        return None
    return fit(positive, unlabelled, min(max(good / total, 0.01), 0.99))


def _scores(model: Network | None, column: pa.Array) -> np.ndarray:
    return model.score(batch_features(column)) if model else np.full(len(column), 0.5)


def score(docs: DataFrame, model: Network | None, folds: int = FOLDS, held_out: int = HELD_OUT, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; a null text is empty, without a model the score is 0.5."""

    def run(batches):
        for batch in batches:
            s = _scores(model, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s)], ["doc_id", "held_out", "score"])

    rows = docs.select("doc_id", in_fold(folds, held_out).alias("held_out"), whole_text().alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(run, f"doc_id {id_type}, held_out boolean, score double")
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, model: Network | None, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, in one pass without a shuffle."""

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).fill_null("")
            yield batch.filter(pa.array(_scores(model, texts) >= threshold))

    return docs.mapInArrow(run, docs.schema)
