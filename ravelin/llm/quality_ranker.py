"""Quality classifier: Bradley-Terry ranking learned from preference pairs.

A document's strength is a linear function of features of its text. A pair (preferred, other) has probability
``sigmoid(strength(preferred) - strength(other))``; the weights maximise that over pairs drawn from labelled
documents, by gradient steps on the logistic loss of the feature differences. The threshold is a quantile of the
strengths of the labelled documents, and the score puts that quantile at ``cut``.

Labels are learned from a bounded sample of labelled rows (``most_labelled``, taken by the hash of doc_id);
every document is scored by its whole text. Null and empty texts have the features of an empty text. Without
both labels in the sample there are no pairs: the weights are 0 and every score is 0.5. An own column with the name
quality_score is replaced. Of documents with one id that with the least features is learned from; all are scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm import vectext as V
from ravelin.llm.shared import table

#: Character classes, as bytes: ASCII upper, lower, digit, line feed, other blanks, marks of a sentence, exclamation, symbols, the rest of ASCII, beyond ASCII.
_CLASSES = np.full(256, 9, np.int64)
_CLASSES[:128] = 8
for _i, _s in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "\n", " \t\r\v\f", ".,;:?'\"()-", "!", "#*$%&|<>~^=+_/\\{}[]@`")):
    _CLASSES[[ord(_c) for _c in _s]] = _i
N_FEATURES = 2 * 21


def _repeated(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """In each text, the items that are equal to an earlier one."""
    row = V.rows_of(first)
    order = np.lexsort((values, row))
    same = np.zeros(len(values), bool)
    if len(values) > 1:
        a, b = order[:-1], order[1:]
        same[1:] = (values[a] == values[b]) & (row[a] == row[b])
    return V.sums(same, np.searchsorted(row[order], np.arange(len(first))))


def features(texts: pa.Array) -> np.ndarray:
    """A row of ``N_FEATURES`` for each text: shares between 0 and 1 or logarithms, and their squares."""
    out = []
    for _, _, data, off in V.pieces(texts):
        n = len(off) - 1
        size = np.maximum(np.diff(off), 1)
        shares = np.bincount(np.repeat(np.arange(n), np.diff(off)) * 10 + _CLASSES[data], minlength=10 * n).reshape(n, 10) / size[:, None]
        starts, ends, first = V.spans(data, off)
        words = np.diff(first)
        some = np.maximum(words, 1)
        h = V.hashes(V.fold(data), starts, ends)
        kind = _CLASSES[data]
        begins, finishes = kind[starts], kind[ends - 1] if len(ends) else kind[:0]
        tri, tri_first = V.shingles(h, first, 3)
        row = V.rows_of(first)
        twice = np.zeros(len(h), bool)
        twice[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
        lines = np.bincount(np.repeat(np.arange(n), np.diff(off))[data == 10], minlength=n) + 1
        length = V.sums(ends - starts, first) / some
        columns = [
            *shares.T,
            V.sums(begins == 0, first) / some,
            V.sums(finishes == 5, first) / some,
            V.sums((finishes >= 6) & (finishes <= 8), first) / some,
            V.sums(ends - starts == 1, first) / some,
            V.sums(twice, first) / some,
            _repeated(h, first) / some,
            _repeated(tri, tri_first) / np.maximum(np.diff(tri_first), 1),
            np.minimum(length, 40) / 40,
            np.log1p(words) / 10,
            np.log1p(words / lines) / 10,
            np.minimum(words, 30) / 30,
        ]
        x = np.stack(columns, 1)
        out.append(np.concatenate([x, x * x], 1))
    return np.concatenate(out) if out else np.zeros((0, N_FEATURES))


@dataclass
class Ranker:
    """strength = ((x - mean) / scale) . weights; score = sigmoid(slope * (strength - threshold) + logit(cut))."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float
    cut: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (self.strength(x) - self.threshold) + np.log(self.cut / (1 - self.cut))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def best_quantile(strength: np.ndarray, good: np.ndarray) -> float:
    """The quantile of the strengths that parts the two labels with the fewest errors, each label weighed by its share; ties: the middle one."""
    order = np.argsort(strength, kind="stable")
    s, y = strength[order], good[order]
    lost = np.concatenate([[0], np.cumsum(y)]) / max(y.sum(), 1)
    let_in = 1 - np.concatenate([[0], np.cumsum(1 - y)]) / max((1 - y).sum(), 1)
    wrong = lost + let_in
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    return float(best[len(best) // 2]) / len(s)


def fit(x: np.ndarray, good: np.ndarray, *, cut: float = 0.3, pairs: int = 40_000, steps: int = 400, ridge: float = 1e-4, seed: int = 7) -> Ranker:
    """``x``: a row of features for each labelled text; ``good``: whether it is preferred to those that are not."""
    good = good.astype(bool)
    mean, scale = (x.mean(0), np.maximum(x.std(0), 1e-6)) if len(x) else (np.zeros(N_FEATURES), np.ones(N_FEATURES))
    flat = Ranker(mean, scale, np.zeros(N_FEATURES), 0.0, 1.0, 0.5)
    if good.all() or not good.any():
        return flat
    z = np.clip((x - mean) / scale, -8, 8)
    rng = np.random.default_rng(seed)
    d = z[rng.choice(np.flatnonzero(good), pairs)] - z[rng.choice(np.flatnonzero(~good), pairs)]
    w, m, v = np.zeros(d.shape[1]), np.zeros(d.shape[1]), np.zeros(d.shape[1])
    for t in range(1, steps + 1):
        loss_slope = -1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        g = loss_slope @ d / pairs + ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    s = z @ w
    q = best_quantile(s, good)
    ordered = np.sort(s)
    at = min(max(round(q * len(s)), 1), len(s) - 1)
    threshold = float(ordered[at - 1] + ordered[at]) / 2
    spread = abs(float(np.median(s[good])) - float(np.median(s[~good]))) or 1.0
    return Ranker(mean, scale, w, threshold, 8 / spread, cut)


def held_out(doc_id: Column, folds: int = 5, fold: int = 0) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds == fold


def train(docs: DataFrame, labels: DataFrame, *, most_labelled: int = 20_000, **options) -> Ranker:
    """``labels``: doc_id, quality; rows with nulls are left out. At most ``most_labelled`` of them are used, by hash of doc_id."""
    sample = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most_labelled)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # most_labelled ids at most

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features(b.column("text"))
            yield pa.record_batch([b.column("doc_id"), b.column("quality"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), N_FEATURES).cast(pa.list_(pa.float64()))], ["doc_id", "quality", "x"])

    every = rows.select("doc_id", F.col("quality").cast("int").alias("quality"), "text").mapInArrow(of, "doc_id long, quality int, x array<double>")
    got = every.groupBy("doc_id", "quality").agg(F.min("x").alias("x")).toArrow()  # most_labelled rows at most: of documents with one id, that with the least features
    got = got.sort_by("doc_id")  # the order of the rows does not depend on the tasks
    x = got.column("x").combine_chunks().values.to_numpy().reshape(-1, N_FEATURES) if got.num_rows else np.zeros((0, N_FEATURES))
    return fit(x, got.column("quality").to_numpy() == 1, **options)


def scored(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """All columns of ``docs`` and quality_score."""
    schema = docs.drop("quality_score").withColumn("quality_score", F.lit(0.0)).schema

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = [n for n in b.schema.names if n != "quality_score"]
            yield pa.record_batch([*(b.column(n) for n in kept), pa.array(ranker.score(features(b.column("text"))))], [*kept, "quality_score"])

    return docs.mapInArrow(of, schema)


def op1_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every document, learned from the labels outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(~held_out(F.col("doc_id")))
    return scored(docs, train(docs, labels)).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= 0.3).cast("int").alias("predicted"),
    )
