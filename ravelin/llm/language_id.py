"""Language identification: averaged hashed subword embeddings and a linear softmax.

The subwords of a text are the byte 2-, 3- and 4-grams of its folded letters, with a mark where a word begins and
ends, hashed into ``BUCKETS`` buckets. A text's vector is the average of the embeddings of its subwords, and a
linear layer with softmax on it gives the probabilities. Embeddings and layer are learned by stochastic gradient
descent in numpy from a bounded, stratified sample of labelled documents (``most_labelled``); the temperature of the
softmax is calibrated on a part of the sample that is not trained on, and so is the probability under which a
prediction counts as rejected.

As the layer is linear, averaging and layer are one table (bucket, language) when texts are predicted: every subword
of the whole text is looked up in it.

Null texts and texts without a letter are ``und`` with score 0, as is every text if there is no labelled document. Own
columns named lang_pred, score or accepted are replaced. Of more than ``most_labelled`` languages the most frequent are learned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ravelin.llm import vectext as V
from ravelin.llm.shared import stored, table

BUCKETS = 1 << 16
#: Bytes that subwords are made of: ASCII letters and all bytes beyond ASCII; all else is a gap, as one blank.
_GAP = np.ones(256, bool)
_GAP[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False


def subwords(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, rows): one item for each subword of each text."""
    low = V.fold(data)
    low[_GAP[data]] = 32
    # a gap between the texts, so that no subword has bytes of two of them
    n = len(off) - 1
    rows = np.repeat(np.arange(n), np.diff(off) + 2)
    padded = np.full(len(low) + 2 * n, 32, np.uint32)
    padded[np.arange(len(low)) + 2 * np.repeat(np.arange(n), np.diff(off)) + 1] = low
    keep = np.ones(len(padded), bool)
    keep[1:] = (padded[1:] != 32) | (padded[:-1] != 32) | (rows[1:] != rows[:-1])  # runs of gaps are one gap
    b, rows = padded[keep], rows[keep]
    out, of = [], []
    for size in (2, 3, 4):
        if len(b) < size:
            continue
        same = rows[size - 1 :] == rows[: len(rows) - size + 1]
        code = np.full(len(same), size, np.uint32)
        for i in range(size):
            code = code * np.uint32(0x01000193) ^ b[i : i + len(same)]
        inner = np.ones(len(same), bool)
        for i in range(1, size - 1):
            inner &= b[i : i + len(same)] != 32  # gaps only at the ends
        inner &= same
        code = code[inner] * np.uint32(0x85EBCA6B)
        out.append(code >> np.uint32(16))
        of.append(rows[: len(same)][inner])
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out).astype(np.int64), np.concatenate(of)


@dataclass
class Model:
    languages: list[str]
    #: (BUCKETS, languages): embeddings times layer
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    least: float


def logits(texts: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(a row of logits for each text, whether it has a letter)."""
    k = len(model.languages)
    columns = [np.ascontiguousarray(model.table[:, j]) for j in range(k)]
    out, letters = [np.zeros((0, k))], [np.zeros(0, bool)]
    for _, _, data, off in V.pieces(texts):
        n = len(off) - 1
        buckets, rows = subwords(data, off)
        count = np.bincount(rows, minlength=n)
        sums = np.stack([np.bincount(rows, c[buckets], minlength=n) for c in columns], 1) if k else np.zeros((n, 0))
        out.append(sums / np.maximum(count, 1)[:, None] + model.bias)
        row = np.repeat(np.arange(n), np.diff(off))
        has = np.bincount(row[~_GAP[data] & (data < 128)], minlength=n) > 0
        for i in np.flatnonzero(~has & (np.bincount(row[data >= 128], minlength=n) > 0)):
            has[i] = any(map(str.isalpha, data[off[i] : off[i + 1]].tobytes().decode()))
        letters.append(has)
    return np.concatenate(out), np.concatenate(letters)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True)) if z.size else z
    return e / e.sum(1, keepdims=True)


def fit(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, languages: list[str], *, size: int = 16, epochs: int = 8, rate: float = 0.5, reject: float = 0.01, seed: int = 3) -> Model:
    """``docs``: (buckets, counts) of each; ``labels``: an index into ``languages`` for each."""
    k, rng = len(languages), np.random.default_rng(seed)
    emb = rng.uniform(-1, 1, (BUCKETS, size)) / size
    layer, bias = np.zeros((size, k)), np.zeros(k)
    order = rng.permutation(len(docs))
    apart = order[: len(docs) // 5]  # for the calibration
    train = order[len(docs) // 5 :]
    steps = max(epochs * len(train), 1)
    t = 0
    for _ in range(epochs):
        for i in rng.permutation(train):
            at, share = docs[i]
            lr = rate * (1 - t / steps)
            t += 1
            if not len(at):
                continue
            h = share @ emb[at]
            p = softmax((h @ layer + bias)[None])[0]
            p[labels[i]] -= 1
            back = layer @ p
            layer -= lr * np.outer(h, p)
            bias -= 0.1 * lr * p
            emb[at] -= lr * len(at) ** 0.5 * share[:, None] * back
    flat = emb @ layer
    held = apart if len(apart) else train
    z = np.stack([docs[i][1] @ flat[docs[i][0]] + bias for i in held]) if len(held) else np.zeros((0, k))
    y = labels[held]
    best, temperature = np.inf, 1.0
    for t in 2.0 ** np.arange(-3, 4.5, 0.5):  # the temperature with the least loss
        if len(y) and (loss := -np.log(np.maximum(softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean()) < best:
            best, temperature = loss, t
    top = softmax(z / temperature).max(1) if len(y) else np.zeros(0)
    least = float(np.quantile(top, reject)) if len(top) else 0.0
    return Model(languages, flat.astype(np.float32), bias, float(temperature), least)


def train(docs: DataFrame, *, most_labelled: int = 3000) -> Model:
    """``docs``: text, lang (labelled where neither is null). About ``most_labelled`` different texts, as many of each language as there are, at most.

    Texts are chosen by hashes alone; the tasks that hold them make their subword counts, and only these travel.
    """
    labelled = docs.select("text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("text") != "")).withColumn("hash", F.xxhash64("text"))
    counts = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_labelled)
    languages = F.count("*").over(Window.partitionBy())  # a row for each language
    share = counts.select("lang", F.least(F.lit(1.0), most_labelled / languages / F.col("count")).alias("share"))
    chance = F.pmod("hash", F.lit(1 << 32)) / 2.0**32
    slim = labelled.select("hash", "lang").join(F.broadcast(share), "lang").where(chance < F.col("share")).select("hash", "lang").distinct()
    slim = stored(slim.orderBy("hash", "lang").limit(2 * most_labelled), "sample")
    sample = labelled.join(F.broadcast(slim), ["hash", "lang"]).select("text", "lang", "hash")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, end, data, off in V.pieces(b.column("text")):
                buckets, rows = subwords(data, off)
                both, counts = np.unique(rows * BUCKETS + buckets, return_counts=True)
                edges = np.searchsorted(both // BUCKETS, np.arange(end - row + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(edges), pa.array(x)) for x in ((both % BUCKETS).astype(np.int32), counts.astype(np.int32))]
                yield pa.record_batch([b.column("lang").slice(row, end - row), b.column("hash").slice(row, end - row), *lists], ["lang", "hash", "buckets", "counts"])

    bags = sample.mapInArrow(of, "lang string, hash long, buckets array<int>, counts array<int>").dropDuplicates(["hash", "lang"])
    got = bags.toPandas().sort_values(["hash", "lang"])
    languages = sorted(set(got["lang"]))
    share_of = lambda c: np.asarray(c, np.float64) / max(np.sum(c), 1)
    bags = [(np.asarray(b, np.int64), share_of(c)) for b, c in zip(got["buckets"], got["counts"], strict=True)]
    return fit(bags, np.array([languages.index(x) for x in got["lang"]], np.int64), languages)


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` and lang_pred, score, accepted."""
    added = {"lang_pred": F.lit(""), "score": F.lit(0.0), "accepted": F.lit(True)}
    schema = docs.drop(*added).withColumns(added).schema
    names, added = pa.array([*model.languages, "und"]), list(added)
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)  # a table of fixed size: BUCKETS rows

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            z, letters = logits(b.column("text"), m)
            p = softmax(z / m.temperature) if m.languages else np.zeros((len(z), 1))
            best = np.where(letters & bool(m.languages), p.argmax(1), len(m.languages))
            score = np.where(best < len(m.languages), p.max(1), 0.0)
            kept = [n for n in b.schema.names if n not in added]
            yield pa.record_batch([*(b.column(n) for n in kept), names.take(pa.array(best)), pa.array(score), pa.array(score >= max(m.least, 1e-9))], [*kept, *added])

    return docs.mapInArrow(of, schema)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the documents outside the held-out quarter."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    out = predicted(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted")
