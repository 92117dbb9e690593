"""Cross-entropy difference: every document's mean loss per word under a target model less that under a background model.

Both models are bigram models over one vocabulary. The target model counts the documents that are labelled as
targets, the background model all documents. With K(v) the number of vocabulary words that follow v,

    p(w | v) = (n(v, w) + prior * p(w)) / (K(v) + prior)

where n(v, w) is counted for words v and w of the vocabulary (v may also be the start of a text) and is 0 for other
words. p(w) = (n(w) + 1) / (N + V + 1) for the V words of the vocabulary; all other words share what is left equally.
So p(. | v) sums to 1 over all words. The vocabulary has the ``vocabulary`` most frequent words of all documents; the
bigrams of them are counted exactly, however many there are.

A document is scored without its own counts: they are taken from n(v, w) and K(v), so that no model knows a document
by heart. A document that stands twice is scored with the counts of its copy. The score is target loss - background
loss: the lower, the more like the target.

1. Words are counted; the vocabulary goes to all tasks (``vocabulary`` rows).
2. K(v) and the bigrams of the ``HEAD`` most frequent words are counted; those that make up 2**-18 of all words or
   more go to all tasks (2**18 rows at most), which score them at once.
3. Tasks send on (bigram, document, times) of all other bigrams. In the partition of a bigram they are summed up, and
   what other documents add to a bigram's count is a correction to the document's loss. A bigram that no other
   document has needs none, and sends nothing on. No bigram outside the head has more than one in ``HEAD`` words.
4. Corrections are summed by document.

Documents are known by a 64-bit hash of doc_id and text, words by 64-bit hashes. Null and empty texts have 0 words and
score 0. Equal rows have equal scores. Without target documents every word of the vocabulary has the same p(w | v).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ravelin.llm import vectext as V
from ravelin.llm.shared import drop_table, stored, table

HEAD = 2048
#: Bytes of text at a time.
PIECE = 1 << 19


def words_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = V.fold(data)
    starts, ends, first = V.spans(low, off)
    return V.hashes(low, starts, ends), first


class Tally:
    """Sums of counts by key, within a task; of at most about ``most`` keys at a time."""

    def __init__(self, most: int = 1 << 21):
        self.most, self.held, self.size = most, [], 0

    def add(self, key: np.ndarray, *counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The sums that have to go out, as there are too many keys."""
        self.held.append((key, *counts))
        self.size += len(key)
        if self.size > self.most:
            self._merge()
            if self.size > self.most // 2:
                yield from self.flush()

    def _merge(self) -> None:
        key, *counts = (np.concatenate(x) for x in zip(*self.held, strict=True))
        u, back = np.unique(key, return_inverse=True)
        self.held = [(u, *(np.bincount(back, c, len(u)).astype(np.int64) for c in counts))]
        self.size = len(u)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            self._merge()
            key, *counts = self.held[0]
            yield pa.record_batch([pa.array(key.view(np.int64)), *map(pa.array, counts)], ["key", "target", "every"])
        self.held, self.size = [], 0


@dataclass
class Shared:
    """The vocabulary by falling frequency; the id of a word is its place, -1 for other words, ``size`` for the start of a text."""

    hashes: np.ndarray
    #: rows: target, every; a column for each id, and a last one for all other words together
    words: np.ndarray
    #: how many other words there are
    others: int

    def __post_init__(self):
        self.order = np.argsort(self.hashes)
        self.sorted = self.hashes[self.order]

    @property
    def size(self) -> int:
        return len(self.hashes)

    def ids(self, h: np.ndarray) -> np.ndarray:
        if not self.size:
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.sorted, h), self.size - 1)
        return np.where(self.sorted[at] == h, self.order[at], -1)

    def shares(self) -> np.ndarray:
        """p(w) of each id and, last, of each single other word; a row for each model."""
        p = (self.words + 1) / (self.words.sum(1, keepdims=True) + self.size + 1)
        p[:, -1] /= max(self.others, 1)
        return p if self.others or not self.size else p / (1 - p[:, -1:])

    def key(self, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return before * (self.size + 1) + ids

    def pairs(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words before, whether both are counted)."""
        before = np.empty_like(ids)
        before[1:] = ids[:-1]
        before[first[:-1][np.diff(first) > 0]] = self.size
        return before, (before >= 0) & (ids >= 0)


@dataclass
class Model:
    """K(v) of each id and the start, and the counts of the head's bigrams by key; rows: target, every."""

    follows: np.ndarray
    keys: np.ndarray
    counts: np.ndarray

    def head(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether it is in the head, its place there)."""
        if not len(self.keys):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.keys[at] == keys, at


def _marked(batch: pa.RecordBatch, at: int, end: int) -> np.ndarray:
    return batch.column("target").slice(at, end - at).to_numpy(zero_copy_only=False).astype(bool)


def vocabulary(docs: DataFrame, *, vocabulary: int = 1 << 16) -> Shared:
    """The most frequent words of ``docs`` (text, target) with their counts."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for b in batches:
            for at, end, data, off in V.pieces(b.column("text"), PIECE):
                h, first = words_of(data, off)
                yield from tally.add(h, np.repeat(_marked(b, at, end), np.diff(first)).astype(np.int64), np.ones(len(h), np.int64))
        yield from tally.flush()

    rows = docs.mapInArrow(of, "key long, target long, every long")
    counts = stored(rows.groupBy("key").agg(F.sum("target").alias("target"), F.sum("every").alias("every")), "words")
    top = counts.orderBy(F.desc("every"), "key").limit(vocabulary).toPandas()
    total = counts.agg(F.count("*"), F.coalesce(F.sum("target"), F.lit(0)), F.coalesce(F.sum("every"), F.lit(0))).first()
    words = top[["target", "every"]].to_numpy().T.astype(np.float64).reshape(2, -1)
    drop_table(counts)
    rest = np.array(total[1:], float)[:, None] - words.sum(1, keepdims=True)
    return Shared(top["key"].to_numpy().astype(np.int64).view(np.uint64), np.concatenate([words, rest], 1), total[0] - len(top))


def counted(docs: DataFrame, shared: Shared, *, head: int = HEAD, part: int = 18) -> Model:
    """K(v), and the bigrams of the ``head`` most frequent words that are one in 2**part words, of ``docs`` (text, target)."""
    sent = docs.sparkSession.sparkContext.broadcast(shared)  # ``vocabulary`` rows
    size = shared.size

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, tally = sent.value, Tally()
        follows = np.zeros((2, size + 1), np.int64)
        for b in batches:
            for at, end, data, off in V.pieces(b.column("text"), PIECE):
                h, first = words_of(data, off)
                ids = s.ids(h)
                before, both = s.pairs(ids, first)
                chosen = np.repeat(_marked(b, at, end), np.diff(first))
                for row, some in zip(follows, (both & chosen, both), strict=True):
                    row += np.bincount(before[some], minlength=size + 1)
                both &= (ids < head) & ((before < head) | (before == size))
                yield from tally.add(s.key(before[both], ids[both]), chosen[both].astype(np.int64), np.ones(int(both.sum()), np.int64))
        some = np.flatnonzero(follows[1])
        yield from tally.flush()
        yield pa.record_batch([pa.array(-1 - some), *(pa.array(x[some]) for x in follows)], ["key", "target", "every"])

    rows = docs.mapInArrow(of, "key long, target long, every long").groupBy("key").agg(F.sum("target").alias("target"), F.sum("every").alias("every"))
    least = shared.words[1].sum() / 2**part
    got = rows.where((F.col("key") < 0) | (F.col("every") >= F.lit(float(least)))).toPandas().sort_values("key")
    key, counts = got["key"].to_numpy().astype(np.int64), got[["target", "every"]].to_numpy().T.astype(np.float64).reshape(2, -1)
    follows = np.zeros((2, size + 1))
    follows[:, -1 - key[key < 0]] = counts[:, key < 0]
    return Model(follows, key[key >= 0], counts[:, key >= 0])


@dataclass
class Scorer:
    shared: Shared
    model: Model
    prior: float

    def __post_init__(self):
        self.share = self.prior * self.shared.shares()

    def looked(self, target: np.ndarray, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
        """(words of each text, its two losses with the head's bigrams alone, (text, key, times) of each other bigram of a text)."""
        s, m = self.shared, self.model
        h, first = words_of(data, off)
        n, row, ids = np.diff(first), V.rows_of(first), s.ids(h)
        before, both = s.pairs(ids, first)
        share = self.share[:, ids]  # -1 is the last column
        known = np.flatnonzero(before >= 0)
        # the document's own counts: of words after v, where they are counted, and of pairs
        context = row[known] * (s.size + 1) + before[known]
        u, back = np.unique(context, return_inverse=True)
        own = np.zeros(len(ids))
        own[known] = np.bincount(back, both[known], len(u))[back]
        follows = np.where(before >= 0, m.follows[:, before], 0)
        follows = np.maximum(follows - np.stack([own * target[row], own]), 0)
        some = np.flatnonzero(both)
        keys = s.key(before[some], ids[some])
        wide = (s.size + 1) ** 2
        u, back, times = np.unique(row[some] * wide + keys, return_inverse=True, return_counts=True)
        in_head, at = m.head(keys)
        seen = np.zeros((2, len(ids)))
        mine, hit = times[back], some[in_head]
        seen[:, hit] = np.maximum(m.counts[:, at[in_head]] - np.stack([mine[in_head] * target[row[hit]], mine[in_head]]), 0)
        loss = np.log(follows + self.prior) - np.log(seen + share)
        text, key = u // wide, u % wide
        rest = ~m.head(key)[0]
        return n, np.stack([V.sums(x, first) for x in loss]), (text[rest], key[rest], times[rest])


def scored(docs: DataFrame, shared: Shared, model: Model, *, prior: float = 100.0) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, loss_difference (per word) for each row of ``docs`` (doc_id, text, target), which are those that were counted."""
    sent = docs.sparkSession.sparkContext.broadcast(Scorer(shared, model, prior))  # bounded, as said above
    keyed = docs.select(F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.coalesce("text", F.lit(""))).alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), "text", "target")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, end, data, off in V.pieces(b.column("text"), PIECE):
                target = _marked(b, at, end)
                _, _, (text, key, times) = sent.value.looked(target, data, off)
                # the sign tells targets, which keeps the rows slim
                signed = np.where(target[text], -times, times).astype(np.int32)
                yield pa.record_batch([pa.array(key), b.column("doc").slice(at, end - at).take(pa.array(text)), pa.array(signed)], ["key", "doc", "n"])

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, end, data, off in V.pieces(b.column("text"), PIECE):
                n, loss, _ = sent.value.looked(_marked(b, at, end), data, off)
                yield pa.record_batch([b.column("doc").slice(at, end - at), b.column("doc_id").slice(at, end - at), pa.array(n), *map(pa.array, loss), pa.array(np.ones(end - at, np.int64))], ["doc", "doc_id", "n_tokens", "t", "g", "rows"])

    rows = keyed.select("doc", "text", "target").mapInArrow(pairs, "key long, doc long, n int")
    same = Window.partitionBy("key")
    rows = rows.withColumns({"every": F.sum(F.abs("n")).over(same), "targets": F.sum(F.when(F.col("n") < 0, -F.col("n")).otherwise(0)).over(same)})
    n, own = F.abs("n"), F.when(F.col("n") < 0, -F.col("n")).otherwise(0)
    rows = rows.where(F.col("every") > n).withColumn("word", (F.col("key") % (shared.size + 1)).cast("int"))
    share = prior * shared.shares()[:, :-1]
    shares = docs.sparkSession.createDataFrame(pa.table({"word": pa.array(np.arange(shared.size, dtype=np.int32)), "a": pa.array(share[0]), "b": pa.array(share[1])}))
    rows = rows.join(F.broadcast(shares), "word")  # ``vocabulary`` rows
    more = rows.select("doc", (-n * F.log1p((F.col("targets") - own) / F.col("a"))).alias("t"), (-n * F.log1p((F.col("every") - n) / F.col("b"))).alias("g"))
    more = more.groupBy("doc").agg(F.sum("t").alias("t"), F.sum("g").alias("g"))
    zero = {"doc_id": F.lit(None).cast("long"), "n_tokens": F.lit(0).cast("long"), "rows": F.lit(0).cast("long")}
    every = keyed.mapInArrow(alone, "doc long, doc_id long, n_tokens long, t double, g double, rows long").unionByName(more.withColumns(zero))
    sums = every.groupBy("doc").agg(F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.sum("t").alias("t"), F.sum("g").alias("g"), F.sum("rows").alias("rows"))
    words = F.greatest(F.col("n_tokens") * F.col("rows"), F.lit(1))
    one = sums.select("doc_id", "n_tokens", (F.col("t") / words).alias("target_loss"), (F.col("g") / words).alias("background_loss"), F.explode(F.array_repeat(F.lit(0), F.col("rows").cast("int"))))
    return one.drop("col").withColumn("loss_difference", F.col("target_loss") - F.col("background_loss"))


def marked(docs: DataFrame, targets: DataFrame, *, most_broadcast: int = 4_000_000) -> DataFrame:
    """``docs`` (doc_id, text) with target: whether doc_id is in ``targets``. Up to ``most_broadcast`` ids go to all tasks, more are joined by a shuffle."""
    ids = stored(targets.where("doc_id IS NOT NULL").select("doc_id").distinct().withColumn("target", F.lit(True)), "targets")
    side = F.broadcast(ids) if ids.count() <= most_broadcast else ids.hint("merge")
    return docs.join(side, "doc_id", "left").select("doc_id", "text", F.coalesce("target", F.lit(False)).alias("target"))


def loss_difference(docs: DataFrame, targets: DataFrame, **options) -> DataFrame:
    """The scores of ``docs`` (doc_id, text); ``targets``: doc_id of the target documents."""
    rows = marked(docs, targets)
    shared = vocabulary(rows.select("text", "target"), **options)
    return scored(rows, shared, counted(rows.select("text", "target"), shared))


def op2_loss_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both losses of every document; targets are the documents whose label is quality 1."""
    good = table(spark, sf_dir, "labels").where("quality = 1")
    return loss_difference(table(spark, sf_dir, "documents").select("doc_id", "text"), good)
