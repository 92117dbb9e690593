"""Quality rules: how far a document's character classes and common words are from those of its language.

Two histograms describe a text: the classes of its characters, and its words among the most common words of each
language with one cell for all others. References are the sums of these histograms over all documents of a
language, each document with weight 1, so that no long document dominates; the classes have a little of the whole
table's, so that a few documents do not judge themselves. A document's distance is the
Jensen-Shannon distance (base 2, between 0 and 1) to the nearest language's references. Documents with fewer words
than ``least_words`` are too short to be judged by their words; with fewer characters than ``least_chars``, by
their characters.

The fixed rules stand beside it: a document with fewer than 50 words or more than half of its words in repeated
three-word windows fails.

Null texts have no words. Null languages are one language, as any other. Repeated rows are judged alike. An
empty table gives no rows. Own columns with the names of the results (n_words, kept and so on) are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ravelin.llm import vectext as V
from ravelin.llm.shared import table

#: Classes: ASCII upper, lower, digit, blank, line feed, sentence marks, other marks, symbols, controls, beyond ASCII.
N_CLASSES = 10
_CLASSES = np.full(256, 9, np.int64)
_CLASSES[:128] = 8
for _i, _s in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t\r\v\f", "\n", ".,;:?", "!'\"()-_/\\[]{}@^~`=+", "#*$%&|<>")):
    _CLASSES[[ord(_c) for _c in _s]] = _i
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(_c) for _c in "#*$%&|<>"]] = True
_FIRST_BYTE = (np.arange(256) & 0xC0) != 0x80


def class_counts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Characters of each class in each text; a character beyond ASCII counts once."""
    n = len(off) - 1
    row = np.repeat(np.arange(n), np.diff(off))
    return np.bincount((row * N_CLASSES + _CLASSES[data])[_FIRST_BYTE[data]], minlength=N_CLASSES * n).reshape(n, N_CLASSES)


def repeated_words(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each text, the words that are in a three-word window found twice or more in it."""
    n = len(first) - 1
    if len(h) < 3:
        return np.zeros(n, np.int64)
    row = V.rows_of(first)
    inside = row[2:] == row[:-2]
    at = np.flatnonzero(inside)
    w = V.mix(V.mix(V.mix(h[at]) * np.uint64(3) + h[at + 1]) * np.uint64(5) + h[at + 2])
    key = V.mix(w + V.mix(row[at].astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    k = key[order]
    twice = np.zeros(len(k), bool)
    if len(k) > 1:
        same = k[1:] == k[:-1]
        twice[1:] |= same
        twice[:-1] |= same
    starts = at[order[twice]]
    covered = np.zeros(len(h), bool)
    for i in range(3):
        covered[starts + i] = True
    return V.sums(covered, first)


def repeated_lines(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """For each text, the lines with a word that are equal to an earlier line."""
    n = len(off) - 1
    ends = np.flatnonzero(data == 10)
    row = np.repeat(np.arange(n), np.diff(off))
    starts = np.sort(np.concatenate([off[:-1], ends + 1]))
    stops = np.sort(np.concatenate([ends, off[1:]]))
    # a line feed at the very end of a text and the next text's start share an offset: sorting keeps them paired
    words = np.concatenate([[0], np.cumsum(~V.SPACE[data])])
    filled = words[stops] > words[starts]
    starts, stops = starts[filled], stops[filled]
    if not len(starts):
        return np.zeros(n, np.int64)
    h = V.hashes(data, starts, stops)
    of = row[starts]
    key = V.mix(h + V.mix(of.astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    return np.bincount(of[order][1:][same], minlength=n)


@dataclass
class References:
    """For each language: shares of the character classes, hashes of its common words, and their shares with one more for all others."""

    languages: list[str | None]
    classes: np.ndarray
    words: list[np.ndarray]
    shares: list[np.ndarray]


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance in base 2 of each row of ``p`` and ``q``."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum(-1)
        b = np.where(q > 0, q * np.log2(q / m), 0).sum(-1)
    return np.sqrt(np.clip((a + b) / 2, 0, 1))


def measures(texts: pa.Array, refs: References) -> dict[str, np.ndarray]:
    """The rules' counts and both distances of each text; a distance to no language is 0."""
    out: list[dict[str, np.ndarray]] = []
    lists = [(np.sort(w), np.argsort(w)) for w in refs.words]
    for _, _, data, off in V.pieces(texts):
        n = len(off) - 1
        starts, ends, first = V.spans(data, off)
        words = np.diff(first)
        counts = class_counts(data, off)
        chars = np.concatenate([[0], np.cumsum(_FIRST_BYTE[data])])
        exact = V.hashes(data, starts, ends)
        low, low_first = _content_words(data, off)
        row = V.rows_of(low_first)
        total = np.maximum(np.diff(low_first), 1)[:, None]
        by_word = np.zeros((n, 0))
        for i in range(len(refs.languages)):
            values, at = lists[i]
            k = len(values)
            pos = np.minimum(np.searchsorted(values, low), max(k - 1, 0))
            cell = np.where(values[pos] == low, at[pos], k) if k else np.zeros(len(low), np.int64)
            hist = np.bincount(row * (k + 1) + cell, minlength=n * (k + 1)).reshape(n, k + 1) / total
            by_word = np.concatenate([by_word, divergence(hist, refs.shares[i])[:, None]], 1)
        out.append({
            "n_words": words,
            "word_chars": V.sums(chars[ends] - chars[starts], first),
            "n_symbols": np.bincount(np.repeat(np.arange(n), np.diff(off))[_SYMBOL[data]], minlength=n),
            "n_dup_lines": repeated_lines(data, off),
            "n_repeat_words": repeated_words(exact, first),
            "n_chars": counts.sum(1),
            "class_distance": nearest_class(counts, refs),
            "word_distance": by_word.min(1) if by_word.size else np.zeros(n),
        })
    return {k: np.concatenate([x[k] for x in out]) for k in out[0]} if out else {}


def _content_words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the folded words without their marks, and the first of each text."""
    low = V.fold(data)
    starts, ends, first = V.spans(low, off, V.NOT_WORD)
    return V.hashes(low, starts, ends), first


def references(docs: DataFrame, *, common: int = 200, trim: float = 0.18, prior: float = 1.0) -> References:
    """The histograms of all documents with a text, by lang. Every language has references, however many there are.

    Classes are summed first; then classes and words are, without the documents whose classes are more than ``trim``
    from the first sums, so that junk does not set the norm. To the classes of a language come those of ``prior`` documents
    like the whole table, so that a few with a ``lang`` of their own set no norm for themselves: with a prior of 1, texts
    that share no class with others take 13 documents to be kept, texts of the letters of others any number.
    """
    return _summed(docs, common, _summed(docs, 0, None, trim, prior), trim, prior)


class Weights:
    """Sums of weights by language and key, within a task; of at most about ``most`` keys at a time."""

    def __init__(self, most: int = 1 << 20):
        self.most, self.size = most, 0
        self.held: dict[str | None, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.classes: dict[str | None, np.ndarray] = {}

    def add(self, lang: str | None, classes: np.ndarray, docs: int, keys: np.ndarray, weights: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Adds them; the sums that have to go out, as there are too many keys."""
        self.classes[lang] = self.classes.get(lang, 0) + np.append(classes, docs)
        self.held.setdefault(lang, []).append((keys, weights))
        self.size += len(keys)
        if self.size > self.most:
            self._merge()
            if self.size > self.most // 2:
                yield from self.flush()

    def _merge(self) -> None:
        for lang, parts in self.held.items():
            keys, weights = (np.concatenate(x) for x in zip(*parts, strict=True))
            u, back = np.unique(keys, return_inverse=True)
            self.held[lang] = [(u, np.bincount(back, weights, len(u)))]
        self.size = sum(len(x[0][0]) for x in self.held.values())

    def flush(self) -> Iterator[pa.RecordBatch]:
        self._merge()
        for lang, sums in self.classes.items():
            ((keys, weights),) = self.held[lang]
            size = len(keys) + N_CLASSES
            yield pa.record_batch([
                pa.array([lang] * size, pa.string()),
                pa.array(np.arange(size) < N_CLASSES),
                pa.array(np.concatenate([np.arange(N_CLASSES), keys.view(np.int64)])),
                pa.array(np.concatenate([sums[:N_CLASSES], weights])),
                pa.array(np.append(sums[N_CLASSES], np.zeros(size - 1)).astype(np.int64)),
            ], ["lang", "is_class", "key", "weight", "docs"])
        self.held, self.classes, self.size = {}, {}, 0


def nearest_class(counts: np.ndarray, refs: References) -> np.ndarray:
    shares = counts / np.maximum(counts.sum(1, keepdims=True), 1)
    return np.min([divergence(shares, c) for c in refs.classes], axis=0) if len(refs.classes) else np.zeros(len(counts))


def _summed(docs: DataFrame, common: int, first: References | None, trim: float, prior: float) -> References:
    sent = docs.sparkSession.sparkContext.broadcast(first)  # a list of ``common`` words for each language

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """By language: the sum of the class shares and, if ``common``, each word's share of its document, summed."""
        held = Weights()
        for b in batches:
            langs = b.column("lang").to_pylist()
            for at, end, data, off in V.pieces(b.column("text")):
                names = sorted({x for x in langs[at:end] if x is not None}) + [None]
                lang = np.array([names.index(x) for x in langs[at:end]])
                counts = class_counts(data, off)
                some = counts.sum(1) > 0
                if sent.value is not None:
                    some &= nearest_class(counts, sent.value) <= trim
                shares = counts / np.maximum(counts.sum(1, keepdims=True), 1)
                if common:
                    h, first = _content_words(data, off)
                    row = V.rows_of(first)
                    each = some[row] / np.maximum(np.diff(first), 1)[row]
                for i, name in enumerate(names):
                    chosen = some & (lang == i)
                    if chosen.any():
                        keys, weights = (h[chosen[row]], each[chosen[row]]) if common else (np.zeros(0, np.uint64), np.zeros(0))
                        yield from held.add(name, shares[chosen].sum(0), int(chosen.sum()), keys, weights)
        yield from held.flush()

    sums = docs.select("lang", "text").mapInArrow(of, "lang string, is_class boolean, key long, weight double, docs long")
    sums = sums.groupBy("lang", "is_class", "key").agg(F.sum("weight").alias("weight"), F.sum("docs").alias("docs"))
    most = max(common, N_CLASSES)
    # the common words of each language: of each of many parts of its words the most common, then of those
    salted = Window.partitionBy("lang", "is_class", F.pmod("key", F.lit(64))).orderBy(F.desc("weight"), "key")
    top = sums.withColumn("place", F.row_number().over(salted)).where(F.col("place") <= most)
    place = Window.partitionBy("lang", "is_class").orderBy(F.desc("weight"), "key")
    top = top.withColumn("place", F.row_number().over(place)).where(F.col("place") <= most)
    got = top.select("lang", "is_class", "key", "weight", "docs").toPandas()
    got["lang"] = got["lang"].where(got["lang"].notna(), None)
    # -1 is the null language: one pass over the rows, however many languages there are
    code, names = pd.factorize(got["lang"])
    groups = {None if i < 0 else names[i]: rows for i, rows in got.groupby(code)}
    n = {x: int(rows["docs"].sum()) for x, rows in groups.items()}
    langs = sorted(n, key=lambda x: (-n[x], x is None, x or ""))
    by_class = got[got["is_class"]].groupby("key")["weight"].sum().reindex(range(N_CLASSES), fill_value=0.0).to_numpy()
    every = max(sum(n.values()), 1)
    classes, words, shares = [], [], []
    for x in langs:
        own = groups[x]
        c = own[own["is_class"]].set_index("key")["weight"].reindex(range(N_CLASSES), fill_value=0.0).to_numpy() + prior * by_class / every
        w = own[~own["is_class"]].sort_values(["weight", "key"], ascending=[False, True])
        classes.append(c / max(c.sum(), 1e-12))
        words.append(w["key"].to_numpy().astype(np.int64).view(np.uint64))
        share = np.minimum(w["weight"].to_numpy() / max(n[x], 1), 1)
        shares.append(np.append(share, max(1 - share.sum(), 0)))
    return References(langs, np.array(classes).reshape(-1, N_CLASSES), words, shares)


def judged(docs: DataFrame, refs: References, *, most_class: float = 0.195, most_word: float = 0.6, least_words: int = 50, least_chars: int = 200) -> DataFrame:
    """All columns of ``docs``, the counts, both distances, base_failed and kept."""
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars")
    added = [*counts, "class_distance", "word_distance"]
    plain = docs.drop(*added)
    schema = plain.withColumns({n: F.lit(0).cast("long") for n in counts} | {n: F.lit(0.0) for n in added[6:]}).schema
    sent = docs.sparkSession.sparkContext.broadcast(refs)  # a list of ``common`` words for each language

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = [n for n in b.schema.names if n not in added]
            if b.num_rows:
                m = measures(b.column("text"), sent.value)
                yield pa.record_batch([*(b.column(n) for n in kept), *(pa.array(m[n]) for n in added)], [*kept, *added])

    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    far: Column = ((F.col("class_distance") > most_class) & (F.col("n_chars") >= least_chars)) | ((F.col("word_distance") > most_word) & (F.col("n_words") >= least_words))
    return docs.mapInArrow(of, schema).withColumn("base_failed", failed).withColumn("kept", ~failed & ~far)


def op7_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of every document and whether the rules keep it."""
    docs = table(spark, sf_dir, "documents")
    out = judged(docs.select("doc_id", "text"), references(docs))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance")
