"""Benchmark decontamination by latent semantic retrieval.

A passage is ``WINDOW`` words in a row; documents and benchmark items are cut into passages that overlap by half.
A passage's vector has its TF-IDF weights over the benchmark's words, all other words have no weight. A randomised
singular value decomposition of the passages of all documents, with the benchmark's passages at equal total energy,
gives the latent space: tasks sum ``A'(A G)`` for one Gaussian test matrix ``G`` over their passages (a fixed-size
matrix each), and the driver takes the decomposition of the sum (the one-pass Nystrom form). Passages whose latent
cosine with a passage of an item is at least ``cosine`` are candidates. The cosine is taken as if the longer of the two
were as short as the shorter one, as a short item is quoted within a passage of other words.

A candidate is a match if the longest common subsequence of the item's words and the words around the passage has at
least ``lcs`` of the item's words, and at least ``answer`` of the item's answer words are there: the ``ANSWERS`` words
of the item that are rarest in the corpus. Items of fewer than ``SHORT`` words say too little for that; they match
where all their words follow each other.

The benchmark is taken in blocks of about ``block_words`` words, each with its own latent space; a block's tables have
a size that this bounds (or its longest item, if that is longer), and are broadcast. Documents are read whole, in their
partitions, and never shuffled, twice for each block.

Null and empty texts match nothing, nor do items without words. Repeated rows of documents match each; items with equal
text match each under their own id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm import vectext as V
from ravelin.llm.shared import packed, stored, table

WINDOW = 32
STEP = WINDOW // 2
#: Dimensions of the latent space of a block of up to ``RANK_WORDS`` words; more by the root of the words.
RANK, RANK_WORDS = 192, 1 << 14
ANSWERS = 6
SHORT = 5
#: Terms counted in a dense table of a piece's passages, the most frequent of the benchmark; the rest are gathered one by one.
COMMON = 64
#: Bytes of text at a time: the vectors of their words stay in the processor's cache.
PIECE = 1 << 16
MATCHES = "doc_id long, item_id long, cosine double, lcs double"


@dataclass
class Block:
    """A block of the benchmark: item ids, each item's term numbers, and the terms' hashes."""

    ids: list
    words: list[np.ndarray]
    terms: np.ndarray

    def __post_init__(self):
        # for the low bits of a hash: number of the term, -1 for none, -2 for several
        self.low = np.uint64((1 << max(16, len(self.terms).bit_length() + 4)) - 1)
        at = (self.terms & self.low).astype(np.int64)
        self.look = np.full(int(self.low) + 1, -1, np.int64)
        self.look[at] = np.arange(len(at))
        self.look[np.flatnonzero(np.bincount(at, minlength=len(self.look)) > 1)] = -2
        self.order = np.argsort(self.terms)
        self.sorted = self.terms[self.order]

    @property
    def rank(self) -> int:
        """Dimensions of the latent space: more words need more to be told apart."""
        return int(RANK * max(1.0, sum(map(len, self.words)) / RANK_WORDS) ** 0.5)

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """The number of the term of each hash, -1 if it is no term."""
        n = self.look[(h & self.low).astype(np.int64)]
        several = np.flatnonzero(n == -2)
        n = np.where((n >= 0) & (self.terms[np.maximum(n, 0)] == h), n, -1)
        if len(several):
            at = np.minimum(np.searchsorted(self.sorted, h[several]), len(self.sorted) - 1)
            n[several] = np.where(self.sorted[at] == h[several], self.order[at], -1)
        return n


def words_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = V.fold(data)
    starts, ends, first = V.spans(low, off, V.NOT_WORD)
    return V.hashes(low, starts, ends), first


def block_of(ids: list, texts: pa.Array) -> Block:
    h, first = words_of(*V.buffers(texts))
    filled = [i for i in range(len(ids)) if first[i + 1] > first[i]]
    words = [h[first[i] : first[i + 1]] for i in filled]
    terms, back, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *words]), return_inverse=True, return_counts=True)
    order = np.argsort(-n, kind="stable")  # the most frequent have the lowest numbers
    terms, place = terms[order], np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    parts = np.split(place[back], np.cumsum([len(w) for w in words])[:-1]) if words else []
    return Block([ids[i] for i in filled], parts, terms)


def halves(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(half, first half): the number of the half passage of each word, and of the first one of each text (with one more for the end)."""
    n = np.diff(first)
    edges = np.concatenate([[0], np.cumsum(-(-n // STEP))]).astype(np.int64)
    place = np.arange(first[-1]) - np.repeat(first[:-1], n)
    return np.repeat(edges[:-1], n) + place // STEP, edges


def counts_of_common(numbers: np.ndarray, of: np.ndarray, count: int, terms: int) -> np.ndarray:
    """For each of ``count`` passages, how often each of the ``COMMON`` first terms is in it; ``of``: the passage of each word."""
    c = min(COMMON, terms)
    some = (numbers >= 0) & (numbers < c)
    return np.bincount(of[some] * c + numbers[some], minlength=count * c).reshape(count, c).astype(np.float32)


def segment_sums(rows: np.ndarray, at: np.ndarray, of: np.ndarray, steps: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """(segments, sums): the sums of ``rows[at]`` over the runs of equal ``of``, in any order.

    The first items of all segments are added at once, then the second ones, and so on; ``np.add.reduceat`` goes through columns one by one.
    """
    starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    n = np.diff(starts, append=len(of))
    order = np.argsort(-n, kind="stable")
    starts, n = starts[order], n[order]
    out = rows[at[starts]]
    more = np.searchsorted(-n, -np.arange(1, min(int(n[0]), steps)), "left").tolist()  # segments of more than k items
    for k, m in enumerate(more, 1):
        out[:m] += rows[at[starts[:m] + k]]
    for i in range(int(np.searchsorted(-n, -steps, "left"))):
        out[i] += rows[at[starts[i] + steps : starts[i] + n[i]]].sum(axis=0)
    return of[starts], out


def half_sums(numbers: np.ndarray, half: np.ndarray, count: int, rows: np.ndarray) -> np.ndarray:
    """For each half passage the sum of the rows of its terms; words that are no term add nothing."""
    common = counts_of_common(numbers, half, count, len(rows))
    out = common @ rows[: common.shape[1]]
    some = np.flatnonzero(numbers >= common.shape[1])
    if len(some):
        of, sums = segment_sums(rows, numbers[some], half[some])
        out[of] += sums
    return out


def windows(edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first half, last half) of the passages: two halves that follow each other, or the only one of a text."""
    m = np.diff(edges)
    count = np.where(m > 1, m - 1, m)
    a = np.repeat(edges[:-1] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    return a, np.minimum(a + 1, np.repeat(edges[1:] - 1, count))


def gaussian(n: int, rank: int, seed: int = 5) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((n, rank)).astype(np.float32)


def energy(numbers: np.ndarray, first: np.ndarray, test: np.ndarray, z: np.ndarray) -> None:
    """Adds A'(A test) to ``z``, with A the counts of the terms in passages that do not overlap."""
    half, edges = halves(first)
    m = np.diff(edges)
    pair = np.repeat(np.concatenate([[0], np.cumsum(-(-m // 2))])[:-1], m) + (np.arange(edges[-1]) - np.repeat(edges[:-1], m)) // 2
    if not len(numbers):
        return
    whole = pair[half]
    y = half_sums(numbers, whole, int(whole[-1]) + 1, test)
    common = counts_of_common(numbers, whole, len(y), len(test))
    z[: common.shape[1]] += common.T @ y
    some = np.flatnonzero(numbers >= common.shape[1])
    if len(some):
        t = numbers[some]
        order = np.argsort(t.astype(np.uint16) if len(z) < 1 << 16 else t, kind="stable")
        of, sums = segment_sums(y, whole[some][order], t[order])
        z[of] += sums


def latent(z: np.ndarray, test: np.ndarray) -> np.ndarray:
    """The right singular vectors (as columns) with singular values above noise, from z = A'A test."""
    if not len(z):
        return np.zeros((0, 0))
    shift = np.sqrt(len(z)) * np.finfo(float).eps * np.linalg.norm(z)
    shifted = z + shift * test
    core = test.T.astype(float) @ shifted
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    keep = values > values.max(initial=0) * 1e-12
    u, s, _ = np.linalg.svd(shifted @ (vectors[:, keep] / np.sqrt(values[keep])), full_matrices=False)
    return u[:, s > s.max(initial=0) * 1e-6]


def corpus_statistics(docs: DataFrame, block: Block) -> tuple[np.ndarray, int, np.ndarray]:
    """(occurrences of each term, words, A'(A test)) of all documents."""
    t, rank = len(block.terms), block.rank
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(block)
    per = 256  # terms in a row of what tasks give

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, test = sent.value, gaussian(t, rank)
        z, seen, words = np.zeros((t, rank)), np.zeros(t, np.int64), 0
        for batch in batches:
            for _, _, data, off in V.pieces(batch.column(0), PIECE):
                h, first = words_of(data, off)
                n = b.numbers(h)
                seen += np.bincount(n[n >= 0], minlength=t)
                words += len(h)
                energy(n, first, test, z)
        if words:
            both = np.concatenate([z, seen[:, None], np.zeros((t, 1))], 1)
            both[0, -1] = words
            at = range(0, t, per)
            yield pa.record_batch([pa.array([i // per for i in at], pa.int32()), pa.array([both[i : i + per].tobytes() for i in at], pa.binary())], ["part", "sums"])

    def add(tab: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer()) for x in tab.column("sums"))
        return tab.slice(0, 1).set_column(tab.schema.get_field_index("sums"), "sums", pa.array([total.tobytes()], pa.binary()))

    sums = docs.select("text").mapInArrow(of, "part int, sums binary")
    salted = sums.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(16)))
    half = salted.groupBy("part", "salt").applyInArrow(add, "part int, sums binary, salt int")
    got = half.drop("salt").groupBy("part").applyInArrow(add, "part int, sums binary").orderBy("part").toArrow()
    if not got.num_rows:
        return np.zeros(t, np.int64), 0, np.zeros((t, rank))
    both = np.concatenate([np.frombuffer(x.as_buffer()).reshape(-1, rank + 2) for x in got.column("sums")])
    return both[:, rank].astype(np.int64), int(both[0, rank + 1]), both[:, :rank]


def near_passages(numbers: np.ndarray, half: np.ndarray, count: int, x: np.ndarray, y: np.ndarray, rows: np.ndarray, target: np.ndarray, size: np.ndarray, other: float, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, target, cosine) of the pairs at ``least`` or above; passages are halves x to y, ``target`` has unit length and ``size`` its lengths before.

    The words that are no term count in a passage's length; a cosine is taken at the length of the shorter one.
    """
    sums = half_sums(numbers, half, count, rows)
    rest = np.bincount(half[numbers < 0], minlength=count) * other**2
    two = np.flatnonzero(y > x)
    p = sums[x]
    p[two] += sums[y[two]]
    length = np.sqrt(np.einsum("ij,ij->i", p, p) + rest[x] + np.where(y > x, rest[y], 0)).astype(np.float32)
    dot = p @ target.T
    length = np.maximum(length, np.float32(1e-9))
    near, to = np.divmod(np.flatnonzero((dot >= np.float32(least) * size) | (dot >= np.float32(least) * length[:, None])), len(size))
    return near, to, dot[near, to] / np.minimum(length[near], size[to])


def common_length(a: np.ndarray, b: np.ndarray) -> int:
    """The length of the longest common subsequence: bit i of ``row`` is 0 where the best of the first i + 1 items of ``b`` is longer than of the first i."""
    at: dict[int, int] = {}
    for i, y in enumerate(b.tolist()):
        at[y] = at.get(y, 0) | 1 << i
    every = (1 << len(b)) - 1
    row = every
    for x in a.tolist():
        both = row & at.get(x, 0)
        row = ((row + both) | (row - both)) & every
    return len(b) - row.bit_count()


def holds(around: np.ndarray, words: np.ndarray) -> bool:
    """Whether the words follow each other somewhere."""
    n = len(words)
    return len(around) >= n and bool((np.lib.stride_tricks.sliding_window_view(around, n) == words).all(1).any())


@dataclass
class Answers:
    """Each item's answer words: ``place`` has their places among all answer words (the last one for none), ``needed`` how many of them a match has."""

    number: np.ndarray
    place: np.ndarray
    needed: np.ndarray

    @classmethod
    def of(cls, words: list[np.ndarray], idf: np.ndarray, answer: float) -> Answers:
        own = [u[np.argsort(-idf[u], kind="stable")][:ANSWERS] for u in map(np.unique, words)]
        every = np.unique(np.concatenate([np.zeros(0, np.int64), *own]))
        place = np.full((len(own), ANSWERS), len(every))
        for i, u in enumerate(own):
            place[i, : len(u)] = np.searchsorted(every, u)
        needed = [len(u) if len(w) < SHORT else np.ceil(answer * len(u) - 1e-9) for w, u in zip(words, own, strict=True)]
        number = np.full(len(idf), -1, np.int64)
        number[every] = np.arange(len(every))
        return cls(number, place, np.array(needed))

    def there(self, numbers: np.ndarray, half: np.ndarray, count: int, items: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Whether the halves lo up to (not with) hi have the answer words that each of ``items`` needs."""
        at = self.number[numbers]
        some = (numbers >= 0) & (at >= 0)
        wide = count + 1
        keys = np.append(np.unique(at[some] * wide + half[some]), np.iinfo(np.int64).max)  # by answer word, the halves that have it
        found = np.zeros(len(items), np.int64)
        left = np.arange(len(items))  # those that may still come to what is needed
        for k in range(ANSWERS):
            p = self.place[items[left], k] * wide
            found[left] += keys[np.searchsorted(keys, p + lo[left])] < p + hi[left]
            left = left[found[left] + (ANSWERS - 1 - k) >= self.needed[items[left]]]
        return found >= self.needed[items]


def share_found(around: np.ndarray, words: np.ndarray, answers: np.ndarray, lcs: float, answer: float) -> float:
    """The share of the item's words in the common subsequence, 0 if it is no match."""
    if len(words) < SHORT:
        return float(holds(around, words))
    if np.isin(answers, around).mean() < answer:
        return 0.0
    share = common_length(words, around) / len(words)
    return share if share >= lcs else 0.0


def matched(docs: DataFrame, benchmark: DataFrame, *, cosine: float = 0.36, lcs: float = 0.6, answer: float = 0.6, block_words: int = 1 << 16) -> DataFrame:
    """doc_id, item_id, cosine, lcs (both of the best passage) for each document and item that match.

    ``docs``: doc_id, text; ``benchmark``: item_id, text.
    """
    items = benchmark.where(F.coalesce(F.col("text"), F.lit("")) != "").select("item_id", "text")
    words = items.agg(F.coalesce(F.sum(F.size(F.split("text", r"\s+"))), F.lit(0))).first()[0]
    blocks = max(1, -(-words // block_words))
    out = None
    for i in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(blocks)) == i).toArrow().sort_by([("item_id", "ascending"), ("text", "ascending")])
        b = block_of(rows.column("item_id").to_pylist(), rows.column("text").combine_chunks())
        found = _matched_block(docs, b, cosine, lcs, answer)
        out = found if out is None else out.unionByName(found)
    return out


def _matched_block(docs: DataFrame, block: Block, cosine: float, lcs: float, answer: float) -> DataFrame:
    t = len(block.terms)
    if not t:
        return docs.sparkSession.createDataFrame([], MATCHES)
    seen, words, z = corpus_statistics(docs, block)
    test = gaussian(t, block.rank)
    idf = np.log((1 + words) / (1 + seen))
    edges = np.concatenate([[0], np.cumsum([len(w) for w in block.words])]).astype(np.int64)
    numbers = np.concatenate(block.words) if block.words else np.zeros(0, np.int64)
    own = np.zeros((t, block.rank))
    energy(numbers, edges, test, own)
    # counts become TF-IDF: A D has D A'A D, and A'(A D)(D^-1 test) is what was summed; D^-1 test is the test matrix then
    z, own = idf[:, None] * z, idf[:, None] * own
    scale = np.linalg.norm(z) / max(np.linalg.norm(own), 1e-12) or 1.0
    v = latent(z + scale * own, test / np.maximum(idf, 1e-6)[:, None])
    rows = (idf[:, None] * v).astype(np.float32)
    half, at = halves(edges)
    first_half, last_half = windows(at)
    sums = half_sums(numbers, half, at[-1], rows)
    target = sums[first_half] + np.where((last_half > first_half)[:, None], sums[last_half], 0)
    size = np.maximum(np.linalg.norm(target, axis=1), 1e-9).astype(np.float32)
    target /= size[:, None]
    item_of = np.searchsorted(at, first_half, "right") - 1
    # words that are no term have the weight of a usual term: they are no part of any item
    other = float(np.median(idf)) if t else 0.0
    wanted = Answers.of(block.words, idf, answer)
    answers = [np.flatnonzero(np.isin(wanted.number, p)) for p in wanted.place]
    lengths = np.array([len(w) for w in block.words])
    sent = docs.sparkSession.sparkContext.broadcast((block, rows, target, size, item_of, wanted, answers, lengths, other))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, rows, target, size, item_of, wanted, answers, lengths, other = sent.value
        for batch in batches:
            ids = batch.column("doc_id")
            got: dict[str, list] = {"row": [], "item": [], "cosine": [], "lcs": []}
            for row, _, data, off in V.pieces(batch.column("text"), PIECE):
                h, first = words_of(data, off)
                n = b.numbers(h)
                half, edges = halves(first)
                x, y = windows(edges)
                near, to, cosines = near_passages(n, half, edges[-1], x, y, rows, target, size, other, cosine)
                text = np.searchsorted(edges, x[near], "right") - 1
                wide = -(-lengths[item_of[to]] // STEP)  # the words around, in halves and rounded up
                some = np.flatnonzero(wanted.there(n, half, edges[-1], item_of[to], np.maximum(x[near] - wide, edges[text]), np.minimum(x[near] + 2 + wide, edges[text + 1])))
                near, to, cosines, text = near[some], to[some], cosines[some], text[some]
                best: dict[tuple[int, int], tuple[float, float]] = {}
                for i, j, d, c in zip(near, to, text, cosines.tolist(), strict=True):
                    item = item_of[j]
                    w = b.words[item]
                    begin = first[d] + (x[i] - edges[d]) * STEP
                    if (d, item) in best and best[d, item][1] == 1:
                        continue
                    around = n[max(first[d], begin - len(w)) : min(first[d + 1], begin + WINDOW + len(w))]
                    share = share_found(around, w, answers[item], lcs, answer)
                    if share:
                        best[d, item] = max(best.get((d, item), (0.0, 0.0)), (c, share), key=lambda z: (z[1], z[0]))
                for (d, item), (score, share) in best.items():
                    for name, value in zip(got, (row + d, item, score, share), strict=True):
                        got[name].append(value)
            items = pa.array(b.ids, pa.int64()).take(pa.array(got["item"], pa.int64()))
            yield pa.record_batch([ids.take(pa.array(got["row"], pa.int64())), items, pa.array(got["cosine"], pa.float64()), pa.array(got["lcs"], pa.float64())], ["doc_id", "item_id", "cosine", "lcs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(of, MATCHES)


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that match no item; rows with null doc_id go by their text, as all do here."""
    keyed = docs.select(packed(docs), "text", F.xxhash64("text").alias("key"))
    found = matched(keyed.select(F.col("key").alias("doc_id"), "text"), benchmark, **options).select(F.col("doc_id").alias("key")).distinct()
    return keyed.join(stored(found, "matched"), "key", "left_anti").select("row.*")


def op6_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with a passage of the benchmark, and which items they match."""
    return matched(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
