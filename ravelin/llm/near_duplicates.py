"""Near-duplicates by Order MinHash over word shingles, verified by banded alignment.

A text is the sequence of its folded words without marks; its k-mers are the runs of five words, each labelled
with how often the same run came before. Each of 48 hash functions orders the labelled k-mers; a table's
entry is the two least ones, kept in the order they have in the text. Texts of high edit similarity agree in many
entries, texts with the same words in another order do not. A text's entries put it into as many buckets. One edit
changes five runs, so that scattered edits leave few of them: texts of 24 words and more have 16 entries from runs of three
words besides, and those of up to 37 words 64 from runs of two (``KINDS``; lengths of similar texts differ by up to a fifth,
so two of them have a kind in common). Two texts at the very threshold, with edits scattered over single words, share a
bucket with a chance of more than 0.9, more similar ones nearly always.

1. Equal texts become one node (grouped by hash). Buckets with one node are left out at once.
2. Every node is compared with two of the least nodes of its buckets; links join the nodes to components.
3. Where a bucket still holds nodes of several components, all pairs of nodes of different components in it are
   compared: by a join where it has up to ``SMALL`` nodes; else its nodes are dealt into blocks of about
   ``BLOCK_BYTES`` of words, and every two blocks are compared in a task, by one matrix product that bounds the words
   two nodes share, and by alignment where the bound is high enough, in the first of their buckets alone. So any two texts that share a bucket have been compared, or are in
   one class without it, whatever the size of the bucket.
4. A pair is a link if its word edit distance, computed in a widening band, is at most ``1 - similarity`` of the
   longer text's words. Bounds on the distance from lengths and word counts come first. Two very long texts that
   pass these bounds cost time in proportion to their words times their distance, a fifth of the words at most.

Rounds are written to the shared folder.

Null and empty texts are each their own class, also if repeated; texts without words, only if equal. Every row of the
input has a row in the result. ``class_id`` is the least doc_id of the class (null only if all are); ``component``
names the class uniquely where ids are null or repeated, and is null for rows without a text.

Texts are one node, and words equal, by 64-bit hashes; in the alignment, by 16 bits of them, where a chance match (of
two given words, one in 65,536) makes the distance one less.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm import vectext as V
from ravelin.llm.components import components
from ravelin.llm.shared import drop_table, packed, stored, table

#: Words of a run; the least and the most words of texts that have entries from such runs; and how many entries.
KINDS = ((5, 1, 1 << 62, 48), (3, 24, 1 << 62, 16), (2, 1, 37, 64))
#: The first column of each kind in a row that has room for all.
COLUMNS = (0, 48, 64, 128)
SMALL = 32
#: Bytes of words in a block; a node counts as ``NODE_BYTES`` at least, so a block has up to 4,096 nodes.
BLOCK_BYTES = 1 << 23
NODE_BYTES = 1 << 11
SIMILARITY = 0.8
_FACTORS = np.random.default_rng(11).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MOST = np.uint64((1 << 64) - 1)
#: Bytes of text at a time: the hashes of their k-mers stay in the processor's cache.
PIECE = 1 << 18


def _words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = V.fold(data)
    starts, ends, first = V.spans(low, off, V.NOT_WORD)
    return V.hashes(low, starts, ends), first


def occurrences(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each item, how often an equal one came before it in its text."""
    if not len(h):
        return np.zeros(0, np.uint64)
    key = V.mix(h + V.mix(V.rows_of(first).astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    new = np.ones(len(h), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    at = np.arange(len(h))
    out = np.empty(len(h), np.uint64)
    out[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return out


def order_minhash(h: np.ndarray, first: np.ndarray, size: int, tables: int) -> np.ndarray:
    """A row of ``tables`` entries for each text, from the hashes of its words and runs of ``size`` of them; 0 for texts without words."""
    k, kf = V.shingles(h, first, size)
    n = np.diff(kf)
    some = np.flatnonzero(n > 0)
    out = np.zeros((len(n), tables), np.uint64)
    if not len(some):
        return out
    x = V.mix(k + occurrences(k, kf) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(size))
    starts = kf[:-1][some]
    # the low bits of a value are the k-mer's place, so that the least value also says where it is
    low = np.uint64((1 << max(24, len(x).bit_length())) - 1)
    place, v = np.arange(len(x), dtype=np.uint64), np.empty_like(x)
    for t in range(tables):
        np.multiply(x, _FACTORS[t], out=v)
        v &= ~low
        v |= place
        a = (np.minimum.reduceat(v, starts) & low).astype(np.int64)
        v[a] = _MOST
        b = np.minimum.reduceat(v, starts)
        b = np.where(b == _MOST, a, (b & low).astype(np.int64))
        out[some, t] = V.mix(V.mix(x[np.minimum(a, b)] + np.uint64(t)) * np.uint64(31) + x[np.maximum(a, b)])
    return out


def all_entries(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A row of entries for each text, those of each kind in its columns; 0 where a text has none of a kind."""
    n = np.diff(first)
    out = np.zeros((len(n), COLUMNS[-1]), np.uint64)
    for at, (size, least, most, tables) in zip(COLUMNS, KINDS, strict=False):
        some = np.flatnonzero((n >= least) & (n <= most))
        if len(some):
            firsts = np.concatenate([[0], np.cumsum(n[some])])
            words = h if len(some) == len(n) else h[np.repeat(first[some] - firsts[:-1], n[some]) + np.arange(firsts[-1])]
            out[some, at : at + tables] = order_minhash(words, firsts, size, tables)
    return out


def sketched(docs: DataFrame) -> DataFrame:
    """node (hash of the text), n_words, entries (longs of each kind that the text has, in their order), words (16-bit hashes) of each different text."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, end, data, off in V.pieces(b.column("text"), PIECE):
                h, first = _words(data, off)
                low = (h >> np.uint64(48)).astype("<u2").tobytes()
                every = all_entries(h, first).view(np.int64)
                entries = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum((every != 0).sum(1))]).astype(np.int32)), pa.array(every[every != 0]))
                words = pa.array([low[2 * i : 2 * j] for i, j in zip(first[:-1], first[1:], strict=True)], pa.binary())
                yield pa.record_batch([b.column("node").slice(at, end - at), pa.array(np.diff(first)), entries, words], ["node", "n_words", "entries", "words"])

    rows = docs.where(F.coalesce(F.col("text"), F.lit("")) != "").select(F.xxhash64("text").alias("node"), "text")
    return rows.mapInArrow(of, "node long, n_words long, entries array<long>, words binary").dropDuplicates(["node"])


def _by_table(entries: list[list[int]], n_words: np.ndarray) -> np.ndarray:
    """The entries of ``sketched`` in a row for each text, those of each kind in its columns; where a text has none, a number that no other text has."""
    out = np.repeat(np.arange(1, len(n_words) + 1, dtype=np.int64)[:, None], COLUMNS[-1], 1)
    for row, own, n in zip(out, entries, n_words, strict=True):
        read = 0
        for at, (_, least, most, tables) in zip(COLUMNS, KINDS, strict=False):
            if least <= n <= most:
                row[at : at + tables] = own[read : read + tables]
                read += tables
    return out


def _rounds(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, half: int, most: np.ndarray) -> np.ndarray:
    """Edit distances of rows of ``a`` and ``b`` (padded; n <= m) over paths at most ``half`` off the corridor between both ends."""
    p, wide = len(n), int((m - n).max()) + 2 * half + 1
    j = np.arange(-half, wide - half)
    step = np.arange(wide, dtype=np.int32)
    far = np.int32(1 << 28)
    cur = np.broadcast_to(np.where(j >= 0, j, far).astype(np.int32), (p, wide)).copy()
    out = np.full(p, far, np.int32)
    rows = int(n.max())
    padded = np.full((p, half + max(b.shape[1], rows + wide) + wide), -2, np.int32)
    padded[:, half : half + b.shape[1]] = b
    order = np.argsort(-n, kind="stable")  # the longest first: those that are done are the last rows
    a, padded, n, m = a[order], padded[order], n[order], m[order]
    live = p
    for i in range(rows + 1):
        if i:
            c, s = cur[:live], padded[:live, i - 1 : i - 1 + wide]
            t = c + (s != a[:live, i - 1 : i])
            t[:, :-1] = np.minimum(t[:, :-1], c[:, 1:] + 1)
            cur[:live] = np.minimum.accumulate(t - step, axis=1) + step
        while live and n[live - 1] == i:
            live -= 1
            out[order[live]] = cur[live, m[live] - n[live] + half]
        if i % 64 == 63 and live and (cur[:live].min(1) > most[order[:live]]).all():
            break
    return out


def similar(pairs: list[tuple[np.ndarray, np.ndarray]], similarity: float = SIMILARITY) -> np.ndarray:
    """For each pair of sequences: its edit similarity, 1 - distance / longer length, if that is at least ``similarity``, else 0.

    The value can be below the true one, but not below ``similarity`` where that one is not.
    """
    out = np.zeros(len(pairs))
    open_: list[tuple[int, np.ndarray, np.ndarray, int, int]] = []
    for i, (a, b) in enumerate(pairs):
        if len(a) > len(b):
            a, b = b, a
        n, m = len(a), len(b)
        most = int(np.floor((1 - similarity) * m + 1e-9))
        if m - n > most or not m:
            continue
        if n == m and np.array_equal(a, b):
            out[i] = 1.0
            continue
        differ = np.flatnonzero(a != b[:n])
        head = int(differ[0]) if len(differ) else n
        a, b = a[head:], b[head:]
        differ = np.flatnonzero(a[::-1] != b[::-1][: len(a)])
        tail = int(differ[0]) if len(differ) else len(a)
        a, b = a[: len(a) - tail], b[: len(b) - tail]
        if not len(a):
            out[i] = 1 - len(b) / m
            continue
        seen = np.bincount(a, minlength=1 << 16) if len(a) > 20_000 else None
        if seen is None:
            u, c = np.unique(np.concatenate([a, b]), return_counts=True)
            ca = np.bincount(np.searchsorted(u, a), minlength=len(u))
            common = int(np.minimum(ca, c - ca).sum())
        else:
            common = int(np.minimum(seen, np.bincount(b, minlength=1 << 16)).sum())
        if len(b) - common <= most:
            open_.append((i, a.astype(np.int32), b.astype(np.int32), m, most))
    half = 8
    while open_:
        open_.sort(key=lambda x: len(x[1]))
        left, at = [], 0
        while at < len(open_):
            end, longest = at, 0
            while end < len(open_) and (end == at or (end - at + 1) * max(longest, len(open_[end][2])) <= 400_000):
                longest = max(longest, len(open_[end][2]))
                end += 1
            group = open_[at:end]
            at = end
            n, m = np.array([len(x[1]) for x in group]), np.array([len(x[2]) for x in group])
            a, b = np.full((len(group), n.max()), -1, np.int32), np.full((len(group), m.max()), -2, np.int32)
            for r, x in enumerate(group):
                a[r, : n[r]], b[r, : m[r]] = x[1], x[2]
            d = _rounds(a, b, n, m, half, np.array([x[4] for x in group]))
            for x, dist in zip(group, d, strict=True):
                if dist <= x[4]:
                    out[x[0]] = 1 - dist / x[3]
                elif half < x[4]:
                    left.append(x)
        open_, half = left, half * 4
    return out


def verified(pairs: DataFrame, words: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes that are links. ``words``: node, words, a row for each node."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = [tuple(np.frombuffer(y.as_buffer(), "<u2") for y in x) for x in zip(b.column("wa"), b.column("wb"), strict=True)]
            ok = pa.array(similar(both, similarity) > 0)
            yield pa.record_batch([b.column("a").filter(ok), b.column("b").filter(ok)], ["a", "b"])

    first = words.select(F.col("node").alias("b"), F.col("words").alias("wb"))
    second = words.select(F.col("node").alias("a"), F.col("words").alias("wa"))
    return pairs.join(first, "b").join(second, "a").select("a", "b", "wa", "wb").mapInArrow(of, "a long, b long")


def _pairs_with_least(buckets: DataFrame) -> DataFrame:
    """Each node with two of the least nodes of its buckets. ``buckets``: bucket, node, least."""
    of = buckets.groupBy("node").agg(F.min("least").alias("x"), F.max("least").alias("y"))
    return of.select(F.col("node").alias("a"), F.explode(F.array_distinct(F.array("x", "y"))).alias("b")).where("a != b")


def _with_several(buckets: DataFrame) -> DataFrame:
    """The buckets with several components, the number of their nodes and of their blocks. ``buckets``: bucket, node, n_words, component."""
    blocks = F.ceil(F.sum(F.greatest(2 * F.col("n_words"), F.lit(NODE_BYTES))) / BLOCK_BYTES)
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("size"), blocks.alias("blocks"), F.min("component").alias("c"), F.max("component").alias("d")).where("c != d")
    return stored(sizes.select("bucket", "size", "blocks"), "sizes")


def _pairs_of_small(rows: DataFrame) -> DataFrame:
    """The pairs of nodes of different components in the same bucket. ``rows``: bucket, node, component; up to SMALL rows a bucket."""
    other = rows.select("bucket", F.col("node").alias("b"), F.col("component").alias("d"))
    return rows.join(other, "bucket").where((F.col("node") > F.col("b")) & (F.col("component") != F.col("d"))).select(F.col("node").alias("a"), "b").distinct()


def _pairs_of_blocks(rows: DataFrame) -> DataFrame:
    """The rows of each two blocks of a bucket that have several components between them. ``rows``: bucket, node, component, blocks (of the bucket)."""
    dealt = stored(rows.select("bucket", "node", "component", F.pmod(F.xxhash64("node"), "blocks").alias("block")), "blocks")
    blocks = dealt.groupBy("bucket", "block").agg(F.min("component").alias("c"), F.max("component").alias("d"))
    other = blocks.select("bucket", F.col("block").alias("hi"), F.col("c").alias("e"), F.col("d").alias("f"))
    both = blocks.withColumnRenamed("block", "lo").join(other, "bucket").where((F.col("lo") <= F.col("hi")) & (F.least("c", "e") != F.greatest("d", "f")))
    sides = both.select("bucket", "lo", "hi", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("block"))
    return dealt.join(sides, ["bucket", "block"])


def shared_words(words: list[np.ndarray]) -> np.ndarray:
    """A row for each text, so that the product of two rows is at least the number of words that both have, each as often as both have it."""
    first = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    h = np.concatenate(words).astype(np.uint64)
    wide = 1 << min(max(int(16 * first[-1] / len(words)), 1).bit_length(), 13)
    at = V.mix(h * np.uint64(0x9E3779B97F4A7C15) + occurrences(h, first)) & np.uint64(wide - 1)
    cell, n = np.unique(V.rows_of(first) * wide + at.astype(np.int64), return_counts=True)
    out = np.zeros(len(words) * wide, np.float32)
    out[cell] = n
    return out.reshape(len(words), wide)


def links_of_blocks(rows: pa.Table, similarity: float, batch: int = 256) -> list[tuple[int, int]]:
    """Pairs (greater, less) of nodes of the blocks ``lo`` and ``hi`` that are links; pairs in one component, also by links found here, are passed over.

    So are pairs that share an entry of an earlier table: they are compared in the bucket of that one.
    """
    node, n, block = (rows.column(c).to_numpy() for c in ("node", "n_words", "block"))
    entries = _by_table(rows.column("entries").to_pylist(), n)
    t = int(np.flatnonzero(entries[0] == rows.column("bucket")[0].as_py())[0])
    label = np.unique(rows.column("component").to_numpy(), return_inverse=True)[1]
    words = [np.frombuffer(x.as_buffer(), "<u2") for x in rows.column("words")]
    bags = shared_words(words)
    lo, hi = (np.flatnonzero(block == rows.column(c)[0].as_py()) for c in ("lo", "hi"))
    out = []
    for at in range(0, len(lo), batch):
        some = lo[at : at + batch]
        longest, shortest = np.maximum(n[some][:, None], n[hi]), np.minimum(n[some][:, None], n[hi])
        most = np.floor((1 - similarity) * longest + 1e-9)
        shared = bags[some] @ bags[hi].T
        near = (longest - shortest <= most) & (longest - shared <= most) & (label[some][:, None] != label[hi])
        if len(lo) == len(hi) and lo[0] == hi[0]:
            near &= some[:, None] < hi
        x, y = np.nonzero(near)
        likely = np.argsort(-shared[x, y] / longest[x, y], kind="stable")  # what is linked early spares comparisons
        pairs = np.stack([some[x], hi[y]], 1)[likely]
        earlier = [(entries[c[:, 0], :t] == entries[c[:, 1], :t]).any(1) for c in np.array_split(pairs, len(pairs) // 50_000 + 1)]
        pairs = pairs[~np.concatenate(earlier)]
        while len(pairs):
            pairs = pairs[label[pairs[:, 0]] != label[pairs[:, 1]]]  # links that were found have joined some
            now, pairs = pairs[:batch], pairs[batch:]
            for i, k in now[similar([(words[i], words[k]) for i, k in now], similarity) > 0]:
                out.append((max(node[i], node[k]), min(node[i], node[k])))
                label[label == label[k]] = label[i]
    return out


def _links_in_large(rows: DataFrame, words: DataFrame, similarity: float) -> DataFrame:
    """The links (a, b) between components in buckets of any size. ``rows``: bucket, node, component, blocks; ``words``: node, n_words, entries, words."""

    def of(group: pa.Table) -> pa.Table:
        found = links_of_blocks(group, similarity)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return _pairs_of_blocks(rows).join(words, "node").groupBy("bucket", "lo", "hi").applyInArrow(of, "a long, b long")


def linked(nodes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(node, component) of the nodes that are linked to others. ``nodes``: as from ``sketched``."""
    entries = nodes.where("n_words > 0").select("node", F.explode("entries").alias("bucket"))
    # least and greatest node come from sums within the tasks, and large buckets are split by the join: no bucket is one task
    ends = entries.groupBy("bucket").agg(F.min("node").alias("least"), F.max("node").alias("greatest")).where("least != greatest")
    ends = stored(ends.select("bucket", "least"), "ends")
    buckets = stored(entries.join(ends, "bucket"), "buckets")
    words = stored(nodes.join(buckets.select("node").distinct(), "node", "left_semi"), "words")
    tried = stored(_pairs_with_least(buckets), "pairs")
    found = stored(verified(tried, words, similarity), "links")
    joined = stored(components(found), "components")

    labels = words.select("node", "n_words").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    labelled = buckets.join(labels, "node").select("bucket", "node", "n_words", "component")
    sizes = _with_several(labelled)
    rows = stored(labelled.join(sizes, "bucket"), "rows")
    pairs = stored(_pairs_of_small(rows.where(F.col("size") <= SMALL).drop("size")).join(tried, ["a", "b"], "left_anti"), "pairs")
    more = verified(pairs, words, similarity).unionByName(_links_in_large(rows.where(F.col("size") > SMALL).drop("size"), words, similarity))
    more = stored(more, "links")
    if not more.isEmpty():
        again = stored(components(found.unionByName(more)), "components")
        drop_table(joined)
        joined = again
    for t in (ends, buckets, words, tried, found, sizes, rows, pairs, more):
        drop_table(t)
    return joined


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, node, component, class_id for each row of ``docs`` (doc_id, text) with a text."""
    nodes = stored(sketched(docs), "nodes")
    joined = linked(nodes, similarity)
    drop_table(nodes)
    full = docs.where(F.coalesce(F.col("text"), F.lit("")) != "")
    members = full.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("node"))
    members = members.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    members = stored(members, "members")
    # written, so that the join below is of plain tables: Spark splits a large class among tasks then
    ids = stored(members.groupBy("component").agg(F.min("doc_id").alias("class_id")), "ids")
    out = stored(members.join(ids, "component").select("doc_id", "node", "component", "class_id"), "classes")
    for t in (joined, members, ids):
        drop_table(t)
    return out


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id, component for each row of ``docs`` (doc_id, text)."""
    own = F.col("doc_id").cast("long")
    empty = docs.where(F.coalesce(F.col("text"), F.lit("")) == "").select(own.alias("doc_id"), own.alias("class_id"), F.lit(None).cast("long").alias("component"))
    return classes(docs, similarity).drop("node").unionByName(empty)


def deduplicated(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of ``docs`` for each class: of those with its least doc_id, one with the least hash of its text. Rows without a text all stay."""
    key = lambda i, node: F.xxhash64(i.isNull(), i, node)
    of = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")
    kept = classes(docs, similarity).groupBy("component").agg(F.min(of).alias("kept")).select(key(F.col("kept.doc_id"), F.col("kept.node")).alias("key"))
    rows = docs.select(packed(docs), key(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("key"), (F.coalesce(F.col("text"), F.lit("")) == "").alias("empty"))
    some = rows.where(~F.col("empty")).join(stored(kept, "kept"), "key", "left_semi").dropDuplicates(["key"])
    return some.unionByName(rows.where("empty")).select("row.*")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near-duplicates of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))
