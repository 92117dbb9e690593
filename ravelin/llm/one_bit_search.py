"""Approximate nearest neighbours by randomly rotated one-bit codes.

A vector x less a centre c has a length r and a direction o. After a random rotation, only the signs of o are kept, one
bit for each dimension, packed; they stand for the unit vector b with entries +-1/sqrt(D). Two scalars belong to a code:
r, and f = <b, o>. For a query direction q, <b, q> / f estimates <o, q>, with an error that is, for all but a part of
rotations that falls as exp(-bound**2 / 2), less than sqrt((1 - f**2) / f**2) * bound / sqrt(D - 1). With the lengths
this gives a lower bound of the distance. Rows whose lower bound is above the k-th nearest distance known so far are
passed over, all others are measured on the original vectors; so what is returned is ranked by the distance itself, and a
neighbour is missed only where its bound fails. Every row is indexed and looked at by every query; nothing is fitted but
the centre, the mean of ``sample`` rows with the least hashes.

The same sample gives every query a first limit, the k-th nearest distance within it, which holds for all rows.

The plan: rows are dealt into groups of about ``group_mb`` by a hash of their ids and every group gets the queries,
which are few beside the rows; a task holds the rows of a group as codes and vectors, and its queries pass by in
batches. There is no join and no row for a pair but for a query's k nearest in each group, below its first limit; of
these, tasks keep k for each query before they come together. The vectors are shuffled once, the queries once for each
group. A group that is lost is made again from the input.

Vectors that are null, zero or hold null or non-finite components take no part; nor do vectors of another width than
most rows have (of widths that equally many have, the greatest). Among equal vectors only the k + 1 with the least ids can be among the k nearest of a
query, itself aside, so a vector that a third of all rows have costs each group no more than that. Rows with the
query's id are its own rows. Null ids are the greatest id; a query with null id is left out. Queries that are equal rows
are one query, those of equal id and different vectors have their own k rows each. An empty table gives no rows. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ravelin.llm.shared import table

#: Rows of codes and queries that are compared at a time.
_ROWS, _QUERIES = 8192, 512
_NO_ID = (1 << 63) - 1


def usable(vector: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(vector.isNotNull() & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def rotation(width: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, width)))
    return q * np.sign(np.diag(r))


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows in double precision, components added in their order."""
    total = np.zeros(len(x))
    for j in range(x.shape[1]):
        d = x[:, j].astype(np.float64) - y[:, j]
        total += d * d
    return np.sqrt(total)


def matrix(vectors: pa.Array) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


class Codes:
    """One-bit codes of rows, with their scalars."""

    def __init__(self, x: np.ndarray, centre: np.ndarray, turn: np.ndarray, bound: float):
        width = x.shape[1]
        o = (x.astype(np.float64) - centre) @ turn
        self.length = np.sqrt((o * o).sum(1))
        o = np.divide(o, self.length[:, None], out=np.zeros_like(o), where=self.length[:, None] > 0)
        self.bits = np.packbits(o >= 0, axis=1)
        self.fit = np.maximum(np.abs(o).sum(1) / np.sqrt(width), 1e-6)
        self.error = np.sqrt(np.maximum(1 - self.fit**2, 0)) / self.fit * bound / np.sqrt(max(width - 1, 1))
        self.width = width

    def least(self, rows: slice, direction: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Lower bounds of the squared distances of the queries (turned directions and lengths) to ``rows``."""
        signs = np.unpackbits(self.bits[rows], axis=1, count=self.width).astype(np.float32)
        signs = (2 * signs - 1) / np.float32(np.sqrt(self.width))
        most = (direction @ signs.T) / self.fit[rows].astype(np.float32) + (self.error[rows] + 1e-4).astype(np.float32)
        r = self.length[rows]
        squares = (length**2)[:, None] + (r * r)[None, :]
        return squares * (1 - 1e-9) - 2 * length[:, None] * r[None, :] * np.minimum(most, 1)


def _first_of_equals(ids: np.ndarray, x: np.ndarray, most: int) -> np.ndarray:
    """Indexes of the rows that are among the ``most`` with the least ids of all that have the same vector."""
    _, same = np.unique((x + np.zeros(1, x.dtype)).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel(), return_inverse=True)
    order = np.lexsort((ids, same))
    starts = np.flatnonzero(np.concatenate([[True], np.diff(same[order]) > 0]))
    place = np.arange(len(order)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(order)]])))
    return np.sort(order[place < most])


def _nearest_k(query: np.ndarray, far: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the ``k`` nearest of each query, ties to the lesser id, in that order."""
    order = np.lexsort((ids, far, query))
    starts = np.flatnonzero(np.concatenate([[True], np.diff(query[order]) > 0])) if len(order) else np.zeros(0, np.int64)
    place = np.arange(len(order)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(order)]])))
    return order[place < k]


class Group:
    """The rows of one group, against batches of queries."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, centre: np.ndarray, turn: np.ndarray, k: int, bound: float):
        kept = _first_of_equals(ids, x, k + 1) if len(ids) else np.zeros(0, np.int64)
        self.ids, self.x, self.k, self.centre, self.turn = ids[kept], x[kept], k, centre, turn
        self.codes = Codes(self.x, centre, turn, bound) if len(kept) else None

    def search(self, ids: np.ndarray, q: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's index, row's id, distance) of the k nearest of each query, of those within its limit."""
        turned = (q.astype(np.float64) - self.centre) @ self.turn
        length = np.sqrt((turned * turned).sum(1))
        direction = np.divide(turned, length[:, None], out=np.zeros_like(turned), where=length[:, None] > 0).astype(np.float32)
        limit = limit.copy()
        found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        for start in range(0, len(self.ids), _ROWS):
            rows = slice(start, start + _ROWS)
            near = (self.codes.least(rows, direction, length) <= (limit**2 * (1 + 1e-9))[:, None]) & (self.ids[rows] != ids[:, None])
            query, row = np.nonzero(near)
            row += start
            parts = [distances(self.x[row[i : i + (1 << 18)]], q[query[i : i + (1 << 18)]]) for i in range(0, len(row), 1 << 18)]
            far = np.concatenate([*parts, np.zeros(0)])
            inside = far <= limit[query]
            found = [np.concatenate([a, b]) for a, b in zip(found, (query[inside], self.ids[row[inside]], far[inside]), strict=True)]
            best = _nearest_k(found[0], found[2], found[1], self.k)
            found = [a[best] for a in found]
            count = np.bincount(found[0], minlength=len(ids))
            last = np.cumsum(count) - 1
            limit = np.where(count >= self.k, found[2][last] if len(found[2]) else limit, limit)
        return found[0], found[1], found[2]


def _search(batches: Iterator[pa.RecordBatch], centre: np.ndarray, turn: np.ndarray, k: int, bound: float) -> Iterator[pa.RecordBatch]:
    """Rows of a group come before its queries; several groups may follow each other."""
    now, held, group = None, [], None
    for b in batches:
        numbers = b.column("group").to_numpy()
        asks = b.column("limit").is_valid().to_numpy(zero_copy_only=False)
        edges = np.flatnonzero((np.diff(numbers) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
        for start, end in zip([0, *edges], [*edges, b.num_rows], strict=True):
            if start == end:
                continue
            part = b.slice(start, end - start)
            if numbers[start] != now:
                now, held, group = numbers[start], [], None
            ids, x = part.column("vec_id").to_numpy(), matrix(part.column("embedding"))
            if not asks[start]:
                held.append((ids, x))
                continue
            if not held and group is None:
                continue  # a group without rows
            if group is None:
                group, held = Group(np.concatenate([i for i, _ in held]), np.concatenate([v for _, v in held]), centre, turn, k, bound), []
            limits = part.column("limit").to_numpy()
            for i in range(0, len(ids), _QUERIES):
                some = slice(i, i + _QUERIES)
                query, row, far = group.search(ids[some], x[some], limits[some])
                keys = part.column("key").slice(i, _QUERIES)
                yield pa.record_batch([pa.array(ids[some][query]), keys.take(pa.array(query)), pa.array(row), pa.array(far)], ["query_id", "key", "vec_id", "score"])


def _limits(batches: Iterator[pa.RecordBatch], ids: np.ndarray, x: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """The k-th nearest distance of each query within the sample, infinite if it has no k rows; rounding is allowed for."""
    x64 = x.astype(np.float64)
    squares = (x64 * x64).sum(1)
    for b in batches:
        out = []
        for i in range(0, b.num_rows, _QUERIES):
            some = b.slice(i, _QUERIES)
            own, q = some.column("vec_id").to_numpy(), matrix(some.column("embedding")).astype(np.float64)
            size = (q * q).sum(1)[:, None] + squares
            far = np.sqrt(np.maximum(size - 2 * (q @ x64.T), 0) + 1e-12 * size) * (1 + 1e-6)
            far[own[:, None] == ids] = np.inf
            out.append(np.partition(far, k - 1, axis=1)[:, k - 1] if far.shape[1] >= k else np.full(len(own), np.inf))
        limit = pa.array(np.concatenate([*out, np.zeros(0)]))
        yield pa.record_batch([*(b.column(c) for c in ("vec_id", "key", "embedding")), limit], ["vec_id", "key", "embedding", "limit"])


def nearest(vectors: DataFrame, queries: DataFrame, *, k: int = 10, bound: float = 3.5, sample: int = 4096, group_mb: float = 32.0, seed: int = 11) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows of ``vectors`` (vec_id, embedding) nearest to each of ``queries``, Euclidean."""
    spark = vectors.sparkSession
    rows = vectors.where(usable(F.col("embedding"))).select(F.coalesce("vec_id", F.lit(_NO_ID)).alias("vec_id"), "embedding")
    first = rows.groupBy(F.size("embedding").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).limit(1).collect()
    kind = vectors.schema["embedding"].dataType.simpleString()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not first:
        return empty
    width = first[0]["width"]
    rows = rows.where(F.size("embedding") == width)
    asked = queries.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull() & (F.size("embedding") == width))
    asked = asked.select("vec_id", F.xxhash64("embedding").alias("key"), "embedding").dropDuplicates(["vec_id", "embedding"])
    drawn = rows.orderBy(F.xxhash64(F.lit(seed), "vec_id"), "vec_id", "embedding").limit(sample).toArrow().combine_chunks()  # bounded by ``sample``
    ids, x = drawn.column("vec_id").to_numpy(), matrix(drawn.column("embedding").combine_chunks())
    centre, turn = x.astype(np.float64).mean(0), rotation(width, seed)

    n = first[0]["count"]
    groups = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), int(n * width * 4 / (group_mb * 1e6)))
    dealt = rows.select(F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(groups)).cast("int").alias("group"), "vec_id", F.lit(0).cast("long").alias("key"), "embedding", F.lit(None).cast("double").alias("limit"))
    asked = asked.mapInArrow(partial(_limits, ids=ids, x=x, k=k), f"vec_id long, key long, embedding {kind}, limit double")
    sent = asked.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), "vec_id", "key", "embedding", "limit")
    both = dealt.unionByName(sent).repartitionById(groups, "group").sortWithinPartitions("group", F.col("limit").isNotNull())
    found = both.mapInArrow(partial(_search, centre=centre, turn=turn, k=k, bound=bound), "query_id long, key long, vec_id long, score double")
    order = Window.partitionBy("query_id", "key").orderBy("score", "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)  # tasks keep k of a query before the shuffle
    return best.select("query_id", "rank", F.nullif("vec_id", F.lit(_NO_ID)).alias("vec_id"), "score")


def op11_one_bit_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest rows of each row whose id is divisible by 100."""
    e = table(spark, sf_dir, "embeddings")
    return nearest(e, e.where("vec_id % 100 = 0"))


OP11_SQL = """
WITH e AS MATERIALIZED (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, e.vec_id, sqrt(list_reduce(list_transform(list_zip(q.v, e.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])), lambda a, b: a + b)) AS score FROM e q JOIN e ON q.vec_id % 100 = 0 AND q.vec_id <> e.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INT) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 10
"""
