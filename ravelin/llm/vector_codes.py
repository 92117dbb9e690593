"""Vector code compression: parts of integer vectors as indexes of codebook entries, found by screened matrix products.

A component x becomes floor(``scale`` * x). Vectors are cut into ``parts`` equal consecutive parts; each part position
has a codebook, which starts as that part of the vectors with the least ids and moves for ``rounds`` rounds to the
floored means of the parts assigned to each entry. All results are exact: the nearest entry is that of integer
arithmetic, ties to the lower index.

How the nearest entry is found: a float32 matrix product gives all inner products a.c of a batch at once. Its error is
at most g |a||c| with g = (n + 2) u / (1 - (n + 2) u), u = 2**-24 and n components in a part (two roundings to float32,
n products and sums in any order, Cauchy-Schwarz), so |c|^2 - 2 a.c lies in an interval. Where the interval of one
entry alone reaches below the upper end of the best, that entry is the nearest. All other entries that overlap the best
are evaluated in int64, and the least distance, then the least index, wins. Where int64 could overflow, Python's
integers take its place.

Every round is one pass over the vectors: a task sums its parts by entry and sends at most ``parts`` * ``entries`` rows
of a part's width; their sums are that many rows for the whole table, which the driver turns into the next codebooks.
Codebooks (a few kilobytes) go to the tasks with the code. A lost executor costs its tasks of the round.

Rows without a vector, or with a component that is null, not finite or 2**60 or more in magnitude, are left out; so are
vectors whose width is no positive multiple of ``parts`` or is another than most of the others have (of widths that
equally many have, the greatest). Null ids come last in the order of ids, rows of equal id in the order of their vectors; repeated rows count as often as they
stand. With fewer rows than ``entries`` the codebooks are that much shorter. A squared distance that does not fit into
a long is null. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm.shared import stored, table

_LONGEST = (1 << 63) - 1


@dataclass(frozen=True)
class Codebooks:
    """``entries[p][e]``: the components of entry ``e`` of part ``p``, as Python integers."""

    entries: tuple[tuple[tuple[int, ...], ...], ...]

    @property
    def digest(self) -> str:
        """SHA-256 of all components in decimal by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(x) for part in self.entries for entry in part for x in entry).encode()).hexdigest()


def usable(vector: Column, parts: int) -> Column:
    inside = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(2.0**60))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & (F.size(vector) % parts == 0) & F.forall(vector, inside), F.lit(False))


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), exactly: int64 where squared distances fit into it, Python's integers elsewhere."""
    y = np.floor(x.astype(np.float64) * scale)  # exact: a power of two times a double of moderate size
    if not y.size or np.abs(y).max() < 2.0**30 / np.sqrt(x.shape[-1]):
        return y.astype(np.int64)
    return np.array([int(v) for v in y.ravel()], object).reshape(y.shape)


def nearest_entry(a: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest row of ``c`` for each row of ``a``; integers, ties to the lower index."""
    n, width = a.shape
    if a.dtype == object or c.dtype == object or np.abs(c).max() >= 2.0**30 / np.sqrt(width):
        far = ((a.astype(object)[:, None, :] - c.astype(object)[None, :, :]) ** 2).sum(2)
        index = np.array([min(range(len(c)), key=row.__getitem__) for row in far], np.int64)
        return index, far[np.arange(n), index]
    a32, c32 = a.astype(np.float32), c.astype(np.float32)
    u = (width + 2) * 2.0**-24
    long_a, long_c = (np.sqrt((x.astype(np.float64) ** 2).sum(1)) for x in (a, c))
    cc = (c * c).sum(1)
    with np.errstate(over="ignore", invalid="ignore"):
        score = cc - 2.0 * (a32 @ c32.T)
        # the second term: roundings of the doubles in score, in the lengths and in the sums below
        off = 2.0 * (u / (1 - u)) * (1 + 1e-9) * long_a[:, None] * long_c + 2.0**-48 * (cc + long_a[:, None] * long_c)
        near = ~(score - off > (score + off).min(1, keepdims=True))
    index = near.argmax(1)
    open_rows = np.flatnonzero(near.sum(1) > 1)
    if len(open_rows):
        row, entry = np.nonzero(near[open_rows])
        far = ((a[open_rows[row]] - c[entry]) ** 2).sum(1)
        first = np.concatenate([[0], np.flatnonzero(np.diff(row)) + 1])
        least = np.minimum.reduceat(far, first)
        index[open_rows] = np.minimum.reduceat(np.where(far == least[row], entry, len(c)), first)
    return index, ((a - c[index]) ** 2).sum(1)


def _matrix(vectors: pa.Array) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def _assigned(vectors: pa.Array, codebooks: Codebooks, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(parts, index, squared distance) for each part position."""
    x = integers(_matrix(vectors), scale)
    for a, entries in zip(np.split(x, len(codebooks.entries), axis=1), codebooks.entries, strict=True):
        c = np.array(entries, object)
        small = max(abs(v) for entry in entries for v in entry) < 1 << 62
        yield a, *nearest_entry(a, c.astype(np.int64) if small else c)


def _sums(batches: Iterator[pa.RecordBatch], codebooks: Codebooks, scale: int) -> Iterator[pa.RecordBatch]:
    """For each part, entry and position the sum over all batches of a task, and how many parts it has."""
    total: dict[tuple[int, int], list] = {}
    for b in batches:
        if not b.num_rows:
            continue
        for p, (a, index, _) in enumerate(_assigned(b.column("embedding"), codebooks, scale)):
            for e in np.unique(index):
                own = a[index == e]
                held = total.setdefault((p, int(e)), [0, [0] * a.shape[1]])
                held[0] += len(own)
                held[1] = [x + int(y) for x, y in zip(held[1], own.sum(0), strict=True)]
    rows = [(p, e, i, Decimal(s), n) for (p, e), (n, all_of) in total.items() for i, s in enumerate(all_of)]
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.decimal128(38, 0), pa.int64())
    yield pa.record_batch([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["part", "entry", "place", "total", "n"])


def _coded(batches: Iterator[pa.RecordBatch], codebooks: Codebooks, scale: int) -> Iterator[pa.RecordBatch]:
    digits = np.array([f"{i:02x}" for i in range(256)], object)
    for b in batches:
        code, error = np.full(b.num_rows, "", object), np.zeros(b.num_rows, object)
        if b.num_rows:
            for _, index, far in _assigned(b.column("embedding"), codebooks, scale):
                code += digits[index]
                error += far.astype(object)
        fits = pa.array([int(e) if e <= _LONGEST else None for e in error], pa.int64())
        yield pa.record_batch([b.column("row"), pa.array(code, pa.string()), fits], ["row", "code", "error"])


def kept(vectors: DataFrame, *, parts: int = 8) -> DataFrame:
    """The rows of ``vectors`` that take part, those of one width."""
    rows = vectors.where(usable(F.col("embedding"), parts))
    first = rows.groupBy(F.size("embedding").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).limit(1).collect()
    return rows.where(F.size("embedding") == (first[0]["width"] if first else 0))


def trained(rows: DataFrame, *, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> Codebooks | None:
    """Codebooks of ``rows`` (of ``kept``), of at most 256 entries; None for no rows."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").select("embedding").limit(entries).toArrow().column(0).combine_chunks()
    if not len(first):
        return None
    start = np.split(integers(_matrix(first), scale), parts, axis=1)
    books = [[[int(v) for v in entry] for entry in part] for part in start]
    for _ in range(rounds):
        now = Codebooks(tuple(tuple(map(tuple, part)) for part in books))
        made = rows.select("embedding").mapInArrow(partial(_sums, codebooks=now, scale=scale), "part int, entry int, place int, total decimal(38,0), n long")
        for r in made.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():  # a row for each component of the codebooks
            books[r["part"]][r["entry"]][r["place"]] = int(r["total"]) // r["n"]
    return Codebooks(tuple(tuple(map(tuple, part)) for part in books))


def compressed(vectors: DataFrame, *, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """row (all columns of ``vectors``), code, error, codebooks_sha256 for each row that takes part."""
    rows = kept(vectors, parts=parts)
    books = trained(rows, parts=parts, entries=entries, rounds=rounds, scale=scale)
    spark = vectors.sparkSession
    packed = F.struct(*(F.col(f"`{c}`") for c in vectors.columns if c != "embedding")).alias("row")
    coded = rows.select(packed, "embedding") if books else rows.limit(0).select(packed, "embedding")
    schema = f"row {coded.schema['row'].dataType.simpleString()}, code string, error long"
    books = books or Codebooks(())
    out = coded.mapInArrow(partial(_coded, codebooks=books, scale=scale), schema) if books.entries else spark.createDataFrame([], schema)
    return out.withColumn("codebooks_sha256", F.lit(books.digest))


def with_label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` (vec_id, label, code, error, ...) with ``label_error``: the errors of equal labels together, null labels as one.

    Errors are summed within the tasks first, so a label that most rows have is no large group. The sums are a written
    table: Spark sends it to all tasks if it is small, and joins it by label, splitting large ones, if not. Null if an
    error of the label is null or the sum does not fit into a long.
    """
    whole = F.when(F.count("error") == F.count("*"), F.sum(F.col("error").cast("decimal(38,0)")))
    sums = coded.groupBy("label").agg(whole.alias("total"))
    sums = stored(sums.select("label", F.when(F.col("total") <= _LONGEST, F.col("total").cast("long")).alias("label_error")), "label-errors")
    c, s = coded.alias("c"), sums.alias("s")
    return c.join(s, F.col("c.label").eqNullSafe(F.col("s.label")), "left").select("c.*", "s.label_error")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors, with their errors and those of their labels."""
    coded = compressed(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    coded = stored(coded.select("row.vec_id", "row.label", "code", "error", "codebooks_sha256"), "vector-codes")
    return with_label_errors(coded).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _rounds_sql(rounds: int) -> str:
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""far{i} AS MATERIALIZED (
  SELECT n, part, entry, sum((x - c) * (x - c)) AS far FROM comps JOIN book{i} USING (part, place) GROUP BY ALL),
own{i} AS MATERIALIZED (SELECT n, part, arg_min(entry, far * 16 + entry) AS entry, min(far) AS far FROM far{i} GROUP BY ALL)""")
        if i < rounds:
            steps.append(f"""sums{i} AS (SELECT part, entry, place, CAST(sum(x) AS HUGEINT) AS s, count(*) AS k FROM comps JOIN own{i} USING (n, part) GROUP BY ALL),
book{i + 1} AS MATERIALIZED (
  SELECT part, entry, place, CASE WHEN k IS NULL THEN c ELSE CAST((s - ((s % k) + k) % k) // k AS BIGINT) END AS c
  FROM book{i} LEFT JOIN sums{i} USING (part, entry, place))""")
    return ",\n".join(steps)


OP12_SQL = f"""
WITH rows AS MATERIALIZED (
  SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS n FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
flat AS (SELECT n, unnest(range(len(embedding))) AS i, CAST(floor(4096 * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS x, len(embedding) // 8 AS w FROM rows),
comps AS MATERIALIZED (SELECT n, i // w AS part, i % w AS place, x FROM flat),
book0 AS MATERIALIZED (SELECT part, n AS entry, place, x AS c FROM comps WHERE n < 16),
{_rounds_sql(6)},
codes AS (SELECT n, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(far) AS BIGINT) AS error FROM own6 GROUP BY n)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(c, ',' ORDER BY part, entry, place)) FROM book6) AS codebooks_sha256
FROM codes JOIN rows USING (n)
"""
