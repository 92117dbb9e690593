"""Grouping sets from mergeable cells: sums, and sketches of distinct values and of quantiles.

The rows are aggregated once, to the finest cells; every coarser level is merged from the cells, never from the rows. Counts
and sums merge exactly. Distinct values are HyperLogLog sketches and quantiles KLL sketches, a few kilobytes in a cell,
whose unions are the sketches of the union of the rows; so cells of many days can be kept as a table, and a new day is merged into it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.sources.tables import written

#: 2**12 registers: a standard error of about 1.6 %. KLL with k = 200: a rank error of about 1.7 % with a chance of 99 %.
LOG_REGISTERS, KLL_K = 12, 200


def cells(rows: DataFrame, dims: Sequence[str], *, sums: Sequence[str] = (), distinct: Sequence[str] = (), quantiles: Sequence[str] = ()) -> DataFrame:
    """A row for each combination of ``dims``: n, and for each name x its sum, ``x_distinct`` and ``x_spread`` (sketches; x of quantiles is a long).

    Nulls in ``dims`` are values of their own; null measures are not counted in sums or sketches; sketches of nothing are null or empty.
    """
    return rows.groupBy(*dims).agg(
        F.count("*").alias("n"), *(F.sum(s).alias(s) for s in sums), *(F.hll_sketch_agg(d, LOG_REGISTERS).alias(f"{d}_distinct") for d in distinct),
        *(F.kll_sketch_agg_bigint(q, F.lit(KLL_K)).alias(f"{q}_spread") for q in quantiles),
    )


def merged(table: DataFrame, by: Sequence[str], *, sums: Sequence[str] = (), distinct: Sequence[str] = (), quantiles: Sequence[str] = ()) -> list[Column]:
    """What merges columns of ``cells``; the same columns come out."""
    return [F.sum("n").alias("n"), *(F.sum(s).alias(s) for s in sums), *(F.hll_union_agg(f"{d}_distinct").alias(f"{d}_distinct") for d in distinct), *(F.kll_merge_agg_bigint(f"{q}_spread", F.lit(KLL_K)).alias(f"{q}_spread") for q in quantiles)]


def united(old: DataFrame, new: DataFrame, dims: Sequence[str], **measures: Sequence[str]) -> DataFrame:
    """The cells of two sets of rows that have no row in common."""
    return old.unionByName(new).groupBy(*dims).agg(*merged(old, dims, **measures))


def rolled(table: DataFrame, dims: Sequence[str], sets: Sequence[Sequence[str]], **measures: Sequence[str]) -> DataFrame:
    """Grouping sets over ``cells``: ``dims`` (null where a set leaves one out), ``level``, and the merged columns.

    ``level`` is the grouping id: a bit for each of ``dims``, the first the highest, 1 where it is left out; it tells a null that is a value from one
    that is not. The set of no columns is one row, also if there are no cells.
    """
    together = table.groupingSets([[F.col(d) for d in s] for s in sets], *dims).agg(F.grouping_id().cast("int").alias("level"), *merged(table, dims, **measures))
    return together.select(*dims, "level", *[c for c in table.columns if c not in dims])


def estimates(rows: DataFrame, *, distinct: Sequence[str] = (), quantiles: Sequence[str] = (), at: Sequence[float] = (0.5, 0.9)) -> DataFrame:
    """Sketch columns as numbers: ``n_x`` of distinct values, ``x_p50`` and so on of quantiles."""
    out = rows.withColumns({f"n_{d}": F.hll_sketch_estimate(f"{d}_distinct") for d in distinct})
    out = out.withColumns({f"{q}_p{round(100 * p)}": F.kll_sketch_get_quantile_bigint(f"{q}_spread", F.lit(p)) for q in quantiles for p in at})
    return out.drop(*(f"{d}_distinct" for d in distinct), *(f"{q}_spread" for q in quantiles))


DIMS = ("brand", "kind", "month")
SETS = (("brand", "kind", "month"), ("brand", "kind"), ("kind", "month"), ("brand",), ("month",), ())


def _sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, parts = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("lineitem", "part"))
    month = F.date_format("l_shipdate", "yyyy-MM").alias("month")
    sold = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"), "left")
    return sold.select(F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"), month, F.col("l_quantity").cast("long").alias("quantity"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"), F.col("l_orderkey").alias("orders"))


def sales_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, quantity and cents by brand, type and month and five coarser levels, from one table of cells."""
    table = written(cells(_sales(spark, sf_dir), DIMS, sums=["quantity", "cents"]), "cells")
    return rolled(table, DIMS, SETS, sums=["quantity", "cents"])


SALES_ROLLUP_SQL = """
WITH s AS (SELECT p_brand AS brand, p_type AS kind, strftime(l_shipdate, '%Y-%m') AS month, CAST(l_quantity AS BIGINT) AS quantity, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem LEFT JOIN part ON l_partkey = p_partkey)
SELECT brand, kind, month, CAST(grouping(brand, kind, month) AS INT) AS level, count(*) AS n, CAST(sum(quantity) AS BIGINT) AS quantity, CAST(sum(cents) AS BIGINT) AS cents
FROM s GROUP BY GROUPING SETS ((brand, kind, month), (brand, kind), (kind, month), (brand), (month), ())"""


def sales_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different orders, and the median and the 90th percentile of cents, at all those levels, by sketches merged from the cells."""
    table = written(cells(_sales(spark, sf_dir), DIMS, distinct=["orders"], quantiles=["cents"]), "sketches")
    return estimates(rolled(table, DIMS, SETS, distinct=["orders"], quantiles=["cents"]), distinct=["orders"], quantiles=["cents"])
