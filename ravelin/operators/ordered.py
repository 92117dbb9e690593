"""Windows over a whole table: ranks, running sums and RANGE frames without a task that sees all rows.

A window without PARTITION BY is one task in Spark. Here the table is range-partitioned by the order and sorted within
partitions; every task numbers its rows, counts runs of equal keys and adds up, carrying on from batch to batch; a row for
each partition comes to the driver, which is as many as ``spark.sql.shuffle.partitions``, and goes back as what all
partitions before it hold. Ties may lie in several partitions: the order may have more columns than the keys, so a key that
a third of all rows have is as many partitions as its rows need, and the driver's rows say where a run goes on.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.sources.tables import written


def _partitions(df: DataFrame) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)


def _numbered(running: Sequence[str]):
    """For mapInArrow over sorted rows: the place of each row, its run of equal keys, where that began, and sums so far."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, run, began, last, so_far = 0, -1, 0, None, [0] * len(running)
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            key = b.column("_key").to_numpy()
            new = np.concatenate([[last is None or key[0] != last], key[1:] != key[:-1]])
            places = np.arange(place, place + n)
            runs, starts = run + np.cumsum(new), np.maximum.accumulate(np.where(new, places, began))
            sums = []
            for i, name in enumerate(running):
                total = so_far[i] + np.cumsum(b.column(name).fill_null(0).to_numpy())
                so_far[i] = int(total[-1])
                sums.append(pa.array(total))
            place, run, began, last = place + n, int(runs[-1]), int(starts[-1]), key[-1]
            own = {"_place": pa.array(places), "_run": pa.array(runs), "_began": pa.array(starts), **{f"_sum{i}": s for i, s in enumerate(sums)}}
            yield pa.record_batch([*b.columns, *own.values()], [*b.schema.names, *own])

    return of


def positioned(rows: DataFrame, keys: Sequence[str], *, ties: Sequence[str] = (), running: Sequence[str] = (), name: str = "positioned") -> DataFrame:
    """``rows`` with row_number, rank, dense_rank (long), percent_rank (double), n_rows, and ``running_x`` for each long column x of ``running``.

    Rows of equal ``keys`` (as told by a 64-bit hash of them) share ranks; ``ties`` decide row_number and running sums among them; rows that are equal
    in both come in any order. All columns ascend; nulls come first and are equal. A null adds 0; sums have to fit into a long. No rows: none.
    """
    spark, own = rows.sparkSession, rows.columns
    plain = rows.withColumn("_key", F.xxhash64(*keys))
    sorted_rows = plain.repartitionByRange(_partitions(rows), *keys, *ties).sortWithinPartitions(*keys, *ties).withColumn("_part", F.spark_partition_id())
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in sorted_rows.schema), "_place long", "_run long", "_began long", *(f"_sum{i} long" for i in range(len(running)))])
    table = written(sorted_rows.mapInArrow(_numbered(running), schema), name)

    ends = table.groupBy("_part").agg(
        F.count("*").alias("n"), F.max("_run").alias("run"), F.max("_began").alias("began"), F.min_by("_key", "_place").alias("first"), F.max_by("_key", "_place").alias("last"),
        *(F.max_by(f"_sum{i}", "_place").alias(f"sum{i}") for i in range(len(running))),
    )
    before, n, dense, run_rank, last, sums = [], 0, 0, 0, None, [0] * len(running)
    for r in sorted(ends.collect(), key=lambda r: r["_part"]):  # a row for each partition
        goes_on = n > 0 and r["first"] == last
        first_rank = run_rank if goes_on else n + 1
        before.append((r["_part"], n, dense - goes_on, first_rank, *sums))
        run_rank = first_rank if r["run"] == 0 else n + r["began"] + 1
        n, dense, last, sums = n + r["n"], dense - goes_on + r["run"] + 1, r["last"], [s + r[f"sum{i}"] for i, s in enumerate(sums)]
    offsets = spark.createDataFrame(before, ", ".join(["_part int", "_n long", "_dense long", "_first long", *(f"_before{i} long" for i in range(len(running)))]))
    both = table.join(F.broadcast(offsets), "_part")  # a row for each partition
    rank = F.when(F.col("_run") == 0, F.col("_first")).otherwise(F.col("_n") + F.col("_began") + 1)
    return both.select(
        *(F.col(f"`{c}`") for c in own), (F.col("_n") + F.col("_place") + 1).alias("row_number"), rank.alias("rank"), (F.col("_dense") + F.col("_run") + 1).alias("dense_rank"),
        ((rank - 1) / F.lit(float(max(n - 1, 1)))).alias("percent_rank"), F.lit(n).cast("long").alias("n_rows"), *((F.col(f"_before{i}") + F.col(f"_sum{i}")).alias(f"running_{c}") for i, c in enumerate(running)),
    )


def ntile(buckets: int) -> Column:
    """The bucket (from 1) of a row of ``positioned``: the first buckets have one row more if they can't be equal."""
    n, i = F.col("n_rows"), F.col("row_number") - 1
    size, more = F.floor(n / buckets), n % buckets
    return F.when(i < more * (size + 1), F.floor(i / (size + 1))).otherwise(more + F.floor((i - more * (size + 1)) / F.greatest(size, F.lit(1)))).cast("int") + 1


def trailing(rows: DataFrame, at: str, width: int, sums: Sequence[str]) -> DataFrame:
    """For each value of the long column ``at``, ``sums`` over all rows from ``at - width`` to ``at``, both inclusive, and their number ``n``.

    Rows are summed by value first. A frame is the running sum at its end less that before its start; where a frame starts there is a row of zeros in the
    same order, so one pass has both, whatever the width. Rows with a null ``at`` have no frame.
    """
    whole = rows.where(F.col(at).isNotNull()).groupBy(at).agg(*(F.sum(s).alias(s) for s in sums), F.count("*").alias("n"))
    names = [*sums, "n"]
    ends = whole.select(F.col(at).alias("own"), F.col(at).alias("pos"), F.lit(1).alias("end"), *names)
    starts = whole.select(F.col(at).alias("own"), (F.col(at) - width).alias("pos"), F.lit(0).alias("end"), *(F.lit(0).cast("long").alias(s) for s in names))
    marked = positioned(ends.unionByName(starts), ["pos", "end"], running=names, name="trailing")
    sign = F.when(F.col("end") == 1, 1).otherwise(-1)
    return marked.groupBy(F.col("own").alias(at)).agg(*(F.sum(sign * F.col(f"running_{s}")).alias(s) for s in names))


def _lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


def line_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines by quantity: rank, dense_rank, percent_rank, hundredths by ntile, and the running sum of cents; ties by the other columns."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    rows = _lineitem(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", cents.alias("cents"))
    placed = positioned(rows, ["l_quantity"], ties=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "cents"], running=["cents"])
    return placed.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "cents", "row_number", "rank", "dense_rank", "percent_rank", ntile(100).alias("hundredth"), "running_cents")


LINE_RANKS_SQL = """
WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, cents, row_number() OVER o AS row_number, rank() OVER (ORDER BY l_quantity) AS rank, dense_rank() OVER (ORDER BY l_quantity) AS dense_rank,
  percent_rank() OVER (ORDER BY l_quantity) AS percent_rank, CAST(ntile(100) OVER o AS INT) AS hundredth, CAST(sum(cents) OVER (o ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_cents
FROM l WINDOW o AS (ORDER BY l_quantity, l_orderkey, l_linenumber, l_partkey, l_suppkey, cents)"""


def ship_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each day of shipping, the lines and the quantity shipped on it and on the six days before."""
    day = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', l_shipdate)")
    rows = _lineitem(spark, sf_dir).select(day.alias("day"), F.col("l_quantity").cast("long").alias("quantity"))
    return trailing(rows, "day", 6 * 86_400_000_000, ["quantity"])


SHIP_FRAMES_SQL = """
WITH d AS (SELECT l_shipdate, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q, count(*) AS c FROM lineitem GROUP BY 1)
SELECT epoch_us(l_shipdate) AS day, CAST(sum(q) OVER w AS BIGINT) AS quantity, CAST(sum(c) OVER w AS BIGINT) AS n FROM d
WINDOW w AS (ORDER BY l_shipdate RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW)"""
