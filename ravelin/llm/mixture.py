"""Mixing sources to target weights: hash-random keys, a range sort within each source, prefix sums, exact cuts.

Every source has a budget of words (its target). Its documents are put in a random order that depends on nothing
but ``doc_id`` and the seed; the running sum of words decides which documents the budget covers. A target above the
source's size takes whole epochs first and the rest from one more. The document at the cut gives the words up to
the budget, so that the words taken are the target, rounded down.

Only (doc_id, source, size) is shuffled. The order within a source is a range partitioning over (source, key), so a
source that holds a third of all rows is spread over a third of the partitions; the running sum is taken in
each partition, and the sums of the partitions before it are added from a table with a row for each partition and
source.

Null and empty texts have size 0 and take 0. Null sources are one source, the last in order. Documents with equal
doc_id share a key and stand in the order of their sizes, then of hashes of their texts; equal rows get equal treatment
but for the cut, where one of them is taken first. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ravelin.llm.shared import drop_table, packed, stored, table

WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    """Runs of characters other than space and the controls 9 to 13."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[ \t-\r]+"), "")).cast("long")


def targets(sizes: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, most_epochs: float = 3.0) -> DataFrame:
    """source, source_size, target: ``sizes`` has a row for each source.

    The words of all sources are shared by weight, no target above ``most_epochs`` times its source's size, the
    excess shared again by weight until none is above. That ends at ``target = min(most_epochs * size, weight *
    level)`` with one level for all; in the order of most_epochs * size / weight, the sources up to some row are at
    their limit, and the level is what they leave, over the weights of the rest.

    The windows below run over one row for each source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (rank % len(weights) + 1).cast("int"))
    w = sizes.withColumn("weight", weight).withColumn("most", most_epochs * F.col("source_size"))
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest, every = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = w.withColumn("all_words", F.sum("source_size").over(every))
    w = w.withColumn("level", (F.col("all_words") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    # the first row, in this order, that is under its limit at its own level fixes the level of all that follow
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct(F.col("most") / F.col("weight"), F.col("level").alias("level")))).over(every)
    w = w.withColumn("level", level["level"])
    under = F.col("level").isNotNull() & (F.col("level") * F.col("weight") <= F.col("most"))
    return w.select("source", "source_size", F.when(under, F.col("level") * F.col("weight")).otherwise(F.col("most")).alias("target"))


def mixed(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, most_epochs: float = 3.0, seed: int = 0) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for each row of ``docs`` (doc_id, text, source)."""
    slim = docs.select("doc_id", "source", F.xxhash64("text").alias("own_key"), word_count(F.col("text")).alias("size"))
    return _cut(slim, weights, most_epochs, seed, "own_key").drop("own_key")


def repeated(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, most_epochs: float = 3.0, seed: int = 0) -> DataFrame:
    """The rows of ``docs``, each as often as its words taken over its words, rounded half up; rows without words never.

    Whole texts stand in the result, so a source's words come as near to its target as its documents at the cut
    allow. Rows are joined back by doc_id, source and a hash of the text; equal rows are counted together and get
    equal shares, the first ones more.
    """
    keyed = docs.select(packed(docs), "doc_id", "source", F.xxhash64("text").alias("own_key"), word_count(F.col("text")).alias("size"))
    cut = _cut(keyed.drop("row"), weights, most_epochs, seed, "own_key").where("taken > 0")
    copies = cut.groupBy("doc_id", "source", "own_key").agg(F.sum(F.floor(F.col("taken") / F.col("size") + 0.5)).cast("long").alias("copies"), F.count("*").alias("equal"))
    c = stored(copies.where("copies > 0"), "copies").alias("c")
    k = keyed.alias("k")
    same = F.col("k.doc_id").eqNullSafe(F.col("c.doc_id")) & F.col("k.source").eqNullSafe(F.col("c.source")) & (F.col("k.own_key") == F.col("c.own_key"))
    # rows that are equal in all three are one row there, standing for all of them
    rows = k.join(c, same).select("row", "k.doc_id", "k.source", "k.own_key", "copies", "equal")
    once = Window.partitionBy("doc_id", "source", "own_key").orderBy(F.lit(0))
    rows = rows.withColumn("place", F.row_number().over(once))
    each = F.floor(F.col("copies") / F.col("equal")) + (F.col("place") <= F.col("copies") % F.col("equal")).cast("long")
    return rows.withColumn("again", F.explode(F.sequence(F.lit(0), each))).where("again > 0").select("row.*")


def _cut(slim: DataFrame, weights: tuple[int, ...], most_epochs: float, seed: int, *more: str) -> DataFrame:
    """``slim``: doc_id, source, size and what else is to be kept, by which rows of equal doc_id and size are in order."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    slim = stored(slim.withColumn("key", key), "sizes")  # written, as the range sort reads it twice
    n = max(int(slim.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ranged = stored(
        slim.repartitionByRange(n, F.col("source").asc_nulls_last(), "key", "size", *more).withColumn("part", F.spark_partition_id()),
        "mixture",
    )
    drop_table(slim)
    parts = ranged.groupBy("part", "source").agg(F.sum("size").alias("part_size"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", "source", F.coalesce(F.sum("part_size").over(earlier), F.lit(0)).alias("skipped"))
    goals = targets(ranged.groupBy("source").agg(F.sum("size").alias("source_size")), weights=weights, most_epochs=most_epochs)
    edges = parts.join(goals, parts.source.eqNullSafe(goals.source)).select(parts.part, parts.source, "skipped", "source_size", "target")

    within = Window.partitionBy("part", "source").orderBy("key", "size", *more).rowsBetween(Window.unboundedPreceding, -1)
    rows = ranged.withColumn("run", F.coalesce(F.sum("size").over(within), F.lit(0)))
    both = rows.join(edges, (rows.part == edges.part) & rows.source.eqNullSafe(edges.source))
    size, budget = rows["size"], F.floor(F.col("target"))
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - epochs * F.col("source_size") - (F.col("skipped") + F.col("run"))
    taken = (epochs * size + F.greatest(F.lit(0), F.least(rest, size))).cast("long")
    return both.select("doc_id", rows["source"], *(rows[c] for c in more), size.alias("size"), "source_size", "target", taken.alias("taken"))


def op10_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that a mix of all sources takes from every document."""
    return mixed(table(spark, sf_dir, "documents")).drop("source")


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+')) AS size,
    md5(concat('0:', coalesce(CAST(doc_id AS VARCHAR), ''))) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, 3.0::DOUBLE * source_size AS most, CAST(list_extract([5.0, 2.0, 1.0],
    CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)) AS DOUBLE) AS weight FROM s),
l AS (
  SELECT *, ((SELECT sum(source_size) FROM s) - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST
    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS own FROM w),
v AS (SELECT arg_min(own, most / weight) AS level FROM l WHERE own * weight <= most),
t AS (
  SELECT source, source_size, CASE WHEN level * weight <= most THEN level * weight ELSE most END AS target
  FROM l LEFT JOIN v ON true),
r AS (
  SELECT d.*, source_size, target, CAST(floor(target) AS BIGINT) AS budget, CASE WHEN source_size > 0 THEN CAST(floor(floor(target) / source_size) AS BIGINT) ELSE 0 END AS epochs,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(epochs * size + greatest(0, least(budget - epochs * source_size - run, size)) AS BIGINT) AS taken FROM r
"""
