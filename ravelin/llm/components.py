"""Connected components of a graph given as edges, by alternating large-star and small-star steps.

Each round is written to the shared folder, so that no round is computed twice and the lineage stays short. The
driver sees one count and one checksum per round. The minimum of a node's neighbours is taken with partial sums
and written; the join back to the neighbours is a plain sort-merge join whose large partitions Spark may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.shared import drop_table, stored


def _round(edges: DataFrame) -> DataFrame:
    """``edges``: a > b, distinct. Joins every larger neighbour to the least one, then every node's smaller neighbours. Written."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    # written, so that the join is of plain tables: Spark splits the many neighbours of one node among tasks then
    first = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    large = both.join(first, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    own = least.select("a", F.col("m").alias("b"))
    others = large.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    out = stored(own.unionByName(others).distinct(), "edges")
    drop_table(first)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, component): every node of an edge (a, b: long) and the least node of its component.

    Loops, repeated edges and edges in either direction are allowed; a null end drops the edge. No edges: no rows.
    """
    e = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    e = stored(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    sign = lambda x: tuple(x.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
    seen = sign(e)
    while seen[0]:
        after = _round(e)
        drop_table(e)
        e, before, seen = after, seen, sign(after)
        if before == seen:
            break
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
