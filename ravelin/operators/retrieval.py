"""Retrieval: exact vector top-k, BM25, rank fusion, neighbourhoods in a graph, and chunks of documents.

Vectors are read once, in groups that all queries pass by, so no join makes a row for each pair. A lexical query meets
the documents that have one of its words. Per query only the best k of each part of the rows move on (two windows, the first salted).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORDS = r"\W+"
#: What a text with a table has.
TABLE = r"(?m)^\s*\|.*\|\s*$|<table|\S \| \S"
#: Queries, and rows of a group, that are compared at a time.
BLOCK, ROWS = 512, 4096


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def best(scored: DataFrame, query: str, item: str, k: int, salts: int = 16) -> DataFrame:
    """The ``k`` rows of each query with the highest score, ties by item, with their rank."""
    order = [F.col("score").desc(), F.col(item).asc()]
    part = Window.partitionBy(query, F.pmod(F.xxhash64(item), F.lit(salts))).orderBy(*order)
    few = scored.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= k)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(*order))).where(F.col("rank") <= k)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; 0 if one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def _matrix(vectors: pa.Array) -> np.ndarray:
    """A row of unit length for each vector, of zeros for one that has no length."""
    flat = np.asarray(vectors.flatten(), np.float64).reshape(len(vectors), -1)
    size = np.sqrt((flat * flat).sum(1, keepdims=True))
    return np.divide(flat, size, out=np.zeros_like(flat), where=size > 0)


def _best_of_group(names: np.ndarray, wanted: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row's id, score) of the ``k`` rows with the highest scores for each query, ties to the lesser id; ``ids`` ascend."""
    found, near = np.zeros((len(names), 0), np.int64), np.zeros((len(names), 0))
    for at in range(0, len(ids), ROWS):
        scores = np.round(wanted @ rows[at : at + ROWS].T, 6)
        scores[names[:, None] == ids[at : at + ROWS]] = -2.0
        # what was found before has lesser ids, so a stable order keeps ties right
        found = np.concatenate([found, np.broadcast_to(ids[at : at + ROWS], scores.shape)], 1)
        near = np.concatenate([near, scores], 1)
        first = np.argsort(-near, axis=1, kind="stable")[:, :k]
        found, near = np.take_along_axis(found, first, 1), np.take_along_axis(near, first, 1)
    some = near > -2
    return np.broadcast_to(names[:, None], near.shape)[some], found[some], near[some] + 0.0


def nearest(vectors: DataFrame, queries: DataFrame, k: int, *, group_rows: int = 1 << 17) -> DataFrame:
    """query_id, vec_id, score (cosine, six places), rank of the ``k`` of ``vectors`` (vec_id, embedding) nearest to each of ``queries``, itself aside.

    All vectors have one width; rows with a null are left out. Rows are dealt into groups of about ``group_rows`` by a hash of their ids and every group
    gets the queries, which come after its rows in a partition and pass by in blocks: the vectors are read and shuffled once, whatever the number of
    queries, and a task holds one group and one block. Tasks send on the best ``k`` of each query.
    """
    spark = vectors.sparkSession
    vectors, queries = (x.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select("vec_id", "embedding") for x in (vectors, queries))
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-vectors.count() // group_rows), 1)
    dealt = vectors.select(F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int").alias("group"), F.lit(False).alias("asks"), "vec_id", "embedding")
    sent = queries.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.lit(True).alias("asks"), "vec_id", "embedding")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            group, asks = b.column("group").to_numpy(), b.column("asks").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((group[1:] != group[:-1]) | (asks[1:] != asks[:-1])) + 1
            for start, end in zip([0, *edges], [*edges, b.num_rows], strict=True):
                if start == end:
                    continue
                if group[start] != now:
                    now, held = group[start], []
                ids, rows = b.column("vec_id")[start:end].to_numpy(), _matrix(b.column("embedding")[start:end])
                if not asks[start]:
                    held.append((ids, rows))
                    continue
                if len(held) > 1 or (held and len(held[0]) == 2):  # the group is whole: its rows in the order of ids
                    every = np.concatenate([x[0] for x in held])
                    order = np.argsort(every, kind="stable")
                    held = [(every[order], np.concatenate([x[1] for x in held])[order], None)]
                for at in range(0, len(ids) if held else 0, BLOCK):
                    out = _best_of_group(ids[at : at + BLOCK], rows[at : at + BLOCK], held[0][0], held[0][1], k)
                    yield pa.record_batch([pa.array(x) for x in out], ["query_id", "vec_id", "score"])

    both = dealt.unionByName(sent).repartitionById(groups, "group").sortWithinPartitions("group", "asks")
    return best(both.mapInArrow(of, "query_id long, vec_id long, score double"), "query_id", "vec_id", k)


def vector_topk(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    """The ``k`` vectors nearest to each query vector (ids divisible by 50), by cosine, itself aside."""
    e = _read(spark, sf_dir, "embeddings")
    return nearest(e, e.where("vec_id % 50 = 0"), k)


VECTOR_TOPK_SQL = """
WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) AS score
  FROM embeddings q JOIN embeddings e ON q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5"""


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), WORDS), "")


def bm25(docs: DataFrame, queries: DataFrame, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """B2: Okapi BM25 of ``docs`` (doc_id, text) for ``queries`` (query_id, text); every different word of a query counts once.

    Only words of queries are counted in documents: the words of the bounded set of queries are joined to the words
    of documents before these are grouped.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("word"))
    sized = docs.select("doc_id", tokens(F.col("text")).alias("words")).withColumn("size", F.size("words"))
    whole = sized.agg(F.count("*").alias("n"), F.avg("size").alias("mean"))
    words = sized.select("doc_id", "size", F.explode("words").alias("word")).join(asked.select("word").distinct(), "word", "left_semi")
    tf = words.groupBy("word", "doc_id", "size").agg(F.count("*").alias("tf"))
    df = tf.groupBy("word").agg(F.count("*").alias("df"))
    one = whole.select(F.struct("n", "mean").alias("s")).scalar()
    idf = df.withColumn("all", one).select("word", F.log(1 + (F.col("all")["n"] - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), F.col("all")["mean"].alias("mean"))
    weight = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("size") / F.col("mean")))
    scored = tf.join(idf, "word").join(asked, "word").groupBy("query_id", "doc_id").agg(F.round(F.sum(weight), 6).alias("score"))
    return best(scored, "query_id", "doc_id", k)


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2, O8 for the benchmark's items whose id is divisible by 10, against all documents."""
    return bm25(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "benchmark").where("item_id % 10 = 0").select(F.col("item_id").alias("query_id"), "text"), 8)


_BM25_SQL = r"""
w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-zA-Z0-9_]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT count(*) AS n, avg(len(words)) AS mean FROM w),
a AS (SELECT DISTINCT item_id AS query_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-zA-Z0-9_]+'), lambda x: x <> '')) AS word FROM benchmark WHERE item_id % 10 = 0),
u AS (SELECT doc_id, len(words) AS size, unnest(words) AS word FROM w),
tf AS (SELECT word, doc_id, size, count(*) AS tf FROM u WHERE word IN (SELECT word FROM a) GROUP BY ALL),
idf AS (SELECT word, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf, mean FROM tf, s GROUP BY word, n, mean),
sc AS (SELECT query_id, doc_id, round(sum(idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * size / mean))), 6) AS score FROM tf JOIN idf USING (word) JOIN a USING (word) GROUP BY 1, 2),
lexical AS (SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM sc)"""

BM25_TOPK_SQL = f"WITH {_BM25_SQL} SELECT * FROM lexical WHERE rank <= 8"


def fused(lists: list[DataFrame], k: int, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (query_id, doc_id, rank)."""
    one = reduce(DataFrame.unionByName, [x.select("query_id", "doc_id", "rank") for x in lists])
    return best(one.groupBy("query_id", "doc_id").agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 9).alias("score")), "query_id", "doc_id", k)


def overlap(lists: DataFrame, docs: DataFrame, queries: DataFrame) -> DataFrame:
    """The share of a query's different words that a document has, a tenth more for documents with a table; a lexical stand-in for a reranker."""
    words = lambda c: F.array_distinct(tokens(F.col(c)))
    j = lists.join(docs.select("doc_id", F.col("text").alias("body")), "doc_id").join(queries.select("query_id", F.col("text").alias("asked")), "query_id")
    share = F.coalesce(F.try_divide(F.size(F.array_intersect(words("asked"), words("body"))), F.size(words("asked"))), F.lit(0.0))
    table = F.col("body").rlike(TABLE)
    return j.withColumn("score", F.round(share * F.when(table, 1.1).otherwise(1.0), 6)).drop("body", "asked")


def reranked(lists: DataFrame, scores: DataFrame, docs: DataFrame, table_boost: float = 1.1) -> DataFrame:
    """``lists`` (query_id, doc_id) with the score that a model gave each pair (``scores``: query_id, doc_id, score), more by ``table_boost`` for documents with a table.

    Pairs without a score have 0. Of several scores of a pair the highest counts.
    """
    given = scores.groupBy("query_id", "doc_id").agg(F.max("score").alias("given"))
    tables = docs.select("doc_id", F.col("text").rlike(TABLE).alias("table"))
    j = lists.select("query_id", "doc_id").join(given, ["query_id", "doc_id"], "left").join(tables, "doc_id", "left")
    boost = F.when(F.coalesce("table", F.lit(False)), table_boost).otherwise(1.0)
    return j.select("query_id", "doc_id", F.round(F.coalesce("given", F.lit(0.0)) * boost, 6).alias("score"))


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B3 of BM25 and of the reranked order of the same candidates."""
    docs, queries = _read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "benchmark").where("item_id % 10 = 0").select(F.col("item_id").alias("query_id"), "text")
    lexical = bm25(docs, queries, 20)
    again = best(overlap(lexical.drop("score", "rank"), docs, queries), "query_id", "doc_id", 20)
    return fused([lexical, again], 4)


RRF_FUSION_SQL = rf"""
WITH {_BM25_SQL}, top AS (SELECT * FROM lexical WHERE rank <= 20),
q AS (SELECT item_id AS query_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-zA-Z0-9_]+'), lambda x: x <> '')) AS asked FROM benchmark WHERE item_id % 10 = 0),
o AS (SELECT query_id, doc_id, round(len(list_intersect(asked, words)) / len(asked)::DOUBLE * CASE WHEN regexp_matches(text, '(?m)^\s*\|.*\|\s*$|<table|\S \| \S') THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END, 6) AS score
  FROM top JOIN q USING (query_id) JOIN w USING (doc_id) JOIN documents USING (doc_id)),
g AS (SELECT query_id, doc_id, rank FROM top UNION ALL SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) FROM o),
f AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM g GROUP BY 1, 2),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM f)
SELECT * FROM r WHERE rank <= 4"""


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """Node, hop: the nodes within ``hops`` (1 to 3) of a seed with the least number of hops.

    The nodes of a hop are the different neighbours of those of the hop before; a node's hop is the least of those it
    is in. The edges are dealt out once and that exchange is used for every hop.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    reached = [seeds.select("node").distinct()]
    for _ in range(hops):
        reached.append(both.join(reached[-1], both.a == F.col("node"), "left_semi").select(F.col("b").alias("node")).distinct())
    every = reduce(DataFrame.unionByName, [r.withColumn("hop", F.lit(i)) for i, r in enumerate(reached)])
    return every.groupBy("node").agg(F.min("hop").alias("hop"))


def _khop(spark: SparkSession, sf_dir: str, hops: int) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem")
    edges = li.select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("a"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("b"))
    seeds = _read(spark, sf_dir, "part").where("p_partkey in (1, 2, 3)").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("node"))
    return neighbourhood(edges, seeds, hops)


def khop_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _khop(spark, sf_dir, 1)


def khop_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _khop(spark, sf_dir, 2)


def khop_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B6, B7."""
    return _khop(spark, sf_dir, 3)


_KHOP_SQL = """
WITH RECURSIVE e AS (SELECT DISTINCT 'p' || l_partkey AS a, 's' || l_suppkey AS b FROM lineitem), g AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
k AS (SELECT 'p' || p_partkey AS node, 0 AS hop FROM part WHERE p_partkey IN (1, 2, 3) UNION SELECT g.b, k.hop + 1 FROM k JOIN g ON g.a = k.node WHERE k.hop < {hops})
SELECT node, min(hop) AS hop FROM k GROUP BY node"""
KHOP_1_SQL, KHOP_2_SQL, KHOP_3_SQL = (_KHOP_SQL.format(hops=h) for h in (1, 2, 3))


def chunked(docs: DataFrame, size: int = 120, overlap: int = 20) -> DataFrame:
    """doc_id, chunk, n_words, text: windows of ``size`` words that share ``overlap`` words with the one before."""
    words = F.array_remove(F.split("text", r"\s+"), "")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - 1 - overlap), F.lit(size - overlap))
    rows = docs.select("doc_id", words.alias("words")).where(F.size("words") > 0).select("doc_id", "words", F.posexplode(starts).alias("chunk", "start"))
    part = F.slice("words", F.col("start") + 1, F.lit(size))
    return rows.select("doc_id", "chunk", F.size(part).alias("n_words"), F.array_join(part, " ").alias("text"))


def chunk_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunked(_read(spark, sf_dir, "documents")).select("doc_id", "chunk", "n_words", F.md5(F.col("text").cast("binary")).alias("text_md5"))


CHUNK_DOCS_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS words FROM documents),
c AS (SELECT doc_id, words, unnest(range(0, greatest(0, len(words) - 21) + 1, 100)) AS start FROM w WHERE len(words) > 0)
SELECT doc_id, CAST(start / 100 AS INT) AS chunk, CAST(len(words[start + 1:start + 120]) AS INT) AS n_words, md5(array_to_string(words[start + 1:start + 120], ' ')) AS text_md5 FROM c"""
