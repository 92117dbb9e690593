"""Streams as they arrive, in chunks cut anywhere, as tables of lines; and small list, lookup and suggestion operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ravelin.functions.text import let
from ravelin.operators import streams
from ravelin.sources.tables import written


def lines_of(chunks: DataFrame, *, block: int = 1024) -> DataFrame:
    """Chunks (request_id, seq, chunk) as request_id, line_no (from 0), line.

    A line may lie in many chunks, a chunk may hold many lines. What follows the last line feed is a line if it is not
    blank. A chunk delivered twice counts once; null chunks are empty. Plain text without a line feed waits for one,
    or for the end.

    Line numbers are sums of line feeds: over blocks of ``block`` seqs, then within a block, so that one long stream
    is many small groups. Only the chunks of one line come together.
    """
    pieces = F.split(F.coalesce("chunk", F.lit("")), "\n", -1)
    rows = chunks.dropDuplicates(["request_id", "seq"]).select("request_id", "seq", (F.col("seq") - F.pmod("seq", F.lit(block))).alias("block"), pieces.alias("pieces"))
    rows = rows.withColumn("feeds", F.size("pieces") - 1)
    stream = Window.partitionBy("request_id")
    earlier = stream.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("request_id", "block").agg(F.sum("feeds").alias("feeds"))
    totals = totals.select(F.col("request_id").alias("r"), F.col("block").alias("b"), F.coalesce(F.sum("feeds").over(earlier), F.lit(0)).alias("before"), F.sum("feeds").over(stream).alias("last"))
    within = Window.partitionBy("request_id", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(totals, F.col("request_id").eqNullSafe(F.col("r")) & F.col("block").eqNullSafe(F.col("b")))
    placed = placed.withColumn("first", F.col("before") + F.coalesce(F.sum("feeds").over(within), F.lit(0)))
    parts = placed.select("request_id", "seq", "first", "last", F.posexplode("pieces").alias("place", "piece"))
    of = F.array_sort(F.collect_list(F.struct("seq", "piece")))
    whole = parts.groupBy("request_id", (F.col("first") + F.col("place")).alias("line_no"), "last").agg(F.array_join(F.transform(of, lambda p: p["piece"]), "").alias("line"))
    return whole.where((F.col("line_no") < F.col("last")) | F.rlike("line", F.lit(r"\S"))).select("request_id", "line_no", "line")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as the chunks of one stream for each user, cut within lines and within JSON."""
    k = F.col("event_id")
    s = k.cast("string")
    shapes = F.array(F.concat(F.lit("data: a"), s), F.concat(F.lit(" b"), s, F.lit("\n")), F.concat(F.lit('\n\nevent: e\ndata: {"token": "'), s), F.lit('"}\n'), F.lit(""), F.concat(F.lit("tail"), s))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("request_id"), k.alias("seq"), F.element_at(shapes, (k % 6 + 1).cast("int")).alias("chunk"))


_CHUNK_LINES = r"""
WITH h AS (SELECT user_id AS request_id, event_id, (['data: a' || event_id, ' b' || event_id || chr(10), chr(10) || chr(10) || 'event: e' || chr(10) || 'data: {"token": "' || event_id, '"}' || chr(10), '', 'tail' || event_id])[event_id % 6 + 1] AS chunk FROM events),
w AS (SELECT request_id, string_split(string_agg(chunk, '' ORDER BY event_id), chr(10)) AS pieces FROM h GROUP BY 1),
u AS (SELECT request_id, len(pieces) - 1 AS last, unnest(pieces) AS line, generate_subscripts(pieces, 1) - 1 AS seq FROM w),
l AS (SELECT request_id, CAST(seq AS BIGINT) AS seq, line FROM u WHERE seq < last OR trim(line) <> '')"""


def stream_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of streams that arrive in chunks."""
    return lines_of(_chunks(spark, sf_dir))


STREAM_LINES_SQL = _CHUNK_LINES + "\nSELECT request_id, seq AS line_no, line FROM l"


def chunk_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams in chunks, put together to lines and folded to texts."""
    lines = lines_of(_chunks(spark, sf_dir)).withColumnRenamed("line_no", "seq")
    return streams.folded(lines).select("request_id", "text", "n_tokens")


CHUNK_FOLD_SQL = f"SELECT request_id, text, n_tokens FROM ({_CHUNK_LINES},\np AS" + streams.STREAM_FOLD_SQL.split("\np AS", 1)[1] + ")"


def ingestion_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: each document's stream of ingestion events, every event in two chunks, as progress; ``seq`` is the number of the line."""
    e = streams._events(spark, sf_dir)
    half = F.floor(F.length("payload") / 2).cast("int")
    both = F.array(F.concat(F.lit("data: "), F.substring("payload", F.lit(1), half)), F.concat(F.substr("payload", half + 1), F.lit("\n\n")))
    chunks = e.select(F.col("doc_id").alias("request_id"), "seq", F.posexplode(both).alias("place", "chunk"))
    lines = lines_of(chunks.select("request_id", (F.col("seq") * 2 + F.col("place")).alias("seq"), "chunk"))
    events = lines.where(F.startswith("line", F.lit("data:"))).select(F.col("request_id").alias("doc_id"), F.col("line_no").alias("seq"), F.trim(F.substr("line", F.lit(6))).alias("payload"))
    return streams.progressed(events)


INGESTION_STREAM_SQL = streams.INGESTION_PROGRESS_SQL.replace("event_id AS seq", "2 * (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) AS seq", 1)


def selected(choices: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """``choices`` (with ``key``) and what ``nodes`` (``key``, a row for each) say of the node; nulls where there is none."""
    return choices.join(nodes, key, "left")


def selected_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J9 on orders that choose a customer, one in seven one that is not there."""
    node = F.when(F.col("o_orderkey") % 7 == 0, -F.col("o_custkey")).otherwise(F.col("o_custkey"))
    choices = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", node.alias("node_id"))
    nodes = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("node_id"), F.col("c_name").alias("label"), F.col("c_mktsegment").alias("kind"))
    return selected(choices, nodes, "node_id").select("o_orderkey", "node_id", "label", "kind")


SELECTED_NODE_SQL = """
WITH c AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN -o_custkey ELSE o_custkey END AS node_id FROM orders)
SELECT o_orderkey, node_id, c_name AS label, c_mktsegment AS kind FROM c LEFT JOIN customer ON node_id = c_custkey"""


def last_where(items: Column, test: Callable[[Column], Column]) -> Column:
    """The last item that passes, null if none does."""
    return F.try_element_at(F.filter(items, test), F.lit(-1))


def list_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter, map and slice, last match, and membership on the words of every text."""
    words = F.split("text", " ", -1)
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", F.size(F.filter(words, lambda w: F.length(w) > 6)).alias("n_long"),
        F.array_join(F.transform(F.slice(words, 1, 3), lambda w: F.concat(F.lit("<"), w, F.lit(">"))), "").alias("first_three"),
        last_where(words, lambda w: F.length(w).between(1, 3)).alias("last_short"), F.array_contains(words, "die").alias("has_word"),
    )


LIST_STEPS_SQL = """
WITH w AS (SELECT doc_id, string_split(text, ' ') AS words FROM documents)
SELECT doc_id, CAST(len(list_filter(words, lambda w: length(w) > 6)) AS INT) AS n_long, array_to_string(list_transform(words[1:3], lambda w: '<' || w || '>'), '') AS first_three,
  list_filter(words, lambda w: length(w) BETWEEN 1 AND 3)[-1] AS last_short, list_contains(words, 'die') AS has_word FROM w"""


def _runs(terms: Column) -> Column:
    """Array of (term, n) of an array of terms: sorted, each where its run begins and as often as it is long."""

    def of(s: Column) -> Column:
        starts = F.filter(F.when(F.size(s) > 0, F.sequence(F.lit(0), F.size(s) - 1)).otherwise(F.array().cast("array<int>")), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return let(starts, lambda at: F.transform(at, lambda x, k: F.struct(F.get(s, x).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(s)) - x).cast("long").alias("n"))))

    return let(F.array_sort(terms), of)


def suggested(docs: DataFrame, limit: int = 4, most: int = 50_000) -> DataFrame:
    """doc_id, place (from 1), term, question: the terms that mark each document of ``docs`` (doc_id, lang, text) most, as questions.

    Terms are runs of four letters or more of any script, in small letters. A term's weight is how often the document has it times the logarithm of the
    documents of the language over those that have it, so that words that all have say nothing (weight 0) and stand last. By weight (nine places), then by
    the term. No documents, or none with terms: no rows; a null language is one language; rows of equal doc_id are one document.

    Terms are counted in the row; only rows that share a doc_id are brought together. How many documents have a term goes to all tasks for the ``most``
    terms that most documents have, or fewer, so that of these a document's best alone are moved; all other terms meet their numbers by a join.
    """
    lang = F.coalesce("lang", F.lit("")).alias("lang")
    several = written(docs.groupBy(F.col("doc_id").alias("_id")).agg(F.count("*").alias("_n")).where("_n > 1").select("_id"), "several-rows")
    same = F.col("doc_id").eqNullSafe(F.col("_id"))
    terms = F.transform(F.regexp_extract_all("text", F.lit(r"\p{L}{4,}"), F.lit(0)), lambda w: F.lower(w))
    alone = docs.join(several, same, "left_anti").select("doc_id", lang, F.inline(_runs(terms)))
    shared = docs.join(several, same, "left_semi").select("doc_id", lang, F.explode(terms).alias("term"))
    counts = alone.unionByName(shared.groupBy("doc_id", "lang", "term").agg(F.count("*").alias("n")))
    having = written(counts.groupBy("lang", "term").agg(F.count("*").alias("having")), "having")
    level, n_terms = 64, 0
    for r in having.groupBy(F.floor(F.log2("having")).alias("level")).agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect():  # at most 64
        if n_terms + r["n"] > most:
            break
        level, n_terms = r["level"], n_terms + r["n"]
    common = F.floor(F.log2("having")) >= level
    met = counts.join(F.broadcast(having.where(common)), ["lang", "term"], "left")
    found = met.where("having IS NOT NULL").unionByName(met.where("having IS NULL").drop("having").join(having.where(~common), ["lang", "term"]))
    whole = docs.select("doc_id", lang).distinct().groupBy("lang").agg(F.count("*").alias("docs"))
    weight = F.round(F.col("n") * F.log(F.col("docs") / F.col("having")), 9)
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(weight.desc(), "term"))
    best = found.join(F.broadcast(whole), "lang").withColumn("place", place).where(F.col("place") <= limit)  # a row for each language
    return best.select("doc_id", "place", "term", F.concat(F.lit("What is said about "), "term", F.lit("?")).alias("question"))


def term_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B12 on all documents."""
    return suggested(spark.read.parquet(f"{sf_dir}/documents.parquet"))


TERM_SUGGESTIONS_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS lang, lower(unnest(regexp_extract_all(text, '\p{L}{4,}'))) AS term FROM documents),
n AS (SELECT doc_id, lang, term, count(*) AS n FROM t GROUP BY ALL),
w AS (SELECT *, count(*) OVER (PARTITION BY lang, term) AS having_it FROM n),
l AS (SELECT coalesce(lang, '') AS lang, count(DISTINCT doc_id) AS docs FROM documents GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(n * ln(docs / having_it), 9) DESC, term) AS place FROM w JOIN l USING (lang))
SELECT doc_id, CAST(place AS INT) AS place, term, 'What is said about ' || term || '?' AS question FROM r WHERE place <= 4"""
