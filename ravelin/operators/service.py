"""Replies, requests, settings, drawers, downloads and labels as a client of the service meets them: queries over the
helpers of the other modules, and those that are needed here only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.functions import labels, text
from ravelin.operators import citations, library, sessions, workspace
from ravelin.sources import readers


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(key: Column, *choices) -> Column:
    """One of the choices by key; None stands for null."""
    return F.element_at(F.array(*map(F.lit, choices)), (key % len(choices) + 1).cast("int"))


def _flag(key: Column, n: int) -> Column:
    return F.when(key % n == 0, True).when(key % n == 1, False)


def _flag_sql(key: str, n: int) -> str:
    return f"CASE WHEN {key} % {n} = 0 THEN true WHEN {key} % {n} = 1 THEN false END"


# The keys that may hold the answer, the first that has one counts; and what a reply without times counts as.
ANSWER_KEYS = ("reply", "response", "answer", "message", "output", "grounded_answer")
LATENCY, SCORE = 1.8, 0.95


def synthesised(replies: DataFrame) -> DataFrame:
    """``body`` (JSON, or a plain text) as answer, latency_sec, traceability_score, follow_ups and suggestions.

    Without an answer key the text itself is the answer, or the JSON as it came. A time that is no number is the
    default; of the two lists each stands in for the other where that is no list. A null body gives a null answer.
    """
    v = F.try_parse_json("body")
    # a plain text is not JSON, a JSON text is its own answer
    own = F.when(F.startswith(F.ltrim("body"), F.lit('"')), F.try_variant_get(v, "$", "string"))
    keys = [F.nullif(F.try_variant_get(v, f"$.{k}", "string"), F.lit("")) for k in ANSWER_KEYS]

    def number(key: str, default: float) -> Column:
        kind = F.schema_of_variant(F.try_variant_get(v, f"$.{key}", "variant"))
        return F.when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(v, f"$.{key}", "double")).otherwise(default)

    lists = [F.try_variant_get(v, f"$.{k}", "array<string>") for k in ("follow_up_inquiries", "suggestions")]
    none = F.array().cast("array<string>")
    return replies.withColumns({
        "answer": F.coalesce(*keys, own, "body"),
        "latency_sec": number("latency_sec", LATENCY),
        "traceability_score": number("traceability_score", SCORE),
        "follow_ups": F.coalesce(*lists, none),
        "suggestions": F.coalesce(*reversed(lists), none),
    })


def reply_synthesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P4, P5, X1, X3 on bodies of all shapes, one in eleven a plain text."""
    k = F.col("doc_id")
    body = F.concat(
        F.lit('{"'), _pick(k, *ANSWER_KEYS, "other"), F.lit('": "'), F.when(k % 5 == 0, "").otherwise(F.concat("lang", F.lit(" "), k.cast("string"))), F.lit('", "latency_sec": '), _pick(k, "2.5", '"3"', "null", "4"),
        F.lit(', "follow_up_inquiries": '), _pick(k, '["f"]', "null", '"f"'), F.lit(', "suggestions": '), _pick(k, '["s", "t"]', "[]", "7", "null", '["s"]'), F.lit("}"),
    )
    rows = synthesised(_read(spark, sf_dir, "documents").select("doc_id", F.when(k % 11 == 0, F.col("text")).otherwise(body).alias("body")))
    return rows.select("doc_id", "answer", "latency_sec", "traceability_score", F.array_join("follow_ups", "|").alias("follow_ups"), F.array_join("suggestions", "|").alias("suggestions"))


REPLY_SYNTHESIS_SQL = f"""
WITH b AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN text ELSE '{{"' || ({[*ANSWER_KEYS, "other"]})[doc_id % 7 + 1] || '": "' || CASE WHEN doc_id % 5 = 0 THEN '' ELSE lang || ' ' || doc_id END || '", "latency_sec": ' ||
    (['2.5', '"3"', 'null', '4'])[doc_id % 4 + 1] || ', "follow_up_inquiries": ' || (['["f"]', 'null', '"f"'])[doc_id % 3 + 1] || ', "suggestions": ' || (['["s", "t"]', '[]', '7', 'null', '["s"]'])[doc_id % 5 + 1] || '}}' END AS body FROM documents),
j AS (SELECT doc_id, body, CASE WHEN json_valid(body) THEN body ELSE '{{}}' END AS v FROM b),
l AS (SELECT *, CASE WHEN json_type(v, '$.follow_up_inquiries') = 'ARRAY' THEN json_extract_string(v, '$.follow_up_inquiries[*]') END AS f, CASE WHEN json_type(v, '$.suggestions') = 'ARRAY' THEN json_extract_string(v, '$.suggestions[*]') END AS s FROM j)
SELECT doc_id, coalesce({", ".join(f"nullif(json_extract_string(v, '$.{k}'), '')" for k in ANSWER_KEYS)}, body) AS answer,
  CASE WHEN json_type(v, '$.latency_sec') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CAST(json_extract_string(v, '$.latency_sec') AS DOUBLE) ELSE {LATENCY}::DOUBLE END AS latency_sec, {SCORE}::DOUBLE AS traceability_score,
  coalesce(array_to_string(coalesce(f, s, []), '|'), '') AS follow_ups, coalesce(array_to_string(coalesce(s, f, []), '|'), '') AS suggestions FROM l"""


def citation_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as answers, half of them without citations; their chunks are found twice, with and without a similarity."""
    k = F.col("doc_id")
    cite = F.struct(F.lit(1).alias("citation_index"), F.lit("own").alias("chunk_id"), F.col("source").alias("plain_text"), F.lit(0.75).alias("similarity"))
    chunk = lambda n, s: F.struct(F.concat(F.lit(f"c{n}-"), k.cast("string")).alias("chunk_id"), F.col("text").alias("text"), s.cast("double").alias("similarity"))
    one = F.array(cite)
    d = _read(spark, sf_dir, "documents").select("doc_id", F.when(k % 2 == 0, one).otherwise(F.slice(one, 1, 0)).alias("citations"), F.array(chunk(1, F.lit(0.5)), chunk(2, F.lit(None))).alias("top_chunks"))
    return citations.chunk_fallback(d).select("doc_id", F.explode("citations").alias("c")).select("doc_id", "c.*")


CITATION_FALLBACK_SQL = """
SELECT doc_id, 1 AS citation_index, 'own' AS chunk_id, source AS plain_text, 0.75::DOUBLE AS similarity FROM documents WHERE doc_id % 2 = 0
UNION ALL SELECT doc_id, CAST(n AS INT), 'c' || n || '-' || doc_id, text, CASE WHEN n = 1 THEN 0.5 ELSE 0.9 END::DOUBLE FROM documents, range(1, 3) AS t(n) WHERE doc_id % 2 <> 0"""


def tokens(answers: DataFrame) -> DataFrame:
    """V1: answer_id, place, kind (text or citation), value: the pieces of ``text`` in order; empty pieces are left out, their places too."""
    bracket = r"\[\d+(?:\s*,\s*\d+)*\]"
    marks = F.regexp_extract_all("text", F.lit(bracket), F.lit(0))
    pairs = F.transform(F.split("text", bracket), lambda piece, i: F.array(F.struct(F.lit("text").alias("kind"), piece.alias("value")), F.struct(F.lit("citation").alias("kind"), F.get(marks, i).alias("value"))))
    return answers.select("answer_id", F.posexplode(F.flatten(pairs)).alias("place", "token")).select("answer_id", "place", "token.*").where("value <> ''")


def citation_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1 on whole texts between markers."""
    k = F.col("doc_id").cast("string")
    marked = F.concat(F.lit("["), k, F.lit("]"), "text", F.lit(" [1, 2][3] ["), "source", F.lit("] "), "text", F.lit("[4 ,5]"))
    return tokens(_read(spark, sf_dir, "documents").select(F.col("doc_id").alias("answer_id"), marked.alias("text")))


CITATION_TOKENS_SQL = r"""
WITH m AS (SELECT doc_id, '[' || doc_id || ']' || text || ' [1, 2][3] [' || source || '] ' || text || '[4 ,5]' AS t FROM documents),
p AS (SELECT doc_id, string_split_regex(t, '\[\d+(?:\s*,\s*\d+)*\]') AS s, regexp_extract_all(t, '\[\d+(?:\s*,\s*\d+)*\]') AS c FROM m),
x AS (SELECT doc_id, s, c, unnest(range(len(s))) AS i FROM p)
SELECT doc_id AS answer_id, CAST(2 * i AS INT) AS place, 'text' AS kind, s[i + 1] AS value FROM x WHERE s[i + 1] <> ''
UNION ALL SELECT doc_id, CAST(2 * i + 1 AS INT), 'citation', c[i + 1] FROM x WHERE i < len(c)"""


def query_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P20: orders as requests that leave out what they may."""
    k = F.col("o_orderkey")
    docs = F.slice(F.array(F.lit("a.pdf"), F.lit("b.pdf")), F.lit(1), (k % 3).cast("int"))
    r = _read(spark, sf_dir, "orders").select("o_orderkey", _pick(k, None, 1, 2, 3).cast("int").alias("hops"), _pick(k, "fast", "expert", None, None, None).alias("mode"), _pick(k, None, 5, 9).cast("int").alias("top_k"), docs.alias("active_docs"), F.when(k % 11 == 0, "own.pdf").alias("document_filter"))
    return readers.requested(r).select("o_orderkey", "mode", "hops", "top_k", "document_filter")


QUERY_REQUESTS_SQL = """
WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 4 END AS hops, CASE o_orderkey % 5 WHEN 0 THEN 'fast' WHEN 1 THEN 'expert' END AS mode, CASE o_orderkey % 3 WHEN 1 THEN 5 WHEN 2 THEN 9 END AS top_k,
  (['a.pdf', 'b.pdf'])[1:o_orderkey % 3] AS docs, CASE WHEN o_orderkey % 11 = 0 THEN 'own.pdf' END AS f FROM orders),
m AS (SELECT *, coalesce(mode, CASE WHEN hops > 1 THEN 'expert' ELSE 'fast' END) AS sent FROM r)
SELECT o_orderkey, sent AS mode, CAST(coalesce(hops, CASE WHEN sent = 'expert' THEN 3 ELSE 1 END) AS INT) AS hops, CAST(coalesce(top_k, CASE WHEN sent = 'expert' THEN 8 ELSE 4 END) AS INT) AS top_k,
  coalesce(f, CASE WHEN len(docs) = 1 THEN docs[1] END) AS document_filter FROM m"""


def query_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """parts as requests, many of them wrong."""
    k = F.col("p_partkey")
    r = _read(spark, sf_dir, "part").select("p_partkey", F.when(k % 6 > 1, F.col("p_name")).when(k % 6 == 0, "").alias("query"), (k % 5).cast("int").alias("hops"), (k % 13).cast("int").alias("top_k"), _pick(k, "fast", "expert", "slow", None).alias("mode"))
    return readers.problems(r).select("p_partkey", F.array_join("problems", ",").alias("problems"))


QUERY_PROBLEMS_SQL = """
WITH r AS (SELECT p_partkey, CASE WHEN p_partkey % 6 > 1 THEN p_name WHEN p_partkey % 6 = 0 THEN '' END AS query, p_partkey % 5 AS hops, p_partkey % 13 AS top_k, (['fast', 'expert', 'slow', NULL])[p_partkey % 4 + 1] AS mode FROM part)
SELECT p_partkey, concat_ws(',', CASE WHEN coalesce(length(query), 0) = 0 THEN 'query' END, CASE WHEN hops NOT BETWEEN 1 AND 3 THEN 'hops' END, CASE WHEN top_k NOT BETWEEN 1 AND 10 THEN 'top_k' END,
  CASE WHEN mode NOT IN ('fast', 'expert') THEN 'mode' END) AS problems FROM r"""


def error_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as failed calls."""
    k = F.col("event_id")
    e = _read(spark, sf_dir, "events").select("event_id", _pick(k, None, 0, 200, 401, 403, 404, 429, 500, 502, 503, 418).cast("int").alias("status"), _pick(k, None, "AbortError", "TimeoutError", "TypeError", "SchemaError", "Error").alias("error"))
    return e.select("event_id", "status", "error", readers.error_kind(F.col("status"), F.col("error")).alias("kind"))


ERROR_KINDS_SQL = """
WITH e AS (SELECT event_id, CAST(([NULL, 0, 200, 401, 403, 404, 429, 500, 502, 503, 418])[event_id % 11 + 1] AS INT) AS status, ([NULL, 'AbortError', 'TimeoutError', 'TypeError', 'SchemaError', 'Error'])[event_id % 6 + 1] AS error FROM events)
SELECT event_id, status, error, CASE WHEN error = 'AbortError' THEN 'aborted' WHEN error = 'TimeoutError' THEN 'timeout' WHEN error = 'TypeError' OR status = 0 THEN 'offline' WHEN error = 'SchemaError' THEN 'schema'
  WHEN status IN (401, 403) THEN 'forbidden' WHEN status = 404 THEN 'missing' WHEN status = 429 THEN 'busy' WHEN status IN (502, 503, 504) THEN 'unavailable' WHEN status >= 500 THEN 'server' ELSE 'unknown' END AS kind FROM e"""


def upload_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as replies to an upload that lack some counts."""
    k = F.col("p_partkey")
    count = lambda n: F.when(k % n > 0, k % 50).alias
    r = _read(spark, sf_dir, "part").select("p_partkey", count(3)("pages"), count(4)("chunks"), count(5)("facts"), count(6)("triples"), _pick(k, "", None, "processing").alias("status"), F.when(k % 2 == 0, "").otherwise(F.col("p_brand")).alias("filename"), F.col("p_name").alias("sent_name"))
    return workspace.upload_report(r).drop("sent_name")


UPLOAD_REPORTS_SQL = f"""
SELECT p_partkey, {", ".join(f"coalesce(CASE WHEN p_partkey % {n} > 0 THEN p_partkey % 50 END, 0) AS {c}" for n, c in ((3, "pages"), (4, "chunks"), (5, "facts"), (6, "triples")))},
  coalesce(nullif((['', NULL, 'processing'])[p_partkey % 3 + 1], ''), 'ready') AS status, coalesce(nullif(CASE WHEN p_partkey % 2 = 0 THEN '' ELSE p_brand END, ''), p_name) AS filename FROM part"""


def session_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a session list whose ids, titles and sources come in all forms."""
    k = F.col("o_orderkey")
    source = lambda n, on: F.struct(F.lit(n).alias("name"), F.lit(on).alias("selected"))
    both = F.array(source("a", False), source("c", True))
    o = _read(spark, sf_dir, "orders").select(
        F.when(k % 3 == 0, F.concat(F.lit("t"), k.cast("string"))).when(k % 3 == 1, "").alias("thread_id"), F.when(k % 2 == 0, F.concat(F.lit("s"), k.cast("string"))).alias("session_id"), k.cast("string").alias("id"),
        F.when(k % 5 > 1, F.col("o_orderpriority")).when(k % 5 == 0, "").alias("title"), F.when(k % 7 > 0, F.array(F.lit("a"), F.lit("b"))).alias("attached_docs"),
        F.when(k % 4 > 1, both).when(k % 4 == 1, F.slice(both, 1, 0)).alias("sources"),
    )
    return workspace.session_rows(o).select("id", "title", F.size("sources").alias("n_sources"), F.array_join(F.transform(F.filter("sources", lambda s: s["selected"]), lambda s: s["name"]), ",").alias("selected"))


SESSION_LIST_SQL = """
WITH o AS (SELECT CASE o_orderkey % 3 WHEN 0 THEN 't' || o_orderkey WHEN 1 THEN '' END AS thread_id, CASE WHEN o_orderkey % 2 = 0 THEN 's' || o_orderkey END AS session_id, CAST(o_orderkey AS VARCHAR) AS id,
    CASE WHEN o_orderkey % 5 > 1 THEN o_orderpriority WHEN o_orderkey % 5 = 0 THEN '' END AS title, coalesce(CASE WHEN o_orderkey % 7 > 0 THEN ['a', 'b'] END, []) AS names,
    coalesce(CASE WHEN o_orderkey % 4 > 1 THEN [{'name': 'a', 'selected': false}, {'name': 'c', 'selected': true}] END, []) AS sources FROM orders),
r AS (SELECT coalesce(nullif(thread_id, ''), nullif(session_id, ''), nullif(id, '')) AS id, coalesce(nullif(title, ''), 'New Chat') AS title, len(sources) > 0 AS own, names, sources FROM o)
SELECT id, title, CAST(CASE WHEN own THEN len(sources) ELSE len(names) END AS INT) AS n_sources,
  coalesce(array_to_string(CASE WHEN own THEN list_transform(list_filter(sources, lambda s: list_contains(names, s.name)), lambda s: s.name) ELSE names END, ','), '') AS selected FROM r"""


def stored_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as keys of a store, a third of whose values is malformed."""
    k = F.col("c_custkey")
    item = lambda name: F.concat(F.lit('{"name": "'), name, F.lit('", "n": '), k.cast("string"), F.lit("}"))
    value = F.when(k % 3 == 0, F.concat(F.lit("["), item(F.col("c_name")), F.lit(", "), item(F.col("c_mktsegment")), F.lit("]"))).when(k % 3 == 1, F.concat(F.lit("["), "c_name")).otherwise(item(F.col("c_name")))
    rows = readers.stored_values(_read(spark, sf_dir, "customer").select(k.alias("key"), value.alias("value")), "struct<name:string,n:bigint>")
    return rows.select("key", F.size("items").alias("n_items"), F.array_join("items.name", "|").alias("names"))


STORED_ITEMS_SQL = """
WITH c AS (SELECT c_custkey AS key, CASE c_custkey % 3 WHEN 0 THEN '[{"name": "' || c_name || '", "n": ' || c_custkey || '}, {"name": "' || c_mktsegment || '", "n": ' || c_custkey || '}]' WHEN 1 THEN '[' || c_name ELSE '{"name": "' || c_name || '", "n": ' || c_custkey || '}' END AS value FROM customer),
p AS (SELECT key, CASE WHEN json_valid(value) THEN value ELSE '[]' END AS v FROM c)
SELECT key, CAST(CASE WHEN json_type(v) = 'ARRAY' THEN json_array_length(v) ELSE 0 END AS INT) AS n_items, CASE WHEN json_type(v) = 'ARRAY' THEN coalesce(array_to_string(json_extract_string(v, '$[*].name'), '|'), '') ELSE '' END AS names FROM p"""


def saved_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customers' settings over the defaults; one in four has the address that is no longer valid."""
    k = F.col("c_custkey")
    saved = _read(spark, sf_dir, "customer").select("c_custkey", F.when(k % 3 > 0, F.col("c_mktsegment")).alias("mode"), F.when(k % 4 == 0, "http://old").when(k % 4 == 1, F.concat(F.lit("http://"), "c_name")).alias("url"))
    return workspace.configured(saved, {"mode": "expert", "url": "none"}, "http://old")


SAVED_SETTINGS_SQL = """
SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END, 'expert') AS mode, coalesce(nullif(CASE c_custkey % 4 WHEN 0 THEN 'http://old' WHEN 1 THEN 'http://' || c_name END, 'http://old'), 'none') AS url FROM customer"""


def model_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as the models that were found, then as what stands in where none of that kind is there."""
    brands = _read(spark, sf_dir, "part").select(F.col("p_brand").alias("model")).distinct()
    fallback = _read(spark, sf_dir, "region").select(F.col("r_name").alias("model"))
    some = workspace.listed_models(brands, fallback).withColumn("found", F.lit(True))
    return some.unionByName(workspace.listed_models(brands.where("model = 'no such brand'"), fallback).withColumn("found", F.lit(False)))


MODEL_LIST_SQL = "SELECT DISTINCT p_brand AS model, true AS found FROM part UNION ALL SELECT r_name, false FROM region"


def pull_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines of a download for each user; one in seven is no JSON, one has no total."""
    k = F.col("event_id")
    line = F.when(k % 7 == 0, F.col("event_type")).when(k % 7 == 1, '{"status": "success"}').otherwise(F.concat(F.lit('{"status": "pulling", "completed": '), (k % 60).cast("string"), F.lit(', "total": '), (k % 5 * 30).cast("string"), F.lit("}")))
    return workspace.pulled(_read(spark, sf_dir, "events").select(F.col("user_id").alias("model"), k.alias("seq"), line.alias("line")))


PULL_PROGRESS_SQL = """
WITH l AS (SELECT user_id AS model, event_id AS seq, CASE event_id % 7 WHEN 0 THEN event_type WHEN 1 THEN '{"status": "success"}' ELSE '{"status": "pulling", "completed": ' || event_id % 60 || ', "total": ' || event_id % 5 * 30 || '}' END AS line FROM events),
j AS (SELECT model, seq, json_extract_string(v, '$.status') AS status, CAST(json_extract_string(v, '$.completed') AS DOUBLE) AS c, CAST(json_extract_string(v, '$.total') AS DOUBLE) AS t FROM (SELECT *, CASE WHEN json_valid(line) THEN line ELSE '{}' END AS v FROM l))
SELECT model, seq, status, CAST(coalesce(floor(c * 100 / nullif(t, 0) + 0.5), CASE WHEN status = 'success' THEN 100 ELSE 0 END) AS INT) AS percent FROM j WHERE status IS NOT NULL"""


def abort_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as calls to stop an answer, in all forms."""
    n = F.col("o_orderkey").cast("string")
    form = lambda *parts: F.concat(*(F.lit(p) if p else n for p in parts))
    bodies = F.array(form("thr-", ""), form('{"session_id": "s', "", '"}'), form('{"thread_id": "t', "", '", "session_id": "s"}'), F.lit("{}"), form('{"thread_id": "", "session_id": "x', "", '"}'))
    return workspace.abort_request(_read(spark, sf_dir, "orders").select("o_orderkey", F.element_at(bodies, (F.col("o_orderkey") % 5 + 1).cast("int")).alias("body"))).select("o_orderkey", "thread_id")


ABORT_IDS_SQL = """
WITH b AS (SELECT o_orderkey, (['thr-' || o_orderkey, '{"session_id": "s' || o_orderkey || '"}', '{"thread_id": "t' || o_orderkey || '", "session_id": "s"}', '{}', '{"thread_id": "", "session_id": "x' || o_orderkey || '"}'])[o_orderkey % 5 + 1] AS body FROM orders),
j AS (SELECT *, CASE WHEN json_valid(body) THEN body ELSE '{}' END AS v FROM b)
SELECT o_orderkey, coalesce(nullif(json_extract_string(v, '$.thread_id'), ''), nullif(json_extract_string(v, '$.session_id'), ''), CASE WHEN NOT starts_with(ltrim(body), '{') THEN body END) AS thread_id FROM j"""


def drawer_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of an order as what is done to a drawer, in their order (ties: part, then supplier)."""
    li = _read(spark, sf_dir, "lineitem")
    action = F.struct("l_linenumber", "l_partkey", "l_suppkey", _pick(F.col("l_partkey"), "add", "remove", "pin").alias("kind"), _pick(F.col("l_suppkey"), "a", "b", "c", "d").alias("name"))
    d = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(action)).alias("actions")).withColumn("docs", F.array(F.lit("a"), F.lit("b")))
    return sessions.drawer(d).select("l_orderkey", F.array_join("docs", ",").alias("docs"))


DRAWER_ACTIONS_SQL = """
WITH RECURSIVE a AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n, (['add', 'remove', 'pin'])[l_partkey % 3 + 1] AS kind, (['a', 'b', 'c', 'd'])[l_suppkey % 4 + 1] AS name FROM lineitem),
f AS (SELECT DISTINCT l_orderkey AS k, 0::BIGINT AS n, ['a', 'b'] AS docs FROM lineitem
  UNION ALL SELECT f.k, a.n, CASE WHEN kind = 'add' THEN CASE WHEN list_contains(docs, name) THEN docs ELSE list_append(docs, name) END
    WHEN kind = 'remove' OR list_contains(docs, name) THEN list_filter(docs, lambda x: x <> name) ELSE list_prepend(name, docs) END FROM f JOIN a ON a.k = f.k AND a.n = f.n + 1)
SELECT k AS l_orderkey, coalesce(array_to_string(arg_max(docs, n), ','), '') AS docs FROM f GROUP BY k"""


def moved(rows: DataFrame, other: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` without those of ``keys``, and ``other`` with them; a row that ``other`` has already is not added again."""
    going = rows.join(keys.select(key), key, "left_semi").join(other.select(key), key, "left_anti")
    return sessions.removed(rows, keys, key), other.unionByName(going)


def archive_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as sessions, of which some are archived, some restored and some purged."""
    o = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("title"))
    live, archive = o.where("id % 4 > 0"), o.where("id % 4 = 0")
    live, archive = moved(live, archive, o.where("id % 6 = 1"), "id")
    archive, live = moved(archive, live, o.where("id % 12 = 0"), "id")
    archive = sessions.removed(archive, o.where("id % 20 = 8"), "id")
    return live.withColumn("place", F.lit("live")).unionByName(archive.withColumn("place", F.lit("archive")))


ARCHIVE_MOVES_SQL = """
WITH a AS (SELECT o_orderkey AS id, o_orderstatus AS title, o_orderkey % 4 = 0 OR o_orderkey % 6 = 1 AS away FROM orders),
b AS (SELECT id, title, away AND id % 12 <> 0 AS away FROM a)
SELECT id, title, CASE WHEN away THEN 'archive' ELSE 'live' END AS place FROM b WHERE NOT (away AND id % 20 = 8)"""


def snapshot_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as rows of two snapshots; the service was unavailable for one in five of the newer one."""
    k = F.col("o_orderkey")
    o = _read(spark, sf_dir, "orders")
    new = o.where(k % 3 > 0).select(k.alias("id"), F.when(k % 5 == 0, 503).when(k % 7 > 0, 200).alias("status"), F.lit("new").alias("version"))
    old = o.where(k % 2 == 0).select(k.alias("id"), F.lit(200).alias("status"), F.lit("old").alias("version"))
    return readers.kept_if_unavailable(new, old, "id", "status")


SNAPSHOT_KEPT_SQL = """
WITH n AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 503 WHEN o_orderkey % 7 > 0 THEN 200 END AS status, 'new' AS version FROM orders WHERE o_orderkey % 3 > 0),
u AS (SELECT * FROM n WHERE status IS DISTINCT FROM 503)
SELECT * FROM u UNION ALL SELECT o_orderkey, 200, 'old' FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey NOT IN (SELECT id FROM u)"""


def latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest state of each user's ingestion (ties: the greatest event)."""
    e = _read(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("x")).select("user_id", F.col("x.event_id").alias("event_id"), F.col("x.event_type").alias("status"))


LATEST_STATUS_SQL = """
SELECT user_id, event_id, event_type AS status FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1"""


def persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as replies with signs that they were not saved."""
    k = F.col("o_orderkey")
    r = _read(spark, sf_dir, "orders").select("o_orderkey", _flag(k, 7).alias("persisted"), _flag(k, 5).alias("saved"), _pick(k, None, "FAILED", "ok", "Error").alias("persistence_status"), _pick(k, None, "", "full").alias("persistence_error"))
    return workspace.persisted(r).select("o_orderkey", "is_persisted")


PERSISTENCE_SQL = f"""
WITH r AS (SELECT o_orderkey, {_flag_sql("o_orderkey", 7)} AS a, {_flag_sql("o_orderkey", 5)} AS b, ([NULL, 'FAILED', 'ok', 'Error'])[o_orderkey % 4 + 1] AS s, ([NULL, '', 'full'])[o_orderkey % 3 + 1] AS e FROM orders)
SELECT o_orderkey, a IS DISTINCT FROM false AND b IS DISTINCT FROM false AND coalesce(lower(s), '') NOT IN ('failed', 'error') AND coalesce(e, '') = '' AS is_persisted FROM r"""


def link_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customers' shared links without those of old samples."""
    k = F.col("c_custkey")
    links = _read(spark, sf_dir, "customer").select(F.concat(F.lit("share-"), (k % 50).cast("string")).alias("id"), _pick(k, None, "http://old.host/x", "http://new.host/x").alias("url"), "c_custkey")
    return workspace.own_links(links, ["share-1", "share-2"], "old.host")


LINK_PURGE_SQL = """
WITH l AS (SELECT 'share-' || c_custkey % 50 AS id, ([NULL, 'http://old.host/x', 'http://new.host/x'])[c_custkey % 3 + 1] AS url, c_custkey FROM customer)
SELECT * FROM l WHERE id NOT IN ('share-1', 'share-2') AND NOT coalesce(contains(url, 'old.host'), false)"""


def delete_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with flags that are there or not."""
    k = F.col("doc_id")
    d = _read(spark, sf_dir, "documents").select("doc_id", _flag(k, 7).alias("is_protected"), _flag(k, 5).alias("can_delete"), _flag(k, 3).alias("deletable"), _pick(k, "system", "user", None).alias("owner"))
    return library.deletable(d).select("doc_id", "protected", "deletable_now")


DELETE_GUARD_SQL = f"""
WITH d AS (SELECT doc_id, {_flag_sql("doc_id", 7)} AS p, {_flag_sql("doc_id", 5)} AS c, {_flag_sql("doc_id", 3)} AS e, (['system', 'user', NULL])[doc_id % 3 + 1] AS o FROM documents),
g AS (SELECT *, coalesce(p, c = false OR e = false OR o = 'system', false) AS protected FROM d)
SELECT doc_id, protected, coalesce(c, e, NOT protected) AS deletable_now FROM g"""


def name_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """parts whose name has the query in it; a query that is not trimmed finds fewer."""
    p = _read(spark, sf_dir, "part")
    found = lambda query, trimmed: library.named_like(F.col("p_name"), query, trimmed)
    return p.select("p_partkey", found("ART 1", False).alias("plain"), found(" ART 1 ", False).alias("untrimmed"), found(" ART 1 ", True).alias("trimmed"), found("  ", True).alias("blank"))


NAME_MATCHES_SQL = """
SELECT p_partkey, contains(lower(p_name), 'art 1') AS plain, contains(lower(p_name), ' art 1 ') AS untrimmed, contains(lower(p_name), 'art 1') AS trimmed, true AS blank FROM part"""


def suggestion_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as replies with suggestions of all forms; one in four has no active documents."""
    n = F.col("p_name")
    items = F.array(*(F.concat(F.lit(a), n, F.lit(b)) for a, b in (('"', '"'), ('{"title": "t ', '"}'), ('{"query": "", "prompt": "p ', '"}'), ('{"other": "', '"}'))), F.lit('""'))
    r = _read(spark, sf_dir, "part").select("p_partkey", F.slice(F.array(F.lit("d")), 1, F.when(F.col("p_partkey") % 4 > 0, 1).otherwise(0)).alias("active_docs"), items.alias("items"))
    return workspace.suggestions(r).select("p_partkey", F.array_join("queries", "|").alias("queries"))


SUGGESTION_LISTS_SQL = """
WITH r AS (SELECT p_partkey, CASE WHEN p_partkey % 4 > 0 THEN ['d'] ELSE [] END AS docs, ['"' || p_name || '"', '{"title": "t ' || p_name || '"}', '{"query": "", "prompt": "p ' || p_name || '"}', '{"other": "' || p_name || '"}', '""'] AS items FROM part),
q AS (SELECT p_partkey, docs, list_transform(items, lambda i: CASE WHEN starts_with(ltrim(i), '"') THEN nullif(json_extract_string(i, '$'), '')
    ELSE coalesce(nullif(json_extract_string(i, '$.query'), ''), nullif(json_extract_string(i, '$.title'), ''), nullif(json_extract_string(i, '$.prompt'), '')) END) AS q FROM r)
SELECT p_partkey, CASE WHEN len(docs) > 0 THEN array_to_string(list_filter(q, lambda x: x IS NOT NULL), '|') ELSE '' END AS queries FROM q"""


def elapsed(start: Column, end: Column, digits: int = 1) -> Column:
    """Seconds between two times in milliseconds."""
    return F.round((end - start) / 1000, digits)


def display_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the values of events."""
    k, v = F.col("event_id"), F.col("value")
    stage = _pick(k, None, "fusion", " ROUTING ", "no such stage", None)
    return _read(spark, sf_dir, "events").select(
        "event_id", labels.mb_label(v * 60).alias("mb"), labels.seconds_label(v / 16).alias("seconds"), labels.score_label(F.when(k % 3 > 0, v / 128)).alias("score"), labels.thought_label(F.when(k % 4 > 0, (k % 9 - 1) / 4)).alias("thought"),
        elapsed(k, k * 3 + 250, 2).alias("elapsed"), labels.stage_phrase(stage, v / 16).alias("phrase"),
    )


def _phrases() -> str:
    by_stage = "".join(f" WHEN upper(trim(stage)) = '{n}' THEN '{p}'" for n, p in labels.STAGES.items())
    by_time = "".join(f" WHEN value / 16 >= {s} THEN '{labels.STAGES[n]}'" for s, n in labels.FROM_SECONDS)
    return f"CASE{by_stage}{by_time} ELSE '{labels.STAGES['ROUTING']}' END"


DISPLAY_LABELS_SQL = f"""
WITH e AS (SELECT *, ([NULL, 'fusion', ' ROUTING ', 'no such stage', NULL])[event_id % 5 + 1] AS stage, CASE WHEN event_id % 3 > 0 THEN value / 128 END AS s, CASE WHEN event_id % 4 > 0 THEN (event_id % 9 - 1) / 4.0::DOUBLE END AS t FROM events)
SELECT event_id, CASE WHEN value * 60 >= 1024 THEN format('{{:.2f}} GB', value * 60 / 1024) ELSE format('{{:.2f}} MB', value * 60) END AS mb,
  CASE WHEN value / 16 < 1 THEN CAST(floor(value / 16 * 1000 + 0.5) AS BIGINT) || 'ms' ELSE format('{{:.2f}}s', value / 16) END AS seconds,
  CASE WHEN s IS NULL THEN '95%' ELSE CAST(floor(s * 100 + 0.5) AS BIGINT) || '%' END AS score,
  CASE WHEN t IS NULL OR t <= 0 THEN '0.0s' WHEN t < 1 THEN CAST(floor(t * 1000 + 0.5) AS BIGINT) || 'ms' ELSE format('{{:.1f}}s', t) END AS thought,
  round((event_id * 2 + 250) / 1000.0::DOUBLE, 2) AS elapsed, {_phrases()} AS phrase FROM e"""


def device_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What parts' names say of platforms, browsers, colours and files."""
    k = F.col("p_partkey")
    name = _pick(k, "Darwin", "Win32", "Linux x86_64", "plan9", None)
    agent = _pick(k, "X Android 9", "an iPhone", "Windows NT", "Macintosh", "linux", "?", None)
    colour = F.concat(F.lit("#"), F.substring(F.lower(F.lpad(F.hex(k * 7919 % 16777216), 6, "0")), 1, F.when(k % 2 == 0, 6).otherwise(3)))
    file = F.concat("p_brand", F.lit("."), _pick(k, "pdf", "DOCX", "csv", "bin"))
    return _read(spark, sf_dir, "part").select("p_partkey", text.platform(name).alias("platform"), text.system(agent, name).alias("system"), colour.alias("colour"), labels.rgb(colour)["r"].alias("r"), labels.rgb(colour)["g"].alias("g"), labels.rgb(colour)["b"].alias("b"), text.file_type(file).alias("type"), labels.char_sum(F.col("p_name")).alias("char_sum"))


DEVICE_LABELS_SQL = f"""
WITH p AS (SELECT p_partkey, p_name, lower(coalesce((['Darwin', 'Win32', 'Linux x86_64', 'plan9', NULL])[p_partkey % 5 + 1], '')) AS n, lower(coalesce((['X Android 9', 'an iPhone', 'Windows NT', 'Macintosh', 'linux', '?', NULL])[p_partkey % 7 + 1], '')) AS a,
  substr(lpad(lower(hex(p_partkey * 7919 % 16777216)), 6, '0'), 1, CASE WHEN p_partkey % 2 = 0 THEN 6 ELSE 3 END) AS c FROM part),
h AS (SELECT *, CASE WHEN length(c) = 3 THEN c[1] || c[1] || c[2] || c[2] || c[3] || c[3] ELSE c END AS x FROM p)
SELECT p_partkey, CASE {" ".join(f"WHEN regexp_matches(n, '{w}') THEN '{v}'" for w, v in text.PLATFORMS)} ELSE 'macos' END AS platform,
  CASE WHEN contains(a, 'android') THEN 'Android' WHEN regexp_matches(a, 'iphone|ipad|ipod') THEN 'iOS' WHEN contains(n, 'win') OR contains(a, 'windows') THEN 'Windows' WHEN contains(n, 'mac') OR contains(a, 'macintosh') THEN 'Mac'
    WHEN contains(n, 'linux') OR contains(a, 'linux') THEN 'Linux' ELSE 'Desktop' END AS system, '#' || c AS colour,
  {", ".join(f"CAST('0x' || substr(x, {i}, 2) AS INT) AS {v}" for i, v in ((1, "r"), (3, "g"), (5, "b")))}, (['pdf', 'docx', 'csv', 'other'])[p_partkey % 4 + 1] AS type,
  CAST(list_sum(list_transform(string_split(p_name, ''), lambda ch: unicode(ch))) AS INT) AS char_sum FROM h"""
