"""Token streams and ingestion progress as tables of lines and events; the streaming forms are in ravelin.streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The keys whose string is a token, in their order, and those that make a line metadata.
TOKEN_KEYS = ("token", "text", "content", "response", "delta.content", "reply")
METADATA_KEYS = ("citations", "subgraph", "sources")


def classified(lines: DataFrame) -> DataFrame:
    """R2: every line (column ``line``) with its kind (drop, token, metadata) and what it adds to the text.

    JSON under data: that is neither token nor metadata is text, as is any other plain line; JSON that can't be parsed
    is left to the caller as kind broken. Metadata is one JSON object.
    """
    strip = lambda c: F.regexp_replace(F.regexp_replace(c, r"^\s+", ""), r"\s+$", "")
    # in steps, so that each line is parsed once
    line, own = F.col("line"), {c: F.col(f"`{c}`") for c in lines.columns}
    rows = lines.select(F.struct(*own.values()).alias("_row"), "line", line.startswith("data:").alias("_data"), strip(line).alias("_bare"))
    rows = rows.withColumn("_payload", F.when(F.col("_data"), F.regexp_replace(F.substr(line, F.lit(6)), r"^[ \t]", "")).otherwise(line))
    rows = rows.withColumn("_core", strip(F.col("_payload")))
    core, payload, bare, data = F.col("_core"), F.col("_payload"), F.col("_bare"), F.col("_data")
    rows = rows.withColumn("_parsed", F.try_parse_json(F.when(core.startswith("{") & core.endswith("}"), core)))
    rows = rows.withColumn("_strings", F.array(*(F.try_variant_get("_parsed", f"$.{k}", "variant") for k in TOKEN_KEYS)))
    # the first key that has a string; other values are no tokens, though they may be read as strings
    typed = F.transform("_strings", lambda v: F.struct(F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False)).alias("is"), F.try_variant_get(v, "$", "string").alias("as")))
    meta_paths = [F.try_variant_get("_parsed", f"$.{k}", "variant") for k in METADATA_KEYS]
    truthy = F.transform(F.array(*meta_paths), lambda v: ~F.coalesce(F.to_json(v), F.lit("null")).isin("null", "false", "0", '""'))
    rows = rows.withColumns({"_typed": typed, "_meta": F.exists(truthy, lambda x: x) | F.coalesce(F.try_variant_get("_parsed", "$.status", "string") == "completed", F.lit(False))})
    rows = rows.withColumns({"_string": F.exists("_typed", lambda t: t["is"]), "_token": F.get(F.filter(F.transform("_typed", lambda t: t["as"]), lambda x: x.isNotNull()), F.lit(0))})
    braces = core.startswith("{") & core.endswith("}")
    kind = (
        F.when((bare == "") | bare.startswith(":") | bare.startswith("event:"), "drop")
        .when((payload == "") | (core == "[DONE]"), "drop")
        .when(braces & F.col("_parsed").isNull(), "broken").when(F.col("_string"), "token").when(braces & F.col("_meta"), "metadata")
        .when(data, "token").when(~core.startswith("{") & ~core.startswith("["), "token").otherwise("drop")
    )
    rows = rows.withColumn("kind", kind)
    added = F.when(F.col("_string"), F.col("_token")).when(data, F.concat(payload, F.lit("\n"))).otherwise(F.concat(line, F.lit("\n")))
    return rows.select("_row.*", "kind", F.when(F.col("kind") == "token", added).alias("added"), F.when(F.col("kind") == "metadata", core).alias("metadata"))


def folded(lines: DataFrame, *, block: int = 1024) -> DataFrame:
    """request_id, text, n_tokens, and metadata: the keys of all its objects, the last value of each, as a map of JSON strings.

    A line that was delivered twice (same request_id and seq) counts once. Lines are folded in blocks of ``block`` seqs, and a request's
    blocks then, so that the lines of a long stream never meet in one group; its text and the last values do, as they are its result.
    """
    c = classified(lines.dropDuplicates(["request_id", "seq"])).withColumn("block", F.col("seq") - F.pmod("seq", F.lit(block)))
    merge = lambda acc, m: F.map_concat(F.map_filter(acc, lambda k, v: ~F.map_contains_key(m, k)), m)
    merged = lambda maps: F.aggregate(maps, F.create_map().cast("map<string,string>"), merge)
    pieces = F.array_sort(F.collect_list(F.when(F.col("kind") == "token", F.struct("seq", "added"))))
    objects = F.array_sort(F.collect_list(F.when(F.col("kind") == "metadata", F.struct("seq", "metadata"))))
    parts = c.groupBy("request_id", "block").agg(pieces.alias("p"), objects.alias("o")).select(
        "request_id", "block", F.array_join(F.transform("p", lambda x: x["added"]), "").alias("text"), F.size("p").alias("n"), merged(F.transform("o", lambda x: F.from_json(x["metadata"], "map<string,string>"))).alias("metadata"),
    )
    # a map can't be sorted by, so blocks are put in order by their numbers alone
    ordered = lambda name: F.transform(F.array_sort(F.collect_list(F.struct("block", F.to_json(name).alias("v")))), lambda x: F.from_json(x["v"], "map<string,string>"))
    texts = F.array_sort(F.collect_list(F.struct("block", "text")))
    g = parts.groupBy("request_id").agg(texts.alias("texts"), F.sum("n").cast("int").alias("n_tokens"), ordered("metadata").alias("maps"))
    return g.select("request_id", F.array_join(F.transform("texts", lambda x: x["text"]), "").alias("text"), "n_tokens", merged(F.col("maps")).alias("metadata"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as the lines of one stream for each user."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.col("event_id")
    s = k.cast("string")
    shapes = F.array(
        F.concat(F.lit('data: {"token": "t'), s, F.lit(' "}')), F.concat(F.lit('{"text": "x'), s, F.lit('"}')), F.concat(F.lit("data: plain "), s), F.lit(": keepalive"),
        F.lit("event: ping"), F.lit("data: [DONE]"), F.concat(F.lit('data: {"stage": '), s, F.lit("}")), F.concat(F.lit("line "), s), F.concat(F.lit('data: {"citations": ['), s, F.lit('], "n": '), s, F.lit("}")), F.lit(""),
    )
    return e.select(F.col("user_id").alias("request_id"), k.alias("seq"), F.element_at(shapes, (k % 10 + 1).cast("int")).alias("line"))


def stream_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2, R3, A8, A9."""
    f = folded(_lines(spark, sf_dir))
    return f.select("request_id", "text", "n_tokens", F.col("metadata")["citations"].alias("citations"), F.col("metadata")["n"].alias("last_n"))


STREAM_FOLD_SQL = r"""
WITH l AS (SELECT user_id AS request_id, event_id AS seq, (['data: {"token": "t' || event_id || ' "}', '{"text": "x' || event_id || '"}', 'data: plain ' || event_id, ': keepalive', 'event: ping', 'data: [DONE]',
    'data: {"stage": ' || event_id || '}', 'line ' || event_id, 'data: {"citations": [' || event_id || '], "n": ' || event_id || '}', ''])[event_id % 10 + 1] AS line FROM events),
p AS (SELECT *, starts_with(line, 'data:') AS data, CASE WHEN starts_with(line, 'data:') THEN regexp_replace(substr(line, 6), '^[ \t]', '') ELSE line END AS payload FROM l),
j AS (SELECT *, trim(payload) AS core, CASE WHEN starts_with(trim(payload), '{') AND json_valid(trim(payload)) THEN CAST(trim(payload) AS JSON) END AS o FROM p),
k AS (SELECT *, list_filter([o->'$.token', o->'$.text', o->'$.content', o->'$.response', o->'$.delta.content', o->'$.reply'], lambda x: json_type(x) = 'VARCHAR') AS strings,
  coalesce(json_type(o->'$.citations') NOT IN ('NULL') OR json_type(o->'$.subgraph') NOT IN ('NULL') OR json_type(o->'$.sources') NOT IN ('NULL') OR o->>'$.status' = 'completed', false) AS meta FROM j),
c AS (SELECT *, CASE WHEN trim(line) = '' OR starts_with(line, ':') OR starts_with(line, 'event:') OR payload = '' OR core = '[DONE]' THEN 'drop' WHEN len(strings) > 0 THEN 'token' WHEN o IS NOT NULL AND meta THEN 'metadata'
  WHEN data OR NOT (starts_with(core, '{') OR starts_with(core, '[')) THEN 'token' ELSE 'drop' END AS kind FROM k),
a AS (SELECT *, CASE WHEN kind = 'token' THEN CASE WHEN len(strings) > 0 THEN strings[1]->>'$' ELSE CASE WHEN data THEN payload ELSE line END || chr(10) END END AS added FROM c)
SELECT request_id, coalesce(string_agg(added, '' ORDER BY seq), '') AS text, CAST(count(added) AS INT) AS n_tokens,
  arg_max(o->>'$.citations', seq) FILTER (kind = 'metadata') AS citations, arg_max(o->>'$.n', seq) FILTER (kind = 'metadata') AS last_n FROM a GROUP BY 1"""


def is_terminal(phase: Column, percent: Column, status: Column) -> Column:
    return F.coalesce((status == "ready") | (percent >= 100) | (phase == "ready"), F.lit(False))


def progressed(events: DataFrame) -> DataFrame:
    """Events (doc_id, seq, payload) as progress, up to and with the first that ends each document's ingestion.

    ``payload`` is JSON or [DONE]. What is no JSON is ignored; objects with an unknown phase or a percent out of range
    have the defaults (percent 50, processing). A phase of error does not end it. The consumer's progress is clamped
    to 15 to 100.
    """
    raw = F.from_json("payload", "phase string, percent double, progress_percent double, status string, detail string")
    done = F.col("payload") == "[DONE]"
    e = events.where(done | (F.try_parse_json("payload").isNotNull() & F.col("payload").startswith("{"))).withColumn("j", raw)
    phase, given = F.lower(F.col("j.phase")), F.coalesce("j.percent", "j.progress_percent", F.lit(0.0))
    valid = (phase.isNull() | phase.isin("uploading", "parsing", "chunking", "embedding", "ready", "error")) & given.between(0, 100)
    e = e.select(
        "doc_id", "seq",
        F.when(done, "ready").when(valid, phase).otherwise(F.coalesce("j.phase", F.lit("processing"))).alias("phase"),
        F.when(done, 100.0).when(valid, given).otherwise(F.coalesce("j.percent", F.lit(50.0))).alias("percent"),
        F.when(done, "ready").when(valid, F.col("j.status")).otherwise(F.coalesce("j.status", F.when(F.col("j.percent") >= 100, "ready").otherwise("processing"))).alias("status"),
        valid.alias("valid"),
    )
    # an invalid object ends it by status or percent, not by phase
    e = e.withColumn("terminal", is_terminal(F.when(F.coalesce("valid", F.lit(True)), F.col("phase")), F.col("percent"), F.col("status")))
    before = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("ended", F.coalesce(F.max("terminal").over(before), F.lit(False))).where(~F.col("ended"))
    return e.select("doc_id", "seq", "phase", "percent", "status", "terminal", F.greatest(F.lit(15.0), F.least(F.lit(100.0), "percent")).alias("shown"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.col("event_id")
    phases = F.element_at(F.array(*map(F.lit, ("UPLOADING", "parsing", "error", "weird"))), (k % 4 + 1).cast("int"))
    percent = F.floor(F.col("value") % 110).cast("string")
    body = F.concat(F.lit('{"phase": "'), phases, F.lit('", "'), F.when(k % 3 == 0, "percent").otherwise("progress_percent"), F.lit('": '), percent, F.lit("}"))
    payload = F.when(k % 37 == 0, "[DONE]").when(k % 11 == 0, "not json").otherwise(body)
    return e.select(F.col("user_id").alias("doc_id"), k.alias("seq"), payload.alias("payload"))


def ingestion_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R5, R6."""
    return progressed(_events(spark, sf_dir))


INGESTION_PROGRESS_SQL = """
WITH l AS (SELECT user_id AS doc_id, event_id AS seq, CASE WHEN event_id % 37 = 0 THEN '[DONE]' WHEN event_id % 11 = 0 THEN 'not json' ELSE '{"phase": "' || (['UPLOADING', 'parsing', 'error', 'weird'])[event_id % 4 + 1]
    || '", "' || CASE WHEN event_id % 3 = 0 THEN 'percent' ELSE 'progress_percent' END || '": ' || CAST(floor(value % 110) AS INT) || '}' END AS line FROM events),
o AS (SELECT *, CASE WHEN json_valid(line) THEN CAST(line AS JSON) END AS j FROM l),
e AS (SELECT doc_id, seq, line = '[DONE]' AS done, j IS NULL AS bad, j->>'$.phase' AS p, CAST(coalesce(j->>'$.percent', j->>'$.progress_percent') AS DOUBLE) AS v, j->>'$.percent' IS NOT NULL AS own FROM o),
f AS (SELECT *, p <> 'weird' AND v BETWEEN 0 AND 100 AS valid FROM e WHERE done OR NOT bad),
g AS (SELECT doc_id, seq, CASE WHEN done THEN 'ready' WHEN valid THEN lower(p) ELSE p END AS phase, CASE WHEN done THEN 100.0::DOUBLE WHEN valid THEN v WHEN own THEN v ELSE 50.0::DOUBLE END AS percent,
  CASE WHEN done THEN 'ready' WHEN valid THEN NULL WHEN own AND v >= 100 THEN 'ready' ELSE 'processing' END AS status FROM f),
h AS (SELECT *, coalesce(status = 'ready', false) OR percent >= 100 AS terminal FROM g),
i AS (SELECT *, coalesce(bool_or(terminal) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS ended FROM h)
SELECT doc_id, seq, phase, percent, status, terminal, greatest(15.0::DOUBLE, least(100.0::DOUBLE, percent)) AS shown FROM i WHERE NOT ended"""
