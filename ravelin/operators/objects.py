"""JSON objects and lists of any shape: shallow merges of objects, and splices of lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def merged_objects(rows: DataFrame, key: str, order: str, objects: str) -> DataFrame:
    """``key``, merged (JSON text): the objects of each key, shallowly merged in the order of ``order``, so that of a name's values the last stays whole.

    Every object becomes a row for each of its names, tasks keep the last of each (key, name) before anything is shuffled, and the object is built
    again from those: no group holds all objects of a key. A value of null is a value. What is no JSON object adds nothing; a key with nothing but that
    has ``{}``. Names are in the order of their bytes. Of equal ``order`` the value that is greater as text stays; of names twice in one object JSON
    keeps the last. A null key is one key.
    """
    parsed = rows.select(key, order, F.try_parse_json(objects).alias("_v"))
    is_object = F.coalesce(F.schema_of_variant("_v").startswith("OBJECT<"), F.lit(False))
    parsed = parsed.select(key, order, F.when(is_object, F.col("_v")).alias("_v"))
    fields = parsed.lateralJoin(rows.sparkSession.tvf.variant_explode_outer(F.col("_v").outer()).toDF("_pos", "_name", "_value"))
    last = fields.groupBy(key, "_name").agg(F.max_by("_value", F.struct(order, F.to_json("_value"))).alias("_value"))
    # names become entries of one map for each key; the entry without a name stands for keys without objects
    entries = F.collect_list(F.when(F.col("_name").isNotNull(), F.struct("_name", "_value")))
    return last.groupBy(key).agg(F.to_json(F.to_variant_object(F.map_from_entries(entries))).alias("merged"))


def spliced(items: Column, start: Column, remove: Column, insert: Column) -> Column:
    """``items`` with ``remove`` of them, from index ``start`` (from 0, or from the end if negative), replaced by ``insert``.

    A start before the list is its beginning, one beyond it its end; fewer than none are none, more than there are all. Null in any of them: null.
    """
    size = F.size(items)
    at = F.when(start < 0, F.greatest(size + start, F.lit(0))).otherwise(F.least(start, size)).cast("int")
    gone = F.least(F.greatest(remove, F.lit(0)), size - at).cast("int")
    head, tail = F.slice(items, F.lit(1), at), F.slice(items, at + gone + 1, size - at - gone)
    return F.when(items.isNotNull() & start.isNotNull() & remove.isNotNull() & insert.isNotNull(), F.concat(head, insert, tail))


def _settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as objects that their users save: names that clash, nested values, nulls, and what is no object."""
    k = F.col("event_id")
    s, kind = k.cast("string"), F.col("event_type")
    shapes = F.array(
        F.concat(F.lit('{"'), kind, F.lit('": '), s, F.lit(', "seen": {"at": '), s, F.lit(', "tags": ["'), kind, F.lit('"]}}')), F.concat(F.lit('{"seen": null, "'), kind, F.lit('": "x'), s, F.lit('"}')),
        F.col("props"), F.concat(F.lit("["), s, F.lit("]")), F.lit("{broken"), F.concat(F.lit('{"a.b": ['), s, F.lit(', {"c": null}], "k": false}')), F.lit("{}"),
    )
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", F.element_at(shapes, (k % 7 + 1).cast("int")).alias("saved"))


def merged_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each user's saved objects come to: how many names, all of them, and some of the values."""
    m = merged_objects(_settings(spark, sf_dir), "user_id", "event_id", "saved")
    value = lambda path: F.get_json_object("merged", path)
    names = F.array_join(F.array_sort(F.json_object_keys("merged")), ",")
    return m.select("user_id", names.alias("names"), value("$.seen.at").alias("seen_at"), value("$.seen.tags[0]").alias("tag"), value("$['a.b'][0]").alias("first"), value("$.k").alias("k"), value("$.click").alias("click"))


MERGED_SETTINGS_SQL = r"""
WITH s AS (SELECT user_id, event_id, (['{"' || event_type || '": ' || event_id || ', "seen": {"at": ' || event_id || ', "tags": ["' || event_type || '"]}}', '{"seen": null, "' || event_type || '": "x' || event_id || '"}',
  props, '[' || event_id || ']', '{broken', '{"a.b": [' || event_id || ', {"c": null}], "k": false}', '{}'])[event_id % 7 + 1] AS saved FROM events),
o AS (SELECT user_id, event_id, CASE WHEN json_valid(saved) AND json_type(saved) = 'OBJECT' THEN CAST(saved AS JSON) END AS o FROM s),
n AS (SELECT user_id, event_id, o, unnest(json_keys(o)) AS name FROM o WHERE o IS NOT NULL),
l AS (SELECT user_id, name, arg_max(json_extract(o, '$."' || name || '"'), event_id) AS v FROM n GROUP BY ALL),
v AS (SELECT user_id, string_agg(name, ',' ORDER BY name) AS names, any_value(v) FILTER (name = 'seen') AS seen, any_value(v) FILTER (name = 'a.b') AS ab, any_value(v) FILTER (name = 'k') AS k, any_value(v) FILTER (name = 'click') AS click FROM l GROUP BY user_id)
SELECT user_id, coalesce(names, '') AS names, seen->>'$.at' AS seen_at, seen->>'$.tags[0]' AS tag, ab->>'$[0]' AS first, k->>'$' AS k, click->>'$' AS click FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN v USING (user_id)"""


def text_splices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X6 on the words of every text: two put in for up to three, from before the beginning to beyond the end."""
    k = F.col("doc_id")
    words = F.split("text", " ", -1)
    start, remove = (k % 11 - 5) * (k % 3 + 1), k % 5 - 1
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.array_join(spliced(words, start, remove, F.array(F.lit("<new>"), F.col("source"))), " ").alias("spliced"))


TEXT_SPLICES_SQL = """
WITH w AS (SELECT doc_id, source, string_split(text, ' ') AS w, (doc_id % 11 - 5) * (doc_id % 3 + 1) AS s, greatest(doc_id % 5 - 1, 0) AS r FROM documents),
a AS (SELECT *, CASE WHEN s < 0 THEN greatest(len(w) + s, 0) ELSE least(s, len(w)) END AS b FROM w)
SELECT doc_id, array_to_string(list_concat(list_concat(list_slice(w, 1, b), ['<new>', source]), list_slice(w, b + r + 1, len(w))), ' ') AS spliced FROM a"""
