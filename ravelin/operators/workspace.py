"""What remains of a workstation: voices, resource needs, versions of questions, keys, links, models and uploads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Names of novelty voices, words of better ones, well-known voices in their order, all in lower case.
NOVELTY = ("albert", "bad news", "bahh", "bells", "boing", "bubbles", "cellos", "deranged", "good news", "hysterical", "pipe organ", "organ", "trinoids", "whisper", "wobble", "zarvox", "fred", "junior", "ralph", "superstar", "jester")
BETTER = ("enhanced", "premium", "natural", "neural", "online")
KNOWN = ("samantha", "google uk english female", "google us english", "daniel", "karen", "ava", "serena", "reed", "flo", "sandy", "shelley", "alex")
# Gigabytes of disk and memory of local models by a part of their name, and of local services; a workstation needs 1.2 GB of memory.
MODELS = (("7b", 4.7, 8.0), ("8b", 4.9, 16.0), ("", 2.0, 4.0))
SERVICES = {"graph": (1.5, 0.5), "memory": (0.25, 0.15), "cache": (0.05, 0.1)}
BASE_MEMORY = 1.2


def _has(column: Column, words: tuple[str, ...]) -> Column:
    return reduce(Column.__or__, [F.contains(column, F.lit(w)) for w in words])


def is_natural(name: str = "name", lang: str = "lang") -> Column:
    """F16: an English voice that is no novelty."""
    return F.startswith(F.lower(lang), F.lit("en")) & ~_has(F.lower(name), NOVELTY)


def best_voice(voices: DataFrame, by: str, preferred: str | None = None) -> DataFrame:
    """Of each ``by``, one voice (name, lang, pos): the preferred one; else, among the natural ones if there are any, the first
    with a better word, else the first of the first well-known name that is there, else en-US, else English, else the first."""
    low = F.lower("name")
    natural = is_natural()
    any_natural = F.max(natural).over(Window.partitionBy(by))
    known = F.coalesce(*(F.when(F.contains(low, F.lit(n)), F.lit(i)) for i, n in enumerate(KNOWN)))
    rank = (
        F.when(F.col("name") == F.lit(preferred), -1).when(any_natural & ~natural, 99).when(_has(low, BETTER), 0)
        .when(known.isNotNull(), known + 1).when(F.col("lang") == "en-US", 20).when(F.startswith(F.lower("lang"), F.lit("en")), 21).otherwise(22)
    )
    ranked = voices.withColumn("rank", rank)
    return ranked.groupBy(by).agg(F.min_by(F.struct("name", "lang", "rank"), F.struct("rank", "pos")).alias("v")).select(by, "v.*")


def _voices(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    k = F.col("p_partkey")
    names = F.array(*map(F.lit, ("Samantha", "Fred", "Google US English", "Ava (Premium)", "Anna", "Pipe Organ", "Daniel", "Thomas")))
    langs = F.array(*map(F.lit, ("en-US", "en-GB", "de-DE", "en-AU", "fr-FR")))
    name = F.when((k % 97 == 5) & (k > 300), "Pipe Organ").otherwise(F.element_at(names, (k * 7 % 8 + 1).cast("int")))
    return p.select(F.pmod(k, F.lit(97)).alias("device"), k.alias("pos"), name.alias("name"), F.element_at(langs, (k * 3 % 5 + 1).cast("int")).alias("lang"))


def voice_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16, O7 on voices made from part: a device for every 97th."""
    return best_voice(_voices(spark, sf_dir), "device")


VOICE_PICK_SQL = f"""
WITH v AS (SELECT p_partkey % 97 AS device, p_partkey AS pos, CASE WHEN p_partkey % 97 = 5 AND p_partkey > 300 THEN 'Pipe Organ' ELSE (['Samantha', 'Fred', 'Google US English', 'Ava (Premium)', 'Anna', 'Pipe Organ', 'Daniel', 'Thomas'])[p_partkey * 7 % 8 + 1] END AS name,
    (['en-US', 'en-GB', 'de-DE', 'en-AU', 'fr-FR'])[p_partkey * 3 % 5 + 1] AS lang FROM part),
n AS (SELECT *, starts_with(lower(lang), 'en') AND NOT regexp_matches(lower(name), '{"|".join(NOVELTY)}') AS ok FROM v),
r AS (SELECT *, CASE WHEN bool_or(ok) OVER (PARTITION BY device) AND NOT ok THEN 99 WHEN regexp_matches(lower(name), '{"|".join(BETTER)}') THEN 0
  WHEN contains(lower(name), 'samantha') THEN 1 WHEN contains(lower(name), 'google us english') THEN 3 WHEN contains(lower(name), 'daniel') THEN 4 WHEN contains(lower(name), 'ava') THEN 6
  WHEN lang = 'en-US' THEN 20 WHEN starts_with(lower(lang), 'en') THEN 21 ELSE 22 END AS rank FROM n)
SELECT device, arg_min(name, rank::BIGINT * 100000000 + pos) AS name, arg_min(lang, rank::BIGINT * 100000000 + pos) AS lang, min(rank) AS rank FROM r GROUP BY device"""


def footprint(configs: DataFrame) -> DataFrame:
    """Configurations (model, cloud, and local flags graph, memory, cache) with the gigabytes of disk and memory they need, in tenths."""
    disk, memory = F.lit(0.0), F.lit(BASE_MEMORY)
    for part, d, m in reversed(MODELS):
        if part:
            size_d, size_m = F.when(F.contains("model", F.lit(part)), d).otherwise(size_d), F.when(F.contains("model", F.lit(part)), m).otherwise(size_m)
        else:
            size_d, size_m = F.lit(d), F.lit(m)
    disk, memory = disk + F.when(F.col("cloud"), 0.0).otherwise(size_d), memory + F.when(F.col("cloud"), 0.0).otherwise(size_m)
    for name, (d, m) in SERVICES.items():
        disk, memory = disk + F.when(F.col(name), d).otherwise(0.0), memory + F.when(F.col(name), m).otherwise(0.0)
    tenth = lambda x: F.floor(F.round(x * 10, 6) + 0.5) / 10
    return configs.withColumn("disk_gb", tenth(disk)).withColumn("memory_gb", tenth(memory))


def resource_footprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7 on configurations made from suppliers."""
    s, k = spark.read.parquet(f"{sf_dir}/supplier.parquet"), F.col("s_suppkey")
    model = F.element_at(F.array(*map(F.lit, ("llama3.2:3b", "qwen2.5:7b", "llama3.1:8b", "other"))), (k % 4 + 1).cast("int"))
    return footprint(s.select("s_suppkey", model.alias("model"), (k % 5 == 0).alias("cloud"), (k % 2 == 0).alias("graph"), (k % 3 == 0).alias("memory"), (k % 7 == 0).alias("cache")))


RESOURCE_FOOTPRINT_SQL = """
WITH c AS (SELECT s_suppkey, (['llama3.2:3b', 'qwen2.5:7b', 'llama3.1:8b', 'other'])[s_suppkey % 4 + 1] AS model, s_suppkey % 5 = 0 AS cloud, s_suppkey % 2 = 0 AS graph, s_suppkey % 3 = 0 AS memory, s_suppkey % 7 = 0 AS cache FROM supplier),
s AS (SELECT *, CASE WHEN cloud THEN 0 WHEN contains(model, '7b') THEN 4.7 WHEN contains(model, '8b') THEN 4.9 ELSE 2.0 END::DOUBLE + CASE WHEN graph THEN 1.5 ELSE 0 END::DOUBLE + CASE WHEN memory THEN 0.25 ELSE 0 END::DOUBLE + CASE WHEN cache THEN 0.05 ELSE 0 END::DOUBLE AS d,
  1.2::DOUBLE + CASE WHEN cloud THEN 0 WHEN contains(model, '7b') THEN 8.0 WHEN contains(model, '8b') THEN 16.0 ELSE 4.0 END::DOUBLE + CASE WHEN graph THEN 0.5 ELSE 0 END::DOUBLE + CASE WHEN memory THEN 0.15 ELSE 0 END::DOUBLE + CASE WHEN cache THEN 0.1 ELSE 0 END::DOUBLE AS m FROM c)
SELECT s_suppkey, model, cloud, graph, memory, cache, floor(round(d * 10, 6) + 0.5) / 10 AS disk_gb, floor(round(m * 10, 6) + 0.5) / 10 AS memory_gb FROM s"""


def current(versions: str, index: str) -> Column:
    """The version that an index from 0 points at, the last one if there is no index or no such version; null without versions."""
    at = F.when((F.col(index) >= 0) & (F.col(index) < F.size(versions)), F.col(index) + 1).otherwise(-1).cast("int")
    return F.when(F.size(versions) > 0, F.element_at(F.col(versions), at))


def edited(turns: DataFrame) -> DataFrame:
    """Turns (question, versions of it with their answers, index, answer, new_question): the answer that is shown is
    kept in its version, then a version for the new question follows and is the current one."""
    kept = F.transform("versions", lambda v, i: F.struct(v["question"].alias("question"), F.when(i == F.coalesce("index", F.size("versions") - 1), F.col("answer")).otherwise(v["answer"]).alias("answer")))
    start = F.when(F.size("versions") > 0, kept).otherwise(F.array(F.struct(F.col("question").alias("question"), F.col("answer").alias("answer"))))
    added = F.concat(start, F.array(F.struct(F.col("new_question").alias("question"), F.lit(None).cast("string").alias("answer"))))
    return turns.withColumn("versions", added).withColumn("index", F.size("versions") - 1).withColumn("question", F.col("new_question"))


def version_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W8 on orders: the lines of an order are the versions of a question."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    lines = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity")))
    g = li.groupBy("l_orderkey").agg(lines.alias("lines"))
    v = F.transform("lines", lambda x: F.struct(F.concat(F.lit("q"), x["l_partkey"].cast("string")).alias("question"), x["l_returnflag"].alias("answer")))
    turns = g.select("l_orderkey", v.alias("versions"), F.when(F.col("l_orderkey") % 3 > 0, (F.col("l_orderkey") % 4).cast("int")).alias("index"), F.lit("shown").alias("answer"), F.lit("q0").alias("question"), F.concat(F.lit("new"), F.col("l_orderkey").cast("string")).alias("new_question"))
    before = turns.withColumn("was", current("versions", "index")["question"])
    after = edited(before)
    return after.select("l_orderkey", "was", F.size("versions").alias("n_versions"), current("versions", "index")["question"].alias("now"), F.size(F.filter("versions", lambda x: x["answer"] == "shown")).alias("n_shown"))


VERSION_POINTERS_SQL = """
WITH g AS (SELECT l_orderkey, list({'n': l_linenumber, 'p': l_partkey, 's': l_suppkey} ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_quantity) AS v, CASE WHEN l_orderkey % 3 > 0 THEN l_orderkey % 4 END AS i FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, 'q' || v[CASE WHEN i < len(v) THEN i + 1 ELSE len(v) END].p AS was, CAST(len(v) + 1 AS INT) AS n_versions, 'new' || l_orderkey AS now, CASE WHEN coalesce(i, 0) < len(v) THEN 1 ELSE 0 END AS n_shown FROM g"""


def verified_keys(configs: DataFrame) -> DataFrame:
    """Configurations (keys: array of struct provider, verified; substrates: array of struct mode, tested, online): whether one may go on, and the providers."""
    keys = F.coalesce(F.forall("keys", lambda k: F.coalesce(k["verified"], F.lit(False))), F.lit(True))
    cloud = F.forall(F.filter("substrates", lambda s: s["mode"] == "cloud"), lambda s: F.coalesce(s["tested"] & s["online"], F.lit(False)))
    names = F.array_join(F.array_distinct(F.transform("keys", lambda k: k["provider"])), ", ")
    return configs.withColumn("may_go_on", keys & cloud).withColumn("providers", F.when(F.size("keys") > 0, names).otherwise("None"))


def own_links(links: DataFrame, old_ids: list[str], old_host: str) -> DataFrame:
    """shared links without those of old samples."""
    return links.where(~F.col("id").isin(old_ids) & ~F.coalesce(F.contains("url", F.lit(old_host)), F.lit(False)))


def persisted(responses: DataFrame) -> DataFrame:
    """responses with none of the signs that they were not saved."""
    no = lambda c: F.coalesce(F.col(c) == F.lit(False), F.lit(False))
    failed = F.coalesce(F.lower("persistence_status").isin("failed", "error"), F.lit(False))
    return responses.withColumn("is_persisted", ~(no("persisted") | no("saved") | failed | (F.coalesce("persistence_error", F.lit("")) != "")))


def pulled(lines: DataFrame) -> DataFrame:
    """Lines of a model's download (model, seq, line of JSON) as progress; a line that is no JSON is left out."""
    j = F.from_json("line", "status string, completed long, total long")
    rows = lines.withColumn("j", j).where("j.status is not null")
    percent = F.coalesce(F.floor(F.try_divide(F.col("j.completed") * 100.0, F.col("j.total")) + 0.5), F.when(F.col("j.status") == "success", 100).otherwise(0))
    return rows.select("model", "seq", F.col("j.status").alias("status"), percent.cast("int").alias("percent"))


def upload_report(replies: DataFrame) -> DataFrame:
    """Replies to an upload with what the contract asks for: name, counts of 0 and the status ready where they are missing."""
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("pages", "chunks", "facts", "triples")}
    return replies.withColumns(zero | {"status": F.coalesce(F.nullif("status", F.lit("")), F.lit("ready")), "filename": F.coalesce(F.nullif("filename", F.lit("")), "sent_name")})


def session_rows(remote: DataFrame) -> DataFrame:
    """Rows of a session list (thread_id, session_id, id, title, attached_docs, sources) with one id, a title, and sources whose selection follows the attached names; where there are names only, placeholders stand for the sources."""
    names = F.coalesce("attached_docs", F.array().cast("array<string>"))
    own = F.transform("sources", lambda s: F.struct(s["name"].alias("name"), F.array_contains(names, s["name"]).alias("selected")))
    made = F.transform(names, lambda n: F.struct(n.alias("name"), F.lit(True).alias("selected")))
    return remote.select(
        F.coalesce(*(F.nullif(c, F.lit("")) for c in ("thread_id", "session_id", "id"))).alias("id"), F.coalesce(F.nullif("title", F.lit("")), F.lit("New Chat")).alias("title"),
        F.when(F.size(F.coalesce("sources", F.array().cast(remote.schema["sources"].dataType))) > 0, own).otherwise(made).alias("sources"),
    )


def toggled(sources: DataFrame, picked: DataFrame) -> DataFrame:
    """Sources (session, id, name, selected) after ``picked`` (session, id, name): a source with that name in any case, or that id, changes its mark; one that is not there is added, selected."""
    low = picked.select("session", F.lower("name").alias("low")).distinct().withColumn("by_name", F.lit(True))
    ids = picked.select("session", "id").distinct().withColumn("by_id", F.lit(True))
    s = sources.withColumn("low", F.lower("name")).join(low, ["session", "low"], "left").join(ids, ["session", "id"], "left")
    hit = F.col("by_name").isNotNull() | F.col("by_id").isNotNull()
    changed = s.select("session", "id", "name", F.when(hit, ~F.col("selected")).otherwise(F.col("selected")).alias("selected"))
    new = picked.withColumn("low", F.lower("name")).join(sources.select("session", F.lower("name").alias("low")), ["session", "low"], "left_anti").join(sources.select("session", "id"), ["session", "id"], "left_anti")
    return changed.unionByName(new.select("session", "id", "name", F.lit(True).alias("selected")))


def source_toggle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as sources of a nation's session."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    k, session = F.col("s_suppkey"), F.col("s_nationkey").alias("session")
    sources = s.where("s_suppkey % 4 > 0").select(session, k.alias("id"), F.col("s_name").alias("name"), (k % 2 == 0).alias("selected"))
    picked = s.where("s_suppkey % 3 = 0").select(session, F.when(k % 6 == 0, k).otherwise(-k).alias("id"), F.when(k % 6 == 0, F.lit("?")).otherwise(F.upper("s_name")).alias("name"))
    return toggled(sources, picked)


SOURCE_TOGGLE_SQL = """
WITH s AS (SELECT s_nationkey AS session, s_suppkey AS id, s_name AS name, s_suppkey % 2 = 0 AS selected FROM supplier WHERE s_suppkey % 4 > 0),
p AS (SELECT s_nationkey AS session, CASE WHEN s_suppkey % 6 = 0 THEN s_suppkey ELSE -s_suppkey END AS id, CASE WHEN s_suppkey % 6 = 0 THEN '?' ELSE upper(s_name) END AS name FROM supplier WHERE s_suppkey % 3 = 0)
SELECT session, id, name, CASE WHEN EXISTS (SELECT 1 FROM p WHERE p.session = s.session AND (p.id = s.id OR lower(p.name) = lower(s.name))) THEN NOT selected ELSE selected END AS selected FROM s
UNION ALL SELECT session, id, name, true FROM p WHERE NOT EXISTS (SELECT 1 FROM s WHERE p.session = s.session AND (p.id = s.id OR lower(p.name) = lower(s.name)))"""


def suggestions(replies: DataFrame) -> DataFrame:
    """Replies (active_docs, items: JSON texts of strings or objects with query, title or prompt) as lists of queries; none without active documents."""

    def query(item: Column) -> Column:
        v = F.try_parse_json(item)
        keys = [F.nullif(F.try_variant_get(v, f"$.{k}", "string"), F.lit("")) for k in ("query", "title", "prompt")]
        return F.coalesce(F.when(F.startswith(F.ltrim(item), F.lit('"')), F.nullif(F.try_variant_get(v, "$", "string"), F.lit(""))), *keys)

    return replies.withColumn("queries", F.when(F.size("active_docs") > 0, F.array_compact(F.transform("items", query))).otherwise(F.array().cast("array<string>")))


def configured(saved: DataFrame, defaults: dict, stale_url: str) -> DataFrame:
    """Saved settings over defaults, without an address that is no longer valid."""
    kept = saved.withColumn("url", F.when(F.col("url") != stale_url, F.col("url"))) if "url" in saved.columns else saved
    return kept.select(*(F.coalesce(c, F.lit(defaults[c])).alias(c) if c in defaults else F.col(c) for c in kept.columns))


def listed_models(found: DataFrame, fallback: DataFrame) -> DataFrame:
    """The models that were found, or the fixed ones if there are none."""
    none = found.agg((F.count("*") == 0).alias("none"))  # one row
    return found.unionByName(fallback.where(none.scalar()))


def abort_request(calls: DataFrame) -> DataFrame:
    """Calls (body: a thread id, or JSON with thread_id or session_id) as thread ids."""
    v = F.try_parse_json("body")
    ids = [F.nullif(F.try_variant_get(v, f"$.{k}", "string"), F.lit("")) for k in ("thread_id", "session_id")]
    return calls.withColumn("thread_id", F.coalesce(*ids, F.when(~F.startswith(F.ltrim("body"), F.lit("{")), F.col("body"))))
