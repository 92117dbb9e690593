"""Rule-based checks of claims and what is counted over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NUMBER = r"\d+(?:\.\d+)?"


def claims(answers: DataFrame, citations: DataFrame, overlap: float = 0.5) -> DataFrame:
    """Every sentence of ``answers`` (answer_id, text) as a claim, checked against ``citations`` (answer_id, citation_index, text).

    CITATION_INVALID if an index has no citation; NUMERICAL_MISMATCH if a number is in no cited text; without a
    citation UNSUPPORTED; else SUPPORTED if ``overlap`` of the claim's words are in the cited texts, else UNSUPPORTED.
    """
    said = F.filter(F.transform(F.split("text", r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")
    c = answers.select("answer_id", F.posexplode(said).alias("claim", "text"))
    marks = F.transform(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\[(\d+)\]"), F.lit(1))), lambda n: n.cast("int"))
    plain = F.regexp_replace("text", r"\[\d+\]", " ")
    c = c.select("answer_id", "claim", marks.alias("cited"), F.array_distinct(F.regexp_extract_all(plain, F.lit(NUMBER), F.lit(0))).alias("numbers"), F.array_distinct(F.filter(F.split(F.lower(plain), r"\W+"), lambda w: w != "")).alias("words"))
    # what a cited text says is read once for each citation; of a claim's meetings only its own numbers and words that were found move on
    tokens = lambda of: F.array_distinct(F.filter(F.split(F.lower(of), r"\W+"), lambda w: w != ""))
    given = citations.select("answer_id", "citation_index", F.array_distinct(F.regexp_extract_all("text", F.lit(NUMBER), F.lit(0))).alias("given_numbers"), tokens(F.col("text")).alias("given_words"), F.lit(1).alias("is"))
    each = c.withColumn("citation_index", F.explode("cited")).join(given, ["answer_id", "citation_index"], "left")
    met = each.select(
        "answer_id", "claim", "citation_index", F.col("is").isNotNull().alias("is"),
        F.transform(F.array_intersect("numbers", "given_numbers"), lambda n: F.array_position("numbers", n)).alias("found"), F.transform(F.array_intersect("words", "given_words"), lambda w: F.array_position("words", w)).alias("shared"),
    )
    union = lambda name: F.size(F.array_distinct(F.flatten(F.collect_list(name))))
    whole = met.groupBy("answer_id", "claim").agg(F.countDistinct(F.when(~F.col("is"), F.col("citation_index"))).alias("n_invalid"), union("found").alias("n_matched"), union("shared").alias("n_shared"))
    slim = c.select("answer_id", "claim", F.size("cited").alias("n_cited"), F.size("numbers").alias("n_numbers"), F.size("words").alias("n_words"))
    one = slim.join(whole, ["answer_id", "claim"], "left").fillna(0, ["n_invalid", "n_matched", "n_shared"])
    share = F.coalesce(F.try_divide(F.col("n_shared"), F.col("n_words")), F.lit(0.0))
    status = (
        F.when(F.col("n_invalid") > 0, "CITATION_INVALID").when(F.col("n_cited") == 0, "UNSUPPORTED")
        .when(F.col("n_matched") < F.col("n_numbers"), "NUMERICAL_MISMATCH").when(share >= overlap, "SUPPORTED").otherwise("UNSUPPORTED")
    )
    return one.select("answer_id", "claim", "n_numbers", F.col("n_matched").cast("int").alias("n_matched"), F.col("n_invalid").cast("long").alias("n_invalid"), status.alias("status"))


def _answers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Whole documents as answers, every ninth word with a marker and every seventh sentence's end with a number; the even words as their cited texts."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    k, words = F.col("doc_id"), F.split("text", " ", -1)
    n = lambda m: (k % m).cast("string")
    marked = F.transform(words, lambda w, i: F.when(i % 9 == 4, F.concat(w, F.lit(" ["), (i % 3 + 1).cast("string"), F.lit("]"))).when(i % 35 == 6, F.concat(w, F.lit(" "), (i % 8).cast("string"), F.lit(".5. Then"))).otherwise(w))
    answers = d.select(k.alias("answer_id"), F.concat(F.lit("Grew by "), n(4), F.lit(".5 in "), F.array_join(marked, " "), F.lit(" ["), (k % 3 + 1).cast("string"), F.lit("]. No source here. "), F.lit("Other 7 words [1].")).alias("text"))
    half = F.array_join(F.filter(words, lambda w, i: i % 2 == 0), " ")
    cites = d.select(k.alias("answer_id"), F.explode(F.sequence(F.lit(1), F.lit(2))).alias("citation_index"), F.concat(F.lit("grew by "), n(3), F.lit(".5 in "), half, F.lit(" 7, 4.5")).alias("text"))
    return answers, cites


def claim_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B10 on answers with numbers and markers added."""
    return claims(*_answers(spark, sf_dir))


#: Sentences, markers and numbers are found in the answers' texts.
CLAIM_VERIFY_SQL = r"""
WITH d AS (SELECT doc_id AS k, string_split(text, ' ') AS w FROM documents),
a AS (SELECT k, 'Grew by ' || k % 4 || '.5 in ' || array_to_string(list_transform(w, lambda x, i: CASE WHEN (i - 1) % 9 = 4 THEN x || ' [' || (i - 1) % 3 + 1 || ']' WHEN (i - 1) % 35 = 6 THEN x || ' ' || (i - 1) % 8 || '.5. Then' ELSE x END), ' ')
    || ' [' || k % 3 + 1 || ']. No source here. Other 7 words [1].' AS t FROM d),
e AS (SELECT k, n, 'grew by ' || k % 3 || '.5 in ' || array_to_string(list_filter(w, lambda x, i: i % 2 = 1), ' ') || ' 7, 4.5' AS t FROM d, range(1, 3) AS r(n)),
s AS (SELECT k, list_filter(list_transform(string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(57344), 'g'), chr(57344)), lambda x: trim(x)), lambda x: x <> '') AS s FROM a),
c AS (SELECT k, unnest(s) AS t, generate_subscripts(s, 1) - 1 AS claim FROM s),
m AS (SELECT *, list_distinct(list_transform(regexp_extract_all(t, '\[(\d+)\]', 1), lambda n: CAST(n AS INT))) AS cited, regexp_replace(t, '\[\d+\]', ' ', 'g') AS plain FROM c),
f AS (SELECT *, list_distinct(regexp_extract_all(plain, '\d+(?:\.\d+)?')) AS numbers, list_distinct(list_filter(regexp_split_to_array(lower(plain), '[^a-zA-Z0-9_]+'), lambda x: x <> '')) AS words FROM m),
v AS (SELECT f.k, claim, count(*) FILTER (n IS NULL) AS bad, coalesce(string_agg(e.t, ' '), '') AS evidence FROM (SELECT k, claim, unnest(cited) AS i FROM f) f LEFT JOIN e ON e.k = f.k AND e.n = f.i GROUP BY ALL),
g AS (SELECT f.*, coalesce(bad, 0) AS bad, len(list_intersect(numbers, regexp_extract_all(coalesce(evidence, ''), '\d+(?:\.\d+)?'))) AS hit, len(list_intersect(words, regexp_split_to_array(lower(coalesce(evidence, '')), '[^a-zA-Z0-9_]+'))) AS shared FROM f LEFT JOIN v USING (k, claim))
SELECT k AS answer_id, CAST(claim AS INT) AS claim, CAST(len(numbers) AS INT) AS n_numbers, CAST(hit AS INT) AS n_matched, bad AS n_invalid,
  CASE WHEN bad > 0 THEN 'CITATION_INVALID' WHEN len(cited) = 0 THEN 'UNSUPPORTED' WHEN hit < len(numbers) THEN 'NUMERICAL_MISMATCH' WHEN len(words) > 0 AND shared / len(words)::DOUBLE >= 0.5 THEN 'SUPPORTED' ELSE 'UNSUPPORTED' END AS status FROM g"""


def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and the decision over labels, grouped by source: a label's quality stands for support, toxic for a mismatch."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    j = spark.read.parquet(f"{sf_dir}/labels.parquet").join(d, "doc_id")
    g = j.groupBy("source").agg(F.count("*").alias("n_claims"), F.count_if(F.col("quality") == 1).alias("n_supported"), F.count_if(F.col("toxic") == 1).alias("n_mismatches"), F.bool_and(F.col("quality") == 1).alias("all_supported"))
    share = F.try_divide("n_supported", "n_claims")
    decision = F.when((share >= 0.9) & (F.col("n_mismatches") == 0), "accept").when(share >= 0.8, "accept_with_warning").when(share >= 0.5, "retry").otherwise("reject")
    return g.withColumn("faithfulness", F.round(share, 6)).withColumn("decision", decision)


QUALITY_GATE_SQL = """
WITH g AS (SELECT source, count(*) AS n_claims, count(*) FILTER (quality = 1) AS n_supported, count(*) FILTER (toxic = 1) AS n_mismatches, bool_and(quality = 1) AS all_supported
  FROM labels JOIN documents USING (doc_id) GROUP BY source)
SELECT *, round(n_supported / n_claims::DOUBLE, 6) AS faithfulness, CASE WHEN n_supported / n_claims::DOUBLE >= 0.9 AND n_mismatches = 0 THEN 'accept' WHEN n_supported / n_claims::DOUBLE >= 0.8 THEN 'accept_with_warning'
  WHEN n_supported / n_claims::DOUBLE >= 0.5 THEN 'retry' ELSE 'reject' END AS decision FROM g"""


def feedback_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user the ratings up (purchase, signup) and down (error), their ratio (0 without ratings) and its percent."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    up, down = F.count_if(F.col("event_type").isin("purchase", "signup")), F.count_if(F.col("event_type") == "error")
    g = e.groupBy("user_id").agg(up.alias("up"), down.alias("down")).withColumn("total", F.col("up") + F.col("down"))
    ratio = F.coalesce(F.try_divide("up", "total"), F.lit(0.0))
    return g.select("user_id", "up", "down", "total", F.round(ratio, 6).alias("ratio"), F.floor(ratio * 100 + 0.5).alias("percent"))


FEEDBACK_STATS_SQL = """
WITH g AS (SELECT user_id, count(*) FILTER (event_type IN ('purchase', 'signup')) AS up, count(*) FILTER (event_type = 'error') AS down FROM events GROUP BY 1)
SELECT *, up + down AS total, round(coalesce(up / nullif(up + down, 0)::DOUBLE, 0), 6) AS ratio, CAST(floor(coalesce(up / nullif(up + down, 0)::DOUBLE, 0) * 100 + 0.5) AS BIGINT) AS percent FROM g"""
