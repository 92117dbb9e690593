"""Rows that are shown or downloaded: document links and cards, models with what they need, ids of sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.functions import text
from ravelin.sources import readers

# Gigabytes of disk and memory of a model by a part of its name, and of all others.
MODEL_SIZES = (("3b", 2.0, 4.0), ("7b", 4.7, 8.0), ("", 4.9, 16.0))


def model_rows(models: DataFrame) -> DataFrame:
    """Models (provider, display_name, model, status, tier) with is_active, size_gb, memory_gb; the provider is shown where there is no name."""
    *known, (_, disk, memory) = MODEL_SIZES
    size, ram = F.lit(disk), F.lit(memory)
    for part, d, m in reversed(known):
        size, ram = F.when(F.contains("model", F.lit(part)), d).otherwise(size), F.when(F.contains("model", F.lit(part)), m).otherwise(ram)
    shown = text.truthy(F.col("display_name"), F.col("provider"))
    return models.select("provider", shown.alias("display_name"), "model", "status", "tier", (F.col("status") == "READY").alias("is_active"), size.alias("size_gb"), ram.alias("memory_gb"))


def document_cards(items: DataFrame) -> DataFrame:
    """Items (name, size, uploaded_at, pages, status) as the name and the text of a file that says what is known of each; no pages count as one."""
    pages = F.when(F.col("pages") > 0, F.col("pages")).otherwise(1)
    lines = (("Filename", F.col("name")), ("Size", F.col("size")), ("Uploaded", F.col("uploaded_at")), ("Pages", pages.cast("string")), ("Status", F.col("status")))
    card = F.array_join(F.array(*(F.concat(F.lit(f"{label}: "), F.coalesce(value, F.lit(""))) for label, value in lines)), "\n")
    stem = F.substr("name", F.lit(1), F.length("name") - 4)
    return items.select("name", F.when(F.endswith("name", F.lit(".pdf")), F.concat(stem, F.lit("_metadata.txt"))).otherwise(F.col("name")).alias("file"), card.alias("card"))


def uuid_of(*key: Column) -> Column:
    """An id of version 4's form that a key always has: hexadecimal digits of its hash, with the version's digit and one of the variant's four."""
    digits = F.md5(F.concat_ws("\x1f", *(F.coalesce(k.cast("string"), F.lit("\x00")) for k in key)).cast("binary"))
    part = lambda a, n: F.substring(digits, a, n)
    variant = F.element_at(F.array(*map(F.lit, "89ab")), F.conv(part(17, 1), 16, 10).cast("int") % 4 + 1)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-4"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def document_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A link for each document, named by the beginning of its text, to a page or, where there is none, to the document."""
    name = F.concat(F.substring("text", 1, 30), F.lit("/ü & co.pdf"))
    page = F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 40 - 2)
    return _documents(spark, sf_dir).select("doc_id", text.deep_link(F.lit("https://host/api/documents"), name, page).alias("link"))


DOCUMENT_LINKS_SQL = """
WITH d AS (SELECT doc_id, substr(text, 1, 30) || '/ü & co.pdf' AS name, CASE WHEN doc_id % 3 > 0 THEN doc_id % 40 - 2 END AS page FROM documents)
SELECT doc_id, 'https://host/api/documents/' || array_to_string(list_transform(string_split(name, ''), lambda c: CASE WHEN contains('!''()*', c) THEN c ELSE url_encode(c) END), '') || CASE WHEN page > 0 THEN '#page=' || page ELSE '' END AS link FROM d"""


def metadata_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K14 on documents as library items."""
    k = F.col("doc_id")
    suffix = F.element_at(F.array(*map(F.lit, (".pdf", ".txt", ".pdf.md"))), (k % 3 + 1).cast("int"))
    items = _documents(spark, sf_dir).select(F.concat("source", F.lit("-"), k.cast("string"), suffix).alias("name"), F.concat(F.col("n_chars").cast("string"), F.lit(" B")).alias("size"), F.col("lang").alias("uploaded_at"), F.when(k % 4 > 0, k % 4 - 1).alias("pages"), F.col("source").alias("status"))
    return document_cards(items)


METADATA_CARDS_SQL = """
WITH d AS (SELECT *, source || '-' || doc_id || (['.pdf', '.txt', '.pdf.md'])[doc_id % 3 + 1] AS name, CASE WHEN doc_id % 4 > 0 THEN doc_id % 4 - 1 END AS pages FROM documents)
SELECT name, regexp_replace(name, '[.]pdf$', '_metadata.txt') AS file, 'Filename: ' || name || chr(10) || 'Size: ' || coalesce(n_chars || ' B', '') || chr(10) || 'Uploaded: ' || coalesce(lang, '') || chr(10) || 'Pages: ' || CASE WHEN pages > 0 THEN pages ELSE 1 END || chr(10) || 'Status: ' || coalesce(source, '') AS card FROM d"""


def listed_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P17 on models named by parts."""
    p, k = spark.read.parquet(f"{sf_dir}/part.parquet"), F.col("p_partkey")
    size = F.element_at(F.array(*map(F.lit, ("3b", "7b", "8b", "13b-q4"))), (k % 4 + 1).cast("int"))
    rows = p.select(F.col("p_brand").alias("provider"), F.when(k % 5 == 0, "").when(k % 5 > 1, F.col("p_name")).alias("display_name"), F.concat(F.regexp_replace("p_name", " ", "-"), F.lit(":"), size).alias("model"), F.when(k % 3 == 0, "READY").when(k % 3 == 1, "PULLING").alias("status"), F.col("p_type").alias("tier"))
    return model_rows(rows)


LISTED_MODELS_SQL = """
WITH m AS (SELECT p_partkey AS k, p_brand AS provider, p_name, replace(p_name, ' ', '-') || ':' || (['3b', '7b', '8b', '13b-q4'])[p_partkey % 4 + 1] AS model, p_type AS tier FROM part)
SELECT provider, CASE WHEN k % 5 > 1 THEN p_name ELSE provider END AS display_name, model, CASE k % 3 WHEN 0 THEN 'READY' WHEN 1 THEN 'PULLING' END AS status, tier, CASE k % 3 WHEN 0 THEN true WHEN 1 THEN false END AS is_active,
  CASE WHEN position('3b' IN model) > 0 THEN 2.0 WHEN position('7b' IN model) > 0 THEN 4.7 ELSE 4.9 END::DOUBLE AS size_gb, CASE WHEN position('3b' IN model) > 0 THEN 4.0 WHEN position('7b' IN model) > 0 THEN 8.0 ELSE 16.0 END::DOUBLE AS memory_gb FROM m"""


def session_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An id for each message of each conversation."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return c.select("conv_id", "turn", uuid_of(F.col("conv_id"), F.col("turn")).alias("id"))


SESSION_IDS_SQL = """
WITH h AS (SELECT conv_id, turn, md5(conv_id || chr(31) || turn) AS h FROM conversations)
SELECT conv_id, turn, h[1:8] || '-' || h[9:12] || '-4' || h[14:16] || '-' || ('89ab')[(position(h[17] IN '0123456789abcdef') - 1) % 4 + 1] || h[18:20] || '-' || h[21:32] AS id FROM h"""


def table_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables that can be asked, as views: name, columns, rows."""
    found = readers.views(spark, sf_dir)
    return spark.sql(" UNION ALL ".join(f"SELECT '{name}' AS name, '{' '.join(sorted(df.columns))}' AS columns, count(*) AS n_rows FROM {name}" for name, df in found.items()))


TABLE_LIST_SQL = " UNION ALL ".join(
    f"SELECT '{name}' AS name, (SELECT string_agg(column_name, ' ' ORDER BY column_name) FROM (DESCRIBE {name})) AS columns, (SELECT count(*) FROM {name}) AS n_rows" for name in readers.TABLES
)
