"""Readers and writers: JSON with defaults and a corrupt column, files to upload, key-value rows, and report files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Suffixes of files that may be uploaded, and the phases of their ingestion.
UPLOAD_SUFFIXES = ("pdf", "docx", "doc", "txt", "md", "csv", "xlsx")
PHASES = ("uploading", "parsing", "chunking", "embedding", "ready", "error")

SCHEMAS = {
    "citation": "citation_index int, chunk_id string, document_id string, pdf_filename string, primary_page int, heading string, plain_text string, university string, similarity double",
    "document": "id string, doc_id string, filename string, name string, pages int, size_mb double, chunks_count int, status string, is_protected boolean, can_delete boolean, deletable boolean, owner string, uploaded_at string",
    "ingestion_event": "doc_id string, seq bigint, phase string, percent double, progress_percent double, status string, detail string",
    "query_request": "query string, hops int, top_k int, mode string, document_filter string, active_docs array<string>, thread_id string, chat_history array<struct<human:string,ai:string>>",
    "stream_line": "request_id string, seq bigint, line string",
    "feedback": "session_id string, rating string, query string, message_id string, reason string",
}
#: What a field is where it is missing (a null that is there stays).
DEFAULTS = {"citation": {"heading": "", "plain_text": "", "similarity": 0.0}, "document": {"pages": 0, "size_mb": 0.0, "chunks_count": 0, "status": "ready"}, "query_request": {"hops": 2, "top_k": 4, "mode": "fast"}}


#: The tables that a folder may have.
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def views(spark: SparkSession, folder: str, names: Sequence[str] = TABLES) -> dict[str, DataFrame]:
    """The tables of a folder by name, each also a temporary view of that name, so that SQL can be run on them."""
    found = {name: spark.read.parquet(f"{folder}/{name}.parquet") for name in names}
    for name, df in found.items():
        df.createOrReplaceTempView(name)
    return found


def json_rows(spark: SparkSession, path: str, entity: str) -> DataFrame:
    """Lines of JSON as an entity's columns with defaults; ``corrupt`` has a line that is no such object."""
    raw = spark.read.schema(f"{SCHEMAS[entity]}, corrupt string").json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="corrupt")
    return raw.fillna(DEFAULTS.get(entity, {}))


def stored_values(rows: DataFrame, schema: str) -> DataFrame:
    """Key, value (JSON text) as key and parsed array; what can't be parsed is an empty array."""
    empty = F.array().cast(f"array<{schema}>")
    return rows.select("key", F.coalesce(F.try_variant_get(F.try_parse_json("value"), "$", f"array<{schema}>"), empty).alias("items"))


def problems(request: DataFrame) -> DataFrame:
    """query requests with the list of what is wrong with them."""
    wrong = lambda c, name: F.when(F.coalesce(c, F.lit(False)), F.lit(name))
    checks = (wrong(F.coalesce(F.length("query"), F.lit(0)) == 0, "query"), wrong(~F.col("hops").between(1, 3), "hops"), wrong(~F.col("top_k").between(1, 10), "top_k"), wrong(~F.col("mode").isin("fast", "expert"), "mode"))
    return request.withColumn("problems", F.array_compact(F.array(*checks)))


def requested(requests: DataFrame) -> DataFrame:
    """P20: mode, hops and top_k of requests as sent: more than one hop is expert; defaults go by mode; one active document is the filter."""
    mode = F.coalesce("mode", F.when(F.col("hops") > 1, "expert").otherwise("fast"))
    one = F.when(F.size("active_docs") == 1, F.element_at("active_docs", 1))
    return requests.withColumn("mode", mode).withColumn("hops", F.coalesce("hops", F.when(F.col("mode") == "expert", 3).otherwise(1))).withColumn("top_k", F.coalesce("top_k", F.when(F.col("mode") == "expert", 8).otherwise(4))).withColumn("document_filter", F.coalesce("document_filter", one))


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """Files that may be uploaded: name, size, suffix and content."""
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.element_at(F.split(name, r"\."), -1))
    return spark.read.format("binaryFile").load(path).select(name.alias("name"), F.col("length").alias("bytes"), suffix.alias("suffix"), "content").where(suffix.isin(*UPLOAD_SUFFIXES))


def error_kind(status: Column, error: Column) -> Column:
    """What to tell a user: aborted before timeout before offline before schema before the status."""
    return (
        F.when(error == "AbortError", "aborted").when(error == "TimeoutError", "timeout").when((error == "TypeError") | (status == 0), "offline").when(error == "SchemaError", "schema")
        .when(status.isin(401, 403), "forbidden").when(status == 404, "missing").when(status == 429, "busy").when(status.isin(502, 503, 504), "unavailable").when(status >= 500, "server").otherwise("unknown")
    )


def kept_if_unavailable(new: DataFrame, old: DataFrame, key: str, status: str) -> DataFrame:
    """Rows of ``new``, but the old row where the new one's status is 503 or it is not there."""
    use = new.where(F.coalesce(F.col(status) != 503, F.lit(True)))
    return use.unionByName(old.join(use.select(key), key, "left_anti"))


def write_reports(reports: DataFrame, column: str, path: str) -> None:
    """One column of texts, as text files with a report in each line-terminated block."""
    reports.select(column).write.option("lineSep", "\n\n").text(path)


def write_rows(rows: DataFrame, path: str, kind: str = "parquet") -> None:
    """Rows as files of a format."""
    rows.write.format(kind).save(path)
