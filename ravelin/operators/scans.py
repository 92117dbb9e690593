"""Scans of JSON lines that were written from the given tables, some of them broken."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.sources import jsonlines
from ravelin.sources.tables import shared_dir


def _document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as JSON lines of entity document; some cut, some no object, some with a value of another type, some with fields missing or null."""
    k = F.col("doc_id")
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    s = k.cast("string")
    size = F.when(k % 7 == 0, F.lit('"many"')).when(k % 7 == 1, F.lit("null")).when(k % 7 == 2, F.lit("3.5")).otherwise(F.col("n_chars").cast("string"))
    body = F.concat(F.lit('{"id": "'), s, F.lit('", "filename": '), F.to_json(F.struct(F.substring("text", 1, 40).alias("f")), {"ignoreNullFields": "false"}), F.lit(', "name": "'), F.col("source"), F.lit('"'))
    body = F.concat(body, F.when(k % 5 == 0, F.lit("")).otherwise(F.concat(F.lit(', "pages": '), size)), F.when(k % 3 == 0, F.lit("")).otherwise(F.concat(F.lit(', "size_mb": '), (k % 100 / 10).cast("string"))))
    line = F.when(k % 13 == 4, F.concat(body, F.lit(', "status": '))).when(k % 17 == 5, F.concat(F.lit("["), s, F.lit("]"))).otherwise(F.concat(body, F.lit("}")))
    return d.select(F.regexp_replace(line, r'"filename": \{"f":(.*?)\}, "name"', '"filename": $1, "name"').alias("line"))


def scanned_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines, written to files and read back, as documents and error rows."""
    path = f"{shared_dir(spark)}/ravelin-lines-{uuid.uuid4().hex}"
    _document_lines(spark, sf_dir).write.text(path)
    rows = jsonlines.checked(jsonlines.lines(spark, path), "document", required=("id",))
    broken = F.when(F.col("error").isNotNull(), F.length("line"))
    return rows.select("id", F.col("filename"), F.col("name"), "pages", "size_mb", "status", "error", broken.alias("broken_length"))


SCANNED_DOCUMENTS_SQL = r"""
WITH b AS (SELECT doc_id AS k, '{"id": "' || doc_id || '", "filename": ' || to_json(substr(text, 1, 40)) || ', "name": "' || source || '"' || CASE WHEN doc_id % 5 = 0 THEN '' ELSE ', "pages": ' || CASE doc_id % 7 WHEN 0 THEN '"many"' WHEN 1 THEN 'null' WHEN 2 THEN '3.5' ELSE CAST(n_chars AS VARCHAR) END END
    || CASE WHEN doc_id % 3 = 0 THEN '' ELSE ', "size_mb": ' || CAST(doc_id % 100 / 10 AS VARCHAR) END AS body FROM documents),
l AS (SELECT k, CASE WHEN k % 13 = 4 THEN body || ', "status": ' WHEN k % 17 = 5 THEN '[' || k || ']' ELSE body || '}' END AS line FROM b),
j AS (SELECT line, CASE WHEN json_valid(line) THEN CAST(line AS JSON) END AS o FROM l),
e AS (SELECT *, CASE WHEN o IS NULL THEN 'malformed' WHEN json_type(o) <> 'OBJECT' THEN 'not an object' WHEN json_type(o, '$.pages') NOT IN ('UBIGINT', 'BIGINT', 'NULL') THEN 'type pages' END AS error FROM j)
SELECT CASE WHEN error IS NULL THEN o->>'$.id' END AS id, CASE WHEN error IS NULL THEN o->>'$.filename' END AS filename, CASE WHEN error IS NULL THEN o->>'$.name' END AS name,
  CASE WHEN error IS NULL THEN CASE WHEN json_exists(o, '$.pages') THEN CAST(o->>'$.pages' AS INT) ELSE 0 END END AS pages, CASE WHEN error IS NULL THEN CASE WHEN json_exists(o, '$.size_mb') THEN CAST(o->>'$.size_mb' AS DOUBLE) ELSE 0.0 END END AS size_mb,
  CASE WHEN error IS NULL THEN 'ready' END AS status, error, CASE WHEN error IS NOT NULL THEN length(line) END AS broken_length FROM e"""
