"""The document library: items, readiness, search, order, totals, and the lookups that attach documents to sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ravelin.functions import labels, text


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files: filename, id, size_mb, status."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", "n_chars")
    extension = F.element_at(F.array(*map(F.lit, ("pdf", "docx", "csv", "txt", "json", "md", "png", "bin"))), (F.col("doc_id") % 8 + 1).cast("int"))
    status = F.element_at(F.array(*map(F.lit, ("ready", "indexed", "processing", "error"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return d.select(
        "doc_id", F.concat(F.lit("Report_"), F.col("lang"), F.lit("-"), F.col("doc_id").cast("string"), F.lit("."), extension).alias("filename"),
        (F.col("n_chars") / 4096.0).alias("size_mb"), status.alias("status"), "source",
    )


_NAMED_SQL = """
n AS (SELECT doc_id, 'Report_' || lang || '-' || doc_id || '.' || (['pdf', 'docx', 'csv', 'txt', 'json', 'md', 'png', 'bin'])[doc_id % 8 + 1] AS filename,
  n_chars / 4096.0::DOUBLE AS size_mb, (['ready', 'indexed', 'processing', 'error'])[doc_id % 4 + 1] AS status, source FROM documents)"""

# The library's colours, by the sum of the characters of a name.
COLOURS = ("rose", "indigo", "emerald", "amber")


def item(df: DataFrame) -> DataFrame:
    """Filename, size_mb, status as a library item. No size counts as one megabyte, any status but processing, ready and indexed as ready."""
    size = F.floor(F.col("size_mb") * 1048576 + 0.5).cast("long")
    colour = F.element_at(F.array(*map(F.lit, COLOURS)), (labels.char_sum(F.col("filename")) % 4 + 1).cast("int"))
    return df.withColumns({
        "type": text.file_type(F.col("filename")),
        "colour": colour,
        "bytes": F.when(size > 0, size).otherwise(1048576),
        "library_status": F.when(F.col("status").isin("ready", "indexed"), "indexed").when(F.col("status") == "processing", "processing").otherwise("ready"),
    })


def library_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return item(_named(spark, sf_dir)).select("doc_id", "filename", "type", "colour", "bytes", "library_status")


_TYPE_SQL = """CASE regexp_extract(filename, '\\.([a-z]+)$', 1) WHEN 'pdf' THEN 'pdf' WHEN 'docx' THEN 'docx' WHEN 'csv' THEN 'csv'
  WHEN 'txt' THEN 'txt' WHEN 'json' THEN 'json' WHEN 'md' THEN 'md' WHEN 'png' THEN 'image' ELSE 'other' END"""

LIBRARY_ITEMS_SQL = f"""
WITH {_NAMED_SQL}
SELECT doc_id, filename, {_TYPE_SQL} AS type, (['rose', 'indigo', 'emerald', 'amber'])[
    CAST(list_sum(list_transform(string_split(filename, ''), lambda c: unicode(c))) AS BIGINT) % 4 + 1] AS colour,
  CASE WHEN floor(size_mb * 1048576 + 0.5) > 0 THEN CAST(floor(size_mb * 1048576 + 0.5) AS BIGINT) ELSE 1048576 END AS bytes,
  CASE WHEN status IN ('ready', 'indexed') THEN 'indexed' WHEN status = 'processing' THEN 'processing' ELSE 'ready' END AS library_status
FROM n"""


def named_like(column: Column, query: str, trimmed: bool) -> Column:
    """the name has the query in it, in any case; a blank one finds all where it is trimmed."""
    q = query.strip() if trimmed else query
    return F.lit(True) if trimmed and not q else F.contains(F.lower(column), F.lit(q.lower()))


def of_type(column: Column, wanted: str) -> Column:
    """other is all that is none of pdf, csv and docx."""
    if wanted == "all":
        return F.lit(True)
    return ~column.isin("pdf", "csv", "docx") if wanted == "other" else column == wanted


def ordered(by: str, position: str = "doc_id") -> list[Column]:
    """O2: the seven orders of the library; ties go by position."""
    orders = {
        "date-desc": [F.col("doc_id").desc()], "date-asc": [F.col("doc_id").asc()],
        "name-asc": [F.lower("filename").asc()], "name-desc": [F.lower("filename").desc()],
        "size-desc": [F.col("bytes").desc()], "size-asc": [F.col("bytes").asc()], "type": [F.col("type").asc(), F.lower("filename").asc()],
    }
    return [*orders[by], F.col(position).asc()]


def library_search_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each source, the first 20 of the items that a search finds, by type and name."""
    found = item(_named(spark, sf_dir)).where(named_like(F.col("filename"), " REPORT_E ", True) & of_type(F.col("type"), "other"))
    w = Window.partitionBy("source").orderBy(*ordered("type"))
    return found.withColumn("place", F.row_number().over(w)).where("place <= 20").select("source", "place", "filename", "type", "bytes")


LIBRARY_SEARCH_SORT_SQL = f"""
WITH {_NAMED_SQL}, i AS (SELECT *, {_TYPE_SQL} AS type, greatest(CAST(floor(size_mb * 1048576 + 0.5) AS BIGINT), 1) AS bytes FROM n),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY type, lower(filename), doc_id) AS place FROM i
  WHERE contains(lower(filename), 'report_e') AND type NOT IN ('pdf', 'csv', 'docx'))
SELECT source, place, filename, type, bytes FROM r WHERE place <= 20"""


def library_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes, counts and the providers' names of each library (a source here); no provider: None."""
    i = item(_named(spark, sf_dir))
    kinds = F.array_sort(F.collect_set(F.when(F.col("library_status") == "processing", F.col("type"))))
    return i.groupBy("source").agg(
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_bytes"), F.count("*").alias("n_items"),
        F.count_if(F.col("status") == "ready").alias("n_ready_page"), F.count_if(F.col("status").isin("ready", "indexed")).alias("n_ready_library"),
        F.count_if(F.col("filename").endswith(".pdf")).alias("n_pdf"),
        F.coalesce(F.nullif(F.array_join(kinds, ", "), F.lit("")), F.lit("None")).alias("processing_types"),
    )


LIBRARY_TOTALS_SQL = f"""
WITH {_NAMED_SQL}, i AS (SELECT *, {_TYPE_SQL} AS type, CASE WHEN floor(size_mb * 1048576 + 0.5) > 0 THEN CAST(floor(size_mb * 1048576 + 0.5) AS BIGINT) ELSE 1048576 END AS bytes FROM n)
SELECT source, CAST(sum(bytes) AS BIGINT) AS total_bytes, count(*) AS n_items, count(*) FILTER (status = 'ready') AS n_ready_page,
  count(*) FILTER (status IN ('ready', 'indexed')) AS n_ready_library, count(*) FILTER (filename LIKE '%.pdf') AS n_pdf,
  coalesce(string_agg(DISTINCT type, ', ' ORDER BY type) FILTER (status = 'processing'), 'None') AS processing_types
FROM i GROUP BY source"""


def is_ready(name: str, status: str, progress: str, in_set: str, any_in_set: str) -> Column:
    """unfinished and processing documents are not ready; where the set of ready names is not empty it decides alone."""
    return (
        F.when(F.col(progress) < 100, False).when(F.col(status) == "processing", False)
        .when(F.col(any_in_set), F.coalesce(F.col(in_set), F.lit(False))).otherwise(F.coalesce(F.col(status).isin("ready", "indexed"), F.lit(False)))
    )


def is_indexed(status: str, progress: str, in_set: str) -> Column:
    """F8: a name in the set is enough, but not needed."""
    return F.coalesce(F.col(in_set), F.lit(False)) | (F.coalesce(F.col(status).isin("ready", "indexed"), F.lit(False)) & ~F.coalesce(F.col(progress) < 100, F.lit(False)))


def readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags by the set of ready names, which comes from the documents of even source numbers."""
    n = _named(spark, sf_dir).withColumn("progress", F.when(F.col("doc_id") % 9 == 0, 60).otherwise(100)).withColumn("name", F.lower("filename"))
    ready = n.where(F.regexp_extract("source", r"(\d+)$", 1).try_cast("int") % 2 == 0).where("status = 'ready'").select("name").distinct().withColumn("in_set", F.lit(True))
    some = ready.agg((F.count("*") > 0).alias("any_in_set"))  # one row
    j = n.join(ready, "name", "left").withColumn("any_in_set", some.scalar())
    return j.select("doc_id", "filename", is_ready("name", "status", "progress", "in_set", "any_in_set").alias("ready"), is_indexed("status", "progress", "in_set").alias("indexed"))


READINESS_SQL = f"""
WITH {_NAMED_SQL}, p AS (SELECT *, CASE WHEN doc_id % 9 = 0 THEN 60 ELSE 100 END AS progress FROM n),
r AS (SELECT DISTINCT lower(filename) AS name FROM p WHERE TRY_CAST(regexp_extract(source, '(\\d+)$', 1) AS INT) % 2 = 0 AND status = 'ready')
SELECT doc_id, filename, CASE WHEN progress < 100 OR status = 'processing' THEN false WHEN (SELECT count(*) FROM r) > 0 THEN r.name IS NOT NULL
  ELSE status IN ('ready', 'indexed') END AS ready,
  r.name IS NOT NULL OR (status IN ('ready', 'indexed') AND progress >= 100) AS indexed
FROM p LEFT JOIN r ON lower(filename) = r.name"""


def harvested(mentions: DataFrame, known: DataFrame, library: DataFrame) -> DataFrame:
    """Names that sessions mention, each once at its first place, with the document they mean.

    A name is a known document by lower case, else a library item by lower-case filename, else by id; what is none
    of them is dropped. Three equi-joins stand for the disjunction.
    """
    once = mentions.groupBy("session", F.lower("name").alias("low")).agg(F.min("pos").alias("pos"), F.min_by("name", "pos").alias("name"))
    k = known.groupBy(F.lower("filename").alias("low")).agg(F.min("id").alias("known_id"))
    by_name = library.groupBy(F.lower("filename").alias("low")).agg(F.min("id").alias("name_id"))
    by_id = library.groupBy(F.col("id").cast("string").alias("name")).agg(F.min("id").alias("own_id"))
    j = once.join(k, "low", "left").join(by_name, "low", "left").join(by_id, "name", "left")
    return j.withColumn("id", F.coalesce("known_id", "name_id", "own_id")).where("id is not null").select("session", "pos", "name", "id")


def doc_harvest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U2, J3, V4 on documents (sessions are sources) whose labels make them known."""
    n = _named(spark, sf_dir)
    names = F.array(F.col("filename"), F.upper("filename"), F.col("doc_id").cast("string"), F.lit("Document"), F.concat(F.lit("missing-"), F.col("doc_id").cast("string")))
    mentions = n.select(F.col("source").alias("session"), "doc_id", F.posexplode(names).alias("i", "name")).where("name != 'Document'").withColumn("pos", F.col("doc_id") * 5 + F.col("i"))
    known = n.join(spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id"), "doc_id", "left_semi").select("filename", F.col("doc_id").alias("id"))
    library = n.where("doc_id % 2 = 0").select("filename", F.col("doc_id").alias("id"))
    return harvested(mentions, known, library)


DOC_HARVEST_SQL = f"""
WITH {_NAMED_SQL}, m AS (SELECT source AS session, doc_id * 5 + x.i AS pos, x.name AS name FROM (SELECT *, unnest([{{'i': 0, 'name': filename}}, {{'i': 1, 'name': upper(filename)}},
    {{'i': 2, 'name': CAST(doc_id AS VARCHAR)}}, {{'i': 4, 'name': 'missing-' || doc_id}}]) AS x FROM n)),
o AS (SELECT session, lower(name) AS low, min(pos) AS pos, arg_min(name, pos) AS name FROM m GROUP BY 1, 2),
k AS (SELECT lower(filename) AS low, min(doc_id) AS id FROM n WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY 1),
b AS (SELECT lower(filename) AS low, min(doc_id) AS id FROM n WHERE doc_id % 2 = 0 GROUP BY 1)
SELECT session, pos, name, coalesce(k.id, b.id, d.doc_id) AS id FROM o LEFT JOIN k USING (low) LEFT JOIN b USING (low)
  LEFT JOIN (SELECT doc_id FROM n WHERE doc_id % 2 = 0) d ON CAST(d.doc_id AS VARCHAR) = o.name
WHERE coalesce(k.id, b.id, d.doc_id) IS NOT NULL"""


def attached(names: DataFrame, library: DataFrame) -> DataFrame:
    """Attached names with their library item: the first, by position, whose filename equals the name in any case or whose id is the name; a name without one gets a placeholder."""
    by_name = library.groupBy(F.lower("filename").alias("low")).agg(F.min(F.struct("pos", "id")).alias("a"))
    by_id = library.groupBy(F.col("id").cast("string").alias("name")).agg(F.min(F.struct("pos", "id")).alias("b"))
    j = names.withColumn("low", F.lower("name")).join(by_name, "low", "left").join(by_id, "name", "left")
    best = F.least("a", "b")
    return j.select("session", "name", F.coalesce(best["id"].cast("string"), F.concat(F.lit("doc-"), F.col("name"))).alias("id"), best.isNotNull().alias("in_library"))


def attach_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _named(spark, sf_dir)
    names = n.select(F.col("source").alias("session"), F.when(F.col("doc_id") % 3 == 0, F.upper("filename")).when(F.col("doc_id") % 3 == 1, F.col("doc_id").cast("string")).otherwise(F.col("filename")).alias("name"))
    library = n.where("doc_id % 4 != 1").select("filename", F.col("doc_id").alias("id"), F.col("doc_id").alias("pos"))
    return attached(names, library)


ATTACH_LOOKUP_SQL = f"""
WITH {_NAMED_SQL}, a AS (SELECT source AS session, CASE doc_id % 3 WHEN 0 THEN upper(filename) WHEN 1 THEN CAST(doc_id AS VARCHAR) ELSE filename END AS name FROM n),
l AS (SELECT * FROM n WHERE doc_id % 4 <> 1)
SELECT session, name, coalesce(CAST(least(x.doc_id, y.doc_id) AS VARCHAR), 'doc-' || name) AS id, coalesce(x.doc_id, y.doc_id) IS NOT NULL AS in_library
FROM a LEFT JOIN l x ON lower(x.filename) = lower(name) LEFT JOIN l y ON CAST(y.doc_id AS VARCHAR) = name"""


def new_upload(df: DataFrame) -> DataFrame:
    """Name and bytes of an upload, with its first guess of pages and chunks."""
    pdf = F.lower(F.element_at(F.split("name", r"\."), -1)) == "pdf"
    guess = lambda per: F.greatest(F.lit(1), F.floor(F.col("bytes") / per + 0.5))
    return df.withColumn("pages", F.when(pdf, guess(100_000)).otherwise(1)).withColumn("chunks", guess(50_000))


def deletable(df: DataFrame) -> DataFrame:
    """is_protected and can_delete from the flags that are there."""
    guard = F.coalesce(F.col("is_protected"), (F.col("can_delete") == F.lit(False)) | (F.col("deletable") == F.lit(False)) | (F.col("owner") == "system"), F.lit(False))
    return df.withColumn("protected", guard).withColumn("deletable_now", F.coalesce(F.col("can_delete"), F.col("deletable"), ~guard))
