"""Citations: pages, normalised records, and the join of markers in an answer with its citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.functions.text import deduplicated_markers, trim, truthy

# How pages are named in chunk ids, headings and strings, in the order in which the patterns are tried.
CHUNK_PAGES = (r"(?i)(?:_parent_|parent_?)0*(\d+)", r"(?i)(?:_p|p)0*(\d+)(?:[_\D]|$)", r"(?i)page[_-]?0*(\d+)")
HEADING_PAGES = (r"\|\s*0*(\d+)\s*$", r"^\s*0*(\d+)\s*\|", r"(?i)(?:page|p\.?)\s*0*(\d+)")
STRING_PAGES = (r"(?i)(?:page|p\.?)[=:\s]*(\d+)", r"(?i)#page=(\d+)", r"\|\s*0*(\d+)\s*$", r"^\s*0*(\d+)\s*\|")
FILE_ALIASES = ("pdf_filename", "filename", "file_name", "document_name", "doc_name", "source")
PAGE_ALIASES = ("primary_page", "page", "page_number", "physical_page", "page_no")
PLACEHOLDER = "Audited Document"


def _first_number(value: Column, patterns: tuple[str, ...]) -> Column:
    """The number of the first pattern that is found, if it is positive."""
    found = F.coalesce(*(F.nullif(F.regexp_extract(value, p, 1), F.lit("")) for p in patterns))
    n = found.try_cast("int")
    return F.when(n > 0, n)


def string_page(value: Column) -> Column:
    """P2 for a citation that is a string."""
    return _first_number(value, STRING_PAGES)


def first_positive(fields: list[Column]) -> Column:
    """The first positive number that one of the fields begins with."""
    numbers = [F.nullif(F.regexp_extract(c.cast("string"), r"^\s*([+-]?\d+)", 1), F.lit("")).try_cast("int") for c in fields]
    return F.coalesce(*(F.when(n > 0, n) for n in numbers))


def preferred(*pages: Column) -> Column:
    """The first page above 1, else the first."""
    return F.coalesce(*(F.when(x > 1, x) for x in pages), *pages)


def page(chunk_id: Column, heading: Column, explicit: list[Column]) -> Column:
    """Pages above 1 of the chunk's id, of the heading, of the fields; then pages of 1 in the same order; else null."""
    return preferred(_first_number(chunk_id, CHUNK_PAGES), _first_number(heading, HEADING_PAGES), first_positive(explicit))


def page_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P2 on ids, headings and fields made from the keys of lineitem."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    k = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    n = (k % 120).cast("string")
    chunk = F.element_at(F.array(F.concat(F.lit("doc_parent_00"), n), F.concat(F.lit("_p0"), n, F.lit("_c1")), F.concat(F.lit("page-"), n), F.lit("chunk"), F.lit("parent_1")), (k % 5 + 1).cast("int"))
    heading = F.element_at(F.array(F.concat(F.lit("Annual Report | "), n), F.concat(n, F.lit(" | Annual")), F.concat(F.lit("Section (Page "), n, F.lit(")")), F.lit("")), (k % 4 + 1).cast("int"))
    field = F.when(k % 3 == 0, (k % 7).cast("string")).when(k % 3 == 1, F.lit("x"))
    rows = li.select("l_orderkey", "l_linenumber", chunk.alias("chunk_id"), heading.alias("heading"), field.alias("field")).distinct()
    return rows.withColumn("page", page(F.col("chunk_id"), F.col("heading"), [F.col("field")]))


PAGE_EXTRACT_SQL = r"""
WITH k AS (SELECT DISTINCT l_orderkey, l_linenumber, l_orderkey * 10 + l_linenumber AS k FROM lineitem),
r AS (SELECT l_orderkey, l_linenumber, (['doc_parent_00' || k % 120, '_p0' || k % 120 || '_c1', 'page-' || k % 120, 'chunk', 'parent_1'])[k % 5 + 1] AS chunk_id,
  (['Annual Report | ' || k % 120, k % 120 || ' | Annual', 'Section (Page ' || k % 120 || ')', ''])[k % 4 + 1] AS heading,
  CASE k % 3 WHEN 0 THEN CAST(k % 7 AS VARCHAR) WHEN 1 THEN 'x' END AS field FROM k),
p AS (SELECT *, nullif(TRY_CAST(coalesce(nullif(regexp_extract(chunk_id, '(?i)(?:_parent_|parent_?)0*(\d+)', 1), ''), nullif(regexp_extract(chunk_id, '(?i)(?:_p|p)0*(\d+)(?:[_\D]|$)', 1), ''), nullif(regexp_extract(chunk_id, '(?i)page[_-]?0*(\d+)', 1), '')) AS INT), 0) AS c,
  nullif(TRY_CAST(coalesce(nullif(regexp_extract(heading, '\|\s*0*(\d+)\s*$', 1), ''), nullif(regexp_extract(heading, '^\s*0*(\d+)\s*\|', 1), ''), nullif(regexp_extract(heading, '(?i)(?:page|p\.?)\s*0*(\d+)', 1), '')) AS INT), 0) AS h,
  nullif(TRY_CAST(field AS INT), 0) AS f FROM r)
SELECT l_orderkey, l_linenumber, chunk_id, heading, field, coalesce(CASE WHEN c > 1 THEN c END, CASE WHEN h > 1 THEN h END, CASE WHEN f > 1 THEN f END, c, h, f) AS page FROM p"""


def normalized(raw: DataFrame, default_name: str | None = None) -> DataFrame:
    """Citations of any shape, as columns (raw_kind, raw_text, the aliases, metadata map, position), in one shape.

    raw_kind is null, string or object; the first truthy alias counts, the record's before those in metadata. A
    missing page stays null.
    """
    has = set(raw.columns)
    own = lambda *names: [F.col(n).cast("string") for n in names if n in has]
    meta = lambda *names: [F.col("metadata")[n] for n in names] if "metadata" in has else []
    last = F.lit(default_name or PLACEHOLDER)
    first = lambda *c: truthy(*c, F.lit(None).cast("string"))
    kind = F.coalesce("raw_kind", F.lit("null"))
    positive = lambda n: F.when(F.col(n) > 0, F.col(n)) if n in has else F.lit(None).cast("int")
    index = F.when(kind == "object", F.coalesce(positive("citation_index"), positive("index"))).otherwise(F.lit(None))
    index = F.coalesce(index, F.col("position"))
    shown = trim(F.regexp_replace(F.regexp_replace(trim(F.col("raw_text")), r"^(.*?)\s*\(.*?\)", "$1"), r"^(.*?)#page=\d+", "$1"))
    name = F.when(kind == "object", trim(F.coalesce(first(*own(*FILE_ALIASES), *meta(*FILE_ALIASES)), last))).when(kind == "string", F.coalesce(first(shown), last)).otherwise(last)
    chunk = first(*own("chunk_id", "id"), *meta("chunk_id"))
    fields = [*own(*PAGE_ALIASES), *meta(*PAGE_ALIASES)] or [F.lit(None).cast("string")]
    # in steps, each a projection of its own: one expression for all would be too long to be compiled
    raw = raw.withColumns({
        "_chunk": F.coalesce(first(*own("chunk_id", "id"), *meta("chunk_id", "id")), F.lit("")), "_heading": F.coalesce(first(*own("heading", "title"), *meta("heading", "title")), F.lit("")),
        "_field": first_positive(fields), "_index": index, "_name": name,
    })
    raw = raw.withColumns({"_chunk": _first_number(F.col("_chunk"), CHUNK_PAGES), "_heading": _first_number(F.col("_heading"), HEADING_PAGES), "_string": string_page(trim(F.col("raw_text")))})
    object_page, index, name = preferred(F.col("_chunk"), F.col("_heading"), F.col("_field")), F.col("_index"), F.col("_name")
    only = lambda c: F.when(kind == "object", F.coalesce(c, F.lit(""))).otherwise("")
    similarity = F.col("similarity") if "similarity" in has else F.lit(None).cast("double")
    keys = [c for c in raw.columns if c in ("answer_id", "position")]
    return raw.select(
        *keys, index.cast("int").alias("out_index"),
        F.when(kind == "object", F.coalesce(chunk, F.concat(F.lit("chk-"), index.cast("string")))).otherwise(F.concat(F.lit("cit-"), F.col("position").cast("string"))).alias("out_chunk"),
        F.when(kind == "object", F.coalesce(first(*own("document_id", "doc_id"), *meta("doc_id")), name)).otherwise(name).alias("out_document"),
        name.alias("out_file"), F.when(kind == "object", object_page).when(kind == "string", F.col("_string")).alias("out_page"),
        only(first(*own("heading"), *meta("heading"), *own("title"))).alias("out_heading"), only(first(*own("plain_text", "text", "content", "snippet"))).alias("out_text"),
        F.when(kind == "object", F.coalesce(similarity, F.lit(0.9))).when(kind == "string", 0.95).otherwise(0.9).alias("out_similarity"),
    )


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of all shapes from documents: answer_id is the source, position the place in it."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    k = F.col("doc_id")
    kind = F.element_at(F.array(F.lit("object"), F.lit("string"), F.lit(None).cast("string"), F.lit("object")), (k % 4 + 1).cast("int"))
    obj = kind == "object"
    return d.select(
        k.alias("answer_id"), ((k % 9) + 1).cast("int").alias("position"), kind.alias("raw_kind"),
        F.when(kind == "string", F.concat(F.lit(" File "), k.cast("string"), F.lit(".pdf (Page "), (k % 30).cast("string"), F.lit(") "))).alias("raw_text"),
        F.when(obj & (k % 3 == 0), (k % 5).cast("int")).alias("citation_index"), F.when(obj & (k % 3 == 1), (k % 7).cast("int")).alias("index"),
        F.when(obj & (k % 5 > 0), F.concat(F.lit("doc_p0"), (k % 40).cast("string"), F.lit("_c"))).alias("chunk_id"),
        F.when(k % 2 == 0, "").alias("pdf_filename"), F.when(k % 8 > 3, F.concat(F.lit(" f"), k.cast("string"), F.lit(".pdf "))).alias("filename"),
        F.when(k % 16 == 0, (k % 12).cast("string")).alias("page"), F.when(k % 6 == 0, "").otherwise(F.col("text")).alias("plain_text"), F.concat("source", F.lit(" "), "text").alias("snippet"),
        F.when(k % 10 > 0, (k % 100) / 100).alias("similarity"), F.create_map(F.lit("source"), F.concat(F.lit("meta-"), F.col("source"))).alias("metadata"),
    )


def citation_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1, P2, P11 on citations of all shapes."""
    return normalized(_raw(spark, sf_dir))


#: The raw citations as the generator makes them; name, page, index and the rest are read from their fields.
CITATION_NORMALIZE_SQL = r"""
WITH r AS (SELECT doc_id AS k, CAST(doc_id % 9 + 1 AS INT) AS position, (['object', 'string', NULL, 'object'])[doc_id % 4 + 1] AS kind, source, text FROM documents),
w AS (SELECT k, position, kind, CASE WHEN kind = 'string' THEN ' File ' || k || '.pdf (Page ' || k % 30 || ') ' END AS raw, CASE WHEN kind = 'object' AND k % 3 = 0 THEN k % 5 END AS citation_index, CASE WHEN kind = 'object' AND k % 3 = 1 THEN k % 7 END AS index,
  CASE WHEN kind = 'object' AND k % 5 > 0 THEN 'doc_p0' || k % 40 || '_c' END AS chunk_id, CASE WHEN k % 2 = 0 THEN '' END AS pdf_filename, CASE WHEN k % 8 > 3 THEN ' f' || k || '.pdf ' END AS filename, CASE WHEN k % 16 = 0 THEN CAST(k % 12 AS VARCHAR) END AS page,
  CASE WHEN k % 6 = 0 THEN '' ELSE text END AS plain_text, source || ' ' || text AS snippet, CASE WHEN k % 10 > 0 THEN (k % 100) / 100.0::DOUBLE END AS similarity, 'meta-' || source AS meta FROM r),
n AS (SELECT *, coalesce(kind = 'object', false) AS obj, list_filter([citation_index, index, position], lambda x: x > 0)[1] AS own_index,
  list_filter([trim(pdf_filename), trim(filename), trim(meta)], lambda x: x <> '')[1] AS own_name, try_cast(split_part(split_part(chunk_id, '_p', 2), '_', 1) AS INT) AS chunk_page, try_cast(page AS INT) AS field_page,
  split_part(trim(raw), ' (', 1) AS said_name, try_cast(split_part(split_part(raw, '(Page ', 2), ')', 1) AS INT) AS said_page FROM w),
p AS (SELECT *, list_filter([chunk_page, field_page], lambda x: x > 0) AS pages, CASE WHEN obj THEN own_index ELSE position END AS idx, CASE WHEN obj THEN own_name WHEN kind = 'string' THEN said_name ELSE 'Audited Document' END AS name FROM n)
SELECT k AS answer_id, position, CAST(idx AS INT) AS out_index, CASE WHEN NOT obj THEN 'cit-' || position ELSE coalesce(chunk_id, 'chk-' || idx) END AS out_chunk, name AS out_document, name AS out_file,
  CAST(CASE WHEN obj THEN coalesce(list_filter(pages, lambda x: x > 1)[1], pages[1]) WHEN kind = 'string' AND said_page > 0 THEN said_page END AS INT) AS out_page, '' AS out_heading,
  CASE WHEN NOT obj THEN '' WHEN plain_text <> '' THEN plain_text ELSE snippet END AS out_text, CASE WHEN obj THEN coalesce(similarity, 0.9::DOUBLE) WHEN kind = 'string' THEN 0.95::DOUBLE ELSE 0.9::DOUBLE END AS out_similarity FROM p"""


def markers(answers: DataFrame) -> DataFrame:
    """V1 without the text between: answer_id, place, citation_index of every index in every bracket of ``text``."""
    brackets = F.regexp_extract_all(F.col("text"), F.lit(r"\[(\d+(?:\s*,\s*\d+)*)\]"), F.lit(1))
    numbers = F.flatten(F.transform(brackets, lambda b: F.transform(F.split(b, ","), lambda n: trim(n).try_cast("int"))))
    return answers.select("answer_id", F.posexplode(numbers).alias("place", "citation_index"))


def matched(marks: DataFrame, citations: DataFrame) -> DataFrame:
    """Every marker with its citation: the last with its index, else the one at that place in the list, else none.

    ``citations``: answer_id, position (from 1), citation_index, file.
    """
    by_index = citations.groupBy("answer_id", "citation_index").agg(F.max_by("file", "position").alias("by_index"))
    by_place = citations.select("answer_id", F.col("position").alias("citation_index"), F.col("file").alias("by_place"))
    j = marks.join(by_index, ["answer_id", "citation_index"], "left").join(by_place, ["answer_id", "citation_index"], "left")
    return j.select("answer_id", "place", "citation_index", F.coalesce("by_index", "by_place").alias("file"))


def marker_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1 on answers with markers added; the four citations of each have indices that repeat and skip."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("answer_id"), "text")
    k = F.col("answer_id")
    n = lambda m: (k % m + 1).cast("string")
    words = F.transform(F.split("text", " ", -1), lambda w, i: F.when(i % 31 == 7, F.concat(w, F.lit(" ["), (i % 9).cast("string"), F.lit(" , "), (i % 4 + 1).cast("string"), F.lit("]"))).otherwise(w))
    answers = d.select("answer_id", F.concat(F.array_join(words, " "), F.lit(" ["), n(5), F.lit("] and ["), n(3), F.lit(", "), n(7), F.lit("]. [x] [1,] []")).alias("text"))
    cites = d.select("answer_id", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("position"))
    cites = cites.withColumn("citation_index", (F.when(F.col("position") == 4, 1).otherwise(F.col("position") * 2 - 1 + k % 2)).cast("int")).withColumn("file", F.concat(F.lit("f"), F.col("position").cast("string"), F.lit(".pdf")))
    return matched(markers(answers), cites)


#: Markers are found by cutting the answers at their brackets.
MARKER_JOIN_SQL = """
WITH t AS (SELECT doc_id AS answer_id, array_to_string(list_transform(string_split(text, ' '), lambda w, i: CASE WHEN (i - 1) % 31 = 7 THEN w || ' [' || (i - 1) % 9 || ' , ' || (i - 1) % 4 + 1 || ']' ELSE w END), ' ')
    || ' [' || doc_id % 5 + 1 || '] and [' || doc_id % 3 + 1 || ', ' || doc_id % 7 + 1 || ']. [x] [1,] []' AS text FROM documents),
b AS (SELECT answer_id, list_filter(list_transform(string_split(text, '[')[2:], lambda x: CASE WHEN contains(x, ']') THEN list_transform(string_split(split_part(x, ']', 1), ','), lambda n: try_cast(trim(n) AS INT)) END),
    lambda ns: ns IS NOT NULL AND len(list_filter(ns, lambda n: n IS NULL)) = 0) AS marks FROM t),
m AS (SELECT answer_id, unnest(list_transform(flatten(marks), lambda n, i: {'p': i - 1, 'i': n})) AS x FROM b),
c AS (SELECT doc_id AS answer_id, p AS position, CASE WHEN p = 4 THEN 1 ELSE p * 2 - 1 + doc_id % 2 END AS citation_index, 'f' || p || '.pdf' AS file FROM documents, range(1, 5) AS t(p)),
l AS (SELECT answer_id, citation_index, arg_max(file, position) AS file FROM c GROUP BY 1, 2)
SELECT m.answer_id, CAST(x.p AS INT) AS place, CAST(x.i AS INT) AS citation_index, coalesce(l.file, c.file) AS file
FROM m LEFT JOIN l ON l.answer_id = m.answer_id AND l.citation_index = x.i LEFT JOIN c ON c.answer_id = m.answer_id AND c.position = x.i"""


def citation_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2 on whole texts with markers of all kinds between their words."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    k = F.col("doc_id")

    def marked(word: Column, i: Column) -> Column:
        n, m = ((i + k) % 9 + 1).cast("string"), (i % 2 + 1).cast("string")
        one = F.concat(F.lit("["), n, F.lit("]"))
        shapes = F.array(
            F.concat(one, F.lit(" "), one), F.concat(one, one, one), F.concat(one, F.lit(" ,\t"), one), F.concat(one, F.lit("; "), one, F.lit(" ; "), one), F.concat(F.lit("["), n, F.lit(", 2,  "), m, F.lit(",2]")),
            F.concat(F.lit(" .  "), one), F.concat(one, F.lit(" [77] "), one), F.concat(F.lit("["), n, F.lit(",5] ["), n, F.lit(", 5]")), F.concat(F.lit(" ! [x] ["), n), F.concat(F.lit("[0"), n, F.lit("] "), one),
        )
        return F.when(i % 7 == 3, F.concat(word, F.lit(" "), F.element_at(shapes, ((i + k) % 10 + 1).cast("int")))).otherwise(word)

    words = F.transform(F.split(F.translate("text", "[]", ""), " ", -1), marked)
    return d.select("doc_id", deduplicated_markers(F.array_join(words, " ")).alias("clean"))


#: Brackets and what follows each as rows; a bracket goes if it is the one before it again, with what is between them.
CITATION_DEDUP_SQL = r"""
WITH t AS (SELECT doc_id, array_to_string(list_transform(string_split(translate(text, '[]', ''), ' '), lambda w, i: CASE WHEN (i - 1) % 7 <> 3 THEN w ELSE w || ' ' || (CASE (i - 1 + doc_id) % 10
    WHEN 0 THEN '[N] [N]' WHEN 1 THEN '[N][N][N]' WHEN 2 THEN '[N] ,' || chr(9) || '[N]' WHEN 3 THEN '[N]; [N] ; [N]' WHEN 4 THEN '[N, 2,  ' || (i - 1) % 2 + 1 || ',2]' WHEN 5 THEN ' .  [N]' WHEN 6 THEN '[N] [77] [N]'
    WHEN 7 THEN '[N,5] [N, 5]' WHEN 8 THEN ' ! [x] [N' ELSE '[0N] [N]' END).replace('N', CAST((i - 1 + doc_id) % 9 + 1 AS VARCHAR)) END), ' ') AS t FROM documents),
p AS (SELECT doc_id, unnest(string_split(t, '[')) AS x, generate_subscripts(string_split(t, '['), 1) AS i FROM t),
q AS (SELECT *, i > 1 AND contains(x, ']') AS closed, CASE WHEN i > 1 AND contains(x, ']') THEN split_part(x, ']', 1) END AS inside, CASE WHEN i > 1 AND contains(x, ']') THEN substr(x, strpos(x, ']') + 1) ELSE x END AS rest FROM p),
r AS (SELECT *, list_transform(string_split(inside, ','), lambda n: try_cast(trim(n) AS INT)) AS numbers FROM q),
s AS (SELECT *, CASE WHEN list_contains(list_transform(numbers, lambda n: n IS NULL), true) THEN NULL WHEN contains(inside, ',') THEN array_to_string(list_transform(list_sort(list_transform(list_distinct(numbers), lambda n: {'at': list_position(numbers, n), 'n': n})), lambda u: u.n), ', ') ELSE inside END AS mark FROM r),
u AS (SELECT *, coalesce(mark = lag(mark) OVER w AND (translate(lag(rest) OVER w, ' ' || chr(9), '') IN ('', ',') OR trim(lag(rest) OVER w, ' ' || chr(9)) = ';' AND starts_with(lag(rest) OVER w, ';')), false) AS again FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
v AS (SELECT doc_id, i, CASE WHEN again OR i = 1 THEN '' WHEN closed THEN '[' || coalesce(mark, inside) || ']' ELSE '[' END || CASE WHEN coalesce(lead(again) OVER (PARTITION BY doc_id ORDER BY i), false) THEN '' ELSE rest END AS piece FROM u),
x AS (SELECT doc_id, string_split(string_agg(piece, '' ORDER BY i), '[') AS x FROM v GROUP BY doc_id)
SELECT doc_id, array_to_string(list_transform(x, lambda y, i: CASE WHEN i < len(x) AND list_contains(['.', ',', ';', ':', '!', '?'], right(rtrim(y), 1)) THEN rtrim(left(rtrim(y), length(rtrim(y)) - 1)) || right(rtrim(y), 1) || substr(y, length(rtrim(y)) + 1) ELSE y END), '[') AS clean FROM x"""


def chunk_fallback(responses: DataFrame) -> DataFrame:
    """Responses (citations, top_chunks, texts) whose empty citation list is filled from the chunks that were found."""
    made = F.transform("top_chunks", lambda c, i: F.struct((i + 1).alias("citation_index"), c["chunk_id"].alias("chunk_id"), c["text"].alias("plain_text"), F.coalesce(c["similarity"], F.lit(0.9)).alias("similarity")))
    return responses.withColumn("citations", F.when(F.size("citations") > 0, F.col("citations")).otherwise(made))
