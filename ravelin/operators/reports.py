"""Reports on answers: Markdown, developer JSON, HTML and PDF, a row for each answer, and their writers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.functions.text import html_escaped, inline_html
from ravelin.operators.batches import in_pieces

# Fixed values of the PDF's layout: the page in points, lines on a page, columns of a line.
WIDTH, HEIGHT, MARGIN, LEADING = 612, 792, 54, 14
LINES, COLUMNS = 46, 88


def _optional(condition: Column, *lines: Column) -> Column:
    return F.when(condition, F.array(*lines)).otherwise(F.array().cast("array<string>"))


def _lines(answers: DataFrame, title: str) -> Column:
    """K8: ``answers``: answer_id, query, text, decision, score, seconds, route, citations (array of struct citation_index, file, page, text, chunk_id, similarity), claims (array of struct claim_id, text, supported, status), entities (array of string), n_edges."""
    lit, blank, rule = F.lit, F.lit(""), F.lit("---")
    code = lambda c: F.concat(lit("`"), c, lit("`"))
    bar = F.concat(
        lit("**Quality Gate:** "), code(F.upper(F.coalesce("decision", lit("accept")))), lit(" | **Traceability Score:** "), code(F.coalesce(F.format_number("score", 2), lit("1.00"))),
        lit(" | **Latency:** "), code(F.coalesce(F.concat(F.format_number("seconds", 2), lit("s")), lit("N/A"))),
    )
    cite = lambda c: F.array_join(
        F.array(
            F.concat(lit("### ["), c["citation_index"].cast("string"), lit("] "), F.coalesce(F.nullif(c["file"], blank), lit("Document")), lit(" ("), F.coalesce(F.concat(lit("Page "), c["page"].cast("string")), lit("Page N/A")), lit(")")),
            F.when(F.coalesce(c["text"], blank) != "", F.concat(lit('> "'), F.trim(c["text"]), lit('"'))),
            F.concat(lit("- *Chunk ID:* "), code(F.coalesce(F.nullif(c["chunk_id"], blank), lit("chunk-ref"))), F.coalesce(F.concat(lit(" | *Relevance Similarity:* "), code(F.format_number(c["similarity"], 3))), blank)),
            blank,
        ), "\n",
    )
    claim = lambda c: F.concat(F.when(c["supported"], lit("- [x] **")).otherwise("- [ ] **"), c["claim_id"], lit(":** "), c["text"], F.when(c["status"] != "SUPPORTED", F.concat(lit("\n  - *Status:* "), code(c["status"]))).otherwise(""))
    names = F.array_join(F.transform(F.slice("entities", 1, 15), code), ", ")
    section = lambda some, head, *body: F.when(some, F.concat(F.array(rule, blank, lit(head), blank), *body)).otherwise(F.array().cast("array<string>"))
    return F.concat(
        F.array(lit(f"# {title}"), blank, bar), _optional(F.col("route").isNotNull(), F.concat(lit("**Routing Strategy:** "), code(F.col("route")))),
        F.array(blank, rule, blank, lit("## Research Inquiry"), blank, F.concat(lit("> "), F.coalesce(F.nullif("query", blank), lit("General Query"))), blank, rule, blank, lit("## Grounded Synthesis & Findings"), blank, F.trim("text"), blank),
        section(F.size("citations") > 0, "## References & Grounded Citations", F.transform("citations", cite)),
        section(F.size("claims") > 0, "## Verified Claims & Fact Checks", F.transform("claims", claim), F.array(blank)),
        section(F.size("entities") > 0, "## Subgraph Entity Context", F.array(
            F.concat(lit("Identified **"), F.size("entities").cast("string"), lit(" entities** and **"), F.coalesce("n_edges", lit(0)).cast("string"), lit(" relationships** in the knowledge graph traversal.")),
            F.concat(lit("- Key Entities: "), names, F.when(F.size("entities") > 15, ", ...").otherwise("")), blank)),
        F.array(rule),
    )


def markdown(answers: DataFrame, title: str = "Research Report") -> DataFrame:
    """answer_id, report."""
    return answers.select("answer_id", F.array_join(_lines(answers, title), "\n").alias("report"))


def developer_json(answers: DataFrame, exported_at: str) -> DataFrame:
    """K9: answer_id and one JSON object with every field there, null or default where the answer has none."""
    body = F.struct(
        F.lit("1.0.0").alias("export_version"), F.lit(exported_at).alias("exported_at"), F.coalesce("query", F.lit("")).alias("query"), F.col("text").alias("grounded_answer"),
        F.struct(F.col("score").alias("traceability_score"), F.coalesce("decision", F.lit("accept")).alias("quality_gate_decision"), F.col("seconds").alias("execution_time_seconds"), F.col("route").alias("routing_strategy")).alias("metadata"),
        F.coalesce("citations", F.array().cast(answers.schema["citations"].dataType)).alias("citations"), F.coalesce("claims", F.array().cast(answers.schema["claims"].dataType)).alias("verified_claims"),
    )
    return answers.select("answer_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))


def html(answers: DataFrame, title: str = "Research Report") -> DataFrame:
    """answer_id and a page with the answer and its references."""
    cite = lambda c: F.concat(F.lit("<li value=\""), c["citation_index"].cast("string"), F.lit("\">"), html_escaped(F.coalesce(c["file"], F.lit("Document"))), F.coalesce(F.concat(F.lit(", page "), c["page"].cast("string")), F.lit("")), F.lit("</li>"))
    paragraphs = F.array_join(F.transform(F.split("text", r"\n{2,}"), lambda p: F.concat(F.lit("<p>"), inline_html(p), F.lit("</p>"))), "\n")
    page = F.concat(F.lit(f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{title}</title></head><body><h1>'), html_escaped(F.coalesce("query", F.lit(""))), F.lit("</h1>"), paragraphs, F.lit("<ol>"), F.array_join(F.transform("citations", cite), ""), F.lit("</ol></body></html>"))
    return answers.select("answer_id", page.alias("html"))


def pdf_bytes(lines: list[str]) -> bytes:
    """A PDF 1.4 file of lines that are escaped already: pages of ``LINES`` lines, each with its number, and the offsets of all objects."""
    pages = [lines[i : i + LINES] for i in range(0, max(len(lines), 1), LINES)]
    objects = ["<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{' '.join(f'{4 + 2 * i} 0 R' for i in range(len(pages)))}] /Count {len(pages)} >>", "<< /Type /Font /Subtype /Type1 /BaseFont /Courier >>"]
    for i, page in enumerate(pages):
        shown = "\n".join(f"({x}) Tj T*" for x in page)
        body = f"BT /F1 10 Tf {LEADING} TL {MARGIN} {HEIGHT - MARGIN} Td\n{shown}\nET\nBT /F1 8 Tf {MARGIN} {MARGIN // 2} Td (Page {i + 1} of {len(pages)}) Tj ET"
        objects += [f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {WIDTH} {HEIGHT}] /Resources << /Font << /F1 3 0 R >> >> /Contents {5 + 2 * i} 0 R >>", f"<< /Length {len(body)} >>\nstream\n{body}\nendstream"]
    out, offsets = b"%PDF-1.4\n", []
    for n, x in enumerate(objects, 1):
        offsets.append(len(out))
        out += f"{n} 0 obj\n{x}\nendobj\n".encode("latin-1")
    table = "".join(f"{x:010d} 00000 n \n" for x in offsets)
    return out + f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n{table}trailer\n<< /Size {len(objects) + 1} /Root 1 0 R >>\nstartxref\n{len(out)}\n%%EOF\n".encode("latin-1")


def pdf(answers: DataFrame, title: str = "Research Report") -> DataFrame:
    """answer_id and a PDF file; quotes have four lines at most."""
    from ravelin.functions.text import pdf_escaped, wrapped

    quote = lambda c: F.concat(F.array(F.concat(F.lit("["), c["citation_index"].cast("string"), F.lit("] "), F.coalesce(c["file"], F.lit("Document")))), F.slice(wrapped(c["text"], COLUMNS - 4), 1, 4))
    body = F.flatten(F.transform(F.split("text", "\n"), lambda x: wrapped(x, COLUMNS)))
    lines = F.transform(F.concat(F.array(F.lit(title), F.lit("")), body, F.array(F.lit("")), F.flatten(F.transform("citations", quote))), pdf_escaped)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_pieces(batches, "lines"):
            files = [pdf_bytes(x.split("\n")) for x in b.column("lines").to_pylist()]
            yield pa.record_batch([b.column("answer_id"), pa.array(files, pa.binary())], ["answer_id", "pdf"])

    # escaped lines hold no line feed, and as one text for each file they are in pieces by their bytes
    return answers.select(F.col("answer_id").cast("long").alias("answer_id"), F.array_join(lines, "\n").alias("lines")).mapInArrow(of, "answer_id long, pdf binary")


def page_count(pdf_file: bytes) -> int:
    return int(re.search(rb"/Count (\d+)", pdf_file)[1])


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    k = F.col("doc_id")
    cite = F.struct((k % 5 + 1).cast("int").alias("citation_index"), F.concat(F.col("source"), F.lit(".pdf")).alias("file"), F.when(k % 3 > 0, (k % 30).cast("int")).alias("page"), F.regexp_replace("text", r"\s+", " ").alias("text"), F.lit("").alias("chunk_id"), F.lit(None).cast("double").alias("similarity"))
    claim = F.struct(F.concat(F.lit("c"), k.cast("string")).alias("claim_id"), F.lit("It grew.").alias("text"), (k % 2 == 0).alias("supported"), F.when(k % 2 == 0, "SUPPORTED").otherwise("UNSUPPORTED").alias("status"))
    return d.select(
        k.alias("answer_id"), F.when(k % 4 > 0, F.concat(F.lit("What of "), "source", F.lit("?"))).otherwise("").alias("query"), F.regexp_replace("text", r"\s+", " ").alias("text"),
        F.when(k % 7 > 0, "accept_with_warning").alias("decision"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("double").alias("seconds"), F.when(k % 3 == 0, "hybrid").alias("route"),
        F.when(k % 2 == 0, F.array(cite)).otherwise(F.array().cast("array<struct<citation_index:int,file:string,page:int,text:string,chunk_id:string,similarity:double>>")).alias("citations"), F.array(claim).alias("claims"),
        F.transform(F.sequence(F.lit(1), (k % 18 + 1).cast("int")), lambda i: F.concat(F.lit("e"), i.cast("string"))).alias("entities"), (k % 6).alias("n_edges"),
    )


def markdown_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8, A13, O4 on answers made from documents."""
    return markdown(_answers(spark, sf_dir))


MARKDOWN_REPORT_SQL = r"""
WITH d AS (SELECT doc_id AS k, source, text, chr(10) AS n, chr(10) || chr(10) AS p FROM documents)
SELECT k AS answer_id, '# Research Report' || p || '**Quality Gate:** `' || CASE WHEN k % 7 > 0 THEN 'ACCEPT_WITH_WARNING' ELSE 'ACCEPT' END || '` | **Traceability Score:** `1.00` | **Latency:** `N/A`' || n
  || CASE WHEN k % 3 = 0 THEN '**Routing Strategy:** `hybrid`' || n ELSE '' END || n || '---' || p || '## Research Inquiry' || p || '> ' || CASE WHEN k % 4 > 0 THEN 'What of ' || source || '?' ELSE 'General Query' END
  || p || '---' || p || '## Grounded Synthesis & Findings' || p || trim(regexp_replace(text, '\s+', ' ', 'g')) || p
  || CASE WHEN k % 2 = 0 THEN '---' || p || '## References & Grounded Citations' || p || '### [' || k % 5 + 1 || '] ' || source || '.pdf (Page ' || CASE WHEN k % 3 > 0 THEN CAST(k % 30 AS VARCHAR) ELSE 'N/A' END || ')' || n
    || '> "' || trim(regexp_replace(text, '\s+', ' ', 'g')) || '"' || n || '- *Chunk ID:* `chunk-ref`' || p ELSE '' END
  || '---' || p || '## Verified Claims & Fact Checks' || p || CASE WHEN k % 2 = 0 THEN '- [x] **c' || k || ':** It grew.' ELSE '- [ ] **c' || k || ':** It grew.' || n || '  - *Status:* `UNSUPPORTED`' END || p
  || '---' || p || '## Subgraph Entity Context' || p || 'Identified **' || k % 18 + 1 || ' entities** and **' || k % 6 || ' relationships** in the knowledge graph traversal.' || n
  || '- Key Entities: ' || array_to_string(list_transform(range(1, least(k % 18 + 1, 15) + 1), lambda i: '`e' || i || '`'), ', ') || CASE WHEN k % 18 + 1 > 15 THEN ', ...' ELSE '' END || p || '---' AS report FROM d"""


def developer_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K9, X2."""
    return developer_json(_answers(spark, sf_dir), "2024-05-06T00:00:00Z")


DEVELOPER_EXPORT_SQL = r"""
WITH d AS (SELECT doc_id AS k, source, regexp_replace(text, '\s+', ' ', 'g') AS t FROM documents)
SELECT k AS answer_id, '{"export_version":"1.0.0","exported_at":"2024-05-06T00:00:00Z","query":' || to_json(CASE WHEN k % 4 > 0 THEN 'What of ' || source || '?' ELSE '' END) || ',"grounded_answer":' || to_json(t)
  || ',"metadata":{"traceability_score":null,"quality_gate_decision":"' || CASE WHEN k % 7 > 0 THEN 'accept_with_warning' ELSE 'accept' END || '","execution_time_seconds":null,"routing_strategy":' || CASE WHEN k % 3 = 0 THEN '"hybrid"' ELSE 'null' END || '},"citations":['
  || CASE WHEN k % 2 = 0 THEN '{"citation_index":' || k % 5 + 1 || ',"file":' || to_json(source || '.pdf') || ',"page":' || CASE WHEN k % 3 > 0 THEN CAST(k % 30 AS VARCHAR) ELSE 'null' END || ',"text":' || to_json(t) || ',"chunk_id":"","similarity":null}' ELSE '' END
  || '],"verified_claims":[{"claim_id":"c' || k || '","text":"It grew.","supported":' || (k % 2 = 0) || ',"status":"' || CASE WHEN k % 2 = 0 THEN 'SUPPORTED' ELSE 'UNSUPPORTED' END || '"}]}' AS json FROM d"""


def html_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K10."""
    return html(_answers(spark, sf_dir))


#: Bold and code by the places of their marks.
HTML_REPORT_SQL = r"""
WITH d AS (SELECT doc_id AS k, source, regexp_replace(text, '\s+', ' ', 'g') AS t FROM documents),
e AS (SELECT k, source, array_to_string(list_transform(string_split(t, ''), lambda c: CASE c WHEN '&' THEN '&amp;' WHEN '<' THEN '&lt;' WHEN '>' THEN '&gt;' WHEN '"' THEN '&quot;' WHEN chr(39) THEN '&#039;' ELSE c END), '') AS t FROM d),
b AS (SELECT k, source, string_split(t, '**') AS b FROM e),
c AS (SELECT k, source, string_split(array_to_string(list_transform(b, lambda x, i: CASE WHEN i % 2 = 1 THEN x WHEN i = len(b) THEN '**' || x ELSE '<strong>' || x || '</strong>' END), ''), '`') AS c FROM b),
f AS (SELECT k, source, array_to_string(list_transform(c, lambda x, i: CASE WHEN i % 2 = 1 THEN x WHEN i = len(c) THEN '`' || x ELSE '<code>' || x || '</code>' END), '') AS t FROM c)
SELECT k AS answer_id, '<!DOCTYPE html><html><head><meta charset="utf-8"><title>Research Report</title></head><body><h1>' || CASE WHEN k % 4 > 0 THEN 'What of ' || source || '?' ELSE '' END || '</h1><p>' || t || '</p><ol>'
  || CASE WHEN k % 2 = 0 THEN '<li value="' || k % 5 + 1 || '">' || source || '.pdf' || CASE WHEN k % 3 > 0 THEN ', page ' || k % 30 ELSE '' END || '</li>' ELSE '' END || '</ol></body></html>' AS html FROM f"""


def pdf_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, pages and checksum of each file."""
    made = pdf(_answers(spark, sf_dir))
    pages = F.regexp_extract(F.decode("pdf", "ISO-8859-1"), r"/Count (\d+)", 1)
    return made.select("answer_id", F.octet_length("pdf").cast("long").alias("n_bytes"), pages.cast("long").alias("n_pages"), F.crc32("pdf").alias("crc"))
