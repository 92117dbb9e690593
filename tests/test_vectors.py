"""Examples by hand of what the functions give."""

import datetime
import time

import pytest
from pyspark.sql import functions as F

from ravelin.functions import labels, text
from ravelin.operators import answers, citations, library, reports, sessions, streams
from ravelin.sources import readers


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("chunk", "heading", "field", "wanted"), [
    ("parent_005", "", None, 5), ("doc_p098_c98_01", "", None, 98), ("x_p020_", "", None, 20), ("page_16", "", None, 16), ("page-16", "", "3", 16),
    ("", "Report | 5", "1", 5), ("", "98 | Report", None, 98), ("", "Section (Page 5)", None, 5), ("", "", "7 of 9", 7), ("parent_1", "", "4", 4), ("", "", "0", None), ("", "", None, None),
])
def test_page(spark, chunk, heading, field, wanted):
    assert one(spark, citations.page(F.lit(chunk), F.lit(heading), [F.lit(field).cast("string")])) == wanted


@pytest.mark.parametrize(("given", "wanted"), [
    ("a [1] [1]", "a [1]"), ("a [1][1][1]", "a [1]"), ("a [1], [1]", "a [1]"), ("a [1, 1]", "a [1]"), ("a [1, 2, 1]", "a [1, 2]"), ("a [1] [2]", "a [1] [2]"),
    ("a [1, 2] [2]", "a [1, 2] [2]"), ("said . [1]", "said. [1]"), ("", ""),
])
def test_markers_once(spark, given, wanted):
    assert one(spark, text.deduplicated_markers(F.lit(given))) == wanted
    assert answers.unique_markers(given) == wanted


@pytest.mark.parametrize(("function", "given", "wanted"), [
    (text.speech, "# Hi `x` [1]\n```a\nb```  **b**", "Hi x Code block omitted. b"), (text.copied, "See (Report.pdf, page 4) [1] now [2, 3] .", "See now."),
    (text.doc_name, "X_Annual-Report.pdf", "X Annual Report"), (text.suggestion, " What  is it?..", "What is it"), (text.title, "  a \n b ", "a b"),
    (text.title, "", "New Chat"), (text.title, "x" * 50, "x" * 42 + "..."), (text.slug, "Hello, World! 2", "hello-world-2"), (text.slug, "!!", "research-response"),
    (text.html_escaped, "<a href=\"x\">&'", "&lt;a href=&quot;x&quot;&gt;&amp;&#039;"), (text.pdf_escaped, "(a\\b) – “c” é", "\\(a\\\\b\\) - \"c\"  "), (text.provider, " sk-ant-1", "anthropic"),
    (text.provider, "x" * 40, "cohere"), (text.provider, "a1" * 16, "mistral"), (text.provider, "", "unknown"), (text.provider, "sk-1", "openai"), (text.platform, "Darwin", "macos"), (text.platform, "Win32", "windows"),
    (text.gateway, "Host.example.com/a/", "https://host.example.com"), (text.gateway, "https://Ab.com:443/x", "https://ab.com"), (text.gateway, "https://ab.com:8443", "https://ab.com:8443"),
    (text.percent_encoded, "a b/ü(1)", "a%20b%2F%C3%BC(1)"), (text.file_type, "A.B.PDF", "pdf"), (text.file_type, "none", "other"),
    (text.sanitized, "data: a\n: keepalive\nb[DONE]\\x08 c• d\n\n\n\ne", "a\n\nb c\n\n• d\n\ne"),
])
def test_text(spark, function, given, wanted):
    assert one(spark, function(F.lit(given))) == wanted


@pytest.mark.parametrize(("function", "given", "wanted"), [
    (labels.bytes_label, 0, "0 B"), (labels.bytes_label, 1023, "1023 B"), (labels.bytes_label, 1536, "1.5 KB"), (labels.bytes_label, 20480, "20 KB"), (labels.bytes_label, 5 << 20, "5.0 MB"), (labels.bytes_label, 3 << 30, "3.0 GB"),
    (labels.mb_label, 2048.0, "2.00 GB"), (labels.seconds_label, 0.45, "450ms"), (labels.thought_label, 0.45, "450ms"), (labels.thought_label, 1.8, "1.8s"), (labels.thought_label, -1.0, "0.0s"), (labels.score_label, 0.876, "88%"), (labels.size_label, 0.5, "512 KB"),
    (labels.clamped, 3, 15), (labels.clamped, 300, 100),
])
def test_labels(spark, function, given, wanted):
    assert one(spark, function(F.lit(given))) == wanted


def test_colour_and_stage(spark):
    assert tuple(one(spark, labels.rgb(F.lit("#0af")))) == (0, 170, 255)
    assert one(spark, labels.stage_phrase(F.lit(" fusion "), F.lit(0.0))) == "Finding the most relevant evidence..."
    assert one(spark, labels.stage_phrase(F.lit(None).cast("string"), F.lit(1.5))) == "Searching attached documents..."


def test_urls(spark):
    check = lambda u: one(spark, text.checked_url(F.lit(u)))
    assert check("https://")["error"] == "incomplete"
    assert check("http://a.com")["fix"] == "https://a.com"
    assert check("a.com")["fix"] == "https://a.com"
    assert check("https://a.com/x/")["warning"] == "path and slash"
    assert check("https://a.com/x/")["fix"] == "https://a.com"
    assert check("https://a.com")["is_valid"]
    assert check("https://abc")["error"] == "domain"
    assert check("http://localhost:8000")["is_valid"]


def test_wrap(spark):
    assert one(spark, text.wrapped(F.lit("aa bb  cccccccc d"), 5)) == ["aa bb", "cccccccc", "d"]
    assert one(spark, text.wrapped(F.lit(""), 5)) == [""]


def test_answer_cleaner():
    clean, cites = answers.cleaned("• **### Title**\nIt grew (Annual Report.pdf, Page 8) [1]: yes (Plan.docx, p. 3).\x08 Key [𝟏]", [{"citation_index": 1, "pdf_filename": "Document", "primary_page": None}])
    assert clean.startswith("### Title")
    assert {(c["citation_index"], c["pdf_filename"], c["primary_page"]) for c in cites} == {(1, "Annual Report.pdf", 8), (2, "Plan.docx", 3)}
    assert "\x08" not in clean and "[1]:" in clean
    assert answers.cleaned("", []) == ("", [])
    assert answers.cleaned("no marks", [{"citation_index": 2, "pdf_filename": "a.pdf", "primary_page": 1}])[0] == "no marks [2]"


def test_layout():
    clean = answers.cleaned("Intro: • one • two - **Bold** [2]: said. 1. **First** x\nline\n- item\nKey Strategic Conclusions\n\n\n\nend  ", [{"citation_index": 2, "pdf_filename": "a.pdf", "primary_page": 1}])[0]
    assert clean == "Intro:\n\n• one\n\n• two\n\n- **Bold** [2]\n  said.\n\n1. **First** x\nline\n\n- item\n\n### Key Strategic Conclusions\n\nend"
    assert answers.cleaned("[3] (Page 4, b.docx) and (c.pdf) [5] not (d.pdf) nor (see above) [6]", [])[1] == [{"citation_index": 3, "pdf_filename": "b.docx", "primary_page": 4}, {"citation_index": 5, "pdf_filename": "c.pdf", "primary_page": None}]


@pytest.mark.parametrize("part", ["word ", "• a ", "(", "[1] (", "(a.pdf, ", "- **x", "{\"token\": \"", "[1, ", "\n\n", "1. **", "|", "```\n", "> q\n", "- i\n", "`", "**"])
def test_long_texts_take_little_time(part):
    began = time.perf_counter()
    text = part * (100_000 // len(part))
    answers.cleaned(text, [])
    assert sum(1 for _ in answers.blocks(text)) >= 0
    answers.without_fragments(text)
    assert time.perf_counter() - began < 20


def test_unwrapped_fragments(spark):
    for given in ('ask{"token": " question "}{"delta": {"content": "x\\n"}}{"text": "\\u00e9"}', '{"token": "\\q"}', "plain", '{"other": "x"} {"reply": ""}'):
        assert one(spark, text.unwrapped(F.lit(given))) == answers.without_fragments(given)


def test_fragments():
    assert answers.without_fragments('ask{"token": " question "}{"delta": {"content": "x\\n"}}{"text": "\\u00e9"}') == "ask question x\né"
    assert answers.without_fragments('{"token": "\\q"}') == "\\q"


def test_blocks():
    got = list(answers.blocks("# A\n\ntext\nmore\n- x\n  on\n\n- y\n1. n\n> q\n> r\n---\n```py\nx\n```\n|a|b|\n|--|:-:|\n|1|2|\n**Note:** z\n**Bold**"))
    assert [b["type"] for b in got] == ["heading", "paragraph", "unordered-list", "ordered-list", "blockquote", "hr", "code", "table", "callout", "heading"]
    assert got[2]["text"] == "0:x\non\n0:y"
    assert got[7]["language"] == "left,center"


def test_stream_lines(spark):
    lines = ['data: {"token": ""}', 'data: {"token": 5}', '{"delta": {"content": "d"}}', "[1]", '{"a": 1}', '{"bad', 'data: {"bad}', "  ", 'data: {"status": "completed"}']
    got = streams.classified(spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "seq int, line string")).orderBy("seq").collect()
    assert [r["kind"] for r in got] == ["token", "token", "token", "drop", "drop", "drop", "broken", "drop", "metadata"]
    assert [r["added"] for r in got][:3] == ["", '{"token": 5}\n', "d"]


def test_pdf():
    made = reports.pdf_bytes([f"line {i}" for i in range(100)])
    assert reports.page_count(made) == 3
    start = int(made.rsplit(b"startxref\n", 1)[1].split(b"\n")[0])
    assert made[start:].startswith(b"xref")
    first = int(made[start:].split(b"\n")[3].split()[0])
    assert made[first:].startswith(b"1 0 obj")


def test_sessions(spark):
    stored = spark.createDataFrame([(1, "a"), (2, "b")], "id int, title string")
    changes = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "id int, title string, n int")
    got = {tuple(r) for r in sessions.upserted(stored.withColumn("n", F.lit(0)), changes, "id", "n").select("id", "title", "front").collect()}
    assert got == {(1, "a", 1), (2, "y", 0), (3, "z", 0)}
    d = spark.createDataFrame([(["a"], [("add", "b"), ("pin", "c"), ("pin", "a"), ("remove", "b")])], "docs array<string>, actions array<struct<kind:string,name:string>>")
    assert sessions.drawer(d).first()["docs"] == ["c"]


def test_library(spark):
    i = library.item(spark.createDataFrame([("a.PDF", 0.0, "error")], "filename string, size_mb double, status string")).first()
    assert (i["type"], i["bytes"], i["library_status"]) == ("pdf", 1048576, "ready")
    d = library.deletable(spark.createDataFrame([(None, False, None, "u"), (None, None, None, "system"), (False, None, None, None)], "is_protected boolean, can_delete boolean, deletable boolean, owner string"))
    assert [(r["protected"], r["deletable_now"]) for r in d.collect()] == [(True, False), (True, False), (False, True)]


def test_readers(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"filename": "a.pdf"}\n{"pages": "x"\n{"filename": "b", "pages": 3, "status": null}\n')
    got = readers.json_rows(spark, str(tmp_path / "d.json"), "document").collect()
    assert [(r["filename"], r["pages"], r["corrupt"] is None) for r in got] == [("a.pdf", 0, True), (None, 0, False), ("b", 3, True)]
    kept = readers.stored_values(spark.createDataFrame([("k", '[{"a": 1}]'), ("l", "oops")], "key string, value string"), "struct<a:int>").collect()
    assert [len(r["items"]) for r in kept] == [1, 0]
    p = readers.problems(spark.createDataFrame([("", 4, 2, "x"), ("q", 1, 4, "fast")], "query string, hops int, top_k int, mode string")).collect()
    assert [r["problems"] for r in p] == [["query", "hops", "mode"], []]


def test_dates(spark):
    now = F.lit(datetime.datetime(2024, 3, 10, 12, 0, tzinfo=datetime.UTC))
    label = lambda s: one(spark, labels.session_date(F.lit(s), now))
    assert [label(x) for x in ("", "2m ago", "what", "2024-03-10T11:59:30Z", "2024-03-10T09:05:00Z", "2024-03-09T23:00:00Z", "2024-01-02T00:00:00Z", "2022-09-05T00:00:00Z")] == ["Recent", "2m ago", "what", "Just now", "Today, 9:05 AM", "Yesterday, 11:00 PM", "Jan 2", "Sep 5, 2022"]
