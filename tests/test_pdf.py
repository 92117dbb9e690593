"""PDF files of whole texts: offsets, lengths, page numbers, and the lines that they show, against a plain reading."""

import re

from pyspark.sql import functions as F

from ravelin.functions.text import PDF_FOLDS
from ravelin.operators import reports
from tests.conftest import DATA


def plain(text):
    folds = dict(PDF_FOLDS)
    return "".join(folds.get(c, c if " " <= c <= "~" else " ") for c in text)


def wrap(text, width):
    lines = [""]
    for word in re.split(r"[ \t\n\x0b\f\r]+", text):
        if word:
            longer = f"{lines[-1]} {word}" if lines[-1] else word
            if lines[-1] and len(longer) > width:
                lines.append(word)
            else:
                lines[-1] = longer
    return lines


def shown(file):
    """The lines of all pages, by reading the file's objects at the offsets of its table."""
    table = int(re.search(rb"startxref\n(\d+)\n%%EOF\n$", file)[1])
    head = re.match(rb"xref\n0 (\d+)\n0000000000 65535 f \n", file[table:])
    entries = re.findall(rb"(\d{10}) 00000 n \n", file[table:])
    assert len(entries) == int(head[1]) - 1
    objects = {}
    for n, at in enumerate(map(int, entries), 1):
        found = re.match(rb"(\d+) 0 obj\n(.*?)\nendobj\n", file[at:], re.S)
        assert int(found[1]) == n
        objects[n] = found[2]
    kids = [int(k) for k in re.findall(rb"(\d+) 0 R", re.search(rb"/Kids \[(.*?)\]", objects[2])[1])]
    lines = []
    for place, kid in enumerate(kids, 1):
        stream = re.match(rb"<< /Length (\d+) >>\nstream\n(.*)\nendstream$", objects[int(re.search(rb"/Contents (\d+)", objects[kid])[1])], re.S)
        assert len(stream[2]) == int(stream[1])
        own = re.findall(rb"\(((?:\\.|[^\\()])*)\) Tj T\*", stream[2])
        assert len(own) <= reports.LINES and f"(Page {place} of {len(kids)})".encode() in stream[2]
        lines += [re.sub(rb"\\(.)", rb"\1", x).decode("latin-1") for x in own]
    return lines, len(kids)


def test_files_show_the_texts(spark):
    answers = reports._answers(spark, DATA)
    odd = answers.limit(1).withColumns({"answer_id": F.lit(-1).cast("long"), "text": F.lit("(a) \\ “b” — ü•\n\n" + "x" * 200 + " end")})
    rows = {r["answer_id"]: r for r in answers.unionByName(odd).collect()}
    files = {r["answer_id"]: bytes(r["pdf"]) for r in reports.pdf(answers.unionByName(odd)).collect()}
    assert files.keys() == rows.keys()
    for i, r in rows.items():
        wanted = ["Research Report", "", *(line for part in r["text"].split("\n") for line in wrap(part, reports.COLUMNS)), ""]
        for c in r["citations"]:
            wanted += [f"[{c['citation_index']}] {c['file']}", *wrap(c["text"], reports.COLUMNS - 4)[:4]]
        lines, pages = shown(files[i])
        assert lines == [plain(x) for x in wanted] and pages == -(-len(wanted) // reports.LINES) == reports.page_count(files[i])
