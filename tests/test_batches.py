"""Texts in pieces: what a task holds at a time, and that every row comes out in its order."""

import zlib

import pyarrow as pa

from ravelin.operators import answers, batches, reports


def test_pieces_are_bounded_and_whole():
    texts = ["a" * n for n in (5, 0, 900, 3, 4)] + [None, "ü" * 300, "b" * 2000, "", "c"]
    batch = pa.record_batch([pa.array(range(10)), pa.array(texts)], ["id", "text"])
    got = list(batches.in_pieces(iter([batch, batch.slice(0, 0)]), "text", 1000))
    assert [x for p in got for x in p.column("text").to_pylist()] == texts and len(got) > 2
    assert all(sum(len((x or "").encode()) for x in p.column("text").to_pylist()) <= 2000 + 1000 for p in got)
    assert len(list(batches.in_pieces(iter([pa.record_batch([pa.array(["x" * 100] * 1000)], ["text"])]), "text", 1000))) == 100


def _noting(seen):
    plain = batches.in_pieces

    def noted(rows, column):
        for piece in plain(rows, column, 10_000):
            with open(seen, "a") as f:
                f.write(f"{sum(len(x or '') for x in piece.column(column).to_pylist())}\n")
            yield piece

    return noted


def _largest(spark, make, monkeypatch, tmp_path):
    """The most bytes of texts that a task takes up at once, as its workers note them."""
    seen = str(tmp_path / "seen")
    monkeypatch.setattr(answers, "in_pieces", _noting(seen))
    df = spark.createDataFrame([(i, "word " * 200 if i % 50 else None, None) for i in range(2000)], f"answer_id long, text string, citations {answers.CITATIONS}").coalesce(1)
    rows = make(df).collect()
    return rows, [int(x) for x in open(seen)]


def test_answers_are_cleaned_in_pieces(spark, monkeypatch, tmp_path):
    rows, sizes = _largest(spark, answers.clean_answers, monkeypatch, tmp_path)
    assert [(r["answer_id"], r["clean_text"], r["citations"]) for r in rows] == [(i, ("word " * 200).strip() if i % 50 else "", []) for i in range(2000)]
    assert len(sizes) > 100 and max(sizes) <= 20_000


def test_blocks_are_found_in_pieces(spark, monkeypatch, tmp_path):
    rows, sizes = _largest(spark, answers.exploded_blocks, monkeypatch, tmp_path)
    assert [tuple(r) for r in rows] == [(i, 0, "paragraph", None, None, None, ("word " * 200).strip()) for i in range(2000) if i % 50]
    assert len(sizes) > 100 and max(sizes) <= 20_000


def test_pdf_files_are_made_in_pieces_and_measured_without_python(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(reports, "in_pieces", _noting(str(tmp_path / "seen")))
    docs = [(i, ("é(word) \\ " * 100 + "\n") * (1 + i % 3), f"s{i}") for i in range(300)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["answer_id"]: tuple(r)[1:] for r in reports.pdf_report(spark, str(tmp_path)).collect()}
    files = {r["answer_id"]: bytes(r["pdf"]) for r in reports.pdf(reports._answers(spark, str(tmp_path))).collect()}
    assert len(got) == 300 and got == {i: (len(f), reports.page_count(f), zlib.crc32(f)) for i, f in files.items()}
    sizes = [int(x) for x in open(tmp_path / "seen")]
    assert len(sizes) > 20 and max(sizes) <= 20_000
    assert str(reports.pdf_report(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan()).count("MapIn") == 1
