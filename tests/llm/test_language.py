import numpy as np
import pyarrow as pa

from ravelin.llm import language_id as L
from tests.conftest import DATA
from tests.llm import fixtures


def test_held_out_accuracy(spark):
    got = L.op4_language_id(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) >= 0.9


def test_odd_rows_and_empty_tables(spark):
    docs = fixtures.odd(spark)
    out = L.predicted(docs, L.train(docs)).collect()
    by = {r["doc_id"]: r for r in out}
    assert len(out) == docs.count()
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (100, 101, 102, 105))
    assert by[106]["lang_pred"] != "und" and {r["lang_pred"] for r in out} <= {"en", "de", "zh", "und"}
    none = L.train(fixtures.empty(spark))
    assert {r["lang_pred"] for r in L.predicted(docs, none).collect()} == {"und"}


def test_subwords_stay_in_their_text():
    data = np.frombuffer(b"abcd", np.uint8)
    both, rows = L.subwords(data, np.array([0, 2, 4]))
    one, _ = L.subwords(data[:2], np.array([0, 2]))
    assert sorted(both[rows == 0]) == sorted(one)


def plain_subwords(text):
    """Buckets of the 2-, 3- and 4-byte runs; gaps are blanks, and stand only at the ends of a run."""
    low = text.lower().encode()
    b = bytes(x if 97 <= x <= 122 or x > 127 else 32 for x in low)
    b = b" " + b + b" "
    while b"  " in b:
        b = b.replace(b"  ", b" ")
    out = []
    for size in (2, 3, 4):
        for i in range(len(b) - size + 1):
            g = b[i : i + size]
            if 32 not in g[1:-1]:
                code = size
                for x in g:
                    code = (code * 0x01000193 % 2**32) ^ x
                out.append((code * 0x85EBCA6B % 2**32) >> 16)
    return out


def test_probabilities_are_those_of_a_plain_scan(spark):
    rng = np.random.default_rng(1)
    model = L.Model(["a", "b", "c"], rng.normal(size=(L.BUCKETS, 3)).astype(np.float32), rng.normal(size=3), 1.7, 0.0)
    texts = ["Hello, world", "a", "é è x1y2", "one\n\ntwo  three", fixtures.prose(1), fixtures.prose(2, 5000)]
    z, letters = L.logits(pa.array(texts), model)
    got = {r["doc_id"]: r for r in L.predicted(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, t in enumerate(texts):
        wanted = model.table[plain_subwords(t)].astype(float).mean(0) + model.bias
        e = np.exp(wanted / 1.7 - max(wanted / 1.7))
        assert letters[i] and np.allclose(z[i], wanted)
        assert np.isclose(got[i]["score"], max(e) / sum(e)) and got[i]["lang_pred"] == "abc"[int(np.argmax(e))]


def test_sample_is_of_different_texts(spark):
    rows = [(i, fixtures.prose(i), "en" if i % 2 else "de", "s", None) for i in range(20)] + [(100 + i, fixtures.prose(3), "en", "s", None) for i in range(200)]
    model = L.train(spark.createDataFrame(rows, fixtures.SCHEMA), most_labelled=40)
    assert model.languages == ["de", "en"]
