import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ravelin.llm import token_files as T
from ravelin.llm import warc as W
from tests.llm import fixtures

PATH = T.public_tokenizer()


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"ab1.'\n\t  é日\0\x85\xa0\x1c", "  ", "\n\n", "the", " of", "'s", "<|endoftext|>"]), max_size=30).map("".join), max_size=6))
def test_words_apart_have_the_ids_of_the_text(plain, texts):
    encode = T.encoder(PATH)
    got = [np.frombuffer(x, encode.kind).tolist() for x in encode(texts, b"")]
    assert got == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"aZ1'.,$ \n\r\t\x0b\x01é×ſƀ\u0301½²日Ж\u2009\u3000", "  ", "\n \n", "'re", "'sample", "''"]), max_size=30).map("".join), max_size=6))
def test_units_of_the_pattern(plain, texts):
    encode = T.encoder(PATH)
    got = [np.frombuffer(x, encode.kind).tolist() for x in encode(texts, b"")]
    assert got == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]


class Counted:
    """A tokenizer or its model, with the characters that it was given."""

    def __init__(self, inner):
        self.inner, self.given = inner, 0

    def encode_batch_fast(self, texts, **options):
        self.given += sum(map(len, texts))
        return self.inner.encode_batch_fast(texts, **options)

    def tokenize(self, word):
        self.given += len(word)
        return self.inner.tokenize(word)


def test_a_word_is_encoded_once_for_all_marks_behind_it():
    encode = T.Encoder(PATH)
    encode.tokenizer, encode.model = Counted(encode.tokenizer), Counted(encode.tokenizer.model)
    words = [f"{a}{b}{c}ing" for a in "bdfgklmn" for b in "aeiou" for c in "prst"]
    encode([" " + " ".join(w + mark for w in words for mark in ("", ".", ",", "!!", "&&&", "\n"))], b"")
    assert encode.tokenizer.given + encode.model.given < 1.5 * sum(len(w) + 1 for w in words)


def test_vocabularies_with_tokens_across_words(tmp_path):
    t = Tokenizer.from_file(PATH)
    t.add_tokens(["under morning"])
    t.save(str(tmp_path / "t.json"))
    texts = ["light under morning walks", "under mornings\n\nunder morning", ""]
    encode = T.Encoder(str(tmp_path / "t.json"))
    assert [np.frombuffer(x, encode.kind).tolist() for x in encode(texts, b"")] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1), max_size=9), max_size=9))
def test_coding_round_trip(docs):
    both = [T.encode(np.array(d, np.uint32)) for d in docs]
    control, data = (np.frombuffer(b"".join(x[i] for x in both), np.uint8) for i in (0, 1))
    assert T.decode(control, data, np.array([len(d) for d in docs], np.int64)).tolist() == [x for d in docs for x in d]


def test_files_hold_all_ids_in_order(spark, plain):
    docs = fixtures.odd(spark)
    files = T.write_files(docs, tokenizer=PATH, block=500)
    got = T.read_files(files).orderBy("start").collect()
    wanted = [(r["doc_id"], plain.encode(r["text"] or "", add_special_tokens=False).ids + [2]) for r in docs.select("doc_id", "text").collect()]
    ids = [None if r["doc_id"] is None else r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x))
    key = lambda x: (x[0] is not None, x[0], x[1])
    assert sorted([(r["doc_id"], list(r["ids"])) for r in got], key=key) == sorted(wanted, key=key)
    at = 0
    for r in got:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += r["n_tokens"]
    assert T.read_files(T.write_files(fixtures.empty(spark), tokenizer=PATH)).count() == 0


def test_archives(spark):
    rows = [(1, "http://a/ü x\r\ny", "<p>same</p>"), (5, None, "<p>same</p>"), (3, "http://b", None), (4, "http://c", ""), (2, "http://d", "x" * 300_000), (None, "http://e", "<p>same</p>"), (9, "u", "é\r\n\r\nWARC/1.1\r\n"), (9, "u", "é\r\n\r\nWARC/1.1\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("x")).withColumn("payload", F.lit(1))
    files = W.write_archives(pages, roll=1000)
    got = W.read_archives(files).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["page_id"], []).append(r)
    assert by[5][0]["record_type"] == "response" and bytes(by[5][0]["payload"]) == b"<p>same</p>"
    assert by[1][0]["record_type"] == by[None][0]["record_type"] == "revisit" and by[1][0]["refers_to"] == by[None][0]["refers_to"] == 5
    assert by[3][0]["refers_to"] == 4 and by[4][0]["record_type"] == "response" and by[4][0]["payload_bytes"] == 0
    assert [r["record_type"] for r in by[9]] == ["response", "response"]
    assert by[2][0]["payload_digest"] == W.base32_sha1(b"x" * 300_000) and by[2][0]["payload_bytes"] == 300_000
    fs, path = W.open_fs(files.first()["file"])
    with fs.open_input_stream(path) as f:
        assert f.read(4) == b"\x5d\x2a\x4d\x18"
    assert W.read_archives(W.write_archives(pages.where("page_id > 100"))).count() == 0


def test_damage_is_seen(spark):
    import io
    import struct

    import zstandard

    dictionary = b"d" * 100
    rec = W.record(1, "u", b"payload", W.base32_sha1(b"other"), None, "2024-01-01T00:00:00Z")
    data = struct.pack("<II", W.SKIPPABLE, 100) + dictionary + zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)).compress(rec)
    ((head, block),) = list(W.read_records(io.BytesIO(data)))
    assert block.endswith(b"payload") and W.base32_sha1(b"payload") != head["WARC-Payload-Digest"].removeprefix("sha1:")
