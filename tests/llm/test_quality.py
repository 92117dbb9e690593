import math
import re
import zlib

import numpy as np
import pyarrow as pa

from ravelin.llm import quality_ranker as Q
from tests.conftest import DATA
from tests.llm import fixtures


def test_held_out_accuracy(spark):
    got = Q.op1_quality_ranking(spark, DATA).join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["predicted"] == r["quality"] for r in held]) >= 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)


def test_odd_rows_and_empty_tables(spark):
    labels = spark.createDataFrame([(0, 1), (1, 1), (2, 1), (105, 0), (102, 0), (None, 1), (3, None)], "doc_id long, quality int")
    docs = fixtures.odd(spark)
    out = Q.scored(docs, Q.train(docs, labels))
    assert out.count() == docs.count() and out.where("quality_score is null").count() == 0
    none = Q.train(fixtures.empty(spark), labels)
    assert Q.scored(docs, none).select("quality_score").distinct().first()[0] == 0.5
    assert Q.scored(fixtures.empty(spark), none).count() == 0


def test_preference_pairs_order_documents():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, Q.N_FEATURES))
    good = x[:, 3] > 0
    r = Q.fit(x, good)
    assert ((r.score(x) >= r.cut) == good).mean() > 0.97


def test_features_do_not_depend_on_neighbours():
    texts = ["a b c", None, "", "X" * 5, fixtures.prose(1)]
    one = np.concatenate([Q.features(pa.array([t], pa.string())) for t in texts])
    assert np.allclose(one, Q.features(pa.array(texts, pa.string())))


def test_threshold_is_a_quantile():
    s, good = np.arange(10.0), np.arange(10) >= 3
    assert Q.best_quantile(s, good) == 0.3


def plain_features(text):
    """The features by their definitions, from the bytes of one text."""
    groups = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "\n", " \t\r\v\f", ".,;:?'\"()-", "!", "#*$%&|<>~^=+_/\\{}[]@`"]
    raw = (text or "").encode()
    kind = lambda b: 9 if b > 127 else next((i for i, g in enumerate(groups) if chr(b) in g), 8)
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    low = [w.decode().lower() for w in words]
    n, some = len(words), max(len(words), 1)
    tri = [tuple(low[i : i + 3]) for i in range(max(n - 2, min(n, 1)))]
    again = lambda x: len(x) - len(set(x))
    out = [sum(kind(b) == k for b in raw) / max(len(raw), 1) for k in range(10)]
    out += [sum(kind(w[0]) == 0 for w in words) / some, sum(kind(w[-1]) == 5 for w in words) / some, sum(6 <= kind(w[-1]) <= 8 for w in words) / some]
    out += [sum(len(w) == 1 for w in words) / some, sum(a == b for a, b in zip(low, low[1:], strict=False)) / some, again(low) / some, again(tri) / max(len(tri), 1)]
    out += [min(sum(map(len, words)) / some, 40) / 40, math.log1p(n) / 10, math.log1p(n / (raw.count(b"\n") + 1)) / 10, min(n, 30) / 30]
    return [*out, *(x * x for x in out)]


def test_features_are_those_of_a_plain_scan():
    texts = ["", "a", "A b. C! a b. c a b", "x\ny\n\n y  \t z", "é ÉÈ 😀 wörd", "$$$ ### a_b {x} \x01", *(fixtures.prose(i) for i in range(5)), fixtures.prose(9) * 40]
    assert np.allclose(Q.features(pa.array(texts)), [plain_features(t) for t in texts])


def test_an_id_that_many_documents_have_is_learned_from_once(spark):
    docs = fixtures.rows(60) + [(3, fixtures.prose(900 + i), "en", "s", None) for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    few = [r for r in docs if r[0] != 3]
    same = Q.train(spark.createDataFrame(docs, fixtures.SCHEMA), labels)
    again = Q.train(spark.createDataFrame(docs[::-1], fixtures.SCHEMA).repartition(5), labels)
    assert np.allclose(same.weights, again.weights) and len(few) == 59
