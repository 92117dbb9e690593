import hashlib
import importlib.util
import io
import random
import re
import string
import sys
import tokenize

import numpy as np

from ravelin.llm import secrets as S
from tests.llm import fixtures

ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
TEXTS = [
    None, "", "x", "é password = 'hunter22' 😀 Token:abc API_KEY=a/b+c==", "secret=token: abcdefgh", "AKIA" + "A1" * 8 + " AKIAAKIA AKIA" + "Z" * 15, "abc" * 8 + " " + "ab" * 11 + " 0123456789abcdef01234567", "token=token=abcdefgh", "PASSWORD: x password:  \"yyyyyy\"",
    "key 7fK2mQ9xV4bN8pR1tY6wZ3sD5gH0jL seen internationalizationofthings2024",
]


def brute(text):
    text = text or ""
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def model(spark):
    words = [w for i in range(60) for w in fixtures.prose(i).split()] + ["user_name", "lastIndexOf", "max-width", "config.yaml", "2024-01-05", "internationalization"] * 20
    ordinary = spark.createDataFrame([(w, False) for w in words] + [(None, True), ("", False), ("é😀", False)], "token string, secret boolean")
    return S.train(S.random_strings(spark, 2000).selectExpr("token", "true AS secret").unionByName(ordinary))


def test_fixed_spans_are_those_of_a_plain_scan(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    for r in S.scanned(docs, model(spark)).collect():
        got = [(s["start"], S.KINDS.index(s["kind"]), s["kind"], s["end"]) for s in r["spans"] if s["kind"] != "random"]
        assert got == brute(r["text"])


def test_random_strings_are_found(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    got = {r["doc_id"]: [s["value"] for s in r["spans"] if s["kind"] == "random"] for r in S.scanned(docs, model(spark)).collect()}
    assert got[9] == ["7fK2mQ9xV4bN8pR1tY6wZ3sD5gH0jL"]
    assert not any(got[i] for i in range(4))


def test_query(spark):
    from tests.conftest import DATA

    for r in S.op5_markov_secrets(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text"), "doc_id").collect():
        wanted = brute(r["text"])
        said = ",".join(f"{k}:{a}:{b}" for a, _, k, b in wanted)
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in S.KINDS[:3]] == [sum(x[2] == k for x in wanted) for k in S.KINDS[:3]]


def test_odd_rows_and_empty_tables(spark):
    m = S.train(spark.createDataFrame([], "token string, secret boolean"))
    assert np.allclose(m.ratios, 0)
    docs = fixtures.odd(spark)
    assert S.scanned(docs, m).count() == docs.count()
    assert S.scanned(fixtures.empty(spark), m).count() == 0


def plain_ratio(token, ratios):
    token = "".join(p if re.search("[a-z]", p) else p.lower() for p in re.split("([+/_=.-])", token))
    return sum(ratios[128 * ord(a) + ord(b)] for a, b in zip(token, token[1:], strict=False)) / (len(token) - 1)


def test_ratios_and_thresholds_are_those_of_a_plain_scan(spark):
    m = model(spark)
    r = random.Random(4)
    texts = [" ".join(r.choice([fixtures.prose(i, 30), "".join(r.choices(S.ALPHABET, k=r.choice([8, 9, 30, 47, 48, 49, 50, 200])))]) for _ in range(4)) for i in range(40)] + ["SHOUTING WORDS REPEATED", "x" * 3000]
    got = {x["doc_id"]: [s["value"] for s in x["spans"] if s["kind"] == "random"] for x in S.scanned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), m).collect()}
    for i, text in enumerate(texts):
        wanted = []
        for c in re.finditer(S.CANDIDATE, text):
            limit = max(0.0, m.mean + 6.5 * (m.variance / (len(c[0]) - 1)) ** 0.5)
            if plain_ratio(c[0], np.round(m.ratios, 6)) > limit and not any(b[0] < c.end() and c.start() < b[3] for b in brute(text)):
                wanted.append(c[0])
        assert got[i] == wanted


def test_precision_and_recall_on_planted_keys(spark):
    m = model(spark)
    r = random.Random(5)
    alphabets = {"letters": string.ascii_letters, "all": string.ascii_letters + string.digits, "capitals and digits": string.ascii_uppercase + string.digits, "small and digits": string.ascii_lowercase + string.digits}
    rows, keys = [], {}
    for i, (name, n) in enumerate((a, n) for a in alphabets for n in (8, 10, 12, 16, 20, 30, 40) for _ in range(20)):
        keys[i] = "".join(r.choices(alphabets[name], k=n))
        rows.append((i, f"{fixtures.prose(5000 + i, 40)} {keys[i]} {fixtures.prose(6000 + i, 40)}"))
    got = {x["doc_id"]: [s["value"] for s in x["spans"]] for x in S.scanned(spark.createDataFrame(rows, "doc_id long, text string"), m).collect()}
    found = sum(keys[i] in got[i] for i in keys)
    assert found >= 0.95 * len(keys)
    assert sum(len(v) for v in got.values()) - found <= 0.02 * len(keys)
    letters = [i for i in range(20 * 7) if keys[i] in got[i]]
    assert len(letters) >= 0.9 * 20 * 7  # letters alone, from 8 characters


def outside():
    """Ordinary names that no sample has: those of the standard library and the words of a licence-like prose."""
    names = set()
    for module in sorted(sys.stdlib_module_names):
        spec = None if module.startswith("_") or module in ("antigravity", "this") else importlib.util.find_spec(module)
        if spec and spec.origin and spec.origin.endswith(".py"):
            with open(spec.origin, encoding="utf-8", errors="ignore") as f:
                names |= {t.string for t in tokenize.generate_tokens(io.StringIO(f.read()).readline) if t.type == tokenize.NAME}
    return sorted(n for n in names if re.fullmatch(S.CANDIDATE, n))


def test_identifiers_outside_the_samples_and_random_strings(spark):
    docs = spark.createDataFrame([(i, fixtures.prose(i)) for i in range(200)], "doc_id long, text string")
    m = S.train(S.samples_of(docs, S.public_vocabulary()))
    names = outside()
    assert len(names) > 3000
    forms = ["mail2.example.com", "4111111111111111", "2024-11-05", "Keyboard", "Summarize", "expected", "markdown", "workspace", "src/components/chat/AnswerMarkdown.tsx", "BYTECODE_SUFFIXES", "user_name_2", "README.md", "HTMLInputElement", "internationalization"]
    r = random.Random(6)
    alphabets = [string.ascii_letters, string.ascii_letters + string.digits, string.ascii_uppercase + string.digits, string.ascii_lowercase + string.digits]
    keys = {n: ["".join(r.choices(a, k=n)) for a in alphabets for _ in range(100)] for n in (12, 16, 20, 30, 40)}
    rows = [(i, t) for i, t in enumerate([" ".join(names), " ".join(forms), *(" ".join(k) for k in keys.values())])]
    got = {x["doc_id"]: [s["value"] for s in x["spans"] if s["kind"] == "random"] for x in S.scanned(spark.createDataFrame(rows, "doc_id long, text string"), m, deviations=2.5).collect()}
    assert len(got[0]) < 0.01 * len(names), (len(got[0]), len(names), got[0][:20])
    assert got[1] == []
    for i, n in enumerate(keys):
        assert len(got[2 + i]) >= (0.9 if n < 16 else 0.97) * len(keys[n]), (n, len(got[2 + i]))


def test_running_sums(spark):
    from pyspark.sql import functions as F

    for n in (0, 1, 255, 256, 257, 512, 5000):
        x = [i % 7 for i in range(n)]
        got = spark.createDataFrame([(x,)], "x array<int>").select(S.running_sums(F.col("x")).alias("s")).first()["s"]
        assert got == np.cumsum(x).tolist()
    text = " ".join(["token=abcdefgh"] * 3000)
    got = S.scanned(spark.createDataFrame([(1, text)], "doc_id long, text string"), model(spark)).first()["spans"]
    assert [(s["start"], s["end"]) for s in got] == [(15 * i, 15 * i + 14) for i in range(3000)]
