import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ravelin.operators import chunks


def lines(spark, rows, **options):
    got = {}
    for r in chunks.lines_of(spark.createDataFrame(rows, "request_id int, seq long, chunk string"), **options).collect():
        got[r["request_id"], r["line_no"]] = r["line"]
    return got


def test_lines_of_streams_cut_anywhere(spark):
    rng = random.Random(5)
    rows, wanted = [], {}
    for request in range(12):
        text = "".join(rng.choice("ab \n") for _ in range(rng.randrange(200)))
        every = text.split("\n")
        if not every[-1].strip():
            every.pop()
        wanted |= {(request, i): x for i, x in enumerate(every)}
        cuts = sorted(rng.choices(range(len(text) + 1), k=30))
        rows += [(request, 3 * i, text[a:b]) for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(text)], strict=True))]
    rng.shuffle(rows)
    assert lines(spark, rows, block=8) == lines(spark, rows) == wanted


def test_odd_chunks(spark):
    assert lines(spark, [(1, 0, None), (1, 1, "a"), (1, 1, "a"), (1, 2, ""), (1, 3, "b\n \n"), (1, 4, " "), (2, 0, None), (3, 9, "\n")]) == {(1, 0): "ab", (1, 1): " ", (3, 0): ""}
    assert lines(spark, [(None, 0, "a\n"), (None, 1, "b")]) == {(None, 0): "a", (None, 1): "b"}
    assert lines(spark, []) == {}
    assert lines(spark, [(1, i, "x" * 1000) for i in range(3000)]) == {(1, 0): "x" * 3_000_000}


def test_last_match(spark):
    rows = spark.createDataFrame([(["a", "bb", "c", "dd"],), (["a"],), ([],), (None,)], "items array<string>")
    assert [r[0] for r in rows.select(chunks.last_where(F.col("items"), lambda x: F.length(x) == 2)).collect()] == ["dd", None, None, None]


def test_suggestions(spark):
    docs = [(1, "en", "Beta alpha beta, which gamma delta omega abc"), (2, "en", "which alpha"), (3, "en", "which Tree"), (4, "de", "Größe größe über which"), (5, "de", "über"), (6, None, "only ones"), (7, "en", ""), (8, "en", None)]
    rows = spark.createDataFrame(docs, "doc_id long, lang string, text string")
    got = {}
    for r in chunks.suggested(rows).orderBy("doc_id", "place").collect():
        got.setdefault(r["doc_id"], []).append(r["term"])
    # 1: beta twice; then what it alone has; alpha, which two of five have, is behind them. 6: what all documents of a language have, by the alphabet
    assert got == {1: ["beta", "delta", "gamma", "omega"], 2: ["alpha", "which"], 3: ["tree", "which"], 4: ["größe", "which", "über"], 5: ["über"], 6: ["ones", "only"]}
    assert chunks.suggested(rows.limit(0)).count() == 0


@pytest.mark.parametrize("most", [0, 3, 50_000])
def test_terms_that_mark_documents_whatever_goes_to_all_tasks(spark, most):
    r = random.Random(most)
    words = ["alpha", "Beta", "gämma", "delta", "omega", "sigma", "kappa", "abc", "1234"] + [f"rare{c}" * 2 for c in "abcdefgh"]
    rows = [(r.choice([None, *range(1, 25)]), r.choice(["en", "de", None]), r.choice([None, "", " ".join(r.choices(words, k=12))])) for _ in range(40)] + [(100 + i, "en", " ".join(r.choices(words, k=20))) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(5)
    n, members = Counter(), {(d, lang or "") for d, lang, _ in rows}
    for d, lang, text in rows:
        n.update((d, lang or "", w.lower()) for w in re.findall(r"[^\W\d_]{4,}", text or ""))
    having, docs = Counter((lang, w) for _, lang, w in n), Counter(lang for d, lang in members if d is not None)
    docs.update(lang for d, lang in members if d is None)
    wanted, by = set(), defaultdict(list)
    for (d, lang, w), k in n.items():
        by[d].append((-round(k * math.log(docs[lang] / having[lang, w]), 9), w))
    for d, ranked in by.items():
        wanted |= {(d, i + 1, round(-weight, 6)) for i, (weight, _) in enumerate(sorted(ranked)[:4])}
    got = chunks.suggested(df, most=most).collect()
    assert len(got) == len(wanted)
    weights = defaultdict(set)
    for (d, lang, w), k in n.items():
        weights[d, w].add(round(k * math.log(docs[lang] / having[lang, w]), 6))
    assert all(any((x["doc_id"], x["place"], v) in wanted for v in weights[x["doc_id"], x["term"]]) for x in got)
    assert chunks.suggested(df.limit(0)).count() == 0


def test_terms_of_documents_are_counted_where_they_are(spark):
    """Of documents with one row, no term goes through a shuffle by document but the best."""
    docs = spark.createDataFrame([(i, "en", f"word{i} other") for i in range(50)], "doc_id long, lang string, text string")
    plan = str(chunks.suggested(docs)._jdf.queryExecution().executedPlan())
    assert plan.count("WindowGroupLimit") == 2 and "LeftAnti" in plan and "BroadcastHashJoin" in plan
