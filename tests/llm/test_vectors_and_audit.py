import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from ravelin.llm import one_bit_search, source_audit, vector_codes
from tests.llm import fixtures

VECTORS = "vec_id long, embedding array<float>, label int, score string, code string, rank string"
ODD = [
    (None, [0.5] * 16, 1), (900, None, 1), (901, [0.0] * 16, 2), (902, [float("nan")] * 16, 2), (903, [float("inf")] + [0.0] * 15, None), (904, [None] + [0.1] * 15, None),
    (905, [], 1), (906, [0.25] * 8, 1), (907, [0.25] * 7, 1), (908, [0.5] * 16, None), (908, [0.5] * 16, None), (1000, [0.5] * 16, 3), (1000, [-0.5] * 16, 3), (910, [1e30] * 16, 3),
]


def vectors(n=300, width=16, seed=1):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, width)).astype(np.float32)
    x[n // 2 : n // 2 + n // 4] = x[3]  # one vector that a quarter of the rows have
    return [(i, [float(v) for v in x[i]], int(i % 4) if i % 7 else None) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "own", "own", "own") for r in rows], VECTORS).repartition(3)


def finite(v, width=16):
    return v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)


def nearest(rows, k, divisor):
    """The k nearest of each different query row, by all distances in Python."""
    own = [(float("inf") if i is None else i, v) for i, v, *_ in rows if finite(v) and any(v)]
    out = Counter()
    for q, v in {(i, tuple(v)) for i, v in own if i != float("inf") and i % divisor == 0}:
        far = sorted((sum((a - b) ** 2 for a, b in zip(v, w, strict=True)) ** 0.5, i) for i, w in own if i != q)
        out.update((q, rank + 1, None if i == float("inf") else i, round(d, 9)) for rank, (d, i) in enumerate(far[:k]))
    return out


@pytest.mark.parametrize("sample", [1, 50, 4096])
def test_neighbours_are_those_of_all_distances(spark, sample):
    rows = vectors() + [r for r in ODD if r[0] != 910]
    df = frame(spark, rows)
    got = one_bit_search.nearest(df, df.where("vec_id % 20 = 0"), sample=sample)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert Counter((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in got.collect()) == nearest(rows, 10, 20)


def test_neighbours_of_few_rows(spark):
    few = [(0, [1.0, 2.0], 0), (20, [1.0, 2.0], 0), (5, [1.0, 3.0], 0)]
    df = frame(spark, few)
    got = sorted(map(tuple, one_bit_search.nearest(df, df.where("vec_id % 20 = 0")).collect()))
    assert got == [(0, 1, 20, 0.0), (0, 2, 5, 1.0), (20, 1, 0, 0.0), (20, 2, 5, 1.0)]
    assert one_bit_search.nearest(df.limit(0), df.limit(0)).count() == 0
    assert one_bit_search.nearest(df, df.limit(0)).count() == 0


@pytest.mark.parametrize("width", [3, 64, 200])
def test_bounds_hold_and_pass_rows_over(width):
    r = np.random.default_rng(width)
    x, q = r.standard_normal((4000, width)).astype(np.float32), r.standard_normal((50, width))
    centre, turn = x.mean(0).astype(np.float64), one_bit_search.rotation(width, 1)
    assert np.allclose(turn @ turn.T, np.eye(width))
    turned = (q - centre) @ turn
    length = np.sqrt((turned**2).sum(1))
    least = one_bit_search.Codes(x, centre, turn, 3.5).least(slice(0, 4000), (turned / length[:, None]).astype(np.float32), length)
    far = ((q[:, None] - x[None]) ** 2).sum(2)
    assert (least > far).mean() < 5e-4  # the chance that a bound fails
    if width == 64:
        assert (least <= np.partition(far, 9, axis=1)[:, 9:10]).mean() < 0.5  # even of vectors without any structure


def test_recall_where_neighbours_are_far(spark):
    r = np.random.default_rng(5)
    rows = [(i, [float(v) for v in x], 0) for i, x in enumerate(r.standard_normal((2000, 16)).astype(np.float32))]
    df = frame(spark, rows)
    got = {(r.query_id, r.vec_id) for r in one_bit_search.nearest(df, df.where("vec_id % 20 = 0")).collect()}
    wanted = {(q, i) for q, _, i, _ in nearest(rows, 10, 20)}
    assert len(got & wanted) >= 0.999 * len(wanted)


def codes(rows, entries=16, rounds=6):
    """Codes in Python's integers, by the definition."""
    kept = sorted(((float("inf") if i is None else i, [math.floor(4096 * x) for x in v], i, label) for i, v, label, *_ in rows if finite(v) and max(map(abs, v)) < 2**60), key=lambda r: r[:2])
    w = len(kept[0][1]) // 8
    cut = [[v[p * w : p * w + w] for p in range(8)] for _, v, *_ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(8)]

    def best(a, book):
        return min((sum((x - y) ** 2 for x, y in zip(a, e, strict=True)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(8):
            own = defaultdict(list)
            for c in cut:
                own[best(c[p], books[p])[1]].append(c[p])
            for i, parts in own.items():
                books[p][i] = [sum(x) // len(parts) for x in zip(*parts, strict=True)]
    found = [[best(c[p], books[p]) for p in range(8)] for c in cut]
    by_label = Counter()
    for (*_, label), f in zip(kept, found, strict=True):
        by_label[label] += sum(d for d, _ in f)
    return Counter((i, "".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f), by_label[label]) for (*_, i, label), f in zip(kept, found, strict=True)), books


@pytest.mark.parametrize("rows", [vectors() + ODD, vectors(9), [(i, [float(np.float32(x * 3e4)) for x in v], n) for i, v, n in vectors(40)]], ids=["odd", "few", "wide"])
def test_codes_are_those_of_the_definition(spark, rows):
    df = frame(spark, rows)
    got = vector_codes.compressed(df)
    assert got.columns == ["row", "code", "error", "codebooks_sha256"] and "score" in got.select("row.*").columns
    wanted, books = codes(rows)
    kept = vector_codes.with_label_errors(got.select("row.vec_id", "row.label", "code", "error", "codebooks_sha256"))
    found = kept.collect()
    assert Counter((r.vec_id, r.code, r.error, r.label_error) for r in found) == wanted
    assert {r.codebooks_sha256 for r in found} == {vector_codes.Codebooks(tuple(tuple(map(tuple, b)) for b in books)).digest}


def test_codes_of_no_rows(spark):
    none = vector_codes.compressed(frame(spark, [(1, None, 1)]))
    assert none.count() == 0 and none.columns == ["row", "code", "error", "codebooks_sha256"]


@pytest.mark.parametrize("most", [1, 100, 5000, 1 << 22, 1 << 26, 1 << 31, 1 << 40])
@pytest.mark.parametrize("width", [1, 8, 33])
def test_screened_entries_are_the_nearest(most, width):
    r = np.random.default_rng(most % 1000 + width)
    a = r.integers(-most, most + 1, (400, width))
    c = np.concatenate([r.integers(-most, most + 1, (8, width)), a[:4], a[:4], a[4:5] + 1, a[4:5] - 1])
    if most >= 1 << 29:
        a = a.astype(object)
    index, far = vector_codes.nearest_entry(a, c)
    every = ((a.astype(object)[:, None] - c.astype(object)[None]) ** 2).sum(2)
    wanted = [min(range(len(c)), key=lambda i, row=row: (row[i], i)) for row in every]
    assert list(index) == wanted and [int(d) for d in far] == [every[i][w] for i, w in enumerate(wanted)]


def audit(rows, least=3, most=200):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for text, lang, source in rows]
    out = set()
    for lang in {x for x, _, _ in docs}:
        own = [(s, w) for x, s, w in docs if x == lang]
        df = Counter(t for _, w in own for t in set(w))
        kept = [t for t, n in df.items() if n >= least]
        sources = sorted({s for s, _ in own})
        count = {s: Counter(t for x, w in own if x == s for t in w) for s in sources}
        whole = Counter(t for _, w in own for t in w)

        def p(c, kept=kept):
            n = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (c[t] + 1) // n for t in kept}

        each, q = {s: p(count[s]) for s in sources}, p(whole)
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            found = {"pair": [(o, sum(f(each[s][t], each[o][t]) for t in kept)) for o in sources if o != s], "term": [(t, f(each[s][t], q[t])) for t in kept if count[s][t] and each[s][t] > q[t]]}
            for part, items in found.items():
                ranked = sorted(items, key=lambda i: (-i[1], i[0].encode()))
                out |= {(lang, s, part, item, value, rank + 1) for rank, (item, value) in enumerate(ranked) if part == "pair" or rank < most}
    return out


def test_audit_is_that_of_the_definition(spark):
    rows = [(r[1], r[2], r[3]) for r in fixtures.rows(30) + fixtures.ODD] + [("Ä ä É_É x1y X", "fr", None)] * 3 + [(f"word{'abc'[i % 3]} é", "fr", f"t{i % 5}") for i in range(9)] + [(None, "xx", "a"), ("", "xx", "b")]
    df = spark.createDataFrame(rows, "text string, lang string, source string").selectExpr("*", "1 AS value", "'x' AS term", "'x' AS count", "2 AS rank")
    got = source_audit.audited(df.repartition(3))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    found = {tuple(r) for r in got.collect()}
    assert found == audit(rows) and len(found) == got.count()
    assert {(r[1], r[3], r[4]) for r in found if r[0] == "xx"} == {("a", "b", 0), ("b", "a", 0)}


def test_audit_of_counts_sent_in_many_parts(spark):
    rows = [(r[1], r[2], r[3]) for r in fixtures.rows(30)]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    terms = {(r.lang, r.term): r.by_source for r in source_audit.term_counts(df, most_held=1).collect()}
    assert terms == {(r.lang, r.term): r.by_source for r in source_audit.term_counts(df).collect()}
    assert {tuple(r) for r in source_audit.audited(df, most_terms=5).collect()} == audit(rows, most=5)
    assert source_audit.audited(df.limit(0)).count() == 0


@pytest.mark.parametrize("count,whole", [(0, 1), (4, 7), (10**10, 10**10 + 1), (8 * 10**13, 9 * 10**13), (123456789012, 9 * 10**13 - 7)])
def test_shares_are_exact(spark, count, whole):
    assert spark.sql(f"SELECT {source_audit.share(f'{count}L', f'{whole}L')} AS p").first().p == 1 + 10**9 * (count + 1) // whole
