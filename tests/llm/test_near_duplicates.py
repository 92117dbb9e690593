import random

import numpy as np
import pyarrow as pa
import pytest

from ravelin.llm import near_duplicates as N
from ravelin.llm import vectext as V
from ravelin.llm.components import components
from tests.llm import fixtures


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def test_banded_alignment_is_the_edit_distance():
    r = random.Random(3)
    pairs = []
    for _ in range(300):
        a = [r.randint(0, 30) for _ in range(r.randint(0, 60))]
        b = list(a) if r.random() < 0.8 else [r.randint(0, 30) for _ in range(r.randint(0, 60))]
        for _ in range(r.randint(0, 14)):
            at = r.randint(0, len(b))
            b[at : at + r.randint(0, 1)] = [r.randint(0, 30)] * r.randint(0, 1)
        pairs.append((np.array(a, np.uint16), np.array(b, np.uint16)))
    got = N.similar(pairs)
    for (a, b), s in zip(pairs, got, strict=True):
        longest = max(len(a), len(b))
        true = longest > 0 and distance(list(a), list(b)) <= np.floor(0.2 * longest + 1e-9)
        assert (s > 0) == true


def edited(text, every, r):
    w = text.split()
    return " ".join("changed" + str(r.random()) if i % every == every // 2 else x for i, x in enumerate(w))


def test_planted_copies(spark):
    r = random.Random(5)
    rows = fixtures.rows(30)
    rows += [(200 + i, rows[0][1], "en", "s", None) for i in range(40)]  # exact copies
    rows += [(300 + i, edited(rows[1][1], 40, r), "en", "s", None) for i in range(40)]  # near copies
    rows += [(400, " ".join(rows[2][1].split()[::-1]), "en", "s", None)]  # the same words, reversed
    got = {x["doc_id"]: x for x in N.near_duplicates(spark.createDataFrame(rows, fixtures.SCHEMA)).collect()}
    assert {got[200 + i]["class_id"] for i in range(40)} == {0}
    assert {got[300 + i]["class_id"] for i in range(40)} == {1}
    assert all(got[i]["class_id"] == i for i in [*range(30), 400])


def test_only_partner_inside_a_large_family(spark):
    r = random.Random(8)
    base = [f"w{r.getrandbits(60)}" for _ in range(100)]
    rows = [(0, " ".join(base[:79]), "en", "s", None), (1, " ".join(base[:90]), "en", "s", None)]  # 0 is near to 1 alone
    for i in range(120):
        at = r.randint(0, 90)
        rows.append((2 + i, " ".join(base[:at] + [f"w{r.getrandbits(60)}" for _ in range(10)] + base[at + 10 :]), "en", "s", None))
    near = {i for i in range(122) if i and distance(rows[0][1].split(), rows[i][1].split()) <= 0.2 * len(rows[i][1].split())}
    assert near == {1} and distance(rows[1][1].split(), rows[2][1].split()) <= 20
    got = N.near_duplicates(spark.createDataFrame(rows, fixtures.SCHEMA)).collect()
    assert {x["class_id"] for x in got} == {0}


def test_large_buckets_are_compared_in_full(spark):
    r = random.Random(9)
    line = " ".join(f"w{r.getrandbits(60)}" for _ in range(30))
    rows = []
    for i in range(300):  # one passage in all; pairs of neighbours are near copies of each other, all others are not
        own = [f"x{r.getrandbits(60)}" for _ in range(20)] if i % 2 == 0 else [*own[:15], *(f"x{r.getrandbits(60)}" for _ in range(5))]
        rows.append((i, line + " " + " ".join(own), "en", "s", None))
    got = N.near_duplicates(spark.createDataFrame(rows, fixtures.SCHEMA)).collect()
    assert all(x["class_id"] == x["doc_id"] // 2 * 2 for x in got)


def test_common_passage_does_not_join(spark):
    line = fixtures.prose(999, 14)
    rows = [(i, line + "\n" + fixtures.prose(1000 + i, 40), "en", "s", None) for i in range(120)]
    got = N.near_duplicates(spark.createDataFrame(rows, fixtures.SCHEMA)).collect()
    assert all(x["class_id"] == x["doc_id"] for x in got)


def test_odd_rows_and_empty_tables(spark):
    docs = fixtures.odd(spark)
    got = N.near_duplicates(docs)
    assert got.where("doc_id in (100, 101, 102)").select("class_id").distinct().count() == 3
    kept = N.deduplicated(docs)
    assert kept.columns == docs.columns
    ids = [x["doc_id"] for x in kept.collect()]
    assert ids.count(104) == 0 and ids.count(3) == 1 and 103 in ids and 100 in ids  # 104 repeats 3
    assert kept.where("key != 'key'").count() == 0
    assert N.near_duplicates(fixtures.empty(spark)).count() == 0
    assert N.deduplicated(fixtures.empty(spark)).count() == 0


def test_unrelated_texts_with_null_or_equal_ids_stay(spark):
    texts = [fixtures.prose(i) for i in range(2000, 2012)]
    rows = [(None if i < 6 else 9, t, "en", "s", None) for i, t in enumerate(texts)]
    rows += [(None, texts[0], "en", "s", None), (9, texts[6], "en", "s", None)]  # repeated rows
    kept = N.deduplicated(spark.createDataFrame(rows, fixtures.SCHEMA)).collect()
    assert sorted(x["text"] for x in kept) == sorted(texts)


def scattered(words, edits, r):
    """``words`` with this many single-word changes, deletions and insertions: the edit similarity is 1 - edits / the longer one's words, or a little more."""
    out = [[w] for w in words]
    for i in r.sample(range(len(words)), edits):
        new = f"z{r.getrandbits(60)}"
        out[i] = r.choice([[], [new], [words[i], new]])
    return [w for x in out for w in x]


def changed(words, edits, r):
    """``words`` with this many of them replaced."""
    out = list(words)
    for i in r.sample(range(len(words)), edits):
        out[i] = f"z{r.getrandbits(60)}"
    return out


@pytest.mark.parametrize("n", [5, 8, 10, 12, 15, 20, 23, 24, 30, 37, 38, 40, 50, 60, 75, 100, 200, 1000])
def test_recall_at_every_length(n):
    r = random.Random(n)
    for share in (0.80, 0.85, 0.90, 0.95):
        edits = int((1 - share) * n + 1e-9)
        if not edits:
            continue
        both = [(a, (changed if i % 2 else scattered)(a, edits, r)) for i in range(150) for a in [[f"w{r.getrandbits(60)}" for _ in range(n)]]]
        both = [(a, b) for a, b in both if edits <= 0.2 * max(len(a), len(b)) + 1e-9]
        entries = []
        for side in zip(*both, strict=True):
            data, off = V.buffers(pa.array([" ".join(w) for w in side]))
            entries.append(N.all_entries(*N._words(data, off)))
        found = ((entries[0] == entries[1]) & (entries[0] != 0)).any(1).mean()
        assert found >= 0.9, (n, share, found)


def test_entries_are_read_back_by_kind():
    r = random.Random(2)
    texts = [" ".join(f"w{r.getrandbits(20)}" for _ in range(n)) for n in (1, 5, 23, 24, 37, 38, 200)]
    every = N.all_entries(*N._words(*V.buffers(pa.array(texts)))).view(np.int64)
    held = N._by_table([[x for x in row if x] for row in every.tolist()], np.array([len(t.split()) for t in texts]))
    assert (held[every != 0] == every[every != 0]).all() and len(np.unique(held[every == 0])) <= len(texts)


def test_classes_of_short_texts_are_those_of_all_pairs(spark):
    r = random.Random(21)
    texts = []
    for _ in range(30):
        base = [f"w{r.getrandbits(30)}" for _ in range(r.randint(1, 40))]
        texts += [changed(base, r.randint(0, len(base) // 8), r) for _ in range(r.choice([1, 2, 5]))]
    texts += [["the", "end"], ["The", "END."], ["end", "the"], ["the"], ["a", "b", "c", "d", "e"], ["a", "b", "x", "d", "e"], ["e", "d", "c", "b", "a"]]
    plain = [[w.strip(".").lower() for w in t] for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(plain):
        for j in range(i):
            if distance(a, plain[j]) <= 0.2 * max(len(a), len(plain[j])) + 1e-9:
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    got = {x["doc_id"]: x["class_id"] for x in N.near_duplicates(spark.createDataFrame([(i, " ".join(t), "en", "s", None) for i, t in enumerate(texts)], fixtures.SCHEMA)).collect()}
    assert got == {i: find(i) for i in range(len(texts))}


def test_recall_against_all_pairs(spark):
    r = random.Random(12)
    pairs = {}
    for share in (80, 85, 90, 95):
        for i in range(60):
            a = [f"w{r.getrandbits(60)}" for _ in range(100)]
            pairs[share * 1000 + 2 * i] = (a, scattered(a, 100 - share, r))
    rows = [(k + j, " ".join(w), "en", "s", None) for k, both in pairs.items() for j, w in enumerate(both)]
    got = {x["doc_id"]: x["class_id"] for x in N.near_duplicates(spark.createDataFrame(rows, fixtures.SCHEMA)).collect()}
    for share in (80, 85, 90, 95):  # texts of different pairs share no word, so these are all pairs there are
        links = [k for k, (a, b) in pairs.items() if k // 1000 == share and distance(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9]
        found = sum(got[k] == got[k + 1] for k in links)
        assert len(links) >= 20 and found >= 0.9 * len(links), (share, found, len(links))
    assert all(got[k] == k for k in pairs)


def test_classes_are_those_of_all_pairs(spark):
    r = random.Random(13)
    texts = []
    for family in range(12):
        base = [f"w{r.getrandbits(30)}" for _ in range(60)]
        texts += [scattered(base, r.randint(0, 5), r) for _ in range(r.choice([1, 2, 3, 40]))]
    r.shuffle(texts)
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(texts):
        for j in range(i):
            if set(a) & set(texts[j]) and distance(a, texts[j]) <= 0.2 * max(len(a), len(texts[j])) + 1e-9:
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    rows = [(i, " ".join(t), "en", "s", None) for i, t in enumerate(texts)]
    got = {x["doc_id"]: x["class_id"] for x in N.near_duplicates(spark.createDataFrame(rows, fixtures.SCHEMA)).collect()}
    assert got == {i: find(i) for i in range(len(texts))}


def test_components_name_classes_where_ids_do_not(spark):
    a, b, c = (fixtures.prose(i) for i in (3000, 3001, 3002))
    for ids in ([None, None, 1], [5, 5, 1]):
        docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in zip(ids, (a, b, c), strict=True)], fixtures.SCHEMA)
        assert len({x["component"] for x in N.near_duplicates(docs).collect()}) == 3
        assert sorted(x["text"] for x in N.deduplicated(docs).collect()) == sorted([a, b, c])
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in ((5, a), (5, b), (6, a), (7, b), (6, a), (None, None), (None, None))], fixtures.SCHEMA)
    got = N.near_duplicates(docs).collect()
    assert len(got) == 7 and sorted(str(x["component"]) for x in got).count("None") == 2
    assert len({x["component"] for x in got}) == 3
    assert sorted((x["doc_id"] or 0, x["text"] or "") for x in N.deduplicated(docs).collect()) == sorted([(5, a), (5, b), (0, ""), (0, "")])


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randint(0, 200), r.randint(0, 200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(5, 5), (None, 1)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in {x for e in edges if None not in e and e[0] != e[1] for x in e}}
