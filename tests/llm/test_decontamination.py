import random
import tracemalloc

import numpy as np
import pyarrow as pa

from ravelin.llm import decontamination as D
from tests.llm import fixtures

ITEMS = [(i, fixtures.prose(5000 + i, 16 + 7 * (i % 8))) for i in range(24)]


def planted(r, item, before, after):
    return fixtures.prose(r.random(), before) + " " + item + " " + fixtures.prose(r.random(), after)


def test_planted_passages(spark):
    r = random.Random(4)
    docs = fixtures.rows(60)
    wanted = set()
    for i, (item, text) in enumerate(ITEMS):
        docs.append((500 + i, planted(r, text, r.randint(0, 300), r.randint(0, 300)), "en", "s", None))
        docs.append((600 + i, planted(r, text.upper().replace(".", " !"), r.randint(0, 50), r.randint(0, 50)), "en", "s", None))
        words = text.split()
        words[len(words) // 2] = "otherwise"  # a paraphrase: one word changed, one added
        words.insert(3, "indeed")
        docs.append((700 + i, planted(r, " ".join(words), 40, 40), "en", "s", None))
        wanted |= {(500 + i, item), (600 + i, item), (700 + i, item)}
    got = {(x["doc_id"], x["item_id"]) for x in D.matched(spark.createDataFrame(docs, fixtures.SCHEMA), spark.createDataFrame(ITEMS, "item_id long, text string")).collect()}
    assert got == wanted


def test_blocks_give_the_same(spark):
    docs = spark.createDataFrame(fixtures.rows(20) + [(900, ITEMS[3][1], "en", "s", None)], fixtures.SCHEMA)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert {(x["doc_id"], x["item_id"]) for x in D.matched(docs, items, block_words=150).collect()} == {(900, 3)}


def test_odd_rows_and_empty_tables(spark):
    docs = fixtures.odd(spark)
    items = spark.createDataFrame([(1, None), (2, ""), (3, "too short"), (4, fixtures.prose(3, 80)), (4, fixtures.prose(3, 80)), (5, fixtures.prose(3, 80))], "item_id long, text string")
    kept = D.clean(docs, items)
    assert kept.columns == docs.columns
    assert {x["doc_id"] for x in docs.collect()} - {x["doc_id"] for x in kept.collect()} == {3, 104}
    assert D.clean(docs, items.where("item_id < 4")).count() == docs.count()
    assert D.matched(fixtures.empty(spark), items).count() == 0


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_all_documents_and_items_by_brute_force(spark):
    r = random.Random(11)
    items = [(i, fixtures.prose(8000 + i, n)) for i, n in enumerate([1, 2, 3, 4, 5, 6, 8, 10, 12, 16, 20, 30, 32, 40, 60] * 2)]
    docs = []
    for i, (_, text) in enumerate(items):
        for k, share in enumerate((0.6, 0.7, 0.8, 1.0)):
            w = text.split()
            kept = set(r.sample(range(len(w)), -(-len(w) * int(share * 100) // 100)))
            new = " ".join(x if j in kept else f"other{r.random()}" for j, x in enumerate(w))
            docs.append((4 * i + k, fixtures.prose(r.random(), r.randint(0, 90)) + " " + new + " " + fixtures.prose(r.random(), r.randint(0, 90)), "en", "s", None))
    words = lambda t: "".join(c if c.isalnum() else " " for c in t.lower()).split()
    seen = {}
    for d in docs:
        for w in words(d[1]):
            seen[w] = seen.get(w, 0) + 1
    wanted = set()
    for i, text in items:
        w = words(text)
        rare = sorted(set(w), key=lambda x: seen.get(x, 0))
        surely = [x for x in rare if seen.get(x, 0) < seen.get(rare[min(len(rare), D.ANSWERS) - 1], 0)]  # of words at the cut, any may be taken
        for d, body, *_ in docs:
            b = words(body)
            if len(w) < D.SHORT:
                if any(b[j : j + len(w)] == w for j in range(len(b))):
                    wanted.add((d, i))
            elif lcs(w, b) >= 0.6 * len(w) and sum(x in b for x in surely) >= 0.6 * D.ANSWERS:
                # within the reach of one passage, as far as any passage reaches
                reach = D.WINDOW + 2 * len(w)
                if any(lcs(w, b[j : j + reach]) >= 0.6 * len(w) and sum(x in b[j : j + reach] for x in surely) >= 0.6 * D.ANSWERS for j in range(0, max(1, len(b) - reach + 1))):
                    wanted.add((d, i))
    got = {(x["doc_id"], x["item_id"]): x["lcs"] for x in D.matched(spark.createDataFrame(docs, fixtures.SCHEMA), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(wanted) > 80 and len(wanted & set(got)) >= 0.95 * len(wanted)
    by_id, by_item = {d[0]: words(d[1]) for d in docs}, dict(items)
    for (d, i), share in got.items():
        w = words(by_item[i])
        assert lcs(w, by_id[d]) >= share * len(w) - 1e-9 and share >= (0.6 if len(w) >= D.SHORT else 1)


def test_recall_in_a_full_block(spark):
    r = random.Random(31)
    words = [f"w{i}" for i in range(20_000)]
    weights = [1 / (i + 10) for i in range(20_000)]
    items = [(i, r.choices(words, weights, k=32)) for i in range(2000)]  # 64,000 words: nearly one block of 65,536
    docs, wanted = [], set()
    for i in range(160):
        own = items[i * 12][1]
        kept = set(r.sample(range(32), 20))
        quote = [w if j in kept else f"other{r.random()}" for j, w in enumerate(own)]
        docs.append((i, " ".join([*r.choices(words, weights, k=r.randint(0, 70)), *quote, *r.choices(words, weights, k=r.randint(0, 70))])))
        wanted.add((i, i * 12))
    docs += [(1000 + i, " ".join(r.choices(words, weights, k=250))) for i in range(500)]
    found = D.matched(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string"), answer=0.0).collect()
    got = {(x["doc_id"], x["item_id"]) for x in found}
    assert len(got & wanted) >= 0.9 * len(wanted), len(got & wanted)
    assert not any(d >= 1000 for d, _ in got)
    assert D.block_of(list(range(2000)), pa.array([" ".join(w) for _, w in items])).rank > 1.9 * D.RANK


def test_terms_that_share_their_low_bits():
    h = np.random.default_rng(2).integers(0, 1 << 63, 5000, dtype=np.uint64) | np.uint64(0)
    h[:50] = (h[:50] >> np.uint64(40) << np.uint64(40)) + np.uint64(7)
    b = D.Block([0], [np.arange(5000)], np.unique(h))
    assert (b.numbers(b.terms) == np.arange(len(b.terms))).all()
    assert (b.numbers(np.random.default_rng(3).integers(1 << 63, (1 << 64) - 1, 5000, dtype=np.uint64)) == -1).all()


def test_latent_space_has_the_singular_vectors():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(300, 12)) @ np.diag(np.arange(12, 0, -1)) @ np.linalg.qr(rng.normal(size=(12, 12)))[0]
    test = rng.standard_normal((12, 12))
    v = D.latent(a.T @ a @ test, test)
    _, s, w = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(np.abs(np.sum(v[:, :5] * w.T[:, :5], axis=0)), 1, atol=1e-6)


def test_common_length():
    r = random.Random(1)
    for _ in range(200):
        a, b = ([r.randint(-1, 6) for _ in range(r.randint(0, 20))] for _ in range(2))
        assert D.common_length(np.array(a, int), np.array(b, int)) == lcs(a, b)


def test_sums_of_segments():
    rng = np.random.default_rng(3)
    rows = rng.integers(-50, 50, (300, 7)).astype(np.float32)
    for lengths in ([1], [200], [3, 1, 90, 2, 2, 33, 32, 31], rng.integers(1, 40, 60)):
        of = np.repeat(np.arange(len(lengths)) * 2 + 1, lengths)
        at = rng.integers(0, 300, len(of))
        segments, sums = D.segment_sums(rows, at, of)
        assert sorted(segments.tolist()) == np.unique(of).tolist()
        assert all((x == rows[at[of == i]].sum(axis=0)).all() for i, x in zip(segments, sums, strict=True))


def test_answer_words_of_a_long_text():
    rng = np.random.default_rng(4)
    items = [rng.choice(2000, 30, replace=False) for _ in range(150)]
    wanted = D.Answers.of(items, rng.random(2000), 0.6)
    numbers = rng.integers(-1, 2000, 320_000)
    half = np.arange(len(numbers)) // D.STEP
    which, lo = rng.integers(0, 150, 400), rng.integers(0, 19_900, 400)
    hi = lo + rng.integers(1, 90, 400)
    tracemalloc.start()
    got = wanted.there(numbers, half, 20_000, which, lo, hi)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 16 << 20  # a table of all halves and answer words would have more
    for i, a, b, there in zip(which, lo, hi, got, strict=True):
        around = set(wanted.number[numbers[a * D.STEP : b * D.STEP][numbers[a * D.STEP : b * D.STEP] >= 0]].tolist()) - {-1}
        assert there == (len(around & set(wanted.place[i].tolist())) >= wanted.needed[i])
    assert 0 < got.sum() < 400
