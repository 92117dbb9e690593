import random
import re
from collections import Counter

import numpy as np

from ravelin.llm import divergence_rules as R
from ravelin.llm import lm_scoring as M
from tests.llm import fixtures

TEXTS = [None, "", "a b c a b c", "x\nx\n \n y \ny\nx", "#*$%&|<> é😀", "a a a a", "the line\nthe line\n", "\n\n", "a\r\nb\r\nb\r\n", *(fixtures.prose(i) for i in range(6)), "one two three " * 40]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + k for i, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if windows[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n)


def test_counts_are_those_of_a_plain_scan(spark):
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string")
    for r in R.judged(docs, R.references(docs)).collect():
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == brute(r["text"])
        assert not (r["kept"] and r["base_failed"])


def test_distance(spark):
    p = np.array([[1.0, 0.0], [0.5, 0.5]])
    assert np.allclose(R.divergence(p, np.array([0.0, 1.0])), [1, np.sqrt(0.311278124459)])
    junk = (1000, " ".join("%%% ### $$$ &&&".split() * 1 + [f"{i}%%%$$$###" for i in range(90)]), "en", "s", None)
    docs = spark.createDataFrame([*fixtures.rows(40), junk], fixtures.SCHEMA)
    got = {r["doc_id"]: r["kept"] for r in R.judged(docs, R.references(docs)).collect()}
    assert not got[1000] and all(got[i] for i in range(40))


def test_every_language_has_references(spark):
    rows = []
    for i in range(70):  # each language has words of its own
        r = random.Random(i)
        words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(80)]
        rows += [(2 * i + k, " ".join(r.sample(words, 80)), None if i == 69 else f"l{i:02}") for k in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    refs = R.references(docs)
    assert len(refs.languages) == 70 and None in refs.languages
    assert all(r["kept"] for r in R.judged(docs, refs).collect())


def test_a_few_documents_of_junk_set_no_norm_of_their_own(spark):
    r = random.Random(9)
    junk = lambda: " ".join("".join(r.choice("ABCDEFGHXYZ0123456789#$%&*|<>") for _ in range(7)) for _ in range(400))
    script = ["".join(chr(0x4E00 + r.randrange(60)) for _ in range(3)) for _ in range(50)]
    rows = [(i, fixtures.prose(i, 120), "en" if i % 2 else "de") for i in range(300)]
    rows += [(1000 + i, junk(), ("zz", "en", None)[i % 3]) for i in range(9)]
    rows += [(2000 + i, " ".join(r.choices(script, k=120)), "zh") for i in range(20)]
    rows += [(3000 + i, " ".join(r.choices(fixtures.WORDS[::-1], k=120)), "new") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x["doc_id"]: x["kept"] for x in R.judged(docs, R.references(docs)).collect()}
    assert {i for i, kept in got.items() if not kept} == set(range(1000, 1009))


def plain_distance(p, q):
    m = [(x + y) / 2 for x, y in zip(p, q, strict=True)]
    kl = lambda a: sum(x * np.log2(x / y) for x, y in zip(a, m, strict=True) if x > 0)
    return np.sqrt(max((kl(p) + kl(q)) / 2, 0))


def plain_rules(rows, common=200, trim=0.18, prior=1.0):
    """{doc_id: (class distance, word distance)} by the definitions, a text at a time."""
    groups = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t\r\v\f", "\n", ".,;:?", "!'\"()-_/\\[]{}@^~`=+", "#*$%&|<>"]
    kind = lambda c: next((i for i, g in enumerate(groups) if c in g), 8 if ord(c) < 128 else 9)
    histogram = lambda t: [sum(kind(c) == k for c in t) / max(len(t), 1) for k in range(10)]
    words = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower())
    texts = [(i, t or "", lang) for i, t, lang in rows]
    langs = sorted({lang for _, t, lang in texts if t}, key=str)
    mean = lambda x: [sum(c) / len(x) for c in zip(*x, strict=True)]
    norm = lambda x: [y / max(sum(x), 1e-12) for y in x]


    def by_lang(some):
        """The mean histogram of each language's texts and of ``prior`` texts like all of them."""
        whole = [histogram(t) for t, _ in some]
        sums = [[sum(c) for c in zip(*[h for h, (_, of) in zip(whole, some, strict=True) if of == lang], strict=True)] for lang in langs]
        return [norm([x + prior * y for x, y in zip(own, mean(whole), strict=True)]) for own in sums]

    rough = by_lang([(t, of) for _, t, of in texts if t])
    good = [(t, of) for _, t, of in texts if t and min(plain_distance(histogram(t), c) for c in rough) <= trim]
    langs = [x for x in langs if any(of == x for _, of in good)]
    classes = by_lang(good)
    shares = []
    for lang in langs:
        own, total = [words(t) for t, of in good if of == lang], Counter()
        for w in own:
            for x, n in Counter(w).items():
                total[x] += n / len(w) / len(own)
        assert len(total) <= common or sorted(total.values())[-common] > sorted(total.values())[-common - 1] + 1e-12  # no tie at the cut
        shares.append(dict(total.most_common(common)))
    out = {}
    for i, t, _ in texts:
        w, far = Counter(words(t)), []
        for s in shares:
            p = [w[x] / max(sum(w.values()), 1) for x in s]
            rest = (sum(w.values()) - sum(w[x] for x in s)) / max(sum(w.values()), 1)
            far.append(plain_distance([*p, rest], [*s.values(), max(1 - sum(s.values()), 0)]))
        out[i] = (min(plain_distance(histogram(t), c) for c in classes), min(far))
    return out


def test_distances_and_kept_are_those_of_a_plain_scan(spark):
    r = random.Random(2)
    rows = [(i, fixtures.prose(i, r.randint(5, 120)), "de" if i % 3 else None) for i in range(25)]
    rows += [(100, None, "de"), (101, "", "de"), (102, "%%% ###\n" * 40, "de"), (103, "ÀÉ é 😀 " * 60, None), (104, "xq zw " * 30 + fixtures.prose(7, 20), "de"), (105, rows[0][1], "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    common = 12
    refs = R.references(docs, common=common)
    wanted = plain_rules(rows, common)
    for x in R.judged(docs, refs).collect():
        c, w = wanted[x["doc_id"]]
        assert np.isclose(x["class_distance"], c) and np.isclose(x["word_distance"], w)
        far = (c > 0.195 and len(x["text"] or "") >= 200) or (w > 0.6 and x["n_words"] >= 50)
        assert x["kept"] == (not brute(x["text"])[5] and not far)


def test_rules_on_odd_rows(spark):
    docs = fixtures.odd(spark)
    assert R.judged(docs, R.references(docs)).count() == docs.count()
    assert R.judged(docs, R.references(fixtures.empty(spark))).count() == docs.count()
    assert R.references(fixtures.empty(spark)).languages == []


def plain_losses(rows, kept, prior=100.0):
    """(target, background) loss of each row (doc_id, text, target), by counting all other rows for each."""
    texts = {i: (t or "").lower().split() for i, (_, t, _) in enumerate(rows)}
    every = Counter(w for t in texts.values() for w in t)
    top = [w for w, _ in every.most_common(kept)]
    assert len(every) == kept or every.most_common(kept)[-1][1] > every.most_common(kept + 1)[-1][1]  # no tie at the cut
    top, others = set(top), len(every) - len(top)
    out = {}
    for i in texts:
        both = []
        for of in ([j for j in texts if rows[j][2]], list(texts)):
            one, n = Counter(w for j in of for w in texts[j]), sum(len(texts[j]) for j in of)
            share = {w: (one[w] + 1) / (n + len(top) + 1) for w in top}
            rest = 1 - sum(share.values())
            if not others:
                share = {w: p / (1 - rest) for w, p in share.items()}
            two, follows = Counter(), Counter()
            for j in of:
                if j != i:
                    for v, w in zip([None, *texts[j]], texts[j], strict=False):
                        if w in top and (v is None or v in top):
                            two[v, w] += 1
                            follows[v] += 1
            p = lambda v, w: ((two[v, w] if w in top and (v is None or v in top) else 0) + prior * share.get(w, rest / max(others, 1))) / ((follows[v] if v is None or v in top else 0) + prior)  # noqa: E731, B023
            for v in [None, *list(every)[:5]]:  # a probability model: all words that may follow add up to 1
                assert np.isclose(sum(p(v, w) for w in every), 1)
            both.append(-sum(np.log(p(v, w)) for v, w in zip([None, *texts[i]], texts[i], strict=False)) / max(len(texts[i]), 1))
        out[i] = tuple(both)
    return out


def test_losses_are_those_of_plain_counts(spark):
    r = random.Random(3)
    words = ["a", "b", "c", *(f"w{i}" for i in range(40))]
    texts = [" ".join(r.choices(words, [30, 20, 12, *([1] * 40)], k=r.randint(1, 60))) for _ in range(25)]
    rows = [(i, t, i % 3 == 0) for i, t in enumerate(texts)] + [(100, "", True), (101, None, False), (102, texts[0], False), (103, "a a a a b a", True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, target boolean")
    counts = sorted(Counter(w for _, t, _ in rows for w in (t or "").split()).values(), reverse=True)
    cut = next(k for k in range(8, 30) if counts[k - 1] > counts[k])
    for kept in (cut, len(counts)):
        wanted = plain_losses(rows, kept)
        for head in (2, 2048):  # most bigrams through the shuffle, then most through the head
            shared = M.vocabulary(docs, vocabulary=kept)
            got = {x["doc_id"]: x for x in M.scored(docs, shared, M.counted(docs, shared, head=head)).collect()}
            assert len(got) == len(rows)
            for i, (doc, text, _) in enumerate(rows):
                assert np.isclose(got[doc]["target_loss"], wanted[i][0]) and np.isclose(got[doc]["background_loss"], wanted[i][1])
                assert got[doc]["n_tokens"] == len((text or "").split()) and got[doc]["background_loss"] >= 0


def test_bigrams_are_exact_however_many(spark):
    r = random.Random(6)
    words = [f"w{i}" for i in range(3000)]
    rows = [(i, " ".join(r.choices(words, k=2000)), i == 0) for i in range(40)]  # some 80,000 different bigrams, nearly all of them once
    rows.append((40, rows[5][1], False))
    got = {x["doc_id"]: x for x in M.loss_difference(spark.createDataFrame(rows, "doc_id long, text string, target boolean").drop("target"), spark.createDataFrame([(0,)], "doc_id long")).collect()}
    alone = [got[i]["background_loss"] for i in range(40) if i != 5]
    assert min(alone) > 7.5 and max(got[5]["background_loss"], got[40]["background_loss"]) < 5.5  # a copy is seen, a document itself is not
    assert abs(got[0]["target_loss"] - np.log(3000)) < 0.5  # the only target document is no stranger to its words and does not know itself by heart


def test_losses_on_odd_rows(spark):
    docs = fixtures.odd(spark)
    targets = spark.createDataFrame([(i,) for i in (0, 1, 104, None, 104, 999)], "doc_id long")
    got = M.loss_difference(docs.select("doc_id", "text"), targets).collect()
    ids = sorted((x["doc_id"] is None, x["doc_id"]) for x in got)
    assert ids == sorted((x["doc_id"] is None, x["doc_id"]) for x in docs.select("doc_id").collect())
    by = {}
    for x in got:
        by.setdefault(x["doc_id"], set()).add((x["n_tokens"], x["target_loss"], x["background_loss"]))
    assert len(by[104]) == 1  # equal rows, equal scores
    assert by[100] == by[101] == by[102] == {(0, 0.0, 0.0)}
    assert all(x["background_loss"] >= 0 and np.isfinite(x["loss_difference"]) for x in got)
    assert M.loss_difference(docs.select("doc_id", "text"), targets.where("doc_id < 0")).count() == docs.count()
    assert M.loss_difference(fixtures.empty(spark).select("doc_id", "text"), targets).count() == 0
    named = docs.withColumnRenamed("source", "target").withColumn("every", docs.score)
    assert M.marked(named.select("doc_id", "text"), targets).columns == ["doc_id", "text", "target"]
