import re
from collections import defaultdict

import pytest

import corpus_pipeline
from ravelin.llm import decontamination, mixture, near_duplicates, quality_ranker
from tests.conftest import DATA
from tests.llm import fixtures


def filled(sizes, weights=(5, 2, 1), most=3.0):
    """Targets by the rounds of the definition: share by weight, cut at the limit, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    fixed, left = {}, set(names)
    while left:
        rest = sum(sizes.values()) - sum(fixed.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = {s for s in left if share[s] > most * sizes[s]}
        if not over:
            return fixed | share
        fixed |= {s: most * sizes[s] for s in over}
        left -= over
    return fixed


def test_mix_takes_the_targets(spark):
    docs = fixtures.odd(spark)
    got = mixture.mixed(docs).collect()
    size = defaultdict(int)
    for r in docs.collect():
        size[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    wanted = filled(size)
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == size[r["source"]] and abs(r["target"] - wanted[r["source"]]) < 1e-6
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert len(got) == docs.count() and all(taken[s] == int(wanted[s] + 1e-9) for s in size)
    assert sorted(map(str, got)) == sorted(map(str, mixture.mixed(docs.repartition(3)).collect()))


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1, "c": 1000}, {"a": 0, "b": 0}, {"a": 5}, {None: 7, "a": 1, "b": 100, "c": 3, "d": 900}])
def test_targets(spark, sizes):
    got = {r["source"]: r["target"] for r in mixture.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    assert all(abs(got[s] - t) < 1e-6 for s, t in filled(sizes).items())


def test_repeated_rows(spark):
    docs = fixtures.odd(spark)
    out = mixture.repeated(docs)
    assert out.columns == docs.columns
    sizes = {r["source"]: r["target"] for r in mixture.mixed(docs).collect()}
    words = defaultdict(int)
    for r in out.collect():
        words[r["source"]] += len((r["text"] or "").split())
    assert all(abs(words[s] - t) <= 90 or s == "s1" for s, t in sizes.items() if s)
    assert mixture.repeated(fixtures.empty(spark)).count() == 0 and mixture.mixed(fixtures.empty(spark)).count() == 0


def test_stages(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "decontamination", "mixture", "token_files"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    columns = docs.columns

    kept = corpus_pipeline.quality(spark, docs, DATA).cache()
    ranker = quality_ranker.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    wanted = {r["doc_id"] for r in quality_ranker.scored(docs, ranker).where("quality_score >= 0.3").collect()}
    ids = {r["doc_id"] for r in kept.collect()}
    assert kept.columns == columns and ids == wanted
    assert sum((i in ids) == (q == 1) for i, q in labels.items()) >= 0.95 * len(labels)

    unique = corpus_pipeline.dedup(spark, kept, DATA).cache()
    classes = near_duplicates.near_duplicates(kept).select("class_id").distinct().count()
    assert unique.columns == columns and unique.count() == classes

    clean = corpus_pipeline.decontaminate(spark, unique, DATA).cache()
    bench = [r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    exact = {r["doc_id"] for r in unique.collect() if any(b in r["text"] for b in bench)}
    gone = {r["doc_id"] for r in unique.collect()} - {r["doc_id"] for r in clean.collect()}
    assert exact <= gone and len(gone) <= len(exact) + 2
    assert gone == {r["doc_id"] for r in decontamination.matched(unique, spark.read.parquet(f"{DATA}/benchmark.parquet")).collect()}

    mixed = corpus_pipeline.mix(spark, clean, DATA).cache()
    assert mixed.columns == columns and {r["doc_id"] for r in mixed.collect()} <= {r["doc_id"] for r in clean.collect()}
    out = corpus_pipeline.tokens(spark, mixed, DATA).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(r["doc_id"] for r in mixed.collect())


@pytest.fixture
def tables(spark, tmp_path):
    """A folder with odd documents and one with none, labels and a benchmark beside them."""
    out = []
    for name, docs in (("odd", fixtures.odd(spark)), ("empty", fixtures.empty(spark))):
        folder = f"{tmp_path}/{name}"
        docs.coalesce(2).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(i, 1, 0) for i in range(12)] + [(102, 0, 0), (105, 0, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(1, fixtures.prose(5)), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        out.append(folder)
    return out


def test_all_stages_on_odd_rows_and_empty_tables(spark, tables):
    for folder in tables:
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        columns, before = docs.columns, docs.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, folder)
            docs.write.parquet(f"{folder}/{name}.parquet")
            docs = spark.read.parquet(f"{folder}/{name}.parquet")
            assert docs.columns == columns and (name == "mixture" or docs.count() <= before)
            before = docs.count()
        wanted = sorted(str(r["doc_id"]) for r in docs.collect())
        got = corpus_pipeline.tokens(spark, docs, folder).collect()
        assert sorted(str(r["doc_id"]) for r in got) == wanted
        assert sorted(str(r["doc_id"]) for r in corpus_pipeline.run(spark, folder).collect()) == wanted
        if folder.endswith("odd"):
            assert "5" not in wanted and wanted.count("104") == 0 and len(wanted) >= 8
        else:
            assert wanted == []


def test_ties_at_the_cut_are_in_the_order_of_their_texts(spark):
    rows = [(1, f"{c} {c} {c}", "en", "a", None) for c in "bcdefgh"] + [(2, "x " * 500, "en", "b", None)]
    docs = spark.createDataFrame(rows, fixtures.SCHEMA)
    once = sorted(map(str, mixture.repeated(docs).collect()))
    for n in (1, 3, 7):
        assert sorted(map(str, mixture.repeated(docs.repartition(n)).collect())) == once
