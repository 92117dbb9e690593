"""The JSON-lines source, inline parts, merged objects, splices, sinks that are run twice, snapshots and deadlines."""

import json
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ravelin.operators import inline, objects
from ravelin.sources import jsonlines
from ravelin.streaming import sinks

# --- JSON lines


@pytest.mark.parametrize("split", [1, 7, 64, 1 << 20])
def test_every_line_is_read_once_wherever_files_are_cut(spark, tmp_path, split):
    files = {"a.json": b"one\ntwo\r\n\nthree", "b.json": b"\n\n", "c.json": b"", "sub/d.json": "ä€😀\n".encode() * 3 + b"x" * 200 + b"\n", "_hidden": b"no\n", ".crc": b"no\n"}
    for name, content in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    got = Counter((r["file"].rsplit("/", 1)[-1], r["at"], r["line"]) for r in jsonlines.lines(spark, str(tmp_path), split_bytes=split).collect())
    wanted = Counter()
    for name, content in files.items():
        at = 0
        for line in content.splitlines(keepends=True) if not name.startswith(("_", ".")) else ():
            wanted[name.rsplit("/", 1)[-1], at, line.decode().rstrip("\r\n")] += 1
            at += len(line)
    assert got == wanted
    assert jsonlines.lines(spark, f"file:{tmp_path}/a.json", split_bytes=split).count() == 4


def test_a_folder_without_lines(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert jsonlines.lines(spark, str(tmp_path / "none")).count() == 0 and jsonlines.lines(spark, str(tmp_path / "not there")).count() == 0


def test_lines_that_break_the_schema_are_error_rows(spark):
    lines = ['{"query": "q", "hops": 3, "active_docs": ["a"], "chat_history": [{"human": "h", "ai": "a"}]}', '{"query": "q"}', '{"query": null, "hops": null}', '{"hops": 1}', '{"query": 5}', '{"query": "q", "hops": "3"}', '{"query": "q", "hops": 3.5}', '{"query": "q", "hops": 99999999999}', '{"query": "q", "active_docs": {}}', "[]", '"x"', "null", "{", "nothing", " ", '{"query": "q", "more": [1]}']
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string")
    got = {r["i"]: r for r in jsonlines.checked(rows, "query_request", required=("query",)).collect()}
    assert {i: r["error"] for i, r in got.items()} == {
        0: None, 1: None, 2: "missing query", 3: "missing query", 4: "type query", 5: "type hops", 6: "type hops", 7: "type hops", 8: "type active_docs", 9: "not an object", 10: "not an object", 11: "not an object", 12: "malformed", 13: "malformed", 15: None,
    }
    assert (got[0]["hops"], got[0]["top_k"], got[0]["active_docs"], got[0]["chat_history"][0]["ai"]) == (3, 4, ["a"], "a")
    assert (got[1]["hops"], got[1]["mode"], got[5]["query"]) == (2, "fast", None)
    assert jsonlines.checked(rows.limit(0), "query_request").count() == 0


def test_a_stream_reads_each_whole_line_once_over_a_restart(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a").write_text("1\n2\n3")  # the third line is not whole yet

    def run():
        q = jsonlines.lines(spark, str(folder), stream=True, split_bytes=2).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(120) and q.exception() is None
        return sorted(r["line"] for r in spark.read.schema(jsonlines.SCHEMA).parquet(str(tmp_path / "out")).collect())

    assert run() == ["1", "2"]
    with (folder / "a").open("a") as f:
        f.write("3\n4\n")
    (folder / "b").write_text("5\n6")
    assert run() == ["1", "2", "33", "4", "5"]
    assert run() == ["1", "2", "33", "4", "5"]


# --- inline parts


def tokens(text):
    """Parts by trying every end for every beginning, the way the rules are told."""
    out, plain, at = [], "", 0

    def whole(s):
        for mark, kind in (("`", "code"), ("***", "bold italic"), ("**", "bold"), ("__", "bold"), ("*", "italic"), ("_", "italic")):
            inner = s[len(mark) : -len(mark)]
            if len(s) > 2 * len(mark) and s == mark + inner + mark and mark[0] not in inner and not (kind == "italic" and "\n" in inner):
                return [(kind, inner, None)]
        if re.fullmatch(r"\[[0-9]+(\s*,\s*[0-9]+)*\]", s):
            return [("citation", n.strip(), None) for n in s[1:-1].split(",")]
        link = re.fullmatch(r"(?s)\[([^\]]+)\]\(((https?:/)?/[^\s)]+)\)", s)
        return [("link", link[1], link[2])] if link and (link[3] is None or link[2].split("//", 1)[1:] != [""]) else []

    while at < len(text):
        found = next(((whole(text[at:e]), e) for e in range(at + 2, len(text) + 1) if whole(text[at:e])), None) if text[at] in "`*_[" else None
        if found:
            out += [("text", plain, None)] * bool(plain) + found[0]
            plain, at = "", found[1]
        else:
            plain, at = plain + text[at], at + 1
    return out + [("text", plain, None)] * bool(plain)


def tree(text, parent=None, depth=0, place=None):
    place = place if place is not None else [0]
    for kind, content, address in tokens(text):
        own, place[0] = place[0], place[0] + 1
        yield own, parent, depth, kind, content, address
        if kind == "bold":
            yield from tree(content, own, depth + 1, place)


def marked(seed, n=18):
    r = random.Random(seed)
    return "".join(r.choice(["a", "b ", "`", "*", "**", "***", "_", "__", "[", "]", "[1]", "[2, 3]", "[l](/p)", "(", ")", "https://x", "\n", ","]) for _ in range(n))


def test_parts_are_those_of_the_rules():
    for seed in range(3000):
        text = marked(seed)
        assert list(inline.nested(text)) == list(tree(text)), text


def test_parts_as_rows(spark):
    texts = ["**a __b [1, 22] `c`__ d** e", None, "", "plain", "*x*" * 300, *(marked(s, 60) for s in range(40))]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, line string").repartition(3)
    got = Counter(map(tuple, inline.inline_rows(df).drop("line").collect()))
    assert got == Counter((i, *row) for i, t in enumerate(texts) for row in tree(t or ""))
    nested = {r["content"]: (r["depth"], r["parent"]) for r in inline.inline_rows(df.where("i = 0")).collect()}
    assert nested["22"] == (2, 2) and nested["b [1, 22] `c`"] == (1, 0) and nested[" e"] == (0, None)


def test_inline_parts_are_counted_where_they_are(spark):
    rows = [(1, "a `b` a `b` **c [2]**"), (2, "`b` x"), (2, "x `b`"), (None, "[1]"), (None, "[1] y"), (3, ""), (4, None), (5, "a `b`")]
    df = spark.createDataFrame(rows, "k long, line string").repartition(3)
    counts = inline.inline_counts(df, "k")
    wanted = Counter((k, *part[2:]) for k, line in rows for part in inline.nested(line or ""))
    got = [tuple(r) for r in counts.collect()]
    assert len(got) == len(wanted) and {r[:-1]: r[-1] for r in got} == dict(wanted)
    assert inline.inline_counts(df.limit(0), "k").count() == 0
    # of keys with one line no part goes through a shuffle: those that are moved come from the semi-join alone
    plan = str(inline.inline_counts(df.where("k in (1, 3, 5)"), "k")._jdf.queryExecution().executedPlan())
    assert plan.count("hashpartitioning(k") == 1 and plan.index("LeftAnti") < plan.index("hashpartitioning(k") < plan.index("LeftSemi")


# --- objects and lists


def test_objects_merge_by_names(spark):
    r = random.Random(1)
    value = lambda: r.choice([1, "x", None, True, [1, {"a": None}], {"deep": {"n": 2.5}}, "ä\"'\n"])
    rows = [(None if i % 9 == 0 else i % 4, i, r.choice(["[]", "5", "nope", None, '"s"']) if i % 6 == 0 else json.dumps({r.choice(["a", "b", "a.b", "ü", "q\"z", ""]): value() for _ in range(r.randint(0, 3))})) for i in range(120)] + [(77, 1, "[1, 2]"), (78, 1, None)]
    got = {x["k"]: json.loads(x["merged"]) for x in objects.merged_objects(spark.createDataFrame(rows, "k int, i int, o string").repartition(5), "k", "i", "o").collect()}
    wanted = {}
    for k, _, o in sorted(rows, key=lambda x: x[1]):
        try:
            parsed = json.loads(o or "null")
        except ValueError:
            parsed = None
        wanted.setdefault(k, {}).update(parsed if isinstance(parsed, dict) else {})
    assert got == wanted and got[77] == got[78] == {}
    assert objects.merged_objects(spark.createDataFrame([], "k int, i int, o string"), "k", "i", "o").count() == 0


def test_splices(spark):
    cases = [(n, s, d, i) for n in (0, 1, 5) for s in (-9, -2, 0, 1, 4, 5, 9) for d in (-1, 0, 1, 3, 99) for i in ([], ["x"], ["x", None])]
    rows = spark.createDataFrame([(k, [f"w{j}" for j in range(n)], s, d, i) for k, (n, s, d, i) in enumerate(cases)], "k int, a array<string>, s int, d int, i array<string>")
    got = {r["k"]: r["out"] for r in rows.select("k", objects.spliced(F.col("a"), F.col("s"), F.col("d"), F.col("i")).alias("out")).collect()}
    for k, (n, s, d, i) in enumerate(cases):
        wanted = [f"w{j}" for j in range(n)]
        at = max(n + s, 0) if s < 0 else min(s, n)
        wanted[at : at + max(d, 0)] = i
        assert got[k] == wanted
    assert spark.createDataFrame([(None, 1, 1, ["x"])], "a array<string>, s int, d int, i array<string>").select(objects.spliced(F.col("a"), F.col("s"), F.col("d"), F.col("i"))).first()[0] is None


# --- sinks

LOG = "k long, v string"


def start(source, path, tmp_path, also=None):
    q = sinks.logged(source, path, also=also).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    return q


def test_a_batch_that_is_written_and_not_committed_is_there_once(spark, tmp_path):
    path, died = str(tmp_path / "log"), []
    for i in range(3):
        spark.createDataFrame([(i, "a"), (9, f"v{i}")], LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)

    def dies(batch, number):
        if number == 1 and not died:
            died.append(number)
            raise RuntimeError("the process ends between write and commit")

    def source():
        return spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    with pytest.raises(Exception, match="between write and commit"):
        start(source(), path, tmp_path, dies).awaitTermination(120)
    assert died == [1] and sinks.log(spark, path, LOG).count() == 4  # rows of batch 1 are there, but it is not done
    q = start(source(), path, tmp_path, dies)
    assert q.awaitTermination(120) and q.exception() is None
    rows = sinks.log(spark, path, LOG)
    assert Counter((r["k"], r["v"]) for r in rows.collect()) == Counter([(0, "a"), (1, "a"), (2, "a"), (9, "v0"), (9, "v1"), (9, "v2")])
    assert {(r["k"], r["v"]) for r in sinks.last_versions(rows, ["k"], ["batch"]).collect()} == {(0, "a"), (1, "a"), (2, "a"), (9, "v2")}
    small = sinks.compacted(spark, path, LOG, ["k"], [], str(tmp_path / "small"))
    assert {(r["k"], r["v"], r["batch"]) for r in small.collect()} == {(0, "a", 2), (1, "a", 2), (2, "a", 2), (9, "v2", 2)}


def test_batches_replace_only_themselves_and_deleted_keys_go(spark, tmp_path):
    schema, path = "k long, v string, deleted boolean", str(tmp_path / "log")
    batch = lambda *rows: spark.createDataFrame(list(rows), schema)
    sinks.write_batch(batch((1, "a", False), (2, "a", None), (None, "n", False)), 0, path)
    sinks.write_batch(batch((1, "b", True), (2, "b", False)), 1, path)
    sinks.write_batch(batch((1, "b", True), (2, "c", False)), 1, path)
    sinks.write_batch(batch(), 2, path)
    got = sinks.last_versions(sinks.log(spark, path, schema), ["k"], ["batch"])
    assert {(r["k"], r["v"]) for r in got.collect()} == {(2, "c"), (None, "n")}


def test_a_snapshot_is_refreshed_and_kept_where_it_is_not_available(spark, tmp_path):
    now, versions = [0.0], [[(1, "old", 200), (2, "old", 200)], [(1, "new", 503), (2, "new", 200)], None, [(2, "last", 200)]]

    def read():
        rows = versions.pop(0)
        if rows is None:
            raise OSError("no answer")
        return spark.createDataFrame(rows, "k long, said string, status int")

    snapshot = sinks.Snapshot(read, "k", str(tmp_path / "snapshots"), 15.0, lambda: now[0])
    seen = {}

    def write(batch, number):
        seen[number] = sorted((r["k"], r["said"]) for r in batch.collect())
        now[0] += 15.0 if number != 1 else 14.0  # at batch 2 the snapshot of batch 1 is not old enough

    for i in range(5):
        spark.createDataFrame([(1, i), (2, i), (3, i)], "k long, i long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    source = spark.readStream.schema("k long, i long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = sinks.with_snapshot(source, snapshot, write).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120) and q.exception() is None
    assert seen[0] == [(1, "old"), (2, "old"), (3, None)]
    assert seen[1] == seen[2] == [(1, "old"), (2, "new"), (3, None)]  # 503 keeps the old row
    assert seen[3] == seen[2] and snapshot.failures == 1  # no answer keeps them all
    assert seen[4] == [(1, "old"), (2, "last"), (3, None)]


def test_a_query_past_its_deadline_ends_and_leaves_no_files(spark, tmp_path):
    slow = F.udf(lambda x: time.sleep(0.2) or x, "long")
    began = time.monotonic()
    with pytest.raises(sinks.DeadlineExceeded), sinks.deadline(spark, 2.0):
        spark.range(2000).repartition(4).select(slow("id").alias("x")).write.parquet(str(tmp_path / "out"))
    assert time.monotonic() - began < 60
    left = [p for p in (tmp_path / "out").rglob("*.parquet") if "_temporary" not in str(p)] if (tmp_path / "out").exists() else []
    assert not left
    with sinks.deadline(spark, 60):
        assert spark.range(10).count() == 10
    with pytest.raises(ZeroDivisionError), sinks.deadline(spark, 60):
        1 / 0  # noqa: B018
