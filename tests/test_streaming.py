"""The streaming forms give what the batch forms give."""

import random
import time

from pyspark.sql import functions as F

from ravelin.functions import text
from ravelin.operators import chunks, sessions, streams
from ravelin.streaming import stateful
from tests.conftest import DATA


def run(stream, name):
    q = stream.writeStream.outputMode("append").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return stream.sparkSession.table(name)


LINES = "request_id long, seq long, line string"


def until(stream, name, tmp_path, rows):
    """The table that a running stream has made as soon as it has so many rows; and the progress of its batches."""
    q = stream.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(processingTime="200 milliseconds").start()
    try:
        end = time.monotonic() + 150
        while stream.sparkSession.table(name).count() < rows and time.monotonic() < end and q.isActive:
            time.sleep(0.3)
        assert q.exception() is None
        return stream.sparkSession.table(name).collect(), q.recentProgress
    finally:
        q.stop()


def shuffled(spark, tmp_path, rows, parts):
    """A stream that brings rows in a random order, in so many batches, every fifth row twice."""
    r = random.Random(parts)
    rows = rows + rows[::5]
    r.shuffle(rows)
    for i in range(parts):
        spark.createDataFrame(rows[i::parts], LINES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(LINES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_answers_are_those_of_the_batch_form(spark, tmp_path):
    stateful.rocksdb(spark)
    lines = chunks.lines_of(chunks._chunks(spark, DATA)).where("request_id < 8").withColumnRenamed("line_no", "seq")
    rows = [tuple(r) for r in lines.select("request_id", "seq", "line").collect()]
    last = {r: max(s for x, s, _ in rows if x == r) for r, _, _ in rows}
    meta = [(r, s + 1, f'data: {{"citations": [{r}], "n": 1}}') for r, s in last.items()] + [(r, s + 2, f'{{"sources": [], "n": {r}}}') for r, s in last.items()]
    rows += meta + [(r, s + 3, "data: [DONE]") for r, s in last.items()]
    wanted = {r["request_id"]: r for r in streams.folded(spark.createDataFrame(rows, LINES)).withColumn("text", text.sanitized(F.col("text"))).collect()}
    got, progress = until(stateful.answers(shuffled(spark, tmp_path, rows, 4), numbered=True), "answers", tmp_path, len(last))
    assert len(got) == len(last) == len(wanted)
    for r in got:
        w = wanted[r["request_id"]]
        assert (r["text"], r["n_tokens"], r["metadata"], r["complete"]) == (w["text"], w["n_tokens"], w["metadata"], True)
        assert "[DONE]" not in r["text"] and r["metadata"]["n"] == str(r["request_id"])
    for p in progress:  # a batch writes what it brings: a piece for each line, and a few values for each request
        state = p["stateOperators"][0]
        assert state["customMetrics"]["rocksdbPutCount"] <= 5 * p["numInputRows"] + 12 * len(last) + 12
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] <= 4 * len(last)  # the pieces are gone


def test_answers_without_an_end_expire(spark, tmp_path):
    stateful.rocksdb(spark)
    rows = [(1, 0, "data: • a"), (1, 1, ": keepalive"), (2, 0, "data: [DONE]"), (3, 1, "data: [DONE]"), (4, 0, '{"token": "x"}'), (4, 1, "data: [DONE]"), (4, 2, "late")]
    spark.createDataFrame(rows, LINES).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(LINES).parquet(str(tmp_path / "in"))
    got, _ = until(stateful.answers(source, timeout_ms=1500, numbered=True), "expired", tmp_path, 4)
    assert sorted(tuple(r)[:3] + (r["complete"],) for r in got) == [(1, "• a\n", 1, False), (2, "", 0, True), (3, "", 0, False), (4, "xlate\n", 2, True)]


def test_long_streams_and_conversations_are_folded_in_blocks(spark):
    r = random.Random(2)
    rows = [(k, s, r.choice([f'data: {{"token": "t{s} "}}', f"plain {s}", ": keepalive", f'{{"citations": [{s}], "k{s % 3}": {s}}}'])) for k, n in ((1, 700), (2, 3), (None, 50)) for s in r.sample(range(3 * n), n)]
    df = spark.createDataFrame(rows + rows[::7], LINES).repartition(5)
    whole = {x["request_id"]: (x["text"], x["n_tokens"], x["metadata"]) for x in streams.folded(df, block=1 << 40).collect()}
    assert {x["request_id"]: (x["text"], x["n_tokens"], x["metadata"]) for x in streams.folded(df, block=8).collect()} == whole and len(whole) == 3
    said = [(k, t, role, f"text {t}") for k, n in ((1, 500), (None, 9)) for t in r.sample(range(4 * n), n) for role in ["user"]] + [(1, None, None, None)]
    messages = spark.createDataFrame(said, "conv_id long, turn long, role string, text string").repartition(5)
    one = {x["conv_id"]: (x["transcript"], x["n_messages"]) for x in sessions.transcripts(messages, block=1 << 40).collect()}
    assert {x["conv_id"]: (x["transcript"], x["n_messages"]) for x in sessions.transcripts(messages, block=4).collect()} == one
    assert one[1][1] == 501 and one[1][0].startswith("### 1. \n\n\n\n### 2. User\n\ntext ") and one[None][0].count("### ") == 9


def test_progress(spark, tmp_path):
    rows = [(1, 0, "parsing", 10.0, None), (1, 1, "error", 20.0, None), (1, 2, "embedding", 100.0, None), (1, 3, "ready", 100.0, None), (2, 0, "ready", 1.0, None), (2, 1, "ready", 2.0, None)]
    events = spark.createDataFrame(rows, "doc_id long, seq long, phase string, percent double, status string")
    events.repartition(1).write.parquet(str(tmp_path / "in"))
    got = run(stateful.progress(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))), "progress")
    assert sorted((r["doc_id"], r["seq"], r["terminal"]) for r in got.collect()) == [(1, 0, False), (1, 1, False), (1, 2, True), (2, 0, True)]
