"""R2 to R5 over streams: state for each request or document, idempotent if a line comes twice.

``answers`` keeps its state by ``transformWithStateInPandas``: a map with an entry for each line of a request, so that a batch
writes the lines it brings and no more, and a timer for each request. It needs the RocksDB state store (``rocksdb``).
``progress`` keeps two numbers for each document and runs with any state store.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ravelin.functions import text
from ravelin.operators import streams


def rocksdb(spark: SparkSession) -> None:
    """The state store that ``answers`` needs, for streams that start from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Answers(StatefulProcessor):
    """Lines of one request: token pieces by seq, metadata by key, and what is known of the end."""

    def __init__(self, timeout_ms: int, numbered: bool):
        self.timeout_ms, self.numbered = timeout_ms, numbered

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pieces = handle.getMapState("pieces", "seq long", "added string")
        self.metadata = handle.getMapState("metadata", "key string", "seq long, value string")
        self.known = handle.getValueState("known", "lines long, done long, ended boolean, timer long")

    def _told(self, key: tuple, complete: bool) -> pd.DataFrame:
        found = sorted(((seq, added) for (seq,), (added,) in self.pieces.iterator()), key=lambda x: x[0])
        told = [added for _, added in found if added is not None]
        values = [(k, v) for (k,), (_, v) in self.metadata.iterator()]
        self.pieces.clear()
        self.metadata.clear()
        return pd.DataFrame({"request_id": [key[0]], "raw": ["".join(told)], "n_tokens": [len(told)], "pairs": [[{"key": k, "value": v} for k, v in values]], "complete": [complete]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        lines, done, ended, timer = self.known.get() if self.known.exists() else (0, None, False, None)
        for frame in rows:
            for r in frame.itertuples():
                seq = int(r.seq)
                if ended or self.pieces.containsKey((seq,)):
                    continue
                lines += 1
                self.pieces.updateValue((seq,), (r.added if isinstance(r.added, str) else None,))
                for entry in r.entries if r.entries is not None else ():
                    name, value = entry["key"], entry["value"]
                    if not self.metadata.containsKey((name,)) or self.metadata.getValue((name,))[0] <= seq:
                        self.metadata.updateValue((name,), (seq, value))
                if r.done:
                    done = seq if done is None else min(done, seq)
        # numbered lines: all up to the end have come when there are as many as its number says
        if not ended and done is not None and (not self.numbered or lines > done):
            yield self._told(key, True)
            ended = True
        if timer is not None:
            self.handle.deleteTimer(timer)
        timer = timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms
        self.handle.registerTimer(timer)
        self.known.update((lines, done, ended, timer))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.known.exists() and not self.known.get()[2]:
            yield self._told(key, False)
        self.known.clear()


def answers(lines: DataFrame, *, timeout_ms: int = 60_000, numbered: bool = False) -> DataFrame:
    """A stream of ``lines`` (request_id, seq, line) as request_id, text, n_tokens, metadata, complete.

    A request is given out once: when its [DONE] has come (``numbered``: and all lines from 0 up to it), or when nothing has
    come for ``timeout_ms``, then as not complete. Lines may come in any order and twice, within a batch and across batches; those that
    come after it was given out are ignored until its state expires, also after ``timeout_ms``. The text is put together by seq
    and sanitised as a whole; metadata is the last value of each key by seq.
    """
    c = streams.classified(lines).withColumn("done", F.col("line").rlike(r"^(data:)?\s*\[DONE\]\s*$"))
    entries = F.map_entries(F.from_json("metadata", "map<string,string>")).alias("entries")
    rows = c.select("request_id", F.col("seq").cast("long").alias("seq"), "added", entries, "done")
    schema = "request_id long, raw string, n_tokens int, pairs array<struct<key:string,value:string>>, complete boolean"
    out = rows.groupBy("request_id").transformWithStateInPandas(_Answers(timeout_ms, numbered), schema, "Append", "ProcessingTime")
    return out.select("request_id", text.sanitized(F.col("raw")).alias("text"), "n_tokens", F.map_from_entries("pairs").alias("metadata"), "complete")


def progress(events: DataFrame) -> DataFrame:
    """``events`` (doc_id, seq, phase, percent, status) up to and with the first that ends a document's ingestion; events come in order of seq within a batch or later."""

    def step(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, ended = state.get if state.exists else (-1, False)
        rows = pd.concat(list(frames)).sort_values("seq").drop_duplicates("seq")
        out = []
        for r in rows.itertuples():
            if ended or r.seq <= last:
                continue
            ended = bool(r.terminal)
            last = int(r.seq)
            out.append((key[0], last, r.phase, float(r.percent), ended))
        state.update((last, ended))
        yield pd.DataFrame(out, columns=["doc_id", "seq", "phase", "percent", "terminal"])

    marked = events.withColumn("terminal", streams.is_terminal(F.col("phase"), F.col("percent"), F.col("status")))
    return marked.groupBy("doc_id").applyInPandasWithState(step, "doc_id long, seq long, phase string, percent double, terminal boolean", "last long, ended boolean", "append", GroupStateTimeout.NoTimeout)
