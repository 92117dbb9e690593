"""Sinks that can be run twice, the refreshed snapshot (R10, R8), and deadlines.

A batch of a stream may be written more than once: the process may end after the rows are written and before the batch is
marked as done, and then the same batch comes again. So a batch's rows go to a partition with its number, which replaces
what was there; readers take the last version of a key, by batch and then by the order within it.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ravelin.sources.readers import kept_if_unavailable


def write_batch(rows: DataFrame, batch: int, path: str) -> None:
    """Rows as the partition ``batch`` of a table of files; that partition alone is replaced, at the end of the write. A batch without rows replaces nothing."""
    numbered = rows.withColumn("batch", F.lit(batch).cast("long"))
    numbered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def logged(rows: DataFrame, path: str, *, also: Callable[[DataFrame, int], None] | None = None) -> DataStreamWriter:
    """A stream's rows in ``path``, each once whatever is run twice. ``also`` is called with each batch after its rows are written."""

    def sink(batch: DataFrame, number: int) -> None:
        write_batch(batch, number, path)
        if also:
            also(batch, number)

    return rows.writeStream.foreachBatch(sink)


def log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows that were logged, with their batch."""
    return spark.read.schema(f"{schema}, batch long").parquet(path)


def last_versions(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of each key the last of its rows by ``order``; one whose ``deleted`` is true, where there is such a column, is gone.

    Tasks keep the last row of each key before anything is shuffled. Of rows that are equal in ``order`` the greatest stays; null keys are one key.
    """
    rest = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order, *(c for c in rest if c not in order))).alias("_last")).select(*keys, "_last.*")
    return last.where(~F.coalesce("deleted", F.lit(False))) if "deleted" in rows.columns else last


def compacted(spark: SparkSession, path: str, schema: str, keys: Sequence[str], order: Sequence[str], to: str) -> DataFrame:
    """The last versions as a log of their own in ``to``, under the last batch's number, so that batches that follow can be added to it."""
    rows = log(spark, path, schema)
    last = rows.agg(F.max("batch")).first()[0]
    if last is not None:
        write_batch(last_versions(rows, keys, ["batch", *order]).drop("batch"), last, to)
    return log(spark, to, schema) if last is not None else rows


class Snapshot:
    """A table that is read anew when it is older than ``seconds``; where that fails, or a status says it is not available, the rows before stay.

    Rows are written under a name of their own each time, so that a batch that reads the old ones is not disturbed. ``read`` gives rows with a column
    ``status``; rows of status 503 keep the row of that key that was there before, as in the batch form.
    """

    def __init__(self, read: Callable[[], DataFrame], key: str, path: str, seconds: float = 15.0, clock: Callable[[], float] | None = None):
        self.read, self.key, self.path, self.seconds, self.clock = read, key, path, seconds, clock or time.monotonic
        self.rows, self.at, self.failures = None, None, 0

    def current(self) -> DataFrame:
        if self.at is None or self.clock() - self.at >= self.seconds:
            try:
                new = self.read()
                whole = new if self.rows is None else kept_if_unavailable(new, self.rows, self.key, "status")
                where = f"{self.path}/{uuid.uuid4().hex}"
                whole.write.parquet(where)
                self.rows = new.sparkSession.read.schema(whole.schema).parquet(where)
            except Exception:
                if self.rows is None:
                    raise
                self.failures += 1
            self.at = self.clock()
        return self.rows


def with_snapshot(rows: DataFrame, snapshot: Snapshot, write: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """Each batch of a stream with the snapshot as it is when the batch begins, given to ``write``; rows whose key is not there have nulls."""

    def sink(batch: DataFrame, number: int) -> None:
        write(batch.join(snapshot.current(), snapshot.key, "left"), number)

    return rows.writeStream.foreachBatch(sink)


class DeadlineExceeded(RuntimeError):
    """A query was ended by its deadline."""


@contextmanager
def deadline(spark: SparkSession, seconds: float):
    """Spark jobs that the block starts are cancelled when it has taken so long, and ``DeadlineExceeded`` is raised in their place.

    Jobs of other threads go on. A write that is cancelled leaves no rows: its files were never committed.
    """
    context, tag, over = spark.sparkContext, f"deadline-{uuid.uuid4().hex}", threading.Event()

    def end() -> None:
        over.set()
        context.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, end)
    context.addJobTag(tag)
    timer.start()
    try:
        yield tag
    except Exception as error:
        if over.is_set():
            raise DeadlineExceeded(f"more than {seconds} seconds") from error
        raise
    finally:
        timer.cancel()
        context.removeJobTag(tag)
