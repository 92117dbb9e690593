"""R11 over streams: the windows of ``ravelin.operators.timing`` behind a watermark.

An event that is older than the watermark (the latest event time, less ``late``, that was known when the batch before it
began) is dropped with its window; a window is given out once, when the watermark has passed its end, and its state goes then. So state is bounded by the windows that
are open at a time, whatever the length of the stream.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.operators import timing


def marked(events: DataFrame, at: str, late: str) -> DataFrame:
    """``events`` with a watermark; times without a zone are taken in the session's, as watermarks need one."""
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)


def tumbling(events: DataFrame, late: str, width: str, keys: Sequence[str], *, at: str = "ts", value: str = "cents") -> DataFrame:
    return timing.tumbling(marked(events, at, late), width, keys, at=at, value=value)


def sliding(events: DataFrame, late: str, width: str, slide: str, keys: Sequence[str], *, at: str = "ts", value: str = "cents") -> DataFrame:
    return timing.sliding(marked(events, at, late), width, slide, keys, at=at, value=value)


def sessions(events: DataFrame, late: str, gap: str, key: str, *, at: str = "ts", value: str = "cents") -> DataFrame:
    return timing.sessions(marked(events, at, late), gap, key, at=at, value=value)


def replies(requests: DataFrame, answers: DataFrame, late: str, within: str) -> DataFrame:
    """Stream-stream join: requests (request_id, asked) with the answers (request_id, answered, ...) that come ``within`` that time; a request without one
    is given out with nulls when none can come any more. Both sides' state is bounded by ``late`` and ``within``."""
    q, a = marked(requests, "asked", late).alias("q"), marked(answers, "answered", late).alias("a")
    met = (F.col("q.request_id") == F.col("a.request_id")) & (F.col("answered") >= F.col("asked")) & (F.col("answered") <= F.col("asked") + F.expr(f"INTERVAL {within}"))
    return q.join(a, met, "left").select("q.*", *(F.col(f"a.`{c}`") for c in answers.columns if c != "request_id"))
