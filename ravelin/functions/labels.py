"""Labels for sizes, times and progress, and colours; all are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The phrase of each stage of a query, and the phrase from a number of seconds on where no stage is known.
STAGES = {
    "RECEIVED": "Analyzing your question...",
    "ROUTING": "Analyzing your question...",
    "QUERY_DECOMPOSITION": "Structuring research topics...",
    "VECTOR_RETRIEVAL": "Searching attached documents...",
    "GRAPH_RETRIEVAL": "Exploring concept relationships in knowledge graph...",
    "FUSION": "Finding the most relevant evidence...",
    "RERANKING": "Finding the most relevant evidence...",
    "SYNTHESIS": "Synthesizing research findings...",
}
FROM_SECONDS = ((3.5, "SYNTHESIS"), (2.8, "FUSION"), (2.1, "GRAPH_RETRIEVAL"), (1.4, "VECTOR_RETRIEVAL"), (0.7, "QUERY_DECOMPOSITION"))


def half_up(x: Column) -> Column:
    """Rounding as floor(x + 0.5)."""
    return F.floor(x + 0.5)


def _fixed(x: Column, digits: int) -> Column:
    return F.replace(F.format_number(x, digits), F.lit(","), F.lit(""))


def bytes_label(n: Column) -> Column:
    """N1."""
    kb, mb = n / 1024, n / (1024 * 1024)
    return (
        F.when(F.coalesce(n, F.lit(0)) <= 0, "0 B").when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(kb < 10, F.concat(_fixed(kb, 1), F.lit(" KB"))).when(kb < 1024, F.concat(half_up(kb).cast("string"), F.lit(" KB")))
        .when(mb < 1024, F.concat(_fixed(mb, 1), F.lit(" MB"))).otherwise(F.concat(_fixed(mb / 1024, 1), F.lit(" GB")))
    )


def mb_label(mb: Column) -> Column:
    """N2."""
    return F.when(mb >= 1024, F.concat(_fixed(mb / 1024, 2), F.lit(" GB"))).otherwise(F.concat(_fixed(mb, 2), F.lit(" MB")))


def size_label(mb: Column) -> Column:
    """Megabytes with one digit, below one megabyte in whole kilobytes."""
    return F.when(mb >= 1, F.concat(_fixed(mb, 1), F.lit(" MB"))).otherwise(F.concat(half_up(mb * 1024).cast("string"), F.lit(" KB")))


def seconds_label(s: Column) -> Column:
    """N3."""
    return F.when(s < 1, F.concat(half_up(s * 1000).cast("string"), F.lit("ms"))).otherwise(F.concat(_fixed(s, 2), F.lit("s")))


def score_label(score: Column) -> Column:
    """No score counts as 95%."""
    return F.when(score.isNull() | F.isnan(score), "95%").otherwise(F.concat(half_up(score * 100).cast("string"), F.lit("%")))


def thought_label(s: Column) -> Column:
    """N5."""
    return F.when(s.isNull() | F.isnan(s) | (s <= 0), "0.0s").when(s < 1, F.concat(half_up(s * 1000).cast("string"), F.lit("ms"))).otherwise(F.concat(_fixed(s, 1), F.lit("s")))


def clamped(x: Column, least: int = 15, most: int = 100) -> Column:
    """N6."""
    return F.greatest(F.lit(least), F.least(F.lit(most), x))


def wave(level: Column, speaking: Column, bar: Column) -> Column:
    """N8."""
    return F.when(speaking, F.greatest(level, 0.75 + (bar % 3) * 0.4)).otherwise(F.least(level, F.lit(0.35)))


def session_date(text: Column, as_of: Column) -> Column:
    """``text`` is a label, an ISO time or anything else, ``as_of`` the time it is read at."""
    at = F.try_to_timestamp(text)
    age = F.unix_timestamp(as_of) - F.unix_timestamp(at)
    clock = F.date_format(at, "h:mm a")
    return (
        F.when(F.coalesce(text, F.lit("")) == "", "Recent").when((text == "Just now") | text.contains("ago") | (text == "Today"), text)
        .when(at.isNull(), text).when(age < 60, "Just now")
        .when(F.to_date(at) == F.to_date(as_of), F.concat(F.lit("Today, "), clock))
        .when(F.to_date(at) == F.date_sub(F.to_date(as_of), 1), F.concat(F.lit("Yesterday, "), clock))
        .when(F.year(at) == F.year(as_of), F.date_format(at, "MMM d")).otherwise(F.date_format(at, "MMM d, yyyy"))
    )


def last_connected(at_ms: Column, connected: Column, as_of_ms: Column) -> Column:
    """D2."""
    minutes = F.floor((as_of_ms - at_ms) / 60_000)
    hours, days = F.floor(minutes / 60), F.floor(minutes / 1440)

    def ago(n: Column, unit: str) -> Column:
        return F.concat(F.lit("Last connected: "), n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))

    return (
        F.when(connected, "Last connected: Just now").when(F.coalesce(at_ms, F.lit(0)) <= 0, "Last connected: Never")
        .when(minutes < 1, "Last connected: Just now").when(minutes < 60, ago(minutes, "minute")).when(hours < 24, ago(hours, "hour")).otherwise(ago(days, "day"))
    )


def stage_phrase(stage: Column, elapsed: Column) -> Column:
    """The phrase of a stage, or of the seconds gone."""
    out = F.when(F.lit(False), "")
    for name, phrase in STAGES.items():
        out = out.when(F.upper(F.trim(stage)) == name, phrase)
    for seconds, name in FROM_SECONDS:
        out = out.when(elapsed >= seconds, STAGES[name])
    return out.otherwise(STAGES["ROUTING"])


def rgb(colour: Column) -> Column:
    """struct<r, g, b> of #rgb or #rrggbb."""
    h = F.regexp_replace(colour, "^#", "")
    h = F.when(F.length(h) == 3, F.regexp_replace(h, "(.)", "$1$1")).otherwise(h)
    return F.struct(*(F.conv(F.substring(h, 1 + 2 * i, 2), 16, 10).cast("int").alias(c) for i, c in enumerate("rgb")))


def char_sum(text: Column) -> Column:
    """The sum of the code points (the same as of UTF-16 units within the basic plane)."""
    return F.aggregate(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c)), F.lit(0), lambda a, c: a + c)
