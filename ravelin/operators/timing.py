"""Event time: tumbling, sliding and session windows, points in intervals as pairs, and sums over such pairs without them.

``tumbling``, ``sliding`` and ``sessions`` are one grouping each and run on tables and, behind a watermark, on streams
(``ravelin.streaming.event_time``). ``table_sessions`` gives the rows of ``sessions`` for a table in which one key may have a
third of all events: Spark's session windows bring a key's events into one task, here rows are range-partitioned by key and
time, tasks send the sessions they see, and only the first and last of each partition may go on in another.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.operators.ordered import positioned
from ravelin.sources.tables import written

SECOND = 1_000_000


def micros(at: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp without a zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), at)


def _measures(value: str) -> list[Column]:
    return [F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most")]


def tumbling(events: DataFrame, width: str, keys: Sequence[str], *, at: str = "ts", value: str = "cents") -> DataFrame:
    """Start, end, ``keys``, n, total, least and most of ``value`` for each window of ``width``; events without a time are in none."""
    return events.groupBy(F.window(at, width).alias("w"), *keys).agg(*_measures(value)).select("w.start", "w.end", *keys, "n", "total", "least", "most")


def sliding(events: DataFrame, width: str, slide: str, keys: Sequence[str], *, at: str = "ts", value: str = "cents") -> DataFrame:
    """As ``tumbling`` with a window of ``width`` that begins every ``slide``: an event is in all that cover it."""
    return events.groupBy(F.window(at, width, slide).alias("w"), *keys).agg(*_measures(value)).select("w.start", "w.end", *keys, "n", "total", "least", "most")


def sessions(events: DataFrame, gap: str, key: str, *, at: str = "ts", value: str = "cents") -> DataFrame:
    """Start, end, ``key``, n, total, least, most of runs of a key's events with no more than ``gap`` between them; a session ends ``gap`` after its last event."""
    return events.where(F.col(at).isNotNull()).groupBy(F.session_window(at, gap).alias("w"), key).agg(*_measures(value)).select("w.start", "w.end", key, "n", "total", "least", "most")


def _islands(gap: int):
    """For mapInArrow over rows in order of key and time: the sessions of a partition, the first and the last marked."""
    names = ["_part", "_seq", "_hash", "key", "first", "last", "n", "known", "total", "least", "most"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seq = None, 0  # the session that the next batch may go on with

        def out(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int32(), pa.int64(), pa.int64(), kind, *[pa.int64()] * 7]
            return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

        for b in batches:
            if not b.num_rows:
                continue
            kind = b.schema.field("key").type
            keys, at, value = b.column("_hash").to_numpy(), b.column("at").to_numpy(), b.column("value")
            here, known = value.fill_null(0).to_numpy(), value.is_valid().to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]) | (at[1:] - at[:-1] > gap)) + 1])
            ends = np.concatenate([starts[1:], [len(keys)]])
            low, high = np.where(known, here, np.iinfo(np.int64).max), np.where(known, here, np.iinfo(np.int64).min)
            total, least, most, some = np.add.reduceat(here, starts), np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts), np.add.reduceat(known.astype(np.int64), starts)
            part, rows = b.column("_part")[0].as_py(), []
            for i, (s, e) in enumerate(zip(starts, ends, strict=True)):
                now = [part, seq, int(keys[s]), b.column("key")[int(s)].as_py(), int(at[s]), int(at[e - 1]), int(e - s), int(some[i]), *((int(total[i]), int(least[i]), int(most[i])) if some[i] else (None, None, None))]
                if held is not None and held[2] == now[2] and now[4] - held[5] <= gap:
                    held[5], held[6], held[7] = now[5], held[6] + now[6], held[7] + now[7]
                    held[8:] = [f([x for x in pair if x is not None], default=None) if f is not sum else (None if pair == (None, None) else sum(x or 0 for x in pair)) for f, pair in zip((sum, min, max), zip(held[8:], now[8:], strict=True), strict=True)]
                else:
                    if held is not None:
                        rows.append(tuple(held))
                    seq += 1
                    held = [part, seq, *now[2:]]
            if rows:
                yield out(rows)
        if held is not None:
            yield out([tuple(held)])

    return of


def table_sessions(events: DataFrame, gap: int, key: str, *, at: str = "ts", value: str = "cents", known: bool = False) -> DataFrame:
    """The rows of ``sessions`` for a table, whatever share of it a key has: ``key``, first, last (microseconds), n, total, least, most. ``gap`` is in microseconds.

    A null key is one key; events without a time are in no session; null values are not added, and ``known``, if asked for, counts the others. Keys are told apart by a 64-bit hash. No rows: none.
    """
    spark, kind = events.sparkSession, events.schema[key].dataType.simpleString()
    rows = events.where(F.col(at).isNotNull()).select(F.col(key).alias("key"), F.xxhash64(key).alias("_hash"), micros(at).alias("at"), F.col(value).cast("long").alias("value"))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ranged = rows.repartitionByRange(n, "_hash", "at").sortWithinPartitions("_hash", "at").withColumn("_part", F.spark_partition_id())
    found = written(ranged.mapInArrow(_islands(gap), f"_part int, _seq long, _hash long, key {kind}, first long, last long, n long, known long, total long, least long, most long"), "sessions")
    counts = ["n", *(["known"] if known else [])]
    edge = found.groupBy("_part").agg(F.min_by(F.struct("_hash", "first", "last"), "_seq").alias("head"), F.max_by(F.struct("_hash", "first", "last"), "_seq").alias("tail"), F.max("_seq").alias("size"))
    root, tail, links = None, None, []
    for r in sorted(edge.collect(), key=lambda r: r["_part"]):  # a row for each partition
        if tail is not None and r["head"]["_hash"] == tail["_hash"] and r["head"]["first"] - tail["last"] <= gap:
            links += [(r["_part"], 1, *root)]
            root = root if r["size"] == 1 else (r["_part"], r["size"])
        else:
            root = (r["_part"], r["size"])
        tail = r["tail"]
    if not links:
        return found.select(F.col("key").alias(key), "first", "last", *counts, "total", "least", "most")
    to = spark.createDataFrame(links, "_part int, _seq long, to_part int, to_seq long")  # at most one for each partition
    joined = found.join(F.broadcast(to), ["_part", "_seq"], "left")
    ids = joined.withColumns({"_part": F.coalesce("to_part", "_part"), "_seq": F.coalesce("to_seq", "_seq")})
    whole = ids.groupBy("_part", "_seq").agg(F.first("key").alias(key), F.min("first").alias("first"), F.max("last").alias("last"), *(F.sum(c).alias(c) for c in counts), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"))
    return whole.drop("_part", "_seq")


def in_intervals(points: DataFrame, intervals: DataFrame, *, at: str, start: str, end: str, on: Sequence[str] = (), finest: int = 60 * SECOND, most_in_bin: int = 1_000_000) -> DataFrame:
    """Each point (long ``at``) with each interval (longs ``start`` to ``end``, the end excluded) it is in, and equal columns ``on``; all columns of both.

    An equi-join on bins, and then the exact test. Bins have widths ``finest`` times powers of two; an interval goes to the narrowest that is as long as
    it, where it lies in one or two bins, so intervals of any length are two rows at most; a point looks once at each width that some interval has, at
    most 64. Bins with more than ``most_in_bin`` points are split: points are dealt by a hash of the row, intervals go to all pieces. Rows with a null
    in a time or in ``on`` are in no pair; an interval that ends before or where it starts holds none. Names of the two sides must differ but for ``on``.
    """
    spark = points.sparkSession
    length = F.col(end) - F.col(start)
    level = F.greatest(F.ceil(F.log2(length / finest)), F.lit(0)).cast("int")
    # the logarithm may be off by rounding: one level up where the bin is still too narrow
    width = lambda lv: F.call_function("shiftleft", F.lit(finest).cast("long"), lv)
    held = intervals.where(length > 0).withColumn("_level", level).withColumn("_level", F.col("_level") + (width(F.col("_level")) < length).cast("int"))
    lo, hi = F.floor(F.col(start) / width(F.col("_level"))), F.floor((F.col(end) - 1) / width(F.col("_level")))
    held = held.withColumn("_bin", F.explode(F.when(lo == hi, F.array(lo)).otherwise(F.array(lo, hi))))
    levels = sorted(r[0] for r in held.select("_level").distinct().collect())  # at most 64
    if not levels:
        levels = [0]
    looks = F.explode(F.array(*(F.struct(F.lit(lv).alias("_level"), F.floor(F.col(at) / (finest << lv)).alias("_bin")) for lv in levels)))
    asked = points.where(F.col(at).isNotNull()).withColumn("_look", looks).select(*points.columns, "_look._level", "_look._bin")
    bins = ["_level", "_bin"]
    heavy = asked.groupBy(*bins).agg(F.count("*").alias("_n")).where(F.col("_n") > most_in_bin)
    heavy = written(heavy.select(*bins, F.ceil(F.col("_n") / most_in_bin).cast("int").alias("_pieces")), "heavy-bins")  # fewer than points * 64 / most_in_bin
    pieces = F.coalesce("_pieces", F.lit(1))
    asked = asked.join(heavy, bins, "left").withColumn("_piece", F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in points.columns)), pieces).cast("int")).drop("_pieces")
    held = held.join(heavy, bins, "left").withColumn("_piece", F.explode(F.sequence(F.lit(0), pieces - 1))).drop("_pieces")
    pairs = asked.join(held, [*bins, "_piece", *on])
    return pairs.where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop(*bins, "_piece")


def _met(value: str) -> list[Column]:
    """Of rows: their number, that of known values, and the sum of these."""
    return [F.count("*").alias("n"), F.count(value).alias("known"), F.coalesce(F.sum(value), F.lit(0)).cast("long").alias("total")]


def summed_inside(points: DataFrame, intervals: DataFrame, *, at: str, start: str, end: str, value: str) -> DataFrame:
    """``intervals`` with what the points (long ``at``) in each are together: n, known (those with a ``value``) and total (0 without any).

    What pairs would add up to, without the pairs: points and ends of intervals in one order, running sums over all points, and an interval has those
    at its end less those at its start (the end excluded). Work and rows grow with points and intervals, however many points are in one. Intervals with a null in
    a time, or that end before or where they start, are left out; points without a time are in none.
    """
    sums = ["n", "known", "total"]
    held = intervals.where(F.col(end) > F.col(start)).select(F.struct(*(F.col(f"`{c}`") for c in intervals.columns)).alias("row"), F.col(start).alias("_start"), F.col(end).alias("_end"))
    bounds = F.explode(F.array(F.struct(F.col("_start").alias("pos"), F.lit(-1).alias("sign")), F.struct(F.col("_end").alias("pos"), F.lit(1).alias("sign"))))
    ends = held.select("row", bounds.alias("b")).select("row", "b.*", *(F.lit(0).cast("long").alias(s) for s in sums))
    there = points.where(F.col(at).isNotNull()).groupBy(F.col(at).alias("pos")).agg(*_met(value))
    rows = ends.unionByName(there.withColumn("sign", F.lit(2)), allowMissingColumns=True)  # bounds before the points at the same place
    placed = positioned(rows, ["pos"], ties=["sign"], running=sums, name="inside")
    both = placed.where("sign < 2").groupBy("row").agg(F.count_if(F.col("sign") == 1).alias("equal"), *(F.sum(F.col("sign") * F.col(f"running_{s}")).alias(s) for s in sums))
    each = both.withColumn("one", F.explode(F.sequence(F.lit(1), F.col("equal"))))  # equal intervals were added up
    return each.select("row.*", *(F.call_function("div", s, "equal").alias(s) for s in sums))


def summed_over(points: DataFrame, intervals: DataFrame, *, at: str, start: str, end: str, value: str, on: Sequence[str] = ()) -> DataFrame:
    """Each of the distinct points (``on`` and long ``at``) with what the intervals that it is in are together: n, known (those with a ``value``) and total (0 without any).

    As ``summed_inside`` the other way round: an interval comes in at its start and goes out at its end, and a point has the sums of what came and went up to
    it. Over all of one ``on`` they are 0, so that one running sum goes through all. Nulls as in ``in_intervals``.
    """
    sums, keys = ["n", "known", "total"], [*on, "pos"]
    held = intervals.where(F.col(end) > F.col(start)).dropna(subset=[start, end, *on])
    came = F.explode(F.array(F.struct(F.col(start).alias("pos"), F.lit(1).alias("sign")), F.struct(F.col(end).alias("pos"), F.lit(-1).alias("sign"))))
    steps = held.select(*on, F.col(value).alias("_value"), came.alias("b")).select(*on, "b.*", "_value")
    steps = steps.groupBy(*keys).agg(F.sum("sign").alias("n"), F.sum(F.when(F.col("_value").isNotNull(), F.col("sign")).otherwise(0)).alias("known"), F.coalesce(F.sum(F.col("sign") * F.col("_value")), F.lit(0)).cast("long").alias("total"))
    asked = points.where(F.col(at).isNotNull()).select(*on, F.col(at).alias("pos")).dropna().distinct()
    rows = steps.withColumn("_point", F.lit(0)).unionByName(asked.select("*", *(F.lit(0).cast("long").alias(s) for s in sums), F.lit(1).alias("_point")))
    placed = positioned(rows, keys, ties=["_point"], running=sums, name="over")
    return placed.where("_point = 1").select(*on, F.col("pos").alias(at), *(F.col(f"running_{s}").alias(s) for s in sums))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("cents", F.round(F.col("value") * 100).cast("long"))


def _stamped(rows: DataFrame) -> DataFrame:
    """Starts and ends of windows in microseconds."""
    return rows.withColumns({"start": micros("start"), "end": micros("end")})


def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each kind by hour."""
    return _stamped(tumbling(_events(spark, sf_dir), "1 hour", ["event_type"]))


TUMBLING_WINDOWS_SQL = """
WITH e AS (SELECT event_type, CAST(round(value * 100) AS BIGINT) AS cents, epoch_us(ts) // 3600000000 * 3600000000 AS start FROM events WHERE ts IS NOT NULL)
SELECT start, start + 3600000000 AS "end", event_type, count(*) AS n, CAST(sum(cents) AS BIGINT) AS total, min(cents) AS least, max(cents) AS most FROM e GROUP BY ALL"""


def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each kind in a day, every six hours."""
    return _stamped(sliding(_events(spark, sf_dir), "24 hours", "6 hours", ["event_type"]))


SLIDING_WINDOWS_SQL = """
WITH e AS (SELECT event_type, CAST(round(value * 100) AS BIGINT) AS cents, epoch_us(ts) // 21600000000 AS slot FROM events WHERE ts IS NOT NULL),
s AS (SELECT *, (slot - unnest(range(4))) * 21600000000 AS start FROM e)
SELECT start, start + 86400000000 AS "end", event_type, count(*) AS n, CAST(sum(cents) AS BIGINT) AS total, min(cents) AS least, max(cents) AS most FROM s GROUP BY ALL"""


def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's sessions, which end with six hours without an event."""
    return table_sessions(_events(spark, sf_dir), 6 * 3600 * SECOND, "user_id")


SESSION_WINDOWS_SQL = """
WITH e AS (SELECT user_id, CAST(round(value * 100) AS BIGINT) AS cents, epoch_us(ts) AS t FROM events WHERE ts IS NOT NULL),
g AS (SELECT *, CASE WHEN t - lag(t) OVER w <= 21600000000 THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t)),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t RANGE UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, min(t) AS first, max(t) AS last, count(*) AS n, CAST(sum(cents) AS BIGINT) AS total, min(cents) AS least, max(cents) AS most FROM i GROUP BY user_id, session"""


def events_in_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each session, how many events other users had during it, and their cents."""
    events = _events(spark, sf_dir).where(F.col("user_id").isNotNull())  # of a user that is not known nothing can be said of others
    held = table_sessions(events, 6 * 3600 * SECOND, "user_id", known=True)
    own = held.select("user_id", "first", (F.col("last") + 1).alias("until"), *(F.col(c).alias(f"own_{c}") for c in ("n", "known", "total")))
    inside = summed_inside(events.select(micros("ts").alias("t"), "cents"), own, at="t", start="first", end="until", value="cents")
    cents = F.when(F.col("known") > F.col("own_known"), F.col("total") - F.coalesce("own_total", F.lit(0)))
    return inside.where(F.col("n") > F.col("own_n")).select("user_id", "first", (F.col("n") - F.col("own_n")).alias("n_others"), cents.alias("cents"))


EVENTS_IN_SESSIONS_SQL = f"""
WITH s AS ({SESSION_WINDOWS_SQL}),
p AS (SELECT user_id AS other, epoch_us(ts) AS t, CAST(round(value * 100) AS BIGINT) AS cents FROM events)
SELECT user_id, first, count(*) AS n_others, CAST(sum(cents) AS BIGINT) AS cents FROM s JOIN p ON t >= first AND t <= last AND other <> user_id GROUP BY ALL"""


def orders_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each day on which a nation's customers order, the nation's orders then open: ordered, and not all shipped. Intervals from days to months."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    shipped = read("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max(micros("l_shipdate")).alias("shipped"))
    owners = read("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    orders = read("orders").join(owners, "o_custkey").withColumn("ordered", micros("o_orderdate"))
    days = orders.select("c_nationkey", F.col("ordered").alias("day")).distinct()
    held = orders.join(shipped, "o_orderkey").select("c_nationkey", "ordered", "shipped", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    open_on = summed_over(days, held, at="day", start="ordered", end="shipped", value="cents", on=["c_nationkey"])
    return open_on.where("n > 0").select("c_nationkey", "day", F.col("n").alias("n_open"), F.when(F.col("known") > 0, F.col("total")).alias("cents"))


ORDERS_OPEN_SQL = """
WITH s AS (SELECT l_orderkey, max(epoch_us(l_shipdate)) AS shipped FROM lineitem GROUP BY 1),
o AS (SELECT c_nationkey, o_orderkey, epoch_us(o_orderdate) AS ordered, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders JOIN customer ON o_custkey = c_custkey),
d AS (SELECT DISTINCT c_nationkey, ordered AS day FROM o)
SELECT d.c_nationkey, day, count(*) AS n_open, CAST(sum(c) AS BIGINT) AS cents FROM d JOIN o ON o.c_nationkey = d.c_nationkey AND day >= ordered JOIN s ON l_orderkey = o_orderkey AND day < shipped GROUP BY ALL"""
