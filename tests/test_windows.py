"""Windows, ranks, intervals and rollups against plain Python, on odd rows and hot keys; and the streaming forms against the batch forms."""

import datetime as dt
import random
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from ravelin.operators import ordered, rollups, timing
from ravelin.streaming import event_time
from tests.conftest import DATA

START = dt.datetime(2024, 1, 1)


def table(spark, rows, schema, parts=4):
    return spark.createDataFrame(rows, schema).repartition(parts)


def ranked(rows):
    """(key, tie, amount) with row_number, rank, dense_rank, percent_rank, 7-tile and running sum."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out, total, rank, dense = [], 0, 0, 0
    for i, r in enumerate(order):
        if i == 0 or order[i - 1][0] != r[0]:
            rank, dense = i + 1, dense + 1
        total += r[2] or 0
        size, more = divmod(len(order), 7)
        tile = i // (size + 1) if i < more * (size + 1) else more + (i - more * (size + 1)) // max(size, 1)
        out.append((*r, i + 1, rank, dense, round((rank - 1) / max(len(order) - 1, 1), 12), tile + 1, total))
    return out


@pytest.mark.parametrize("rows", [
    [(r % 5 if r % 11 else None, r, r * 3 - 50 if r % 4 else None) for r in range(200)], [(7, r, 1) for r in range(100)], [(r, 0, -r) for r in range(50)], [(None, 1, None)], [(1, 2, 3), (1, 1, 4)], [(r // 90, r, 1) for r in range(180)],
], ids=["few keys", "one key", "all keys", "one null", "two", "runs"])
def test_ranks_are_those_of_a_sorted_list(spark, rows):
    df = table(spark, rows, "key long, tie long, amount long")
    placed = ordered.positioned(df, ["key"], ties=["tie"], running=["amount"])
    got = placed.select("key", "tie", "amount", "row_number", "rank", "dense_rank", F.round("percent_rank", 12), ordered.ntile(7), "running_amount").collect()
    assert sorted(map(tuple, got), key=lambda r: r[3]) == ranked(rows)


def test_ranks_of_no_rows_and_without_one_task(spark):
    df = table(spark, [(1, 1, 1)], "key long, tie long, amount long")
    assert ordered.positioned(df.limit(0), ["key"], running=["amount"]).count() == 0
    plan = ordered.line_ranks(spark, DATA)._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan


@pytest.mark.parametrize("width", [0, 3, 1000])
def test_trailing_frames(spark, width):
    r = random.Random(width)
    rows = [(r.randint(0, 60) if r.random() < 0.9 else None, r.randint(-5, 5)) for _ in range(300)] + [(30, 1)] * 200
    got = {x["at"]: (x["amount"], x["n"]) for x in ordered.trailing(table(spark, rows, "at long, amount long"), "at", width, ["amount"]).collect()}
    wanted = {a: (sum(v for t, v in rows if t is not None and a - width <= t <= a), sum(t is not None and a - width <= t <= a for t, _ in rows)) for a, _ in rows if a is not None}
    assert got == wanted


def islands(rows, gap):
    by, out = defaultdict(list), Counter()
    for key, at, cents in rows:
        if at is not None:
            by[key].append((at, cents))
    for key, own in by.items():
        own.sort(key=lambda x: x[0])
        held = []
        for at, cents in own:
            if held and (at - held[-1][0]).total_seconds() > gap:
                out[_session(key, held)] += 1
                held = []
            held.append((at, cents))
        out[_session(key, held)] += 1
    return out


def _session(key, held):
    known = [c for _, c in held if c is not None]
    us = lambda t: round((t - dt.datetime(1970, 1, 1)).total_seconds() * 1e6)
    return key, us(held[0][0]), us(held[-1][0]), len(held), sum(known) if known else None, min(known, default=None), max(known, default=None)


@pytest.mark.parametrize("gap", [1, 30, 100_000])
def test_sessions_of_a_hot_key(spark, gap):
    r = random.Random(gap)
    rows = [(None if r.random() < 0.1 else "hot" if r.random() < 0.5 else f"u{r.randint(0, 5)}", START + dt.timedelta(seconds=r.randint(0, 3000)) if r.random() < 0.95 else None, r.randint(-9, 9) if r.random() < 0.9 else None) for _ in range(600)]
    df = table(spark, rows, "user string, ts timestamp_ntz, cents long", 7)
    got = timing.table_sessions(df, gap * timing.SECOND, "user")
    assert Counter(map(tuple, got.collect())) == islands(rows, gap)
    built_in = timing.sessions(df, f"{gap} seconds", "user").select("user", timing.micros("start").alias("first"), (timing.micros("end") - gap * timing.SECOND).alias("last"), "n", "total", "least", "most")
    assert Counter(map(tuple, built_in.collect())) == islands(rows, gap)
    assert timing.table_sessions(df.limit(0), 1, "user").count() == 0


@pytest.mark.parametrize("most", [5, 1_000_000])
def test_points_in_intervals_of_any_length(spark, most):
    r = random.Random(most)
    points = [(i, r.choice(["a", "b", None]), 500 if i % 3 == 0 else r.randint(-2000, 2000) if r.random() < 0.95 else None) for i in range(300)]
    spans = [(j, r.choice(["a", "b", None]), s := r.randint(-2000, 2000), s + r.choice([-5, 0, 1, 7, 64, 65, 1000, 3999])) for j in range(200)] + [(900, "a", None, 5), (901, "a", 5, None), (902, "a", -(10**15), 10**15)]
    p, s = table(spark, points, "i long, kind string, at long"), table(spark, spans, "j long, kind string, start long, end long")
    got = Counter(map(tuple, timing.in_intervals(p, s, at="at", start="start", end="end", on=["kind"], finest=8, most_in_bin=most).select("i", "j").collect()))
    assert got == Counter((i, j) for i, k, t in points for j, k2, a, b in spans if t is not None and a is not None and b is not None and k is not None and k == k2 and a <= t < b)
    every = Counter(map(tuple, timing.in_intervals(p.drop("kind"), s.drop("kind"), at="at", start="start", end="end", finest=8, most_in_bin=most).select("i", "j").collect()))
    assert every == Counter((i, j) for i, _, t in points for j, _, a, b in spans if None not in (t, a, b) and a <= t < b)
    assert timing.in_intervals(p, s.limit(0).withColumnRenamed("kind", "other"), at="at", start="start", end="end").count() == 0


def test_sums_over_points_in_intervals_without_pairs(spark):
    r = random.Random(8)
    points = [(r.choice(["a", "b", None]), r.randint(-50, 50) if r.random() < 0.95 else None, r.randint(-9, 9) if r.random() < 0.8 else None) for _ in range(300)]
    spans = [(r.choice(["a", "b", None]), s := r.choice([None, *range(-60, 60)]), None if s is None else s + r.choice([-5, 0, 1, 2, 20, 70]), r.randint(-9, 9) if r.random() < 0.8 else None) for _ in range(200)]
    spans += spans[:5]  # equal intervals stay apart
    p, s = table(spark, points, "kind string, at long, v long", 5), table(spark, spans, "kind string, start long, end long, w long", 5)
    valid = [x for x in spans if None not in x[1:3] and x[1] < x[2]]
    whole = lambda values: (len(values), sum(v is not None for v in values), sum(v or 0 for v in values))
    got = Counter(map(tuple, timing.summed_inside(p, s, at="at", start="start", end="end", value="v").collect()))
    assert got == Counter((*x, *whole([v for _, t, v in points if t is not None and x[1] <= t < x[2]])) for x in valid)
    got = Counter(map(tuple, timing.summed_over(p, s, at="at", start="start", end="end", value="w", on=["kind"]).collect()))
    assert got == Counter((k, t, *whole([w for k2, a, b, w in valid if k2 == k and a <= t < b])) for k, t in {x[:2] for x in points} if k is not None and t is not None)
    got = Counter(map(tuple, timing.summed_over(p, s, at="at", start="start", end="end", value="w").collect()))
    assert got == Counter((t, *whole([w for _, a, b, w in valid if a <= t < b])) for t in {x[1] for x in points} if t is not None)
    assert timing.summed_inside(p.limit(0), s.limit(0), at="at", start="start", end="end", value="v").count() == timing.summed_over(p.limit(0), s.limit(0), at="at", start="start", end="end", value="w").count() == 0


@pytest.mark.parametrize("name", ["events_in_sessions", "orders_open"])
def test_sums_over_intervals_make_no_pairs(spark, name):
    """No join of points and intervals: the rows of the largest step are no more than those read."""
    plan = getattr(timing, name)(spark, DATA)._jdf.queryExecution().toString()
    assert "_bin" not in plan and "_piece" not in plan


def test_events_and_orders_with_nulls(spark, tmp_path):
    at = lambda h: START + dt.timedelta(hours=h)
    events = [(1, at(0), 1, 5.0), (2, at(1), 1, None), (3, at(0.5), 2, None), (4, at(1), None, 7.0), (5, None, 2, 1.0), (6, at(1), 3, None), (7, at(0.2), 4, 2.5), (8, at(40), 5, 1.0)]
    table(spark, events, "event_id long, ts timestamp_ntz, user_id long, value double").write.parquet(str(tmp_path / "events.parquet"))
    table(spark, [(1, 9), (2, None)], "c_custkey long, c_nationkey int").write.parquet(str(tmp_path / "customer.parquet"))
    orders = [(1, 1, at(0), 2.0), (2, 1, at(24), None), (3, 1, at(96), 1.0), (4, 2, at(0), 1.0), (5, 1, at(400), None), (6, 1, at(300), 4.0)]
    table(spark, orders, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    lines = [(1, at(48)), (1, at(24)), (2, at(96)), (3, at(96)), (4, at(48)), (5, at(500)), (6, None)]
    table(spark, lines, "l_orderkey long, l_shipdate timestamp_ntz").write.parquet(str(tmp_path / "lineitem.parquet"))
    for name in ("events_in_sessions", "orders_open"):
        got = Counter(map(tuple, getattr(timing, name)(spark, str(tmp_path)).collect()))
        con = duckdb.connect()
        for t in ("events", "customer", "orders", "lineitem"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
        assert got and got == Counter(con.sql(getattr(timing, f"{name.upper()}_SQL")).fetchall())


def test_interval_join_has_no_nested_loop(spark):
    plan = timing.orders_open(spark, DATA)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_cells_merge_to_what_the_rows_have(spark):
    r = random.Random(3)
    rows = [(r.choice(["a", "b", None]), r.choice("xyz"), r.randint(0, 3000), r.randint(0, 10**6) if r.random() < 0.9 else None) for _ in range(20_000)]
    df = table(spark, rows, "p string, q string, who long, cents long")
    names = {"sums": ["cents"], "distinct": ["who"], "quantiles": ["cents"]}
    early, late = (rollups.cells(x, ["p", "q"], **names) for x in (df.where("who % 2 = 0"), df.where("who % 2 = 1")))
    table_of_cells = rollups.united(early, late, ["p", "q"], **names)
    got = rollups.estimates(rollups.rolled(table_of_cells, ["p", "q"], [("p", "q"), ("p",), ()], **names), distinct=["who"], quantiles=["cents"]).collect()
    assert len(got) == 9 + 3 + 1
    for x in got:
        own = [t for t in rows if (x["level"] & 2 or t[0] == x["p"]) and (x["level"] & 1 or t[1] == x["q"])]
        values = sorted(t[3] for t in own if t[3] is not None)
        assert x["n"] == len(own) and x["cents"] == sum(values)
        exact = len({t[2] for t in own})
        assert abs(x["n_who"] - exact) <= 0.05 * exact  # three standard errors
        for p in (50, 90):
            rank = sum(v <= x[f"cents_p{p}"] for v in values) / len(values)
            assert abs(rank - p / 100) < 0.03


def test_sketches_of_a_table_are_within_their_error(spark):
    exact = {(r["brand"], r["kind"], r["month"], r["level"]): r for r in rollups.rolled(rollups.cells(rollups._sales(spark, DATA), rollups.DIMS), rollups.DIMS, rollups.SETS).collect()}
    found = rollups.sales_sketches(spark, DATA).collect()
    orders = {r["brand"]: r["n"] for r in rollups._sales(spark, DATA).groupBy("brand").agg(F.countDistinct("orders").alias("n")).collect()}
    assert len(found) == len(exact)
    for r in found:
        assert r["n"] == exact[r["brand"], r["kind"], r["month"], r["level"]]["n"]
        if r["level"] == 3:
            assert abs(r["n_orders"] - orders[r["brand"]]) <= 0.05 * orders[r["brand"]]
    assert rollups.rolled(rollups.cells(rollups._sales(spark, DATA).limit(0), rollups.DIMS), rollups.DIMS, [()]).count() <= 1


EVENTS = "user string, ts timestamp_ntz, cents long"


def stream(spark, path, batches):
    """A stream that brings each list of (user, seconds, cents) as a batch; the last pushes the watermark past all others."""
    import time

    for rows in batches:
        one = spark.createDataFrame([(u, START + dt.timedelta(seconds=s), c) for u, s, c in rows], EVENTS).coalesce(1)
        one.write.mode("append").parquet(path)
        time.sleep(0.05)
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(path)


def result(df, name, tmp_path):
    q = df.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    assert q.awaitTermination(180) and q.exception() is None
    return q, Counter(map(tuple, df.sparkSession.table(name).collect()))


BATCHES = [
    [("a", 0, 1), ("b", 5, 2), ("a", 59, 4)],
    [("a", 100, 8), ("a", 50, 16)],  # 50 is late, but within a minute of 59
    [("b", 400, 32), ("a", 395, None)],
    [("b", 410, 1024)],
    [("a", 10, 64), ("b", 20, 128), ("b", 380, 256)],  # 10 and 20 are dropped: the watermark was 340 when the batch before began
    [("a", 100_000, 512)],
]
IN_TIME = [r for i, b in enumerate(BATCHES) for r in b if (i, r[1]) not in {(4, 10), (4, 20)}]


@pytest.mark.parametrize("kind", ["tumbling", "sliding", "sessions"])
def test_streams_with_late_rows_give_the_rows_of_the_table(spark, tmp_path, kind):
    args = {"tumbling": ("1 minute", ["user"]), "sliding": ("2 minutes", "1 minute", ["user"]), "sessions": ("90 seconds", "user")}[kind]
    source = stream(spark, str(tmp_path / "in"), BATCHES)
    q, got = result(getattr(event_time, kind)(source, "1 minute", *args), f"windows_{kind}", tmp_path)
    kept = spark.createDataFrame([(u, START + dt.timedelta(seconds=s), c) for u, s, c in IN_TIME], EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))
    wanted = getattr(timing, kind)(kept, *args).where(F.col("end") <= START + dt.timedelta(seconds=100_000 - 60))
    assert got == Counter(map(tuple, wanted.collect()))
    state = [o["numRowsTotal"] for p in q.recentProgress for o in p["stateOperators"]]
    dropped = sum(o["numRowsDroppedByWatermark"] for p in q.recentProgress for o in p["stateOperators"])
    assert dropped > 0 and state[-1] < max(state)  # late rows are dropped, closed windows leave the state


def test_requests_meet_their_answers_in_time(spark, tmp_path):
    at = lambda s: START + dt.timedelta(seconds=s)
    asked = [(1, at(0)), (2, at(10)), (3, at(20)), (9, at(50_000))]
    answered = [(1, at(5), "x"), (2, at(500), "too late"), (8, at(7), "nobody"), (9, at(90_000), "end")]
    spark.createDataFrame(asked, "request_id long, asked timestamp").coalesce(1).write.parquet(str(tmp_path / "q"))
    spark.createDataFrame(answered, "request_id long, answered timestamp, text string").coalesce(1).write.parquet(str(tmp_path / "a"))
    q = spark.readStream.schema("request_id long, asked timestamp").parquet(str(tmp_path / "q"))
    a = spark.readStream.schema("request_id long, answered timestamp, text string").parquet(str(tmp_path / "a"))
    _, got = result(event_time.replies(q, a, "10 seconds", "60 SECONDS").select("request_id", "text"), "replies", tmp_path)
    assert got == Counter({(1, "x"): 1, (2, None): 1, (3, None): 1})
