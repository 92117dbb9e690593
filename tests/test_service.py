from ravelin.operators import service


def replies(spark, *bodies):
    rows = service.synthesised(spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "n int, body string")).orderBy("n").collect()
    return [(r["answer"], r["latency_sec"], r["follow_ups"], r["suggestions"]) for r in rows]


def test_answers_of_replies(spark):
    assert replies(spark, '{"answer": "a", "reply": ""}', '"said"', "plain text", '{"x": 1}', None, "") == [(a, 1.8, [], []) for a in ("a", "said", "plain text", '{"x": 1}', None, "")]


def test_times_and_lists_of_replies(spark):
    got = replies(spark, '{"reply": "a", "latency_sec": 3, "suggestions": ["s"]}', '{"reply": "a", "latency_sec": "3", "follow_up_inquiries": ["f"], "suggestions": "s"}', '{"reply": "a", "latency_sec": null, "follow_up_inquiries": [], "suggestions": ["s"]}')
    assert got == [("a", 3.0, ["s"], ["s"]), ("a", 1.8, ["f"], ["f"]), ("a", 1.8, [], ["s"])]


def test_tokens(spark):
    rows = spark.createDataFrame([(1, "[1][2, 3] b"), (2, ""), (3, None), (4, "x [a] [12]"), (5, "y" * 100_000 + "[7]")], "answer_id int, text string")
    got = [tuple(r) for r in service.tokens(rows).orderBy("answer_id", "place").collect()]
    assert got == [(1, 1, "citation", "[1]"), (1, 3, "citation", "[2, 3]"), (1, 4, "text", " b"), (4, 0, "text", "x [a] "), (4, 1, "citation", "[12]"), (5, 0, "text", "y" * 100_000), (5, 1, "citation", "[7]")]


def test_moves(spark):
    rows = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id int")
    ids = lambda df: sorted(r["id"] for r in df.collect())
    live, archive = service.moved(rows(1, 2, 3), rows(3, 4), rows(2, 3, 9), "id")
    assert (ids(live), ids(archive)) == ([1], [2, 3, 4])
    live, archive = service.moved(rows(1), rows(), rows(), "id")
    assert (ids(live), ids(archive)) == ([1], [])
