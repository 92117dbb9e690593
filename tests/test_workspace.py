from ravelin.operators import workspace as W


def test_session_rows(spark):
    rows = [("t", None, None, "", ["a"], [("a", False), ("b", True)]), (None, "s", None, "T", ["x"], None), (None, None, "i", None, None, [])]
    got = [tuple(r) for r in W.session_rows(spark.createDataFrame(rows, "thread_id string, session_id string, id string, title string, attached_docs array<string>, sources array<struct<name:string,selected:boolean>>")).collect()]
    assert [(i, t, [tuple(x) for x in s]) for i, t, s in got] == [("t", "New Chat", [("a", True), ("b", False)]), ("s", "T", [("x", True)]), ("i", "New Chat", [])]


def test_suggestions(spark):
    rows = [(["d"], ['"plain"', '{"title": "t"}', '{"query": "", "prompt": "p"}', "{}", '""']), ([], ['"plain"'])]
    assert [r["queries"] for r in W.suggestions(spark.createDataFrame(rows, "active_docs array<string>, items array<string>")).collect()] == [["plain", "t", "p"], []]


def test_small_ones(spark):
    saved = spark.createDataFrame([(None, "http://old"), ("fast", "http://new")], "mode string, url string")
    assert [tuple(r) for r in W.configured(saved, {"mode": "expert", "url": "none"}, "http://old").collect()] == [("expert", "none"), ("fast", "http://new")]
    fallback = spark.createDataFrame([("m",)], "model string")
    assert [r["model"] for r in W.listed_models(fallback.where("false"), fallback).collect()] == ["m"]
    assert [r["model"] for r in W.listed_models(spark.createDataFrame([("x",)], "model string"), fallback).collect()] == ["x"]
    calls = spark.createDataFrame([("abc",), ('{"session_id": "s"}',), ('{"thread_id": "t", "session_id": "s"}',), ("{}",)], "body string")
    assert [r["thread_id"] for r in W.abort_request(calls).collect()] == ["abc", "s", "t", None]
    keys = spark.createDataFrame([([("a", True), ("a", True)], []), ([("a", False)], []), ([], [("cloud", True, False)])], "keys array<struct<provider:string,verified:boolean>>, substrates array<struct<mode:string,tested:boolean,online:boolean>>")
    assert [(r["may_go_on"], r["providers"]) for r in W.verified_keys(keys).collect()] == [(True, "a"), (False, "a"), (False, "None")]
    links = spark.createDataFrame([("share-1", "x"), ("b", "http://old.host/1"), ("c", None)], "id string, url string")
    assert [r["id"] for r in W.own_links(links, ["share-1"], "old.host").collect()] == ["c"]
    replies = spark.createDataFrame([(True, None, None, None), (False, None, None, None), (None, None, "failed", None), (None, None, None, "e")], "persisted boolean, saved boolean, persistence_status string, persistence_error string")
    assert [r["is_persisted"] for r in W.persisted(replies).collect()] == [True, False, False, False]
    lines = spark.createDataFrame([("m", 1, '{"status": "pulling", "completed": 1, "total": 3}'), ("m", 2, "oops"), ("m", 3, '{"status": "success"}')], "model string, seq int, line string")
    assert [(r["seq"], r["percent"]) for r in W.pulled(lines).collect()] == [(1, 33), (3, 100)]
