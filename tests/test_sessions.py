from ravelin.operators import sessions


def test_changes_are_sorted_after_they_are_dealt(spark):
    """No task sorts a whole split of a file: the rows of both sides are dealt by key first, to a fixed number of tasks, and no join deals the large side again."""
    stored = spark.createDataFrame([(i, "s", 0) for i in range(5)], "id long, title string, n int")
    changes = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 2), (7, "d", 1), (None, "e", 3)], "id long, title string, n int")
    up = sessions.upserted(stored, changes, "id", "n")
    assert sorted((-1 if r["id"] is None else r["id"], r["title"], r["front"]) for r in up.collect()) == [(-1, "e", 0), (0, "s", 1), (1, "c", 0), (2, "s", 1), (3, "s", 1), (4, "s", 1), (7, "d", 0)]
    plan = str(up._jdf.queryExecution().executedPlan())
    partial = plan[plan.index("partial_max") :]
    assert partial.index("Exchange") < partial.index("REPARTITION_BY_NUM") < partial.index("Scan")
    assert "REPARTITION_BY_NUM" in str(sessions.patched(stored, stored.select("id", "title"), "id")._jdf.queryExecution().executedPlan())
