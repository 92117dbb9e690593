from ravelin.operators import verification


def test_a_claim_keeps_the_digits_that_its_own_place_has(spark):
    """The second argument of ``trim`` is what to cut: claim 1 began with a 1 once, claim 2 with a 2."""
    answers = spark.createDataFrame([(1, "As said [1]. 19.5 of it [1]. 25 of it [1]."), (2, "None. 1 is here [7].")], "answer_id long, text string")
    citations = spark.createDataFrame([(1, 1, "as said 19.5 of it and 25")], "answer_id long, citation_index int, text string")
    got = [tuple(r) for r in verification.claims(answers, citations).orderBy("answer_id", "claim").collect()]
    assert got == [
        (1, 0, 0, 0, 0, "SUPPORTED"), (1, 1, 1, 1, 0, "SUPPORTED"), (1, 2, 1, 1, 0, "SUPPORTED"),
        (2, 0, 0, 0, 0, "UNSUPPORTED"), (2, 1, 1, 0, 1, "CITATION_INVALID"),
    ]
