"""The cleaners on texts made at random, against the row-wise forms, and on texts by hand."""

import random

import pytest
from pyspark.sql import functions as F

from ravelin.functions import text
from ravelin.operators import answers

PIECES = ["[1]", "[1, 2]", "[2,1 ]", "[ 3]", "[1 ,1,2]", "[x]", "[", "]", " ", "  ", "\t", ",", ";", ".", "!", "word", "\n", "[07]", "[1][1]", "(", ")"]


def made(seed):
    r = random.Random(seed)
    return "".join(r.choice(PIECES) for _ in range(14))


def test_markers_once_as_row_by_row(spark):
    texts = [made(s) for s in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r["i"]: r["clean"] for r in df.select("i", text.deduplicated_markers(F.col("t")).alias("clean")).collect()}
    wanted = {i: answers.unique_markers(t) for i, t in enumerate(texts)}
    assert [(texts[i], got[i], wanted[i]) for i in got if got[i] != wanted[i]][:3] == []


@pytest.mark.parametrize(("given", "wanted"), [
    ("See (Report.pdf, page 4) [1] now [2, 3] .", "See now."), ("a (page 4, Report.PDF)\nb", "a b"), ("a [1] (R.docx, p. 2) b", "a b"), ("a (p. 2) b", "a (p. 2) b"), ("a (p. 2) [1] b", "a b"),
    ("a (R.md) b (x)", "a (R.md) b (x)"), ("a (R.md) [2] b", "a b"), ("f(x) [i] = 2 ;", "f(x) [i] = 2;"), ("a [1 , 2]\t[3]  !\n\n b  \tc  ", "a!\n\n b c"), ("(", "("), ("a (b\nR.pdf, page 2) c", "a (b\nR.pdf, page 2) c"), ("", ""),
    ("x (Annual R.xlsx sheet, see, page 12 ff) y", "x y"), ("a ( page 3, R.pdf) b", "a ( page 3, R.pdf) b"),
])
def test_copied(spark, given, wanted):
    assert spark.range(1).select(text.copied(F.lit(given))).first()[0] == wanted


def test_nulls_stay_nulls(spark):
    none = spark.range(1).select(F.lit(None).cast("string").alias("t"))
    assert none.select(*(f(F.col("t")) for f in (text.copied, text.deduplicated_markers, text.sanitized, text.speech))).first() == (None,) * 4


def test_a_long_text_is_cleaned_in_linear_time(spark):
    long = spark.range(1).select(F.repeat(F.lit("some words [1] [1], and (Plan.docx, p. 3) [2] . "), 20_000).alias("t"))
    r = long.select(F.length(text.copied(F.col("t"))).alias("a"), F.length(text.deduplicated_markers(F.col("t"))).alias("b")).first()
    assert r["a"] == len("some words, and. ") * 20_000 - 1 and r["b"] > 0
