"""Small documents for the operators' tests: clean ones, and every odd case the docstrings define."""

import random

WORDS = "the of and a river stone light under morning walks quiet garden paper window slowly bright letter carries house winter bread table sings north".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n=80):
    r = random.Random(seed)
    out = []
    for i in range(n):
        w = r.choice(WORDS)
        if r.random() < 0.5:
            w += "".join(r.choice("abcdefghijklmnoprstu") for _ in range(r.randint(2, 6)))
        out.append(w.capitalize() if i % 12 == 0 else w + "." if i % 12 == 11 else w)
    return " ".join(out)


def rows(n=12):
    return [(i, prose(i), "en" if i % 2 else "de", f"s{i % 3}", None) for i in range(n)]


ODD = [
    (100, None, "en", "s0", None), (101, "", None, None, 0), (102, " \n\t ", "en", "s1", 3), (103, prose(1, 60_000), "en", "s1", None),
    (None, prose(7), "en", "s2", None), (104, prose(3), "en", "s0", None), (104, prose(3), "en", "s0", None), (105, "%%% $$$ ###", "de", "s0", None), (106, "一二三 😀", "zh", "s2", None),
]


def odd(spark):
    """Clean documents and odd ones, with columns that have names the operators use."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows() + ODD, SCHEMA)
    for name in ("score", "row", "key", "copies", "place", "node", "quality_score", "n_words", "kept", "spans", "size"):
        df = df.withColumn(name, F.lit(name))
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
