"""Secret scan with DataFrame functions alone: fixed patterns, and random strings found by two character Markov models.

Fixed patterns give spans of three kinds: assign, access and hex. Positions come from the pieces that a text falls
into when it is split by a pattern: the lengths of the pieces and of the matches between them add up to offsets in
code points.

The models are first-order Markov chains over characters: one of random strings, one of ordinary identifiers,
smoothed with the shares of single characters, learned from labelled samples (token, secret). A candidate is a run of
``LEAST`` or more of the characters that keys are made of, with a letter or digit at both ends. It is a span of the
kind ``random`` if the mean log-likelihood ratio of its transitions is above a threshold for its length and it does not
overlap a span of a fixed pattern. Parts of a token without a small letter, between marks, are taken in lower case, as names of
constants are the words that they are in small letters. The threshold lies ``deviations`` standard deviations above the mean of ordinary
tokens of that length, both measured on labelled tokens that the models have not seen; it is never below 0.

The samples of the query: secrets are random strings of several alphabets, made from hashes, and the values of the
fixed patterns in the documents; ordinary are the different words of documents without such values, and identifiers made from the
words of a public tokenizer's vocabulary: several words in camel, snake and dotted form, as paths, hosts, constants and file names, with
and without numbers, and dates and numbers alone. The threshold is measured on identifiers of other words than those the
models have seen. Samples are bounded (``most_samples`` of each kind, ``most_texts`` by hash). The models are a table of
fixed size, 128 * 128 numbers, that goes into the plan as one constant.

Null and empty texts have no spans. No samples of a kind: that model is uniform. Repeated rows are scanned alike.
"""

from __future__ import annotations

import json
import random
import zlib
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm.shared import table

# The kinds in their order, and the patterns; a match of fewer characters than the last number is dropped.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PATTERNS = {"assign": (ASSIGN, 6), "access": ("AKIA[A-Z0-9]+", 20), "hex": ("[0-9a-f]+", 24)}
#: Runs of the least length are as good as all runs of which the short ones are dropped, where a pattern is one run.
LONG = {"access": "AKIA[A-Z0-9]{16,}", "hex": "(?<![0-9a-f])[0-9a-f]{24,}"}
#: A text without any of these, in lower case, has no match of the pattern: that is seen faster than by the pattern.
HINTS = {"assign": ("password", "passwd", "secret", "token", "apikey", "api_key"), "access": ("akia",)}

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=.-"
TOKEN = r"[A-Za-z0-9+/_=.-]"
#: Characters of the shortest candidate: below, a random string cannot be told from a name.
LEAST = 8
CANDIDATE = rf"[A-Za-z0-9]{TOKEN}{{{LEAST - 2},}}[A-Za-z0-9]"
SPANS = "array<struct<start:int,kind:string,end:int,value:string>>"
#: Running sums are taken in pieces of this many numbers, so that their cost stays near linear.
CHUNK = 256


def running_sums(numbers: Column) -> Column:
    """array<int>: the sum of each number and those before it. An empty array gives an empty one."""
    start = lambda: F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("out"))

    def local(c: Column) -> Column:
        return F.aggregate(c, start(), lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.concat(a["out"], F.array(a["sum"] + x)).alias("out")), lambda a: a["out"])

    def parts(c: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(c) - 1) / CHUNK).cast("int")), lambda k: F.slice(c, k * CHUNK + 1, F.lit(CHUNK)))

    sums = F.transform(parts(numbers), local)
    before = local(F.transform(sums, lambda c: F.coalesce(F.element_at(c, -1), F.lit(0))))
    moved = F.zip_with(sums, F.concat(F.array(F.lit(0)), before), lambda c, s: F.transform(c, lambda x: x + s))
    return F.when(F.size(numbers) <= CHUNK, local(numbers)).otherwise(F.flatten(F.filter(moved, lambda c: c.isNotNull())))


def _spans(kind: str, text: Column, pattern: str) -> Column:
    """array<struct<start, kind, end, value>> of the matches, leftmost and not overlapping."""
    # each step is an array of one element, whose element the next step reads as often as it needs to
    both = F.array(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps")))
    ends = F.transform(both, lambda s: F.struct(s["found"].alias("found"), running_sums(F.zip_with(F.slice(s["gaps"], F.lit(1), F.size(s["found"])), s["found"], lambda g, m: F.length(g) + F.length(m))).alias("ends")))
    one = lambda m, e: F.struct((e - F.length(m)).alias("start"), F.lit(kind).alias("kind"), e.alias("end"), m.alias("value"))
    return F.flatten(F.transform(ends, lambda s: F.zip_with(s["found"], s["ends"], one))).cast(SPANS)


def _fixed(kind: str, text: Column, pattern: str) -> Column:
    return F.when(_likely(kind, text) & F.rlike(text, F.lit(pattern)), _spans(kind, text, pattern)).otherwise(F.array().cast(SPANS))


def _likely(kind: str, text: Column) -> Column:
    low = F.lower(text)
    return reduce(Column.__or__, [F.contains(low, F.lit(h)) for h in HINTS[kind]]) if kind in HINTS else F.lit(True)


def fixed_spans(text: Column) -> dict[str, Column]:
    """The spans of each fixed kind."""
    assign = F.filter(_fixed("assign", text, ASSIGN), lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= PATTERNS["assign"][1])
    return {"assign": assign} | {k: _fixed(k, text, LONG[k]) for k in LONG}


def folded(token: Column) -> Column:
    """A token with its parts between marks that have no small letter in lower case: they are compared with words as they are mostly written."""
    parts = F.split(token, "(?<=[+/_=.-])|(?=[+/_=.-])")
    small = F.array_join(F.transform(parts, lambda p: F.when(F.rlike(p, F.lit("[a-z]")), p).otherwise(F.lower(p))), "")
    return F.when(F.rlike(token, F.lit("[A-Z]([^a-z]|$)")), small).otherwise(token)


@dataclass
class Model:
    """Log-likelihood ratios of the transitions, secret against ordinary, at 128 * first + second code; mean and variance of those of ordinary tokens."""

    ratios: np.ndarray
    mean: float
    variance: float

    def column(self) -> Column:
        return F.from_json(F.lit(json.dumps([round(float(x), 6) for x in self.ratios])), "array<double>")

    def threshold(self, steps: Column, deviations: float) -> Column:
        return F.greatest(F.lit(0.0), self.mean + deviations * F.sqrt(F.lit(self.variance) / steps))


def ratio(token: Column, model: Column) -> Column:
    """The mean log-likelihood ratio of a token's transitions. ``token``: a column or variable, as it is read for each; ``model``: the ratios."""
    start = F.lit(0.0)
    code = lambda i: F.ascii(F.substring(token, i, F.lit(1)))
    short = F.aggregate(F.sequence(F.lit(2), F.length(token)), start, lambda s, i: s + F.get(model, code(i - 1) * 128 + code(i)))
    # finding the i-th character takes longer the longer the token is, so long ones are taken apart first
    chars = F.array(F.transform(F.split(token, ""), F.ascii))
    long = F.aggregate(chars, start, lambda s, c: s + F.aggregate(F.sequence(F.lit(1), F.length(token) - 1), start, lambda t, i: t + F.get(model, F.get(c, i - 1) * 128 + F.get(c, i))))
    return F.when(F.length(token) < 2, 0.0).otherwise(F.when(F.length(token) <= 48, short).otherwise(long) / (F.length(token) - 1))


def train(samples: DataFrame, *, weight: float = 20.0, held: int = 4) -> Model:
    """``samples``: token, secret (boolean), and it may be apart (boolean): ordinary tokens for the threshold alone; without that column one in ``held``, by hash.

    A transition's count is smoothed with ``weight`` times the share of its second character, which has one added.
    """
    alphabet = np.array([ord(c) for c in ALPHABET])
    known = samples.where(F.col("token").isNotNull() & F.col("secret").isNotNull())
    apart = ~F.col("secret") & (F.coalesce("apart", F.lit(False)) if "apart" in samples.columns else F.pmod(F.xxhash64("token"), F.lit(held)) == 0)
    chars = F.transform(F.filter(F.split(folded(F.col("token")), ""), lambda c: c != ""), F.ascii)
    codes = known.where(~apart).select("secret", chars.alias("c"))
    steps = codes.where(F.size("c") > 1).select("secret", F.explode(F.zip_with(F.slice("c", 1, F.size("c") - 1), F.slice("c", 2, F.size("c")), lambda a, b: a * 128 + b)).alias("step"))
    every = np.zeros((2, 128, 128))
    for r in steps.where(F.col("step").between(0, 128 * 128 - 1)).groupBy("secret", "step").count().collect():  # 2 * 128 * 128 rows at most
        every[int(r["secret"]), r["step"] // 128, r["step"] % 128] += r["count"]
    counts = every[:, alphabet][:, :, alphabet]
    single = (counts.sum(1) + 1) / (counts.sum((1, 2)) + len(alphabet))[:, None]
    p = np.log((counts + weight * single[:, None, :]) / (counts.sum(2) + weight)[:, :, None])
    ratios = np.zeros((128, 128))
    ratios[np.ix_(alphabet, alphabet)] = p[1] - p[0]
    model = Model(ratios.ravel(), 0.0, 1.0)
    tokens = known.where(apart & F.rlike("token", F.lit(f"^{CANDIDATE}$"))).select(folded(F.col("token")).alias("t"))
    tokens = tokens.select(ratio(F.col("t"), model.column()).alias("ratio"), (F.length("t") - 1).alias("steps"))
    mean = tokens.agg(F.sum(F.col("ratio") * F.col("steps")) / F.sum("steps")).first()[0]
    if mean is not None:
        variance = tokens.agg(F.avg(F.pow(F.col("ratio") - mean, 2) * F.col("steps"))).first()[0]
        model = Model(model.ratios, mean, variance)
    return model


def scanned(docs: DataFrame, model: Model, *, deviations: float = 6.5) -> DataFrame:
    """All columns of ``docs`` and spans: array<struct<start, kind, end, value>> by start, then kind as listed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    fixed = fixed_spans(text)
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)))
    both = F.transform(found, lambda t: F.struct(t.alias("token"), folded(t).alias("folded")))
    table = model.column()
    chosen = F.transform(F.filter(both, lambda t: ratio(t["folded"], table) > model.threshold(F.length(t["token"]) - 1, deviations)), lambda t: t["token"])
    out = docs.withColumns({f"_{k}": v for k, v in fixed.items()} | {"_chosen": chosen})
    # positions are computed for texts that have such a token, which few have
    spans = F.filter(_spans("random", text, CANDIDATE), lambda s: F.array_contains("_chosen", s["value"]))
    out = out.withColumn("_random", F.when(F.size("_chosen") > 0, spans).otherwise(F.array().cast(SPANS)))
    base = F.concat(*(F.col(f"_{k}") for k in fixed))
    added = F.filter("_random", lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    order = F.array(*(F.lit(k) for k in KINDS))
    keyed = F.transform(F.concat(base, added), lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("place"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value")))
    return out.withColumn("spans", F.array_sort(keyed)).drop(*(f"_{k}" for k in fixed), "_chosen", "_random")


def random_strings(spark: SparkSession, n: int) -> DataFrame:
    """token: ``n`` strings of 8 to 40 characters, made from hashes, of five alphabets in turn."""
    whole = F.base64(F.unhex(F.sha2(F.col("id").cast("string").cast("binary"), 512)))
    plain = F.regexp_replace(whole, "[^A-Za-z0-9]", "")
    kind = F.col("id") % 5
    letters = F.regexp_replace(plain, "[0-9]", "")
    token = F.when(kind == 0, whole).when(kind == 1, letters).when(kind == 2, F.upper(plain)).when(kind == 3, F.lower(plain)).otherwise(plain)
    return spark.range(n).select(F.substring(token, F.lit(1), (F.lit(8) + F.pmod(F.xxhash64("id"), F.lit(33))).cast("int")).alias("token"))


def words_of(vocabulary: str) -> list[str]:
    """The words of three letters and more of a byte-level vocabulary, those that it has with a blank before them."""
    with open(vocabulary, encoding="utf-8") as f:
        entries = json.load(f)["model"]["vocab"]
    blank = "\u0120"  # how such vocabularies write it
    return sorted(e[1:] for e in entries if e[0] == blank and len(e) > 3 and e[1:].isascii() and e[1:].isalpha())


def identifier(words: list[str], r: random.Random) -> str:
    """A name as programs, files and hosts have them, made from some of ``words``."""
    some = [r.choice(words) for _ in range(r.choice((1, 2, 2, 3, 3, 4)))]
    small, large = [w.lower() for w in some], [w.capitalize() for w in some]
    joined = r.choice("_-./").join(small)
    number = str(r.randrange(10 ** r.randint(1, 4)))
    return r.choice((
        small[0] + "".join(large[1:]), "".join(large), "".join(small), small[0][:3].upper() + "".join(large), joined, joined, joined.upper(), joined + number, joined + r.choice("_-./") + number,
        ".".join(small) + r.choice((".com", ".org", ".net", ".example.com")), "/".join(small) + r.choice((".py", ".html", ".tar.gz", ".json", ".md")), some[0] + r.choice(("", "=", ".", "--")) + small[-1],
        small[0].upper() + r.choice((".md", "-", "_", "/")) + small[-1], small[0][:2] + "_" + small[-1][:2].upper() + r.choice((".UTF-8", "")),
        f"{r.randint(1980, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", str(r.randrange(10 ** r.randint(8, 19))),
    ))


def identifiers(spark: SparkSession, words: list[str], n: int, seed: int = 5) -> DataFrame:
    """token, apart: ``n`` identifiers of three quarters of ``words``, and a third as many, apart, of the rest."""
    r = random.Random(seed)
    rest, most = [w for w in words if zlib.crc32(w.encode()) % 4 == 0], [w for w in words if zlib.crc32(w.encode()) % 4]
    made = [(identifier(of, r), apart) for of, apart, k in ((most, False, n), (rest, True, n // 3)) if of for _ in range(k)]
    return spark.createDataFrame(made, "token string, apart boolean")


def public_vocabulary() -> str:
    """The path of a public tokenizer's vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def samples_of(docs: DataFrame, vocabulary: str, *, most_samples: int = 8000, most_identifiers: int = 30_000, most_texts: int = 1000) -> DataFrame:
    """Labelled samples (token, secret, apart): ``most_samples`` random strings, as many different values of fixed patterns, by hash, the different words of
    about ``most_texts`` documents without any, and identifiers made from the words of ``vocabulary``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    any_fixed = reduce(Column.__or__, [_likely(k, text) & F.rlike(text, F.lit(p)) for k, p in {"assign": ASSIGN, **LONG}.items()])
    fixed = fixed_spans(F.col("text"))
    values = F.concat(F.transform(fixed["assign"], lambda s: F.regexp_extract(s["value"], ASSIGN, 2)), *(F.transform(fixed[k], lambda s: s["value"]) for k in LONG))
    secret = docs.select("text").where(any_fixed).select(F.explode(values).alias("token")).distinct()
    secret = secret.orderBy(F.xxhash64("token"), "token").limit(most_samples)
    secret = secret.unionByName(random_strings(docs.sparkSession, most_samples)).select("token", F.lit(True).alias("secret"), F.lit(False).alias("apart"))
    chance = most_texts / max(docs.count(), 1)
    words = F.regexp_extract_all(F.col("text"), F.lit(rf"[A-Za-z0-9]{TOKEN}*[A-Za-z0-9]"), F.lit(0))
    few = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < F.lit(int(chance * (1 << 20)) + 1)).where(~any_fixed)
    seen = few.select(F.explode(words).alias("token")).distinct().select("token", F.lit(False).alias("secret"), F.lit(False).alias("apart"))
    named = identifiers(docs.sparkSession, words_of(vocabulary), most_identifiers).select("token", F.lit(False).alias("secret"), "apart")
    return secret.unionByName(seen).unionByName(named)


def op5_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scanned(docs, train(samples_of(docs, public_vocabulary())), deviations=2.5)
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return out.select("doc_id", *(count(k) for k in KINDS[:3]), F.sha2(said(base).cast("binary"), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"), count("random"))
