"""Source divergence audit: how the words of each source of a language differ from those of its other sources.

Terms are runs of ASCII letters and of characters beyond ASCII, A to Z lower-cased. Each language keeps the terms that at
least ``least_docs`` of its documents have, V of them. A group (language, source) or a whole language gives a kept term
p = 1 + floor(10**9 * (count + 1) / (N + V)), N its occurrences of kept terms. p against q differs by
f = floor((p - q)**2 / q). Two sources differ by the sum of f over all V terms, terms that neither has included.

The plan, with a row for each kept term that holds all sources of its language:

1. Tasks count terms by group and document and send each term once for each group (again after ``most_held`` different
   ones), so what is shuffled is a vocabulary, not texts. Rows go to their (language, term), where counts are summed,
   rare terms fall out, and what is left becomes one row with the counts of its sources.
2. N by source and V by language are sums over these rows, one short row for each language.
3. Each row becomes an array of counts indexed by source; equal arrays of a language are one row with their number, and
   become arrays of p. Higher-order functions emit the contributions of the pairs of sources
   of which one at least has the term, less what the pair contributes to a term that neither has; the latter counts V
   times. Tasks sum contributions by pair before anything is shuffled.
4. The terms that a source has more often than its language are ranked; tasks keep the best of each group, and these
   again by parts of the group, before a group comes together.

The result has a row for each pair of sources of a language, and the wide rows an entry for each source, so the number of
sources of one language bounds what a row takes. The numbers fit into longs up to 9 * 10**13 occurrences and 10**9
terms in a language.

Null text, language and source are read as ''. Documents are rows: a repeated row counts again. Empty texts have no
terms, but their group occurs; without kept terms all its pairs have the value 0. Ties go by the UTF-8 bytes of the
item. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ravelin.llm.shared import drop_table, stored, table

#: Letters stay, A to Z become small, all other ASCII characters become spaces, bytes of other characters stay.
_BYTES = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)).lower()


def _counted(batches: Iterator[pa.RecordBatch], most_held: int) -> Iterator[pa.RecordBatch]:
    """lang, source, term, count, docs of the documents seen, each (lang, source, term) once unless there are too many to hold."""
    counts: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), (count, docs) in counts.items():
            n = len(count)
            yield pa.record_batch(
                [pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(list(count), pa.binary()).cast(pa.string()), pa.array(list(count.values()), pa.int64()), pa.array([docs[t] for t in count], pa.int64())],
                ["lang", "source", "term", "count", "docs"],
            )
        counts.clear()

    for b in batches:
        held = sum(len(c) for c, _ in counts.values())
        for lang, source, text in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), b.column("text").cast(pa.binary()), strict=True):
            count, docs = counts[lang, source]
            words = text.as_py().translate(_BYTES).split()
            held -= len(count)
            count.update(words)
            docs.update(set(words))
            held += len(count)
            if held > most_held:
                yield from rows()
                held = 0
    yield from rows()


def term_counts(docs: DataFrame, *, least_docs: int = 3, most_held: int = 1 << 19) -> DataFrame:
    """lang, term, by_source (a map from source to count) of the kept terms of each language. ``docs``: text, lang, source."""
    read = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")))
    seen = read.mapInArrow(partial(_counted, most_held=most_held), "lang string, source string, term string, count long, docs long")
    # one shuffle, by (lang, term), serves both sums
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_source = seen.repartition(n, "lang", "term").groupBy("lang", "term", "source").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    terms = by_source.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.map_from_entries(F.collect_list(F.struct("source", "count"))).alias("by_source"))
    return terms.where(F.col("docs") >= least_docs).select("lang", "term", "by_source")


def share(count: str, whole: str) -> str:
    """SQL for 1 + floor(10**9 * (count + 1) / whole) in longs: the quotient of 10**4 times the numerator, and that of 10**5 times its remainder."""
    a = f"(({count} + 1L) * 10000L)"
    return f"(1L + ({a} div {whole}) * 100000L + (({a} % {whole}) * 100000L) div {whole})"


def divergence(p: str, q: str) -> str:
    """SQL for floor((p - q)**2 / q) of longs."""
    return f"((({p}) - ({q})) * (({p}) - ({q})) div ({q}))"


def totals(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """A row for each language of ``docs``: lang, sources (all that occur, in order), wholes (N + V of each), whole (N + V of the language), kept (V)."""
    groups = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    sums = terms.select("lang", F.explode("by_source").alias("source", "count")).groupBy("lang", "source").agg(F.sum("count").alias("n"))
    sizes = terms.groupBy("lang").agg(F.count("*").alias("kept"))
    listed = groups.join(sums, ["lang", "source"], "left").groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0)).alias("n")))).alias("all"))
    one = listed.join(sizes, "lang", "left").withColumn("kept", F.coalesce("kept", F.lit(0)))
    return one.select("lang", F.col("all.source").alias("sources"), F.expr("transform(all, x -> x.n + kept)").alias("wholes"), F.expr("aggregate(all, 0L, (s, x) -> s + x.n) + kept").alias("whole"), "kept")


def counted(terms: DataFrame, sums: DataFrame) -> DataFrame:
    """A wide row for each kept term: lang, term, the columns of ``sums``, and counts (an array by source)."""
    return terms.join(sums, "lang").withColumn("counts", F.expr("transform(sources, s -> coalesce(by_source[s], 0L))"))


def shares() -> Column:
    """p by source, from ``counts`` and ``wholes``."""
    return F.expr(f"transform(counts, (c, i) -> {share('c', 'wholes[i]')})").alias("p")


def pairs(terms: DataFrame, sums: DataFrame) -> DataFrame:
    """lang, source, item, value for each two different sources of a language, in both orders."""
    # terms with the same counts contribute the same: rare terms, which are most, are few different rows
    alike = counted(terms, sums).groupBy("lang", "counts").agg(F.count("*").alias("terms"))
    rows = alike.join(sums, "lang").select("lang", "terms", "counts", shares())
    rows = rows.select("lang", "terms", F.expr("transform(p, (x, i) -> struct(i AS s, x AS p, counts[i] AS n))").alias("cells"))
    # each source that has the term meets all; ``back`` is the other direction where the other source lacks the term
    emitted = F.expr(f"""flatten(transform(filter(cells, x -> x.n > 0), h -> transform(cells, x ->
        struct(h.s AS s, x.s AS t, {divergence('h.p', 'x.p')} AS there, CASE WHEN x.n = 0 THEN {divergence('x.p', 'h.p')} END AS back))))""")
    met = rows.select("lang", "terms", F.inline(emitted)).where("s <> t").groupBy("lang", "s", "t")
    added = met.agg(F.expr("sum(there * terms)").alias("there"), F.sum("terms").alias("n_there"), F.expr("sum(back * terms)").alias("back"), F.expr("sum(CASE WHEN back IS NOT NULL THEN terms END)").alias("n_back"))
    added = stored(added, "pairs")
    there, back = added.select("lang", "s", "t", "there", "n_there"), added.select("lang", F.col("t").alias("s"), F.col("s").alias("t"), "back", "n_back")
    every = sums.select("lang", "sources", "wholes", "kept", F.posexplode("sources").alias("s", "source")).select("*", F.posexplode("sources").alias("t", "item")).where("s <> t")
    neither = F.expr(f"CASE WHEN kept > 0 THEN {divergence(share('0L', 'wholes[s]'), share('0L', 'wholes[t]'))} ELSE 0L END")  # of a term that none of the two has
    every = every.select("lang", "s", "t", "source", "item", "kept", neither.alias("neither"))
    both = every.join(there, ["lang", "s", "t"], "left").join(back, ["lang", "s", "t"], "left")
    return both.select("lang", "source", "item", F.expr("coalesce(there, 0L) + coalesce(back, 0L) + (kept - coalesce(n_there, 0L) - coalesce(n_back, 0L)) * neither").alias("value"))


def typical(terms: DataFrame, sums: DataFrame) -> DataFrame:
    """lang, source, item, value for the kept terms that a source has, and has more often than its language."""
    found = F.expr(f"""transform(filter(sequence(0, size(sources) - 1), i -> counts[i] > 0 AND p[i] > q), i ->
        struct(sources[i] AS source, {divergence('p[i]', 'q')} AS value))""")
    q = F.expr(share("aggregate(counts, 0L, (s, x) -> s + x)", "whole")).alias("q")
    wide = counted(terms, sums).select("lang", "term", "sources", "counts", shares(), q)
    return wide.select("lang", "term", F.inline(found)).select("lang", "source", F.col("term").alias("item"), "value")


def audited(docs: DataFrame, *, least_docs: int = 3, most_terms: int = 200) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank of all groups of ``docs``; of the terms the best ``most_terms``."""
    terms = stored(term_counts(docs, least_docs=least_docs), "terms")
    sums = stored(totals(docs, terms), "totals")
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    ranked = lambda rows, part: rows.withColumn("rank", F.row_number().over(order)).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    # Spark keeps the best most_terms of each group in every task before they are shuffled
    best = ranked(typical(terms, sums), "term").where(F.col("rank") <= most_terms)
    return ranked(pairs(terms, sums), "pair").unionByName(best)


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of sources of each language, and the 200 terms that mark each source most."""
    return audited(table(spark, sf_dir, "documents").select("text", "lang", "source"))


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS n, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT n, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS MATERIALIZED (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT n) >= 3),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
t AS MATERIALIZED (
  SELECT lang, source, coalesce(sum(c.n), 0) + coalesce(any_value(v), 0) AS whole FROM g LEFT JOIN c USING (lang, source) LEFT JOIN v USING (lang) GROUP BY ALL),
p AS MATERIALIZED (
  SELECT lang, source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // whole AS p
  FROM k JOIN t USING (lang) LEFT JOIN c USING (lang, source, term)),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
q AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 1)) // (any_value(whole) + any_value(v)) AS q
  FROM c JOIN (SELECT lang, sum(n) AS whole FROM c GROUP BY lang) USING (lang) JOIN v USING (lang) GROUP BY lang, term),
term AS (
  SELECT lang, source, 'term' AS part, term AS item, CAST(((p - q) * (p - q)) // q AS BIGINT) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank
FROM (SELECT * FROM pair UNION ALL SELECT * FROM term) QUALIFY part = 'pair' OR rank <= 200
"""
