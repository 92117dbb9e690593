"""Queries over the text functions. The driver's texts have no markers, bullets or controls, so the queries add them, by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.functions import labels, text


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", "text", "n_chars")


def _pick(key: Column, *choices: str) -> Column:
    return F.element_at(F.array(*map(F.lit, choices)), (key % len(choices) + 1).cast("int"))


def speech_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5."""
    d = _documents(spark, sf_dir)
    marked = F.concat(F.lit("# "), "text", F.lit(" [1] **bold** `code x` [^2]\n```py\nprint(1)\n```\n> _quote_ ~ "), "text")
    return d.select("doc_id", text.speech(marked).alias("spoken"))


#: Cut at fences, at ticks and at brackets, with lists; marks and blanks go last.
SPEECH_CLEAN_SQL = r"""
WITH m AS (SELECT doc_id, '# ' || text || ' [1] **bold** `code x` [^2]' || chr(10) || '```py' || chr(10) || 'print(1)' || chr(10) || '```' || chr(10) || '> _quote_ ~ ' || text AS t FROM documents),
f AS (SELECT doc_id, string_split(t, '```') AS f FROM m),
g AS (SELECT doc_id, string_split(array_to_string(list_transform(f, lambda x, i: CASE WHEN i % 2 = 1 THEN x WHEN i = len(f) THEN '```' || x ELSE 'Code block omitted.' END), ''), '`') AS ticks FROM f),
h AS (SELECT doc_id, string_split(array_to_string(list_transform(ticks, lambda x, i: CASE WHEN i % 2 = 0 AND (i = len(ticks) OR x = '') THEN '`' || x ELSE x END), ''), '[') AS b FROM g),
k AS (SELECT doc_id, array_to_string(list_transform(b, lambda x, i: CASE WHEN i = 1 THEN x WHEN contains(x, ']') AND try_cast(ltrim(split_part(x, ']', 1), '^') AS HUGEINT) IS NOT NULL THEN substr(x, strpos(x, ']') + 1) ELSE '[' || x END), '') AS t FROM h)
SELECT doc_id, array_to_string(list_filter(string_split(translate(t, '#*_~>' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     ' || repeat(' ', 5)), ' '), lambda w: w <> ''), ' ') AS spoken FROM k"""


def copy_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4, with citations that are spelled out."""
    d = _documents(spark, sf_dir)
    n = (F.col("doc_id") % 30 + 1).cast("string")
    marked = F.concat(
        "text", F.lit(" [1, 2] . Then   two  [3][4] , and [5] \n"), "text", F.lit("  end [7] (Report.pdf, page "), n, F.lit(") [8]  on (Page "), n, F.lit(", Plan.docx) and (only a note, page 3x) (Notes.md) [9] ; (p. "), n,
        F.lit(") [2, 3] but (p. 4) stays ! [1] (Sheet.xlsx, p. "), n, F.lit(") [x] ("), "source", F.lit(")"),
    )
    return d.select("doc_id", text.copied(marked).alias("copied"))


#: References are found among the brackets by what their comma-separated parts are; then brackets, closing marks and lines.
COPY_CLEAN_SQL = r"""
WITH m AS (SELECT doc_id, text || ' [1, 2] . Then   two  [3][4] , and [5] ' || chr(10) || text || '  end [7] (Report.pdf, page ' || doc_id % 30 + 1 || ') [8]  on (Page ' || doc_id % 30 + 1 || ', Plan.docx) and (only a note, page 3x) (Notes.md) [9] ; (p. '
    || doc_id % 30 + 1 || ') [2, 3] but (p. 4) stays ! [1] (Sheet.xlsx, p. ' || doc_id % 30 + 1 || ') [x] (' || source || ')' AS t FROM documents),
a AS (SELECT doc_id, list_transform(string_split(t, '('), lambda x, i: {'i': i, 'x': x, 'inside': CASE WHEN i > 1 AND contains(x, ')') THEN split_part(x, ')', 1) END, 'rest': CASE WHEN i > 1 AND contains(x, ')') THEN substr(x, strpos(x, ')') + 1) ELSE x END}) AS a FROM m),
b AS (SELECT doc_id, list_transform(a, lambda p: {'i': p.i, 'x': p.x, 'inside': p.inside, 'rest': p.rest,
    'file': len(list_filter(['.pdf', '.doc', '.txt', '.md', '.xls'], lambda s: contains(lower(p.inside), s))) > 0,
    'page': len(list_filter(string_split(lower(p.inside), ','), lambda q: starts_with(trim(q), 'p') AND try_cast(trim(ltrim(trim(q), 'page.'))[1] AS INT) IS NOT NULL)) > 0,
    'cited': starts_with(ltrim(p.rest), '[') AND try_cast(ltrim(p.rest)[2] AS INT) IS NOT NULL}) AS b FROM a),
c AS (SELECT doc_id, array_to_string(list_transform(b, lambda p: CASE WHEN p.inside IS NULL THEN CASE WHEN p.i = 1 THEN p.x ELSE '(' || p.x END
    WHEN p.file AND p.page THEN CASE WHEN p.cited THEN substr(p.rest, strpos(p.rest, ']') + 1) WHEN p.i > 1 AND ends_with(rtrim(b[p.i - 1].rest), ']') THEN p.rest ELSE ltrim(p.rest) END
    WHEN (p.file OR p.page) AND p.cited THEN substr(p.rest, strpos(p.rest, ']') + 1) ELSE '(' || p.inside || ')' || p.rest END), '') AS t FROM b),
d AS (SELECT doc_id, list_transform(string_split(t, '['), lambda x, i: {'is': i > 1 AND contains(x, ']') AND len(list_filter(string_split(split_part(x, ']', 1), ','), lambda n: try_cast(trim(n) AS HUGEINT) IS NULL)) = 0, 'first': i = 1, 'x': x}) AS d FROM c),
e AS (SELECT doc_id, list_transform(d, lambda p: CASE WHEN p.is THEN substr(p.x, strpos(p.x, ']') + 1) WHEN p.first THEN p.x ELSE '[' || p.x END) AS e, d FROM d),
f AS (SELECT doc_id, array_to_string(list_transform(e, lambda x, i: CASE WHEN i < len(e) AND d[i + 1].is THEN rtrim(x, ' ' || chr(9) || chr(10) || chr(13)) ELSE x END), '') AS t FROM e),
""" + "".join(f"""g{i} AS (SELECT doc_id, array_to_string(list_transform(string_split(t, '{mark}'), lambda x, i: CASE WHEN i < len(string_split(t, '{mark}')) THEN rtrim(x, ' ' || chr(9) || chr(10) || chr(13)) ELSE x END), '{mark}') AS t FROM {f"g{i - 1}" if i else "f"}),
""" for i, mark in enumerate(text.CLOSING_MARKS)) + r"""h AS (SELECT doc_id, list_transform(string_split(t, chr(10)), lambda line: rtrim(array_to_string(list_transform(string_split(line, '  '), lambda x, i: CASE WHEN i = 1 THEN x ELSE ltrim(x) END), ' '))) AS lines FROM g5)
SELECT doc_id, trim(array_to_string(lines, chr(10)), ' ' || chr(9) || chr(10) || chr(13)) AS copied FROM h"""


def sanitize_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1, the built-in steps."""
    d = _documents(spark, sf_dir)
    marked = F.concat(F.lit("data: "), "text", F.lit("\n: keepalive\nglued• one •two [DONE]\\x08 \\u0008x\x07\n\n\n\nend "), "text")
    return d.select("doc_id", text.sanitized(marked).alias("clean"))


#: By lines, by characters, by backslashes and by bullets; of blank lines in a row one stays.
SANITIZE_STREAM_SQL = r"""
WITH m AS (SELECT doc_id, 'data: ' || text || chr(10) || ': keepalive' || chr(10) || 'glued• one •two [DONE]\x08 \u0008x' || chr(7) || chr(10) || chr(10) || chr(10) || chr(10) || 'end ' || text AS t FROM documents),
l AS (SELECT doc_id, replace(array_to_string(list_transform(string_split(t, chr(10)), lambda x: CASE WHEN starts_with(x, 'data:') THEN ltrim(x[6:]) WHEN starts_with(x, ':') AND trim(x[2:]) = 'keepalive' THEN '' ELSE x END), chr(10)), '[DONE]', '') AS t FROM m),
c AS (SELECT doc_id, array_to_string(list_filter(string_split(t, ''), lambda x: NOT (ord(x) < 9 OR ord(x) IN (11, 12, 127) OR ord(x) BETWEEN 14 AND 31)), '') AS t FROM l),
b AS (SELECT doc_id, list_transform(string_split(t, '\'), lambda x, i: {'x': x, 'first': i = 1, 'hex': CASE WHEN starts_with(x, 'x') THEN lower(x[2:3]) WHEN starts_with(x, 'u00') AND x[4] IN ('0', '1') THEN lower(x[4:5]) END, 'size': CASE WHEN starts_with(x, 'x') THEN 4 ELSE 6 END}) AS b FROM c),
e AS (SELECT doc_id, array_to_string(list_transform(b, lambda p: CASE WHEN p.first THEN p.x WHEN list_contains(list_transform(list_filter(range(128), lambda n: n < 9 OR n IN (11, 12, 127) OR n BETWEEN 14 AND 31), lambda n: printf('%02x', n)), p.hex) THEN substr(p.x, p.size) ELSE '\' || p.x END), '') AS t FROM b),
u AS (SELECT doc_id, string_split(t, '•') AS u FROM e),
p AS (SELECT doc_id, string_split(array_to_string(list_transform(u, lambda x, i: CASE WHEN i = 1 THEN rtrim(x, ' ' || chr(10)) WHEN i = len(u) THEN ltrim(x, ' ' || chr(10)) ELSE trim(x, ' ' || chr(10)) END), chr(10) || chr(10) || '• '), chr(10)) AS lines FROM u)
SELECT doc_id, array_to_string(list_filter(lines, lambda x, i: x <> '' OR i = 1 OR lines[i - 1] <> ''), chr(10)) AS clean FROM p"""


def slug_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T6, T8, T9, P18."""
    d = _documents(spark, sf_dir)
    start = F.col("text")
    return d.select("doc_id", text.title(start).alias("title"), text.slug(start).alias("slug"), text.export_name("report", start, F.lit("2024-05-06").cast("date"), "md").alias("file"), text.doc_name(F.concat("source", F.lit("_annual-report.v2.pdf"))).alias("name"))


SLUG_TITLE_SQL = r"""
WITH a AS (SELECT doc_id, source, text AS t FROM documents),
b AS (SELECT *, trim(regexp_replace(t, '\s+', ' ', 'g')) AS one, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(t), '[^a-z0-9\s-]', '', 'g'), '^\s+', ''), '\s+$', ''), '\s+', '-', 'g') AS s FROM a)
SELECT doc_id, CASE WHEN one = '' THEN 'New Chat' WHEN length(one) <= 42 THEN one ELSE trim(substr(one, 1, 42)) || '...' END AS title,
  coalesce(nullif(substr(s, 1, 36), ''), 'research-response') AS slug, 'report-' || coalesce(nullif(substr(s, 1, 32), ''), 'research-response') || '-2024-05-06.md' AS file,
  source || ' annual report.v2' AS name FROM b"""


def suggestion_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source up to four different follow-ups, from three lists in their order of preference."""
    d = _documents(spark, sf_dir)
    said = lambda *parts: F.concat(*(F.col(p) if p in ("text", "source", "lang") else F.lit(p) for p in parts))
    lists = F.concat(F.array(said("text", "?"), said("text", "...")), F.array(said("What of  ", "source", " ?")), F.array(said("lang", "."), said("source", "\n", "text")))
    clean = F.array_distinct(F.filter(F.transform(lists, text.suggestion), lambda s: F.length(s) > 5))
    return d.select("doc_id", F.posexplode(F.slice(clean, 1, 4)).alias("place", "query"))


SUGGESTION_RANK_SQL = r"""
WITH l AS (SELECT doc_id, unnest([{'i': 1, 'q': text || '?'}, {'i': 2, 'q': text || '...'}, {'i': 3, 'q': 'What of  ' || source || ' ?'},
    {'i': 4, 'q': lang || '.'}, {'i': 5, 'q': source || chr(10) || text}]) AS x FROM documents),
c AS (SELECT doc_id, x.i AS i, trim(regexp_replace(regexp_replace(x.q, '\s+', ' ', 'g'), '[.?]+$', '')) AS q FROM l),
f AS (SELECT doc_id, q, min(i) AS i FROM c WHERE length(q) > 5 GROUP BY 1, 2),
r AS (SELECT doc_id, q, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS place FROM f)
SELECT doc_id, CAST(place AS INT) AS place, q AS query FROM r WHERE place < 4"""


def html_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T10, T13 on pages."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return p.select("page_id", F.md5(text.html_escaped(F.col("html")).cast("binary")).alias("escaped_md5"), F.md5(text.inline_html(F.concat(F.lit("**a** `b` "), "html")).cast("binary")).alias("inline_md5"))


HTML_ESCAPE_SQL = r"""
WITH e AS (SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#039;') AS h FROM pages)
SELECT page_id, md5(h) AS escaped_md5, md5(regexp_replace(regexp_replace('**a** `b` ' || h, '\*\*(.+?)\*\*', '<strong>\1</strong>', 'g'), '`(.+?)`', '<code>\1</code>', 'g')) AS inline_md5 FROM e"""


def provider_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T14 on keys made from ids."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    h = F.md5(F.col("o_orderkey").cast("string").cast("binary"))
    prefix = _pick(F.col("o_orderkey"), "gsk_", "AIzaSy", "nvapi-", "sk-ant-", "co-", "sk-or-", "sk-", "", "key-", " gsk_")
    key = F.when(F.col("o_orderkey") % 17 == 0, F.concat(h, F.substring(h, 1, 8))).when(F.col("o_orderkey") % 23 == 0, F.lit("  ")).otherwise(F.concat(prefix, h))
    return o.select("o_orderkey", key.alias("key")).withColumn("provider", text.provider(F.col("key")))


PROVIDER_DETECT_SQL = r"""
WITH k AS (SELECT o_orderkey, CASE WHEN o_orderkey % 17 = 0 THEN md5(CAST(o_orderkey AS VARCHAR)) || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) WHEN o_orderkey % 23 = 0 THEN '  '
  ELSE (['gsk_', 'AIzaSy', 'nvapi-', 'sk-ant-', 'co-', 'sk-or-', 'sk-', '', 'key-', ' gsk_'])[o_orderkey % 10 + 1] || md5(CAST(o_orderkey AS VARCHAR)) END AS key FROM orders),
t AS (SELECT *, trim(key) AS k FROM k)
SELECT o_orderkey, key, CASE WHEN k = '' THEN 'unknown' WHEN k LIKE 'gsk\_%' ESCAPE '\' THEN 'groq' WHEN starts_with(k, 'AIza') THEN 'gemini' WHEN starts_with(k, 'nvapi-') THEN 'nvidia'
  WHEN starts_with(k, 'sk-ant-') THEN 'anthropic' WHEN starts_with(k, 'co-') OR length(k) = 40 THEN 'cohere' WHEN starts_with(k, 'sk-or-') THEN 'openrouter' WHEN starts_with(k, 'sk-') THEN 'openai'
  WHEN regexp_full_match(k, '[a-zA-Z0-9]{32}') THEN 'mistral' ELSE 'custom' END AS provider FROM t"""


def url_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F15, T17 on the pages' addresses."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    c = text.checked_url(F.col("url"))
    return p.select("page_id", c.alias("c"), text.gateway(F.col("url")).alias("root")).select("page_id", "root", "c.is_valid", "c.error", "c.warning", "c.fix", "c.trailing_slash", "c.has_path")


URL_VALIDATE_SQL = r"""
WITH u AS (SELECT page_id, url, starts_with(url, 'https://') AS secure, ends_with(url, '/') AS slash, lower(regexp_extract(url, '^(https?://[^/?#]+)', 1)) AS root,
  regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) NOT IN ('', '/') AS path FROM pages)
SELECT page_id, root, secure AS is_valid, CASE WHEN NOT secure THEN 'scheme' END AS error,
  CASE WHEN secure AND slash AND path THEN 'path and slash' WHEN secure AND path THEN 'path' WHEN secure AND slash THEN 'slash' END AS warning,
  CASE WHEN NOT secure THEN 'https://' || substr(url, 8) WHEN slash OR path THEN root END AS fix, slash AS trailing_slash, secure AND path AS has_path FROM u"""


def date_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1, D2, D3, D4 on events, as of a fixed time."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    as_of = F.lit("2024-01-30 12:00:00").cast("timestamp")
    at = F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    given = F.when(F.col("event_id") % 50 == 0, "Just now").when(F.col("event_id") % 51 == 0, "soon").when(F.col("event_id") % 52 == 0, F.concat(F.lit("2023"), F.substring(at, 5, 20))).otherwise(at)
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return e.select("event_id", labels.session_date(given, as_of).alias("label"), labels.last_connected(F.when(F.col("event_id") % 9 > 0, ms), F.col("event_id") % 10 == 0, F.unix_millis(as_of)).alias("connected"))


DATE_LABELS_SQL = r"""
WITH e AS (SELECT event_id, ts AS own, CASE WHEN event_id % 52 = 0 THEN CAST(replace(strftime(ts, '%Y-%m-%d %H:%M:%S'), '2024-', '2023-') AS TIMESTAMP) ELSE date_trunc('second', ts) END AS ts1, TIMESTAMP '2024-01-30 12:00:00' AS ref FROM events),
a AS (SELECT *, epoch(ref) - epoch(ts1) AS age, CAST(floor((epoch_ms(ref) - epoch_ms(own)) / 60000) AS BIGINT) AS m FROM e)
SELECT event_id, CASE WHEN event_id % 50 = 0 THEN 'Just now' WHEN event_id % 51 = 0 THEN 'soon' WHEN age < 60 THEN 'Just now'
    WHEN CAST(ts1 AS DATE) = CAST(ref AS DATE) THEN 'Today, ' || strftime(ts1, '%-I:%M %p') WHEN CAST(ts1 AS DATE) = CAST(ref AS DATE) - 1 THEN 'Yesterday, ' || strftime(ts1, '%-I:%M %p')
    WHEN year(ts1) = year(ref) THEN strftime(ts1, '%b %-d') ELSE strftime(ts1, '%b %-d, %Y') END AS label,
  'Last connected: ' || CASE WHEN event_id % 10 = 0 THEN 'Just now' WHEN event_id % 9 = 0 THEN 'Never' WHEN m < 1 THEN 'Just now'
    WHEN m < 60 THEN m || ' minute' || CASE WHEN m = 1 THEN '' ELSE 's' END || ' ago' WHEN m // 60 < 24 THEN m // 60 || ' hour' || CASE WHEN m // 60 = 1 THEN '' ELSE 's' END || ' ago'
    ELSE m // 1440 || ' day' || CASE WHEN m // 1440 = 1 THEN '' ELSE 's' END || ' ago' END AS connected FROM a"""


def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of pages."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    t = text.stripped_html(F.col("html"))
    return p.select("page_id", F.length(t).alias("n_chars"), F.md5(t.cast("binary")).alias("text_md5"))


HTML_TEXT_SQL = r"""
WITH t AS (SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
  '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'),
  '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#039;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS t FROM pages)
SELECT page_id, CAST(length(t) AS INT) AS n_chars, md5(t) AS text_md5 FROM t"""


def size_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N1, N6, N8, P13, P21 as numbers: rounded values rather than labels, as engines print halves differently."""
    d = _documents(spark, sf_dir)
    mb = F.col("n_chars") / 4096.0
    return d.select("doc_id", labels.half_up(mb * 1024).alias("kb"), F.greatest(F.lit(1), labels.half_up(F.col("n_chars") / 500)).cast("long").alias("pages"), labels.clamped(F.col("n_chars") % 140).alias("progress"),
                    F.round(labels.wave((F.col("doc_id") % 10) / 10, F.col("doc_id") % 2 == 0, F.col("doc_id")), 6).alias("wave"))


SIZE_LABELS_SQL = """
SELECT doc_id, CAST(floor(n_chars / 4096.0::DOUBLE * 1024 + 0.5) AS BIGINT) AS kb, greatest(1, CAST(floor(n_chars / 500.0::DOUBLE + 0.5) AS BIGINT)) AS pages,
  greatest(15, least(100, n_chars % 140)) AS progress,
  round(CASE WHEN doc_id % 2 = 0 THEN greatest((doc_id % 10) / 10.0::DOUBLE, 0.75 + (doc_id % 3) * 0.4::DOUBLE) ELSE least((doc_id % 10) / 10.0::DOUBLE, 0.35::DOUBLE) END, 6) AS wave FROM documents"""


def word_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Escaped text in lines of 80; the sum of the lines' lengths and blanks is that of the words."""
    d = _documents(spark, sf_dir)
    return d.select("doc_id", F.posexplode(text.wrapped(text.pdf_escaped(F.col("text")), 80)).alias("line", "content"))


#: Characters one by one, and words put on the last line as long as it is short enough.
WORD_WRAP_SQL = r"""
WITH e AS (SELECT doc_id, array_to_string(list_transform(string_split(text, ''), lambda c: CASE WHEN c IN ('\', '(', ')') THEN '\' || c WHEN ord(c) BETWEEN 32 AND 126 THEN c ELSE coalesce(CAST(map_extract_value(MAP {"""  + ", ".join(f"'{a}': '{b.replace(chr(39), chr(39) * 2)}'" for a, b in text.PDF_FOLDS) + r"""}, c) AS VARCHAR), ' ') END), '') AS t FROM documents),
w AS (SELECT doc_id, list_filter(string_split(t, ' '), lambda x: x <> '') AS w FROM e),
l AS (SELECT doc_id, string_split(CASE WHEN len(w) = 0 THEN '' ELSE list_reduce(w, lambda a, x: a || CASE WHEN length(split_part(a, chr(10), -1)) + 1 + length(x) <= 80 THEN ' ' ELSE chr(10) END || x) END, chr(10)) AS l FROM w)
SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INT) AS line, unnest(l) AS content FROM l"""
