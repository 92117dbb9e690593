"""Chat sessions as rows: history pairs, titles and what follows from the order of turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def chat_history_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per conversation its title, turns, (user, assistant) pairs and last user text.

    Pairs start at every second turn from the first, so a leading system turn shifts all of them; the last six
    pairs count.
    """
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    w = Window.partitionBy("conv_id").orderBy("turn")
    pairs = c.select(
        "conv_id", "turn", "role", "text",
        (F.row_number().over(w) - 1).alias("pos"),
        F.lead("role").over(w).alias("next_role"),
        F.lead("text").over(w).alias("next_text"),
    )
    is_pair = (F.col("pos") % 2 == 0) & (F.col("role") == "user") & (F.col("next_role") == "assistant") & (F.col("text") != "") & (F.col("next_text") != "")
    user = F.col("role") == "user"
    title = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col("first_user"), r"\s+", " "), "^ +", ""), " +$", "")
    short = F.concat(F.regexp_replace(F.substring(title, 1, 44), " +$", ""), F.lit("..."))
    return (
        pairs.groupBy("conv_id")
        .agg(
            F.count("*").alias("n_turns"),
            F.least(F.count_if(is_pair), F.lit(6)).alias("n_pairs"),
            F.min_by(F.when(user, F.col("text")), F.when(user, F.col("pos"))).alias("first_user"),
            F.max_by(F.when(user, F.col("text")), F.when(user, F.col("pos"))).alias("last_user_text"),
        )
        .select(
            "conv_id",
            F.when(F.coalesce(title, F.lit("")) == "", "New Chat").when(F.length(title) > 44, short).otherwise(title).alias("title"),
            "n_turns", "n_pairs", "last_user_text",
        )
    )


CHAT_HISTORY_PAIRS_SQL = r"""
WITH p AS (
  SELECT *, row_number() OVER w - 1 AS pos, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
g AS (
  SELECT conv_id, count(*) AS n_turns,
    least(count(*) FILTER (pos % 2 = 0 AND role = 'user' AND next_role = 'assistant' AND text <> '' AND next_text <> ''), 6) AS n_pairs,
    arg_min(text, pos) FILTER (role = 'user') AS first_user, arg_max(text, pos) FILTER (role = 'user') AS last_user_text
  FROM p GROUP BY conv_id),
t AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(first_user, '\s+', ' ', 'g'), '^ +', ''), ' +$', '') AS title0 FROM g)
SELECT conv_id, CASE WHEN coalesce(title0, '') = '' THEN 'New Chat' WHEN length(title0) > 44
  THEN concat(regexp_replace(substr(title0, 1, 44), ' +$', ''), '...') ELSE title0 END AS title, n_turns, n_pairs, last_user_text
FROM t"""


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def asof_prev_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every assistant turn, as a row of feedback, with the nearest user text before it."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    c = _read(spark, sf_dir, "conversations")
    asked = F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(before)
    return c.withColumn("query", asked).where("role = 'assistant'").select("conv_id", "turn", F.coalesce("query", F.lit("")).alias("query"))


ASOF_PREV_USER_SQL = """
WITH a AS (SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (
  PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS query FROM conversations)
SELECT conv_id, turn, coalesce(query, '') AS query FROM a WHERE role = 'assistant'"""


def last_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last user text and the last assistant text of each conversation."""
    last = lambda role: F.max_by("text", F.when(F.col("role") == role, F.col("turn"))).alias(f"last_{role}")
    return _read(spark, sf_dir, "conversations").groupBy("conv_id").agg(last("user"), last("assistant"))


LAST_MESSAGES_SQL = """
SELECT conv_id, arg_max(text, turn) FILTER (role = 'user') AS last_user,
  arg_max(text, turn) FILTER (role = 'assistant') AS last_assistant FROM conversations GROUP BY conv_id"""


def transcripts(messages: DataFrame, *, block: int = 1024) -> DataFrame:
    """conv_id, transcript (Markdown, messages numbered by turn), n_messages for each conversation of ``messages`` (conv_id, turn, role, text).

    Messages are numbered and joined in blocks of ``block`` turns, and a conversation's blocks then, so that no group holds all messages of a long
    one; its transcript is one value, as that is the result. Null roles and texts are empty; a null conv_id is one conversation; messages of equal turn are in the order of
    role and text; those without a turn come first.
    """
    rows = messages.select("conv_id", "turn", *(F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")), (F.col("turn") - F.pmod("turn", F.lit(block))).alias("block"))
    sizes = rows.groupBy("conv_id", "block").agg(F.count("*").alias("size"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    placed = rows.join(sizes, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("block").eqNullSafe(F.col("b"))).withColumn("n", F.col("before") + F.row_number().over(within))
    line = F.concat(F.lit("### "), F.col("n").cast("string"), F.lit(". "), F.initcap("role"), F.lit("\n\n"), F.col("text"))
    joined = lambda key, value: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, value.alias("value")))), lambda x: x["value"]), "\n\n")
    parts = placed.groupBy("conv_id", "block").agg(joined("n", line).alias("part"), F.count("*").alias("size"), F.min("n").alias("first"))
    return parts.groupBy("conv_id").agg(joined("first", F.col("part")).alias("transcript"), F.sum("size").alias("n_messages"))


def transcript_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as one Markdown transcript with numbered messages."""
    return transcripts(_read(spark, sf_dir, "conversations"))


TRANSCRIPT_EXPORT_SQL = """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)
SELECT conv_id, string_agg('### ' || n || '. ' || upper(role[1]) || role[2:] || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY n) AS transcript,
  count(*) AS n_messages FROM r GROUP BY conv_id"""


def session_sort_pinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions (orders here) with the pinned ones first, then the latest; sessions without a time last.

    Ties go by key, which makes the order total where the original comparison is not. The place is given among the
    sessions of a customer: no order over all customers is needed.
    """
    o = _read(spark, sf_dir, "orders")
    pins = _read(spark, sf_dir, "customer").where("c_custkey % 7 = 0").select(F.col("c_custkey").alias("o_custkey"))
    flagged = o.join(pins.withColumn("of_pinned", F.lit(True)), "o_custkey", "left")
    pinned = F.coalesce("of_pinned", F.lit(False)) & (F.col("o_orderkey") % 3 == 0)
    millis = F.when(F.col("o_orderpriority") != "5-LOW", F.unix_millis(F.col("o_orderdate").cast("timestamp")))
    w = Window.partitionBy("o_custkey").orderBy(F.col("pinned").desc(), F.col("updated_ms").desc_nulls_last(), "o_orderkey")
    return flagged.select("o_custkey", "o_orderkey", pinned.alias("pinned"), millis.alias("updated_ms")).withColumn("place", F.row_number().over(w))


SESSION_SORT_PINNED_SQL = """
WITH f AS (SELECT o_custkey, o_orderkey, (c_custkey IS NOT NULL AND o_orderkey % 3 = 0) AS pinned,
    CASE WHEN o_orderpriority <> '5-LOW' THEN epoch_ms(o_orderdate) END AS updated_ms
  FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 7 = 0) ON o_custkey = c_custkey)
SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY pinned DESC, updated_ms DESC NULLS LAST, o_orderkey) AS place FROM f"""


def merged(remote: DataFrame, local: DataFrame) -> DataFrame:
    """Sessions (id, title, messages, sources, pos) of two stores. What the remote one says of a session holds;
    its messages and sources give way to the local ones only if they are empty. Local sessions follow the remote ones."""
    r, l = remote.alias("r"), local.alias("l")
    full = lambda c: F.when(F.size(f"r.{c}") > 0, F.col(f"r.{c}")).otherwise(F.coalesce(f"l.{c}", F.array().cast("array<string>"))).alias(c)
    only_local = F.col("r.id").isNull()
    return r.join(l, F.col("r.id") == F.col("l.id"), "full_outer").select(
        F.coalesce("r.id", "l.id").alias("id"),
        F.when(only_local, F.col("l.title")).otherwise(F.col("r.title")).alias("title"),
        full("messages"), full("sources"),
        only_local.cast("int").alias("store"), F.coalesce("r.pos", "l.pos").alias("pos"),
    )


def session_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J4, J5 on two overlapping parts of orders."""
    o = _read(spark, sf_dir, "orders")
    some = lambda cond, c: F.when(cond, F.array(F.col(c))).otherwise(F.array().cast("array<string>"))
    key = F.col("o_orderkey")
    remote = o.where(key % 3 != 0).select(key.alias("id"), F.concat(F.lit("remote "), "o_orderstatus").alias("title"), some(key % 2 == 0, "o_orderstatus").alias("messages"), some(key % 5 != 0, "o_orderpriority").alias("sources"), key.alias("pos"))
    local = o.where(key % 4 != 0).select(key.alias("id"), F.concat(F.lit("local "), "o_orderstatus").alias("title"), F.array(F.concat(F.lit("local "), F.col("o_orderstatus"))).alias("messages"), some(key % 7 != 0, "o_orderstatus").alias("sources"), key.alias("pos"))
    m = merged(remote, local)
    return m.select("id", "title", F.array_join("messages", "|").alias("messages"), F.array_join("sources", "|").alias("sources"), "store", "pos")


SESSION_MERGE_SQL = """
WITH r AS (SELECT o_orderkey AS id, 'remote ' || o_orderstatus AS title, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE '' END AS messages,
    CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority ELSE '' END AS sources FROM orders WHERE o_orderkey % 3 <> 0),
l AS (SELECT o_orderkey AS id, 'local ' || o_orderstatus AS title, 'local ' || o_orderstatus AS messages,
    CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus ELSE '' END AS sources FROM orders WHERE o_orderkey % 4 <> 0)
SELECT coalesce(r.id, l.id) AS id, CASE WHEN r.id IS NULL THEN l.title ELSE r.title END AS title,
  coalesce(nullif(r.messages, ''), l.messages, '') AS messages, coalesce(nullif(r.sources, ''), l.sources, '') AS sources,
  CASE WHEN r.id IS NULL THEN 1 ELSE 0 END AS store, coalesce(r.id, l.id) AS pos
FROM r FULL JOIN l ON r.id = l.id"""


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` dealt by ``key`` to as many tasks as ``spark.sql.shuffle.partitions`` says: what a task then sorts is a share of the rows, where before a
    shuffle it would be all of a file's split, and after one as much as adaptive execution puts together."""
    return rows.repartition(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1), key)


def upserted(stored: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """``stored`` with the latest change of each key in place of its row (ties: the greatest row); changed rows come first (front = 0)."""
    newest = _dealt(changes, key).groupBy(key).agg(F.max(F.struct(order, *(c for c in changes.columns if c not in (key, order)))).alias("row")).select(key, "row.*")
    kept = stored.join(newest.select(key), key, "left_anti")
    return newest.withColumn("front", F.lit(0)).unionByName(kept.withColumn("front", F.lit(1)))


def patched(stored: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """K2: columns of ``patch`` that are not null replace those of ``stored``."""
    p = patch.select(key, *(F.col(c).alias(f"new_{c}") for c in patch.columns if c != key))
    changed = set(patch.columns) - {key}
    return _dealt(stored, key).join(p, key, "left").select(*(F.coalesce(f"new_{c}", c).alias(c) if c in changed else F.col(c) for c in stored.columns))


def removed(stored: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in ``gone``; an empty ``gone`` leaves all, clearing (K4) is a filter on false."""
    return stored.join(gone.select(key), key, "left_anti")


def session_mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as sessions: some are upserted, some renamed, some deleted."""
    o = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("title"), F.col("o_orderpriority").alias("note"))
    li = _read(spark, sf_dir, "lineitem")
    changes = li.select(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("title"), F.col("l_linestatus").alias("note"), F.col("l_linenumber").alias("n"))
    up = upserted(o.withColumn("n", F.lit(0)), changes, "id", "n")
    names = o.where("id % 11 = 0").select("id", F.concat(F.lit("renamed "), "title").alias("title"))
    return removed(patched(up, names, "id"), o.where("id % 13 = 0"), "id").select("id", "title", "note", "front")


SESSION_MUTATIONS_SQL = """
WITH m AS (SELECT l_orderkey AS id, max({'n': l_linenumber, 'title': l_returnflag, 'note': l_linestatus}) AS x
  FROM lineitem GROUP BY 1), c AS (SELECT id, x.title AS title, x.note AS note FROM m),
u AS (SELECT id, title, note, 0 AS front FROM c UNION ALL
  SELECT o_orderkey, o_orderstatus, o_orderpriority, 1 FROM orders WHERE o_orderkey NOT IN (SELECT id FROM c))
SELECT u.id, CASE WHEN u.id % 11 = 0 AND o_orderkey IS NOT NULL THEN 'renamed ' || o_orderstatus ELSE u.title END AS title, note, front
FROM u LEFT JOIN orders ON o_orderkey = u.id WHERE u.id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 13 = 0)"""


def drawer(attached: DataFrame) -> DataFrame:
    """Session, docs and a list of actions (add, remove, pin with name), folded in their order."""

    def step(docs, action):
        name = action["name"]
        return (
            F.when(action["kind"] == "add", F.array_union(docs, F.array(name)))
            .when(action["kind"] == "remove", F.array_remove(docs, name))
            .when(F.array_contains(docs, name), F.array_remove(docs, name))
            .otherwise(F.array_prepend(docs, name))
        )

    return attached.withColumn("docs", F.aggregate("actions", F.col("docs"), step))
