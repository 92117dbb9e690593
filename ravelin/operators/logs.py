"""What a log that is written batch by batch says in the end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.sources.tables import shared_dir
from ravelin.streaming import sinks

BATCHES = 4


def saved_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as configurations that users save and delete in four batches, the third written twice; the last version of each."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = e.select("user_id", "event_type", "event_id", F.col("props").alias("config"), (F.col("event_id") % 7 == 3).alias("deleted"))
    path = f"{shared_dir(spark)}/ravelin-configs-{uuid.uuid4().hex}"
    for batch in (0, 1, 2, 2, 3):
        sinks.write_batch(rows.where(F.pmod(F.col("user_id") + F.col("event_id"), F.lit(BATCHES)) == batch), batch, path)
    schema = "user_id long, event_type string, event_id long, config string, deleted boolean"
    return sinks.last_versions(sinks.log(spark, path, schema), ["user_id", "event_type"], ["batch", "event_id"]).drop("deleted")


SAVED_CONFIGS_SQL = """
WITH e AS (SELECT *, (user_id + event_id) % 4 AS batch FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY batch DESC, event_id DESC) AS r FROM e)
SELECT user_id, event_type, event_id, props AS config, batch FROM r WHERE r = 1 AND event_id % 7 <> 3"""
