"""Intermediate tables in the folder that driver and executors share, so that what follows is not computed twice."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; one of our own only where that is unset and the master is local, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="ravelin-")
        spark.sparkContext.setCheckpointDir(named)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(named)  # without a scheme it is on the default file system, for Spark and for tasks
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(folder).toString().rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table of files; a lost executor costs its tasks alone."""
    path = f"{shared_dir(df.sparkSession)}/ravelin-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
