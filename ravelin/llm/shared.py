"""Tables and files in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; one of our own only where that is unset and driver and tasks are one process, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="ravelin-")
        spark.sparkContext.setCheckpointDir(named)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(named)  # without a scheme it is on the default file system, for Spark and for tasks
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(folder).toString().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/ravelin-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table: what follows is not computed again if an executor is lost."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder of our own under the shared one."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def drop_table(df: DataFrame) -> None:
    """Deletes a table that ``stored`` has written, once nothing reads it any more."""
    folders = {str(PurePosixPath(f.split(":", 1)[-1]).parent) for f in df.inputFiles()}
    for folder in folders:
        if PurePosixPath(folder).name.startswith("ravelin-"):
            scheme = df.inputFiles()[0].split(folder)[0]
            drop_path(df.sparkSession, scheme + folder)


def open_fs(path: str):
    """The file system and the path in it, as tasks see them, of a path or URI under the shared folder."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        if path.startswith("file:"):
            path = "/" + path.removeprefix("file:").lstrip("/")
            return fs.LocalFileSystem(), path
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def packed(docs: DataFrame) -> Column:
    """All columns of ``docs`` as one, ``row``: ``select("row.*")`` gives them back, whatever their names are."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
