"""Cutting the lineage of operators by tables in the shared folder that the session names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names for what executors share. A folder of our own serves only a local session that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not named and master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not named:
        named = tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df, kept as Parquet in the shared folder, so that the loss of an executor loses nothing.

    checkpoint() would go on with the sizes that were guessed for df, by which tables of any size may be broadcast; here Spark knows them from the files.
    """
    path = f"{shared_folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forgotten(df: DataFrame) -> None:
    """Drops a table that checkpointed() keeps and that nothing reads any more."""
    files = df.inputFiles()
    if files:
        where = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
