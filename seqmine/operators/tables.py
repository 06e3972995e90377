"""Intermediate tables in shared storage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names. Only a local session may go without: it gets a temporary one."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="seqmine-")
        spark.conf.set("spark.checkpoint.dir", top)
    return top.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{checkpoint_dir(spark)}/seqmine-{spark.conf.get('spark.app.id')}"


def table(df: DataFrame, name: str) -> DataFrame:
    """df as a table in shared storage: computed once, its lineage ends there, and no executor holds the only copy."""
    path = f"{own_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession) -> None:
    """Deletes all intermediate tables of this application. Results that were not written yet can't be computed afterwards."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
