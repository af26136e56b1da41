"""Results that several later steps read: computed once, kept where every executor sees them."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under spark.checkpoint.dir; where that is unset, under this machine's temporary folder if all executors run on it, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/checkpoints"
    return f"{base.rstrip('/')}/tessera-{name}{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df as a Parquet table in a shared folder."""
    path = shared_folder(df.sparkSession, "")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
