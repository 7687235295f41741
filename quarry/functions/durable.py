"""Tables written between the steps of a plan that grows with each."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_top(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Where that is unset, a temporary folder serves a local session (as
    in tests); on a cluster that is an error, as nodes don't share such a folder."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all nodes share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quarry-"))
        top = spark.sparkContext.getCheckpointDir()
    return top.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """Writes ``df`` below ``shared_top`` and reads it back, which cuts its lineage; removed when the session's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_top(spark)}/quarry-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)
