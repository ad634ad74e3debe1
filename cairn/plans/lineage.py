"""Cutting the lineage of iterative plans with tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only in local mode, where one machine does everything, it may be unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _own:
            _own.append(f"file://{tempfile.mkdtemp(prefix='cairn-')}")
        base = _own[0]
    return base.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df as a written table: later plans start from its files, and a lost executor costs no more than its own tasks. It goes with the session."""
    spark, path = df.sparkSession, f"{shared_folder(df.sparkSession)}/cairn/plan-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)  # when the session ends
    return spark.read.schema(df.schema).parquet(path)
