"""Tables that a job writes down between its steps, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only where it is unset on one machine a temporary folder stands in."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found or known.isDefined():
        return (found or known.get()).rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="tideline-")
    atexit.register(shutil.rmtree, own, True)
    spark.sparkContext.setCheckpointDir(f"file://{own}")
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write a table and read it again: what follows starts there, and a lost executor costs no earlier step."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
