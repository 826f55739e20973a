"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of this machine, if the session runs on this machine alone."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="docveil-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def tasks(df: DataFrame, rows: int = 50_000) -> int:
    """How many tasks df takes of about so many rows."""
    return -(-df.count() // rows) or 1


def spread(df: DataFrame, key: str, rows: int = 50_000) -> DataFrame:
    """df dealt by a key, about so many rows a task: where little is read of a row but much is done with it, the size of the files
    says too little of the tasks that it takes. What is grouped or joined by the key later stays where it is."""
    return df.repartition(tasks(df, rows), key)


def kept(df: DataFrame, name: str) -> DataFrame:
    """df, written once as Parquet and read again: computed once, however often it is used, and safe from lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)
