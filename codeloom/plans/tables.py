"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, a local master gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = f"file://{tempfile.mkdtemp(prefix='codeloom-')}"
    spark.conf.set("spark.checkpoint.dir", made)
    return made


#: Whether Spark deletes the shuffle files of a query when it ends, and not when the driver happens to collect its garbage.
_FREES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, tag: str, frees: bool = False) -> DataFrame:
    """``df`` written as Parquet and read again: cuts the lineage of an iteration and survives lost executors. With ``frees`` its shuffle files go at once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(_FREES, None)
    if frees:
        spark.conf.set(_FREES, "true")
    try:
        df.write.parquet(path)
    finally:
        if frees:
            spark.conf.set(_FREES, before) if before is not None else spark.conf.unset(_FREES)
    return df.sparkSession.read.schema(df.schema).parquet(path)
