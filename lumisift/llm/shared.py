"""Folders and tables that the driver and all executors share.

A table that an operator writes on its way must stay until the operator's result is written, as a lost task
reads it again. `release` drops one that nothing reads any more; `release_all` drops those of the session, and
is for the caller to call once results are written.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a fresh local one is set only where none is configured (tests)."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    known = spark.conf.get("spark.lumisift.shared.dir", None)
    if not known:
        known = "file://" + tempfile.mkdtemp(prefix="lumisift-")
        spark.conf.set("spark.lumisift.shared.dir", known)
    return known


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


#: Paths of the tables that are still there.
_stored: set[str] = set()


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and reread it: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    _stored.add(path)
    return out


def release(df: DataFrame) -> None:
    """Drop a table of `materialize` that no plan reads any more."""
    path = getattr(df, "_stored_at", None)
    if path in _stored:
        _stored.discard(path)
        name = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        name.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(name, True)


def release_all(spark: SparkSession) -> int:
    """Drop all tables that operators of this session have left; their number. Results that were not written yet can't be read after."""
    paths = list(_stored)
    _stored.clear()
    for path in paths:
        name = spark._jvm.org.apache.hadoop.fs.Path(path)
        name.getFileSystem(spark._jsc.hadoopConfiguration()).delete(name, True)
    return len(paths)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
