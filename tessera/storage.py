"""Materialising intermediate results where every executor can read them."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset a local session, whose one machine sees it all, gets a fresh folder."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named and not sc.master.startswith("local") or sc.master.startswith("local-cluster") and not named:
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    if not named:
        named = "file://" + tempfile.mkdtemp(prefix="tessera-")
        sc.setCheckpointDir(named)
    return named


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def shuffled(df: DataFrame) -> DataFrame:
    """``df``, to be joined by a shuffle. Spark takes a file's compressed size for that of its rows, which may be thirty times
    as much; what grows with the input and is joined by a broadcast then doesn't fit the driver."""
    return df.hint("merge")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage: the loss of an executor never recomputes what went before.
    The files go when the driver's process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tessera/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_delete, spark, path)
    return spark.read.schema(df.schema).parquet(path)
