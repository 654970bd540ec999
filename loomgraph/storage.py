"""Cutting lineage: tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Files that a table of known size is written in at least, if it has so many partitions.
FILES = 8
#: Folders written by this process, for release().
_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """What the session names in spark.checkpoint.dir.

    Where nothing is set, a local session gets a temporary folder; on a cluster executors would write where the
    driver can't read, so that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="loomgraph-"))
    return sc.getCheckpointDir()


def stored(df: DataFrame, rows: int | None = None, each: int = 200_000) -> DataFrame:
    """df written as Parquet into the shared folder and read again: short lineage, storage that outlives executors.

    Where the caller knows a bound on the number of rows, df is written in files of about ``each`` rows (FILES at
    least), not in one for every shuffle partition: many small files cost more than what is in them.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(FILES, -(-rows // each)))
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Removes what stored() has written so far; for callers whose results are written. Returns the number of folders."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    n = len(_WRITTEN)
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(conf).delete(path, True)
    return n
