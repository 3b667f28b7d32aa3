"""Scratch tables in the folder that driver and executors share.

Iterative plans cut their lineage by writing a table and reading it back.  The folder is the one the
cluster names in ``spark.checkpoint.dir``; only where that is unset and all of Spark runs in this process (tests,
a laptop) a folder of this machine is made and set, which goes when the process ends.  A lost executor costs nothing: the tables are whole files in shared storage.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The shared scratch folder of this session, without a slash at its end."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share: a local one would hold a part of the rows on each machine")
        folder = tempfile.mkdtemp(prefix="lorekeep-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        named = "file://" + folder
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/lorekeep/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and return the table as read back."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._lorekeep_path = path
    return back


def discard(*tables: DataFrame | None) -> None:
    """Delete tables made by :func:`materialize` that no later plan reads."""
    for df in tables:
        path = getattr(df, "_lorekeep_path", None)
        if path:
            jvm = df.sparkSession._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` as read, or dealt over the cores where the table has fewer files than there are cores.

    A file of one row group is one task, whatever its splits.  Tables of at least as many files stay put.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if len(df.inputFiles()) < cores else df
