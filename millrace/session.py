"""Session helpers."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def attach(spark: SparkSession) -> SparkSession:
    """Let Python workers on this machine import the package from where the driver found it.

    On a cluster of many machines, ship the package with --py-files or install it.
    """
    root = str(Path(__file__).resolve().parent.parent)
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(":") if p]
    if root not in paths:
        environment["PYTHONPATH"] = ":".join([root, *paths])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset (tests on one machine), a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    set_before = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_before.isDefined():
        return set_before.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="millrace-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


#: (JVM weak reference to the file index of a stashed table, its path)
_STASHED: list[tuple] = []


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def sweep(spark: SparkSession) -> None:
    """Delete the stashed tables that no plan in the JVM can reach any more."""
    for entry in list(_STASHED):
        reference, path = entry
        if reference.get() is None:
            _STASHED.remove(entry)
            _delete(spark, path)


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: the lineage is cut, executors may be lost.

    The table lives for as long as a plan refers to it.
    """
    spark = df.sparkSession
    sweep(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    index = back._jdf.queryExecution().analyzed().collectLeaves().head().relation().location()
    _STASHED.append((spark._jvm.java.lang.ref.WeakReference(index), path))
    return back


@atexit.register
def _at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    try:
        for _, path in _STASHED:
            _delete(spark, path)
    except Exception:  # the JVM may be gone already
        pass


def settled(df: DataFrame) -> DataFrame:
    """df computed once, into the shared folder: for a narrow table that several jobs read."""
    return stash(df, "settled")
