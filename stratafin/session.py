"""Session helpers: defaults for tests, lineage cuts in the shared folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, shuffle: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the engine expects (UTC, AQE, Arrow)."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    reach(spark)
    return spark


def reach(spark: SparkSession) -> None:
    """Lets Python workers find this package where the driver found it, whatever folder they start in."""
    env = getattr(spark.sparkContext, "environment", None)
    if env is None:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in parts:
        env["PYTHONPATH"] = os.pathsep.join([root, *parts])


def shared_dir(spark: SparkSession) -> str:
    """The folder for lineage cuts: the cluster's own setting where there is one.

    Only in local mode, where one machine runs everything, a temporary folder
    stands in for an unset ``spark.checkpoint.dir``; elsewhere that is an error,
    for executors would write to disks of their own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="stratafin-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


_staged: list[str] = []


def stage(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: columnar, compressed, read again where needed.

    The folder is removed by ``release_staged`` or when the driver ends.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(at)
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    _staged.append(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def release_staged(spark: SparkSession) -> int:
    """Removes all staged tables; for long sessions, once the results built on them are written. Their number."""
    n = len(_staged)
    while _staged:
        path = spark._jvm.org.apache.hadoop.fs.Path(_staged.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n
