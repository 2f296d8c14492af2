"""Materialise intermediate results as parquet tables in the shared checkpoint folder.

A pinned table cuts lineage, survives the loss of any executor, and has a known size on
disk. Because of that Catalyst itself decides between a broadcast and a shuffled join for
it (``spark.sql.autoBroadcastJoinThreshold``); no broadcast is forced anywhere.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
# Folders of the open runs, innermost last.
_open_runs: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """Folder for this application's pinned tables, below the cluster's checkpoint folder."""
    base = spark.conf.get(_SETTING, None)
    if not base:
        # Only a single-machine session may fall back to a folder of its own.
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {_SETTING} to a folder that every executor can reach")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set(_SETTING, base)
    return f"{base.rstrip('/')}/panelwright/{spark.sparkContext.applicationId}"


def pin(frame: DataFrame, label: str = "table", compression: str | None = None) -> DataFrame:
    """Write ``frame`` once and return a scan of the written table."""
    spark = frame.sparkSession
    folder = "/".join([scratch_root(spark), *_open_runs[-1:]])
    path = f"{folder}/{label}-{uuid.uuid4().hex}"
    options = {"compression": compression} if compression else {}
    frame.write.mode("errorifexists").options(**options).parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


class Run:
    """What is pinned inside a ``with`` block of this goes to a folder that can be released alone.

    Release it once the results that read these tables are written.
    """

    def __init__(self, spark: SparkSession, label: str = "run"):
        self.spark = spark
        self.name = f"{label}-{uuid.uuid4().hex}"

    def __enter__(self) -> Run:
        _open_runs.append(self.name)
        return self

    def __exit__(self, *_: object) -> None:
        _open_runs.remove(self.name)

    def release(self) -> None:
        _delete(self.spark, f"{scratch_root(self.spark)}/{self.name}")


def release(spark: SparkSession) -> None:
    """Delete every table this application has pinned."""
    _delete(spark, scratch_root(spark))


def _delete(spark: SparkSession, folder: str) -> None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
