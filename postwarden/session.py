"""Session settings and the shared working folder."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "postwarden", master: str | None = None, **conf) -> SparkSession:
    """Session with the settings the library is tuned for.

    AQE stays on so that partition counts, join strategies and skewed
    partitions are decided from runtime sizes.  ``master`` and memory are left
    to spark-submit unless given.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Call-site capture per column object makes building wide plans slow.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder path for stream state and intermediate tables.

    It lies under ``spark.checkpoint.dir``, which on a cluster names shared
    storage.  Where that is unset, it lies in the warehouse, which must not be a
    local path then unless the master is local.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        base = os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "working")
        local = base.startswith("file:") or "://" not in base
        if local and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return os.path.join(base, f"{purpose}-{uuid.uuid4().hex}")


def delete_folder(spark: SparkSession, path: str) -> None:
    """Removes a folder of any file system that Spark can write to; an absent one is fine."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


_WORKING: list[list[str]] = []


@contextmanager
def working_tables(spark: SparkSession) -> Iterator[None]:
    """Removes the tables that ``materialise`` writes inside, once what needs them has been written elsewhere."""
    _WORKING.append([])
    try:
        yield
    finally:
        for path in _WORKING.pop():
            delete_folder(spark, path)


def materialise(df: DataFrame, purpose: str) -> DataFrame:
    """Writes a result that several jobs will read to the shared folder and reads it back.

    The table stays unless ``working_tables`` is around the call.
    """
    path = shared_dir(df.sparkSession, purpose)
    if _WORKING:
        _WORKING[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
