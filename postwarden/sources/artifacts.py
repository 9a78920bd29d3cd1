"""Sets of tables that are published together under a version.

The tables of a version are written first, each to a folder that nothing else uses; one row in ``published`` makes them visible.
A writer that dies before that leaves nothing that a reader sees, and two writers at once don't mix: each row names its own folder.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from postwarden.sources.tables import read_or_empty

PUBLISHED = "version int, folder string, tables array<string>"


def published(spark: SparkSession, root: str) -> DataFrame:
    """The versions that can be read."""
    return read_or_empty(spark, os.path.join(root, "published"), PUBLISHED)


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame]) -> int:
    """Writes the tables and then makes them the newest version; gives its number."""
    newest = published(spark, root).agg({"version": "max"}).first()[0]
    version = (newest or 0) + 1
    folder = f"v{version}-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(os.path.join(root, folder, name))
    spark.createDataFrame([(version, folder, sorted(tables))], PUBLISHED).coalesce(1).write.mode("append").parquet(
        os.path.join(root, "published")
    )
    return version


def load(spark: SparkSession, root: str, version: int | None = None) -> dict[str, DataFrame]:
    """The tables of a version, by default of the newest."""
    rows = published(spark, root)
    if version is not None:
        rows = rows.filter(rows["version"] == version)
    found = rows.orderBy(rows["version"].desc(), rows["folder"].desc()).first()
    if found is None:
        raise LookupError(f"no published version{'' if version is None else f' {version}'} in {root}")
    return {name: spark.read.parquet(os.path.join(root, found["folder"], name)) for name in found["tables"]}
