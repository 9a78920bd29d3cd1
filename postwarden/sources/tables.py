"""Parquet, CSV and JSON tables."""

from __future__ import annotations

from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_or_empty(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A parquet table, or an empty one of the schema where the path does not exist."""
    try:
        return spark.read.schema(schema).parquet(path)
    except (AnalysisException, Py4JError) as problem:
        if "PATH_NOT_FOUND" in str(problem):
            return spark.createDataFrame([], schema)
        raise


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Overwrites a table, split into folders by ``by`` so that readers can skip them."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Quoted CSV that keeps line breaks and outer blanks of texts."""
    keep = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode("overwrite").options(header=True, escape='"', **keep).csv(path)


def write_top_json(df: DataFrame, path: str, by: str, limit: int = 200) -> None:
    """The ``limit`` rows with the highest ``by``, as JSON lines; equal ones by the other columns in turn."""
    rest = [F.col(c) for c in df.columns if c != by]
    df.orderBy(F.col(by).desc(), *rest).limit(limit).write.mode("overwrite").json(path)


def write_manifest(spark: SparkSession, names: list[str], path: str) -> None:
    """Feature names with their positions, as JSON lines."""
    rows = list(enumerate(names))
    spark.createDataFrame(rows, "position int, feature string").coalesce(1).write.mode(
        "overwrite"
    ).json(path)


def read_manifest(spark: SparkSession, path: str) -> list[str]:
    rows = spark.read.schema("position int, feature string").json(path).orderBy("position")
    return [r["feature"] for r in rows.collect()]
