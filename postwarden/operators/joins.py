"""Joins that stay balanced when a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 1e-4


def hot_keys(df: DataFrame, key: str, share: float = HOT_SHARE) -> DataFrame:
    """Keys holding more than ``share`` of the rows.

    There can be at most ``1 / share`` of them whatever the size of ``df``,
    which bounds the table; only the key column is scanned.
    """
    total = df.agg(F.count(F.lit(1)).alias("n")).select(F.col("n") * F.lit(share)).scalar()
    return (
        df.groupBy(key).agg(F.count(F.lit(1)).alias("rows_"))
        .filter(F.col("rows_") > total).select(key)
    )


def lookup(
    left: DataFrame, right: DataFrame, key: str, row_id: str | None = None,
    share: float | None = None,
) -> DataFrame:
    """Left join to a table that is unique on ``key``.

    By default a plain join, whose skewed partitions AQE splits.  With ``share``,
    ``left`` is read three times and rows of hot keys are served by a broadcast of the few hot ``right`` rows.
    Their join key is then replaced by a spread-out value that matches nothing,
    so the shuffled join that serves all other keys gets no hot partition.
    That value is ``row_id``, or a hash of the row.
    """
    values = [c for c in right.columns if c != key]
    if share is None:
        return left.join(right, key, "left").select(*left.columns, *values)
    keys = hot_keys(left.select(key), key, share)
    served = right.join(F.broadcast(keys), key, "left_semi").select(
        key, F.struct(*values).alias("hot_")
    )
    # A hot key stays hot when ``right`` does not know it.
    hot = keys.join(F.broadcast(served), key, "left").withColumnRenamed(key, "hot_key_")
    apart = F.col(row_id) if row_id else F.xxhash64(*left.columns)
    marked = left.join(F.broadcast(hot), F.col(key) == F.col("hot_key_"), "left").withColumn(
        "cold_key_",
        F.when(F.col("hot_key_").isNull() & F.col(key).isNotNull(), F.col(key).cast("string"))
        .otherwise(F.concat(F.lit("\x00"), apart.cast("string"))),
    )
    cold = right.select(
        F.col(key).cast("string").alias("cold_key_"), F.struct(*values).alias("cold_value_")
    )
    found = F.coalesce(F.col("hot_"), F.col("cold_value_"))
    return marked.join(cold, "cold_key_", "left").select(
        *left.columns, *[found[v].alias(v) for v in values]
    )
