"""Model quality from (label, prediction) pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion_counts(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Rows per (label, prediction) pair that occurs; the only pass over the data."""
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n")
    )


def class_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(class, precision, recall, f1, support); 0 where a ratio is undefined."""
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    sides = confusion_counts(df, label, prediction).select(F.explode(F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("actual"),
                 F.lit(0).cast("long").alias("guessed"), hit.cast("long").alias("hit")),
        F.struct(F.col("prediction").alias("class"), F.lit(0).cast("long").alias("actual"),
                 F.col("n").alias("guessed"), F.lit(0).cast("long").alias("hit")),
    )).alias("s"))
    sums = sides.groupBy("s.class").agg(
        *[F.sum(f"s.{c}").alias(c) for c in ("actual", "guessed", "hit")]
    )
    return sums.select(
        "class",
        F.coalesce(F.try_divide("hit", "guessed"), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide("hit", "actual"), F.lit(0.0)).alias("recall"),
        F.coalesce(
            F.try_divide(2 * F.col("hit"), F.col("guessed") + F.col("actual")), F.lit(0.0)
        ).alias("f1"),
        F.col("actual").alias("support"),
        F.col("hit").alias("correct"),
    )


def evaluate(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: accuracy, support-weighted F1, rows."""
    return class_report(df, label, prediction).agg(
        (F.sum("correct") / F.sum("support")).alias("accuracy"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1_weighted"),
        F.sum("support").alias("rows"),
    )
