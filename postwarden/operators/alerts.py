"""Alerts that compare a time window with the one before it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postwarden.operators.reports import hourly_volume, performance_rollup


def volume_spikes(log: DataFrame, threshold: float = 0.25) -> DataFrame:
    """Hours whose volume per label exceeds the previous hour's by more than ``threshold``.

    The windows run over hourly counts, one row per hour and label.  An hour
    that follows one without mails has no base and raises nothing.
    """
    w = Window.partitionBy("predicted_label").orderBy("hour")
    adjacent = F.lag("hour").over(w) == F.col("hour") - F.expr("INTERVAL 1 HOUR")
    before = F.when(adjacent, F.lag("mails").over(w))
    return (
        hourly_volume(log).withColumn("previous", before)
        .filter(F.col("mails") > F.col("previous") * (1 + threshold))
        .select(
            "hour", "predicted_label", "mails", "previous",
            (F.col("mails") / F.col("previous") - 1).alias("increase"),
        )
    )


def drift_alerts(
    log: DataFrame, feedback: DataFrame | None = None, window: str = "daily",
    max_risk_shift: float = 5.0, max_fpr_rise: float = 0.01,
) -> DataFrame:
    """Windows whose mean risk or false positive rate moved too far from the window before.

    The false positive rate is the share of bad predictions among the mails
    whose known outcome is ham; mails without an outcome don't count.
    """
    rolled = performance_rollup(log, (window,), feedback)
    w = Window.partitionBy("time_window").orderBy("metric_date")
    fpr = F.col("false_positives") / F.greatest(F.lit(1), F.col("true_negatives") + F.col("false_positives"))
    shifted = rolled.select(
        "metric_date", "time_window", "total_emails", "avg_risk_score",
        fpr.alias("false_positive_rate"),
    ).select(
        "*",
        (F.col("avg_risk_score") - F.lag("avg_risk_score").over(w)).alias("risk_shift"),
        (F.col("false_positive_rate") - F.lag("false_positive_rate").over(w)).alias("fpr_rise"),
    )
    return shifted.select(
        "*",
        (F.abs("risk_shift") > max_risk_shift).alias("risk_drift"),
        (F.col("fpr_rise") > max_fpr_rise).alias("fpr_alert"),
    ).filter(F.col("risk_drift") | F.col("fpr_alert"))
