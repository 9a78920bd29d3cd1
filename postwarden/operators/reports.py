"""Reports over the scored mail log.  ``as_of`` is always a parameter, never the wall clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postwarden.functions.times import trunc_time

AT = "classified_at"


def look_back(log: DataFrame, as_of: str, hours: int) -> DataFrame:
    """Rows at or after ``as_of`` minus ``hours``; a literal bound, so scans can skip row groups."""
    return log.filter(F.col(AT) >= F.expr(f"TIMESTAMP_NTZ '{as_of}' - INTERVAL {int(hours)} HOURS"))


def label_shares(df: DataFrame, label: str = "predicted_label") -> DataFrame:
    """Mails and share per label."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("mails"))
    total = F.sum("mails").over(Window.partitionBy())  # over one row per label
    return counts.select(label, "mails", (F.col("mails") / total).alias("share"))


def label_stats(log: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    return look_back(log, as_of, hours).groupBy("predicted_label").agg(
        F.count(F.lit(1)).alias("mails")
    )


def hourly_volume(log: DataFrame, as_of: str | None = None, hours: int = 24) -> DataFrame:
    rows = log if as_of is None else look_back(log, as_of, hours)
    return (
        rows.groupBy(trunc_time(F.col(AT), "hour").alias("hour"), "predicted_label")
        .agg(F.count(F.lit(1)).alias("mails")).orderBy("hour", "predicted_label")
    )


def sender_profile(log: DataFrame, sender: str | None = None) -> DataFrame:
    """Per-label count and mean risk, for one sender or for all."""
    rows = log if sender is None else log.filter(F.col("from_email") == sender)
    return rows.groupBy("from_email", "predicted_label").agg(
        F.count(F.lit(1)).alias("mails"), F.avg("risk_score").alias("avg_risk")
    )


def severity(score: Column) -> Column:
    return (
        F.when(score >= 60, "critical").when(score >= 35, "high").when(score >= 15, "medium")
        .otherwise("low")
    )


def recent_threats(log: DataFrame, min_risk: int = 60, limit: int = 20) -> DataFrame:
    return (
        log.filter(F.col("risk_score") >= min_risk)
        .orderBy(F.col(AT).desc(), F.col("email_id").desc()).limit(limit)
    )


def recent_mail(log: DataFrame, limit: int = 10) -> DataFrame:
    return log.orderBy(F.col(AT).desc(), F.col("email_id").desc()).limit(limit)


def search_mail(
    log: DataFrame, sender: str | None = None, label: str | None = None,
    min_risk: int | None = None, limit: int = 100,
) -> DataFrame:
    """Newest matches.  ``%`` and ``_`` in ``sender`` are wildcards; a ``min_risk`` of 0 is no filter."""
    if sender:
        log = log.filter(F.col("from_email").like(f"%{sender}%"))
    if label:
        log = log.filter(F.col("predicted_label") == label)
    if min_risk:
        log = log.filter(F.col("risk_score") >= min_risk)
    return recent_mail(log, limit)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per named table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count"
        )
        out = one if out is None else out.unionByName(one)
    return out


UNITS = {"hourly": "hour", "daily": "day", "weekly": "week"}


def performance_rollup(
    log: DataFrame, windows=("hourly", "daily", "weekly"), feedback: DataFrame | None = None,
    confidence: str | None = None, millis: str | None = None,
) -> DataFrame:
    """Volume, label, risk and error counts per hour, day and week.

    The log is reduced to hourly sums once; days and weeks add those up.
    ``feedback`` (message_id, true_label) yields false positives and negatives;
    of several outcomes of one message the first by name counts.
    """
    label, score = F.col("predicted_label"), F.col("risk_score")
    if feedback is not None:
        known = feedback.filter(F.col("message_id").isNotNull()).groupBy("message_id").agg(
            F.min("true_label").alias("true_label")
        )
        log = log.join(known, "message_id", "left")
        truth = F.col("true_label")
        wrong_bad = truth.isNotNull() & (truth == "ham") & (label != "ham")
        right_ham = truth.isNotNull() & (truth == "ham") & (label == "ham")
        wrong_ham = truth.isNotNull() & (truth != "ham") & (label == "ham")
    else:
        wrong_bad = wrong_ham = right_ham = F.lit(False)

    def total(name: str | None) -> Column:
        return F.sum(F.col(name).cast("double") if name else F.lit(None).cast("double"))

    hourly = log.groupBy(trunc_time(F.col(AT), "hour").alias("metric_date")).agg(
        F.count(F.lit(1)).alias("total_emails"),
        F.count_if(label == "ham").alias("ham_count"),
        F.count_if(label == "spam").alias("spam_count"),
        F.count_if(label == "phishing").alias("phishing_count"),
        F.count_if((score >= 35) & (score < 60)).alias("high_risk_count"),
        F.count_if(score >= 60).alias("critical_risk_count"),
        F.count_if(wrong_bad).alias("false_positives"),
        F.count_if(wrong_ham).alias("false_negatives"),
        F.count_if(right_ham).alias("true_negatives"),
        F.sum(score.cast("long")).alias("risk_total"),
        total(confidence).alias("confidence_total"),
        total(millis).alias("millis_total"),
    )
    window = F.explode(F.array(*[
        F.struct(
            F.lit(w).alias("time_window"),
            trunc_time(F.col("metric_date"), UNITS[w]).alias("metric_date"),
        ) for w in windows
    ]))
    sums = [c for c in hourly.columns if c != "metric_date"]
    rolled = hourly.select(window.alias("w_"), *sums).groupBy("w_").agg(
        *[F.sum(c).alias(c) for c in sums]
    )
    n = F.col("total_emails")
    return rolled.select(
        "w_.metric_date", "w_.time_window", *sums[:9],
        (F.col("risk_total") / n).alias("avg_risk_score"),
        (F.col("confidence_total") / n).alias("avg_confidence"),
        (F.col("millis_total") / n).alias("avg_processing_time_ms"),
    )
