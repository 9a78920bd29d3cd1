"""Coordinated campaigns: bursts of bad mail from one sender domain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postwarden.functions import fixed as fx
from postwarden.functions.times import micros, trunc_time

AT = "classified_at"
BAD_LABELS = ["spam", "phishing"]


#: Width of the time blocks that running sums are carried over, and of their parts.  A part holds no more than so many instants.
BLOCK_SECONDS, PART_MICROS = 60, 100_000


def trailing_bad_counts(log: DataFrame, window_seconds: int = 600, block_seconds: int = BLOCK_SECONDS) -> DataFrame:
    """``similar_emails``: spam and phishing of the row's domain in the trailing window.

    The window includes its lower bound, the row and rows of the same instant.  Every bad row adds one at its time and takes it
    away just after the window has passed, so the count is a running sum over the instants of a domain, linear in the rows.

    Rows of one instant combine before they are shuffled.  The sum runs inside parts of a tenth of a second, over the parts of a
    minute, and over the minutes of a domain: none of these groups grows with the number of mails, whatever share of the log one
    domain, minute or instant has.
    """
    width = window_seconds * 1_000_000
    bad = F.col("predicted_label").isin(BAD_LABELS)
    timed = log.filter(F.col("domain").isNotNull() & (F.col("domain") != "")).withColumn("us_", micros(F.col(AT)))
    own = F.struct(F.col("us_").alias("at"), bad.cast("int").alias("step"))
    gone = F.struct((F.col("us_") + width + 1).alias("at"), F.lit(-1).alias("step"))
    steps = timed.select("domain", F.inline(F.when(bad, F.array(own, gone)).otherwise(F.array(own))))
    instants = steps.groupBy("domain", F.col("at").alias("us_")).agg(F.sum("step").alias("total_")).withColumn(
        "part_", F.floor(F.col("us_") / PART_MICROS).cast("long")
    )
    minute = F.floor(F.col("part_") * PART_MICROS / (block_seconds * 1_000_000)).cast("long").alias("minute_")
    parts = instants.groupBy("domain", minute, "part_").agg(F.sum("total_").alias("total_"))
    minutes = parts.groupBy("domain", "minute_").agg(F.sum("total_").alias("total_"))

    def earlier(order: str, *within: str) -> Column:
        before = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("total_").over(before), F.lit(0))

    by_minute = minutes.select("domain", "minute_", earlier("minute_", "domain").alias("minutes_"))
    by_part = parts.select("domain", "minute_", "part_", earlier("part_", "domain", "minute_").alias("parts_"))
    carried = by_part.join(by_minute, ["domain", "minute_"]).select(
        "domain", "part_", (F.col("minutes_") + F.col("parts_")).alias("carried_")
    )
    inside = Window.partitionBy("domain", "part_").orderBy("us_").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = instants.join(carried, ["domain", "part_"]).select(
        "domain", "us_", (F.sum("total_").over(inside) + F.col("carried_")).alias("similar_emails")
    )
    return timed.join(counts, ["domain", "us_"]).select(*log.columns, "similar_emails")


def campaign_alerts(log: DataFrame, window_seconds: int = 600, threshold: int = 15) -> DataFrame:
    """Rows, of any label, at which the trailing count reaches the threshold."""
    return trailing_bad_counts(log, window_seconds).filter(F.col("similar_emails") >= threshold)


def campaign_rows(alerts: DataFrame) -> DataFrame:
    """One active campaign per domain: last count, first and last alert time."""
    last = F.max(F.struct(AT, "similar_emails"))
    return alerts.groupBy("domain").agg(
        last.alias("last_"), F.min(AT).alias("first_detected")
    ).select(
        campaign_name().alias("campaign_name"), "domain",
        F.lit("coordinated_attack").alias("attack_type"),
        F.lit("active").alias("status"), F.lit("critical").alias("severity"),
        F.col("last_.similar_emails").alias("email_count"),
        "first_detected", F.col("last_." + AT).alias("last_detected"),
    )


def campaign_name() -> Column:
    return F.concat(
        F.lit("Campaign-"), F.col("domain"), F.lit("-"), F.date_format("first_detected", "yyyyMMdd")
    )


def detect_campaigns(log: DataFrame, window_seconds: int = 600, threshold: int = 15) -> DataFrame:
    return campaign_rows(campaign_alerts(log, window_seconds, threshold))


def active_campaigns(campaigns: DataFrame) -> DataFrame:
    return campaigns.filter(F.col("status") == "active").orderBy(
        F.col("last_detected").desc(), "domain"
    )


def campaign_profile(
    log: DataFrame, window_seconds: int = 600, threshold: int = 15, unit: str = "day",
    top_keywords: int = 5, keywords: list[str] = fx.SERVE_SPAM_KEYWORDS,
) -> DataFrame:
    """Profile of each campaign episode.

    An episode is a run of consecutive ``unit``s of a domain with at least one
    alert; its mails are the domain's bad mails of those units.  Needs
    ``to_email`` and ``subject`` in the log.  Keywords are counted by mails
    whose subject holds them; ties go by name.
    """
    step = F.expr("INTERVAL 1 HOUR" if unit == "hour" else "INTERVAL 1 DAY")
    slot = trunc_time(F.col(AT), unit).alias("slot_")
    alert_slots = campaign_alerts(log, window_seconds, threshold).groupBy("domain", slot).agg(
        F.min(AT).alias("first_"), F.max(AT).alias("last_")
    )
    order = Window.partitionBy("domain").orderBy("slot_")
    starts = F.coalesce(F.lag("slot_").over(order) + step < F.col("slot_"), F.lit(True))
    episodes = alert_slots.withColumn("starts_", starts.cast("int")).withColumn(
        "episode", F.sum("starts_").over(order).cast("int")
    )
    bad = log.filter(F.col("predicted_label").isin(BAD_LABELS)).withColumn("slot_", trunc_time(F.col(AT), unit))
    members = bad.join(episodes.drop("starts_"), ["domain", "slot_"])
    low = F.lower(F.coalesce(F.col("subject"), F.lit("")))
    words = list(dict.fromkeys(keywords))
    counted = F.array(*[
        F.struct((-F.count_if(low.contains(k))).alias("n"), F.lit(k).alias("keyword")) for k in words
    ])
    profile = members.groupBy("domain", "episode").agg(
        F.count(F.lit(1)).alias("email_count"),
        F.count_distinct("from_email").alias("unique_senders"),
        F.count_distinct("to_email").alias("unique_targets"),
        F.avg("risk_score").alias("avg_risk_score"),
        F.min("first_").alias("first_detected"), F.max("last_").alias("last_detected"),
        counted.alias("counted_"),
    )
    common = F.slice(F.array_sort(F.filter("counted_", lambda x: x["n"] < 0)), 1, top_keywords)
    return profile.withColumn("common_keywords", F.transform(common, lambda x: x["keyword"])).drop(
        "counted_"
    ).withColumn("campaign_name", campaign_name())
