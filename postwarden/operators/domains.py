"""Domain reputation from the mail log, from the name and from infrastructure facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postwarden.functions.senders import domain_pattern_risk

COUNTS = ["total_emails", "ham_count", "spam_count", "phishing_count"]


def domain_counts(log: DataFrame) -> DataFrame:
    """Mergeable part: counts, risk total and first/last time per sender domain."""
    label = F.col("predicted_label")
    return log.filter(F.col("domain").isNotNull() & (F.col("domain") != "")).groupBy("domain").agg(
        F.count(F.lit(1)).alias("total_emails"),
        F.count_if(label == "ham").alias("ham_count"),
        F.count_if(label == "spam").alias("spam_count"),
        F.count_if(label == "phishing").alias("phishing_count"),
        F.sum(F.col("risk_score").cast("long")).alias("risk_total"),
        F.min("classified_at").alias("first_seen"),
        F.max("classified_at").alias("last_seen"),
    )


def merge_domain_counts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Union of two partial tables, added up; associative, so batches can be merged in any order."""
    return old.unionByName(new).groupBy("domain").agg(
        *[F.sum(c).alias(c) for c in COUNTS],
        F.sum("risk_total").alias("risk_total"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
    )


def ratio_level(phish: Column, spam: Column, total: Column) -> Column:
    p, s = phish / total, spam / total
    return (
        F.when((p > 0.3) | (s > 0.5), "critical")
        .when((p > 0.1) | (s > 0.3), "high")
        .when((p > 0.05) | (s > 0.15), "medium")
        .otherwise("low")
    )


def grade_domains(counts: DataFrame) -> DataFrame:
    """Domain table from counts: observed level, and name-based score, reasons and provider flag."""
    level = ratio_level(F.col("phishing_count"), F.col("spam_count"), F.col("total_emails"))
    return counts.withColumn(
        "shape_", domain_pattern_risk(F.concat(F.lit("x@"), F.col("domain")))
    ).select(
        "domain", *COUNTS,
        level.alias("risk_level"),
        F.col("shape_.risk_score").alias("risk_score"),
        (F.col("risk_total") / F.col("total_emails")).alias("avg_risk_score"),
        F.col("shape_.is_free_provider").alias("is_free_provider"),
        F.array_contains("shape_.reasons", "high_risk_tld").alias("has_suspicious_tld"),
        F.col("shape_.reasons").alias("risk_reasons"),
        "first_seen", "last_seen",
    )


def domain_risk(log: DataFrame) -> DataFrame:
    return grade_domains(domain_counts(log))


def top_malicious_domains(domains: DataFrame, limit: int = 10) -> DataFrame:
    """Critical and high domains by phishing + spam; equal counts are ordered by name."""
    bad = F.col("phishing_count") + F.col("spam_count")
    return (
        domains.filter(F.col("risk_level").isin("critical", "high"))
        .orderBy(bad.desc(), "domain").limit(limit)
    )


def new_malicious_domains(log: DataFrame, since, history: DataFrame | None = None) -> DataFrame:
    """Domains first seen at or after ``since``, already critical or high, not in ``history``."""
    fresh = domain_risk(log).filter(
        (F.col("first_seen") >= F.lit(since)) & F.col("risk_level").isin("critical", "high")
    )
    return fresh if history is None else fresh.join(history.select("domain"), "domain", "left_anti")


def domain_infra_risk(domains: DataFrame, enrichment: DataFrame, as_of: str) -> DataFrame:
    """Score in [0, 1] from domain age, DNS records and certificate age.

    ``enrichment`` has domain, created, has_mx, has_a, has_ns, tls_not_before;
    a domain without a row counts as unknown in every respect.
    """
    day = F.to_date(F.lit(as_of))
    age = F.greatest(F.lit(0), F.datediff(day, F.col("created")))
    tls = F.greatest(F.lit(0), F.datediff(day, F.col("tls_not_before")))

    def missing(flag: str) -> Column:
        return ~F.coalesce(F.col(flag), F.lit(False))

    score = (
        F.when(F.col("created").isNull(), 0.25).when(age < 90, 0.35).when(age < 365, 0.15)
        .otherwise(0.0)
        + F.when(missing("has_mx"), 0.2).otherwise(0.0)
        + F.when(missing("has_a"), 0.15).otherwise(0.0)
        + F.when(missing("has_ns"), 0.1).otherwise(0.0)
        + F.when(F.col("tls_not_before").isNull(), 0.05).otherwise(0.0)
    )
    facts = enrichment.select("domain", "created", "has_mx", "has_a", "has_ns", "tls_not_before")
    return domains.select("domain").distinct().join(facts, "domain", "left").select(
        "domain",
        F.when(F.col("created").isNotNull(), age).alias("domain_age_days"),
        *[(~missing(c)).alias(c) for c in ("has_mx", "has_a", "has_ns")],
        F.when(F.col("tls_not_before").isNotNull(), tls).alias("ssl_age_days"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("score"),
    )
