"""Rule-based risk score with its factors, in two profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postwarden.functions import fixed as fx
from postwarden.functions import text as tx
from postwarden.functions.senders import domain_pattern_risk
from postwarden.operators.reports import severity

FACTOR = "struct<type:string,weight:string,value:string,description:string>"


def _factor(kind: str, weight: str, value: Column | None, description) -> Column:
    text = description if isinstance(description, Column) else F.lit(description)
    return F.struct(
        F.lit(kind).alias("type"), F.lit(weight).alias("weight"),
        (F.lit(None).cast("string") if value is None else value.cast("string")).alias("value"),
        text.alias("description"),
    ).cast(FACTOR)


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('\\"')), F.lit('"'))


def _counted(n: Column, tail: str) -> Column:
    return F.concat(n.cast("string"), F.lit(tail))


class _Rules:
    """Rules in evaluation order; each is (condition, points, factor)."""

    def __init__(self):
        self.rules: list[tuple[Column, int, Column]] = []

    def add(self, condition: Column, points: int, factor: Column) -> None:
        self.rules.append((F.coalesce(condition, F.lit(False)), points, factor))

    def points(self) -> Column:
        return sum((F.when(c, p).otherwise(0) for c, p, _ in self.rules), F.lit(0))

    def factors(self) -> list[Column]:
        return [F.when(c, f) for c, _, f in self.rules]


def risk_signals(df: DataFrame) -> DataFrame:
    """Adds the counts both profiles use; needs ``combined_`` and ``from_`` of the serve inputs."""
    text = F.col("combined_")
    return df.select(
        "*",
        domain_pattern_risk("from_").alias("domain_reputation"),
        tx.keywords_present("combined_", fx.PHISHING_PHRASES).alias("phrases_"),
        tx.keyword_occurrences("combined_", fx.URGENCY_TERMS).alias("urgency_"),
        F.regexp_count(text, F.lit(fx.LARGE_AMOUNT)).alias("amounts_"),
        text.rlike(fx.DISCOUNT).alias("discount_"),
    )


SIGNALS = ["phrases_", "urgency_", "amounts_", "discount_"]


def risk_score(df: DataFrame, profile: str = "additive") -> DataFrame:
    """Adds risk_score, severity, risk_factors, domain_reputation and the threat columns.

    Needs the serve features with ``from_``, ``sender_is_known``, and either
    ``combined_`` or the columns of ``risk_signals``.  ``additive`` has threat_type ``none`` and zero
    sub-scores; ``threat_typed`` tells phishing and spam points apart.
    """
    signals = df if SIGNALS[0] in df.columns else risk_signals(df)
    if profile == "additive":
        scored = _additive(signals)
    elif profile == "threat_typed":
        scored = _threat_typed(signals)
    else:
        raise ValueError(f"unknown profile {profile!r}")
    return scored.drop(*SIGNALS)


def _factor_list(columns: list[Column]) -> Column:
    return F.array_compact(F.array(*columns))


def _money(discount: Column) -> Column:
    return F.concat(
        F.lit('{"symbols": '), F.col("spam_money_symbol").cast("string"),
        F.lit(', "amounts": '), F.col("amounts_").cast("string"),
        F.lit(', "discount": '), discount.cast("string"), F.lit("}"),
    )


def _additive(df: DataFrame) -> DataFrame:
    level, domain = F.col("domain_reputation.risk_level"), F.col("domain_reputation.domain")
    reasons = F.array_join("domain_reputation.reasons", ", ")
    phrases, keywords = F.col("phrases_"), F.col("spam_keyword_count")
    urgency = F.col("urgency_")
    r = _Rules()
    r.add(level == "critical", 40, _factor(
        "critical_domain", "critical", _quoted(domain), F.concat(F.lit("High-risk domain: "), reasons)))
    r.add(level == "high", 20, _factor(
        "suspicious_domain", "high", _quoted(domain), "Suspicious domain patterns detected"))
    r.add(F.col("ip_in_url") == 1, 40, _factor(
        "ip_based_url", "critical", None, "URL uses IP address instead of domain"))
    r.add(phrases >= 3, 30, _factor(
        "phishing_phrases", "critical", phrases, _counted(phrases, " phishing phrases detected")))
    r.add((phrases >= 1) & (phrases < 3), 15, _factor(
        "phishing_phrases", "high", phrases, "Phishing-related phrases found"))
    r.add(keywords >= 5, 15, _factor(
        "promotional_content", "medium", keywords,
        _counted(keywords, " promotional keywords detected")))
    r.add((F.col("spam_money_symbol") >= 2) | (F.col("amounts_") >= 2), 15, _factor(
        "financial_promotion", "medium", _money(F.lit("false")),
        "Financial promotions/discounts - marketing email"))
    r.add(F.col("suspicious_sender") == 1, 15, _factor(
        "suspicious_sender", "high", None, "Suspicious sender address pattern"))
    r.add(urgency >= 3, 15, _factor(
        "urgency_tactics", "medium", urgency, "Urgency pressure tactics detected"))
    # The first-time rule looks at the points so far, so they are staged as a column.
    staged = df.select("*", r.points().cast("int").alias("base_"))
    late = _Rules()
    late.add((F.col("sender_is_known") == 0) & (F.col("base_") > 0), 10, _factor(
        "unknown_sender", "low", None, "First-time sender"))
    late.add(F.col("suspicious_tld") == 1, 15, _factor(
        "suspicious_tld", "high", None, "URL uses high-risk TLD (.xyz, .top, .ru, .cn)"))
    total = staged.select("*", (F.col("base_") + late.points()).cast("int").alias("risk_score"))
    return total.select(
        "*",
        severity(F.col("risk_score")).alias("severity"),
        _factor_list(r.factors() + late.factors()).alias("risk_factors"),
        F.lit("none").alias("threat_type"),
        F.lit(0).alias("phishing_indicators"),
        F.lit(0).alias("spam_indicators"),
    ).drop("base_")


def _threat_typed(df: DataFrame) -> DataFrame:
    level, domain = F.col("domain_reputation.risk_level"), F.col("domain_reputation.domain")
    reasons = F.array_join("domain_reputation.reasons", ", ")
    phrases, keywords = F.col("phrases_"), F.col("spam_keyword_count")
    urgency = F.col("urgency_")
    sender = F.col("suspicious_sender") == 1
    posing = sender & tx.contains_any("from_", fx.IMPERSONATED)
    phish = _Rules()
    phish.add(F.col("ip_in_url") == 1, 40, _factor(
        "ip_based_url", "critical", None, "URL uses IP address - STRONG phishing indicator"))
    phish.add(phrases >= 3, 30, _factor(
        "phishing_phrases", "critical", phrases,
        _counted(phrases, " phishing phrases - credential harvesting attempt")))
    phish.add((phrases >= 1) & (phrases < 3), 15, _factor(
        "phishing_phrases", "high", phrases, "Account verification phrases detected"))
    phish.add(level == "critical", 40, _factor(
        "critical_domain", "critical", _quoted(domain), F.concat(F.lit("High-risk domain: "), reasons)))
    phish.add(level == "high", 20, _factor(
        "suspicious_domain", "high", _quoted(domain), "Suspicious domain patterns"))
    phish.add(posing, 25, _factor(
        "sender_impersonation", "critical", None, "Sender impersonating trusted service"))
    plain_sender = _Rules()
    plain_sender.add(sender & ~posing, 15, _factor(
        "suspicious_sender", "high", None, "Suspicious sender address pattern"))
    is_phish = (
        (F.col("ip_in_url") == 1) | (phrases >= 3) | (level == "critical") | posing
    )
    spam = _Rules()
    spam.add(keywords >= 10, 30, _factor(
        "marketing_keywords", "high", keywords,
        _counted(keywords, " promotional keywords - marketing email")))
    spam.add((keywords >= 5) & (keywords < 10), 15, _factor(
        "promotional_content", "medium", keywords, _counted(keywords, " promotional keywords")))
    money = (F.col("spam_money_symbol") >= 2) | (F.col("amounts_") >= 2) | F.col("discount_")
    spam.add(money & ~is_phish, 15, _factor(
        "financial_promotion", "medium", _money(F.col("discount_")),
        "Financial promotions/discounts - marketing email"))
    shared = _Rules()
    shared.add(urgency >= 3, 15, _factor(
        "urgency_tactics", "medium", urgency, "Urgency pressure tactics"))
    shared.add((F.col("subject_uppercase_ratio") > 0.5) | (F.col("spam_exclamation_count") >= 5), 10,
               _factor("excessive_formatting", "medium", None,
                       "Excessive uppercase/exclamation marks"))
    staged = df.select(
        "*",
        phish.points().cast("int").alias("phishing_indicators"),
        spam.points().cast("int").alias("spam_indicators"),
        F.when(is_phish, "phishing").when((keywords >= 5) | money, "spam").otherwise("none")
        .alias("threat_type"),
    )
    p, s = F.col("phishing_indicators"), F.col("spam_indicators")
    late = _Rules()
    late.add((F.col("sender_is_known") == 0) & ((s > 0) | (p > 0)), 10, _factor(
        "unknown_sender", "low", None, "First-time sender"))
    late.add(F.col("suspicious_tld") == 1, 15, _factor(
        "suspicious_tld", "high", None, "URL uses suspicious TLD (.xyz, .top, .ru, .cn)"))
    total = staged.select(
        "*",
        (p + s + plain_sender.points() + shared.points() + late.points()).cast("int")
        .alias("risk_score"),
    )
    score = F.col("risk_score")
    graded = (
        F.when(p >= 40, "critical").when((p >= 20) | (score >= 40), "high")
        .when(score >= 20, "medium").otherwise("low")
    )
    return total.select(
        "*", graded.alias("severity"),
        _factor_list(
            phish.factors() + plain_sender.factors() + spam.factors() + shared.factors()
            + late.factors()
        ).alias("risk_factors"),
    )
