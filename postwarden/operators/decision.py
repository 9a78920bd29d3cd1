"""From class scores and risk to a label, its confidence, category and explanation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postwarden.functions import fixed as fx


def _scores() -> tuple[Column, Column, Column]:
    return F.col("ham_score"), F.col("spam_score"), F.col("phishing_score")


def top_label(order: list[str] = fx.LABELS) -> Column:
    """Label of the highest score; equal scores go to the first in ``order``."""
    best = F.greatest(*_scores())
    out = F.when(F.col(f"{order[0]}_score") == best, order[0])
    for name in order[1:]:
        out = out.when(F.col(f"{name}_score") == best, name)
    return out


def decide_label(df: DataFrame, profile: str = "live") -> DataFrame:
    """Adds predicted_label, model_confidence, category and explanation.

    ``live`` lets strong spam and phishing evidence override the model,
    ``override`` decides by risk first, ``model_first`` only turns ham into spam.
    """
    decide = {"live": _live, "override": _override, "model_first": _model_first}
    if profile not in decide:
        raise ValueError(f"unknown profile {profile!r}")
    return decide[profile](df)


def _reasons() -> Column:
    return F.size("risk_factors").cast("string")


def _first_three() -> Column:
    return F.array_join(F.transform(F.slice("risk_factors", 1, 3), lambda f: f["description"]), ", ")


def _live(df: DataFrame) -> DataFrame:
    _, spam, phish = _scores()
    risk = F.col("risk_score")
    best = F.greatest(*_scores())
    to_spam = (
        (F.col("spam_keyword_count") >= 3) | (F.col("subject_has_buy_now") == 1)
        | ((spam > 0.3) & (risk >= 15))
    )
    to_phish = (risk >= 60) & (phish > 0.15)
    labelled = df.select(
        "*",
        F.when(to_phish, "phishing").when(to_spam, "spam").otherwise(top_label())
        .alias("predicted_label"),
        F.least(F.lit(0.99), best).alias("model_confidence"),
    )
    label = F.col("predicted_label")
    categorised = labelled.select(
        "*",
        F.when((label == "spam") & (risk > 30), "spam_high_risk")
        .when(label == "spam", "spam_promotional")
        .when((label == "phishing") & (risk >= 60), "phishing_critical")
        .when(label == "phishing", "phishing_suspicious").alias("category"),
    )
    texts = {
        "spam_high_risk": F.concat(
            F.lit("Classified as HIGH-RISK SPAM: "), _reasons(),
            F.lit(" risk indicators with aggressive marketing tactics")),
        "spam_promotional": F.lit(
            "Classified as SPAM due to promotional content and marketing keywords"),
        "phishing_critical": F.concat(
            F.lit("CRITICAL PHISHING THREAT: "), _reasons(),
            F.lit(" phishing indicators detected - Immediate action recommended")),
        "phishing_suspicious": F.concat(
            F.lit("Suspicious phishing attempt: "), _reasons(), F.lit(" risk indicators detected")),
    }
    explanation = F.lit("Legitimate email with no significant risk indicators")
    for name, text in texts.items():
        explanation = F.when(F.col("category") == name, text).otherwise(explanation)
    return categorised.select("*", explanation.alias("explanation"))


def _override(df: DataFrame) -> DataFrame:
    _, spam, phish = _scores()
    risk, reasons = F.col("risk_score"), F.size("risk_factors")
    severe, high = risk >= 60, risk >= 35
    by_phish = (phish > 0.15) & (reasons >= 2)
    by_spam = (spam > 0.25) & (reasons >= 2)
    label = (
        F.when(severe, "phishing")
        .when(high, F.when(phish > spam, "phishing").otherwise("spam"))
        .when(by_phish, "phishing").when(by_spam, "spam")
        .otherwise(top_label(["phishing", "spam", "ham"]))
    )
    confidence = (
        F.when(severe, F.least(F.lit(0.95), phish + risk / 100))
        .when(high, F.greatest(phish, spam) + risk / 200)
        .when(by_phish, phish).when(by_spam, spam)
        .otherwise(F.greatest(*_scores()))
    )
    scored = F.concat(F.lit(" (Risk Score: "), risk.cast("string"), F.lit("/100) - "), _first_three())
    labelled = df.select("*", label.alias("predicted_label"))
    explanation = (
        F.when(severe, F.concat(F.lit("🚨 CRITICAL THREAT DETECTED"), scored))
        .when(high, F.concat(F.lit("⚠️ HIGH RISK DETECTED"), scored))
        .when(by_phish, F.concat(F.lit("Classified as phishing due to: "), _first_three()))
        .when(by_spam, F.concat(F.lit("Classified as spam due to: "), _first_three()))
        .when(F.col("predicted_label") == "ham", F.lit(None))
        .otherwise(F.concat(F.lit("Model-based classification with "), _reasons(), F.lit(" risk factors")))
    )
    return labelled.select(
        "*",
        F.least(F.lit(0.99), confidence).alias("model_confidence"),
        F.lit(None).cast("string").alias("category"),
        explanation.cast("string").alias("explanation"),
    )


def _model_first(df: DataFrame) -> DataFrame:
    model = top_label()
    to_spam = (model == "ham") & (
        (F.col("spam_keyword_count") >= 3) | (F.col("subject_has_buy_now") == 1)
        | (F.col("threat_type") == "spam")
    )
    labelled = df.select(
        "*", F.when(to_spam, "spam").otherwise(model).alias("predicted_label"),
        F.least(F.lit(0.99), F.greatest(*_scores())).alias("model_confidence"),
    )
    label = F.col("predicted_label")
    return labelled.select(
        "*",
        F.when(label == "spam", "spam_promotional").when(label == "phishing", "phishing_real")
        .alias("category"),
        F.when(
            label != "ham",
            F.concat(F.lit("ML-based classification ("), label, F.lit(") with "), _reasons(),
                     F.lit(" risk signals")),
        ).alias("explanation"),
    )
