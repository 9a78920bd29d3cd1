"""Scoring mails: features, reputation, model scores, risk, label, response."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postwarden.functions import fixed as fx
from postwarden.operators.decision import decide_label
from postwarden.operators.features import FEATURE_NAMES, serve_features_with_inputs
from postwarden.operators.linear import SCORES, LinearModel, softmax
from postwarden.operators.model import assemble, predict_scores
from postwarden.operators.reputation import KEY, with_sender_reputation
from postwarden.operators.risk import risk_score, risk_signals
from postwarden.operators.vectors import sparse_stage, tfidf_stage
from postwarden.plans.training import NUMBERS, FeatureSpace


def risk_frame(
    mail: DataFrame, reputation: DataFrame, profile: str = "additive",
    keep: list[str] | None = None, hot_share: float | None = None,
) -> DataFrame:
    """Serve features, reputation and risk of each mail.

    Everything that needs the text is computed in the scan; the reputation is
    then joined to rows of numbers, so no body is ever shuffled.
    """
    keep = keep or ["mail_id"]
    numbers = risk_signals(serve_features_with_inputs(mail, keep)).drop("combined_")
    known = with_sender_reputation(
        numbers.withColumn(KEY, F.col("from_")), reputation, row_id=keep[0], hot_share=hot_share
    )
    return risk_score(known.drop(KEY), profile)


def score_mail(
    mail: DataFrame, reputation: DataFrame, scorer: Callable[[DataFrame], DataFrame],
    risk_profile: str = "additive", decision: str = "live", keep: list[str] | None = None,
    model_name: str = fx.MODEL_NAME,
) -> DataFrame:
    """Mails with label, confidence, risk and explanation.

    ``scorer`` adds ham_score, spam_score and phishing_score.  One that needs the texts (``ModelScorer``,
    ``VectorScorer``) reads them where they are scanned.  Rows that come with an ``error``, and rows without any content, are returned unscored with
    the reason, so one bad mail never fails a batch.
    """
    keep = keep or ["mail_id"]
    nothing = F.col("from_email").isNull() & F.col("subject").isNull() & F.col("body").isNull()
    given = F.col("error") if "error" in mail.columns else F.lit(None).cast("string")
    checked = mail.withColumn("error", F.coalesce(given, F.when(nothing, F.lit("empty message"))))
    carried = getattr(scorer, "carried", [])
    if carried:
        checked = scorer.prepare(checked)
    scored = scorer(risk_frame(checked, reputation, risk_profile, [*keep, "error", *carried])).drop(*carried)
    decided = decide_label(scored, decision).withColumn("model_used", F.lit(model_name))
    # One pass over the mails: results of bad rows are blanked instead of split off.
    good = F.col("error").isNull()
    return decided.select(
        *keep, "error",
        *[F.when(good, F.col(c)).alias(c) for c in decided.columns if c not in (*keep, "error")],
    )


def constant_scorer(ham: float, spam: float, phishing: float) -> Callable[[DataFrame], DataFrame]:
    """Fixed class scores, for rule-only use and for checks."""
    values = {"ham_score": ham, "spam_score": spam, "phishing_score": phishing}
    return lambda df: df.select("*", *[F.lit(float(v)).alias(k) for k, v in values.items()])


class ModelScorer:
    """Class scores by a linear model.

    What the terms add to the scores is worked out beside the serve features, in the scan, so that a mail carries three numbers
    through the join with its sender's reputation instead of its text or vector.
    """

    carried = ["term_logits_"]

    def __init__(self, model: LinearModel, space: FeatureSpace):
        if model.names != space.names:
            raise ValueError("the model was learnt on other features")
        self.model, self.space = model, space

    def prepare(self, mail: DataFrame) -> DataFrame:
        rows, vectors, at = mail, [], 0
        for name, vocab in (("body", self.space.body), ("subject", self.space.subject)):
            rows = sparse_stage(rows, [t for t, _ in vocab], [w for _, w in vocab], name, f"{name}_terms_")
            vectors.append((F.col(f"{name}_terms_"), at, len(vocab)))
            at += len(vocab)
        return rows.select(*mail.columns, F.array(*self.model.sparse_logits(vectors)).alias("term_logits_"))

    def __call__(self, df: DataFrame) -> DataFrame:
        numbers = self.model.number_logits(NUMBERS)
        logits = df.select("*", *[
            (F.col("term_logits_")[c] + numbers[c] + F.lit(b)).alias(f"z{c}_") for c, b in enumerate(self.model.intercepts)
        ])
        names = [f"z{c}_" for c in range(len(SCORES))]
        chances = softmax([F.col(n) for n in names])
        return logits.select("*", *[p.alias(n) for p, n in zip(chances, SCORES)]).drop(*names)


class VectorScorer:
    """Class scores by a fitted model of Spark ML; sparse vectors travel with the mails."""

    carried = ["body_vector_", "subject_vector_"]

    def __init__(self, model, space: FeatureSpace):
        self.model, self.space = model, space

    def prepare(self, mail: DataFrame) -> DataFrame:
        rows = mail
        for name, vocab in (("body", self.space.body), ("subject", self.space.subject)):
            rows = tfidf_stage(rows, [t for t, _ in vocab], [w for _, w in vocab], name, f"{name}_vector_")
        return rows

    def __call__(self, df: DataFrame) -> DataFrame:
        rows = assemble(df, [*self.carried, *NUMBERS])
        return predict_scores(rows, self.model).drop("features")


def risk_summary(scored: DataFrame, row_id: str = "mail_id") -> DataFrame:
    """The short form of a score."""
    return scored.select(
        row_id, "predicted_label", "risk_score", "severity",
        F.round("model_confidence", 4).alias("confidence"),
    )


def responses(scored: DataFrame, row_id: str = "mail_id") -> DataFrame:
    """(row_id, response): the nested answer per mail as JSON.

    The message's own id and recipients are told where the scored mails carry ``message_id`` and ``to_email``.
    """
    reputation = F.struct(*fx.REPUTATION_COLUMNS)
    nested = F.struct(
        _given(scored, "message_id", F.coalesce(F.col(row_id).cast("string"), F.lit("unknown"))).alias("message_id"),
        F.col("from_").alias("from_email"),
        _given(scored, "to_email", F.array().cast("array<string>")).alias("to"),
        F.col("subject_").alias("subject"),
        F.struct(
            *[F.round(c, 4).alias(c) for c in ("ham_score", "spam_score", "phishing_score")],
            "predicted_label", "category", "model_used",
            F.round("model_confidence", 4).alias("model_confidence"),
        ).alias("predicted"),
        F.struct(
            "risk_score", "severity", "domain_reputation", "threat_type", "phishing_indicators",
            "spam_indicators",
        ).alias("risk_analysis"),
        F.struct(*FEATURE_NAMES).alias("metadata"),
        reputation.alias("reputation"),
        F.col("risk_factors").alias("reasons"),
        "explanation",
    )
    return scored.select(row_id, F.to_json(nested, {"ignoreNullFields": "false"}).alias("response"))


def factor_rows(scored: DataFrame, row_id: str = "mail_id", at: str | None = None) -> DataFrame:
    """One row per risk factor of a mail, with the time it was found where ``at`` names one.

    The outer explode keeps Spark from deriving a filter on the factors, which
    would be pushed below the projections and compute everything twice.
    """
    found = [F.col(at).alias("detected_at")] if at else []
    return scored.select(
        row_id, *found, F.posexplode_outer("risk_factors").alias("position", "factor")
    ).filter(F.col("position").isNotNull()).select(
        row_id, "position", F.col("factor.type").alias("factor_type"),
        F.col("factor.weight").alias("weight"), F.col("factor.value").alias("value"),
        F.col("factor.description").alias("description"), *[c for c in ("detected_at",) if at],
    )


def _given(scored: DataFrame, name: str, otherwise: Column) -> Column:
    """A column that mails may come with."""
    return F.coalesce(F.col(name), otherwise) if name in scored.columns else otherwise


def log_rows(scored: DataFrame, at: str = "classified_at") -> DataFrame:
    """Scored mails as rows of the mail log: ids, addresses, scores, model, risk and times.

    ``message_id``, ``to_email`` (array) and ``sent_at`` are taken where the mails came with them (see ``keep`` of
    ``score_mail``); a mail without a message id goes by its own id.
    """
    return scored.filter(F.col("error").isNull()).select(
        F.col("mail_id").alias("email_id"), _given(scored, "message_id", F.col("mail_id").cast("string")).alias("message_id"),
        F.col("from_").alias("from_email"), _given(scored, "to_email", F.array().cast("array<string>")).alias("to_email"), F.col("subject_").alias("subject"),
        F.col("domain_reputation.domain").alias("domain"), "predicted_label", *SCORES,
        F.col("model_confidence").alias("confidence"), F.col("model_used").alias("model_version"), "risk_score", "severity",
        F.col("domain_reputation.risk_level").alias("domain_risk_level"), F.col(at),
        _given(scored, "sent_at", F.col(at)).alias("sent_at"),
    )
