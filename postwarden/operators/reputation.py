"""Sender reputation: building it and attaching it to mails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postwarden.functions import fixed as fx
from postwarden.functions import text as tx
from postwarden.functions.senders import clean_address
from postwarden.operators.joins import lookup

KEY = "from_email_norm"


def sender_key(df: DataFrame, normalise: str = "address") -> DataFrame:
    """Adds the reputation key: the cleaned address, or the raw sender in lower case.

    Rows that carry the key already are left as they are.
    """
    if KEY in df.columns:
        return df
    raw = F.lower(F.coalesce(F.col("from_email"), F.lit("")))
    return df.withColumn(KEY, clean_address("from_email") if normalise == "address" else raw)


def _count(label: str) -> Column:
    return F.count_if(F.col("label_") == fx.LABEL_CODES[label])


def sender_reputation(
    df: DataFrame, profile: str = "spam_share", normalise: str = "address"
) -> DataFrame:
    """Label counts per sender, spam ratio and whether the sender is known.

    ``spam_share`` divides spam by all mails and knows senders with more than
    one mail.  ``bad_share`` divides spam + phishing, skips empty senders and
    knows every sender seen.  Counts combine before the shuffle, so a sender
    with a third of all mails costs one partial row per task.
    """
    keyed = sender_key(df, normalise).select(KEY, tx.label_code("label").alias("label_"))
    if profile == "bad_share":
        keyed = keyed.filter(F.col(KEY) != "")
    counted = keyed.filter(F.col("label_").isNotNull()).groupBy(KEY).agg(
        F.count(F.lit(1)).alias("sender_email_count"),
        _count("ham").alias("sender_ham_count"),
        _count("spam").alias("sender_spam_count"),
        _count("phishing").alias("sender_phish_count"),
    )
    bad = F.col("sender_spam_count")
    known = F.col("sender_email_count") > 1
    if profile == "bad_share":
        bad, known = bad + F.col("sender_phish_count"), F.lit(True)
    elif profile != "spam_share":
        raise ValueError(f"unknown profile {profile!r}")
    return counted.select(
        "*",
        (bad / F.col("sender_email_count")).alias("sender_spam_ratio"),
        known.cast("int").alias("sender_is_known"),
    )


def label_distribution(df: DataFrame, labels: list[str] = fx.LABELS) -> DataFrame:
    """Share of each label per sender, one column per label."""
    known = F.col("label").isin(labels)
    total = F.count_if(known)
    return df.filter(known).groupBy("from_email").agg(
        *[(F.count_if(F.col("label") == x) / total).alias(f"sender_label_{x}") for x in labels]
    )


def with_sender_reputation(
    df: DataFrame, reputation: DataFrame, default_ratio: float = 0.0,
    normalise: str = "address", row_id: str = "mail_id", hot_share: float | None = None,
) -> DataFrame:
    """Reputation columns for every row; unknown senders get 0 and ``default_ratio``.

    The join may shuffle ``df``, so reduce mails to what is needed first.
    """
    joined = lookup(
        sender_key(df, normalise), reputation.select(KEY, *fx.REPUTATION_COLUMNS), KEY, row_id,
        hot_share,
    )
    fill = {c: default_ratio if c == "sender_spam_ratio" else 0 for c in fx.REPUTATION_COLUMNS}
    return joined.na.fill(fill)
