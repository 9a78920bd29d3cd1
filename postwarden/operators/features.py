"""The mail feature row, in three profiles.

Each profile is a chain of projections: clean the inputs once, derive what
several features share (lower-cased text, URL array), then the features.
No shuffle and no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postwarden.functions import fixed as fx
from postwarden.functions import senders as sd
from postwarden.functions import text as tx
from postwarden.functions import urls as ur

SERVE_SPECIAL = r"^\p{L}\p{N} "


def mail_features(
    df: DataFrame, profile: str = "train", keep: list[str] | None = None
) -> DataFrame:
    """Feature columns per mail, next to the ``keep`` columns (default ``mail_id``).

    Reads ``body``, ``subject``, ``from_email`` and, if present,
    ``raw_headers`` (string) or ``headers`` (map).  ``train`` and ``serve`` give
    the same 45 columns by different rules; ``compact`` gives 28.
    """
    keep = keep or ["mail_id"]
    if profile == "train":
        return _train(df, keep)
    if profile == "serve":
        return serve_inputs(df, keep).select(*keep, *_serve_columns())
    if profile == "compact":
        return _compact(df, keep)
    raise ValueError(f"unknown profile {profile!r}")


def _headers(df: DataFrame) -> Column:
    if "headers" in df.columns and dict(df.dtypes)["headers"].startswith("map"):
        return tx.map_text(F.col("headers"))
    for name in ("raw_headers", "headers"):
        if name in df.columns:
            return F.coalesce(F.col(name).cast("string"), F.lit(""))
    return F.lit("")


def _named(columns: dict[str, Column]) -> list[Column]:
    return [c.alias(n) for n, c in columns.items()]


# --- train ------------------------------------------------------------------


def _train(df: DataFrame, keep: list[str]) -> DataFrame:
    cleaned = df.select(
        *keep,
        tx.safe_text("body").alias("body_"),
        tx.safe_text("subject").alias("subject_"),
        F.lower(tx.safe_text("from_email")).alias("from_"),
        tx.safe_text(_headers(df)).alias("headers_"),
    )
    shared = cleaned.select(
        "*", F.concat_ws(" ", "body_", "subject_").alias("both_")
    ).select(
        "*",
        F.lower("both_").alias("lower_"),
        ur.extract_urls("both_", "train").alias("urls_"),
        sd.address_domain("from_").alias("domain_"),
    )
    urls, low, both = F.col("urls_"), F.col("lower_"), F.col("both_")
    body, sender, headers = F.col("body_"), F.col("from_"), F.col("headers_")
    columns = tx.text_stats("body_", "body_", "body", fx.ASCII_PUNCT)
    columns["body_consecutive_caps"] = tx.flag(body.rlike("[A-Z]{3,}"))
    columns |= _subject_stats("subject_", "subject_")
    columns |= {
        "url_count": F.size(urls),
        "has_url": tx.flag(F.size(urls) > 0),
        "suspicious_tld": ur.any_url(urls, ur.has_train_tld),
        "ip_in_url": ur.any_url(urls, lambda u: u.rlike(fx.IP_URL_TRAIN)),
        "shortened_url": ur.any_url(urls, ur.is_shortened),
        "https_ratio": ur.share_of(urls, lambda u: F.lower(u).startswith("https")),
        "url_length_avg": ur.mean_length(urls),
        "url_has_hex_encoding": ur.any_url(urls, lambda u: u.rlike("%[0-9A-Fa-f]{2}")),
        "url_long_query": ur.any_url(urls, lambda u: ur.query_longer_than(u, 30, True)),
    }
    columns |= html_measures("body_", "train")
    reply = F.regexp_extract(headers, f"(?i)Reply-To:[{fx.WHITE}]*(.*)", 1)
    return_path = F.regexp_extract(headers, f"(?i)Return-Path:[{fx.WHITE}]*<(.*?)>", 1)
    columns |= {
        "spam_keyword_count": tx.keyword_occurrences("lower_", fx.TRAIN_SPAM_KEYWORDS),
        "spam_money_symbol": tx.flag(tx.contains_any("lower_", fx.TRAIN_MONEY_SYMBOLS)),
        "spam_pct_off": tx.flag(tx.contains_any("lower_", ["% off", "off%"])),
        "spam_uppercase_words": tx.upper_words(both),
        "spam_exclamation_count": tx.occurrences(both, "!"),
        "spam_has_unsubscribe": tx.flag(low.contains("unsubscribe")),
        "spam_has_dear_friend": tx.flag(tx.contains_any("lower_", ["dear friend", "dear valued"])),
        "spam_has_click_here": tx.flag(low.contains("click here")),
        "sender_domain_match": tx.flag(
            (F.col("domain_") != "")
            & F.endswith(return_path, F.concat(F.lit("@"), F.col("domain_")))
        ),
        "reply_to_mismatch": tx.flag(
            reply.contains("@") & ~F.contains(sender, F.lower(tx.squeeze(reply)))
        ),
        "has_display_name": tx.flag(sender.rlike("^[^<]+<")),
        "header_length": F.length(headers),
        "free_email_provider": tx.flag(F.col("domain_").isin(fx.TRAIN_FREE_DOMAINS)),
        "suspicious_sender": tx.flag(tx.contains_any("from_", fx.TRAIN_SENDER_TOKENS)),
        "subject_has_buy_now": tx.flag(F.lower("subject_").contains("buy now")),
    }
    return shared.select(*keep, *_named(columns))


def _subject_stats(text: str, squeezed: str) -> dict[str, Column]:
    stats = tx.text_stats(text, squeezed, "subject", fx.ASCII_PUNCT)
    dropped = {"subject_special_char_ratio", "subject_question_count"}
    return {n: c for n, c in stats.items() if n not in dropped}


def html_measures(markup, profile: str = "train") -> dict[str, Column]:
    """Tag, image, script, style and inline-data counts with the tag ratio of the profile."""
    m = tx._col(markup)
    length = F.length(m)
    if profile == "train":
        space = f"[{fx.WHITE}]"
        return {
            "html_tag_count": tx.pattern_count(m, fx.TRAIN_TAG, "<"),
            "html_ratio": tx.ratio(tx.pattern_count(m, fx.TAG, "<"), length),
            "img_count": tx.pattern_count(m, f"(?i)<img{space}", "<"),
            "script_count": tx.pattern_count(m, f"(?i)<script{space}", "<"),
            "style_count": tx.pattern_count(m, f"(?i)<style{space}", "<"),
            "base64_count": tx.pattern_count(m, fx.TRAIN_BASE64, ";base64,"),
        }
    untagged = F.when(m.contains("<"), F.regexp_replace(m, fx.TAG, "")).otherwise(m)
    return {
        "html_tag_count": tx.pattern_count(m, fx.TAG, "<"),
        "html_ratio": tx.ratio(length - F.length(untagged), length),
        "img_count": tx.pattern_count(m, "(?i)<img", "<"),
        "script_count": tx.pattern_count(m, "(?i)<script", "<"),
        "style_count": tx.pattern_count(m, "(?i)<style", "<"),
        "base64_count": tx.occurrences(F.lower(m), "base64"),
    }


# --- serve ------------------------------------------------------------------


def serve_inputs(df: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` plus the shared inputs of the serve profile and of the risk score."""
    return df.select(
        *keep,
        F.coalesce(F.col("body").cast("string"), F.lit("")).alias("body_"),
        F.coalesce(F.col("subject").cast("string"), F.lit("")).alias("subject_"),
        sd.clean_address("from_email").alias("from_"),
        _headers(df).alias("headers_"),
    ).select(
        "*",
        F.lower("body_").alias("body_lower_"),
        tx.squeeze("body_").alias("body_squeezed_"),
        tx.squeeze("subject_").alias("subject_squeezed_"),
        sd.address_domain("from_").alias("domain_"),
        ur.extract_urls("body_", "serve").alias("urls_"),
    ).select("*", F.concat_ws(" ", "body_lower_", F.lower("subject_")).alias("combined_"))


def _serve_columns() -> list[Column]:
    urls, body, subject = F.col("urls_"), F.col("body_"), F.col("subject_")
    low = F.col("body_lower_")
    sender, headers = F.col("from_"), F.col("headers_")
    columns = tx.text_stats("body_", "body_squeezed_", "body", SERVE_SPECIAL)
    columns["body_consecutive_caps"] = tx.flag(body.rlike("[A-Z]{4,}"))
    columns |= _subject_stats("subject_", "subject_squeezed_")
    columns |= {
        "url_count": F.size(urls),
        "has_url": tx.flag(F.size(urls) > 0),
        "suspicious_tld": ur.any_url(urls, lambda u: ur.ends_with_tld(u, fx.SERVE_URL_TLDS)),
        "ip_in_url": ur.any_url(urls, lambda u: u.rlike(fx.IP_URL_SERVE)),
        "shortened_url": ur.any_url(urls, lambda u: tx.contains_any(u, fx.SERVE_SHORTENERS)),
        "https_ratio": ur.share_of(urls, lambda u: u.startswith("https")),
        "url_length_avg": ur.mean_length(urls),
        "url_has_hex_encoding": ur.any_url(urls, lambda u: u.contains("%")),
        "url_long_query": ur.any_url(urls, lambda u: ur.query_longer_than(u, 50, False)),
    }
    columns |= html_measures("body_", "serve")
    columns |= {
        "spam_keyword_count": tx.keyword_occurrences("combined_", fx.SERVE_SPAM_KEYWORDS),
        "spam_money_symbol": tx.keyword_occurrences("body_", fx.SERVE_MONEY_SYMBOLS)
        + tx.keyword_occurrences("subject_", fx.SERVE_MONEY_SYMBOLS),
        "spam_pct_off": tx.pattern_count(body, fx.PERCENT_OFF, "%"),
        "spam_uppercase_words": tx.shouted_words("body_squeezed_"),
        "spam_exclamation_count": tx.occurrences(body, "!") + tx.occurrences(subject, "!"),
        "spam_has_unsubscribe": tx.flag(low.contains("unsubscribe")),
        "spam_has_dear_friend": tx.flag(body.rlike("(?i)dear (?:friend|sir|madam)")),
        "spam_has_click_here": tx.flag(low.contains("click here")),
        "sender_domain_match": tx.flag(F.contains(headers, F.col("domain_"))),
        "reply_to_mismatch": tx.flag(
            headers.contains("Reply-To") & ~F.contains(headers, sender)
        ),
        "has_display_name": tx.flag(headers.contains("<") & headers.contains(">")),
        "header_length": F.length(headers),
        "free_email_provider": tx.flag(tx.contains_any("from_", fx.SERVE_FREE_NAMES)),
        "suspicious_sender": tx.flag(tx.contains_any("from_", fx.SERVE_SENDER_TOKENS)),
        "subject_has_buy_now": tx.flag(subject.rlike("(?i)free|offer|buy now")),
    }
    return _named(columns)


def serve_features_with_inputs(df: DataFrame, keep: list[str]) -> DataFrame:
    """Serve features next to the inputs that risk scoring needs (``from_``, ``combined_``)."""
    return serve_inputs(df, keep).select(
        *keep, "from_", "combined_", F.col("subject_"), *_serve_columns()
    )


# --- compact ----------------------------------------------------------------


def _compact(df: DataFrame, keep: list[str]) -> DataFrame:
    cleaned = df.select(
        *keep,
        tx.clean_text("body", "entities_first").alias("body_"),
        tx.clean_text("subject", "entities_first").alias("subject_"),
        F.lower(F.coalesce(F.col("from_email"), F.lit(""))).alias("from_"),
    ).select(
        "*",
        F.lower("body_").alias("lower_"),
        ur.extract_urls("body_", "serve").alias("urls_"),
        sd.address_domain("from_").alias("domain_"),
    )
    urls = F.col("urls_")
    columns = tx.text_stats("body_", "body_", "body", fx.ASCII_PUNCT)
    columns["body_consecutive_caps"] = F.regexp_count("body_", F.lit("[A-Z]{3,}"))
    columns |= _subject_stats("subject_", "subject_")
    columns["subject_consecutive_caps"] = F.regexp_count("subject_", F.lit("[A-Z]{3,}"))
    columns |= {
        "url_count": F.size(urls),
        "has_url": tx.flag(F.size(urls) > 0),
        "suspicious_tld": ur.any_url(
            urls, lambda u: ur.ends_with_tld(F.lower(u), fx.COMPACT_URL_TLDS)
        ),
        "ip_in_url": ur.any_url(urls, lambda u: u.rlike(fx.IP_URL_SERVE)),
        "https_ratio": ur.share_of(urls, lambda u: u.startswith("https")),
        "url_length_avg": ur.mean_length(urls),
    }
    columns |= {
        f"body_{kind}_keyword_count": tx.keywords_present("lower_", words)
        for kind, words in fx.COMPACT_WORDS.items()
    }
    columns |= {
        "free_email_provider": tx.flag(F.col("domain_").isin(fx.FREE_DOMAINS)),
        "suspicious_sender": tx.flag(tx.contains_any("from_", fx.COMPACT_SENDER_TOKENS)),
    }
    return cleaned.select(*keep, *_named(columns))


FEATURE_NAMES = [
    "body_text_length", "body_word_count", "body_avg_word_length", "body_uppercase_ratio",
    "body_digit_ratio", "body_special_char_ratio", "body_exclamation_count",
    "body_question_count", "body_consecutive_caps", "subject_text_length", "subject_word_count",
    "subject_avg_word_length", "subject_uppercase_ratio", "subject_digit_ratio",
    "subject_exclamation_count", "url_count", "has_url", "suspicious_tld", "ip_in_url",
    "shortened_url", "https_ratio", "url_length_avg", "url_has_hex_encoding", "url_long_query",
    "html_tag_count", "html_ratio", "img_count", "script_count", "style_count", "base64_count",
    "spam_keyword_count", "spam_money_symbol", "spam_pct_off", "spam_uppercase_words",
    "spam_exclamation_count", "spam_has_unsubscribe", "spam_has_dear_friend",
    "spam_has_click_here", "sender_domain_match", "reply_to_mismatch", "has_display_name",
    "header_length", "free_email_provider", "suspicious_sender", "subject_has_buy_now",
]
