"""Sender address and sender domain expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postwarden.functions import fixed as fx
from postwarden.functions.text import _col, any_of, contains_any, squeeze


def clean_address(sender) -> Column:
    """Lower-case address: inside ``<...>`` first, else an address pattern, else the whole text."""
    s = F.coalesce(_col(sender), F.lit(""))
    inside = F.nullif(squeeze(F.regexp_extract(s, "<([^<>]*)>", 1)), F.lit(""))
    found = F.nullif(F.regexp_extract(s, fx.ADDRESS, 0), F.lit(""))
    return F.lower(F.coalesce(inside, found, squeeze(s)))


def address_domain(address) -> Column:
    """Last part after ``@``; '' when there is none."""
    a = F.coalesce(_col(address), F.lit(""))
    return F.when(a.contains("@"), F.element_at(F.split(a, "@"), -1)).otherwise(F.lit(""))


def second_domain(address) -> Column:
    """Second part after ``@`` in lower case; null without ``@``."""
    return F.lower(F.try_element_at(F.split(_col(address), "@"), F.lit(2)))


def domain_level(score: Column) -> Column:
    return (
        F.when(score >= 4, "critical").when(score >= 2, "high").when(score >= 1, "medium")
        .otherwise("low")
    )


def domain_pattern_risk(address) -> Column:
    """Struct (risk_level, risk_score, reasons, is_free_provider, domain) from the domain's shape."""
    a = F.coalesce(_col(address), F.lit(""))
    d = F.lower(address_domain(a))
    hyphens = F.octet_length(d) - F.octet_length(F.replace(d, F.lit("-"), F.lit("")))
    signs = [
        (d.rlike(any_of(fx.DOMAIN_RISK_TLDS, r"\z")), 3, "high_risk_tld"),
        (d.rlike(r"\p{Nd}{3,}"), 2, "numeric_domain"),
        (hyphens >= 3, 2, "multiple_hyphens"),
        (F.length(d) > 30, 1, "long_domain"),
    ]
    score = sum((F.when(c, w).otherwise(0) for c, w, _ in signs), F.lit(0))
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, _, name in signs]))
    valid = a.contains("@")

    def pick(good: Column, bad: Column) -> Column:
        return F.when(valid, good).otherwise(bad)

    return F.struct(
        pick(domain_level(score), F.lit("high")).alias("risk_level"),
        pick(score, F.lit(5)).cast("int").alias("risk_score"),
        pick(reasons, F.array(F.lit("invalid_email"))).alias("reasons"),
        pick(contains_any(d, fx.FREE_DOMAINS), F.lit(False)).alias("is_free_provider"),
        pick(d, F.lit("unknown")).alias("domain"),
    )
