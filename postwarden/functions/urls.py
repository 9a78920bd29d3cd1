"""URL expressions on strings and on arrays of URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postwarden.functions import fixed as fx
from postwarden.functions.text import _col, any_of, contains_any

PATTERNS = {
    "train": fx.URL_TRAIN,
    "serve": fx.URL_SERVE,
    "threat": fx.URL_THREAT,
    "strict": fx.URL_STRICT,
}


def extract_urls(text, pattern: str = "serve") -> Column:
    """All URLs in order.  Texts without ``http``/``www.`` get an empty array without a regex run."""
    text = F.coalesce(_col(text), F.lit(""))
    probe = F.lower(text)
    maybe = probe.contains("://")
    if pattern == "threat":
        maybe = maybe | probe.contains("www.")
    return F.when(
        maybe, F.regexp_extract_all(text, F.lit(PATTERNS[pattern]), F.lit(0))
    ).otherwise(F.array().cast("array<string>"))


def normalise_urls(urls) -> Column:
    """Drop trailing punctuation and give bare ``www.`` hosts a scheme."""

    def one(u: Column) -> Column:
        u = F.regexp_replace(u, r"[).,;\"']+\z", "")
        return F.when(u.startswith("www."), F.concat(F.lit("http://"), u)).otherwise(u)

    return F.transform(_col(urls), one)


def find_urls(text) -> Column:
    return normalise_urls(extract_urls(text, "threat"))


# --- parts ------------------------------------------------------------------


def url_netloc(url) -> Column:
    return F.regexp_extract(_col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def url_host(url) -> Column:
    """Lower-case host without user info and port."""
    after_user = F.regexp_replace(url_netloc(url), "^.*@", "")
    return F.lower(F.regexp_replace(after_user, r":[0-9]*\z", ""))


def url_path(url) -> Column:
    return F.regexp_extract(_col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def percent_decoded(url) -> Column:
    """Percent-decoding that keeps ``+`` and malformed escapes as they are."""
    url = _col(url)
    guarded = F.regexp_replace(F.replace(url, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.when(url.contains("%"), F.coalesce(F.try_url_decode(guarded), url)).otherwise(url)


# --- tests on one URL -------------------------------------------------------


def is_shortened(url) -> Column:
    """Host ends with a known shortener domain."""
    host = F.split_part(F.regexp_replace(_col(url), "https?://", ""), F.lit("/"), F.lit(1))
    host = F.split_part(F.lower(host), F.lit(":"), F.lit(1))
    return host.rlike(any_of(fx.SHORTENERS, r"\z"))


def has_train_tld(url) -> Column:
    """A listed TLD anywhere in a URL that holds a slash, else at its end."""
    u = F.lower(_col(url))
    return F.when(u.contains("/"), contains_any(u, fx.TRAIN_URL_TLDS)).otherwise(
        u.rlike(any_of(fx.TRAIN_URL_TLDS, r"\z"))
    )


def ends_with_tld(url, tlds: list[str]) -> Column:
    return _col(url).rlike(any_of(tlds, r"\z"))


def query_longer_than(url, limit: int, whole: bool) -> Column:
    """Query part over ``limit``: all after the first ``?``, or only up to the next one."""
    u = _col(url)
    tail = F.regexp_extract(u, r"(?s)\?(.*)\z" if whole else r"\?([^?]*)", 1)
    return u.contains("?") & (F.length(tail) > limit)


def shannon_entropy(text) -> Column:
    """Bits per character; 0 for the empty string."""
    text = F.coalesce(_col(text), F.lit(""))
    total = F.length(text).cast("double")
    chars = F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))

    def share(c: Column) -> Column:
        return (total - F.length(F.replace(text, c, F.lit("")))) / total

    return F.aggregate(
        chars, F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c))
    )


# --- tests on an array of URLs ---------------------------------------------


def any_url(urls: Column, test) -> Column:
    return F.exists(urls, test).cast("int")


def share_of(urls: Column, test) -> Column:
    n = F.size(urls)
    return F.size(F.filter(urls, test)).cast("double") / F.greatest(F.lit(1), n)


def mean_length(urls: Column) -> Column:
    total = F.aggregate(urls, F.lit(0), lambda acc, u: acc + F.length(u))
    return total.cast("double") / F.greatest(F.lit(1), F.size(urls))


def link_struct(url: Column) -> Column:
    """The per-link findings of the link report."""
    return F.struct(
        url.alias("url"),
        url.startswith("https").alias("is_https"),
        url.rlike(fx.IP_URL_SERVE).alias("has_ip"),
        ends_with_tld(url, fx.LINK_URL_TLDS).alias("suspicious_tld"),
        contains_any(url, fx.LINK_SHORTENERS).alias("is_shortened"),
        url.contains("%").alias("has_hex_encoding"),
        F.length(url).alias("length"),
    )
