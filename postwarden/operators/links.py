"""Link analysis and URL threat scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postwarden.functions import fixed as fx
from postwarden.functions import text as tx
from postwarden.functions import urls as ur


def analyze_links(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Links of each body with findings, the number of risky ones and a level.

    Works on the array inside the row: no explode and no shuffle.
    """
    keep = keep or ["mail_id"]
    links = df.select(*keep, ur.extract_urls("body", "serve").alias("found_")).select(
        *keep, F.transform("found_", ur.link_struct).alias("urls")
    )
    risky = F.size(
        F.filter("urls", lambda u: u["has_ip"] | u["suspicious_tld"] | u["is_shortened"])
    )
    return links.select(
        *keep, F.size("urls").alias("url_count"), "urls", risky.alias("high_risk_urls"),
        F.when(risky > 0, "high").otherwise("low").alias("risk_level"),
    )


def mail_links(df: DataFrame, text: str = "body", row_id: str = "mail_id") -> DataFrame:
    """One row per link of a text: (row_id, position, url)."""
    return df.select(
        row_id, F.posexplode(ur.find_urls(text)).alias("position", "url")
    )


def registered_domains(df: DataFrame, suffixes: DataFrame, host: str = "host") -> DataFrame:
    """Adds ``suffix``, ``domain`` and ``subdomain`` of a host by a table of public suffix rules.

    A rule is a suffix (``co.uk``), one with any label in front (``*.ck``), or an exception from such a one (``!www.ck``: the
    suffix is what follows its first label).  An exception wins, else the longest rule.  A host without a rule has no suffix.

    Each different host looks up all its tails at once, in one join with the rules, which the planner broadcasts if they are
    few; what is found is joined back by host.
    """
    rules = suffixes.select(F.lower(F.trim("suffix")).alias("rule_")).filter("rule_ <> ''").distinct()
    is_ip = F.col(host).rlike(fx.IPV4_HOST)
    labels = F.split("host_", r"\.")

    def tail(k: Column) -> Column:
        return F.array_join(F.slice(labels, -k, k), ".")

    def tails(k: Column) -> Column:
        anything = F.when(k == 1, F.lit("*")).otherwise(F.concat(F.lit("*."), tail(F.greatest(k - 1, F.lit(1)))))
        plain = F.array(F.struct(tail(k).alias("rule_"), k.alias("used_"), F.lit(False).alias("except_")),
                        F.struct(anything.alias("rule_"), k.alias("used_"), F.lit(False).alias("except_")))
        return F.concat(plain, F.array(F.struct(
            F.concat(F.lit("!"), tail(k)).alias("rule_"), (k - 1).alias("used_"), F.lit(True).alias("except_")
        )))

    asked = df.filter(F.col(host).isNotNull() & ~is_ip).select(F.col(host).alias("host_")).distinct()
    looked = asked.select("host_", F.inline(F.flatten(F.transform(F.sequence(F.lit(1), F.size(labels)), tails))))
    found = looked.join(rules, "rule_").groupBy("host_").agg(
        F.coalesce(F.max(F.when(F.col("except_"), F.col("used_"))), F.max("used_")).alias("used_")
    )
    out = df.join(found, df[host] == found["host_"], "left").drop("host_").withColumn("labels_", F.split(F.col(host), r"\."))
    used = F.coalesce("used_", F.lit(0))
    rest = F.slice("labels_", F.lit(1), F.greatest(F.lit(0), F.size("labels_") - used))
    return (
        out.withColumn("suffix", F.coalesce(F.array_join(F.slice("labels_", F.greatest(F.lit(1), F.size("labels_") - used + 1), used), "."), F.lit("")))
        .withColumn("rest_", rest)
        .withColumn(
            "domain",
            F.when(is_ip, F.col(host))
            .when(F.size("rest_") > 0, F.element_at("rest_", -1)).otherwise(""),
        )
        .withColumn(
            "subdomain",
            F.when(is_ip, "").otherwise(
                F.array_join(F.slice("rest_", F.lit(1), F.greatest(F.lit(0), F.size("rest_") - 1)), ".")
            ),
        )
        .drop("labels_", "used_", "rest_")
    )


def url_threat(df: DataFrame, suffixes: DataFrame, url: str = "url") -> DataFrame:
    """Adds the threat features and ``threat_score`` in [0, 1] for a URL column.

    ``multi_tld`` asks for a dot inside the registrable label, which suffix
    splitting never leaves there; the term is kept as defined.
    """
    decoded = df.withColumn("decoded_", ur.percent_decoded(url)).withColumn(
        "host", ur.url_host("decoded_")
    ).withColumn("path_", ur.url_path("decoded_"))
    split = registered_domains(decoded, suffixes, "host")
    low_url = F.lower(F.col(url))
    has_exec = F.lower("path_").rlike(tx.any_of(fx.EXECUTABLE_EXTENSIONS, r"\z"))
    marks = split.select(
        "*",
        F.col("host").rlike(fx.IPV4_HOST).alias("has_ip"),
        (F.col("domain").contains(".") & F.col("suffix").contains(".")).alias("multi_tld"),
        F.element_at(F.split("suffix", r"\."), -1).isin(fx.THREAT_TLDS).alias("suspicious_tld"),
        (F.length(F.col(url)) > 200).alias("long_url"),
        ur.shannon_entropy("path_").alias("path_entropy"),
        has_exec.alias("has_exec"),
        tx.keywords_present(low_url, fx.THREAT_TOKENS).alias("suspicious_tokens"),
    )

    def points(name: str, weight: float) -> Column:
        return F.when(F.col(name), weight).otherwise(0.0)

    score = reduce(lambda a, b: a + b, [
        points("has_ip", 0.35), points("multi_tld", 0.25), points("suspicious_tld", 0.15),
        points("long_url", 0.05), F.when(F.col("path_entropy") > 3.5, 0.10).otherwise(0.0),
        points("has_exec", 0.25), F.least(F.col("suspicious_tokens") * F.lit(0.05), F.lit(0.25)),
    ])
    full = F.when(
        (F.col("domain") != "") & (F.col("suffix") != ""), F.concat_ws(".", "domain", "suffix")
    ).when(F.col("domain") != "", F.col("domain")).otherwise(F.col("host"))
    return marks.select(
        *df.columns, "host", full.alias("registered_domain"), "subdomain", "has_ip", "multi_tld",
        "suspicious_tld", "long_url", "path_entropy", "has_exec", "suspicious_tokens",
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("threat_score"),
    )


def max_url_threat(
    df: DataFrame, suffixes: DataFrame, text: str = "body", row_id: str = "mail_id"
) -> DataFrame:
    """Highest link score, its URL and the number of links per text; 0 for texts without links.

    Texts without links keep one row without a URL, so nothing is joined back.
    """
    links = df.select(row_id, F.posexplode_outer(ur.find_urls(text)).alias("position", "url"))
    scored = url_threat(links, suffixes)
    worst = F.max(F.when(F.col("url").isNotNull(), F.struct("threat_score", (-F.col("position")).alias("p"), "url")))
    return scored.groupBy(row_id).agg(worst.alias("worst_"), F.count("url").alias("link_count")).select(
        row_id, F.coalesce("worst_.threat_score", F.lit(0.0)).alias("max_threat_score"),
        F.col("worst_.url").alias("worst_url"), "link_count",
    )
