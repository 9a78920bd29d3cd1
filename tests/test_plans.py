"""Bursts, suffix rules, and what the plans of registered queries hold."""

import re

import pytest
from pyspark.sql import functions as F

from postwarden.operators import campaigns, links
from postwarden.plans.catalog import QUERIES
from postwarden.sources import tables


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_burst_splits(spark):
    """A domain whose bad mails all fall into one minute is dealt in parts, and counted right."""
    n = 200_000
    rows = spark.range(n).select(
        F.col("id").alias("email_id"), F.expr("if(id < 0, 'e.org', 'd.org')").alias("domain"), F.lit("spam").alias("predicted_label"),
        F.expr("timestamp_ntz'2024-05-01 10:00:00' + make_dt_interval(0, 0, 0, cast(id * 0.0003 AS decimal(18, 6)))").alias("classified_at"),
    )
    got = campaigns.trailing_bad_counts(rows, 30)
    told = got.agg(F.count("*"), F.max("similar_emails"), F.sum((F.col("similar_emails") == F.least(F.col("email_id") + 1, F.lit(100_001))).cast("int")))
    assert tuple(told.first()) == (n, 100_001, n)
    windows = re.findall(r"windowspecdefinition\(([^,]*#\d+L?(?:, [^,]*#\d+L?)*?), [^,]*ASC", plan_of(got))
    keys = {tuple(re.sub(r"#\d+L?", "", k).split(", ")) for k in windows}
    assert keys <= {("domain",), ("domain", "minute_"), ("domain", "part_")}, keys


def test_one_instant_is_one_row(spark):
    """Mails of one instant combine before they meet."""
    rows = spark.range(50_000).selectExpr(
        "id email_id", "'d.org' domain", "if(id % 2 = 0, 'spam', 'ham') predicted_label", "timestamp_ntz'2024-05-01 10:00:00' classified_at"
    )
    got = campaigns.trailing_bad_counts(rows, 600)
    assert [tuple(r) for r in got.groupBy("similar_emails").count().collect()] == [(25_000, 50_000)]


RULES = ["com", "uk", "co.uk", "*.ck", "!www.ck", "kobe.jp", "*.kobe.jp", "!city.kobe.jp", "jp", " ORG ", ""]


@pytest.mark.parametrize("host, want", [
    ("a.b.example.com", ("com", "example", "a.b")), ("www.bbc.co.uk", ("co.uk", "bbc", "www")), ("bbc.uk", ("uk", "bbc", "")),
    ("a.b.ck", ("b.ck", "a", "")), ("x.a.b.ck", ("b.ck", "a", "x")), ("b.ck", ("b.ck", "", "")), ("www.ck", ("ck", "www", "")),
    ("x.www.ck", ("ck", "www", "x")), ("ck", ("", "ck", "")), ("c.kobe.jp", ("c.kobe.jp", "", "")),
    ("city.kobe.jp", ("kobe.jp", "city", "")), ("a.city.kobe.jp", ("kobe.jp", "city", "a")), ("d.c.kobe.jp", ("c.kobe.jp", "d", "")),
    ("localhost", ("", "localhost", "")), ("a.unknown", ("", "unknown", "a")), ("192.168.0.1", ("", "192.168.0.1", "")),
    ("example.org", ("org", "example", "")), ("", ("", "", "")), ("com", ("com", "", "")),
])
def test_suffix_rules(spark, host, want):
    hosts = spark.createDataFrame([(host, 1), (host, 2)], "host string, used long")
    suffixes = spark.createDataFrame([(r,) for r in [*RULES, *RULES]], "suffix string")
    got = links.registered_domains(hosts, suffixes)
    assert [tuple(r) for r in got.select("suffix", "domain", "subdomain").collect()] == [want] * 2
    assert got.columns == ["host", "used", "suffix", "domain", "subdomain"]


def test_rules_are_looked_up_in_one_join(spark, data):
    """However long the suffixes are; and no job runs while the query is built."""
    plan = QUERIES["url_threat"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"\bJoin\b", plan)) == 2  # the rules, and what was found for a host
    plan = QUERIES["mail_url_threat"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"\bJoin\b", plan)) == 2


def test_weights_shuffle_no_text(spark, data):
    """Only the view's own join with labels is left, whose narrow side is broadcast."""
    assert "partitioning(" not in plan_of(QUERIES["tfidf_weights"](spark, data))


def test_top_rows_break_ties(spark, tmp_path):
    rows = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 2.0), ("d", 1.0)], "feature string, importance double")
    tables.write_top_json(rows.repartition(3), str(tmp_path / "top"), "importance", 3)
    assert [r["feature"] for r in spark.read.json(str(tmp_path / "top")).orderBy(F.desc("importance"), "feature").collect()] == ["c", "a", "b"]


def test_sampling_reads_its_input_a_few_times(spark, data):
    for name in ("oversampled_corpus", "stratified_holdout"):
        plan = QUERIES[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()
        assert 1 <= len(re.findall(r"\bRelation \[doc_id#\d+L,text", plan)) <= 2, name
