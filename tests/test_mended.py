"""Answers that were wrong once, and plans that must not come back."""

import random
import time

import pytest
from pyspark.sql import functions as F

from postwarden import session
from postwarden.functions import text as tx
from postwarden.operators import alerts, campaigns, dataset, links, reports
from postwarden.sources import mail_files, tables
from postwarden.streaming import jobs
from postwarden.streaming.store import BatchStore

LOG = "email_id long, message_id string, domain string, predicted_label string, risk_score int, classified_at timestamp_ntz"


def log(spark, rows):
    return spark.createDataFrame(rows, "email_id long, message_id string, domain string, predicted_label string, risk_score int, at string").select(
        "email_id", "message_id", "domain", "predicted_label", "risk_score", F.col("at").cast("timestamp_ntz").alias("classified_at")
    )


def test_suffixes_of_any_depth(spark):
    suffixes = spark.createDataFrame([("us",), ("k12.ma.us",), ("pvt.k12.ma.us",)], "suffix string")
    hosts = spark.createDataFrame([("www.school.pvt.k12.ma.us",), ("a.k12.ma.us",), ("us",)], "host string")
    got = {r.host: (r.suffix, r.domain, r.subdomain) for r in links.registered_domains(hosts, suffixes).collect()}
    assert got == {
        "www.school.pvt.k12.ma.us": ("pvt.k12.ma.us", "school", "www"), "a.k12.ma.us": ("k12.ma.us", "a", ""), "us": ("us", "", ""),
    }


def test_labels_written_as_decimals(spark, tmp_path):
    rows = spark.createDataFrame(
        [("a@b", "s", f"text {i}", x) for i, x in enumerate(["1.0", "1", "0.0", "0", "spam?", None])],
        "sender string, subject string, body string, label string",
    )
    tables.write_csv(rows, str(tmp_path / "csv"))
    got = {r.body: r.label for r in mail_files.read_csv_mail(spark, str(tmp_path / "csv")).collect()}
    assert got == {"text 0": "spam", "text 1": "spam", "text 2": "ham", "text 3": "ham"}


def test_two_texts_under_one_id_stay(spark):
    rows = [(1, "s", "x" * 40), (1, "s", "y" * 40), (1, "s", "x" * 40), (2, "s", "x" * 40)]
    got = dataset.dedupe_mail(spark.createDataFrame(rows, "mail_id int, subject string, body string")).collect()
    assert sorted((r.mail_id, r.body[0]) for r in got) == [(1, "x"), (1, "y")]


def test_stream_keeps_rows_without_an_id(spark, tmp_path):
    rows = log(spark, [(i, m, "d", "ham", 1, "2024-01-01 00:00:00") for i, m in enumerate([None, None, "", "a", "a"])])
    rows.coalesce(1).write.parquet(str(tmp_path / "log"))
    stream = jobs.log_stream(spark, str(tmp_path / "log"), LOG)
    home = str(tmp_path / "home")
    jobs.drain(jobs.append_job(jobs.unique_message_stream(stream), home))
    got = sorted(r.message_id for r in spark.read.parquet(f"{home}/rows").collect())
    assert got == ["a", "generated-0", "generated-1", "generated-2"] == sorted(
        r.message_id for r in dataset.unique_messages(rows).collect()
    )


def test_lost_stream_state_is_an_error(spark, tmp_path):
    store = BatchStore(spark, str(tmp_path))
    assert store.replaced("recent", jobs.RECENT, -1).count() == 0
    with pytest.raises(Exception):
        store.replaced("recent", jobs.RECENT, 0).count()


def test_false_positive_rate_counts_known_outcomes_only(spark):
    rows = []
    for day, wrong in ((1, 1), (2, 3)):
        for i in range(14):
            label = "spam" if i < wrong else "ham"
            rows.append((len(rows), f"m{len(rows)}", "d", label, 5, f"2024-01-0{day} 0{i % 9}:00:00"))
    # outcomes of four mails a day, one of them given twice
    known = [(f"m{b + i}", "ham") for b in (0, 14) for i in (0, 1, 2, 3)] + [("m0", "ham"), (None, "ham")]
    feedback = spark.createDataFrame(known, "message_id string, true_label string")
    got = alerts.drift_alerts(log(spark, rows), feedback).collect()
    assert [(r.false_positive_rate, r.total_emails) for r in got] == [(0.75, 14)]
    daily = reports.performance_rollup(log(spark, rows), ("daily",), feedback).orderBy("metric_date").collect()
    assert [(r.total_emails, r.false_positives) for r in daily] == [(14, 1), (14, 3)]


def test_redaction_is_linear(spark):
    texts = ["w" * 1_000_000, "w" * 1_000_000 + "@", "a@b.c x.y-z@d", "@a @@ b@@c", "-.@.-", "e@f@g"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    start = time.time()
    got = [r.t for r in df.select("i", tx.redact_pii("t").alias("t")).orderBy("i").collect()]
    assert time.time() - start < 20
    mark = "[REDACTED_EMAIL]"
    assert got == [texts[0], texts[1], f"{mark} {mark}", "@a @@ b@@c", mark, f"{mark}@g"]


def brute_trailing(rows, width):
    return {
        r[0]: sum(o[2] == r[2] and o[3] != "ham" and 0 <= r[4] - o[4] <= width for o in rows) for r in rows
    }


def test_trailing_counts_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, "", rng.choice("ab"), rng.choice(["ham", "spam", "phishing"]), rng.randrange(0, 4000)) for i in range(400)]
    df = spark.createDataFrame(rows, "email_id long, m string, domain string, predicted_label string, sec long").withColumn(
        "classified_at", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, sec)")
    )
    for width in (10, 60, 600):
        got = {r.email_id: r.similar_emails for r in campaigns.trailing_bad_counts(df, width).collect()}
        assert got == brute_trailing(rows, width)


def test_one_busy_domain_takes_linear_time(spark):
    df = spark.range(300_000).selectExpr(
        "id as email_id", "'d' as domain", "'spam' as predicted_label",
        "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id / 10) as classified_at",
    )
    counted = campaigns.trailing_bad_counts(df, 86_400)
    start = time.time()
    top = counted.agg(F.max("similar_emails"), F.count(F.lit(1))).first()
    assert tuple(top) == (300_000, 300_000) and time.time() - start < 60
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "RangeFrame, -" not in plan


@pytest.mark.parametrize("name", ["risk_additive", "document_features_train", "clean_text_tags_first", "tfidf_vocabulary"])
def test_registered_queries_deal_no_texts_round(spark, data, name):
    from postwarden.plans.catalog import QUERIES

    plan = QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobin" not in plan


@pytest.mark.parametrize("name", ["trained_logistic", "trained_forest", "trained_boosted"])
def test_registered_training_is_whole(spark, data, name, monkeypatch):
    from __spark_entry__ import queries
    from postwarden.functions import fixed as fx
    from postwarden.operators.features import FEATURE_NAMES
    from postwarden.operators.vectors import fit_tfidf
    from postwarden.plans import catalog, training

    class Seen(Exception):
        pass

    def fit(vectors, algorithm, **options):
        raise Seen(len(vectors.first()["features"]), options, [r[0] for r in vectors.groupBy("held").count().collect()] if "held" in vectors.columns else [])

    monkeypatch.setattr(training, "fit_classifier", fit)
    with pytest.raises(Seen) as seen:
        queries()[name](spark, data)
    size, options, held = seen.value.args
    rows = catalog.dataset.split_mail(catalog._labelled(spark, data)).filter("split = 'train'")
    terms = fit_tfidf(rows, "body", fx.BODY_MAX_FEATURES, True).count() + fit_tfidf(rows, "subject", fx.SUBJECT_MAX_FEATURES, True).count()
    assert size == terms + len(FEATURE_NAMES) + len(fx.REPUTATION_COLUMNS)
    assert not {"maxIter", "maxDepth", "numTrees"} & set(options)
    if name == "trained_boosted":
        assert (options.get("validation") == "held") == (True in held) and False in held


def test_working_tables_are_removed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_dir", lambda spark, purpose: str(tmp_path / purpose))
    kept = session.materialise(spark.range(3), "kept")
    with session.working_tables(spark):
        session.materialise(session.materialise(spark.range(5), "one"), "two").write.parquet(str(tmp_path / "out"))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["kept", "out"]
    assert kept.count() == 3 and spark.read.parquet(str(tmp_path / "out")).count() == 5
