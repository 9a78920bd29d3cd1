"""Properties, brute-force comparisons and skewed inputs."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from postwarden.operators import campaigns, dataset, evaluation, joins, links, reputation, vectors
from postwarden.operators.features import mail_features
from postwarden.plans import scoring
from postwarden.sources.views import view


@pytest.fixture(scope="module")
def mail(spark, data):
    return view(spark, data, "mail").cache()


# --- joins ------------------------------------------------------------------


def test_lookup_with_hot_and_unknown_keys(spark):
    """A third of the rows share a key, another third a key the table lacks, some have none."""
    keys = ["hot"] * 400 + ["gone"] * 400 + [None] * 100 + [f"k{i}" for i in range(300)]
    left = spark.createDataFrame(list(enumerate(keys)), "id int, k string")
    right = spark.createDataFrame(
        [("hot", 1)] + [(f"k{i}", i) for i in range(0, 300, 2)], "k string, v int"
    )
    plain = left.join(right, "k", "left").select("id", "k", "v")
    got = joins.lookup(left, right, "k", "id", share=0.1).select("id", "k", "v")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)
    assert {r[0] for r in joins.hot_keys(left, "k", 0.1).collect()} == {"hot", "gone"}
    assert sorted(map(tuple, joins.lookup(left, right, "k").collect()), key=str) == sorted(
        map(tuple, plain.collect()), key=str
    )


# --- campaigns --------------------------------------------------------------


def _burst_log(spark, seed=3):
    """One domain holds most rows, many at the same instant and at chunk borders."""
    rng = random.Random(seed)
    start = datetime(2024, 5, 1)
    rows = []
    for i in range(900):
        seconds = rng.choice([rng.randrange(0, 20_000), rng.randrange(0, 40) * 600, 3600, 7200])
        domain = "big.org" if i % 3 else f"d{i % 9}.org"
        label = rng.choice(["ham", "spam", "phishing"])
        rows.append((i, domain, label, start + timedelta(seconds=seconds)))
    return spark.createDataFrame(
        rows, "email_id int, domain string, predicted_label string, classified_at timestamp_ntz"
    ), rows


@pytest.mark.parametrize("chunk_windows", [1, 6])
def test_trailing_counts_equal_brute_force(spark, chunk_windows):
    log, rows = _burst_log(spark)
    got = {
        r["email_id"]: r["similar_emails"]
        for r in campaigns.trailing_bad_counts(log, 600, chunk_windows).collect()
    }
    assert len(got) == len(rows)
    for i, domain, _, at in rows:
        want = sum(
            d == domain and label != "ham" and at - timedelta(seconds=600) <= t <= at
            for _, d, label, t in rows
        )
        assert got[i] == want


def test_campaign_upsert_keeps_last_count(spark):
    log, _ = _burst_log(spark)
    alerts = campaigns.campaign_alerts(log, 600, 15)
    row = campaigns.campaign_rows(alerts).filter("domain = 'big.org'").first()
    last = max(alerts.collect(), key=lambda r: r["classified_at"])
    assert row["last_detected"] == last["classified_at"]
    assert row["email_count"] == last["similar_emails"]
    assert row["campaign_name"] == "Campaign-big.org-20240501"


# --- corpus -----------------------------------------------------------------


def test_union_counts(mail):
    assert dataset.union_corpora(mail, mail).count() == 2 * mail.count()


def test_dedupe_is_idempotent_and_keeps_first(spark):
    text = "x" * 40
    rows = [(5, "s", text), (2, "s", text), (9, "s", "short"), (7, None, text), (8, None, text),
            (1, "sx", text[1:] + "yy")]
    df = spark.createDataFrame(rows, "mail_id int, subject string, body string")
    once = dataset.dedupe_mail(df)
    assert sorted(r["mail_id"] for r in once.collect()) == [1, 2, 7]
    assert dataset.dedupe_mail(once).count() == once.count()


def test_dedupe_with_one_text_in_most_rows(spark):
    df = spark.range(3000).select(
        F.col("id").alias("mail_id"), F.lit("s").alias("subject"),
        F.when(F.col("id") % 3 > 0, F.lit("same " * 10)).otherwise(
            F.concat(F.lit("different text number with length "), F.col("id"))).alias("body"),
    )
    got = dataset.dedupe_mail(df)
    assert got.count() == 1001
    assert got.filter("mail_id = 1").count() == 1 and got.filter("mail_id = 2").count() == 0


def test_split_is_disjoint_complete_and_stable(mail):
    split = dataset.split_mail(mail).select("mail_id", "split")
    again = dataset.split_mail(mail.repartition(5)).select("mail_id", "split")
    assert split.filter("split IS NULL").count() == 0
    assert split.count() == mail.count()
    assert split.exceptAll(again).count() == 0
    share = split.filter("split = 'train'").count() / split.count()
    assert 0.7 < share < 0.9


@pytest.mark.parametrize("fraction", [0.0, 0.18, 0.2, 0.5, 1.0])
def test_holdout_is_exact_per_class(spark, fraction):
    df = spark.range(1000).select(
        F.col("id").alias("mail_id"),
        F.when(F.col("id") % 10 < 8, "ham").when(F.col("id") % 10 < 9, "spam").otherwise("phishing")
        .alias("label"),
    )
    got = dataset.stratified_holdout(df, fraction).groupBy("label").agg(
        F.count_if("is_holdout").alias("h"), F.count(F.lit(1)).alias("n")
    ).collect()
    for r in got:
        assert r["h"] == int(r["n"] * fraction + 0.5)
    few = dataset.first_n_per_class(
        df, spark.createDataFrame([("ham", 37)], "label string, target_ long"), "label", buckets=4
    )
    assert few.filter("picked_").count() == 37 and few.count() == 1000


@pytest.mark.parametrize("ratio,want", [(0.05, 40), (0.5, 150), (0.75, 225)])
def test_oversampling_reaches_the_target(spark, ratio, want):
    df = spark.range(400).select(
        F.col("id").alias("mail_id"),
        F.when(F.col("id") < 300, "ham").when(F.col("id") < 360, "spam").otherwise("phishing").alias("label"),
    )
    out = dataset.oversample(df, ratio)
    sizes = {r["label"]: r["count"] for r in out.groupBy("label").count().collect()}
    assert sizes == {"ham": 300, "spam": 60, "phishing": want}
    assert out.select("mail_id").distinct().count() == 400
    assert out.groupBy("mail_id", "copy").count().filter("count > 1").count() == 0


def test_unknown_labels_go_to_the_error_output(spark):
    df = spark.createDataFrame([(1, "ham"), (2, "maybe"), (3, None)], "mail_id int, label string")
    good, bad = dataset.normalise_labels(df)
    assert [r["mail_id"] for r in good.collect()] == [1]
    assert sorted(r["mail_id"] for r in bad.collect()) == [2, 3]


def test_missing_message_ids_are_generated(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "m"), (4, "m")], "email_id int, message_id string")
    got = {r["message_id"]: r["email_id"] for r in dataset.unique_messages(df).collect()}
    assert got == {"generated-1": 1, "generated-2": 2, "m": 3}


# --- reputation and risk ----------------------------------------------------


def test_display_names_match_in_reputation(spark):
    schema = "mail_id int, from_email string, label string"
    known = spark.createDataFrame([(1, '"A" <x@y.org>', "spam"), (2, "X@y.org", "ham")], schema)
    rep = reputation.sender_reputation(known)
    asked = spark.createDataFrame([(9, "B <x@Y.org>", None), (8, "z@y.org", None)], schema)
    got = {r["mail_id"]: r for r in reputation.with_sender_reputation(asked, rep, 0.5).collect()}
    assert (got[9]["sender_email_count"], got[9]["sender_spam_ratio"], got[9]["sender_is_known"]) == (2, 0.5, 1)
    assert (got[8]["sender_email_count"], got[8]["sender_spam_ratio"], got[8]["sender_is_known"]) == (0, 0.5, 0)


def test_score_bounds_and_severity_order(spark, data):
    mails = view(spark, data, "link_mail")
    rep = reputation.sender_reputation(mails.limit(0).withColumn("label", F.lit("ham")))
    rows = scoring.risk_frame(mails, rep).select("risk_score", "severity").distinct().collect()
    rank = {"low": 0, "medium": 1, "high": 2, "critical": 3}
    ordered = [rank[r["severity"]] for r in sorted(rows, key=lambda r: r["risk_score"])]
    assert ordered == sorted(ordered)
    suffixes = spark.createDataFrame([("com",), ("org",), ("net",)], "suffix string")
    scores = links.url_threat(links.mail_links(mails), suffixes).agg(
        F.min("threat_score"), F.max("threat_score")).first()
    assert 0.0 <= scores[0] <= scores[1] <= 1.0


def test_longest_suffix_wins(spark):
    suffixes = spark.createDataFrame([("uk",), ("co.uk",), ("com",)], "suffix string")
    hosts = ["a.b.co.uk", "co.uk", "x.com", "1.2.3.4", "localhost", "y.unknown"]
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    got = {r["host"]: (r["subdomain"], r["domain"], r["suffix"])
           for r in links.registered_domains(df, suffixes).collect()}
    assert got == {
        "a.b.co.uk": ("a", "b", "co.uk"), "co.uk": ("", "", "co.uk"), "x.com": ("", "x", "com"),
        "1.2.3.4": ("", "1.2.3.4", ""), "localhost": ("", "localhost", ""),
        "y.unknown": ("y", "unknown", ""),
    }


# --- vectors and quality ----------------------------------------------------


def test_vectors_agree_with_rows(spark, mail):
    from pyspark.ml.functions import vector_to_array

    vocab = vectors.fit_tfidf(mail, "subject", 40).cache()
    rows = vectors.tfidf(mail, vocab, "subject")
    norms = rows.groupBy("mail_id").agg(F.sum(F.col("weight") ** 2).alias("n")).collect()
    assert all(r["n"] == pytest.approx(1.0) for r in norms)
    terms = sorted(r["term"] for r in vocab.collect())
    wide = vectors.tfidf_vectors(mail, vocab, "subject").select(
        "mail_id", vector_to_array("features").alias("a")).collect()
    from_vectors = {
        (r["mail_id"], terms[i]): w for r in wide for i, w in enumerate(r["a"]) if w
    }
    from_rows = {(r["mail_id"], r["term"]): r["weight"] for r in rows.collect()}
    assert from_vectors.keys() == from_rows.keys()
    assert all(from_rows[k] == pytest.approx(v) for k, v in from_vectors.items())


def test_bigrams_follow_stop_word_removal(spark):
    df = spark.createDataFrame([(1, "The cat and the dog, a cat")], "mail_id int, body string")
    got = vectors.with_terms(df, "body").first()["terms"]
    assert got == ["cat", "dog", "cat", "cat dog", "dog cat"]
    assert vectors.with_terms(df.limit(0).union(df.select("mail_id", F.lit("").alias("body"))), "body").first()["terms"] == []


def test_evaluation_of_a_known_matrix(spark):
    matrix = [[10832, 150, 50], [120, 3401, 0], [45, 15, 1234]]
    pairs = spark.createDataFrame(
        [(i, j, n) for i, row in enumerate(matrix) for j, n in enumerate(row)],
        "label int, prediction int, n int",
    ).filter("n > 0").select("label", "prediction", F.explode(F.sequence(F.lit(1), "n")))
    assert evaluation.evaluate(pairs).first()["accuracy"] == 15467 / 15847
    spam = evaluation.class_report(pairs).filter("class = 1").first()
    assert (spam["precision"], spam["recall"]) == (3401 / 3566, 3401 / 3521)


# --- plans ------------------------------------------------------------------


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("profile", ["train", "serve", "compact"])
def test_features_are_one_native_scan(spark, mail, data, profile):
    rows = spark.read.parquet(f"{data}/documents.parquet").select(
        F.col("doc_id").alias("mail_id"), F.col("text").alias("body"), F.lit("s").alias("subject"),
        F.col("source").alias("from_email"),
    )
    plan = _plan(mail_features(rows, profile))
    assert "Exchange" not in plan and "Python" not in plan


def test_reports_prune_columns_and_push_filters(spark, data):
    from postwarden.operators import reports

    plan = _plan(reports.label_stats(view(spark, data, "mail_log"), "2024-01-31 00:00:00", 48))
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts," in plan
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string>" in plan


def test_no_plan_moves_everything_to_one_task(spark, data):
    """Windows and limits without a partition key would show as a single-partition exchange."""
    log = view(spark, data, "mail_log")
    for df in (campaigns.trailing_bad_counts(log), campaigns.detect_campaigns(log),
               reputation.sender_reputation(view(spark, data, "mail"))):
        assert "SinglePartition" not in _plan(df)


def test_tfidf_shuffles_no_texts(spark, data):
    mail = view(spark, data, "mail")
    vocab = spark.createDataFrame([("a", 1.0)], "term string, idf double")
    plan = _plan(vectors.tfidf(mail, vocab, "subject"))
    assert plan.count("Exchange hashpartitioning") == 0


def test_scoring_never_shuffles_texts(spark, data, capsys):
    """With broadcasts off, no exchange of the scoring plan carries a text column."""
    import re

    rows = spark.read.parquet(f"{data}/documents.parquet").select(
        F.col("doc_id").alias("mail_id"), F.col("text").alias("body"),
        F.substring("text", 1, 60).alias("subject"), F.col("source").alias("from_email"),
    )
    rep = reputation.sender_reputation(rows.withColumn("label", F.lit("ham")))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        scoring.risk_frame(rows, rep).explain("formatted")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    plan = capsys.readouterr().out
    moved = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", plan)
    assert moved
    assert not any(re.search(r"\b(text|body|body_|combined_)#", columns) for columns in moved)


@pytest.mark.parametrize("bounds", [{}, {"min_df": 3}, {"max_df": 0.3}, {"min_df": 2, "max_df": 0.5}])
@pytest.mark.parametrize("size", [5, 30, 10_000])
def test_vocabulary_equals_counts_of_all_terms(spark, size, bounds):
    """Pairs of rare words are left out before they are counted, and the vocabulary stays the same, ties included."""
    import random

    rng = random.Random(3)
    names = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(names, [1 / (i + 1) for i in range(60)], k=rng.randint(0, 40))) for _ in range(120)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None, "", "w1"])], "mail_id int, body string")
    counts, docs = {}, {}
    for row in vectors.with_terms(df, "body").collect():
        for t in row["terms"]:
            counts[t] = counts.get(t, 0) + 1
        for t in set(row["terms"]):
            docs[t] = docs.get(t, 0) + 1
    kept = [t for t in counts if bounds.get("min_df", 1) <= docs[t] <= 123 * bounds.get("max_df", 1.0)]
    want = [(t, counts[t], docs[t]) for t in sorted(kept, key=lambda t: (-counts[t], t))[:size]]
    got = vectors.fit_tfidf(df, "body", size, **bounds)
    assert [tuple(r)[:3] for r in got.collect()] == want


def test_rare_pairs_are_not_counted(spark, monkeypatch):
    """Before, every different pair of the texts went through the shuffle."""
    df = spark.createDataFrame([(i, f"aa bb cc{i} dd{i}") for i in range(50)], "mail_id int, body string")
    real, seen = vectors._counts, []
    monkeypatch.setattr(vectors, "_counts", lambda *a, **k: seen.append(real(*a, **k)) or seen[-1])
    assert [r["term"] for r in vectors.fit_tfidf(df, "body", 2).collect()] == ["aa", "aa bb"]
    assert [r["term"] for r in seen[-1].collect()] == ["aa bb"]
