"""Streams end with the same result as the batch job, over several batches and late rows."""

import os

import pytest
from pyspark.sql import functions as F

from postwarden.operators import campaigns, domains, reports, reputation
from postwarden.plans import scoring
from postwarden.sources.views import view
from postwarden.streaming import jobs
from postwarden.streaming.store import BatchStore, valid_runs

SCHEMA = (
    "email_id bigint, message_id string, from_email string, domain string, "
    "predicted_label string, risk_score int, classified_at timestamp_ntz"
)
DAY = 86_400


@pytest.fixture(scope="module")
def log_files(spark, data, tmp_path_factory):
    """The log as six files in time order, read one per batch."""
    folder = str(tmp_path_factory.mktemp("log"))
    log = view(spark, data, "mail_log")
    hours = F.day("classified_at")
    for i in range(6):
        part = log.filter((hours > i * 5) & (hours <= (i + 1) * 5) if i < 5 else hours > 25)
        part.coalesce(1).write.mode("append").parquet(folder)
    return folder, log


def _stream(spark, folder):
    return jobs.log_stream(spark, folder, SCHEMA, files_per_batch=1)


def _rows(df, *order):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_hourly_volume(spark, log_files):
    folder, log = log_files
    home = jobs.new_home(spark, "t")
    jobs.drain(jobs.upsert_job(jobs.hourly_volume_stream(_stream(spark, folder), "1 day"), home))
    assert len([f for f in os.listdir(os.path.join(home, "rows")) if f.startswith("batch")]) > 1
    got = jobs.latest_rows(spark, home, ["hour", "predicted_label"])
    assert _rows(got) == _rows(reports.hourly_volume(log))


def test_domain_table(spark, log_files):
    folder, log = log_files
    home = jobs.new_home(spark, "t")
    jobs.drain(jobs.upsert_job(jobs.domain_count_stream(_stream(spark, folder)), home))
    assert _rows(jobs.graded_domains(spark, home)) == _rows(domains.domain_risk(log))


def test_campaigns(spark, log_files):
    folder, log = log_files
    home = jobs.new_home(spark, "t")
    window, threshold = 5 * DAY, 8
    jobs.drain(jobs.campaign_job(_stream(spark, folder), home, window, threshold))
    want = campaigns.detect_campaigns(log, window, threshold)
    assert want.count() > 0
    assert _rows(jobs.campaign_table(spark, home)) == _rows(want)


def test_campaign_stream_takes_late_rows_and_drops_very_late_ones(spark, tmp_path):
    folder = str(tmp_path / "log")

    def put(rows):
        spark.createDataFrame(
            [(None, None, None, "d.org", "spam", 1, t) for t in rows],
            SCHEMA.replace("timestamp_ntz", "string"),
        ).withColumn("classified_at", F.col("classified_at").cast("timestamp_ntz")).coalesce(1).write.mode(
            "append").parquet(folder)

    def run():
        jobs.drain(jobs.campaign_job(
            _stream(spark, folder), home, window_seconds=600, threshold=3, lateness_seconds=1800))
        return [tuple(r) for r in jobs.campaign_table(spark, home).select(
            "email_count", F.col("last_detected").cast("string")).collect()]

    home = jobs.new_home(spark, "t")
    put(["2024-05-01 10:00:00", "2024-05-01 10:05:00"])
    assert run() == []
    put(["2024-05-01 10:04:00"])
    assert run() == [(3, "2024-05-01 10:05:00")]
    put(["2024-05-01 11:00:00"])
    assert run() == [(3, "2024-05-01 10:05:00")]
    put(["2024-05-01 10:03:00", "2024-05-01 10:56:00", "2024-05-01 10:57:00"])
    assert run() == [(3, "2024-05-01 11:00:00")]


def test_duplicates_and_history(spark, log_files):
    folder, log = log_files
    doubled = _stream(spark, folder).withColumn("copy_", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy_")
    home = jobs.new_home(spark, "t")
    jobs.drain(jobs.append_job(jobs.unique_message_stream(doubled), home))
    assert _rows(spark.read.parquet(os.path.join(home, "rows"))) == _rows(log)
    home = jobs.new_home(spark, "t")
    jobs.drain(jobs.append_job(jobs.sender_history(_stream(spark, folder)), home))
    assert _rows(spark.read.parquet(os.path.join(home, "rows"))) == _rows(jobs.sender_history(log))


def test_domain_job_equals_batch_with_few_files(spark, log_files):
    folder, log = log_files
    home = jobs.new_home(spark, "t")
    jobs.drain(jobs.domain_job(_stream(spark, folder), home, base=2))
    assert _rows(jobs.stored_domains(spark, home, base=2)) == _rows(domains.domain_risk(log))
    jobs.drain(jobs.domain_job(_stream(spark, folder), home, base=2))  # nothing new
    assert _rows(jobs.stored_domains(spark, home, base=2)) == _rows(domains.domain_risk(log))


def _store(spark, data, tmp_path, files=2):
    folder = str(tmp_path / "mail")
    mails = view(spark, data, "link_mail").withColumn(
        "classified_at", F.lit("2024-05-01 10:00:00").cast("timestamp_ntz"))
    mails.repartition(files).write.parquet(folder)
    rep = reputation.sender_reputation(mails.limit(0).withColumn("label", F.lit("ham")))

    def score(df):
        return scoring.score_mail(
            df, rep, scoring.constant_scorer(0.2, 0.2, 0.6), keep=["mail_id", "classified_at"])

    schema = ", ".join(f"{n} {t}" for n, t in mails.dtypes)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    return mails, score, stream


def test_store_job_writes_all_tables(spark, data, tmp_path):
    mails, score, stream = _store(spark, data, tmp_path)
    home = jobs.new_home(spark, "t")
    jobs.drain(jobs.store_job(stream, home, score, threshold=5))
    scored = score(mails)
    log = scoring.log_rows(scored)
    assert _rows(jobs.stored(spark, home, "mails").drop("processing_ms")) == _rows(log)
    assert _rows(jobs.stored(spark, home, "factors")) == _rows(scoring.factor_rows(scored, at="classified_at"))
    assert _rows(jobs.stored(spark, home, "texts")) == _rows(mails.selectExpr("mail_id email_id", "body", "raw_headers"))
    assert _rows(jobs.stored(spark, home, "history")) == _rows(jobs.sender_history(log))
    assert jobs.stored(spark, home, "errors").count() == 0
    assert _rows(jobs.stored_domains(spark, home)) == _rows(domains.domain_risk(log))
    want = campaigns.detect_campaigns(log, 600, 5)
    assert want.count() > 0 and _rows(jobs.campaign_table(spark, home)) == _rows(want)
    assert {"confidence", "to_email", "domain_risk_level", "model_version", "sent_at"} <= set(log.columns)


def test_a_killed_batch_leaves_nothing_visible(spark, data, tmp_path, monkeypatch):
    mails, score, stream = _store(spark, data, tmp_path)
    home = jobs.new_home(spark, "t")
    commit = BatchStore.commit

    def dies(self, batch, *told):
        if batch == 1:
            raise RuntimeError("killed")
        commit(self, batch, *told)

    monkeypatch.setattr(BatchStore, "commit", dies)
    with pytest.raises(Exception, match="killed"):
        jobs.drain(jobs.store_job(stream, home, score, threshold=5))
    names = ("mails", "factors", "history", "texts", "errors")
    seen = {n: jobs.stored(spark, home, n).count() for n in names}
    assert 0 < seen["mails"] < mails.count() and seen["mails"] == seen["texts"] == seen["history"]
    total = jobs.stored_domains(spark, home).agg(F.sum("total_emails")).first()[0]
    assert total == jobs.stored(spark, home, "mails").filter("domain <> ''").count()
    monkeypatch.setattr(BatchStore, "commit", commit)
    # The query goes on: the killed batch is done again, in place of what it had left.
    jobs.drain(jobs.store_job(stream, home, score, threshold=5))
    log = scoring.log_rows(score(mails))
    assert _rows(jobs.stored(spark, home, "mails").drop("processing_ms")) == _rows(log)
    assert _rows(jobs.stored_domains(spark, home)) == _rows(domains.domain_risk(log))


def test_valid_runs_cover_every_batch_once():
    for n in range(200):
        covered = [b for size, run in valid_runs(n, 3) for b in range(run * 3**size, (run + 1) * 3**size)]
        assert sorted(covered) == list(range(n))
    assert len(valid_runs(1000, 8)) <= 7 * 4


def test_merged_state_keeps_few_files(spark, tmp_path):
    store = BatchStore(spark, str(tmp_path / "store"), base=2)

    def added(df):
        return df.groupBy("k").agg(F.sum("n").alias("n"))

    assert store.state("counts", added) is None
    for batch in range(13):
        assert store.begin(batch)
        store.merge("counts", spark.createDataFrame([(batch % 3, 1), (7, batch)], "k int, n long").coalesce(1), batch, added)
        store.commit(batch)
        got = {r["k"]: r["n"] for r in store.state("counts", added).collect()}
        assert got[7] == sum(range(batch + 1)) and sum(v for k, v in got.items() if k != 7) == batch + 1
    runs = [p for p in (tmp_path / "store/state/name=counts").glob("size=*/run=*")]
    assert len(runs) <= len(valid_runs(13, 2)) + len(valid_runs(12, 2)) + 2
    assert len(list((tmp_path / "store/commits").glob("batch=*"))) == 2
    assert not store.begin(12) and store.begin(13)
    with pytest.raises(RuntimeError, match="lost batches"):
        store.begin(15)
