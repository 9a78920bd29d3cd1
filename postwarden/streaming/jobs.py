"""Streaming counterparts of the reports, the domain table and campaign detection.

Every job is restartable: its progress lives in a checkpoint folder and its
sinks write one folder per batch, so a repeated batch replaces its own output.
"""

from __future__ import annotations

import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from postwarden.functions.times import from_instant, to_instant
from postwarden.operators import campaigns as cp
from postwarden.operators.domains import domain_counts, grade_domains, merge_domain_counts
from postwarden.plans.scoring import factor_rows, log_rows
from postwarden.operators.dataset import with_message_id
from postwarden.session import delete_folder, shared_dir
from postwarden.streaming.store import BatchStore

AT = "classified_at"
INSTANT = "instant_"  # watermarks need a time with zone


def log_stream(
    spark: SparkSession, folder: str, schema: str, glob: str | None = None,
    files_per_batch: int | None = None,
) -> DataFrame:
    """File stream of parquet log files."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def _start(df: DataFrame, mode: str, home: str, sink: Callable, once: bool) -> StreamingQuery:
    writer = (
        df.writeStream.outputMode(mode).foreachBatch(sink)
        .option("checkpointLocation", os.path.join(home, "checkpoint"))
    )
    return (writer.trigger(availableNow=True) if once else writer).start()


def _batch_folder(home: str, name: str, batch: int) -> str:
    return os.path.join(home, name, f"batch={batch}")


def drain(query: StreamingQuery) -> None:
    """Waits for a query over the data that exists now, and raises what it raised."""
    query.awaitTermination()
    problem = query.exception()
    if problem is not None:
        raise problem


# --- keyed results that later batches replace -------------------------------


def upsert_job(df: DataFrame, home: str, once: bool = True) -> StreamingQuery:
    """Update-mode result: each batch appends the rows that changed in it."""

    def sink(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(_batch_folder(home, "rows", batch))

    return _start(df, "update", home, sink, once)


def latest_rows(spark: SparkSession, home: str, keys: list[str]) -> DataFrame:
    """Newest version of every key of an upsert job."""
    rows = spark.read.parquet(os.path.join(home, "rows"))
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(
        F.max_by(F.struct(*values), "batch").alias("last_")
    ).select(*keys, "last_.*")


def hourly_volume_stream(log: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Mails per hour and label; rows later than ``lateness`` behind the newest are dropped."""
    return (
        log.select(to_instant(F.col(AT)).alias(INSTANT), "predicted_label")
        .withWatermark(INSTANT, lateness)
        .groupBy(F.window(INSTANT, "1 hour").alias("w_"), "predicted_label")
        .agg(F.count(F.lit(1)).alias("mails"))
        .select(from_instant(F.col("w_.start")).alias("hour"), "predicted_label", "mails")
    )


def domain_count_stream(log: DataFrame) -> DataFrame:
    """Running counts per domain as a stateful stream, for short ones; ``domain_job`` keeps its files few."""
    return domain_counts(log)


def graded_domains(spark: SparkSession, home: str) -> DataFrame:
    return grade_domains(latest_rows(spark, home, ["domain"]))


def _added(parts: DataFrame) -> DataFrame:
    return merge_domain_counts(parts.limit(0), parts)


def domain_job(log: DataFrame, home: str, once: bool = True, base: int = 8) -> StreamingQuery:
    """Counts per domain, kept as merged runs of batches: no state store, and few files after any number of batches."""

    def sink(rows: DataFrame, batch: int) -> None:
        store = BatchStore(rows.sparkSession, home, base)
        if store.begin(batch):
            store.merge("domain_counts", domain_counts(rows), batch, _added)
            store.commit(batch)

    return _start(log, "append", home, sink, once)


def stored_domains(spark: SparkSession, home: str, base: int = 8) -> DataFrame:
    """Domain table over all visible batches of a domain or store job."""
    return grade_domains(BatchStore(spark, home, base).state("domain_counts", _added))


# --- appended results -------------------------------------------------------


def append_job(df: DataFrame, home: str, once: bool = True) -> StreamingQuery:
    """Append-only parquet sink, for sender history and deduplicated mail."""
    writer = (
        df.writeStream.outputMode("append").format("parquet")
        .option("checkpointLocation", os.path.join(home, "checkpoint"))
        .option("path", os.path.join(home, "rows"))
    )
    return (writer.trigger(availableNow=True) if once else writer).start()


def sender_history(log: DataFrame) -> DataFrame:
    """Projection kept per sender, with the confidence where the log has it; the same for a table and for a stream."""
    return log.select(
        F.col("from_email").alias("email_address"), "message_id", "predicted_label", "risk_score",
        *[c for c in ("confidence",) if c in log.columns], F.col(AT).alias("sent_at"),
    )


def unique_message_stream(log: DataFrame, lateness: str = "1 day") -> DataFrame:
    """First arrival per message id; ids are forgotten once ``lateness`` has passed.

    Rows without an id get one from their order key, as in a table.
    """
    log = with_message_id(log)
    timed = log.withColumn(INSTANT, to_instant(F.col(AT))).withWatermark(INSTANT, lateness)
    return timed.dropDuplicatesWithinWatermark(["message_id"]).drop(INSTANT)


# --- campaigns --------------------------------------------------------------


CAMPAIGN_STATE = (
    "domain string, last_detected timestamp_ntz, email_count bigint, first_detected timestamp_ntz"
)
RECENT = "domain string, predicted_label string, classified_at timestamp_ntz"


def _campaign_step(
    store: BatchStore, rows: DataFrame, batch: int, window_seconds: int, threshold: int, lateness_seconds: int
) -> None:
    """Writes the campaigns after a batch, and the recent rows that later counts can still need."""
    keep = f"INTERVAL {int(lateness_seconds + window_seconds)} SECONDS"
    late = f"INTERVAL {int(lateness_seconds)} SECONDS"
    recent = store.replaced("recent", RECENT, batch - 1)
    before = store.replaced("campaigns", CAMPAIGN_STATE, batch - 1)
    new = rows.select("domain", "predicted_label", AT)
    newest = recent.agg(F.max(AT)).scalar()
    in_time = new.filter(newest.isNull() | (F.col(AT) >= newest - F.expr(late)))
    known = recent.unionByName(in_time)
    alerts = cp.campaign_alerts(known, window_seconds, threshold)
    found = alerts.groupBy("domain").agg(
        F.max(AT).alias("last_detected"),
        F.max_by("similar_emails", F.struct(AT, "similar_emails")).alias("email_count"),
        F.min(AT).alias("first_detected"),
    )
    newer = F.struct("last_detected", "email_count")
    merged = before.unionByName(found).groupBy("domain").agg(
        F.max(newer).alias("n_"), F.min("first_detected").alias("first_detected")
    ).select("domain", "n_.last_detected", "n_.email_count", "first_detected")
    store.replace("campaigns", merged, batch)
    edge = known.agg(F.max(AT)).scalar()
    store.replace("recent", known.filter(F.col(AT) >= edge - F.expr(keep)), batch)


def campaign_job(
    log: DataFrame, home: str, window_seconds: int = 600, threshold: int = 15,
    lateness_seconds: int = 3600, once: bool = True,
) -> StreamingQuery:
    """Keeps one campaign row per domain up to date.

    Lost state of an earlier batch is an error.  State is two tables per batch: the recent log rows a trailing count can
    still need (lateness + window), and the campaigns so far.  Each batch counts over recent + new rows with the same
    running sums as the batch job, so a busy domain is spread over many tasks.  A row that comes late by less than
    ``lateness_seconds`` has its effect; later ones are dropped.
    """

    def sink(rows: DataFrame, batch: int) -> None:
        store = BatchStore(rows.sparkSession, home)
        if store.begin(batch):
            _campaign_step(store, rows, batch, window_seconds, threshold, lateness_seconds)
            store.commit(batch)

    return _start(log, "append", home, sink, once)


def campaign_table(spark: SparkSession, home: str) -> DataFrame:
    """Campaign rows after the newest visible batch."""
    store = BatchStore(spark, home)
    rows = store.replaced("campaigns", CAMPAIGN_STATE, store.committed())
    return rows.select(
        cp.campaign_name().alias("campaign_name"), "domain",
        F.lit("coordinated_attack").alias("attack_type"), F.lit("active").alias("status"),
        F.lit("critical").alias("severity"), "email_count", "first_detected", "last_detected",
    )


# --- several tables from one batch ------------------------------------------


def store_job(
    mail: DataFrame, home: str, score: Callable[[DataFrame], DataFrame], once: bool = True,
    window_seconds: int = 600, threshold: int = 15, lateness_seconds: int = 3600,
) -> StreamingQuery:
    """Scores a mail stream and stores all tables of a batch, visible together or not at all.

    Written are mails, texts, risk factors, sender history, errors, counts per domain and campaigns; ``score`` maps mails to
    scored mails (with classified_at) and the batch is scored once.  Texts come from the mails themselves, so no scored row
    carries one.  ``stored`` reads what is visible.
    """

    def sink(rows: DataFrame, batch: int) -> None:
        store = BatchStore(rows.sparkSession, home)
        if not store.begin(batch):
            return
        spark, started = rows.sparkSession, time.monotonic()
        path = shared_dir(spark, "scored")
        score(rows).write.parquet(path)
        millis = round(1000 * (time.monotonic() - started))
        scored = spark.read.parquet(path)
        n = scored.count()
        mails = log_rows(scored)
        texts = [c for c in ("body", "raw_headers", "headers") if c in rows.columns]
        store.append("mails", mails.withColumn("processing_ms", F.lit(millis / max(n, 1))), batch)
        store.append("texts", rows.select(F.col("mail_id").alias("email_id"), *texts), batch)
        store.append("factors", factor_rows(scored.filter(F.col("error").isNull()), at=AT), batch)
        store.append("history", sender_history(mails), batch)
        store.append("errors", scored.filter(F.col("error").isNotNull()).select("mail_id", "error"), batch)
        store.merge("domain_counts", domain_counts(mails), batch, _added)
        _campaign_step(store, mails, batch, window_seconds, threshold, lateness_seconds)
        store.commit(batch, n, millis)
        delete_folder(spark, path)

    return _start(mail, "append", home, sink, once)


def stored(spark: SparkSession, home: str, name: str) -> DataFrame:
    """The visible rows of a table of a store job."""
    return BatchStore(spark, home).table(name)


def new_home(spark: SparkSession, purpose: str) -> str:
    return shared_dir(spark, f"stream-{purpose}")
