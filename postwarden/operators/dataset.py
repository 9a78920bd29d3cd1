"""Building the labelled corpus: dedupe, split, hold-out, balance, weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postwarden.functions import fixed as fx
from postwarden.functions import text as tx
from postwarden.session import materialise


def min_length(df: DataFrame, chars: int = 20, column: str = "body") -> DataFrame:
    """Rows whose text is longer than ``chars``."""
    return df.filter(F.length(column) > chars)


def union_corpora(*parts: DataFrame) -> DataFrame:
    """UNION ALL by column name."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _content_key(columns: list[str]) -> Column:
    """SHA-256 over the columns, each preceded by its length, so no two contents share an input."""
    parts = []
    for c in columns:
        text = F.col(c).cast("string")
        parts += [F.coalesce(F.octet_length(text), F.lit(-1)).cast("string"), F.lit(":"),
                  F.coalesce(text, F.lit(""))]
    return F.sha2(F.concat(*parts), 256)


def dedupe_mail(
    df: DataFrame, keys: list[str] = ("subject", "body"), order: str = "mail_id", min_len: int = 30,
    ids_unique: bool = False,
) -> DataFrame:
    """Keeps the row with the lowest ``order`` of each content; then drops short bodies.

    The smallest id per content hash is found with partial aggregation, so a
    text with very many copies costs one row per task; whole rows are shuffled
    once, by id, to be matched with the kept ids.  Rows with the same id and
    content are merged, first within each task, unless ``ids_unique`` says there
    are none; different contents under one id stay apart.
    """
    long_enough = df.filter(F.length("body") > min_len)
    marked = long_enough.withColumn("content_", _content_key(list(keys)))
    kept = marked.groupBy("content_").agg(F.min(order).alias(order))
    rows = marked if ids_unique else marked.dropDuplicates([order, "content_"])
    return rows.join(kept, [order, "content_"], "left_semi").drop("content_")


def with_message_id(df: DataFrame, key: str = "message_id", order: str = "email_id") -> DataFrame:
    """Rows without a message id get one derived from their order key."""
    made = F.concat(F.lit("generated-"), F.col(order).cast("string"))
    return df.withColumn(key, F.coalesce(F.nullif(F.col(key), F.lit("")), made))


def unique_messages(df: DataFrame, key: str = "message_id", order: str = "email_id") -> DataFrame:
    """First row per message id; rows without one get an id derived from their order key."""
    filled = with_message_id(df, key, order)
    first = filled.groupBy(key).agg(F.min(order).alias(order))
    return filled.join(first, [key, order], "left_semi")


def hash_bucket(row_id, buckets: int) -> Column:
    """Stable bucket of an id from its MD5: the same in any engine and any partitioning."""
    head = F.substring(F.md5(tx._col(row_id).cast("string")), 1, 8)
    return F.pmod(F.conv(head, 16, 10).cast("long"), F.lit(buckets)).cast("int")


SPLITS = ("train", "val", "test")


def split_mail(df: DataFrame, weights=(8, 1, 1), row_id: str = "mail_id") -> DataFrame:
    """Adds ``split``; a projection, so no shuffle and the same answer on every run."""
    bucket = hash_bucket(row_id, sum(weights))
    edge, out = 0, None
    for name, w in zip(SPLITS, weights):
        edge += w
        out = F.when(bucket < edge, name) if out is None else out.when(bucket < edge, name)
    return df.withColumn("split", out)


def normalise_labels(df: DataFrame, label: str = "label") -> tuple[DataFrame, DataFrame]:
    """(rows with 0/1/2 labels, rows whose label is unknown)."""
    coded = df.withColumn("label_code", tx.label_code(label))
    return (
        coded.filter(F.col("label_code").isNotNull()),
        coded.filter(F.col("label_code").isNull()).drop("label_code"),
    )


def label_encoding(
    df: DataFrame, label: str = "label", known: list[str] = tuple(fx.LABEL_CODES)
) -> DataFrame:
    """(label, code) with codes by alphabetical order of the known labels present."""
    present = df.filter(F.col(label).isin(*known)).agg(
        F.array_sort(F.collect_set(label)).alias("present_")
    )
    return present.select(F.posexplode("present_").alias("code", label)).select(label, "code")


# --- exact numbers per class ------------------------------------------------


def _digest(row_id: str) -> Column:
    return F.struct(F.md5(F.col(row_id).cast("string")).alias("h"), F.col(row_id).alias("id"))


BUCKETS = 4096


def bucket_sizes(
    df: DataFrame, label: str, row_id: str = "mail_id", labels: list = fx.LABELS, buckets: int = BUCKETS
) -> DataFrame:
    """Rows of each class and hash bucket, a table of bounded size that is written once for all that reads it."""
    narrow = df.filter(F.col(label).isin(labels)).select(label, hash_bucket(row_id, buckets).alias("bucket_"))
    return materialise(narrow.groupBy(label, "bucket_").agg(F.count(F.lit(1)).alias("n_")), "bucket-sizes")


def _counts(sizes: DataFrame, label: str) -> DataFrame:
    return sizes.groupBy(label).agg(F.sum("n_").alias("class_count"))


def first_n_per_class(
    df: DataFrame, targets: DataFrame, label: str, row_id: str = "mail_id",
    labels: list = fx.LABELS, buckets: int = BUCKETS, sizes: DataFrame | None = None,
) -> DataFrame:
    """Adds ``picked_``: whether a row is among the ``target_`` first of its class in hash order.

    ``targets`` is (label, target_), ``sizes`` what ``bucket_sizes`` gives, if it is there already.  Classes are cut into hash buckets, whose
    counts say up to which bucket a class is taken whole; only the rows of its
    one next bucket are ranked, to find the last row taken.  That gives one
    cut per class (at most ``len(labels)`` rows, hence the broadcast), and
    picking is a comparison in place: no class ever moves to one task.
    """
    narrow = df.filter(F.col(label).isin(labels)).select(
        label, row_id, hash_bucket(row_id, buckets).alias("bucket_")
    )
    if sizes is None:
        sizes = narrow.groupBy(label, "bucket_").agg(F.count(F.lit(1)).alias("n_"))
    before = Window.partitionBy(label).orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)
    room = sizes.join(F.broadcast(targets), label).select(
        label, "bucket_", "n_",
        (F.col("target_") - F.coalesce(F.sum("n_").over(before), F.lit(0))).alias("room_"),
    )
    whole, part = F.col("room_") >= F.col("n_"), F.col("room_") > 0
    edges = room.groupBy(label).agg(
        F.max(F.when(whole, F.col("bucket_"))).alias("whole_to_"),
        F.max(F.when(part & ~whole, F.struct("bucket_", "room_"))).alias("edge_"),
    )
    order = Window.partitionBy(label).orderBy(_digest(row_id))
    last_taken = (
        narrow.join(F.broadcast(edges.select(label, "edge_")), label)
        .filter(F.col("bucket_") == F.col("edge_.bucket_"))
        .withColumn("rank_", F.row_number().over(order))
        .filter(F.col("rank_") <= F.col("edge_.room_"))
        .groupBy(label).agg(F.max(_digest(row_id)).alias("cut_"))
    )
    cuts = edges.select(label, "whole_to_", F.col("edge_.bucket_").alias("edge_bucket_")).join(
        F.broadcast(last_taken), label, "left"
    )
    mine = hash_bucket(row_id, buckets)
    picked = (mine <= F.col("whole_to_")) | (
        (mine == F.col("edge_bucket_")) & (_digest(row_id) <= F.col("cut_"))
    )
    return df.join(F.broadcast(cuts), label, "left").select(
        *df.columns, F.coalesce(picked, F.lit(False)).alias("picked_")
    )


def class_counts(df: DataFrame, label: str = "label", labels: list = fx.LABELS) -> DataFrame:
    """Rows per known class: at most ``len(labels)`` rows."""
    return df.filter(F.col(label).isin(labels)).groupBy(label).agg(
        F.count(F.lit(1)).alias("class_count")
    )


def stratified_holdout(
    df: DataFrame, fraction: float = 0.2, label: str = "label", row_id: str = "mail_id",
    labels: list = fx.LABELS,
) -> DataFrame:
    """Adds ``is_holdout``; exactly round(fraction x class size) rows of every class."""
    sizes = bucket_sizes(df, label, row_id, labels)
    targets = _counts(sizes, label).select(
        label, F.floor(F.col("class_count") * F.lit(fraction) + 0.5).cast("long").alias("target_")
    )
    return first_n_per_class(df, targets, label, row_id, labels, sizes=sizes).withColumnRenamed(
        "picked_", "is_holdout"
    )


def oversample(
    df: DataFrame, ratio: float = 0.05, label: str = "label", row_id: str = "mail_id",
    labels: list = fx.LABELS,
) -> DataFrame:
    """Repeats rows of the smallest class until it has ``ratio`` of the largest; adds ``copy``.

    Every row is repeated target // size times, and the first target % size
    rows in hash order once more.  Other classes stay as they are; rows without
    a known class are left out.
    """
    sizes = bucket_sizes(df, label, row_id, labels)
    counts = _counts(sizes, label)
    edges = counts.agg(
        F.min(F.struct("class_count", label)).alias("least_"), F.max("class_count").alias("most_")
    )
    minority = edges.select(F.col(f"least_.{label}")).scalar()
    target = edges.select(
        F.greatest(F.col("least_.class_count"), F.floor(F.col("most_") * F.lit(ratio)))
    ).scalar()
    wanted = counts.select(
        label, "class_count",
        F.when(F.col(label) == minority, target).otherwise(F.col("class_count")).alias("want_"),
    ).select(
        label, F.expr("want_ DIV class_count").alias("times_"),
        F.expr("want_ % class_count").alias("target_"),
    )
    marked = first_n_per_class(df, wanted.select(label, "target_"), label, row_id, labels, sizes=sizes)
    repeats = (F.col("times_") + F.col("picked_").cast("long")).cast("int")
    return marked.join(F.broadcast(wanted.select(label, "times_")), label).select(
        *df.columns, F.explode(F.sequence(F.lit(1), repeats)).alias("copy")
    )


def class_weights(df: DataFrame, label: str = "label", labels: list = fx.LABELS) -> DataFrame:
    """Inverse frequency per class, scaled so that the largest class has weight 1."""
    counts = class_counts(df, label, labels)
    most = counts.agg(F.max("class_count")).scalar()
    return counts.select(label, "class_count", (most / F.col("class_count")).alias("weight"))


def with_class_weights(df: DataFrame, label: str = "label", labels: list = fx.LABELS) -> DataFrame:
    """Adds ``weight``; the weights are one row per known class."""
    weights = class_weights(df, label, labels).select(label, "weight")
    return df.join(F.broadcast(weights), label)
