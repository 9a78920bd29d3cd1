"""Document fingerprints from closed syncmers, with DataFrame functions only.

A text is a sequence of words (runs of at most ``WORD`` non-space characters).  Three words in a row are an anchor
(a closed syncmer) when the smallest of their hashes is at an edge.  That depends on the three words
alone, so equal passages have equal anchors wherever they stand.  The fingerprint keeps the ``ANCHORS`` anchors with
the smallest hashes, each with the place of its first occurrence: 16 hexadecimal digits, 44 bits of hash and 20
bits of place (later places count as the last that fits).  Fewer than three words are one anchor as a whole; a text
without words, empty or null, has the empty fingerprint.

Two fingerprints are compared by position: among the smallest hashes of their union, those in both count when their
shift (difference of places) is within ``SLACK`` words of the commonest shift.  The likeness is their share; two empty
fingerprints are alike (1), an empty one is unlike any other (0).

``with_next`` gives each row the text of the next one by id without a global sort: rows meet in buckets of at
most 2**BUCKET_BITS consecutive ids, and each bucket also gets the first row of the next one.  Null ids come first; rows
with the same id are ordered by their text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postwarden.session import materialise

WORD, ANCHORS, SLACK = 16, 64, 16
PLACE_BITS, BUCKET_BITS, LEVEL_BITS = 20, 10, 20
LAST_PLACE = (1 << PLACE_BITS) - 1


def word_hashes(text: Column) -> Column:
    words = F.regexp_extract_all(text, F.lit(r"[^ \t\n\x0B\f\r]{1,%d}" % WORD), F.lit(0))
    return F.transform(words, lambda w: F.xxhash64(w))


def _packed(hashed: Column, place: Column) -> Column:
    return hashed.bitwiseAND(F.lit(~LAST_PLACE)).bitwiseOR(F.least(place.cast("bigint"), F.lit(LAST_PLACE).cast("bigint")))


def anchors_from_hashes(h: Column) -> Column:
    """Anchors in the order of their hashes.  ``h`` has to be a column, since lambdas refer to it."""
    def at(i: Column) -> Column:
        one, two = F.get(h, i), F.get(h, i + 1)
        three = F.get(h, i + 2)
        return F.when(F.least(one, three) <= two, _packed(F.xxhash64(one, two, three), i))

    found = F.array_compact(F.transform(F.sequence(F.lit(0), F.size(h) - 3), at))
    whole = F.array(_packed(F.xxhash64(h), F.lit(0)))
    return F.sort_array(
        F.when(F.size(h) >= 3, found).when(F.size(h) > 0, whole).otherwise(F.array().cast("array<bigint>"))
    )


def first_places(ordered: Column) -> Column:
    """The first of each hash, and of those the smallest ``ANCHORS``."""
    def new(x: Column, i: Column) -> Column:
        return (i == 0) | (F.shiftright(x, PLACE_BITS) != F.shiftright(F.get(ordered, i - 1), PLACE_BITS))

    return F.slice(F.filter(ordered, new), 1, ANCHORS)


def with_anchors(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the anchors of a text column; staged, so that each step is computed once."""
    return (
        df.withColumn("_hashes", word_hashes(F.col(text)))
        .withColumn("_ordered", anchors_from_hashes(F.col("_hashes"))).drop("_hashes")
        .withColumn(out, first_places(F.col("_ordered"))).drop("_ordered")
    )


def shown(anchors: Column) -> Column:
    return F.array_join(F.transform(anchors, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def with_likeness(df: DataFrame, one: str, two: str, out: str) -> DataFrame:
    """Adds the likeness of two anchor columns."""
    a, b = F.col(one), F.col(two)

    def hashes(x: Column) -> Column:
        return F.transform(x, lambda v: F.shiftright(v, PLACE_BITS))

    staged = df.withColumn("_a", hashes(a)).withColumn("_b", hashes(b)).withColumn(
        "_union", F.slice(F.sort_array(F.array_union("_a", "_b")), 1, ANCHORS)
    ).withColumn("_both", F.array_intersect(F.array_intersect("_a", "_b"), "_union"))

    def place(x: Column, own: str, h: Column) -> Column:
        return F.get(x, F.array_position(F.col(own), h).cast("int") - 1).bitwiseAND(F.lit(LAST_PLACE))

    shifts = F.transform("_both", lambda h: place(a, "_a", h) - place(b, "_b", h))
    staged = staged.withColumn("_shifts", shifts)
    best = F.array_max(F.transform(
        F.array_distinct("_shifts"), lambda d: F.size(F.filter("_shifts", lambda e: F.abs(e - d) <= SLACK))
    ))
    return staged.withColumn(
        out, F.when(F.size("_union") == 0, 1.0).otherwise(F.coalesce(best, F.lit(0)) / F.size("_union"))
    ).drop("_a", "_b", "_union", "_both", "_shifts")


def following(values: DataFrame, column: str, levels: int) -> DataFrame:
    """The next larger value of each distinct value, the smallest after the largest.

    Values are grouped by their upper bits, so that no group is larger than the bits allow; what follows a
    group's last value is the first of the next group, found the same way one level up.
    """
    if levels == 0:
        order = Window.orderBy(column)
        return values.select(
            column, F.coalesce(F.lead(column).over(order), F.min(column).over(Window.partitionBy())).alias("next")
        )
    up = f"{column}_up"
    grouped = values.withColumn(up, F.shiftright(column, LEVEL_BITS))
    lowest = grouped.groupBy(up).agg(F.min(column).alias("lowest"))
    ahead = following(lowest.select(up), up, levels - 1).join(
        lowest.select(F.col(up).alias("next"), "lowest"), "next"
    ).select(up, "lowest")
    inside = F.lead(column).over(Window.partitionBy(up).orderBy(column))
    return grouped.withColumn("_inside", inside).join(ahead, up).select(
        column, F.coalesce("_inside", "lowest").alias("next")
    )


def with_next(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, Window]:
    """Rows by bucket with the text of the next row; ``extra`` marks the copied first row of the next bucket."""
    rows = df.select(
        F.col(id_col).cast("bigint").alias(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    ).withColumn("key", F.coalesce(id_col, F.lit(-(1 << 63)).cast("bigint"))).withColumn(
        "bucket", F.shiftright("key", BUCKET_BITS)
    )
    first = materialise(rows.groupBy("bucket").agg(F.min("key").alias("first_key")), "buckets")
    ahead = following(first.select("bucket"), "bucket", 2)
    wanted = materialise(ahead.join(
        first.select(F.col("bucket").alias("next"), "first_key"), "next"
    ).select("first_key", F.col("bucket").alias("to_bucket")), "bucket-ends")
    extra = rows.join(wanted, rows["key"] == wanted["first_key"]).select(
        id_col, "text", "key", F.col("to_bucket").alias("bucket"), F.lit(1).alias("extra")
    )
    window = Window.partitionBy("bucket").orderBy("extra", "key", "text_hash")
    both = rows.select(id_col, "text", "key", "bucket", F.lit(0).alias("extra")).unionByName(extra)
    return both.withColumn("text_hash", F.xxhash64("text")), window


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of every row's text."""
    rows = df.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return with_anchors(rows, "_text", "_anchors").select(id_col, shown(F.col("_anchors")).alias("fingerprint"))


def compared_with_edited(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited form, and their likeness.

    The edited text has its last half replaced by the beginning of the next row's text.
    """
    rows, window = with_next(df, id_col, text_col)
    half = F.floor(F.col("n_chars") / 2).cast("int")
    staged = rows.withColumn("next_text", F.lead("text").over(window)).withColumn(
        "n_chars", F.char_length("text").cast("bigint")
    ).withColumn(
        "edited", F.concat(F.left("text", F.col("n_chars").cast("int") - half), F.left(F.coalesce("next_text", F.lit("")), half))
    ).drop("next_text")
    staged = with_anchors(staged, "text", "own").drop("text")
    staged = with_anchors(staged, "edited", "other").withColumn("edited_sha256", F.sha2("edited", 256)).drop("edited")
    staged = staged.withColumn("following", F.lead("own").over(window)).filter("extra = 0")
    staged = with_likeness(staged, "own", "other", "near_edited")
    staged = with_likeness(staged, "own", "following", "near_next")
    return staged.select(
        id_col, "n_chars", "edited_sha256", shown(F.col("own")).alias("fingerprint"),
        shown(F.col("other")).alias("edited_fingerprint"), "near_edited", "near_next",
    )
