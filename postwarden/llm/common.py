"""Small helpers that several operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def remainder(column: str, divisor: int) -> Column:
    """crc32 of the value as text, modulo ``divisor``; null for a null value."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % divisor


def ascii_lower(column: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(column, UPPER, LOWER)


def texts(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """The column's strings, null as empty."""
    return [x or "" for x in column.to_pylist()]


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    """A record batch from columns in the schema's order."""
    arrays = [
        c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, type=f.type)
        for c, f in zip(columns, schema, strict=True)
    ]
    arrays = [a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a for a in arrays]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def carried(df: DataFrame, id_col: str, text_col: str, carry: bool) -> DataFrame:
    """What an operator hands on beside its results: the id, or the whole row as one column, so that no names clash.

    The text stands beside it, unless the row has it as a string: no text travels twice.
    """
    text = F.col(text_col).cast("string").alias("_text")
    if not carry:
        return df.select(F.col(id_col).cast("bigint").alias(id_col), text)
    narrow = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), text)
    return narrow.select("row") if place_of(df, text_col) is not None else narrow


def place_of(df: DataFrame, column: str) -> int | None:
    """The place of a column of strings among the others."""
    at = [i for i, f in enumerate(df.schema) if f.name.lower() == column.lower() and f.dataType == T.StringType()]
    return at[0] if len(at) == 1 else None


def text_of(b: pa.RecordBatch, place: int | None) -> pa.Array:
    """The texts of a batch of ``carried`` rows; ``place`` is that of the text in the row."""
    return b.column(1) if b.num_columns > 1 else b.column(0).field(place)


def result_type(narrow: DataFrame, **fields: str | T.DataType) -> T.StructType:
    """The first column of ``narrow`` and further fields."""
    kind = T.StructType([narrow.schema.fields[0]])
    for name, of in fields.items():
        kind = kind.add(name, of)
    return kind


def take_sample(df: DataFrame, key: str, by: list[str], rows: int) -> DataFrame:
    """About ``rows`` rows of each value of ``by``, chosen by a hash of ``key``.

    The counts come from one narrow pass; the choice itself is a filter, so
    nothing is shuffled and no value's rows meet in one task.  The number of
    values of ``by`` has to be small (classes, languages).
    """
    share = F.lit(0.0)
    for r in df.groupBy(*by).count().collect():
        same = F.lit(True)
        for c in by:
            same = same & F.col(c).eqNullSafe(F.lit(r[c]))
        share = F.when(same, F.lit(min(1.0, rows / r["count"]))).otherwise(share)
    unit = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("sample")), F.lit(1 << 20)) / float(1 << 20)
    return df.filter(unit < share)


_KEPT: dict = {}


def kept(make, *key):
    """``make(*key)``, which this worker keeps for its later tasks in place of what it kept before.

    The same workers serve all operators of a session in turn, so what each of them remembers would add up.
    """
    if (make, key) not in _KEPT:
        forget()
        _KEPT[make, key] = make(*key)
    return _KEPT[make, key]


def forget() -> None:
    """Lets go of what other operators left in this worker."""
    _KEPT.clear()


class Generations:
    """A bounded memory of two halves: when the younger one is full it becomes the older, whose entries live on if they are asked for.

    So what is met again and again is never worked out twice, and what is met once is forgotten.
    """

    def __init__(self, most: int):
        self.half, self.young, self.old = max(1, most // 2), {}, {}

    def missing(self, wanted) -> list:
        """Those that have to be worked out and set in ``young``; after that ``young`` holds all that are wanted."""
        young = self.young
        new = [w for w in wanted if w not in young]
        if len(young) + len(new) > self.half:
            self.old, self.young, new = young, {}, list(wanted)
        young, old, unknown = self.young, self.old, []
        for w in new:
            if w in old:
                young[w] = old[w]
            else:
                unknown.append(w)
        return unknown


def group_starts(*columns: np.ndarray) -> np.ndarray:
    """Where a new group begins in columns that are sorted together, with the end appended."""
    n = len(columns[0])
    if not n:
        return np.zeros(1, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), n)


def merged(rows: DataFrame, how: str, kind: str, bits: int = 8) -> np.ndarray | None:
    """One array from an array per task (columns part, data), added or or-ed in steps of 2 to the ``bits`` at a time.

    Every array has the same bounded size, so no task holds more than that many of them.
    """
    def join(table: pa.Table) -> pa.Table:
        total = None
        for x in table.column("data"):
            own = np.frombuffer(x.as_py(), kind)
            total = own if total is None else total + own if how == "sum" else total | own
        part = table.column("part")[0].as_py() >> bits
        return pa.table({"part": pa.array([part], pa.int64()), "data": pa.array([total.tobytes()], pa.binary())})

    last = rows.agg(F.max("part")).first()[0]
    if last is None:
        return None
    while True:
        rows = rows.groupBy((F.col("part") / (1 << bits)).cast("bigint").alias("_g")).applyInArrow(
            lambda t: join(t), "part bigint, data binary"
        )
        last >>= bits
        if not last:
            return np.frombuffer(rows.first()["data"], kind)


def runs(batches, keys: int):
    """Rows of record batches by runs of equal values in the first ``keys`` columns (numbers without nulls).

    Gives numpy columns and where each run starts, with the end appended; a run is never cut.
    """
    held = None
    for b in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if held is not None:
            columns = [np.concatenate([h, c]) for h, c in zip(held, columns)]
        starts = group_starts(*columns[:keys])
        if len(starts) > 2:
            yield [c[: starts[-2]] for c in columns], starts[:-1]
        held = [c[starts[-2] :] for c in columns] if len(starts) > 1 else None
    if held is not None:
        yield held, np.array([0, len(held[0])])
