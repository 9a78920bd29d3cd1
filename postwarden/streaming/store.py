"""Tables that grow batch by batch and become visible a whole batch at a time.

Every table of a batch is written first, to folders that carry the batch's number; a marker written last makes the batch visible.
Readers take batches up to the newest marker, so what a killed batch left is never seen, and its repetition replaces it.

State that is merged over batches (counts per key) is kept in runs of sizes 1, ``base``, ``base`` squared and so on: whenever
``base`` runs of one size are complete they are merged into one of the next, so after n batches there are fewer than ``base`` runs
of each size, and each row is rewritten as often as there are sizes.  Which runs are valid follows from n alone.  Runs that are not
valid any more are deleted one batch later, so a reader that has just begun finds what it saw.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postwarden.session import delete_folder
from postwarden.sources.tables import read_or_empty

MARKER = "rows bigint, millis bigint, batch int"


def valid_runs(batches: int, base: int) -> list[tuple[int, int]]:
    """(size, number) of the runs that hold the first ``batches`` batches; run i of size k holds base**k of them."""
    runs, size = [], 0
    while base**size <= batches:
        done = batches // base**size
        runs += [(size, i) for i in range(done // base * base, done)]
        size += 1
    return runs


class BatchStore:
    def __init__(self, spark: SparkSession, home: str, base: int = 8):
        self.spark, self.home, self.base = spark, home, base

    def _path(self, *parts) -> str:
        return os.path.join(self.home, *map(str, parts))

    # --- batches ---

    def committed(self) -> int:
        """The newest visible batch, -1 before the first."""
        newest = read_or_empty(self.spark, self._path("commits"), MARKER).agg(F.max("batch")).first()[0]
        return -1 if newest is None else newest

    def begin(self, batch: int) -> bool:
        """Whether the batch has to be done: a repeated one that is visible has not, one after a gap is an error."""
        newest = self.committed()
        if batch > newest + 1:
            raise RuntimeError(f"batch {batch} follows {newest}: the store has lost batches")
        return batch == newest + 1

    def commit(self, batch: int, rows: int = 0, millis: int = 0) -> None:
        """Makes the batch visible, and removes what the batch before the last needed alone."""
        row = self.spark.createDataFrame([(rows, millis)], "rows bigint, millis bigint").coalesce(1)
        row.write.mode("overwrite").parquet(self._path("commits", f"batch={batch}"))
        kept = {*valid_runs(batch, self.base), *valid_runs(batch + 1, self.base)}
        for name in self._numbered("state"):
            for size in self._numbered("state", name):
                for run in self._numbered("state", name, size):
                    if (int(size.partition("=")[2]), int(run.partition("=")[2])) not in kept:
                        delete_folder(self.spark, self._path("state", name, size, run))
        delete_folder(self.spark, self._path("commits", f"batch={batch - 2}"))

    # --- tables that only grow ---

    def append(self, name: str, df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(self._path(name, f"batch={batch}"))

    def table(self, name: str) -> DataFrame:
        """The rows of all visible batches."""
        rows = self.spark.read.parquet(self._path(name))
        return rows.filter(F.col("batch") <= self.committed()).drop("batch")

    def replaced(self, name: str, schema: str, batch: int) -> DataFrame:
        """What one batch wrote of a table that each batch writes whole; empty before the first."""
        if batch < 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self._path(name, f"batch={batch}"))

    def replace(self, name: str, df: DataFrame, batch: int) -> None:
        """Writes such a table; the one before the last is removed."""
        self.append(name, df, batch)
        delete_folder(self.spark, self._path(name, f"batch={batch - 2}"))

    # --- state merged over batches ---

    def _run(self, name: str, size: int, run: int) -> str:
        return self._path("state", f"name={name}", f"size={size}", f"run={run}")

    def _numbered(self, *parts) -> list[str]:
        """The folders below, which are few."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(*parts))
        system = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [s.getPath().getName() for s in system.listStatus(place)] if system.exists(place) else []
        return [n for n in found if "=" in n]

    def merge(self, name: str, df: DataFrame, batch: int, merged: Callable[[DataFrame], DataFrame]) -> None:
        """Adds a batch's part to a state; ``merged`` adds up the rows of several parts."""
        df.write.mode("overwrite").parquet(self._run(name, 0, batch))
        size = 0
        while (batch + 1) % self.base ** (size + 1) == 0:
            done = (batch + 1) // self.base**size
            parts = [self._run(name, size, i) for i in range(done - self.base, done)]
            size += 1
            merged(self.spark.read.parquet(*parts)).write.mode("overwrite").parquet(
                self._run(name, size, done // self.base - 1)
            )

    def state(self, name: str, merged: Callable[[DataFrame], DataFrame]) -> DataFrame | None:
        """The state over all visible batches; None before the first."""
        runs = valid_runs(self.committed() + 1, self.base)
        return merged(self.spark.read.parquet(*[self._run(name, k, i) for k, i in runs])) if runs else None
