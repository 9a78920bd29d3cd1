"""Connected components by alternating large and small stars over tables.

Each round replaces the edges by ones that lead to smaller nodes: a node's larger neighbours are tied to the smallest
node it knows (large star), then its smaller ones are (small star).  A node with very many neighbours never has them
gathered: only their minimum is taken, combined before the shuffle, and joined back, where skewed partitions
split.  Each round is a table in the shared folder, so no lineage grows and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postwarden.session import materialise


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")).first()
    return r["n"], r["x"]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter(
        "a <> b"
    ).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """edges lead from larger a to smaller b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Smallest reachable node (root) of each node that has an edge and isn't itself the smallest.

    ``edges`` has two columns of one orderable type; nodes without edges, and roots, have no row.
    """
    one, two = edges.columns
    now = materialise(
        edges.filter(F.col(one) != F.col(two)).select(
            F.greatest(one, two).alias("a"), F.least(one, two).alias("b")
        ).distinct(), "edges",
    )
    state = _state(now)
    while state[0]:
        now = materialise(_small_star(_large_star(now)), "edges")
        before, state = state, _state(now)
        if state == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
