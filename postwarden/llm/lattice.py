"""Near-duplicate vectors by lattice hashing.

Each of ``tables`` random projections takes a unit vector to eight dimensions, where the nearest point of the E8
lattice is its cell; the ``probes`` neighbouring cells that lie closest are probed too.  Two vectors are compared, by
cosine in double precision, when the cell of one is the cell or a probed one of the other in some table.

Equal vectors of a label are one node that counts as many.  Memberships in cells are narrow rows; those of cells that
only one node reaches are dropped before vectors are joined to them.  A crowded cell is split into blocks, and each
pair of blocks is a piece of work of its own.  A pair that several cells find is counted where it is found first, so no list
of pairs exists: a node gets its number of links from each piece, and a tie to the first node that its links lead to there.

Vectors that are null, empty, zero or hold null or non-finite numbers, and those without a label, link with nothing;
vectors of different dimension don't link.  Rows that repeat a vec_id are vectors of their own.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postwarden.llm.common import batch
from postwarden.llm.components import components
from postwarden.session import materialise

#: Vectors in a block of a crowded cell.
BLOCK = 1024
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5,
                 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def e8_roots() -> np.ndarray:
    """The 240 shortest vectors: two coordinates of size one, or all of size a half with an even number negative."""
    eye = np.eye(8)
    whole = [s * eye[i] + t * eye[j] for i in range(8) for j in range(i) for s in (1, -1) for t in (1, -1)]
    signs = 0.5 - np.array([[m >> k & 1 for k in range(8)] for m in range(256)])
    return np.concatenate([np.array(whole), signs[(signs < 0).sum(axis=1) % 2 == 0]])


def nearest_e8(y: np.ndarray) -> np.ndarray:
    """The nearest lattice point of each row: the better of the integer points with even sum and their shift by a half."""
    def even(z: np.ndarray) -> np.ndarray:
        point = np.rint(z)
        error = z - point
        odd = np.flatnonzero(point.sum(axis=1) % 2)
        worst = np.abs(error[odd]).argmax(axis=1)
        point[odd, worst] += np.where(error[odd, worst] >= 0, 1, -1)
        return point

    whole, shifted = even(y), even(y - 0.5) + 0.5
    better = ((y - whole) ** 2).sum(axis=1) <= ((y - shifted) ** 2).sum(axis=1)
    return np.where(better[:, None], whole, shifted)


class Lattice:
    """Projections for one dimension, the same in every process."""

    def __init__(self, dim: int, tables: int, probes: int, scale: float, seed: int):
        rng = np.random.default_rng([seed, dim])
        self.projection = rng.standard_normal((tables, dim, 8)) / scale
        self.offset = rng.random((tables, 8))
        self.roots, self.probes = e8_roots(), probes
        self.salt = rng.integers(1, 1 << 63, tables).astype(np.uint64)

    def _code(self, points: np.ndarray, table: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = ((points * 2).astype(np.int64).astype(np.uint64) * _MIX).sum(axis=-1, dtype=np.uint64) + self.salt[table]
            h ^= h >> np.uint64(29)
            h *= _MIX[4]
            return (h ^ (h >> np.uint64(32))).view(np.int64)

    def cells(self, unit: np.ndarray, table: int) -> np.ndarray:
        """Codes of the own cell (first column) and the probed ones."""
        y = unit @ self.projection[table] + self.offset[table]
        home = nearest_e8(y)
        away = -2 * (y - home) @ self.roots.T
        close = np.argsort(away, axis=1, kind="stable")[:, : self.probes]
        return self._code(np.concatenate([home[:, None], home[:, None] + self.roots[close]], axis=1), table)


@lru_cache(8)
def lattice(dim: int, tables: int, probes: int, scale: float, seed: int) -> Lattice:
    return Lattice(dim, tables, probes, scale, seed)


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    # scaled first, so that very large or small numbers neither overflow nor vanish
    v = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def usable(vector) -> np.ndarray | None:
    if not vector or any(x is None for x in vector):
        return None
    v = np.array(vector, np.float64)
    return v if np.isfinite(v).all() and v.any() else None


def _links(ids: list, vectors: list[bytes], side: np.ndarray, weight: np.ndarray, cell: int, table: int,
           settings: tuple, threshold: float):
    """Links that this cell is the first to find: (node, count) and ties that connect the same nodes, for one pair of blocks."""
    unit = unit_rows(np.frombuffer(b"".join(vectors), np.float64).reshape(len(ids), -1))
    n = len(ids)
    mixed = side.min() != side.max()
    hits = []
    for at in range(0, n, 512):
        close = unit[at : at + 512] @ unit.T >= threshold
        i, j = np.nonzero(close)
        i += at
        keep = i < j
        if mixed:
            keep &= side[i] != side[j]
        hits.append((i[keep], j[keep]))
    i, j = (np.concatenate(x) for x in zip(*hits))
    if not len(i):
        return None
    lat = lattice(unit.shape[1], *settings)
    for t in range(table + 1):
        cells = lat.cells(unit, t)
        one = (cells[i, :1] == cells[j]).any(axis=1)  # j reaches the cell of i
        if t < table:
            other = (cells[j, :1] == cells[i]).any(axis=1)
            keep = ~(one | other)
        else:
            # here: in the cell of i if j reaches it, else in the cell of j
            keep = np.where(one, cells[i, 0] == cell, cells[j, 0] == cell)
        i, j = i[keep], j[keep]
        if not len(i):
            return None
    count = np.bincount(i, weight[j], n) + np.bincount(j, weight[i], n)
    root = np.arange(n)
    while True:
        least = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if (new == root).all():
            break
        root = new
    edges = [(ids[k], ids[root[k]]) for k in np.flatnonzero(root != np.arange(n))]
    touched = np.flatnonzero(count)
    return [ids[k] for k in touched], count[touched].astype(np.int64).tolist(), edges


def linked(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    threshold: float = 0.93, tables: int = 10, probes: int = 4, scale: float = 1.5, seed: int = 11,
) -> DataFrame:
    """Number of links, component and whether it is kept, for every row."""
    settings = (tables, probes, scale, seed)
    rows = df.select(
        F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"),
        F.col(label_col).cast("string").alias("label"),
    )
    schema = pa.schema([("vec_id", pa.int64()), ("node", pa.string()), ("label", pa.string()), ("vector", pa.binary())])

    def read(batches):
        for b in batches:
            node, data = [], []
            for vector, label in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                v = usable(vector) if label is not None else None
                raw = None if v is None else (v + 0.0).tobytes()  # -0 is 0
                data.append(raw)
                # The key is a digest of the whole label, so that equal vectors of other labels are other nodes.
                node.append(None if v is None else hashlib.blake2b(
                    raw, digest_size=16, key=hashlib.blake2b(label.encode()).digest()
                ).hexdigest())
            yield batch(schema, b.column(0), node, b.column(2), data)

    parsed = materialise(rows.mapInArrow(read, "vec_id bigint, node string, label string, vector binary"), "vectors")
    nodes = materialise(
        parsed.filter("node is not null").groupBy("node").agg(
            F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("weight"),
            F.first("label").alias("label"), F.first("vector").alias("vector"),
        ), "nodes",
    )
    members = pa.schema([("bucket", pa.int64()), ("tab", pa.int32()), ("node", pa.string()), ("home", pa.bool_()), ("part", pa.string())])

    def assign(batches):
        for b in batches:
            ids, data = b.column(0).to_pylist(), [x.as_py() for x in b.column(1)]
            parts = [f"{len(x) // 8}/{label}" for x, label in zip(data, b.column(2).to_pylist())]
            for size in {len(x) for x in data}:
                at = [k for k, x in enumerate(data) if len(x) == size]
                unit = unit_rows(np.frombuffer(b"".join([data[k] for k in at]), np.float64).reshape(len(at), -1))
                lat = lattice(size // 8, *settings)
                for t in range(tables):
                    cells = lat.cells(unit, t)
                    width = cells.shape[1]
                    home = np.zeros(cells.shape, bool)
                    home[:, 0] = True
                    yield batch(
                        members, cells.ravel(), np.full(cells.size, t, np.int32),
                        [ids[k] for k in at for _ in range(width)], home.ravel(), [parts[k] for k in at for _ in range(width)],
                    )

    met = materialise(nodes.select("node", "vector", "label").mapInArrow(
        assign, "bucket bigint, tab int, node string, home boolean, part string"
    ), "cells")
    crowded = met.groupBy("bucket", "tab", "part").agg(
        F.count(F.lit(1)).alias("n"), F.max("home").alias("lived")
    ).filter("n > 1 and lived").select("bucket", "tab", "part", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    work = met.drop("home").join(crowded, ["bucket", "tab", "part"]).withColumn("mine", mine).withColumn(
        "theirs", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    ).select(
        "bucket", "tab", "part", "node", F.least("mine", "theirs").alias("low"), F.greatest("mine", "theirs").alias("high"), "mine"
    )
    order = ["bucket", "tab", "part", "low", "high"]
    full = work.join(nodes.select("node", "weight", "vector"), "node").select(*order, "mine", "node", "weight", "vector")
    full = full.repartition(*order).sortWithinPartitions(*order, "node")
    found = pa.schema([("node", pa.string()), ("links", pa.int64()), ("other", pa.string())])

    def compare(batches):
        def one(rows):
            bucket, tab, _, low, high = (c[0] for c in rows[:5])
            side, ids = np.array(rows[5]), rows[6]
            if len(ids) < 2 or (low != high and side.min() == side.max()):
                return None
            return _links(ids, rows[8], side, np.array(rows[7], float), bucket, tab, settings, threshold)

        held = None
        for b in batches:
            columns = [c.to_pylist() for c in b.columns]
            if held:
                columns = [h + c for h, c in zip(held, columns)]
            keys = list(zip(*columns[:5]))
            starts = [k for k in range(len(keys)) if k == 0 or keys[k] != keys[k - 1]]
            for s, e in zip(starts, starts[1:]):
                if e - s > 1 and (got := one([c[s:e] for c in columns])):
                    yield from _shown(found, got)
            held = [c[starts[-1] :] for c in columns] if starts else None
        if held and (got := one(held)):
            yield from _shown(found, got)

    links = materialise(full.mapInArrow(compare, "node string, links bigint, other string"), "links")
    counts = links.filter("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(links.filter("other is not null").select("node", "other"))
    told = nodes.select("node", "least", "weight").join(counts, "node", "left").join(roots, "node", "left").select(
        "node", "least", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        F.coalesce("root", "node").alias("root"),
    )
    told = materialise(told, "told")
    smallest = told.groupBy("root").agg(F.min("least").alias("component_id"))
    named = told.join(smallest, "root").select("node", "n_links", "component_id")
    return parsed.select("vec_id", "node").join(named, "node", "left").select(
        F.col("vec_id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
    ).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def _shown(schema: pa.Schema, got):
    nodes, counts, edges = got
    yield batch(
        schema, nodes + [a for a, _ in edges], counts + [0] * len(edges), [None] * len(nodes) + [b for _, b in edges]
    )
