"""Approximate nearest neighbours by a hierarchical k-means tree.

The tree is fitted on a bounded sample (``SAMPLE_VALUES`` numbers); every vector is then put into the leaf that it reaches
by the nearest centre of each level.  A query goes through the tree best bin first: a priority queue holds the nodes met so far by
their centre's inner product plus the query's length times the node's spread, and gives up leaves in that order.

How many leaves a query visits is calibrated: a bounded number of queries visits all leaves, which gives their true
neighbours and the place of each neighbour's leaf in the query's own order; visits are widened until the mean share of true
neighbours in the visited leaves reaches ``recall``.

Leaves lie in shards of bounded size (a large leaf in several), and a query travels to the shards that hold its leaves with
the list of them.  A shard that very many queries visit is copied, so that no task gets more than ``QUERIES`` of them; each
copy is paid for by that many queries.  Each shard hands on a query's best rows only.

Equal vectors are one entry of the index with the smallest ids that a result can hold (k + 1 of them, enough
when one is the query's own): scores are equal, and smaller ids come first.  Scores are sums of exact products, rounded
once, so they don't depend on where a vector lies.

Vectors that are null, empty, zero or hold null or non-finite components take no part.  Vectors of different length are
compared as if zeros followed.  Rows that repeat id and vector count once; rows that share an id with another vector are rows of
their own, as queries too, and no row of a query's id is its neighbour.  Null ids come last among equal scores and
are no queries.  Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postwarden.llm.common import batch, runs
from postwarden.session import materialise

#: Numbers in the sample that the tree is fitted on, and rows of it at most.
SAMPLE_VALUES, SAMPLE_ROWS = 1 << 21, 1 << 15
#: Children of a node, rows that a leaf should hold, leaves at most.
BRANCHING, LEAF_ROWS, LEAVES = 8, 256, 4096
#: Numbers in a shard of the index; queries that one copy of a shard serves.
SHARD_VALUES, QUERIES = 1 << 19, 1 << 16
#: Queries that calibrate the number of visits.
CALIBRATION = 128


def padded(vectors: list[bytes], width: int) -> np.ndarray:
    """Rows of doubles, with zeros after the shorter ones."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v) // 8] = np.frombuffer(v, np.float64)
    return out


def k_means(points: np.ndarray, count: int, rng, rounds: int = 10) -> np.ndarray:
    """The cluster of each point, after some rounds; clusters that stay empty are left out."""
    centres = points[rng.choice(len(points), count, replace=False)]
    for _ in range(rounds):
        home = np.argmin((centres**2).sum(axis=1) - 2 * points @ centres.T, axis=1)
        centres = np.array([points[home == c].mean(axis=0) for c in np.unique(home)])
    return np.argmin((centres**2).sum(axis=1) - 2 * points @ centres.T, axis=1)


class Tree:
    """Nodes in the order of a walk: centres, spreads, children, and the number of each leaf."""

    def __init__(self, points: np.ndarray, leaf_rows: float, branching: int = BRANCHING, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.centres, self.spreads, self.children, self.leaf = [], [], [], []
        self.leaves = 0
        self._grow(points, max(1.0, leaf_rows), branching, rng)
        self.centres = np.array(self.centres)
        self.spreads = np.array(self.spreads)

    def _grow(self, points, leaf_rows, branching, rng) -> int:
        node = len(self.children)
        centre = points.mean(axis=0) if len(points) else np.zeros(points.shape[1])
        self.centres.append(centre)
        self.spreads.append(math.sqrt(((points - centre) ** 2).sum(axis=1).mean()) if len(points) else 0.0)
        self.children.append([])
        self.leaf.append(-1)
        if len(points) > leaf_rows and len(points) > 1:
            home = k_means(points, min(branching, len(points)), rng)
            groups = [points[home == c] for c in np.unique(home)]
            if len(groups) > 1:
                self.children[node] = [self._grow(g, leaf_rows, branching, rng) for g in groups]
        if not self.children[node]:
            self.leaf[node] = self.leaves
            self.leaves += 1
        return node

    def places(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        out = np.zeros(len(points), np.int32)
        work = [(0, np.arange(len(points)))]
        while work:
            node, rows = work.pop()
            below = self.children[node]
            if not below:
                out[rows] = self.leaf[node]
            elif len(rows):
                centres = self.centres[below]
                home = np.argmin((centres**2).sum(axis=1) - 2 * points[rows] @ centres.T, axis=1)
                work += [(child, rows[home == c]) for c, child in enumerate(below)]
        return out

    def visits(self, query: np.ndarray, most: int) -> list[int]:
        """The first ``most`` leaves, best bin first."""
        hope = (self.centres @ query + math.sqrt(float(query @ query)) * self.spreads).tolist()
        queue, found = [(-hope[0], 0)], []
        while queue and len(found) < most:
            node = heapq.heappop(queue)[1]
            if self.children[node]:
                for child in self.children[node]:
                    heapq.heappush(queue, (-hope[child], child))
            else:
                found.append(self.leaf[node])
        return found


def inner_product(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of the products, rounded once."""
    return math.fsum((a * b).tolist())


def _entries(rows: DataFrame, k: int) -> DataFrame:
    """A row for each different vector: node, vector and its first k + 1 ids."""
    place = Window.partitionBy("node").orderBy(F.asc_nulls_last("vec_id"))
    first = rows.select("node", "vec_id").distinct().withColumn("rank", F.row_number().over(place)).filter(
        F.col("rank") <= k + 1
    )
    ids = first.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id"))).alias("ids"))
    vectors = rows.groupBy("node").agg(F.first("vector").alias("vector"))
    return vectors.join(ids, "node").select("node", "vector", F.transform("ids", lambda x: x["vec_id"]).alias("ids"))


def _sample(entries: DataFrame, count: int, width: int) -> np.ndarray:
    most = max(1, min(SAMPLE_ROWS, SAMPLE_VALUES // width))
    unit = F.pmod(F.xxhash64("node"), F.lit(1 << 20)) / float(1 << 20)
    some = entries.filter(unit < min(1.0, most / count)).select("node", "vector").collect()
    return padded([bytes(r["vector"]) for r in sorted(some, key=lambda r: r["node"])], width)


def _indexed(entries: DataFrame, shared, width: int) -> DataFrame:
    schema = pa.schema([("leaf", pa.int32()), ("node", pa.string()), ("vector", pa.binary()), ("ids", pa.list_(pa.int64()))])

    def put(batches):
        for b in batches:
            yield batch(schema, shared.value.places(padded([x.as_py() for x in b.column(1)], width)), *b.columns)

    return entries.select("node", "vector", "ids").mapInArrow(put, "leaf int, node string, vector binary, ids array<bigint>")


def _shards(sizes: dict[int, int], leaves: int, most: int) -> list[tuple[int, int, int]]:
    """(leaf, its first shard, in how many it lies): small neighbours share a shard, a large leaf has several."""
    out, shard, held = [], 0, 0
    for leaf in range(leaves):
        n = sizes.get(leaf, 0)
        if held and held + n > most:
            shard, held = shard + 1, 0
        pieces = max(1, -(-n // most))
        out.append((leaf, shard, pieces))
        if pieces > 1:
            shard, held = shard + pieces, 0
        else:
            held += n
    return out


def _visits(queries: DataFrame, shared, width: int, homes: dict[int, tuple[int, int]], most: int) -> DataFrame:
    """A row for each query and shard that it visits, with the leaves in the query's order and their places in it."""
    schema = pa.schema([
        ("shard", pa.int64()), ("qkey", pa.string()), ("query", pa.binary()), ("own", pa.int64()),
        ("leaves", pa.list_(pa.int32())), ("places", pa.list_(pa.int32())),
    ])
    home = queries.sparkSession.sparkContext.broadcast(homes)

    def walk(batches):
        for b in batches:
            out = []
            for key, raw, own in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                vector = raw.as_py()
                by: dict[int, tuple[list, list]] = {}
                for place, leaf in enumerate(shared.value.visits(padded([vector], width)[0], most)):
                    start, pieces = home.value[leaf]
                    for shard in range(start, start + pieces):
                        lists = by.setdefault(shard, ([], []))
                        lists[0].append(leaf)
                        lists[1].append(place)
                out += [(shard, key, vector, own, *lists) for shard, lists in by.items()]
                if len(out) >= 4096:
                    yield batch(schema, *zip(*out))
                    out = []
            if out:
                yield batch(schema, *zip(*out))

    return queries.select("qkey", "vector", "vec_id").mapInArrow(
        walk, "shard bigint, qkey string, query binary, own bigint, leaves array<int>, places array<int>"
    )


class _Shard:
    """Some entries of the index by leaf."""

    def __init__(self, leaves: np.ndarray, vectors: np.ndarray, ids: list[list]):
        order = np.argsort(leaves, kind="stable")
        self.leaves, self.vectors, self.ids = leaves[order], vectors[order], [ids[i] for i in order]
        names, starts = np.unique(self.leaves, return_index=True)
        ends = np.append(starts[1:], len(order))
        self.spans = {int(n): slice(int(s), int(e)) for n, s, e in zip(names, starts, ends)}

    def best(self, queries: np.ndarray, own: list, leaves: list[list[int]], places: list[list[int]], k: int):
        """For each query its best k rows here: (score, id, place of the leaf in its order)."""
        scores = np.full((len(queries), len(self.leaves)), -np.inf)
        asked: dict[int, list[int]] = {}
        for q, mine in enumerate(leaves):
            for leaf in mine:
                asked.setdefault(leaf, []).append(q)
        for leaf, who in asked.items():
            if span := self.spans.get(leaf):
                scores[who, span] = queries[who] @ self.vectors[span].T
        for q in range(len(queries)):
            at = np.flatnonzero(scores[q] > -np.inf)
            # The query's own entry may hold no other id, so one more than k entries may be needed.
            if len(at) > k + 1:
                worst = np.partition(scores[q][at], len(at) - k - 1)[len(at) - k - 1]
                slack = 1e-9 * (abs(worst) + math.sqrt(float(queries[q] @ queries[q])))
                at = at[scores[q][at] >= worst - slack]
            where = dict(zip(leaves[q], places[q]))
            rows = []
            for i in at.tolist():
                score, place = inner_product(queries[q], self.vectors[i]), where[int(self.leaves[i])]
                rows += [(score, x, place) for x in self.ids[i] if x is None or x != own[q]]
            rows.sort(key=lambda r: (-r[0], r[1] is None, r[1] or 0))
            yield rows[:k]


def _found(visits: DataFrame, indexed: DataFrame, shards: DataFrame, width: int, k: int) -> DataFrame:
    """The best k rows of each query in each shard that it visits."""
    # A shard is copied for each QUERIES of its queries.
    copies = materialise(
        visits.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / QUERIES).alias("copies")), "tree-copies"
    )
    keyed = indexed.join(F.broadcast(shards), "leaf").select(
        (F.col("start") + F.pmod(F.xxhash64("node"), F.col("pieces"))).alias("shard"), "leaf", "vector", "ids"
    ).join(copies, "shard").select(
        "shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)).alias("copy"), F.lit(0).cast("bigint").alias("side"),
        "leaf", "vector", "ids", F.lit(None).cast("string").alias("qkey"), F.lit(None).cast("bigint").alias("own"),
        F.lit(None).cast("array<int>").alias("leaves"), F.lit(None).cast("array<int>").alias("places"),
    )
    asked = visits.join(copies, "shard").select(
        "shard", F.pmod(F.xxhash64("qkey"), F.col("copies")).alias("copy"), F.lit(1).cast("bigint").alias("side"), F.lit(-1).alias("leaf"),
        F.col("query").alias("vector"), F.lit(None).cast("array<bigint>").alias("ids"), "qkey", "own", "leaves", "places",
    )
    both = keyed.unionByName(asked).repartition("shard", "copy").sortWithinPartitions("shard", "copy", "side")
    schema = pa.schema([("qkey", pa.string()), ("score", pa.float64()), ("vec_id", pa.int64()), ("place", pa.int32())])

    def scan(batches):
        entries, built, now = [], None, None
        for b in batches:
            names = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
            sides = b.column(2).to_pylist()
            cuts = [i for i in range(b.num_rows) if i == 0 or (names[i], sides[i]) != (names[i - 1], sides[i - 1])]
            for s, e in zip(cuts, [*cuts[1:], b.num_rows]):
                if names[s] != now:
                    entries, built, now = [], None, names[s]
                part = b.slice(s, e - s)
                if sides[s] == 0:
                    entries.append(part)
                    continue
                if built is None and entries:
                    table = pa.Table.from_batches(entries)
                    built = _Shard(
                        table.column("leaf").to_numpy(), padded([x.as_py() for x in table.column("vector")], width),
                        table.column("ids").to_pylist(),
                    )
                    entries = []
                for at in range(0, part.num_rows if built else 0, 128):
                    some = part.slice(at, 128)
                    rows, keys = [], some.column(6).to_pylist()
                    best = built.best(
                        padded([x.as_py() for x in some.column(4)], width), some.column(7).to_pylist(),
                        some.column(8).to_pylist(), some.column(9).to_pylist(), k,
                    )
                    for key, found in zip(keys, best):
                        rows += [(key, *r) for r in found]
                    if rows:
                        yield batch(schema, *zip(*rows))

    order = Window.partitionBy("qkey").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return both.mapInArrow(scan, "qkey string, score double, vec_id bigint, place int").withColumn(
        "rank", F.row_number().over(order)
    ).filter(F.col("rank") <= k)


def _calibrated(places: dict[str, list[int]], leaves: int, recall: float) -> int:
    """The fewest visits at which queries find this share of their true neighbours on average."""
    for most in range(1, leaves):
        shares = [sum(p < most for p in mine) / len(mine) for mine in places.values()]
        if sum(shares) >= recall * len(shares):
            return most
    return leaves


def nearest(
    df: DataFrame, query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, recall: float = 0.95,
    visits: int | None = None,
) -> DataFrame:
    """The k nearest rows found of each row that fulfils ``query``: query_id, rank, vec_id, score.

    ``visits`` sets the number of leaves that a query visits instead of calibrating it.
    """
    spark = df.sparkSession
    schema = pa.schema([
        ("node", pa.string()), ("vec_id", pa.int64()), ("asks", pa.bool_()), ("width", pa.int32()), ("vector", pa.binary()),
    ])

    def parse(batches):
        for b in batches:
            rows = []
            for id_, asks, vector in zip(*(c.to_pylist() for c in b.columns)):
                if vector is None or any(x is None for x in vector):
                    continue
                v = np.asarray(vector, np.float64)
                if not np.isfinite(v).all() or not v.any():
                    continue
                v = v[: np.flatnonzero(v)[-1] + 1] + 0.0  # zeros at the end change nothing, and -0 is 0
                raw = v.tobytes()
                rows.append((hashlib.blake2b(raw, digest_size=16).hexdigest(), id_, bool(asks), len(v), raw))
            yield batch(schema, *(zip(*rows) if rows else [[]] * 5))

    rows = df.select(
        F.col(id_col).cast("bigint").alias("_1"), F.coalesce(query, F.lit(False)).alias("_2"),
        F.col(vector_col).cast("array<double>").alias("_3"),
    ).mapInArrow(parse, "node string, vec_id bigint, asks boolean, width int, vector binary")
    rows = materialise(rows, "tree-rows")
    entries = materialise(_entries(rows, k), "tree-entries")
    size = rows.agg(F.count_distinct("node").alias("n"), F.max("width").alias("width")).first()
    if not size["n"]:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    count, width = size["n"], size["width"]
    points = _sample(entries, count, width)
    leaves = max(1, min(LEAVES, count // LEAF_ROWS, len(points) // 4))
    tree = Tree(points if len(points) else np.zeros((0, width)), len(points) / leaves)
    shared = spark.sparkContext.broadcast(tree)
    indexed = materialise(_indexed(entries, shared, width), "tree-index")
    sizes = {r["leaf"]: r["count"] for r in indexed.groupBy("leaf").count().collect()}
    homes = _shards(sizes, tree.leaves, max(1, SHARD_VALUES // width))
    shards = spark.createDataFrame(homes, "leaf int, start bigint, pieces bigint")
    by_leaf = {leaf: (start, pieces) for leaf, start, pieces in homes}
    queries = rows.filter("asks and vec_id is not null").select(
        F.concat_ws(":", "vec_id", "node").alias("qkey"), "vec_id", "vector"
    ).dropDuplicates(["qkey"])
    queries = materialise(queries, "tree-queries")
    if visits is None:
        total = queries.count()
        unit = F.pmod(F.xxhash64("qkey"), F.lit(1 << 30)) / float(1 << 30)
        some = queries.filter(unit < min(1.0, CALIBRATION / max(total, 1)))
        true = _found(materialise(_visits(some, shared, width, by_leaf, tree.leaves), "tree-probes"), indexed, shards, width, k)
        places: dict[str, list[int]] = {}
        for r in true.select("qkey", "place").collect():
            places.setdefault(r["qkey"], []).append(r["place"])
        visits = _calibrated(places, tree.leaves, recall)
    walked = materialise(_visits(queries, shared, width, by_leaf, visits), "tree-visits")
    return _found(walked, indexed, shards, width, k).select(
        F.split_part("qkey", F.lit(":"), F.lit(1)).cast("bigint").alias("query_id"), "rank", "vec_id", "score"
    )
