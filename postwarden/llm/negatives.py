"""Hard negatives for anchor vectors by bounds along a spanning tree of the anchors.

Vectors become integers, floor(scale * x), and scores integer inner products.  Anchors are dealt into blocks of near ones,
each with a minimum spanning tree.  The scores of the root with a slice of the rows are worked out; for every other
anchor of the tree, its parent's score (or what is known of it) plus or minus the length of the edge times the row's length
bounds the score with that row.  Only rows whose bounds reach into what is asked for are scored again:

* positives: the bounds alone tell a score that enough rows of the label reach, and rows that can't are left out;
* negatives: the windows of the anchor's positives, shortened likewise by what rows surely in the window reach.

A unit of work is one slice of the rows and one group of anchor blocks, both of bounded size, so all anchors meet all rows in
blocks and no label, vector or anchor is gathered in one place.  Each unit hands on the few best rows of an anchor.

Rows with a null label or vector, or with a null or non-finite component, take no part.  Rows that repeat id, label and vector
count once; other rows that share an id are rows of their own, and an anchor's other rows are those of other ids.  Null ids come
after others of the same score.  Vectors of different length are compared as if zeros followed.  Only the named columns are
read.  Scores have to fit 64 bits: larger vectors end in an ArithmeticError.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postwarden.llm.common import batch
from postwarden.session import materialise

#: Numbers in a slice of the rows, and in a group of anchors.
SLICE_VALUES = 1 << 19
#: Anchors in a block, about.
BLOCK = 256
#: Centres that anchors are dealt to, and anchors that they are taken from.
CENTRES, CENTRE_SAMPLE = 256, 4096
_EXACT = float(1 << 53)


def whole(vector, scale: int) -> np.ndarray | None:
    """floor(scale * x) of each component, or None if one is null or not finite."""
    if vector is None or any(x is None for x in vector):
        return None
    v = np.floor(np.asarray(vector, np.float64) * scale)
    if not np.isfinite(np.asarray(vector, np.float64)).all():
        return None
    if len(v) and np.abs(v).max() >= 2.0**62:
        raise ArithmeticError("a component is too large for integer scores")
    return v.astype(np.int64)


def matrix(vectors: list[bytes], width: int) -> np.ndarray:
    """Integer rows, with zeros after the shorter ones."""
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v) // 8] = np.frombuffer(v, np.int64)
    return out


def spanning_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A minimum spanning tree of the rows: visiting order, parents (as places in that order) and edge lengths.

    The root is the row nearest to the mean; parents come before their children.
    """
    n = len(points)
    p = points.astype(np.float64)
    left = np.ones(n, bool)
    at = int(np.argmin(((p - p.mean(axis=0)) ** 2).sum(axis=1)))
    near, by = np.full(n, np.inf), np.full(n, -1)
    order, parent, edge = [], [], []
    place = np.zeros(n, int)
    while True:
        place[at] = len(order)
        parent.append(-1 if by[at] < 0 else place[by[at]])
        edge.append(0.0 if by[at] < 0 else math.sqrt(near[at]))
        order.append(at)
        left[at] = False
        if len(order) == n:
            return np.array(order), np.array(parent), np.array(edge)
        square = ((p - p[at]) ** 2).sum(axis=1)
        closer = left & (square < near)
        near[closer], by[closer] = square[closer], at
        at = int(np.argmin(np.where(left, near, np.inf)))


class Rows:
    """Some rows to be scored: ids (with those that are null), labels, integer vectors and their lengths."""

    def __init__(self, ids, missing, labels, vectors: np.ndarray):
        self.ids, self.missing, self.labels = ids, missing, labels
        self.lengths = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
        self.longest = float(self.lengths.max(initial=0.0))
        self.vectors, self.real = vectors, vectors.astype(np.float64)

    def scores(self, anchor: np.ndarray, length: float, at=None) -> np.ndarray:
        """Exact scores with one anchor, of all rows or of those at ``at``."""
        if length * self.longest < _EXACT:  # every partial sum is a whole number that a double holds
            real = self.real if at is None else self.real[at]
            return np.rint(real @ anchor.astype(np.float64)).astype(np.int64)
        if length * self.longest >= 2.0**63:
            raise ArithmeticError("scores don't fit 64 bits")
        return (self.vectors if at is None else self.vectors[at]) @ anchor


def along_tree(anchors: np.ndarray, parent: np.ndarray, edge: np.ndarray, rows: Rows, asked, take) -> int:
    """Scores rows with each anchor where the bounds from its parent ask for it; gives the number of scores worked out.

    ``asked(i, low, high)`` tells which rows anchor i needs, ``take(i, at, scores)`` gets them.
    """
    n = len(rows.ids)
    lengths = np.sqrt((anchors.astype(np.float64) ** 2).sum(axis=1))
    children = np.bincount(parent[parent >= 0], minlength=len(anchors))
    bounds: dict[int, tuple] = {}
    worked = 0
    for i in range(len(anchors)):
        if parent[i] < 0:
            scores = rows.scores(anchors[i], lengths[i])
            low = high = scores.astype(np.float64)
            at = np.flatnonzero(asked(i, low, high))
            take(i, at, scores[at])
            worked += n
        else:
            up = int(parent[i])
            slack = edge[i] * rows.lengths * (1 + 1e-9) + 1 + 1e-12 * lengths[i] * rows.longest
            low, high = bounds[up][0] - slack, bounds[up][1] + slack
            children[up] -= 1
            if not children[up]:
                del bounds[up]
            at = np.flatnonzero(asked(i, low, high))
            scores = rows.scores(anchors[i], lengths[i], None if 2 * len(at) > n else at)
            scores = scores[at] if 2 * len(at) > n else scores
            take(i, at, scores)
            worked += len(at)
            if children[i]:
                low[at] = high[at] = scores
        if children[i]:
            bounds[i] = (low, high)
    return worked


def at_least(low: np.ndarray, k: int) -> float:
    """A score that k of the rows with these lower bounds reach."""
    return float(np.partition(low, len(low) - k)[len(low) - k]) if len(low) >= k else -np.inf


def first(scores, ids, missing, k: int) -> np.ndarray:
    """Places of the first k rows: highest score, then smallest id, null ids last."""
    if len(scores) > 4 * k:
        few = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return few[np.lexsort((ids[few], missing[few], -scores[few]))[:k]]
    return np.lexsort((ids, missing, -scores))[:k]


def best_positives(anchors, parent, edge, own, rows: Rows, k: int):
    """Per anchor, the places and scores of its best k rows of the same label and another id.  own: (id, missing, label)."""
    out: dict[int, tuple] = {}

    def others(i):
        same = rows.labels == own[i][2]
        return same & ((rows.ids != own[i][0]) | (rows.missing != own[i][1]))

    def asked(i, low, high):
        mine = others(i)
        return mine & (high >= at_least(low[mine], k))

    def take(i, at, scores):
        keep = first(scores, rows.ids[at], rows.missing[at], k)
        out[i] = (at[keep], scores[keep])

    along_tree(anchors, parent, edge, rows, asked, take)
    return out


def window(score: int, low: int, high: int) -> tuple[int, int]:
    """Scores n with low * score <= 100 * n <= high * score."""
    return -((-low * score) // 100), (high * score) // 100


def best_negatives(anchors, parent, edge, own, windows, rows: Rows, k: int):
    """Per (anchor, window), the places and scores of the best k rows of other labels in the window."""
    out: dict[tuple[int, int], tuple] = {}

    def asked(i, low, high):
        wanted = np.zeros(len(rows.ids), bool)
        if not windows[i]:
            return wanted
        other = rows.labels != own[i][2]
        for least, most in windows[i]:
            reached = at_least(low[other & (low >= least) & (high <= most)], k)
            wanted |= (high >= max(least, reached)) & (low <= most)
        return wanted & other

    def take(i, at, scores):
        for w, (least, most) in enumerate(windows[i]):
            inside = np.flatnonzero((scores >= least) & (scores <= most))
            keep = inside[first(scores[inside], rows.ids[at[inside]], rows.missing[at[inside]], k)]
            if len(keep):
                out[i, w] = (at[keep], scores[keep])

    along_tree(anchors, parent, edge, rows, asked, take)
    return out


_PARSED = "key string, id bigint, label string, anchor boolean, width int, vector binary"
_PARSED_ARROW = pa.schema([
    ("key", pa.string()), ("id", pa.int64()), ("label", pa.string()), ("anchor", pa.bool_()), ("width", pa.int32()),
    ("vector", pa.binary()),
])


def _parsed(df: DataFrame, scale: int) -> DataFrame:
    """Usable rows (id, label, anchor, vector) with a key of their own, each once."""

    def parse(batches):
        for b in batches:
            rows = []
            for id_, label, anchor, vector in zip(*(c.to_pylist() for c in b.columns)):
                v = whole(vector, scale) if label is not None else None
                if v is not None:
                    raw = v.tobytes()
                    name = hashlib.blake2b(raw, digest_size=16)
                    name.update(f"|{id_}|{label}".encode())
                    rows.append((name.hexdigest(), id_, label, bool(anchor), len(v), raw))
            yield batch(_PARSED_ARROW, *(zip(*rows) if rows else [[]] * 6))

    return df.mapInArrow(parse, _PARSED).dropDuplicates(["key"])


def _centres(anchors: DataFrame, count: int, width: int) -> np.ndarray:
    """Centres that near anchors share, from a bounded sample (a few rounds of k-means)."""
    wanted = min(CENTRES, -(-count // BLOCK))
    most = min(CENTRE_SAMPLE, max(wanted, SLICE_VALUES // max(width, 1)))
    unit = F.pmod(F.xxhash64("key"), F.lit(1 << 20)) / float(1 << 20)
    some = anchors.filter(unit < min(1.0, most / count)).select("key", "vector").collect()
    points = matrix([bytes(r["vector"]) for r in sorted(some, key=lambda r: r["key"])], width).astype(np.float64)
    if len(points) <= wanted:
        return points if len(points) else np.zeros((1, width))
    centres = points[np.random.default_rng(7).choice(len(points), wanted, replace=False)]
    for _ in range(8):
        home = np.argmin((centres**2).sum(axis=1) - 2 * points @ centres.T, axis=1)
        for c in range(wanted):
            if (home == c).any():
                centres[c] = points[home == c].mean(axis=0)
    return centres


_TREE = "block string, place int, parent int, edge double, key string, id bigint, label string, vector binary"


def _trees(anchors: DataFrame, count: int, width: int) -> DataFrame:
    """The anchors in blocks, each in the order of its spanning tree."""
    shared = anchors.sparkSession.sparkContext.broadcast(_centres(anchors, count, width))
    schema = pa.schema([
        ("cell", pa.int32()), ("key", pa.string()), ("id", pa.int64()), ("label", pa.string()), ("vector", pa.binary()),
    ])

    def home(batches):
        centres = shared.value
        offset = (centres**2).sum(axis=1)
        for b in batches:
            points = matrix([x.as_py() for x in b.column(3)], width).astype(np.float64)
            yield batch(schema, np.argmin(offset - 2 * points @ centres.T, axis=1).astype(np.int32), *b.columns)

    def tree(table: pa.Table) -> pa.Table:
        table = table.sort_by("key")
        points = matrix([x.as_py() for x in table.column("vector")], width)
        order, parent, edge = spanning_tree(points)
        table = table.take(pa.array(order))
        return pa.table([
            table.column("block"), pa.array(np.arange(len(order)), pa.int32()), pa.array(parent, pa.int32()), pa.array(edge),
            *(table.column(c) for c in ("key", "id", "label", "vector")),
        ], names=["block", "place", "parent", "edge", "key", "id", "label", "vector"])

    celled = anchors.select("key", "id", "label", "vector").mapInArrow(
        home, "cell int, key string, id bigint, label string, vector binary"
    )
    celled = materialise(celled, "anchor-cells")
    parts = celled.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    block = F.concat_ws("/", "cell", F.pmod(F.xxhash64("key"), F.col("parts")))
    blocked = celled.join(F.broadcast(parts), "cell").select(block.alias("block"), "key", "id", "label", "vector")
    return blocked.groupBy("block").applyInArrow(lambda t: tree(t), _TREE)


def _column(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """An id column's values and which are null."""
    c = table.column(name).combine_chunks()
    return c.fill_null(0).to_numpy(), c.is_null().to_numpy(zero_copy_only=False)


def _blocks(left: pa.Table, right: pa.Table, width: int):
    """The rows of a slice, and each block of anchors in a group: its table, vectors, parents, edges and own values."""
    ids, missing = _column(left, "id")
    rows = Rows(
        ids, missing, np.array(left.column("label").to_pylist(), object), matrix([x.as_py() for x in left.column("vector")], width)
    )
    right = right.sort_by([("block", "ascending"), ("place", "ascending")])
    starts = [i for i, p in enumerate(right.column("place").to_pylist()) if p == 0]
    for s, e in zip(starts, [*starts[1:], right.num_rows]):
        part = right.slice(s, e - s)
        own = list(zip(*_column(part, "id"), part.column("label").to_pylist()))
        yield (
            rows, part, matrix([x.as_py() for x in part.column("vector")], width), part.column("parent").to_numpy(),
            part.column("edge").to_numpy(), own,
        )


def _met(rows: DataFrame, trees: DataFrame, slices: int, groups: int, each, schema: str):
    """Applies ``each`` to every slice of the rows and group of anchor blocks."""
    rows = rows.select("key", "id", "label", "vector").withColumn(
        "slice", F.pmod(F.xxhash64("key"), F.lit(slices)).cast("int")
    ).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    trees = trees.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int")).withColumn(
        "slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))
    )
    return rows.groupBy("slice", "group").cogroup(trees.groupBy("slice", "group")).applyInArrow(each, schema)


def mined(
    df: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256,
) -> DataFrame:
    """The first negatives of every anchor and each of its positives.

    ``anchor`` is a condition on ``df``.  Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    rows = materialise(_parsed(df.select(
        F.col(id_col).cast("bigint").alias("_1"), F.col(label_col).cast("string").alias("_2"),
        F.coalesce(anchor, F.lit(False)).alias("_3"), F.col(vector_col).cast("array<double>").alias("_4"),
    ), scale), "negatives-rows")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max("width").alias("width"), F.count_if("anchor").alias("anchors")).first()
    if not size["anchors"]:
        return df.sparkSession.createDataFrame(
            [], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
        )
    width = size["width"] or 0
    most = max(1, SLICE_VALUES // max(width, 1))
    slices, groups = -(-size["n"] // most), -(-size["anchors"] // most)
    trees = materialise(_trees(rows.filter("anchor"), size["anchors"], width), "negatives-trees")
    order = [F.desc("score"), F.asc_nulls_last("other"), F.asc("row")]

    def near(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for slice_, part, anchors, parent, edge, own in _blocks(left, right, width) if left.num_rows else ():
            keys, names = part.column("key").to_pylist(), left.column("key")
            for i, (at, scores) in best_positives(anchors, parent, edge, own, slice_, positives).items():
                out += [(keys[i], names[p].as_py(), left.column("id")[p].as_py(), s) for p, s in zip(at.tolist(), scores.tolist())]
        return pa.table([pa.array(c, k) for c, k in zip(
            zip(*out) if out else [[]] * 4, (pa.string(), pa.string(), pa.int64(), pa.int64())
        )], names=["key", "row", "other", "score"])

    found = _met(rows, trees, slices, groups, lambda a, b: near(a, b), "key string, row string, other bigint, score bigint")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(*order))).filter(
        F.col("rank") <= positives
    )
    chosen = ranked.groupBy("key").agg(
        F.array_sort(F.collect_list(F.struct("rank", "other", "score"))).alias("positives")
    )
    chosen = materialise(chosen, "negatives-positives")
    asked = trees.join(chosen, "key", "left").select(
        *trees.columns, F.transform(F.coalesce("positives", F.array()), lambda x: x["score"]).alias("scores")
    )

    def hard(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for slice_, part, anchors, parent, edge, own in _blocks(left, right, width) if left.num_rows else ():
            keys, names = part.column("key").to_pylist(), left.column("key")
            windows = [[window(s, low, high) for s in scores] for scores in part.column("scores").to_pylist()]
            for (i, w), (at, scores) in best_negatives(anchors, parent, edge, own, windows, slice_, negatives).items():
                out += [
                    (keys[i], w, names[p].as_py(), left.column("id")[p].as_py(), s) for p, s in zip(at.tolist(), scores.tolist())
                ]
        return pa.table([pa.array(c, k) for c, k in zip(
            zip(*out) if out else [[]] * 5, (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64())
        )], names=["key", "w", "row", "other", "score"])

    met = _met(rows, asked, slices, groups, lambda a, b: hard(a, b), "key string, w int, row string, other bigint, score bigint")
    best = met.withColumn("rank", F.row_number().over(Window.partitionBy("key", "w").orderBy(*order))).filter(
        F.col("rank") <= negatives
    )
    ids = trees.select("key", F.col("id").alias("anchor_id"))
    return best.join(chosen, "key").join(ids, "key").select(
        "anchor_id", F.expr("positives[w].other").alias("positive_id"), "rank", F.col("other").alias("negative_id"),
        F.expr("positives[w].score").alias("positive_score"), F.col("score").alias("negative_score"),
    )
