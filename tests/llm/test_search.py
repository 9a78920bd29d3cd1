"""Ranked lexical search, hard negatives and nearest vectors against brute force."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postwarden.llm import kmeanstree, lexical, negatives

ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())])
VECTORS = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("label", T.IntegerType()),
])
TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    lower = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    return TERM.findall((text or "").translate(lower))


@pytest.mark.parametrize("text", [None, "", "A-b_C1\x7f\x00É日本 x́y", "İ ß ÀÉ aZ09@[`{", " \t\n", "x" * 9000])
def test_terms(text):
    assert [t.decode() for t in lexical.terms_of(text.encode() if text is not None else None)] == terms(text)


def brute_search(docs, items, k):
    """docs: (id, text), items: (id, text); every row of docs is a document."""
    held = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, n_words = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in set(items):
        asked = Counter(terms(text))
        scores = []
        for doc, c in held:
            m = 25 + (75 * sum(c.values()) * n_docs) // n_words
            score = sum(
                times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
                for t, times in asked.items() if c[t]
            )
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        out += [(item, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def item_rows(rows):
    rng = random.Random(3)
    long = [t for _, t, *_ in rows if t and len(t) > 60]
    items = [(i, " ".join(rng.choice(long).split()[:12])) for i in range(12)]
    return items + [(12, None), (13, ""), (14, "nothing like it"), (15, "one"), (15, "ka ka lo"), (None, "mi ter"), items[0],
                    (16, " ".join(long)), (17, "日本語 one")]


@pytest.mark.parametrize("item_terms", [1_000_000, 60])
def test_search_equals_brute_force(spark, rows, crowded, item_terms):
    items = item_rows(rows)
    asked = spark.createDataFrame(items, ITEMS).withColumn("doc_id", F.lit(1)).withColumn("terms", F.lit("x"))
    found = lexical.ranked(crowded, asked, item_terms=item_terms).collect()
    assert sorted(map(tuple, found), key=str) == brute_search([(r[0], r[1]) for r in rows], items, 10)


def test_search_ties_and_copies(spark):
    docs = [(i % 40, "same words here") for i in range(90)] + [(None, "same words here")] * 3 + [(500, "other text words")]
    items = [(1, "same here"), (2, "words"), (3, "absent")]
    found = lexical.ranked(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(7), spark.createDataFrame(items, ITEMS), k=45
    ).collect()
    assert sorted(map(tuple, found), key=str) == brute_search(docs, items, 45)


def test_search_of_nothing(spark, docs, none):
    items = spark.createDataFrame([(1, "one ka")], ITEMS)
    for d, i in ((none, items), (docs, items.limit(0)), (none, items.limit(0)), (docs, items.withColumn("text", F.lit(None)))):
        out = lexical.ranked(d, i)
        assert out.columns == ["item_id", "rank", "doc_id", "score"] and out.count() == 0


def test_bounds_leave_out_documents_but_no_result():
    """Blocks of short vectors are left out whole, and few pairs are scored whole."""
    rng = np.random.default_rng(2)
    queries = [
        lexical._Query(rng.choice(300, 12, replace=False).astype(np.int32), rng.integers(1, 9000, 12)) for _ in range(5)
    ]
    impacts = [np.sort(rng.choice(300, rng.integers(1, 60), replace=False)) for _ in range(3000)]
    values = [rng.integers(1, 1_000_000, len(t)) // rng.choice([1, 50]) for t in impacts]
    lengths = np.array([math.sqrt((v.astype(float) ** 2).sum()) for v in values])
    order = np.argsort(-lengths)
    found, scored = [lexical._Found(0) for _ in queries], 0
    for at in range(0, 3000, 100):
        some = order[at : at + 100]
        starts = np.cumsum([0, *(len(impacts[i]) for i in some)])
        scored += lexical.search_block(
            queries, found, some, np.zeros(100, bool), lengths[some], starts, np.concatenate([impacts[i] for i in some]),
            np.concatenate([values[i] for i in some]), 10,
        )
    for query, known in zip(queries, found):
        weight = dict(zip(query.terms.tolist(), query.weights.tolist()))
        true = sorted(
            (-sum(weight.get(t, 0) * v for t, v in zip(impacts[i].tolist(), values[i].tolist())), i) for i in range(3000)
        )[:10]
        assert [(-s, i) for s, i in zip(*known.rows[:2])] == true
    assert scored < 0.5 * 3000 * len(queries)


def vector_rows(n=260, dims=12, near=True):
    rng = np.random.default_rng(9)
    points = rng.normal(size=(n, dims))
    if near:  # groups of near vectors, of several lengths
        points = rng.normal(size=(12, dims))[rng.integers(0, 12, n)] + 0.2 * points
    points *= rng.uniform(0.2, 1.5, (n, 1))
    rows = [(i, [float(np.float32(x)) for x in p], int(rng.integers(0, 3))) for i, p in enumerate(points)]
    nan, inf = float("nan"), float("inf")
    return rows + [
        (1000, rows[0][1], rows[0][2]), (1001, rows[0][1], 2), (1020, rows[3][1], 1), rows[5], (100, rows[7][1], 1),
        (1100, None, 1), (1200, [None] * dims, 1), (1300, [nan] + [1.0] * (dims - 1), 1), (1400, [inf] * dims, 2),
        (1500, [0.0] * dims, 1), (1600, [], 0), (1700, rows[9][1], None), (None, rows[11][1], 1), (1800, rows[12][1][:5], 2),
        *[(2000 + 20 * i, rows[40][1], i % 3) for i in range(30)],
    ]


def usable(vector):
    return vector is not None and all(x is not None and math.isfinite(x) for x in vector)


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))


def key(score, other):
    return (-score, other is None, other or 0)


def brute_negatives(rows, anchor, k=5, m=10):
    kept = {(i, label, tuple(math.floor(256 * x) for x in v)) for i, v, label in rows if label is not None and usable(v)}
    out = []
    for a, label, v in kept:
        if a is None or a % anchor:
            continue
        scores = [(dot(v, w), i, other) for i, other, w in kept if i != a]
        positives = sorted((key(s, i) for s, i, other in scores if other == label))[:k]
        for p, none, i in positives:
            inside = [(s, j) for s, j, other in scores if other != label and -30 * p <= 100 * s <= -90 * p]
            out += [
                (a, None if none else i, r, None if none2 else j, -p, -s)
                for r, (s, none2, j) in enumerate(sorted(key(*x) for x in inside)[:m], 1)
            ]
    return sorted(out, key=str)


@pytest.mark.parametrize("values", [1 << 19, 600])
def test_negatives_equal_brute_force(spark, monkeypatch, values):
    monkeypatch.setattr(negatives, "SLICE_VALUES", values)
    monkeypatch.setattr(negatives, "BLOCK", 16)
    rows = vector_rows()
    df = spark.createDataFrame(rows, VECTORS).withColumn("key", F.lit("x")).withColumn("slice", F.lit("y"))
    found = negatives.mined(df, F.col("vec_id") % 5 == 0).collect()
    assert sorted(map(tuple, found), key=str) == brute_negatives(rows, 5)


def test_negatives_of_nothing(spark):
    empty = spark.createDataFrame([], VECTORS)
    alone = spark.createDataFrame([(0, [1.0, 2.0], 1), (1, [0.0, 0.0], 2), (2, None, 1)], VECTORS)
    for df in (empty, alone, alone.withColumn("label", F.lit(None).cast("int"))):
        out = negatives.mined(df, F.col("vec_id") == 0)
        assert out.count() == 0 and out.columns == [
            "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
        ]


def test_large_scores_stay_whole_and_larger_ones_are_refused(spark):
    rows = [(0, [4e6] * 3, 1), (1, [4e6 + 1] * 3, 1), (2, [3e6, 2e6, 1e6], 2), (3, [2e6 + 1] * 3, 2)]
    df = spark.createDataFrame(rows, VECTORS)
    found = negatives.mined(df, F.col("vec_id") == 0).collect()
    assert sorted(map(tuple, found), key=str) == brute_negatives([(i, np.float32(v).tolist(), n) for i, v, n in rows], 100)
    with pytest.raises(Exception, match="64 bits|too large"):
        negatives.mined(df.withColumn("embedding", F.expr("array(4e20f, 1f)")), F.col("vec_id") == 0).collect()


def test_tree_bounds_spare_scores():
    """A spanning tree is the lightest one, and near anchors spare their children most scores."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(4, 16)) * 256
    points = np.floor(centres[rng.integers(0, 4, 2000)] + rng.normal(size=(2000, 16)) * 8).astype(np.int64)
    anchors = points[:40]
    order, parent, edge = negatives.spanning_tree(anchors)
    square = ((anchors[:, None] - anchors[None]) ** 2).sum(axis=2).astype(float)
    inside, left, weight = {0}, set(range(1, 40)), 0.0
    while left:
        d, j = min((square[i, j], j) for i in inside for j in left)
        weight += math.sqrt(d)
        inside.add(j)
        left.remove(j)
    assert edge.sum() == pytest.approx(weight) and (parent[1:] < np.arange(1, 40)).all()
    rows = negatives.Rows(np.arange(2000), np.zeros(2000, bool), np.array(["a"] * 2000, object), points)
    taken = {}

    def asked(i, low, high):
        return high >= negatives.at_least(low, 10)

    worked = negatives.along_tree(anchors[order], parent, edge, rows, asked, lambda i, at, s: taken.update({i: (at, s)}))
    for i, (at, scores) in taken.items():
        true = points @ anchors[order[i]]
        assert (true[at] == scores).all() and set(np.argsort(-true, kind="stable")[:5]) <= set(at.tolist())
    assert worked < 0.7 * 40 * 2000


def brute_nearest(rows, every, k):
    kept = {(i, tuple(v)) for i, v, _ in rows if usable(v) and any(v)}
    out = {}
    for q, v in kept:
        if q is None or q % every:
            continue
        scores = sorted(key(math.fsum(x * y for x, y in zip(v, w)), i) for i, w in kept if i != q)
        out.setdefault(q, []).append([(r, None if none else i, -s) for r, (s, none, i) in enumerate(scores[:k], 1)])
    return out


def told(found):
    out = defaultdict(list)
    for r in sorted(found, key=lambda r: (r.query_id, r["rank"])):
        out[r.query_id].append((r["rank"], r.vec_id, r.score))
    return out


def small(monkeypatch):
    for name, value in {"LEAF_ROWS": 6, "SHARD_VALUES": 400, "QUERIES": 4, "SAMPLE_ROWS": 150, "BRANCHING": 3}.items():
        monkeypatch.setattr(kmeanstree, name, value)


def test_all_leaves_give_the_exact_neighbours(spark, monkeypatch):
    small(monkeypatch)
    rows = vector_rows()
    df = spark.createDataFrame(rows, VECTORS).withColumn("node", F.lit("x")).withColumn("leaf", F.lit("y")).repartition(5)
    found = kmeanstree.nearest(df, F.col("vec_id") % 20 == 0, visits=10_000).collect()
    true, got = brute_nearest(rows, 20, 20), told(found)
    assert set(got) == set(true)
    for q, lists in true.items():
        assert sorted(got[q]) == sorted(x for one in lists for x in one)


def test_calibrated_recall(spark, monkeypatch):
    small(monkeypatch)
    rows = vector_rows(1500)
    found = told(kmeanstree.nearest(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 20 == 0).collect())
    hits = total = 0
    for q, lists in brute_nearest(rows, 20, 20).items():
        for one in lists:
            hits += len(set(one) & {(r, i, s) for _, i, s in found[q] for r, j, t in one if (i, s) == (j, t)})
            total += len(one)
    assert hits >= 0.9 * total


def test_neighbours_of_few(spark):
    ask = F.col("vec_id") % 20 == 0
    assert kmeanstree.nearest(spark.createDataFrame([], VECTORS), ask).count() == 0
    assert kmeanstree.nearest(spark.createDataFrame([(0, [1.0], 1), (1, [0.0], 1), (2, None, 1)], VECTORS), ask).count() == 0
    found = kmeanstree.nearest(spark.createDataFrame([(0, [1.0], 1), (1, [2.0], 1), (20, [2.0], 1)], VECTORS), ask).collect()
    assert told(found) == {0: [(1, 1, 2.0), (2, 20, 2.0)], 20: [(1, 1, 4.0), (2, 0, 2.0)]}


def test_crowded_leaves_are_dealt_to_several_shards():
    homes = kmeanstree._shards({0: 3, 1: 4, 2: 25, 3: 1}, 5, 10)
    assert homes == [(0, 0, 1), (1, 0, 1), (2, 1, 3), (3, 4, 1), (4, 4, 1)]
