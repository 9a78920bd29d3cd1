"""Fingerprints, Jaccard join, vectors and components against brute force."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from postwarden.llm import components, jaccard, lattice, syncmers


def reachable(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        ra, rb = find(a), find(b)
        root[max(ra, rb)] = min(ra, rb)
    return {n: find(n) for n in nodes}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def hash_longs(values):
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest((v & (1 << 64) - 1).to_bytes(8, "little"), seed=h)
    return signed(h)


def brute_anchors(text):
    words = []
    for w in (text or "").replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" "):
        words += [w[i : i + syncmers.WORD] for i in range(0, len(w), syncmers.WORD)]
    h = [signed(xxhash.xxh64_intdigest(w.encode(), seed=42)) for w in words]
    found = {}
    for i in range(len(h) - 2):
        if min(h[i], h[i + 2]) <= h[i + 1]:
            found.setdefault(hash_longs(h[i : i + 3]) >> syncmers.PLACE_BITS, i)
    if 0 < len(h) < 3:
        found[hash_longs(h) >> syncmers.PLACE_BITS] = 0
    return sorted((a << syncmers.PLACE_BITS) | min(i, syncmers.LAST_PLACE) for a, i in found.items())[: syncmers.ANCHORS]


def brute_likeness(a, b):
    one = {x >> syncmers.PLACE_BITS: x & syncmers.LAST_PLACE for x in a}
    two = {x >> syncmers.PLACE_BITS: x & syncmers.LAST_PLACE for x in b}
    union = sorted({*one, *two})[: syncmers.ANCHORS]
    if not union:
        return 1.0
    shifts = [one[x] - two[x] for x in union if x in one and x in two]
    return max((sum(abs(e - d) <= syncmers.SLACK for e in shifts) for d in shifts), default=0) / len(union)


def shown(anchors):
    return "".join(f"{x & (1 << 64) - 1:016x}" for x in anchors)


def test_fingerprint_query(apply, rows):
    out = defaultdict(list)
    for r in apply("op3_closed_syncmers"):
        out[r.doc_id].append(r)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert sum(map(len, out.values())) == len(rows)
    for i, (key, text, *_) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = brute_anchors(text), brute_anchors(edited), brute_anchors(after)
        want = (len(text), hashlib.sha256(edited.encode()).hexdigest(), shown(a), shown(b), brute_likeness(a, b), brute_likeness(a, c))
        got = [(r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in out[key]]
        assert want in got


def test_fingerprints_are_native_and_empty_tables_work(crowded, none):
    df = syncmers.fingerprints(crowded)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    assert syncmers.compared_with_edited(none).count() == 0
    assert syncmers.compared_with_edited(crowded).count() == crowded.count()


@pytest.mark.parametrize("ids", [[7], [1, 5000, 5001, 1 << 40, (1 << 62) + 3, -9, -(1 << 50)], list(range(0, 9000, 3))])
def test_next_row_over_far_apart_ids(spark, ids):
    df = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string")
    rows, window = syncmers.with_next(df, "doc_id", "text")
    from pyspark.sql import functions as F

    got = {r.doc_id: r.next for r in rows.withColumn("next", F.lead("text").over(window)).filter("extra = 0").collect()}
    order = sorted(ids)
    assert got == {i: f"text {order[(k + 1) % len(order)]}" for k, i in enumerate(order)}


def sets_of(rows):
    out = {}
    for key, text, *_ in rows:
        w = (text or "").encode().lower().split()
        out.setdefault(key, {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def brute_join(rows):
    sets = sets_of(rows)
    keys = [k for k in sets if k is not None and sets[k]]
    links = [
        (a, b) for i, a in enumerate(keys) for b in keys[i + 1 :]
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    return sets, reachable([k for k in sets if k is not None], links)


def test_jaccard_query(apply, rows):
    sets, root = brute_join(rows)
    out = apply("op9_jaccard_join")
    assert len(out) == len(rows)
    for r in out:
        assert r.n_shingles == len(sets[r.doc_id]) and r.component_id == root.get(r.doc_id)


def test_jaccard_with_chains_groups_and_common_passages(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(4000)]
    passages = [" ".join(rng.choices(words, k=40)) for _ in range(3)]
    rows = []
    for i in range(250):
        base = " ".join(rng.choices(words, k=rng.choice([3, 8, 30, 60])))
        rows.append((i, f"{passages[i % 3]} {base}" if i % 2 else base))
    seed = rng.choices(words, k=60)
    for i in range(150):  # each differs a little from the one before, so that ends are far apart
        seed = list(seed)
        seed[rng.randrange(60)] = rng.choice(words)
        rows.append((1000 + i, " ".join(seed)))
    for i in range(200):  # many near copies of one text
        copy = list(seed)
        copy[i % 60] = f"own{i}"
        rows.append((2000 + i, " ".join(copy)))
    sets, root = brute_join(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.joined(df).collect()}
    assert got == {k: (len(sets[k]), root[k]) for k in sets}


def test_prefixes_are_enough():
    """Partners share at least the smaller number asked for, whatever the sketch says."""
    rng = np.random.default_rng(4)
    for _ in range(300):
        level = rng.integers(0, 14, jaccard.SKETCH).astype(np.uint8) * rng.integers(0, 2)
        common = rng.integers(1, 1 << 62, rng.integers(3, 60)).astype(np.uint64)
        x, y = (np.unique(np.append(common, rng.integers(1, 1 << 62, rng.integers(0, 1 + len(common) // 5)).astype(np.uint64))) for _ in "xy")
        same = len(np.intersect1d(x, y))
        if 100 * same < 75 * (len(x) + len(y) - same):
            continue
        (px, mx, lx), (py, my, ly) = (jaccard.prefix(s, level, (75, 100)) for s in (x, y))
        both = np.intersect1d(x[px], y[py])
        assert len(both) >= min(mx, my)
        if lx != ly:
            first, size = (px, x) if lx < ly else (py, y)
            assert same <= len(size) - len(first) + len(both)


def test_jaccard_on_odd_tables(crowded, none, rows):
    assert jaccard.joined(none).count() == 0
    assert jaccard.joined(crowded).count() == len(rows)


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 480)] + [(500, i) for i in range(501, 560)]
    root = reachable({x for e in links for x in e}, links)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "x long, y long")).collect()}
    assert got == {n: r for n, r in root.items() if n != r}
    assert components.components(spark.createDataFrame([], "x long, y long")).count() == 0


def test_nearest_lattice_point():
    rng, roots = np.random.default_rng(0), lattice.e8_roots()
    y = rng.normal(0, 3, (300, 8))
    point = lattice.nearest_e8(y)
    assert ((2 * point) % 2 == (2 * point[:, :1]) % 2).all() and (point.sum(axis=1) % 2 == 0).all()
    own = ((y - point) ** 2).sum(axis=1)
    assert (own[:, None] <= ((y[:, None] - point[:, None] - roots) ** 2).sum(axis=2) + 1e-9).all()
    assert len(np.unique(roots, axis=0)) == 240 and np.allclose((roots**2).sum(axis=1), 2)


def vector_rows():
    rng = np.random.default_rng(8)
    rows = []
    for i in range(60):
        base = rng.standard_normal(16)
        for k in range(rng.integers(1, 5)):
            v = base + rng.normal(0, rng.choice([0, 0.05, 0.15]), 16)
            rows.append((len(rows), [float(np.float32(x)) for x in v], int(i % 3)))
    common = rows[0][1]
    rows += [(1000 + i, [x * (1 + i % 2) for x in common], 0) for i in range(40)]
    rows += [
        (2000, None, 0), (2001, [], 0), (2002, [0.0] * 16, 0), (2003, [float("nan")] * 16, 0), (2004, [1.0, None], 0),
        (2005, common, None), (2006, common, 1), (2007, common[:8], 0), (2008, [float("inf")] * 16, 0), (2009, [1e30, *[0.0] * 15], 2),
        (2010, [1.0, *[0.0] * 15], 2),
    ]
    return rows


def test_lattice_links(spark):
    rows = vector_rows()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")

    def usable(v):
        return v and all(x is not None and math.isfinite(np.float32(x)) for x in v) and any(v)

    links = []
    good = [(i, np.array(v, np.float32).astype(float), c) for i, v, c in rows if c is not None and usable(v)]
    for k, (i, v, c) in enumerate(good):
        for j, u, d in good[k + 1 :]:
            if c == d and len(u) == len(v) and u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= 0.93:
                links.append((i, j))
    root = reachable([r[0] for r in rows], links)
    degree = defaultdict(int)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    out = lattice.linked(df).collect()
    assert len(out) == len(rows)
    found = sum(r.n_links for r in out)
    assert found >= 0.9 * 2 * len(links) and all(r.n_links <= degree[r.vec_id] for r in out)
    if found == 2 * len(links):
        assert {r.vec_id: r.component_id for r in out} == root
    assert all(r.kept == (r.vec_id == r.component_id) for r in out)


def test_crowded_cells_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.standard_normal(16)
    rows = [(i, (base + rng.normal(0, 0.01, 16)).tolist(), 1) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    monkeypatch.setattr(lattice, "BLOCK", 32)
    out = lattice.linked(df).collect()
    assert all((r.n_links, r.component_id) == (119, 0) for r in out)


def test_lattice_on_odd_tables(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert lattice.linked(df).count() == 0
    twice = spark.createDataFrame([(1, [1.0, 0.0], 1, "x"), (1, [0.0, 1.0], 1, "x"), (None, [1.0, 0.0], 1, "x")], "vec_id long, embedding array<float>, label int, node string")
    assert sorted((r.vec_id or 0, r.n_links, r.component_id) for r in lattice.linked(twice).collect()) == [(0, 1, 1), (1, 0, 1), (1, 1, 1)]


def test_lattice_tells_long_labels_apart(spark):
    long = "l" * 70
    rows = [(1, [1.0, 0.0], long + "a"), (2, [1.0, 0.0], long + "b"), (3, [1.0, 0.01], long + "a")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in lattice.linked(df).collect())
    assert got == [(1, 1, 1), (2, 0, 2), (3, 1, 1)]


@pytest.mark.parametrize("cosine", [0.932, 0.94, 0.95])
def test_lattice_finds_planted_pairs(spark, cosine):
    """Pairs just above the threshold, in 64 dimensions among unrelated vectors."""
    rng = np.random.default_rng(3)
    rows, pairs = [], 60
    for i in range(pairs):
        a, b = rng.normal(size=(2, 64))
        a /= np.linalg.norm(a)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        rows += [(2 * i, a.tolist(), 1), (2 * i + 1, (cosine * a + np.sqrt(1 - cosine**2) * b).tolist(), 1)]
    rows += [(1000 + i, rng.normal(size=64).tolist(), 1) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    linked = {r.vec_id: (r.n_links, r.component_id) for r in lattice.linked(df).collect()}
    assert sum(linked[2 * i + 1] == (1, 2 * i) for i in range(pairs)) >= 0.95 * pairs


def test_bitmaps_never_understate_what_sets_share():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (1, 5, 30, 40, 300, 400, 3000, 20_000)]
    sets += [np.unique(np.concatenate([a[: len(a) * 3 // 4], rng.integers(0, 1 << 63, len(a) // 4 + 1).astype(np.uint64)])) for a in sets]
    n = np.array([len(a) for a in sets])
    bits = jaccard.Bitmaps([jaccard.bitmap_of(a) for a in sets])
    for i, a in enumerate(sets):
        others = np.arange(len(sets))
        most = bits.most_shared(i, others, n)
        true = np.array([len(np.intersect1d(a, b)) for b in sets])
        assert (most >= true).all() and most[i] == n[i]
    # Unlike sets of one size are told apart, an unknown bitmap spares nothing.
    assert bits.most_shared(4, np.array([5]), n)[0] < 0.75 * n[4]
    unknown = jaccard.Bitmaps([None, jaccard.bitmap_of(sets[4])])
    assert unknown.most_shared(0, np.array([1]), n[[4, 4]])[0] == unknown.most_shared(1, np.array([0]), n[[4, 4]])[0] == n[4]


def test_shingles_of_one_component_are_dealt_out(spark):
    from pyspark.sql import functions as F

    tokens = spark.range(2000).withColumn("top_blocks", F.expr("if(id < 1000, 1, 20)"))
    counts = tokens.groupBy("top_blocks", jaccard.slice_of("id", "top_blocks").alias("slice")).count().collect()
    for blocks, most in ((1, 200), (20, 25)):
        assert max(r["count"] for r in counts if r.top_blocks == blocks) < most


def test_pairs_are_counted_where_they_meet(spark):
    """Thirty unlinked sets that share forty shingles: a row for each pair, not for each shingle or slice of shingles."""
    ids, tokens = range(30), range(0, 1 << 40, (1 << 40) // 40)
    entries = spark.createDataFrame(
        [(t, i, 100, 8, 7) for t in list(tokens)[:40] for i in ids], "token long, id long, n int, m int, last long"
    )
    member = spark.createDataFrame([(i, i, i) for i in ids], "id long, node long, part long")
    bitmaps = spark.createDataFrame([(i, None) for i in ids], "id long, bits binary")
    made = jaccard._met(entries, member, bitmaps, (75, 100)).collect()
    assert sorted((r.x, r.y, r.m, r.c) for r in made) == [(a, b, 8, 40) for a in ids for b in ids if a < b]
    assert jaccard._pairs(entries, member, bitmaps, (75, 100)).count() == 435
