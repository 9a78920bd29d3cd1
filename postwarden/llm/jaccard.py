"""Documents whose sets of word shingles are alike, by adaptive multi-match prefixes.

Documents with equal sets are one node (their smallest id), so copies take no part in what follows.  Shingles have one
order: those of a bounded count sketch that stand out come later, the others by hash.  Of a set of n shingles whose
partners share at least o of them, the first n - o + m are a prefix, and two partners have m of them in common if each has
such a prefix.  Each document takes the m whose cost (entries of the prefix, and partners to check, estimated by the
sketch) is least: one for rare shingles, more where the prefix reaches common ones.  A pair is checked if it shares as many
prefix shingles as the smaller m of the two asks for; the check compares the whole sets exactly.  Before that, the shingles
of a prefix that no other prefix holds bound what two sets can share: of the two, the one whose prefix ends first in the
order has all its shared prefix shingles in the other's prefix, so its unmatched ones are in its own set alone.  And where many
documents meet in a shingle, a bitmap of each whole set travels with the entry: a bit of one set that the other lacks is a shingle
that they don't share.

Large groups of near copies would meet in every shingle.  So a first step ties each document to the smallest of those that
agree with it in several minima of hashes, checks that pair, and takes components.  From then on only documents of
different components are paired: a prefix shingle that occurs in one component is dropped, by its smallest and
largest component, combined before the shuffle; of the others, the rows of the largest component meet the rest in blocks.

Sets are computed from the texts for documents that have a pair to check; a bitmap of fixed size spares the others.
A shingle is the hash of its words.  A text with fewer words than a shingle is one shingle; one without words, or null,
links with nothing, and so does a null id.  Rows that share an id are one document.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postwarden.llm.common import batch, forget, group_starts, merged, runs, texts
from postwarden.llm.components import components
from postwarden.session import materialise

MINIMA = 8
#: Minima that two documents have to share for the first step.
AGREE = 4
SKETCH, BITMAP = 1 << 16, 1 << 23
#: Largest number of prefix shingles that a pair is asked to share, and the cost of a check in prefix entries.
MOST_MATCHES, CHECK_COST = 8, 4.0
BLOCK = 1024
#: Bits of a set's bitmap: four for a shingle at least, within these bounds.  Larger sets fill theirs, and are only spared less.
LEAST_BITS, MOST_BITS = 64, 1 << 14
#: Rows that meet in a shingle, up to which all their pairs are looked at in one step; beyond it bitmaps spare pairs.
FEW = 12
#: Entries of shingles with the same largest component that go to one place, and pairs that a task holds before it gives them.
SLICE_ROWS, PAIRS_HELD = 1 << 14, 1 << 18
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MINIMA = np.random.default_rng(3).integers(1, 1 << 63, MINIMA).astype(np.uint64) | np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))


def shingles(text: str, words: int) -> np.ndarray:
    """The distinct shingles of a text, sorted."""
    parts = text.encode("utf-8", "replace").lower().split()
    h = np.fromiter(map(xxhash.xxh64_intdigest, parts), np.uint64, len(parts))
    if not len(h):
        return h
    take = min(words, len(h))
    total = np.zeros(len(h) - take + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(take):
            total = total * _STEP + h[k : len(h) - take + 1 + k]
    return np.unique(_mixed(total + np.uint64(take)))


def bitmap_of(tokens: np.ndarray) -> bytes:
    """A bitmap of a set.  Its two halves laid over each other are the bitmap of half the size."""
    size = LEAST_BITS
    while size < 4 * len(tokens) and size < MOST_BITS:
        size *= 2
    seen = np.zeros(size, bool)
    seen[(tokens >> np.uint64(20) & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(seen, bitorder="little").tobytes()


class Bitmaps:
    """The bitmaps of some rows (None: unknown), for bounds on what two of the sets share."""

    def __init__(self, raw: list):
        self.words = np.array([len(x) // 8 if x else 0 for x in raw])
        self.place, self.of = np.zeros(len(raw), np.int64), {}
        for w in np.unique(self.words[self.words > 0]):
            rows = np.flatnonzero(self.words == w)
            self.place[rows] = np.arange(len(rows))
            self.of[int(w)] = np.frombuffer(b"".join([raw[i] for i in rows]), "<u8").reshape(-1, w)

    def most_shared(self, i: int, others: np.ndarray, n: np.ndarray) -> np.ndarray:
        """How many elements set i and each of the others share at most; n has the sizes of all."""
        most = np.minimum(n[i], n[others])
        for w, table in self.of.items() if self.words[i] else ():
            at = np.flatnonzero(self.words[others] == w)
            if not len(at):
                continue
            one, many = self.of[int(self.words[i])][self.place[i]], table[self.place[others[at]]]
            while len(one) > many.shape[1]:
                one = one[: len(one) // 2] | one[len(one) // 2 :]
            while many.shape[1] > len(one):
                half = many.shape[1] // 2
                many = many[:, :half] | many[:, half:]
            alone = np.bitwise_count(one & ~many).sum(axis=1).astype(np.int64)
            theirs = np.bitwise_count(many & ~one).sum(axis=1).astype(np.int64)
            most[at] = np.minimum(most[at], np.minimum(n[i] - alone, n[others[at]] - theirs))
        return most


def needed(n: np.ndarray | int, share: tuple[int, int]):
    """Least number of common shingles that a set of ``n`` has with any partner."""
    return -(-n * share[0] // share[1])


def levels(sketch: np.ndarray) -> np.ndarray:
    """How far each counter stands out: 0 within chance of the mean, else 1 + log2 of the excess."""
    mean = sketch.mean()
    return np.floor(np.log2(np.maximum(sketch - mean - 6 * np.sqrt(mean + 1), 0.5)) + 2).clip(0).astype(np.uint8)


def prefix(tokens: np.ndarray, level: np.ndarray, share: tuple[int, int]) -> tuple[np.ndarray, int, int]:
    """The prefix of a set, the number of matches it asks for, and a number that orders sets by their prefix's last shingle."""
    own = level[(tokens & np.uint64(SKETCH - 1)).astype(np.int64)]
    order = np.lexsort((tokens, own))
    n, least = len(tokens), int(needed(len(tokens), share))
    most = min(MOST_MATCHES, least)
    ends = n - least + np.arange(1, most + 1)
    partners = np.append(0, np.cumsum(np.where(own[order] > 0, np.exp2(own[order] - 2.0), 0)))[ends]
    m = int(np.argmin(ends + CHECK_COST * partners / np.arange(1, most + 1))) + 1
    last = order[ends[m - 1] - 1]
    return order[: ends[m - 1]], m, (int(own[last]) << 57) | (int(tokens[last]) >> 7)


def _described(docs: DataFrame, words: int) -> DataFrame:
    """Per row: id, set digest, size, minima and bitmap; per task: the counts of its shingles in the sketch."""
    schema = pa.schema([
        ("id", pa.int64()), ("digest", pa.binary()), ("n", pa.int64()), ("minima", pa.list_(pa.int64())),
        ("bits", pa.binary()), ("part", pa.int64()), ("data", pa.binary()),
    ])

    def run(batches):
        forget()
        counts = np.zeros(SKETCH, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                some = b.slice(at, 512)
                digest, size, minima, bits = [], [], [], []
                for t in texts(some.column(1)):
                    s = shingles(t, words)
                    size.append(len(s))
                    bits.append(bitmap_of(s) if len(s) else None)
                    digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    if len(s):
                        with np.errstate(over="ignore"):
                            minima.append([int((s * a).min().view(np.int64)) for a in _MINIMA])
                        counts += np.bincount((s & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
                    else:
                        minima.append(None)
                none = [None] * len(size)
                yield batch(schema, some.column(0), digest, size, minima, bits, none, none)
        yield batch(schema, [None], [None], [-1], [None], [None], [TaskContext.get().partitionId()], [counts.tobytes()])

    return docs.mapInArrow(run, "id bigint, digest binary, n bigint, minima array<bigint>, bits binary, part bigint, data binary")


def _bits(ids: np.ndarray) -> np.ndarray:
    return (_mixed(ids.astype(np.int64).view(np.uint64)) & np.uint64(BITMAP - 1)).astype(np.int64)


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """The sets of the wanted documents (column id)."""
    def mark(batches):
        seen = np.zeros(BITMAP, bool)
        for b in batches:
            seen[_bits(b.column(0).to_numpy())] = True
        yield pa.RecordBatch.from_arrays([
            pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([np.packbits(seen).tobytes()], pa.binary()),
        ], names=["part", "data"])

    bitmap = merged(materialise(wanted.mapInArrow(mark, "part bigint, data binary"), "bitmap"), "or", "u1")
    if bitmap is None:
        bitmap = np.zeros(BITMAP // 8, np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap.tobytes())
    schema = pa.schema([("id", pa.int64()), ("tokens", pa.binary())])

    def run(batches):
        seen = np.unpackbits(np.frombuffer(shared.value, np.uint8)).astype(bool)
        for b in batches:
            b = b.filter(pa.array(seen[_bits(b.column(0).to_numpy())]))
            for at in range(0, b.num_rows, 512):
                some = b.slice(at, 512)
                yield batch(schema, some.column(0), [shingles(t, words).tobytes() for t in texts(some.column(1))])

    found = docs.filter("id is not null").mapInArrow(run, "id bigint, tokens binary")
    return materialise(found.join(wanted, "id", "left_semi"), "sets")


def checked(docs: DataFrame, pairs: DataFrame, words: int, share: tuple[int, int]) -> DataFrame:
    """Those of the pairs (columns x, y) whose sets are alike."""
    wanted = materialise(pairs.select(F.col("x").alias("id")).union(pairs.select("y")).distinct(), "wanted")
    sets = _sets(docs, wanted, words)
    both = pairs.join(sets.select(F.col("id").alias("x"), F.col("tokens").alias("one")), "x").join(
        sets.select(F.col("id").alias("y"), F.col("tokens").alias("two")), "y"
    ).select("x", "y", "one", "two")

    def run(batches):
        for b in batches:
            keep = []
            for one, two in zip(b.column(2), b.column(3)):
                one, two = np.frombuffer(one.as_py(), np.uint64), np.frombuffer(two.as_py(), np.uint64)
                same = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(same > 0 and share[1] * same >= share[0] * (len(one) + len(two) - same))
            yield pa.RecordBatch.from_arrays(b.columns[:2], names=["x", "y"]).filter(pa.array(keep, pa.bool_()))

    return materialise(both.mapInArrow(run, "x bigint, y bigint"), "checked")


def _first_step(nodes: DataFrame) -> DataFrame:
    """For each node the smallest node with most of its minima, if that is another one."""
    spread = nodes.select("id", F.posexplode("minima").alias("k", "value"))
    pivot = spread.groupBy("k", "value").agg(F.min("id").alias("pivot"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = spread.join(pivot, ["k", "value"]).groupBy("id", "pivot").count().filter(f"id <> pivot and count >= {AGREE}")
    return met.groupBy("id").agg(F.max_by("pivot", F.struct("count", -F.col("pivot"))).alias("y")).select(
        F.col("id").alias("x"), "y"
    )


def _entries(docs: DataFrame, level: np.ndarray, words: int, share: tuple[int, int]) -> DataFrame:
    """Prefix entries that meet another one: shingle, id, size of the set, matches asked for."""
    shared = docs.sparkSession.sparkContext.broadcast(level)
    schema = pa.schema([("token", pa.int64()), ("salt", pa.int32()), ("id", pa.int64()), ("n", pa.int32()), ("m", pa.int32()), ("last", pa.int64())])
    common = 13  # a sketch level: from some thousand documents on, an entry surely meets others

    def emit(batches):
        own = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 256):
                some = b.slice(at, 256)
                found: list[list] = [[], [], [], [], [], []]
                for key, t in zip(some.column(0).to_pylist(), texts(some.column(1))):
                    s = shingles(t, words)
                    if not len(s):
                        continue
                    first, m, last = prefix(s, own, share)
                    chosen = s[first]
                    hot = own[(chosen & np.uint64(SKETCH - 1)).astype(np.int64)] >= common
                    for x, v in zip(found, (
                        chosen.view(np.int64), np.where(hot, 1 + key % 9973, 0).astype(np.int32), np.full(len(chosen), key),
                        np.full(len(chosen), len(s), np.int32), np.full(len(chosen), m, np.int32),
                        np.full(len(chosen), last),
                    )):
                        x.append(v)
                if found[0]:
                    yield batch(schema, *map(np.concatenate, found))

    def several(batches):
        for columns, starts in runs(batches, 2):
            many = np.repeat(np.diff(starts) > 1, np.diff(starts)) | (columns[1] > 0)
            if many.any():
                yield batch(schema, *[c[many] for c in columns])

    kind = "token bigint, salt int, id bigint, n int, m int, last bigint"
    entries = docs.filter("id is not null").mapInArrow(emit, kind)
    met = entries.repartition("token", "salt").sortWithinPartitions("token", "salt").mapInArrow(several, kind)
    return materialise(met.drop("salt"), "entries")


def _summed(x: np.ndarray, y: np.ndarray, m: np.ndarray, c: np.ndarray) -> list[np.ndarray]:
    """Each pair x, y once, with its largest m and the sum of c."""
    order = np.lexsort((y, x))
    x, y, m, c = x[order], y[order], m[order], c[order]
    first = group_starts(x, y)[:-1]
    return [x[first], y[first], np.maximum.reduceat(m, first), np.add.reduceat(c, first)]


def _met(entries: DataFrame, member: DataFrame, bitmaps: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Pairs (x, y) of nodes of different components that can share enough, the matches asked for (m) and found (c).

    A pair is counted where its shingles meet, over all of a task's shingles, so it has a row only for each task.
    """
    met_by_others = F.count(F.lit(1)).over(Window.partitionBy("id", "n", "m", "last"))
    taken = F.col("n") - F.ceil(F.col("n") * share[0] / share[1]) + F.col("m")
    rows = entries.join(member.filter("id = node").select("id", "part"), "id").distinct().withColumn(
        "most", (F.col("n") - taken + met_by_others).cast("int")  # what the set can share with others
    )
    rows = materialise(rows, "members")
    by_part = rows.groupBy("token", "part").agg(F.count(F.lit(1)).alias("c"))
    crossing = by_part.groupBy("token").agg(
        F.sum("c").alias("all"), F.max(F.struct("c", "part")).alias("top"), F.count(F.lit(1)).alias("parts")
    ).filter("parts > 1").select(
        "token", F.col("top.part").alias("top"), F.ceil(F.col("top.c") / BLOCK).cast("int").alias("top_blocks"),
        F.ceil((F.col("all") - F.col("top.c")) / BLOCK).cast("int").alias("blocks"), (F.col("all") > FEW).alias("dense"),
    )
    crossed = rows.join(crossing, "token")
    known = bitmaps.withColumnRenamed("id", "of")
    met = materialise(crossed.join(known, (F.col("id") == F.col("of")) & F.col("dense"), "left").drop("of", "dense"), "crossing")
    # Shingles with the same largest component go together, so that pairs they share are counted before they leave the task.
    # Where they have many entries, slices bound how many; at most one component for SLICE_ROWS entries is that large.
    large = met.groupBy("top").agg(F.count(F.lit(1)).alias("entries")).filter(F.col("entries") > SLICE_ROWS).select(
        "top", F.ceil(F.col("entries") / (8 * SLICE_ROWS)).cast("int").alias("spread")
    )
    dealt = met.join(F.broadcast(large), "top", "left").withColumn(
        "slice", F.when(F.col("spread").isNull(), F.lit(0)).otherwise(slice_of("token", "spread"))
    )
    top, rest = dealt.filter("part = top"), dealt.filter("part <> top")

    def block(of: str):
        return F.pmod(F.xxhash64("id"), F.col(of)).cast("int")

    def every(of: str):
        return F.explode(F.sequence(F.lit(0), F.col(of) - 1))

    place = ["top", "low", "high", "slice", "token"]
    shown = [*place, "side", "id", "part", "n", "m", "last", "most", "bits"]
    work = (
        top.withColumn("low", block("top_blocks")).withColumn("high", every("blocks")).withColumn("side", F.lit(0)).select(shown)
        .union(rest.withColumn("high", block("blocks")).withColumn("low", every("top_blocks")).withColumn("side", F.lit(1)).select(shown))
        # among the rest: blocks below zero, so that they don't mix with those above
        .union(
            rest.withColumn("mine", block("blocks")).withColumn("theirs", every("blocks")).withColumn("side", F.col("mine") + 2)
            .withColumn("low", -1 - F.least("mine", "theirs")).withColumn("high", F.greatest("mine", "theirs")).select(shown)
        )
    )
    schema = pa.schema([("x", pa.int64()), ("y", pa.int64()), ("m", pa.int32()), ("c", pa.int64())])

    def meet(batches):
        held, size_held = [], 0
        for columns, starts in runs(batches, 5):
            _, low, high, _, _, side, key, part, n, m, last, most, raw = columns
            n, most, bitmaps = n.astype(np.int64), most.astype(np.int64), None
            out: list[list] = [[], [], []]

            def fits(i, j):
                """Whether rows i and j (arrays, or one row and an array) are a pair that can be alike."""
                apart = np.where((low[i] >= 0) | (-1 - low[i] != high[i]), side[i] != side[j], key[i] != key[j])
                bound = np.where(last[j] < last[i], most[j], most[i])
                bound = np.where(last[j] == last[i], np.maximum(most[j], most[i]), bound)
                return (
                    apart & (part[i] != part[j]) & (np.minimum(n[j], n[i]) * share[1] >= np.maximum(n[j], n[i]) * share[0])
                    & (bound * (share[0] + share[1]) >= (n[j] + n[i]) * share[0])
                )

            def give(i, j):
                out[0].append(np.minimum(key[i], key[j]))
                out[1].append(np.maximum(key[i], key[j]))
                out[2].append(np.minimum(m[i], m[j]))

            sizes = np.diff(starts)
            for size in range(2, FEW + 1):
                first = starts[:-1][sizes == size]
                for one in range(size if len(first) else 0):
                    for two in range(one + 1, size):
                        hit = first[fits(first + one, first + two)]
                        if len(hit):
                            give(hit + one, hit + two)
            for at in np.flatnonzero(sizes > FEW):
                s, e = starts[at], starts[at + 1]
                bitmaps = bitmaps or Bitmaps(raw)
                for i in range(s, e - 1):
                    j = np.arange(i + 1, e)
                    j = j[fits(i, j)]
                    if len(j):
                        j = j[bitmaps.most_shared(i, j, n) * (share[0] + share[1]) >= (n[i] + n[j]) * share[0]]
                    if len(j):
                        give(i, j)
            if out[0]:
                x, y, m = map(np.concatenate, out)
                held.append(_summed(x, y, m, np.ones(len(x), np.int64)))
                size_held += len(held[-1][0])
            if size_held > PAIRS_HELD:
                held = [_summed(*map(np.concatenate, zip(*held)))]
                size_held = len(held[0][0])
                if size_held > PAIRS_HELD // 2:
                    yield batch(schema, *held[0])
                    held, size_held = [], 0
        if held:
            yield batch(schema, *_summed(*map(np.concatenate, zip(*held))))

    return work.repartition(*place[:4]).sortWithinPartitions(*place).mapInArrow(meet, "x bigint, y bigint, m int, c bigint")


def _pairs(entries: DataFrame, member: DataFrame, bitmaps: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Pairs of nodes of different components that share as many prefix shingles as they have to, and can share enough in all."""
    met = _met(entries, member, bitmaps, share)
    return materialise(
        met.groupBy("x", "y").agg(F.sum("c").alias("c"), F.max("m").alias("m")).filter("c >= m").select("x", "y"), "pairs"
    )


def slice_of(token: str, top_blocks: str) -> Column:
    """The part of its largest component's shingles that a shingle belongs to, eight for each of ``top_blocks``."""
    return F.pmod(F.xxhash64(token), F.col(top_blocks) * 8)


def joined(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, share: tuple[int, int] = (75, 100)
) -> DataFrame:
    """Set size and component (smallest id reachable over alike sets) of every row."""
    docs = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    told = materialise(_described(docs, words), "described")
    sketch = merged(told.filter("part is not null").select("part", "data"), "sum", "i8")
    level = levels(sketch) if sketch is not None else np.zeros(SKETCH, np.uint8)
    rows = told.filter("part is null").select("id", "digest", "n", "minima", "bits")
    usable = rows.filter("digest is not null and id is not null")
    classes = usable.groupBy("digest").agg(F.min("id").alias("node"))
    member = materialise(usable.select("id", "digest").join(classes, "digest").select("id", "node").distinct(), "nodes")
    nodes = usable.join(member.filter("id = node").select("id"), "id", "left_semi").select("id", "minima")
    first = checked(docs, materialise(_first_step(nodes), "first-pairs"), words, share)
    roots = materialise(components(first), "first-parts")
    known = member.join(roots.select(F.col("node"), F.col("root").alias("part")), "node", "left").select(
        "id", "node", F.coalesce("part", "node").alias("part")
    )
    known = materialise(known, "known")
    # Where rows under one id have several sets, their entries have no bitmap.
    bitmaps = usable.groupBy("id").agg(F.count_distinct("digest").alias("sets"), F.first("bits").alias("bits")).select(
        "id", F.when(F.col("sets") == 1, F.col("bits")).alias("bits")
    )
    pairs = _pairs(_entries(docs, level, words, share), known, bitmaps, share)
    second = checked(docs, pairs, words, share)
    # A document of several sets ties their nodes together.
    edges = first.union(second).union(member.filter("id <> node").select("id", "node"))
    roots = components(edges).withColumnRenamed("node", "id")
    return rows.select("id", "n").join(roots, "id", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("root", "id").alias("component_id")
    )
