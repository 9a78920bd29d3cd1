"""Ranked lexical search over all documents by norm buckets.

A document is a vector of integer impacts over the terms that some item asks for, and an item a vector of integer
weights; a score is their inner product.  Documents are dealt by the length of their vectors, longest first, so every
partition, and every block of it, is a bucket of similar lengths.  For an item that already knows ``k`` scores, a bucket
is left out when the item's length times the bucket's largest length stays below the worst of them (Cauchy-Schwarz).
Inside a bucket the item's heaviest coordinates are multiplied out and the others bounded by the lengths of what is left
of both vectors; only documents whose bound reaches the worst known score are scored whole, in 64-bit integers.  The
longest vectors are searched first and give all other buckets their first worst scores, so nothing that belongs to the
result is left out.

Texts are read once for each block of items (``ITEM_TERMS`` terms together), into narrow rows; statistics come from all
of them.  What is broadcast is one block of items.

Null and empty texts have no term: such a document is never ranked and doesn't count, such an item has no rows.  Every
row of the documents is a document of its own, also where ids repeat or are null; null ids come after others of the same
score.  Items that repeat both id and text count once; different texts under one id are ranked apart.  Only the named
columns are read.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postwarden.llm.common import batch
from postwarden.session import materialise

#: Different terms of the items that are searched for together.
ITEM_TERMS = 1_000_000
#: Documents in a block, the smallest bucket.
BLOCK = 2048
#: The share of an item's squared length that its heaviest coordinates hold, which are multiplied out for the bound.
FOCUS = 0.7
#: Documents with longer vectors than this share of all are searched first.
FIRST_SHARE = 0.98

# Letters, digits and bytes of other characters stay, A-Z in lower case; everything else separates terms.
_KEEP = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)).lower()


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text in order."""
    return text.translate(_KEEP).split() if text else []


def _lists(values: list, kind) -> pa.Array:
    offsets = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    flat = np.concatenate(values) if values else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=kind))


def _items(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row for each different item with a term: id, key, terms and how often each occurs."""
    schema = pa.schema([
        ("item", pa.int64()), ("key", pa.string()), ("terms", pa.list_(pa.binary())), ("counts", pa.list_(pa.int64())),
    ])

    def count(batches):
        for b in batches:
            found = [Counter(terms_of(t)) for t in b.column(2).to_pylist()]
            keep = [i for i, c in enumerate(found) if c]
            yield batch(
                schema, b.column(0).take(pa.array(keep, pa.int64())), b.column(1).take(pa.array(keep, pa.int64())),
                [list(found[i]) for i in keep], [list(found[i].values()) for i in keep],
            )

    named = items.select(F.col(id_col).cast("bigint").alias("item"), F.col(text_col).cast("binary").alias("text"))
    key = F.concat_ws(":", F.coalesce(F.col("item").cast("string"), F.lit("")), F.sha2("text", 256))
    named = named.filter("text is not null").distinct().select("item", key.alias("key"), "text")
    return named.mapInArrow(count, "item bigint, key string, terms array<binary>, counts array<bigint>")


def _counted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Of every document with a term: its number of terms, and which terms of the vocabulary it holds how often."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = pa.schema([
        ("doc", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())),
    ])

    def count(batches):
        known = shared.value
        names = known.keys()
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                numbers, terms, counts, keep = [], [], [], []
                for i, text in enumerate(part.column(1)):
                    words = terms_of(text.as_py())
                    if not words:
                        continue
                    found = Counter(words)
                    held = found.keys() & names
                    keep.append(i)
                    numbers.append(len(words))
                    terms.append(np.fromiter((known[t] for t in held), np.int32, len(held)))
                    counts.append(np.fromiter((found[t] for t in held), np.int32, len(held)))
                yield batch(
                    schema, part.column(0).take(pa.array(keep, pa.int64())), numbers, _lists(terms, pa.int32()),
                    _lists(counts, pa.int32()),
                )

    return docs.mapInArrow(count, "doc bigint, n bigint, terms array<int>, counts array<int>")


class _Query:
    """An item: its coordinates from the heaviest on, the length of all and of those behind the focus."""

    def __init__(self, terms: np.ndarray, weights: np.ndarray):
        order = np.lexsort((terms, -weights))
        self.terms, self.weights = terms[order], weights[order]
        square = np.cumsum(self.weights.astype(float) ** 2)
        self.length = math.sqrt(square[-1])
        self.focus = int(np.searchsorted(square, FOCUS * square[-1])) + 1
        self.rest = math.sqrt(max(0.0, square[-1] - square[min(self.focus, len(square)) - 1]))


def best(scores: np.ndarray, ids: np.ndarray, missing: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: highest score, then smallest id, null ids last."""
    return np.lexsort((ids, missing, -scores))[:k]


class _Found:
    """The best documents of one item so far."""

    def __init__(self, worst: int):
        self.worst = worst
        self.rows = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)]

    def add(self, scores, ids, missing, k: int) -> None:
        rows = [np.concatenate(x) for x in zip(self.rows, (scores, ids, missing))]
        keep = best(*rows, k)
        self.rows = [x[keep] for x in rows]
        if len(keep) == k:
            self.worst = max(self.worst, int(self.rows[0][-1]))


def search_block(queries: list[_Query], found: list[_Found], ids, missing, lengths, starts, terms, impacts, k: int) -> int:
    """Searches one bucket for every item; gives how many (item, document) pairs were scored whole."""
    order = np.argsort(terms, kind="stable")
    docs = np.repeat(np.arange(len(ids)), np.diff(starts))[order]
    values = impacts[order]
    names, first = np.unique(terms[order], return_index=True)
    ends = np.append(first[1:], len(order))
    longest, scored = float(lengths.max(initial=0.0)), 0
    slack = 1 + 1e-9
    for query, known in zip(queries, found):
        if query.length * longest * slack < known.worst or not len(names):
            continue
        at = np.searchsorted(names, query.terms)
        at[at == len(names)] = 0
        here = np.flatnonzero(names[at] == query.terms)
        if not len(here):
            continue
        total, squares = np.zeros(len(ids), np.int64), np.zeros(len(ids))
        for c in here[here < query.focus]:
            span = slice(first[at[c]], ends[at[c]])
            v = values[span]
            total[docs[span]] += query.weights[c] * v
            squares[docs[span]] += v.astype(float) ** 2
        bound = total + query.rest * np.sqrt(np.maximum(lengths * lengths - squares, 0.0) + 1.0)
        alive = (bound * slack >= known.worst) & (bound > 0)
        scored += int(alive.sum())
        if not alive.any():
            continue
        for c in here[here >= query.focus]:
            span = slice(first[at[c]], ends[at[c]])
            near = alive[docs[span]]
            total[docs[span][near]] += query.weights[c] * values[span][near]
        hit = np.flatnonzero(alive & (total > 0) & (total >= known.worst))
        if len(hit):
            known.add(total[hit], ids[hit], missing[hit], k)
    return scored


def _searched(vectors: DataFrame, queries: list[_Query], worst: list[int], k: int) -> DataFrame:
    """The best k documents of each item in each partition."""
    shared = vectors.sparkSession.sparkContext.broadcast((queries, worst))
    schema = pa.schema([("place", pa.int32()), ("doc", pa.int64()), ("score", pa.int64())])

    def search(batches):
        asked, least = shared.value
        found = [_Found(w) for w in least]
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                ids, lists, values = part.column(0), part.column(2), part.column(3)
                search_block(
                    asked, found, ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False),
                    part.column(1).to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py(),
                    lists.flatten().to_numpy(), values.flatten().to_numpy(), k,
                )
        rows = [(i, f) for i, f in enumerate(found) if len(f.rows[0])]
        if rows:
            yield batch(
                schema, np.concatenate([np.full(len(f.rows[0]), i, np.int32) for i, f in rows]),
                pa.array(np.concatenate([f.rows[1] for _, f in rows]), mask=np.concatenate([f.rows[2] for _, f in rows])),
                np.concatenate([f.rows[0] for _, f in rows]),
            )

    # Documents of one length, such as copies, may lie in several partitions.
    ordered = vectors.repartitionByRange(F.desc("length"), F.xxhash64("doc")).sortWithinPartitions(F.desc("length"))
    return ordered.select("doc", "length", "terms", "impacts").mapInArrow(search, "place int, doc bigint, score bigint")


def _block(docs: DataFrame, items: list, k: int) -> DataFrame:
    """The best k documents of each of these items."""
    vocabulary: dict[bytes, int] = {}
    for item in items:
        for term in item["terms"]:
            vocabulary.setdefault(bytes(term), len(vocabulary))
    counted = materialise(_counted(docs, vocabulary), "lexical-counts")
    stats = counted.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("words")).first()
    n_docs, n_words = stats["docs"], stats["words"] or 1
    holds = dict.fromkeys(range(len(vocabulary)), 0)
    for r in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        holds[r["term"]] = r["count"]
    queries = []
    for item in items:
        terms = np.array([vocabulary[bytes(t)] for t in item["terms"]], np.int32)
        weights = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holds[t] + 1))) for t in terms.tolist()]
        queries.append(_Query(terms, np.array(weights, np.int64) * np.array(item["counts"], np.int64)))
    m = f"(25 + (75 * n * {n_docs}L) div {n_words}L)"
    vectors = counted.filter("size(terms) > 0").select(
        "doc", "terms", F.expr(f"transform(counts, c -> (1000000000L * c) div (1000L * c + 8L * {m}))").alias("impacts")
    ).withColumn("length", F.expr("sqrt(aggregate(impacts, 0D, (s, x) -> s + cast(x as double) * x))"))
    vectors = materialise(vectors, "lexical-vectors")
    cut = vectors.agg(F.percentile_approx("length", FIRST_SHARE, 1000)).first()[0]
    cut = 0.0 if cut is None else cut
    first = materialise(_searched(vectors.filter(F.col("length") >= cut), queries, [0] * len(queries), k), "lexical-first")
    place = Window.partitionBy("place").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    ranked = first.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") == k)
    worst = [0] * len(queries)
    for r in ranked.select("place", "score").collect():
        worst[r["place"]] = r["score"]
    rest = _searched(vectors.filter(F.col("length") < cut), queries, worst, k)
    names = docs.sparkSession.createDataFrame(
        [(i, item["item"]) for i, item in enumerate(items)], "place int, item bigint"
    )
    merged = first.union(rest).withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
    return merged.join(names, "place").select("item", "rank", "doc", "score")


def ranked(
    documents: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", k: int = 10, item_terms: int = ITEM_TERMS,
) -> DataFrame:
    """The k highest-scoring documents of each item: its id, rank, the document's id and the score."""
    spark = documents.sparkSession
    docs = documents.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).cast("binary").alias("text"))
    asked = materialise(_items(items, item_col, item_text_col), "lexical-items")
    total = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = -(-total // item_terms)
    out = spark.createDataFrame([], "item bigint, rank int, doc bigint, score bigint")
    for i in range(blocks):
        mine = asked.filter(F.pmod(F.xxhash64("key"), F.lit(blocks)) == i).orderBy("key").collect()
        if mine:
            out = out.union(_block(docs, mine, k))
    return out.select(F.col("item").alias(item_col), "rank", F.col("doc").alias(id_col), "score")
