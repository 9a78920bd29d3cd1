"""Toxicity by multiple-instance learning.

A text is a bag of sentences.  Each sentence has a probability (logistic in hashed features of its distinct
words: the word and its first three to six letters), and the text's probability is their noisy-or: that at least
one sentence is toxic.  Only documents are labelled; the weights are learnt from those labels by gradient steps
on a bounded sample, weighted so that the classes count as they do among all labelled rows.  Sentence scores
then locate the offending sentences.

Sentences end at ``.``, ``!``, ``?`` or a line feed.  A null or empty text has one empty sentence.  Without a
label of either class nothing is learnt and every score is the share of toxic labels (0 without labels).
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postwarden.llm.common import carried, forget, place_of, result_type, take_sample, text_of, texts
from postwarden.session import materialise

DIMENSIONS = 1 << 18
PREFIXES = (3, 4, 5, 6)
#: Words whose weights a worker remembers; the memory is emptied when full.
REMEMBER = 300_000
_SENTENCE = re.compile(r"[.!?\n]+")
_APART = str.maketrans({i: " " for i in range(48) if i != 10} | {i: " " for i in [*range(58, 65), *range(91, 97), *range(123, 128)]} | {ord(c): "." for c in ".!?\n"})


def sentences(text: str) -> list[str]:
    return [s for s in _SENTENCE.split(text) if s.strip()] or [""]


def bags(text: str) -> list[set[str]]:
    """The distinct words of each sentence."""
    return [set(s.split()) for s in text.lower().translate(_APART).split(".") if s and not s.isspace()] or [set()]


def features(word: str) -> list[int]:
    keys = [f"w {word}", *(f"p {word[:n]}" for n in PREFIXES if len(word) >= n)]
    return [zlib.crc32(k.encode("utf-8", "replace")) % DIMENSIONS for k in keys]


def noisy_or(z: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Log of the probability that no sentence of a bag is toxic.  z: sentence logits; starts: first of each bag."""
    return np.add.reduceat(-np.logaddexp(0, z), starts)


def fit(docs: list[list[list[int]]], n_words: int, word_features: list[list[int]], labels: np.ndarray,
        weights: np.ndarray, epochs: int, rate: float, decay: float) -> tuple[np.ndarray, float]:
    """Feature weights and bias.  docs: word numbers by sentence and document."""
    sizes = np.array([len(f) for f in word_features], np.int64)
    flat = np.array([x for f in word_features for x in f], np.int64)
    begin = np.append(0, np.cumsum(sizes))
    w, g2 = np.zeros(DIMENSIONS), np.full(DIMENSIONS, 1e-4)
    b, b2 = -4.0, 1e-4
    order = np.random.default_rng(7)
    for _ in range(epochs):
        turn = order.permutation(len(docs))
        for at in range(0, len(turn), 64):
            some = turn[at : at + 64]
            lengths = [len(s) for d in some for s in docs[d]]
            words = np.array([x for d in some for s in docs[d] for x in s], np.int64)
            sentence_of_word = np.repeat(np.arange(len(lengths)), lengths)
            per_doc = np.array([len(docs[d]) for d in some])
            starts = np.append(0, np.cumsum(per_doc)[:-1])
            n = sizes[words]
            where = np.repeat(begin[words] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum()) if len(words) else words
            f, s = flat[where], np.repeat(sentence_of_word, n)
            z = b + np.bincount(s, w[f], len(lengths))
            none = noisy_or(z, starts)
            p = -np.expm1(none)
            # d loss / d z = sigmoid(z) * (1 - y / p): all sentences of a clean text, and the likely ones of a toxic one
            y = labels[some]
            slope = weights[some] * (1 - y / np.maximum(p, 1e-9))
            gz = np.repeat(slope, per_doc) / (1 + np.exp(-z)) / len(some)
            grad = np.bincount(f, gz[s], DIMENSIONS)
            hit = np.flatnonzero(grad)
            grad[hit] += decay * w[hit]
            g2[hit] += grad[hit] ** 2
            w[hit] -= rate * grad[hit] / np.sqrt(g2[hit])
            gb = gz.sum()
            b2 += gb * gb
            b -= rate * gb / np.sqrt(b2)
    return w, float(b)


def learn(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows_per_class: int,
          epochs: int, rate: float, decay: float) -> tuple[np.ndarray | None, float]:
    """Weights and bias.  Ids meet labels as narrow rows; only the bounded sample of them is joined, by broadcast, to texts."""
    marked = labels.filter(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label"))
    rows = materialise(docs.select(F.col(id_col).alias("_id")).join(marked, "_id"), "labelled")
    counts = {r["_label"]: r["count"] for r in rows.groupBy("_label").count().collect()}
    if len(counts) < 2:
        return None, float(bool(counts.get(1)))
    chosen = take_sample(rows, "_id", ["_label"], rows_per_class).distinct()
    sample = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id")

    def cut(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([
                b.column(0), b.column(1),
                pa.array(["\n".join(" ".join(sorted(s)) for s in bags(t)) for t in texts(b.column(2))], pa.string()),
            ], names=["id", "label", "words"])

    got = sample.select(F.col("_id").cast("bigint"), F.col("_label").cast("int"), "_text").mapInArrow(
        cut, "id bigint, label int, words string"
    ).toArrow()
    got = got.sort_by([("id", "ascending"), ("words", "ascending")]).drop_columns("id")  # the steps depend on the order
    number: dict[str, int] = {}
    docs, labels = [], np.array(got.column(0).to_pylist(), float)
    for text in got.column(1).to_pylist():
        docs.append([[number.setdefault(w, len(number)) for w in s.split(" ") if w] for s in text.split("\n")])
    if not (labels == 0).any() or not (labels == 1).any():
        return None, counts.get(1, 0) / sum(counts.values())
    weights = np.where(labels == 1, counts[1] / (labels == 1).sum(), counts[0] / (labels == 0).sum())
    weights *= len(labels) / weights.sum()
    return fit(docs, len(number), [features(w) for w in number], labels, weights, epochs, rate, decay)


class Scorer:
    def __init__(self, w: np.ndarray | None, b: float):
        self.w, self.b, self.known = w, b, {}

    def weight(self, word: str) -> float:
        got = self.known.get(word)
        if got is None:
            if len(self.known) >= REMEMBER:
                self.known.clear()
            got = self.known[word] = float(self.w[features(word)].sum())
        return got

    def logits(self, text: str) -> np.ndarray:
        known, weight = self.known, self.weight
        return np.array([self.b + sum([known[x] if x in known else weight(x) for x in s]) for s in bags(text)])

    def text(self, text: str) -> float:
        if self.w is None:
            return self.b
        return float(-np.expm1(-np.logaddexp(0, self.logits(text)).sum()))

    def offending(self, text: str, least: float) -> list[tuple[str, float]]:
        """The sentences with at least that probability."""
        if self.w is None:
            return []
        out = []
        for s in sentences(text):
            p = self.text(s)
            if p >= least:
                out.append((s.strip(), p))
        return out


def scored(
    df: DataFrame, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    rows_per_class: int = 4000, epochs: int = 8, rate: float = 0.6, decay: float = 1e-6, locate: float | None = None,
    carry: bool = False,
) -> DataFrame:
    """The probability that each row's text is toxic; with ``locate``, also its sentences of that score or more.

    It is learnt from the texts of ``docs`` that ``labels`` (id, label) names.  With ``carry``, each row is handed on whole, as the column ``row``.
    """
    shared = df.sparkSession.sparkContext.broadcast(
        learn(docs, labels, id_col, text_col, label_col, rows_per_class, epochs, rate, decay)
    )
    place = place_of(df, text_col)

    def run(batches):
        forget()
        scorer = Scorer(*shared.value)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                many = texts(text_of(part, place))
                columns = [part.column(0), pa.array([min(1.0, max(0.0, scorer.text(t))) for t in many], pa.float64())]
                if locate is not None:
                    columns.append(pa.array([[x for x, _ in scorer.offending(t, locate)] for t in many], pa.list_(pa.string())))
                names = [part.schema.names[0], "score", "offending"]
                yield pa.RecordBatch.from_arrays(columns, names=names[: len(columns)])

    narrow = carried(df, id_col, text_col, carry)
    more = {} if locate is None else {"offending": T.ArrayType(T.StringType())}
    return narrow.mapInArrow(run, result_type(narrow, score="double", **more))
