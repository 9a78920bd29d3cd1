"""A three-class linear model as data: sparse rows, fitting by gradient steps, scores by a sparse product.

A row's vector is kept as two arrays, the places of its numbers and the numbers.  The coefficients are a table of bounded
size (``MAX_COEFFICIENTS``), so they travel as literal arrays inside the plan: a product is a projection.  A step of the
fit sums per place inside each task, by Arrow batches, and adds up the tasks' sums.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postwarden.functions import fixed as fx

#: Coefficients (features times classes) that a model may have.
MAX_COEFFICIENTS = 1_000_000
SCORES = [f"{name}_score" for name in fx.LABELS]
TABLE = "position int, feature string, " + ", ".join(f"{name} double" for name in fx.LABELS)
INTERCEPT = "intercept"


def literal_array(values: list, kind: str = "double") -> Column:
    """A constant array; one literal, where ``lit`` would make an expression of each entry."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def dot(indices: str | Column, values: str | Column, coefficients: Column) -> Column:
    """Sum of the values times the coefficients at their places."""
    return F.aggregate(
        F.zip_with(indices, values, lambda i, v: v * F.get(coefficients, i)), F.lit(0.0), lambda a, x: a + x
    )


def softmax(logits: list[Column]) -> list[Column]:
    """Probabilities of the classes, computed against the largest logit."""
    top = F.greatest(*logits)
    parts = [F.exp(z - top) for z in logits]
    total = sum(parts[1:], parts[0])
    return [p / total for p in parts]


@dataclass
class LinearModel:
    """Feature names in order, a coefficient for each and class, and an intercept for each class."""

    names: list[str]
    weights: list[list[float]]
    intercepts: list[float]
    places: dict[str, int] = field(init=False, repr=False)

    def __post_init__(self):
        if len(self.weights) * len(self.names) > MAX_COEFFICIENTS:
            raise ValueError(f"more than {MAX_COEFFICIENTS} coefficients")
        self.places = {n: i for i, n in enumerate(self.names)}

    def sparse_logits(self, vectors: list[tuple[Column, int, int]]) -> list[Column]:
        """Per class, what sparse vectors add to the score.  Each comes as (struct of indices and values, first place, size)."""
        out = []
        for row in self.weights:
            parts = [dot(v["indices"], v["values"], literal_array(row[at : at + size])) for v, at, size in vectors]
            out.append(sum(parts[1:], parts[0]))
        return out

    def number_logits(self, columns: list[str]) -> list[Column]:
        """Per class, what number columns add to the score."""
        return [
            sum((F.col(c) * F.lit(row[self.places[c]]) for c in columns), F.lit(0.0)) for row in self.weights
        ]

    def rows(self, spark: SparkSession) -> DataFrame:
        """The model as a table; the intercept is its last row."""
        rows = [(i, n, *(w[i] for w in self.weights)) for i, n in enumerate(self.names)]
        return spark.createDataFrame([*rows, (len(self.names), INTERCEPT, *self.intercepts)], TABLE)

    @classmethod
    def from_rows(cls, table: DataFrame) -> LinearModel:
        rows = sorted(table.collect(), key=lambda r: r["position"])
        if not rows or rows[-1]["feature"] != INTERCEPT or [r["position"] for r in rows] != list(range(len(rows))):
            raise ValueError("not a whole model")
        return cls(
            [r["feature"] for r in rows[:-1]], [[float(r[n]) for r in rows[:-1]] for n in fx.LABELS],
            [float(rows[-1][n]) for n in fx.LABELS],
        )

    @classmethod
    def from_logistic(cls, model, names: list[str]) -> LinearModel:
        """A multinomial regression of Spark ML; classes it never saw get no weight and the lowest intercept."""
        matrix, intercepts = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
        if len(matrix) == 1:  # two classes in the binary form
            matrix, intercepts = [0 * matrix[0], matrix[0]], [0.0, intercepts[0]]
        missing = len(fx.LABELS) - len(matrix)
        return cls(
            list(names), [[float(x) for x in row] for row in matrix] + [[0.0] * len(names)] * missing,
            [float(x) for x in intercepts] + [-1e6] * missing,
        )


def dense_statistics(rows: DataFrame, column: str, size: int) -> tuple[list[float], list[float]]:
    """Mean and scale (one over the deviation, 0 for constants) of each entry of an array column, in one pass."""
    if not size:
        return [], []
    x = [F.get(column, F.lit(i)) for i in range(size)]
    found = rows.agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(x)], *[F.stddev_pop(c).alias(f"d{i}") for i, c in enumerate(x)],
        *[(F.min(c) < F.max(c)).alias(f"v{i}") for i, c in enumerate(x)],
    ).first()
    varies = [bool(found[f"v{i}"]) for i in range(size)]
    means = [float(found[f"m{i}"] or 0.0) for i in range(size)]
    return means, [1.0 / found[f"d{i}"] if varies[i] else 0.0 for i in range(size)]


def standardised(column: str, means: list[float], scales: list[float]) -> Column:
    mean, scale = literal_array(means), literal_array(scales)
    return F.transform(column, lambda v, i: (v - F.get(mean, i)) * F.get(scale, i))


STEP = "place int, " + ", ".join(f"g{c} double" for c in range(len(fx.LABELS)))


def _missed(weights: list[list[float]]):
    """A task's part of a step: the sums, per place, of the values times what the probabilities miss the labels by."""
    table = np.array(weights)

    def slopes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(table.shape)
        for batch in batches:
            i, v, k = (batch.column(name) for name in ("i", "v", "k"))
            rows, places = np.asarray(pc.list_parent_indices(i)), np.asarray(i.flatten())
            values = v.flatten()
            bad = np.bincount(rows, np.asarray(values.is_null().cast(pa.int8())), batch.num_rows) > 0
            bad |= k.is_null().to_numpy(zero_copy_only=False)
            values = values.fill_null(0.0).to_numpy()
            z = np.stack([np.bincount(rows, values * w[places], batch.num_rows) for w in table])
            chances = np.exp(z - z.max(axis=0))
            chances /= chances.sum(axis=0)
            chances -= np.arange(len(table))[:, None] == np.asarray(k.fill_null(-1))
            chances[:, bad] = 0.0
            for total, missed in zip(sums, chances):
                total += np.bincount(places, values * missed[rows], len(total))
        used = np.flatnonzero(sums.any(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), *[pa.array(total[used]) for total in sums]], ["place", *[f"g{c}" for c in range(len(sums))]]
        )

    return slopes


def fit_softmax(
    rows: DataFrame, size: int, steps: int = 60, l2: float = 0.001, momentum: float = 0.9, label: str = "label_code",
) -> tuple[list[list[float]], list[float]]:
    """Multinomial logistic regression by full-batch gradient steps with momentum: weights and intercepts.

    ``rows`` have ``indices`` and ``values`` (sparse, below ``size``) and a label code, and should be a written table, as every
    step reads them once.  The step length comes from the mean square of the rows, which bounds the curvature, so nothing has
    to be tuned.  Each step takes one sum per place to the driver (bounded by the number of features).
    """
    classes = len(fx.LABELS)
    if (size + 1) * classes > MAX_COEFFICIENTS:
        raise ValueError(f"more than {MAX_COEFFICIENTS} coefficients")
    # The intercept is one more place, whose value is 1 in every row.
    full = rows.select(
        F.concat("indices", F.array(F.lit(size))).alias("i"), F.concat("values", F.array(F.lit(1.0))).alias("v"), F.col(label).alias("k"),
    )
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    told = full.agg(F.count(F.lit(1)).alias("n"), F.avg(square).alias("square")).first()
    weights = [[0.0] * (size + 1) for _ in range(classes)]
    if not told["n"]:
        return [w[:size] for w in weights], [0.0] * classes
    n, rate = told["n"], 1.0 / (0.5 * told["square"] + l2)
    moved = [[0.0] * (size + 1) for _ in range(classes)]
    for _ in range(steps):
        sums = full.mapInArrow(_missed(weights), STEP).groupBy("place").agg(
            *[F.sum(f"g{c}").alias(f"g{c}") for c in range(classes)]
        ).collect()
        slopes = [[0.0] * (size + 1) for _ in range(classes)]
        for r in sums:
            for c in range(classes):
                slopes[c][r["place"]] = r[f"g{c}"] / n
        for c in range(classes):
            for j in range(size + 1):
                pull = l2 * weights[c][j] if j < size else 0.0
                moved[c][j] = momentum * moved[c][j] - rate * (slopes[c][j] + pull)
                weights[c][j] += moved[c][j]
    return [w[:size] for w in weights], [w[size] for w in weights]


def unscaled(
    weights: list[list[float]], intercepts: list[float], first: int, means: list[float], scales: list[float],
) -> tuple[list[list[float]], list[float]]:
    """Coefficients for raw numbers from those for standardised ones, which begin at ``first``."""
    out, free = [], []
    for row, b in zip(weights, intercepts):
        raw = [w * s for w, s in zip(row[first:], scales)]
        out.append([*row[:first], *raw])
        free.append(b - sum(w * m for w, m in zip(raw, means)))
    return out, free


def importance(model: LinearModel, spreads: dict[str, float], spark: SparkSession, limit: int = 200) -> DataFrame:
    """(feature, importance): coefficient sizes summed over the classes, times the feature's spread where one is given."""
    rows = []
    for i, name in enumerate(model.names):
        value = sum(abs(w[i]) for w in model.weights) * spreads.get(name, 1.0)
        if value > 0:
            rows.append((name, value))
    table = spark.createDataFrame(rows, "feature string, importance double")
    return table.orderBy(F.desc("importance"), "feature").limit(limit)
