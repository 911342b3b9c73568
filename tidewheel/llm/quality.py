"""Quality classifier: regularised quadratic discriminant analysis of document statistics.

Each class has a mean and a covariance shrunk towards the pooled one and towards its own
diagonal. The score is the posterior of class 1 from the difference of the two
log-densities, with Mahalanobis distances through cached Cholesky factors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

FEATURES = (
    "length",
    "distinct",
    "in_a_row",
    "capitals",
    "symbols",
    "marks",
    "word_length",
    "line_repeats",
    "digits",
)
_CAPITALS = np.zeros(256, bool)
_CAPITALS[ord("A") : ord("Z") + 1] = True
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>{}[]~^_=+@\\")] = True
_MARKS = np.zeros(256, bool)
_MARKS[list(b"!?")] = True
_DIGITS = np.zeros(256, bool)
_DIGITS[ord("0") : ord("9") + 1] = True
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1)]] = True


def _share(part: float, whole: float) -> float:
    """A share with its variance evened out."""
    return math.asin(math.sqrt(min(1.0, part / whole))) if whole else 0.0


def statistics(text: str | None) -> tuple[float, ...]:
    """The transformed statistics of a whole text; all 0 if it has no word."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return (0.0,) * len(FEATURES)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    letters = int(counts[_LETTERS].sum())
    chars = sum(map(len, words))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return (
        math.log1p(n),
        len(set(words)) / n**0.9,
        _share(sum(map(eq, words, words[1:])), n),
        _share(int(counts[_CAPITALS].sum()), letters),
        _share(int(counts[_SYMBOLS].sum()), chars),
        _share(int(counts[_MARKS].sum()), n),
        math.log(chars / n),
        _share(len(lines) - len(set(lines)), len(lines)),
        _share(int(counts[_DIGITS].sum()), chars),
    )


def features(text: Column) -> Column:
    """The statistics of a text as an array of doubles; those of an empty text for null."""

    @pandas_udf("array<double>")
    def of(texts):
        return texts.map(statistics)

    return of(F.coalesce(text, F.lit("")))


@dataclass
class Discriminant:
    """Means, lower Cholesky factors and log-priors of classes 0 and 1; None for a class without rows."""

    means: list[np.ndarray | None]
    factors: list[np.ndarray | None]
    log_priors: list[float]
    _inverse: list[np.ndarray | None] = field(init=False)
    _log_dets: list[float] = field(init=False)

    def __post_init__(self):
        self._inverse = [None if f is None else np.linalg.inv(f) for f in self.factors]
        self._log_dets = [0.0 if f is None else float(np.log(np.diag(f)).sum()) for f in self.factors]

    def log_density(self, x: np.ndarray, k: int) -> np.ndarray:
        z = (x - self.means[k]) @ self._inverse[k].T
        return -0.5 * np.einsum("ij,ij->i", z, z) - self._log_dets[k] + self.log_priors[k]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1; 0.5 if nothing was learned, 0 or 1 if only one class was seen."""
        seen = [m is not None for m in self.means]
        if not all(seen):
            return np.full(len(x), 0.5 if not any(seen) else float(seen[1]))
        odds = np.clip(self.log_density(x, 1) - self.log_density(x, 0), -700, 700)
        return 1 / (1 + np.exp(-odds))


def fit(
    rows: DataFrame, label: str = "label", column: str = "features", pool: float = 0.1, diagonal: float = 0.1,
    floor: float = 1e-3,
) -> Discriminant:
    """Learn from all rows of ``column`` (array of doubles) and ``label`` (0 or 1; others are left out).

    One aggregation sums rows, values and products per class; ``pool`` is the weight of the
    pooled covariance, ``diagonal`` that of a class's own diagonal, ``floor`` is added to
    each variance.
    """
    d = len(FEATURES)
    x = [F.col(column)[i] for i in range(d)]
    sums = [F.sum(v).alias(f"s{i}") for i, v in enumerate(x)]
    products = [F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i in range(d) for j in range(i, d)]
    found = {
        int(r["label"]): r
        for r in rows.where(F.col(label).isin(0, 1))
        .groupBy(F.col(label).alias("label"))
        .agg(F.count("*").alias("n"), *sums, *products)
        .collect()  # two rows
    }
    total = sum(r["n"] for r in found.values())
    means, spreads, priors = [], [], []
    for k in (0, 1):
        r = found.get(k)
        if r is None:
            means.append(None)
            spreads.append(None)
            priors.append(0.0)
            continue
        mean = np.array([r[f"s{i}"] for i in range(d)]) / r["n"]
        second = np.zeros((d, d))
        for i in range(d):
            for j in range(i, d):
                second[i, j] = second[j, i] = r[f"p{i}_{j}"] / r["n"]
        means.append(mean)
        spreads.append(second - np.outer(mean, mean))
        priors.append(math.log(r["n"] / total))
    pooled = sum((spreads[k] * found[k]["n"] / total for k in found), np.zeros((d, d)))
    factors = []
    for spread in spreads:
        if spread is None:
            factors.append(None)
            continue
        own = (1 - diagonal) * spread + diagonal * np.diag(np.diag(spread))
        factors.append(np.linalg.cholesky((1 - pool) * own + pool * pooled + floor * np.eye(d)))
    return Discriminant(means, factors, priors)


def score(column: Column, model: Discriminant) -> Column:
    """Probability of label 1, from an array of statistics."""

    @pandas_udf("double")
    def of(rows):
        import pandas as pd

        if not len(rows):
            return pd.Series([], dtype="float64")
        return pd.Series(model.score(np.stack(rows.to_numpy())))

    return of(column)


def labelled(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality") -> DataFrame:
    """``docs`` with ``label`` (0 or 1) from ``labels``; of several labels of one key the mean counts, from 0.5 on as 1."""
    of_key = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(key).agg(
        (F.avg(label) >= 0.5).cast("int").alias("label")
    )
    return docs.join(of_key, key)
