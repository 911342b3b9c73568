"""Scale-out models as column expressions over a small array of training points.

Points are structs ``(x, n, total)``: a scale-out, its number of runs and the sum
of their run times. The models depend on nothing else, so an array is no longer
than the number of different scale-outs however many runs there were.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Machine epsilon of a double, the ridge term of the local regression; a fixed value.
EPSILON = 2.220446049250313e-16


def scale_out_point(x: Column, n: Column, total: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), n.cast("double").alias("n"), total.cast("double").alias("total"))


_SUMS = ("m0", "m1", "m2", "t0", "t1")


def nearest_x(points: Column, at: Column) -> Column:
    """The training scale-out nearest to ``at``."""
    return F.array_min(F.transform(points, lambda p: F.struct(F.abs(p["x"] - at).alias("d"), p["x"].alias("x"))))["x"]


def kernel_terms(x: Column, n: Column, total: Column, at: Column, bandwidth: Column, center: Column) -> dict[str, Column]:
    """What a training point adds to the five sums behind a local regression at ``at``.

    Sums around any ``center`` lead to the same solution. Around the scale-out nearest
    to ``at``, which has the largest weight, they lose no digits to cancellation.
    """
    w = F.exp(-((x - at) * (x - at)) / (F.lit(2.0) * bandwidth * bandwidth))
    u = x - center
    return dict(zip(_SUMS, (w * n, w * n * u, w * n * u * u, w * total, w * total * u)))


def ridge_line(
    sums: Callable[[str], Column], at: Column, center: Column, degree: int = 1, tol: float = EPSILON
) -> Column:
    """Value at ``at`` of the line (or, with degree 0, level) that solves the weighted, ridged system."""
    m0, m1, m2, t0, t1 = map(sums, _SUMS)
    if degree == 0:
        return t0 / (m0 + tol)
    ridge = F.lit(tol)
    top = m2 * t0 - m1 * t1 + (at - center) * (m0 * t1 - m1 * t0) + ridge * (t0 + at * (t1 + center * t0))
    trace = m0 + m2 + F.lit(2.0) * center * m1 + center * center * m0
    return top / (m0 * m2 - m1 * m1 + ridge * trace + ridge * ridge)


def local_regression(
    points: Column, at: Column, bandwidth: Column, degree: int = 1, tol: float = EPSILON
) -> Column:
    """Local regression with Gaussian weights at ``at`` over an array of training points; ``tol`` is its ridge."""
    if degree > 1:
        return _solve_curve(_curve_sums(points, at, bandwidth, degree), at, F.lit(float(tol)))
    center = nearest_x(points, at)

    def add(sums: Column, p: Column) -> Column:
        terms = kernel_terms(p["x"], p["n"], p["total"], at, bandwidth, sums["c"])
        return F.struct(sums["c"].alias("c"), *[(sums[name] + term).alias(name) for name, term in terms.items()])

    start = F.struct(center.alias("c"), *[F.lit(0.0).alias(name) for name in _SUMS])
    return F.aggregate(points, start, add, lambda sums: ridge_line(lambda name: sums[name], at, sums["c"], degree, tol))


def _curve_sums(points: Column, at: Column, bandwidth: Column, degree: int) -> Column:
    """Weighted sums of x^0 to x^(2 degree), then of run time times x^0 to x^degree."""

    def add(sums: Column, p: Column) -> Column:
        w = F.exp(-((p["x"] - at) * (p["x"] - at)) / (F.lit(2.0) * bandwidth * bandwidth))
        terms = [w * p["n"] * F.pow(p["x"], F.lit(k)) for k in range(2 * degree + 1)]
        terms += [w * p["total"] * F.pow(p["x"], F.lit(k)) for k in range(degree + 1)]
        return F.zip_with(sums, F.array(*terms), lambda a, b: a + b)

    return F.aggregate(points, F.array(*[F.lit(0.0)] * (3 * degree + 2)), add)


@F.pandas_udf(T.DoubleType())
def _solve_curve(sums: pd.Series, at: pd.Series, tol: pd.Series) -> pd.Series:
    """Values at ``at`` of polynomials that solve the weighted, ridged systems given by their sums."""
    if not len(sums):
        return pd.Series([], dtype="float64")
    table = np.stack(sums.to_numpy())
    size = (table.shape[1] + 1) // 3
    power = np.arange(size)
    system = table[:, power[:, None] + power[None, :]] + tol.to_numpy()[:, None, None] * np.eye(size)
    solved = np.linalg.solve(system, table[:, 2 * size - 1:, None])[:, :, 0]
    return pd.Series((solved * at.to_numpy()[:, None] ** power).sum(axis=1))


def regress_each(rows: DataFrame, keys: Sequence[str], bandwidths: Sequence[float]) -> DataFrame:
    """``(keys..., bw, predicted)`` for rows ``(keys..., points)`` at the scale-out ``at``, one of the keys.

    The five sums are plain grouped sums over the exploded points and bandwidths.
    """
    centered = rows.select(*keys, nearest_x(F.col("points"), F.col("at")).alias("center"), "points")
    each = centered.select(*keys, "center", F.inline("points")).select(
        "*", F.explode(number_array(bandwidths)).alias("bw")
    )
    at, bw, center = F.col("at"), F.col("bw"), F.col("center")
    terms = kernel_terms(F.col("x"), F.col("n"), F.col("total"), at, bw, center)
    sums = each.groupBy(*keys, "center", "bw").agg(*[F.sum(term).alias(name) for name, term in terms.items()])
    return sums.select(*keys, "bw", ridge_line(F.col, at, center).alias("predicted"))


def ernest_features(x: Column) -> list[Column]:
    """1, 1/x, log x and x."""
    x = x.cast("double")
    return [F.lit(1.0), F.lit(1.0) / x, F.log(x), x]


def ernest_value(coefficients: Column, x: Column) -> Column:
    terms = [F.element_at(coefficients, k + 1) * f for k, f in enumerate(ernest_features(x))]
    return terms[0] + terms[1] + terms[2] + terms[3]


def ernest_products(x: Column, n: Column, total: Column) -> list[Column]:
    """The 10 products of feature pairs and the 4 of features and run time, whose sums fix the fit."""
    f = ernest_features(x)
    return [n * f[i] * f[j] for i in range(4) for j in range(i, 4)] + [total * f[i] for i in range(4)]


def ernest_sums(points: Column) -> Column:
    """The 14 sums of products over an array of points, as an array."""

    def add(sums: Column, p: Column) -> Column:
        return F.zip_with(sums, F.array(*ernest_products(p["x"], p["n"], p["total"])), lambda a, b: a + b)

    return F.aggregate(points, F.array(*[F.lit(0.0)] * 14), add)


# A larger set of columns has to explain more than rounding errors.
_LEAST_GAIN = 1e-13


def nonnegative_fit(gram: np.ndarray, moment: np.ndarray) -> np.ndarray:
    """Least squares with coefficients >= 0 for a stack of small problems, given their products.

    The optimum is the unconstrained optimum on some subset of columns, and there are
    few columns, so every subset is solved and the best feasible one kept. Small sets
    come first and need no more columns than the data can tell apart.
    """
    size = moment.shape[1]
    scale = np.sqrt(np.maximum(np.einsum("bii->bi", gram), 1e-300))
    gram = gram / scale[:, :, None] / scale[:, None, :]
    moment = moment / scale
    best = np.zeros_like(moment)
    best_value = np.zeros(len(moment))
    subsets = [list(cols) for count in range(1, size + 1) for cols in combinations(range(size), count)]
    for cols in subsets:
        sub = gram[:, cols][:, :, cols]
        solvable = np.flatnonzero(np.linalg.eigvalsh(sub)[:, 0] > 1e-11)
        if not len(solvable):
            continue
        found = np.linalg.solve(sub[solvable], moment[solvable][:, cols][:, :, None])[:, :, 0]
        value = -(found * moment[solvable][:, cols]).sum(axis=1)
        better = (found >= 0).all(axis=1) & (value < best_value[solvable] * (1 + _LEAST_GAIN))
        rows = solvable[better]
        best[rows] = 0.0
        best[rows[:, None], cols] = found[better]
        best_value[rows] = value[better]
    return best / scale


def _solve_sums(sums: np.ndarray) -> np.ndarray:
    gram = np.zeros((len(sums), 4, 4))
    upper = np.triu_indices(4)
    gram[:, upper[0], upper[1]] = sums[:, :10]
    gram[:, upper[1], upper[0]] = sums[:, :10]
    return nonnegative_fit(gram, sums[:, 10:])


@F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
def fit_each(problems: pd.Series) -> pd.Series:
    """Coefficients for each problem of a row: array of 14 sums -> array of 4 coefficients."""
    counts = [len(row) for row in problems]
    if not sum(counts):
        return pd.Series([[] for _ in counts], dtype="object")
    sums = np.array([np.asarray(sums, dtype="float64") for row in problems for sums in row])
    fitted = np.split(_solve_sums(sums), np.cumsum(counts)[:-1])
    return pd.Series([list(map(list, rows)) for rows in fitted])


def relative_deviation(predicted: Column, actual: Column) -> Column:
    return F.abs((predicted - actual) / actual)


def mean_of(values: Column, size: Column) -> Column:
    """Mean of an array of doubles of known size."""
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b) / size


def number_array(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])
