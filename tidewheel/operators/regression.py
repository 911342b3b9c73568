"""Least squares by full-batch gradient descent.

The gradient of a squared loss over all rows is ``G w - b`` with the mean
products ``G = avg(x x')`` and ``b = avg(x y)``. One pass over the data yields
both, and the descent itself needs no further pass, whatever its step count.
Points too wide for that take one pass per step instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Widest point for which the products are aggregated column by column.
MAX_PRODUCT_COLUMNS = 8
# Widest point for which the matrix of products is formed at all: 128 MB on the driver.
MAX_PRODUCT_WIDTH = 4096
# Side of the square tiles that matrix is summed in.
TILE = 64
# Into how many sums per tile those of all tasks are added first.
FAN_IN = 256


def mean_products(points: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """``avg(x x')`` and ``avg(x label)`` of points ``(label, features)``, in one pass, which checks their width too."""
    if width <= MAX_PRODUCT_COLUMNS:
        x = [F.get("features", F.lit(k)) for k in range(width)]
        pairs = [(i, j) for i in range(width) for j in range(i, width)]
        row = points.agg(
            *[F.avg(x[i] * x[j]) for i, j in pairs], *[F.avg(x[i] * F.col("label")) for i in range(width)], *_widths()
        ).first()
        _same_width(*row[-2:])
        gram = np.zeros((width, width))
        for (i, j), value in zip(pairs, row):
            gram[i, j] = gram[j, i] = value
        return gram, np.array(row[len(pairs) : -2], dtype="float64")

    # A point's columns are its features, its label and 1.
    columns = width + 2
    padded = -(-columns // TILE) * TILE
    gram = np.zeros((padded, padded))
    tiles = _tiles(points, width, padded).collect()
    _same_width(min(t["least"] for t in tiles), max(t["most"] for t in tiles))
    for i, j, part, _, _ in tiles:
        at = slice(i, i + TILE), slice(j, j + TILE)
        gram[at] = np.frombuffer(part).reshape(TILE, TILE)
        gram[at[::-1]] = gram[at].T
    gram /= gram[columns - 1, columns - 1]
    return gram[:width, :width], gram[:width, width]


def _tiles(points: DataFrame, width: int, padded: int) -> DataFrame:
    """``(i, j, part)``: the sums of products of columns from ``i`` with columns from ``j``, as bytes, for i <= j.

    Beside them are the ``least`` and the ``most`` features of a point; with others than ``width`` sums are void.
    A task sends its sums once; sums of the same tile are added in two rounds, so that no task
    adds those of more than ``1 / FAN_IN`` of all tasks at once.
    """
    starts = range(0, padded, TILE)

    def sums_of_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, least, most = None, width, width
        for batch in batches:
            if len(batch):
                sizes = batch["features"].map(len)
                least, most = min(least, int(sizes.min())), max(most, int(sizes.max()))
                if least != most:
                    total = np.zeros((padded, padded))
                    break
                z = np.zeros((len(batch), padded))
                z[:, :width] = np.stack(batch["features"].to_numpy())
                z[:, width] = batch["label"]
                z[:, width + 1] = 1.0
                total = np.zeros((padded, padded)) if total is None else total
                for i in starts:
                    total[i : i + TILE, i:] += z[:, i : i + TILE].T @ z[:, i:]
        if total is not None:
            group = TaskContext.get().partitionId() % FAN_IN
            for i in starts:
                rows = [(i, j, group, total[i : i + TILE, j : j + TILE].tobytes(), least, most) for j in starts if j >= i]
                yield pd.DataFrame(rows, columns=["i", "j", "group", "part", "least", "most"])

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict = {}
        for batch in batches:
            for i, j, group, part, least, most in batch.itertuples(index=False):
                value = np.frombuffer(part)
                key = (i, j, group)
                if key in totals:
                    before, low, high = totals[key]
                    totals[key] = before + value, min(low, least), max(high, most)
                else:
                    totals[key] = value, least, most
        for (i, j, group), (value, least, most) in totals.items():
            yield pd.DataFrame({"i": [i], "j": [j], "group": [group], "part": [value.tobytes()], "least": [least], "most": [most]})

    schema = "i int, j int, group int, part binary, least int, most int"
    return (
        points.select("features", F.col("label").cast("double").alias("label"))
        .mapInPandas(sums_of_task, schema)
        .repartition("i", "j", "group")
        .mapInPandas(added, schema)
        .withColumn("group", F.lit(0))
        .repartition("i", "j")
        .mapInPandas(added, schema)
        .drop("group")
    )


def _sum_over_batches(points: DataFrame, part: Callable[[np.ndarray, np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """Sum of ``part(features, labels)``, a short vector, over all rows: per task first, then in Spark."""

    def reduce_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            if len(batch):
                value = part(np.stack(batch["features"].to_numpy()).astype("float64"), batch["label"].to_numpy("float64"))
                total = value if total is None else total + value
        if total is not None:
            yield pd.DataFrame({"pos": np.arange(len(total)), "value": total})

    rows = (
        points.select("features", F.col("label").cast("double").alias("label"))
        .mapInPandas(reduce_task, "pos int, value double")
        .groupBy("pos")
        .agg(F.sum("value").alias("value"))
        .collect()
    )
    total = np.zeros(len(rows))
    for pos, value in rows:
        total[pos] = value
    return total


def _gradient(points: DataFrame, width: int) -> tuple[Callable[[np.ndarray], np.ndarray], Callable[[], None]]:
    """The full-batch gradient as a function of the weights, and a call that frees what it holds."""
    if width <= MAX_PRODUCT_WIDTH:
        gram, moment = mean_products(points, width)
        return (lambda w: gram @ w - moment), (lambda: None)

    held = points.select("label", "features").persist(StorageLevel.MEMORY_AND_DISK)
    _same_width(*held.agg(*_widths()).first())

    def by_pass(w: np.ndarray) -> np.ndarray:
        total = _sum_over_batches(
            held, lambda x, y: np.concatenate([x.T @ (x @ w - y), [len(y)]]), width
        )
        return total[:-1] / total[-1]

    return by_pass, held.unpersist


def _widths() -> tuple[Column, Column]:
    return F.min(F.size("features")), F.max(F.size("features"))


def _width(points: DataFrame) -> int:
    """The number of features of a point; whether all have as many is seen in the pass over them."""
    some = points.select(F.size("features").alias("n")).where(F.col("n").isNotNull()).first()
    if some is None:
        raise ValueError("no points")
    return some["n"]


def _same_width(least: int, most: int) -> None:
    """Points of unequal width are an error."""
    if least != most:
        raise ValueError(f"points have {least} to {most} features")


def _weights(points: DataFrame, weights: np.ndarray, steps: int) -> DataFrame:
    rows = [(k, float(w), steps) for k, w in enumerate(weights)]
    return points.sparkSession.createDataFrame(rows, "pos int, weight double, steps int")


def linear_regression_bgd(
    data: DataFrame, iters: int = 10, lr: float = 0.01, init: tuple[float, float] = (0.0, 0.0)
) -> DataFrame:
    """``(theta0, theta1)`` of ``y = theta0 + theta1 x`` over ``data(x, y)`` after ``iters`` steps."""
    x, y = F.col("x"), F.col("y")
    mx, my, mxx, mxy = data.agg(F.avg(x), F.avg(y), F.avg(x * x), F.avg(x * y)).first()
    t0, t1 = (float(t) for t in init)
    for _ in range(iters):
        t0, t1 = t0 - lr * (t0 + t1 * mx - my), t1 - lr * (t0 * mx + t1 * mxx - mxy)
    return data.sparkSession.createDataFrame([(t0, t1)], "theta0 double, theta1 double")


def linear_regression_sgd(
    points: DataFrame,
    iters: int = 100,
    step: float = 1.0,
    reg: float = 0.01,
    l2: bool = True,
    tol: float = 0.001,
) -> DataFrame:
    """``(pos, weight, steps)`` from zero weights with step ``step / sqrt(t)`` and an L2 penalty.

    Stops after a step t > 1 that moved the weights by less than ``tol * max(|w|, 1)``.
    """
    gradient, free = _gradient(points, width := _width(points))
    w = np.zeros(width)
    done = 0
    for t in range(1, iters + 1):
        rate = step / np.sqrt(t)
        shrink = 1.0 - rate * reg if l2 else 1.0
        moved = w * shrink - rate * gradient(w)
        change = np.linalg.norm(moved - w)
        w, done = moved, t
        if t > 1 and change < tol * max(np.linalg.norm(w), 1.0):
            break
    free()
    return _weights(points, w, done)


def sgd_least_squares(
    points: DataFrame,
    iters: int = 50,
    step: float = 0.1,
    decay: str = "sqrt",
    fit_intercept: bool = False,
) -> DataFrame:
    """``(pos, weight, steps)`` of plain gradient descent; ``decay`` is ``sqrt`` or ``none``.

    With ``fit_intercept`` a last weight belongs to a constant feature.
    """
    if decay not in ("sqrt", "none"):
        raise ValueError(f"unknown decay {decay!r}")
    if fit_intercept:
        points = points.select("label", F.concat("features", F.array(F.lit(1.0))).alias("features"))
    gradient, free = _gradient(points, width := _width(points))
    w = np.zeros(width)
    for t in range(1, iters + 1):
        w = w - (step / np.sqrt(t) if decay == "sqrt" else step) * gradient(w)
    free()
    return _weights(points, w, iters)


def squared_error(points: DataFrame, weights: Sequence[float]) -> DataFrame:
    """``(mse)`` of a linear model on points; a point of another width than the model is an error."""
    width = F.size("features")
    wrong = F.raise_error(F.concat(F.lit(f"a point does not have {len(weights)} features but "), width.cast("string")))
    points = points.withColumn("features", F.when(width == len(weights), F.col("features")).otherwise(wrong))
    fit = sum((F.element_at("features", k + 1) * F.lit(float(w)) for k, w in enumerate(weights)), F.lit(0.0))
    return points.agg(F.avg((fit - F.col("label")) * (fit - F.col("label"))).alias("mse"))
