"""Generated inputs for the iterative jobs.

Each generator takes a table of row positions, such as ``spark.range(n)``, and
derives every row from its position and the seed alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.functions.hashing import hash_normal, hash_uniform

# Default seed of the generators; a fixed value.
DEFAULT_SEED = 4650285087650871364

_MEANS, _CENTERS, _CHOICE, _NOISE = 101, 102, 103, 104


def _uniform_plane(spark: SparkSession, k: int, value_range: float, seed: int, stream: int) -> DataFrame:
    pos = F.col("id")
    return spark.range(k).select(
        pos.cast("int").alias("id"),
        *[
            (hash_uniform(seed, pos, stream * 10 + axis) * value_range - value_range / 2).alias(name)
            for axis, name in enumerate("xy")
        ],
    )


def gen_kmeans_centers(spark: SparkSession, k: int, value_range: float = 100.0, seed: int = DEFAULT_SEED) -> DataFrame:
    """``(id, x, y)``: k start centres, drawn independently of the true means, with 2 decimals."""
    drawn = _uniform_plane(spark, k, value_range, seed, _CENTERS)
    return drawn.select("id", F.round("x", 2).alias("x"), F.round("y", 2).alias("y"))


def kmeans_means(spark: SparkSession, k: int, value_range: float = 100.0, seed: int = DEFAULT_SEED) -> list[tuple[float, float]]:
    """The k true means around which ``gen_kmeans_points`` scatters points."""
    return [(r.x, r.y) for r in _uniform_plane(spark, k, value_range, seed, _MEANS).orderBy("id").collect()]


def gen_kmeans_points(
    positions: DataFrame,
    k: int,
    stddev: float = 0.08,
    value_range: float = 100.0,
    seed: int = DEFAULT_SEED,
    skew: Sequence[int] | None = None,
    pos: str = "id",
) -> DataFrame:
    """``(x, y, mean_id)``: a point per position, normal around a mean picked by the skew weights.

    Means are equally likely unless there is exactly one weight for each.
    """
    means = kmeans_means(positions.sparkSession, k, value_range, seed)
    weights = list(skew) if skew is not None and len(skew) == k else [1] * k
    total = float(sum(weights))
    at = F.col(pos)

    bounds, reached = [], 0.0
    for weight in weights[:-1]:
        reached += weight / total
        bounds.append(reached)
    # Draws come in [0, 1), so the number of bounds at or below a draw is its mean.
    draw = hash_uniform(seed, at, _CHOICE)
    reached_by = F.filter(F.array(*map(F.lit, bounds)).cast("array<double>"), lambda bound: bound <= F.col("_draw"))
    picked = positions.select(at, draw.alias("_draw")).select(at, F.size(reached_by).alias("mean_id"))

    def coordinate(axis: int) -> Column:
        table = F.array(*[F.lit(mean[axis]) for mean in means])
        noise = hash_normal(seed, at, _NOISE + axis) * F.lit(stddev * value_range)
        return F.round(noise + F.get(table, F.col("mean_id")), 2)

    return picked.select(coordinate(0).alias("x"), coordinate(1).alias("y"), "mean_id")


def gen_linreg(positions: DataFrame, seed: int = DEFAULT_SEED, pos: str = "id") -> DataFrame:
    """``(x, y)``: x standard normal, y = 2x + 0.01 noise, with 2 decimals."""
    at = F.col(pos)
    drawn = positions.select(hash_normal(seed, at, 0).alias("x"), hash_normal(seed, at, 1).alias("noise"))
    return drawn.select(
        F.round("x", 2).alias("x"), F.round(F.lit(2.0) * F.col("x") + F.lit(0.01) * F.col("noise"), 2).alias("y")
    )


def gen_polynomial_features(positions: DataFrame, dim: int, seed: int = DEFAULT_SEED, pos: str = "id") -> DataFrame:
    """``(label, features)``: powers 0..dim-1 of x in [0, 1), label 2x + 10 + standard normal noise."""
    at = F.col(pos)
    drawn = positions.select(hash_uniform(seed, at, 0).alias("x"), hash_normal(seed, at, 1).alias("noise"))
    powers = F.array(*[F.pow(F.col("x"), F.lit(k)) for k in range(dim)])
    return drawn.select((F.lit(2.0) * F.col("x") + 10.0 + F.col("noise")).alias("label"), powers.alias("features"))


def polynomial_lines(points: DataFrame, layout: str = "label_first") -> DataFrame:
    """``(value)``: points as text, ``label,f1 f2 ...`` or, with ``label_last``, ``f1 f2 ... label``."""
    features = F.array_join(F.transform("features", lambda v: v.cast("string")), " ")
    if layout == "label_first":
        return points.select(F.concat_ws(",", F.col("label").cast("string"), features).alias("value"))
    if layout == "label_last":
        return points.select(F.concat_ws(" ", features, F.col("label").cast("string")).alias("value"))
    raise ValueError(f"unknown layout {layout!r}")
