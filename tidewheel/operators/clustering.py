"""K-means from given centres, the library's own initialisation, and the cost of a clustering."""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.plans.state import checkpointed, materialize

# Up to this many centres are literals of a nearest-centre expression.
_UNROLLED_CENTERS = 64
# Centres of a block, where there are more, and blocks at most; beyond, blocks get larger.
_BLOCK_CENTERS, _BLOCKS = 256, 65_536
# Places that meet a block in one group.
_BLOCK_PLACES = 65_536
_CENTER = "id int, x double, y double"

Centers = DataFrame | Iterable[Sequence[float]]


def _listed(rows) -> list[tuple[int, float, float]]:
    return sorted((int(i), float(x), float(y)) for i, x, y in rows)


def center_rows(centers: Centers) -> list[tuple[int, float, float]] | DataFrame:
    """Centres ``(id, x, y)``: a list ordered by id if they are few, else a table, which stays on Spark."""
    if isinstance(centers, DataFrame):
        centers = centers.select(F.col("id").cast("int"), F.col("x").cast("double"), F.col("y").cast("double"))
        few = centers.limit(_UNROLLED_CENTERS + 1).collect()
        return _listed(few) if len(few) <= _UNROLLED_CENTERS else centers
    rows = _listed(centers)
    return rows if len(rows) <= _UNROLLED_CENTERS else SparkSession.active().createDataFrame(rows, _CENTER)


def _distance(x: Column, y: Column, cx, cy) -> Column:
    return F.sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy))


def nearest_center(points: DataFrame, centers: Centers) -> DataFrame:
    """Points with ``center_id`` and ``distance`` of the nearest centre; the lowest id wins a tie.

    Without centres, and where no distance is a finite number, the id is -1. A few centres are
    literals, so nothing is shuffled. With more, places of points are looked up once each among
    blocks of centres, and the points are joined with what was found for their place.
    """
    rows = center_rows(centers)
    limit = F.lit(sys.float_info.max)
    if isinstance(rows, DataFrame):
        found = _nearest_of_blocks(_places(points), rows).select(
            F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("d").alias("_d"), F.col("id").alias("_id")
        )
        here = (F.col("x").cast("double") == F.col("_x")) & (F.col("y").cast("double") == F.col("_y"))
        placed, nearest, center = points.join(found, here, "left"), F.col("_d"), F.col("_id")
    elif not rows:
        return points.withColumns({"center_id": F.lit(-1), "distance": limit})
    else:
        names = [f"_d{k}" for k in range(len(rows))]
        found = {n: _distance(F.col("x"), F.col("y"), F.lit(cx), F.lit(cy)) for n, (_, cx, cy) in zip(names, rows)}
        placed = points.withColumns(found)
        placed = placed.withColumn("_best", F.least(*names) if len(names) > 1 else F.col(names[0]))
        nearest = F.col("_best")
        center = F.lit(rows[-1][0])
        for name, (i, _, _) in list(zip(names, rows))[-2::-1]:
            center = F.when(F.col(name) == nearest, F.lit(i)).otherwise(center)
    return placed.select(
        *points.columns,
        F.when(nearest < limit, center).otherwise(F.lit(-1)).alias("center_id"),
        F.least(nearest, limit).alias("distance"),
    )


def _finite(*names: str) -> Column:
    """Whether the columns hold numbers that are neither null, NaN nor infinite."""
    return reduce(and_, (F.abs(F.col(c)) <= F.lit(sys.float_info.max) for c in names))


def _places(points: DataFrame) -> DataFrame:
    """``(x, y, n)``: the finite places of points and how many points there are."""
    xy = points.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return checkpointed(xy.where(_finite("x", "y")).groupBy("x", "y").agg(F.count("*").alias("n")))


class _Blocks:
    """Boxes around the centres of each block, in order of slabs (by x) and of rows within one (by y)."""

    def __init__(self, boxes: np.ndarray, slabs: np.ndarray):
        self.min_x, self.max_x, self.min_y, self.max_y = boxes.T
        first = np.flatnonzero(np.concatenate(([True], slabs[1:] != slabs[:-1])))
        self.ends = np.append(first[1:], len(slabs))
        #: The extent of each slab, and the order of blocks by slab and by y.
        self.left, self.right = np.minimum.reduceat(self.min_x, first), np.maximum.reduceat(self.max_x, first)
        slab = np.repeat(np.arange(len(first)), self.ends - first)
        self.bottom, self.top = _pairs(slab, self.min_y), _pairs(slab, self.max_y)

    def least(self, blocks: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """What the distance from each point to a centre of each block is at least."""
        out_x = np.maximum(np.maximum(self.min_x[blocks] - x, x - self.max_x[blocks]), 0.0)
        out_y = np.maximum(np.maximum(self.min_y[blocks] - y, y - self.max_y[blocks]), 0.0)
        return np.sqrt(out_x * out_x + out_y * out_y)

    def home(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """A block for each point: one whose box it lies in or near, or the nearest box in any slab."""
        blocks = self._row(np.minimum(np.searchsorted(self.right, x), len(self.right) - 1), y)
        near = self.least(blocks, x, y)
        apart = near > np.hypot(self.max_x[blocks] - self.min_x[blocks], self.max_y[blocks] - self.min_y[blocks])
        if apart.any():
            x, y, best, chosen = x[apart], y[apart], near[apart], blocks[apart]
            for slab in range(len(self.right)):
                other = self._row(np.full(len(y), slab), y)
                far = self.least(other, x, y)
                chosen = np.where(far < best, other, chosen)
                best = np.minimum(far, best)
            blocks[apart] = chosen
        return blocks

    def _row(self, slab: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.minimum(np.searchsorted(self.top, _pairs(slab, y)), self.ends[slab] - 1)

    def within(self, x: np.ndarray, y: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a point's position and a block that may hold a centre as near as ``d``."""
        # A little more than d, for what subtracting and squaring round away; then the boxes decide.
        reach = d * (1 + 1e-12) + 1e-150
        first = np.searchsorted(self.right, np.nextafter(x - reach, -np.inf))
        slabs = np.searchsorted(self.left, np.nextafter(x + reach, np.inf), "right") - first
        owner, slab = _spread(first, np.maximum(slabs, 0))
        begin = np.searchsorted(self.top, _pairs(slab, np.nextafter(y - reach, -np.inf)[owner]))
        end = np.searchsorted(self.bottom, _pairs(slab, np.nextafter(y + reach, np.inf)[owner]), "right")
        of, blocks = _spread(begin, np.maximum(end - begin, 0))
        owner = owner[of]
        near = self.least(blocks, x[owner], y[owner]) <= d[owner]
        return owner[near], blocks[near]


def _pairs(slab: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Complex numbers, which numpy orders by slab, then by y."""
    out = np.empty(len(y), np.complex128)
    out.real, out.imag = slab, y
    return out


def _spread(first: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``counts[k]`` numbers from ``first[k]`` on for every k, and the k of each."""
    of = np.repeat(np.arange(len(first)), counts)
    return of, first[of] + np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)


def _blocks(centers: DataFrame) -> tuple[DataFrame, _Blocks | None]:
    """Centres ``(block, id, x, y)``, of those in one place the lowest id, and the boxes of the blocks.

    Centres are cut into slabs by x and each slab by y, into blocks of about ``_BLOCK_CENTERS`` or,
    beyond ``_BLOCKS`` of them, more; only cuts and boxes come to the driver.
    """
    one = centers.where(F.col("id").isNotNull() & _finite("x", "y")).groupBy("x", "y").agg(F.min("id").alias("id"))
    one = checkpointed(one)
    total = one.count()
    if not total:
        return one, None
    size = max(_BLOCK_CENTERS, math.ceil(total / _BLOCKS))

    def cuts(value: str, parts: int) -> Column:
        shares = [k / parts for k in range(1, parts)]
        return F.percentile_approx(value, shares, 10_000) if shares else F.array().cast("array<double>")

    at_x = one.agg(cuts("x", math.ceil(math.sqrt(total / size))).alias("c")).first()["c"]
    slabbed = one.withColumn("slab", _place(np.unique(at_x))("x"))
    most = slabbed.groupBy("slab").count().agg(F.max("count")).first()[0]
    parts = math.ceil(most / size)
    at_y = slabbed.groupBy("slab").agg(cuts("y", parts).alias("c"), F.count("*").alias("n")).collect()
    # A slab with fewer centres takes every second, third, ... cut.
    rows: dict[int, np.ndarray] = {}
    for slab, c, n in at_y:
        every = max(1, parts * size // n)
        rows[slab] = np.unique(c[every - 1 :: every])
    starts = dict(zip(sorted(rows), np.cumsum([0, *(len(rows[k]) + 1 for k in sorted(rows))]).tolist()))

    @F.pandas_udf("int")
    def block(slab: pd.Series, y: pd.Series) -> pd.Series:
        out = np.zeros(len(slab), np.int32)
        for k in slab.unique().tolist():
            at = (slab == k).to_numpy()
            out[at] = starts[k] + np.searchsorted(rows[k], y.to_numpy()[at])
        return pd.Series(out)

    placed = checkpointed(slabbed.select(block("slab", "y").alias("block"), "slab", "id", "x", "y"))
    boxes = placed.groupBy("block", "slab").agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).orderBy("block").collect()
    # Blocks without centres are left out, and the others numbered anew.
    number = _place([b["block"] for b in boxes])("block")
    found = _Blocks(np.array([tuple(b)[2:] for b in boxes]), np.array([b["slab"] for b in boxes]))
    return placed.select(number.alias("block"), "id", "x", "y"), found


def _place(cuts: Sequence[float]) -> Callable[[str], Column]:
    """How many of the ordered ``cuts`` are below a column."""
    cuts = np.array(cuts)

    @F.pandas_udf("int")
    def place(values: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, values.to_numpy()).astype(np.int32))

    return place


def _nearest_of_blocks(places: DataFrame, centers: DataFrame) -> DataFrame:
    """Places ``(x, y, n)`` with the distance ``d`` and the ``id`` of their nearest centre; none without centres.

    A place is compared with the centres of the block it lies in, then with those of all other
    blocks whose boxes are no farther away than the nearest found.
    """
    centers, blocks = _blocks(centers)
    if blocks is None:
        return places.select("*", F.lit(None).cast("double").alias("d"), F.lit(None).cast("int").alias("id")).limit(0)

    @F.pandas_udf("int")
    def home(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(blocks.home(x.to_numpy(), y.to_numpy()).astype(np.int32))

    def further(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, n, block, d = (batch.column(c).to_numpy() for c in ("x", "y", "n", "block", "d"))
            for at in range(0, len(x), 256):
                part = slice(at, at + 256)
                owner, asked = blocks.within(x[part], y[part], d[part])
                other = asked != block[part][owner]
                owner, asked = owner[other] + at, asked[other]
                for k in range(0, len(owner), 1 << 16):
                    of = owner[k : k + (1 << 16)]
                    yield pa.record_batch([x[of], y[of], n[of], asked[k : k + (1 << 16)].astype(np.int32)], ["x", "y", "n", "block"])

    asked = "x double, y double, n long, block int"
    first = checkpointed(_met(places.select("x", "y", "n", home("x", "y").alias("block")), centers))
    again = _met(checkpointed(first.mapInArrow(further, asked)), centers)
    best = F.min(F.struct("d", "id"))
    return first.unionByName(again).groupBy("x", "y").agg(F.first("n").alias("n"), best.alias("b")).select("x", "y", "n", "b.*")


def _met(asked: DataFrame, centers: DataFrame) -> DataFrame:
    """Rows ``(x, y, n, block)`` with distance ``d`` and ``id`` of the nearest centre of the block.

    A block that more than ``_BLOCK_PLACES`` rows ask for is met in several groups. Tasks hold the centres of
    one group, and rows as they come.
    """
    groups = asked.groupBy("block").agg(F.ceil(F.count("*") / _BLOCK_PLACES).cast("int").alias("groups"))
    here = centers.join(groups, "block").select(
        "block", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"), F.lit(None).cast("long").alias("n"), "id", "x", "y"
    )
    group = F.pmod(F.xxhash64("x", "y"), F.col("groups")).cast("int")
    there = asked.join(groups, "block").select("block", group.alias("group"), "n", F.lit(None).cast("int").alias("id"), "x", "y")
    rows = here.unionByName(there).repartition("block", "group")
    # Centres come before places, ordered by id, so that the first of equals is the lowest.
    rows = rows.sortWithinPartitions("block", "group", F.col("id").asc_nulls_last())
    return rows.mapInArrow(_compared, "x double, y double, n long, block int, d double, id int")


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current, held = None, []
    ids, xs, ys = np.empty(0, np.int32), np.empty(0), np.empty(0)
    for batch in batches:
        block, group, x, y = (batch.column(c).to_numpy() for c in ("block", "group", "x", "y"))
        center = batch.column("id").is_valid().to_numpy(zero_copy_only=False)
        number = batch.column("id").fill_null(0).to_numpy()
        change = (block[1:] != block[:-1]) | (group[1:] != group[:-1]) | (center[1:] != center[:-1])
        ends = np.concatenate(([0], np.flatnonzero(change) + 1, [len(block)])).tolist()
        d, best = np.zeros(len(block)), np.zeros(len(block), np.int32)
        for a, b in zip(ends, ends[1:]):
            if a == b:
                continue
            if (block[a], group[a]) != current:
                current, held = (block[a], group[a]), []
            if center[a]:
                held.append((number[a:b], x[a:b], y[a:b]))
                ids, xs, ys = (np.concatenate(c) for c in zip(*held))
                continue
            step = max(1, (1 << 16) // len(ids))
            for k in range(a, b, step):
                rows = slice(k, min(b, k + step))
                out_x, out_y = x[rows, None] - xs, y[rows, None] - ys
                far = np.sqrt(out_x * out_x + out_y * out_y)
                nearest = far.argmin(axis=1)
                d[rows], best[rows] = far[np.arange(len(far)), nearest], ids[nearest]
        place = pa.array(~center)
        found = pa.record_batch([batch.column("x"), batch.column("y"), batch.column("n"), batch.column("block"), d, best], _COMPARED)
        yield found.filter(place)


_COMPARED = ["x", "y", "n", "block", "d", "id"]


def lloyd_step(points: DataFrame, centers: Centers) -> DataFrame:
    """``(id, x, y)``: the mean of the points nearest to each centre; a centre without points is gone.

    Many centres meet each place of points once; points without a finite distance move none of them.
    """
    rows = center_rows(centers)
    if isinstance(rows, DataFrame):
        return _moved(_places(points), rows)
    return (
        nearest_center(points.select("x", "y"), rows)
        .groupBy(F.col("center_id").alias("id"))
        .agg((F.sum("x") / F.count("*")).alias("x"), (F.sum("y") / F.count("*")).alias("y"))
    )


def _moved(places: DataFrame, centers: DataFrame) -> DataFrame:
    found = _nearest_of_blocks(places, centers).where(F.col("d") < F.lit(sys.float_info.max))
    means = ((F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c) for c in "xy")
    return found.groupBy("id").agg(*means)


def kmeans(
    points: DataFrame,
    centers: Centers,
    iters: int = 10,
    path: str | None = None,
    final_step: str = "last",
    cache: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """``(points with center_id, centres)`` after ``iters`` steps from the given centres.

    With ``path`` the centres of step i are written to ``iteration_i`` and the next
    step reads them from there. ``final_step="previous"`` assigns the points with the
    centres of the step before the last one.
    """
    if final_step not in ("last", "previous"):
        raise ValueError(f"unknown final step {final_step!r}")
    if final_step == "previous" and iters < 2:
        raise ValueError("there is no previous step")
    spark = points.sparkSession
    xy = points.select("x", "y")
    current = center_rows(centers)
    # Many centres meet places, which are counted once for all steps.
    places = _places(xy) if isinstance(current, DataFrame) and iters else None
    if cache and iters > 1 and places is None:
        xy = xy.persist(StorageLevel.MEMORY_AND_DISK)
    before = current
    for step in range(1, iters + 1):
        before = current
        moved = _moved(places, current) if isinstance(current, DataFrame) else lloyd_step(xy, current)
        if path is not None:
            moved = materialize(moved, path, step, single_file=True)
        elif isinstance(current, DataFrame):
            moved = checkpointed(moved)
        current = center_rows(moved)
    xy.unpersist()
    chosen = before if final_step == "previous" else current
    clustered = nearest_center(points, chosen).drop("distance")
    return clustered, chosen if isinstance(chosen, DataFrame) else spark.createDataFrame(chosen, _CENTER)


def nearest_vector(points: DataFrame, centers: Sequence[Sequence[float]], features: str = "features") -> DataFrame:
    """Points of any width with ``center_id`` (position in ``centers``) and squared ``cost``."""
    table = np.asarray(centers, dtype="float64")

    @F.pandas_udf("center_id int, cost double")
    def nearest(batch: pd.Series) -> pd.DataFrame:
        rows = np.stack(batch.to_numpy()).astype("float64") if len(batch) else np.empty((0, table.shape[1]))
        cost = np.stack([((rows - center) ** 2).sum(axis=1) for center in table], axis=1)
        best = cost.argmin(axis=1)
        return pd.DataFrame({"center_id": best.astype("int32"), "cost": cost[np.arange(len(rows)), best]})

    return points.withColumn("_n", nearest(features)).select(*points.columns, "_n.center_id", "_n.cost")


def wssse(points: DataFrame, centers: Sequence[Sequence[float]], features: str = "features") -> DataFrame:
    """``(wssse)``: the sum of squared distances to the nearest centre."""
    return nearest_vector(points.select(features), centers, features).agg(F.sum("cost").alias("wssse"))


def kmeans_auto(points: DataFrame, k: int, iters: int = 20, seed: int = 1, features: str = "features"):
    """``(points with center_id, centres, training cost)`` by the library's k-means with its own start."""
    vectors = points.withColumn("_vector", array_to_vector(F.col(features)))
    model = KMeans(
        k=k, maxIter=iters, seed=seed, initMode="k-means||", featuresCol="_vector", predictionCol="center_id"
    ).fit(vectors)
    clustered = model.transform(vectors).drop("_vector")
    return clustered, [list(map(float, c)) for c in model.clusterCenters()], model.summary.trainingCost
