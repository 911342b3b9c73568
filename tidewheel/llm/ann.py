"""Approximate nearest neighbours by cosine: inverted lists with an adaptive dimension scan.

Unit vectors are turned by a random rotation, so that every block of columns holds an equal
share of a distance. Within each probed list a scan goes through the blocks of columns and
drops a candidate as soon as a test on its partial distance says that it is farther than
the nearest found so far.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.llm.common import checkpointed


#: Rows that a task holds at once while it deals vectors to lists.
_EMITTED = 1 << 14


@dataclass(frozen=True)
class Params:
    """``sample`` vectors at most are fitted; there is a list for ``per_list`` vectors, up to ``most_lists``.

    As many lists are probed as hold ``coverage`` of the ``k`` nearest that ``asked`` vectors of
    the sample have in the sample, so vectors without clusters get more probes. ``tolerance``
    is the bound of the test: with 2.1, about one true neighbour in a thousand is dropped.
    ``block`` is how many candidates, and how many queries, share a task's block.
    """

    sample: int = 16384
    per_list: int = 1024
    most_lists: int = 4096
    coverage: float = 0.97
    asked: int = 512
    tolerance: float = 2.1
    block: int = 4096
    chunk: int = 512
    columns: int = 16
    rounds: int = 8
    seed: int = 42


def usable(vector: Column) -> Column:
    """Whether a vector takes part: neither null, empty nor zero, and all its components finite."""
    finite = F.forall(
        vector,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")),
    )
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _unit(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _centres(sample: np.ndarray, lists: int, p: Params) -> np.ndarray:
    """Centres of ``lists`` groups of unit vectors, by rounds of k-means on the sample."""
    rng = np.random.default_rng(p.seed)
    centres = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)]
    for _ in range(p.rounds):
        nearest = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        filled = np.linalg.norm(sums, axis=1) > 1e-12
        centres = centres.copy()
        centres[filled] = sums[filled] / np.linalg.norm(sums[filled], axis=1, keepdims=True)
    return centres


def _probes(sample: np.ndarray, centres: np.ndarray, k: int, p: Params) -> int:
    """Lists, nearest first, that hold ``coverage`` of the nearest within the sample."""
    asked = min(p.asked, len(sample))
    if len(sample) < 2:
        return len(centres)
    close = sample[:asked] @ sample.T
    close[np.arange(asked), np.arange(asked)] = -np.inf
    k = min(k, len(sample) - 1)
    nearest = np.argpartition(-close, k - 1, axis=1)[:, :k]
    own = (sample @ centres.T).argmax(axis=1)
    ranks = np.argsort(np.argsort(-(sample[:asked] @ centres.T), axis=1), axis=1)
    found = ranks[np.arange(asked)[:, None], own[nearest]]
    return int(np.quantile(found, p.coverage, method="higher")) + 1


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _scan(rows: np.ndarray, query: np.ndarray, k: int, p: Params, own: np.ndarray) -> np.ndarray:
    """Places of rows that may be among the ``k`` nearest of a query (rotated unit vectors)."""
    dim = rows.shape[1]
    bound = np.inf
    places, distances = [], []
    for at in range(0, len(rows), p.chunk):
        alive = np.flatnonzero(~own[at : at + p.chunk]) + at
        partial = np.zeros(len(alive))
        for low in range(0, dim, p.columns):
            high = min(dim, low + p.columns)
            gap = rows[alive, low:high] - query[low:high]
            partial = partial + np.einsum("ij,ij->i", gap, gap)
            if np.isfinite(bound) and len(alive):
                slack = 1.0 if high == dim else (1 + p.tolerance / np.sqrt(high)) ** 2
                near = partial * (dim / high) <= bound * slack + 1e-9
                alive, partial = alive[near], partial[near]
        places.append(alive)
        distances.append(partial)
        known = np.concatenate(distances)
        if len(known) >= k:
            bound = float(np.partition(known, k - 1)[k - 1])
    places, distances = np.concatenate(places), np.concatenate(distances)
    return places[distances <= bound + 1e-9]


def _sums(x: np.ndarray) -> np.ndarray:
    """Sums of rows from left to right, so that equal vectors have equal scores everywhere."""
    return x.cumsum(axis=1)[:, -1]


def _search(
    candidates: pa.Table, queries: pa.Table, k: int, p: Params, turn: np.ndarray
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its ``k`` nearest of a block, with exact cosines of the vectors as given."""
    ids = candidates.column("vec_id").to_numpy()
    x = _matrix(candidates.column("vector").combine_chunks())
    rows = _unit(x) @ turn
    norms = np.sqrt(_sums(x * x))
    q = _matrix(queries.column("vector").combine_chunks())
    turned, own_norms = _unit(q) @ turn, np.sqrt(_sums(q * q))
    for i, query_id in enumerate(queries.column("vec_id").to_pylist()):
        near = _scan(rows, turned[i], k, p, ids == query_id)
        scores = _sums(x[near] * q[i]) / (norms[near] * own_norms[i])
        order = np.lexsort((ids[near], -scores))[:k]
        yield query_id, ids[near][order], scores[order]


def search(
    vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding",
    params: Params = Params(),
) -> DataFrame:
    """``k`` nearest of each query: query_id, rank (int, from 1), vec_id, score (double, cosine).

    ``queries`` are searched among all ``vectors`` but their own key; both have ``key`` and
    ``vector``. Ties go to the smaller key. Vectors that are not ``usable``, rows without key and
    vectors of another length than most take no part. Of rows with one key the smallest vector
    counts. Every usable vector is in a list; only the lists' centres and the number of probes
    come from a sample, chosen by a hash of the key. No queries or no other vectors, no result.

    A list that is too long for a block is dealt over several by a hash of the key, and so are
    its queries.
    """
    p = params

    def prepared(df: DataFrame) -> DataFrame:
        values = F.col(vector).cast("array<double>")
        return (
            df.where(F.col(key).isNotNull() & usable(F.col(vector)))
            .groupBy(F.col(key).cast("long").alias("vec_id"))
            .agg(F.min(values).alias("vector"))
        )

    rows = checkpointed(prepared(vectors))
    shape = (
        rows.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    )
    schema = "query_id long, vec_id long, score double"
    if shape is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, total = shape["dim"], shape["n"]
    rows = rows.where(F.size("vector") == dim)
    sample = rows.orderBy(F.xxhash64("vec_id", F.lit(p.seed)), "vec_id").limit(p.sample).toArrow()
    lists = max(1, min(p.most_lists, total // p.per_list))
    known = _unit(_matrix(sample.column("vector").combine_chunks()))
    centres = _centres(known, lists, p)
    lists = len(centres)
    probes = _probes(known, centres, k, p)

    def nearest(batches: Iterator[pa.RecordBatch], count: int) -> Iterator[pa.RecordBatch]:
        step = max(1, _EMITTED // count)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                close = _unit(_matrix(part.column("vector"))) @ centres.T
                found = np.argpartition(-close, count - 1, axis=1)[:, :count]
                taken = part.take(pa.array(np.repeat(np.arange(len(close)), count)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.ravel().astype(np.int32)), taken.column("vec_id"), taken.column("vector")],
                    ["list", "vec_id", "vector"],
                )

    fields = "list int, vec_id long, vector array<double>"
    listed = checkpointed(rows.mapInArrow(lambda b: nearest(b, 1), fields))
    # Not kept: a query has a row for every probe.
    asked = checkpointed(prepared(queries).where(F.size("vector") == dim)).mapInArrow(lambda b: nearest(b, probes), fields)

    def blocks(df: DataFrame) -> dict[int, int]:
        counts = df.groupBy("list").agg(F.count("*").alias("n")).collect()  # a row for each list
        return {r["list"]: -(-r["n"] // p.block) for r in counts}

    row_blocks, query_blocks = blocks(listed), blocks(asked)

    def dealt(df: DataFrame, own: dict[int, int], other: dict[int, int], own_name: str, other_name: str) -> DataFrame:
        """Each row in one of its own list's blocks, once for every block of the other side."""

        def of(counts: dict[int, int]) -> Column:
            return F.get(F.array(*(F.lit(counts.get(i, 0)) for i in range(lists))), F.col("list"))

        return df.withColumn(
            own_name, F.pmod(F.xxhash64("vec_id", F.lit(p.seed + 1)), of(own)).cast("int")
        ).withColumn("others", of(other)).where("others > 0").withColumn(
            other_name, F.explode(F.sequence(F.lit(0), F.col("others") - 1))
        ).drop("others")

    turn = rotation(dim, p.seed)

    def run(group: pa.Table, ask: pa.Table) -> pa.Table:
        found: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if group.num_rows and ask.num_rows:
            for query_id, ids, scores in _search(group, ask, k, p, turn):
                found["query_id"].extend([query_id] * len(ids))
                found["vec_id"].extend(ids.tolist())
                found["score"].extend(scores.tolist())
        return pa.table(found, pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]))

    by = ["list", "row_block", "query_block"]
    met = (
        dealt(listed, row_blocks, query_blocks, "row_block", "query_block").groupBy(*by)
        .cogroup(dealt(asked, query_blocks, row_blocks, "query_block", "row_block").groupBy(*by))
        .applyInArrow(run, schema)
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
