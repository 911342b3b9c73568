"""Joins whose large side may hold most of its rows under a few keys."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.plans.state import checkpointed, renamed_apart

# A table of at most this size, as text, is broadcast.
BROADCAST_BYTES = 8_000_000

# A vertex with fewer edges than this never needs splitting.
HOT_MIN_ROWS = 1_000_000
# A vertex is hot only with more than 1/MAX_HOT_KEYS of all edges, so there are
# fewer hot vertices than this and a table of them is safe to broadcast.
MAX_HOT_KEYS = 200_000
# Edges of a partition of the layout: one for this many, but as many as there are slots above the second number.
ROWS_PER_PARTITION = 4_000_000
LEAST_PER_PARTITION = 50_000


@dataclass
class OutEdges:
    """Edges ``(src, dst, outdeg)`` laid out once for a join per superstep.

    ``cold`` is hash-partitioned and sorted by ``src``, so a step shuffles the state and
    never the edges. Edges of hot vertices stay spread as they were
    read, in ``hot``, and meet a broadcast of the hot vertices' state.
    """

    cold: DataFrame
    hot: DataFrame | None
    hot_keys: DataFrame | None

    def receive(self, state: DataFrame, key: str = "v") -> DataFrame:
        """One row per (state row, out-edge), with the state's columns."""
        state = state.withColumnRenamed(key, "src")
        sent = state.join(self.cold, "src")
        if self.hot is None:
            return sent
        hot_state = state.join(F.broadcast(self.hot_keys), "src", "left_semi")
        return sent.unionByName(F.broadcast(hot_state).join(self.hot, "src"))

    def release(self) -> None:
        for part in (self.cold, self.hot):
            if part is not None:
                part.unpersist()


def partitions_for(spark: SparkSession, edges: int, rows: int = ROWS_PER_PARTITION) -> int:
    """Partitions of the layout of so many edges, of about ``rows`` at most."""
    slots = spark.sparkContext.defaultParallelism
    parts = max(min(slots, 1 + edges // LEAST_PER_PARTITION), -(-edges // rows))
    # Beyond the slots a multiple of them, so that no slot waits for a last few partitions.
    return parts if parts <= slots else -(-parts // slots) * slots


def hot_limit(total: int, hot_rows: int | None = None) -> int:
    """Edges beyond which a vertex is hot, of ``total``."""
    return max(HOT_MIN_ROWS if hot_rows is None else hot_rows, total // MAX_HOT_KEYS)


def out_edges(
    edges: DataFrame,
    degrees: DataFrame,
    hot_rows: int | None = None,
    total: int | None = None,
    counted: bool = True,
    parts: int | None = None,
) -> OutEdges:
    """Lay out ``edges(src, dst)``; ``degrees(src, outdeg)`` counts the rows of each ``src``, ``total`` all of them.

    Unless ``counted``, the edges are laid out without ``outdeg``. ``parts`` are those of ``partitions_for`` unless
    given. The state that meets the layout must not
    be read from the table of ``degrees``, or the cached edges would be made anew in that step.
    """
    spark = edges.sparkSession
    if total is None:
        total = degrees.agg(F.coalesce(F.sum("outdeg"), F.lit(0))).first()[0]
    limit = hot_limit(total, hot_rows)

    # In one partition: every step's plan reads them, and a checkpoint that is partitioned by a key is found once only.
    hot_keys = checkpointed(renamed_apart(degrees.filter(F.col("outdeg") > limit).coalesce(1)))
    columns = ["src", "dst", "outdeg"] if counted else ["src", "dst"]
    hot = None
    cold = edges
    if hot_keys.isEmpty():
        hot_keys = None
    else:
        few, rest = (checkpointed(renamed_apart(hot_keys)) for _ in range(2))
        hot = edges.join(F.broadcast(few), "src").select(columns).persist(StorageLevel.MEMORY_AND_DISK)
        cold = edges.join(F.broadcast(rest.select("src")), "src", "left_anti")
    # Partitioned before the degrees join, so the edges are shuffled once.
    parts = parts or partitions_for(spark, total)
    cold = cold.select("src", "dst").repartition(parts, "src")
    if counted:
        cold = cold.join(degrees, "src")
    cold = cold.sortWithinPartitions("src").select(columns).persist(StorageLevel.MEMORY_AND_DISK)
    return OutEdges(cold, hot, hot_keys)


def join_few(
    large: DataFrame, few: DataFrame, keys: Sequence[str], how: str = "inner", computed: bool = False
) -> DataFrame:
    """Join a table with one row per key to one that may have any number of rows per key.

    The small table is computed first, into a checkpoint unless it is ``computed``, and its size is summed up. Up to
    ``BROADCAST_BYTES`` it is broadcast, and the large one stays where it is. Beyond, the
    join is left to Spark, which splits partitions that turn out skewed.
    """
    few = few if computed else checkpointed(few)
    size = few.agg(F.coalesce(F.sum(F.length(F.to_json(F.struct("*")))), F.lit(0))).first()[0]
    return large.join(F.broadcast(few) if size <= BROADCAST_BYTES else few, list(keys), how)
