"""Where iterative jobs keep their state between steps.

State is written as Parquet below the shared folder that the cluster names in
``spark.checkpoint.dir`` and read back. That cuts the lineage of long loops, and
a written step does not depend on any executor staying alive.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Steps of a loop from one checkpoint to the next.
CUT_EVERY = 4


def state_root(spark: SparkSession) -> str:
    """The shared folder for state; a temporary one only for a local session without it."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidewheel-"))
    return spark.sparkContext.getCheckpointDir()


def new_folder(spark: SparkSession, label: str) -> str:
    """A path below the state root that no other job uses."""
    return os.path.join(state_root(spark), f"{label}-{uuid.uuid4().hex}")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df``, computed and written below the state root; Spark drops the files once they are not in use."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(state_root(spark))
    return df.checkpoint()


def renamed_apart(df: DataFrame) -> DataFrame:
    """``df`` with columns of its own.

    A plan that reads one written table twice gives the second reading new columns, and what was cached over that
    reading is then no longer found. A copy of the table under columns of its own is another table.
    """
    return df.select(*(F.col(c).alias(c) for c in df.columns))


def materialize(df: DataFrame, path: str, step: int | str | None = None, single_file: bool = False) -> DataFrame:
    """Write ``df`` (as iteration ``step`` of ``path``) and return it read back from there."""
    target = path if step is None else f"{path}/iteration_{step}"
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").parquet(target)
    return df.sparkSession.read.schema(df.schema).parquet(target)


def _remove(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class LoopState:
    """The written tables of one running loop.

    ``advance`` writes the next version of a named table and drops the version
    before the one just replaced, so a loop holds two versions of it at most.
    With ``path`` given by the caller every version is kept.
    """

    def __init__(self, spark: SparkSession, label: str, path: str | None = None):
        self.spark = spark
        self.keep = path is not None
        self.path = path or new_folder(spark, label)
        self._versions: dict[str, list[str]] = {}
        self._saved: list[str] = []

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write a table that the whole loop reads."""
        self._saved.append(f"{self.path}/{name}")
        return materialize(df, self._saved[-1])

    def advance(self, df: DataFrame, name: str, step: int) -> DataFrame:
        folder = f"{self.path}/{name}"
        out = materialize(df, folder, step)
        versions = self._versions.setdefault(name, [])
        versions.append(f"{folder}/iteration_{step}")
        if not self.keep:
            while len(versions) > 2:
                _remove(self.spark, versions.pop(0))
        return out

    def finish(self) -> None:
        """Drop what the loop saved, unless the result still reads it because no step ran."""
        if self._versions and not self.keep:
            for path in self._saved:
                _remove(self.spark, path)

    def remove(self) -> None:
        """Drop everything that the loop wrote."""
        _remove(self.spark, self.path)


def observed(df: DataFrame, **counts: Column) -> tuple[DataFrame, Observation]:
    """``df``, and aggregates over its rows that are known once an action has read them.

    Only for rows that no shuffle follows: tasks of the last stage count once, whatever is run again.
    """
    seen = Observation()
    return df.observe(seen, *(c.alias(name) for name, c in counts.items())), seen


@contextmanager
def small_tasks(spark: SparkSession, parts: int, read: str) -> Iterator[None]:
    """Inside ``with``, shuffles have at least ``parts`` partitions, before Spark merges small ones.

    A task reads at most ``read`` bytes of a file, in Spark's notation, if its row groups are no larger.
    """
    settings = {"spark.sql.files.maxPartitionBytes": read}
    if parts > int(spark.conf.get("spark.sql.shuffle.partitions")):
        settings["spark.sql.shuffle.partitions"] = str(parts)
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


class CoPartitioned:
    """The tables of a loop, all hash-partitioned alike by what each is grouped by.

    Inside ``with``, every shuffle has ``parts`` partitions and none are merged afterwards, so tables
    that ``keep`` has written meet each other, and edges laid out in as many partitions, without
    moving. ``keep`` counts what is asked while it writes. All tables but the ``result`` are deleted
    at the end, and those named to ``drop`` before.

    A table is cached, in memory, then on disk: a lost part is made again from the tables before it.
    Those that are ``cut`` are also written below the state root and cached as read back, which ends that
    chain; a loop cuts every ``CUT_EVERY`` steps. Files come back several times faster than a checkpoint, and a
    plan may read what is cached over them twice: over a checkpoint, which knows its partitioning, the second
    reading is not found and all steps before it run again.
    """

    def __init__(self, spark: SparkSession, parts: int):
        self.spark = spark
        self.settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": str(parts)}
        self._kept: list[DataFrame] = []
        self._parts = parts
        self._path = new_folder(spark, "loop")
        #: Rows written by each ``keep``.
        self.written: list[int] = []

    def __enter__(self) -> CoPartitioned:
        self._before = {name: self.spark.conf.get(name) for name in self.settings}
        for name, value in self.settings.items():
            self.spark.conf.set(name, value)
        return self

    def __exit__(self, *_) -> None:
        for name, value in self._before.items():
            self.spark.conf.set(name, value)
        self.drop(*self._kept)
        _remove(self.spark, self._path)

    def keep(self, df: DataFrame, cut: bool = False, **counts: Column) -> tuple[DataFrame, dict]:
        """``df`` cached, and written if ``cut``, with aggregates over its rows, taken while they are made.

        A table to be cut is partitioned by its first column.
        """
        out, seen = self._cached(df, **counts)
        if cut:
            file = materialize(out, self._path, len(self.written))
            out.unpersist()
            out, _ = self._cached(file.repartition(self._parts, file.columns[0]))
            self.written.pop()
        self._kept.append(out)
        return out, seen

    def _cached(self, df: DataFrame, **counts: Column) -> tuple[DataFrame, dict]:
        df, seen = observed(renamed_apart(df), rows=F.count(F.lit(1)), **counts)
        # Once cached, a table's true size is known; otherwise estimates would multiply from step to step.
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
        df.count()
        self.written.append(seen.get["rows"])
        return df, seen.get

    def drop(self, *tables: DataFrame) -> None:
        """Forget tables that nothing reads any more; files stay until the end, lost parts may be made from them."""
        for df in tables:
            self._kept = [other for other in self._kept if other is not df]
            df.unpersist()

    def result(self, df: DataFrame) -> DataFrame:
        """``df`` in a checkpoint, to outlive the loop."""
        cached, _ = self._cached(df)
        out = checkpointed(cached)
        cached.unpersist()
        return out
