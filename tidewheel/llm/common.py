"""Helpers shared by the operators of this package."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words, and a run of any others.
BLANKS = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df``, written to the folder that all executors share.

    The folder is the session's ``spark.checkpoint.dir``. A local session without one,
    as in tests, gets a temporary folder; any other session must name one.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="tidewheel-checkpoints-")
        context.setCheckpointDir(folder)
    return df.checkpoint()


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Inside, the session has these settings; ``__`` in a name stands for a dot."""
    named = {name.replace("__", "."): value for name, value in values.items()}
    before = {name: spark.conf.get(name) for name in named}
    for name, value in named.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def shuffles_dropped(spark: SparkSession):
    """Inside, an action's shuffle files are dropped once it has ended, not when its tables are forgotten.

    For actions that leave nothing to read but what they return or write.
    """
    return settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true")


def small_batches(spark: SparkSession, size: str = "8m"):
    """Inside, Python gets batches of about this many bytes, for functions that hold several times their input."""
    return settings(spark, spark__sql__execution__arrow__maxBytesPerBatch=size)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """The words of a text, in order; none for a null text."""
    return let(
        F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS)),
        lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, GAP)),
    )


def word_count(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def crc_fold(doc_id: Column, folds: int = 5) -> Column:
    """Which of ``folds`` a row is in; a null id counts as an empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds
