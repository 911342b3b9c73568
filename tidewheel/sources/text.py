"""Text and delimited files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.functions.text import split_lines, to_doubles


def read_lines(spark: SparkSession, path: str, min_partitions: int | None = None) -> DataFrame:
    """``(value)``: one row per line. ``min_partitions`` only ever raises the number of splits."""
    lines = spark.read.text(path)
    if min_partitions and lines.rdd.getNumPartitions() < min_partitions:
        lines = lines.repartition(min_partitions)
    return lines


def spread(df: DataFrame, key: str) -> DataFrame:
    """An input with fewer splits than there are task slots, spread by ``key``; any other as it is.

    Meant for a plain scan before costly work per row.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots, key) if df.rdd.getNumPartitions() < slots else df


def lines_of(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """``(keys..., value)``: the lines of a text column, as ``read_lines`` would give them."""
    return df.select(*keys, F.explode(split_lines(F.col(text))).alias("value"))


def read_delimited(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    sep: str = "|",
    columns: Sequence[str] | None = None,
    comment: str | None = None,
    trailing_sep: bool = False,
) -> DataFrame:
    """Typed delimited text; ``schema`` names every field in file order, ``columns`` picks some.

    ``trailing_sep`` is for lines that end in a separator. Quotes have no meaning, and
    malformed rows fail the query.
    """
    full = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names = list(columns or full.fieldNames())
    if trailing_sep:
        full = T.StructType([*full.fields, T.StructField("_after_last", T.StringType())])
    reader = spark.read.schema(full).option("sep", sep).option("quote", "").option("mode", "FAILFAST")
    if comment:
        reader = reader.option("comment", comment)
    return reader.csv(path).select(*names)


def write_delimited(df: DataFrame, path: str, sep: str = ",", mode: str = "errorifexists", trailing_sep: bool = False) -> None:
    """Write rows as delimited text without a header."""
    if trailing_sep:
        df = df.withColumn("_after_last", F.lit(None).cast("string"))
    df.write.mode(mode).option("sep", sep).option("quote", "").option("emptyValue", "").csv(path)


def read_edges(
    spark: SparkSession, path: str, sep: str = r"\t", comment: str | None = "%", id_type: str = "bigint"
) -> DataFrame:
    """``(src, dst)``: the first two tokens of each line that does not start with ``comment``."""
    lines = spark.read.text(path)
    if comment:
        lines = lines.filter(~F.col("value").startswith(comment))
    tokens = lines.select(F.split("value", sep).alias("t"))
    return tokens.select(
        F.element_at("t", 1).cast(id_type).alias("src"), F.element_at("t", 2).cast(id_type).alias("dst")
    )


def read_labeled_points(spark: SparkSession, path: str, layout: str = "label_first") -> DataFrame:
    """``(label, features)`` from ``label,f1 f2 ...`` or, with ``label_last``, ``f1 f2 ... label``.

    The first layout may also be written ``(label,[f1,f2,...])``.
    """
    lines = spark.read.text(path)
    if layout == "label_first":
        bare = F.regexp_replace("value", r"^\s*\(|\[|\]|\)\s*$", "")
        bracketed = F.col("value").contains("[")
        halves = F.split(bare, ",", 2)
        features = F.element_at(halves, 2)
        features = F.when(bracketed, F.regexp_replace(features, r"\s*,\s*", " ")).otherwise(features)
        return lines.select(
            F.element_at(halves, 1).cast("double").alias("label"),
            to_doubles(F.trim(features), " ").alias("features"),
        )
    if layout != "label_last":
        raise ValueError(f"unknown layout {layout!r}")
    numbers = lines.select(to_doubles(F.trim("value"), " ").alias("a"))
    return numbers.select(
        F.element_at("a", -1).alias("label"),
        F.slice("a", F.lit(1), F.size("a") - 1).alias("features"),
    )


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """``(features)``: space-separated doubles of any width."""
    return spark.read.text(path).select(to_doubles(F.trim("value"), " ").alias("features"))
