"""Edge lists: directions, vertices, adjacency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.plans.skew import join_few


def undirected(edges: DataFrame) -> DataFrame:
    """Every edge in both directions, duplicates kept, in one scan."""
    both = F.array(
        F.struct(F.col("src").alias("src"), F.col("dst").alias("dst")),
        F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")),
    )
    return edges.select(F.explode(both).alias("e")).select("e.src", "e.dst")


def initial_labels(edges: DataFrame) -> DataFrame:
    """``(v, component)``: each source vertex labelled with itself."""
    return edges.select(F.col("src").alias("v")).distinct().withColumn("component", F.col("v"))


def initial_ranks(edges: DataFrame, rank: float = 1.0) -> DataFrame:
    """``(v, rank)``: each source vertex with the same rank."""
    return edges.select(F.col("src").alias("v")).distinct().withColumn("rank", F.lit(float(rank)))


def vertices(edges: DataFrame) -> DataFrame:
    """``(v)``: every vertex seen at either end of an edge."""
    return edges.select(F.explode(F.array("src", "dst")).alias("v")).distinct()


def out_degrees(edges: DataFrame) -> DataFrame:
    """``(src, outdeg)``, duplicates counted."""
    return edges.groupBy("src").agg(F.count("*").alias("outdeg"))


def vertex_degrees(edges: DataFrame) -> DataFrame:
    """``(v, outdeg)`` of every vertex at either end, 0 without out-edges, in one scan."""
    ends = F.array(
        F.struct(F.col("src").alias("v"), F.lit(1).alias("out")), F.struct(F.col("dst").alias("v"), F.lit(0).alias("out"))
    )
    return (
        edges.select(F.explode(ends).alias("e")).groupBy("e.v").agg(F.sum("e.out").alias("outdeg"))
    )


def adjacency(edges: DataFrame, distinct: bool = False, max_neighbors: int = 1_000_000) -> DataFrame:
    """``(v, piece, neighbors)``: destinations per source, duplicates kept unless ``distinct``.

    A vertex with more than ``max_neighbors`` edges is spread over several rows,
    numbered by ``piece``, so no single row or task has to hold all of them.
    """
    counted = edges.groupBy("src", "dst").agg(F.lit(1).alias("n") if distinct else F.count("*").alias("n"))
    degrees = out_degrees(edges.distinct() if distinct else edges)
    large = degrees.filter(F.col("outdeg") > max_neighbors).select(
        "src", F.ceil(F.col("outdeg") / F.lit(max_neighbors)).alias("pieces")
    )
    # Copies of one edge are cut into runs too, since they may be the bulk of a vertex.
    run = F.explode(F.sequence(F.lit(1), F.ceil(F.col("n") / F.lit(max_neighbors)))).alias("run")
    runs = join_few(counted, large, ["src"], "left").select("src", "dst", "n", "pieces", run)
    copies = F.least(F.lit(max_neighbors), F.col("n") - (F.col("run") - 1) * max_neighbors).cast("int")
    piece = F.coalesce(F.pmod(F.xxhash64("dst", "run"), F.col("pieces")), F.lit(0)).cast("int")
    return (
        runs.select(F.col("src").alias("v"), piece.alias("piece"), F.array_repeat("dst", copies).alias("part"))
        .groupBy("v", "piece")
        .agg(F.flatten(F.collect_list("part")).alias("neighbors"))
    )


def component_count(labels: DataFrame) -> DataFrame:
    """``(vertices, components)`` of a labelling ``(v, component)``."""
    return labels.agg(
        F.count("*").alias("vertices"), F.count_distinct("component").alias("components")
    )
