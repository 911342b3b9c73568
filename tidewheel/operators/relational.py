"""The two revenue queries and the run-time report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _revenue():
    return F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount"))


def shipping_priority(
    customer: DataFrame,
    orders: DataFrame,
    lineitem: DataFrame,
    segment: str = "AUTOMOBILE",
    date: str = "1995-03-12",
    priority: str = "o_shippriority",
) -> DataFrame:
    """Revenue per order placed before ``date`` with lines shipped after it, for one market segment.

    Works on ISO date strings as well as on date and timestamp columns. Lines are
    summed per order before the join, so a huge order is one row when it is shuffled.
    """
    per_order = (
        lineitem.filter(F.col("l_shipdate") > F.lit(date))
        .groupBy("l_orderkey")
        .agg(F.sum(_revenue()).alias("revenue"))
    )
    buyers = customer.filter(F.col("c_mktsegment") == segment).select("c_custkey")
    placed = orders.filter(F.col("o_orderdate") < F.lit(date)).select(
        "o_orderkey", "o_custkey", "o_orderdate", F.col(priority)
    )
    return (
        placed.join(buyers, F.col("o_custkey") == F.col("c_custkey"))
        .join(per_order, F.col("o_orderkey") == F.col("l_orderkey"))
        .groupBy("o_orderkey", "o_orderdate", priority)
        .agg(F.sum("revenue").alias("revenue"))
    )


def returned_items(
    customer: DataFrame, orders: DataFrame, lineitem: DataFrame, nation: DataFrame, min_year: int = 1990
) -> DataFrame:
    """Revenue of returned lines per customer, over orders placed after ``min_year``."""
    # As a range on the column this reaches the scan; year(column) would not.
    recent = orders.filter(F.col("o_orderdate") >= F.lit(f"{min_year + 1:04d}-01-01"))
    per_order = (
        lineitem.filter(F.col("l_returnflag") == "R")
        .groupBy("l_orderkey")
        .agg(F.sum(_revenue()).alias("revenue"))
    )
    per_customer = (
        recent.join(per_order, F.col("o_orderkey") == F.col("l_orderkey"))
        .groupBy("o_custkey")
        .agg(F.sum("revenue").alias("revenue"))
    )
    address = ["c_address"] if "c_address" in customer.columns else []
    return (
        customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(per_customer, F.col("c_custkey") == F.col("o_custkey"))
        .select("c_custkey", "c_name", *address, "n_name", "c_acctbal", "revenue")
    )


def suite_runtimes(experiment: DataFrame, experiment_run: DataFrame, suite: str) -> DataFrame:
    """Run times per experiment name of a suite, ordered by suite and name.

    ``median_time`` is the sum without the smallest and largest run: a median for
    three runs, and kept under that name for other counts. Runs are reduced per
    experiment before the join.
    """
    per_experiment = experiment_run.groupBy("experiment_id").agg(
        F.min("time").alias("low"), F.max("time").alias("high"), F.sum("time").alias("total")
    )
    return (
        experiment.filter(F.col("suite") == suite)
        .join(per_experiment, F.col("id") == F.col("experiment_id"))
        .groupBy("suite", "name")
        .agg(
            F.min("low").alias("min_time"),
            F.max("high").alias("max_time"),
            (F.sum("total") - F.min("low") - F.max("high")).alias("median_time"),
        )
        .orderBy("suite", "name")
    )
