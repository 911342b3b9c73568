"""Command line jobs over files: ``spark-submit tidewheel/jobs.py <job> ...`` or ``python -m tidewheel.jobs``.

Every job reads text files and writes its whole result to text files, as lists of fields with a separator.
"""

from __future__ import annotations

import argparse
import os
import sys

if __package__ in (None, ""):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.operators import clustering, datagen, regression, relational, runtimes
from tidewheel.operators import text as text_ops
from tidewheel.operators.components import connected_components
from tidewheel.operators.graph import component_count
from tidewheel.operators.pagerank import pagerank, pagerank_delta
from tidewheel.sources import runs as run_files
from tidewheel.sources import text as files

# Field lists of the TPC-H text files; fixed values.
CUSTOMER = (
    "c_custkey bigint, c_name string, c_address string, c_nationkey int, c_phone string, c_acctbal double, "
    "c_mktsegment string, c_comment string"
)
ORDERS = (
    "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate string, "
    "o_orderpriority string, o_clerk string, o_shippriority bigint, o_comment string"
)
LINEITEM = (
    "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate string, l_commitdate string, l_receiptdate string, l_shipinstruct string, l_shipmode string, "
    "l_comment string"
)
NATION = "n_nationkey int, n_name string, n_regionkey int, n_comment string"


def _tbl(spark: SparkSession, path: str, schema: str, *columns: str) -> DataFrame:
    return files.read_delimited(spark, path, schema, "|", columns, trailing_sep=True)


def _lineitem(spark, path):
    return _tbl(spark, path, LINEITEM, "l_orderkey", "l_extendedprice", "l_discount", "l_returnflag", "l_shipdate")


def _customer(spark, path):
    return _tbl(spark, path, CUSTOMER, "c_custkey", "c_name", "c_address", "c_nationkey", "c_acctbal", "c_mktsegment")


def _orders(spark, path):
    return _tbl(spark, path, ORDERS, "o_orderkey", "o_custkey", "o_orderdate", "o_shippriority")


def wordcount(spark, a):
    files.write_delimited(text_ops.word_count(files.read_lines(spark, a.input)), a.output)


def grep(spark, a):
    text_ops.grep(files.read_lines(spark, a.input, a.slices), "value", a.keyword).write.text(a.output)


def shipping_priority(spark, a):
    result = relational.shipping_priority(
        _customer(spark, a.customer), _orders(spark, a.orders), _lineitem(spark, a.lineitem), a.segment, a.date
    )
    result = result.select("o_orderkey", "revenue", "o_orderdate", "o_shippriority")
    files.write_delimited(result, a.output, "|")


def returned_items(spark, a):
    nation = _tbl(spark, a.nation, NATION, "n_nationkey", "n_name")
    result = relational.returned_items(
        _customer(spark, a.customer), _orders(spark, a.orders), _lineitem(spark, a.lineitem), nation, a.min_year
    )
    files.write_delimited(result, a.output, "|")


def suite_runtimes(spark, a):
    experiment = files.read_delimited(spark, a.experiments, "id bigint, suite string, name string", ",")
    run = files.read_delimited(spark, a.runs, "experiment_id bigint, time bigint", ",")
    files.write_delimited(relational.suite_runtimes(experiment, run, a.suite), a.output, ",")


def rank_pages(spark, a):
    sep, comment, kind = (r"\s+", None, "string") if a.mode == "contrib" else (r"\t", "%", "bigint")
    if a.mode == "static":
        sep, comment = r"\s+", "#"
    edges = files.read_edges(spark, a.input, sep, comment, kind)
    if a.mode == "delta":
        result = pagerank_delta(edges, a.pages, a.iterations, a.threshold, stats=bool(a.stats))
    else:
        result = pagerank(edges, a.iterations, a.mode, n=a.pages, stats=bool(a.stats))
    _write_loop(result, a)


def components(spark, a):
    edges = files.read_edges(spark, a.input, a.separator, a.comment)
    result = connected_components(edges, a.iterations, a.to_convergence, a.through, stats=bool(a.stats))
    labels = result[0] if a.stats else result
    component_count(labels).show()  # one row
    _write_loop(result, a)


def _write_loop(result, a) -> None:
    if a.stats:
        result, stats = result
        files.write_delimited(stats.orderBy("op", "step"), a.stats, ",", "overwrite")
    files.write_delimited(result, a.output, " ", "overwrite")


def kmeans(spark, a):
    points = files.read_delimited(spark, a.points, "x double, y double", " ")
    centers = files.read_delimited(spark, a.centers, "id int, x double, y double", " ")
    clustered, _ = clustering.kmeans(points, centers, a.iterations, a.through, a.final_step)
    files.write_delimited(clustered.select("center_id", "x", "y"), a.output, " ", "overwrite")


def kmeans_auto(spark, a):
    vectors = files.read_vectors(spark, a.input)
    _, centers, _ = clustering.kmeans_auto(vectors, a.k, a.iterations, a.seed)
    clustering.wssse(vectors, centers).show()


def linreg(spark, a):
    data = files.read_delimited(spark, a.input, "x double, y double", " ")
    fit = regression.linear_regression_bgd(data, a.iterations, init=(a.theta0, a.theta1))
    files.write_delimited(fit, a.output, " ", "overwrite")


def linreg_sgd(spark, a):
    fit = regression.linear_regression_sgd(files.read_labeled_points(spark, a.input))
    files.write_delimited(fit, a.output, " ", "overwrite")


def sgd(spark, a):
    points = files.read_labeled_points(spark, a.input, "label_last")
    fit = regression.sgd_least_squares(points, fit_intercept=a.intercept)
    files.write_delimited(fit, a.output, " ", "overwrite")


def gen_kmeans(spark, a):
    skew = [int(s) for s in a.skew.split(",")] if a.skew else None
    points = datagen.gen_kmeans_points(spark.range(a.points), a.k, a.stddev, a.range, a.seed, skew)
    two_decimals = [F.format_string("%.2f", c).alias(c) for c in ("x", "y")]
    files.write_delimited(points.select(*two_decimals), f"{a.output}/points", " ", "overwrite")
    centers = datagen.gen_kmeans_centers(spark, a.k, a.range, a.seed)
    files.write_delimited(centers.select("id", *two_decimals), f"{a.output}/centers", " ", "overwrite")


def gen_linreg(spark, a):
    data = datagen.gen_linreg(spark.range(a.points), a.seed)
    files.write_delimited(data.select(*[F.format_string("%.2f", c).alias(c) for c in ("x", "y")]), a.output, " ", "overwrite")


def gen_features(spark, a):
    points = datagen.gen_polynomial_features(spark.range(a.points), a.dimension, a.seed)
    datagen.polynomial_lines(points, a.layout).write.mode("overwrite").text(a.output)


def parse_runs(spark, a):
    ended, failed = run_files.read_run_states(spark, a.suite)
    files.write_delimited(failed.select("folder", "exit_code"), f"{a.output}/failed")
    ended.select("nodes", "runtime_ms", "suite").write.partitionBy("suite").csv(f"{a.output}/runs")


def _minutes(spark, a) -> DataFrame:
    """Trimmed run times of files ``nodes,runtime`` with a header; the file name is the suite."""
    rows = spark.read.schema("nodes int, runtime_ms bigint").option("header", True).option("mode", "FAILFAST")
    suite = F.regexp_extract("_metadata.file_path", r"([^/]+?)(?:\.csv)?$", 1).alias("suite")
    return runtimes.runtimes_minutes(rows.csv(a.input).select(suite, "nodes", "runtime_ms"))


def fit_runtimes(spark, a):
    observed = _minutes(spark, a).persist()
    models = runtimes.fit_best_model(observed, a.refit)
    models.write.mode("overwrite").json(f"{a.output}/models")
    curve = runtimes.prediction_curve(observed, n=a.points)
    curve.write.mode("overwrite").option("header", True).csv(f"{a.output}/curves")
    observed.unpersist()


def learning_curves(spark, a):
    splits = runtimes.subsample_splits(_minutes(spark, a), range(a.smallest, a.largest + 1), a.iterations, a.seed)
    errors = runtimes.split_errors(splits).persist()

    def write(df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").option("header", True).csv(f"{a.output}/{name}")

    write(errors, "draws")
    curve = runtimes.curve_of(errors)
    write(curve, "suites")
    write(runtimes.average_curve(curve), "average")
    errors.unpersist()


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="tidewheel")
    jobs = parser.add_subparsers(required=True)

    def job(name, run, *positional):
        sub = jobs.add_parser(name)
        sub.set_defaults(run=run)
        for field in positional:
            sub.add_argument(field, type=int if field in ("iterations", "k") else str)
        return sub

    job("wordcount", wordcount, "input", "output")
    job("grep", grep, "input", "keyword", "output").add_argument("slices", type=int, nargs="?")

    p = job("shipping-priority", shipping_priority)
    for table in ("--lineitem", "--customer", "--orders"):
        p.add_argument(table, required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--segment", default="AUTOMOBILE")
    p.add_argument("--date", default="1995-03-12")

    p = job("returned-items", returned_items, "customer", "orders", "lineitem", "nation", "output")
    p.add_argument("--min-year", type=int, default=1990)
    job("suite-runtimes", suite_runtimes, "experiments", "runs", "suite", "output")

    p = job("pagerank", rank_pages, "input", "output", "iterations")
    p.add_argument("--mode", choices=("contrib", "bulk", "static", "delta"), default="contrib")
    p.add_argument("--pages", type=int)
    p.add_argument("--threshold", type=float, default=0.1)
    p.add_argument("--stats", metavar="FOLDER")

    p = job("components", components, "input", "output", "iterations")
    p.add_argument("--separator", default=r"\t")
    p.add_argument("--comment", default="%")
    p.add_argument("--to-convergence", action="store_true")
    p.add_argument("--through")
    p.add_argument("--stats", metavar="FOLDER")

    p = job("kmeans", kmeans, "points", "centers", "output", "iterations")
    p.add_argument("--through")
    p.add_argument("--final-step", choices=("last", "previous"), default="last")
    job("kmeans-auto", kmeans_auto, "input", "k", "iterations").add_argument("--seed", type=int, default=1)

    p = job("linreg", linreg, "input", "output", "iterations")
    p.add_argument("--theta0", type=float, default=0.0)
    p.add_argument("--theta1", type=float, default=0.0)
    job("linreg-sgd", linreg_sgd, "input", "output")
    job("sgd", sgd, "input", "output").add_argument("--intercept", action="store_true")

    p = job("gen-kmeans", gen_kmeans, "output")
    p.add_argument("--points", type=int, required=True)
    p.add_argument("-k", type=int, required=True)
    p.add_argument("--stddev", type=float, default=0.08)
    p.add_argument("--range", type=float, default=100.0)
    p.add_argument("--seed", type=int, default=datagen.DEFAULT_SEED)
    p.add_argument("--skew")
    p = job("gen-linreg", gen_linreg, "output")
    p.add_argument("--points", type=int, required=True)
    p.add_argument("--seed", type=int, default=datagen.DEFAULT_SEED)
    p = job("gen-features", gen_features, "output")
    p.add_argument("--points", type=int, required=True)
    p.add_argument("--dimension", type=int, required=True)
    p.add_argument("--layout", choices=("label_first", "label_last"), default="label_first")
    p.add_argument("--seed", type=int, default=datagen.DEFAULT_SEED)

    job("parse-runs", parse_runs, "suite", "output")
    p = job("fit-runtimes", fit_runtimes, "input", "output")
    p.add_argument("--points", type=int, default=500)
    p.add_argument("--refit", action="store_true")
    p = job("learning-curves", learning_curves, "input", "output")
    p.add_argument("--smallest", type=int, default=3)
    p.add_argument("--largest", type=int, default=15)
    p.add_argument("--iterations", type=int, default=2000)
    p.add_argument("--seed", type=int, default=1)
    return parser


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = _parser().parse_args(arguments)
    a.run(spark or SparkSession.builder.appName("tidewheel").getOrCreate(), a)


if __name__ == "__main__":
    main()
