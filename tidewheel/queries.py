"""The registered queries: each operator over inputs derived from the given tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tidewheel.functions.hashing import hash_int, hash_uniform
from tidewheel.operators import clustering, datagen, graph, regression, relational, runtimes
from tidewheel.operators import text as text_ops
from tidewheel.operators.components import connected_components, contracted_components
from tidewheel.operators.pagerank import pagerank, pagerank_delta
from tidewheel.plans.state import materialize, new_folder
from tidewheel.sources import runs as run_files
from tidewheel.sources import text as files

Query = Callable[[SparkSession, str], DataFrame]

KEYWORD = "the"
GRAPH_STEPS = 5
COMPONENT_STEPS = 10
DELTA_THRESHOLD = 0.1
LLOYD_STEPS = 10
WIDE_STEPS = 20
BGD_STEPS = 10
GENERATED_CLUSTERS = 5
HOT_ROWS = 50
PIECE_ROWS = 20
KERNEL_BANDWIDTH = 8
CURVE_POINTS = 500
LEARNING_SIZES = tuple(range(3, 16))
LEARNING_ITERATIONS = 2000
BULK_STEPS = 25
BULK_EPS = 0.05
START_CENTERS = [(1, 10.0, 10.0), (2, 40.0, 10.0), (3, 10.0, 40.0), (4, 40.0, 40.0), (5, 500.0, 500.0)]
MASTER = "node0"
LINES_PER_LOG = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- derived inputs --------------------------------------------------------

# One id space for all entities: key * 8 + kind.
REGION, NATION, SUPPLIER, CUSTOMER, ORDER, PART, LINE = range(7)


def _id(key: str, kind: int) -> Column:
    return F.col(key).cast("bigint") * 8 + kind


def _edge(src: Column, dst: Column) -> list[Column]:
    return [src.alias("src"), dst.alias("dst")]


def supply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed: region > nation > customer > order > part > supplier > nation."""
    item = F.explode(
        F.array(
            F.struct(*_edge(_id("l_orderkey", ORDER), _id("l_partkey", PART))),
            F.struct(*_edge(_id("l_partkey", PART), _id("l_suppkey", SUPPLIER))),
        )
    ).alias("e")
    parts = [
        table(spark, sf_dir, "nation").select(*_edge(_id("n_regionkey", REGION), _id("n_nationkey", NATION))),
        table(spark, sf_dir, "customer").select(*_edge(_id("c_nationkey", NATION), _id("c_custkey", CUSTOMER))),
        table(spark, sf_dir, "supplier").select(*_edge(_id("s_suppkey", SUPPLIER), _id("s_nationkey", NATION))),
        table(spark, sf_dir, "orders").select(*_edge(_id("o_custkey", CUSTOMER), _id("o_orderkey", ORDER))),
        table(spark, sf_dir, "lineitem").select(item).select("e.src", "e.dst"),
    ]
    return _union(parts)


def territory_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region, nation, supplier, customer, order and order line: one component per region."""
    line = (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 8 + LINE
    parts = [
        table(spark, sf_dir, "nation").select(*_edge(_id("n_regionkey", REGION), _id("n_nationkey", NATION))),
        table(spark, sf_dir, "customer").select(*_edge(_id("c_nationkey", NATION), _id("c_custkey", CUSTOMER))),
        table(spark, sf_dir, "supplier").select(*_edge(_id("s_nationkey", NATION), _id("s_suppkey", SUPPLIER))),
        table(spark, sf_dir, "orders").select(*_edge(_id("o_custkey", CUSTOMER), _id("o_orderkey", ORDER))),
        table(spark, sf_dir, "lineitem").select(*_edge(_id("l_orderkey", ORDER), line)),
    ]
    return _union(parts)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


def price_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 2000).alias("y")
    )


def regression_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_quantity") / 50).alias("x"), (F.col("l_extendedprice") / 100000).alias("y")
    )


def labeled_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regression_data(spark, sf_dir).select(
        F.col("y").alias("label"), F.array(F.lit(1.0), F.col("x")).alias("features")
    )


def embedding_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", F.col("embedding").cast("array<double>").alias("features")
    )


def _label_centers(vectors: DataFrame) -> list[list[float]]:
    """Mean vector per label, by label: as many as there are classes."""
    means = vectors.groupBy("label").agg(Summarizer.mean(array_to_vector("features")).alias("mean"))
    rows = means.select("label", vector_to_array("mean").alias("mean")).collect()
    return [row["mean"] for row in sorted(rows)]


def raw_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("suite"),
        (4 * (1 + F.col("l_suppkey") % 15)).cast("int").alias("nodes"),
        F.col("l_extendedprice").cast("bigint").alias("runtime_ms"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runtimes.runtimes_minutes(raw_runs(spark, sf_dir))


# -- sources and sinks -----------------------------------------------------


def lines(spark, sf_dir):
    return files.lines_of(documents(spark, sf_dir), "text", "doc_id")


def read_delimited_roundtrip(spark, sf_dir):
    path = new_folder(spark, "delimited")
    fields = ["l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_returnflag"]
    items = table(spark, sf_dir, "lineitem").select(*fields)
    files.write_delimited(items, path, sep="|", trailing_sep=True)
    schema = "l_orderkey bigint, l_linenumber int, l_extendedprice double, l_discount double, l_returnflag string"
    return files.read_delimited(
        spark, path, schema, sep="|", columns=["l_orderkey", "l_extendedprice", "l_returnflag"], trailing_sep=True
    )


def read_edges(spark, sf_dir):
    path = new_folder(spark, "edges")
    edges = supply_edges(spark, sf_dir)
    comments = table(spark, sf_dir, "region").select(F.concat(F.lit("% "), "r_name").alias("value"))
    comments.unionAll(edges.select(F.concat_ws("\t", "src", "dst"))).write.text(path)
    return files.read_edges(spark, path)


def read_labeled_points(spark, sf_dir):
    first, last = new_folder(spark, "points"), new_folder(spark, "points")
    points = labeled_points(spark, sf_dir)
    datagen.polynomial_lines(points, "label_first").write.text(first)
    datagen.polynomial_lines(points, "label_last").write.text(last)
    both = files.read_labeled_points(spark, first, "label_first").unionAll(
        files.read_labeled_points(spark, last, "label_last")
    )
    return both.select("label", F.element_at("features", 1).alias("f1"), F.element_at("features", 2).alias("f2"))


def read_vectors(spark, sf_dir):
    path = new_folder(spark, "vectors")
    embedding_vectors(spark, sf_dir).select(F.array_join(F.col("features").cast("array<string>"), " ")).write.text(path)
    vectors = files.read_vectors(spark, path)
    return vectors.select(F.size("features").alias("width"), F.posexplode("features").alias("pos", "value")).select(
        "width", "pos", F.round("value", 6).alias("value")
    )


def read_lines(spark, sf_dir):
    path = new_folder(spark, "lines")
    table(spark, sf_dir, "documents").select(F.concat_ws("\t", "doc_id", "lang", "source")).write.text(path)
    return files.read_lines(spark, path, min_partitions=16)


def materialized(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return materialize(orders, new_folder(spark, "orders"), 1)


def _write_run_states(spark, sf_dir) -> str:
    """A state file per experiment, scale-out and run, its time summed from the lines.

    Every seventh run failed, and every sixth has no exit code.
    """
    path = new_folder(spark, "states")
    per_run = (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            F.col("l_returnflag").alias("suite"),
            (4 * (1 + F.col("l_suppkey") % 15)).cast("int").alias("nodes"),
            F.col("l_linenumber").alias("run"),
        )
        .agg(F.sum(F.col("l_extendedprice").cast("bigint")).alias("runTime"))
    )
    folder = F.format_string("%s.top%03d.run%02d", "suite", "nodes", "run").alias("bench")
    code = F.when(F.col("run") == 7, 1).when(F.col("run") != 6, 0).alias("runExitCode")
    per_run.select(folder, code, "runTime").repartition(8, "bench").write.partitionBy("bench").json(path)
    return path


def run_states(spark, sf_dir):
    ended, failed = run_files.read_run_states(spark, _write_run_states(spark, sf_dir), "part-*.json")
    return ended.select("suite", "nodes", "run", "runtime_ms", F.lit(0).alias("exit_code")).unionAll(
        failed.select("suite", "nodes", "run", F.lit(None).cast("bigint"), "exit_code")
    )


def _write_host_logs(spark, sf_dir) -> str:
    """Metric logs of hosts that each hold a stretch of the events; two experiments share scale-outs and runs."""
    path = new_folder(spark, "logs")
    events = table(spark, sf_dir, "events")
    stretch = F.floor(F.col("event_id") / LINES_PER_LOG)
    names = list(run_files.METRIC_COLUMNS)
    values = [F.col("value") * (k + 1) if k else F.col("value") for k in range(len(names))]
    line = F.concat_ws(",", F.col("event_id"), *[v.cast("string") for v in values])
    header = "\n".join(['"made from events"'] * run_files.METRIC_PREAMBLE_LINES + ['"epoch","' + '","'.join(names) + '"'])
    logs = (
        events.select(
            F.format_string(
                "%s.top%03d.run%02d", F.when(stretch % 2 == 0, "A").otherwise("N"),
                (4 * (1 + F.floor(stretch / 2) % 15)).cast("int"), (1 + F.floor(stretch / 2) % 7).cast("int"),
            ).alias("bench"),
            F.concat(F.lit("node"), stretch).alias("log"),
            F.struct("event_id", line.alias("line")).alias("row"),
        )
        .groupBy("bench", "log")
        .agg(F.sort_array(F.collect_list("row")).alias("rows"))
        .select("bench", "log", F.concat_ws("\n", F.lit(header), F.transform("rows", lambda r: r["line"])).alias("value"))
    )
    logs.write.partitionBy("bench", "log").text(path)
    return path


def _host_metrics(spark, sf_dir) -> DataFrame:
    return run_files.read_host_metrics(
        spark, f"{_write_host_logs(spark, sf_dir)}/*.top*.run*", MASTER, logs="log=*/part-*", host_pattern=r"/log=([^/]+)/"
    )


def host_metrics(spark, sf_dir):
    return _host_metrics(spark, sf_dir)


def run_metrics(spark, sf_dir):
    ended, _ = run_files.read_run_states(spark, _write_run_states(spark, sf_dir), "part-*.json")
    rolled = runtimes.run_metrics(_host_metrics(spark, sf_dir), ended)
    metrics = [f"{kind}_{name}" for kind in ("avg", "max") for name in run_files.METRIC_COLUMNS]
    return rolled.select("run_key", "host", "samples", *[F.round(m, 6).alias(m) for m in metrics], "runtime_ms")


# -- text and relational ---------------------------------------------------


def word_count(spark, sf_dir):
    return text_ops.word_count(files.lines_of(documents(spark, sf_dir), "text"))


def grep(spark, sf_dir):
    # A keyword without a line break can only be in a line of a text that holds it.
    texts = text_ops.grep(documents(spark, sf_dir), "text", KEYWORD)
    return text_ops.grep(files.lines_of(texts, "text", "doc_id"), "value", KEYWORD)


def tpch_q3_variant(spark, sf_dir):
    result = relational.shipping_priority(
        table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"),
        priority="o_orderpriority",
    )
    return result.select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"), "o_orderpriority",
        F.round("revenue", 4).alias("revenue"),
    )


def _returned_items(spark, sf_dir, min_year):
    result = relational.returned_items(
        table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"),
        table(spark, sf_dir, "nation"), min_year,
    )
    return result.withColumn("revenue", F.round("revenue", 4))


def tpch_q10_variant(spark, sf_dir):
    return _returned_items(spark, sf_dir, 1990)


def tpch_q10_variant_1997(spark, sf_dir):
    return _returned_items(spark, sf_dir, 1997)


def suite_runtimes(spark, sf_dir):
    experiment = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("suite"), F.col("o_orderpriority").alias("name")
    )
    run = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("experiment_id"), F.col("l_quantity").cast("int").alias("time")
    )
    return relational.suite_runtimes(experiment, run, "F")


# -- graph -----------------------------------------------------------------


def graph_undirected(spark, sf_dir):
    return graph.undirected(supply_edges(spark, sf_dir))


def graph_vertices(spark, sf_dir):
    edges = supply_edges(spark, sf_dir)
    return graph.initial_labels(edges).join(graph.initial_ranks(edges), "v")


def graph_adjacency(spark, sf_dir):
    rows = graph.adjacency(supply_edges(spark, sf_dir))
    return rows.select("v", "piece", F.array_join(F.sort_array("neighbors").cast("array<string>"), ",").alias("neighbors"))


def graph_adjacency_distinct(spark, sf_dir):
    rows = graph.adjacency(supply_edges(spark, sf_dir), distinct=True)
    return rows.select("v", "piece", F.array_join(F.sort_array("neighbors").cast("array<string>"), ",").alias("neighbors"))


def graph_adjacency_pieces(spark, sf_dir):
    """Neighbours of all pieces together, where no row holds more than a few."""
    rows = graph.adjacency(supply_edges(spark, sf_dir), max_neighbors=PIECE_ROWS)
    together = rows.groupBy("v").agg(F.count("*").alias("pieces"), F.flatten(F.collect_list("neighbors")).alias("all"))
    return together.select(
        "v", F.array_join(F.sort_array("all").cast("array<string>"), ",").alias("neighbors"),
        ((F.col("pieces") > 1) <= (F.size("all") > PIECE_ROWS)).alias("split_if_large"),
    )


def _rounded(ranks: DataFrame) -> DataFrame:
    return ranks.select("v", F.round("rank", 6).alias("rank"))


def _pages(edges: DataFrame) -> int:
    return graph.vertices(edges).count()


def pagerank_contrib(spark, sf_dir):
    return _rounded(pagerank(supply_edges(spark, sf_dir), GRAPH_STEPS))


def pagerank_bulk(spark, sf_dir):
    return _rounded(pagerank(supply_edges(spark, sf_dir), GRAPH_STEPS, mode="bulk"))


def pagerank_bulk_converged(spark, sf_dir):
    """Stops before the last step, when no rank moves by the bound."""
    return _rounded(pagerank(supply_edges(spark, sf_dir), BULK_STEPS, mode="bulk", eps=BULK_EPS))


def pagerank_static(spark, sf_dir):
    return _rounded(pagerank(supply_edges(spark, sf_dir), GRAPH_STEPS, mode="static"))


def pagerank_hot(spark, sf_dir):
    """Ranks where the edges of busy vertices stay spread and meet a broadcast of their state."""
    return _rounded(pagerank(supply_edges(spark, sf_dir), GRAPH_STEPS, mode="static", hot_rows=HOT_ROWS))


def components_hot(spark, sf_dir):
    return connected_components(territory_edges(spark, sf_dir), COMPONENT_STEPS, hot_rows=HOT_ROWS)


def pagerank_changes(spark, sf_dir):
    edges = supply_edges(spark, sf_dir)
    return _rounded(pagerank_delta(edges, _pages(edges), GRAPH_STEPS, DELTA_THRESHOLD))


def pagerank_iteration_stats(spark, sf_dir):
    return pagerank(supply_edges(spark, sf_dir), GRAPH_STEPS, mode="bulk", stats=True)[1]


def pagerank_delta_iteration_stats(spark, sf_dir):
    edges = supply_edges(spark, sf_dir)
    _, stats = pagerank_delta(edges, _pages(edges), GRAPH_STEPS, DELTA_THRESHOLD, stats=True)
    return stats


def components(spark, sf_dir):
    return connected_components(territory_edges(spark, sf_dir), COMPONENT_STEPS)


def components_multijob(spark, sf_dir):
    return connected_components(
        territory_edges(spark, sf_dir), COMPONENT_STEPS, materialize=new_folder(spark, "components")
    )


def chain_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order and the next one, by key, in chains of 1500."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("src"))
    following = orders.select((F.col("src") - 1).alias("src"), F.col("src").alias("dst"))
    return orders.where("src % 1500 <> 0").join(following, "src")


def components_chain(spark, sf_dir):
    """Chains whose smallest label would take 1500 steps from end to end."""
    return contracted_components(chain_edges(spark, sf_dir))[0]


def component_count(spark, sf_dir):
    return graph.component_count(connected_components(territory_edges(spark, sf_dir), to_convergence=True))


def cc_iteration_stats(spark, sf_dir):
    return connected_components(territory_edges(spark, sf_dir), COMPONENT_STEPS, stats=True)[1]


# -- machine learning ------------------------------------------------------


def nearest_center(spark, sf_dir):
    placed = clustering.nearest_center(price_points(spark, sf_dir), START_CENTERS)
    return placed.select("x", "y", "center_id", F.round("distance", 6).alias("distance"))


def kmeans_lloyd(spark, sf_dir):
    return clustering.kmeans(price_points(spark, sf_dir), START_CENTERS, LLOYD_STEPS)[0]


def kmeans_centers(spark, sf_dir):
    centers = clustering.kmeans(price_points(spark, sf_dir), START_CENTERS, LLOYD_STEPS)[1]
    return centers.select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def kmeans_multijob(spark, sf_dir):
    return clustering.kmeans(price_points(spark, sf_dir), START_CENTERS, LLOYD_STEPS, path=new_folder(spark, "kmeans"))[0]


def kmeans_multijob_previous(spark, sf_dir):
    return clustering.kmeans(
        price_points(spark, sf_dir), START_CENTERS, LLOYD_STEPS, path=new_folder(spark, "kmeans"), final_step="previous"
    )[0]


def line_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two lines of every order as centres: many, and some of them in one place."""
    lines = table(spark, sf_dir, "lineitem").where("l_linenumber <= 2")
    key = (F.col("l_orderkey") * 2 + F.col("l_linenumber")).cast("int")
    return lines.select(key.alias("id"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 2000).alias("y"))


def account_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        "c_custkey", (F.col("c_custkey") % 50 + 0.5).cast("double").alias("x"), (F.col("c_acctbal") / 200).alias("y")
    )


def nearest_of_many_centers(spark, sf_dir):
    placed = clustering.nearest_center(account_points(spark, sf_dir), line_centers(spark, sf_dir))
    return placed.select("c_custkey", "center_id", F.round("distance", 9).alias("distance"))


def kmeans_many_centers(spark, sf_dir):
    """Two steps over order lines from one centre per customer; divided by pi, no mean lies between two rounded values."""
    start = account_points(spark, sf_dir).select(F.col("c_custkey").cast("int").alias("id"), "x", "y")
    centers = clustering.kmeans(price_points(spark, sf_dir), start, 2)[1]
    return centers.select("id", *(F.round(F.col(c) / F.pi(), 6).alias(c) for c in "xy"))


def kmeans_auto(spark, sf_dir):
    """Facts about a clustering whose start is random: rows, clusters, misplaced rows, whether it beats one centre."""
    vectors = embedding_vectors(spark, sf_dir)
    clustered, centers, _ = clustering.kmeans_auto(vectors, k=10, iters=10)
    placed = clustering.nearest_vector(clustered.withColumnRenamed("center_id", "given"), centers)
    mean = vectors.agg(Summarizer.mean(array_to_vector("features")).alias("mean"))
    single = clustering.wssse(vectors, [list(mean.first()["mean"])]).first()["wssse"]
    return placed.agg(
        F.count("*").alias("n"),
        F.countDistinct("given").alias("clusters"),
        F.sum((F.col("given") != F.col("center_id")).cast("bigint")).alias("misplaced"),
        (F.sum("cost") < single).alias("better"),
    )


def wssse(spark, sf_dir):
    vectors = embedding_vectors(spark, sf_dir)
    return clustering.wssse(vectors, _label_centers(vectors)).select(F.round("wssse", 6).alias("wssse"))


def linreg_bgd(spark, sf_dir):
    fit = regression.linear_regression_bgd(regression_data(spark, sf_dir), BGD_STEPS)
    return fit.select(F.round("theta0", 8).alias("theta0"), F.round("theta1", 8).alias("theta1"))


def _rounded_weights(fit: DataFrame) -> DataFrame:
    return fit.select("pos", F.round("weight", 8).alias("weight"), "steps")


def linreg_sgd(spark, sf_dir):
    return _rounded_weights(regression.linear_regression_sgd(labeled_points(spark, sf_dir)))


def sgd_least_squares(spark, sf_dir):
    return _rounded_weights(regression.sgd_least_squares(labeled_points(spark, sf_dir)))


def sgd_intercept(spark, sf_dir):
    """The intercept's weight comes last."""
    points = labeled_points(spark, sf_dir).select("label", F.slice("features", 2, 1).alias("features"))
    return _rounded_weights(regression.sgd_least_squares(points, fit_intercept=True))


def wide_points(spark: SparkSession, sf_dir: str, width: int) -> DataFrame:
    """A point for every order: its price, and ``width`` features in [-1, 1] out of its keys."""

    @arrow_udf("array<double>")
    def features(order: pa.Array, customer: pa.Array) -> pa.Array:
        o, c = (np.asarray(keys.to_numpy(zero_copy_only=False), np.int64)[:, None] for keys in (order, customer))
        k = np.arange(1, width + 1)
        values = np.fmod(o * (2 * k + 1) + c * k, 997) / 498.0 - 1.0
        return pa.ListArray.from_arrays(np.arange(len(o) + 1, dtype=np.int32) * width, values.ravel())

    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.col("o_totalprice") / 100000).alias("label"))
    keys = (F.col(key).cast("bigint") for key in ("o_orderkey", "o_custkey"))
    return files.spread(orders, "o_orderkey").select("label", features(*keys).alias("features"))


def linreg_sgd_20(spark, sf_dir):
    return _rounded_weights(regression.linear_regression_sgd(wide_points(spark, sf_dir, 20)))


def sgd_least_squares_300(spark, sf_dir):
    return _rounded_weights(regression.sgd_least_squares(wide_points(spark, sf_dir, 300), WIDE_STEPS))


# -- data generation -------------------------------------------------------


def _positions(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"))


def gen_kmeans_points(spark, sf_dir):
    """One point per event."""
    return datagen.gen_kmeans_points(_positions(spark, sf_dir), GENERATED_CLUSTERS, skew=[5, 1, 1, 1, 2])


def gen_kmeans_centers(spark, sf_dir):
    """Generated points counted at the nearest of the generated start centres."""
    points = datagen.gen_kmeans_points(_positions(spark, sf_dir), GENERATED_CLUSTERS)
    centers = datagen.gen_kmeans_centers(spark, GENERATED_CLUSTERS)
    return clustering.nearest_center(points, centers).groupBy("center_id").agg(F.count("*").alias("n"))


def gen_linreg(spark, sf_dir):
    return datagen.gen_linreg(_positions(spark, sf_dir))


def gen_polynomial_features(spark, sf_dir):
    points = datagen.gen_polynomial_features(_positions(spark, sf_dir), 20)
    return points.select(F.round("label", 6).alias("label"), F.posexplode("features").alias("power", "value")).select(
        "label", "power", F.round("value", 6).alias("value")
    )


def uniform_draws(spark, sf_dir):
    """Events per tenth of the unit interval, and per face of a six-sided draw."""
    pos = F.col("id")
    drawn = _positions(spark, sf_dir).select(
        F.floor(hash_uniform(1, pos) * 10).alias("tenth"), hash_int(1, pos, 6, stream=1).alias("face")
    )
    return drawn.groupBy("tenth", "face").agg(F.count("*").alias("n"))


# -- run times -------------------------------------------------------------


def trim_runs(spark, sf_dir):
    return runtimes.trim_runs(raw_runs(spark, sf_dir))


def runtimes_minutes(spark, sf_dir):
    minutes = runtimes.runtimes_minutes(raw_runs(spark, sf_dir))
    return minutes.select("suite", "nodes", F.round("minutes", 8).alias("minutes"))


def relative_error(spark, sf_dir):
    prices = table(spark, sf_dir, "lineitem").withColumn(
        "net", F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    )
    return runtimes.relative_error(prices, "net", "l_extendedprice", "l_returnflag").select(
        "l_returnflag", F.round("error", 8).alias("error")
    )


def ernest_fit(spark, sf_dir):
    fits = runtimes.fit_ernest(runs(spark, sf_dir))
    return fits.select("suite", *[F.round(F.element_at("coefficients", k + 1), 6).alias(f"c{k}") for k in range(4)])


def _scale_out_queries(spark, sf_dir) -> DataFrame:
    return raw_runs(spark, sf_dir).select("suite", F.col("nodes").alias("x")).distinct()


def ernest_predict(spark, sf_dir):
    fits = runtimes.fit_ernest(runs(spark, sf_dir))
    predicted = runtimes.predict_ernest(fits, _scale_out_queries(spark, sf_dir))
    return predicted.select("suite", "x", F.round("predicted", 6).alias("predicted"))


def kernel_predict(spark, sf_dir):
    predicted = runtimes.predict_kernel(runs(spark, sf_dir), _scale_out_queries(spark, sf_dir), KERNEL_BANDWIDTH)
    return predicted.select("suite", "x", F.round("predicted", 6).alias("predicted"))


def interpolation_splits(spark, sf_dir):
    splits = runtimes.interpolation_splits(raw_runs(spark, sf_dir))
    return splits.groupBy("suite", "fold", "role", "nodes").agg(
        F.count("*").alias("n"), F.sum("runtime_ms").alias("total_ms")
    )


def cv_score_kernel(spark, sf_dir):
    scores = runtimes.cv_score_kernel(runs(spark, sf_dir))
    return scores.select("suite", "fold", "bw", F.round("error", 6).alias("error"))


def cv_score_ernest(spark, sf_dir):
    return runtimes.cv_score_ernest(runs(spark, sf_dir)).select("suite", "fold", F.round("error", 6).alias("error"))


def kernel_bandwidth(spark, sf_dir):
    return runtimes.select_bandwidth(runs(spark, sf_dir)).select("suite", "bw", F.round("score", 6).alias("score"))


def best_model(spark, sf_dir):
    best = runtimes.fit_best_model(runs(spark, sf_dir))
    return best.select(
        "suite", "family", "bw", F.round("score", 6).alias("score"), "dropped",
        *[F.round(F.element_at("coefficients", k + 1), 6).alias(f"c{k}") for k in range(4)],
    )


def best_model_refit(spark, sf_dir):
    best = runtimes.fit_best_model(runs(spark, sf_dir), refit=True)
    return best.select(
        "suite", "family", "bw", F.round("score", 6).alias("score"), "dropped",
        *[F.round(F.element_at("coefficients", k + 1), 6).alias(f"c{k}") for k in range(4)],
    )


def best_model_predict(spark, sf_dir):
    observed = runs(spark, sf_dir)
    predicted = runtimes.predict_best(observed, runtimes.fit_best_model(observed), _scale_out_queries(spark, sf_dir))
    return predicted.select("suite", "x", F.round("predicted", 6).alias("predicted"))


def prediction_curve(spark, sf_dir):
    curve = runtimes.prediction_curve(runs(spark, sf_dir), n=CURVE_POINTS)
    return curve.select(
        "suite", F.round("x", 6).alias("x"), F.round("ernest", 6).alias("ernest"), F.round("kernel", 6).alias("kernel")
    )


def subsample_splits(spark, sf_dir):
    splits = runtimes.subsample_splits(runs(spark, sf_dir), LEARNING_SIZES, LEARNING_ITERATIONS)
    return splits.withColumn("minutes", F.round("minutes", 8))


def learning_curve(spark, sf_dir):
    return runtimes.learning_curve(runs(spark, sf_dir), LEARNING_SIZES, LEARNING_ITERATIONS)


def learning_curve_average(spark, sf_dir):
    return runtimes.average_curve(runtimes.learning_curve(runs(spark, sf_dir), LEARNING_SIZES, LEARNING_ITERATIONS))


QUERIES: dict[str, Query] = {
    "lines": lines,
    "read_delimited_roundtrip": read_delimited_roundtrip,
    "read_edges": read_edges,
    "labeled_points": read_labeled_points,
    "read_vectors": read_vectors,
    "read_lines": read_lines,
    "materialize": materialized,
    "run_states": run_states,
    "host_metrics": host_metrics,
    "run_metrics": run_metrics,
    "word_count": word_count,
    "grep": grep,
    "tpch_q3_variant": tpch_q3_variant,
    "tpch_q10_variant": tpch_q10_variant,
    "tpch_q10_variant_1997": tpch_q10_variant_1997,
    "suite_runtimes": suite_runtimes,
    "graph_undirected": graph_undirected,
    "graph_vertices": graph_vertices,
    "graph_adjacency": graph_adjacency,
    "graph_adjacency_distinct": graph_adjacency_distinct,
    "graph_adjacency_pieces": graph_adjacency_pieces,
    "pagerank_contrib": pagerank_contrib,
    "pagerank_bulk": pagerank_bulk,
    "pagerank_bulk_converged": pagerank_bulk_converged,
    "pagerank_static": pagerank_static,
    "pagerank_hot": pagerank_hot,
    "pagerank_delta": pagerank_changes,
    "pagerank_iteration_stats": pagerank_iteration_stats,
    "pagerank_delta_iteration_stats": pagerank_delta_iteration_stats,
    "connected_components": components,
    "connected_components_multijob": components_multijob,
    "connected_components_hot": components_hot,
    "components_chain": components_chain,
    "component_count": component_count,
    "cc_iteration_stats": cc_iteration_stats,
    "nearest_center": nearest_center,
    "kmeans_lloyd": kmeans_lloyd,
    "kmeans_centers": kmeans_centers,
    "kmeans_multijob": kmeans_multijob,
    "kmeans_multijob_previous": kmeans_multijob_previous,
    "kmeans_auto": kmeans_auto,
    "nearest_of_many_centers": nearest_of_many_centers,
    "kmeans_many_centers": kmeans_many_centers,
    "wssse": wssse,
    "linreg_bgd": linreg_bgd,
    "linreg_sgd": linreg_sgd,
    "sgd_least_squares": sgd_least_squares,
    "sgd_intercept": sgd_intercept,
    "linreg_sgd_20": linreg_sgd_20,
    "sgd_least_squares_300": sgd_least_squares_300,
    "gen_kmeans_points": gen_kmeans_points,
    "gen_kmeans_centers": gen_kmeans_centers,
    "gen_linreg": gen_linreg,
    "gen_polynomial_features": gen_polynomial_features,
    "hash_uniform": uniform_draws,
    "trim_runs": trim_runs,
    "runtimes_minutes": runtimes_minutes,
    "relative_error": relative_error,
    "ernest_fit": ernest_fit,
    "ernest_predict": ernest_predict,
    "kernel_predict": kernel_predict,
    "interpolation_splits": interpolation_splits,
    "cv_score_kernel": cv_score_kernel,
    "cv_score_ernest": cv_score_ernest,
    "kernel_bandwidth": kernel_bandwidth,
    "best_model": best_model,
    "best_model_refit": best_model_refit,
    "best_model_predict": best_model_predict,
    "prediction_curve": prediction_curve,
    "subsample_splits": subsample_splits,
    "learning_curve": learning_curve,
    "learning_curve_average": learning_curve_average,
}
