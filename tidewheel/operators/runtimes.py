"""Run times as a function of scale-out, for many suites at once.

Runs are rows ``(suite, nodes, runtime_ms)`` or, once converted, ``(suite, nodes,
minutes)``. A suite may hold any number of runs: they are first reduced to one row
per scale-out, and only those few points meet each other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.functions.hashing import hash_uniform
from tidewheel.functions.kernel import (
    EPSILON,
    ernest_products,
    ernest_sums,
    ernest_value,
    fit_each,
    local_regression,
    number_array,
    mean_of,
    regress_each,
    relative_deviation,
    scale_out_point,
)
from tidewheel.plans.skew import join_few
from tidewheel.plans.state import checkpointed

BANDWIDTHS = tuple(range(1, 101))

_REPEAT_BLOCK = 65_536
_NUMBERING_BUCKETS = 4_096


# -- runs ------------------------------------------------------------------


def _repeat(df: DataFrame, times: str) -> DataFrame:
    """Each row as often as its ``times`` says, by blocks so that no long array is built."""
    block = F.explode(F.sequence(F.lit(0), F.floor((F.col(times) - 1) / F.lit(_REPEAT_BLOCK)))).alias("_block")
    blocks = df.select("*", block)
    size = F.least(F.lit(_REPEAT_BLOCK), F.col(times) - F.col("_block") * _REPEAT_BLOCK)
    return blocks.select("*", F.explode(F.sequence(F.lit(1), size.cast("int"))).alias("_copy")).drop(
        times, "_block", "_copy"
    )


def trim_runs(runs: DataFrame) -> DataFrame:
    """Runs without one fastest and one slowest per suite and scale-out.

    Runs between the extremes pass where they are. Those at an extreme are counted, and
    repeated as often as their count says when one is taken off for each extreme.
    """
    key, time = ["suite", "nodes"], F.col("runtime_ms")
    ends = runs.groupBy(*key).agg(F.min("runtime_ms").alias("_low"), F.max("runtime_ms").alias("_high"))
    marked = join_few(runs.select(*key, "runtime_ms"), ends, key)
    at_end = (time == F.col("_low")) | (time == F.col("_high"))
    off = (time == F.col("_low")).cast("int") + (time == F.col("_high")).cast("int")
    counted = marked.filter(at_end).groupBy(*key, "runtime_ms").agg((F.count("*") - F.max(off)).alias("n"))
    between = marked.filter(~at_end).select(*key, "runtime_ms")
    return between.unionByName(_repeat(counted.filter(F.col("n") > 0), "n"))


def runtimes_minutes(runs: DataFrame) -> DataFrame:
    """``(suite, nodes, minutes)`` of the trimmed runs."""
    return trim_runs(runs).select("suite", "nodes", (F.col("runtime_ms") / F.lit(60000.0)).alias("minutes"))


def relative_error(df: DataFrame, predicted: str, actual: str, *keys: str) -> DataFrame:
    """``(keys..., error)``: mean absolute deviation relative to the actual value."""
    return df.groupBy(*keys).agg(F.avg(relative_deviation(F.col(predicted), F.col(actual))).alias("error"))


def _counted(runs: DataFrame) -> DataFrame:
    return runs.groupBy("suite", "nodes", "minutes").agg(F.count("*").alias("n"))


def scale_outs(runs: DataFrame) -> DataFrame:
    """``(suite, points)``: per suite the array of its scale-outs with run count and total minutes."""
    totals = runs.groupBy("suite", "nodes").agg(F.count("*").alias("n"), F.sum("minutes").alias("total"))
    point = scale_out_point(F.col("nodes"), F.col("n"), F.col("total"))
    return totals.groupBy("suite").agg(F.sort_array(F.collect_list(point)).alias("points"))


def _inner_nodes(points: Column) -> Column:
    """The scale-outs but the smallest and the largest, of a sorted array of points."""
    xs = F.transform(points, lambda p: p["x"])
    return F.slice(xs, F.lit(2), F.greatest(F.size(xs) - 2, F.lit(0)))


def _without(points: Column, x: Column) -> Column:
    return F.filter(points, lambda p: p["x"] != x)


# -- models ----------------------------------------------------------------


def fit_ernest(runs: DataFrame, *keys: str) -> DataFrame:
    """``(keys..., coefficients)``: non-negative least squares on 1, 1/x, log x and x per key (suite by default)."""
    keys = keys or ("suite",)
    products = ernest_products(F.col("nodes"), F.lit(1.0), F.col("minutes"))
    sums = runs.groupBy(*keys).agg(*[F.sum(p).alias(f"_s{k}") for k, p in enumerate(products)])
    problem = F.array(F.array(*[f"_s{k}" for k in range(len(products))]))
    return sums.select(*keys, F.element_at(fit_each(problem), 1).alias("coefficients"))


def predict_ernest(models: DataFrame, query: DataFrame, x: str = "x") -> DataFrame:
    """Query rows ``(suite, x)`` with ``predicted`` minutes."""
    return join_few(query, models, ["suite"]).select(
        *query.columns, ernest_value(F.col("coefficients"), F.col(x)).alias("predicted")
    )


def predict_kernel(
    runs: DataFrame, query: DataFrame, bandwidth: float | str = "bw", degree: int = 1, x: str = "x", tol: float = EPSILON
) -> DataFrame:
    """Query rows ``(suite, x)`` with ``predicted`` minutes by local regression over the suite's runs.

    ``bandwidth`` is a number, or the name of a column of the query; ``tol`` is added to the
    diagonal of the system that is solved.
    """
    h = F.col(bandwidth) if isinstance(bandwidth, str) else F.lit(float(bandwidth))
    value = local_regression(F.col("points"), F.col(x).cast("double"), h.cast("double"), degree, tol)
    known = join_few(query, scale_outs(runs), ["suite"])
    return known.select(*query.columns, value.alias("predicted"))


# -- cross-validation ------------------------------------------------------


def interpolation_splits(runs: DataFrame) -> DataFrame:
    """Runs once per ``fold`` with their ``role``: a fold tests one scale-out and trains on the others.

    The smallest and largest scale-out of a suite are never tested.
    """
    nodes = runs.groupBy("suite").agg(F.sort_array(F.collect_set("nodes")).alias("nodes"))
    inner = F.slice("nodes", F.lit(2), F.greatest(F.size("nodes") - 2, F.lit(0)))
    folds = nodes.select("suite", inner.alias("folds"))
    per_fold = join_few(runs, folds, ["suite"]).select(*runs.columns, F.explode("folds").alias("fold"))
    return per_fold.withColumn("role", F.when(F.col("nodes") == F.col("fold"), "test").otherwise("train"))


def _fold_errors(runs: DataFrame, predictions: DataFrame, models: int) -> DataFrame:
    """``(suite, fold, errors)``: mean relative errors of the array ``predicted``, one per model, over the runs at the fold.

    A run says only between which two predictions it lies. For run times above 0 the sum of
    ``|p / t - 1|`` follows from the counts and the sums of ``1 / t`` between predictions,
    so runs are reduced to a row per gap before any shuffle, whatever the number of models.
    """
    known = checkpointed(predictions.withColumn("cuts", F.array_sort("predicted")))
    tested = join_few(runs.select("suite", F.col("nodes").alias("fold"), "minutes"), known, ["suite", "fold"], computed=True)
    # Cuts at or below a run, by halving; each step is a column, so it is computed once.
    tested, step = tested.withColumn("gap", F.lit(0)), 1 << models.bit_length()
    while step := step // 2:
        passed = F.get("cuts", F.col("gap") + F.lit(step - 1)) <= F.col("minutes")
        tested = tested.withColumn("gap", F.col("gap") + F.when(passed, F.lit(step)).otherwise(F.lit(0)))
    gaps = tested.groupBy("suite", "fold", "gap").agg(
        F.count("*").alias("n"), F.sum(F.lit(1.0) / F.col("minutes")).alias("inverse")
    )
    held = gaps.groupBy("suite", "fold").agg(
        F.sort_array(F.collect_list(F.struct("gap", "n", "inverse"))).alias("gaps"), F.sum("n").alias("n")
    )

    def error(p: Column) -> Column:
        below = F.size(F.filter("cuts", lambda cut: cut < p))

        def add(total: Column, g: Column) -> Column:
            over = p * g["inverse"] - g["n"]
            return total + F.when(g["gap"] > below, -over).otherwise(over)

        return F.aggregate("gaps", F.lit(0.0), add) / F.col("n")

    return held.join(known, ["suite", "fold"]).select("suite", "fold", F.transform("predicted", error).alias("errors"))


def _per_fold(runs: DataFrame) -> DataFrame:
    """``(suite, fold, points)``: the training points of every fold."""
    folds = scale_outs(runs).select("suite", "points", F.explode(_inner_nodes(F.col("points"))).alias("at"))
    return folds.select(
        "suite",
        F.col("at").cast(runs.schema["nodes"].dataType).alias("fold"),
        "at",
        _without(F.col("points"), F.col("at")).alias("points"),
    )


def cv_score_kernel(runs: DataFrame, bandwidths: Sequence[float] = BANDWIDTHS) -> DataFrame:
    """``(suite, fold, bw, error)`` of local regression for every fold and bandwidth."""
    tried = sorted({float(bw) for bw in bandwidths})
    each = regress_each(_per_fold(runs), ("suite", "fold", "at"), tried)
    in_order = F.sort_array(F.collect_list(F.struct("bw", "predicted")))
    predicted = each.groupBy("suite", "fold").agg(F.transform(in_order, lambda v: v["predicted"]).alias("predicted"))
    errors = _fold_errors(runs, predicted, len(tried))
    return errors.select("suite", "fold", F.inline(F.arrays_zip(number_array(tried).alias("bw"), F.col("errors").alias("error"))))


def cv_score_ernest(runs: DataFrame) -> DataFrame:
    """``(suite, fold, error)`` of the non-negative least squares model for every fold."""
    fitted = _per_fold(runs).select(
        "suite", "fold", "at", fit_each(F.array(ernest_sums(F.col("points")))).alias("fits")
    )
    value = ernest_value(F.element_at("fits", 1), F.col("at"))
    errors = _fold_errors(runs, fitted.select("suite", "fold", F.array(value).alias("predicted")), 1)
    return errors.select("suite", "fold", F.get("errors", F.lit(0)).alias("error"))


def select_bandwidth(runs: DataFrame, bandwidths: Sequence[float] = BANDWIDTHS) -> DataFrame:
    """``(suite, bw, score)``: the bandwidth with the least mean error over folds, the smallest on a tie."""
    means = cv_score_kernel(runs, bandwidths).groupBy("suite", "bw").agg(F.avg("error").alias("score"))
    return (
        means.groupBy("suite")
        .agg(F.min(F.struct("score", "bw")).alias("best"))
        .select("suite", "best.bw", "best.score")
    )


def fit_best_model(runs: DataFrame, refit: bool = False, bandwidths: Sequence[float] = BANDWIDTHS) -> DataFrame:
    """``(suite, family, bw, score, dropped, coefficients)``: the model with the least mean error over folds.

    A local regression wins a tie. Unless ``refit``, the model keeps the training data
    of the last fold: all runs but those at scale-out ``dropped``.
    """
    kernel = select_bandwidth(runs, bandwidths).withColumnRenamed("score", "kernel_score")
    ernest = cv_score_ernest(runs).groupBy("suite").agg(F.avg("error").alias("ernest_score"))
    points = F.col("points")
    dropped = F.lit(None).cast("double") if refit else F.element_at(_inner_nodes(points), -1)
    trained = scale_outs(runs).filter(F.size("points") > 2).select("suite", "points", dropped.alias("dropped"))
    kept = F.filter(points, lambda p: F.col("dropped").isNull() | (p["x"] != F.col("dropped")))
    fits = trained.select(
        "suite", "dropped", F.element_at(fit_each(F.array(ernest_sums(kept))), 1).alias("coefficients")
    )
    ernest_wins = F.col("ernest_score") < F.col("kernel_score")
    return (
        kernel.join(ernest, "suite")
        .join(fits, "suite")
        .select(
            "suite",
            F.when(ernest_wins, "ernest").otherwise("kernel").alias("family"),
            F.when(~ernest_wins, F.col("bw")).alias("bw"),
            F.least("ernest_score", "kernel_score").alias("score"),
            "dropped",
            "coefficients",
        )
    )


def predict_best(runs: DataFrame, models: DataFrame, query: DataFrame, x: str = "x") -> DataFrame:
    """Query rows ``(suite, x)`` with ``predicted`` minutes by each suite's best model."""
    points = F.filter("points", lambda p: F.col("dropped").isNull() | (p["x"] != F.col("dropped")))
    at = F.col(x).cast("double")
    value = F.when(F.col("family") == "ernest", ernest_value(F.col("coefficients"), at)).otherwise(
        local_regression(points, at, F.coalesce("bw", F.lit(1.0)))
    )
    known = scale_outs(runs).join(models, "suite")
    return join_few(query, known, ["suite"]).select(*query.columns, value.alias("predicted"))


def prediction_curve(
    runs: DataFrame, lo: float = 2.0, hi: float = 62.0, n: int = 500, bandwidths: Sequence[float] = BANDWIDTHS
) -> DataFrame:
    """``(suite, x, ernest, kernel)``: both models, fitted to all runs, on an even grid of scale-outs."""
    step = (hi - lo) / (n - 1)
    models = (
        scale_outs(runs)
        .join(select_bandwidth(runs, bandwidths), "suite")
        .select("suite", "points", "bw", F.element_at(fit_each(F.array(ernest_sums(F.col("points")))), 1).alias("c"))
    )
    grid = models.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k"))
    grid = grid.withColumn("x", F.lit(float(lo)) + F.col("k") * F.lit(step))
    return grid.select(
        "suite",
        "x",
        ernest_value(F.col("c"), F.col("x")).alias("ernest"),
        local_regression(F.col("points"), F.col("x"), F.col("bw")).alias("kernel"),
    )


# -- learning curves -------------------------------------------------------


def _draw_runs(runs: DataFrame, draws: DataFrame) -> DataFrame:
    """Draws ``(suite, nodes, runs, number, ...)`` with the minutes of run ``number`` of ``runs`` at a scale-out.

    Runs are numbered bucket after bucket, and only inside the buckets that a draw
    falls into, so no task has to order all runs of a scale-out.
    """
    at, first_key = ["suite", "nodes", "bucket"], ["suite", "nodes"]
    in_ms = F.round(F.col("minutes") * 60000).cast("bigint")
    counted = _counted(runs).withColumn("bucket", F.pmod(in_ms, F.lit(_NUMBERING_BUCKETS)))
    earlier = Window.partitionBy(*first_key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = counted.groupBy(*at).agg(F.sum("n").alias("held"))
    starts = sizes.select(
        *at,
        "held",
        F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("start"),
        F.sum("held").over(Window.partitionBy(*first_key)).alias("runs"),
    )
    # Equal stretches of numbers turn the search for the bucket into a join on the stretch.
    stretch = F.ceil(F.col("runs") / F.lit(_NUMBERING_BUCKETS))
    spans = F.sequence(
        F.floor(F.col("start") / stretch), F.floor((F.col("start") + F.col("held") - 1) / stretch)
    )
    buckets = starts.select(*at, "start", "held", F.explode(spans).alias("stretch"))
    found = draws.withColumn("stretch", F.floor(F.col("number") / stretch)).join(buckets, [*first_key, "stretch"])
    offset = F.col("number") - F.col("start")
    found = found.filter((offset >= 0) & (offset < F.col("held"))).withColumn("offset", offset)

    upto = Window.partitionBy(*at).orderBy("minutes").rowsBetween(Window.unboundedPreceding, 0)
    numbered = counted.join(found.select(*at), at, "left_semi").select(
        *at, "minutes", "n", F.sum("n").over(upto).alias("next")
    )
    inside = (F.col("offset") < F.col("next")) & (F.col("offset") >= F.col("next") - F.col("n"))
    return found.join(numbered, at).filter(inside).select(*draws.columns, "minutes").drop("runs", "number")


def subsample_splits(runs: DataFrame, sizes: Sequence[int], n_iter: int, seed: int = 1) -> DataFrame:
    """``(suite, size, iter, role, nodes, minutes)``: random training sets, each with one test run.

    An iteration draws ``size`` different scale-outs to train on, a scale-out between
    the smallest and largest of them to test (which may be one of them), and a run
    for each. Draws depend on seed, suite, size and iteration alone. A suite with
    fewer scale-outs than ``size`` has no such split.
    """

    def draw(stream: int, *at) -> Column:
        return hash_uniform(seed, F.concat_ws("/", "suite", "size", "iter", *(a.cast("string") for a in at)), stream)

    each_size = scale_outs(runs).select("suite", "points", F.explode(F.array(*map(F.lit, sizes))).alias("size"))
    problems = (
        each_size.filter(F.size("points") >= F.col("size"))
        .select("suite", "points", "size", F.explode(F.sequence(F.lit(1), F.lit(n_iter))).alias("iter"))
        .repartition("suite", "size", "iter")
    )
    shuffled = F.array_sort(
        F.transform("points", lambda p: F.struct(draw(0, p["x"]).alias("u"), p["x"].alias("x"), p["n"].alias("n")))
    )
    chosen = problems.withColumn("train", F.slice(shuffled, F.lit(1), F.col("size")))
    xs = F.transform("train", lambda t: t["x"])
    spanned = chosen.withColumns({"low": F.array_min(xs), "high": F.array_max(xs)}).withColumn(
        "between", F.filter("points", lambda p: (p["x"] >= F.col("low")) & (p["x"] <= F.col("high")))
    )
    tested = spanned.withColumn(
        "test", F.element_at("between", (F.floor(draw(1) * F.size("between")) + 1).cast("int"))
    )

    def pick(role: str, p: Column, stream: int) -> Column:
        return F.struct(
            F.lit(role).alias("role"),
            p["x"].alias("nodes"),
            p["n"].cast("bigint").alias("runs"),
            F.floor(draw(stream, p["x"]) * p["n"]).alias("number"),
        )

    picks = F.concat(F.transform("train", lambda t: pick("train", t, 2)), F.array(pick("test", F.col("test"), 3)))
    drawn = tested.select("suite", "size", "iter", F.explode(picks).alias("p")).select(
        "suite",
        "size",
        "iter",
        "p.role",
        F.col("p.nodes").cast(runs.schema["nodes"].dataType).alias("nodes"),
        "p.runs",
        "p.number",
    )
    return _draw_runs(runs, drawn)


def split_errors(splits: DataFrame, bandwidths: Sequence[float] = BANDWIDTHS) -> DataFrame:
    """``(suite, size, iter, ernest, kernel, best)``: relative error of three models on each random split.

    Splits are partitioned by their key once. The inner folds, the choice of bandwidth
    and the choice between the two models group by that key and shuffle no further.
    """
    key = ["suite", "size", "iter"]
    slots = splits.sparkSession.sparkContext.defaultParallelism
    trains, tests = F.col("role") == "train", F.col("role") == "test"
    point = scale_out_point(F.col("nodes"), F.lit(1), F.col("minutes"))
    # A fixed number of partitions, since the rows are few but costly.
    problems = (
        splits.repartition(slots, *key)
        .groupBy(*key)
        .agg(
            F.sort_array(F.collect_list(F.when(trains, point))).alias("points"),
            F.max(F.when(tests, F.col("nodes"))).cast("double").alias("test_at"),
            F.max(F.when(tests, F.col("minutes"))).alias("actual"),
        )
    )
    points = F.col("points")
    inner = F.slice("points", F.lit(2), F.size("points") - 2)

    folds = problems.select(*key, "points", F.inline(inner)).select(
        *key, F.col("x").alias("at"), F.col("total").alias("tested"), _without(points, F.col("x")).alias("points")
    )
    each = regress_each(folds, (*key, "at", "tested"), bandwidths)
    chosen = (
        each.groupBy(*key, "bw")
        .agg(F.avg(relative_deviation(F.col("predicted"), F.col("tested"))).alias("score"))
        .groupBy(*key)
        .agg(F.min(F.struct("score", "bw")).alias("kernel_best"))
    )

    # As a column of its own: a lambda around a lambda cannot stand in the argument of a Python function.
    fold = F.transform(inner, lambda f: F.struct(f["x"], f["total"].alias("y"), _without(points, f["x"]).alias("rest")))
    scored = problems.join(chosen, key).withColumn("folds", fold)
    sums = F.concat(F.array(ernest_sums(points)), F.transform("folds", lambda f: ernest_sums(f["rest"])))
    scored = scored.withColumn("fits", fit_each(sums))
    fold_errors = F.zip_with(
        "folds",
        F.slice("fits", F.lit(2), F.size("folds")),
        lambda f, c: relative_deviation(ernest_value(c, f["x"]), f["y"]),
    )
    scored = scored.withColumn("ernest_score", mean_of(fold_errors, F.size("folds")))

    at, bw = F.col("test_at"), F.col("kernel_best.bw")
    kept = F.element_at("folds", -1)["rest"]
    best = F.when(
        F.col("ernest_score") < F.col("kernel_best.score"), ernest_value(F.element_at("fits", -1), at)
    ).otherwise(local_regression(kept, at, bw))
    predictions = {
        "ernest": ernest_value(F.element_at("fits", 1), at),
        "kernel": local_regression(points, at, bw),
        "best": best,
    }
    return scored.select(
        *key, *[relative_deviation(value, F.col("actual")).alias(name) for name, value in predictions.items()]
    )


def learning_curve(
    runs: DataFrame,
    sizes: Sequence[int] = tuple(range(3, 16)),
    n_iter: int = 2000,
    seed: int = 1,
    bandwidths: Sequence[float] = BANDWIDTHS,
) -> DataFrame:
    """``(suite, size, model, error)``: mean error of each model over random splits of each size.

    The splits are drawn once and kept in a checkpoint, since the models read them more than once.
    """
    return curve_of(split_errors(checkpointed(subsample_splits(runs, sizes, n_iter, seed)), bandwidths))


def curve_of(errors: DataFrame) -> DataFrame:
    """``(suite, size, model, error)``: the errors of single splits, averaged."""
    means = errors.groupBy("suite", "size").agg(*[F.avg(m).alias(m) for m in ("ernest", "kernel", "best")])
    return means.unpivot(["suite", "size"], ["ernest", "kernel", "best"], "model", "error")


def average_curve(curve: DataFrame) -> DataFrame:
    """``(size, model, error)``: a learning curve averaged over suites."""
    return curve.groupBy("size", "model").agg(F.avg("error").alias("error"))


# -- host metrics ----------------------------------------------------------


def run_metrics(host_metrics: DataFrame, runs: DataFrame) -> DataFrame:
    """``(run_key, suite, nodes, run, host, samples, avg_*, max_*, runtime_ms)``: metrics per host beside the run time.

    A run is known by its experiment (``suite``), scale-out and number.
    """
    names = [c for c in host_metrics.columns if c not in ("suite", "nodes", "run", "host", "seq")]
    per_host = host_metrics.groupBy("suite", "nodes", "run", "host").agg(
        F.count("*").alias("samples"),
        *[F.avg(c).alias(f"avg_{c}") for c in names],
        *[F.max(c).alias(f"max_{c}") for c in names],
    )
    key = F.format_string("%s.top%03d.run%02d", "suite", "nodes", "run").alias("run_key")
    return per_host.join(runs, ["suite", "nodes", "run"]).select(key, *per_host.columns, "runtime_ms")
