import math
import sys

import numpy as np
import pytest
from pyspark.mllib.regression import LabeledPoint, LinearRegressionWithSGD
from pyspark.sql import functions as F

from tests.conftest import rows
from tidewheel import queries as q
from tidewheel.operators import clustering, datagen, regression

SF = "/root/testdata/sf0.01"


def points(spark, values):
    return spark.createDataFrame(values, "x double, y double")


def test_nearest_center_lowest_id_wins_a_tie(spark):
    df = points(spark, [(0.0, 0.0), (5.0, 0.0), (9.0, 1.0)])
    got = clustering.nearest_center(df, [(7, 10.0, 0.0), (2, 0.0, 0.0)])
    assert [tuple(r) for r in got.orderBy("x").collect()] == [(0.0, 0.0, 2, 0.0), (5.0, 0.0, 2, 5.0), (9.0, 1.0, 7, 2 ** 0.5)]
    assert {r.center_id for r in clustering.nearest_center(df, []).collect()} == {-1}


def test_nearest_of_many_centers_agrees_with_brute_force(spark):
    rng = np.random.default_rng(3)
    values = rng.uniform(0, 10, (500, 2))
    for k in (1, 5, 100):
        centers = [(i, *map(float, c)) for i, c in enumerate(rng.uniform(0, 10, (k, 2)))]
        df = points(spark, [tuple(map(float, v)) for v in values])
        got = {(r.x, r.y): r.center_id for r in clustering.nearest_center(df, centers).collect()}
        for x, y in values:
            d = [((x - cx) ** 2 + (y - cy) ** 2) ** 0.5 for _, cx, cy in centers]
            assert got[x, y] == int(np.argmin(d))


def test_lloyd_on_prices(spark, partitions):
    df = q.price_points(spark, SF)
    clustered, centers = clustering.kmeans(df, q.START_CENTERS, 3)
    got = {r.id: (round(r.x, 4), round(r.y, 4)) for r in centers.collect()}
    assert got == {1: (12.9626, 13.2480), 2: (37.9543, 13.2968), 3: (12.9149, 39.3327), 4: (37.9513, 39.3844)}
    assert dict(rows(clustered.groupBy("center_id").count())) == {1: 14998, 2: 14777, 3: 15106, 4: 15119}
    cost = clustering.nearest_center(df, centers).agg(F.sum(F.col("distance") * F.col("distance"))).first()[0]
    assert cost == pytest.approx(6479696.814, abs=1e-2)


def test_lloyd_cost_never_rises(spark):
    df = q.price_points(spark, "/root/testdata/sf0.001")
    current, costs = q.START_CENTERS, []
    for _ in range(4):
        costs.append(clustering.nearest_center(df, current).agg(F.sum(F.col("distance") ** 2)).first()[0])
        current = clustering.center_rows(clustering.lloyd_step(df, current))
    assert costs == sorted(costs, reverse=True)


def test_kmeans_through_files(spark, tmp_path):
    df = points(spark, [(0.0, 0.0), (1.0, 0.0), (4.0, 0.0), (5.0, 0.0), (6.0, 0.0)])
    start = [(1, 0.0, 0.0), (2, 1.0, 0.0)]
    path = str(tmp_path / "km")
    last, centers = clustering.kmeans(df, start, 3, path=path)
    assert rows(last) == rows(clustering.kmeans(df, start, 3)[0])
    assert rows(spark.read.parquet(f"{path}/iteration_3")) == rows(centers)
    previous, used = clustering.kmeans(df, start, 2, path=path, final_step="previous")
    assert rows(used) == rows(spark.read.parquet(f"{path}/iteration_1")) == [(1, 0.0, 0.0), (2, 4.0, 0.0)]
    with pytest.raises(ValueError):
        clustering.kmeans(df, start, 1, final_step="previous")


def test_wssse_and_library_kmeans(spark):
    rng = np.random.default_rng(1)
    true = np.array([[0, 0, 0], [10, 0, 5], [0, 10, -5]], dtype=float)
    values = np.concatenate([c + rng.normal(0, 0.1, (60, 3)) for c in true])
    df = spark.createDataFrame([(list(map(float, v)),) for v in values], "features array<double>")
    clustered, centers, cost = clustering.kmeans_auto(df, 3, 10, seed=5)
    assert np.allclose(sorted(centers), sorted(true.tolist()), atol=0.1)
    want = sum(min(((v - np.array(c)) ** 2).sum() for c in centers) for v in values)
    assert clustering.wssse(df, centers).first()[0] == pytest.approx(want)
    assert cost == pytest.approx(want)
    assert clustered.groupBy("center_id").count().filter("count = 60").count() == 3


def test_batch_descent_by_hand(spark):
    df = points(spark, [(1.0, 2.0), (2.0, 3.0), (4.0, 7.0)])
    xs, ys = np.array([1.0, 2.0, 4.0]), np.array([2.0, 3.0, 7.0])
    t0, t1 = 0.5, -0.5
    for _ in range(7):
        steps = [(t0 - 0.01 * (t0 + t1 * x - y), t1 - 0.01 * (t0 + t1 * x - y) * x) for x, y in zip(xs, ys)]
        t0, t1 = np.mean(steps, axis=0)
    got = regression.linear_regression_bgd(df, 7, init=(0.5, -0.5)).first()
    assert tuple(got) == pytest.approx((t0, t1))


def test_descent_on_prices(spark):
    pairs, labeled = q.regression_data(spark, SF), q.labeled_points(spark, SF)
    assert tuple(regression.linear_regression_bgd(pairs, 5).first()) == pytest.approx((0.02586796, 0.01313482), abs=1e-8)
    five = [r.weight for r in regression.linear_regression_sgd(labeled, 5).collect()]
    assert five == pytest.approx([0.42971847, 0.17912163], abs=1e-8)
    full = regression.linear_regression_sgd(labeled).collect()
    assert [r.weight for r in full] == pytest.approx([0.46851064, 0.10677078], abs=1e-8) and full[0].steps == 45
    plain = [r.weight for r in regression.sgd_least_squares(labeled).collect()]
    assert plain == pytest.approx([0.34172786, 0.16304365], abs=1e-8)


def test_sgd_against_the_library(spark):
    data = datagen.gen_polynomial_features(spark.range(400), 4, seed=9).collect()
    df = spark.createDataFrame(data)
    for l2, kind in ((True, "l2"), (False, None)):
        model = LinearRegressionWithSGD.train(
            spark.sparkContext.parallelize([LabeledPoint(r.label, r.features) for r in data]),
            iterations=100, step=1.0, regParam=0.01, regType=kind, miniBatchFraction=1.0, convergenceTol=0.001,
        )
        got = [r.weight for r in regression.linear_regression_sgd(df, l2=l2).collect()]
        assert got == pytest.approx(list(model.weights), abs=1e-10)


def test_all_ways_to_the_gradient_agree(spark, monkeypatch):
    df = datagen.gen_polynomial_features(spark.range(3000), 6, seed=2).persist()
    want = [r.weight for r in regression.linear_regression_sgd(df, 30).collect()]
    monkeypatch.setattr(regression, "MAX_PRODUCT_COLUMNS", 1)
    assert [r.weight for r in regression.linear_regression_sgd(df, 30).collect()] == pytest.approx(want, abs=1e-9)
    monkeypatch.setattr(regression, "MAX_PRODUCT_WIDTH", 1)
    assert [r.weight for r in regression.linear_regression_sgd(df, 30).collect()] == pytest.approx(want, abs=1e-9)
    df.unpersist()


@pytest.mark.parametrize("width", [9, 62, 63, 130])
def test_products_of_wide_points(spark, monkeypatch, width):
    """Widths around one and two tiles, with sums of several tasks in several groups."""
    monkeypatch.setattr(regression, "FAN_IN", 3)
    rng = np.random.default_rng(width)
    x, y = rng.normal(0, 1, (300, width)), rng.normal(0, 1, 300)
    rows = [(float(b), [float(v) for v in a]) for a, b in zip(x, y)]
    df = spark.createDataFrame(rows, "label double, features array<double>").repartition(7)
    gram, moment = regression.mean_products(df, width)
    assert np.allclose(gram, x.T @ x / 300) and np.allclose(moment, x.T @ y / 300)


def test_points_of_unequal_width_are_refused(spark):
    rows = [(1.0, [1.0]), (2.0, [1.0, 2.0]), (3.0, [1.0, 3.0])]
    ragged = spark.createDataFrame(rows, "label double, features array<double>")
    with pytest.raises(ValueError, match="1 to 2 features"):
        regression.linear_regression_sgd(ragged)
    with pytest.raises(ValueError, match="1 to 2 features"):
        regression.sgd_least_squares(ragged)
    with pytest.raises(Exception, match="does not have 1 features"):
        regression.squared_error(ragged, [1.0]).collect()


def test_many_centers(spark):
    centers = [(k, float(k), 0.0) for k in range(20_000)]
    points = spark.createDataFrame([(12345.4, 0.0), (7.5, 1.0), (-3.0, 0.0)], "x double, y double")
    found = clustering.nearest_center(points, centers).collect()
    assert sorted(r["center_id"] for r in found) == [0, 7, 12345]


def test_plain_descent_options(spark):
    df = spark.createDataFrame([(3.0, [1.0]), (5.0, [2.0])], "label double, features array<double>")
    w = b = 0.0
    for t in range(1, 4):
        errors = [(w * x + b - y, x) for y, x in ((3.0, 1.0), (5.0, 2.0))]
        gw, gb = sum(e * x for e, x in errors) / 2, sum(e for e, _ in errors) / 2
        w, b = w - 0.1 * gw, b - 0.1 * gb
    got = regression.sgd_least_squares(df, 3, 0.1, decay="none", fit_intercept=True)
    assert [r.weight for r in got.orderBy("pos").collect()] == pytest.approx([w, b])
    assert regression.squared_error(df, [w]).first()[0] == pytest.approx(((w - 3) ** 2 + (2 * w - 5) ** 2) / 2)


def test_many_centers_in_blocks(spark, no_broadcast, monkeypatch):
    """Crowded centres, ties, points far outside, and points without coordinates."""
    monkeypatch.setattr(clustering, "_BLOCK_CENTERS", 8)
    rng = np.random.default_rng(7)
    places = np.round(np.concatenate([rng.normal(0, 1, (150, 2)), rng.uniform(-40, 40, (150, 2)), np.full((30, 2), 5.0)]), 1)
    centers = [(int(i), float(x), float(y)) for i, (x, y) in zip(rng.permutation(len(places)), places)]
    values = [tuple(map(float, v)) for v in np.round(rng.uniform(-60, 60, (200, 2)), 1)] + [(5.0, 5.0)]
    df = points(spark, values + [(None, 1.0)])
    got = clustering.nearest_center(df, spark.createDataFrame(centers, "id int, x double, y double")).collect()
    assert len(got) == len(values) + 1
    for r in got:
        if r.x is None:
            assert r.center_id == -1
            continue
        want = min((math.sqrt((r.x - x) * (r.x - x) + (r.y - y) * (r.y - y)), i) for i, x, y in centers)
        assert (r.distance, r.center_id) == want


def test_steps_with_many_centers(spark):
    rng = np.random.default_rng(8)
    values = [tuple(map(float, v)) for v in rng.uniform(0, 10, (600, 2))]
    start = [(i, *map(float, c)) for i, c in enumerate(rng.uniform(0, 10, (90, 2)))]
    current = start
    for _ in range(2):
        of: dict = {}
        for x, y in values:
            _, i = min((((x - cx) * (x - cx) + (y - cy) * (y - cy)) ** 0.5, i) for i, cx, cy in current)
            of.setdefault(i, []).append((x, y))
        current = [(i, *np.mean(v, axis=0)) for i, v in sorted(of.items())]
    _, centers = clustering.kmeans(points(spark, values), start, 2)
    got = sorted(tuple(r) for r in centers.collect())
    assert np.allclose(np.array(got), np.array(current))


def test_places_meet_few_of_many_blocks(spark, monkeypatch):
    """Copies of centres and of points count once, and a point asks near blocks only, wherever it lies."""
    monkeypatch.setattr(clustering, "_BLOCK_CENTERS", 16)
    rng = np.random.default_rng(9)
    angles = rng.uniform(0, 2 * math.pi, 2000)
    centers = [(i, math.cos(a), math.sin(a)) for i, a in enumerate(angles)] + [(k, 0.5, float(k - 5000)) for k in range(5000, 5600)]
    copies = centers + [(i + 10_000, x, y) for i, x, y in centers] + [(-5, math.nan, 0.0), (-6, None, 0.0), (-7, 0.0, math.inf)]
    values = [tuple(map(float, v)) for v in rng.normal(0, 1, (300, 2))] + [(700.0, 700.0), (-900.0, 0.1), (0.5, 300.25)]
    df = points(spark, values * 3 + [(None, 1.0), (math.nan, 1.0), (math.inf, 1.0)])
    table = spark.createDataFrame(copies, "id int, x double, y double")
    got = clustering.nearest_center(df, table).collect()
    assert sum(r.center_id == -1 and r.distance == sys.float_info.max for r in got) == 3 and len(got) == 912
    for r in got:
        if r.center_id != -1:
            assert (r.distance, r.center_id) == min((math.sqrt((r.x - x) * (r.x - x) + (r.y - y) * (r.y - y)), i) for i, x, y in centers)
    _, blocks = clustering._blocks(table)
    x, y = np.array(values).T
    home = blocks.home(x, y)
    d = np.array([min(math.hypot(px - cx, py - cy) for _, cx, cy in centers) for px, py in values])
    owner, _ = blocks.within(x, y, d * 1.000001)
    assert len(blocks.min_x) > 150 and len(owner) < 5 * len(values) and len(home) == len(values)


@pytest.mark.parametrize("width", [3, 20])
def test_points_are_made_once(spark, width):
    """One pass reads every point and sees that all are as wide; wider and narrower ones are refused."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def features(k):
        made.add(1)
        return [float((k * i) % 7) for i in range(1, width + 1)]

    ids = spark.range(0, 400, 1, 4).select(F.col("id").cast("double").alias("label"), "id")
    regression.sgd_least_squares(ids.select("label", features("id").alias("features")), 2).collect()
    assert 400 <= made.value < 800
    for odd in (0, 399):

        @F.udf("array<double>")
        def uneven(k, odd):
            return [float((k * i) % 7) for i in range(1, width + 1 + (k == odd))]

        with pytest.raises(ValueError, match=f"points have {width} to {width + 1} features"):
            regression.sgd_least_squares(ids.select("label", uneven("id", F.lit(odd)).alias("features")), 2)
