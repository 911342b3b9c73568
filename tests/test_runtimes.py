import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tidewheel.functions.kernel import nonnegative_fit
from tidewheel.operators import runtimes

EPS = np.finfo(float).eps


def raw_rows():
    """Seven runs at each of eight scale-outs of three suites, by a rule."""
    out = []
    for s, (a, b, c) in enumerate([(1.0, 50.0, 0.0), (2.0, 10.0, 0.1), (0.0, 160.0, 0.01)]):
        for nodes, k in itertools.product(range(4, 36, 4), range(7)):
            noise = 1 + 0.05 * np.sin(13 * s + 7 * nodes + 31 * k)
            out.append((f"suite{s}", nodes, int(60000 * (a + b / nodes + c * nodes) * noise)))
    return out


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame(raw_rows(), "suite string, nodes int, runtime_ms bigint")


@pytest.fixture(scope="module")
def runs(raw):
    return runtimes.runtimes_minutes(raw).persist()


def trimmed():
    """``{suite: (x, y)}`` as arrays."""
    out = {}
    for suite in ("suite0", "suite1", "suite2"):
        xs, ys = [], []
        for nodes in range(4, 36, 4):
            for t in sorted(r[2] for r in raw_rows() if r[:2] == (suite, nodes))[1:-1]:
                xs.append(float(nodes))
                ys.append(t / 60000)
        out[suite] = np.array(xs), np.array(ys)
    return out


def features(x):
    return np.c_[np.ones_like(x), 1 / x, np.log(x), x]


def nnls(x, y):
    """The best of the non-negative least squares solutions on every set of columns, by SVD."""
    m = features(np.asarray(x, float))
    best = (np.inf, None)
    for members in range(16):
        cols = [k for k in range(4) if members >> k & 1]
        w = np.zeros(4)
        if cols:
            w[cols] = np.linalg.lstsq(m[:, cols], y, rcond=None)[0]
        error = ((m @ w - y) ** 2).sum()
        if (w >= 0).all() and error < best[0]:
            best = error, w
    return best[1]


def local(x, y, at, h, tol=None):
    m = np.c_[np.ones_like(x), x]
    weighted = m.T * np.exp(-((x - at) ** 2) / (2 * h ** 2))
    return np.array([1.0, at]) @ np.linalg.solve(weighted @ m + (tol or EPS) * np.eye(2), weighted @ y)


def folds(x, y):
    for fold in np.unique(x)[1:-1]:
        m = x == fold
        yield fold, x[~m], y[~m], y[m]


def kernel_scores(x, y, bandwidths):
    return {
        h: np.mean([np.mean(np.abs((local(a, b, fold, h) - t) / t)) for fold, a, b, t in folds(x, y)]) for h in bandwidths
    }


def ernest_score(x, y):
    return np.mean([np.mean(np.abs((features(np.array([fold])) @ nnls(a, b) - t) / t)) for fold, a, b, t in folds(x, y)])


def test_trim_drops_one_of_each_extreme(spark, partitions):
    df = spark.createDataFrame(
        [("a", 1, t) for t in (5, 5, 5, 9, 9)] + [("a", 2, 7)] + [("a", 3, 1), ("a", 3, 2)] + [("b", 1, t) for t in (4, 4, 4)] + [("b", 2, t) for t in (3, 1, 2)],
        "suite string, nodes int, runtime_ms bigint",
    )
    assert rows(runtimes.trim_runs(df)) == [("a", 1, 5), ("a", 1, 5), ("a", 1, 9), ("b", 1, 4), ("b", 2, 2)]


def test_trim_of_one_run_time_repeated_many_times(spark):
    df = spark.range(200_000).selectExpr("'a' as suite", "1 as nodes", "cast(42 as bigint) as runtime_ms")
    assert runtimes.trim_runs(df).count() == 199_998


def test_minutes(runs):
    got = rows(runs.select("suite", "nodes", F.round("minutes", 9)))
    want = sorted((s, int(a), round(b, 9)) for s, (x, y) in trimmed().items() for a, b in zip(x, y))
    assert got == want


def test_relative_error(spark):
    df = spark.createDataFrame([("k", 11.0, 10.0), ("k", 8.0, 10.0), ("j", 3.0, 3.0)], "g string, p double, a double")
    assert rows(runtimes.relative_error(df, "p", "a", "g")) == [("j", 0.0), ("k", pytest.approx(0.15))]


def test_nonnegative_fit_meets_the_optimality_conditions():
    rng = np.random.default_rng(0)
    m = rng.normal(size=(300, 12, 4))
    y = rng.normal(size=(300, 12))
    gram, moment = np.einsum("bri,brj->bij", m, m), np.einsum("bri,br->bi", m, y)
    w = nonnegative_fit(gram, moment)
    slope = np.einsum("bij,bj->bi", gram, w) - moment
    assert (w >= 0).all() and (slope > -1e-9).all() and np.abs(slope * w).max() < 1e-9
    assert ((w > 0).sum(axis=1) < 4).any() and (w > 0).all(axis=1).any() and (w == 0).any()


def test_nonnegative_fit_with_dependent_columns():
    x = np.array([4.0, 8.0, 12.0])
    m = features(x)
    y = np.array([10.0, 6.0, 5.0])
    w = nonnegative_fit((m.T @ m)[None], (m.T @ y)[None])[0]
    assert (w >= 0).all() and np.abs(m @ w - m @ nnls(x, y)).max() < 1e-5


def test_ernest_fit_and_prediction(spark, runs, partitions):
    fits = runtimes.fit_ernest(runs)
    got = dict(rows(fits))
    query = spark.createDataFrame([(s, 10) for s in trimmed()], "suite string, x int")
    predicted = dict((s, p) for s, _, p in rows(runtimes.predict_ernest(fits, query)))
    for suite, (x, y) in trimmed().items():
        assert got[suite] == pytest.approx(nnls(x, y), abs=1e-6)
        assert predicted[suite] == pytest.approx(float((features(np.array([10.0])) @ nnls(x, y))[0]), abs=1e-6)


@pytest.mark.parametrize("h", [1, 3, 20])
def test_kernel_prediction(spark, runs, h):
    query = spark.createDataFrame([(s, float(x)) for s in trimmed() for x in (2, 4, 9.5, 18, 40)], "suite string, x double")
    for suite, x, p in rows(runtimes.predict_kernel(runs, query, h)):
        assert p == pytest.approx(local(*trimmed()[suite], x, h), rel=1e-7, abs=1e-9)
    far = spark.createDataFrame([("suite0", 500.0)], "suite string, x double")
    assert runtimes.predict_kernel(runs, far, 1).first().predicted == 0.0


def test_kernel_prediction_options(spark, runs):
    query = spark.createDataFrame([("suite1", 10, 2.0), ("suite1", 10, 6.0)], "suite string, x int, bw double")
    x, y = trimmed()["suite1"]
    for _, at, h, p in rows(runtimes.predict_kernel(runs, query, "bw")):
        assert p == pytest.approx(local(x, y, float(at), h), rel=1e-8)
    for _, at, h, p in rows(runtimes.predict_kernel(runs, query, "bw", tol=0.5)):
        assert p == pytest.approx(local(x, y, float(at), h, 0.5), rel=1e-8)
    for _, at, h, p in rows(runtimes.predict_kernel(runs, query, "bw", degree=0)):
        w = np.exp(-((x - at) ** 2) / (2 * h * h))
        assert p == pytest.approx((w @ y) / w.sum(), rel=1e-9)
    for degree in (2, 3):
        for _, at, h, p in rows(runtimes.predict_kernel(runs, query, "bw", degree=degree)):
            m = np.vander(x, degree + 1, increasing=True)
            weighted = m.T * np.exp(-((x - at) ** 2) / (2 * h * h))
            c = np.linalg.solve(weighted @ m + EPS * np.eye(degree + 1), weighted @ y)
            assert p == pytest.approx(float(c @ float(at) ** np.arange(degree + 1)), rel=1e-4)


def test_interpolation_splits(raw):
    splits = runtimes.interpolation_splits(raw)
    per_fold = splits.groupBy("suite", "fold", "role").agg(F.count("*").alias("n"), F.min("nodes").alias("low"), F.max("nodes").alias("high"))
    got = {(s, f, r): (n, low, high) for s, f, r, n, low, high in rows(per_fold)}
    assert {f for _, f, _ in got} == set(range(8, 32, 4))
    assert got["suite0", 8, "test"] == (7, 8, 8) and got["suite0", 8, "train"] == (49, 4, 32)


def test_cross_validation_and_choice_of_model(spark, runs, partitions):
    bandwidths = (1, 2, 5, 9, 30)
    picked = {s: (bw, score) for s, bw, score in rows(runtimes.select_bandwidth(runs, bandwidths))}
    best = {r.suite: r for r in runtimes.fit_best_model(runs, bandwidths=bandwidths).collect()}
    again = {r.suite: r for r in runtimes.fit_best_model(runs, refit=True, bandwidths=bandwidths).collect()}
    families = set()
    for suite, (x, y) in trimmed().items():
        scores = kernel_scores(x, y, bandwidths)
        bw = min(bandwidths, key=lambda h: (scores[h], h))
        assert picked[suite] == (bw, pytest.approx(scores[bw], rel=1e-7))
        family = "ernest" if ernest_score(x, y) < scores[bw] else "kernel"
        families.add(family)
        assert (best[suite].family, best[suite].dropped) == (family, 28.0) and again[suite].dropped is None
        assert best[suite].score == pytest.approx(min(ernest_score(x, y), scores[bw]), rel=1e-6)
        kept = x != 28
        assert best[suite].coefficients == pytest.approx(nnls(x[kept], y[kept]), abs=1e-5)
        assert again[suite].coefficients == pytest.approx(nnls(x, y), abs=1e-5)
    query = spark.createDataFrame([(s, 28) for s in trimmed()], "suite string, x int")
    models = runtimes.fit_best_model(runs, bandwidths=bandwidths)
    for suite, _, p in rows(runtimes.predict_best(runs, models, query)):
        x, y = trimmed()[suite]
        kept = x != 28
        if best[suite].family == "ernest":
            want = float((features(np.array([28.0])) @ nnls(x[kept], y[kept]))[0])
        else:
            want = local(x[kept], y[kept], 28.0, best[suite].bw)
        assert p == pytest.approx(want, rel=1e-5)


def test_ties_between_bandwidths_go_to_the_smallest(spark):
    flat = spark.createDataFrame([("f", n, 60000) for n in (4, 8, 12, 16) for _ in range(3)], "suite string, nodes int, runtime_ms bigint")
    runs = runtimes.runtimes_minutes(flat)
    scores = runtimes.cv_score_kernel(runs, (50, 60)).select(F.round("error", 9)).distinct().collect()
    assert [r[0] for r in scores] == [0.0]
    assert runtimes.cv_score_ernest(runs).agg(F.max("error")).first()[0] == pytest.approx(0, abs=1e-9)


def test_prediction_curve(runs):
    got = runtimes.prediction_curve(runs, 4.0, 32.0, 15, bandwidths=(2, 5)).orderBy("suite", "x").collect()
    assert len(got) == 45 and [r.x for r in got[:3]] == [4.0, 6.0, 8.0] and got[14].x == 32.0
    for r in got:
        x, y = trimmed()[r.suite]
        scores = kernel_scores(x, y, (2, 5))
        assert r.kernel == pytest.approx(local(x, y, r.x, min(scores, key=scores.get)), rel=1e-7)
        assert r.ernest == pytest.approx(float((features(np.array([r.x])) @ nnls(x, y))[0]), rel=1e-6)


def test_random_splits(spark, runs, partitions):
    splits = runtimes.subsample_splits(runs, [3, 8, 9], 40, seed=4)
    got = rows(splits)
    assert {s for _, s, *_ in got} == {3, 8}
    known = {(s, int(a), b) for s, (x, y) in trimmed().items() for a, b in zip(x, y)}
    for (suite, size, _), group in itertools.groupby(got, key=lambda r: r[:3]):
        group = list(group)
        train = [r[4] for r in group if r[3] == "train"]
        test = [r[4] for r in group if r[3] == "test"]
        assert len(train) == len(set(train)) == size and len(test) == 1
        assert min(train) <= test[0] <= max(train)
        assert all((suite, r[4], r[5]) in known for r in group)
    used = {(r[0], r[4], r[5]) for r in got if r[1] == 8}
    assert used == known
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    assert rows(runtimes.subsample_splits(runs, [3, 8, 9], 40, seed=4)) == got
    assert rows(runtimes.subsample_splits(runs, [3, 8, 9], 40, seed=5)) != got


def test_draws_from_a_scale_out_with_most_runs_are_uniform(spark):
    many = spark.range(60000).selectExpr("'s' as suite", "8 as nodes", "cast(if(id % 3 = 0, 7, id) as double) as minutes")
    few = spark.createDataFrame([("s", n, float(n)) for n in (4, 16)], "suite string, nodes int, minutes double")
    drawn = runtimes.subsample_splits(many.unionByName(few), [3], 3000).filter("role = 'train' and nodes = 8")
    n, sevens, mean = drawn.agg(F.count("*"), F.count_if(F.col("minutes") == 7), F.avg(F.when(F.col("minutes") != 7, F.col("minutes")))).first()
    assert n == 3000 and sevens / n == pytest.approx(1 / 3, abs=0.04) and mean == pytest.approx(30000, rel=0.05)


def test_learning_curve(spark, runs):
    bandwidths = (1, 4, 10)
    splits = runtimes.subsample_splits(runs, [6, 7], 6, seed=2).persist()
    errors = {(s, size, it): e for s, size, it, *e in rows(runtimes.split_errors(splits, bandwidths))}
    assert len(errors) == 36
    for key, group in itertools.groupby(rows(splits), key=lambda r: r[:3]):
        group = list(group)
        train = sorted((float(r[4]), r[5]) for r in group if r[3] == "train")
        x, y = map(np.array, zip(*train))
        (at, actual), = [(float(r[4]), r[5]) for r in group if r[3] == "test"]
        scores = kernel_scores(x, y, bandwidths)
        bw = min(bandwidths, key=lambda h: (scores[h], h))
        kept = x != x[-2]
        if ernest_score(x, y) < scores[bw]:
            best = float((features(np.array([at])) @ nnls(x[kept], y[kept]))[0])
        else:
            best = local(x[kept], y[kept], at, bw)
        want = [float((features(np.array([at])) @ nnls(x, y))[0]), local(x, y, at, bw), best]
        assert errors[key] == pytest.approx([abs((w - actual) / actual) for w in want], abs=2e-4)
    curve = runtimes.learning_curve(runs, [6, 7], 6, seed=2, bandwidths=bandwidths)
    got = {(s, size, m): e for s, size, m, e in rows(curve)}
    mean = np.mean([errors["suite1", 7, it][1] for it in range(1, 7)])
    assert got["suite1", 7, "kernel"] == pytest.approx(mean)
    average = {(size, m): e for size, m, e in rows(runtimes.average_curve(curve))}
    assert average[6, "best"] == pytest.approx(np.mean([got[f"suite{k}", 6, "best"] for k in range(3)]))


def test_queries_draw_as_often_as_the_reference():
    from tidewheel import queries

    assert queries.LEARNING_ITERATIONS == 2000
