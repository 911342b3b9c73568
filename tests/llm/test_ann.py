import numpy as np
import pytest

from tidewheel.llm import ann

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, queries, k=5):
    """Nearest by cosine, ties to the smaller id."""
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    out = {}
    for q in queries:
        v = x[ids == q][0]
        score = (x * v).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((v * v).sum()))
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:k]
        out[int(q)] = [(int(ids[i]), float(score[i])) for i in order]
    return out


def found(df, **options):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def vectors(n, dim, seed=0, spread=0.7):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, dim))
    x = centres[rng.integers(0, 12, n)] + spread * rng.standard_normal((n, dim))
    return [(i, x[i].astype(np.float32).tolist()) for i in range(n)]


def test_recall(spark):
    rows = vectors(6000, 48)
    df = spark.createDataFrame(rows, SCHEMA)
    params = ann.Params(per_list=100, block=150, chunk=64)
    got = found(ann.search(df, df.where("vec_id % 50 = 0"), params=params))
    want = brute(rows, range(0, 6000, 50))
    hit = [len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want]
    assert sum(hit) / (5 * len(want)) >= 0.95
    for q, best in got.items():
        scores = dict(brute(rows, [q], 6000)[q])
        assert all(abs(scores[i] - s) < 1e-12 for i, s in best)


def test_recall_without_clusters(spark):
    rng = np.random.default_rng(4)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((4000, 32)).astype(np.float32))]
    df = spark.createDataFrame(rows, SCHEMA)
    got = found(ann.search(df, df.where("vec_id % 50 = 0"), params=ann.Params(per_list=100)))
    want = brute(rows, range(0, 4000, 50))
    hit = [len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want]
    assert sum(hit) / (5 * len(want)) >= 0.9


def test_all_lists_probed_is_exact_with_ties(spark):
    rows = vectors(400, 16) + [(1000 + i, [1.0] * 16) for i in range(60)] + [(2000, [2.0] * 16)]
    df = spark.createDataFrame(rows, SCHEMA)
    params = ann.Params(per_list=20, coverage=1.0, tolerance=50.0, block=30, chunk=16)
    got = found(ann.search(df, df.where("vec_id % 50 = 0"), params=params))
    want = brute(rows, [i for i, _ in rows if i % 50 == 0])
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert [i for i, _ in got[1000]] == [1001, 1002, 1003, 1004, 1005]


def test_unusable_vectors_take_no_part(spark):
    rows = [
        (0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]),
        (6, [None, 1.0]), (7, []), (8, [1.0]), (None, [1.0, 0.0]), (50, [0.0, 3e38]), (50, [0.0, 3e38]), (100, None),
    ]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'clash' rank", "'clash' list")
    got = found(ann.search(df, df.where("vec_id % 50 = 0")))
    assert {q: [i for i, _ in v] for q, v in got.items()} == {0: [1, 50], 50: [1, 0]}
    assert got[0][0][1] == pytest.approx(2**-0.5)


def test_too_few(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert ann.search(none, none).collect() == []
    one = spark.createDataFrame([(0, [1.0])], SCHEMA)
    assert ann.search(one, one).collect() == []
