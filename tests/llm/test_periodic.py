import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import ODD, WORD, odd_documents
from tidewheel.llm import periodic, queries
from tidewheel.llm.common import words_of


def brute(words):
    """Start, length and period of all runs, by comparing all places with those a period on."""
    found = {}
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i < len(words) - q:
            end = i
            while end < len(words) - q and words[end] == words[end + q]:
                end += 1
            if end > i and end - i + q >= max(24, 3 * q):
                found.setdefault((i, end - i + q), q)
            i = max(end, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def left_over(words, runs):
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in dropped)


def generated(rng):
    kinds, size, parts = int(rng.integers(1, 6)), int(rng.integers(0, 220)), [np.zeros(0, np.int64)]
    while sum(map(len, parts)) < size:
        draw = rng.random()
        block = rng.integers(0, kinds, int(rng.integers(1, 20)))
        if draw < 0.4:
            parts.append(block)
        elif draw < 0.8:
            parts.append(np.resize(block, int(rng.integers(24, 80))))
        else:  # periods within periods
            inner = np.append(np.resize(block[:3], int(rng.integers(5, 40))), rng.integers(0, kinds))
            parts.append(np.tile(inner, int(rng.integers(1, 6))))
    return np.concatenate(parts)[:size].astype(np.int64)


def test_runs_against_brute_force():
    rng = np.random.default_rng(11)
    for _ in range(40):
        texts = [generated(rng) for _ in range(15)]
        owner, *found = periodic.runs_of(texts)
        for k, text in enumerate(texts):
            got = [run for o, *run in zip(owner.tolist(), *(x.tolist() for x in found)) if o == k]
            assert [tuple(r) for r in got] == brute(text.tolist())


def test_extensions_against_comparison():
    rng = np.random.default_rng(12)
    for _ in range(30):
        text = np.concatenate([[90], generated(rng), [91], generated(rng), [92]])
        if len(text) < 8:
            continue
        grammar = periodic.Grammar(text, len(text))
        i = rng.integers(1, len(text) - 1, 200)
        j = rng.integers(1, len(text) - 1, 200)
        i, j = np.minimum(i, j)[i != j], np.maximum(i, j)[i != j]
        ahead, behind = (grammar.extension(i, j, way) for way in (True, False))
        for a, b, x, y in zip(i.tolist(), j.tolist(), ahead.tolist(), behind.tolist()):
            want = next(k for k in range(len(text)) if text[a + k] != text[b + k])
            assert x == want
            assert y == next(k for k in range(len(text)) if text[a - k - 1] != text[b - k - 1])


def test_long_texts_and_texts_over_a_batch():
    one = np.zeros(300_000, np.int64)
    many = np.resize(np.arange(70_001), 280_000)
    owner, start, length, period = periodic.runs_of([one, np.arange(50), many])
    assert list(zip(owner.tolist(), start.tolist(), length.tolist(), period.tolist())) == [
        (0, 0, 300_000, 1), (2, 0, 280_000, 70_001),
    ]


def test_grid_in_parts(monkeypatch):
    rng = np.random.default_rng(13)
    texts = [generated(rng) for _ in range(30)]
    whole = periodic.runs_of(texts)
    monkeypatch.setattr(periodic, "PLACES", 7)
    assert all((a == b).all() for a, b in zip(whole, periodic.runs_of(texts)))


def judged(df):
    found = df.select("doc_id", words_of(F.col("text")).alias("words")).withColumn("found", periodic.periodic(F.col("words")))
    return found.select("doc_id", "words", "found.runs", periodic.collapsed(F.col("words"), F.col("found.kept")).alias("left"))


def test_odd_rows(spark):
    got = judged(odd_documents(spark)).collect()
    assert len(got) == len(ODD)
    want = []
    for key, text, *_ in ODD:
        words = WORD.findall(text or "")
        runs = brute(words) if len(words) < 1000 else []
        want.append((key, runs, left_over(words, runs)))
    assert sorted(((r.doc_id, [tuple(x) for x in r.runs], r.left) for r in got), key=repr) == sorted(want, key=repr)
    assert any(runs for _, runs, _ in want)


def test_nulls_and_no_rows(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [None] * 30), (4, ["a"] * 23)], "k int, words array<string>")
    rows = df.withColumn("found", periodic.periodic(F.col("words"))).orderBy("k").collect()
    assert [[tuple(x) for x in r.found.runs] for r in rows] == [[], [], [(0, 30, 1)], []]
    assert judged(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_ties_of_the_best_run(spark):
    schema = "runs array<struct<start:bigint,length:bigint,period:bigint>>"
    runs = [([(0, 30, 10), (5, 30, 10), (40, 61, 20)],), ([(0, 30, 10), (0, 33, 11), (9, 99, 33)],), ([],)]
    got = [r[0] for r in spark.createDataFrame(runs, schema).select(periodic.best_run(F.col("runs"))).collect()]
    assert [r and tuple(r) for r in got] == [(40, 61, 20), (0, 30, 10), None]


@pytest.fixture(scope="module")
def small(tmp_path_factory, spark):
    folder = tmp_path_factory.mktemp("docs")
    rng = np.random.default_rng(14)
    rows = [(k, " ".join(f"w{x}" for x in generated(rng))) for k in range(150)] + [(None, "a " * 30), (7, None), (8, "b " * 90)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return str(folder), rows


def test_query_against_brute_force(spark, small):
    folder, rows = small
    want = []
    for key, text in rows:
        words = WORD.findall(text or "")
        n, h = len(words), None if key is None else zlib.crc32(str(key).encode())
        if h is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        runs = brute(words)
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        told = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        want.append(
            (key, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2])
            + tuple(hashlib.sha256(t.encode()).hexdigest() for t in (told, left_over(words, runs)))
        )
    got = queries.op13_periodic(spark, folder)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(want, key=repr)
