from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import DOCS, ODD, WORD, odd_documents
from tidewheel.llm import mixing, sharding
from tidewheel.llm.common import word_count


def fair(sizes, weights, most=3.0):
    """Targets by sharing the excess again and again."""
    total = sum(sizes.values())
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_ = {}, set(order)
    while open_:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        full = {s for s in open_ if share[s] > most * sizes[s] + 1e-9}
        if not full:
            return target | share
        target |= {s: most * sizes[s] for s in full}
        open_ -= full
    return target


def test_targets_are_those_of_resharing(spark):
    for sizes in (
        {"a": 10, "b": 100, "c": 1000},
        {"a": 1, "b": 1, "c": 1, "d": 5000, None: 40},
        {"x": 0, "y": 10},
        {f"s{i:02}": (i * 37) % 101 for i in range(20)},
    ):
        rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        found = {r["source"]: r["target"] for r in mixing.targets(rows).collect()}
        want = fair(sizes, (5, 2, 1))
        assert found == pytest.approx(want)


def documents(spark):
    rows = [(i, f"s{i % 7 if i % 3 else 0}", 1 + (i * 7919) % 400) for i in range(3000)]
    return spark.createDataFrame(rows, "doc_id long, source string, words long")


def test_mix_meets_its_targets_and_agrees_with_itself(spark):
    docs = documents(spark)
    found = mixing.pareto_mix(docs, F.col("words")).collect()
    taken, target = Counter(), {}
    for r in found:
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        # Certain whole copies, and one more at most.
        assert 0 <= r["copies"] - r["target"] // r["source_size"] <= 1
    for source in target:
        assert abs(taken[source] - target[source]) <= 200
    again = mixing.pareto_mix(docs.repartition(5, "words"), F.col("words")).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, again))


def test_longer_documents_are_likelier(spark):
    rows = [(i, "only" if i % 2 else "other", 5 if i % 4 < 2 else 500) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, words long")
    found = mixing.pareto_mix(docs, F.col("words"), weights=(1, 3)).collect()
    shares = defaultdict(list)
    for r in found:
        if r["source"] == "only":
            shares[r["size"]].append(r["copies"])
    assert sum(shares[500]) / len(shares[500]) > sum(shares[5]) / len(shares[5])


def test_mix_of_odd_rows_and_repeats(spark):
    docs = odd_documents(spark)
    mix = mixing.pareto_mix(docs, word_count(F.col("text")))
    found = mix.collect()
    assert len(found) == len(ODD)
    for r in found:
        text = next(t for i, t, *_ in ODD if i == r["doc_id"])
        assert r["size"] == len(WORD.findall(text or ""))
        assert 0 <= r["taken"] <= 3 * r["size"]
    rows = mixing.repeat_rows(docs, mix)
    assert rows.columns == docs.columns
    assert rows.count() == sum(r["copies"] for r in found)
    assert mixing.pareto_mix(spark.createDataFrame([], DOCS), F.lit(1)).collect() == []


def test_repeated_rows_are_taken_one_by_one(spark):
    """A third of a source under one key: its target is met to half a document, and rows are repeated as the mix says."""
    for key in (7, 11, 12345):
        rows = [(key if i % 3 == 0 else 1000 + i, "a", "w " * 50) for i in range(300)] + [(5000 + i, "b", "v " * 40) for i in range(200)]
        rows += [(None, None, None), (key, "b", "v " * 40)]
        docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
        mix = mixing.pareto_mix(docs, word_count(F.col("text")), weights=(3, 7))
        found = mix.collect()
        for source, size in (("a", 50), ("b", 40)):
            of = [r for r in found if r["source"] == source]
            assert abs(sum(r["taken"] for r in of) - of[0]["target"]) <= size / 2
        got = Counter((r["doc_id"], r["source"]) for r in mixing.repeat_rows(docs, mix).collect())
        want = Counter()
        for r in found:
            want[r["doc_id"], r["source"]] += r["copies"]
        assert got == +want


def shards_of(rows, shards=8):
    """Shard and slot of sorted ``(key, tie, size)``."""
    total, before, slots, out = sum(r[2] for r in rows), 0, Counter(), []
    for row in sorted(rows):
        shard = min(shards - 1, shards * before // total)
        out.append((row, shard, slots[shard]))
        slots[shard] += 1
        before += row[2]
    return out


@pytest.mark.parametrize("per_task", [3, 1_000_000])
@pytest.mark.parametrize("kind", ["plain", "clustered", "hot", "far"])
def test_shards_are_those_of_a_running_sum(spark, kind, per_task):
    key = {
        "plain": lambda i: i,
        "clustered": lambda i: i * i * i if i % 2 else i // 100,
        "hot": lambda i: 5 if i % 3 else i,
        "far": lambda i: (-1) ** i * (2**62 + i),
    }[kind]
    rows = [(key(i), i, 1 + (i * 31) % 97 + (5000 if i == 700 else 0)) for i in range(1500)]
    df = spark.createDataFrame(rows, "k long, t long, s long")
    found = sharding.histogram_sort(df, "k", F.col("s"), 8, F.col("t"), rows_per_task=per_task).collect()
    assert sorted(((r["k"], r["t"], r["s"]), r["shard"], r["slot"]) for r in found) == shards_of(rows)


def test_equal_rows_are_cut_and_slots_have_no_gap(spark):
    rows = [(1, 10)] * 600 + [(None, 10)] * 300 + [(2, None)] * 100
    df = spark.createDataFrame(rows, "k long, s long").withColumn("shard", F.lit("clash"))
    found = sharding.histogram_sort(df, "k", F.col("s"), 8, rows_per_task=5).collect()
    sizes, slots = Counter(), defaultdict(list)
    for r in found:
        sizes[r["shard"]] += r["s"] or 0
        slots[r["shard"]].append(r["slot"])
    assert max(sizes.values()) - min(sizes.values()) <= 20
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_tolerance_is_kept(spark):
    rows = [(i * 17 % 1009, 1 + i % 5) for i in range(1009)]
    df = spark.createDataFrame(rows, "k long, s long")
    found = sharding.histogram_sort(df, "k", F.col("s"), 4, tolerance=40).collect()
    sizes = Counter()
    for r in found:
        sizes[r["shard"]] += r["s"]
    assert max(sizes.values()) - min(sizes.values()) <= 100


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert sharding.histogram_sort(none, "doc_id", F.col("n_chars")).collect() == []
    zero = spark.createDataFrame([(1, 0), (2, 0)], "k long, s long")
    assert sorted(r["slot"] for r in sharding.histogram_sort(zero, "k", F.col("s")).collect()) == [0, 1]
