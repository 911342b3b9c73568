import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import DOCS, ODD, fingerprint, groups, odd_documents
from tidewheel.llm import simhash


def signed(value):
    return value - (1 << 64) if value >> 63 else value


def components_of(spark, prints, distance=2):
    """Component of each of the given 64-bit values, by place."""
    rows = spark.createDataFrame([(signed(v),) for v in set(prints)], "print long")
    return {r["node"]: r["root"] for r in simhash.components(simhash.links(rows, distance)).collect()}


def test_code_is_perfect():
    values = np.arange(1 << 12, dtype=np.int64) << 11
    near = simhash.codewords(np.random.default_rng(1).integers(0, 1 << 23, 4000))
    found = (near >= 0).sum(axis=1)
    assert set(found.tolist()) <= {1, 6}
    assert simhash.codewords(values).shape == (1 << 12, 6)


@pytest.mark.parametrize("bits", [0, 1, 2])
def test_close_values_share_a_key(bits):
    rng = random.Random(bits)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for place in rng.sample(range(64), bits):
            b ^= 1 << place
        places, keys = simhash.keys(np.array([signed(a), signed(b)], np.int64))
        assert set(keys[places == 0].tolist()) & set(keys[places == 1].tolist())


def test_fingerprints_are_those_of_brute_force(spark):
    rows = odd_documents(spark).withColumn("p", simhash.hex_of(simhash.fingerprint(F.col("text"))))
    for row in rows.collect():
        if len(row["text"] or "") < 60000:
            assert int(row["p"], 16) == fingerprint(row["text"])


def test_links_and_components_are_those_of_brute_force(spark):
    rng = random.Random(7)
    prints = []
    for _ in range(25):
        value = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 12)):  # a walk: ends are farther apart than links reach
            prints.append(value)
            for _ in range(rng.randrange(0, 4)):
                value ^= 1 << rng.randrange(64)
    prints += [0, 1, 3, (1 << 64) - 1, 1 << 63]
    want = groups(dict(enumerate(prints)))
    found = components_of(spark, prints)
    root = [found.get(signed(v), signed(v)) for v in prints]
    for i in range(len(prints)):
        for j in range(i):
            assert (root[i] == root[j]) == (want[i] == want[j])


def test_large_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 4)
    centre = 0x123456789ABCDEF0
    prints = {centre ^ (1 << i) ^ (1 << j) for i in range(12) for j in range(12)} | {centre ^ (0xFF << 40)}
    found = components_of(spark, prints)
    roots = {found.get(signed(v), signed(v)) for v in prints}
    assert len(roots) == 2


def test_near_duplicates_of_odd_rows(spark):
    rows = [r for r in ODD if len(r[1] or "") < 60000]
    found = simhash.near_duplicates(odd_documents(spark).where("n_chars is null or n_chars < 60000")).collect()
    prints = {r[0]: fingerprint(r[1]) for r in rows if r[0] is not None}
    want = groups(prints)
    by_key = {r["doc_id"]: r["component_id"] for r in found}
    assert len(found) == len(ODD)
    for key, component in want.items():
        assert by_key[key] == component
    assert by_key[None] == 4  # the text of document 4


def test_one_of_each_group_stays(spark):
    docs = odd_documents(spark)
    kept = simhash.one_of_each(docs, simhash.near_duplicates(docs))
    assert kept.columns == docs.columns
    keys = sorted(str(r["doc_id"]) for r in kept.collect())
    assert keys == sorted(["1", "4", "None", "6", "7", "8", "9", "10"])


def test_empty_table(spark):
    none = spark.createDataFrame([], DOCS)
    assert simhash.near_duplicates(none).collect() == []
    assert simhash.one_of_each(none, simhash.near_duplicates(none)).collect() == []


def test_a_key_with_a_copy_and_another_text(spark):
    a, b = "alpha beta gamma delta epsilon", "one two three four five six"
    docs = spark.createDataFrame([(3, a), (5, a), (5, b)], "doc_id long, text string")
    kept = simhash.one_of_each(docs, simhash.near_duplicates(docs))
    assert sorted(tuple(r) for r in kept.collect()) == [(3, a), (5, b)]
