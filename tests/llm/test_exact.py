import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import DOCS, ODD, odd_documents
from tidewheel.llm import exact


def brute(rows):
    """keep_id, group size, digest of each row, and how many rows of each group are kept."""
    groups = {}
    for key, text, *_ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append(key)
    out = []
    for key, text, *_ in rows:
        t = re.sub(r"[\x20\x09-\x0D]+", " ", text or "")
        keys = [k for k in groups[t] if k is not None]
        out.append((key, min(keys, default=None), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr), {hashlib.sha256(t.encode()).hexdigest(): min((k for k in ks if k is not None), default=None) for t, ks in groups.items()}


def check(df, rows):
    got = df.collect()
    assert df.columns == ["doc_id", "keep_id", "group_size", "kept", "sha256"]
    want, first = brute(rows)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.sha256) for r in got), key=repr) == want
    kept = [(r.sha256, r.doc_id) for r in got if r.kept]
    assert dict(kept) == first and len(kept) == len(first)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=300), st.binary(max_size=300), st.integers(1, 40))
def test_prints_compose(a, b, chunk):
    whole = exact.fingerprint(a + b, chunk=chunk)
    assert whole == exact.joined(exact.fingerprint(a, chunk=chunk), exact.fingerprint(b), len(b))
    slow = 0
    for byte in a + b:
        slow = (slow * exact.BASE + byte + 1) % exact.PRIME
    assert whole == slow


def test_print_of_a_full_chunk():
    data = np.random.default_rng(5).integers(0, 256, exact.CHUNK * 2 + 3).astype(np.uint8)
    slow = 0
    for byte in data.tolist():
        slow = (slow * exact.BASE + byte + 1) % exact.PRIME
    assert exact.fingerprint(data.tobytes()) == slow
    assert exact.fingerprint(b"\xff" * exact.CHUNK, base=exact.PRIME - 1) >= 0


def test_odd_rows(spark):
    check(exact.groups_of_copies(odd_documents(spark)), ODD)


def test_no_rows(spark):
    assert exact.groups_of_copies(spark.createDataFrame([], DOCS)).count() == 0


def test_blanks_at_the_ends_and_repeated_rows(spark):
    rows = [(9, " a b"), (3, "\n\na\tb"), (4, "a b"), (4, "a b"), (None, "a b"), (7, "a b "), (None, "z"), (None, "z"), (8, "a b")]
    check(exact.groups_of_copies(spark.createDataFrame(rows, "doc_id long, text string")), rows)


@pytest.mark.parametrize("huge", [0, 40, exact.HUGE])
def test_chunks_dealt_out_and_texts_with_one_print(spark, huge):
    """With base 1 a print is a sum of bytes, so that texts of the same letters share it."""
    rng = np.random.default_rng(3)
    rows = []
    for key in range(300):
        letters = list("aaabbbcccdddeeefff" * int(rng.integers(1, 6)))
        rng.shuffle(letters)
        rows.append((key, "".join(letters)))
    rows += [(1000 + k, rows[k % 7][1]) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    check(exact.groups_of_copies(df, base=1, chunk=16, huge=huge), rows)
    check(exact.groups_of_copies(df, chunk=16, huge=huge), rows)


def test_a_group_that_holds_most_rows(spark, partitions):
    text = "the same long text " * 500
    rows = [(k, text if k % 3 else f"text {k}") for k in range(2000)]
    check(exact.groups_of_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)), rows)


def test_limits():
    with pytest.raises(ValueError):
        exact.groups_of_copies(None, chunk=0)
