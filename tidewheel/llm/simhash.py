"""Near-duplicates by 64-bit SimHash fingerprints, found through Golay codewords.

A fingerprint has three segments. Of two fingerprints that differ in two bits at most, one
segment is equal, and in the next one they have a codeword of the binary Golay code within
distance 4 in common. The equal segment with the codeword's index is the key under which
candidates meet; pairs that meet are compared, and links are followed to components.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tidewheel.llm.common import checkpointed

SEED = 42
#: Length of the code, its data bits, and its generator x^11+x^9+x^7+x^6+x^5+x+1.
LENGTH, DATA, GENERATOR = 23, 12, 0b101011100011
_CHECKS = LENGTH - DATA
#: Segments by their lowest bit; the last has 18 bits.
SEGMENTS = (0, 23, 46)
_SEGMENT_MASK = (1 << LENGTH) - 1
DISTANCE = 2
#: Fingerprints of a larger bucket are linked through their neighbours at one bit instead of in pairs.
BUCKET = 64
_CHUNK = 1 << 16


def _fingerprint(text: str | None, shingle: int) -> int:
    """Signed 64-bit SimHash of a whole text; 0 if it has no word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = max(1, len(words) - shingle + 1)
    starts, ends = starts[:last].tolist(), ends[min(shingle, len(words)) - 1 :].tolist()
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_digest
    for at in range(0, last, _CHUNK):
        hashes = b"".join(
            [digest(joined[a:b], SEED) for a, b in zip(starts[at : at + _CHUNK], ends[at : at + _CHUNK])]
        )
        counts += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > last).tobytes(), "big", signed=True)


def fingerprint(text: Column, shingle: int = 3) -> Column:
    """SimHash of the shingles of a text, as a long; A-Z count as a-z, a null text as an empty one."""

    @pandas_udf("long")
    def of(texts):
        return texts.map(lambda t: _fingerprint(t, shingle))

    return of(F.coalesce(text, F.lit("")))


@cache
def _code() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of the data bits, and for each remainder the error patterns of weight 4 at most.

    A remainder has one pattern, or six if its lightest has weight 3; -1 fills the rest.
    """

    def remainder(value: int) -> int:
        for bit in range(LENGTH - 1, _CHECKS - 1, -1):
            if value >> bit & 1:
                value ^= GENERATOR << (bit - _CHECKS)
        return value

    of_data = np.array([remainder(d << _CHECKS) for d in range(1 << DATA)], np.int64)
    patterns = np.full((1 << _CHECKS, 6), -1, np.int64)
    filled = np.zeros(1 << _CHECKS, np.int64)
    for weight in range(5):
        for places in combinations(range(LENGTH), weight):
            error = sum(1 << p for p in places)
            rest = of_data[error >> _CHECKS] ^ (error & ((1 << _CHECKS) - 1))
            patterns[rest, filled[rest]] = error
            filled[rest] += 1
    return of_data, patterns


def codewords(values: np.ndarray) -> np.ndarray:
    """Indices of the codewords within distance 4 of 23-bit values: a row of six, -1 where there are fewer."""
    of_data, patterns = _code()
    rest = of_data[values >> _CHECKS] ^ (values & ((1 << _CHECKS) - 1))
    errors = patterns[rest]
    return np.where(errors < 0, -1, (values[:, None] ^ errors) >> _CHECKS)


def keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``prints`` (int64) and their keys: which segment, its bits, a codeword of the next."""
    unsigned = prints.view(np.uint64)
    parts = [((unsigned >> np.uint64(low)) & np.uint64(_SEGMENT_MASK)).astype(np.int64) for low in SEGMENTS]
    places, found = [], []
    for segment, equal in enumerate(parts):
        near = codewords(parts[(segment + 1) % len(parts)])
        row, column = np.nonzero(near >= 0)
        places.append(row)
        found.append((segment << 40) | (equal[row] << DATA) | near[row, column])
    return np.concatenate(places), np.concatenate(found)


def _emit_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column("print").to_numpy(zero_copy_only=False).astype(np.int64)
        if len(prints):
            places, found = keys(prints)
            yield pa.record_batch({"key": found, "print": prints[places]})


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each connected group of the pairs: members and the smallest of them."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    members = [x for x in parent if root(x) != x]
    return np.array(members, np.int64), np.array([root(x) for x in members], np.int64)


def _links(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Links of rows sorted by key; members of a bucket that is too large come with themselves."""

    def of(key: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        sizes = np.diff(np.append(starts, len(key)))
        large = np.repeat(sizes > BUCKET, sizes)
        left, right = [], []
        small_key, small = key[~large], prints[~large]
        for step in range(1, min(BUCKET, len(small))):
            same = np.flatnonzero(small_key[step:] == small_key[:-step])
            if not len(same):
                break
            x, y = small[same], small[same + step]
            near = np.bitwise_count((x ^ y).view(np.uint64)) <= distance
            left.append(x[near])
            right.append(y[near])
        members, tops = _roots(np.concatenate(left), np.concatenate(right)) if left else (prints[:0], prints[:0])
        crowd = np.unique(prints[large])
        return pa.record_batch({"a": np.concatenate([members, crowd]), "b": np.concatenate([tops, crowd])})

    held_key, held = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        key = np.concatenate([held_key, batch.column("key").to_numpy(zero_copy_only=False)])
        prints = np.concatenate([held, batch.column("print").to_numpy(zero_copy_only=False)])
        if not len(key):
            continue
        first = int(np.searchsorted(key, key[-1]))  # the last bucket may go on in the next batch
        if first:
            yield of(key[:first], prints[:first])
        held_key, held = key[first:], prints[first:]
    if len(held):
        yield of(held_key, held)


def links(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links ``a``, ``b`` that join all fingerprints (distinct, column ``print``) at ``distance`` or less.

    Within a batch of buckets only a spanning star of each group is returned. A bucket of
    more than ``BUCKET`` fingerprints emits no pairs: its members are linked through all
    values at one bit from them, which two fingerprints share exactly if they differ in two
    bits or less.
    """
    if not 0 <= distance <= DISTANCE:
        raise ValueError(f"the keys find distances up to {DISTANCE}")
    rows = prints.select("print").mapInArrow(_emit_keys, "key long, print long")
    met = checkpointed(
        rows.repartition("key")
        .sortWithinPartitions("key")
        .mapInArrow(lambda batches: _links(batches, distance), "a long, b long")
    )
    crowd = met.where("a = b").select(F.col("a").alias("print")).distinct()
    if distance < DISTANCE:
        flips = [F.lit(0)] if distance == 0 else [F.lit(0), *(F.shiftleft(F.lit(1).cast("long"), i) for i in range(64))]
    else:
        flips = [F.lit(0), *(F.shiftleft(F.lit(1).cast("long"), i) for i in range(64))]
    around = crowd.select(
        "print", F.explode(F.array(*(F.col("print").bitwiseXOR(f.cast("long")) for f in flips))).alias("hub")
    )
    before = F.lag("print").over(Window.partitionBy("hub").orderBy("print"))
    shared = around.select("print", before.alias("before")).where("before is not null")
    if distance < DISTANCE:
        near = F.bit_count(F.col("print").bitwiseXOR(F.col("before"))) <= distance
        shared = shared.where(near)
    return met.where("a <> b").unionByName(shared.select(F.col("print").alias("a"), F.col("before").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node reachable) for every node of an edge but the roots.

    Alternates stars to larger and to smaller neighbours until the edges are stars around
    roots; the steps grow with the logarithm of the longest path. Edges have columns a and b.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs, seen = checkpointed(pairs), None
    while True:
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        larger = (
            both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        )
        least = larger.groupBy("a").agg(F.min("b").alias("m"))
        smaller = larger.join(least, "a").select(
            F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e")
        )
        pairs = checkpointed(smaller.select("e.a", F.col("e.m").alias("b")).where("a <> b").distinct())


def near_duplicates(
    docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 3, distance: int = DISTANCE
) -> DataFrame:
    """``key``, ``print`` (long) and ``component_id`` (smallest key of the group) of every row.

    Fingerprints link at ``distance`` differing bits or less, and a group is all that links
    reach. Null and empty texts have fingerprint 0 and link like others. A null key counts as
    no key in the smallest; a group of null keys only has a null id. Repeated rows stay.
    No rows, no result. Other columns are not returned.
    """
    prints = checkpointed(docs.select(F.col(key).alias("__key"), fingerprint(F.col(text), shingle).alias("print")))
    by_print = checkpointed(prints.groupBy("print").agg(F.min("__key").alias("first")))
    found = components(links(by_print, distance))
    rooted = by_print.join(found.withColumnRenamed("node", "print"), "print", "left").select(
        "print", "first", F.coalesce("root", "print").alias("root")
    )
    first_of = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of_print = rooted.join(first_of, "root").select("print", "component_id")
    return prints.join(of_print, "print").select(F.col("__key").alias(key), "print", "component_id")


def one_of_each(docs: DataFrame, found: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents without duplicates: of each group in ``found`` the smallest key stays.

    Rows are told apart by key and fingerprint: of rows alike in both one stays, of rows without a key
    one for each text, and a row goes only if its own fingerprint is in a group with a smaller key.
    """
    gone = found.where(F.col(key) != F.col("component_id")).select(key, F.col("print").alias("__print")).distinct()
    plain = F.when(F.col(key).isNull(), F.coalesce(F.col(text), F.lit("")))
    named = docs.withColumns({"__print": fingerprint(F.col(text)), "__plain": plain})
    return named.join(gone, [key, "__print"], "left_anti").dropDuplicates([key, "__print", "__plain"]).select(*docs.columns)


def hex_of(prints: Column) -> Column:
    return F.lpad(F.lower(F.hex(prints)), 16, "0")
