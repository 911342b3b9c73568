"""Exact copies of texts by composable polynomial fingerprints, compared chunk by chunk.

The fingerprint of bytes is a polynomial in them modulo a prime. That of two strings in a row is
``first * base ** len(second) + second``, so a text is read in chunks, and the chunks of a huge one
are dealt over the cluster, hashed side by side and summed. Rows with equal fingerprints and lengths
are compared chunk by chunk; should different texts share a fingerprint, they are told apart by
their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.common import GAP, checkpointed

#: A Mersenne prime, and a number below it that has no small order.
PRIME, BASE = (1 << 61) - 1, 0x1B873593CC9E2D51 % ((1 << 61) - 1)
#: Bytes of a chunk, and bytes from which a text's chunks are dealt over the cluster.
CHUNK, HUGE = 1 << 16, 1 << 20
_DIGITS = 21


@cache
def _powers(base: int, size: int) -> np.ndarray:
    """Powers of the base for each place of a chunk, the last place's first, in three rows of digits.

    A digit times a byte, summed over a chunk, is below 2^53: doubles hold it exactly.
    """
    digits = np.zeros((3, size))
    power, low = 1, (1 << _DIGITS) - 1
    for place in range(size - 1, -1, -1):
        digits[:, place] = power & low, power >> _DIGITS & low, power >> 2 * _DIGITS
        power = power * base % PRIME
    return digits


def chunk_print(data: np.ndarray, base: int = BASE, chunk: int = CHUNK) -> int:
    """Fingerprint of at most ``chunk`` bytes."""
    sums = _powers(base, chunk)[:, chunk - len(data) :] @ (data + 1.0)
    return sum(int(s) << k * _DIGITS for k, s in enumerate(sums)) % PRIME


def joined(first: int, second: int, length: int, base: int = BASE) -> int:
    """Fingerprint of two strings in a row; ``length`` is that of the second."""
    return (first * pow(base, length, PRIME) + second) % PRIME


def fingerprint(data: bytes | memoryview, base: int = BASE, chunk: int = CHUNK) -> int:
    """Fingerprint of a whole text, composed from its chunks."""
    values, found = np.frombuffer(data, np.uint8), 0
    for at in range(0, len(values), chunk):
        part = values[at : at + chunk]
        found = joined(found, chunk_print(part, base, chunk), len(part), base)
    return found


def normal(text: Column) -> Column:
    """A text with one space for each stretch of white space, as bytes; none for a null text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), GAP, " ").cast("binary")


def _printed(batches: Iterator[pa.RecordBatch], base: int, chunk: int, texts: bool) -> Iterator[pa.RecordBatch]:
    """Print, length and digest of each row, with its key or, if ``texts``, its bytes.

    A text that the batch has before is compared with it here and its bytes are sent once.
    """
    for batch in batches:
        column = batch.column("bytes")
        views = [v.as_buffer() for v in column]
        out = {
            "print": pa.array([fingerprint(v, base, chunk) for v in views], pa.int64()),
            "length": pa.array([len(v) for v in views], pa.int64()),
            "sha256": pa.array([hashlib.sha256(v).hexdigest() for v in views], pa.string()),
        }
        if not texts:
            yield pa.record_batch({"key": batch.column("key"), **out})
            continue
        first: dict[tuple[int, int], int] = {}
        left = []
        for row, at in enumerate(zip(out["print"].to_pylist(), out["length"].to_pylist())):
            before = first.setdefault(at, row)
            if before == row or memoryview(views[row]) != memoryview(views[before]):
                left.append(row)
        yield pa.record_batch({"bytes": column, **out}).take(pa.array(left, pa.int64()))


def _chunks(data: Column, chunk: int) -> Column:
    """Number and bytes of each chunk; one empty chunk for no bytes."""
    last = F.floor(F.greatest(F.length(data) - 1, F.lit(0)) / chunk).cast("int")
    return F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.struct(i.alias("i"), F.substring(data, i * chunk + 1, F.lit(chunk)).alias("bytes")),
    )


def _huge_prints(rows: DataFrame, base: int, chunk: int) -> tuple[DataFrame, DataFrame]:
    """Prints of rows, whose chunks are dealt over the cluster; and their chunks with the print of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [
                chunk_print(np.frombuffer(v.as_buffer(), np.uint8), base, chunk) * pow(base, after, PRIME) % PRIME
                for v, after in zip(batch.column("bytes"), batch.column("after").to_pylist())
            ]
            yield pa.record_batch({"position": batch.column("position"), "part": pa.array(values, pa.int64())})

    keyed = rows.withColumn("position", F.monotonically_increasing_id()).withColumn("length", F.length("bytes").cast("long"))
    keyed = keyed.withColumn("sha256", F.sha2("bytes", 256))
    parts = checkpointed(
        keyed.select("key", "position", "length", "sha256", F.explode(_chunks(F.col("bytes"), chunk)).alias("chunk"))
    )
    dealt = parts.select(
        "position",
        F.col("chunk.bytes").alias("bytes"),
        F.greatest(F.col("length") - (F.col("chunk.i") + 1).cast("long") * chunk, F.lit(0)).alias("after"),
        "chunk.i",
    ).repartition(F.col("position"), F.col("i"))
    sums = (
        dealt.drop("i")
        .mapInArrow(run, "position long, part long")
        .groupBy("position")
        .agg((F.sum(F.col("part").cast("decimal(20,0)")) % F.lit(PRIME).cast("decimal(20,0)")).cast("long").alias("print"))
    )
    named = parts.join(checkpointed(sums), "position")
    return (
        named.where("chunk.i = 0").select("key", "print", "length", "sha256"),
        named.select("print", "length", "sha256", "chunk.i", "chunk.bytes"),
    )


def groups_of_copies(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    base: int = BASE,
    chunk: int = CHUNK,
    huge: int = HUGE,
) -> DataFrame:
    """key, keep_id, group_size, kept and sha256 of every row.

    Texts are copies if they are identical with one space for each stretch of white space; a null
    text is empty. The row with the smallest key of a group is kept, one of those alike in key and
    text; a row without key only if all are. ``keep_id`` is the key of that row, ``sha256`` the
    digest of the normalised text. Repeated rows stay, each with its own verdict. No rows, no
    result. Other columns are not returned. ``base`` is the polynomial's, ``chunk`` the bytes that
    are hashed and compared together, ``huge`` the bytes of a text from which its chunks are dealt out.

    Each task sends one copy of a chunk of a group to the comparison, however many it read.
    """
    if not 1 <= chunk <= 1 << 23 or not 0 < base < PRIME:
        raise ValueError("chunk must be from 1 to 2^23 and base from 1 to 2^61 - 2")
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    large = F.octet_length(F.coalesce(F.col("text"), F.lit(""))) > huge
    usual, wide = (rows.where(c).select("key", normal(F.col("text")).alias("bytes")) for c in (~large, large))
    huge_rows, huge_chunks = _huge_prints(wide, base, chunk)

    def printed(of: DataFrame, texts: bool) -> DataFrame:
        first = "bytes binary" if texts else "key long"
        return of.mapInArrow(
            lambda batches: _printed(batches, base, chunk, texts), f"{first}, print long, length long, sha256 string"
        )

    prints = printed(usual, False).select(*huge_rows.columns).unionByName(huge_rows)
    prints = checkpointed(prints.withColumn("position", F.monotonically_increasing_id()))
    chunks = printed(usual.select("bytes"), True).select(
        "print", "length", "sha256", F.explode(_chunks(F.col("bytes"), chunk)).alias("chunk")
    )
    chunks = chunks.select("print", "length", "sha256", "chunk.i", "chunk.bytes").unionByName(huge_chunks)

    def mixed(of: DataFrame, by: list[str]) -> DataFrame:
        """Groups in which some chunk has different bytes."""
        compared = of.groupBy(*by, "i").agg(F.min("bytes").alias("least"), F.max("bytes").alias("most"))
        return checkpointed(compared.where("least <> most").select(*by).distinct())

    by = ["print", "length"]
    sizes = _sizes(prints, by)
    found = mixed(chunks.join(sizes.where("group_size > 1").select(*by), by, "left_semi"), by)
    if not found.isEmpty():
        by = [*by, "sha256"]
        sizes = _sizes(prints, by)
        if not mixed(chunks.join(found, ["print", "length"], "left_semi"), by).isEmpty():
            raise ValueError("different texts have one fingerprint, one length and one SHA-256 digest")
    return prints.join(sizes, by).select(
        F.col("key").alias(key), F.col("first.key").alias("keep_id"), "group_size",
        (F.col("position") == F.col("first.position")).alias("kept"), "sha256",
    )


def _sizes(prints: DataFrame, by: list[str]) -> DataFrame:
    """Rows of each group, and its first row."""
    order = F.struct(F.col("key").isNull().alias("none"), "key", "position")
    return prints.groupBy(*by).agg(F.count("*").alias("group_size"), F.min(order).alias("first"))
