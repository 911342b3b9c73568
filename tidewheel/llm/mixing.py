"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target. A source whose target is over its size first takes certain
whole copies of every document; the rest of the target is filled in the order of random
odds divided by inclusion odds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.llm.common import checkpointed, word_count

#: Cells into which one look divides a source's documents; two looks precede the last one.
BITS = 10
LOOKS = 2
_RANK_BITS = 50


def targets(
    sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.0, most: float = 3.0
) -> DataFrame:
    """Adds ``target`` to rows of ``source`` and ``source_size``.

    Sources take ``weights`` in turn, by code point, null last, and share ``share`` of all
    sizes. No target is above ``most`` times its source's size; what is over goes to the
    other sources by weight, until none is above. This is a water level: sources are full
    in the order of cap per weight, and those not full get level times weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*(F.lit(float(w)) for w in weights))
    by_cap = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    rows = (
        sizes.withColumn("weight", F.get(turn, (F.row_number().over(by_name) - 1) % len(weights)))
        .withColumn("cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("full_before", F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("open_weight", F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("goal", F.sum("source_size").over(everything) * F.lit(float(share)))
    )
    level = (F.col("goal") - F.coalesce("full_before", F.lit(0.0))) / F.col("open_weight")
    rows = rows.withColumn("level", level)
    full = F.col("cap") <= F.col("level") * F.col("weight")
    rows = rows.withColumn("settled", F.max(F.when(~full, F.col("level"))).over(everything))
    target = F.when(full, F.col("cap")).otherwise(F.col("settled") * F.col("weight"))
    return rows.select("source", "source_size", target.alias("target"))


def _uniform(doc_id: Column, seed: int) -> Column:
    """A number above 0 and below 1 that only the id and the seed decide."""
    digest = F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(2**48)


def _joined(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows with their source's row; null is a source as well."""
    return left.join(
        right.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source")), "left"
    ).drop("__source")


def pareto_mix(
    docs: DataFrame, size: Column, weights: Sequence[float] = (5, 2, 1), share: float = 1.0,
    most: int = 3, seed: int = 42,
) -> DataFrame:
    """Takes of every document: doc_id, size, source_size, target (double), copies and taken (long).

    ``docs`` has doc_id and source; other columns are dropped. With ``r`` the target over the size of its source, every
    document is taken ``floor(r)`` times. The rest of the target is filled with further
    copies in the order of ``(u / (1 - u)) / odds``: ``u`` is a hash of doc_id and seed, and
    the inclusion odds are ``f / (1 - f) * ln(2 + size)`` with ``f`` the share still to take, so longer
    documents are likelier. Documents are taken while they fit; then one more is, the one
    whose size is nearest to what is missing, if that brings the source closer. The take of
    a source thus misses its target by half a document at most. Rows alike in doc_id, source
    and size follow each other in the order and are taken one by one. Nulls: an own source, id and size 0. No rows, no result.

    No source is sorted whole: sums over ranges of the order find the range in which the
    target is reached, within it a finer one, and only that one is sorted.
    """
    fixed = checkpointed(
        docs.select("doc_id", "source", F.coalesce(size.cast("long"), F.lit(0).cast("long")).alias("size")).withColumn(
            "position", F.monotonically_increasing_id()
        )
    )
    goals = checkpointed(targets(fixed.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    certain = F.floor(ratio)
    goals = goals.withColumn("certain", certain).withColumn(
        "open", F.col("target") - certain * F.col("source_size")
    )
    part = F.col("open") / F.col("source_size")
    u = _uniform(F.col("doc_id"), seed)
    odds = part / (1 - part) * F.log(F.col("size") + 2.0)
    q = F.when((F.col("source_size") > 0) & (F.col("open") > 0), u / (1 - u) / odds)
    rank = F.floor(F.coalesce(q / (1 + q), F.lit(0.0)) * F.lit(float(2**_RANK_BITS - 1)))
    ranked = _joined(fixed, goals).withColumn("rank", rank.cast("long"))

    in_source = Window.partitionBy("source")
    cut = goals.select("source", "open", F.lit(0).cast("long").alias("cell"), F.lit(0).cast("long").alias("before"))
    # A source with nothing left to take has no order.
    inside = ranked.where("open > 0").select("source", "doc_id", "size", "rank", "position")
    for look in range(1, LOOKS + 1):
        shift = _RANK_BITS - look * BITS
        cells = inside.withColumn("next", F.shiftright("rank", shift)).groupBy("source", "next").agg(
            F.sum("size").alias("words")
        )
        summed = _joined(cells, cut).withColumn(
            "end", F.col("before") + F.sum("words").over(in_source.orderBy("next"))
        )
        cut = checkpointed(
            summed.where(F.col("end") > F.col("open"))
            .groupBy("source")
            .agg(
                F.max("open").alias("open"),
                F.min("next").alias("cell"),
                F.min(F.col("end") - F.col("words")).cast("long").alias("before"),
            )
        )
        wanted = cut.select("source", F.col("cell").alias("wanted"))
        inside = _joined(inside, wanted).where(F.shiftright("rank", shift) == F.col("wanted")).drop("wanted")
    last = _joined(inside, cut).withColumn(
        "end", F.col("before") + F.sum("size").over(in_source.orderBy("rank", "doc_id", "size", "position"))
    )
    # The first document in the order that no longer fits, and the words before it.
    edge = last.where(F.col("end") > F.col("open")).groupBy("source").agg(
        F.min(F.struct("rank", "doc_id", "size", "position")).alias("edge")
    )
    state = checkpointed(_joined(goals.select("source", "open"), edge))
    place = F.struct("rank", "doc_id", "size", "position")
    marked = _joined(ranked.drop("open"), state).withColumn(
        "fits", (F.col("open") > 0) & F.coalesce(place < F.col("edge"), F.lit(True))
    )
    filled = marked.groupBy("source").agg(
        F.max("open").alias("open"),
        F.sum(F.when(F.col("fits"), F.col("size")).otherwise(F.lit(0))).alias("filled"),
    )
    missing = filled.select("source", (F.col("open") - F.col("filled")).alias("missing"))
    off = F.abs(F.col("size") - F.col("missing"))
    closing = (
        _joined(marked, missing)
        .where(~F.col("fits") & (off < F.col("missing")))
        .groupBy("source")
        .agg(F.min(F.struct(off.alias("off"), "rank", "doc_id", "size", "position")).alias("closing"))
    )
    closing = checkpointed(
        closing.select("source", F.struct("closing.rank", "closing.doc_id", "closing.size", "closing.position").alias("closing"))
    )
    extra = F.when(F.col("fits") | F.coalesce(place.eqNullSafe(F.col("closing")), F.lit(False)), 1).otherwise(0)
    copies = (F.col("certain") + extra).cast("long")
    return _joined(marked, closing).select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )


def repeat_rows(docs: DataFrame, mix: DataFrame, size: Column | None = None) -> DataFrame:
    """Each document as often as the mix takes it; ``size`` as in the mix, by default the words of ``text``.

    Rows alike in doc_id, source and size share their copies evenly; where these do not go up, which
    is so for two such groups of a source at most, the first rows read have one more. Nulls are alike.
    """
    by = ["doc_id", "source", "size"]
    size = word_count(F.col("text")) if size is None else F.coalesce(size.cast("long"), F.lit(0).cast("long"))
    totals = checkpointed(mix.groupBy(*by).agg(F.sum("copies").alias("__copies"), F.count("*").alias("__rows")))
    totals = totals.select(*(F.col(c).alias(f"__{c}") for c in by), "__copies", "__rows").where("__copies > 0")

    def times(found: DataFrame, copies: Column) -> DataFrame:
        return found.withColumn("__times", copies).where("__times > 0").withColumn(
            "__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__times")))
        ).select(*docs.columns)

    def met(some: DataFrame) -> DataFrame:
        same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by[:2]]
        return docs.join(some, [*same, size == F.col("__size")])

    each, more = F.floor(F.col("__copies") / F.col("__rows")), F.col("__copies") % F.col("__rows")
    out = times(met(totals.where(more == 0)), each)
    uneven = totals.where(more != 0)
    if uneven.isEmpty():
        return out
    numbered = met(uneven).withColumn("__order", F.monotonically_increasing_id())
    number = F.row_number().over(Window.partitionBy("__doc_id", "__source", "__size").orderBy("__order"))
    numbered = numbered.withColumn("__number", number)
    return out.unionByName(times(numbered, each + (F.col("__number") <= more).cast("long")))
