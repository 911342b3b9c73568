"""PageRank in four variants that give four different answers.

``contrib``: distinct edges, base 0.15; a page without in-links is gone after a step.
``bulk``: duplicate edges count, base 0.15/n; the same pages vanish; may stop early.
``static``: duplicate edges count, base 0.15, every vertex kept.
``pagerank_delta``: only pages whose last change exceeded a threshold send it on.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.operators.graph import out_degrees
from tidewheel.plans.blocks import Blocks
from tidewheel.plans.skew import out_edges, partitions_for
from tidewheel.plans.state import CUT_EVERY, CoPartitioned, LoopState, checkpointed, observed

DAMPING = 0.85
#: Tables of changes that are kept before they are summed into one.
LOG = 8


def pagerank(
    edges: DataFrame,
    iters: int = 10,
    mode: str = "contrib",
    n: int | None = None,
    eps: float | None = 1e-4,
    init: float = 1.0,
    normalize: bool = False,
    stats: bool = False,
    hot_rows: int | None = None,
):
    """``(v, rank)`` after ``iters`` supersteps.

    ``n`` (number of pages; those at either end of an edge are counted if it is not given) and ``eps``
    (stop once no page moved by more; ``None`` never stops early) belong to ``bulk``. ``init`` is the first rank; ``normalize``
    scales the result to sum to the number of vertices, in ``static``. With
    ``stats`` the result is a pair: ranks, and ``(op, step, rows_in, rows_out)``.
    """
    if mode not in ("contrib", "bulk", "static"):
        raise ValueError(f"unknown mode {mode!r}")
    spark = edges.sparkSession
    links = checkpointed(edges.select("src", "dst").distinct()) if mode == "contrib" else edges
    blocks = Blocks(links, hot_rows)
    eps = eps if mode == "bulk" else None
    stay = mode == "static"

    def first(outdeg: np.ndarray) -> np.ndarray:
        return np.where(stay | (outdeg > 0), float(init), np.nan)

    rows: list[tuple] = []
    counts = {name: F.sum(name) for name in ("moved", "senders", "messages")}
    with CoPartitioned(spark, blocks.parts) as loop:
        found = blocks.lay_out()
        base = 0.15 / max(n or found, 1) if mode == "bulk" else 0.15

        def rule(sums: np.ndarray, outdeg: np.ndarray) -> np.ndarray:
            if stay:  # a page without in-links has the base, and so has null, which no edge finds
                sums = np.where(np.isnan(sums) | np.isnan(outdeg), 0.0, sums)
            return base + DAMPING * sums

        ranks, seen = loop.keep(blocks.start(first), **counts)
        for step in range(1, iters + 1):
            cut = step % CUT_EVERY == 0 and step < iters
            before, sent = ranks, seen
            ranks, seen = loop.keep(blocks.turn(ranks, rule, eps, send=step < iters and not cut), **counts)
            loop.drop(before)
            rows.append(("distribute", step, sent["senders"] or 0, sent["messages"] or 0))
            if eps is not None and not seen["moved"]:
                break
            if cut:  # only ranks are written, not what they send
                state, _ = loop.keep(ranks.where("kind = 'state'"), cut=True)
                loop.drop(ranks)
                ranks, _ = loop.keep(blocks.turn(state, None, None, send=True))
                loop.drop(state)
        result = loop.result(blocks.values(ranks, "rank"))
        blocks.release()
    if mode == "static" and normalize:
        size, sum_ = result.agg(F.count("*"), F.sum("rank")).first()
        result = result.withColumn("rank", F.col("rank") * F.lit(size / sum_))
    return (result, spark.createDataFrame(rows, _COUNTS)) if stats else result


_COUNTS = "op string, step int, rows_in bigint, rows_out bigint"


def _sources(edges: DataFrame) -> DataFrame:
    return out_degrees(edges).withColumnRenamed("src", "v")


def pagerank_delta(
    edges: DataFrame,
    n: int,
    iters: int = 10,
    threshold: float = 0.1,
    stats: bool = False,
    hot_rows: int | None = None,
):
    """``(v, rank)`` for pages with out-links: 1 plus every change above ``threshold``.

    The first change is 1 - 1/n. A step sums the damped changes per target, forgets
    those not above the threshold, and adds the rest; it stops when none is left. A step
    writes these changes only; the ranks are their sums, made at the end.
    """
    spark = edges.sparkSession
    files = LoopState(spark, "pages")
    degrees = files.save(_sources(edges), "pages")
    total = degrees.agg(F.coalesce(F.sum("outdeg"), F.lit(0))).first()[0]
    rows: list[tuple] = []
    with CoPartitioned(spark, partitions_for(spark, total)) as loop:
        pages, seen = loop.keep(degrees.repartition("v"))
        layout = out_edges(edges, degrees.withColumnRenamed("v", "src"), hot_rows, total)
        changes = pages.select("v", F.lit(1.0 - 1.0 / n).alias("delta"))
        senders = seen["rows"]
        log: list[DataFrame] = []
        for step in range(1, iters + 1):
            part = F.lit(DAMPING) * F.col("delta") / F.col("outdeg")
            summed = (
                layout.receive(changes)
                .groupBy(F.col("dst").alias("v"))
                .agg(F.sum(part).alias("delta"), F.count("*").alias("messages"))
            )
            large = F.abs("delta") > F.lit(threshold)
            summed, seen = observed(summed, messages=F.sum("messages"), kept=F.count_if(large))
            updates = summed.where(large).select("v", "delta").hint("shuffle_hash").join(pages.select("v"), "v")
            changes, updated = loop.keep(updates, cut=step % CUT_EVERY == 0)
            log.append(changes)
            messages = seen.get["messages"] or 0
            rows += [
                ("distribute", step, senders, messages),
                ("sum_and_filter", step, messages, seen.get["kept"]),
                ("update", step, updated["rows"], updated["rows"]),
            ]
            senders = updated["rows"]
            if not senders:
                break
            if len(log) > LOG:  # all but the last, which the next step sends, become one
                merged, _ = loop.keep(_sums(log[:-1], "delta"), cut=True)
                loop.drop(*log[:-1])
                log = [merged, changes]
        first = pages.select("v", F.lit(1.0).alias("delta"))
        result = loop.result(_sums([first, *log], "delta").withColumnRenamed("delta", "rank"))
        layout.release()
    files.remove()
    return (result, spark.createDataFrame(rows, _COUNTS)) if stats else result


def _sums(tables: list[DataFrame], value: str) -> DataFrame:
    out = tables[0]
    for table in tables[1:]:
        out = out.unionAll(table)
    return out.groupBy("v").agg(F.sum(value).alias(value))
