"""Connected components: the smallest label spread step by step, or edges contracted until none is left."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.operators.graph import out_degrees, undirected
from tidewheel.plans.skew import out_edges, partitions_for
from tidewheel.plans.state import CoPartitioned, LoopState, checkpointed, observed, small_tasks

#: Tables of changed labels that are read beside the base table before they are merged into it.
LOG = 4
#: Edges, in both directions, in a partition of the loop: a task holds what its vertices heard, and its log, in memory.
ROWS_PER_STEP = 1_000_000
#: Edges, in both directions, from which on vertices with one neighbour are kept out of the steps.
LEAVES_FROM = 1_000_000
#: Edges, in both directions, from which on what is left is searched for leaves again.
AGAIN_FROM = 1_000_000
#: Edges, in both directions, in a partition when vertices are searched for leaves: their tables of vertices stay small.
ROWS_PER_SEARCH = 2_000_000
#: What a task of that search reads of a file: a few million edges at most, where they are packed tightest.
READ_PER_SEARCH = "8m"
#: Steps of a contraction that take vertices in their own order.
PLAIN = 3


def connected_components(
    edges: DataFrame,
    iters: int = 10,
    to_convergence: bool = False,
    materialize: str | None = None,
    stats: bool = False,
    hot_rows: int | None = None,
):
    """``(v, component)`` after ``iters`` supersteps, or fewer when no label changes.

    Only vertices whose label fell in the last step send it on, and a step writes the labels that
    fell and no others. ``to_convergence`` goes on until none does; without ``materialize`` and
    ``stats`` it contracts the edges instead. ``materialize`` names a folder that keeps the labels
    after every step. With ``stats`` the result is a pair: the labels, and
    ``(op, step, rows_in, rows_out)``.
    """
    if to_convergence and not stats and materialize is None:
        return contracted_components(edges)[0]
    total = 2 * edges.count()
    if iters > 0 and not to_convergence and not stats and materialize is None and total >= LEAVES_FROM:
        with small_tasks(edges.sparkSession, -(-total // ROWS_PER_SEARCH), READ_PER_SEARCH):
            return _beside_leaves(edges, total, iters, hot_rows)
    labels, rows = _spread(edges, total, iters, to_convergence, materialize, hot_rows)
    if not stats:
        return labels
    return labels, edges.sparkSession.createDataFrame(rows, "op string, step int, rows_in bigint, rows_out bigint")


def _spread(
    edges: DataFrame,
    total: int,
    iters: int,
    to_convergence: bool = False,
    materialize: str | None = None,
    hot_rows: int | None = None,
    first: DataFrame | None = None,
    earlier: int = 0,
) -> tuple[DataFrame, list[tuple]]:
    """Labels after ``iters`` steps over ``total`` edges in both directions, and what each step read and wrote.

    Labels ``first`` are those after ``earlier`` steps before; the result then has the labels of so many steps
    before the last, too, in columns as ``_back`` names them. ``earlier`` is at most ``LOG``.
    """
    spark = edges.sparkSession
    files = LoopState(spark, "components", materialize) if materialize else None
    both = undirected(edges)
    rows: list[tuple] = []
    parts = partitions_for(spark, total, ROWS_PER_STEP)
    with CoPartitioned(spark, parts) as loop:
        own, _ = loop.keep(out_degrees(both), cut=True)
        layout = out_edges(both, own, hot_rows, total, counted=False, parts=parts)
        if first is None:
            senders = base = own.select(F.col("src").alias("v"), F.col("src").alias("component"))
        else:
            base, _ = loop.keep(first.repartition("v"))
            senders = base.where("component < v")
        log: list[DataFrame] = []
        sent: list[DataFrame] = []
        step = left = 0
        while to_convergence or step < iters:
            left = iters - step - 1
            # The log is merged in time for all labels that the result has to be in the last one.
            full = (step % LOG if files else len(log)) == LOG - 1 or (left == earlier and len(log) + 1 + earlier > LOG)
            heard = (
                layout.receive(senders)
                .groupBy(F.col("dst").alias("v"))
                .agg(F.min("component").alias("heard"), F.count("*").alias("messages"))
            )
            met, seen = observed(
                _latest(heard.hint("shuffle_hash").join(base, "v"), log), messages=F.sum("messages"), heard=F.count("heard")
            )
            lower = met.where("heard < component").select("v", F.col("heard").alias("component"))
            # The last of a log is cut with the table that it is merged into.
            senders, changed = loop.keep(lower, cut=full)
            step += 1
            messages = seen.get["messages"] or 0
            rows += [
                ("neighbor_join", step, messages, messages),
                ("component_filter", step, seen.get["heard"], changed["rows"]),
            ]
            log.append(senders)
            more = changed["rows"] and (to_convergence or left)
            if files or (more and full):
                merged, _ = loop.keep(_latest(base, log), cut=full and not files)
                if files:
                    # Each step writes all labels: no log is left of them, and what is written serves as the cut, too.
                    file = files.advance(merged, "labels", step - 1)
                    if full and more:
                        whole, merged = merged, loop.keep(file.repartition(parts, "v"))[0]
                        loop.drop(whole)
                loop.drop(base, *sent, *log[:-1])
                base, log, sent = merged, [], [senders]
            if not changed["rows"]:
                break
        # Of the steps that were left when no label fell any more, each would have changed nothing again.
        known = [max(0, len(log) - max(0, back - left)) for back in range(1, earlier + 1)]
        labels = _latest(base, log, known)
        if earlier and not log:
            # Before the first step each vertex has itself.
            labels = labels.withColumn(_back(1), F.col("v"))
        result = loop.result(labels)
        layout.release()
    return result, rows


def _beside_leaves(edges: DataFrame, total: int, iters: int, hot_rows: int | None) -> DataFrame:
    """Labels after ``iters`` steps, where vertices with one neighbour take no part; ``total`` edges in both directions.

    What such a vertex sends is its own label, in the first step, and from then on what it has heard from its
    neighbour, which tells that one nothing. So the first step is the smallest label next to each vertex, the
    others need the edges between the rest only, and in the end a leaf has the smallest of that first step and
    what its neighbour had the step before. Whatever labels the rest begins with, the same holds for the leaves it has
    itself: as long as that takes away half of the edges, they are left out in the same way, and a tree is
    gone in as many steps as it is high. Leaves left out ``n`` steps deep need ``n`` earlier labels at the end, which
    are there if at least ``n`` steps follow. Joins here have many rows for a busy vertex, which Spark splits.
    """
    files = LoopState(edges.sparkSession, "leaves")
    # Two readings: a task then has one direction only, and half as many vertices.
    told = _told(edges, "src", "dst")
    least = F.when(F.col("src").isNotNull(), F.least("src", F.min("dst")))
    levels: list[DataFrame] = []
    inner = edges
    while True:
        ends = told.groupBy("src").agg(
            F.min("dst").alias("least"), F.max("dst").alias("most"), least.alias("component")
        )
        only = F.when((F.col("least") == F.col("most")) & (F.col("least") != F.col("src")), F.col("least"))
        found = ends.select(F.col("src").alias("v"), "component", only.alias("only"))
        levels.append(files.save(found, f"level_{len(levels)}"))
        rest = levels[-1].where("only is null").select("v", "component")
        inner = inner.select("src", "dst").where("src <> dst")
        for end, of in (("dst", "b"), ("src", "a")):
            inner = inner.join(rest.select(F.col("v").alias(end), F.col("component").alias(of)).hint("shuffle_hash"), end)
        inner = files.save(inner.select("src", "dst", "a", "b"), f"edges_{len(levels)}")
        last, total = total, 2 * inner.count()
        deeper = len(levels) + 1
        if total < AGAIN_FROM or 2 * deeper > iters or deeper > LOG or 2 * total > last:
            break
        told = _told(inner, "a", "b").unionAll(rest.select("v", F.lit(None).alias("dst"), "component"))
        least = F.min("label")
    steps = iters - len(levels)
    spread, _ = _spread(inner.select("src", "dst"), total, steps, hot_rows=hot_rows, first=rest, earlier=len(levels))
    for level in reversed(range(len(levels))):
        then = [_back(n) for n in range(level + 1)]
        before = [F.col(_back(n + 1)).alias(f"heard_{n}") for n in range(level + 1)]
        heard = spread.select(F.col("v").alias("only"), *before)
        leaves = levels[level].where("only is not null").withColumnRenamed("component", "first")
        leaves = leaves.join(heard.hint("shuffle_hash"), "only", "left")
        # Of two vertices with no others, both are leaves, and neither has a row in what was spread.
        leaves = leaves.select("v", *(F.least("first", f"heard_{n}").alias(then[n]) for n in range(level + 1)))
        labels = spread.select("v", *then).unionAll(leaves)
        spread = files.save(labels, f"labels_{level}") if level else checkpointed(labels)
    files.remove()
    return spread


def _told(edges: DataFrame, a: str, b: str) -> DataFrame:
    """What both ends of ``edges`` hear, as ``(src, dst, label)``; columns ``a`` and ``b`` have the labels of the ends."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col(a).alias("label"))
    return edges.select("src", "dst", F.col(b).alias("label")).unionAll(back)


def _back(steps: int) -> str:
    """The column of the labels so many steps before the last."""
    return f"before_{steps}" if steps else "component"


def _latest(labels: DataFrame, log: list[DataFrame], known: Sequence[int] = ()) -> DataFrame:
    """``labels`` with each component as the log has it, and as its first tables have it, ``known`` of them.

    Labels only ever fall.
    """
    names = [f"component_{k}" for k in range(len(log))]
    for name, changed in zip(names, log):
        labels = labels.join(changed.withColumnRenamed("component", name).hint("shuffle_hash"), "v", "left")
    falls = [F.least("component", *names[:n]) if n else F.col("component") for n in (len(log), *known)]
    return labels.withColumns({_back(back): label for back, label in enumerate(falls)}).drop(*names)


def _order(v: Column, step: int) -> Column:
    """The order of vertices in a step, as good as random and another each time."""
    return F.struct(F.xxhash64(v.cast("string"), F.lit(step)).alias("hash"), v.alias("v"))


def contracted_components(edges: DataFrame) -> tuple[DataFrame, int]:
    """``(v, component)`` with the smallest vertex of each component, and the number of steps.

    In a step each vertex is given to the one that comes first, in some order, of itself and its
    neighbours; those are the vertices of the next step, and edges between them are kept once, in one
    direction. The first ``PLAIN`` steps, which have the most edges, take the vertices as they are
    ordered: that needs neither hashes nor sorting, and ends stars and trees around their smallest. Every
    other step draws an order anew: at least a quarter of its vertices, on average, is gone then, on a chain half of them, so
    that the steps grow with the logarithm of the vertices, whatever the diameter, and all steps
    together move a few times the edges.
    """
    # Written as files: those have a size that Spark can read, however many joins led to them.
    loop = LoopState(edges.sparkSession, "contraction")
    given: list[DataFrame] = []
    left = edges.select("src", "dst")
    while True:
        step = len(given)
        both = undirected(left)
        if step >= PLAIN:
            first = F.min(_order(F.col("dst"), step)).alias("first")
            chosen = both.groupBy("src").agg(first).select(
                F.col("src").alias("v"), F.least("first", _order(F.col("src"), step))["v"].alias("to")
            )
        else:
            chosen = both.groupBy("src").agg(F.min("dst").alias("first"))
            chosen = chosen.select(F.col("src").alias("v"), F.least("first", "src").alias("to"))
        given.append(loop.save(chosen, f"given_{step}"))
        a, b = (given[-1].select(F.col("v").alias(end), F.col("to").alias(to)) for end, to in (("src", "a"), ("dst", "b")))
        moved = left.where("src <> dst").join(a, "src").join(b, "dst").where("a <> b")
        left = loop.advance(moved.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct(), "edges", step)
        if left.isEmpty():
            break
    last = given[-1]
    for earlier in reversed(given[:-1]):
        later = last.select(F.col("v").alias("to"), F.col("to").alias("root"))
        # A vertex without an edge to another is not in the next step: it stays what it was.
        last = earlier.join(later, "to", "left").select("v", F.coalesce("root", "to").alias("to"))
    last = loop.save(last, "roots")
    least = last.groupBy("to").agg(F.min("v").alias("component"))
    labels = checkpointed(last.join(least, "to").select("v", "component"))
    loop.remove()
    return labels, len(given)
