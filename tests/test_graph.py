from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tidewheel.operators import graph
from tidewheel.operators.components import connected_components
from tidewheel.operators.pagerank import pagerank, pagerank_delta

SF = "/root/testdata/sf0.01"
EDGES = [(1, 2), (2, 3), (3, 1), (1, 3), (1, 3), (4, 1), (5, 5), (2, 6)]


def frame(spark, edges, kind="bigint"):
    return spark.createDataFrame(edges, f"src {kind}, dst {kind}")


@pytest.fixture(scope="module")
def directed(spark):
    """Parts bought one line after another in one order; a self-join, so for the small tables only."""
    items = spark.read.parquet(f"{SF}/lineitem.parquet")
    a = items.filter("l_quantity <= 10").select("l_orderkey", F.col("l_partkey").alias("src"), (F.col("l_linenumber") + 1).alias("n"))
    b = items.select("l_orderkey", F.col("l_partkey").alias("dst"), F.col("l_linenumber").alias("n"))
    return a.join(b, ["l_orderkey", "n"]).select("src", "dst").distinct().persist()


@pytest.fixture(scope="module")
def loose(spark):
    """Parts and orders of large returned lines: many components."""
    items = spark.read.parquet(f"{SF}/lineitem.parquet").filter("l_quantity >= 46 and l_returnflag = 'R'")
    return items.selectExpr("l_partkey as src", "1000000 + l_orderkey as dst").distinct().persist()


def test_edge_views(spark):
    edges = frame(spark, EDGES)
    assert rows(graph.undirected(edges)) == sorted(EDGES + [(b, a) for a, b in EDGES])
    assert rows(graph.initial_labels(edges)) == [(v, v) for v in (1, 2, 3, 4, 5)]
    assert rows(graph.initial_ranks(edges, 0.5)) == [(v, 0.5) for v in (1, 2, 3, 4, 5)]
    assert rows(graph.vertices(edges)) == [(v,) for v in range(1, 7)]
    assert rows(graph.out_degrees(edges)) == [(1, 3), (2, 2), (3, 1), (4, 1), (5, 1)]
    assert rows(graph.vertex_degrees(edges)) == [(1, 3), (2, 2), (3, 1), (4, 1), (5, 1), (6, 0)]


def test_adjacency(spark):
    edges = frame(spark, EDGES)
    got = {v: sorted(n) for v, piece, n in rows(graph.adjacency(edges)) if piece == 0}
    assert got == {1: [2, 3, 3], 2: [3, 6], 3: [1], 4: [1], 5: [5]}
    assert {v: sorted(n) for v, _, n in rows(graph.adjacency(edges, distinct=True))}[1] == [2, 3]


def test_adjacency_of_a_hot_vertex_is_split_and_whole(spark, partitions):
    hot = [(0, k % 400) for k in range(2000)] + [(0, 7)] * 1000 + [(k, 0) for k in range(1, 50)]
    got = graph.adjacency(frame(spark, hot), max_neighbors=100).collect()
    found = defaultdict(list)
    for row in got:
        assert len(row.neighbors) <= 500
        found[row.v] += row.neighbors
    assert len([row for row in got if row.v == 0]) > 20
    assert sorted(found[0]) == sorted(d for s, d in hot if s == 0)
    assert all(found[k] == [0] for k in range(1, 50))


def walk(edges, mode, steps, n=None, init=1.0):
    """PageRank by hand."""
    if mode == "contrib":
        edges = sorted(set(edges))
    degree = defaultdict(int)
    for s, _ in edges:
        degree[s] += 1
    everyone = {v for e in edges for v in e}
    ranks = dict.fromkeys(everyone if mode == "static" else degree, init)
    for _ in range(steps):
        sums = defaultdict(float)
        for s, d in edges:
            if s in ranks:
                sums[d] += ranks[s] / degree[s]
        base = 0.15 / n if mode == "bulk" else 0.15
        ranks = {v: base + 0.85 * sums.get(v, 0.0) for v in (everyone if mode == "static" else sums)}
    return ranks


@pytest.mark.parametrize("hot_rows", [None, 0, 2])
@pytest.mark.parametrize("mode", ["contrib", "bulk", "static"])
def test_pagerank_modes(spark, mode, hot_rows):
    got = dict(rows(pagerank(frame(spark, EDGES), 3, mode=mode, n=6, hot_rows=hot_rows)))
    assert got == pytest.approx(walk(EDGES, mode, 3, 6))
    assert (4 in got) == (mode == "static")


def test_pagerank_with_string_ids_and_without_broadcast(spark, no_broadcast, partitions):
    names = [(f"p{a}", f"p{b}") for a, b in EDGES]
    got = dict(rows(pagerank(frame(spark, names, "string"), 4, hot_rows=1)))
    assert got == pytest.approx(walk(names, "contrib", 4))


def test_pagerank_start_value_and_scaling(spark):
    got = dict(rows(pagerank(frame(spark, EDGES), 2, mode="static", init=0.25, normalize=True)))
    want = walk(EDGES, "static", 2, init=0.25)
    factor = 6 / sum(want.values())
    assert got == pytest.approx({v: r * factor for v, r in want.items()})


@pytest.mark.parametrize(
    "mode, step, size, total",
    [("contrib", 1, 1887, 1816.45), ("contrib", 5, 1856, 1435.3191), ("bulk", 3, 1856, 919.265222), ("static", 5, 1986, 1498.463)],
)
def test_pagerank_on_bought_parts(directed, mode, step, size, total):
    ranks = pagerank(directed, step, mode=mode, n=1986)
    assert ranks.agg(F.count("*"), F.round(F.sum("rank"), 4)).first() == (size, pytest.approx(total, abs=1e-4))


def test_bulk_pagerank_stops_when_no_page_moves(directed):
    ranks, stats = pagerank(directed, 80, mode="bulk", n=1986, stats=True)
    assert stats.agg(F.max("step")).first()[0] == 55
    assert ranks.agg(F.sum("rank")).first()[0] == pytest.approx(0.615037, abs=1e-6)
    first = stats.filter("step = 1").first()
    assert (first.op, first.rows_in, first.rows_out) == ("distribute", 1804, 5830)


@pytest.mark.parametrize("threshold, step, total, kept", [(0.1, 3, 5090.9368, 1631), (0.1, 10, 6904.3497, 118), (0.001, 5, 6257.4077, 1855)])
def test_pagerank_delta_on_bought_parts(directed, threshold, step, total, kept):
    ranks, stats = pagerank_delta(directed, 1986, step, threshold, stats=True)
    assert ranks.agg(F.count("*"), F.round(F.sum("rank"), 4)).first() == (1804, pytest.approx(total, abs=1e-4))
    assert stats.filter(f"step = {step} and op = 'sum_and_filter'").first().rows_out == kept


def test_pagerank_delta_ends_without_work(spark):
    chain = frame(spark, [(1, 2), (2, 3)])
    ranks, stats = pagerank_delta(chain, 3, 10, 0.1, stats=True, hot_rows=0)
    delta = 1 - 1 / 3
    assert dict(rows(ranks)) == pytest.approx({1: 1.0, 2: 1 + 0.85 * delta})
    assert stats.agg(F.max("step")).first()[0] == 2


def union_find(edges):
    parent = {}

    def find(v):
        while parent.setdefault(v, v) != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {v: find(v) for v in parent}


@pytest.mark.parametrize("hot_rows", [None, 3])
def test_components_against_union_find(loose, hot_rows):
    labels, stats = connected_components(loose, 10, stats=True, hot_rows=hot_rows)
    want = union_find([tuple(r) for r in loose.collect()])
    assert dict(rows(labels)) == want
    assert graph.component_count(labels).first() == (3108, 1129)
    steps = {(r.op, r.step): (r.rows_in, r.rows_out) for r in stats.collect()}
    assert max(step for _, step in steps) == 7
    assert steps["neighbor_join", 1] == (2 * 1979, 2 * 1979)
    assert steps["component_filter", 7][1] == 0


def test_components_stop_after_the_given_steps(spark, partitions):
    chain = frame(spark, [(k, k + 1) for k in range(1, 8)])
    assert dict(rows(connected_components(chain, 2))) == {1: 1, 2: 1, 3: 1, 4: 2, 5: 3, 6: 4, 7: 5, 8: 6}
    assert set(dict(rows(connected_components(chain, to_convergence=True))).values()) == {1}


def test_components_through_files(spark, tmp_path, no_broadcast):
    path = str(tmp_path / "cc")
    labels = connected_components(frame(spark, EDGES), 10, materialize=path)
    assert dict(rows(labels)) == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 1}
    assert spark.read.parquet(f"{path}/labels/iteration_0").count() == 6


def test_components_around_a_vertex_with_a_third_of_all_edges(spark):
    star = [(0, k) for k in range(1, 3000)] + [(10000 + k, 10001 + k) for k in range(0, 6000, 2)]
    labels = connected_components(frame(spark, star), 10, hot_rows=100)
    assert dict(rows(labels)) == union_find(star)


@pytest.mark.parametrize("hot_rows", [None, 1])
def test_laid_out_edges_give_the_same_answers(spark, no_broadcast, partitions, hot_rows):
    for mode in ("contrib", "bulk", "static"):
        got = dict(rows(pagerank(frame(spark, EDGES), 3, mode=mode, n=6, hot_rows=hot_rows)))
        assert got == pytest.approx(walk(EDGES, mode, 3, 6))
    assert dict(rows(connected_components(frame(spark, EDGES), hot_rows=hot_rows))) == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 1}


def test_edges_are_not_shuffled_again_in_a_step(spark, no_broadcast):
    from tidewheel.plans.skew import out_edges

    edges = frame(spark, EDGES)
    layout = out_edges(edges, graph.out_degrees(edges))
    layout.cold.count()
    ranks = graph.initial_ranks(edges)
    step = layout.receive(ranks).groupBy("dst").agg(F.sum("rank"))
    step.collect()
    plan = step._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].split("InMemoryRelation")[0]
    tail = plan[plan.index("SortMergeJoin"):]
    assert tail.index("TableCacheQueryStage") > 0 and tail.count("Sort [") == 1
    layout.release()


@pytest.mark.parametrize("limit", [0, 1000])
def test_both_ways_to_join_a_few_rows(spark, monkeypatch, limit, partitions):
    from tidewheel.plans import skew

    monkeypatch.setattr(skew, "BROADCAST_BYTES", limit)
    large = spark.range(3000).selectExpr("if(id % 3 = 0, 1, id % 7) as k", "id")
    few = spark.createDataFrame([(k, 10 * k) for k in range(5)], "k bigint, t int")
    want = large.join(few, "k")
    assert rows(skew.join_few(large, few, ["k"])) == rows(want)
    left = skew.join_few(large, few, ["k"], "left")
    assert left.count() == 3000 and left.filter("t is null").count() == large.filter("k > 4").count()
    hot = graph.adjacency(frame(spark, [(0, k) for k in range(500)] + [(1, 2)]), max_neighbors=50)
    assert hot.filter("v = 0").count() > 5 and hot.agg(F.sum(F.size("neighbors"))).first()[0] == 501


def test_contraction_against_union_find(spark, loose, partitions):
    from tidewheel.operators.components import contracted_components

    labels, _ = contracted_components(loose)
    assert dict(rows(labels)) == union_find([tuple(r) for r in loose.collect()])


def test_contraction_of_a_long_chain_loops_and_names(spark):
    from tidewheel.operators.components import contracted_components

    chain = [(k, k + 1) for k in range(1, 1200)] + [(9000, 9000), (9001, 9002), (9002, 9001)]
    labels, steps = contracted_components(frame(spark, chain))
    assert dict(rows(labels)) == union_find(chain) and steps < 15
    named, _ = contracted_components(frame(spark, [("c", "b"), ("b", "a"), ("z", "z")], "string"))
    assert dict(rows(named)) == {"a": "a", "b": "a", "c": "a", "z": "z"}
    assert contracted_components(frame(spark, [(1, 2)]).limit(0))[0].count() == 0


def test_steps_write_what_changed_and_leave_no_files(spark, tmp_path, monkeypatch):
    from tidewheel.operators import components, pagerank as ranks
    from tidewheel.plans import state

    loops = []

    class Watched(state.CoPartitioned):
        def __enter__(self):
            loops.append(self)
            return super().__enter__()

    monkeypatch.setattr(components, "CoPartitioned", Watched)
    monkeypatch.setattr(ranks, "CoPartitioned", Watched)
    comb = [(0, k) for k in range(1, 400)] + [(k, k + 1) for k in range(1000, 1006)]
    components.connected_components(frame(spark, comb), 6)
    # All vertices once, what fell in each step, the labels when the log was merged, and the result.
    assert loops[0].written[0] == loops[0].written[-1] == 407
    assert loops[0].written[1:5] == [405, 5, 4, 3]
    pagerank_delta(frame(spark, comb), 407, 4, 0.3)
    assert loops[1].written[1:-1] == [5, 4, 3, 2]
    before = spark.conf.get("spark.sql.adaptive.enabled")
    assert before == "true"


def test_a_step_moves_messages_only(spark, no_broadcast, monkeypatch):
    """One exchange: neither the state nor the edges move, nor the ranks that sums are compared with."""
    from tidewheel.plans import skew
    from tidewheel.plans.state import CoPartitioned

    monkeypatch.setattr(skew, "LEAST_PER_PARTITION", 4)
    edges = frame(spark, EDGES)
    with CoPartitioned(spark, skew.partitions_for(spark, len(EDGES))) as loop:
        pages, seen = loop.keep(graph.out_degrees(edges).repartition("src"), edges=F.sum("outdeg"))
        assert (seen["rows"], seen["edges"]) == (5, 8)
        layout = skew.out_edges(edges, pages, total=len(EDGES))
        ranks = pages.select(F.col("src").alias("v"), F.lit(1.0).alias("rank"))
        summed = layout.receive(ranks).groupBy(F.col("dst").alias("v")).agg(F.sum("rank").alias("rank"))
        plan = summed.join(ranks.withColumnRenamed("rank", "old"), "v", "left")
        lines = plan._jdf.queryExecution().executedPlan().toString().split("\n")
        layout.release()
    cached, exchanges = None, 0
    for line in lines:
        depth = len(line) - len(line.lstrip(" :+-*()0123456789"))
        if cached is not None and depth > cached:
            continue
        cached = depth if "InMemoryRelation" in line else None
        exchanges += "Exchange " in line
    assert exchanges == 1 and any("hashpartitioning(dst" in line and ", 3)" in line for line in lines)


def test_loops_end_on_a_relation_known_to_be_empty(spark):
    none = spark.sql("select 1L as src, 2L as dst where false")
    labels, stats = connected_components(none, 3, stats=True)
    assert labels.count() == 0 and stats.filter("rows_in > 0").count() == 0
    for mode in ("contrib", "bulk", "static"):
        assert pagerank(none, 2, mode=mode, n=3).count() == 0
    assert pagerank_delta(none, 3, 2).count() == 0


def test_edges_laid_out_are_found_in_every_step(spark, no_broadcast, monkeypatch):
    """No step lays the edges out again, though the layout and the state come from one table of vertices."""
    from tidewheel.plans import skew
    from tidewheel.plans.state import CoPartitioned

    monkeypatch.setattr(skew, "LEAST_PER_PARTITION", 4)
    plans = []
    keep = CoPartitioned.keep

    def watched(self, df, **counts):
        plans.append(df._jdf.queryExecution().executedPlan().toString().split("\n"))
        return keep(self, df, **counts)

    monkeypatch.setattr(CoPartitioned, "keep", watched)
    edges = frame(spark, EDGES)
    connected_components(edges, 3)
    for mode in ("bulk", "static"):
        pagerank(edges, 2, mode=mode, n=6, eps=None)
    pagerank_delta(edges, 6, 2, 0.01)
    cached, inside, outside = None, 0, 0
    for plan in plans:
        cached = None
        for line in plan:
            depth = len(line) - len(line.lstrip(" :+-*()0123456789"))
            if cached is None or depth <= cached:
                cached = depth if "InMemoryRelation" in line else None
            if "REPARTITION_BY_NUM" in line:
                inside, outside = inside + (cached is not None), outside + (cached is None)
    assert inside > 6 and not outside


def test_contraction_ends_stars_in_few_steps(spark):
    """Hubs with the smallest and the largest number of their stars."""
    from tidewheel.operators.components import contracted_components

    stars = [(h * 1000, h * 1000 + k) for h in range(20) for k in range(1, 400)] + [(0, h * 1000) for h in range(1, 20)]
    labels, steps = contracted_components(frame(spark, stars))
    assert {r.component for r in labels.collect()} == {0} and labels.count() == 20 * 400 and steps <= 4


@pytest.mark.parametrize("hot_rows", [None, 0])
def test_a_step_reads_what_is_cached_and_writes_no_checkpoint(spark, no_broadcast, monkeypatch, hot_rows):
    """A step's plan moves messages once, however often it reads the tables of the steps before."""
    from tidewheel.plans import skew, state

    monkeypatch.setattr(skew, "LEAST_PER_PARTITION", 4)
    plans, cuts = [], []
    cached, checkpointed = state.CoPartitioned._cached, state.checkpointed

    def watched(self, df, **counts):
        plans.append(df._jdf.queryExecution().executedPlan().toString().split("\n"))
        return cached(self, df, **counts)

    monkeypatch.setattr(state.CoPartitioned, "_cached", watched)
    monkeypatch.setattr(state, "checkpointed", lambda df: cuts.append(1) or checkpointed(df))
    edges = frame(spark, EDGES)
    want = walk(EDGES, "bulk", 6, 6)
    assert dict(rows(pagerank(edges, 6, mode="bulk", n=6, eps=1e-12, hot_rows=hot_rows))) == pytest.approx(want)
    pagerank(edges, 6, mode="static", hot_rows=hot_rows)
    pagerank_delta(edges, 6, 6, 0.01, hot_rows=hot_rows)
    connected_components(frame(spark, [(k, k + 1) for k in range(20)]), 6, hot_rows=hot_rows)
    assert len(cuts) == 4  # the results
    for plan in plans:
        inside, moved = None, 0
        for line in plan:
            depth = len(line) - len(line.lstrip(" :+-*()0123456789"))
            if inside is None or depth <= inside:
                inside = depth if "InMemoryRelation" in line else None
            moved += inside is None and "Exchange hashpartitioning" in line
        assert moved <= 1


def test_bulk_pagerank_counts_its_pages(spark):
    got = dict(rows(pagerank(frame(spark, EDGES), 3, mode="bulk")))
    assert got == pytest.approx(walk(EDGES, "bulk", 3, 6))


def spread(edges, steps):
    """The smallest label that reaches each vertex in so many steps, by hand."""
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    labels = {v: v for v in near}
    for _ in range(steps):
        labels = {v: min([labels[v], *(labels[w] for w in near[v])]) for v in near}
    return labels


@pytest.mark.parametrize("steps, hot_rows", [(1, None), (2, None), (4, 1), (5, None), (6, None), (9, 2)])
def test_components_beside_leaves(spark, monkeypatch, steps, hot_rows):
    """Stars, trees, chains, pairs, copies and loops, their leaves kept out of the steps."""
    from tidewheel.operators import components

    made = []

    class Watched(components.CoPartitioned):
        def __enter__(self):
            made.append(self)
            return super().__enter__()

    monkeypatch.setattr(components, "CoPartitioned", Watched)
    monkeypatch.setattr(components, "LEAVES_FROM", 0)
    edges = [(500 - k // 3, 500 - k) for k in range(1, 200)] + [(600, k) for k in range(601, 640)] + [(3, 640), (640, 600)]
    edges += [(k, k + 1) for k in range(700, 712)] + [(800, 801), (803, 802), (803, 802), (810, 810), (811, 811), (811, 4)]
    edges += [(900, 901), (901, 902), (902, 900), (902, 5)]
    labels = connected_components(frame(spark, edges), steps, hot_rows=hot_rows)
    assert dict(rows(labels)) == spread(edges, steps)
    ends = defaultdict(set)
    for a, b in edges:
        ends[a].add(b)
        ends[b].add(a)
    alone = sum(1 for v, others in ends.items() if len(others) == 1 and others != {v})
    assert alone > 150 and made[0].written[1] == made[0].written[-1] == len(ends) - alone
    names = [(str(a), str(b)) for a, b in edges]
    if steps == 4:
        assert dict(rows(connected_components(frame(spark, names, "string"), steps))) == spread(names, steps)


@pytest.mark.parametrize("hot_rows", [None, 20])
def test_a_pagerank_step_moves_arrays(spark, monkeypatch, hot_rows):
    """What a step keeps are rows of blocks, not of pages; all sums are those by hand."""
    from tidewheel.operators import pagerank as ranks
    from tidewheel.plans import skew

    loops = []

    class Watched(ranks.CoPartitioned):
        def __enter__(self):
            loops.append(self)
            return super().__enter__()

    monkeypatch.setattr(ranks, "CoPartitioned", Watched)
    monkeypatch.setattr(skew, "LEAST_PER_PARTITION", 1000)
    edges = [(k * k % 397, (7 * k + k // 5) % 500) for k in range(2500)] + [(3, k) for k in range(450, 510)]
    got = dict(rows(pagerank(frame(spark, edges), 6, mode="bulk", eps=None, hot_rows=hot_rows)))
    pages = len({v for edge in edges for v in edge})
    assert got == pytest.approx(walk(edges, "bulk", 6, pages))
    blocks = 3
    assert loops[0].written[-1] == len(got) > 400
    assert max(loops[0].written[:-1]) <= blocks + 2 * blocks * blocks


def test_pagerank_with_null_ends(spark):
    """An edge from null sends nothing; null is heard of but in `static`, where it keeps the base."""
    edges = EDGES + [(None, 2), (4, None)]
    sent = [(s, d) for s, d in edges if s is not None]
    got = {r.v: r.rank for r in pagerank(frame(spark, edges), 3, mode="bulk", n=6).collect()}
    assert got == pytest.approx(walk(sent, "bulk", 3, 6))
    static = {r.v: r.rank for r in pagerank(frame(spark, edges), 3, mode="static").collect()}
    assert static == pytest.approx({**walk(sent, "static", 3), None: 0.15})


@pytest.mark.parametrize("steps, hot_rows", [(1, None), (2, None), (3, None), (4, 3), (5, None), (7, 0), (10, None), (13, None)])
def test_leaves_of_what_leaves_hung_on_take_no_part(spark, monkeypatch, steps, hot_rows):
    """Trees, chains, rings with trees on them, pairs, copies, loops and nulls: as many levels go as steps allow."""
    from tidewheel.operators import components

    made = []

    class Watched(components.CoPartitioned):
        def __enter__(self):
            made.append(self)
            return super().__enter__()

    monkeypatch.setattr(components, "CoPartitioned", Watched)
    monkeypatch.setattr(components, "LEAVES_FROM", 0)
    monkeypatch.setattr(components, "AGAIN_FROM", 0)
    # A tree of 3, 9, 27, 81 and 243 vertices, numbered from the leaves up, and one from the root down.
    tree = [(k, 3 * k + j) for k in range(121) for j in (1, 2, 3)]
    edges = [(5000 - a, 5000 - b) for a, b in tree] + [(6000 + b, 6000 + a) for a, b in tree]
    edges += [(900, 901), (901, 902), (902, 900), (902, 5), (5, 906), (5, 907), (907, 4), (904, 904), (905, 905), (905, 4)]
    edges += [(k, k + 1) for k in range(700, 705)] + [(800, 801), (803, 802), (803, 802), (810, 811), (812, 811)]
    labels = connected_components(frame(spark, edges), steps, hot_rows=hot_rows)
    assert dict(rows(labels)) == spread(edges, steps)
    # So many levels go: each needs a step before and one after it.
    ends = {v for edge in edges for v in edge}
    levels = max(1, min(4, steps // 2))
    assert made[0].written[1] == made[0].written[-1] < len(ends) / (2, 6, 18, 40)[levels - 1]
    if steps == 7:
        with_null = spark.createDataFrame([*edges, (None, 4), (8000, None)], "src bigint, dst bigint")
        monkeypatch.setattr(components, "LEAVES_FROM", 10**9)
        want = connected_components(with_null, steps).collect()
        monkeypatch.setattr(components, "LEAVES_FROM", 0)
        names = [(str(a), str(b)) for a, b in edges]
        assert dict(rows(connected_components(frame(spark, names, "string"), steps))) == spread(names, steps)
        got = connected_components(with_null, steps).collect()
        assert len(got) == len(want) == len(ends) + 2 and set(got) == set(want)
    assert spark.conf.get("spark.sql.shuffle.partitions") == "8"


def test_leaves_are_searched_for_in_partitions_of_a_bounded_size(spark, monkeypatch):
    from tidewheel.operators import components

    names = ["spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes"]
    before, seen = [spark.conf.get(name) for name in names], []
    inner = components._beside_leaves
    monkeypatch.setattr(components, "_beside_leaves", lambda edges, *rest: (
        seen.append([spark.conf.get(name) for name in names]), inner(edges, *rest))[1])
    monkeypatch.setattr(components, "LEAVES_FROM", 0)
    monkeypatch.setattr(components, "ROWS_PER_SEARCH", 10)
    edges = [(0, k) for k in range(1, 100)]
    assert dict(rows(connected_components(frame(spark, edges), 3))) == spread(edges, 3)
    assert seen == [["20", components.READ_PER_SEARCH]] and [spark.conf.get(name) for name in names] == before


def test_a_step_holds_a_bounded_part_and_with_files_no_log(spark, tmp_path, monkeypatch):
    """Hash tables of labels do not grow with the edges, nor, where all labels are written anyway, with the steps."""
    from tidewheel.operators import components

    parts, joins = [], []

    class Watched(components.CoPartitioned):
        def __enter__(self):
            parts.append(self._parts)
            return super().__enter__()

        def keep(self, df, **counts):
            lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
            inside, found = None, 0
            for line in lines:
                depth = len(line) - len(line.lstrip(" :+-*()0123456789"))
                if inside is None or depth <= inside:
                    inside = depth if "InMemoryRelation" in line else None
                found += inside is None and "ShuffledHashJoin" in line
            joins.append(found)
            return super().keep(df, **counts)

    monkeypatch.setattr(components, "CoPartitioned", Watched)
    monkeypatch.setattr(components, "ROWS_PER_STEP", 10)
    chain = [(k, k + 1) for k in range(40)]
    path = str(tmp_path / "cc")
    for steps in (3, 4, 9):
        joins.clear()
        labels = connected_components(frame(spark, chain), steps, materialize=f"{path}_{steps}")
        assert dict(rows(labels)) == spread(chain, steps)
        for step in range(steps):
            assert dict(rows(spark.read.parquet(f"{path}_{steps}/labels/iteration_{step}"))) == spread(chain, step + 1)
        assert max(joins) == 1
    labels, stats = connected_components(frame(spark, chain), 9, stats=True)
    assert dict(rows(labels)) == spread(chain, 9)
    assert [tuple(r) for r in stats.where("op = 'component_filter'").select("rows_out").collect()] == [(40 - k,) for k in range(9)]
    assert parts == [8, 8, 8, 8]
