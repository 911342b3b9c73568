"""The same queries as SQL text, for an independent engine to check results with.

Loops are written out step by step; nothing here runs in the library itself.
"""

from __future__ import annotations

import math
import re
from itertools import combinations, permutations

from tidewheel import queries as q
from tidewheel.functions.kernel import EPSILON
from tidewheel.operators import datagen as g
from tidewheel.sources.runs import METRIC_COLUMNS

# -- derived inputs --------------------------------------------------------


def _id(key: str, kind: int) -> str:
    return f"cast({key} as bigint) * 8 + {kind}"


SUPPLY = f"""
select {_id('n_regionkey', q.REGION)} as src, {_id('n_nationkey', q.NATION)} as dst from nation
union all select {_id('c_nationkey', q.NATION)}, {_id('c_custkey', q.CUSTOMER)} from customer
union all select {_id('s_suppkey', q.SUPPLIER)}, {_id('s_nationkey', q.NATION)} from supplier
union all select {_id('o_custkey', q.CUSTOMER)}, {_id('o_orderkey', q.ORDER)} from orders
union all select {_id('l_orderkey', q.ORDER)}, {_id('l_partkey', q.PART)} from lineitem
union all select {_id('l_partkey', q.PART)}, {_id('l_suppkey', q.SUPPLIER)} from lineitem"""

TERRITORY = f"""
select {_id('n_regionkey', q.REGION)} as src, {_id('n_nationkey', q.NATION)} as dst from nation
union all select {_id('c_nationkey', q.NATION)}, {_id('c_custkey', q.CUSTOMER)} from customer
union all select {_id('s_nationkey', q.NATION)}, {_id('s_suppkey', q.SUPPLIER)} from supplier
union all select {_id('o_custkey', q.CUSTOMER)}, {_id('o_orderkey', q.ORDER)} from orders
union all select {_id('l_orderkey', q.ORDER)}, (l_orderkey * 8 + l_linenumber) * 8 + {q.LINE} from lineitem"""

POINTS = "select l_quantity as x, l_extendedprice / 2000 as y from lineitem"
PAIRS = "select l_quantity / 50 as x, l_extendedprice / 100000 as y from lineitem"
VECTORS = "select vec_id, label, cast(embedding as double[]) as features from embeddings"
RAW_RUNS = """select l_returnflag as suite, cast(4 * (1 + l_suppkey % 15) as integer) as nodes,
  cast(trunc(l_extendedprice) as bigint) as runtime_ms from lineitem"""
TRIMMED = f"""select suite, nodes, runtime_ms from (
  select *, row_number() over (partition by suite, nodes order by runtime_ms) as rn,
    count(*) over (partition by suite, nodes) as n from ({RAW_RUNS})) where rn > 1 and rn < n"""
RUNS = f"select suite, nodes, runtime_ms / 60000.0::double as minutes from ({TRIMMED})"


def _with(*steps: tuple[str, str]) -> str:
    """A chain of intermediate results, each computed once."""
    return "with " + ",\n".join(f"{name} as materialized ({sql.strip()})" for name, sql in steps) + "\n"


# -- text ------------------------------------------------------------------


def _lines(keys: str = "doc_id, ") -> str:
    return f"""select {keys}unnest(case when ls[-1] = '' then ls[1:len(ls) - 1] else ls end) as value
from (select {keys}string_split_regex(text, '\\r\\n|\\r|\\n') as ls from documents)"""


WORD_COUNT = (
    _with(
        ("l", _lines("")),
        ("p", r"select string_split_regex(lower(value), '\W+') as a from l"),
        (
            "t",
            """select unnest(case when len(a) = 1 then a when a[-1] <> '' then a
               when len(a) = 2 and a[1] = '' then []::varchar[] else a[1:len(a) - 1] end) as word from p""",
        ),
    )
    + "select word, count(*) as cnt from t group by word"
)

# -- graph -----------------------------------------------------------------


def _pagerank(mode: str, steps: int) -> str:
    edges = f"select distinct src, dst from ({SUPPLY})" if mode == "contrib" else SUPPLY
    chain = [
        ("e", edges),
        ("d", "select src, count(*) as outdeg from e group by src"),
        ("vs", "select src as v from e union select dst from e"),
        ("r0", "select v, 1.0::double as rank from vs" if mode == "static" else "select src as v, 1.0::double as rank from d"),
    ]
    base = "0.15 / (select count(*) from vs)" if mode == "bulk" else "0.15"
    for k in range(1, steps + 1):
        sums = f"""select e.dst as v, sum(r.rank / d.outdeg) as s from r{k - 1} r
                   join e on e.src = r.v join d on d.src = r.v group by e.dst"""
        if mode == "static":
            step = f"select vs.v, {base} + 0.85 * coalesce(s.s, 0) as rank from vs left join ({sums}) s on s.v = vs.v"
        else:
            step = f"select v, {base} + 0.85 * s as rank from ({sums})"
        chain.append((f"r{k}", step))
    return _with(*chain)


def _pagerank_sql(mode: str) -> str:
    return _pagerank(mode, q.GRAPH_STEPS) + f"select v, round(rank, 6) as rank from r{q.GRAPH_STEPS}"


def _converged() -> str:
    """Bulk ranks after the first step in which no rank moved by ``BULK_EPS``; written out, so all steps are computed."""
    steps = q.BULK_STEPS
    moved = [
        f"select {k} as step, (select count(*) from r{k} a join r{k - 1} b on b.v = a.v where abs(a.rank - b.rank) > {q.BULK_EPS}) as n"
        for k in range(1, steps + 1)
    ]
    ranks = "\nunion all ".join(f"select {k} as step, v, rank from r{k}" for k in range(1, steps + 1))
    return _pagerank("bulk", steps)[:-1] + f""",
moved as materialized ({' union all '.join(moved)}),
stopped as (select coalesce(min(step), {steps}) as step from moved where n = 0)
select v, round(rank, 6) as rank from ({ranks}) where step = (select step from stopped)"""


def _pagerank_stats() -> str:
    rows = [
        f"""select 'distribute' as op, {k} as step,
              (select count(*) from r{k - 1} r join d on d.src = r.v) as rows_in,
              (select cast(coalesce(sum(d.outdeg), 0) as bigint) from r{k - 1} r join d on d.src = r.v) as rows_out"""
        for k in range(1, q.GRAPH_STEPS + 1)
    ]
    return _pagerank("bulk", q.GRAPH_STEPS) + "\nunion all ".join(rows)


def _delta_chain(steps: int) -> str:
    chain = [
        ("e", SUPPLY),
        ("d", "select src, count(*) as outdeg from e group by src"),
        ("n", "select count(*) as n from (select src from e union select dst from e)"),
        ("s0", "select src as v, 1.0::double as rank from d"),
        ("w0", "select src as v, 1.0::double - 1.0::double / n.n as delta from d, n"),
    ]
    for k in range(1, steps + 1):
        chain += [
            (
                f"t{k}",
                f"""select e.dst as v, sum(0.85 * w.delta / d.outdeg) as delta, count(*) as messages
                    from w{k - 1} w join e on e.src = w.v join d on d.src = w.v group by e.dst""",
            ),
            (f"w{k}", f"select v, delta from t{k} where abs(delta) > {q.DELTA_THRESHOLD}"),
            (f"s{k}", f"select s.v, s.rank + coalesce(w.delta, 0) as rank from s{k - 1} s left join w{k} w on w.v = s.v"),
        ]
    return _with(*chain)


def _delta_stats() -> str:
    rows = []
    for k in range(1, q.GRAPH_STEPS + 1):
        senders = f"(select count(*) from w{k - 1} w join d on d.src = w.v)"
        messages = f"(select cast(coalesce(sum(messages), 0) as bigint) from t{k})"
        kept = f"(select count(*) from w{k})"
        updated = f"(select count(*) from w{k} w join s0 on s0.v = w.v)"
        rows += [
            f"select 'distribute' as op, {k} as step, {senders} as rows_in, {messages} as rows_out",
            f"select 'sum_and_filter', {k}, {messages}, {kept}",
            f"select 'update', {k}, {updated}, {updated}",
        ]
    return _delta_chain(q.GRAPH_STEPS) + "\nunion all ".join(rows)


def _components(steps: int) -> str:
    chain = [
        ("t", TERRITORY),
        ("e", "select src, dst from t union all select dst, src from t"),
        ("c0", "select distinct src as v, src as component, true as changed from e"),
    ]
    for k in range(1, steps + 1):
        chain += [
            (
                f"h{k}",
                f"""select e.dst as v, min(c.component) as heard, count(*) as messages
                    from c{k - 1} c join e on e.src = c.v where c.changed group by e.dst""",
            ),
            (
                f"c{k}",
                f"""select c.v, least(c.component, coalesce(h.heard, c.component)) as component,
                      coalesce(h.heard < c.component, false) as changed from c{k - 1} c left join h{k} h on h.v = c.v""",
            ),
        ]
    return _with(*chain)


def _component_stats() -> str:
    rows = []
    for k in range(1, q.COMPONENT_STEPS + 1):
        messages = f"(select cast(coalesce(sum(messages), 0) as bigint) from h{k})"
        ran = f"where exists (select 1 from c{k - 1} where changed)"
        rows += [
            f"select 'neighbor_join' as op, {k} as step, {messages} as rows_in, {messages} as rows_out {ran}",
            f"select 'component_filter', {k}, (select count(*) from h{k}), (select count(*) from c{k} where changed) {ran}",
        ]
    return _components(q.COMPONENT_STEPS) + "\nunion all ".join(rows)


COMPONENTS = _components(q.COMPONENT_STEPS) + f"select v, component from c{q.COMPONENT_STEPS}"

# -- machine learning ------------------------------------------------------

_CENTERS = "\nunion all ".join(f"select {i} as id, {x}::double as x, {y}::double as y" for i, x, y in q.START_CENTERS)


def _nearest(centers: str) -> str:
    """Points with the struct ``b`` of least distance and id among a table of centres."""
    distance = "sqrt((p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y))"
    return f"""select x, y, list_min(list_transform(cs, lambda c: {{'d': {distance}, 'id': c.id}})) as b
from pts p, (select list({{'id': id, 'x': x, 'y': y}}) as cs from {centers})"""


def _lloyd(steps: int) -> str:
    chain = [("pts", POINTS), ("c0", _CENTERS)]
    for k in range(1, steps + 1):
        chain.append((f"c{k}", f"select b.id as id, avg(x) as x, avg(y) as y from ({_nearest(f'c{k - 1}')}) group by b.id"))
    return _with(*chain)


def _kmeans(steps: int, final: int) -> str:
    return _lloyd(steps) + f"select x, y, b.id as center_id from ({_nearest(f'c{final}')})"


_LINE_CENTERS = """select cast(l_orderkey * 2 + l_linenumber as integer) as id, l_quantity as x, l_extendedprice / 2000 as y
from lineitem where l_linenumber <= 2"""
_ACCOUNTS = "select c_custkey, cast(c_custkey % 50 + 0.5 as double) as x, c_acctbal / 200 as y from customer"


def _nearest_of_many(points: str, centers: str, keep: str) -> str:
    """As ``_nearest``, for any number of centres: every pair, reduced by point."""
    distance = "sqrt((p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y))"
    return f"""select {keep}, min({{'d': {distance}, 'id': c.id}}) as b from ({points}) p, ({centers}) c group by {keep}"""


def _many_centers(steps: int) -> str:
    """Points in one place share their centre, so each place is looked up once."""
    chain = [
        ("pts", f"select x, y, count(*) as n from ({POINTS}) group by x, y"),
        ("c0", f"select cast(c_custkey as integer) as id, x, y from ({_ACCOUNTS})"),
    ]
    for k in range(1, steps + 1):
        near = _nearest_of_many("select * from pts", f"select * from c{k - 1}", "p.x, p.y, p.n")
        chain.append((f"c{k}", f"select b.id as id, sum(x * n) / sum(n) as x, sum(y * n) / sum(n) as y from ({near}) group by b.id"))
    return _with(*chain) + f"select id, round(x / pi(), 6) as x, round(y / pi(), 6) as y from c{steps}"


def _bgd(steps: int) -> str:
    chain = [("data", PAIRS), ("p0", "select 0::double as t0, 0::double as t1")]
    for k in range(1, steps + 1):
        chain.append(
            (
                f"p{k}",
                f"""select p.t0 - 0.01 * avg(p.t0 + p.t1 * d.x - d.y) as t0, p.t1 - 0.01 * avg((p.t0 + p.t1 * d.x - d.y) * d.x) as t1
                    from data d, p{k - 1} p group by p.t0, p.t1""",
            )
        )
    return _with(*chain) + f"select round(t0, 8) as theta0, round(t1, 8) as theta1 from p{steps}"


def _descent(iters: int, rate: str, reg: float, tol: float | None) -> str:
    """Gradient descent on the features 1 and x; ``rate`` is the step size at step ``t + 1``."""
    error = "(r.w0 + r.w1 * d.x - d.y)"
    stop = (
        f"t > 1 and sqrt((w0 - o0) * (w0 - o0) + (w1 - o1) * (w1 - o1)) < {tol} * greatest(sqrt(w0 * w0 + w1 * w1), 1)"
        if tol is not None
        else "false"
    )
    return f"""with recursive data as materialized ({PAIRS}),
r as (
  select 0 as t, 0::double as w0, 0::double as w1, false as done
  union all
  select t, w0, w1, {stop} from (
    select r.t + 1 as t, r.w0 as o0, r.w1 as o1,
      r.w0 * (1 - {rate} * {reg}) - {rate} * avg({error}) as w0,
      r.w1 * (1 - {rate} * {reg}) - {rate} * avg({error} * d.x) as w1
    from r, data d where not r.done and r.t < {iters} group by r.t, r.w0, r.w1)
),
f as (select * from r order by t desc limit 1)
select 0 as pos, round(w0, 8) as weight, t as steps from f
union all select 1, round(w1, 8), t from f"""


def _wide_descent(width: int, iters: int, rate: str, reg: float, tol: float | None) -> str:
    """Gradient descent on ``width`` features of the orders; ``rate`` is the step size at step ``t + 1``."""

    def norm(values: str) -> str:
        return f"sqrt(list_dot_product({values}, {values}))"

    moved = "list_transform(list_zip(w, o), lambda z: z[1] - z[2])"
    stop = f"t > 1 and {norm(moved)} < {tol} * greatest({norm('w')}, 1)" if tol is not None else "false"
    return f"""with recursive data as materialized (
  select o_totalprice / 100000 as y, list_transform(range(1, {width} + 1),
    lambda k: ((o_orderkey::bigint * (2 * k + 1) + o_custkey::bigint * k) % 997)::double / 498 - 1) as x
  from orders
),
r as (
  select 0 as t, list_transform(range({width}), lambda k: 0::double) as w, false as done
  union all
  select t, w, {stop} from (
    select r.t + 1 as t, r.w as o, list_transform(list_zip(r.w, g), lambda z: z[1] * (1 - {rate} * {reg}) - {rate} * z[2]) as w
    from r join (
      select t, list(g order by k) as g from (
        select t, k, avg(e * x) as g from (
          select r.t, list_dot_product(r.w, d.x) - d.y as e, unnest(d.x) as x, unnest(range({width})) as k
          from r, data d where not r.done and r.t < {iters})
        group by t, k)
      group by t) s on r.t = s.t)
),
f as (select * from r order by t desc limit 1)
select unnest(range({width}))::int as pos, round(unnest(w), 8) as weight, t as steps from f"""


WSSSE = (
    _with(
        ("vecs", VECTORS),
        ("parts", "select label, unnest(features) as value, unnest(range(len(features))) as pos from vecs"),
        ("means", "select label, pos, avg(value) as value from parts group by label, pos"),
        ("centers", "select label, list(value order by pos) as center from means group by label"),
        (
            "cost",
            """select vec_id, min(list_sum(list_transform(list_zip(features, center), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) as cost
               from vecs, centers group by vec_id""",
        ),
    )
    + "select round(sum(cost), 6) as wssse from cost"
)

# -- run times -------------------------------------------------------------

_F = ("1.0::double", "1.0::double / nodes", "ln(nodes)", "nodes::double")


def _determinant(cells: list[list[str]]) -> str:
    """Determinant of a small matrix of SQL expressions, written out."""
    size = len(cells)
    terms = []
    for order in permutations(range(size)):
        swaps = sum(order[i] > order[j] for i, j in combinations(range(size), 2))
        terms.append(("-" if swaps % 2 else "+") + " * ".join(cells[row][col] for row, col in enumerate(order)))
    return "(" + " ".join(terms) + ")"


def _nonnegative(source: str, keys: str) -> list[tuple[str, str]]:
    """Steps that fit non-negative coefficients per key, by trying every set of columns.

    ``source`` has the keys, nodes, n and total. The last step, ``fits``, has keys and c0 to c3.
    """
    sums = [f"sum(n * f{i} * f{j}) as g{i}{j}" for i in range(4) for j in range(i, 4)]
    sums += [f"sum(total * f{i}) as b{i}" for i in range(4)]
    scaled = [f"g{i}{j} / sqrt(g{i}{i} * g{j}{j}) as g{i}{j}" for i in range(4) for j in range(i, 4)]
    scaled += [f"b{i} / sqrt(g{i}{i}) as b{i}" for i in range(4)] + [f"sqrt(g{i}{i}) as z{i}" for i in range(4)]

    def cell(i: int, j: int) -> str:
        return f"g{min(i, j)}{max(i, j)}"

    tries = []
    for size in range(1, 5):
        for cols in combinations(range(4), size):
            matrix = [[cell(i, j) for j in cols] for i in cols]
            found = {}
            for at, col in enumerate(cols):
                replaced = [[f"b{i}" if k == at else matrix[r][k] for k in range(size)] for r, i in enumerate(cols)]
                found[col] = f"{_determinant(replaced)} / det"
            values = ", ".join(f"{found[c]} as c{c}" if c in found else f"0::double as c{c}" for c in range(4))
            tries.append(f"select {keys}, z0, z1, z2, z3, {values}, b0, b1, b2, b3 from (select *, {_determinant(matrix)} as det from scaled) where det > 1e-13")
    gain = " + ".join(f"c{k} * b{k}" for k in range(4))
    feasible = " and ".join(f"c{k} >= 0" for k in range(4))
    best = ", ".join(f"arg_max(c{k} / z{k}, {gain}) as c{k}" for k in range(4))
    return [
        ("feats", f"select {keys}, n, total, {', '.join(f'{f} as f{k}' for k, f in enumerate(_F))} from {source}"),
        ("gram", f"select {keys}, {', '.join(sums)} from feats group by {keys}"),
        ("scaled", f"select {keys}, {', '.join(scaled)} from gram"),
        ("tried", "\nunion all ".join(tries)),
        ("fits", f"select {keys}, {best} from tried where {feasible} group by {keys}"),
    ]


def _renamed(steps: list[tuple[str, str]], prefix: str) -> list[tuple[str, str]]:
    """The same steps under other names, beside those that another fit uses."""
    names = "|".join(name for name, _ in steps)
    return [(prefix + name, re.sub(rf"\b(from) ({names})\b", rf"\1 {prefix}\2", sql)) for name, sql in steps]


def _ernest_value(x: str) -> str:
    return f"(c0 + c1 / {x} + c2 * ln({x}) + c3 * {x})"


_ROUNDED_FITS = ", ".join(f"round(c{k}, 6) as c{k}" for k in range(4))

_TOTALS = [
    ("obs", RUNS),
    ("totals", "select suite, nodes, count(*)::double as n, sum(minutes) as total from obs group by suite, nodes"),
    ("ends", "select suite, min(nodes) as low, max(nodes) as high from totals group by suite"),
    ("folds", "select t.suite, t.nodes as fold from totals t join ends e on e.suite = t.suite where t.nodes > e.low and t.nodes < e.high"),
    ("train", "select f.suite, f.fold, t.nodes, t.n, t.total from folds f join totals t on t.suite = f.suite and t.nodes <> f.fold"),
]


def _kernel(source: str, keys: str, at: str, h: str) -> str:
    """Local regression per key over rows with nodes, n and total."""
    w = f"exp(-(nodes - {at}) * (nodes - {at}) / (2.0::double * {h} * {h}))"
    e = repr(EPSILON)
    s = f"""select {keys}, any_value({at}) as x0, any_value(c) as c, sum({w} * n) as m0, sum({w} * n * (nodes - c)) as m1,
      sum({w} * n * (nodes - c) * (nodes - c)) as m2, sum({w} * total) as t0, sum({w} * total * (nodes - c)) as t1
      from (select *, arg_min(nodes, abs(nodes - {at})) over (partition by {keys})::double as c from {source}) group by {keys}"""
    top = f"m2 * t0 - m1 * t1 + (x0 - c) * (m0 * t1 - m1 * t0) + {e}::double * (t0 + x0 * (t1 + c * t0))"
    bottom = f"m0 * m2 - m1 * m1 + {e}::double * (m0 + m2 + 2 * c * m1 + c * c * m0) + {e}::double * {e}::double"
    return f"select {keys}, ({top}) / ({bottom}) as predicted from ({s})"


def _kernel_cv(bandwidths: str) -> list[tuple[str, str]]:
    return [
        ("bws", f"select unnest({bandwidths})::double as bw"),
        ("kp", _kernel("train, bws", "suite, fold, bw", "fold::double", "bw")),
        (
            "kcv",
            """select k.suite, k.fold, k.bw, avg(abs((k.predicted - o.minutes) / o.minutes)) as error
               from kp k join obs o on o.suite = k.suite and o.nodes = k.fold group by k.suite, k.fold, k.bw""",
        ),
        ("kscore", "select suite, bw, avg(error) as score from kcv group by suite, bw"),
        ("kbest", "select suite, bw, score from kscore qualify row_number() over (partition by suite order by score, bw) = 1"),
    ]


_ALL_BANDWIDTHS = "range(1, 101)"

_ERNEST_CV = _nonnegative("train", "suite, fold") + [
    (
        "ecv",
        f"""select f.suite, f.fold, avg(abs(({_ernest_value('f.fold')} - o.minutes) / o.minutes)) as error
            from fits f join obs o on o.suite = f.suite and o.nodes = f.fold group by f.suite, f.fold""",
    ),
    ("escore", "select suite, avg(error) as score from ecv group by suite"),
]

_BEST = [
    *_TOTALS,
    *_kernel_cv(_ALL_BANDWIDTHS),
    *_ERNEST_CV,
    ("last", "select suite, max(fold) as fold from folds group by suite"),
    (
        "best",
        """select k.suite, case when e.score < k.score then 'ernest' else 'kernel' end as family,
             case when e.score < k.score then null else k.bw end as bw, least(e.score, k.score) as score,
             l.fold::double as dropped, f.c0, f.c1, f.c2, f.c3
           from kbest k join escore e on e.suite = k.suite join last l on l.suite = k.suite
           join fits f on f.suite = l.suite and f.fold = l.fold""",
    ),
]

_CURVE_STEP = repr((62.0 - 2.0) / (q.CURVE_POINTS - 1))

# -- generated files -------------------------------------------------------

_STATES = """select l_returnflag as suite, cast(4 * (1 + l_suppkey % 15) as integer) as nodes, l_linenumber as run,
  cast(sum(cast(trunc(l_extendedprice) as bigint)) as bigint) as runtime_ms from lineitem group by 1, 2, 3"""

_LOG = f"(event_id // {q.LINES_PER_LOG})"
_HOSTS = f"""select case when {_LOG} % 2 = 0 then 'A' else 'N' end as suite,
  cast(4 * (1 + {_LOG} // 2 % 15) as integer) as nodes, cast(1 + {_LOG} // 2 % 7 as integer) as run,
  'node' || {_LOG} as host, cast(row_number() over (partition by {_LOG} order by event_id) - 1 as integer) as seq,
  {', '.join(f'value * {k + 1} as {name}' for k, name in enumerate(METRIC_COLUMNS))}
from events where 'node' || {_LOG} <> '{q.MASTER}'"""

_ROLLED = ", ".join(f"round({kind}(h.{m}), 6) as {kind}_{m}" for kind in ("avg", "max") for m in METRIC_COLUMNS)

# -- pseudo-random draws ---------------------------------------------------


def _uniform(seed: int, stream: int, pos: str) -> str:
    digest = f"md5('{seed}/{stream}/' || ({pos}))"
    return f"(('0x' || substr({digest}, 1, 13))::bigint / 4503599627370496.0::double)"


def _normal(seed: int, stream: int, pos: str) -> str:
    u, v = _uniform(seed, 2 * stream, pos), _uniform(seed, 2 * stream + 1, pos)
    return f"(sqrt(-2.0::double * ln(1.0::double - {u})) * cos({2 * math.pi!r}::double * {v}))"


def _plane(stream: int, k: int) -> str:
    """k places in the plane, evenly drawn."""
    axes = ", ".join(
        f"{_uniform(g.DEFAULT_SEED, stream * 10 + axis, 'id')} * 100.0::double - 50.0::double as {name}" for axis, name in enumerate("xy")
    )
    return f"select id, {axes} from (select unnest(range({k})) as id)"


def _generated(weights: list[int]) -> str:
    bounds = ", ".join(repr(sum(weights[:n]) / sum(weights)) + "::double" for n in range(1, len(weights)))
    draw = _uniform(g.DEFAULT_SEED, 103, "event_id")
    noise = [f"{_normal(g.DEFAULT_SEED, 104 + axis, 'event_id')} * 8.0::double" for axis in range(2)]
    return f"""select round({noise[0]} + m.x, 2) + 0.0::double as x, round({noise[1]} + m.y, 2) + 0.0::double as y, m.id::int as mean_id
        from (select event_id, len(list_filter([{bounds}], lambda b: b <= {draw})) as chosen from events)
        join ({_plane(101, len(weights))}) m on m.id = chosen"""


def _subsample(sizes: tuple[int, ...], n_iter: int) -> list[tuple[str, str]]:
    """Steps to ``split``: suite, size, iter, role, nodes, minutes of every draw."""
    key = "suite || '/' || size || '/' || iter"
    at = f"{key} || '/' || nodes::double"
    return [
        ("numbered", """select suite, nodes, minutes, row_number() over (partition by suite, nodes
            order by cast(round(minutes * 60000) as bigint) % 4096, minutes) - 1 as number from obs"""),
        ("suites", "select suite, count(*) as width from totals group by suite"),
        ("problems", f"""select suite, size, iter from suites, (select unnest({list(sizes)}) as size),
            (select unnest(range(1, {n_iter + 1})) as iter) where width >= size"""),
        ("placed", f"""select suite, size, iter, nodes, n, row_number() over (partition by suite, size, iter
            order by {_uniform(1, 0, at)}, nodes) as place from problems join totals using (suite)"""),
        ("spanned", """select suite, size, iter, min(nodes) as low, max(nodes) as high from placed
            where place <= size group by all"""),
        ("between_", """select suite, size, iter, nodes, n, row_number() over w as place, count(*) over (partition by suite, size, iter) as width
            from spanned join totals using (suite) where nodes between low and high window w as (partition by suite, size, iter order by nodes)"""),
        ("picked", f"""select suite, size, iter, 'train' as role, nodes, floor({_uniform(1, 2, at)} * n) as number from placed where place <= size
            union all select suite, size, iter, 'test', nodes, floor({_uniform(1, 3, at)} * n) from between_
            where place = floor({_uniform(1, 1, key)} * width) + 1"""),
        ("split", "select suite, size, iter, role, nodes, minutes from picked join numbered using (suite, nodes, number)"),
    ]


ORACLES: dict[str, str] = {
    "lines": _lines(),
    "read_delimited_roundtrip": "select l_orderkey, l_extendedprice, l_returnflag from lineitem",
    "read_edges": SUPPLY,
    "labeled_points": f"select y as label, 1.0::double as f1, x as f2 from ({PAIRS}) union all select y, 1.0, x from ({PAIRS})",
    "read_vectors": f"""select cast(len(features) as integer) as width, unnest(range(len(features)))::int as pos,
        round(unnest(features), 6) as value from ({VECTORS})""",
    "read_lines": "select concat_ws(chr(9), doc_id, lang, source) as value from documents",
    "materialize": "select o_orderkey, o_custkey, o_totalprice from orders",
    "run_states": f"""select suite, nodes, run, case when run >= 6 then null else runtime_ms end as runtime_ms,
        case when run = 7 then 1 when run = 6 then null else 0 end as exit_code from ({_STATES})""",
    "host_metrics": _HOSTS,
    "run_metrics": f"""select printf('%s.top%03d.run%02d', h.suite, h.nodes, h.run) as run_key, h.host, count(*) as samples,
        {_ROLLED}, s.runtime_ms
        from ({_HOSTS}) h join ({_STATES}) s on s.suite = h.suite and s.nodes = h.nodes and s.run = h.run
        where s.run < 6 group by h.suite, h.nodes, h.run, h.host, s.runtime_ms""",
    "word_count": WORD_COUNT,
    "grep": f"select doc_id, value from ({_lines()}) where contains(value, '{q.KEYWORD}')",
    "tpch_q3_variant": """select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as o_orderdate, o_orderpriority,
        round(sum(l_extendedprice * (1 - l_discount)), 4) as revenue
        from customer join orders on o_custkey = c_custkey join lineitem on l_orderkey = o_orderkey
        where c_mktsegment = 'AUTOMOBILE' and o_orderdate < timestamp '1995-03-12' and l_shipdate > timestamp '1995-03-12'
        group by o_orderkey, o_orderdate, o_orderpriority""",
    **{
        name: f"""select c_custkey, c_name, n_name, c_acctbal, round(sum(l_extendedprice * (1 - l_discount)), 4) as revenue
            from customer join orders on o_custkey = c_custkey join lineitem on l_orderkey = o_orderkey
            join nation on n_nationkey = c_nationkey
            where year(o_orderdate) > {year} and l_returnflag = 'R' group by c_custkey, c_name, n_name, c_acctbal"""
        for name, year in (("tpch_q10_variant", 1990), ("tpch_q10_variant_1997", 1997))
    },
    "suite_runtimes": """select e.o_orderstatus as suite, e.o_orderpriority as name,
        min(cast(r.l_quantity as integer)) as min_time, max(cast(r.l_quantity as integer)) as max_time,
        cast(sum(cast(r.l_quantity as integer)) - min(cast(r.l_quantity as integer)) - max(cast(r.l_quantity as integer)) as bigint) as median_time
        from orders e, lineitem r where e.o_orderkey = r.l_orderkey and e.o_orderstatus = 'F'
        group by e.o_orderstatus, e.o_orderpriority""",
    "graph_undirected": f"with e as ({SUPPLY}) select src, dst from e union all select dst, src from e",
    "graph_vertices": f"select distinct src as v, src as component, 1.0::double as rank from ({SUPPLY})",
    "graph_adjacency": f"select src as v, 0 as piece, string_agg(dst, ',' order by dst) as neighbors from ({SUPPLY}) group by src",
    "graph_adjacency_distinct": f"""select src as v, 0 as piece, string_agg(dst, ',' order by dst) as neighbors
        from (select distinct src, dst from ({SUPPLY})) group by src""",
    "graph_adjacency_pieces": f"""select src as v, string_agg(dst, ',' order by dst) as neighbors, true as split_if_large
        from ({SUPPLY}) group by src""",
    "pagerank_contrib": _pagerank_sql("contrib"),
    "pagerank_bulk": _pagerank_sql("bulk"),
    "pagerank_bulk_converged": _converged(),
    "pagerank_static": _pagerank_sql("static"),
    "pagerank_hot": _pagerank_sql("static"),
    "pagerank_delta": _delta_chain(q.GRAPH_STEPS) + f"select v, round(rank, 6) as rank from s{q.GRAPH_STEPS}",
    "pagerank_iteration_stats": _pagerank_stats(),
    "pagerank_delta_iteration_stats": _delta_stats(),
    "connected_components": COMPONENTS,
    "connected_components_multijob": COMPONENTS,
    "connected_components_hot": COMPONENTS,
    "component_count": _components(q.COMPONENT_STEPS)
    + f"select count(*) as vertices, count(distinct component) as components from c{q.COMPONENT_STEPS}",
    "cc_iteration_stats": _component_stats(),
    "nearest_center": _lloyd(0) + f"select x, y, b.id as center_id, round(b.d, 6) as distance from ({_nearest('c0')})",
    "kmeans_lloyd": _kmeans(q.LLOYD_STEPS, q.LLOYD_STEPS),
    "kmeans_centers": _lloyd(q.LLOYD_STEPS) + f"select id, round(x, 6) as x, round(y, 6) as y from c{q.LLOYD_STEPS}",
    "kmeans_multijob": _kmeans(q.LLOYD_STEPS, q.LLOYD_STEPS),
    "kmeans_multijob_previous": _kmeans(q.LLOYD_STEPS, q.LLOYD_STEPS - 1),
    "nearest_of_many_centers": "select c_custkey, b.id as center_id, round(b.d, 9) as distance from ("
    + _nearest_of_many(_ACCOUNTS, _LINE_CENTERS, "p.c_custkey") + ")",
    "kmeans_many_centers": _many_centers(2),
    "components_chain": """with o as (
  select o_orderkey as v, o_orderkey - row_number() over (order by o_orderkey) as gap, (o_orderkey + 1499) // 1500 as block from orders
)
select v, min(v) over (partition by gap, block) as component from o
qualify count(*) over (partition by gap, block) > 1""",
    "kmeans_auto": "select count(*) as n, 10::bigint as clusters, 0::bigint as misplaced, true as better from embeddings",
    "wssse": WSSSE,
    "linreg_bgd": _bgd(q.BGD_STEPS),
    "linreg_sgd": _descent(100, "1.0 / sqrt(r.t + 1)", 0.01, 0.001),
    "linreg_sgd_20": _wide_descent(20, 100, "1.0 / sqrt(r.t + 1)", 0.01, 0.001),
    "sgd_least_squares_300": _wide_descent(300, q.WIDE_STEPS, "0.1 / sqrt(r.t + 1)", 0.0, None),
    "sgd_least_squares": _descent(50, "0.1 / sqrt(r.t + 1)", 0.0, None),
    "sgd_intercept": f"""select 1 - pos as pos, weight, steps from ({_descent(50, "0.1 / sqrt(r.t + 1)", 0.0, None)})""",
    "gen_kmeans_points": _generated([5, 1, 1, 1, 2]),
    "gen_kmeans_centers": _with(
        ("pts", _generated([1] * q.GENERATED_CLUSTERS)),
        ("c", f"select id, round(x, 2) as x, round(y, 2) as y from ({_plane(102, q.GENERATED_CLUSTERS)})"),
    )
    + f"select b.id::int as center_id, count(*) as n from ({_nearest('c')}) group by 1",
    "gen_linreg": f"""select round(x, 2) + 0.0::double as x, round(2.0::double * x + 0.01::double * noise, 2) + 0.0::double as y from (
        select {_normal(g.DEFAULT_SEED, 0, 'event_id')} as x, {_normal(g.DEFAULT_SEED, 1, 'event_id')} as noise from events)""",
    "gen_polynomial_features": f"""select round(2.0::double * x + 10.0::double + noise, 6) as label, power::int as power,
        round(pow(x, power), 6) as value from (select {_uniform(g.DEFAULT_SEED, 0, 'event_id')} as x,
        {_normal(g.DEFAULT_SEED, 1, 'event_id')} as noise from events), (select unnest(range(20)) as power)""",
    "hash_uniform": f"""select floor({_uniform(1, 0, 'event_id')} * 10)::bigint as tenth,
        floor({_uniform(1, 1, 'event_id')} * 6)::bigint as face, count(*) as n from events group by 1, 2""",
    "trim_runs": TRIMMED,
    "runtimes_minutes": f"select suite, nodes, round(minutes, 8) as minutes from ({RUNS})",
    "relative_error": """select l_returnflag, round(avg(abs((l_extendedprice * (1 - l_discount) * (1 + l_tax) - l_extendedprice) / l_extendedprice)), 8) as error
        from lineitem group by l_returnflag""",
    "ernest_fit": _with(*_TOTALS[:2], *_nonnegative("totals", "suite")) + f"select suite, {_ROUNDED_FITS} from fits",
    "ernest_predict": _with(*_TOTALS[:2], *_nonnegative("totals", "suite"))
    + f"""select f.suite, x.nodes as x, round({_ernest_value('x.nodes')}, 6) as predicted
        from fits f join (select distinct suite, nodes from ({RAW_RUNS})) x on x.suite = f.suite""",
    "kernel_predict": _with(
        *_TOTALS[:2],
        ("pairs", "select a.suite, a.nodes as x, t.nodes, t.n, t.total from totals a join totals t on t.suite = a.suite"),
        ("kp", _kernel("pairs", "suite, x", "x::double", f"{q.KERNEL_BANDWIDTH}")),
    )
    + "select suite, x, round(predicted, 6) as predicted from kp",
    "interpolation_splits": _with(
        ("raw", RAW_RUNS),
        ("ends", "select suite, min(nodes) as low, max(nodes) as high from raw group by suite"),
        ("folds", "select distinct r.suite, r.nodes as fold from raw r join ends e on e.suite = r.suite where r.nodes > e.low and r.nodes < e.high"),
    )
    + """select f.suite, f.fold, case when r.nodes = f.fold then 'test' else 'train' end as role, r.nodes,
        count(*) as n, cast(sum(r.runtime_ms) as bigint) as total_ms
        from folds f join raw r on r.suite = f.suite group by f.suite, f.fold, r.nodes""",
    "cv_score_kernel": _with(*_TOTALS, *_kernel_cv(_ALL_BANDWIDTHS))
    + "select suite, fold, bw, round(error, 6) as error from kcv",
    "cv_score_ernest": _with(*_TOTALS, *_ERNEST_CV) + "select suite, fold, round(error, 6) as error from ecv",
    "kernel_bandwidth": _with(*_TOTALS, *_kernel_cv(_ALL_BANDWIDTHS)) + "select suite, bw, round(score, 6) as score from kbest",
    "best_model": _with(*_BEST) + f"select suite, family, bw, round(score, 6) as score, dropped, {_ROUNDED_FITS} from best",
    "best_model_refit": _with(
        *_BEST, *_renamed(_nonnegative("totals", "suite"), "all_")
    )
    + f"""select b.suite, b.family, b.bw, round(b.score, 6) as score, null::double as dropped, {_ROUNDED_FITS.replace('round(c', 'round(a.c')}
        from best b join all_fits a on a.suite = b.suite""",
    "subsample_splits": _with(*_TOTALS[:2], *_subsample(q.LEARNING_SIZES, q.LEARNING_ITERATIONS))
    + "select suite, size, iter, role, nodes, round(minutes, 8) as minutes from split",
    "best_model_predict": _with(
        *_BEST,
        ("xs", f"select distinct suite, nodes as x from ({RAW_RUNS})"),
        (
            "pairs",
            """select x.suite, x.x, t.nodes, t.n, t.total, coalesce(b.bw, 1.0) as h from xs x join best b on b.suite = x.suite
               join totals t on t.suite = x.suite and t.nodes <> b.dropped""",
        ),
        ("bp", _kernel("pairs", "suite, x", "x::double", "h")),
    )
    + f"""select b.suite, p.x, round(case when b.family = 'ernest' then {_ernest_value('p.x')} else p.predicted end, 6) as predicted
        from bp p join best b on b.suite = p.suite""",
    "prediction_curve": _with(
        *_TOTALS,
        *_kernel_cv(_ALL_BANDWIDTHS),
        *_nonnegative("totals", "suite"),
        ("grid", f"select 2.0::double + unnest(range({q.CURVE_POINTS})) * {_CURVE_STEP}::double as x"),
        (
            "pairs",
            """select k.suite, g.x, t.nodes, t.n, t.total, k.bw as h from kbest k, grid g, totals t where t.suite = k.suite""",
        ),
        ("cp", _kernel("pairs", "suite, x", "x", "h")),
    )
    + f"""select p.suite, round(p.x, 6) as x, round({_ernest_value('p.x')}, 6) as ernest, round(p.predicted, 6) as kernel
        from cp p join fits f on f.suite = p.suite""",
}
