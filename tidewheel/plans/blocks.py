"""Sums along edges, block by block: vertices in blocks by a hash, the edges of a block as arrays of positions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from tidewheel.plans.skew import hot_limit, partitions_for
from tidewheel.plans.state import checkpointed, renamed_apart

#: What a block keeps for all steps: positions, weights and where they lead; ``peer`` is the other block.
_FIXED = "seat int, kind string, peer int, a binary, b binary, c binary, d binary"
#: What a step leaves: the values of each block, with counts, and the messages of one block to another.
_SENT = "seat int, kind string, peer int, at binary, value binary, present bigint, moved bigint, senders bigint, messages bigint"
#: Buckets of sources in which edges are counted, to see which may be hot.
BUCKETS = 65_536


class Blocks:
    """The ends of ``edges(src, dst)`` laid out once, so that a step adds arrays and moves one number a target.

    A block is the vertices of one partition, in an order of their own. For its edges it keeps the positions of
    their sources, sorted by target, and the targets' block keeps the positions of the targets. In a step a vertex
    gives each of its edges an equal share of its value; a block sums them for each target and passes the sums to the block of
    the target, without keys: both know their order. A value that is missing is NaN. Edges of hot sources are kept,
    copies as a weight, in the blocks of their targets, and all blocks hear the values of hot vertices, of which there are few.
    Vertices may be of any type that Arrow can look up: numbers, strings, times. One that is null sends nothing.
    """

    def __init__(self, edges: DataFrame, hot_rows: int | None = None):
        spark = edges.sparkSession
        # An edge list's ends may differ in type; sources and targets have to be looked up as one.
        self.type = edges.select("src").unionAll(edges.select("dst")).schema["src"].dataType
        src, dst = F.col("src").cast(self.type), F.col("dst").cast(self.type)
        edges = edges.select(src.alias("src"), dst.alias("dst"))
        hot, total = _hot_sources(edges, hot_rows)
        self.parts = partitions_for(spark, total)
        self._seats = _seats(spark, self.parts)
        self._schema = StructType([*_schema(_FIXED), StructField("ids", ArrayType(self.type))])
        rows = None
        if hot is not None:
            few, rest = (checkpointed(renamed_apart(hot)) for _ in range(2))
            spread = edges.join(F.broadcast(few), "src").groupBy("h", "outdeg", "dst").agg(F.count("*").alias("n"))
            spread = spread.select(self._seat("dst").alias("seat"), F.col("dst").alias("v"), "h", "outdeg", "n")
            heads = hot.select(self._seat("src").alias("seat"), F.col("src").alias("v"), "h", "outdeg", F.lit(None).alias("n"))
            rows = spread.unionAll(heads).groupBy("seat").applyInArrow(_hot, self._schema)
            # A null is never hot.
            edges = edges.join(F.broadcast(rest.select("src")), "src", "left_anti")
        cold = edges.select(self._seat("src").alias("seat"), "src", "dst", self._seat("dst").alias("there"))
        cold = cold.groupBy("seat").applyInArrow(_tiled, self._schema)
        self._rows = cold if rows is None else cold.unionAll(rows)

    def lay_out(self) -> int:
        """Make what the steps read, and count the vertices; inside a loop of as many ``parts``."""
        settled = self._rows.groupBy("seat").applyInArrow(_settled, self._schema)
        self._kept = settled.repartition(self.parts, "seat").persist(StorageLevel.MEMORY_AND_DISK)
        # A step reads no more than it needs of what is kept.
        self.fixed = self._kept.drop("ids")
        self.places = self._kept.where("kind = 'page'").select("seat", "ids")
        return self.places.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()[0]

    def _seat(self, v: str) -> Column:
        return F.element_at(F.array(*map(F.lit, self._seats)), F.pmod(F.hash(v), F.lit(self.parts)) + 1)

    def start(self, first: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
        """The values of every block, ``first`` of the vertices' out-degrees, and what they send."""

        seats = self._seats

        def begin(fixed: pa.Table) -> pa.Table:
            block = _Block(fixed)
            return block.sent(first(block.outdeg), 0, seats)

        return self.fixed.groupBy("seat").applyInArrow(begin, _SENT)

    def turn(
        self, came: DataFrame, rule: Callable[[np.ndarray, np.ndarray], np.ndarray] | None, eps: float | None, send: bool
    ) -> DataFrame:
        """The next values, and what they send if they ``send``.

        ``rule`` makes them of the sums of what came (NaN where nothing did) and the out-degrees; without it values stay. ``moved``
        counts those that differ from the value before by more than ``eps``.
        """

        seats = self._seats if send else None

        def step(came: pa.Table, fixed: pa.Table) -> pa.Table:
            if not fixed.num_rows:  # hot vertices are told to blocks without vertices, too
                return _table([], _SENT)
            block = _Block(fixed)
            old, sums = block.received(came)
            values = old if rule is None else rule(sums, block.outdeg)
            with np.errstate(all="ignore"):
                moved = 0 if eps is None else int((np.abs(values - old) > eps).sum())
            return block.sent(values, moved, seats)

        return came.groupBy("seat").cogroup(self.fixed.groupBy("seat")).applyInArrow(step, _SENT)

    def values(self, state: DataFrame, name: str) -> DataFrame:
        """``(v, name)`` of the values that are there."""

        def read(state: pa.Table, places: pa.Table) -> pa.Table:
            value = _numbers(state.column("value")[0], np.float64)
            there = ~np.isnan(value)
            return pa.table({"v": places.column("ids")[0].values.filter(pa.array(there)), name: value[there]})

        schema = StructType([StructField("v", self.type), *_schema(f"{name} double")])
        state = state.where("kind = 'state'").groupBy("seat")
        return state.cogroup(self.places.groupBy("seat")).applyInArrow(read, schema)

    def release(self) -> None:
        self._kept.unpersist()


def _schema(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def _hot_sources(edges: DataFrame, hot_rows: int | None) -> tuple[DataFrame | None, int]:
    """``(src, outdeg, h)`` of the sources with too many edges for one block, if there are any, and the number of all edges.

    Edges are counted in buckets of sources first, in one pass; sources are counted one by one only in buckets that
    have as many edges as a hot one.
    """
    bucket = F.pmod(F.hash("src"), F.lit(BUCKETS))
    found = checkpointed(edges.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")))
    total = found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    limit = hot_limit(total, hot_rows)
    full = found.where(F.col("n") > limit).select(F.col("bucket").alias("full"))
    if full.isEmpty():
        return None, total
    there = edges.where("src is not null").join(F.broadcast(full), bucket == F.col("full"), "left_semi")
    hot = there.groupBy("src").agg(F.count("*").alias("outdeg")).where(F.col("outdeg") > limit).coalesce(1)
    hot = checkpointed(hot.withColumn("h", F.monotonically_increasing_id().cast("int")))
    return (None if hot.isEmpty() else hot), total


def _seats(spark: SparkSession, parts: int) -> list[int]:
    """For each partition a number that Spark's hash partitioning puts there, so that blocks are dealt evenly."""
    tried = spark.range(64 * parts).select(F.col("id").cast("int").alias("seat"))
    block = F.pmod(F.hash("seat"), F.lit(parts))
    found = tried.groupBy(block.alias("block")).agg(F.min("seat").alias("seat")).collect()
    return [row.seat for row in sorted(found, key=lambda row: row.block)]


def _numbers(cell: pa.Scalar, kind: type) -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), kind)


def _rows(table: pa.Table) -> Iterator[dict[str, pa.Scalar]]:
    for k in range(table.num_rows):
        yield {name: table.column(name)[k] for name in table.column_names}


def _table(rows: list[dict], ddl: str, **more: pa.Array) -> pa.Table:
    """A table of ``rows``, whose arrays become bytes."""
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    columns = {}
    for field in ddl.split(", "):
        name, kind = field.split(" ")
        cells = [row.get(name) for row in rows]
        if kind == "binary":
            cells = [None if cell is None else cell.tobytes() for cell in cells]
        columns[name] = pa.array(cells, kinds[kind])
    return pa.table({**columns, **more})


def _found(v: pa.Array, ids: pa.Array) -> np.ndarray:
    """Positions of ``v`` in ``ids``."""
    return pc.index_in(v, value_set=ids).to_numpy().astype(np.int32)


def _coded(column: pa.ChunkedArray, *first: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray | None]:
    """Numbers for the rows of a column, its values in the order of the numbers, and of what is to be ordered ``first``.

    The order has to be the same when this is made again, so it is that of the values.
    """
    coded = column.combine_chunks().dictionary_encode(null_encoding="encode")
    code, values = coded.indices.to_numpy(), coded.dictionary
    keys, by = {"v": values}, [("v", "ascending")]
    if first:
        keys["first"] = np.empty(len(values), np.int32)
        keys["first"][code] = first[0]
        by.insert(0, ("first", "ascending"))
    order = pc.sort_indices(pa.table(keys), by).to_numpy()
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    return place[code], values.take(pa.array(order)), keys["first"][order] if first else None


def _lists(arrays: list[pa.Array], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.concat_arrays(arrays) if arrays else pa.array([], kind))


def _tiled(edges: pa.Table) -> pa.Table:
    """A block's sources, what it adds for each target and sends where, and the targets that each block is to find."""
    seat = edges.column("seat")[0].as_py()
    source, sources, _ = _coded(edges.column("src"))
    code, targets, there = _coded(edges.column("dst"), edges.column("there").to_numpy())
    peers, cuts = np.unique(there, return_index=True)
    cuts = np.append(cuts, len(there)).astype(np.int32)
    starts = np.append(0, np.cumsum(np.bincount(code))[:-1]).astype(np.int32)
    outdeg = np.bincount(source).astype(np.float64)
    sorted_ = source[np.argsort(code, kind="stable")]
    rows = [{"seat": seat, "kind": "send", "a": sorted_, "b": starts, "c": peers, "d": cuts}]
    rows.append({"seat": seat, "kind": "page", "a": outdeg})
    rows += [{"seat": int(peer), "kind": "take", "peer": seat} for peer in peers]
    ids = [targets[:0], sources, *(targets[start:end] for start, end in zip(cuts[:-1], cuts[1:]))]
    return _table(rows, _FIXED, ids=_lists(ids, targets.type))


def _hot(rows: pa.Table) -> pa.Table:
    """The hot vertices of a block, and edges from hot vertices to it."""
    made, ids = [], []
    own = pc.is_null(rows.column("n"))
    for kind, part in (("own", rows.filter(own)), ("hot", rows.filter(pc.invert(own)))):
        if part.num_rows:
            h, outdeg = part.column("h").to_numpy().astype(np.int32), part.column("outdeg").to_numpy().astype(np.float64)
            made.append({"seat": part.column("seat")[0].as_py(), "kind": kind, "a": h})
            made[-1]["c"] = outdeg if kind == "own" else part.column("n").to_numpy() / outdeg
            ids.append(part.column("v").combine_chunks())
    return _table(made, _FIXED, ids=_lists(ids, rows.column("v").type))


def _settled(rows: pa.Table) -> pa.Table:
    """A block's vertices, sources first, and the positions of those that other blocks send to."""
    found = {"page": [], "own": [], "take": [], "hot": []}
    send = rows.filter(pc.equal(rows.column("kind"), "send"))
    seat = rows.column("seat")[0].as_py()
    for row in _rows(rows.select(["kind", "peer", "a", "c", "ids"])):
        found.get(row["kind"].as_py(), []).append(row)
    kind = rows.column("ids").type.value_type
    sources = [row["ids"].values for row in found["page"] + found["own"]]
    sources = pa.concat_arrays(sources) if sources else pa.array([], kind)
    others = [row["ids"].values for row in found["take"] + found["hot"]]
    others = pa.concat_arrays(others).unique() if others else pa.array([], kind)
    others = others.filter(pc.invert(pc.is_in(others, value_set=sources)))
    ids = pa.concat_arrays([sources, others.take(pc.sort_indices(others))])
    degrees = [_numbers(row["a"], np.float64) for row in found["page"]] + [_numbers(row["c"], np.float64) for row in found["own"]]
    outdeg = np.concatenate([*degrees, np.zeros(len(others))])
    outdeg[pc.is_null(ids).to_numpy(zero_copy_only=False)] = np.nan
    made = [{"seat": seat, "kind": "page", "a": outdeg}]
    for row in found["take"]:
        made.append({"seat": seat, "kind": "take", "peer": row["peer"].as_py(), "a": _found(row["ids"].values, ids)})
    for row in found["own"] + found["hot"]:
        made.append({"seat": seat, "kind": row["kind"].as_py(), "a": _numbers(row["a"], np.int32)})
        made[-1] |= {"b": _found(row["ids"].values, ids), "c": _numbers(row["c"], np.float64)}
    made = _table(made, _FIXED, ids=_lists([ids, *[ids[:0]] * (len(made) - 1)], kind))
    return pa.concat_tables([send.cast(made.schema), made])


class _Block:
    """The fixed rows of one block."""

    def __init__(self, fixed: pa.Table):
        self.seat = fixed.column("seat")[0].as_py()
        self.send = self.own = self.hot = None
        self.take = {}
        for row in _rows(fixed):
            kind = row["kind"].as_py()
            if kind == "page":
                self.outdeg = _numbers(row["a"], np.float64)
            elif kind == "take":
                self.take[row["peer"].as_py()] = _numbers(row["a"], np.int32)
            elif kind == "send":
                self.send = [_numbers(row[name], np.int32) for name in "abcd"]
            elif kind == "own":
                self.own = [_numbers(row[name], np.int32) for name in "ab"]
            else:
                self.hot = [_numbers(row["a"], np.int32), _numbers(row["b"], np.int32), _numbers(row["c"], np.float64)]

    def received(self, came: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """The values before, and the sums of what came, NaN where nothing did."""
        sums, heard = np.zeros(len(self.outdeg)), np.zeros(len(self.outdeg), bool)
        old, told = None, []
        for row in _rows(came):
            kind, value = row["kind"].as_py(), _numbers(row["value"], np.float64)
            if kind == "state":
                old = value
            elif kind == "hot":
                told.append((_numbers(row["at"], np.int32), value))
            else:
                at, there = self.take[row["peer"].as_py()], ~np.isnan(value)
                if not there.all():
                    at, value = at[there], value[there]
                sums[at] += value  # a target comes once in a message
                heard[at] = True
        if self.hot and told:
            h, at, weight = self.hot
            hot = np.full(1 + max(h.max(), *(heads.max() for heads, _ in told)), np.nan)
            for heads, value in told:
                hot[heads] = value
            value = hot[h] * weight
            there = ~np.isnan(value)
            sums += np.bincount(at[there], value[there], len(sums))
            heard[at[there]] = True
        sums[~heard] = np.nan
        return old, sums

    def sent(self, values: np.ndarray, moved: int, seats: list[int] | None) -> pa.Table:
        """The values with their counts, and messages to other blocks, if ``seats`` names these."""
        there = ~np.isnan(values)
        rows = [
            {
                "seat": self.seat,
                "kind": "state",
                "value": values,
                "present": int(there.sum()),
                "moved": moved,
                "senders": int((there & (self.outdeg > 0)).sum()),
                "messages": int(np.nansum(self.outdeg[there])),
            }
        ]
        if seats and self.send:
            sources, starts, peers, cuts = self.send
            with np.errstate(all="ignore"):
                share = (values / self.outdeg)[sources]
            missing = np.isnan(share)
            if missing.any():
                share[missing] = 0.0
                sums = np.add.reduceat(share, starts)
                sums[np.logical_and.reduceat(missing, starts)] = np.nan
            else:
                sums = np.add.reduceat(share, starts)
            for peer, start, end in zip(peers, cuts[:-1], cuts[1:]):
                message = sums[start:end]
                if not np.isnan(message).all():
                    rows.append({"seat": int(peer), "kind": "sum", "peer": self.seat, "value": message})
        if seats and self.own:
            heads, at = self.own
            rows += [{"seat": seat, "kind": "hot", "peer": self.seat, "at": heads, "value": values[at]} for seat in seats]
        return _table(rows, _SENT)
