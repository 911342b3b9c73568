"""Shards of near-equal size by a histogram sort.

Rows are ordered by an integer key. Rounds of one aggregation count the exact sizes and
rows in the cells between probes; each round keeps, for every boundary, the one cell that
holds it and lays new probes inside, until the boundary is exact or within a tolerance.
Then the rows are exchanged once.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass, field
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.llm.common import checkpointed

#: Cells into which a round cuts the range of one boundary.
PROBES = 512
_KEY, _TIE, _SIZE, _CELL, _PART = "__key", "__tie", "__size", "__cell", "__part"
_LOWEST, _HIGHEST = -(2**63), 2**63 - 1


@dataclass
class Boundary:
    """Rows after ``(key, tie)`` lie above; ``low`` to ``high`` is the range still in question."""

    target: float
    low: int
    high: int
    key: int | None = None
    bytes_below: int = 0
    rows_below: int = 0
    done: bool = False
    edge: tuple[int, int] = field(default=(_LOWEST, -1))

    @property
    def width(self) -> int:
        return max(1, -(-(self.high - self.low + 1) // PROBES))

    @property
    def span(self) -> tuple:
        return (self.key, self.low, self.high)


def _histograms(rows: DataFrame, open_: list[Boundary]) -> dict[tuple, list[tuple[int, int, int]]]:
    """Per range in question its filled cells: number, size, rows. One aggregation for all ranges."""
    spans = sorted({b.span: b for b in open_}.values(), key=lambda b: (b.key is not None, b.span[1], b.key or 0))
    which, cell = None, None
    for place, b in enumerate(spans):
        column = F.col(_KEY) if b.key is None else F.col(_TIE)
        inside = (column >= F.lit(b.low)) & (column <= F.lit(b.high))
        if b.key is not None:
            inside = inside & (F.col(_KEY) == F.lit(b.key))
        wide = F.lit(b.low).cast("decimal(20,0)")
        number = F.floor((column.cast("decimal(20,0)") - wide) / F.lit(b.width).cast("decimal(20,0)")).cast("int")
        which = F.when(inside, place) if which is None else which.when(inside, place)
        cell = F.when(inside, number) if cell is None else cell.when(inside, number)
    found: dict[tuple, list[tuple[int, int, int]]] = {b.span: [] for b in spans}
    sums = (
        rows.select(which.alias("w"), cell.alias("c"), _SIZE)
        .where("w is not null")
        .groupBy("w", "c")
        .agg(F.sum(_SIZE).alias("bytes"), F.count("*").alias("rows"))
    )
    for row in sums.collect():  # at most PROBES rows for each boundary
        found[spans[row["w"]].span].append((row["c"], row["bytes"], row["rows"]))
    return {span: sorted(cells) for span, cells in found.items()}


def _narrow(b: Boundary, cells: list[tuple[int, int, int]], tolerance: float) -> None:
    """Keep the cell in which ``target`` is reached; settle the boundary if that is exact enough."""
    ends = list(accumulate((size for _, size, _ in cells), initial=b.bytes_below))
    place = min(bisect_left(ends, b.target, lo=1), len(cells)) - 1
    number, size, count = cells[place]
    below, rows_below = ends[place], b.rows_below + sum(n for _, _, n in cells[:place])
    first = b.low + number * b.width
    last = min(b.high, first + b.width - 1)
    if count == 1 or ends[place + 1] - b.target <= tolerance or (b.key is not None and first == last):
        # The whole cell stays below the boundary.
        b.edge = (last, _HIGHEST) if b.key is None else (b.key, last)
        b.bytes_below, b.rows_below, b.done = below + size, rows_below + count, True
        return
    b.bytes_below, b.rows_below = below, rows_below
    if b.key is None and first == last:
        b.key, b.low, b.high = first, 0, _HIGHEST
    else:
        b.low, b.high = first, last


def splitters(rows: DataFrame, total: int, pieces: int, low: int, high: int, tolerance: float = 0) -> list[Boundary]:
    """The ``pieces - 1`` boundaries at equal shares of ``total``, each with the exact size and rows below."""
    bounds = [Boundary(total * i / pieces, low, high) for i in range(1, pieces)]
    while open_ := [b for b in bounds if not b.done]:
        found = _histograms(rows, open_)
        for b in open_:
            _narrow(b, found[b.span], tolerance)
    return bounds


def _above(b: Boundary) -> Column:
    key, tie = b.edge
    above = F.col(_KEY) > F.lit(key)
    return above if tie == _HIGHEST else above | ((F.col(_KEY) == F.lit(key)) & (F.col(_TIE) > F.lit(tie)))


def _within(cell: Column, bounds: list[Boundary], low: int, high: int, parts: int) -> Column:
    """Which of ``parts`` equal ranges of its cell a row is in: ranges of the key, or of the tie in a cell of one key."""
    edges = [(low, -1), *(b.edge for b in bounds), (high, _HIGHEST)]
    of_key, of_tie = [], []
    for (key, tie), (last_key, last_tie) in zip(edges, edges[1:]):
        first = key + 1 if tie == _HIGHEST else key
        of_key.append((first, max(1, last_key - first + 1)))
        of_tie.append((tie + 1, max(1, last_tie - tie)) if first == last_key else (0, 1 << 63))

    def place(column: Column, spans: list[tuple[int, int]]) -> Column:
        wide = "decimal(20,0)"
        start, width = (F.get(F.array(*(F.lit(str(v)).cast(wide) for v in side)), cell) for side in zip(*spans))
        share = (column.cast(wide) - start).cast("double") / width.cast("double")
        return F.greatest(F.lit(0), F.least(F.lit(parts - 1), F.floor(share * parts))).cast("int")

    single = F.get(F.array(*(F.lit(width == 1) for _, width in of_key)), cell)
    return F.when(single, place(F.col(_TIE), of_tie)).otherwise(place(F.col(_KEY), of_key))


def histogram_sort(
    rows: DataFrame, key: str, size: Column, shards: int = 8, ties: Column | None = None,
    tolerance: float = 0, pieces_per_shard: int = 8, rows_per_task: int = 1_000_000,
) -> DataFrame:
    """``rows`` with ``shard`` (int) and ``slot`` (long, gapless from 0 in key order within a shard).

    A row belongs to shard ``floor(shards * sizes before it / all sizes)``, in the order of
    ``key`` (an integer column; null comes first), then ``ties`` (0 to 2**32 - 1), so that
    sizes of shards differ by at most two rows' sizes (plus ``tolerance``, in units of size,
    per boundary). Rows alike in both are told apart by a position fixed in a checkpoint, so
    a key that a third of all rows have is cut like any other. Null sizes count as 0. Equal
    rows may take each other's slots. No rows, no result; columns called shard or slot
    are replaced.

    Boundaries are sought for ``pieces_per_shard`` cells of a shard. Cells are cut again, into equal ranges
    of about ``rows_per_task`` rows that are counted and then numbered in one task each.
    """
    tie = (ties if ties is not None else F.lit(0)).cast("long")
    position = F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(F.lit(2**31 - 1))
    fixed = checkpointed(
        rows.withColumns(
            {
                _KEY: F.coalesce(F.col(key).cast("long"), F.lit(_LOWEST)),
                _TIE: F.shiftleft(F.coalesce(tie, F.lit(0).cast("long")), 31) + position,
                _SIZE: F.coalesce(size.cast("long"), F.lit(0).cast("long")),
            }
        )
    )
    low, high, total, count = fixed.agg(F.min(_KEY), F.max(_KEY), F.sum(_SIZE), F.count("*")).first()
    cells = shards * pieces_per_shard
    bounds = splitters(fixed, total, cells, low, high, tolerance) if total else []
    cell = F.lit(0)
    for b in bounds:
        cell = cell + _above(b).cast("int")
    placed = fixed.withColumn(_CELL, cell)
    parts = max(1, -(-count // ((len(bounds) + 1) * rows_per_task)))
    placed = placed.withColumn(_PART, _within(F.col(_CELL), bounds, low or 0, high or 0, parts))

    below = [0, *(b.rows_below for b in bounds)]
    starts = [n - below[i - i % pieces_per_shard] for i, n in enumerate(below)]
    earlier = Window.partitionBy(_CELL).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(_CELL, _PART).agg(F.count("*").alias("__n"))
    start = F.get(F.array(*(F.lit(n).cast("long") for n in starts)), F.col(_CELL))
    counts = counts.select(
        _CELL, _PART, (start + F.coalesce(F.sum("__n").over(earlier), F.lit(0))).alias("__first")
    )
    in_order = Window.partitionBy(_CELL, _PART).orderBy(_KEY, _TIE)
    return (
        placed.join(counts, [_CELL, _PART])
        .withColumn("slot", F.row_number().over(in_order) - 1 + F.col("__first"))
        .withColumn("shard", F.floor(F.col(_CELL) / pieces_per_shard).cast("int"))
        .drop(_CELL, _PART, "__first", _KEY, _TIE, _SIZE)
    )
