"""Periodic runs of words, with extents from a grammar made by recompression.

A text's words are named by numbers and compressed level by level: maximal blocks of one symbol
become one symbol each, then adjacent pairs of a symbol of one half of the alphabet and one of the
other do. Equal stretches are parsed alike but for a symbol or two at their ends on each level, so
the longest common extension of two places is found by rising through the levels and falling again.

A run of period q and length ``max(24, 3 * q)`` or more has a place of the grid of that period in
it, with the word q further on being the same. Places of the grids, which are harmonic in number,
are checked against their neighbours; the grammar says how far those that are left extend.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

#: Words and periods of the shortest run.
WORDS, PERIODS = 24, 3
#: Words that are compressed together, unless a single text has more, and places looked at together.
BATCH, PLACES = 250_000, 4_000_000
#: Places in a row that must agree before the grammar is asked; a run has this many on one side of its grid place.
AGREE = 8
#: A fixed odd number that mixes symbols into halves of the alphabet.
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class _Level:
    """Symbols of a level, and where its boundaries are among those of the next one.

    ``up`` has the next level's number of each boundary, -1 if it is none there; ``down`` has the
    way back. ``block`` says in which block of the next level a symbol is, if blocks were made.
    """

    symbols: np.ndarray
    up: np.ndarray | None = None
    down: np.ndarray | None = None
    block: np.ndarray | None = None


def _halves(symbols: np.ndarray, round_: int) -> np.ndarray:
    """Which half of the alphabet each symbol is in this round."""
    mixed = (symbols.astype(np.uint64) + np.uint64(round_ * 0x51ED27 + 1)) * _MIX
    mixed = (mixed ^ (mixed >> np.uint64(29))) * _MIX
    return (mixed >> np.uint64(63)).astype(bool)


class Grammar:
    """A run-length grammar of a sequence of small numbers, with the extensions it answers.

    The first and the last symbol must occur once each. So must one between any two texts, which
    no extension then crosses.
    """

    def __init__(self, ids: np.ndarray, longest: int):
        self.levels = [_Level(ids.astype(np.int32))]
        self.free = int(ids.max()) + 1
        for round_ in range(math.ceil(2.5 * math.log2(longest + 1)) + 4):
            self._blocks()
            if len(self.levels[-1].symbols) < 4:
                break
            self._pairs(round_)

    def _named(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """New symbols, one for each different pair."""
        kinds, which = np.unique((left.astype(np.int64) << 32) | right, return_inverse=True)
        names = (self.free + which).astype(np.int32)
        self.free += len(kinds)
        return names

    def _raise(self, starts: np.ndarray, symbols: np.ndarray, blocks: bool) -> None:
        level = self.levels[-1]
        size = len(level.symbols)
        level.down = np.append(starts, size).astype(np.int32)
        level.up = np.full(size + 1, -1, np.int32)
        level.up[level.down] = np.arange(len(starts) + 1, dtype=np.int32)
        if blocks:
            level.block = np.repeat(np.arange(len(starts), dtype=np.int32), np.diff(level.down))
        self.levels.append(_Level(symbols))

    def _blocks(self) -> None:
        symbols = self.levels[-1].symbols
        starts = np.flatnonzero(np.concatenate(([True], symbols[1:] != symbols[:-1])))
        if len(starts) == len(symbols):
            return
        lengths = np.diff(np.append(starts, len(symbols)))
        made, long = symbols[starts], lengths > 1
        made[long] = self._named(made[long], lengths[long])
        self._raise(starts, made, True)

    def _pairs(self, round_: int) -> None:
        symbols = self.levels[-1].symbols
        half = _halves(symbols, round_)
        first = [np.flatnonzero(a & b) for a, b in ((~half[:-1], half[1:]), (half[:-1], ~half[1:]))]
        at = max(first, key=len)
        if not len(at):
            return
        made = symbols.copy()
        made[at] = self._named(symbols[at], symbols[at + 1])
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        self._raise(np.flatnonzero(keep), made[keep], False)

    def _step(self, level: _Level, x: np.ndarray, y: np.ndarray, forward: bool) -> np.ndarray:
        """By how many symbols of a level both boundaries can move: none where the next ones differ."""
        shift = 0 if forward else 1
        same = level.symbols[x - shift] == level.symbols[y - shift]
        if level.block is None:
            return same.astype(np.int32)
        if forward:
            left = [level.down[level.block[b] + 1] - b for b in (x, y)]
        else:
            left = [b - level.down[level.block[b - 1]] for b in (x, y)]
        return np.where(same, np.minimum(*left), 0).astype(np.int32)

    def extension(self, i: np.ndarray, j: np.ndarray, forward: bool) -> np.ndarray:
        """How many symbols from ``i`` on and from ``j`` on are the same, or before both, by pair of places."""
        way = 1 if forward else -1
        x, y = i.astype(np.int32), j.astype(np.int32)
        top = len(self.levels) - 1
        reached = np.full(len(x), top)
        rising = np.arange(len(x))
        for number, level in enumerate(self.levels[:-1]):
            if not len(rising):
                break
            a, b = x[rising], y[rising]
            inner = np.flatnonzero((level.up[a] < 0) | (level.up[b] < 0))
            step = self._step(level, a[inner], b[inner], forward) * way
            a[inner] += step
            b[inner] += step
            up = (level.up[a], level.up[b])
            risen = (up[0] >= 0) & (up[1] >= 0)
            x[rising], y[rising] = np.where(risen, up[0], a), np.where(risen, up[1], b)
            reached[rising[~risen]] = number
            rising = rising[risen]
        for number in range(top, -1, -1):
            level = self.levels[number]
            falling = np.flatnonzero(reached >= number)
            moving = falling
            while len(moving):
                step = self._step(level, x[moving], y[moving], forward)
                moving, step = moving[step > 0], step[step > 0] * way
                x[moving] += step
                y[moving] += step
            if number:
                below = self.levels[number - 1].down
                x[falling], y[falling] = below[x[falling]], below[y[falling]]
        return np.abs(x - i).astype(np.int64)


def _grid(ids: np.ndarray, offsets: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and periods of the grids at which a run may lie: ``AGREE`` places in a row equal those a period on."""
    periods = np.where(lengths >= WORDS, lengths // PERIODS, 0)
    text = np.repeat(np.arange(len(lengths)), periods)
    q = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    step = np.maximum(WORDS, PERIODS * q) - q
    places = (lengths[text] - 1 - q) // step + 1
    ends = np.cumsum(places)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    at = 0
    while at < len(q):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PLACES, "right")))
        some = slice(at, upto)
        count = places[some]
        number = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        far = np.repeat(q[some], count)
        place = np.repeat(offsets[text[some]], count) + number * np.repeat(step[some], count)
        same = ids[place] == ids[place + far]
        place, far = place[same], far[same]
        ahead, behind = np.ones(len(place), bool), np.ones(len(place), bool)
        for k in range(1, AGREE):
            ahead &= ids[place + k] == ids[place + far + k]
            behind &= ids[place - k] == ids[place + far - k]
        found.append((place[ahead | behind], far[ahead | behind]))
        at = upto
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([p for p, _ in found]), np.concatenate([f for _, f in found])


def runs_of(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, start, length and period of all runs of texts given as numbers, by text, start and period."""
    free = max((int(t.max()) for t in texts if len(t)), default=0) + 1
    lengths = np.array([len(t) for t in texts], np.int64)
    between = np.arange(free, free + len(texts) + 2 * AGREE, dtype=np.int64)
    parts = [between[:AGREE]]
    for k, text in enumerate(texts):
        parts += [text, between[AGREE + k : AGREE + k + 1]]
    ids = np.concatenate([*parts, between[AGREE + len(texts) :]])
    offsets = AGREE + np.cumsum(lengths + 1) - lengths - 1
    place, q = _grid(ids, offsets, lengths)
    owner = np.searchsorted(offsets, place, "right") - 1
    # Only texts that a run may lie in are compressed.
    asked = np.unique(owner)
    if not len(asked):
        return (np.zeros(0, np.int64),) * 4
    spans = [ids[offsets[k] : offsets[k] + lengths[k] + 1] for k in asked]
    moved = np.zeros(len(texts), np.int64)
    moved[asked] = 1 + np.cumsum([0, *map(len, spans[:-1])])
    _, small = np.unique(np.concatenate([ids[:1], *spans]), return_inverse=True)
    grammar = Grammar(small, int(lengths[asked].max()))
    i = place - offsets[owner] + moved[owner]
    after, before = grammar.extension(i, i + q, True), grammar.extension(i, i + q, False)
    start = place - offsets[owner] - before
    length = before + q + after
    ok = length >= np.maximum(WORDS, PERIODS * q)
    owner, start, length, q = owner[ok], start[ok], length[ok], q[ok]
    # Of the periods of one stretch the smallest counts; the others are its multiples.
    order = np.lexsort((q, length, start, owner))
    owner, start, length, q = owner[order], start[order], length[order], q[order]
    new = np.ones(len(q), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    owner, start, length, q = owner[new], start[new], length[new], q[new]
    order = np.lexsort((q, start, owner))
    return owner[order], start[order], length[order], q[order]


_FOUND = (
    "struct<runs:array<struct<start:bigint,length:bigint,period:bigint>>,"
    "kept:array<struct<start:bigint,length:bigint>>>"
)
_SPAN = pa.struct([("start", pa.int64()), ("length", pa.int64())])
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _kept(length: int, start: np.ndarray, run: np.ndarray, period: np.ndarray) -> list[dict]:
    """Stretches of a text that no run repeats."""
    edges = np.zeros(length + 1, np.int64)
    np.add.at(edges, start + period, 1)
    np.add.at(edges, start + run, -1)
    kept = np.concatenate(([0], np.cumsum(edges[:-1]) == 0, [0])).astype(np.int8)
    turns = np.flatnonzero(np.diff(kept))
    return [{"start": a, "length": b - a} for a, b in zip(turns[::2].tolist(), turns[1::2].tolist())]


def _of_words(words: pa.Array) -> pa.Array:
    lengths = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    named = pc.dictionary_encode(words.flatten(), null_encoding="encode")
    ids = named.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths)
    runs: list[list[dict]] = []
    kept: list[list[dict] | None] = []
    at = 0
    while at < len(lengths):
        before = int(ends[at - 1]) if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, before + BATCH, "right")))
        texts = [ids[e - n : e] for e, n in zip(ends[at:upto].tolist(), lengths[at:upto].tolist())]
        owner, start, length, period = runs_of(texts)
        cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
        for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
            of = (start[a:b], length[a:b], period[a:b])
            runs.append([dict(zip(("start", "length", "period"), r)) for r in zip(*(x.tolist() for x in of))])
            kept.append(_kept(len(texts[k]), *of) if b > a else None)
        at = upto
    return pa.StructArray.from_arrays(
        [pa.array(runs, pa.list_(_RUN)), pa.array(kept, pa.list_(_SPAN))], ["runs", "kept"]
    )


def periodic(words: Column) -> Column:
    """``runs`` (start, length, period) and ``kept`` (start, length) of an array of words.

    A run is a stretch whose words a period apart are identical, of ``max(24, 3 * period)`` words or
    more, that no neighbouring word extends; its period is its smallest. Runs are in the order of
    start and period. ``kept`` are the stretches that remain when each run keeps its first period
    only; null where there is no run. A null or empty array has no runs; null words equal each
    other. Each row is judged alone, whatever its length: repeated rows get the same, no row is
    moved and other columns stay as they are.
    """

    @arrow_udf(_FOUND)
    def of(batch: pa.Array) -> pa.Array:
        return _of_words(batch)

    return of(words)


def collapsed(words: Column, kept: Column) -> Column:
    """The words outside of repeats, joined by spaces; all of them where ``kept`` is null."""
    parts = F.transform(kept, lambda s: F.slice(words, (s["start"] + 1).cast("int"), s["length"].cast("int")))
    return F.array_join(F.when(kept.isNull(), words).otherwise(F.flatten(parts)), " ")


def best_run(runs: Column) -> Column:
    """The run of the greatest length for its period, exactly; the first of equals. Null without runs."""
    nothing = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")

    def better(r: Column, best: Column) -> Column:
        wide = "decimal(19,0)"
        return r["length"].cast(wide) * best["period"].cast(wide) > best["length"].cast(wide) * r["period"].cast(wide)

    return F.aggregate(runs, nothing, lambda best, r: F.when(best.isNull() | better(r, best), r).otherwise(best))


def planted(words: Column, doc_id: Column) -> Column:
    """Every tenth array, by a checksum of the id, with a periodic end of its own words; null ids get none."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g, n = F.floor(h / 10), F.size(words)
    a = F.pmod(g, n).cast("int")
    p = (1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).cast("int")
    times = F.ceil((n - a) / p).cast("int")
    tail = F.flatten(F.array_repeat(F.slice(words, a + 1, p), times))
    made = F.slice(F.concat(F.slice(words, F.lit(1), a), tail), F.lit(1), n)
    return F.when((F.pmod(h, F.lit(10)) == 0) & (n > 0), made).otherwise(words)
