"""Phrases that occur together more often than their parts, found by Rabin-Karp fingerprints.

A batch of texts is one array of bytes. Prefix polynomials over its bytes, and over the words that
they make, give the fingerprint of any word or phrase by one subtraction and one product. Three
rounds count fingerprints on Spark: of words, of pairs of frequent words, and of three and four
words all pairs of which are frequent. A last round counts the phrases themselves, verified word by
word, where the fingerprint was frequent; only those become text. A round tells the next what was
frequent by bits of fingerprints, of which there is a fixed number whatever the input; false ones
cost work only.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.llm.common import checkpointed, shuffles_dropped

#: Words of the longest phrase, occurrences of a candidate, share of them within a longer one that drops it.
LONGEST, LEAST, WITHIN = 4, 30, 80
#: What scores are multiples of, and phrases that are reported of each language.
SCALE, TOP = 2_000_000, 2000
#: Language of rows that name none.
UNKNOWN = "und"
#: Bits that a round leaves to the next, as a power of two: 8 MB.
FILTER_BITS = 26
_ROW_BITS = 15
#: Bytes looked at together, and fingerprints counted together.
SLICE, COUNTED = 1 << 21, 1 << 21
#: Fixed odd numbers: bases of the two polynomials, and of the mixing of their values.
_BYTE_BASE, _WORD_BASE = 0xD1342543DE82EF95, 0x2545F4914F6CDD1D
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_BLANK, _BREAK = 1, 2


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _classes() -> np.ndarray:
    kinds = np.zeros(256, np.uint8)
    kinds[[0x20, 0x09]] = _BLANK
    kinds[[*b".,;:!?", *range(0x0A, 0x0E)]] = _BREAK
    return kinds


_CLASS = _classes()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_SYMBOL = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class _Powers:
    """Powers of an odd number and of its inverse, modulo 2^64."""

    def __init__(self, base: int):
        self.bases = (base, pow(base, -1, 1 << 64))
        self.made = [np.ones(1, np.uint64)] * 2

    def of(self, n: int) -> list[np.ndarray]:
        if len(self.made[0]) < n:
            size = 1 << (n - 1).bit_length()
            for k, base in enumerate(self.bases):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                self.made[k] = np.multiply.accumulate(steps)
        return [p[:n] for p in self.made]


_OF_BYTES, _OF_WORDS = _Powers(_BYTE_BASE), _Powers(_WORD_BASE)


def _prefix(values: np.ndarray, powers: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers, out=sums[1:])
    return sums


class _Words:
    """Words of a slice of bytes: where they start and end, their piece, their text and its polynomial."""

    def __init__(self, data: np.ndarray, starts: np.ndarray):
        """``starts`` are the places, in ``data``, at which texts start."""
        data = _LOWER[data]
        kinds = _CLASS[data]
        inner = kinds == 0
        cut = kinds == _BREAK
        first = np.zeros(len(data), bool)
        first[starts[starts < len(data)]] = True
        cut |= first
        begins = inner.copy()
        begins[1:] &= ~inner[:-1] | first[1:]
        ends = inner.copy()
        ends[:-1] &= ~inner[1:] | first[1:]
        self.begin = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.piece = np.cumsum(cut, dtype=np.int32)[self.begin]
        powers, inverse = _OF_BYTES.of(len(data) + 1)
        sums = _prefix(_SYMBOL[data], powers[:-1])
        self.value = _mixed((sums[self.end] - sums[self.begin]) * inverse[self.begin])
        self._data, self._inner = data, inner

    def named(self) -> pa.DictionaryArray:
        """The words' texts, each different one once: equal numbers are equal texts."""
        offsets = np.zeros(len(self.begin) + 1, np.int32)
        np.cumsum(self.end - self.begin, out=offsets[1:])
        text = self._data[self._inner]
        return pa.StringArray.from_buffers(len(self.begin), pa.py_buffer(offsets), pa.py_buffer(text)).dictionary_encode()

    def grams(self, n: int, of_text: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """First words and fingerprints of all phrases of ``n`` words; ``of_text`` is added for each word's text."""
        count = len(self.begin) - n + 1
        if count <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        powers, inverse = _OF_WORDS.of(len(self.begin) + 1)
        sums = _prefix(self.value, powers[:-1])
        value = (sums[n:] - sums[:-n]) * inverse[:count] + of_text[:count] + np.uint64(n)
        at = np.flatnonzero(self.piece[: count] == self.piece[n - 1 :])
        found = _mixed(value[at])
        return at, found if bits == 64 else found >> np.uint64(64 - bits) << np.uint64(64 - bits)


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[_Words, np.ndarray]]:
    """Words of a batch in slices that no phrase crosses, with the row of each word."""
    column = batch.column("text")
    if not len(column) or column.buffers()[2] is None:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    starts = offsets[:-1] - offsets[0]
    at = 0
    while at < len(data):
        end = min(len(data), at + SLICE)
        if end < len(data):
            # A slice ends where a text starts or a piece ends: the last such place, or else the next one.
            before = starts[np.searchsorted(starts, end, "right") - 1]
            if before <= at:
                breaks = np.flatnonzero(_CLASS[data[at:end]] == _BREAK)
                before = at + int(breaks[-1]) + 1 if len(breaks) else 0
            if before <= at:
                step = end
                while step < len(data) and not (_CLASS[data[step : step + SLICE]] == _BREAK).any():
                    step += SLICE
                breaks = np.flatnonzero(_CLASS[data[step : step + SLICE]] == _BREAK)
                ahead = step + int(breaks[0]) + 1 if len(breaks) else len(data)
                text = int(np.searchsorted(starts, end, "right"))
                before = min(ahead, int(starts[text]) if text < len(starts) else len(data))
            end = int(before)
        words = _Words(data[at:end], starts[(starts >= at) & (starts < end)] - at)
        yield words, np.searchsorted(starts, words.begin + at, "right") - 1
        at = end


def _languages(batch: pa.RecordBatch) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Number of the language of each row, the languages, and what fingerprints add for each."""
    named = batch.column("lang").dictionary_encode()
    names = named.dictionary.to_pylist()
    texts = [np.frombuffer(name.encode("utf-8", "surrogatepass"), np.uint8) for name in names]
    added = [_prefix(_SYMBOL[t], _OF_BYTES.of(len(t) + 1)[0][:-1])[-1] + np.uint64(len(t)) for t in texts]
    return named.indices.to_numpy(), names, _mixed(np.array(added, np.uint64)) << np.uint64(3)


def _likely(bits: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Which fingerprints may be frequent."""
    at = (found >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _phrases(words: _Words, of_text: np.ndarray, sizes: tuple[int, ...], bits: np.ndarray | None, width: int):
    """Size, first words and fingerprints of phrases; with ``bits``, of those whose parts may all be frequent.

    Parts are words for pairs and pairs for longer phrases.
    """
    part, ok = 0, None
    for n in sizes:
        at, found = words.grams(n, of_text, width)
        if bits is not None and n > 1 and len(at):
            size = 1 if n == 2 else 2
            if size != part:
                firsts, prints = words.grams(size, of_text, width)
                part, ok = size, np.zeros(len(words.begin), bool)
                ok[firsts] = _likely(bits, prints)
            keep = np.ones(len(at), bool)
            for k in range(n - size + 1):
                keep &= ok[at + k]
            at, found = at[keep], found[keep]
        yield n, at, found


def _counts(batches: Iterator[pa.RecordBatch], sizes: tuple[int, ...], sent, width: int) -> Iterator[pa.RecordBatch]:
    """Fingerprints and how often each occurs, counted over some millions at a time."""
    bits = None if sent is None else np.frombuffer(sent.value, np.uint8)
    held: list[np.ndarray] = []
    size = 0

    def counted() -> pa.RecordBatch:
        prints, counts = np.unique(np.concatenate(held), return_counts=True)
        return pa.record_batch({"print": prints.view(np.int64), "n": counts.astype(np.int64)})

    for batch in batches:
        language, _, added = _languages(batch)
        for words, row in _slices(batch):
            for _, _, found in _phrases(words, added[language[row]], sizes, bits, width):
                held.append(found)
                size += len(found)
            if size >= COUNTED:
                yield counted()
                held, size = [], 0
    if size:
        yield counted()


def _texts(batches: Iterator[pa.RecordBatch], sent, width: int) -> Iterator[pa.RecordBatch]:
    """lang, phrase, n and a pointer (the smallest key of a row with it) of phrases that may be frequent.

    Occurrences of one fingerprint are compared word by word with the first one; others are phrases
    of their own. The phrase of no words counts all words of a language.
    """
    bits = np.frombuffer(sent.value, np.uint8)
    none = np.iinfo(np.int64).max
    for batch in batches:
        language, names, added = _languages(batch)
        keys = np.array([none if k is None else k for k in batch.column("key").to_pylist()], np.int64)
        totals: Counter = Counter()
        for words, row in _slices(batch):
            if not len(row):
                continue
            totals.update(dict(enumerate(np.bincount(language[row], minlength=len(names)).tolist())))
            named = words.named()
            ids, vocabulary = named.indices.to_numpy(), named.dictionary
            out: dict[str, list] = {"lang": [], "phrase": [], "n": [], "seen": []}
            for n, at, found in _phrases(words, added[language[row]], range(1, LONGEST + 1), bits, width):
                may = _likely(bits, found)
                at, found = at[may], found[may]
                if not len(at):
                    continue
                order = np.argsort(found, kind="stable")
                at, found = at[order], found[order]
                starts = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1])))
                group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(at))))
                first = at[starts]
                same = language[row[at]] == language[row[first]][group]
                for k in range(n):
                    same &= ids[at + k] == ids[first + k][group]
                if not same.all():  # another phrase with the same fingerprint
                    parts = [ids[at + k] for k in range(n - 1, -1, -1)]
                    order = np.lexsort((*parts, language[row[at]]))
                    at = at[order]
                    new = np.zeros(len(at), bool)
                    for column in (language[row[at]], *(ids[at + k] for k in range(n))):
                        new[1:] |= column[1:] != column[:-1]
                    new[0] = True
                    starts = np.flatnonzero(new)
                    first = at[starts]
                out["n"] += np.diff(np.append(starts, len(at))).tolist()
                out["seen"] += np.minimum.reduceat(keys[row[at]], starts).tolist()
                out["lang"] += [names[k] for k in language[row[first]].tolist()]
                columns = [vocabulary.take(pa.array(ids[first + k])).to_pylist() for k in range(n)]
                out["phrase"] += [" ".join(phrase) for phrase in zip(*columns)]
            if out["n"]:
                yield _table(out)
        yield _table({"lang": [names[k] for k in totals], "phrase": [""] * len(totals), "n": list(totals.values()), "seen": [none] * len(totals)})


def _table(out: dict[str, list]) -> pa.RecordBatch:
    types = (pa.string(), pa.string(), pa.int64(), pa.int64())
    return pa.record_batch([pa.array(v, t) for v, t in zip(out.values(), types)], names=list(out))


def _bits_of(frequent: DataFrame) -> np.ndarray:
    """The bits of frequent fingerprints: rows of 4 KB made on Spark, as many as the filter has and no more."""
    place = F.shiftrightunsigned("print", 64 - FILTER_BITS)
    rows = frequent.select(F.shiftright(place, _ROW_BITS).alias("row"), (place % (1 << _ROW_BITS)).alias("bit"))
    bits = np.zeros((1 << FILTER_BITS - _ROW_BITS, 1 << _ROW_BITS - 3), np.uint8)
    for row, found in rows.groupBy("row").agg(F.bitmap_construct_agg("bit")).collect():
        bits[row] = np.frombuffer(found, np.uint8)
    return bits.reshape(-1)


def frequent_phrases(
    docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", least: int = LEAST, width: int = 64
) -> DataFrame:
    """lang, phrase, n and seen of all phrases of one to four words that occur ``least`` times in a language.

    A-Z are lower-cased; ``.,;:!?`` and line ends cut a text into pieces, blanks and tabs a piece
    into words, and phrases lie within a piece, their words joined by one space. ``seen`` points to
    an occurrence: it is the smallest key of a row with the phrase. The row of the empty phrase has
    the number of all words of a language. A null text is empty, a null language is ``und``, a row
    without key is counted but not pointed to (``seen`` is null if there is no other), and each
    repeated row counts. No rows, no result. ``width`` is the number of bits of a fingerprint.
    """
    rows = docs.select(
        F.col(key).cast("long").alias("key"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        F.coalesce(F.col(lang), F.lit(UNKNOWN)).alias("lang"),
    )
    context = docs.sparkSession.sparkContext
    bits, sent = np.zeros((1 << FILTER_BITS) // 8, np.uint8), None
    for sizes in ((1,), (2,), tuple(range(3, LONGEST + 1))):
        counts = rows.drop("key").mapInArrow(
            lambda batches, sizes=sizes, sent=sent: _counts(batches, sizes, sent, width), "print long, n long"
        )
        with shuffles_dropped(docs.sparkSession):
            bits |= _bits_of(counts.groupBy("print").agg(F.sum("n").alias("n")).where(F.col("n") >= least))
        sent = context.broadcast(bits.tobytes())
    found = rows.mapInArrow(lambda batches: _texts(batches, sent, width), "lang string, phrase string, n long, seen long")
    counted = found.groupBy("lang", "phrase").agg(F.sum("n").alias("n"), F.min("seen").alias("seen"))
    with shuffles_dropped(docs.sparkSession):
        counted = checkpointed(counted.where((F.col("n") >= least) | (F.col("phrase") == "")))
    return counted.withColumn("seen", F.nullif("seen", F.lit(np.iinfo(np.int64).max)))


def _wide(value: Column | str) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("decimal(19,0)")


def collocations(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    least: int = LEAST,
    top: int = TOP,
    width: int = 64,
) -> DataFrame:
    """The ``top`` phrases of two to four words of each language: lang, rank, phrase, a, l, r, n, score, seen.

    ``a``, ``l`` and ``r`` count the phrase, its first and its second part, ``n`` all words of the
    language. A cut scores ``floor(SCALE * a / (l + r))``, exactly, and the cut with the lowest
    score counts, the first of equals. A phrase is left out if a longer candidate that contains it
    has at least ``WITHIN`` percent of its occurrences. Ties in score go to the more frequent
    phrase, then to the smaller one in the order of bytes. See ``frequent_phrases`` for nulls,
    repeated rows and ``seen``.
    """
    counted = frequent_phrases(docs, key, text, lang, least, width)
    words = F.split("phrase", " ")
    known = counted.where("phrase <> ''")
    candidates = known.where(F.size(words) > 1).select("lang", "phrase", F.col("n").alias("a"), "seen", words.alias("words"))
    size = F.size("words")
    cuts = candidates.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), size - 1)).alias("k")).select(
        "lang", "phrase", "a", "k",
        F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.slice("words", F.col("k") + 1, size - F.col("k")), " ").alias("rest"),
    )
    for part, count in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(known.select("lang", F.col("phrase").alias(part), F.col("n").alias(count)), ["lang", part])
    cuts = cuts.withColumn("top", _wide(F.lit(SCALE)) * _wide("a")).withColumn("low", _wide("l") + _wide("r"))
    lowest = cuts.groupBy("lang", "phrase").agg(F.min(F.struct(F.expr("top div low").alias("score"), "k", "l", "r")).alias("cut"))
    span = F.sequence(F.lit(2), size - 1)
    inner = F.transform(
        span, lambda k: F.transform(F.sequence(F.lit(1), size - k + 1), lambda i: F.array_join(F.slice("words", i, k), " "))
    )
    longer = (
        candidates.where(size > 2)
        .select("lang", "a", F.explode(F.array_distinct(F.flatten(inner))).alias("phrase"))
        .groupBy("lang", "phrase")
        .agg(F.max("a").alias("longer"))
    )
    scored = (
        candidates.drop("words")
        .join(longer, ["lang", "phrase"], "left")
        .where(F.col("longer").isNull() | (100 * _wide("longer") < WITHIN * _wide("a")))
        .join(lowest, ["lang", "phrase"])
        .join(counted.where("phrase = ''").select("lang", F.col("n").alias("words")), "lang")
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("score", F.col("cut.score")).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= top).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a",
        F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("words").alias("n"), "score", "seen",
    )
