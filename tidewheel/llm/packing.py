"""Packing documents into windows of tokens, with lexical neighbours side by side.

Documents are dealt into shards by topic. A shard has a BM25 inverted index; the document
that opens a window asks it for unused neighbours, which fill the window in the order of
their scores. The last one is cut where the window is full, and its rest opens the next.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewheel.llm.common import checkpointed

#: Fixed values of BM25.
K1, B = 1.2, 0.75
END_ID = 1
#: Fixed value: how byte-level vocabularies cut a text before they merge bytes.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Documents for which a shard is made; the largest is a few times that.
SHARD = 512
#: Classes of topics that keep apart; each class is dealt over many shards.
TOPICS = 8


def _alphabet() -> dict[str, int]:
    """The bytes that the characters of a byte-level vocabulary stand for: printable ones for themselves."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _by_rank(path: str) -> tuple[Callable[[str], list[int]], list[str]] | None:
    """An encoder of plain text for a byte-level vocabulary, and the strings that it must not see.

    None if the file holds another kind of tokenizer.
    """
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    plain = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
    if model.get("type") != "BPE" or not plain or spec.get("normalizer"):
        return None
    added = {t["content"] for t in spec.get("added_tokens", [])}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [model["vocab"]["".join(pair)] for pair in pairs]
    if made != sorted(made):
        return None
    of = _alphabet()
    ranks = {bytes(of[c] for c in token): i for token, i in model["vocab"].items() if token not in added}
    encoding = tiktoken.Encoding("words", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return encoding.encode_ordinary, sorted(added)


class _Tokens:
    """Ids of whole texts, as bytes of 16-bit numbers.

    Texts with strings of added tokens, and vocabularies that are not byte-level, go through ``tokenizers``.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids must fit in 16 bits")
        self.encode, self.added = _by_rank(path) or (None, [])

    def of(self, text: str) -> bytes:
        if not self.encode or any(a in text for a in self.added):
            return array("H", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return array("H", self.encode(text)).tobytes()


@cache
def _tokens(path: str) -> _Tokens:
    return _Tokens(path)


def _counted(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different ids in order, and how often each occurs."""
    ordered = np.sort(ids)
    starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    return ordered[starts], np.diff(np.append(starts, len(ordered)))


#: How rare an id counts; ids of byte-pair vocabularies go from frequent to rare.
_RARITY = np.log1p(np.arange(1 << 16, dtype=np.float32))


def _topic(ids: np.ndarray) -> int:
    """The class of a document: a hash of the id that weighs most, by its count and its rarity."""
    found, counts = _counted(ids)
    return int(found[(counts * _RARITY[found]).argmax()]) * 2654435761 % (1 << 32) * TOPICS >> 32


def tokenized(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (binary, 16 bits each, with a closing ``END_ID``) and topic of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([END_ID], "<u2").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                of = _tokens(path).of
                found = [of(text) + end for text in part.column("text").to_pylist()]
                topics = [_topic(np.frombuffer(ids, "<u2")) for ids in found]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(found, pa.binary()), pa.array(topics, pa.int32())],
                    ["doc_id", "ids", "topic"],
                )

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary, topic int")


class Index:
    """BM25 over the documents of one shard. Terms in more than half of them weigh nothing."""

    def __init__(self, docs: list[np.ndarray]):
        self.n = len(docs)
        lengths = np.array([len(d) for d in docs], np.float64)
        norm = K1 * (1 - B + B * lengths / lengths.mean())
        found = [_counted(d) for d in docs]
        terms = np.concatenate([t for t, _ in found]).astype(np.int64)
        counts = np.concatenate([c for _, c in found]).astype(np.float64)
        owners = np.repeat(np.arange(self.n), [len(t) for t, _ in found])
        frequency = np.bincount(terms)
        idf = np.zeros(len(frequency))
        useful = (frequency > 1) & (frequency * 2 < self.n + 1)
        idf[useful] = np.log((self.n - frequency[useful] + 0.5) / (frequency[useful] + 0.5))
        keep = useful[terms]
        terms, counts, owners = terms[keep], counts[keep], owners[keep]
        weights = idf[terms] * counts * (K1 + 1) / (counts + norm[owners])
        order = np.argsort(terms, kind="stable")
        self.owners, self.weights = owners[order], weights[order]
        self.starts = np.searchsorted(terms[order], np.arange(len(frequency) + 1))
        self.of_doc = np.split(terms, np.searchsorted(owners, np.arange(1, self.n)))

    def scores(self, doc: int) -> np.ndarray:
        """Scores of all documents against the terms of one."""
        terms = self.of_doc[doc]
        spans = [slice(a, b) for a, b in zip(self.starts[terms].tolist(), self.starts[terms + 1].tolist())]
        if not spans:
            return np.zeros(self.n)
        owners = np.concatenate([self.owners[s] for s in spans])
        return np.bincount(owners, np.concatenate([self.weights[s] for s in spans]), self.n)


def pack(docs: list[np.ndarray], window: int) -> Iterator[tuple[int, int, int, int, int]]:
    """Pieces of documents: document, start, length, sequence and offset in it.

    Every window but the last is full. The document that opens a window says which unused
    neighbours follow: by score, ties and those without any term in common by place. The
    one that no longer fits is cut, and its rest opens the next window. Document 0 opens the first.
    """
    index = Index(docs)
    left = np.ones(len(docs), bool)
    sequence = offset = doc = opener = 0
    scores: np.ndarray | None = None
    for rest in range(len(docs) - 1, -1, -1):
        left[doc] = False
        start, size = 0, len(docs[doc])
        while start < size:
            if offset == window:
                sequence, offset = sequence + 1, 0
            if not offset:
                opener, scores = doc, None
            length = min(size - start, window - offset)
            yield doc, start, length, sequence, offset
            start += length
            offset += length
        if rest:
            if scores is None:
                scores = np.where(left, index.scores(opener), -np.inf)
            scores[doc] = -np.inf
            doc = int(scores.argmax())


def pack_documents(
    docs: DataFrame, path: str, window: int = 2048, key: str = "doc_id", text: str = "text", shard: int = SHARD
) -> DataFrame:
    """Pieces: doc_id, start, length, ids (binary, 32 bits each, little-endian), doc_tokens, sequence_id, offset.

    Every id of every document, its closing ``END_ID`` included, is in exactly one piece; a
    sequence has ``window`` ids, but for the last of each shard. A null text is empty and has
    its closing id only. Repeated rows, and rows without key, are documents of their own.
    Other columns are not read. No rows, no result.

    A shard is a topic and a hash of the text's ids and of the row's position, fixed in a
    checkpoint: each topic has as many shards as any other, so that one that a third of all
    documents share is spread as well, and so are rows alike in key and text.
    """
    wanted = max(1, -(-docs.count() // shard))
    topics = min(TOPICS, wanted)
    spread = -(-wanted // topics)
    rows = checkpointed(tokenized(docs, path, key, text).withColumn("position", F.monotonically_increasing_id()))
    hashed = F.xxhash64("doc_id", F.crc32("ids"), "position")
    rows = rows.select(
        "doc_id", "ids", (F.col("topic") % topics * spread + F.pmod(hashed, F.lit(spread))).alias("shard")
    )

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("doc_id")
        number = group.column("shard")[0].as_py()
        ids = [np.frombuffer(v.as_buffer(), "<u2") for chunk in group.column("ids").chunks for v in chunk]
        keys = group.column("doc_id").to_pylist()
        out: dict[str, list] = {name: [] for name in _PIECES.names}
        for doc, start, length, sequence, offset in pack(ids, window):
            out["doc_id"].append(keys[doc])
            out["start"].append(start)
            out["length"].append(length)
            out["ids"].append(ids[doc][start : start + length].astype("<u4").tobytes())
            out["doc_tokens"].append(len(ids[doc]))
            out["sequence_id"].append((number << 32) + sequence)
            out["offset"].append(offset)
        return pa.table(out, _PIECES)

    return rows.groupBy("shard").applyInArrow(
        run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    )


_PIECES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids", pa.binary()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
    ]
)
