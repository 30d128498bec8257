"""Removal of repeated byte strings by merged Burrows-Wheeler transforms.

Each byte covered by a ``window``-byte string that also starts earlier (smaller doc_id, or same document and earlier
start) is removed. Pieces of text in which such strings can stand meet by bucket, as ``recurring`` says; equal pieces
count once. There, what the blocks sent is dealt into shards. Each shard's suffixes are sorted once; the shards'
transforms are then merged by refining their interleave: a pass orders all suffixes by ``step`` more symbols and keeps
where neighbours stop being equal (their common prefix). After ``window`` symbols the intervals that are still equal
are the repeated strings; the first of each stays.

Null or empty text: nothing. Null doc_id: never a source, and kept whole. Rows that repeat a doc_id count as one
document at equal starts and don't remove one another's first strings. An empty table gives an empty result. Other
columns don't matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Block
from .recurring import Codes, Recurring, Units, covered, marked, of_first
from .tokens import BYTE_CODE, alone, changes


class _Bytes(Codes):
    def __init__(self, data: np.ndarray):
        self.data = data

    def __call__(self, a: int, b: int) -> np.ndarray:
        return BYTE_CODE[self.data[a:b]]


class _Places:
    """Byte i begins at i."""

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return at


@dataclass(frozen=True)
class RepeatedBytes(Recurring):
    window: int = 100
    gram: int = 40
    step: int = 4
    shard_bytes: int = 1 << 19

    def units(self, block: Block) -> Units:
        return Units(_Bytes(block.bytes), block.offsets, block.raw, _Places())

    def repeated(self, pieces: list[bytes], docs: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return repeated(pieces, docs, starts, self)


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """All suffixes in order, by doubling; the last symbol is least and unique."""
    n = len(symbols)
    rank = symbols.astype(np.int64)
    size = 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - size] = rank[size:] + 1
        key = rank * (n + 600) + second
        order = np.argsort(key)
        ordered = key[order]
        fresh = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank[order] = fresh
        if fresh[-1] == n - 1 or size >= n:
            return order
        size *= 2


def transform(symbols: np.ndarray, order: np.ndarray, step: int) -> np.ndarray:
    """The ``step`` symbols before each suffix, in the suffixes' order, as one number."""
    before = np.zeros(len(symbols), np.int64)
    for k in range(step, 0, -1):
        before = before << 9 | symbols[order - k]
    return before


def merged(transforms: list[np.ndarray], passes: int) -> tuple[np.ndarray, np.ndarray]:
    """The interleave of shards' suffixes by ``passes`` steps, and the steps that each has in common with the one before (``passes`` where still equal).

    ``transforms`` has what precedes each shard's sorted suffixes. A pass takes the suffixes in their present order,
    what precedes them from each shard's transform in turn, and orders stably by that.
    """
    shard = np.repeat(np.arange(len(transforms)), [len(x) for x in transforms]).astype(np.uint16)
    n = len(shard)
    names, before = np.unique(np.concatenate(transforms), return_inverse=True)
    before = before.astype(np.uint16 if len(names) < 1 << 16 else np.int32)
    block, common = np.zeros(n, np.int32), np.full(n, passes, np.int32)
    common[:1] = 0
    symbol = np.empty_like(before)
    for done in range(passes):
        symbol[np.argsort(shard, kind="stable")] = before
        order = np.argsort(symbol, kind="stable")
        shard, old, now = shard[order], block[order], symbol[order]
        split = changes(now, old)
        split[0] = False
        common[split & (common > done)] = done
        block = np.cumsum(split, dtype=np.int32)
        if block[-1] == n - 1:
            break
    return shard, common


def repeated(pieces: list[bytes], ids: np.ndarray, starts: np.ndarray, how: "RepeatedBytes") -> tuple[np.ndarray, np.ndarray]:
    """Piece and offset of each window of ``pieces`` that also starts at a smaller place in another piece."""
    size = np.array([len(x) for x in pieces])
    shards = int(min(max(1, -(-size.sum() // how.shard_bytes)), len(pieces), 1 << 16))
    bounds = np.linspace(0, len(pieces), shards + 1).astype(int)
    transforms, owners, places = [], [], []
    for a, b in zip(bounds, bounds[1:]):
        lengths = size[a:b] + 1
        text = np.frombuffer(b"\0".join(pieces[a:b]) + b"\0", np.uint8).astype(np.int64) + 2
        text[np.cumsum(lengths) - 1] = 1
        text[-1] = 0
        order = suffix_order(text)
        transforms.append(transform(text, order, how.step))
        owners.append(np.repeat(np.arange(a, b), lengths)[order])
        places.append((np.arange(len(text)) - np.repeat(np.cumsum(lengths) - lengths, lengths))[order])
    shard, common = merged(transforms, how.window // how.step)
    turn = np.argsort(shard, kind="stable")
    owner, place = np.empty(len(shard), np.int64), np.empty(len(shard), np.int64)
    owner[turn], place[turn] = np.concatenate(owners), np.concatenate(places)
    block = np.cumsum(common < how.window // how.step)
    full = place + how.window <= size[owner]
    owner, place, block = owner[full], place[full], block[full]
    order = np.lexsort((starts[owner] + place, ids[owner], block))
    owner, place, block = owner[order], place[order], block[order]
    later = ~of_first(ids[owner], starts[owner] + place, changes(block)) if len(owner) else np.zeros(0, bool)
    return owner[later], place[later]


def removed(docs: DataFrame, how: RepeatedBytes = RepeatedBytes()) -> DataFrame:
    """doc_id, n_bytes, ``spans`` (maximal removed runs of bytes: start, length) and ``kept``, the remaining bytes, of each row."""
    if how.window % how.step:
        raise ValueError("window must be a multiple of step")
    blocks, runs = marked(docs.select("doc_id", "text"), how, "bytes")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, spans array<struct<start:bigint,length:bigint>>, kept binary"
    span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))

    def cut(home: pa.Table, found: pa.Table) -> pa.Table:
        block = Block(home)
        data, ids = block.bytes, block.column("doc_id")
        gone = covered(found, block.offsets, how.window)
        edge = np.zeros(len(data) + 1, bool)
        edge[block.offsets] = True
        head, tail = gone.copy(), gone.copy()
        head[1:] &= ~gone[:-1] | edge[1:-1]
        tail[:-1] &= ~gone[1:] | edge[1:-1]
        head, tail = np.flatnonzero(head), np.flatnonzero(tail) + 1
        of = np.searchsorted(block.offsets, head, "right") - 1
        each = pa.StructArray.from_arrays([pa.array(head - block.offsets[of]), pa.array(tail - head)], ["start", "length"])
        spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(ids) + 1)).astype(np.int32)), each).cast(span)
        left = np.concatenate([[0], np.cumsum(~gone)])[block.offsets].astype(np.int64)
        kept = data[~gone].tobytes()
        kept = pa.array([kept[a:b] for a, b in zip(left.tolist(), left[1:].tolist())], pa.binary())
        return pa.Table.from_arrays([ids, pa.array(np.diff(block.offsets)), spans, kept], names=["doc_id", "n_bytes", "spans", "kept"])

    return blocks.groupBy("block").cogroup(runs.groupBy("block")).applyInArrow(lambda home, found: alone(cut(home, found)), schema)


def digests(docs: DataFrame, how: RepeatedBytes = RepeatedBytes()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the SHA-256 of the remaining bytes of each row."""
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["length"])
    return removed(docs, how).select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
