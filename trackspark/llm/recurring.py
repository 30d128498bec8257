"""Windows of text that recur: what blocks of documents and buckets of anchors tell each other.

Texts are sequences of units (bytes, or words). A window is ``window`` units in a row within one text.

1. Documents are packed into blocks. Each window's anchor is its first run of ``gram`` units of least hash; equal
   windows have equal anchors. A piece is the text under consecutive windows with one anchor. Equal pieces (of one
   anchor, by a 128-bit digest of their bytes) are copies: all but the first are repeated in full, so a block asks
   about one of them only, however many it has.
2. A bucket of anchors finds the first of all blocks' copies, and the anchors under which distinct pieces meet.
3. Of these, each block sends its first pieces to the bucket, which finds the repeated windows among them: that is
   ``Recurring.repeated``, the operator's own method.
4. An anchor under which a block alone has more than ``most`` distinct pieces (a template line before varied text)
   is not gathered: its windows are dealt one by one, by 128-bit digests, and copies are counted as above. So is one
   under which all blocks together have more than ``together``, however few in each: only the first of each piece's
   copies deals its windows then.

A task holds a block, or what all blocks send to one bucket. A bucket gets about ``bucket_bytes`` of text, and the text
of at most ``together`` pieces of one anchor; of further ones it gets digests only, at most ``most`` from each block.
Digests decide whether pieces, and windows in 4, are equal.

A place is (doc_id, start) if ``inside`` a document earlier windows count, else doc_id alone. Null doc_ids have none:
such rows are never a source, and nothing of them is removed.
"""

from __future__ import annotations

import hashlib
from abc import ABC, abstractmethod
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Block, packed
from .store import staged
from .tokens import alone, changes, pack, run_hashes, sliding_min, spread, squeezed, swept, unpack


@dataclass(frozen=True)
class Units:
    """A block's texts as units: each one's code, where each text's begin, and the units' bytes with where each begins (one more)."""

    codes: "Codes"
    offsets: np.ndarray
    raw: bytes
    edges: np.ndarray | range


class Codes(ABC):
    @abstractmethod
    def __call__(self, a: int, b: int) -> np.ndarray:
        """Codes of units a to b."""


@dataclass(frozen=True)
class Recurring(ABC):
    window: int
    gram: int
    inside: bool = True
    most: int = 32
    together: int = 4096
    block_bytes: int = 8 << 20
    bucket_bytes: int = 16 << 20
    chunk_bytes: int = 2 << 20

    @abstractmethod
    def units(self, block: Block) -> Units: ...

    @abstractmethod
    def repeated(self, pieces: list[bytes], docs: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece and offset of each window of ``pieces`` that also stands at a smaller place."""


class Pieces:
    """The pieces of a block in order of anchor, content and place; ``first``: none of the block's copies is at a smaller place."""

    def __init__(self, block: Block, how: Recurring):
        units = how.units(block)
        known_doc, known = block.numbers("doc_id")
        n = max(int(units.offsets[-1]) - how.window + 1, 0)
        width, part, low = how.window - how.gram + 1, 1 << 20, np.uint64((1 << 21) - 1)
        spot, least = np.empty(n, np.int64), np.empty(n, np.uint64)
        for a in range(0, n, part):
            code = run_hashes(units.codes(a, a + part + how.window - 1), how.gram)
            # With the place in the lower bits, the leftmost of equal hashes is least.
            best = sliding_min(code & ~low | np.arange(len(code), dtype=np.uint64), width) & low
            spot[a : a + part], least[a : a + part] = best.astype(np.int64) + a, code[best]
        text = np.repeat(np.arange(len(known), dtype=np.int32), np.diff(units.offsets))
        inside = (text[:n] == text[how.window - 1 :]) & known[text[:n]]
        fresh, stop = inside.copy(), inside.copy()
        fresh[1:] &= ~inside[:-1] | (spot[1:] != spot[:-1])
        stop[:-1] &= ~inside[1:] | fresh[1:]
        start = np.flatnonzero(fresh)
        count = np.flatnonzero(stop) + 1 - start
        raw = units.raw
        begin, end = units.edges[start], units.edges[start + count + how.window - 1]
        prints = b"".join([hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(begin.tolist(), end.tolist())])
        (prints, others), anchor, text = np.frombuffer(prints, np.uint64).reshape(-1, 2).T, least[start], text[start]
        doc, place = known_doc[text], start - units.offsets[text]
        order = np.lexsort((place, doc, others, prints, anchor))
        self.units = units
        self.anchor, self.prints, self.others, self.text, self.doc, self.start, self.at, self.count = (x[order] for x in (anchor, prints, others, text, doc, place, start, count))
        self.first = of_first(self.doc, self.start if how.inside else None, changes(self.anchor, self.prints, self.others))


def of_first(doc: np.ndarray, start: np.ndarray | None, fresh: np.ndarray) -> np.ndarray:
    """Rows whose place is that of the first row of their group, groups in order of place; without ``start`` a place is a document."""
    if not len(doc):
        return np.zeros(0, bool)
    head = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    return (doc == doc[head]) & ((start == start[head]) if start is not None else True)


ASK = "bucket long, block long, n long, anchors binary, prints binary, others binary, docs binary, starts binary, hot binary"


class Questions:
    """The first pieces of a block, dealt to buckets; of an anchor with more than ``most`` of them only one, marked ``hot``."""

    def __init__(self, pieces: Pieces, buckets: int, how: Recurring):
        rows = np.flatnonzero(pieces.first)
        anchor = pieces.anchor[rows]
        fresh = changes(anchor)
        group = np.cumsum(fresh) - 1
        hot = np.bincount(group, minlength=1)[group] > how.most if len(rows) else np.zeros(0, bool)
        rows, hot = rows[~hot | fresh], hot[~hot | fresh]
        bucket = (pieces.anchor[rows] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        self.rows, self.hot, self.bucket = rows[order], hot[order], bucket[order]
        self.edges = np.append(np.flatnonzero(changes(self.bucket)), len(rows)) if len(rows) else np.zeros(1, np.int64)


def _asked(blocks: DataFrame, buckets: int, how: Recurring) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block(batch, i)
                pieces = Pieces(block, how)
                asked = Questions(pieces, buckets, how)
                out = []
                for a, b in zip(asked.edges, asked.edges[1:]):
                    at = asked.rows[a:b]
                    out.append((int(asked.bucket[a]), block.number, int(b - a), *(pack(x[at]) for x in (pieces.anchor, pieces.prints, pieces.others, pieces.doc, pieces.start)), pack(asked.hot[a:b])))
                if out:
                    yield _table(out, ASK).to_batches()[0]

    return blocks.mapInArrow(swept(run), ASK)


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.Table.from_arrays([pa.array(x, kinds[k]) for x, (_, k) in zip(zip(*rows) if rows else [[]] * len(fields), fields)], names=[f for f, _ in fields])


def _joined(rows: list[dict], fields: dict[str, type]) -> tuple[list[np.ndarray], np.ndarray]:
    """The arrays of all rows in turn, and the row each entry is from."""
    arrays = [np.concatenate([unpack(r[f], kind) for r in rows]) for f, kind in fields.items()]
    return arrays, np.repeat(np.arange(len(rows)), [r["n"] for r in rows])


#: What a bucket says of a piece: nothing repeats it; it meets distinct pieces; it is a later copy; its windows are to be asked.
ALONE, MEETS, COPY, WINDOWS = range(4)
ANSWER = "bucket long, block long, n long, verdicts binary"


def _answer(rows: pa.Table, how: Recurring) -> pa.Table:
    rows = rows.sort_by("block").to_pylist()
    (anchor, prints, others, doc, start, marked), _ = _joined(rows, {"anchors": np.uint64, "prints": np.uint64, "others": np.uint64, "docs": np.int64, "starts": np.int64, "hot": np.bool_})
    order = np.lexsort((start, doc, others, prints, anchor))
    anchor, prints, others, doc, start, marked = (x[order] for x in (anchor, prints, others, doc, start, marked))
    group, kind = changes(anchor), changes(anchor, prints, others)
    at, member = np.flatnonzero(group), np.cumsum(group) - 1
    kinds = np.add.reduceat(kind.astype(np.int64), at)[member]
    hot = np.maximum.reduceat(marked, at)[member] | (kinds > how.together)
    # A marked piece speaks for others of its block, so it is no mere copy.
    said = np.where(of_first(doc, start if how.inside else None, kind) | marked, np.where(hot, WINDOWS, np.where(kinds > 1, MEETS, ALONE)), COPY).astype(np.uint8)
    verdicts = np.empty_like(said)
    verdicts[order] = said
    ends = np.cumsum([r["n"] for r in rows])
    return _table([(r["bucket"], r["block"], r["n"], pack(verdicts[e - r["n"] : e])) for r, e in zip(rows, ends)], ANSWER)


RUNS, SHARD, ASKED_WINDOWS = range(3)
ACT = "kind int, bucket long, block long, n long, texts binary, docs binary, starts binary, counts binary, keys binary, others binary, data binary"


def _acts(home: pa.Table, answers: pa.Table, buckets: int, how: Recurring) -> pa.Table:
    """What follows from the answers to a block: runs to remove, shards to merge, windows to ask."""
    block = Block(home)
    number = block.number
    pieces = Pieces(block, how)
    units, asked = pieces.units, Questions(pieces, buckets, how)
    found = {r["bucket"]: unpack(r["verdicts"], np.uint8) for r in answers.to_pylist()}
    said = np.concatenate([found[b] for b in asked.bucket[asked.edges[:-1]].tolist()]) if len(asked.rows) else np.zeros(0, np.uint8)
    verdict = np.full(len(pieces.first), COPY, np.uint8)
    verdict[asked.rows] = said
    # The marked piece of a hot anchor speaks for all of that anchor.
    hot = np.unique(pieces.anchor[asked.rows[asked.hot]])
    verdict[pieces.first & np.isin(pieces.anchor, hot)] = WINDOWS
    gone = verdict == COPY
    none = (b"", b"", b"")
    out = [(RUNS, 0, number, int(gone.sum()), pack(pieces.text[gone]), b"", pack(pieces.start[gone]), pack(pieces.count[gone]), *none)]
    meets = np.flatnonzero(verdict == MEETS)
    bucket = (pieces.anchor[meets] % np.uint64(buckets)).astype(np.int64)
    meets = meets[np.argsort(bucket, kind="stable")]
    bucket = np.sort(bucket)
    for at in np.split(meets, np.flatnonzero(changes(bucket))[1:]) if len(meets) else []:
        begin, end = units.edges[pieces.at[at]], units.edges[pieces.at[at] + pieces.count[at] + how.window - 1]
        text = b"".join([units.raw[a:b] for a, b in zip(begin.tolist(), end.tolist())])
        rows = (pack(x[at]) for x in (pieces.text, pieces.doc, pieces.start, pieces.count, pieces.anchor))
        out.append((SHARD, int(pieces.anchor[at[0]] % np.uint64(buckets)), number, len(at), *rows, pack((end - begin).astype(np.int64)), squeezed(text)))
    ask = np.flatnonzero(verdict == WINDOWS)
    if len(ask):
        count = pieces.count[ask]
        offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        start, text, doc = np.repeat(pieces.start[ask], count) + offset, np.repeat(pieces.text[ask], count), np.repeat(pieces.doc[ask], count)
        at = np.repeat(pieces.at[ask], count) + offset
        digest = [hashlib.blake2b(units.raw[a:b], digest_size=16).digest() for a, b in zip(units.edges[at].tolist(), units.edges[at + how.window].tolist())]
        digest = np.frombuffer(b"".join(digest), np.uint64).reshape(-1, 2)
        order = np.lexsort((start, doc, digest[:, 1], digest[:, 0]))
        start, text, doc, digest = start[order], text[order], doc[order], digest[order]
        first = of_first(doc, start if how.inside else None, changes(digest[:, 0], digest[:, 1]))
        later = ~first
        out.append((RUNS, 0, number, int(later.sum()), pack(text[later]), b"", pack(start[later]), pack(np.ones(int(later.sum()), np.int64)), *none))
        start, text, doc, digest = start[first], text[first], doc[first], digest[first]
        bucket = (digest[:, 0] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        for at in np.split(order, np.flatnonzero(changes(bucket[order]))[1:]):
            out.append((ASKED_WINDOWS, int(bucket[at[0]]), number, len(at), pack(text[at]), pack(doc[at]), pack(start[at]), b"", pack(np.ascontiguousarray(digest[at, 0])), pack(np.ascontiguousarray(digest[at, 1])), b""))
    return _table(out, ACT)


FOUND = "block long, n long, texts binary, starts binary, counts binary"


def _found(rows: list[dict], of: np.ndarray, text: np.ndarray, start: np.ndarray) -> pa.Table:
    """Windows to remove, by the block they are in."""
    order = np.lexsort((start, text, of))
    of, text, start = of[order], text[order], start[order]
    heads = np.flatnonzero(changes(of)) if len(of) else np.zeros(0, np.int64)
    cuts = [*heads.tolist(), len(of)]
    return _table([(rows[of[a]]["block"], b - a, pack(text[a:b]), pack(start[a:b]), pack(np.ones(b - a, np.int64))) for a, b in zip(cuts, cuts[1:])], FOUND)


def _answer_windows(rows: pa.Table, how: Recurring) -> pa.Table:
    rows = rows.to_pylist()
    (text, doc, start, key, other), of = _joined(rows, {"texts": np.int32, "docs": np.int64, "starts": np.int64, "keys": np.uint64, "others": np.uint64})
    order = np.lexsort((start, doc, other, key))
    later = order[~of_first(doc[order], start[order] if how.inside else None, changes(key[order], other[order]))]
    return _found(rows, of[later], text[later], start[later])


def _merge(rows: pa.Table, how: Recurring) -> pa.Table:
    """The windows of a bucket's pieces that repeat an earlier one, by chunks of whole anchors."""
    rows = rows.to_pylist()
    (text, doc, start, size, anchor), of = _joined(rows, {"texts": np.int32, "docs": np.int64, "starts": np.int64, "others": np.int64, "keys": np.uint64})
    raw = [spread(r["data"]) for r in rows]
    begin = np.cumsum(size) - size
    begin -= np.repeat(begin[np.cumsum([0, *(r["n"] for r in rows[:-1])])], [r["n"] for r in rows])
    order = np.argsort(anchor, kind="stable")
    fresh = changes(anchor[order])
    # A chunk ends with the anchor under which it gets full.
    chunk = (np.cumsum(size[order]) // how.chunk_bytes)[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
    pieces, starts = [], []
    for at in np.split(order, np.flatnonzero(changes(chunk))[1:]):
        owner, place = how.repeated([raw[of[i]][begin[i] : begin[i] + size[i]] for i in at.tolist()], doc[at], start[at])
        pieces.append(at[owner])
        starts.append(place)
    pieces, starts = np.concatenate(pieces), np.concatenate(starts)
    return _found(rows, of[pieces], text[pieces], start[pieces] + starts)


def marked(docs: DataFrame, how: Recurring, name: str) -> tuple[DataFrame, DataFrame]:
    """Blocks of ``docs`` (doc_id, text and any other columns), and by block the windows to remove: texts, starts, and how many in a row."""
    blocks = packed(docs, how.block_bytes, f"{name}-blocks")
    buckets = max(1, -(-(blocks.agg(F.sum("n_bytes")).first()[0] or 0) // how.bucket_bytes))
    slim = blocks.select("block", "doc_id", "sizes", "data")
    answers = staged(_asked(slim, buckets, how).groupBy("bucket").applyInArrow(lambda rows: alone(_answer(rows, how)), ANSWER), f"{name}-answers")

    def act(home: pa.Table, said: pa.Table) -> pa.Table:
        return alone(_acts(home, said, buckets, how)) if home.num_rows else _table([], ACT)

    acts = staged(slim.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(act, ACT), f"{name}-acts")
    # A task for each bucket, as this takes longer than the size of the shards tells.
    shards = acts.where(F.col("kind") == SHARD).repartition(buckets, "bucket").groupBy("bucket").applyInArrow(lambda rows: alone(_merge(rows, how)), FOUND)
    windows = acts.where(F.col("kind") == ASKED_WINDOWS).groupBy("bucket").applyInArrow(lambda rows: alone(_answer_windows(rows, how)), FOUND)
    runs = acts.where(F.col("kind") == RUNS).select("block", "n", "texts", "starts", "counts").union(shards).union(windows)
    return blocks, staged(runs, f"{name}-runs")


def covered(found: pa.Table, offsets: np.ndarray, window: int) -> np.ndarray:
    """Which units of a block the windows in ``found`` cover; ``offsets`` are where each text's units begin."""
    marks = np.zeros(int(offsets[-1]) + 1, np.int32)
    for r in found.to_pylist():
        at = offsets[unpack(r["texts"], np.int32)] + unpack(r["starts"], np.int64)
        np.add.at(marks, at, 1)
        np.add.at(marks, at + unpack(r["counts"], np.int64) + window - 1, -1)
    return np.cumsum(marks[:-1], dtype=np.int32) > 0
