"""Removal of repeated passages: words covered by a window of ``window`` words that also starts in a document with a smaller doc_id.

Pieces of text in which windows can recur meet by bucket of anchors (``gram`` words), as ``recurring`` says; equal
pieces count once. In a bucket:

1. Windows whose hash two documents have are confirmed as recurring. Confirmed windows in a row of the document with
   the smallest doc_id form a passage, as long as equally many documents' windows share them.
2. The passages, as sequences of words, are dealt into shards of at most ``shard_words`` words. Each shard is compiled
   into an Aho-Corasick automaton, and all pieces are streamed through it, which locates every occurrence, word for
   word. An occurrence in a document with a larger doc_id is removed.
3. A confirmed window that no occurrence of a whole passage covers is a passage of its own in another round.

Null or empty text: nothing. Null doc_id: never a source, and kept whole. Rows that repeat a doc_id don't remove
one another's words. An empty table gives an empty result. Other columns don't matter.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Block
from .recurring import Codes, Recurring, Units, covered, marked
from .tokens import Words, alone, changes, mix, run_hashes


class _WordCodes(Codes):
    def __init__(self, codes: np.ndarray):
        self.codes = codes

    def __call__(self, a: int, b: int) -> np.ndarray:
        return self.codes[a:b]


def spelled(words: Words) -> tuple[bytes, np.ndarray]:
    """The words, each with one space after it, and where each begins (one more entry)."""
    sizes = words.ends - words.starts
    edges = np.concatenate([[0], np.cumsum(sizes + 1)])
    line = np.full(edges[-1], 32, np.uint8)
    inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    line[inside + np.repeat(edges[:-1], sizes)] = words.data[inside + np.repeat(words.starts, sizes)]
    return line.tobytes(), edges


@dataclass(frozen=True)
class Repeats(Recurring):
    window: int = 50
    gram: int = 16
    inside: bool = False
    chunk_bytes: int = 8 << 20
    shard_words: int = 500_000

    def units(self, block: Block) -> Units:
        codes, counts, lines, edges = [], [], [], [np.zeros(1, np.int64)]
        for _, _, data, offsets in block.parts(1 << 20):
            words = Words((data, offsets))
            line, begin = spelled(words)
            codes.append(words.hash)
            counts.append(words.counts)
            lines.append(line)
            edges.append(begin[1:] + edges[-1][-1])
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if counts else np.zeros(1, np.int64)
        return Units(_WordCodes(np.concatenate(codes)), offsets, b"".join(lines), np.concatenate(edges))

    def repeated(self, pieces: list[bytes], docs: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        numbers: dict[bytes, int] = defaultdict()
        numbers.default_factory = numbers.__len__
        lines = [tuple(map(numbers.__getitem__, p.split())) for p in pieces]
        piece, at, group = confirmed(lines, docs, self.window)
        # In order of group and document, so that the first of a group is its source.
        fresh = changes(group)
        head = np.flatnonzero(fresh)
        size = np.diff(np.append(head, len(group)))
        gone = Located(lines, docs, self)
        order = np.lexsort((at[head], piece[head]))
        p, a, n = piece[head][order], at[head][order], size[order]
        ends = np.ones(len(p), bool)
        ends[1:] = (p[1:] != p[:-1]) | (a[1:] != a[:-1] + 1) | (n[1:] != n[:-1])
        first = np.flatnonzero(ends)
        gone.stream(p[first], a[first], np.diff(np.append(first, len(p))))
        # What of the confirmed windows is still to be located, one by one.
        source = head[np.cumsum(fresh) - 1]
        left = np.unique(source[(docs[piece] > docs[piece[source]]) & ~gone.has(piece, at)])
        gone.stream(piece[left], at[left], np.ones(len(left), np.int64))
        return gone.windows()


def confirmed(lines: list[tuple[int, ...]], docs: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Piece, offset and hash of the windows whose hash at least two documents have, in order of hash and document."""
    size = np.array([len(x) for x in lines])
    begin = np.cumsum(size) - size
    piece = np.repeat(np.arange(len(lines)), size)
    code = run_hashes(mix(np.fromiter(chain.from_iterable(lines), np.uint64, int(size.sum())) + np.uint64(1)), window)
    whole = np.flatnonzero(piece[: len(code)] == piece[window - 1 :][: len(code)])
    code, piece = code[whole], piece[whole]
    at = whole - begin[piece]
    order = np.lexsort((at, piece, docs[piece], code))
    code, piece, at = code[order], piece[order], at[order]
    if not len(code):
        return piece, at, code
    fresh = changes(code)
    head = np.flatnonzero(fresh)
    several = docs[piece[head]] < docs[piece[np.append(head[1:], len(code)) - 1]]
    keep = several[np.cumsum(fresh) - 1]
    return piece[keep], at[keep], code[keep]


class Located:
    """Windows that occurrences of passages cover in documents with a larger doc_id than the passage's own."""

    def __init__(self, lines: list[tuple[int, ...]], docs: np.ndarray, how: Repeats):
        self.lines, self.docs, self.how = lines, docs, how
        self.begin = np.concatenate([[0], np.cumsum([len(x) for x in lines])])
        self.gone = np.zeros(self.begin[-1] + 1, bool)

    def stream(self, piece: np.ndarray, at: np.ndarray, windows: np.ndarray) -> None:
        """Locates the passages of so many windows in a row, a shard at a time."""
        length = windows + self.how.window - 1
        shard = np.cumsum(length) // self.how.shard_words
        for rows in np.split(np.arange(len(piece)), np.flatnonzero(changes(shard))[1:]) if len(piece) else []:
            automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
            for k, p, a, n in zip(range(len(rows)), piece[rows].tolist(), at[rows].tolist(), length[rows].tolist()):
                automaton.add_word(self.lines[p][a : a + n], k)
            automaton.make_automaton()
            found = [(i, end, k) for i, line in enumerate(self.lines) for end, k in automaton.iter(line)]
            if found:
                i, end, k = np.array(found, np.int64).T
                later = self.docs[i] > self.docs[piece[rows][k]]
                i, end, k = i[later], end[later], k[later]
                start, n = self.begin[i] + end - length[rows][k] + 1, windows[rows][k]
                marks = np.zeros(len(self.gone) + 1, np.int32)
                np.add.at(marks, start, 1)
                np.add.at(marks, start + n, -1)
                self.gone |= np.cumsum(marks[:-1]) > 0

    def has(self, piece: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.gone[self.begin[piece] + at]

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        where = np.flatnonzero(self.gone)
        piece = np.searchsorted(self.begin, where, "right") - 1
        return piece, where - self.begin[piece]


def cut(docs: DataFrame, how: Repeats = Repeats(), before: str = "words_before") -> DataFrame:
    """``docs`` with repeated passages, and the white space after their words, cut from ``text``; a text with none stays as it is.

    Also ``before``, the words it had; a column of that name is replaced.
    """
    names = [x for x in docs.columns if x != before]
    # In blocks the columns have names of their own, so that none clashes.
    inner = {x: x if x in ("doc_id", "text") else f"c{i}" for i, x in enumerate(names)}
    blocks, found = marked(docs.select(*(docs[x].alias(y) for x, y in inner.items())), how, "passages")
    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{x}` {kinds[x]}" for x in names), f"`{before}` long"])

    def run(home: pa.Table, found: pa.Table) -> pa.Table:
        block = Block(home)
        parts = [(a, b, Words((data, offsets))) for a, b, data, offsets in block.parts()]
        counts = np.concatenate([words.counts for _, _, words in parts])
        offsets = np.concatenate([[0], np.cumsum(counts)])
        gone = covered(found, offsets, how.window)
        texts: list[str | None] = []
        for a, b, words in parts:
            out = gone[offsets[a] : offsets[b]]
            marks = np.zeros(len(words.data) + 1, np.int32)
            # A covered word goes up to where the next word of its text begins.
            last = np.zeros(len(out), bool)
            last[words.first[1:][words.counts > 0] - 1] = True
            ends = np.append(words.starts[1:], 0)
            text = words.document()
            ends[last] = words.offsets[text[last] + 1]
            np.add.at(marks, words.starts[out], 1)
            np.add.at(marks, ends[out], -1)
            stay = np.cumsum(marks[:-1]) == 0
            left = np.concatenate([[0], np.cumsum(stay)])[words.offsets].tolist()
            data = words.data[stay].tobytes()
            texts += [None if null else data[x:y].decode() for x, y, null in zip(left, left[1:], block.null[a:b])]
        columns = [pa.array(texts, pa.string()) if x == "text" else block.column(inner[x]) for x in names]
        return pa.Table.from_arrays([*columns, pa.array(counts.astype(np.int64))], names=[*names, before])

    return blocks.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(lambda home, found: alone(run(home, found)), schema)


def digests(docs: DataFrame, how: Repeats = Repeats()) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the kept words joined by one space, read from ``cut``."""
    kept = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+", " "))
    n_kept = F.when(F.col("kept") == "", 0).otherwise(F.length("kept") - F.length(F.replace("kept", F.lit(" "))) + 1)
    rows = cut(docs.select("doc_id", "text"), how).select("doc_id", F.col("words_before").alias("n_words"), kept.alias("kept"))
    return rows.select("doc_id", "n_words", (F.col("n_words") - n_kept).alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))
