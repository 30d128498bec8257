"""Language-model scores by a probabilistic suffix tree over bytes.

A text is its lower-cased (A-Z) words, each ended by a space, then a line feed for the end. Its probability is the
product of its symbols' probabilities, each given the longest suffix of the preceding ``depth`` symbols that is a
state of the tree.

1. Counts of all windows of ``depth`` + 1 symbols over all training documents; a shorter context's counts are sums,
   made in the bucket where all windows with the same three last context symbols meet.
2. A context is retained if its next-symbol distribution diverges from that of the context one symbol shorter: if
   the Kullback-Leibler divergence times the context's count is at least ``evidence`` bits. The suffixes of a
   retained context are states too.
3. A state's distribution is smoothed with its parent's: p = (n + t * parent) / (total + t), where t is the number of
   symbols seen after it. The root's parent is uniform.

The tree is a table that grows with the corpus: ``evidence`` and ``min_count`` are the same at every size. Its buckets
stay apart by the symbols that its windows end with; only counts of pairs of symbols (256 x 256) are sent to all. A
block of documents tells each bucket its distinct windows there, with their training counts, and the bucket's answers,
each given the longest state, meet the block's texts.

The base score needs the count of every word. A block tells a bucket of words each of its distinct words once, and
the answers meet the block's tokens.

A task holds a block (``block_bytes`` of text or one longer document), or what all blocks tell one bucket, packed;
of that it opens one block's at a time, besides the bucket's distinct windows.

Null text: empty, so only the end token. Null doc_id: hashed as an empty text. Repeated rows get equal rows. Without
training tokens all known counts are 0 and the tree is empty. An empty table gives an empty result. Other columns
don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import Block, packed
from .store import staged
from .tokens import Words, changes, pack, summed, unpack


@dataclass(frozen=True)
class SuffixTree:
    depth: int = 6
    evidence: float = 10.0
    min_count: int = 5
    block_bytes: int = 8 << 20
    bucket_bytes: int = 16 << 20


END = np.uint64(0x6A09E667F3BCC909)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 1


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")


def symbols(words: Words, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The window at each symbol of the texts (the symbol in the low byte, the nearest before it above), and where each text's begin."""
    n = len(words.counts)
    sizes = words.ends - words.starts
    ends = np.concatenate([[0], np.cumsum(sizes + 1)])
    begin = ends[words.first] + np.arange(n + 1) * (depth + 1)
    line = np.full(begin[-1], 32, np.uint8)
    line[(begin[:-1, None] + np.arange(depth)).ravel()] = 10
    line[begin[1:] - 1] = 10
    text = words.document()
    place = np.arange(sizes.sum()) + np.repeat(ends[:-1] + np.arange(len(sizes)) * 0 + text * (depth + 1) + depth - (np.cumsum(sizes) - sizes), sizes)
    inside = np.arange(sizes.sum()) + np.repeat(words.starts - (np.cumsum(sizes) - sizes), sizes)
    line[place] = words.data[inside]
    window = line[depth:].astype(np.uint64)
    for k in range(1, depth + 1):
        window |= line[depth - k : len(line) - k].astype(np.uint64) << np.uint64(8 * k)
    keep = np.ones(len(window), bool)
    later = begin[1:-1, None] - depth + np.arange(depth)
    keep[later.ravel()] = False
    return window[keep], begin - np.arange(n + 1) * depth


#: A bucket holds the windows whose two symbols before the last share a hash, dealt further by the third.
HEADS, SALTS = 64, 16


def _head(window: Column) -> Column:
    return F.shiftright((F.shiftright(window, 8).bitwiseAND(F.lit(0xFFFF)) * 40503).bitwiseAND(F.lit(0xFFFF)), 10)


def _in_all_salts(short: DataFrame) -> DataFrame:
    """Windows of three symbols in every bucket that may hold longer ones."""
    return short.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn("bucket", (_head(F.col("key")) * SALTS + F.col("bucket")).cast("long"))


def bits(key: np.ndarray, n: np.ndarray, m: np.ndarray, parent_total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """States of sorted windows, the sizes and totals of their symbols, and their divergence times the total; m: the symbol's count after the parent."""
    state, first, size = np.unique(key >> 8, return_index=True, return_counts=True)
    if not len(state):
        return state, size, np.zeros(0), np.zeros(0)
    total = np.add.reduceat(n, first)
    return state, size, total, np.add.reduceat(n * np.log2(n * parent_total / (np.repeat(total, size) * m)), first)


def branches(window: np.ndarray, n: np.ndarray, short: np.ndarray, m: np.ndarray, base: np.ndarray, how: SuffixTree) -> list[tuple[np.ndarray, ...]]:
    """For each depth from 2: windows of retained contexts and of their suffixes, and counts; ``short`` are all windows of three symbols."""
    order = np.argsort(short)
    pairs = {2: (short[order], m[order].astype(float))}
    key, c = window, n
    for k in range(how.depth, 2, -1):
        key, inverse = np.unique(key & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
        c = np.bincount(inverse, weights=c, minlength=len(key))
        pairs[k] = key, c
    found = {}
    for k in range(2, how.depth + 1):
        key, c = pairs[k]
        if k == 2:
            up, totals = base[key >> 8 & 255, key & 255], base.sum(axis=1)[key >> 8 & 255]
        else:
            parent = key & ((1 << 8 * k) - 1)
            up = pairs[k - 1][1][np.searchsorted(pairs[k - 1][0], parent)]
            totals = found[k - 1][2][np.searchsorted(found[k - 1][0], parent >> 8)]
        state, size, total, gain = bits(key, c, up, totals)
        found[k] = state, size, total, (total >= how.min_count) & (gain >= how.evidence)
    out, longer = [], np.zeros(0, np.int64)
    for k in range(how.depth, 1, -1):
        state, size, _, kept = found[k]
        kept = kept | np.isin(state, longer & ((1 << 8 * k) - 1))
        longer = state[kept]
        rows = np.repeat(kept, size)
        out.append((k, pairs[k][0][rows], pairs[k][1][rows]))
    return out


def _buckets(windows: np.ndarray) -> np.ndarray:
    """The bucket of each window: its two symbols before the last, as in ``_head``, and a part for the third."""
    window = windows.astype(np.int64)
    return ((window >> 8 & 0xFFFF) * 40503 & 0xFFFF) // 1024 * SALTS + ((window >> 24 & 0xFF) * 167 & 0xFF) // 16


def _texts(block: Block, depth: int) -> Iterator[tuple[slice, Words, np.ndarray, np.ndarray]]:
    """Parts of a block: which texts, their words, their windows and where each text's begin."""
    for a, b, data, offsets in block.parts():
        words = Words((data, offsets), lower=True)
        yield slice(a, b), words, *symbols(words, depth)


def _tokens(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each token, texts' ends included, and the number of tokens of each text."""
    counts = words.counts + 1
    codes = np.full(counts.sum(), END, np.uint64)
    inside = np.ones(len(codes), bool)
    inside[np.cumsum(counts) - 1] = False
    codes[inside] = words.hash
    return codes, counts


def placed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and the place of each value among them."""
    order = np.argsort(values)
    ordered = values[order]
    fresh = changes(ordered)
    place = np.empty(len(values), np.int32)
    place[order] = np.cumsum(fresh, dtype=np.int32) - 1
    return ordered[fresh], place


WINDOWS, WORDS = range(2)
TOLD = "kind int, bucket long, block long, keys binary, counts binary"


def _told(blocks: DataFrame, buckets: int, how: SuffixTree) -> DataFrame:
    """What each block tells each bucket: its distinct windows or words there, in order, and their training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block(batch, i)
                held = block.column("held_out").to_numpy(zero_copy_only=False)
                found: dict[int, tuple[list, list]] = {WINDOWS: ([], []), WORDS: ([], [])}
                for texts, words, window, first in _texts(block, how.depth):
                    key = np.sort(window << np.uint64(1) | np.repeat(held[texts], np.diff(first)))
                    at = np.flatnonzero(changes(key))
                    n = np.diff(np.append(at, len(key)))
                    key = key[at]
                    found[WINDOWS][0].append(key >> np.uint64(1))
                    found[WINDOWS][1].append(np.where(key & np.uint64(1), 0, n))
                    codes, counts = _tokens(words)
                    train = ~np.repeat(held[texts], counts)
                    every, (seen, n) = np.unique(codes), np.unique(codes[train], return_counts=True)
                    counts = np.zeros(len(every), np.int64)
                    counts[np.searchsorted(every, seen)] = n
                    found[WORDS][0].append(every)
                    found[WORDS][1].append(counts)
                rows: list[tuple] = []
                for kind, (keys, counts) in found.items():
                    key, n = summed(keys, counts)
                    order, there, edges = dealt(kind, key, buckets)
                    rows += [(kind, int(b), block.number, pack(key[at]), pack(n[at].astype(np.int32))) for b, at in zip(there, np.split(order, edges))]
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], [x.split()[0] for x in TOLD.split(", ")])

    return staged(blocks.mapInArrow(run, TOLD), "told")


def dealt(kind: int, key: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of keys by bucket, the buckets, and where all but the first begin."""
    bucket = _buckets(key) if kind == WINDOWS else (key % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    there, first = np.unique(bucket[order], return_index=True)
    return order, there, first[1:]


GROWN = "bucket long, level binary, keys binary, counts binary, key long, n long"


def _grown(told: DataFrame, how: SuffixTree) -> tuple[DataFrame, np.ndarray]:
    """Windows of the retained contexts of two symbols (``key``, ``n``) and more (packed) by bucket, a table; and counts of all pairs of symbols.

    Divergence is tested on whole counts: windows meet those of all their shorter contexts in one bucket.
    """

    def merge(rows: pa.Table) -> pa.Table:
        keys, counts, size = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
        for i in range(rows.num_rows):
            key, n = unpack(rows.column("keys")[i].as_py(), np.uint64), unpack(rows.column("counts")[i].as_py(), np.int32).astype(np.int64)
            keys.append(key[n > 0])
            counts.append(n[n > 0])
            size += len(keys[-1])
            if size > 2_000_000 + 2 * len(keys[0]):
                keys, counts = ([x] for x in summed(keys, counts))
                size = 0
        key, n = summed(keys, counts)
        short, m = summed([key & np.uint64((1 << 24) - 1)], [n])
        bucket, none = rows.column("bucket")[0].as_py(), [None] * len(short)
        whole = [[pack(key)], [pack(n)]] if len(key) else [[None], [None]]
        return pa.table({"bucket": pa.array([bucket] * (len(short) + 1), pa.int64()), "key": pa.array([None, *short.tolist()], pa.int64()), "n": pa.array([None, *m.tolist()], pa.int64()), **{c: pa.array(x + none, pa.binary()) for c, x in zip(("windows", "counts"), whole)}})

    counted = told.where(F.col("kind") == WINDOWS).select("bucket", "keys", "counts")
    counted = staged(counted.groupBy("bucket").applyInArrow(merge, "bucket long, key long, n long, windows binary, counts binary"), "windows")
    short = staged(counted.where("key is not null").groupBy("key").agg(F.sum("n").alias("n")), "short-windows")
    base = np.zeros((256, 256))
    for r in short.groupBy(F.col("key").bitwiseAND(F.lit(0xFFFF)).alias("key")).agg(F.sum("n").alias("n")).collect():
        base[r["key"] >> 8, r["key"] & 255] = r["n"]

    def grow(windows: pa.Table, shorts: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if windows.num_rows:
            bucket = windows.column("bucket")[0].as_py()
            key, n = (unpack(windows.column(c)[0].as_py(), np.int64) for c in ("windows", "counts"))
            parts = branches(key, n, shorts.column("key").to_numpy(), shorts.column("n").to_numpy(), base, how)
            level, keys, counts = (np.concatenate(x) for x in zip(*((np.full(len(p[1]), p[0], np.uint8), p[1].astype(np.int64), p[2].astype(np.int64)) for p in parts)))
            two = level == 2
            rows = [(bucket, pack(level[~two]), pack(keys[~two]), pack(counts[~two]), None, None)]
            rows += [(bucket, None, None, None, *x) for x in zip(keys[two].tolist(), counts[two].tolist())]
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 6, kinds)], names=[x.split()[0] for x in GROWN.split(", ")])

    windows = counted.where("windows is not null").select("bucket", "windows", "counts")
    rows = staged(windows.groupBy("bucket").cogroup(_in_all_salts(short).groupBy("bucket")).applyInArrow(grow, GROWN), "tree")
    # A context of two symbols is a state in all its buckets if one of them has it as a suffix.
    both = _in_all_salts(rows.where("key is not null").select("key", "n").distinct())
    none = (F.lit(None).cast("binary").alias(c) for c in ("level", "keys", "counts"))
    return rows.where("level is not null").unionByName(both.select("bucket", *none, "key", "n")), base


def _branches(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """level, window and count of rows of the tree."""
    whole, two = rows.filter(rows.column("level").is_valid()), rows.filter(rows.column("key").is_valid())
    packed = [[unpack(x, kind) for x in whole.column(c).to_pylist()] for c, kind in (("level", np.uint8), ("keys", np.int64), ("counts", np.int64))]
    short = (np.full(two.num_rows, 2, np.uint8), two.column("key").to_numpy(), two.column("n").to_numpy())
    return tuple(np.concatenate([*x, y]) for x, y in zip(packed, short))


def _stem(base: np.ndarray, rows: DataFrame, how: SuffixTree) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """level, window and count of the first two levels."""
    key = np.flatnonzero(base)
    n = base.ravel()[key]
    state, _, total, gain = bits(key, n, base.sum(axis=0)[key & 255], np.full(len(key), base.sum()))
    kept = np.zeros(256, bool)
    kept[state] = (total >= how.min_count) & (gain >= how.evidence)
    kept[[r[0] for r in rows.where("key is not null").select(F.shiftright("key", 8).bitwiseAND(F.lit(255))).distinct().collect()]] = True
    key, n = key[kept[key >> 8]], n[kept[key >> 8]]
    root = np.flatnonzero(base.sum(axis=0))
    return np.repeat([0, 1], [len(root), len(key)]), np.concatenate([root, key]), np.concatenate([base.sum(axis=0)[root], n])


def leveled(level: np.ndarray, key: np.ndarray, n: np.ndarray, depth: int) -> list[tuple[np.ndarray, ...]]:
    """For each depth: states, their totals and numbers of symbols; windows and their counts."""
    out = []
    for k in range(depth + 1):
        keys, counts = key[level == k], n[level == k].astype(float)
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        state, first, size = np.unique(keys >> 8, return_index=True, return_counts=True)
        out.append((state, np.add.reduceat(counts, first) if len(first) else np.zeros(0), size.astype(float), keys, counts))
    return out


def _prepared(docs: DataFrame, how: SuffixTree) -> tuple[DataFrame, DataFrame, int]:
    """Blocks, what they tell, and the number of buckets of words."""
    blocks = packed(_keyed(docs), how.block_bytes, "lm-blocks")
    buckets = max(1, -(-(blocks.agg(F.sum("n_bytes")).first()[0] or 0) // how.bucket_bytes))
    return blocks, _told(blocks, buckets, how), buckets


def learned(docs: DataFrame, how: SuffixTree) -> list[tuple[np.ndarray, ...]]:
    """A small corpus' whole tree, as ``leveled``; scoring leaves it in its table."""
    rows, base = _grown(_prepared(docs, how)[1], how)
    level, key, n = (np.concatenate(x) for x in zip(_stem(base, rows, how), _branches(rows.drop("bucket").toArrow())))
    _, once = np.unique(np.stack([level, key]), axis=1, return_index=True)
    return leveled(level[once], key[once], n[once], how.depth)


def log_probabilities(windows: np.ndarray, model: list[tuple[np.ndarray, ...]]) -> np.ndarray:
    """log10 of each window's symbol given the longest suffix that is a state."""
    p = np.full(len(windows), 1 / 256)
    rows = np.arange(len(windows))
    for k, (states, whole, size, keys, counts) in enumerate(model):
        if not len(states) or not len(rows):
            break
        key = (windows[rows] & np.uint64((1 << 8 * (k + 1)) - 1)).astype(np.int64)
        at = np.searchsorted(states, key >> 8).clip(max=len(states) - 1)
        hit = states[at] == key >> 8
        rows, key, at = rows[hit], key[hit], at[hit]
        place = np.searchsorted(keys, key).clip(max=len(keys) - 1)
        n = np.where(keys[place] == key, counts[place], 0)
        p[rows] = (n + size[at] * p[rows]) / (whole[at] + size[at])
    return np.log10(p)


ANSWER = "kind int, block long, bucket long, said binary, tokens long, distinct long"


def _answers(told: DataFrame, rows: DataFrame, stem: tuple[np.ndarray, ...], how: SuffixTree) -> tuple[DataFrame, DataFrame]:
    """To each block and bucket, in the order told: log10 probabilities of windows (32-bit floats), training counts of words.

    A bucket of words also says how many training tokens and distinct words it has (``block`` is null).
    """
    depth, names = how.depth, [x.split()[0] for x in ANSWER.split(", ")]
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
    table = lambda rows: pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 6, kinds)], names=names)

    def probabilities(tree: pa.Table, asked: pa.Table) -> pa.Table:
        model = leveled(*(np.concatenate(x) for x in zip(stem, _branches(tree))), depth)
        one = lambda c, i: asked.column(c)[i].as_py()
        return table([(WINDOWS, one("block", i), one("bucket", i), pack(log_probabilities(unpack(one("keys", i), np.uint64), model).astype(np.float32)), None, None) for i in range(asked.num_rows)])

    def counts(asked: pa.Table) -> pa.Table:
        keys = [unpack(x, np.uint64) for x in asked.column("keys").to_pylist()]
        every, c = summed(keys, [unpack(x, np.int32).astype(np.int64) for x in asked.column("counts").to_pylist()])
        bucket = asked.column("bucket")[0].as_py()
        said = [(WORDS, block, bucket, pack(c[np.searchsorted(every, key)]), None, None) for block, key in zip(asked.column("block").to_pylist(), keys)]
        return table([*said, (WORDS, None, bucket, None, int(c.sum()), int((c > 0).sum()))])

    asked = told.select("kind", "bucket", "block", "keys", "counts")
    windows = rows.groupBy("bucket").cogroup(asked.where(F.col("kind") == WINDOWS).groupBy("bucket")).applyInArrow(probabilities, ANSWER)
    words = asked.where(F.col("kind") == WORDS).groupBy("bucket").applyInArrow(counts, ANSWER)
    return windows, staged(words, "word-counts")


def score(docs: DataFrame, how: SuffixTree = SuffixTree()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of ``docs``."""
    blocks, told, buckets = _prepared(docs, how)
    rows, base = _grown(told, how)
    windows, words = _answers(told, rows, _stem(base, rows, how), how)
    totals = words.where("block is null").agg(F.sum("tokens"), F.sum("distinct")).first()
    tokens, distinct = totals[0] or 0, totals[1] or 0
    scale, depth = np.log10(tokens + 0.5 * (distinct + 1)), how.depth
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def meet(home: pa.Table, said: pa.Table) -> pa.Table:
        block, found = Block(home), {(r["kind"], r["bucket"]): r["said"] for r in said.to_pylist()}
        parts = []
        for _, words, window, first in _texts(block, depth):
            codes, counts = _tokens(words)
            parts.append((placed(window), first[:-1], placed(codes), counts))
        values, keys = {}, {WINDOWS: np.unique(np.concatenate([x[0][0] for x in parts])), WORDS: np.unique(np.concatenate([x[2][0] for x in parts]))}
        for kind, key in keys.items():
            order, there, _ = dealt(kind, key, buckets)
            values[kind] = np.empty(len(key))
            values[kind][order] = np.concatenate([unpack(found[kind, b], np.float32 if kind == WINDOWS else np.int64) for b in there.tolist()])
        sums: list[list[np.ndarray]] = [[], [], [], []]
        for (windows, place), first, (codes, spot), counts in parts:
            p = values[WINDOWS][np.searchsorted(keys[WINDOWS], windows)][place]
            c = values[WORDS][np.searchsorted(keys[WORDS], codes)]
            known, plain = (c > 0).astype(np.int64)[spot], (np.log10(c + 0.5) - scale)[spot]
            at = np.cumsum(counts) - counts
            for out, x in zip(sums, (counts, np.add.reduceat(known, at), np.add.reduceat(plain, at), np.add.reduceat(p, first))):
                out.append(x)
        n, known, plain, score = map(np.concatenate, sums)
        columns = [block.column("doc_id"), block.column("held_out"), *(pa.array(x) for x in (n.astype(np.int64), known, np.full(len(n), tokens, np.int64), plain, score))]
        return pa.Table.from_arrays(columns, names=[x.split()[0] for x in schema.split(", ")])

    answers = windows.union(words.where("block is not null"))
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(meet, schema)
