"""Byte-level BPE encoding and decoding by the ranks of a vocabulary file.

1. A task splits a block of documents by the vocabulary's pattern and writes each document as places in the block's
   list of distinct words. A word that is a token is known at once, as the tokenizer's rule has it.
2. A block asks about each of its other words once, in one row for each bucket of words that it has words of.
   Spark's higher-order functions fold the ranked merges over the byte array of each distinct word of the corpus,
   once, with the ranks in a map, and concatenate the binary pieces that its ids decode to. A result that is the word
   again, as it is for every complete vocabulary, is told by its absence. The map and the pieces are a table of one
   row, joined to each list of words: as literals they would stand in every description of the plan, which the driver
   keeps.
3. The answers meet the block's documents. However frequent a word is, a bucket hears of it once from each block.

What a task holds is bounded by ``block_bytes`` (or, if longer, one document) and by what all blocks ask one of the
buckets, of which there is one for every ``bucket_bytes`` of text. Words of more than ``long_word`` bytes are folded
by a heap instead, as the fold's time grows with the square of a word's length.

Null text: empty, no ids. Rows are encoded one by one, so ties, repeated rows and other columns don't matter; an
empty table gives an empty result. Special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import json
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import bucketed, staged
from .tokens import alone, cut, pack, slices, spread, squeezed, swept, unpack


@dataclass(frozen=True)
class Vocabulary:
    """``words_a_task``: distinct words that a task folds, some seconds' work; ``words_a_list``: those of one row."""

    path: str = public_tokenizers.path("byte_bpe_50k.tiktoken")
    pattern: str = public_tokenizers.PATTERN
    long_word: int = 256
    block_bytes: int = 16 << 20
    bucket_bytes: int = 16 << 20
    words_a_task: int = 40_000
    words_a_list: int = 4096


#: A pair of tokens (a, b) has the key a * 2**17 + b of 34 bits. Times one of these odd numbers modulo 2**34, its upper half is a place in one of the rank map's halves.
FACTORS = (411_865_637, 230_210_453)
#: More than any token; as a token, the border of a word.
BORDER = (1 << 17) - 1


@functools.cache
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@functools.cache
def pieces(path: str) -> list[bytes]:
    known = ranks(path)
    out = [b""] * (max(known.values()) + 1)
    for piece, rank in known.items():
        out[rank] = piece
    return out


def _rank_map(path: str) -> np.ndarray:
    """The rank of each two tokens that join to a token: at one of a pair's two places, the lower half of its product plus one, and the rank; 0 is a free place."""
    known = ranks(path)
    table, half_size = [0] * (2 << 17), 1 << 17
    for piece, rank in known.items():
        for at in range(1, len(piece)):
            a, b = known.get(piece[:at]), known.get(piece[at:])
            if a is None or b is None:
                continue
            entry, half, moves = (a << 17 | b, rank), 0, 0
            while entry:
                product = entry[0] * FACTORS[half] % (1 << 34)
                place = (product >> 17) + half * half_size
                entry, table[place], half, moves = table[place], entry, 1 - half, moves + 1
                if moves > 1000:
                    raise ValueError("the rank map's halves are too small for this vocabulary")
    return np.fromiter(((entry[0] * FACTORS[at >> 17] % half_size) + 1 << 17 | entry[1] if entry else 0 for at, entry in enumerate(table)), np.int64, len(table))


TABLES = "single array<int>, ranks array<bigint>, pieces array<string>"


def _tables(spark: SparkSession, path: str) -> DataFrame:
    """What folds and decodes words, in one row: the ids of single bytes, the ranks of pairs, and all pieces in hex."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in (row for batch in batches for row in range(batch.num_rows)):
            single = pa.array([ranks(path)[bytes([b])] for b in range(256)], pa.int32())
            columns = single, pa.array(_rank_map(path)), pa.array([x.hex() for x in pieces(path)], pa.string())
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in columns], _names(TABLES))

    return staged(spark.range(0, 1, 1, 1).mapInArrow(swept(run), TABLES), "bpe-tables")


def folded(word: Column, single: Column, ranks: Column) -> Column:
    """Ids of the byte values ``word`` (array<int>): the pair of least rank merges, the first of equals, until none has a rank."""

    def fold(ranked: Column) -> Column:
        def ranked_pair(key: Column) -> Column:
            def found(half: int, product: Column) -> Column:
                # The right entry without the lower half of its product is the rank, any other is more than any rank.
                entry = F.element_at(ranked, (F.shiftright(product.bitwiseAND(bigint((1 << 34) - 1)), 17) + (1 + (half << 17))).cast("int"))
                return entry.bitwiseXOR(F.shiftleft(product.bitwiseAND(bigint(BORDER)) + 1, 17))

            both = (found(half, key * bigint(factor)) for half, factor in enumerate(FACTORS))
            return F.shiftleft(F.least(*both, F.lit(BORDER).cast("bigint")), 34).bitwiseOR(key)

        bigint = lambda x: F.lit(x).cast("bigint")
        left = lambda pair: F.shiftright(pair, 17).bitwiseAND(F.lit(BORDER).cast("bigint"))
        right = lambda pair: pair.bitwiseAND(F.lit(BORDER).cast("bigint"))
        # The pairs of neighbours, borders included, each with its rank in front.
        tokens = F.concat(F.array(bigint(BORDER)), F.transform(word, lambda b: F.element_at(single, b + 1).cast("bigint")), F.array(bigint(BORDER)))
        keys = F.transform(F.array(tokens), lambda x: F.transform(F.slice(x, F.lit(1), F.size(x) - 1), lambda a, i: F.shiftleft(a, 17).bitwiseOR(F.element_at(x, i + 2))))[0]

        def step(pairs: Column, _: Column) -> Column:
            def merge(pairs: Column, at: Column) -> Column:
                token = F.shiftright(F.element_at(pairs, at), 34)
                fresh = F.array(left(F.element_at(pairs, at - 1)) * 131072 + token, token * 131072 + right(F.element_at(pairs, at + 1)))
                return F.concat(F.slice(pairs, F.lit(1), at - 2), F.transform(fresh, ranked_pair), F.slice(pairs, at + 2, F.size(pairs)))

            least = F.array_min(pairs)
            # The first of equal ranks, which may be of different pairs.
            at = F.array_position(F.transform(pairs, lambda x: F.shiftright(x, 34)), F.shiftright(least, 34)).cast("int")
            return F.when(least < BORDER << 34, F.aggregate(F.array(at), pairs, merge)).otherwise(pairs)

        ends = lambda pairs: F.transform(F.slice(pairs, F.lit(2), F.size(pairs) - 1), left)
        return F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(word), F.lit(1))), F.transform(keys, ranked_pair), step, ends)

    # Taken out of its row once; lambdas refer to it.
    return F.transform(F.array(ranks), fold)[0].cast("array<int>")


def heap_fold(word: bytes, known: dict[bytes, int]) -> list[int]:
    """The same ids for a long word, in n log n steps."""
    parts: list[bytes] = [word[i : i + 1] for i in range(len(word))]
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    heap = [(known[parts[i] + parts[i + 1]], i, 2) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in known]
    heapq.heapify(heap)
    while heap:
        _, i, size = heapq.heappop(heap)
        j = after[i]
        if not parts[i] or j >= len(parts) or len(parts[i]) + len(parts[j]) != size:
            continue
        parts[i], parts[j] = parts[i] + parts[j], b""
        after[i] = after[j]
        if after[j] < len(parts):
            before[after[j]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < len(parts) and (rank := known.get(parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (rank, a, len(parts[a]) + len(parts[b])))
    return [known[p] for p in parts if p]


def byte_values(word: Column) -> Column:
    """The values of a binary's bytes."""
    return F.transform(F.split(F.decode(word, "ISO-8859-1"), ""), F.ascii)


BLOCKS = "block long, keys array<string>, counts binary, places binary, lengths binary, ids binary, sizes binary, words binary, n_bytes long"


#: Places below ONE take one byte, those below TWO another, the rest four more.
ONE, TWO = 192, 192 + 63 * 256


def coded(places: np.ndarray) -> bytes:
    lead = np.where(places < ONE, places, np.where(places < TWO, ONE + (places - ONE >> 8), 255)).astype(np.uint8)
    second = (places[(places >= ONE) & (places < TWO)] - ONE & 255).astype(np.uint8)
    parts = [pack(lead), pack(second), pack(places[places >= TWO].astype(np.int32))]
    return np.array([len(x) for x in parts], np.int64).tobytes() + b"".join(parts)


def uncoded(data: bytes) -> np.ndarray:
    parts = cut(data[24:], np.frombuffer(data[:24], np.int64))
    lead, second, long = (unpack(x, kind) for x, kind in zip(parts, (np.uint8, np.uint8, np.int32)))
    out = lead.astype(np.int32)
    two = (lead >= ONE) & (lead < 255)
    out[two] = ONE + (out[two] - ONE << 8) + second
    out[lead == 255] = long
    return out


def _blocks(docs: DataFrame, vocabulary: Vocabulary, key: str) -> DataFrame:
    """A row for each block: its documents' keys and numbers of words, the place of each word in the block's list, the ids of words that are known at once (length 0: not known), and the other words."""
    path, pattern, long_word = vocabulary.path, vocabulary.pattern, vocabulary.long_word

    def made(piece: pa.RecordBatch, block: int, find: Callable[[str], list[str]], known: dict[bytes, int]) -> pa.RecordBatch:
        places: dict[str, int] = defaultdict()
        places.default_factory = places.__len__
        lists = [np.fromiter(map(places.__getitem__, find(x.as_py() or "")), np.int32) for x in piece.column("text")]
        figures = [pack(np.array([len(x) for x in lists], np.int32)), coded(np.concatenate(lists))]
        del lists  # each step's are given up before the next one's are made
        words = [w.encode() for w in places]
        places.clear()
        lengths, ids, left = np.zeros(len(words), np.int32), [], []
        for i, word in enumerate(words):
            rank = known.get(word)
            some = heap_fold(word, known) if rank is None and len(word) > long_word else [] if rank is None else [rank]
            lengths[i] = len(some)
            ids += some
            if not some:
                left.append(word)
        figures += [pack(lengths), pack(np.array(ids, np.int32)), pack(np.array([len(x) for x in left], np.int32)), squeezed(b"".join(left))]
        keys = pa.array([piece.column(key).cast(pa.string()).to_pylist()], pa.list_(pa.string()))
        size = pc.sum(pc.binary_length(piece.column("text"))).as_py() or 0
        return pa.RecordBatch.from_arrays([pa.array([block]), keys, *(pa.array([x], pa.binary()) for x in figures), pa.array([size], pa.int64())], _names(BLOCKS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, known = regex.compile(pattern).findall, ranks(path)
        block = TaskContext.get().partitionId() << 32
        for piece in slices(batches, limit=vocabulary.block_bytes):
            yield alone(made(piece, block, find, known))
            block += 1

    return bucketed(docs.select(key, "text").mapInArrow(swept(run), BLOCKS), "bpe-blocks", "block")


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<binary>": pa.list_(pa.binary()), OTHERS: ODD}
    fields = [x.split() for x in schema.split(", ")]
    return pa.Table.from_arrays([pa.array(x, kinds[k]) for x, (_, k) in zip(zip(*rows) if rows else [[]] * len(fields), fields)], names=[f for f, _ in fields])


ASK = "bucket long, block long, at binary, sizes binary, words binary"


def _asked(blocks: DataFrame, buckets: int) -> DataFrame:
    """What a block asks each bucket: its words there in order of their bytes, and their places in the block's list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, lengths, sizes, words in zip(*(batch.column(x).to_pylist() for x in ("block", "lengths", "sizes", "words"))):
                words = sorted(zip(cut(spread(words), unpack(sizes, np.int32)), np.flatnonzero(unpack(lengths, np.int32) == 0).tolist()))
                bucket = np.fromiter((zlib.crc32(w) for w, _ in words), np.int64) % buckets
                order = np.argsort(bucket, kind="stable")
                there, first = np.unique(bucket[order], return_index=True)
                rows = []
                for b, at in zip(there.tolist(), np.split(order, first[1:])):
                    some = [words[i] for i in at.tolist()]
                    rows.append((b, block, pack(np.diff([i for _, i in some], prepend=0).astype(np.int32)), pack(np.array([len(w) for w, _ in some], np.int32)), squeezed(b"".join([w for w, _ in some]))))
                yield from _table(rows, ASK).to_batches()

    return blocks.select("block", "lengths", "sizes", "words").mapInArrow(swept(run), ASK)


KNOWN = "bucket long, place int, words array<binary>, block long, at binary, places binary"


def _distinct(rows: pa.Table, words_a_list: int) -> pa.Table:
    """A bucket's distinct words in lists, with the place of each list's first among them; and the places of each block's words."""
    place: dict[bytes, int] = defaultdict()
    place.default_factory = place.__len__
    asked = []
    for r in rows.to_pylist():
        words = cut(spread(r["words"]), unpack(r["sizes"], np.int32))
        asked.append((r["bucket"], None, None, r["block"], r["at"], pack(np.fromiter(map(place.__getitem__, words), np.int32))))
    bucket, words = rows.column("bucket")[0].as_py(), list(place)
    return _table([*((bucket, i, words[i : i + words_a_list], None, None, None) for i in range(0, len(words), words_a_list)), *asked], KNOWN)


OTHERS = "array<struct<at:int,bytes:binary>>"
IDS = f"bucket long, place binary, counts binary, sizes binary, texts binary, others {OTHERS}"
ANSWER = f"block long, at binary, counts binary, sizes binary, texts binary, others {OTHERS}"
ODD = pa.list_(pa.struct([("at", pa.int32()), ("bytes", pa.binary())]))


def _packed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of words' ids and bytes, packed."""
    for batch in batches:
        rows = []
        for bucket, first, found in zip(*(batch.column(x) for x in ("bucket", "place", "found"))):
            place = np.arange(len(found), dtype=np.int32) + np.int32(first.as_py())
            n, texts, data = (found.values.field(x) for x in ("n", "ids", "bytes"))
            texts = [x.encode() for x in texts.to_pylist()]
            others = [(int(i), x) for i, x in zip(place, data.to_pylist()) if x is not None]
            rows.append((bucket.as_py(), pack(place), pack(n.to_numpy().astype(np.int32)), pack(np.array(list(map(len, texts)), np.int32)), squeezed(b"".join(texts)), others))
        yield from _table(rows, IDS).to_batches()


def _words(known: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Of each distinct word: the number of its ids, the ids in one text, and what they decode to if that is not the word; packed by list."""

    def one(word: Column) -> Column:
        def told(ids: Column) -> Column:
            data = joined(ids, F.col("pieces"))
            return F.struct(F.size(ids).alias("n"), F.array_join(ids, " ").alias("ids"), F.when(~data.eqNullSafe(word), data).alias("bytes"))

        return F.transform(F.array(folded(byte_values(word), F.col("single"), F.col("ranks"))), told)[0]

    words = known.where("words is not null").select("bucket", "place", "words")
    tasks = max(1, -(-(words.agg(F.sum(F.size("words"))).first()[0] or 0) // vocabulary.words_a_task))
    rows = words.repartitionByRange(tasks, "bucket", "place").crossJoin(F.broadcast(_tables(known.sparkSession, vocabulary.path)))
    return staged(rows.select("bucket", "place", F.transform("words", one).alias("found")).mapInArrow(swept(_packed_ids), IDS), "bpe-ids")


def _answered(asked: pa.Table, words: pa.Table) -> pa.Table:
    """To each block the ids of its words, in the order asked."""
    rows = words.to_pylist()
    place = np.concatenate([unpack(r["place"], np.int32) for r in rows]) if rows else np.zeros(0, np.int32)
    order = np.argsort(place)
    n = np.concatenate([unpack(r["counts"], np.int32) for r in rows])[order] if rows else place
    texts = list(chain.from_iterable(cut(spread(r["texts"]), unpack(r["sizes"], np.int32)) for r in rows))
    texts = [texts[i] for i in order.tolist()]
    odd = {x["at"]: x["bytes"] for r in rows for x in r["others"]}
    out = []
    for r in asked.to_pylist():
        places = unpack(r["places"], np.int32)
        said = [texts[i] for i in places.tolist()]
        others = [(k, odd[i]) for k, i in enumerate(places.tolist()) if i in odd] if odd else []
        out.append((r["block"], r["at"], pack(n[places]), pack(np.array(list(map(len, said)), np.int32)), squeezed(b"".join(said)), others))
    return _table(out, ANSWER)


def _encoded(docs: DataFrame, vocabulary: Vocabulary, key: str, finish: Callable[[list, list, np.ndarray, list, list], list[pa.Array]], schema: str) -> DataFrame:
    """``finish`` on each block's document keys, their words' places, and the words' numbers of ids, ids as text, and bytes."""
    path, size = vocabulary.path, vocabulary.words_a_list
    blocks = _blocks(docs, vocabulary, key)
    buckets = max(1, -(-(blocks.agg(F.sum("n_bytes")).first()[0] or 0) // vocabulary.bucket_bytes))
    known = staged(_asked(blocks, buckets).groupBy("bucket").applyInArrow(lambda rows: alone(_distinct(rows, size)), KNOWN), "bpe-words")
    asked = known.where("words is null").select("bucket", "block", "at", "places")
    answers = asked.groupBy("bucket").cogroup(_words(known, vocabulary).groupBy("bucket")).applyInArrow(lambda asked, words: alone(_answered(asked, words)), ANSWER)

    def meet(rows: pa.Table, said: pa.Table) -> pa.Table:
        known, out = pieces(path), []
        for row in rows.to_pylist():  # one
            counts = unpack(row["counts"], np.int32)
            flat, ends = uncoded(row["places"]), np.cumsum(counts, dtype=np.int64)
            n, every = unpack(row["lengths"], np.int32).copy(), unpack(row["ids"], np.int32).tolist()
            stop = np.cumsum(n).tolist()
            texts: list[bytes] = [b""] * len(n)
            binary = list(texts)
            for i in np.flatnonzero(n).tolist():
                ids = every[stop[i] - n[i] : stop[i]]
                texts[i], binary[i] = " ".join(map(str, ids)).encode(), b"".join([known[x] for x in ids])
            for i, w in zip(np.flatnonzero(n == 0).tolist(), cut(spread(row["words"]), unpack(row["sizes"], np.int32))):
                binary[i] = w
            for r in said.to_pylist():
                at = np.cumsum(unpack(r["at"], np.int32))
                n[at] = unpack(r["counts"], np.int32)
                for i, x in zip(at.tolist(), cut(spread(r["texts"]), unpack(r["sizes"], np.int32))):
                    texts[i] = x
                for x in r["others"]:
                    binary[at[x["at"]]] = x["bytes"]
            out.append(pa.Table.from_arrays(finish(row["keys"], [flat[a:b] for a, b in zip([0, *ends[:-1]], ends)], n, texts, binary), _names(schema)))
        return pa.concat_tables(out)

    heads = blocks.select("block", "keys", "counts", "places", "lengths", "ids", "sizes", "words")
    return heads.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda rows, said: alone(meet(rows, said)), schema)


def encoded(docs: DataFrame, vocabulary: Vocabulary = Vocabulary(), key: str = "doc_id") -> DataFrame:
    """``key`` (as text) and ``ids`` of each row's whole text."""

    def finish(keys: list, places: list, n: np.ndarray, texts: list, binary: list) -> list[pa.Array]:
        return [pa.array(keys, pa.string()), pa.array([list(map(int, b" ".join(map(texts.__getitem__, at.tolist())).split())) for at in places], pa.list_(pa.int32()))]

    return _encoded(docs, vocabulary, key, finish, f"{key} string, ids array<int>")


def joined(ids: Column, table: Column) -> Column:
    """The bytes of ``ids``: pieces of ``table``, in hex, concatenated."""
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.element_at(table, i + 1)), ""))


def decoded(ids: Column, vocabulary: Vocabulary = Vocabulary()) -> Column:
    """The bytes of ``ids``: binary pieces from a literal list, concatenated."""
    return joined(ids, F.from_json(F.lit(json.dumps([x.hex() for x in pieces(vocabulary.path)])), "array<string>"))


def digests(docs: DataFrame, vocabulary: Vocabulary = Vocabulary(), key: str = "doc_id") -> DataFrame:
    """``key``, n_tokens, and the SHA-256 of the ids and of the bytes they decode to."""

    def finish(keys: list, places: list, n: np.ndarray, texts: list, binary: list) -> list[pa.Array]:
        sizes, of_ids, of_bytes = [], [], []
        for at in places:
            sizes.append(int(n[at].sum()))
            at = at.tolist()
            of_ids.append(hashlib.sha256(b" ".join(map(texts.__getitem__, at))).hexdigest())
            of_bytes.append(hashlib.sha256(b"".join(map(binary.__getitem__, at))).hexdigest())
        return [pa.array(keys, pa.string()), pa.array(sizes, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())]

    found = _encoded(docs, vocabulary, key, finish, f"{key} string, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return found.withColumn(key, F.col(key).cast(docs.schema[key].dataType))
