"""Near duplicates by a grouped prefix join: documents whose sets of word shingles have a Jaccard similarity of at least ``percent``.

Documents with equal sets form a class; classes with equal prefixes and sizes form a group. Groups that share a
token of their prefixes and whose sizes allow the similarity are paired, pairs are expanded into their classes, and
each pair of classes is verified on the whole sets. Prefixes hold the rarest tokens; rarity comes from a sketch of
token counts over all documents (any fixed order gives the same links, so the sketch's collisions cost time only).

A token of many groups is not turned into all its pairs: first all its groups meet one of them. What that leaves in
different components meets in a second pass, so no link between components is lost.

Null or empty text: an empty set, linked with nothing. Null doc_id: never linked, component null. Rows that repeat
a doc_id count as one node. An empty table gives an empty result. Other columns don't matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import helpers, staged
from .tokens import Words, changes, mix, slices, summed, swept


@dataclass(frozen=True)
class NearDuplicates:
    """``sketch_bits``: log2 of the sketch's counters, two bytes each (32 MB in all), which are broadcast. ``small``: tokens of up to so many groups give all their pairs at once."""

    words: int = 5
    percent: int = 80
    sketch_bits: int = 24
    small: int = 8


CHUNK = 1 << 14


def sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, sorted by text then hash: text index and hash."""
    words = Words(texts, lower=True)
    at, code = words.runs(k)
    text = words.document()[at]
    short = np.flatnonzero((words.counts > 0) & (words.counts < k))
    if len(short):
        whole = []
        for i in short:
            total = np.uint64(0)
            for h in words.hash[words.first[i] : words.first[i + 1]]:
                total = mix(np.array([total ^ h], np.uint64) + np.uint64(1))[0]
            whole.append(total)
        text, code = np.concatenate([text, short]), np.concatenate([code, np.array(whole, np.uint64)])
    order = np.lexsort((code, text))
    text, code = text[order], code[order]
    first = np.ones(len(code), bool)
    first[1:] = (code[1:] != code[:-1]) | (text[1:] != text[:-1])
    return text[first], code[first]


def sketch(docs: DataFrame, how: NearDuplicates) -> np.ndarray:
    """Counts of all documents' shingles by hash slot, 1024 times their logarithm: 2 x 2**sketch_bits bytes.

    Logarithms don't saturate, so that however large the corpus, what is more common than a slot's usual load comes last.
    """
    shift, size, k = np.uint64(64 - how.sketch_bits), 1 << how.sketch_bits, how.words

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.uint32)]
        for piece in slices(batches):
            slot, n = np.unique((sets(piece.column("text"), k)[1] >> shift).astype(np.int32), return_counts=True)
            slots.append(slot)
            counts.append(n.astype(np.uint32))
            # What a task has seen, not all slots, is what it holds.
            if sum(map(len, slots)) > 1_000_000 + 2 * len(slots[0]):
                slots, counts = ([x] for x in summed(slots, counts))
        slot, n = summed(slots, counts)
        edges = np.append(np.flatnonzero(changes(slot // CHUNK)), len(slot)) if len(slot) else np.zeros(1, np.int64)
        for a, b in zip(edges, edges[1:]):
            part = np.zeros(CHUNK, np.uint32)
            part[slot[a:b] % CHUNK] = n[a:b]
            yield pa.RecordBatch.from_arrays([pa.array([int(slot[a]) // CHUNK * CHUNK]), pa.array([int(part.sum(dtype=np.int64)) % 32]), pa.array([zlib.compress(part.tobytes(), 1)])], ["at", "salt", "counts"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(CHUNK, np.uint32)
        for x in rows["counts"]:
            part = np.frombuffer(zlib.decompress(x), np.uint32)
            # Far above any slot's usual load it matters no more by how much.
            total[: len(part)] = np.minimum(total[: len(part)] + part.astype(np.uint64), 2**32 - 1)
        return pd.DataFrame({"at": [rows["at"].iloc[0]], "salt": [0], "counts": [zlib.compress(total.tobytes(), 1)]})

    schema = "at long, salt long, counts binary"
    counted = docs.select("text").mapInArrow(swept(count), schema)
    added = counted.groupBy("at", "salt").applyInPandas(add, schema).groupBy("at").applyInPandas(add, schema)
    out = np.zeros(max(size, CHUNK), np.uint16)
    for r in added.collect():
        part = np.log2(1 + np.frombuffer(zlib.decompress(r["counts"]), np.uint32).astype(float)) * 1024
        out[r["at"] : r["at"] + len(part)] = part
    return out[:size]


def prefixes(docs: DataFrame, how: NearDuplicates, *more: str) -> DataFrame:
    """doc_id, columns ``more``, n_shingles, two halves of the set's signature, a hash of size and prefix, and the prefix in order of rarity."""
    counts = docs.sparkSession.sparkContext.broadcast(sketch(docs, how))
    shift, k, percent = np.uint64(64 - how.sketch_bits), how.words, how.percent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            text, code = sets(piece.column("text"), k)
            n = np.bincount(text, minlength=piece.num_rows)
            ends = np.cumsum(n)
            signs = [np.concatenate([[np.uint64(0)], np.cumsum(mix(code ^ np.uint64(salt)))]) for salt in (0, 0x5851F42D4C957F2D)]
            signs = [(s[ends] - s[ends - n]).view(np.int64) for s in signs]
            order = np.lexsort((code, counts.value[(code >> shift).astype(np.int64)], text))
            length = np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0)
            place = np.arange(len(code)) - np.repeat(ends - n, n)
            chosen = order[place < np.repeat(length, n)]
            total = np.concatenate([[np.uint64(0)], np.cumsum(mix(code[chosen]))])
            tail = np.cumsum(length)
            alike = mix((total[tail] - total[tail - length]) ^ mix(n.astype(np.uint64))).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)), pa.array(code[chosen].view(np.int64)))
            yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in ("doc_id", *more)), pa.array(n.astype(np.int64)), pa.array(signs[0]), pa.array(signs[1]), pa.array(alike), lists], ["doc_id", *more, "n_shingles", "sign_a", "sign_b", "alike", "prefix"])

    kinds = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in more)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *more, "text").mapInArrow(swept(run), f"doc_id long{kinds}, n_shingles long, sign_a long, sign_b long, alike long, prefix array<long>")


def whole_sets(docs: DataFrame, how: NearDuplicates) -> DataFrame:
    """doc_id and the sorted set, eight bytes a shingle."""
    k = how.words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            text, code = sets(piece.column("text"), k)
            ends = np.cumsum(np.bincount(text, minlength=piece.num_rows))
            data = [code[a:b].tobytes() for a, b in zip([0, *ends[:-1]], ends)]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(data, pa.binary())], ["doc_id", "set"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(swept(run), "doc_id long, set binary")


def verified(pairs: DataFrame, every: DataFrame, how: NearDuplicates) -> DataFrame:
    """The pairs (a, b) of classes that are similar enough on their whole sets."""
    percent = how.percent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b")):
                x, y = np.frombuffer(x.as_buffer(), np.int64), np.frombuffer(y.as_buffer(), np.int64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    joined = pairs.join(every.select(F.col("doc_id").alias("a"), F.col("set").alias("set_a")), "a")
    return joined.join(every.select(F.col("doc_id").alias("b"), F.col("set").alias("set_b")), "b").select("a", "b", "set_a", "set_b").mapInArrow(swept(run), "a long, b long").distinct()


def linked(docs: DataFrame, how: NearDuplicates = NearDuplicates(), *more: str) -> tuple[DataFrame, DataFrame]:
    """Each row's doc_id, columns ``more``, n_shingles and class, and the links between classes that connect each component."""
    rows = staged(prefixes(docs, how, *more), "prefixes")
    keys = ["n_shingles", "sign_a", "sign_b"]
    # A class stands under its least doc_id.
    classes = rows.where("n_shingles > 0 and doc_id is not null").groupBy(*keys).agg(F.min("doc_id").alias("class"), F.min("alike").alias("alike"))
    classes = staged(classes, "classes")
    # A group stands under its least class.
    groups = classes.groupBy("alike").agg(F.min("class").alias("group"), F.first("n_shingles").alias("n"))
    members = staged(classes.join(groups.select("alike", "group"), "alike").select("group", F.col("class"), F.col("n_shingles").alias("n")), "members")
    posted = rows.select(F.col("doc_id").alias("group"), "alike", "prefix").join(groups.select("alike", "group"), ["alike", "group"], "left_semi").groupBy("alike", "group").agg(F.first("prefix").alias("prefix")).select(F.posexplode("prefix").alias("pos", "token"), "group")
    shared = posted.groupBy("token").agg(F.count("*").alias("k")).where("k > 1")
    posted = staged(posted.join(shared, "token").join(groups.select("group", "n"), "group"), "postings")
    fits = lambda m, n: (F.lit(100) * F.least(m, n) >= F.lit(how.percent) * F.greatest(m, n))

    # Sets of sizes n and m that are similar enough share least(n, m) elements.
    least = lambda m, n: F.ceil(F.lit(how.percent) * (m + n) / F.lit(100 + how.percent))
    # At the first token that two sets share, in the order of rarity, the rest of each must still hold that many.
    reach = F.least(F.col("n") - F.col("pos"), F.col("m") - F.col("other")) >= least(F.col("m"), F.col("n"))
    small = posted.where(F.col("k") <= how.small)
    a, b = small.select("token", F.col("group").alias("g"), "n"), small.select("token", F.col("group").alias("h"), F.col("n").alias("m"))
    together = a.join(b, "token").where(F.col("g") < F.col("h")).where(fits(F.col("m"), F.col("n"))).select("g", "h")
    large = posted.where(F.col("k") > how.small)
    # The group with the most large tokens in its prefix has the fewest of its own, so it is the likeliest to be near the others.
    common = large.groupBy("group").agg(F.count("*").alias("common"))
    hubs = large.join(common, "group").groupBy("token").agg(F.max(F.struct("common", F.col("group").alias("hub"), F.col("n").alias("m"))).alias("best")).select("token", "best.hub", "best.m")
    starred = large.join(hubs, "token").where("group <> hub").select("hub", "m", "group", "n").distinct().where(fits(F.col("m"), F.col("n"))).select(F.least("hub", "group").alias("g"), F.greatest("hub", "group").alias("h"))
    pairs = together.union(starred).distinct()
    left = members.select(F.col("group").alias("g"), F.col("class").alias("a"))
    right = members.select(F.col("group").alias("h"), F.col("class").alias("b"))
    ordered = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    spread = pairs.join(left, "g").join(right, "h").select(*ordered)
    firsts = members.groupBy("group").agg(F.min("class").alias("a"), F.count("*").alias("k")).where("k > 1")
    inside = members.join(firsts, "group").where(F.col("a") != F.col("class")).select("a", F.col("class").alias("b"))
    candidates = staged(spread.union(inside).where("a <> b").distinct(), "candidates")
    wanted = large.select("group").union(members.join(firsts, "group", "left_semi").select("group")).distinct().join(members, "group").select(F.col("class").alias("doc_id"))
    wanted = candidates.select(F.col("a").alias("doc_id")).union(candidates.select("b")).union(wanted).distinct()
    every = staged(whole_sets(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, "doc_id", "left_semi"), how).where("length(set) > 0"), "sets")
    links = staged(verified(candidates, every, how), "links")
    # Whatever shares a large token or a group and is still in several components meets in full.
    labels = components(links, "a", "b")
    labelled = members.join(labels.select(F.col("node").alias("class"), "component"), "class", "left").select("group", "class", "n", F.coalesce("component", "class").alias("label"))
    labelled = labelled.join(large.select("group").union(firsts.select("group")).distinct(), "group", "left_semi")
    labelled = staged(labelled, "labelled")
    keyed = large.select("token", "pos", "group").join(labelled, "group").select("token", "pos", "class", "n", "label")
    open_keys = keyed.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("token")
    keyed = staged(keyed.join(open_keys, "token", "left_semi"), "open")
    x = keyed.select("token", "pos", F.col("class").alias("a"), F.col("n").alias("n"), F.col("label").alias("p"))
    y = keyed.select("token", F.col("pos").alias("other"), F.col("class").alias("b"), F.col("n").alias("m"), F.col("label").alias("q"))
    # The first token that two similar sets share passes ``reach``, so pairs of which no token does are left out.
    met = x.join(y, "token").where((F.col("a") < F.col("b")) & (F.col("p") != F.col("q")) & fits(F.col("m"), F.col("n")) & reach).select("a", "n", "b", "m").distinct().join(candidates, ["a", "b"], "left_anti")
    # All that they share lies in the prefix that ends first, or among the elements after it.
    met = staged(met, "met")
    ends = met.select(F.col("a").alias("group")).union(met.select("b")).distinct()
    heads = staged(rows.select(F.col("doc_id").alias("group"), "prefix").where("size(prefix) > 0").join(ends, "group", "left_semi"), "heads")
    met = met.join(heads.select(F.col("group").alias("a"), F.col("prefix").alias("head")), "a").join(heads.select(F.col("group").alias("b"), F.col("prefix").alias("tail")), "b")
    both = F.size(F.array_intersect("head", "tail")) + F.ceil(F.lit(how.percent) * F.greatest("n", "m") / F.lit(100)) - 1
    crossed = met.where(both >= least(F.col("m"), F.col("n"))).select("a", "b")
    alike = labelled.join(firsts.select("group"), "group", "left_semi")
    within = alike.select("group", F.col("class").alias("a"), F.col("label").alias("p")).join(alike.select("group", F.col("class").alias("b"), F.col("label").alias("q")), "group").where("a < b and p <> q").select("a", "b")
    crossed = crossed.union(within).distinct().join(candidates, ["a", "b"], "left_anti")
    return rows.join(classes.select(*keys, "class"), keys, "left"), links.union(staged(verified(crossed, every, how), "links"))


def near_duplicates(docs: DataFrame, how: NearDuplicates = NearDuplicates()) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id reachable by links, the document itself included) for each row."""
    rows, links = linked(docs, how)
    labels = components(links, "a", "b").select(F.col("node").alias("class"), "component")
    return rows.join(labels, "class", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "class", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, how: NearDuplicates = NearDuplicates()) -> DataFrame:
    """The rows of ``docs`` that stand for their component; of rows with the same doc_id and text, one stays. Null ids stay.

    A row goes by its id and text, so of an id with several texts only those go that are near a smaller id's.
    """
    content = f"{helpers(docs)}content"
    # With the id, 64 bits tell its texts apart; null is no text.
    kept = docs.withColumn(content, F.xxhash64("text", F.col("text").isNull()))
    rows, links = linked(kept, how, content)
    labels = components(links, "a", "b").select(F.col("node").alias("class"), "component")
    found = rows.join(labels, "class", "left").where(F.coalesce("component", "class") < F.col("doc_id")).select("doc_id", content).distinct()
    left = kept.join(found, ["doc_id", content], "left_anti")
    # Grouped by content too, so that rows of one id with many texts are dealt out.
    once = left.where("doc_id is not null").dropDuplicates(["doc_id", content])
    return once.unionByName(left.where("doc_id is null")).select(*docs.columns)
