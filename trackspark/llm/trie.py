"""A trie of conversations by LCP-aware external mergesort.

A turn is the digest of its role and text, and a conversation the string of its turns' digests, so texts are hashed
where they are read and never shuffled. Conversations are dealt by ranges of (string, id), which split a common
conversation by its ids. A task sorts them in runs of bounded size, each sequence with the number of leading turns
that it shares with the one before (its LCP), and keeps the runs compressed; a loser tree merges them, comparing two
heads by their LCPs with the last winner and turns only beyond an LCP that both have. The merged stream walks the trie
in order: a stack holds the open path, and a sequence closes all nodes below its LCP, which then are finished.

Nodes on the path of a task's first or last sequence may go on in other tasks. These few (tasks x depth) leave as parts
under their prefix, with what their finished children sum up to, and are added up; nodes under them take their parent
from there. The ids that end at such a node come in sorted pieces and are hashed one after the other, a piece in memory.

Memory: a task holds its range's digests, 32 bytes a turn, compressed, and the nodes whose parents are open. Null roles
and texts are empty; turns are ordered by number, null first, and turns of one number by digest; repeated rows are
turns of their own. Rows without a conversation id belong to none; of a negative one the remainder is negative, as in SQL. Texts may have any length; other columns don't
matter. An empty table gives no node, not even a root.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .merkle import CRC_TABLE, sql_crc
from .store import staged

#: Characters of a turn's digest.
WIDTH = 32


@dataclass(frozen=True)
class Sorting:
    """``run_turns``: turns of a run; ``piece``: ids of a piece that is hashed at a time; ``broadcast_nodes``: shared nodes up to which they are sent to all tasks."""

    run_turns: int = 100_000
    piece: int = 8192
    broadcast_nodes: int = 20_000


def code(role: Column, text: Column) -> Column:
    """128 bits of the digest of a turn, the role behind its length."""
    return F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, WIDTH)


def sequences(rows: DataFrame) -> DataFrame:
    """conv_id, its turns' digests in order, and the UTF-8 bytes of their texts."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turns = rows.where("conv_id is not null").select("conv_id", F.struct("turn", code(role, text).alias("code"), F.octet_length(text).alias("size")).alias("t"))
    found = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return found.select("conv_id", F.col("t.code").alias("codes"), F.col("t.size").alias("sizes"))


def rebuilt(convs: DataFrame, group: int = 5, most: int = 9) -> DataFrame:
    """Each conversation after the first turns of its group's first one: as many as the id's CRC modulo ``most``."""
    convs = staged(convs, "trie-conversations")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    own = convs.select("conv_id", (F.col("conv_id") - F.col("conv_id") % group).alias("base"), h.alias("h"), "codes", "sizes")
    base = convs.select(F.col("conv_id").alias("base"), F.col("codes").alias("base_codes"), F.col("sizes").alias("base_sizes"))
    joined = own.join(base, "base", "left")
    # A base has few followers, so the join is even.
    head = lambda c: F.coalesce(F.slice(F.col(c), F.lit(1), F.col("h")), F.slice(F.col(c[5:]), F.lit(1), F.lit(0)))
    tail = lambda c: F.slice(F.col(c), F.col("h") + 1, F.greatest(F.size(c) - F.col("h"), F.lit(0)))
    return joined.select("conv_id", F.concat(head("base_codes"), tail("codes")).alias("codes"), F.concat(head("base_sizes"), tail("sizes")).alias("sizes"))


def shared(a: str, b: str, start: int) -> int:
    """Leading turns that two sequences have in common, given that ``start`` are."""
    n = min(len(a), len(b)) // WIDTH
    while start < n and a[start * WIDTH : (start + 1) * WIDTH] == b[start * WIDTH : (start + 1) * WIDTH]:
        start += 1
    return start


class Run:
    """A sorted run, its items (sequence, id, sizes) kept compressed, and their LCPs."""

    def __init__(self, items: list[tuple[str, int, bytes]]):
        items.sort(key=lambda x: x[:2])
        self.lcps = [shared(a[0], b[0], 0) for a, b in zip(items, items[1:])]
        # A sequence is kept from where it leaves the one before.
        rest = [s[p * WIDTH :] for (s, _, _), p in zip(items, [0, *self.lcps])]
        self.text = zlib.compress("".join(rest).encode(), 1)
        self.lengths = np.array([len(x) for x in rest], np.int64)
        self.ids = np.array([x[1] for x in items], np.int64)
        self.sizes = zlib.compress(b"".join(x[2] for x in items), 1)

    def __iter__(self) -> Iterator[tuple[int, str, int, bytes]]:
        text, sizes, at, last, seen = zlib.decompress(self.text).decode(), zlib.decompress(self.sizes), 0, "", 0
        for n, key, lcp in zip(self.lengths.tolist(), self.ids.tolist(), [0, *self.lcps]):
            last = last[: lcp * WIDTH] + text[at : at + n]
            size = len(last) // WIDTH * 8
            yield lcp, last, key, sizes[seen : seen + size]
            at, seen = at + n, seen + size


def merged(runs: list[Run]) -> Iterator[tuple[int, str, int, bytes]]:
    """All items in order, each with its LCP with the one before, by a loser tree.

    A run's head knows its LCP with the last winner. Of two heads the one with the larger LCP is smaller, without a
    look at their turns; if they are equal, turns are compared from there, and the loser's LCP becomes that with its
    winner, which is the last winner when the loser is played again.
    """
    sources = [iter(r) for r in runs]
    k = len(sources)
    heads: list = [next(s, None) for s in sources]
    losers = [-1] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; -1 is a run that has not come yet and wins, one that has ended loses."""
        if a < 0 or b < 0:
            return (a, b) if a < 0 else (b, a)
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return (a, b) if y is None else (b, a)
        if x[0] != y[0]:
            return (a, b) if x[0] > y[0] else (b, a)
        lcp = shared(x[1], y[1], x[0])
        rest = (x[1][lcp * WIDTH : (lcp + 1) * WIDTH], x[2]), (y[1][lcp * WIDTH : (lcp + 1) * WIDTH], y[2])
        win, lose = (a, b) if rest[0] <= rest[1] else (b, a)
        heads[lose] = (lcp, *heads[lose][1:])
        return win, lose

    def replay(i: int) -> int:
        node = (i + k) // 2
        while node:
            i, losers[node] = play(i, losers[node])
            node //= 2
        return i

    winner = -1
    for i in range(k):
        winner = replay(i)
    while k and heads[winner] is not None:
        yield heads[winner]
        heads[winner] = next(sources[winner], None)
        winner = replay(winner)


class Node:
    """An open node: sums over its members and finished children so far."""

    __slots__ = ("depth", "size", "least", "members", "children", "leaves", "saved", "ends", "pending", "edge", "ids")

    def __init__(self, depth: int, size: int, edge: bool):
        self.depth, self.size, self.edge = depth, size, edge
        self.least, self.members, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.ends, self.pending, self.ids = hashlib.sha256(), [], []


PART = "prefix string, path array<string>, depth long, size long, least long, n_convs long, n_children long, n_leaves long, saved long, last_id long, piece binary"
NODE = "parent string, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
KINDS = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "array<string>": pa.list_(pa.string())}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, KINDS[f[1]]) for c, f in zip(zip(*rows), fields)], [f[0] for f in fields])


def prefix(sequence: str, depth: int) -> str:
    return hashlib.sha256(sequence[: depth * WIDTH].encode()).hexdigest()


def walked(stream: Iterator[tuple[int, str, int, bytes]], last: str, how: Sorting) -> Iterator[tuple[str, tuple]]:
    """("node", row) for each finished node and ("part", row) for parts of nodes that may go on elsewhere.

    ``last`` is the largest sequence; it and the first one mark the nodes that other tasks may have too.
    """
    stack: list[Node] = []
    before = first = None

    def closed() -> Iterator[tuple[str, tuple]]:
        node = stack.pop()
        up = stack[-1] if stack else None
        if node.edge:
            yield from part(node)
            return
        if not node.children:
            node.leaves = 1
        node.saved += (node.members - 1) * node.size
        row = (node.least, node.depth, node.members, node.children, node.leaves, node.saved, node.ends.hexdigest())
        for parent, child in node.pending:
            yield "node", (parent, child[0], child[1], node.least, *child[2:])
        up.children += 1
        up.leaves += node.leaves
        up.saved += node.saved
        if up.edge:
            yield "node", (prefix(before, up.depth), row[0], row[1], None, *row[2:])
        else:
            up.pending.append((None, row))

    def part(node: Node) -> Iterator[tuple[str, tuple]]:
        path = [prefix(before, d) for d in range(node.depth + 1)]
        yield "part", (path[-1], path, node.depth, node.size, node.least, node.members, node.children, node.leaves, node.saved, None, None)
        if node.ids:
            yield piece(node, path[-1])

    def piece(node: Node, name: str) -> tuple[str, tuple]:
        row = (name, None, None, None, None, None, None, None, None, node.ids[-1], ",".join(map(str, node.ids)).encode())
        node.ids = []
        return "part", row

    for lcp, sequence, key, sizes in stream:
        while len(stack) > lcp + 1:
            yield from closed()
        if first is None:
            first = sequence
        near = max(shared(sequence, first, 0), shared(sequence, last, 0))
        lengths = np.frombuffer(sizes, np.int64)
        for depth in range(len(stack), len(sequence) // WIDTH + 1):
            stack.append(Node(depth, int(lengths[depth - 1]) if depth else 0, depth <= near))
        before = sequence
        for node in stack:
            node.members += 1
            node.least = key if node.least is None or key < node.least else node.least
        end = stack[-1]
        if end.edge:
            end.ids.append(key)
            if len(end.ids) >= how.piece:
                yield piece(end, prefix(sequence, end.depth))
        else:
            end.ends.update(f",{key}".encode() if end.ids else str(key).encode())
            end.ids = [key]
    while stack:
        yield from closed()


def nodes(convs: DataFrame, how: Sorting = Sorting()) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of each node."""
    spark = convs.sparkSession
    kinds = [f"{x.split()[0]} {x.split()[1]}" for x in f"{NODE}, {PART}".split(", ")]
    names, fields = [], []
    for kind, source in zip(kinds, ["node"] * len(NODE.split(", ")) + ["part"] * len(PART.split(", "))):
        names.append(f"{source}_{kind.split()[0]}")
        fields.append(f"{names[-1]} {kind.split()[1]}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: list[Run] = []
        items: list[tuple[str, int, bytes]] = []
        turns, last = 0, ""
        for batch in batches:
            for text, key, sizes in zip(*(batch.column(c).to_pylist() for c in ("sequence", "conv_id", "sizes"))):
                items.append((text, key, np.array(sizes, np.int64).tobytes()))
                turns += len(sizes) + 1
                last = max(last, text)
                if turns >= how.run_turns:
                    runs.append(Run(items))
                    items, turns = [], 0
        if items:
            runs.append(Run(items))
        nothing = (None,) * len(NODE.split(", ")), (None,) * len(PART.split(", "))
        out: list[tuple] = []
        for kind, row in walked(merged(runs), last, how):
            out.append((*row, *nothing[1]) if kind == "node" else (*nothing[0], *row))
            if len(out) >= 4096:
                yield _batch(out, ", ".join(fields))
                out = []
        if out:
            yield _batch(out, ", ".join(fields))

    ordered = convs.select(F.array_join("codes", "").alias("sequence"), "conv_id", "sizes").repartitionByRange("sequence", "conv_id")
    found = staged(ordered.mapInArrow(run, ", ".join(fields)), "trie-nodes")
    finished = found.where("node_depth is not null").select(*(F.col(n).alias(n[5:]) for n in names if n.startswith("node_")))
    parts = found.where("part_prefix is not null").select(*(F.col(n).alias(n[5:]) for n in names if n.startswith("part_")))

    shared_nodes = parts.where("depth is not null").groupBy("prefix").agg(F.first("path").alias("path"), F.first("depth").alias("depth"), F.first("size").alias("size"), F.min("least").alias("conv_id"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")))
    shared_nodes = shared_nodes.withColumn("up", F.when(F.col("depth") > 0, F.element_at("path", F.col("depth").cast("int"))))
    shared_nodes = staged(shared_nodes, "trie-shared")
    below = shared_nodes.where("up is not null").groupBy(F.col("up").alias("prefix")).agg(F.count("*").alias("more"))
    own = shared_nodes.join(below, "prefix", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0)))
    own = own.withColumn("n_leaves", F.col("n_leaves") + (F.col("n_children") == 0).cast("long")).withColumn("saved", F.col("saved") + (F.col("n_convs") - 1) * F.col("size"))
    own = staged(own.drop("more"), "trie-own")
    sums = own.select(F.explode("path").alias("prefix"), "n_leaves", "saved").groupBy("prefix").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    ups = own.select(F.col("prefix").alias("up"), F.col("conv_id").alias("parent_conv_id"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, None
        for batch in batches:
            out = []
            for key, piece in zip(batch.column("prefix").to_pylist(), batch.column("piece").to_pylist()):
                if key != name:
                    if name is not None:
                        out.append((name, state.hexdigest()))
                    name, state = key, hashlib.sha256(piece)
                else:
                    state.update(b",")
                    state.update(piece)
            if out:
                yield _batch(out, "prefix string, ends string")
        if name is not None:
            yield _batch([(name, state.hexdigest())], "prefix string, ends string")

    pieces = parts.where("piece is not null").select("prefix", "last_id", "piece")
    ends = pieces.repartition("prefix").sortWithinPartitions("prefix", "last_id").mapInArrow(hashed, "prefix string, ends string")
    none = hashlib.sha256(b"").hexdigest()
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    edges = own.drop("n_leaves", "saved").join(sums, "prefix").join(ups, "up", "left").join(ends, "prefix", "left").withColumn("ends_sha256", F.coalesce("ends", F.lit(none)))
    ups = ups.withColumnRenamed("parent_conv_id", "above")
    if ups.limit(how.broadcast_nodes + 1).count() <= how.broadcast_nodes:
        ups = F.broadcast(ups)
    # Nodes that have their parent look for none, each under a key of its own.
    finished = finished.withColumn("parent", F.coalesce("parent", F.concat(F.lit("-"), F.col("conv_id").cast("string"))))
    inner = finished.join(ups, finished["parent"] == ups["up"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above"))
    return inner.select(*columns).unionByName(edges.select(*columns))


#: The same rows in DuckDB's SQL, in which a node is named by the digests on its path.
SQL = f"""
with {CRC_TABLE},
turns as (select conv_id, turn, sha256(strlen(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, ''))[1:32] as code, strlen(coalesce(text, '')) as size from conversations where conv_id is not null),
own as (select conv_id, list({{'code': code, 'size': size}} order by turn nulls first, code) as t from turns group by conv_id),
heads as (select conv_id, t, {sql_crc("conv_id::varchar")} % 9 as h from own, crc_table),
built as (select a.conv_id, list_concat(coalesce(b.t[1:a.h], []), a.t[a.h + 1:]) as t from heads a left join own b on b.conv_id = a.conv_id - a.conv_id % 5),
ways as (select conv_id, len(t) as n, list_reduce(list_transform(t, lambda x: x.code), lambda a, b: a || b, '') as s, list_transform(t, lambda x: x.size) as sizes from built),
nodes as (select s[1:32 * d] as k, d, min(conv_id) as conv_id, count(*) as n_convs, max(case when d > 0 then sizes[d] else 0 end) as size, sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (n = d), '')) as ends_sha256
    from (select *, unnest(range(0, n + 1)) as d from ways) group by s[1:32 * d], d),
kids as (select k[1:32 * (d - 1)] as k, count(*) as n_children from nodes where d > 0 group by 1),
counted as (select n.*, coalesce(n_children, 0) as n_children from nodes n left join kids using (k)),
sums as (select k[1:32 * j] as k, sum((n_children = 0)::bigint)::bigint as n_leaves, sum((n_convs - 1) * size)::bigint as saved_tokens from (select *, unnest(range(0, d + 1)) as j from counted) group by 1)
select c.conv_id, c.d as depth, p.conv_id as parent_conv_id, c.n_convs, c.n_children, n_leaves, saved_tokens, c.ends_sha256
from counted c join sums using (k) left join nodes p on c.d > 0 and p.k = c.k[1:32 * (c.d - 1)]
"""
