"""Merkle manifest of a dataset: a tree over each source's rows, a tree over the sources' roots, and a proof for each row.

A row's leaf hashes its columns. The leaves of a source are numbered in order of ``doc_id`` by ranges, and dealt in
aligned blocks of ``arity ** levels``. A block is one row, whose top node is a leaf of the next tier, until each source
has one node left; the sources' roots go the same way. Proofs come down again: in each block a traversal goes from leaf
to leaf, holding the run of nodes around it on each level, while a treehash stack a level builds the run that comes
next, one leaf at a time. The path above a block is made once and appended to those of all its leaves.

Memory: a task holds one block and, for each level, two runs and a stack. Null columns hash as ``-``, a null source is
a source of its own and the first, null ids come first. Rows with one id are ordered by their leaf; rows that are alike
have leaves that are alike, one each. Texts may have any length; other columns don't matter. An empty table gives an
empty result. ``doc_id`` may have any type that can be ordered; proofs carry it unchanged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import staged


@dataclass(frozen=True)
class Tree:
    """``levels``: of one block."""

    arity: int = 16
    levels: int = 2

    @property
    def block(self) -> int:
        return self.arity**self.levels

    def height(self, leaves: int) -> int:
        """Levels above so many leaves."""
        n = 0
        while leaves > 1:
            leaves, n = -(-leaves // self.arity), n + 1
        return n


COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def joined(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def field(c: Column) -> Column:
    """A column's value behind its number of bytes, or ``-``; no two values give one text."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*(field(columns[c]) for c in COLUMNS)), 256)


def lowered(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, source, leaf, and the leaf after tampering: where the id's CRC is a multiple of five, letters A-Z of the text are lower-cased."""
    own = {c: F.col(c) for c in COLUMNS}
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    changed = F.when(hit, leaf(own | {"text": lowered(F.col("text"))})).otherwise(leaf(own))
    return docs.select("doc_id", "source", leaf(own).alias("digest"), changed.alias("changed"))


def numbered(rows: DataFrame, of: str, order: list[str]) -> DataFrame:
    """``pos`` of each row in its tree by ``order``, from 0, and ``total``. Rows are sorted by ranges that split large trees, and counted in each."""
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, at = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            places = []
            for key in batch.column(of).to_pylist():
                last, at = key, at + 1 if key == last else 0
                places.append(at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(places), pa.int32()), pa.array(places, pa.int64())], [*batch.schema.names, "part", "at"])

    ranged = rows.repartitionByRange(of, *order).sortWithinPartitions(of, *order)
    counted = staged(ranged.mapInArrow(run, f"{kind}, part int, at long"), "merkle-order")
    parts = counted.groupBy(of, "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy(of).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(of, "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"), F.sum("n").over(Window.partitionBy(of)).alias("total"))
    return counted.join(parts, [of, "part"]).withColumn("pos", F.col("at") + F.col("offset")).drop("part", "at", "offset")


class Treehash:
    """Builds nodes of ``level`` from the leaves at ``start`` and after, one leaf an update; its stack holds less than a run a level."""

    def __init__(self, leaves: list[str], start: int, level: int, arity: int):
        self.leaves, self.at, self.arity = leaves, start, arity
        self.end = min(start + arity ** (level + 1), len(leaves))
        self.stack: list[list[str]] = [[] for _ in range(level + 1)]

    def update(self) -> None:
        if self.at < self.end:
            self.stack[0].append(self.leaves[self.at])
            self.at += 1
            for below, above in zip(self.stack, self.stack[1:]):
                if len(below) == self.arity or (below and self.at == len(self.leaves)):
                    above.append(joined(below))
                    below.clear()

    def finished(self) -> list[str]:
        while self.at < self.end:
            self.update()
        return self.stack[-1]


def traversed(leaves: list[str], levels: int, arity: int) -> Iterator[list[tuple[list[str], list[str]]]]:
    """For each leaf, the siblings left and right of its path on each level.

    Each step gives the next run of each level one leaf, so it is ready when the path turns to it.
    """
    run = [Treehash(leaves, 0, k, arity).finished() for k in range(levels)]
    coming = [Treehash(leaves, arity ** (k + 1), k, arity) for k in range(levels)]
    for i in range(len(leaves)):
        if i:
            for k in range(levels):
                coming[k].update()
                if i % arity ** (k + 1) == 0:
                    run[k] = coming[k].finished()
                    coming[k] = Treehash(leaves, i + arity ** (k + 1), k, arity)
        places = [i // arity**k % arity for k in range(levels)]
        yield [(run[k][:p], run[k][p + 1 :]) for k, p in enumerate(places)]


def _in_blocks(nodes: DataFrame, how: Tree, *more: str) -> DataFrame:
    """A row for each aligned block, with its nodes in order."""
    rows = nodes.withColumn("block", F.floor(F.col("pos") / how.block))
    return rows.groupBy("of", "block").agg(F.first("total").alias("total"), F.sort_array(F.collect_list(F.struct("pos", "digest", *more))).alias("nodes"))


def tops(blocks: DataFrame, how: Tree) -> DataFrame:
    """Each block's top node, numbered as a node of the next tier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for total, nodes in zip(batch.column("total").to_pylist(), batch.column("nodes").to_pylist()):
                level = [x["digest"] for x in nodes]
                for _ in range(min(how.levels, how.height(total))):
                    level = [joined(level[i : i + how.arity]) for i in range(0, len(level), how.arity)]
                found.append((level[0], -(-total // how.block)))
            yield pa.RecordBatch.from_arrays([batch.column("of"), batch.column("block"), pa.array([t for _, t in found], pa.int64()), pa.array([d for d, _ in found], pa.string())], ["of", "pos", "total", "digest"])

    return blocks.mapInArrow(run, "of string, pos long, total long, digest string")


def climbed(nodes: DataFrame, how: Tree, *more: str) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of each tier, from below, and the root of each tree. ``more`` columns stay with the lowest nodes."""
    tiers: list[DataFrame] = []
    while True:
        tiers.append(staged(_in_blocks(nodes, how, *(more if not tiers else ())), "merkle-blocks"))
        nodes = staged(tops(tiers[-1], how), "merkle-nodes")
        if (nodes.agg(F.max("total")).first()[0] or 0) <= 1:
            return tiers, nodes.select("of", F.col("digest").alias("top"))


PATH = "array<struct<lefts: string, rights: string>>"


def _paths(blocks: DataFrame, upper: DataFrame | None, how: Tree) -> DataFrame:
    """of, pos and path of each node in ``blocks``; ``upper`` has the path above each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                local = traversed([x["digest"] for x in row["nodes"]], min(how.levels, how.height(row["total"])), how.arity)
                paths = [[{"lefts": "".join(a), "rights": "".join(b)} for a, b in levels] + row["path"] for levels in local]
                kind = pa.list_(pa.struct([("lefts", pa.string()), ("rights", pa.string())]))
                yield pa.RecordBatch.from_arrays([pa.array([row["of"]] * len(paths)), pa.array([x["pos"] for x in row["nodes"]], pa.int64()), pa.array(paths, kind)], ["of", "pos", "path"])

    return _below(blocks, upper).mapInArrow(run, f"of string, pos long, path {PATH}")


def _below(blocks: DataFrame, upper: DataFrame | None) -> DataFrame:
    if upper is None:
        return blocks.withColumn("path", F.array().cast(PATH))
    return blocks.join(upper.withColumnRenamed("pos", "block"), ["of", "block"])


def descended(tiers: list[DataFrame], upper: DataFrame | None, how: Tree) -> DataFrame | None:
    """The path above each block of the lowest tier."""
    for blocks in reversed(tiers[1:]):
        upper = staged(_paths(blocks, upper, how), "merkle-paths")
    return upper


def folded(digest: str, path: list[dict]) -> str:
    for level in path:
        digest = hashlib.sha256(f"{level['lefts']}{digest}{level['rights']}".encode()).hexdigest()
    return digest


def manifest(docs: DataFrame, how: Tree = Tree()) -> DataFrame:
    """Each row's leaf, its source's root, the root of all, the hash of its proof, and the root that its leaf folds to after tampering."""
    rows = staged(leaves(docs), "merkle-leaves")
    numbers = numbered(rows.select(field(F.col("source")).alias("of"), "source", "doc_id", "digest", "changed"), "of", ["doc_id", "digest"])
    tiers, subroots = climbed(numbers, how, "doc_id", "changed", "source")
    # A source's own name is in its nodes; the order of sources is that of names, with null first.
    names = rows.select("source").distinct().select(field(F.col("source")).alias("name"), "source")
    sources = subroots.join(names, subroots["of"] == names["name"]).select(F.lit("").alias("of"), "name", "source", F.col("top").alias("digest"))
    above, roots = climbed(numbered(sources, "of", ["source"]), how, "name")
    root = roots.first()
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    if root is None:
        return docs.sparkSession.createDataFrame([], schema)
    root = root["top"]
    # The lowest tier of the sources' tree, its nodes the subroots under their names.
    named = above[0].select("of", F.explode("nodes").alias("n")).select("of", F.col("n.pos").alias("pos"), F.col("n.name").alias("name"), F.col("n.digest").alias("subroot"))
    ways = _paths(above[0], descended(above, None, how), how).join(named, ["of", "pos"]).select(F.col("name").alias("of"), "subroot", "path")
    ways = staged(ways, "merkle-ways")
    upper = descended(tiers, ways.select("of", F.lit(0).cast("long").alias("pos"), "path"), how)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                nodes, out = row["nodes"], []
                local = traversed([x["digest"] for x in nodes], min(how.levels, how.height(row["total"])), how.arity)
                shared = "".join(x["lefts"] + x["rights"] for x in row["path"])
                for node, levels in zip(nodes, local):
                    path = [{"lefts": "".join(a), "rights": "".join(b)} for a, b in levels]
                    proof = "".join(x["lefts"] + x["rights"] for x in path) + shared
                    back = folded(node["changed"], path + row["path"])
                    out.append((node["doc_id"], node["digest"], row["subroot"], root, hashlib.sha256(proof.encode()).hexdigest(), back, back == root))
                columns = list(zip(*out))
                id_type = batch.schema.field("nodes").type.value_type.field("doc_id").type
                kinds = [id_type, *[pa.string()] * 5, pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [x.split()[0] for x in schema.split(", ")])

    blocks = _below(tiers[0], upper).join(ways.select("of", "subroot"), "of")
    return blocks.select("total", "nodes", "path", "subroot").mapInArrow(run, schema)


def sql_crc(text: str) -> str:
    """The unsigned CRC-32 of an ASCII text in DuckDB's SQL, beside the table crc_table."""
    return f"xor(4294967295, list_reduce(list_transform(range(1, length({text}) + 1), lambda i: ascii(substr({text}, i, 1))::bigint), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]), 4294967295))"


#: A table that ``sql_crc`` needs: the remainders of all bytes, by their rule.
CRC_TABLE = "crc_table as (select list_transform(range(0, 256), lambda n: list_reduce(range(0, 8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, n::bigint)) as crc)"


def _sql_field(c: str) -> str:
    return f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')"


def _sql_leaf(text: str) -> str:
    return "sha256(" + " || ".join(_sql_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: The same rows in DuckDB's SQL. Each source is a tree, and the sources are the leaves of the tree named by null.
SQL = f"""
with recursive {CRC_TABLE},
leaves as (select *, row_number() over (order by s, doc_id nulls first, leaf) as id, row_number() over (partition by s order by doc_id nulls first, leaf) - 1 as pos from (
    select doc_id, coalesce('.' || source, '') as s, {_sql_leaf("text")} as leaf, case when coalesce({sql_crc("doc_id::varchar")} % 5 = 0, false) then {_sql_leaf(_LOWERED)} else {_sql_leaf("text")} end as changed from documents, crc_table)),
up as (
    select 0 as lvl, s, pos, leaf as h, count(*) over (partition by s) as n from leaves
    union all
    select lvl + 1, s, pos, h, count(*) over (partition by s) from (select lvl, s, pos // 16 as pos, sha256(string_agg(h, '' order by pos)) as h from up where n > 1 group by lvl, s, pos // 16)),
subroots as (select s, h, row_number() over (order by s collate "C") - 1 as pos from up where n = 1),
upper_up as (
    select 0 as lvl, pos, h, count(*) over () as n from subroots
    union all
    select lvl + 1, pos, h, count(*) over () from (select lvl, pos // 16 as pos, sha256(string_agg(h, '' order by pos)) as h from upper_up where n > 1 group by lvl, pos // 16)),
root as (select h from upper_up where n = 1),
heights as (select s, max(lvl) as height from up group by s),
sides as (
    select l.id, u.lvl as step, coalesce(string_agg(u.h, '' order by u.pos) filter (u.pos < l.pos // (16 ** u.lvl)::bigint), '') as lefts, coalesce(string_agg(u.h, '' order by u.pos) filter (u.pos > l.pos // (16 ** u.lvl)::bigint), '') as rights
    from leaves l join up u on u.s = l.s and u.n > 1 and u.pos // 16 = l.pos // (16 * 16 ** u.lvl)::bigint group by l.id, u.lvl
    union all
    select l.id, height + u.lvl, coalesce(string_agg(u.h, '' order by u.pos) filter (u.pos < r.pos // (16 ** u.lvl)::bigint), ''), coalesce(string_agg(u.h, '' order by u.pos) filter (u.pos > r.pos // (16 ** u.lvl)::bigint), '')
    from leaves l join heights using (s) join subroots r on r.s = l.s join upper_up u on u.n > 1 and u.pos // 16 = r.pos // (16 * 16 ** u.lvl)::bigint group by l.id, height, u.lvl),
proofs as (select id, sha256(string_agg(lefts || rights, '' order by step)) as proof, max(step) as steps from sides group by id),
fold as (
    select id, 0 as step, changed as h from leaves
    union all
    select f.id, f.step + 1, sha256(lefts || f.h || rights) from fold f join sides using (id, step)),
ends as (select id, arg_max(h, step) as h from fold group by id)
select doc_id, leaf, r.h as subroot, root.h as root, coalesce(proof, sha256('')) as proof_sha256, e.h as folded_root, e.h = root.h as verified
from leaves l join subroots r on r.s = l.s join ends e using (id) left join proofs using (id), root
"""
