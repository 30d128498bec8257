"""Documents packed into blocks: one row holds some megabytes of texts, so that a task asks others about each thing in its block once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .store import staged
from .tokens import flat, pack, slices, spread, squeezed, swept, unpack


def packed(docs: DataFrame, block_bytes: int, name: str) -> DataFrame:
    """A row for each block: an array of each column of ``docs`` but ``text``, the texts' numbers of bytes (null: -1), and the bytes of all, compressed.

    ``block`` is a number that no other block has; the table is written, so it stays the same.
    """
    others = [f for f in docs.schema.fields if f.name != "text"]
    schema = ", ".join(["block long", *(f"`{f.name}` array<{f.dataType.simpleString()}>" for f in others), "sizes binary, data binary, n_bytes long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for piece in slices(batches, limit=block_bytes):
            data, offsets = flat(piece.column("text"))
            edges = pa.array([0, piece.num_rows], pa.int32())
            lists = [pa.ListArray.from_arrays(edges, piece.column(f.name)) for f in others]
            columns = [pa.array([block]), *lists, pa.array([pack(np.where(pc.is_null(piece.column("text")).to_numpy(zero_copy_only=False), -1, np.diff(offsets)))], pa.binary()), pa.array([squeezed(data.tobytes())], pa.binary()), pa.array([len(data)])]
            yield pa.RecordBatch.from_arrays(columns, ["block", *(f.name for f in others), "sizes", "data", "n_bytes"])
            block += 1

    return staged(docs.mapInArrow(swept(run), schema), name)


class Block:
    """An opened block: row ``at`` of ``rows``."""

    def __init__(self, rows: pa.Table | pa.RecordBatch, at: int = 0):
        self.rows, self.at = rows, at
        self.number = rows.column("block")[at].as_py()
        sizes = unpack(rows.column("sizes")[at].as_py(), np.int64)
        self.null, self.offsets = sizes < 0, np.concatenate([[0], np.cumsum(np.maximum(sizes, 0))])
        self.raw = spread(rows.column("data")[at].as_py())
        self.bytes = np.frombuffer(self.raw, np.uint8)

    def column(self, name: str) -> pa.Array:
        return self.rows.column(name)[self.at].values

    def numbers(self, name: str) -> tuple[np.ndarray, np.ndarray]:
        """A column of whole numbers (null: 0), and which entries are not null."""
        values = self.column(name)
        return pc.fill_null(values.cast(pa.int64()), 0).to_numpy(zero_copy_only=False), pc.is_valid(values).to_numpy(zero_copy_only=False)

    def parts(self, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """First text, the one after the last, their bytes and offsets, of about ``limit`` bytes each; a longer text stands alone."""
        cut = self.offsets[1:] // limit
        edges = [0, *(np.flatnonzero(np.diff(cut)) + 1).tolist(), len(cut)]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                yield a, b, self.bytes[self.offsets[a] : self.offsets[b]], self.offsets[a : b + 1] - self.offsets[a]
