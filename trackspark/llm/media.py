"""Media columns: content-addressed payloads in tar shards.

Each text's UTF-8 bytes, padded with spaces to a positive multiple of 192, are stored as the samples of an 8-bit
grey PNG of 192 columns, so losslessly. Images stand in tar shards of about ``shard_bytes`` under the shared folder;
an image's name is its digest and a shard's name the digest of its members' names, so a task that runs again writes
the same shard. A shard is written under a name of its own and then moved, so no reader sees half a shard. Rows carry
digest, shard, offset and length. ``headers`` fills metadata columns by reading only the first bytes of each range;
``loaded`` reads whole payloads back.

Null text: empty, so 192 spaces. Rows are stored one by one; equal texts share an image within a shard, and reading
uses one address for a digest. Ties, repeated rows and other columns don't matter; an empty table gives an empty
result and no shard.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import shared_dir, staged
from .tokens import slices, swept


@dataclass(frozen=True)
class Shards:
    width: int = 192
    shard_bytes: int = 32 << 20
    level: int = 6


SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER_BYTES = 33


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def padded(text: bytes, width: int) -> bytes:
    return text + b" " * (-len(text) % width or (0 if text else width))


def image(payload: bytes, how: Shards) -> bytes:
    """A PNG of 8-bit grey samples, one per byte of ``payload``."""
    height = len(payload) // how.width
    rows = np.zeros((height, how.width + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, how.width)
    head = struct.pack(">IIBBBBB", how.width, height, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), how.level)) + _chunk(b"IEND", b"")


def samples(stored: bytes) -> bytes:
    """The samples of such a PNG."""
    width, height = struct.unpack(">II", stored[16:24])
    at, data = len(SIGNATURE), []
    while at < len(stored):
        (size,) = struct.unpack(">I", stored[at : at + 4])
        if stored[at + 4 : at + 8] == b"IDAT":
            data.append(stored[at + 8 : at + 8 + size])
        at += size + 12
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    return rows[:, 1:].tobytes()


def features(payload: bytes, width: int) -> str:
    """Size, mean and deviation of the samples, and an 8 x 8 average hash."""
    x = np.frombuffer(payload, np.uint8).reshape(-1, width)
    edges = np.linspace(0, len(x), 9).astype(int)
    cells = np.array([x[a : max(b, a + 1)].reshape(max(b, a + 1) - a, 8, -1).sum(axis=(0, 2)) / max(b - a, 1) if a < len(x) else np.zeros(8) for a, b in zip(edges, edges[1:])])
    bits = "".join("1" if v else "0" for v in (cells > cells.mean()).ravel())
    total, squares = int(x.sum(dtype=np.int64)), int((x.astype(np.int64) ** 2).sum())
    return f"{width}x{len(x)}:8:{total}:{squares}:{int(bits, 2):016x}"


INDEX = "digest string, shard string, offset long, length long"


def stored(docs: DataFrame, how: Shards = Shards(), key: str = "doc_id") -> DataFrame:
    """``key``, n_bytes, digest, shard, offset and length; writes the shards once."""
    folder = f"{shared_dir(docs.sparkSession)}/media-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members: dict[str, tuple[int, int]] = {}
        body: list[bytes] = []
        rows: list[tuple] = []
        size = 0

        def written() -> pa.RecordBatch:
            where, root = fs.FileSystem.from_uri(folder)
            name = hashlib.sha256("".join(members).encode()).hexdigest() + ".tar"
            where.create_dir(root, recursive=True)
            draft = f"{root}/.{uuid.uuid4().hex}"
            with where.open_output_stream(draft) as out:
                for x in body:
                    out.write(x)
                out.write(b"\0" * 1024)
            where.move(draft, f"{root}/{name}")
            keys, sizes, digests = zip(*rows)
            at, length = zip(*(members[x] for x in digests))
            return pa.RecordBatch.from_arrays([pa.array(keys, docs_key), pa.array(sizes, pa.int64()), pa.array(digests), pa.array([name] * len(rows)), pa.array(at, pa.int64()), pa.array(length, pa.int64())], [key, "n_bytes", "digest", "shard", "offset", "length"])

        docs_key = None
        for piece in slices(batches):
            docs_key = piece.schema.field(key).type
            for k, text in zip(piece.column(key).to_pylist(), piece.column("text").to_pylist()):
                text = (text or "").encode()
                data = image(padded(text, how.width), how)
                digest = hashlib.sha256(data).hexdigest()
                if digest not in members:
                    info = tarfile.TarInfo(f"{digest}.png")
                    info.size = len(data)
                    head = info.tobuf(tarfile.USTAR_FORMAT)
                    members[digest] = (size + len(head), len(data))
                    body += [head, data, b"\0" * (-len(data) % 512)]
                    size += len(head) + len(data) + (-len(data) % 512)
                rows.append((k, len(text), digest))
                if size >= how.shard_bytes:
                    yield written()
                    members, body, rows, size = {}, [], [], 0
        if rows:
            yield written()

    index = docs.select(key, "text").mapInArrow(swept(run), f"{key} {docs.schema[key].dataType.simpleString()}, n_bytes long, {INDEX}")
    return staged(index, "media-index").withColumn("shard", F.concat(F.lit(folder + "/"), "shard"))


def _addresses(index: DataFrame, task_bytes: int = 8 << 20) -> DataFrame:
    """One address for each digest, each shard's in order; a task gets about ``task_bytes`` of images, which the addresses' own size would not tell."""
    tasks = max(1, -(-(index.agg(F.sum("length")).first()[0] or 0) // task_bytes))
    one = index.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at")).select("digest", "at.*")
    return one.repartitionByRange(tasks, "shard", "offset").sortWithinPartitions("shard", "offset")


def _ranges(batch: pa.RecordBatch, most: int | None = None) -> Iterator[tuple[str, bytes]]:
    """Each row's digest and its stored bytes, or the first ``most`` of them."""
    name, source = None, None
    for digest, shard, offset, length in zip(*(batch.column(x).to_pylist() for x in ("digest", "shard", "offset", "length"))):
        if shard != name:
            where, path = fs.FileSystem.from_uri(shard)
            source, name = where.open_input_file(path), shard
        source.seek(offset)
        yield digest, source.read(length if most is None else min(most, length))


def header_fields(index: DataFrame) -> DataFrame:
    """width, height and bit depth of each digest, from the first bytes of its image."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(d, *struct.unpack(">IIB", x[16:25])) for d, x in _ranges(batch, HEADER_BYTES)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found) if found else [[]] * 4, (pa.string(), pa.int32(), pa.int32(), pa.int32()))], ["digest", "width", "height", "bit_depth"])

    return _addresses(index).mapInArrow(run, "digest string, width int, height int, bit_depth int")


def headers(index: DataFrame) -> DataFrame:
    """``index`` with width, height and bit depth."""
    return index.join(header_fields(index), "digest")


PAYLOAD = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def loaded(index: DataFrame, how: Shards = Shards()) -> DataFrame:
    """The figures of each digest's payload, read back from the shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, data in _ranges(batch):
                payload = samples(data)
                rows.append((digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), features(payload, how.width)))
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 7, kinds)], [x.split()[0] for x in PAYLOAD.split(", ")])

    return _addresses(index).mapInArrow(run, PAYLOAD)


def described(docs: DataFrame, how: Shards = Shards(), key: str = "doc_id") -> DataFrame:
    """``key``, n_bytes, the payload's figures and the header's columns for each row of ``docs``."""
    index = stored(docs, how, key)
    # One row for each digest first, so that the rows of a common text take part in one join only, which can be split.
    rows = index.join(header_fields(index).join(loaded(index, how), "digest"), "digest")
    return rows.select(key, "n_bytes", *(x.split()[0] for x in PAYLOAD.split(", ")[1:]), "width", "height", "digest")
