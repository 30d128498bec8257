"""WARC archives in Zstandard: a frame for each record, behind a dictionary in a skippable frame.

``written`` makes one record of each row. Of rows whose payloads are equal and have at least ``least`` bytes, that with
the largest id is a response and the others are revisits, which name it and hold no payload; all smaller ones are
responses. An archive of about ``archive_bytes`` of payload starts with a skippable frame that holds a dictionary,
trained on ``sample_bytes`` of the archive's own payloads spread over all of them; records are lossless with any
dictionary or none. An archive is written under another name and then moved, and the table of archives names only
those of tasks that ended, so a task that runs again leaves no record twice.

``read`` takes any such archives: it loads the dictionary (plain or itself compressed) if the first frame has one,
decodes a frame for each record, in pieces, and holds its checksum, version line, header fields and length, the block's
and the payload's digest, and the HTTP message inside against what is there; it raises ``ValueError`` where they
disagree. Memory: one archive's payloads in a writing task, one record and one piece of an archive in a reading one.

Null payload: empty. Null URL: the record has no target. Rows without id are responses without id. Rows that repeat
the largest id of equal payloads are responses too. Other columns don't matter; an empty table gives an empty result.
Ids may be of any whole-number type.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import shared_dir, staged
from .tokens import slices, swept


@dataclass(frozen=True)
class Archives:
    least: int = 1000
    archive_bytes: int = 16 << 20
    dictionary_bytes: int = 64 << 10
    sample_bytes: int = 4 << 20
    level: int = 3
    broadcast_keys: int = 50_000
    date: str = "2024-01-01T00:00:00Z"


#: Fixed values of the formats: the magic numbers of the skippable frame, a Zstandard frame and a dictionary.
SKIPPABLE, FRAME, DICTIONARY = 0x184D2A5D, 0xFD2FB528, 0xEC30A437
PIECE = 64 << 10
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n"


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _urn(key: int) -> str:
    return f"<urn:page:{key}>"


def record(key: int | None, url: str | None, payload: bytes, keeper: int | None, how: Archives) -> bytes:
    """One WARC record: a response, or a revisit of the page ``keeper``."""
    head = HTTP % len(payload)
    block = head if keeper is not None else head + payload
    fields = [("WARC-Type", "response" if keeper is None else "revisit"), ("WARC-Record-ID", _urn(key) if key is not None else f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", how.date)]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~|{}^`\"\\<>")))
    if keeper is not None:
        fields += [("WARC-Profile", REVISIT), ("WARC-Refers-To", _urn(keeper))]
    fields += [("WARC-Payload-Digest", _digest(payload)), ("WARC-Block-Digest", _digest(block)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def trained(records: list[bytes], how: Archives) -> bytes:
    """A dictionary from records spread over all of them; none where they are too few or too small."""
    step = max(1, -(-sum(map(len, records)) // how.sample_bytes))
    sample = [r[: how.sample_bytes] for r in records[::step]]
    if len(sample) < 16 or sum(map(len, sample)) < 8 * how.dictionary_bytes:
        return b""
    try:
        return zstandard.train_dictionary(how.dictionary_bytes, sample, level=how.level).as_bytes()
    except zstandard.ZstdError:
        return b""


def archive(records: list[bytes], how: Archives) -> bytes:
    dictionary = trained(records, how)
    data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    packer = zstandard.ZstdCompressor(level=how.level, dict_data=data, write_checksum=True, write_content_size=True)
    first = zstandard.ZstdCompressor(level=how.level).compress(dictionary)
    lead = struct.pack("<II", SKIPPABLE, len(first)) + first if dictionary else b""
    return lead + b"".join(map(packer.compress, records))


def frames(source) -> Iterator[bytes]:
    """The decoded frames of an archive that is open for reading."""
    data = source.read(8)
    dictionary = None
    if len(data) == 8 and struct.unpack("<I", data[:4])[0] == SKIPPABLE:
        raw = source.read(struct.unpack("<I", data[4:])[0])
        if len(raw) >= 4 and struct.unpack("<I", raw[:4])[0] == FRAME:
            raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
        if len(raw) < 4 or struct.unpack("<I", raw[:4])[0] != DICTIONARY:
            raise ValueError("the leading frame holds no dictionary")
        dictionary, data = zstandard.ZstdCompressionDict(raw), b""
    opener = zstandard.ZstdDecompressor(dict_data=dictionary)
    while data or (data := source.read(PIECE)):
        one, out = opener.decompressobj(), []
        while True:
            try:
                out.append(one.decompress(data))
            except zstandard.ZstdError as e:
                raise ValueError(f"a frame can't be decoded: {e}") from e
            if one.eof:
                break
            if not (data := source.read(PIECE)):
                raise ValueError("the last frame is cut off")
        data = one.unused_data
        yield b"".join(out)


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of a record, as long and as digested as the header says."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not gap or version not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError(f"no WARC record: {version[:40]!r}")
    fields = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or name.lower() in fields:
            raise ValueError(f"header field {line[:80]!r}")
        fields[name.lower()] = value.strip()
    if missing := {"warc-type", "warc-record-id", "warc-date", "content-length"} - set(fields):
        raise ValueError(f"a record without {', '.join(sorted(missing))}")
    block = rest[:-4]
    if rest[-4:] != b"\r\n\r\n" or str(len(block)) != fields["content-length"]:
        raise ValueError(f"a block of {len(block)} bytes; its header says {fields['content-length']}")
    if fields.get("warc-block-digest", _digest(block)) != _digest(block):
        raise ValueError("the block has another digest")
    return fields, block


def _key(urn: str | None) -> int | None:
    return int(urn[10:-1]) if urn and urn.startswith("<urn:page:") else None


def page(data: bytes) -> tuple[int | None, int, str, str, int | None, str | None, bytes | None]:
    """page_id, payload's bytes and SHA-1, type, the page that a revisit refers to, URL and payload (null in a revisit)."""
    fields, block = parsed(data)
    head, gap, payload = block.partition(b"\r\n\r\n")
    status, *lines = head.split(b"\r\n")
    sizes = [x.partition(b":")[2].strip() for x in lines if x.lower().startswith(b"content-length:")]
    if not gap or not status.startswith(b"HTTP/") or len(sizes) != 1 or not sizes[0].isdigit():
        raise ValueError(f"no HTTP response: {status[:40]!r}")
    label, _, code = fields.get("warc-payload-digest", "").partition(":")
    if label != "sha1":
        raise ValueError("no SHA-1 of the payload")
    kind, digest = fields["warc-type"], base64.b32decode(code).hex()
    if kind == "response" and (len(payload) != int(sizes[0]) or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("the payload has another length or digest")
    if kind == "revisit" and (payload or "warc-refers-to" not in fields):
        raise ValueError("a revisit with a payload or without the record that it refers to")
    return _key(fields["warc-record-id"]), int(sizes[0]), digest, kind, _key(fields.get("warc-refers-to")), fields.get("warc-target-uri"), payload if kind == "response" else None


def keepers(rows: DataFrame, least: int) -> DataFrame:
    """The digests that several rows have, and the largest id of each; summed up where the rows are first."""
    found = rows.where((F.octet_length("payload") >= least) & F.col("page_id").isNotNull()).groupBy(F.sha1("payload").alias("digest"))
    return found.agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1").select("digest", "keeper")


def written(pages: DataFrame, how: Archives = Archives()) -> DataFrame:
    """Writes archives of the rows (page_id, url, payload) and gives one row for each: archive, n_bytes, n_records."""
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    rows = pages.select("page_id", "url", F.coalesce(F.col("payload").cast("binary"), F.lit(b"")).alias("payload"))
    large = (F.octet_length("payload") >= how.least) & F.col("page_id").isNotNull()
    # Small payloads meet nothing, each under a code of its own.
    keys = rows.withColumn("code", F.when(large, F.sha1("payload")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url", "payload").cast("string"))))
    # Written first, so that the join stands on plain exchanges and Spark can split the rows of a common payload.
    twice = staged(keepers(rows, how.least), "warc-keepers")
    if twice.limit(how.broadcast_keys + 1).count() <= how.broadcast_keys:
        twice = F.broadcast(twice)
    typed = keys.join(twice, keys["code"] == twice["digest"], "left").select("page_id", "url", "payload", F.when(F.col("keeper") != F.col("page_id"), F.col("keeper")).alias("keeper"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records: list[bytes] = []
        size = 0

        def stored() -> pa.RecordBatch:
            data = archive(records, how)
            where, root = fs.FileSystem.from_uri(folder)
            name = f"{uuid.uuid4().hex}.warc.zst"
            where.create_dir(root, recursive=True)
            with where.open_output_stream(f"{root}/{name}") as out:
                out.write(data)
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(data)], pa.int64()), pa.array([len(records)], pa.int64())], ["archive", "n_bytes", "n_records"])

        for piece in slices(batches, "payload"):
            for row in zip(*(piece.column(c).to_pylist() for c in ("page_id", "url", "payload", "keeper"))):
                records.append(record(*row, how))
                size += len(row[2])
                if size >= how.archive_bytes:
                    yield stored()
                    records, size = [], 0
        if records:
            yield stored()

    return staged(typed.mapInArrow(swept(run), "archive string, n_bytes long, n_records long"), "warc-archives")


RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
KINDS = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())


def read(archives: DataFrame, payloads: bool = False, task_bytes: int = 8 << 20) -> DataFrame:
    """The records of the archives named by ``archive`` (with ``n_bytes``); with ``payloads`` their URLs and payloads too."""
    names = [x.split()[0] for x in RECORD.split(", ")] + ["url", "payload"] * payloads
    schema = RECORD + ", url string, payload binary" * payloads
    count = len(names)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)), KINDS)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for each in batches:
            for name, expected in zip(each.column("archive").to_pylist(), each.column("n_records").to_pylist()):
                where, path = fs.FileSystem.from_uri(name)
                rows, held, total = [], 0, 0
                with where.open_input_stream(path) as source:
                    for data in frames(source):
                        rows.append(page(data)[:count])
                        held, total = held + (len(data) if payloads else 200), total + 1
                        if held >= 1 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)
                if total != expected:
                    raise ValueError(f"{name} has {total} records; {expected} were written")

    tasks = max(1, -(-(archives.agg(F.sum("n_bytes")).first()[0] or 0) // task_bytes))
    return archives.repartition(tasks).mapInArrow(run, schema)


def described(pages: DataFrame, how: Archives = Archives()) -> DataFrame:
    """Writes the pages (page_id, url, html) as archives and gives what is read back of each record."""
    return read(written(pages.select("page_id", "url", F.col("html").alias("payload")), how))


#: The same rows in DuckDB's SQL.
SQL = """
with p as (select page_id, coalesce(strlen(html), 0) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
k as (select *, case when payload_bytes >= 1000 and page_id is not null then max(page_id) over (partition by payload_digest) end as keeper from p)
select page_id, payload_bytes, payload_digest, case when keeper <> page_id then 'revisit' else 'response' end as record_type, case when keeper <> page_id then keeper end as refers_to from k
"""
