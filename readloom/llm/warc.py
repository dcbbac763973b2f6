"""WARC archives, each record its own Zstandard frame, under a dictionary built from the records.

The dictionary is trained on a bounded sample (SAMPLE records, SAMPLE_BYTES of each) and stands in a
leading skippable frame of every archive, so that each file can be read alone. Of records with equal
payloads of at least REVISIT bytes, the one with the largest page_id holds the payload; the others are
revisits that name it. Every task writes one archive under a name of its own attempt in the shared folder; the
stored manifest lists only the archives of attempts that succeeded, so lost executors leave at most
unlisted files.

Defined cases: a null html is an empty payload; a null url is left out; a record with a null page_id is a
response; repeated rows with the largest page_id are all responses; rows that share a page_id are judged each by
its own payload; a very long payload is a record like any other, one in memory at a time; an empty table gives no
record; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Steps, shared_dir, stored, table

REVISIT = 1000
SAMPLE, SAMPLE_BYTES, DICTIONARY = 512, 16_384, 65_536
BROADCAST_ROWS = 50_000
LEVEL, DATE = 3, "2026-01-01T00:00:00Z"
#: The frame type of the dictionary, and the profile of a revisit.
SKIPPABLE = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6f1c7c0e-6f2b-5a39-9a51-0d7f6e6f2c11")


def record_id(page_id: int | None = None, digest: bytes = b"") -> str:
    """Of a page with this payload; without a page_id, a new one."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id} {digest.hex()}') if page_id is not None else uuid.uuid4()}>"


def train(samples: list[bytes], size: int = DICTIONARY) -> bytes:
    """A trained dictionary; of samples too few to train on, their own bytes."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if len(data) >= 8 else None


class Writer:
    def __init__(self, out: BinaryIO, dictionary: bytes):
        self.out, found = out, _dictionary(dictionary)
        self.codec = zstandard.ZstdCompressor(level=LEVEL, dict_data=found) if found else zstandard.ZstdCompressor(level=LEVEL)
        out.write(struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary)
        self._put({"WARC-Type": "warcinfo", "WARC-Record-ID": record_id(), "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n")

    def _put(self, head: dict[str, str], body: bytes) -> None:
        fields = head | {"WARC-Date": DATE, "Content-Length": str(len(body))}
        lines = "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode()
        self.out.write(self.codec.compress(b"WARC/1.1\r\n" + lines + b"\r\n" + body + b"\r\n\r\n"))

    def write(self, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> None:
        digest = hashlib.sha1(payload).digest()
        head = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": record_id(page_id, digest)}
        if url is not None:
            head["WARC-Target-URI"] = " ".join(url.split())
        head |= {"WARC-Payload-Digest": f"sha1:{base64.b32encode(digest).decode()}", "Content-Type": "application/http; msgtype=response", "X-Payload-Bytes": str(len(payload))}
        if page_id is not None:
            head["X-Page-Id"] = str(page_id)
        http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        if refers_to is not None:
            head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(refers_to, digest), "X-Refers-To-Page-Id": str(refers_to)}
        self._put(head, http if refers_to is not None else http + payload)


def _frames(source: BinaryIO, codec: zstandard.ZstdDecompressor) -> Iterator[bytes]:
    rest = b""
    while True:
        frame, parts = codec.decompressobj(), []
        while not frame.eof:
            data, rest = rest or source.read(1 << 16), b""
            if not data:
                if parts:
                    raise EOFError("the last frame is cut off")
                return
            parts.append(frame.decompress(data))
        rest = frame.unused_data
        yield b"".join(parts)


def read_records(source: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header and block of each record of one archive; one record in memory at a time."""
    kind, size = struct.unpack("<II", source.read(8))
    if kind != SKIPPABLE:
        raise ValueError("no leading dictionary frame")
    found = _dictionary(source.read(size))
    codec = zstandard.ZstdDecompressor(dict_data=found) if found else zstandard.ZstdDecompressor()
    for frame in _frames(source, codec):
        stream = io.BytesIO(frame)
        if (version := stream.readline()) != b"WARC/1.1\r\n":
            raise ValueError(f"not a record: {version[:20]!r}")
        head = {}
        while (line := stream.readline()) != b"\r\n":
            if not line:
                raise EOFError("a record ends in its header")
            name, _, value = line.decode().partition(":")
            head[name] = value.strip()
        body = stream.read(int(head["Content-Length"]))
        if stream.read() != b"\r\n\r\n" or len(body) != int(head["Content-Length"]):
            raise EOFError("a record does not end with its frame")
        yield head, body


def payload(head: dict[str, str], body: bytes) -> bytes:
    """Of a response; checked against its digest."""
    data = body[body.index(b"\r\n\r\n") + 4 :]
    if base64.b32encode(hashlib.sha1(data).digest()).decode() != head["WARC-Payload-Digest"].removeprefix("sha1:"):
        raise ValueError(f"{head['WARC-Record-ID']}: the payload does not match its digest")
    return data


def _write_task(batches: Iterable[pa.RecordBatch], folder: str, dictionary: bytes) -> Iterator[pa.RecordBatch]:
    fs, root = pafs.FileSystem.from_uri(folder)
    context = TaskContext.get()
    name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.zst"
    out = writer = None
    records = 0
    for batch in batches:
        for row in range(batch.num_rows):
            if writer is None:
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(f"{root}/{name}", compression=None, buffer_size=1 << 20)
                writer = Writer(out, dictionary)
            page_id, url, data, refers = (batch.column(i)[row].as_py() for i in range(4))
            writer.write(page_id, url, data, refers)
            records += 1
    if out is not None:
        out.close()
        yield pa.RecordBatch.from_pydict({"file": [f"{folder}/{name}"], "records": [records]}, schema=pa.schema([("file", pa.string()), ("records", pa.int64())]))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes the archives under folder; returns the stored manifest (file, records)."""
    spark = pages.sparkSession
    raw = F.coalesce(F.encode("html", "UTF-8"), F.lit(b"").cast("binary"))
    pages = pages.select("page_id", "url", raw.alias("payload"))
    digest = F.when(F.length("payload") >= REVISIT, F.unhex(F.sha2("payload", 256)))
    with Steps(spark) as steps:
        keys = steps.kept(pages.select("page_id", digest.alias("digest")).where("digest is not null"), "payload-keys")
        firsts = keys.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
        firsts = steps.kept(firsts, "last-of-payload")  # before the join, so that it can split a very frequent payload
        again = keys.join(firsts, "digest").where("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct()
        again = steps.kept(again, "revisits")
        # Nothing but a counted, small list is broadcast; a longer one is joined by shuffle.
        small = again.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        joined = pages.withColumn("digest", digest).join(F.broadcast(again) if small else again, ["page_id", "digest"], "left")
        joined = joined.select("page_id", "url", "payload", "refers_to")
        dictionary = _trained(pages)
        manifest = joined.mapInArrow(lambda b: _write_task(b, folder, dictionary), "file string, records long")
        return stored(manifest, "manifest")


def _trained(pages: DataFrame) -> bytes:
    """The dictionary of a sample of the records, picked by a hash of the id."""
    ids = [r.page_id for r in pages.select("page_id").where("page_id is not null").orderBy(F.xxhash64("page_id")).limit(SAMPLE).collect()]
    picked = pages.where(F.col("page_id").isin(ids)).select("page_id", F.substring("payload", 1, SAMPLE_BYTES).alias("p")).limit(SAMPLE)
    return train([bytes(r.p) for r in sorted(picked.collect(), key=lambda r: (r.page_id, r.p))])


def _read_task(batches: Iterable[pa.RecordBatch], with_payload: bool) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    schema = pa.schema(list(zip(names, kinds, strict=True)) + [("payload", pa.binary())] * with_payload)
    whole = lambda x: None if x is None else int(x)
    for batch in batches:
        for file in batch.column(0).to_pylist():
            fs, path = pafs.FileSystem.from_uri(file)
            rows, held = [], 0
            with fs.open_input_stream(path, compression=None) as source:
                for head, body in read_records(source):
                    if head["WARC-Type"] == "warcinfo":
                        continue
                    data = payload(head, body) if head["WARC-Type"] == "response" else None
                    digest = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    size = len(data) if data is not None else int(head["X-Payload-Bytes"])
                    rows.append((whole(head.get("X-Page-Id")), head.get("WARC-Target-URI"), size, digest, head["WARC-Type"], whole(head.get("X-Refers-To-Page-Id")), *[data] * with_payload))
                    held += len(data or b"") * with_payload + 100
                    if held > 8_000_000:
                        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)
                        rows, held = [], 0
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)


def read_archives(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records of the archives that a manifest lists; a task reads whole archives."""
    spark = manifest.sparkSession
    tasks = min(max(1, manifest.count()), 10_000)
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    if tasks > 1:
        # files are dealt evenly: neighbours in the order of their names go to different tasks
        manifest = manifest.select("file").repartition(tasks)
    return manifest.select("file").mapInArrow(lambda b: _read_task(b, with_payload), schema)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_archives(table(spark, sf_dir, "pages"), shared_dir(spark, "warc"))
    return read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
