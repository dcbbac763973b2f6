"""Read files (four lines a record, or two), dictionaries, and the codecs they come in."""

from __future__ import annotations

import bz2
import gzip
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordinal import with_ordinal

#: The first bytes of compressed files.
MAGIC = {"gzip": b"\x1f\x8b", "bzip2": b"BZ"}


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("/") else (pafs.LocalFileSystem(), path)


def codec(path: str) -> str:
    """gzip, bzip2 or plain, by the first two bytes."""
    fs, name = _opened(path)
    if fs.get_file_info(name).type != pafs.FileType.File:
        return "plain"  # a folder: its files go by their suffixes
    with fs.open_input_file(name) as f:
        head = f.read(2)
    return next((kind for kind, magic in MAGIC.items() if head == magic), "plain")


def codec_column(head):
    """The same of a binary column with a file's first bytes."""
    out = F.lit("plain")
    for kind, magic in MAGIC.items():
        out = F.when(F.hex(F.substring(head, 1, 2)) == magic.hex().upper(), kind).otherwise(out)
    return out


def _unsuffixed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column(0).to_pylist():
            fs, name = _opened(path)
            unpacked = {"gzip": gzip.open, "bzip2": bz2.open}[codec(path)]
            with fs.open_input_file(name) as raw, unpacked(raw, "rt", encoding="utf-8", newline="\n") as lines:
                part: list[str] = []
                at = 0
                for line in lines:
                    part.append(line.rstrip("\n"))
                    if len(part) == 10_000:
                        yield pa.RecordBatch.from_pydict({"value": part, "file": [path] * len(part), "block": [0] * len(part), "m": list(range(at, at + len(part)))})
                        at, part = at + len(part), []
                yield pa.RecordBatch.from_pydict({"value": pa.array(part, pa.string()), "file": pa.array([path] * len(part), pa.string()), "block": pa.array([0] * len(part), pa.int64()), "m": pa.array(range(at, at + len(part)), pa.int64())})


def lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, line_no, value): every line with its number from 0. A plain file is read in blocks by many tasks; the
    lines of each block are counted (a number a block goes to the driver) and a block's start added."""
    hidden = [p for p in paths if not p.endswith((".gz", ".bz2")) and codec(p) != "plain"]
    plain = [p for p in paths if p not in hidden]
    columns = ["value", "file", "block", "m"]
    parts = []
    if plain:
        parts.append(spark.read.text(plain).select("value", F.input_file_name().alias("file"), F.input_file_block_start().alias("block"), F.monotonically_increasing_id().alias("m")))
    if hidden:
        files = spark.createDataFrame([(p,) for p in hidden], "path string").repartition(len(hidden))
        parts.append(files.mapInArrow(_unsuffixed, "value string, file string, block long, m long"))
    out, starts = None, []
    for part in parts:
        counted = part.groupBy("file", "block").agg(F.min("m").alias("first"), F.count("*").alias("n")).collect()
        before: dict[str, int] = {}
        for r in sorted(counted, key=lambda r: (r.file, r.block)):
            starts.append((r.file, r.block, before.get(r.file, 0) - r["first"]))
            before[r.file] = before.get(r.file, 0) + r.n
        out = part.select(*columns) if out is None else out.union(part.select(*columns))
    known = spark.createDataFrame(starts, "file string, block long, shift long")
    return out.join(F.broadcast(known), ["file", "block"]).select("file", (F.col("m") + F.col("shift")).alias("line_no"), "value")


def read_records(spark: SparkSession, paths: list[str], per_record: int = 4) -> DataFrame:
    """(file, ordinal, name, seq, qual): 4 lines a record (name, bases, +, qualities) or 2 (name, bases, without
    qualities). The third line is not kept; an incomplete record at the end is left out."""
    rows = lines(spark, paths).withColumn("ordinal", F.expr(f"line_no div {per_record}")).withColumn("k", F.expr(f"line_no % {per_record}"))
    pick = lambda k: F.max(F.when(F.col("k") == k, F.col("value")))
    qual = pick(3) if per_record == 4 else F.lit(None).cast("string")
    out = rows.groupBy("file", "ordinal").agg(pick(0).alias("name"), pick(1).alias("seq"), qual.alias("qual"), F.count("*").alias("_n"))
    return out.where(F.col("_n") == per_record).drop("_n")


def read_pairs(spark: SparkSession, first: list[str], second: list[str]) -> DataFrame:
    """Mates by their place in files that belong together: (file, ordinal, name, seq, qual, seq2, qual2)."""
    order = lambda paths: F.create_map(*[F.lit(x) for i, p in enumerate(paths) for x in (p.rpartition("/")[2], i)])
    base = F.element_at(F.split("file", "/"), -1)
    one = read_records(spark, first).withColumn("_k", order(first)[base])
    two = read_records(spark, second).withColumn("_k", order(second)[base])
    two = two.select("_k", "ordinal", F.col("seq").alias("seq2"), F.col("qual").alias("qual2"))
    return one.join(two, ["_k", "ordinal"]).drop("_k")


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    """(core_id, core): the words of a text file in their order, from 0."""
    words = lines(spark, [path]).select("line_no", F.posexplode(F.filter(F.split("value", r"\s+"), lambda w: w != "")).alias("at", "core"))
    return with_ordinal(words, "line_no", "at", name="core_id").select(F.col("core_id").cast("int").alias("core_id"), "core")


def parse_packed_patterns(data: bytes) -> list[str]:
    """Groups of: length (2 bytes), count (4 bytes), and each entry as a number of two bits a base, the first base
    highest; all numbers little-endian."""
    out, at = [], 0
    while at < len(data):
        length, count = int.from_bytes(data[at : at + 2], "little"), int.from_bytes(data[at + 2 : at + 6], "little")
        at, width = at + 6, (length + 3) // 4
        if not 0 < length <= 32 or at + count * width > len(data):
            raise ValueError("not a packed dictionary")
        for _ in range(count):
            value = int.from_bytes(data[at : at + width], "little")
            out.append("".join("ACGT"[value >> 2 * (length - 1 - i) & 3] for i in range(length)))
            at += width
    return out


def packed_patterns(cores: list[str]) -> bytes:
    out, at = bytearray(), 0
    while at < len(cores):
        end = at
        while end < len(cores) and len(cores[end]) == len(cores[at]):
            end += 1
        length = len(cores[at])
        out += length.to_bytes(2, "little") + (end - at).to_bytes(4, "little")
        for core in cores[at:end]:
            out += int(core.translate(str.maketrans("ACGT", "0123")), 4).to_bytes((length + 3) // 4, "little")
        at = end
    return bytes(out)


def write_packed_patterns(cores: list[str], path: str) -> None:
    fs, name = _opened(path)
    fs.create_dir(name.rpartition("/")[0] or ".")
    with fs.open_output_stream(name) as f:
        f.write(packed_patterns(cores))


def read_packed_patterns(spark: SparkSession, path: str) -> DataFrame:
    fs, name = _opened(path)
    with fs.open_input_file(name) as f:
        cores = parse_packed_patterns(f.read())
    return spark.createDataFrame(list(enumerate(cores)), "core_id int, core string")


def record_text(name, seq, qual=None):
    """One record as text: four lines, or two without qualities."""
    parts = [name, seq] if qual is None else [name, seq, F.lit("+"), qual]
    return F.concat_ws("\n", *parts)


def write_records(reads: DataFrame, path: str, order: str, qualities: bool = True, codec: str = "none") -> None:
    """Text files in the order of a column, name after name."""
    n = max(1, int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sorted_ = reads.repartitionByRange(n, order).sortWithinPartitions(order)
    sorted_.select(record_text(F.col("name"), F.col("seq"), F.col("qual") if qualities else None).alias("value")).write.option("compression", codec).text(path)


def write_parts(placed: DataFrame, path: str, qualities: bool = True, codec: str = "none") -> None:
    """A folder part=k for each part of operators.cluster.parts."""
    sorted_ = placed.repartition("part").sortWithinPartitions("part", "at")
    sorted_.select("part", record_text(F.col("name"), F.col("seq"), F.col("qual") if qualities else None).alias("value")).write.partitionBy("part").option("compression", codec).text(path)
