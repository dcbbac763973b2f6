"""The archive: Parquet tables of encoded reads in bin order, of the cores, and of the options; with arithmetic coding
also of the qualities in coded blocks and of the model, a pair of tables for each mate.

Reading an archive gives the reads back in bin order. Lost by design: what follows the first blank of a name, letter
case, other letters than the four bases and N (they become A), the quality of an N; a base of quality 0 becomes N.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bases, names, quality, walks
from ..operators import cluster, codec, context, cores, lossy
from ..storage import Steps

#: Names of codecs and what Parquet calls them; it has no bzip2.
CODECS = {"none": "none", "gzip": "gzip", "parallel-gzip": "gzip", "zstd": "zstd"}
READS_A_BLOCK = 4096


def _slow_quality(seq, qual, mapping: Mapping[int, int], offset: int):
    values = quality.remapped(quality.symbols(qual), lossy.as_map(mapping))
    return quality.text(quality.masked(seq, quality.rebased(values, F.lit(offset))), F.lit(offset))


def _quality(seq, qual, mapping: Mapping[int, int], offset: int):
    """The quality string with the lossy map applied and N as the offset's symbol."""
    new = np.array([mapping.get(x, x) for x in range(256)], dtype=np.uint8)
    return walks.both(lambda b, q: np.where(b == ord("N"), np.uint8(offset), new[q]), seq, qual, _slow_quality(seq, qual, mapping, offset))


def _walked(lookups: list[np.ndarray], offsets: list[int]):
    """What is stored of a batch of plain reads and their cores, and what they are ordered by (cluster.RANK). Of others it is not to be used."""
    bits = 2 * cluster.RANKED

    def qualities(data: np.ndarray, at: np.ndarray, qual: pa.Array, mate: int) -> pa.Array:
        quals, q = walks.raw(qual)
        text = np.where(data[walks.spans(at[:-1], np.diff(q))] == ord("N"), np.uint8(offsets[mate]), lookups[mate][quals])
        return walks.texts(text, q, pa.string(), qual.is_null().to_numpy(zero_copy_only=False))

    def run(data: np.ndarray, at: np.ndarray, found: cores.Found, *others: pa.Array) -> list[pa.Array]:
        n, codes = np.diff(at), walks.CODE[data]
        after, before = n - found.end, found.end - found.size
        starts, sizes = (np.stack(x, axis=1).reshape(-1) for x in ((at[:-1] + found.end, at[:-1]), (after, before)))
        payload = walks.texts(*walks.pack(codes[walks.spans(starts, sizes)], after + before), pa.binary())
        # The key is what follows the core, filled with A, which is 0, to the length of the payload.
        key, filled = np.zeros(int((after + before).sum()), dtype=np.uint8), walks.ends(after + before)
        key[walks.spans(filled[:-1], after)] = codes[walks.spans(at[:-1] + found.end, after)]
        packed, held = walks.pack(key, after + before)
        rank, four = found.bins << bits, np.append(packed, np.uint8(0))
        for k in range(cluster.RANKED // 4):
            there = held[:-1] + k < held[1:]
            rank |= np.where(there, four[np.where(there, held[:-1] + k, 0)], 0).astype(np.int64) << bits - 8 * (k + 1)
        out = [payload, pa.array(rank), walks.texts(packed, held, pa.binary()), pa.array((after + before).astype(np.int32)), pa.array(found.bins)]
        out.append(qualities(data, at, others[0], 0))
        if len(others) > 1:
            data2, at2 = walks.raw(others[1])
            out += [walks.texts(*walks.pack(walks.CODE[data2], np.diff(at2)), pa.binary()), qualities(data2, at2, others[2], 1)]
        return out

    return run


def encode(
    reads: DataFrame, dictionary: DataFrame, mapping: Mapping[int, int], offset: int, by_frequency: bool = False,
    mapping2: Mapping[int, int] | None = None, offset2: int | None = None,
) -> DataFrame:
    """(place, read_id, core_id, core_end, name, payload, qual, read_length) and payload2, qual2 of pairs.
    mapping2 and offset2 are those of the second mates, by default the same."""
    mapping2, offset2 = mapping if mapping2 is None else mapping2, offset if offset2 is None else offset2
    core, end, seq, second = F.coalesce("core", F.lit("")), F.col("core_end"), F.col("seq"), "seq2" in reads.columns
    qual = F.col("qual") if "qual" in reads.columns else F.lit(None).cast("string")
    out = {
        "read_id": F.col("read_id"), "core_id": F.col("core_id"), "core_end": end, "name": names.truncated(F.col("name")),
        "payload": bases.packed(bases.payload(bases.normalized(seq), core, end)), "read_length": F.length("seq"),
        "qual": _quality(seq, qual, mapping, offset) if "qual" in reads.columns else qual,
    }
    if second:
        out |= {"payload2": bases.packed(F.col("seq2")), "read_length2": F.length("seq2"), "qual2": _quality(F.col("seq2"), F.col("qual2"), mapping2, offset2)}
    # One walk over a batch searches reads and makes all that is stored of plain ones; others take the forms above.
    columns, kinds = [F.when(walks.alike(seq, qual), qual)], {"_payload": "binary", "_rank": "long", "_key": "binary", "_width": "int", "_bin": "long", "_qual": "string"}
    if second:
        columns += [F.when(walks.plain(F.col("seq2")), F.col("seq2")), F.when(walks.alike(F.col("seq2"), F.col("qual2")), F.col("qual2"))]
        kinds |= {"_payload2": "binary", "_qual2": "string"}
    lookups = [np.array([m.get(x, x) for x in range(256)], dtype=np.uint8) for m in (mapping, mapping2)]
    by = "ordinal" if "ordinal" in reads.columns else "read_id"  # mates are joined by it, so a condition on it comes before the join
    found = cores.search_and(reads, dictionary, by_frequency, _walked(lookups, [offset, offset2]), kinds, columns)
    # Reads are placed encoded, since that is less to sort.
    if found is None:
        return cluster.clustered(cores.search(reads, dictionary, by_frequency).withColumns(out), columns=list(out), by=by).select("place", *out)
    key = bases.normalized(F.when(end > 0, F.substr(seq, end + 1)).otherwise(seq))
    width = (F.length("seq") - F.when(end > 0, F.length(core)).otherwise(0)).cast("int")
    key = F.rpad(key, width, F.lit("A"))
    first = F.conv(F.translate(F.rpad(F.substring(key, 1, cluster.RANKED), cluster.RANKED, F.lit("A")), bases.BASES, "0123"), 4, 10).cast("long")
    slow = {
        "payload": F.unhex(bases.packed_hex(bases.payload(bases.normalized(seq), core, end))), "qual": _slow_quality(seq, qual, mapping, offset),
        "_rank": F.shiftleft("_bin", 2 * cluster.RANKED) + F.coalesce(first, F.lit(0)), "_key": F.unhex(bases.packed_hex(key)), "_width": width,
    }
    if second:
        slow |= {"payload2": F.unhex(bases.packed_hex(F.col("seq2"))), "qual2": _slow_quality(F.col("seq2"), F.col("qual2"), mapping2, offset2)}
    for c, x in slow.items():
        other = "2" if c.endswith("2") else ""
        ok = walks.alike(F.col(f"seq{other}"), F.col("qual2") if other else qual) if c.startswith("qual") else walks.plain(F.col(f"seq{other}"))
        slow[c] = F.when(ok, F.col(c if c.startswith("_") else f"_{c}")).otherwise(x)
    return cluster.clustered_by_rank(found.withColumns(out | slow), list(out), by=by).select("place", *out)


def decode(encoded: DataFrame, dictionary: DataFrame, offset: int, library: str | None = None, offset2: int | None = None) -> DataFrame:
    """Reads of encoded rows, with the dictionary that they were encoded by. offset2: of the second mates, by default the same."""
    known = dictionary.select("core_id", "core")
    known = F.broadcast(known) if known.limit(cores.BROADCAST_CORES + 1).count() <= cores.BROADCAST_CORES else known
    rows = encoded.join(known, "core_id", "left")

    def restored(payload, length, core, end, qual, base):
        seq = walks.restored(payload, length, core, end, qual, chr(base))
        slow = quality.with_unknown(seq, quality.rebased(quality.symbols(qual), F.lit(base)))
        return F.when(qual.isNull() | walks.alike(seq, qual), seq).otherwise(slow)

    name = names.synthesized(library, F.col("place")) if library else F.concat(F.lit("@"), F.col("name"))
    seq = restored(F.col("payload"), F.col("read_length"), F.col("core"), F.col("core_end"), F.col("qual"), offset)
    out = [F.col("place"), F.col("read_id"), name.alias("name"), seq.alias("seq"), "qual"]
    if "payload2" in encoded.columns:
        seq2 = restored(F.col("payload2"), F.col("read_length2"), F.lit(None).cast("string"), F.lit(0), F.col("qual2"), offset if offset2 is None else offset2)
        out += [seq2.alias("seq2"), "qual2"]
    return rows.select(*out)


def _coded(rows: DataFrame, column: str, offset: int, path: str, compression: str) -> None:
    """Writes the symbols of a column of qualities as coded blocks of at most READS_A_BLOCK reads in their order, and the model.
    rows: stored in the order of their places. lengths: of the reads of a block, -1 for a null."""
    spark = rows.sparkSession
    last = offset + context.DEPTH - 1
    with Steps(spark) as steps:
        blocks = steps.kept(codec.runs(rows, column, "place", READS_A_BLOCK), "blocks")
        if not blocks.where((F.col("low") < offset) | (F.col("high") > last)).isEmpty():
            raise ValueError(f"a quality below the offset or of {context.DEPTH} or more can't be coded: write without arithmetic coding")
        codec.counts(blocks, offset).write.option("compression", compression).parquet(f"{path}/model")
        model = codec.model_of(spark.read.parquet(f"{path}/model"))
        codec.encoded(blocks, model, offset, ["first", "lengths"]).write.option("compression", compression).parquet(f"{path}/blocks")


def _decoded(spark: SparkSession, path: str, offset: int, name: str) -> DataFrame:
    """(place, name): the qualities of coded blocks."""
    stored = spark.read.parquet(f"{path}/blocks")
    rows = codec.decoded(stored, codec.model_of(spark.read.parquet(f"{path}/model")), ["first", "lengths"]).select("first", "lengths", "symbols")

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, lengths, data in zip(*batch.columns, strict=True):
                first, lengths = first.as_py(), lengths.values.to_numpy()
                symbols = np.frombuffer(data.as_buffer(), dtype=np.uint8) + np.uint8(offset)
                ends = walks.ends(np.maximum(lengths, 0))
                if symbols.max(initial=0) < 128:
                    cut = walks.texts(symbols, ends, pa.string(), lengths < 0)
                else:
                    text = symbols.tobytes().decode("latin-1")
                    cut = pa.array([None if n < 0 else text[e : e + n] for n, e in zip(lengths.tolist(), ends.tolist(), strict=False)], pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(cut)), pa.int64()), cut], names=["place", name])

    return rows.mapInArrow(split, f"place long, {name} string")


def write(
    reads: DataFrame, dictionary: DataFrame, path: str, percent: int = 0, sample: int = 100_000, compression: str = "zstd", library: str | None = None, arithmetic: bool = False,
) -> None:
    """Encodes reads and writes the archive: reads/, cores/ and options/ under path. arithmetic: qualities are entropy-coded
    in tables of their own (arithmetic/qual and arithmetic/qual2), else they are strings that the codec compresses."""
    if compression not in CODECS:
        raise ValueError(f"{compression}: an archive is compressed by one of {', '.join(sorted(CODECS))}")
    spark = reads.sparkSession
    mapping, offset = lossy.fitted(reads, percent, sample)
    mapping2, offset2 = mapping, offset
    if "qual2" in reads.columns:
        mapping2, offset2 = lossy.fitted(reads.select("read_id", F.col("qual2").alias("qual")), percent, sample)
    rows = encode(reads, dictionary, mapping, offset, mapping2=mapping2, offset2=offset2)
    if library:
        rows = rows.drop("name").withColumn("name", F.lit(None).cast("string"))
    # The ranges of places are written as they were sorted and stored.
    qualities = [(c, o) for c, o in (("qual", offset), ("qual2", offset2)) if arithmetic and c in rows.columns]
    rows.drop(*[c for c, _ in qualities]).write.option("compression", CODECS[compression]).parquet(f"{path}/reads")
    for column, base in qualities:
        _coded(rows, column, base, f"{path}/arithmetic/{column}", CODECS[compression])
    dictionary.write.parquet(f"{path}/cores")
    tables = [{int(a): int(b) for a, b in m.items()} for m in (mapping, mapping2)]
    schema = "phred_offset int, percent int, library string, mapping map<int,int>, phred_offset2 int, mapping2 map<int,int>, arithmetic array<string>"
    spark.createDataFrame([(offset, percent, library, tables[0], offset2, tables[1], [c for c, _ in qualities])], schema).coalesce(1).write.parquet(f"{path}/options")


def read(spark: SparkSession, path: str) -> DataFrame:
    options = spark.read.parquet(f"{path}/options").first().asDict()
    rows, offset2 = spark.read.parquet(f"{path}/reads"), options.get("phred_offset2")
    for column in options.get("arithmetic") or []:
        base = offset2 if column == "qual2" else options["phred_offset"]
        rows = rows.join(_decoded(spark, f"{path}/arithmetic/{column}", base, column), "place")
    return decode(rows, spark.read.parquet(f"{path}/cores"), options["phred_offset"], options["library"], offset2)


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Of a file, or of all files in a folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength()


def run_report(spark: SparkSession, path: str, inputs: list[str]) -> dict[str, float]:
    """What an archive holds and what it saves: reads, those in bins in percent, bits a base and a quality symbol as
    stored in memory, bytes of the input files and of the archive, and their factor."""
    rows = spark.read.parquet(f"{path}/reads")
    coded = spark.read.parquet(f"{path}/options").first().asDict().get("arithmetic") or []
    mates = [m for m in ("", "2") if f"payload{m}" in rows.columns]
    total = lambda column: F.coalesce(F.sum(column), F.lit(0))
    found = rows.agg(
        F.count("*").alias("reads"), F.count("core_id").alias("binned"),
        *[total(F.octet_length(f"payload{m}")).alias(f"packed{m}") for m in mates], *[total(f"read_length{m}").alias(f"bases{m}") for m in mates],
        *[total(F.octet_length(f"qual{m}")).alias(f"quality{m}") for m in mates if f"qual{m}" in rows.columns],
    ).first().asDict()
    for column in coded:
        blocks = spark.read.parquet(f"{path}/arithmetic/{column}/blocks").agg(total(F.octet_length("coded")).alias("n")).first()
        found[column.replace("qual", "quality")] = blocks.n
    out: dict[str, float] = {"reads": found["reads"], "bucketed_percent": round(100 * found["binned"] / max(1, found["reads"]), 2)}
    for m in mates:
        n = max(1, found[f"bases{m}"])
        out[f"bits_per_base{m}"], out[f"bits_per_quality{m}"] = round(8 * found[f"packed{m}"] / n, 3), round(8 * found[f"quality{m}"] / n, 3)
    out["original_bytes"], out["new_bytes"] = sum(stored_bytes(spark, p) for p in inputs), stored_bytes(spark, path)
    out["factor"] = round(out["original_bytes"] / max(1, out["new_bytes"]), 3)
    return out


def size_report(encoded: DataFrame) -> DataFrame:
    """Bits a base and a quality symbol that the encoded columns take before the codec."""
    return encoded.agg(
        F.count("*").alias("n_reads"), F.sum("read_length").cast("long").alias("n_bases"),
        F.round(F.sum(F.octet_length("payload")) * 8.0 / F.sum("read_length"), 6).alias("bits_per_base"),
        F.round(F.sum(F.octet_length("qual")) * 8.0 / F.sum("read_length"), 6).alias("bits_per_quality"),
    )
