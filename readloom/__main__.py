"""Command line: `python -m readloom encode|decode`, with --help for the options."""

from __future__ import annotations

import argparse
import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import __version__, ship
from .operators import checks, cluster, cores
from .operators.ordinal import with_ordinal
from .sources import archive, textfiles


def arguments(argv: list[str]) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="readloom", description="Archives of sequencing reads.")
    parser.add_argument("--version", action="version", version=__version__)
    parts = parser.add_subparsers(dest="command", required=True)
    encode = parts.add_parser("encode", help="read files to an archive")
    encode.add_argument("inputs", nargs="+")
    encode.add_argument("-o", "--output", required=True)
    encode.add_argument("-r", "--paired", action="store_true", help="mates are in the files named with a 2 for the last 1")
    encode.add_argument("-f", "--fasta", action="store_true", help="two lines a record, without qualities")
    encode.add_argument("-Q", "--no-qualities", action="store_true")
    encode.add_argument("-P", "--patterns", help="dictionary of cores, as words of a text file; else frequent k-mers are taken")
    encode.add_argument("-p", "--percent", type=int, default=0, help="error that a lossy quality may add, 0 to 100")
    encode.add_argument("-s", "--sample", type=int, default=100_000, help="reads that the quality table is made from")
    encode.add_argument("-n", "--library", help="names are not kept; reads are numbered under this name")
    encode.add_argument("-c", "--codec", choices=sorted(archive.CODECS), default="zstd")
    encode.add_argument("-A", "--no-arithmetic", action="store_true", help="qualities are not entropy-coded but left to the codec")
    encode.add_argument("-B", "--memory", help="of the driver of a local run, such as 4G")
    decode = parts.add_parser("decode", help="an archive to read files")
    decode.add_argument("inputs", nargs=1)
    decode.add_argument("-o", "--output", required=True, help="a folder, or - for standard output")
    decode.add_argument("-S", "--split", type=int, help="reads a part")
    decode.add_argument("-Q", "--no-qualities", action="store_true")
    decode.add_argument("-c", "--codec", choices=["none", "gzip", "bzip2"], default="none", help="of the files written")
    for p in (encode, decode):
        p.add_argument("-t", "--temp-directory", help="folder for steps in between, which all machines of a run share")
        p.add_argument("-T", "--threads", type=int, default=max(1, min(4, (os.cpu_count() or 2) - 1)))
    return parser.parse_args(argv)


def encode(spark: SparkSession, a: argparse.Namespace) -> None:
    checks.validated(inputs=a.inputs, output=a.output, percent=a.percent, paired=a.paired)
    per_record = 2 if a.fasta else 4
    if a.paired:
        reads = textfiles.read_pairs(spark, a.inputs, [checks.mate_file(p) for p in a.inputs])
    else:
        reads = textfiles.read_records(spark, a.inputs, per_record)
    if a.no_qualities:
        reads = reads.withColumns({c: F.lit(None).cast("string") for c in ("qual", "qual2") if c in reads.columns})
    reads = with_ordinal(checks.non_empty(reads), "file", "ordinal", name="read_id").drop("file", "ordinal")
    entries = textfiles.read_patterns(spark, a.patterns) if a.patterns else cores.frequent(reads)
    started = time.monotonic()
    archive.write(reads, cores.dictionary(entries), a.output, a.percent, a.sample, a.codec, a.library, arithmetic=not a.no_arithmetic)
    mates = [checks.mate_file(p) for p in a.inputs] if a.paired else []
    for name, value in archive.run_report(spark, a.output, [*a.inputs, *mates]).items():
        print(f"{name.replace('_', ' ')}: {value}", file=sys.stderr)
    print(f"seconds: {time.monotonic() - started:.1f}", file=sys.stderr)


def decode(spark: SparkSession, a: argparse.Namespace) -> None:
    checks.validated(inputs=a.inputs, output=a.output, decode=True)
    reads = archive.read(spark, a.inputs[0])
    with_quality = not a.no_qualities and not reads.where("qual is not null").isEmpty()
    if a.output == "-":
        if "seq2" in reads.columns:
            raise ValueError("a pair can't be written to standard output")
        text = textfiles.record_text(F.col("name"), F.col("seq"), F.col("qual") if with_quality else None)
        for row in reads.orderBy("place").select(text.alias("t")).toLocalIterator():
            sys.stdout.write(row.t + "\n")
        return
    mates = [("1", reads)]
    if "seq2" in reads.columns:
        mates.append(("2", reads.drop("seq", "qual").withColumnsRenamed({"seq2": "seq", "qual2": "qual"})))
    for number, one in mates:
        path = f"{a.output}/{number}" if len(mates) > 1 else a.output
        if a.split:
            textfiles.write_parts(cluster.parts(one, a.split), path, with_quality, a.codec)
        else:
            textfiles.write_records(one, path, "place", with_quality, a.codec)


def main(argv: list[str] | None = None) -> int:
    a = arguments(sys.argv[1:] if argv is None else argv)
    builder = SparkSession.builder.config("spark.ui.showConsoleProgress", "false")
    if SparkSession.getActiveSession() is None and "SPARK_MASTER" not in os.environ:
        builder = builder.master(f"local[{a.threads}]")
        if getattr(a, "memory", None):
            builder = builder.config("spark.driver.memory", str(checks.size_in_bytes(a.memory)))
    spark = builder.getOrCreate()
    if a.temp_directory:
        spark.conf.set("spark.checkpoint.dir", a.temp_directory)
    ship(spark)
    try:
        (encode if a.command == "encode" else decode)(spark, a)
    except ValueError as e:
        print(f"readloom: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
