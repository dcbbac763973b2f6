"""Files written by hand, read and written back; archives; the coder; arriving reads."""

from __future__ import annotations

import bz2
import gzip
import random

import pytest
from pyspark.sql import functions as F

from readloom.operators import cluster, codec, context, cores, pairs
from readloom.operators.ordinal import with_ordinal
from readloom.sources import archive, textfiles
from readloom.streaming import bins


def four_lines(records):
    return "".join(f"@{n}\n{s}\n+\n{q}\n" for n, s, q in records)


@pytest.fixture
def records():
    rng = random.Random(1)
    out = [("r0 a comment", "ACGTN", "@+I!#"), ("r1/1", "acgtr", "@@@@@"), ("", "TTTTT", "IIIII")]
    return out + [(f"x{i}", "".join(rng.choices("ACGT", k=5)), "".join(rng.choices("@#$IJ", k=5))) for i in range(200)]


@pytest.mark.parametrize("name", ["a.fq", "a.fq.gz", "hidden", "hidden-bz", "a.fq.bz2"])
def test_reading(spark, tmp_path, records, name):
    path, text = tmp_path / name, four_lines(records) + "@incomplete\nACG\n"
    path.write_bytes(text.encode() if name == "a.fq" else (bz2 if "bz" in name else gzip).compress(text.encode()))
    got = textfiles.read_records(spark, [str(path)]).orderBy("ordinal").collect()
    assert [(r.name, r.seq, r.qual) for r in got] == [(f"@{n}", s, q) for n, s, q in records]
    assert textfiles.codec(str(path)) == ("plain" if name == "a.fq" else "bzip2" if "bz" in name else "gzip")


def test_blocks_of_a_file_keep_their_order(spark, tmp_path, records):
    path = tmp_path / "b.fq"
    path.write_text(four_lines(records * 20))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = textfiles.read_records(spark, [str(path)]).orderBy("ordinal").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.seq for r in got] == [s for _, s, _ in records * 20]


def test_two_lines_empty_and_pairs(spark, tmp_path, records):
    (tmp_path / "a.fa").write_text("".join(f">{n}\n{s}\n" for n, s, _ in records))
    got = textfiles.read_records(spark, [str(tmp_path / "a.fa")], per_record=2).orderBy("ordinal").collect()
    assert [(r.seq, r.qual) for r in got] == [(s, None) for _, s, _ in records]
    (tmp_path / "none.fq").write_text("")
    assert textfiles.read_records(spark, [str(tmp_path / "none.fq")]).count() == 0
    (tmp_path / "p_1.fq").write_text(four_lines(records))
    (tmp_path / "p_2.fq").write_text(four_lines((n, s[::-1], q) for n, s, q in records[:-3]))
    both = textfiles.read_pairs(spark, [str(tmp_path / "p_1.fq")], [str(tmp_path / "p_2.fq")]).orderBy("ordinal").collect()
    assert [(r.seq, r.seq2) for r in both] == [(s, s[::-1]) for _, s, _ in records[:-3]]


def test_patterns(spark, tmp_path):
    (tmp_path / "p.txt").write_text("ACG  TT\n\nGG\tACG\n")
    got = textfiles.read_patterns(spark, str(tmp_path / "p.txt")).orderBy("core_id").collect()
    assert [(r.core_id, r.core) for r in got] == [(0, "ACG"), (1, "TT"), (2, "GG"), (3, "ACG")]
    (tmp_path / "p.bin").write_bytes(textfiles.packed_patterns(["ACG", "TTT", "AAAAA"]))
    assert [r.core for r in textfiles.read_packed_patterns(spark, str(tmp_path / "p.bin")).orderBy("core_id").collect()] == ["ACG", "TTT", "AAAAA"]


def test_bin_order(spark):
    entries = [("TT", 0), ("AAC", 1), ("AC", 2), ("GTA", 3)]
    found = spark.createDataFrame([(i, c, k) for i, (c, k) in enumerate(entries)] + [(9, None, None)], "read_id long, core string, core_id int")
    assert [r.core for r in cluster.bin_order(found).orderBy("bin").collect()] == ["AC", "TT", "AAC", "GTA", None]


@pytest.mark.parametrize(("percent", "arithmetic"), [(0, False), (30, False), (0, True)])
def test_archive(spark, tmp_path, percent, arithmetic):
    rng = random.Random(2)
    entries = ["ACGT", "GGATC", "TTTTTT"]
    rows = []
    for i in range(150):
        seq = "".join(rng.choices("ACGTN", weights=[9, 9, 9, 9, 1], k=31))
        qual = "".join("!" if c == "N" else rng.choice("5GI") for c in seq)
        rows.append((i, f"@n{i} x", seq, qual, seq[::-1], qual[::-1]))
    reads = spark.createDataFrame(rows, "read_id long, name string, seq string, qual string, seq2 string, qual2 string")
    dictionary = cores.dictionary(spark.createDataFrame(list(enumerate(entries)), "core_id int, core string"))
    archive.write(reads, dictionary, str(tmp_path / "a"), percent=percent, arithmetic=arithmetic)
    back = {r.read_id: r for r in archive.read(spark, str(tmp_path / "a")).collect()}
    assert len(back) == len(rows)
    for i, name, seq, qual, seq2, qual2 in rows:
        assert (back[i].name, back[i].seq, back[i].seq2) == (name.split(" ")[0], seq, seq2)
        if not percent:
            assert (back[i].qual, back[i].qual2) == (qual, qual2)


def test_archive_of_mates_with_other_offsets(spark, tmp_path):
    """Mate 1 counts from 64, mate 2 from 33 with '@' for quality 31; each keeps its offset and its lossy table."""
    rows = [(i, f"@n{i}", "ACGTACGT", "hhhhffff", "TTGGCCAA", "@@@@5555") for i in range(20)]
    reads = spark.createDataFrame(rows, "read_id long, name string, seq string, qual string, seq2 string, qual2 string")
    dictionary = cores.dictionary(spark.createDataFrame([(0, "GTAC")], "core_id int, core string"))
    archive.write(reads, dictionary, str(tmp_path / "a"))
    back = [(r.read_id, r.name, r.seq, r.qual, r.seq2, r.qual2) for r in archive.read(spark, str(tmp_path / "a")).orderBy("read_id").collect()]
    assert back == rows
    archive.write(reads, dictionary, str(tmp_path / "b"), percent=30)
    options = spark.read.parquet(str(tmp_path / "b" / "options")).first()
    assert (options.phred_offset, options.phred_offset2) == (64, 33) and options.mapping != options.mapping2
    assert all(r.seq2 == "TTGGCCAA" for r in archive.read(spark, str(tmp_path / "b")).collect())


def test_archive_of_nothing_and_synthesized_names(spark, tmp_path):
    reads = spark.createDataFrame([], "read_id long, name string, seq string, qual string")
    dictionary = cores.dictionary(spark.createDataFrame([(0, "AC")], "core_id int, core string"))
    archive.write(reads, dictionary, str(tmp_path / "a"))
    assert archive.read(spark, str(tmp_path / "a")).count() == 0
    reads = spark.createDataFrame([(1, "@a", "GGAC", "IIII"), (2, "@b", "TTTT", "IIII")], reads.schema)
    archive.write(reads, dictionary, str(tmp_path / "b"), library="lib")
    assert {(r.name, r.seq) for r in archive.read(spark, str(tmp_path / "b")).collect()} == {("@lib.0", "GGAC"), ("@lib.1", "TTTT")}


def test_ordinals_do_not_depend_on_partitions(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    got = []
    for n in (1, 3, 8):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append(sorted((r.k, r.ordinal) for r in with_ordinal(rows.repartition(n), "k").collect()))
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1] == got[2] == [(i, i) for i in range(1000)]


def test_coder():
    rng = random.Random(4)
    for k in (1, 2, 7, 40, 80):
        for n in (0, 1, 2, 3, 600, codec.LANE, codec.LANE + 1, codec.LANE + 2, 9000):
            text = bytes(rng.choices(range(k), k=n))
            model = codec.Model.of((a, b, c, 5) for a, b, c in zip(text, text[1:], text[2:]))
            several = [text, text[:5], b"", text[::-1]]
            assert codec.decode(codec.encode(several, model), [len(x) for x in several], model) == several
    skewed = bytes(rng.choices(range(16), weights=[2**k for k in range(16)], k=50_000))
    model = codec.Model.of((a, b, c, 1) for a, b, c in zip(skewed, skewed[1:], skewed[2:]))
    assert len(codec.encode([skewed], model)[0]) < 0.3 * len(skewed)


def test_arithmetic_archive_of_odd_qualities(spark, tmp_path):
    """Missing, short and long ones; a symbol that the model can't hold is refused."""
    rows = [(i, f"@n{i}", "ACGT" * (i % 4 + 1), None if i % 5 == 0 else "5GI"[i % 3] * (4 * (i % 4 + 1))) for i in range(9000)]
    reads = spark.createDataFrame(rows, "read_id long, name string, seq string, qual string")
    dictionary = cores.dictionary(spark.createDataFrame([(0, "GTAC")], "core_id int, core string"))
    archive.write(reads, dictionary, str(tmp_path / "a"), arithmetic=True)
    assert sorted((r.read_id, r.name, r.seq, r.qual) for r in archive.read(spark, str(tmp_path / "a")).collect()) == rows
    report = archive.run_report(spark, str(tmp_path / "a"), [])
    assert report["reads"] == 9000 and report["bits_per_quality"] < 3
    high = spark.createDataFrame([(1, "@n", "ACGT", "!~~!")], reads.schema)
    with pytest.raises(ValueError):
        archive.write(high, dictionary, str(tmp_path / "b"), arithmetic=True)
    with pytest.raises(ValueError):
        archive.write(high, dictionary, str(tmp_path / "c"), compression="bzip2")


def test_contexts_cross_reads(spark):
    reads = spark.createDataFrame([(0, [1, 2]), (1, [3, 2, 3]), (2, [1, 1])], "read_id long, q array<int>")
    stream = context.streams(reads, F.col("q"))
    text = [1, 2, 3, 2, 3, 1, 1]
    want = {}
    for t in zip(text, text[1:], text[2:]):
        want[t] = want.get(t, 0) + 1
    assert {(r.p2, r.p1, r.v): r.n for r in context.order2(stream).collect()} == want
    pairs_ = {}
    for t in zip(text, text[1:]):
        pairs_[t] = pairs_.get(t, 0) + 1
    assert {(r.p1, r.v): r.n for r in context.order1(stream).collect()} == pairs_


def test_interleaved(spark):
    rows = [(i, f"n{i}", f"S{i}", f"Q{i}") for i in range(5)]
    got = pairs.deinterleaved(spark.createDataFrame(rows, "ordinal long, name string, seq string, qual string")).orderBy("pair").collect()
    assert [(r.name, r.seq, r.seq2) for r in got] == [("n0", "S0", "S1"), ("n2", "S2", "S3")]


def test_command_line(spark, tmp_path, records, capsys):
    from readloom.__main__ import main

    plain = [(n, s.upper().replace("R", "A"), "".join("5" if q in '"!#$' else q for q in qual)) for n, s, qual in records]
    (tmp_path / "a_1.fq").write_text(four_lines(plain))
    (tmp_path / "a_2.fq").write_text(four_lines((n, s[::-1], q) for n, s, q in plain))
    (tmp_path / "p.txt").write_text("ACG TTT\nGAT\n")
    out, one = str(tmp_path / "arch"), str(tmp_path / "a_1.fq")
    assert main(["encode", one, "-o", out, "-P", str(tmp_path / "p.txt")]) == 0
    said = capsys.readouterr().err
    assert f"reads: {len(records)}" in said and "factor: " in said and "bits per quality: " in said
    assert main(["decode", out, "-o", "-"]) == 0
    lines = capsys.readouterr().out.splitlines()
    got = sorted(zip(lines[::4], lines[1::4], lines[3::4], strict=True))
    assert [(n, q) for n, _, q in got] == sorted((f"@{n.split(' ')[0]}", "".join("!" if c == "N" else x for c, x in zip(s, q, strict=True))) for n, s, q in plain)
    assert main(["encode", one, "-o", out + "2", "-r", "-n", "lib", "-A"]) == 0
    assert main(["decode", out + "2", "-o", str(tmp_path / "d"), "-S", "50"]) == 0
    assert sorted(spark.read.text(f"{tmp_path}/d/2/part=5").toPandas().value.str.startswith("@lib.").tolist()).count(True) >= 3
    assert main(["encode", one, "-o", "x", "-p", "101"]) == 1


def test_parts(spark, tmp_path):
    placed = spark.range(25).select(F.col("id").alias("place"), F.lit("@n").alias("name"), F.lit("AC").alias("seq"), F.lit("II").alias("qual"))
    textfiles.write_parts(cluster.parts(placed, 10), str(tmp_path / "p"))
    counts = [spark.read.text(str(tmp_path / "p" / f"part={k}")).count() // 4 for k in (1, 2, 3)]
    assert counts == [10, 10, 5]


def test_arriving_reads(spark, tmp_path):
    dictionary = cores.dictionary(spark.createDataFrame([(0, "AC"), (1, "GGG")], "core_id int, core string"))
    folder = str(tmp_path / "in")
    for k, seqs in enumerate((["ACC", "GGGA"], ["TTT", "AC"])):
        spark.createDataFrame([(10 * k + i, s) for i, s in enumerate(seqs)], "read_id long, seq string").write.mode("append").parquet(folder)
        bins.running_counts(bins.arriving(spark, folder), dictionary, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert {(r.core_id, r.n_reads) for r in bins.totals(spark, str(tmp_path / "out")).collect()} == {(0, 2), (1, 1)}
