"""Golden vectors and properties of the functions on names, bases and qualities."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from readloom.functions import bases, names, quality
from readloom.operators import checks, cores, lossy
from readloom.sources import textfiles


def value(spark, column, **fields):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in fields.items()]).select(column.alias("x")).first().x


@pytest.mark.parametrize(("seq", "packed"), [("ACGTACGTA", "1B1B00"), ("TTTT", "FF"), ("G", "80"), ("", ""), ("acgn", "18")])
def test_packing(spark, seq, packed):
    assert value(spark, bases.packed_hex(F.col("s")), s=seq) == packed
    back = value(spark, bases.unpacked(F.col("p"), F.lit(len(seq))), p=packed)
    assert back == "".join(c if c in "ACGT" else "A" for c in seq.upper())


def test_excision_and_its_inverse(spark):
    rng = random.Random(3)
    rows = [("GGACGTTT", "ACG", 5), ("ACG", "", 0), ("ACGT", "ACGT", 4)]
    for _ in range(60):
        seq = "".join(rng.choices("ACGT", k=rng.randint(1, 300)))
        k = rng.randint(1, min(12, len(seq)))
        end = rng.randint(k, len(seq))
        rows.append((seq, seq[end - k : end], end))
    df = spark.createDataFrame(rows, "seq string, core string, core_end int")
    df = df.withColumn("payload", bases.payload(F.col("seq"), F.col("core"), F.col("core_end")))
    df = df.withColumn("back", bases.restored(F.col("payload"), F.col("core"), F.col("core_end")))
    df = df.withColumn("key", bases.sort_key(F.col("seq"), F.col("core"), F.col("core_end"), F.length("seq")))
    out = df.collect()
    assert all(r.back == r.seq for r in out)
    assert (out[0].payload, out[0].key) == ("TTTGG", "TTTAA")


def test_names(spark):
    assert value(spark, names.truncated(F.col("n")), n="@r1/1 lane=3") == "r1/1"
    assert value(spark, names.truncated(F.col("n")), n="@a\tb c") == "a\tb"
    assert value(spark, names.without_mate(F.col("n")), n="r/2") == "r"
    assert value(spark, names.with_mate(F.col("n"), 2), n="r/1") == "r/2"
    assert value(spark, names.mate_path(F.col("p")), p="a1/x_1.fq") == "a1/x_2.fq"
    assert value(spark, names.mate_path(F.col("p")), p="a/x.fq") is None
    assert value(spark, names.synthesized("lib", F.lit(0))) == "@lib.0"
    assert checks.mate_file("a1/x_1.fq") == "a1/x_2.fq"


def test_unknown_bases(spark):
    q = quality.rebased(quality.symbols(F.col("q")), F.lit(33))
    assert value(spark, quality.masked(F.col("s"), q), s="ACNGT", q="II#I!") == [40, 40, 0, 40, 0]
    masked = quality.masked(F.col("s"), q)
    assert value(spark, quality.with_unknown(F.lit("ACAGT"), masked), s="ACNGT", q="II#I!") == "ACNGN"
    assert value(spark, quality.text(masked, F.lit(33)), s="ACNGT", q="II#I!") == "II!I!"


HISTOGRAM = {"!": 3, "#": 5, "5": 20, "6": 40, "7": 25, "A": 10, "F": 60, "G": 90, "H": 80, "I": 100, "J": 30}
LOSSY = {
    0: [],
    10: [("!", "&", "!")],
    30: [("!", "&", "!"), ("4", "9", "6"), ("?", "D", "A"), ("G", "L", "I")],
    50: [("!", "&", "!"), ("3", "=", "6"), (">", "E", "A"), ("F", "P", "I")],
    100: [("!", "&", "!"), ("1", "C", "6"), ("D", "H", "I")],
}


@pytest.mark.parametrize("percent", LOSSY)
def test_lossy_table(percent):
    got = lossy.table({ord(c): n for c, n in HISTOGRAM.items()}, percent, 33)
    want = {s: ord(to) for a, b, to in LOSSY[percent] for s in range(ord(a), ord(b) + 1) if s != ord(to)}
    assert got == want


def test_offset(spark):
    for text, want in (("hhhB", 64), ("hhh;", 33)):
        counts = lossy.histogram(spark.createDataFrame([(1, text)], "read_id long, qual string"))
        assert lossy.offset(counts).first()[0] == want


@pytest.mark.parametrize(("entries", "read", "core", "end"), [(["AC", "CGT", "GT"], "TACGTACC", "CGT", 5), (["AC", "GT"], "TACGTACC", "AC", 3), (["GGG"], "TACGTACC", None, 0), (["AAC"], "TNNC", "AAC", 4)])
def test_core_search(spark, entries, read, core, end):
    dictionary = cores.dictionary(spark.createDataFrame(list(enumerate(entries)), "core_id int, core string"))
    reads = spark.createDataFrame([(1, read)], "read_id long, seq string")
    row = cores.search(reads, dictionary).first()
    assert (row.core, row.core_end) == (core, end)
    fast = cores.search_arrow(reads, dictionary).first()
    assert (fast.core_id, fast.core_end) == (row.core_id, row.core_end)


def test_two_searches_agree(spark):
    rng = random.Random(5)
    pick = lambda n: "".join(rng.choices("ACGTN", weights=[9, 9, 9, 9, 1], k=n))
    entries = sorted({"".join(rng.choices("ACGT", k=rng.choice([3, 4, 6]))) for _ in range(80)})
    reads = spark.createDataFrame([(i, pick(rng.randint(0, 60))) for i in range(300)], "read_id long, seq string")
    dictionary = cores.dictionary(spark.createDataFrame(list(enumerate(entries)), "core_id int, core string"))
    one = {(r.read_id, r.core_id, r.core_end) for r in cores.search(reads, dictionary).collect()}
    two = {(r.read_id, r.core_id, r.core_end) for r in cores.search_arrow(reads, dictionary).collect()}
    assert one == two


def test_options():
    assert (checks.size_in_bytes("4G"), checks.size_in_bytes("10M")) == (4 << 30, 10 << 20)
    for bad in ("4", "4K", "G"):
        with pytest.raises(ValueError):
            checks.size_in_bytes(bad)
    checks.validated(inputs=["a_1.fq"], output="x")
    for wrong in ({"percent": 101}, {"output": None}, {"inputs": []}, {"drop_names": True}, {"paired": True, "inputs": ["x.fq"]}, {"decode": True, "inputs": ["a", "b"]}):
        with pytest.raises(ValueError):
            checks.validated(**{"inputs": ["a_1.fq"], "output": "x"} | wrong)


def test_packed_dictionary():
    entries = ["ACGT", "TTTT", "ACGTACGTA", "A" * 32]
    assert textfiles.parse_packed_patterns(textfiles.packed_patterns(entries)) == entries
    with pytest.raises(ValueError):
        textfiles.parse_packed_patterns(b"\x04\x00\xff\x00\x00\x00\x00")
