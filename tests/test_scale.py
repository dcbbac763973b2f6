"""Steps whose cost must not grow faster than their input: what their plans hold, and the same results as before."""

from __future__ import annotations

import hashlib
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from readloom.functions import bases, quality
from readloom.operators import cluster, codec, cores, lossy, ordinal, pairs
from readloom.plans import catalogue, derived
from readloom.sources import archive


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def small_tables(spark, path) -> str:
    """Events with gaps, and parts with gaps, out of order and with one null key."""
    spark.createDataFrame([(i * 3 + i % 2, i * 37 % 11, "view") for i in range(50)], "event_id long, user_id long, event_type string").write.parquet(f"{path}/events.parquet")
    spark.createDataFrame([(k,) for k in (90, 7, 8, None, 51, 300)], "p_partkey long").write.parquet(f"{path}/part.parquet")
    return str(path)


def test_reads_hold_no_whole_genome(spark, tmp_path):
    sf = small_tables(spark, tmp_path)
    md5 = lambda x: hashlib.md5(str(x).encode()).hexdigest()
    genome = "".join(md5(k) for k in (7, 8, 51, 90, 300))
    bases, symbols = (str.maketrans(derived.HEXADECIMAL, x) for x in (derived.AS_BASES, derived.AS_QUALITIES))
    for shift in (0, 1000):
        got = derived.reads(spark, sf, shift=shift)
        assert "collect_list" not in plan(got) and "NestedLoop" not in plan(got)
        rows = {r.read_id: r for r in got.collect()}
        assert len(rows) == 50
        for e, u in ((i * 3 + i % 2, i * 37 % 11) for i in range(50)):
            at = (e * 7919 + u * 104729 + shift) % (len(genome) - 48)
            qual = (md5(f"q{e}") + md5(f"r{e}"))[:48].translate(symbols)
            seq = "".join("N" if q == "!" else b for b, q in zip(genome[at : at + 48].translate(bases), qual, strict=True))
            assert (rows[e].name, rows[e].seq, rows[e].qual) == (f"@run.{e}/1 view", seq, qual)
    assert sorted(derived.qualities(spark, sf).collect()) == sorted((r.read_id, r.name, r.qual) for r in rows.values())


@pytest.mark.parametrize("by_frequency", [False, True])
def test_search_where_reads_are(spark, monkeypatch, by_frequency):
    """The same by numbers and by a join, for odd reads and entries; by numbers nothing is exploded, joined or dealt anew."""
    rng = random.Random(8)
    pick = lambda n: "".join(rng.choices("ACGTNacgé", weights=[9, 9, 9, 9, 1, 1, 1, 1, 1], k=n))
    texts = [None, "", "A", "Ré", "ß" * 9, "CGT" * 500, *(pick(rng.randint(0, 70)) for _ in range(200))]
    reads = spark.createDataFrame(list(enumerate(texts)), "read_id long, seq string")
    entries = sorted({"".join(rng.choices("ACGT", k=rng.choice([2, 3, 4, 12]))) for _ in range(90)}) + ["NNN", "acg", "CGT" * 10]
    dictionary = spark.createDataFrame(list(enumerate(entries)), "core_id int, core string").selectExpr("core_id", "core", "length(core) as len")
    fast, all_fast = cores.search(reads, dictionary, by_frequency), cores.candidates(reads, dictionary)
    assert not re.search("Exchange|Generate|Join", fast._jdf.queryExecution().executedPlan().toString())
    assert "Join" not in plan(all_fast)
    rows = (sorted(fast.collect()[1:]), sorted(all_fast.collect()))
    monkeypatch.setattr(cores, "BROADCAST_CORES", 3)
    slow, all_slow = cores.search(reads, dictionary, by_frequency), cores.candidates(reads, dictionary)
    assert "Join" in plan(slow) and rows == (sorted(r for r in slow.collect() if r.seq is not None), sorted(all_slow.collect()))
    assert fast.dtypes == slow.dtypes and all_fast.dtypes == all_slow.dtypes
    twice = dictionary.union(dictionary.selectExpr("core_id + 1000", "core", "len"))
    monkeypatch.undo()
    assert sorted(cores.search(reads, twice, by_frequency).collect()[1:]) == rows[0] and cores.candidates(reads, twice).count() == 2 * len(rows[1])
    longer = spark.createDataFrame([(0, "ACGT" * 9), (1, "TT")], "core_id int, core string").selectExpr("core_id", "core", "length(core) as len")
    assert [r.core_id for r in cores.search(spark.createDataFrame([(1, "TT" + "ACGT" * 9)], "read_id long, seq string"), longer).collect()] == [0]
    none = cores.search(reads, dictionary.limit(0), by_frequency)
    assert none.where("core is null and core_end = 0 and core_id is null").count() == len(texts)


def test_sample_is_counted_before(spark, monkeypatch):
    """The first n by id, of which only about n come to the top-n; ids of both signs, far apart, few, with nulls, repeated."""
    monkeypatch.setattr(lossy, "RANGES", 8)
    rng = random.Random(4)
    for ids in (range(1000), [rng.randint(-(2**63), 2**63 - 1) for _ in range(500)], [-(2**63), *range(300), 2**63 - 1], [5] * 300 + [4, 9], [None] * 30 + list(range(400)), [3], []):
        reads = spark.createDataFrame([(i,) for i in ids], "read_id long").repartition(4)
        for n in (1, 20, 60):
            want = sorted(ids, key=lambda i: (i is not None, i))[:n]
            assert [r.read_id for r in lossy.sample(reads, n).collect()] == want
            last = lossy._enough(reads, n)
            if ids and ids[0] != 5 and last is not None:
                assert sum(i is None or i <= last for i in ids) <= 2 * n + 30
    assert lossy.sample(spark.createDataFrame([("b",), ("a",)], "read_id string"), 1).first().read_id == "a"


def test_blocks_are_coded_together(monkeypatch):
    """Many small blocks are one group of lanes, large ones are bounded; however they are grouped, the bytes are the same."""
    assert list(codec._shares([10] * 100)) == [(0, 100)] and list(codec._shares([])) == []
    monkeypatch.setattr(codec, "GROUP", 25)
    assert list(codec._shares([10, 10, 10, 60, 0, 5])) == [(0, 2), (2, 3), (3, 4), (4, 6)]
    rng = random.Random(2)
    model = codec.Model.of([(a, b, c, rng.randint(1, 90_000)) for a in range(9) for b in range(9) for c in range(9)])
    texts = [bytes(rng.choices(range(80), k=n)) for n in (0, 1, 2, 3, 4095, 4097, 9000)] + [b"\x05" * 20_000]
    whole = codec.encode(texts, model)
    assert whole == [codec.encode([x], model)[0] for x in texts]
    assert codec.decode(whole, [len(x) for x in texts], model) == texts


def test_rows_are_computed_once_to_be_placed(spark):
    """Bounds of ranges come from few rows, not from a run over all; the places are those of one sort, and a range holds its share."""
    rng = random.Random(6)
    n, seen = 20_000, spark.sparkContext.accumulator(0)
    rows = [(i, rng.choice([None, "A", "AC", "CA"]), "".join(rng.choices("ACGT", k=rng.randint(0, 5)))) for i in range(n)]
    found = spark.createDataFrame(rows, "read_id long, core string, seq string").select("read_id", "core", F.concat(F.coalesce("core", F.lit("")), "seq").alias("seq"), F.coalesce(F.length("core"), F.lit(0)).alias("core_end"))

    def counted(x: pa.Array) -> pa.Array:
        seen.add(len(x))
        return x

    placed = cluster.clustered(found.withColumn("seq", F.arrow_udf(counted, "string")("seq"))).collect()
    assert n <= seen.value <= 1.2 * n
    want = sorted(rows, key=lambda r: (r[1] is None, len(r[1] or ""), r[1] or "", r[2], r[0]))
    assert [r.read_id for r in sorted(placed, key=lambda r: r.place)] == [r[0] for r in want]
    assert [r.place for r in sorted(placed, key=lambda r: r.place)] == list(range(n))
    dealt = ordinal._dealt(found, [F.col("core"), F.col("seq"), F.col("read_id")], "read_id", 4)
    shares = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(shares) == n and max(shares) < 0.45 * n
    few = found.where("read_id < 3")
    assert sorted(r.place for r in cluster.clustered(few, columns=["read_id"]).collect()) == [0, 1, 2]
    assert cluster.clustered(found.where("read_id < 0"), columns=["read_id"]).columns == ["read_id", "place"]


def test_walks_equal_the_general_form(spark):
    """Bytes in numpy give what characters in SQL give, on odd rows too; plain rows don't take the form with a step a character."""
    rng = random.Random(3)
    pick = lambda letters, n: "".join(rng.choices(letters, k=n))
    rows = [(None, "II", None, 0), ("AC", None, None, 0), ("", "", None, 0), ("Rßé", "I!#", None, 0), ("ACGT", "I!", None, 0), ("AC", "I!#\u00e9", "A", 1), ("ACG", "!é#", "CG", 3), ("ACG", "!!#", "CG", 99)]
    for _ in range(300):
        seq = pick("ACGTNacgn-", rng.randint(0, 30))
        size = rng.choice([0, 1, 2, 3])
        end = rng.randint(size, len(seq)) if size and len(seq) >= size else 0
        rows.append((seq, pick("!#5I~", len(seq)), bases.BASES[:size] if end else None, end))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, seq string, qual string, core string, core_end int")
    core, end, seq, qual = F.coalesce("core", F.lit("")), F.col("core_end"), F.col("seq"), F.col("qual")
    rebased = lambda: quality.rebased(quality.remapped(quality.symbols(qual), lossy.as_map({53: 35})), F.lit(33))
    width = (F.length("seq") - F.when(end > 0, F.length(core)).otherwise(0)).cast("int")
    pairs = {
        "packed": (bases.packed(seq), F.unhex(bases.packed_hex(seq))),
        "key": (bases.sort_key(seq, core, end, F.length("seq")), F.rpad(bases.normalized(F.when(end > 0, F.substr(seq, end + 1)).otherwise(seq)), width, F.lit("A"))),
        "qual": (archive._quality(seq, qual, {53: 35}, 33), quality.text(quality.masked(seq, rebased()), F.lit(33))),
    }
    got = df.select("i", *[x.alias(f"{k}{j}") for k, v in pairs.items() for j, x in enumerate(v)]).collect()
    for k in pairs:
        assert [(r.i, r[f"{k}0"]) for r in got] == [(r.i, r[f"{k}1"]) for r in got], k
    assert plan(df.select(bases.packed(seq))).count("ArrowEvalPython") >= 1


def test_archive_keeps_odd_reads(spark, tmp_path):
    """Other letters, an empty read, one without qualities; places follow the order of the bins."""
    rows = [(0, "@a x", "ACGTN", "IIII!"), (1, "@b", "ttacg", "I#I#I"), (2, "@c", "", ""), (3, "@d", "GGAC", None), (4, "@e", "RYAC", "!III")]
    reads = spark.createDataFrame(rows, "read_id long, name string, seq string, qual string")
    words = spark.createDataFrame([(0, "AC"), (1, "TAC")], "core_id int, core string").selectExpr("core_id", "core", "length(core) as len")
    archive.write(reads, words, f"{tmp_path}/a")
    back = {r.read_id: (r.name, r.seq, r.qual) for r in archive.read(spark, f"{tmp_path}/a").collect()}
    assert back == {0: ("@a", "ACGTN", "IIII!"), 1: ("@b", "TTACG", "I#I#I"), 2: ("@c", "", ""), 3: ("@d", "GGAC", None), 4: ("@e", "NAAC", "!III")}
    places = [r.read_id for r in archive.read(spark, f"{tmp_path}/a").orderBy("place").collect()]
    assert places == [3, 4, 0, 1, 2]


def test_contexts_are_counted_in_blocks(spark):
    """As in one stream, also over the ends of blocks; nothing is exploded or ordered anew. The blocks keep nulls and lengths."""
    rng = random.Random(9)
    texts = [None if i == 5 else "".join(chr(33 + rng.choice([0, 2, 7, 79])) for _ in range(rng.randint(2, 9))) for i in range(50)]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "place long, q string").repartition(3)
    blocks = codec.gathered(rows, "q", "place", 7)
    assert [(r.block, r.first, r.lengths) for r in blocks.orderBy("block").limit(1).collect()] == [(0, 0, [-1 if x is None else len(x) for x in texts[:7]])]
    stream = [ord(c) - 33 for x in texts for c in x or ""]
    want: dict = {}
    for x in zip(stream, stream[1:], stream[2:], strict=False):
        want[x] = want.get(x, 0) + 1
    got = codec.counts(blocks, 33)
    assert {(r.p2, r.p1, r.v): r.n for r in got.collect()} == want
    assert "Generate" not in plan(got) and "rangepartitioning" not in plan(got)


@pytest.mark.parametrize("low", [33, 64])
def test_coded_qualities_come_back(spark, tmp_path, low):
    """Nulls, empty ones, the highest symbol, both offsets; one below the offset is refused instead of spoilt."""
    quals = ["I" * 48, None, "", chr(low) * 3, chr(low + 79) * 2 + "hh", *["dddf"] * 9]
    rows = [(i, f"@{i}", "C" * len(q or ""), q) for i, q in enumerate(quals)]
    reads = spark.createDataFrame(rows, "read_id long, name string, seq string, qual string").where(F.lit(True) if low == 33 else "read_id > 2")
    words = spark.createDataFrame([(0, "AC", 2)], "core_id int, core string, len int")
    archive.write(reads, words, f"{tmp_path}/a", arithmetic=True)
    back = {r.read_id: r.qual for r in archive.read(spark, f"{tmp_path}/a").collect()}
    assert back == {i: q for i, q in enumerate(quals) if low == 33 or i > 2}
    placed = spark.createDataFrame([(0, "hh>h")], "place long, qual string")
    with pytest.raises(ValueError, match="below the offset"):
        archive._coded(placed, "qual", 64, f"{tmp_path}/b", "zstd")


def test_one_walk_encodes_reads(spark, monkeypatch):
    """Reads are searched, packed and given their keys in one Arrow function, in which they are placed as by cores and keys; odd ones too."""
    rng = random.Random(12)
    rows = [(0, "@n", None, None), (1, "@é x", "Rßé" * 9, "é" * 27), (2, "@c", "", ""), (3, "@d", "GGAC", None), (4, "@e", "GGACß", "!IIII"), (5, "@f", "ACGT", "I!"), (6, None, "ACéGACA", "I!#I!#5")]
    for i in range(7, 400):  # many equal beginnings, some reads repeated
        seq = "".join(rng.choices("ACGTNacg-", weights=[40, 9, 2, 2, 1, 1, 1, 1, 1], k=rng.choice([0, 3, 8, 21, 40])))
        rows.append((i, f"@r{i} x", seq, "".join(rng.choices("!#5I", k=len(seq)))))
    reads = spark.createDataFrame([(*r, *reversed(r[2:])) for r in rows], "read_id long, name string, seq string, qual string, qual2 string, seq2 string").repartition(3)
    entries = ["CA", "AC", "AAC", "AACA", "AAAAAAAA"]
    words = spark.createDataFrame(list(enumerate(entries)), "core_id int, core string").selectExpr("core_id", "core", "length(core) as len")
    for one in (reads.drop("seq2", "qual2"), reads.drop("seq2", "qual2", "qual"), reads):
        got = archive.encode(one, words, {53: 35}, 33, mapping2={73: 72}, offset2=35)
        with monkeypatch.context() as m:
            m.setattr(cores, "BROADCAST_CORES", 0)
            want = archive.encode(one, words, {53: 35}, 33, mapping2={73: 72}, offset2=35)
            assert got.dtypes == want.dtypes and got.orderBy("place").collect() == want.orderBy("place").collect()
    seen = {}
    monkeypatch.setattr(cluster, "with_ordinal", lambda df, *a, **k: seen.setdefault("df", df).withColumn("place", F.lit(0)))
    archive.encode(reads, words, {}, 33).count()
    assert seen["df"]._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert not {"core", "sort_key"} & set(seen["df"].columns)


def test_blocks_are_cut_where_rows_are(spark):
    """Rows stored in their order become blocks without being dealt; together they hold each row once, with the same counts."""
    rng = random.Random(10)
    texts = [None if i % 9 == 5 else "".join(chr(35 + rng.choice([0, 2, 7, 77])) for _ in range(rng.randint(0, 5))) for i in range(100)]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "place long, q string").repartitionByRange(3, "place").sortWithinPartitions("place")
    blocks = codec.runs(rows, "q", "place", 7)
    assert "Exchange" not in codec.runs(spark.range(9).selectExpr("id as place", "'a' as q"), "q", "place")._jdf.queryExecution().executedPlan().toString()
    found = sorted(blocks.collect(), key=lambda r: r.first)
    assert [n for r in found for n in r.lengths] == [-1 if x is None else len(x) for x in texts] and max(len(r.lengths) for r in found) == 7
    assert b"".join(bytes(r.symbols) for r in found).decode("latin-1") == "".join(x or "" for x in texts)
    assert {(r.low, r.high) for r in codec.runs(rows.where("place < 9").withColumn("q", F.lit("b€")), "q", "place").collect()} == {(98, 256)}
    full = rows.withColumn("q", F.rpad(F.coalesce("q", F.lit("")), 4, "%"))
    same = [{(r.p2, r.p1, r.v): r.n for r in codec.counts(b, 35).collect()} for b in (codec.runs(full, "q", "place", 7), codec.gathered(full, "q", "place", 7))]
    assert same[0] == same[1] and same[0]


def test_places_of_mates_come_before_their_reads(spark, tmp_path):
    """Files are zipped by places that events got: no sequence or quality is sorted or stored for that."""
    sf = small_tables(spark, tmp_path)
    for mates in catalogue._mates(spark, sf):
        assert not re.search(r"Relation[^\n]*\b(seq|qual)#", plan(mates)) and "seq" in mates.columns
    ids = sorted(r.read_id for r in derived.reads(spark, sf).collect())
    both = pairs.zipped(*catalogue._mates(spark, sf)).orderBy("ordinal").collect()
    assert [(r.ordinal, r.read_id) for r in both] == list(enumerate(ids))
    want = {r.read_id: (r.seq, r.qual) for r in derived.reads(spark, sf, shift=1000).collect()}
    assert {r.read_id: (r.seq2, r.qual2) for r in both} == want


def test_sample_of_mates_is_taken_before_they_meet(spark, tmp_path, monkeypatch):
    """The condition for the bounds of ranges is on the place, which both files have: neither is joined whole for it."""
    sf, seen = small_tables(spark, tmp_path), {}
    monkeypatch.setattr(cluster, "with_ordinal", lambda df, *a, by, **k: seen.setdefault("df", (df, by))[0].withColumn("place", F.lit(0)))
    words = spark.createDataFrame([(0, "AC", 2)], "core_id int, core string, len int")
    archive.encode(pairs.zipped(*catalogue._mates(spark, sf)), words, {}, 33)
    df, by = seen["df"]
    some = df.where(F.pmod(F.xxhash64(by), F.lit(64)) == 0)._jdf.queryExecution().optimizedPlan().toString()
    assert by == "ordinal" and some.count("xxhash64") == 2
