"""Reads and cores derived from the star-schema tables, for queries on data that hold no reads.

A pseudo-genome of md5 digits is cut into overlapping reads of LENGTH bases. The same rules in SQL for DuckDB stand
beside the DataFrames.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import walks

LENGTH, DIGEST = 48, 32
# Hexadecimal digits to bases and to quality symbols.
HEXADECIMAL, AS_BASES, AS_QUALITIES = "0123456789abcdef", "ACGTACGTACGTACGT", "!#%+/38=@CFHIJGD"
_BASES, _QUALITIES = (np.zeros(256, dtype=np.uint8) for _ in range(2))
for _table, _letters in ((_BASES, AS_BASES), (_QUALITIES, AS_QUALITIES)):
    _table[np.frombuffer(HEXADECIMAL.encode(), dtype=np.uint8)] = np.frombuffer(_letters.encode(), dtype=np.uint8)


def _digest(*parts) -> F.Column:
    return F.md5(F.concat(*parts))


def genome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(piece, near): the digest of each part, by its place in the order of keys from 0, with the two after it."""
    from ..operators.ordinal import with_ordinal

    key = F.col("p_partkey")
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(key).where(key.isNotNull())
    placed = with_ordinal(part, key, name="piece")
    shares = placed.select(F.explode(F.array(*[F.struct((F.col("piece") - k).alias("piece"), F.lit(k).alias("k"), key) for k in range(3)])).alias("x")).select("x.*")
    three = shares.groupBy("piece").agg(*[F.max(F.when(F.col("k") == k, key)).alias(f"k{k}") for k in range(3)])
    return three.select("piece", F.concat(*[F.coalesce(_digest(F.col(f"k{k}").cast("string")), F.lit("")) for k in range(3)]).alias("near"))


def qualities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reads without their bases: (read_id, name, qual)."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.col("event_id").cast("string")
    qual = F.translate(_symbols(text), HEXADECIMAL, AS_QUALITIES).alias("qual")
    return events.repartition(tasks, "event_id").select(F.col("event_id").alias("read_id"), _named(text), qual)  # the file is small, what is derived from it is not


def _named(text: F.Column) -> F.Column:
    return F.concat(F.lit("@run."), text, F.lit("/1 "), F.col("event_type")).alias("name")


def _symbols(text: F.Column) -> F.Column:
    return F.substring(F.concat(_digest(F.lit("q"), text), _digest(F.lit("r"), text)), 1, LENGTH)


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events that reads are derived from, with their place in the order of ids (ordinal, from 0)."""
    from ..operators.ordinal import with_ordinal

    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type")
    return with_ordinal(events, "event_id", by="event_id")


def reads(spark: SparkSession, sf_dir: str, shift: int = 0, unknown: bool = True, events: DataFrame | None = None) -> DataFrame:
    """(read_id, name, seq, qual); unknown: N stands where the quality is the lowest. shift: another place in the genome.
    events: those of numbered, whose places the reads get; by default all, without places.

    A read meets its piece of the genome in a join: no row ever holds more of it than the three digests a read spans."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type") if events is None else events
    others = [c for c in events.columns if c == "ordinal"]
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_partkey is not null").count()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = (F.col("event_id") * 7919 + F.col("user_id") * 104729 + shift) % (parts * DIGEST - LENGTH)
    placed = events.withColumn("_at", at).withColumn("piece", F.expr(f"_at div {DIGEST}"))
    placed = placed.repartition(tasks, "piece")  # the file is small, what is derived from it is not
    name, digits = F.col("event_id").cast("string"), F.col("_digits")
    rows = placed.join(genome(spark, sf_dir), "piece", "left").select(
        F.col("event_id").alias("read_id"), _named(name), F.coalesce("near", F.lit("")).alias("near"), (F.col("_at") % DIGEST).cast("int").alias("_at"), _symbols(name).alias("_digits"), *others,
    )
    cut = F.arrow_udf(lambda near, at, symbols: _cut(near, at, symbols, unknown), "seq string, qual string")
    return rows.withColumn("_x", cut("near", "_at", digits)).select("read_id", "name", "_x.seq", "_x.qual", *others)


def _cut(near: pa.Array, at: pa.Array, symbols: pa.Array, unknown: bool) -> pa.Array:
    """The bases from place at on and the qualities, of hexadecimal digits; null where the place or the digits are."""
    lost, bare = (x.is_null().to_numpy(zero_copy_only=False) for x in (at, symbols))
    none = lost | bare
    (bases, b), (quals, q) = walks.raw(near), walks.raw(symbols)
    first = np.clip(walks.numbers(at), 0, np.diff(b))
    sizes = np.minimum(np.diff(b) - first, LENGTH) * ~none
    seq, qual = _BASES[bases[walks.spans(b[:-1] + first, sizes)]], _QUALITIES[quals]
    if unknown:
        seq = np.where(qual[walks.spans(q[:-1], sizes)] == ord("!"), np.uint8(ord("N")), seq)
    fields = [walks.texts(seq, walks.ends(sizes), pa.string(), none), walks.texts(qual, q, pa.string(), bare)]
    return pa.StructArray.from_arrays(fields, names=["seq", "qual"])


def cores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(core_id, core, len): ids in the order of length and core; few beside the reads."""
    from ..operators.ordinal import with_ordinal

    key, digest = F.col("p_partkey"), F.md5(F.col("p_partkey").cast("string"))
    core = F.when(key % 3 == 0, F.substring(digest, 1, 8)).when(key % 3 == 1, F.substring(digest, 9, 10))
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey")
    every = part.select(F.translate(core, HEXADECIMAL, AS_BASES).alias("core")).where("core is not null").distinct()
    placed = with_ordinal(every, F.length("core"), F.col("core"), name="core_id")
    return placed.select(F.col("core_id").cast("int").alias("core_id"), "core", F.length("core").alias("len"))


def _reads_sql(shift: int = 0) -> str:
    return f"""select read_id, name, seq_raw, qual,
      array_to_string(list_transform(range(1, length(seq_raw) + 1), lambda i: case when substr(qual, i, 1) = '!' then 'N' else substr(seq_raw, i, 1) end), '') as seq
    from (select event_id as read_id, concat('@run.', cast(event_id as varchar), '/1 ', event_type) as name,
      translate(substr(g, cast((event_id * 7919 + user_id * 104729 + {shift}) % (length(g) - {LENGTH}) as int) + 1, {LENGTH}), '{HEXADECIMAL}', '{AS_BASES}') as seq_raw,
      translate(substr(concat(md5(concat('q', cast(event_id as varchar))), md5(concat('r', cast(event_id as varchar)))), 1, {LENGTH}), '{HEXADECIMAL}', '{AS_QUALITIES}') as qual
      from events cross join genome) t"""


GENOME_SQL = "genome as (select string_agg(md5(cast(p_partkey as varchar)), '' order by p_partkey) as g from part)"
READS_SQL = f"{GENOME_SQL}, reads as ({_reads_sql()})"
MATES_SQL = f"{READS_SQL}, mates as ({_reads_sql(1000)})"
CORES_SQL = f"""cores as (select core, length(core) as len, cast(row_number() over (order by length(core), core) - 1 as integer) as core_id from (
  select distinct translate(case when p_partkey % 3 = 0 then substr(md5(cast(p_partkey as varchar)), 1, 8) else substr(md5(cast(p_partkey as varchar)), 9, 10) end,
  '{HEXADECIMAL}', '{AS_BASES}') as core from part where p_partkey % 3 < 2) a)"""
CANDIDATES_SQL = f"""{READS_SQL}, {CORES_SQL},
normal as (select read_id, regexp_replace(upper(seq), '[^ACGT]', 'A', 'g') as s from reads),
kmers as (select read_id, pos, substr(s, pos, k) as core from (select read_id, s, k, unnest(range(1, length(s) - k + 2)) as pos from normal cross join (select distinct len as k from cores) l) u),
candidates as (select read_id, core_id, core, pos from kmers join cores using (core))"""


def _best(order: str) -> str:
    return f"""best as (select * from (select *, row_number() over (partition by read_id order by {order}) as rn from ranked) b where rn = 1),
found as (select r.read_id, r.name, r.seq, r.qual, b.core_id, b.core, coalesce(b.pos + length(b.core) - 1, 0) as core_end from reads r left join best b using (read_id))"""


FOUND_SQL = f"{CANDIDATES_SQL}, ranked as (select * from candidates), {_best('length(core) desc, pos')}"
FREQUENT_SQL = f"""{CANDIDATES_SQL}, often as (select core_id, count(distinct read_id) as n from candidates group by core_id),
ranked as (select c.*, n from candidates c join often using (core_id)), {_best('length(core) desc, n desc, pos')}"""
