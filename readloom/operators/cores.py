"""The dictionary of cores and the search for a read's core.

A read's core is the longest dictionary entry found in it; of equally long ones the leftmost, or, if asked for,
the one that most reads contain, then the leftmost. The search runs on normalized bases.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import walks
from ..functions.bases import normalized

#: A dictionary of up to so many entries of at most LONGEST bases is sent to every task as numbers (12 bytes an entry); a larger
#: one, or one with longer entries, is joined by shuffle.
BROADCAST_CORES, LONGEST = 4_000_000, 31
#: Entries of so many bases are looked up by their number in a table of 4**DIRECT places, longer ones by binary search.
DIRECT = 10


def dictionary(entries: DataFrame) -> DataFrame:
    """(core_id, core, len) of (core_id, core); of equal cores the largest id holds."""
    return entries.groupBy("core").agg(F.max("core_id").alias("core_id")).select("core_id", "core", F.length("core").alias("len"))


def frequent(reads: DataFrame, k: int = 12, n: int = 10_000) -> DataFrame:
    """(core_id, core): the n most frequent k-mers, for reads that come without a dictionary; ties by letters."""
    rows = reads.select(normalized(F.col("seq")).alias("_s")).where(F.length("_s") >= k)
    places = rows.select("_s", F.explode(F.sequence(F.lit(1), F.length("_s") - (k - 1))).alias("pos"))
    counts = places.groupBy(F.substr("_s", "pos", F.lit(k)).alias("core")).agg(F.count("*").alias("n"))
    top = [r.core for r in counts.orderBy(F.desc("n"), "core").limit(n).collect()]  # n entries
    return reads.sparkSession.createDataFrame(list(enumerate(top)), "core_id int, core string")


@dataclass
class Table:
    """Entries of k bases as numbers of two bits a base, rising, with their ids and how many reads contain them (if known)."""

    k: int
    values: np.ndarray
    ids: np.ndarray
    often: np.ndarray | None = None
    direct: np.ndarray | None = None

    def places(self, kmers: np.ndarray) -> np.ndarray:
        """The place in values of each number, -1 for none."""
        if self.direct is not None:
            return self.direct[kmers]
        at = np.minimum(np.searchsorted(self.values, kmers), len(self.values) - 1)
        return np.where(self.values[at] == kmers, at, -1)


def _letters(seq: Column) -> Column:
    """What _hits reads as the normalized read: it takes letters of either case, and all others as A."""
    return F.when(walks.plain(seq), seq).otherwise(normalized(seq))


def _tables(cores: DataFrame, every: bool = False) -> list[Table] | None:
    """By rising length; None for a dictionary that only a join takes. Entries with other letters are in no normalized read.
    Of equal entries the smallest id holds; every: such a dictionary is left to the join."""
    n = F.length("core")
    known = cores.where(F.col("core").rlike("^[ACGT]*$")).select(F.col("core_id").cast("int").alias("core_id"), "core")
    seen = known.agg(F.count("*").alias("n"), F.min(n).alias("least"), F.max(n).alias("most")).first()
    if seen.n > BROADCAST_CORES or seen.n and not 0 < seen.least <= seen.most <= LONGEST:
        return None
    rows = known.toArrow()
    text, ids = rows.column("core").cast(pa.binary()), rows.column("core_id").to_numpy()
    sizes, tables = pc.binary_length(text).to_numpy(), []
    for k in np.unique(sizes).tolist():
        chosen = sizes == k
        letters = walks.CODE[np.frombuffer(b"".join(text.filter(pa.array(chosen)).to_pylist()), dtype=np.uint8)].reshape(-1, k)
        values = np.zeros(len(letters), dtype=np.int64)
        for j in range(k):
            values = values * 4 + letters[:, j]
        order = np.lexsort((ids[chosen], values))
        values, own = values[order], ids[chosen][order]
        first = np.concatenate([[True], values[1:] != values[:-1]])
        if every and not first.all():
            return None
        table = Table(k, values[first], own[first].astype(np.int32))
        if k <= DIRECT:
            table.direct = np.full(4**k, -1, dtype=np.int32)
            table.direct[table.values] = np.arange(len(table.values), dtype=np.int32)
        tables.append(table)
    return tables


def _hits(text: pa.Array, tables: list[Table]) -> Iterator[tuple[Table, np.ndarray, np.ndarray, np.ndarray]]:
    """Of normalized reads, for each length: the rows with an entry, where it starts (from 0) and its place in the table; in
    the order of rows and starts."""
    data, at = walks.raw(text)
    raw = walks.CODE[data]
    row = np.repeat(np.arange(len(text)), np.diff(at))
    kmers, k = np.zeros(len(raw), dtype=np.int64), 0
    for table in tables:
        while k < table.k and len(kmers):
            tail = raw[k:]
            kmers, k = kmers[: len(tail)] * 4 + tail, k + 1
        if not len(kmers):
            return
        place = table.places(kmers)
        hit = np.flatnonzero((place >= 0) & (row[: len(kmers)] == row[k - 1 :]))
        yield table, row[hit], hit - at[row[hit]], place[hit]


def _each_row(tables: list[Table], spark, f, schema: str):
    """An Arrow function of normalized reads: f of a batch and its hits."""
    sent = spark.sparkContext.broadcast(tables)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield f(batch, _hits(batch, sent.value))

    return F.arrow_udf(run, schema)


def _every(text: pa.Array, hits: Iterable) -> pa.Array:
    """All hits of each row, as lists of (core_id, pos, len)."""
    parts = [(row, table.ids[place], start + 1, np.full(len(row), table.k)) for table, row, start, place in hits]
    row, ids, pos, size = (np.concatenate([np.zeros(0, dtype=np.int64), *x]) for x in (zip(*parts, strict=True) if parts else [()] * 4))
    order = np.argsort(row, kind="stable")
    fields = [pa.array(x[order].astype(np.int32)) for x in (ids, pos, size)]
    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(text)))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(fields, names=["core_id", "pos", "len"]))


@dataclass
class Found:
    """Of each row its core: the id (-1 for none), the last place from 1, the length (both 0 for none), and its number in the order
    of bins (the number of all entries for none)."""

    ids: np.ndarray
    end: np.ndarray
    size: np.ndarray
    bins: np.ndarray


def _winner(n: int, hits: Iterable, tables: list[Table]) -> Found:
    ids, end, size = (np.full(n, x, dtype=np.int32) for x in (-1, 0, 0))
    firsts = dict(zip([t.k for t in tables], walks.ends(np.array([len(t.values) for t in tables], dtype=np.int64)).tolist(), strict=False))
    bins = np.full(n, sum(len(t.values) for t in tables), dtype=np.int64)
    for table, row, start, place in hits:  # a longer entry takes the row over
        if table.often is not None and len(row):
            often, heads = table.often[place], np.flatnonzero(np.diff(row, prepend=-1))
            top = np.repeat(np.maximum.reduceat(often, heads), np.diff(np.append(heads, len(row))))
            row, start, place = (x[often == top] for x in (row, start, place))
        first = np.flatnonzero(np.diff(row, prepend=-1))
        ids[row[first]], end[row[first]], size[row[first]] = table.ids[place[first]], start[first] + table.k, table.k
        bins[row[first]] = firsts[table.k] + place[first]
    return Found(ids, end, size, bins)


def _with_frequency(reads: DataFrame, tables: list[Table]) -> list[Table]:
    """The tables with the number of reads that contain each entry: a task adds up its own, at most one row an entry."""
    sent = reads.sparkSession.sparkContext.broadcast(tables)
    schema = pa.schema([("table", pa.int32()), ("place", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {t.k: np.zeros(len(t.values), dtype=np.int64) for t in sent.value}
        for batch in batches:
            for table, row, _start, place in _hits(batch.column(0), sent.value):
                once = np.unique(row * len(table.values) + place) % len(table.values)
                counts[table.k] += np.bincount(once, minlength=len(table.values))
        for i, n in enumerate(counts.values()):
            seen = np.flatnonzero(n)
            for lo in range(0, len(seen), 100_000):
                part = seen[lo : lo + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), i), pa.int32()), pa.array(part, pa.int32()), pa.array(n[part])], schema=schema)

    parts = reads.select(_letters(F.col("seq")).alias("_s")).mapInArrow(run, "table int, place int, n long")
    known = parts.groupBy("table", "place").agg(F.sum("n").alias("n")).toArrow()  # at most one row an entry
    table, place, n = (known.column(c).to_numpy() for c in ("table", "place", "n"))
    out = []
    for i, t in enumerate(tables):
        often = np.zeros(len(t.values), dtype=np.int64)
        often[place[table == i]] = n[table == i]
        out.append(replace(t, often=often))
    return out


def _joined(reads: DataFrame, cores: DataFrame) -> DataFrame:
    """candidates by a join with k-mers of every length."""
    lengths = sorted(r["len"] for r in cores.groupBy("len").count().collect())  # a handful of numbers
    sizes = F.array(*[F.lit(k) for k in lengths]).cast("array<int>")
    rows = reads.select("read_id", normalized(F.col("seq")).alias("_s")).select("read_id", "_s", F.explode(sizes).alias("_k")).where(F.length("_s") >= F.col("_k"))
    places = rows.select("read_id", "_s", "_k", F.explode(F.sequence(F.lit(1), F.length("_s") - F.col("_k") + 1)).alias("pos"))
    spread = places.select("read_id", F.substr("_s", "pos", "_k").alias("core"), "pos")
    return spread.join(cores.select("core_id", "core"), "core").select("read_id", "core_id", "core", "pos")


def candidates(reads: DataFrame, cores: DataFrame) -> DataFrame:
    """(read_id, core_id, core, pos) of every entry found at every place (from 1)."""
    tables = _tables(cores, every=True)
    if tables is None:
        return _joined(reads, cores)
    every = _each_row(tables, reads.sparkSession, _every, "array<struct<core_id:int,pos:int,len:int>>")
    rows = reads.select("read_id", normalized(F.col("seq")).alias("_s")).select("read_id", "_s", F.explode(every("_s")).alias("x"))
    return rows.select("read_id", "x.core_id", F.substr("_s", "x.pos", "x.len").alias("core"), "x.pos")


def search(reads: DataFrame, cores: DataFrame, by_frequency: bool = False) -> DataFrame:
    """reads with core_id, core (null for none) and core_end (last place from 1, 0 for none).

    Each batch of reads is searched where it is; reads are neither spread nor dealt anew."""
    return _searched(reads, cores, by_frequency) or _search_joined(reads, cores, by_frequency)


def search_and(reads: DataFrame, cores: DataFrame, by_frequency: bool, f, kinds: dict[str, str], columns: list[Column]) -> DataFrame | None:
    """search, and what f makes of the same batches: a column of each name and type of kinds, from the reads as they were searched
    (in letters of either case where they are plain), what was found, and the columns. None for a dictionary that only a join takes."""
    return _searched(reads, cores, by_frequency, f, kinds, columns)


def _searched(reads: DataFrame, cores: DataFrame, by_frequency: bool, f=None, kinds: dict[str, str] | None = None, columns: Iterable[Column] = ()) -> DataFrame | None:
    tables = _tables(cores)
    if tables is None:
        return None
    kinds = {} if kinds is None else kinds
    sent = reads.sparkSession.sparkContext.broadcast(_with_frequency(reads, tables) if by_frequency else tables)

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for text, *others in batches:
            found = _winner(len(text), _hits(text, sent.value), sent.value)
            data, at = walks.raw(text)
            core = walks.NORMAL[data[walks.spans(at[:-1] + found.end - found.size, found.size)]]
            fields = [pa.array(found.ids, mask=found.ids < 0), walks.texts(core, walks.ends(found.size), pa.string(), found.ids < 0), pa.array(found.end)]
            more = f(data, at, found, *others) if f else []
            yield pa.StructArray.from_arrays([*fields, *more], names=["core_id", "core", "core_end", *kinds])

    best = F.arrow_udf(run, ", ".join(["core_id int, core string, core_end int", *[f"{c} {k}" for c, k in kinds.items()]]))
    # One column alone would come without its tuple.
    rows = reads.withColumn("_b", best(_letters(F.col("seq")), *(columns or [F.lit(0)])))
    return rows.select(*reads.columns, *[F.col(f"_b.{c}").alias(c) for c in ("core_id", "core", "core_end", *kinds)])


def _search_joined(reads: DataFrame, cores: DataFrame, by_frequency: bool) -> DataFrame:
    """search by a join: only matches are aggregated, one row a read after partial aggregation."""
    found = _joined(reads, cores).withColumn("_len", -F.length("core"))
    if by_frequency:
        often = found.groupBy("core_id").agg((-F.countDistinct("read_id")).alias("_often"))
        found = found.join(often, "core_id")
        rank = F.struct("_len", "_often", "pos", "core_id", "core")
    else:
        rank = F.struct("_len", "pos", "core_id", "core")
    best = found.groupBy("read_id").agg(F.min(rank).alias("b"))
    return reads.join(best, "read_id", "left").select(
        *[reads[c] for c in reads.columns], F.col("b.core_id").alias("core_id"), F.col("b.core").alias("core"),
        F.coalesce(F.col("b.pos") - F.col("b._len") - 1, F.lit(0)).cast("int").alias("core_end"),
    )


def search_arrow(reads: DataFrame, cores: DataFrame) -> DataFrame:
    """(read_id, core_id, core_end), as search finds them, of reads that pass through as Arrow batches. For dictionaries of at
    most BROADCAST_CORES entries of at most LONGEST bases."""
    tables = _tables(cores)
    if tables is None:
        raise ValueError(f"more than {BROADCAST_CORES} cores, or some of more than {LONGEST} bases or none; use search")
    sent = reads.sparkSession.sparkContext.broadcast(tables)
    schema = pa.schema([("read_id", pa.int64()), ("core_id", pa.int32()), ("core_end", pa.int32())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _winner(batch.num_rows, _hits(batch.column(1), sent.value), sent.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.ids, mask=found.ids < 0), pa.array(found.end)], schema=schema)

    return reads.select("read_id", _letters(F.col("seq")).alias("_s")).mapInArrow(run, "read_id long, core_id int, core_end int")
