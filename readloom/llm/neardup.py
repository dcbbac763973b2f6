"""Near duplicates by one-permutation minhashing.

One hash of every shingle fills all bins of a signature (one permutation); an empty bin takes the value of
the first filled bin that its own sequence of universal hashes names (optimal densification). Bins form bands;
texts that agree on a band share a bucket. Texts with equal shingle sets are one class with one
representative. In each bucket, candidate edges form stars: every member with the smallest id and with the
one of smallest hash, so their number is linear in the bucket. Links are confirmed on the full shingle
sets of 64-bit shingle hashes. A star's centre may resemble nobody, so members of a bucket that are still in
different components are settled too, block against block, by products of incidence matrices: exact, with one link
for two roots. Left out are those of which other unsettled texts share too few shingles for any link (an exact bound).
Components come from alternating large-star and small-star steps on tables in the shared folder; no id list goes to the
driver. Steps go as soon as nothing reads them; the result is a stored table.

Defined cases: null or empty text and text without words: empty set, linked with nothing; fewer than five
words: the whole sequence is the one shingle; very long texts are read one at a time, whole; a null doc_id: kept, its
own component (null), linked with nothing; rows that share a doc_id are parts of one document: each keeps its own set
and the links of all are the document's; an empty table gives an empty result; other columns are ignored (pipeline
stage: kept as they are).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Steps, stored, table
from .vecwords import blocks, mix, windows, words

SHINGLE, PERCENT = 5, 75
#: A pair at similarity s meets in some band with probability 1 - (1 - s**ROWS)**BANDS: 0.9999 at 0.75.
BANDS, ROWS = 48, 6
BINS = BANDS * ROWS
BLOCK = 512
_EMPTY = np.uint64(2**64 - 1)


def shingle_sets(hashes: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    w = windows(hashes, SHINGLE)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(w[a : b - SHINGLE + 1]))
        elif b > a:
            out.append(windows(hashes[a:b], int(b - a), seed=1))
        else:
            out.append(hashes[:0])
    return out


def signatures(sets: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """A row of bins for each set; rows of empty sets stay empty."""
    sig = np.full((len(sets), bins), _EMPTY, dtype=np.uint64)
    for row, s in zip(sig, sets, strict=True):
        if len(s):
            at = ((s >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
            lead = np.flatnonzero(np.diff(at, prepend=-1))  # s is sorted: the first in a bin is its minimum
            row[at[lead]] = s[lead]
    filled = sig != _EMPTY
    doc, bin_ = np.nonzero(~filled & filled.any(axis=1)[:, None])
    turn = 0
    while len(doc):
        turn += 1
        donor = (mix(bin_.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(turn)) % np.uint64(bins)).astype(np.int64)
        ok = filled[doc, donor]
        sig[doc[ok], bin_[ok]] = sig[doc[ok], donor[ok]]
        doc, bin_ = doc[~ok], bin_[~ok]
    return sig


def bands(sig: np.ndarray) -> np.ndarray:
    parts = sig.reshape(len(sig), BANDS, ROWS)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(ROWS):
        out = out * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k]
    return mix(out)


_SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_hi", pa.int64()), ("set_lo", pa.int64()), ("bands", pa.list_(pa.int64()))])


def _keys(sets: list[np.ndarray]) -> np.ndarray:
    """128 bits of each set."""
    return np.array([[s.sum(dtype=np.uint64), mix(s + np.uint64(7)).sum(dtype=np.uint64)] for s in sets], dtype=np.uint64).view(np.int64)


def _sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, 1):
        found = words(block, lower=True)
        sets = shingle_sets(found.hash, found.first)
        keys = _keys(sets)
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        rows = bands(signatures(sets)).view(np.int64)
        at = np.concatenate([[0], np.cumsum(np.where(sizes > 0, BANDS, 0))]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(at), pa.array(rows[sizes > 0].ravel()))
        yield pa.RecordBatch.from_arrays([block.batch.column(0), pa.array(sizes), pa.array(keys[:, 0]), pa.array(keys[:, 1]), lists], schema=_SIGNED)


def _sets(texts: pa.Array) -> list[np.ndarray]:
    """The shingle set of each text; equal texts are read once."""
    known, out = texts.dictionary_encode(), []
    for block in blocks([pa.RecordBatch.from_arrays([known.dictionary], names=["text"])], 0):
        found = words(block, lower=True)
        out += shingle_sets(found.hash, found.first)
    return [out[k] for k in known.indices.to_pylist()]


def _alike(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and 100 * both >= PERCENT * (len(x) + len(y) - both)


def _confirm(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, text_a, text_b) -> the pairs whose full sets are similar enough, each row by its own texts."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            good = [_alike(x, y) for x, y in zip(_sets(part.column(2)), _sets(part.column(3)), strict=True)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(good)) for c in part.columns[:2]], schema=schema)


def _spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> a row for each shingle of its set; key tells rows that share a doc_id apart."""
    for block in blocks(batches, 1):
        found = words(block, lower=True)
        sets = shingle_sets(found.hash, found.first)
        sizes = [len(s) for s in sets]
        ids = np.repeat(np.asarray(block.batch.column(0)), sizes)
        keys = np.repeat(_keys(sets)[:, 0], sizes)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(keys), pa.array(np.concatenate(sets).view(np.int64))], names=["id", "key", "h"])


def _pairs(x: str, y: str, n: str, m: str) -> list:
    """(a, b) with a < b, where the sizes allow a link at all."""
    least, most = F.least(n, m), F.greatest(n, m)
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")], (F.col(x) != F.col(y)) & (100 * least >= PERCENT * most)


def links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The confirmed ones of the candidate pairs. The smaller id, often a star's centre, comes last: its join splits
    a centre with very many pairs, and no later shuffle gathers the pieces."""
    rows = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    rows = rows.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    return rows.select("a", "b", "text_a", "text_b").mapInArrow(_confirm, "a long, b long")


def _intersections(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each of x with each of y, by products of incidence matrices."""
    rows = [np.repeat(np.arange(len(z)), [len(s) for s in z]) for z in (x, y)]
    values = [np.concatenate(z) for z in (x, y)]
    both = np.intersect1d(np.unique(values[0]), np.unique(values[1]), assume_unique=True)
    out = np.zeros((len(x), len(y)), dtype=np.float32)
    for lo in range(0, len(both), 2048):
        part, sides = both[lo : lo + 2048], []
        for row, value, z in zip(rows, values, (x, y), strict=True):
            at = np.minimum(np.searchsorted(part, value), len(part) - 1)
            hit = part[at] == value
            side = np.zeros((len(z), len(part)), dtype=np.float32)
            side[row[hit], at[hit]] = 1
            sides.append(side)
        out += sides[0] @ sides[1].T
    return out.astype(np.int64)


def _settle(cell: pa.Table) -> pa.Table:
    """Links between the members of two blocks of a bucket (or within one): one for two different roots."""
    sets: list[np.ndarray] = []
    for texts in cell.column("text").chunks:
        sets += _sets(texts)
    ids, roots, slot, i, j = (cell.column(c).to_numpy() for c in ("id", "root", "slot", "i", "j"))
    one, two = np.flatnonzero(slot == i), np.flatnonzero(slot == j)
    n = np.array([len(s) for s in sets])
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    if not len(one) or not len(two):
        return schema.empty_table()
    both = _intersections([sets[k] for k in one], [sets[k] for k in two])
    good = (100 * both >= PERCENT * (n[one][:, None] + n[two][None, :] - both)) & (roots[one][:, None] != roots[two][None, :]) & (both > 0)
    x, y = np.nonzero(good)
    a, b, ra, rb = ids[one[x]], ids[two[y]], roots[one[x]], roots[two[y]]
    _, first = np.unique(np.stack([np.minimum(ra, rb), np.maximum(ra, rb)]), axis=1, return_index=True)
    return pa.table([pa.array(np.minimum(a, b)[first]), pa.array(np.maximum(a, b)[first])], schema=schema)


def settled(members: DataFrame, texts: DataFrame, block: int = BLOCK) -> DataFrame:
    """All links between members (band, id, root) of one bucket with different roots: (a, b). A bucket is dealt
    to blocks, and a task holds two of them."""
    sizes = members.groupBy("band").agg(F.ceil(F.count("*") / block).cast("int").alias("k"))
    rows = members.join(sizes, "band").select("band", "id", "root", "k", F.pmod(F.xxhash64("id"), F.col("k")).cast("int").alias("slot"))
    rows = rows.join(texts.select(F.col("doc_id").alias("id"), "text"), "id").withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    cells = rows.select("band", F.least("slot", "o").alias("i"), F.greatest("slot", "o").alias("j"), "id", "root", "slot", "text")
    return cells.groupBy("band", "i", "j").applyInArrow(_settle, "a long, b long").distinct()


def components(edges: DataFrame, steps: Steps) -> DataFrame:
    """(id, root): the smallest id reachable, for every id on an edge (a, b)."""
    edges, before = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # The minima are stored before the join, so that it can split a centre with very many neighbours.
        least = steps.kept(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "minima")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = steps.kept(large, "large-star")
        steps.drop(least, edges)
        least = steps.kept(large.groupBy("u").agg(F.min("v").alias("m")), "minima")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = steps.kept(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        steps.drop(least, large)
        state = small.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return small.toDF("id", "root")
        edges, before = small, state


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row a row of docs: doc_id, n_shingles, component_id, representative_id (of its equal sets); a stored table."""
    with Steps(docs.sparkSession) as steps:
        return stored(_found(docs.select("doc_id", "text"), steps), "near-duplicates")


def _found(docs: DataFrame, steps: Steps) -> DataFrame:
    signed = steps.kept(docs.mapInArrow(_sign, "doc_id long, n_shingles long, set_hi long, set_lo long, bands array<long>"), "signed")
    real = signed.where("doc_id is not null and n_shingles > 0")
    key = ["set_hi", "set_lo", "n_shingles"]
    counted = real.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows"), F.count_distinct("doc_id").alias("ids"))
    classes = steps.kept(counted, "classes")
    if not classes.where("rows > ids").isEmpty():  # a text twice under one id: the joins below take it once
        real, docs = real.dropDuplicates(["doc_id", *key]), docs.dropDuplicates(["doc_id", "text"])
    reps = real.join(classes.select(F.col("rep").alias("doc_id"), *key), ["doc_id", *key])
    member = reps.select(F.explode("bands").alias("band"), F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), F.col("set_hi").alias("key"))
    who = lambda h: F.struct(h, F.col("id").alias("id"), F.col("n").alias("n"))
    bucket = member.groupBy("band").agg(
        F.min(F.struct("id", "n")).alias("x"), F.min(who(F.xxhash64("id").alias("h"))).alias("y"), F.min("id").alias("lo"), F.max("id").alias("hi"),
    ).where("lo <> hi")
    bucket = steps.kept(bucket, "bucket-centres")  # before the join, so that it can split a very large bucket
    inside = steps.kept(member.join(bucket, "band").select("band", "id", "n", "key", F.col("x.id").alias("c1"), F.col("x.n").alias("n1"), F.col("y.id").alias("c2"), F.col("y.n").alias("n2")), "buckets")
    steps.drop(bucket)
    (one, ok1), (two, ok2) = _pairs("id", "c1", "n", "n1"), _pairs("id", "c2", "n", "n2")
    tried = steps.kept(inside.where(ok1).select(*one).union(inside.where(ok2).select(*two)).distinct(), "stars")
    texts = steps.kept(docs.join(inside.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi"), "candidates")
    found = steps.kept(links(tried, texts), "links")
    steps.drop(tried)
    roots = components(found, steps)
    # Members of one bucket in different components that were not compared yet: no link may rest on a star's centre.
    labelled = inside.select("band", "id", "n", "key").join(roots, "id", "left").select("band", "id", "n", "key", F.coalesce("root", "id").alias("root"))
    labelled = steps.kept(labelled, "labelled")
    steps.drop(inside)
    split = labelled.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("band")
    split = steps.kept(split, "split-buckets")
    left = steps.kept(labelled.join(split, "band").select("band", "id", "n", "key", "root"), "unsettled")
    steps.drop(labelled, split)
    # What no other of them shares can't be in an intersection: an exact bound on each one's similarities.
    spread = texts.join(left.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi").mapInArrow(_spread, "id long, key long, h long")
    who = F.struct("id", "key")
    alone = spread.groupBy("h").agg(F.min(who).alias("who"), F.max(who).alias("other")).where("who = other").groupBy("who.id", "who.key").agg(F.count("*").alias("alone"))
    open_ = left.join(alone, ["id", "key"], "left").withColumn("m", F.col("n") - F.coalesce("alone", F.lit(0))).where(100 * F.col("m") >= PERCENT * F.col("n"))
    open_ = steps.kept(open_.select("band", "id", "root"), "open")
    more = steps.kept(settled(open_, texts), "late-links")
    steps.drop(left, open_, texts)
    if not more.isEmpty():
        roots = components(found.union(more), steps)
    members = real.select("doc_id", *key).join(classes, key).select("doc_id", "rep").groupBy("doc_id").agg(F.min("rep").alias("rep"))
    out = members.join(roots, members.rep == roots.id, "left")
    out = out.select("doc_id", "rep", F.coalesce("root", "rep").alias("root"))
    rows = signed.select("doc_id", "n_shingles").join(out, "doc_id", "left")
    return rows.select(
        "doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"),
        F.coalesce("rep", "doc_id").alias("representative_id"),
    )


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return found.select("doc_id", "n_shingles", "component_id", kept.alias("kept"), "representative_id")


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component, the document with the smallest id stays."""
    found = near_duplicates(docs)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
