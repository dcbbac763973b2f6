"""Incremental removal of repeated passages with a log-structured fingerprint index.

Every window of WINDOW words is filed under its anchor: the smallest hash among the GRAM-word grams in it,
the leftmost on ties. Equal windows have equal anchors, and neighbouring windows share them, so the index
holds a hash for about one word in eight and yet misses no window. A batch of documents becomes one
immutable run: a table bucketed and sorted by anchor hash. A new batch's anchors are merge-joined with the
runs of earlier batches; a window can only repeat where its anchor is live, i.e. occurs in history or twice
in the batch. Windows under live anchors are read again from the texts and compared by the SHA-256 of their words
(its first 128 bits; the verification); all but the first of equal ones are covered. When FAN_IN
runs have gathered, they are merged into one. Runs are in the shared folder and go when the index is closed.

Documents whose whole word sequence an earlier document has are settled by its SHA-256 and leave no
fingerprints. Batches come in order of doc_id.

Defined cases: null or empty text has no words; fewer than WINDOW words: nothing is removed; a null doc_id:
nothing is removed and nothing counts as its repetition; very long texts are read one at a time, whole; rows that share a doc_id count as one document (none
is earlier than the other; what is removed from one is removed from all at the same places); an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Steps, deleted, freed_shuffles, shared_dir, stored, table
from .vecwords import Words, blocks, windows, words

WINDOW, GRAM, FAN_IN, BATCHES = 20, 6, 4, 2
_WIDTH = WINDOW - GRAM + 1


def anchors(found: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows within one text, the word at which each one's anchor begins, and all gram hashes."""
    n = len(found.hash) - WINDOW + 1
    doc = found.doc()
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    grams = windows(found.hash, GRAM)
    least, span = grams, 1
    while span * 2 <= _WIDTH:
        least, span = np.minimum(least[: len(least) - span], least[span:]), span * 2
    least = np.minimum(least[:n], least[_WIDTH - span : _WIDTH - span + n])
    at = np.zeros(n, dtype=np.int64)
    for j in range(_WIDTH - 1, -1, -1):
        at[grams[j : j + n] == least] = j
    starts = np.flatnonzero(doc[:n] == doc[WINDOW - 1 :])
    return starts, starts + at[starts], grams


def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("sha", pa.binary()), ("h", pa.list_(pa.int64())), ("pos", pa.list_(pa.int32()))])
    for block in blocks(batches, 1):
        found = words(block)
        _, at, grams = anchors(found)
        at = np.unique(at)
        cut = np.searchsorted(at, found.first)
        own = (at - np.repeat(found.first[:-1], np.diff(cut))).astype(np.int32)
        lists = pa.array(cut.astype(np.int32))
        raw = block.data.tobytes()
        shas = [hashlib.sha256(b" ".join(raw[a:b].split())).digest() for a, b in zip(block.at[:-1], block.at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [block.batch.column(0), pa.array(np.diff(found.first)), pa.array(shas, pa.binary()), pa.ListArray.from_arrays(lists, pa.array(grams[at].view(np.int64))), pa.ListArray.from_arrays(lists, pa.array(own))],
            schema=schema,
        )


def _live(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, live anchors) -> digest (two halves) and start of each window filed under one of them."""
    schema = pa.schema([("w1", pa.int64()), ("w2", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int32())])
    for block in blocks(batches, 1):
        found = words(block)
        starts, at, _ = anchors(found)
        live = np.zeros(len(found.hash) + 1, dtype=bool)
        for i, places in enumerate(block.batch.column(2)):
            p = np.asarray(places.values) + found.first[i]
            live[p[p < found.first[i + 1]]] = True
        starts = starts[live[at]]
        doc = found.doc()[starts]
        ids, own = np.asarray(block.batch.column(0))[doc], (starts - found.first[doc]).astype(np.int32)
        raw = block.data.tobytes()
        joined = b" ".join([raw[a:b] for a, b in zip(found.starts.tolist(), found.ends.tolist(), strict=True)])
        begin = np.concatenate([[0], np.cumsum(found.ends - found.starts + 1)])
        for lo in range(0, len(starts), 1 << 16):
            s = starts[lo : lo + (1 << 16)]
            spans = zip(begin[s].tolist(), (begin[s + WINDOW] - 1).tolist(), strict=True)
            digests = np.frombuffer(b"".join([hashlib.sha256(joined[a:b]).digest()[:16] for a, b in spans]), dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array(ids[lo : lo + len(s)]), pa.array(own[lo : lo + len(s)])], schema=schema)


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, starts of covered windows) -> digest of all words, words removed, digest and text of what is kept."""
    schema = pa.schema([("doc_id", pa.int64()), ("sha", pa.binary()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])
    for block in blocks(batches, 1):
        raw, out = block.data.tobytes(), []
        for i, places in enumerate(block.batch.column(2)):
            own = raw[block.at[i] : block.at[i + 1]].split()
            keep = kept_words(len(own), np.asarray(places.values))
            text = b" ".join([w for w, k in zip(own, keep.tolist(), strict=True) if k])
            whole = hashlib.sha256(b" ".join(own)).digest()
            out.append((block.batch.column(0)[i].as_py(), whole, int(len(own) - keep.sum()), hashlib.sha256(text).hexdigest(), text.decode()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)


def kept_words(n: int, starts: np.ndarray) -> np.ndarray:
    """True for each of n words that no window beginning at one of starts covers."""
    steps = np.zeros(n + WINDOW + 1, dtype=np.int64)
    starts = starts[starts <= n - WINDOW]
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + WINDOW, -1)
    return np.cumsum(steps)[:n] == 0


class FingerprintIndex:
    """Runs of anchor hashes (h, doc_id, pos) and the digests of whole texts (sha, doc_id)."""

    def __init__(self, spark: SparkSession, buckets: int | None = None):
        self.spark, self.name = spark, f"readloom_{uuid.uuid4().hex}"
        #: Equal to the number of shuffle partitions, a run is joined as it lies.
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[str] = []
        self.paths: dict[str, str] = {}
        self.texts: list[DataFrame] = []
        self.made = 0
        self.steps = Steps(spark)

    def _write(self, rows: DataFrame) -> str:
        self.made += 1
        name = f"{self.name}_run_{self.made}"
        self.paths[name] = shared_dir(self.spark, "run")
        with freed_shuffles(self.spark):
            rows.write.option("path", self.paths[name]).bucketBy(self.buckets, "h").sortBy("h").saveAsTable(name, format="parquet")
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        deleted(self.spark, self.paths.pop(name))

    def ingest(self, batch: DataFrame, archive: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Adds a batch (doc_id, text), all later than what is indexed; archive: all documents up to now.

        Returns facts (doc_id, n_words, sha, copied) and covered (doc_id, starts)."""
        scanned = self.steps.kept(batch.mapInArrow(_scan, "doc_id long, n_words long, sha binary, h array<long>, pos array<int>"), "scanned")
        real = scanned.where(f"doc_id is not null and n_words >= {WINDOW}")
        first = real.groupBy("sha").agg(F.min("doc_id").alias("first"))
        known = F.lit(None).cast("long")
        for i, texts in enumerate(self.texts):
            first = first.join(texts.select("sha", F.col("doc_id").alias(f"old{i}")), "sha", "left")
            known = F.coalesce(F.col(f"old{i}"), known)
        first = self.steps.kept(first.select("sha", F.coalesce(known, "first").alias("first"), known.isNull().alias("new")), "firsts")
        facts = scanned.select("doc_id", "n_words", "sha").join(first.select("sha", "first"), "sha", "left").select(
            "doc_id", "n_words", "sha", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("copied"))
        fresh = first.where("new").select(F.col("first").alias("doc_id"))
        pairs = scanned.join(fresh, "doc_id").select("doc_id", F.explode(F.arrays_zip("h", "pos")).alias("x")).select("x.h", "doc_id", "x.pos")
        live = pairs.groupBy("h").agg(F.count("*").alias("n"))
        old = F.lit(False)
        for i, run in enumerate(self.runs):
            live = live.join(self.spark.table(run).groupBy("h").agg(F.lit(True).alias(f"in{i}")), "h", "left")
            old = old | F.coalesce(F.col(f"in{i}"), F.lit(False))
        # Stored before the join, so that it can split an anchor that very many documents have.
        live = self.steps.kept(live.select("h", "n", old.alias("old")).where("n > 1 or old").select("h", "old"), "live")
        run = self._write(pairs.join(live, "h", "left").select("h", "doc_id", "pos", F.col("old").isNotNull().alias("live"), F.coalesce("old", F.lit(False)).alias("old")))
        new = self.spark.table(run)
        places = new.where("live").select("doc_id", "pos")
        for earlier in self.runs:
            places = places.union(self.spark.table(earlier).join(new.where("old").groupBy("h").agg(F.lit(True).alias("hit")), "h", "left_semi").select("doc_id", "pos"))
        self.steps.drop(live)
        covered = self._covered(places, archive, batch)
        self.texts.append(first.where("new").select("sha", F.col("first").alias("doc_id")))
        self.runs.append(run)
        if len(self.runs) >= FAN_IN:
            self.compact()
        return facts, covered

    def _covered(self, places: DataFrame, archive: DataFrame, batch: DataFrame) -> DataFrame:
        """Verification: equal windows under live anchors, all but the first of each; only the batch's count."""
        by_doc = places.groupBy("doc_id").agg(F.collect_list("pos").alias("pos"))  # at most the words of one document
        texts = archive.select("doc_id", "text").join(by_doc, "doc_id").select("doc_id", "text", "pos")
        found = self.steps.kept(texts.mapInArrow(_live, "w1 long, w2 long, doc_id long, start int"), "windows")
        firsts = found.groupBy("w1", "w2").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("n")).where("n > 1")
        # Stored before the join, so that it can split a window that very many documents share.
        firsts = self.steps.kept(firsts.select("w1", "w2", F.col("first.doc_id").alias("d"), F.col("first.start").alias("s")), "first-windows")
        again = found.join(firsts, ["w1", "w2"]).where("doc_id > d or doc_id = d and start > s")
        again = again.groupBy("doc_id").agg(F.collect_set("start").alias("starts"))
        low = batch.agg(F.min("doc_id")).first()[0]
        out = self.steps.kept(again.where(F.col("doc_id") >= F.lit(low).cast("long")), "covered")
        self.steps.drop(found, firsts)
        return out

    def compact(self) -> None:
        """Merges all runs into one."""
        merged = self.spark.table(self.runs[0])
        for run in self.runs[1:]:
            merged = merged.union(self.spark.table(run))
        new = self._write(merged.repartition(self.buckets, "h"))
        for run in self.runs:
            self._drop(run)
        self.runs = [new]

    def close(self) -> None:
        """Runs and stored steps go, also those of a batch that failed; what ingest returned can't be read any more."""
        for run in list(self.paths):
            self._drop(run)
        self.runs = []
        self.steps.__exit__()

    def __enter__(self) -> FingerprintIndex:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


def dedup(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """One row a row of docs: doc_id, n_words, n_removed, kept_sha256, copied. Runs the index over batches
    of consecutive ids; the result is a stored table."""
    spark, docs = docs.sparkSession, docs.select("doc_id", "text")
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    cuts = [low + (high - low + 1) * k // batches for k in range(1, batches)] if low is not None else []
    facts, covered, before = None, None, F.col("doc_id").isNull()
    with FingerprintIndex(spark) as index:
        for i, cut in enumerate([*cuts, None]):
            until = F.col("doc_id") < cut if cut is not None else F.lit(True)
            own = (F.col("doc_id") >= cuts[i - 1] if i else F.lit(True)) & until
            own = own | before if i == 0 else own
            one, two = index.ingest(docs.where(own), docs.where(until))
            facts, covered = (one, two) if facts is None else (facts.union(one), covered.union(two))
        texts = docs.join(covered, "doc_id").select("doc_id", "text", "starts")
        kept = texts.mapInArrow(_cut, "doc_id long, sha binary, n_removed long, kept_sha256 string, kept_text string").drop("kept_text")
        kept = kept.groupBy("doc_id", "sha").agg(F.max("n_removed").alias("n_removed"), F.max("kept_sha256").alias("kept_sha256"))
        nothing = hashlib.sha256(b"").hexdigest()
        return stored(facts.join(kept, ["doc_id", "sha"], "left").select(
            "doc_id", "n_words",
            F.when(F.col("copied"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
            F.when(F.col("copied"), F.lit(nothing)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("sha")))).alias("kept_sha256"),
            "copied",
        ), "passages")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))
