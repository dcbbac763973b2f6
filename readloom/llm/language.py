"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are folded to small letters, everything else to blanks; runs of one to three characters are hashed into
DIMENSIONS counts. Training is follow-the-regularised-leader (per-coordinate steps, elastic-net penalty)
on a bounded sample of labelled rows, on the driver; a temperature is then fitted on the part of the sample
that training did not see. Predictions read every whole text, block by block.

The sample has at most about SAMPLE documents, dealt evenly to the languages by a hash of the id, and never over twice
that, also where many rows share an id. Of a column with more than LANGUAGES values the most frequent are learned (ties
by name). Only these two are bounded, and what the sample holds of a text is its counts.

Defined cases: text that is null or has no letter: `und` with score 0, so also everything where no language
can be learned; null labels are not learned from; a null doc_id is never held out nor learned from;
repeated rows are judged alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SAMPLE, LANGUAGES, DIMENSIONS, EPOCHS, FOLDS, HELD_OUT = 4000, 256, 1 << 14, 3, 4, 2
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 0.1
UNDETERMINED = "und"
_LETTER = np.array([chr(c).isalpha() for c in range(1 << 16)])


def counts(text: str | None) -> np.ndarray | None:
    """How often each hashed n-gram occurs; None without letters."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    letter = _LETTER[np.minimum(codes, 0xFFFF)] & (codes < 1 << 16)
    if not letter.any() and not any(chr(c).isalpha() for c in codes[codes >= 1 << 16]):
        return None
    c = np.where(letter | (codes >= 1 << 16), codes, np.uint32(32))
    grams = [c * np.uint32(2654435761)]
    if len(c) > 1:
        grams.append((c[:-1] * np.uint32(40503) + c[1:]) * np.uint32(2246822519) + np.uint32(1))
    if len(c) > 2:
        grams.append(((c[:-2] * np.uint32(40503) + c[1:-1]) * np.uint32(65599) + c[2:]) * np.uint32(3266489917) + np.uint32(2))
    return sum(np.bincount(g >> np.uint32(18), minlength=DIMENSIONS) for g in grams)


@dataclass
class Model:
    """FTRL state is kept, so that training can go on."""

    languages: list[str]
    idf: np.ndarray
    temperature: float = 1.0
    z: np.ndarray = field(init=False)
    n: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        shape = (len(self.idf) + 1, len(self.languages))
        self.z, self.n = np.zeros(shape), np.zeros(shape)

    def _vector(self, at: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = (1 + np.log(tf)) * self.idf[at]
        return np.append(at, len(self.idf)), np.append(x / np.sqrt((x * x).sum()), 1.0)

    def _weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, tf: np.ndarray, language: int) -> None:
        at, x = self._vector(at, tf)
        w = self._weights(at)
        logits = x @ w
        p = np.exp(logits - logits.max())
        p /= p.sum()
        p[language] -= 1
        g = x[:, None] * p
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] += g * g

    def freeze(self) -> Model:
        self.w = self._weights(slice(None)).astype(np.float32)
        return self

    def logits(self, at: np.ndarray, tf: np.ndarray) -> np.ndarray:
        at, x = self._vector(at, tf)
        return x @ self.w[at]

    def calibrate(self, examples: list[tuple[np.ndarray, np.ndarray, int]]) -> None:
        """The temperature of least log loss, by golden-section search over its logarithm."""
        if not examples:
            return
        rows, truth = np.array([self.logits(a, t) for a, t, _ in examples]), np.array([y for *_, y in examples])

        def loss(log_t: float) -> float:
            s = rows / np.exp(log_t)
            s -= s.max(axis=1, keepdims=True)
            return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), truth]).mean())

        low, high, g = -1.5, 3.0, (5**0.5 - 1) / 2
        for _ in range(40):
            a, b = high - g * (high - low), low + g * (high - low)
            low, high = (low, b) if loss(a) < loss(b) else (a, high)
        self.temperature = float(np.exp((low + high) / 2))

    def predict(self, text: str | None) -> tuple[str, float]:
        tf = counts(text) if self.languages else None
        if tf is None:
            return UNDETERMINED, 0.0
        at = np.flatnonzero(tf)
        s = self.logits(at, tf[at]) / self.temperature
        p = np.exp(s - s.max())
        best = int(p.argmax())
        return self.languages[best], float(p[best] / p.sum())


def train(examples: list[tuple[np.ndarray, np.ndarray, str]]) -> Model:
    """Of (n-gram numbers, their counts, language), in the order given; every fifth calibrates."""
    languages = sorted({y for *_, y in examples})
    number = {y: i for i, y in enumerate(languages)}
    df = np.zeros(DIMENSIONS)
    for at, *_ in examples:
        df[at] += 1
    model = Model(languages, np.log((1 + len(examples)) / (1 + df)) + 1)
    held = examples[::5] if len(examples) >= 50 else []
    seen = [x for i, x in enumerate(examples) if not held or i % 5]
    for _ in range(EPOCHS):
        for at, tf, y in seen:
            model.learn(at, tf, number[y])
    model.freeze().calibrate([(at, tf, number[y]) for at, tf, y in held])
    model.z = model.n = None  # predictions need the weights alone
    return model


def fold() -> Column:
    return F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % FOLDS


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("h", pa.int64()), ("lang", pa.string()), ("at", pa.binary()), ("tf", pa.binary())])
    for batch in batches:
        rows = []
        for i in range(batch.num_rows):
            tf = counts(batch.column(2)[i].as_py())
            if tf is not None:
                at = np.flatnonzero(tf)
                rows.append((batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), at.astype("<u2").tobytes(), tf[at].astype("<u4").tobytes()))
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    known = docs.where((fold() != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    totals = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    if not totals:
        return Model([], np.zeros(DIMENSIONS))
    each = max(1, sample // len(totals))
    share = F.create_map(*[F.lit(x) for r in totals for x in (r.lang, min(1.0, each / r["count"]))])
    h = F.xxhash64("doc_id", F.lit("train"))
    picked = known.where(F.pmod(h, F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30)).select(h.alias("h"), "lang", "text")
    counted = picked.mapInArrow(_count, "h long, lang string, at binary, tf binary")
    rows = counted.orderBy("h", "lang", "at", "tf").limit(2 * sample).collect()
    return train([(np.frombuffer(r["at"], "<u2").astype(np.int64), np.frombuffer(r.tf, "<u4").astype(np.float64), r.lang) for r in rows])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # DIMENSIONS numbers a language
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [sent.value.predict(text.as_py()) for text in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], schema=schema)

    rows = docs.select("doc_id", F.coalesce(fold() == HELD_OUT, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return identify(docs, fit(docs))
