"""Words of whole texts and their 64-bit hashes, a block of documents at a time, without a Python loop over words.

A word's hash is the beginning of the SHA-256 of its bytes. Each distinct word of a block is hashed once, so that the
time goes into finding and encoding words, and no structure of the letters makes two words agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 4 << 20
_U = np.uint64
_M1, _M2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_FACTORS = (_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F))
_SEP = np.zeros(256, dtype=bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(30))
    h *= _M1
    h ^= h >> _U(27)
    h *= _M2
    h ^= h >> _U(31)
    return h


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """The hash of data[s:e] for each pair of the sorted, disjoint, non-empty spans; lower: A-Z count as a-z."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    step = np.zeros(len(data) + 1, dtype=np.int8)
    step[starts] = 1
    step[ends] -= 1
    inside = data[np.cumsum(step[:-1], dtype=np.int8).view(bool)]
    at = np.concatenate([[0], np.cumsum(ends - starts)])
    buffers = [None, pa.py_buffer(at), pa.py_buffer(_LOWER[inside] if lower else inside)]
    found = pa.Array.from_buffers(pa.large_binary(), len(starts), buffers).dictionary_encode()
    n = len(found.dictionary)
    _, offsets, values = found.dictionary.buffers()
    cut, raw = np.frombuffer(offsets, dtype=np.int64)[: n + 1].tolist(), values.to_pybytes()
    digests = b"".join([hashlib.sha256(raw[a:b]).digest()[:8] for a, b in zip(cut[:-1], cut[1:], strict=True)])
    return np.frombuffer(digests, dtype=np.uint64)[np.asarray(found.indices)]


@dataclass
class Block:
    """Some rows of a record batch and the bytes of their texts."""

    batch: pa.RecordBatch
    data: np.ndarray  # uint8
    at: np.ndarray  # where each text begins and the last ends


def blocks(batches: Iterable[pa.RecordBatch], column: int, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Slices of at most limit bytes of text, or one longer text. Null texts are empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(column).cast(pa.large_binary()).fill_null(b"")
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
        i = 0
        while i < len(texts):
            j = min(len(texts), max(i + 1, int(np.searchsorted(at, at[i] + limit, side="right")) - 1))
            yield Block(batch.slice(i, j - i), raw[at[i] : at[j]], at[i : j + 1] - at[i])
            i = j


@dataclass
class Words:
    hash: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # number of the first word of each text, and the number of all words

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def spans(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, none crossing from one text into the next; first as in Words."""
    n = len(inside)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(at), dtype=np.int64)
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    edges = at[(at > 0) & (at < n)]
    begin[edges] = inside[edges]
    end[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, at)


def words(block: Block, lower: bool = False) -> Words:
    """The maximal runs of bytes that are not ASCII white space; lower: A-Z count as a-z."""
    starts, ends, first = spans(~_SEP[block.data], block.at)
    return Words(hash_spans(block.data, starts, ends, lower), starts, ends, first)


def windows(h: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """The hash of each n consecutive hashes (also across texts: the caller masks those)."""
    size = len(h) - n + 1
    if size <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(size, seed + n, dtype=np.uint64)
    factor = _FACTORS[seed]
    for j in range(n):
        out *= factor
        out += h[j : j + size]
    return mix(out)
