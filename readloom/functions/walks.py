"""The per-character functions on sequences and qualities as walks over bytes: a batch of rows at a time, in numpy.

They hold for texts of one byte a character; the Column functions beside them in bases and quality are the general form,
which all other rows take. An odd row reaches a walk as a null, which it reads as an empty text.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def plain(*texts: Column) -> Column:
    """All are ASCII; null where one is null."""
    out = None
    for x in texts:
        same = F.octet_length(x) == F.length(x)
        out = same if out is None else out & same
    return out


def raw(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts one after the other, and where each begins, with the end of the last; a null is empty."""
    text = text.cast(pa.large_binary()).fill_null(b"")
    if not len(text):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = text.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[text.offset : text.offset + len(text) + 1]
    out = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, dtype=np.uint8)
    return out, at - at[0]


def texts(data: np.ndarray, at: np.ndarray, kind: pa.DataType, none: np.ndarray | None = None) -> pa.Array:
    """Inverse of raw; none: the rows that are null."""
    known = None if none is None or not none.any() else pa.py_buffer(np.packbits(~none, bitorder="little").tobytes())
    return pa.Array.from_buffers(kind, len(at) - 1, [known, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def ends(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each span, one after the other."""
    return np.repeat(starts - ends(sizes)[:-1], sizes) + np.arange(int(sizes.sum()))


def numbers(column: pa.Array) -> np.ndarray:
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


#: Letters to capitals, what is none of the four bases to A; the same as codes; codes of a byte to its four bases.
NORMAL = np.full(256, ord("A"), dtype=np.uint8)
NORMAL[np.frombuffer(b"ACGTacgt", dtype=np.uint8)] = np.frombuffer(b"ACGTACGT", dtype=np.uint8)
CODE = np.zeros(256, dtype=np.uint8)
CODE[np.frombuffer(b"ACGTacgt", dtype=np.uint8)] = [0, 1, 2, 3, 0, 1, 2, 3]
FOUR = np.frombuffer(b"ACGT", dtype=np.uint8)[np.arange(256)[:, None] >> np.array([6, 4, 2, 0]) & 3]


def pack(codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of rows of these sizes as bytes of four codes each, the last of a row filled with zeros, and where each row begins."""
    held = ends(-(-sizes // 4))
    four = np.zeros(4 * held[-1], dtype=np.uint8)
    four[spans(4 * held[:-1], sizes)] = codes
    four = four.reshape(-1, 4)
    return four[:, 0] << 6 | four[:, 1] << 4 | four[:, 2] << 2 | four[:, 3], held


def _pack(seq: pa.Array) -> pa.Array:
    data, at = raw(seq)
    return texts(*pack(CODE[data], np.diff(at)), pa.binary())


def _unpack(payload: pa.Array, length: pa.Array) -> pa.Array:
    data, at = raw(payload)
    sizes = np.clip(numbers(length), 0, 4 * np.diff(at))
    return texts(FOUR[data].reshape(-1)[spans(4 * at[:-1], sizes)], ends(sizes), pa.string())


def _key(seq: pa.Array, end: pa.Array, width: pa.Array) -> pa.Array:
    data, at = raw(seq)
    end, width = np.minimum(numbers(end), np.diff(at)), numbers(width)
    sizes, out = np.minimum(np.diff(at) - end, width), ends(width)
    key = np.full(out[-1], ord("A"), dtype=np.uint8)
    key[spans(out[:-1], sizes)] = NORMAL[data[spans(at[:-1] + end, sizes)]]
    return texts(key, out, pa.string())


def _arrow(f: Callable, kind: str, *columns: Column) -> Column:
    return F.arrow_udf(f, kind)(*columns)


def packed(seq: Column, slow: Column) -> Column:
    """Two bits a base, as bytes."""
    ok = plain(seq)
    return F.when(ok, _arrow(_pack, "binary", F.when(ok, seq))).otherwise(slow)


def unpacked(payload: Column, length: Column) -> Column:
    """Inverse of packed for a known number of bases."""
    return _arrow(_unpack, "string", payload, length)


def sort_key(seq: Column, core: Column, end: Column, width: Column, slow: Column) -> Column:
    n = F.length(seq)
    ok = plain(seq) & (((end == 0) & (width == n)) | ((end >= F.length(core)) & (end > 0) & (end <= n) & (width == n - F.length(core))))
    return F.when(ok, _arrow(_key, "string", F.when(ok, seq), end, F.when(ok, width).otherwise(0))).otherwise(slow)


def alike(one: Column, two: Column) -> Column:
    """Both are plain and of one length; null where one is null."""
    return plain(one, two) & (F.length(one) == F.length(two))


def both(f: Callable[[np.ndarray, np.ndarray], np.ndarray], one: Column, two: Column, slow: Column) -> Column:
    """A text of f of the bytes of two texts of one length."""
    ok = alike(one, two)

    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        (x, at), (y, _) = raw(a), raw(b)
        return texts(f(x, y), at, pa.string())

    return F.when(ok, _arrow(run, "string", F.when(ok, one), F.when(ok, two))).otherwise(slow)


def where(symbol: str, put: str, seq: Column, qual: Column, slow: Column) -> Column:
    """seq with one character wherever qual has another."""
    a, b = ord(symbol), np.uint8(ord(put))
    return both(lambda x, y: np.where(y == a, b, x), seq, qual, slow)


def restored(payload: Column, length: Column, core: Column, end: Column, qual: Column, symbol: str) -> Column:
    """The read of a packed payload without its core, and N wherever a quality of the read's length has the symbol."""
    low = ord(symbol)

    def run(payload: pa.Array, length: pa.Array, core: pa.Array, end: pa.Array, qual: pa.Array) -> pa.Array:
        (data, p), (cores, c), (quals, q) = raw(payload), raw(core), raw(qual)
        size, end = np.diff(c), numbers(end)
        kept = np.clip(numbers(length) - size, 0, 4 * np.diff(p))
        tail = np.where(end > 0, kept + size - end, kept)
        letters, out = FOUR[data].reshape(-1), ends(kept + np.where(end > 0, size, 0))
        # What precedes the core, the core, what follows it; the payload holds the last of them first.
        seq = np.empty(out[-1], dtype=np.uint8)
        head = kept - tail
        seq[spans(out[:-1], head)] = letters[spans(4 * p[:-1] + tail, head)]
        seq[spans(out[:-1] + head, size * (end > 0))] = cores[spans(c[:-1], size * (end > 0))]
        seq[spans(out[1:] - tail, tail)] = letters[spans(4 * p[:-1], tail)]
        same = np.diff(q) * (np.diff(q) == np.diff(out))
        masked = spans(out[:-1], same)
        seq[masked[quals[spans(q[:-1], same)] == low]] = ord("N")
        return texts(seq, out, pa.string())

    return _arrow(run, "string", payload, length, core, end, F.when(plain(qual), qual))
