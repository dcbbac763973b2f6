"""Vector bin packing of token sequences by the dot-product heuristic.

Every piece asks for tokens, one segment and loss-bearing tokens; a sequence has a limit on each. The open
sequence takes, among the waiting pieces that fit, the one whose demand has the largest dot product with
what the sequence has left (both as shares of the limits). When none fits, a piece is cut to fill the rest.
Whole sequences cut from long documents never wait. Each task packs what it reads, with a bounded number
of pieces waiting, so nothing is shuffled and memory does not depend on the input; what is left at the end
of a task goes into sequences whose lengths are powers of two, which need no padding.

In instruction data the turns of the assistant bear loss: pack_conversations has a limit of its own on their tokens. Of
plain documents all tokens bear loss.

Defined cases: null and empty texts are the end token alone; very long texts are cut into whole sequences; null ids pass
through; a null in the column of loss bears none; repeated rows are packed each; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

VOCABULARY, END = "byte_bpe_50k", 1
LENGTH, SEGMENTS, WAITING = 2048, 512, 1024
COLUMNS = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens")


@dataclass
class Piece:
    key: object
    ids: np.ndarray
    total: int
    start: int = 0
    loss: np.ndarray | None = None  # None: every token bears loss

    @property
    def lossy(self) -> int:
        return len(self.ids) if self.loss is None else int(self.loss.sum())

    def cut(self, n: int) -> tuple[Piece, Piece]:
        one, two = (None, None) if self.loss is None else (self.loss[:n], self.loss[n:])
        return Piece(self.key, self.ids[:n], self.total, self.start, one), Piece(self.key, self.ids[n:], self.total, self.start + n, two)


@dataclass
class Packer:
    """Takes pieces, yields sequences (lists of pieces)."""

    tokens: int = LENGTH
    segments: int = SEGMENTS
    loss_tokens: int = LENGTH
    waiting: int = WAITING
    cuts: bool = True
    pool: list[Piece | None] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.limits = np.array([self.tokens, self.segments, self.loss_tokens], dtype=np.float64)
        self.demand = np.zeros((self.waiting, 3))
        self.pool = [None] * self.waiting
        self.free = list(range(self.waiting))[::-1]

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        if self.cuts:
            while len(piece.ids) > self.tokens or piece.lossy > self.loss_tokens:
                head, piece = piece.cut(self._most(piece, self.tokens, self.loss_tokens))
                if len(head.ids) == self.tokens:
                    yield [head]
                else:
                    yield from self._wait(head)
        elif len(piece.ids) > self.tokens or piece.lossy > self.loss_tokens:
            raise ValueError(f"{piece.key}: an example over the limits can't be packed whole")
        if len(piece.ids) == self.tokens:
            yield [piece]
        elif len(piece.ids):
            yield from self._wait(piece)

    def _wait(self, piece: Piece) -> Iterator[list[Piece]]:
        if not self.free:
            yield self._fill()
        slot = self.free.pop()
        self.pool[slot] = piece
        self.demand[slot] = (len(piece.ids), 1, piece.lossy)

    @staticmethod
    def _most(piece: Piece, tokens: float, loss: float) -> int:
        """The longest prefix within both limits."""
        if piece.loss is None:
            return int(min(tokens, loss))
        return int(min(tokens, np.searchsorted(np.cumsum(piece.loss), loss, side="right")))

    def _take(self, slot: int) -> Piece:
        piece, self.pool[slot] = self.pool[slot], None
        self.demand[slot] = 0
        self.free.append(slot)
        return piece

    def _fill(self) -> list[Piece]:
        left, out = self.limits.copy(), []
        while True:
            fits = (self.demand[:, 0] > 0) & (self.demand <= left).all(axis=1)
            if not fits.any():
                break
            score = np.where(fits, (self.demand / self.limits) @ (left / self.limits), -1.0)
            slot = int(score.argmax())
            left -= self.demand[slot]
            out.append(self._take(slot))
        if self.cuts and left.min() >= 1 and self.demand[:, 0].any():
            slot = int(self.demand[:, 0].argmax())
            head = self._most(self.pool[slot], left[0], left[2])
            if head:
                one, two = self._take(slot).cut(head)
                out.append(one)
                slot = self.free.pop()
                self.pool[slot], self.demand[slot] = two, (len(two.ids), 1, two.lossy)
        return out

    def finish(self) -> Iterator[list[Piece]]:
        while self.demand[:, 0].any():
            out = self._fill()
            length = sum(len(p.ids) for p in out)
            if not self.cuts or length == self.tokens or self.demand[:, 0].any():
                yield out
            else:
                yield from self._powers(out, length)

    @staticmethod
    def _powers(pieces: list[Piece], length: int) -> Iterator[list[Piece]]:
        """The last, short sequence as one for each binary digit of its length."""
        queue = pieces[::-1]
        for bit in range(length.bit_length() - 1, -1, -1):
            room, out = length & (1 << bit), []
            while room:
                piece = queue.pop()
                if len(piece.ids) > room:
                    piece, rest = piece.cut(room)
                    queue.append(rest)
                room -= len(piece.ids)
                out.append(piece)
            if out:
                yield out


@cache
def encoder(name: str = VOCABULARY):
    """text -> ids (numpy), those that `tokenizers` gives with the vocabulary's JSON file and its defaults.

    The same vocabulary's ranks file is read by tiktoken, which is several times as fast. A text that holds an added
    token (one with an id of its own, such as an end mark) or on which tiktoken gives up goes through `tokenizers` itself."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    path = public_tokenizers.path(f"{name}.json")
    with open(path, encoding="utf-8") as f:
        described = json.load(f)
    vocabulary, added = described["model"]["vocab"], [x["content"] for x in described["added_tokens"]]
    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    if described["normalizer"] is not None or any(vocabulary.get(x) != ranks[x.encode()] for x in ("the", "a", "!", "ing")):
        raise ValueError(f"{name}: its two files differ")
    fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    slow = cache(lambda: Tokenizer.from_file(path))

    def encode(text: str) -> np.ndarray:
        if not any(token in text for token in added):
            try:
                return np.asarray(fast.encode_to_numpy(text, disallowed_special=()), dtype="<u4")
            except (ValueError, RuntimeError):
                pass
        return np.asarray(slow().encode(text, add_special_tokens=False).ids, dtype="<u4")

    return encode


def _row(piece: Piece, sequence: int, offset: int) -> tuple:
    return (*piece.key, piece.start, len(piece.ids), zlib.crc32(piece.ids.tobytes()), piece.total, sequence, offset, piece.lossy)


def _packed(batches: Iterable[pa.RecordBatch], keys: tuple[str, ...], options: dict, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """Rows (keys, text, whether it bears loss)."""
    encode, packer = encoder(), Packer(**options)
    base, rows, ids = TaskContext.get().partitionId() << 40, [], []
    count = 0
    types = [(x, pa.int64()) for x in (*keys, *COLUMNS)]
    schema = pa.schema(types + [("ids", pa.list_(pa.int32()))] * with_ids)

    def put(sequences: Iterable[list[Piece]]) -> None:
        nonlocal count
        for pieces in sequences:
            offset = 0
            for piece in pieces:
                rows.append(_row(piece, base + count, offset))
                if with_ids:
                    ids.append(piece.ids.astype(np.int32))
                offset += len(piece.ids)
            count += 1

    def flush() -> pa.RecordBatch:
        columns = [list(c) for c in zip(*rows, strict=True)] or [[] for _ in types]
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, types, strict=True)] + [pa.array(ids, pa.list_(pa.int32()))] * with_ids, schema=schema)
        rows.clear()
        ids.clear()
        return out

    for batch in batches:
        texts, bears = batch.column(len(keys)), batch.column(len(keys) + 1)
        for i, key in enumerate(zip(*(c.to_pylist() for c in batch.columns[: len(keys)]), strict=True)):
            got = np.append(encode(texts[i].as_py() or ""), np.uint32(END)).astype("<u4")
            put(packer.add(Piece(key, got, len(got), loss=None if bears[i].as_py() else np.zeros(len(got), dtype=bool))))
            if len(rows) >= 4096:
                yield flush()
    put(packer.finish())
    yield flush()


def _pack(rows: DataFrame, keys: tuple[str, ...], limits: dict[str, int], with_ids: bool) -> DataFrame:
    schema = ", ".join(f"{x} long" for x in (*keys, *COLUMNS)) + ", ids array<int>" * with_ids
    return rows.mapInArrow(lambda batches: _packed(batches, keys, limits, with_ids), schema)


def pack_documents(docs: DataFrame, with_ids: bool = False, **limits: int) -> DataFrame:
    """A row a piece; sequence_id has the task's number in its high bits. with_ids adds the token ids."""
    return _pack(docs.select("doc_id", "text", F.lit(True)), ("doc_id",), limits, with_ids)


def pack_conversations(turns: DataFrame, with_ids: bool = False, loss_tokens: int = LENGTH // 2, role: str = "assistant", **limits: int) -> DataFrame:
    """A row a piece of the turns (conv_id, turn, role, text), an example each; the turns of role bear loss, and
    no sequence holds more than loss_tokens of them. start and doc_tokens count within the turn."""
    rows = turns.select("conv_id", "turn", "text", F.coalesce(F.col("role") == role, F.lit(False)))
    return _pack(rows, ("conv_id", "turn"), {"loss_tokens": loss_tokens, **limits}, with_ids)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)
