"""Benchmark decontamination by template windows.

Numbers, names and units become typed placeholders, so that a benchmark item and a copy of it with other
values share their template. Windows of WINDOW template tokens are hash-joined with the benchmark's; hits of
one item on one diagonal are put together, and the slots of each run must be consistent: each value of the item stands
for one value of the document, the most frequent one; windows with other values do not count. A document leaks an item if consistent windows
cover SHARE of the item's windows or RUN tokens in a row.

The benchmark is a stated query set that all documents are held against. It is read in blocks of about
BLOCK_WINDOWS windows; a block is the bounded build side of a hash join and is broadcast. A larger benchmark takes
a pass for each block, whose result is stored before the block goes, so that one is alive at a time.

Tokens are runs of letters and digits (a point or comma between digits belongs to the number), and single characters
of Chinese, Japanese, Thai and Lao; capitals count as small letters (letters of up to two bytes). Texts are read in more than one way, and a document leaks an item if one reading
says so. In the first a name is a capitalised word that begins no sentence, in the second any capitalised word;
names of a sentence in a row are one. In the third nothing is a placeholder, so that copies are found whatever their
letter case and however few words an item has. A unit is a unit word after a number.
A window needs LITERAL words that are no placeholders.

Defined cases: null or empty texts match nothing, nor do items with fewer than LITERAL tokens; an
item shorter than a window is one window of its own length; a null doc_id or item_id passes
through; very long texts are read one at a time, whole; repeated rows are each reported; empty tables give an empty result; other columns are ignored
(pipeline stage: kept as they are).
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import stored, table
from .vecwords import Block, blocks, hash_spans, mix, spans, windows

WINDOW, LITERAL, SHARE, RUN = 8, 4, 0.5, 13
BLOCK_WINDOWS, JOINED = 500_000, 2_000_000
# Words that are numbers, and units.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million billion".split()
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons lb lbs pound pounds oz "
    "ml l liter liters litre litres second seconds minute minutes hour hours day days week weeks month months year years "
    "percent degree degrees celsius fahrenheit dollar dollars cent cents euro euros usd eur watt watts volt volts meter meters metre metres"
).split()
READINGS = 3
_NUM, _UNIT, _NAME = 1, 2, 3
_PLACE = mix(np.arange(4, dtype=np.uint64) + np.uint64(0xABCDEF))
_code = np.arange(256)
_DIGIT = (_code >= 48) & (_code <= 57)
_UPPER = (_code >= 65) & (_code <= 90)
_INSIDE = _DIGIT | _UPPER | ((_code >= 97) & (_code <= 122)) | (_code >= 128)
_ENDS = np.isin(_code, list(b".!?:;\n\r\"()[]|"))


def _hashes(vocabulary: list[str]) -> np.ndarray:
    data = " ".join(vocabulary).encode()
    ends = np.cumsum([len(w) + 1 for w in vocabulary]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return np.sort(hash_spans(np.frombuffer(data, dtype=np.uint8), starts, ends, lower=True))


_NUMBER_HASHES, _UNIT_HASHES = _hashes(NUMBER_WORDS), _hashes(UNITS)


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return known[at] == h


@dataclass
class Template:
    canon: np.ndarray  # hash of the word or of its placeholder
    raw: np.ndarray
    kind: np.ndarray
    first: np.ndarray  # number of the first token of each text, and of all tokens


_FOLD = np.array([[(a, b) for b in range(256)] for a in range(256)], dtype=np.uint8)
for _c in map(chr, range(0x80, 0x800)):
    if len(_c.lower()) == 1 and len(_c.lower().encode()) == 2:
        _FOLD[tuple(_c.encode())] = tuple(_c.lower().encode())


def _folded(data: np.ndarray) -> np.ndarray:
    """UTF-8 with capitals of two bytes as small letters."""
    out = data.copy()
    at = np.flatnonzero((data[:-1] >= 0xC3) & (data[:-1] < 0xE0))
    pairs = _FOLD[data[at], data[at + 1]]
    out[at], out[at + 1] = pairs[:, 0], pairs[:, 1]
    return out


def _tokens(inside: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of tokens: runs of inside, and each character of a script without blanks for itself."""
    data, at = block.data, block.at
    starts, ends, first = spans(inside, at)
    lone = ((data >= 0xE3) & (data <= 0xE9)) | (data == 0xEF)
    lone[:-1] |= (data[:-1] == 0xE0) & (data[1:] >= 0xB8) & (data[1:] <= 0xBB)
    lone = np.flatnonzero(lone)
    if len(lone):
        after = lone[lone + 3 < len(data)] + 3
        starts = np.unique(np.concatenate([starts, lone, after[inside[after]]]))
        ends = np.unique(np.concatenate([ends, lone + 3, lone[(lone > 0) & inside[lone - 1]]]))
        first = np.searchsorted(starts, at)
    return starts, ends, first


def readings(block: Block) -> list[Template]:
    """With words that begin a sentence as words, and as names; and without placeholders."""
    data, at = block.data, block.at
    digit = _DIGIT[data]
    inside = _INSIDE[data]
    if len(data) > 2:
        joint = (data == 46) | (data == 44)
        edges = np.concatenate([at[at < len(data)], at[at > 0] - 1])
        joint[edges] = False
        inside[1:-1] |= joint[1:-1] & digit[:-2] & digit[2:]
    starts, ends, first = _tokens(inside, block)
    if not len(starts):
        none = np.zeros(0, dtype=np.uint64)
        return [Template(none, none, np.zeros(0, dtype=np.int8), first)] * READINGS
    folded = _folded(data)
    raw = hash_spans(folded, starts, ends, lower=True)
    leads = np.zeros(len(starts), dtype=bool)
    leads[first[:-1][np.diff(first) > 0]] = True
    digits, breaks = np.cumsum(digit), np.cumsum(_ENDS[data])
    number = (digits[ends - 1] - digits[starts] + digit[starts] > 0) | _among(raw, _NUMBER_HASHES)
    after = np.zeros(len(starts), dtype=bool)
    after[1:] = number[:-1] & ~leads[1:]
    sentence = leads.copy()
    sentence[1:] |= breaks[starts[1:]] > breaks[ends[:-1] - 1]
    capital = np.zeros(len(data) + 3, dtype=bool)  # at the first byte of a capital
    capital[: len(data)] = _UPPER[data]
    capital[: len(data) - 1] |= folded[1:] != data[1:]
    following = starts + np.where(data[starts] >= 0xC0, 2, 1)
    capitalised = capital[starts] & ~capital[following] & (ends > following)
    units, out = after & _among(raw, _UNIT_HASHES), []
    for name in (capitalised & ~sentence, capitalised):
        kind = np.zeros(len(starts), dtype=np.int8)
        kind[name] = _NAME
        kind[units] = _UNIT
        kind[number] = _NUM
        keep = np.ones(len(starts), dtype=bool)
        keep[1:] = ~((kind[1:] == _NAME) & (kind[:-1] == _NAME) & ~sentence[1:])
        count = np.concatenate([[0], np.cumsum(keep)])
        own, kind = raw[keep], kind[keep]
        out.append(Template(np.where(kind == 0, own, _PLACE[kind]), own, kind, count[first]))
    return [*out, Template(raw, raw, np.zeros(len(raw), dtype=np.int8), first)]


@dataclass
class Postings:
    """Windows of one reading and length: sorted hashes, and where each one's (item, place) begin."""

    hash: np.ndarray
    begin: np.ndarray
    item: np.ndarray
    place: np.ndarray


@dataclass
class Index:
    """The windows of a block of items, by reading and length."""

    items: list[tuple[int | None, list[Template]]] = field(default_factory=list)
    found: dict[tuple[int, int], set[tuple[int, int, int]]] = field(default_factory=lambda: defaultdict(set))
    sizes: list[list[int]] = field(default_factory=list)
    postings: dict[tuple[int, int], Postings] = field(default_factory=dict)
    n: int = 0

    def add(self, item_id: int | None, text: str | None) -> None:
        data = np.frombuffer((text or "").encode(), dtype=np.uint8)
        own, sizes = readings(Block(None, data, np.array([0, len(data)]))), []
        for reading, t in enumerate(own):
            length, seen = min(WINDOW, len(t.canon)), 0
            if (t.kind == 0).sum() >= LITERAL:
                other = t.canon.copy()
                other[0] = _PLACE[_NAME]  # inside a text the first word may look like a name
                for canon in (t.canon, other) if reading == 0 else (t.canon,):
                    literal = canon == t.raw
                    for q, h in enumerate(windows(canon, length).tolist()):
                        if (q == 0 or canon is t.canon) and literal[q : q + length].sum() >= min(LITERAL, length):
                            self.found[reading, length].add((h, len(self.items), q))
                            seen += canon is t.canon
            sizes.append(max(1, seen, *(sizes[:1] if reading == 1 else [])))  # placeholders more do not make a share smaller
            self.n += seen
        if any(len(t.canon) >= LITERAL for t in own):
            self.items.append((item_id, own))
            self.sizes.append(sizes)

    def ready(self) -> Index:
        for key, rows in self.found.items():
            ordered = sorted(rows)
            hashes, begin = np.unique(np.array([r[0] for r in ordered], dtype=np.uint64), return_index=True)
            item, place = (np.array([r[k] for r in ordered], dtype=np.int64) for k in (1, 2))
            self.postings[key] = Postings(hashes, np.append(begin, len(ordered)), item, place)
        self.found = {}
        return self

    def leaks(self, block: Block) -> list[tuple[int, int, int, int, int, bool]]:
        """(row, item, consistent windows, the item's windows, first token, whether all values are the same) of each
        leak, by the first reading that finds it."""
        best: dict[tuple[int, int], tuple[int, int, int, bool]] = {}
        for reading, t in enumerate(readings(block)):
            for key, got in self._read(reading, t).items():
                best.setdefault(key, got)
        return [(d, item, *got) for (d, item), got in sorted(best.items())]

    def _hits(self, reading: int, length: int, of: Postings, t: Template) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """(row, item, document's place less the item's, places) of each diagonal whose windows, values aside, would do."""
        h = windows(t.canon, length)
        if not len(h) or not len(of.hash):
            return
        doc = np.repeat(np.arange(len(t.first) - 1), np.diff(t.first))
        literal = np.concatenate([[0], np.cumsum(t.kind == 0)])
        places = np.flatnonzero(_among(h, of.hash))
        places = places[(doc[places] == doc[places + length - 1]) & (literal[places + length] - literal[places] >= min(LITERAL, length))]
        known = np.searchsorted(of.hash, h[places])
        counts = of.begin[known + 1] - of.begin[known]
        sizes = np.array([s[reading] for s in self.sizes])
        total, lo = np.cumsum(counts), 0
        while lo < len(places):  # whole documents, of about JOINED rows together
            hi = int(np.searchsorted(total, (total[lo - 1] if lo else 0) + JOINED, side="right"))
            hi = len(places) if hi >= len(places) else int(np.searchsorted(doc[places], doc[places[max(hi, lo)]]))
            hi = hi if hi > lo else int(np.searchsorted(doc[places], doc[places[lo]], side="right"))
            n = counts[lo:hi]
            at = np.repeat(of.begin[known[lo:hi]] - np.cumsum(n) + n, n) + np.arange(n.sum())
            p, item = np.repeat(places[lo:hi], n), of.item[at]
            shift = p - of.place[at]
            order = np.lexsort((p, shift, item, doc[p]))
            p, item, shift = p[order], item[order], shift[order]
            new = np.ones(len(p), dtype=bool)
            new[1:] = (item[1:] != item[:-1]) | (shift[1:] != shift[:-1]) | (doc[p[1:]] != doc[p[:-1]])
            starts = np.flatnonzero(new)
            ends = np.append(starts[1:], len(p))
            breaks = new.copy()
            breaks[1:] |= p[1:] - p[:-1] > length  # a token between the two windows is not covered
            runs = np.flatnonzero(breaks)
            covered = p[np.append(runs[1:], len(p)) - 1] + length - p[runs]
            longest = np.maximum.reduceat(covered, np.searchsorted(runs, starts))
            for k in np.flatnonzero((ends - starts >= SHARE * sizes[item[starts]]) | (longest >= RUN)).tolist():
                a = starts[k]
                yield int(doc[p[a]]), int(item[a]), int(shift[a]), p[a : ends[k]]
            lo = hi

    def _read(self, reading: int, t: Template) -> dict[tuple[int, int], tuple[int, int, int, bool]]:
        best: dict[tuple[int, int], tuple[int, int, int, bool]] = {}
        for (of, length), known in self.postings.items():
            if of != reading:
                continue
            for d, item, shift, places in self._hits(reading, length, known, t):
                own, size = self.items[item][1][reading], self.sizes[item][reading]
                wrong = _conflicts(own, t, _covered(places, length), shift)
                places = places[np.searchsorted(wrong, places) == np.searchsorted(wrong, places + length)]
                if not len(places):
                    continue
                tokens = _covered(places, length)
                run = max(len(x) for x in np.split(tokens, np.flatnonzero(np.diff(tokens) > 1) + 1))
                if len(places) >= SHARE * size or run >= RUN:
                    same = bool((own.raw[tokens - shift] == t.raw[tokens]).all())
                    got = (len(places), size, int(tokens[0] - t.first[d]), same)
                    # Of several places the one with most windows counts; ties go to the earliest.
                    if (d, item) not in best or (-got[0], got[2]) < (-best[d, item][0], best[d, item][2]):
                        best[d, item] = got
        return best


def _covered(places: np.ndarray, length: int) -> np.ndarray:
    return np.unique(places[:, None] + np.arange(length))


def _conflicts(item: Template, doc: Template, tokens: np.ndarray, shift: int) -> np.ndarray:
    """The slots, run by run, whose item value stands for another value more often (or as often, but earlier)."""
    slots = tokens[doc.kind[tokens] != 0]
    run = np.cumsum(np.diff(tokens, prepend=tokens[0]) > 1)[doc.kind[tokens] != 0]
    keys = list(zip(run.tolist(), doc.kind[slots].tolist(), item.raw[slots - shift].tolist(), strict=True))
    values = doc.raw[slots].tolist()
    seen: dict[tuple, Counter] = defaultdict(Counter)
    for key, value in zip(keys, values, strict=True):
        seen[key][value] += 1
    stands = {key: counts.most_common(1)[0][0] for key, counts in seen.items()}
    return slots[np.array([stands[k] != v for k, v in zip(keys, values, strict=True)], dtype=bool)]


def indexes(benchmark: DataFrame, limit: int = BLOCK_WINDOWS) -> Iterator[tuple[Index, bool]]:
    """The benchmark in blocks of about limit windows, each with whether it is the only one; one at a time on the driver."""
    index, more = Index(), False
    for row in benchmark.select("item_id", "text").toLocalIterator():
        index.add(row.item_id, row.text)
        if index.n >= limit:
            yield index.ready(), False
            index, more = Index(), True
    if index.n:
        yield index.ready(), not more


_LEAKS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_windows", pa.int64()), ("item_windows", pa.int64()), ("first_token", pa.int64()), ("same_values", pa.bool_())])


def _passes(docs: DataFrame, benchmark: DataFrame, limit: int, search, schema, chained: bool) -> Iterator[DataFrame]:
    """docs through search(batches, broadcast index) for each block; but for an only block, stored before the block goes.
    chained: each pass reads what the one before left."""
    for index, only in indexes(benchmark, limit):
        sent = docs.sparkSession.sparkContext.broadcast(index)
        found = docs.mapInArrow(lambda batches, sent=sent: search(batches, sent.value), schema)
        if not only:
            found = stored(found, "decontamination-pass")
            sent.destroy()
        yield found
        docs = found if chained else docs


def leaks(docs: DataFrame, benchmark: DataFrame, limit: int = BLOCK_WINDOWS) -> DataFrame:
    """One row for each document and item that it leaks."""
    schema = "doc_id long, item_id long, n_windows long, item_windows long, first_token long, same_values boolean"

    def search(batches: Iterable[pa.RecordBatch], known: Index) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, 1):
            ids = block.batch.column(0).to_pylist()
            rows = [(ids[d], known.items[i][0], n, size, at, same) for d, i, n, size, at, same in known.leaks(block)]
            yield pa.RecordBatch.from_pylist([dict(zip(_LEAKS.names, r, strict=True)) for r in rows], schema=_LEAKS)

    out = None
    for found in _passes(docs.select("doc_id", "text"), benchmark, limit, search, schema, chained=False):
        out = found if out is None else out.union(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str, limit: int = BLOCK_WINDOWS) -> DataFrame:
    """Pipeline stage: documents that leak an item go. Rows are judged as they pass, without a shuffle."""
    place = docs.columns.index("text")

    def keep(batches: Iterable[pa.RecordBatch], known: Index) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, place):
            bad = {leak[0] for leak in known.leaks(block)}
            yield block.batch.filter(pa.array([i not in bad for i in range(block.batch.num_rows)], pa.bool_()))

    for kept in _passes(docs, table(spark, sf_dir, "benchmark"), limit, keep, docs.schema, chained=True):
        docs = kept
    return docs
