"""Functions on sequences: codes, two-bit packing, excision of a core and its inverse, sort keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import walks

#: The four bases in the order of their codes.
BASES = "ACGT"


def normalized(seq: Column) -> Column:
    """Capitals; what is none of the four bases counts as A."""
    return F.regexp_replace(F.upper(seq), "[^ACGT]", "A")


def codes(seq: Column) -> Column:
    """A digit of 0 to 3 for each base."""
    return F.translate(normalized(seq), BASES, "0123")


def packed_hex(seq: Column) -> Column:
    """Two bits a base, first base highest, the last byte filled with zeros; as hexadecimal text."""
    digits = F.rpad(codes(seq), (F.ceil(F.length(seq) / 4) * 4).cast("int"), F.lit("0"))
    pairs = [(f"{a}{b}", f"{a * 4 + b:X}") for a in range(4) for b in range(4)]
    table = F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    nibbles = F.transform(F.regexp_extract_all(digits, F.lit(".."), F.lit(0)), lambda x: table[x])
    return F.when(F.length(seq) > 0, F.array_join(nibbles, "")).otherwise("")


def packed(seq: Column) -> Column:
    return walks.packed(seq, F.unhex(packed_hex(seq)))


def unpacked(hexadecimal: Column, length: Column) -> Column:
    """Inverse of packed_hex for a known number of bases."""
    table = F.create_map(*[F.lit(x) for v in range(16) for x in (f"{v:X}", BASES[v // 4] + BASES[v % 4])])
    bases = F.array_join(F.transform(F.split(hexadecimal, ""), lambda c: table[c]), "")
    return F.when(length > 0, F.substr(bases, F.lit(1), length)).otherwise("")


def payload(seq: Column, core: Column, end: Column) -> Column:
    """The read without its core: what follows the core, then what precedes it. end: the core's last place
    from 1, or 0 for none."""
    return F.when(end > 0, F.concat(F.substr(seq, end + 1), F.substr(seq, F.lit(1), end - F.length(core)))).otherwise(seq)


def restored(payload_: Column, core: Column, end: Column) -> Column:
    """Inverse of payload."""
    n = F.length(payload_) + F.length(core)
    tail = n - end
    return F.when(end > 0, F.concat(F.substr(payload_, tail + 1), core, F.substr(payload_, F.lit(1), tail))).otherwise(payload_)


def sort_key(seq: Column, core: Column, end: Column, read_length: Column) -> Column:
    """What follows the core, filled with A to the length of the read without it."""
    width = (read_length - F.when(end > 0, F.length(core)).otherwise(0)).cast("int")
    return walks.sort_key(seq, core, end, width, F.rpad(normalized(F.when(end > 0, F.substr(seq, end + 1)).otherwise(seq)), width, F.lit("A")))
