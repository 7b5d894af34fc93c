"""Codec of bases and qualities: one number from 0 to 255 per base. Column builders, and an Arrow kernel for long reads."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the format: lowest code of N, A, C, G, T; most that a scaled quality adds; the code that would be a
# line feed and what is written for it.
CODES = (0, 3, 66, 129, 192)
BASES = "NACGT"
MOST_SCALED = 62
LINE_FEED, ESCAPED = 10, 255
MOST_PHRED = 93


@dataclass(frozen=True)
class Coding:
    """Parameters of the format. lut: scaled value by quality; without one, qualities are clipped."""

    codes: tuple[int, int, int, int, int] = CODES
    phred_offset: int = 33
    min_quality: int = 0
    lut: tuple[tuple[int, int], ...] | None = None

    def __post_init__(self) -> None:
        n, *rest = self.codes
        gaps = [b - a for a, b in zip(rest, rest[1:], strict=False)]
        most = max((v for _, v in self.lut), default=0) if self.lut else MOST_SCALED
        if n < 0 or rest[0] - n < 3 or min(gaps) < most + 1 or rest[-1] + most >= ESCAPED:
            raise ValueError(f"codes must ascend in the order N A C G T with room for qualities: {self.codes}")
        for q, v in self.lut or ():
            if not (0 <= q <= 94 and 0 <= v <= MOST_SCALED):
                raise ValueError(f"quality {q} may not have the value {v}")


def parse_lut(text: str) -> tuple[tuple[int, int], ...]:
    """Lines of a quality and its value; # begins a comment. Errors name the line."""
    out = []
    for i, line in enumerate(text.splitlines(), 1):
        if not (line := line.split("#")[0].strip()):
            continue
        parts = line.split()
        if len(parts) != 2 or not all(p.isdigit() for p in parts):
            raise ValueError(f"line {i}: two numbers are needed: {line!r}")
        q, v = map(int, parts)
        if not (1 <= q <= 94 and 1 <= v <= MOST_SCALED):
            raise ValueError(f"line {i}: out of range: {line!r}")
        out.append((q, v))
    return tuple(out)


def phred(char: Column, offset: int = 33) -> Column:
    return F.greatest(F.lit(0), F.least(F.ascii(char) - offset, F.lit(MOST_PHRED)))


def _lookup(pairs: Sequence[tuple[int, int]], key: Column, default: Column) -> Column:
    table = F.create_map(*[F.lit(x) for p in pairs for x in p])
    return F.coalesce(F.try_element_at(table, key), default)


def scaled(q: Column, lut: Sequence[tuple[int, int]] | None = None) -> Column:
    return _lookup(lut, q, F.lit(0)) if lut else F.least(q, F.lit(MOST_SCALED))


def base_code(base: Column, codes: Sequence[int] = CODES) -> Column:
    n, a, c, g, t = codes
    return F.when(base == "A", a).when(base == "C", c).when(base == "G", g).when(base == "T", t).otherwise(n)


def code(base: Column, q: Column, coding: Coding = Coding()) -> Column:
    """The number of one base: its code plus the scaled quality; N keeps the quality in three steps."""
    b, s = base_code(base, coding.codes), scaled(q, coding.lut)
    n = coding.codes[0]
    value = F.when(b == n, n + F.floor(s * 2 / MOST_SCALED).cast("int")).otherwise(b + s)
    if coding.min_quality:
        value = F.when(q < coding.min_quality, n).otherwise(value)
    return F.when(value == LINE_FEED, ESCAPED).otherwise(value)


def encode(seq: Column, qual: Column, coding: Coding = Coding()) -> Column:
    """array<int> of the numbers of a read. A quality string that is too long is cut, one that is too short is padded with the lowest."""
    n = F.length(seq)
    chars = lambda s: F.filter(F.split(s, ""), lambda x: x != "")
    padded = F.substring(F.rpad(qual, n, chr(coding.phred_offset)), F.lit(1), n)
    return F.zip_with(chars(seq), chars(padded), lambda b, c: code(b, phred(c, coding.phred_offset), coding))


def interval(v: Column, codes: Sequence[int] = CODES) -> Column:
    """The lowest code of a number's base."""
    n, a, c, g, t = codes
    v = F.when(v == ESCAPED, LINE_FEED).otherwise(v)
    return F.when(v >= t, t).when(v >= g, g).when(v >= c, c).when(v >= a, a).otherwise(n)


def decoded_base(v: Column, codes: Sequence[int] = CODES) -> Column:
    low = interval(v, codes)
    out = F.lit("N")
    for base, c in list(zip(BASES, codes, strict=True))[1:]:
        out = F.when(low == c, base).otherwise(out)
    return out


def inverse_lut(lut: Sequence[tuple[int, int]] | None) -> list[int]:
    """Quality by scaled value, 0 to 63: the largest with that value; 0 where there is none."""
    pairs = lut or [(q, q) for q in range(MOST_SCALED + 1)]
    out = [0] * 64
    for q, v in sorted(pairs):
        out[v] = q
    return out


def interpolated_lut(lut: Sequence[tuple[int, int]]) -> list[int]:
    """As ``inverse_lut``, with gaps filled: level before the first and after the last value, linear between."""
    known = sorted({v: q for q, v in sorted(lut)}.items())
    xs, ys = [v for v, _ in known], [q for _, q in known]
    return [min(MOST_PHRED, int(np.floor(np.interp(v, xs, ys) + 0.5))) for v in range(64)]


def decoded_quality(v: Column, codes: Sequence[int] = CODES, lut: Sequence[tuple[int, int]] | None = None) -> Column:
    plain = F.when(v == ESCAPED, LINE_FEED).otherwise(v)
    s = F.least(plain - interval(v, codes), F.lit(63))
    return F.element_at(F.array(*[F.lit(x) for x in inverse_lut(lut)]), s + 1) if lut else F.least(s, F.lit(MOST_SCALED))


def decode_seq(numbers: Column, codes: Sequence[int] = CODES) -> Column:
    return F.array_join(F.transform(numbers, lambda v: decoded_base(v, codes)), "")


def decode_qual(numbers: Column, codes: Sequence[int] = CODES, lut: Sequence[tuple[int, int]] | None = None) -> Column:
    return F.array_join(F.transform(numbers, lambda v: F.chr(decoded_quality(v, codes, lut) + 33)), "")


def decimal(numbers: Column) -> Column:
    """Three digits a number."""
    return F.array_join(F.transform(numbers, lambda v: F.lpad(v.cast("string"), 3, "0")), "")


def from_decimal(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.greatest(F.length(text) / 3 - 1, F.lit(0)).cast("int")), lambda i: F.substring(text, i * 3 + 1, F.lit(3)).cast("int"))


def tables(coding: Coding) -> np.ndarray:
    """(256 bases, 256 quality characters) of numbers, for the Arrow kernel."""
    base = np.full(256, coding.codes[0])
    for b, c in zip(BASES, coding.codes, strict=True):
        base[ord(b)] = c
    q = np.clip(np.arange(256) - coding.phred_offset, 0, MOST_PHRED)
    s = np.array([dict(coding.lut).get(int(x), 0) for x in q]) if coding.lut else np.minimum(q, MOST_SCALED)
    out = np.where(base[:, None] == coding.codes[0], coding.codes[0] + s[None, :] * 2 // MOST_SCALED, base[:, None] + s[None, :])
    out = np.where(q[None, :] < coding.min_quality, coding.codes[0], out)
    return np.where(out == LINE_FEED, ESCAPED, out).astype(np.uint8)


def encode_frame(reads: DataFrame, coding: Coding = Coding()) -> DataFrame:
    """``reads (seq, qual, ...)`` with ``codes`` BINARY instead: table lookups on whole Arrow buffers, for long reads."""
    others = [c for c in reads.columns if c not in ("seq", "qual")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = tables(coding)
        for batch in batches:
            seqs, quals = (batch.column(batch.schema.get_field_index(c)) for c in ("seq", "qual"))
            out = []
            for s, q in zip(seqs, quals, strict=True):
                s = np.frombuffer((s.as_py() or "").encode("latin-1", "replace"), np.uint8)
                q = np.frombuffer((q.as_py() or "").encode("latin-1", "replace").ljust(len(s), bytes([coding.phred_offset]))[: len(s)], np.uint8)
                out.append(table[s, q].tobytes())
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in others], pa.array(out, pa.binary())], [*others, "codes"])

    schema = ", ".join(f"`{n}` {t}" for n, t in reads.select(*others).dtypes)
    return reads.mapInArrow(run, f"{schema}, codes binary")


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(seq), "ACGT", "TGCA")


def hamming(a: Column, b: Column) -> Column:
    """Positions at which two strings differ, over the shorter length."""
    n = F.least(F.length(a), F.length(b))
    return F.aggregate(F.filter(F.sequence(F.lit(0), n), lambda i: i > 0), F.lit(0), lambda d, i: d + (F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1))).cast("int"))


def detect_phred(lowest: Column) -> Column:
    """Encoding by the lowest quality character of a file."""
    return (F.when(lowest < 33, "No known encodings").when(lowest < 64, "Sanger / Illumina 1.9").when(lowest == 65, "Illumina 1.3")
            .when(lowest <= 126, "Illumina 1.5").otherwise("No known encodings"))
