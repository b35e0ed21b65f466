"""Fill-in-middle: a text's prefix, middle and suffix in another order, cut at unit boundaries held in a Roaring-style set.

A unit is `[blank]*[other]+`, or blanks alone at the end (blanks: ASCII white space). The set of a text's boundaries (code point offsets) is
split by the upper 16 bits into containers: sorted array, bitmap or runs, whichever is smallest. Cumulative cardinalities find the container
of the i-th boundary, a select inside it the boundary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lureline.llm.tokens import batches

#: Signs before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
ARRAY_MOST, BITMAP_BYTES = 4096, 8192


class Container:
    """Sorted different numbers below 2^16, as `array`, `bitmap` or `run`."""

    def __init__(self, low: np.ndarray) -> None:
        heads = np.flatnonzero(np.r_[True, np.diff(low) != 1])
        bytes_of = {"array": 2 * len(low) if len(low) <= ARRAY_MOST else BITMAP_BYTES + 1, "run": 2 + 4 * len(heads), "bitmap": BITMAP_BYTES}
        self.kind = min(bytes_of, key=bytes_of.__getitem__)
        if self.kind == "array":
            self.low = low.astype(np.uint16)
        elif self.kind == "run":
            self.first = low[heads].astype(np.uint16)
            self.upto = np.r_[heads[1:], len(low)]  # members up to the end of each run
        else:
            bits = np.zeros(1 << 16, np.uint8)
            bits[low] = 1
            self.words = np.packbits(bits, bitorder="little").view("<u8")
            self.upto = np.cumsum(np.bitwise_count(self.words), dtype=np.int64)

    def select(self, i: int) -> int:
        """The i-th member, from 0."""
        if self.kind == "array":
            return int(self.low[i])
        at = int(np.searchsorted(self.upto, i, "right"))
        i -= int(self.upto[at - 1]) if at else 0
        if self.kind == "run":
            return int(self.first[at]) + i
        word = int(self.words[at])
        for _ in range(i):
            word &= word - 1  # the lowest member goes
        return 64 * at + (word & -word).bit_length() - 1


class Boundaries:
    """A set of offsets, built from a sorted array of different numbers."""

    def __init__(self, offsets: np.ndarray) -> None:
        high = offsets >> 16
        edges = np.r_[np.flatnonzero(np.r_[True, np.diff(high) != 0]), len(offsets)] if len(offsets) else np.zeros(1, np.int64)
        self.high = high[edges[:-1]]
        self.upto = edges[1:]
        self.containers = [Container(offsets[a:b] & 0xFFFF) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]

    def __len__(self) -> int:
        return int(self.upto[-1]) if len(self.upto) else 0

    def select(self, i: int) -> int:
        at = int(np.searchsorted(self.upto, i, "right"))
        return (int(self.high[at]) << 16) + self.containers[at].select(i - (int(self.upto[at - 1]) if at else 0))


def unit_ends(text: str) -> np.ndarray:
    """Where the units of a text end, in code points."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    blank = (points == 32) | ((points >= 9) & (points <= 13))
    ends = np.flatnonzero(~blank & np.r_[blank[1:], True]) + 1 if len(points) else np.zeros(0, np.int64)
    return np.r_[ends, len(points)] if len(points) and blank[-1] else ends


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers: the first 8-digit groups of the hex sha256 of `seed:doc_id` (a null id: nothing after the colon)."""
    hexed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(hexed, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def transform(docs: DataFrame, rate: int = 50, spm: int = 80, seed: int = 42) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars, output.

    `rate` per cent of the documents are rearranged, `spm` per cent of these as suffix, prefix, middle (spm), the others as prefix, suffix,
    middle (psm). The cuts are two boundaries drawn with replacement, so any part may be empty. Texts that are empty or hold one of MARKS
    stay as they are (plain; prefix_chars and middle_chars null). Null text: empty. Null ids draw like others; repeated rows give the same
    row again. Only doc_id and text are read, so other columns can't clash. An empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *draws(F.col("doc_id").cast("long"), seed))
    p, s, m = MARKS

    def rearranged(text: str, h1: int, h2: int, h3: int, h4: int) -> tuple:
        ends = unit_ends(text)
        if not text or any(x in text for x in MARKS) or h3 % 100 >= rate:
            return len(ends), "plain", None, None, text
        n, bounds = len(ends), Boundaries(np.r_[0, ends])
        first, second = (bounds.select(k) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
        a, b, c = text[:first], text[first:second], text[second:]
        if h4 % 100 < spm:
            return n, "spm", first, second - first, f"{s}{c}{p}{a}{m}{b}"
        return n, "psm", first, second - first, f"{p}{a}{s}{c}{m}{b}"

    def each(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            listed = list(zip(*(part[c].to_pylist() for c in ("text", "h1", "h2", "h3", "h4", "doc_id")), strict=True))
            for run in batches(listed, lambda r: len(r[0])):
                out = zip(*(rearranged(*r[:5]) for r in run), strict=True)
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([r[5] for r in run], pa.int64()), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return rows.mapInArrow(each, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that transform() was given, from its output and form alone: a text holds no mark, so the first of each is the one set."""

    def before(c: Column, mark: str) -> Column:
        return F.substring_index(c, mark, 1)

    def after(c: Column, mark: str) -> Column:
        return F.substring(c, F.length(before(c, mark)) + F.lit(len(mark) + 1), F.length(c))

    p, s, m = MARKS
    psm = F.concat(before(after(output, p), s), after(output, m), before(after(after(output, p), s), m))
    spm = F.concat(before(after(output, p), m), after(output, m), before(after(output, s), p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
