"""Long repeated strings, found with a run-length index: which bytes are covered by a string of `length` bytes that also starts elsewhere.

1. Anchors. In every window of `length` bytes the smallest hash of ANCHOR bytes is the window's anchor (winnowing), so equal windows have
   equal anchors at equal places. Windows in a row with one anchor make a span, and every window is in exactly one span.
2. Spans whose anchor occurs once are done: nothing in them repeats. The others are grouped by anchor; equal spans are counted and one of
   each is kept, so exact copies cost one row.
3. Groups with different spans are indexed: spans are concatenated, and their Burrows-Wheeler transform is reduced to its runs, with the text
   positions and common prefixes at the run ends sampled. Matching statistics (the longest match that starts elsewhere) are then streamed
   from the samples: between two samples they fall by one with each byte. A window repeats where they reach `length`.
4. An anchor whose different spans exceed what one index may hold is split by the windows themselves: equal windows are counted by digest.

Passages of words (`repeated_words`) go the same way with words for bytes: a passage under another line break, or one of short words that falls
short of `length` bytes, repeats too. Their spans are short, so the windows of an anchor's different spans are counted by hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lureline.llm.common import cut, packed, row_key
from lureline.llm.tokens import forgotten, runs, slices
from lureline.llm.words import Words, mix64, powers, prefix
from lureline.llm.words import runs as word_runs

ANCHOR = 50
#: Words of an anchor of a window of words.
WORD_ANCHOR = 16
#: Bytes of one anchor's different spans beyond which it is split, and of the spans of several anchors in one index.
INDEX_BYTES, INDEX_TOGETHER = 1_000_000, 250_000
#: Windows of a split span whose digests are held at once.
_DIGESTS = 100_000
_CHUNK = 1 << 21


# ---- anchors

def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each window of `width` values, by prefix and suffix minima of blocks."""
    n = len(values)
    blocks = -(-n // width)
    held = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    held[:n] = values
    held = held.reshape(blocks, width)
    after = np.minimum.accumulate(held, axis=1).ravel()
    before = np.minimum.accumulate(held[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(before[: n - width + 1], after[width - 1 : n])


def spans(buf: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """First window, number of windows and anchor hash of each span of a piece of at most _CHUNK bytes."""
    if len(buf) < length:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64)
    width = min(ANCHOR, length)
    p, (_, down) = prefix(buf), powers(len(buf) + 1)
    at = len(buf) - width + 1
    h = mix64((p[width:] - p[:at]) * down[:at])
    # Among equal hashes the first position wins, which depends on the window's bytes alone.
    key = (h & ~np.uint64(_CHUNK - 1)) | np.arange(at, dtype=np.uint64)
    anchor = (sliding_min(key, length - width + 1) & np.uint64(_CHUNK - 1)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, np.diff(anchor) != 0])
    return first, np.diff(np.r_[first, len(anchor)]), h[anchor[first]]


def span_rows(docs: DataFrame, length: int) -> DataFrame:
    """rk, at, windows, anchor, span (digest of the span's bytes) for each span of each text."""
    rows = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("rk"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("raw")).filter(F.octet_length("raw") >= length)

    def find(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forgotten()
        for run in runs(parts, "raw"):
            keys, cols = [], ([], [], [], [])
            for rk, raw in run:
                # Long texts go by pieces that overlap by a window less a byte: each window is in one piece.
                for base in range(0, max(1, len(raw) - length + 1), _CHUNK - length):
                    piece = raw[base : base + _CHUNK - 1]
                    first, windows, anchor = spans(np.frombuffer(piece, np.uint8), length)
                    keys += [rk] * len(first)
                    cols[0].append(first + base)
                    cols[1].append(windows)
                    cols[2].append(anchor.view(np.int64))
                    cols[3].extend(hashlib.blake2b(piece[a : a + n + length - 1], digest_size=16).digest() for a, n in zip(first.tolist(), windows.tolist(), strict=True))
            numbers = [pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for c in cols[:3]]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), *numbers, pa.array(cols[3], pa.binary())], names=["rk", "at", "windows", "anchor", "span"])

    return rows.mapInArrow(find, "rk binary, at long, windows long, anchor long, span binary")


# ---- the index

def suffix_array(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Suffixes in order, a suffix ending with its span (ends: for each position the end of its span) and equal ones in text order."""
    n = len(text)
    left = ends - np.arange(n, dtype=ends.dtype)
    rank = np.zeros(n, np.int64)
    padded = np.r_[text.astype(np.int16) + np.int16(1), np.zeros(6, np.int16)]
    for k in range(6):  # six symbols of nine bits; 0 beyond the end
        rank = (rank << 9) | np.where(left > k, padded[k : k + n], 0)
    order = np.argsort(rank)
    h = 6
    while True:
        held = rank[order]
        step = np.r_[0, np.cumsum(held[1:] != held[:-1])]
        rank = np.empty(n, np.int64)
        rank[order] = step
        if step[-1] == n - 1 or h >= left.max():
            return order if step[-1] == n - 1 else np.argsort(rank, kind="stable")
        further = np.where(left > h, np.r_[rank, np.zeros(h, np.int64)][h : h + n] + 1, 0)
        rank = rank * (n + 1) + further
        order = np.argsort(rank)
        h *= 2


class RunIndex:
    """The Burrows-Wheeler transform of spans as runs, with text position and common prefix sampled at the ends of the runs."""

    def __init__(self, pieces: list[bytes]) -> None:
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.stop = np.cumsum(sizes)
        self.start = self.stop - sizes
        self.text = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.repeat(self.stop.astype(np.int32), sizes)  # an index is far smaller than 2^31 bytes
        order = suffix_array(self.text, ends)
        # The byte before each suffix; before a span stands a sign of its own, so such places always end a run.
        before = self.text[order - 1].astype(np.int16)
        first = np.zeros(len(self.text), bool)
        first[self.start] = True
        before[first[order]] = -1
        head = np.r_[True, (before[1:] != before[:-1]) | (before[1:] < 0)]
        self.runs = int(head.sum())
        heads = np.flatnonzero(head)
        inner = heads[1:]
        shared = self._common(order[inner - 1], order[inner], ends)
        # Each run's first suffix with what it shares with the one above, each run's last with what it shares with the one below.
        self.head_at, self.head_common = order[heads], np.r_[0, shared]
        self.tail_at, self.tail_common = np.r_[order[inner - 1], order[-1]], np.r_[shared, 0]

    def _common(self, a: np.ndarray, b: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Lengths of the common prefixes of suffixes a and b within their spans, eight bytes at a time."""
        most = np.minimum(ends[a] - a, ends[b] - b)
        padded = np.r_[self.text, np.zeros(8, np.uint8)]
        word = np.lib.stride_tricks.sliding_window_view(padded, 8)
        out, live = np.zeros(len(a), np.int64), np.arange(len(a))
        while len(live):
            done = out[live]
            differ = word[a[live] + done] != word[b[live] + done]
            same = np.where(differ.any(axis=1), differ.argmax(axis=1), 8)
            out[live] += same
            live = live[(same == 8) & (out[live] < most[live])]
        return np.minimum(out, most)

    def matching_statistics(self) -> np.ndarray:
        """For each position the longest match that starts at another position, streamed from the samples."""
        n = len(self.text)
        best = np.zeros(n, np.int64)
        for at, common in ((self.head_at, self.head_common), (self.tail_at, self.tail_common)):
            sampled = np.zeros(n, np.int64)
            value = np.zeros(n, np.int64)
            sampled[at], value[at] = at, common
            last = np.maximum.accumulate(sampled)  # a span's first position is always sampled
            np.maximum(best, value[last] - (np.arange(n) - last), out=best)
        return best


def repeated_ranges(pieces: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """For each span the runs (first window, windows) of its windows that also start elsewhere in the spans."""
    index = RunIndex(pieces)
    hit = index.matching_statistics() >= length
    edge = np.flatnonzero(np.diff(np.r_[False, hit, False].view(np.int8)))
    out: list[list[tuple[int, int]]] = [[] for _ in pieces]
    begin, end = edge[0::2], edge[1::2]
    owner = np.searchsorted(index.start, begin, "right") - 1
    base = index.start[owner]
    for k, a, n in zip(owner.tolist(), (begin - base).tolist(), (end - begin).tolist(), strict=True):
        out[k].append((a, n))
    return out


# ---- the job

def texts_of_spans(docs: DataFrame, spans_wanted: DataFrame, length: int) -> DataFrame:
    """anchor, span, bytes of the wanted spans (rk, at, windows, anchor, span)."""
    lists = spans_wanted.groupBy("rk").agg(F.collect_list(F.struct("at", "windows", "anchor", "span")).alias("own"))
    rows = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("rk"), F.encode("text", "UTF-8").alias("raw")).join(lists, "rk")
    each = rows.select("raw", F.explode("own").alias("s"))
    # substring of binary counts bytes from one
    return each.select("s.anchor", "s.span", F.substring("raw", F.col("s.at").cast("int") + 1, (F.col("s.windows") + length - 1).cast("int")).alias("bytes"))


RANGES = "anchor long, span binary, first long, windows long"


def indexed_ranges(texts: DataFrame, length: int) -> DataFrame:
    """Repeated windows (RANGES) in spans, anchors being together: an index for each INDEX_TOGETHER of them, or for one anchor."""

    def search(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None

        def found() -> pa.RecordBatch:
            out = [(a, s, *r) for (a, s, _), own in zip(held, repeated_ranges([b for _, _, b in held], length), strict=True) for r in own]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.int64(), pa.int64()))], names=["anchor", "span", "first", "windows"])

        for run in runs(parts, "bytes"):
            for row in run:
                if row[0] != last and size >= min(INDEX_BYTES, INDEX_TOGETHER):
                    yield found()
                    held, size = [], 0
                held.append(row)
                size += len(row[2])
                last = row[0]
        if held:
            yield found()

    return texts.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(search, RANGES)


def split_ranges(texts: DataFrame, length: int) -> DataFrame:
    """The same for anchors with too many different spans: windows counted by digest. Counts are combined before the shuffle."""

    def windows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(parts, "bytes"):
            for a, s, b in run:
                for low in range(0, len(b) - length + 1, _DIGESTS):
                    places = range(low, min(low + _DIGESTS, len(b) - length + 1))
                    yield pa.RecordBatch.from_arrays([pa.array([a] * len(places), pa.int64()), pa.array([s] * len(places), pa.binary()), pa.array(places, pa.int64()), pa.array([hashlib.blake2b(b[i : i + length], digest_size=16).digest() for i in places], pa.binary())], names=["anchor", "span", "first", "digest"])

    rows = texts.mapInArrow(windows, "anchor long, span binary, first long, digest binary")
    often = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest")
    return rows.join(often, "digest").select("anchor", "span", "first", F.lit(1).cast("long").alias("windows"))


def repeated_bytes(docs: DataFrame, length: int = 400) -> DataFrame:
    """rk and the byte ranges (start, stop; merged per span) covered by strings of `length` bytes that also start elsewhere.

    Null texts and texts shorter than `length` have none. Matches never cross texts. Repeated rows are each other's copies.
    """
    rows = cut(span_rows(docs, length))
    # Written first, so that the join's hot anchors are split (or the small side is broadcast) by its known size.
    often = cut(rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor"))
    shared = cut(rows.join(often, "anchor", "left_semi"))
    kinds = shared.groupBy("anchor", "span").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rk", "at", "windows")).alias("one"))
    kinds = cut(kinds.select("anchor", "span", "n", "one.*"))
    groups = cut(kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("spans"), F.sum(F.col("windows") + length).alias("bytes")).filter("spans > 1"))
    # A span found several times repeats as a whole; of the others, those with company are looked into.
    open_kinds = kinds.join(groups, "anchor")
    texts = cut(texts_of_spans(docs, open_kinds.select("rk", "at", "windows", "anchor", "span"), length).join(groups.select("anchor", (F.col("bytes") > INDEX_BYTES).alias("large")), "anchor"))
    plain = indexed_ranges(texts.filter("not large").drop("large").dropDuplicates(["anchor", "span"]), length)
    parts = plain.union(split_ranges(texts.filter("large").drop("large").dropDuplicates(["anchor", "span"]), length))
    whole = kinds.filter("n > 1").select("anchor", "span", F.lit(0).cast("long").alias("first"), "windows")
    found = cut(whole.union(parts))
    each = shared.select("rk", "at", "anchor", "span").join(found, ["anchor", "span"])
    return each.select("rk", (F.col("at") + F.col("first")).alias("start"), (F.col("at") + F.col("first") + F.col("windows") + (length - 1)).alias("stop"))


# ---- passages of words

def word_windows(words: Words, width: int) -> tuple[np.ndarray, ...]:
    """Hash of each window of `width` words, where its anchor stands (the first smallest hash of a run in it), that hash, its text's number
    and its place there."""
    h = words.hashes()
    if len(h) < width:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none.astype(np.uint64), none, none
    run = min(WORD_ANCHOR, width)
    whole, short = word_runs(h, width), word_runs(h, run)
    order = np.argsort(short, kind="stable")  # among equal hashes the first place wins
    rank = np.empty(len(short), np.uint64)
    rank[order] = np.arange(len(short), dtype=np.uint64)
    stands = order[sliding_min(rank, width - run + 1).astype(np.int64)]
    at = np.arange(len(whole))
    text = np.searchsorted(words.first, at, "right") - 1
    inside = at + width <= words.first[text + 1]
    return whole[inside], stands[inside], short[stands[inside]], text[inside], (at - words.first[text])[inside]


def word_spans(words: Words, width: int) -> tuple[np.ndarray, ...]:
    """Text, first window, number of windows, anchor and hash of each span: windows in a row with one anchor, of which no two are equal."""
    whole, stands, anchor, text, at = word_windows(words, width)
    if not len(whole):
        return text, at, at, anchor, whole
    first = np.flatnonzero(np.r_[True, (stands[1:] != stands[:-1]) | (text[1:] != text[:-1])])
    count = np.diff(np.r_[first, len(whole)])
    place = (np.arange(len(whole)) - np.repeat(first, count)).astype(np.uint64)
    span = mix64(np.add.reduceat(mix64(whole + place * np.uint64(0x9E3779B97F4A7C15)), first) + count.astype(np.uint64))
    return text[first], at[first], count, anchor[first], span


def _raw(docs: DataFrame, width: int) -> DataFrame:
    """rk and bytes of the texts that may hold a window: its words and the blanks between them."""
    rows = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("rk"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("raw"))
    return rows.filter(F.octet_length("raw") >= 2 * width - 1)


def word_span_rows(docs: DataFrame, width: int) -> DataFrame:
    """rk, at, windows, anchor, span for each span of words of each text."""

    def find(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forgotten()
        for run in runs(parts, "raw"):
            text, at, windows, anchor, span = word_spans(Words([raw for _, raw in run]), width)
            keys = pa.array([rk for rk, _ in run], pa.binary()).take(pa.array(text))
            yield pa.RecordBatch.from_arrays([keys, pa.array(at), pa.array(windows), pa.array(anchor.view(np.int64)), pa.array(span.view(np.int64))], names=["rk", "at", "windows", "anchor", "span"])

    return _raw(docs, width).mapInArrow(find, "rk binary, at long, windows long, anchor long, span long")


def windows_of_spans(docs: DataFrame, spans_wanted: DataFrame, width: int) -> DataFrame:
    """anchor, span, first, whole: the windows of the wanted spans (rk, at, windows, anchor, span), hashed again from their texts."""
    lists = spans_wanted.groupBy("rk").agg(F.collect_list(F.struct("at", "windows", "span")).alias("own"))

    def find(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forgotten()
        for run in runs(parts, "raw"):
            whole, _, anchor, text, _ = word_windows(Words([raw for raw, _ in run]), width)
            begin = np.searchsorted(text, np.arange(len(run)))
            own = [(base + s["at"], s["windows"], s["span"]) for (_, listed), base in zip(run, begin.tolist(), strict=True) for s in listed]
            low, count, span = (np.array(x, np.int64) for x in zip(*own, strict=True))
            first = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            at = np.repeat(low, count) + first
            yield pa.RecordBatch.from_arrays([pa.array(anchor[at].view(np.int64)), pa.array(np.repeat(span, count)), pa.array(first), pa.array(whole[at].view(np.int64))], names=["anchor", "span", "first", "whole"])

    rows = _raw(docs, width).join(lists, "rk").select("raw", "own")
    return rows.mapInArrow(find, "anchor long, span long, first long, whole long")


def repeated_words(docs: DataFrame, width: int = 51) -> DataFrame:
    """rk and the ranges (start, stop; words of the text, from 0) covered by passages of `width` words that also start elsewhere.

    Words are runs without ASCII white space and are compared byte by byte; what lies between them does not count. Passages never cross texts.
    """
    rows = cut(word_span_rows(docs, width))
    often = cut(rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor"))
    shared = cut(rows.join(often, "anchor", "left_semi"))
    kinds = cut(shared.groupBy("anchor", "span").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rk", "at", "windows")).alias("one")).select("anchor", "span", "n", "one.*"))
    groups = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("spans")).filter("spans > 1").select("anchor")
    windows = cut(windows_of_spans(docs, kinds.join(groups, "anchor"), width))
    # At two places, not twice: repeated rows give the windows of a span more than once.
    places = [f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("span", "first")]
    again = windows.groupBy("anchor", "whole").agg(*places).filter("min_span != max_span or min_first != max_first").select("anchor", "whole")
    parts = windows.join(again, ["anchor", "whole"]).select("anchor", "span", "first", F.lit(1).cast("long").alias("windows")).distinct()
    found = cut(kinds.filter("n > 1").select("anchor", "span", F.lit(0).cast("long").alias("first"), "windows").union(parts))
    each = shared.select("rk", "at", "anchor", "span").join(found, ["anchor", "span"])
    return each.select("rk", (F.col("at") + F.col("first")).alias("start"), (F.col("at") + F.col("first") + F.col("windows") + (width - 1)).alias("stop"))


def byte_ranges(raw: bytes, cover: list[dict]) -> list[dict]:
    """Ranges of words as ranges of bytes, from the first word's first byte to the last word's last."""
    words = Words([raw])
    return [{"start": int(words.start[a]), "stop": int(words.end[b - 1])} for a, b in merged(cover)]


def merged(cover: list[dict]) -> list[tuple[int, int]]:
    """Ranges in order, those that touch or overlap joined."""
    out: list[list[int]] = []
    for start, stop in sorted((r["start"], r["stop"]) for r in cover):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [(a, b) for a, b in out]


def without_repeats(docs: DataFrame, length: int = 400, carry: list[str] | None = None, as_text: bool = False, words: int | None = None) -> DataFrame:
    """row (the carried columns; by default all), kept (remaining bytes), n_bytes, n_removed, n_spans of each document.

    words: passages of that many words that also start elsewhere go too, both being judged on the input.
    as_text: kept is text, without bytes that no longer make a character. Null text: empty. The columns stay inside `row`, so names can't
    clash. An empty table gives no rows.
    """
    lists = repeated_bytes(docs, length).groupBy("rk").agg(F.collect_set(F.struct("start", "stop")).alias("cover"))
    rows = docs.select((packed(docs) if carry is None else F.struct(*carry)).alias("row"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("raw"), row_key(F.col("doc_id"), F.col("text")).alias("rk"))
    met = rows.join(lists, "rk", "left")
    if words is None:
        met = met.withColumn("passages", F.lit(None).cast(met.schema["cover"].dataType))
    else:
        met = met.join(repeated_words(docs, words).groupBy("rk").agg(F.collect_set(F.struct("start", "stop")).alias("passages")), "rk", "left")
    met = met.select("row", "raw", "cover", "passages")

    def keep(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(parts, "raw"):
            raws, kept, sizes, removed, spans_gone = part["raw"].to_pylist(), [], [], [], []
            for raw, cover, passages in zip(raws, part["cover"].to_pylist(), part["passages"].to_pylist(), strict=True):
                gone = merged((cover or []) + (byte_ranges(raw, passages) if passages else []))
                edges = [0, *(x for r in gone for x in r), len(raw)]
                left = b"".join(raw[a:b] for a, b in zip(edges[0::2], edges[1::2], strict=True))
                kept.append(left.decode("utf-8", "ignore") if as_text else left)
                sizes.append(len(raw))
                removed.append(len(raw) - len(left))
                spans_gone.append(len(gone))
            yield pa.RecordBatch.from_arrays([part["row"], pa.array(kept, pa.string() if as_text else pa.binary()), *(pa.array(x, pa.int64()) for x in (sizes, removed, spans_gone))], names=["row", "kept", "n_bytes", "n_removed", "n_spans"])

    long = [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")]
    return met.mapInArrow(keep, T.StructType([met.schema["row"], T.StructField("kept", T.StringType() if as_text else T.BinaryType()), *long]))


def trimmed_documents(docs: DataFrame, length: int = 400, words: int | None = None) -> DataFrame:
    """The documents' own columns, text being what is left of it; bytes that no longer make a character go too. A null text stays null."""
    texts = without_repeats(docs, length, as_text=True, words=words)
    text = F.when(F.col("row.text").isNotNull(), F.col("kept"))
    own = {"text": text} | ({"n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return texts.select(*[own.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
