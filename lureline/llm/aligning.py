"""Cross-tokenizer alignment: the tokens of two tokenizers over the same bytes, coalesced into groups, and the pairs of tokens that overlap.

All tokens of both sides are sorted by where they start (lexsort); the running maximum of their ends (maximum.accumulate) shows where a group
ends: where a start reaches it. Overlaps are then expanded within the groups. Pairs of ids are counted corpus-wide in two steps: each block
of documents counts its own pairs and names each by its rank there, and only a block's different pairs are shuffled, not its links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lureline.llm.common import cut
from lureline.llm.tokens import encoder, runs

BLOCK = "block long, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, shas array<string>, groups array<string>, links binary, pairs array<long>, times array<long>"
DOCUMENT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string"
#: A pair of ids is one number: the id of A times 2^32, plus that of B.
_LOW = np.int64((1 << 32) - 1)
#: Pairs in more than one HOT-th of all rows (block, pair): fewer than HOT of them, so their counts may be broadcast (below 1 MB).
HOT = 20_000


class Spelled:
    """Byte strings by id: all bytes joined, where each begins, and its size."""

    def __init__(self, spelled: list[bytes]) -> None:
        self.size = np.fromiter(map(len, spelled), np.int64, len(spelled))
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(spelled), np.uint8)

    def of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The joined bytes of these ids, and where each ends."""
        n = self.size[ids]
        ends = np.cumsum(n)
        return self.bytes[np.repeat(self.start[ids] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)], ends


def byte_level() -> dict[str, int]:
    """The byte behind each character of a byte-level token: printable Latin-1 stands for itself, the others follow from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


class Both:
    """The two tokenizers, with the bytes of their tokens. A gets a blank and the text; B adds its blank itself."""

    def __init__(self, path_a: str, path_b: str) -> None:
        import sentencepiece

        self.a = encoder(path_a, True)
        table = byte_level()
        vocabulary = self.a.tokenizer.get_vocab(with_added_tokens=True)
        spelled = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            spelled[i] = bytes(table[c] for c in token) if all(c in table for c in token) else token.encode()
        self.bytes_a = Spelled(spelled)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [(self.b.id_to_piece(i), self.b.is_byte(i)) for i in range(self.b.get_piece_size())]
        self.bytes_b = Spelled([bytes([int(p[3:5], 16)]) if raw else p.replace("▁", " ").encode() for p, raw in pieces])
        self.digits = Spelled([b"%d;" % i for i in range(max(len(spelled), len(pieces)))])

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        a, ends_a = self.a.flat([" " + t for t in texts])
        lists = self.b.encode(texts, num_threads=1)
        return a.astype(np.int64), ends_a, np.fromiter((i for own in lists for i in own), np.int64), np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))


@lru_cache(maxsize=1)
def both(path_a: str, path_b: str) -> Both:
    return Both(path_a, path_b)


class Aligned:
    """Groups and links of a run of texts. Texts without tokens (null, empty, other bytes on one side) have none."""

    def __init__(self, of: Both, texts: list[str | None]) -> None:
        held = [k for k, t in enumerate(texts) if t]
        some = [texts[k] for k in held]
        a, ends_a, b, ends_b = of.ids(some)
        raw = [b" " + t.encode("utf-8", "surrogatepass") for t in some]
        bytes_a, stops_a = of.bytes_a.of(a)
        bytes_b, stops_b = of.bytes_b.of(b)
        same = np.zeros(len(some), bool)
        at_a = at_b = x = y = 0
        for k, own in enumerate(raw):
            to_a, to_b = int(ends_a[k]), int(ends_b[k])
            upto_a, upto_b = (int(stops_a[to_a - 1]) if to_a else 0), (int(stops_b[to_b - 1]) if to_b else 0)
            same[k] = bytes_a[x:upto_a].tobytes() == own and bytes_b[y:upto_b].tobytes() == own
            x, y, at_a, at_b = upto_a, upto_b, to_a, to_b
        n_a, n_b = np.diff(ends_a, prepend=0), np.diff(ends_b, prepend=0)
        a, b = a[np.repeat(same, n_a)], b[np.repeat(same, n_b)]
        n_a, n_b = n_a * same, n_b * same
        self.sizes = [np.zeros(len(texts), np.int64) for _ in range(4)]  # tokens of A, of B, groups, links
        self.shas, self.groups = [""] * len(texts), [""] * len(texts)
        self.pairs = np.zeros(0, np.int64)
        if not len(a):
            return
        end = np.r_[np.cumsum(of.bytes_a.size[a]), np.cumsum(of.bytes_b.size[b])]
        start = end - np.r_[of.bytes_a.size[a], of.bytes_b.size[b]]
        side = np.r_[np.zeros(len(a), np.int8), np.ones(len(b), np.int8)]
        order = np.lexsort((side, start))
        reach = np.maximum.accumulate(end[order])
        opens = np.r_[True, start[order][1:] >= reach[:-1]]
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(opens) - 1
        doc_a, doc_b = np.repeat(np.arange(len(some)), n_a), np.repeat(np.arange(len(some)), n_b)
        doc = np.r_[doc_a, doc_b]
        # Overlaps: the tokens of B from the first that ends after a token of A starts to the last that starts before it ends.
        low = np.searchsorted(end[len(a) :], start[: len(a)], "right")
        n = np.searchsorted(start[len(a) :], end[: len(a)], "left") - low
        upto = np.cumsum(n)
        self.pairs = np.repeat(a, n) << 32 | b[np.repeat(low - (upto - n), n) + np.arange(int(upto[-1]))]
        counts = n_a, n_b, np.bincount(doc[order][opens], minlength=len(some)), np.bincount(doc_a, weights=n, minlength=len(some)).astype(np.int64)
        for into, own in zip(self.sizes, counts, strict=True):
            into[held] = own
        # The groups as text: ids in order of group and side, each with the sign that follows it.
        line = np.argsort(2 * group + side, kind="stable")
        ids, g, s, d = np.r_[a, b][line], group[line], side[line], doc[line]
        text, ends = of.digits.of(ids)
        text[ends[:-1] - 1] = np.where(g[1:] != g[:-1], ord(";"), np.where(s[1:] != s[:-1], ord("|"), ord(",")))
        text, last = text.tobytes(), np.flatnonzero(np.r_[d[1:] != d[:-1], True])
        at = 0
        for k, to in zip(d[last].tolist(), ends[last].tolist(), strict=True):
            own = text[at : to - 1]
            self.groups[held[k]], self.shas[held[k]] = own.decode(), hashlib.sha256(own).hexdigest()
            at = to


def blocks(docs: DataFrame, path_a: str, path_b: str, block_chars: int = 4_000_000, with_groups: bool = False) -> DataFrame:
    """A row for each block of about `block_chars` characters: its documents, its different pairs with their counts, and its links by the rank
    of their pair (little-endian 32-bit, most frequent first). Written once."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def each(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        of, task, number = both(path_a, path_b), TaskContext.get().partitionId(), 0
        ids, sizes, shas, groups, pairs, chars = [], [[], [], [], []], [], [], [], 0

        def closed() -> pa.RecordBatch:
            names, which, times = np.unique(np.concatenate(pairs), return_inverse=True, return_counts=True)
            by = np.argsort(-times, kind="stable")
            rank = np.empty(len(by), np.int32)
            rank[by] = np.arange(len(by))
            row = [(task << 32) + number, ids, *(np.concatenate(s) for s in sizes), shas, groups if with_groups else None, rank[which].astype("<i4").tobytes(), names[by], times[by]]
            kinds = (pa.int64(), *[pa.list_(pa.int64())] * 5, *[pa.list_(pa.string())] * 2, pa.binary(), *[pa.list_(pa.int64())] * 2)
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=[c.split()[0] for c in BLOCK.split(", ")])

        for run in runs(parts, limit=250_000):
            found = Aligned(of, [r[1] for r in run])
            ids += [r[0] for r in run]
            for into, own in zip(sizes, found.sizes, strict=True):
                into.append(own)
            shas += found.shas
            groups += found.groups if with_groups else []
            pairs.append(found.pairs)
            chars += sum(len(r[1] or "") for r in run)
            if chars >= block_chars:
                yield closed()
                ids, sizes, shas, groups, pairs, chars, number = [], [[], [], [], []], [], [], [], 0, number + 1
        if ids:
            yield closed()

    return cut(rows.mapInArrow(each, BLOCK), group_rows=2)  # about 10 MB each


def block_pairs(held: DataFrame) -> DataFrame:
    """block, rank, pair, times."""
    return held.select("block", F.posexplode(F.arrays_zip("pairs", "times")).alias("rank", "x")).select("block", "rank", "x.pairs", "x.times").withColumnRenamed("pairs", "pair")


def pair_counts(held: DataFrame) -> DataFrame:
    """pair, a, b, n (links that hold it corpus-wide), best (no pair with the same b has more), blocks (in how many blocks it is)."""
    n = block_pairs(held).groupBy("pair").agg(F.sum("times").alias("n"), F.count(F.lit(1)).alias("blocks"))
    n = cut(n.select("pair", F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND(F.lit(int(_LOW))).alias("b"), "n", "blocks"))
    top = n.groupBy("b").agg(F.max("n").alias("top"))
    return cut(n.join(top, "b").select("pair", "a", "b", "n", (F.col("n") == F.col("top")).alias("best"), "blocks"))


def align(docs: DataFrame, path_a: str, path_b: str, block_chars: int = 4_000_000, with_groups: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, groups (`a1,a2|b1;a3|b2,b3`, only with with_groups).

    n_best: links whose pair is as frequent as any other of its id of B; count_sum: the counts of all links' pairs. Texts that are null or
    empty, or whose tokens on one side spell other bytes than a blank and the text, have no tokens: zeros and ''. Null ids stay null,
    repeated rows are documents of their own and count as often. Only doc_id and text are read, so other columns can't clash. An empty
    table gives no rows.
    """
    held = blocks(docs, path_a, path_b, block_chars, with_groups)
    counts = pair_counts(held)
    rows = counts.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0]
    hot = counts.filter(F.col("blocks") * HOT > rows).select("pair", "n", "best")
    met = block_pairs(held).select("block", "rank", "pair").join(F.broadcast(hot), "pair", "left")
    cold = met.filter("n IS NULL").select("block", "rank", "pair").join(counts.select("pair", "n", "best"), "pair")
    met = met.filter("n IS NOT NULL").select("block", "rank", "n", "best").union(cold.select("block", "rank", "n", "best"))

    def scored(own: pa.Table, pairs: pa.Table) -> pa.Table:
        rank = pairs["rank"].to_numpy()
        n, best = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        n[rank], best[rank] = pairs["n"].to_numpy(), pairs["best"].to_numpy()
        links = np.frombuffer(own["links"][0].as_buffer() or b"", "<i4")

        def column(name: str) -> np.ndarray:
            return own[name].combine_chunks().flatten()

        ends = np.cumsum(column("n_links").to_numpy())
        first = ends - column("n_links").to_numpy()
        sums = [np.r_[0, np.cumsum(v[links])] for v in (best, n)]
        texts = column("groups") if with_groups else pa.nulls(len(ends), pa.string())
        return pa.Table.from_arrays([column("doc_ids"), *(column(c) for c in ("n_a", "n_b", "n_groups", "n_links")), *(pa.array(x[ends] - x[first], pa.int64()) for x in sums), column("shas"), texts], names=[c.split()[0] for c in DOCUMENT.split(", ")])

    kept = held.drop("pairs", "times").withColumnRenamed("block", "own_block")
    return kept.groupBy("own_block").cogroup(met.groupBy("block")).applyInArrow(scored, DOCUMENT)
