"""Best-fit packing: best-fit decreasing over all documents, with a segment tree over the remaining capacities of the open bins.

A bin's room is a number from 0 to the capacity, so the tree's leaves are the rooms and hold the bins that have just that room, as ranges of
bin numbers. The tightest bin for a length is the first filled leaf from that length on: one walk of logarithmic length. Pieces of one length
are alike, so the walk is made once for a run of them, which goes to a range of bins with the same room; the outcome is that of placing one
piece after the other. What the driver holds follows from the capacity alone (a count for each length, and the runs), never from the
number of documents. The pieces themselves get a number among those of their length and meet their run in a join.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lureline.llm.common import cut
from lureline.llm.tokens import encoder, runs

PIECES = "part int, doc_id long, piece int, start long, length long, ids_crc32 long, nth long, ids binary"


class RoomTree:
    """Bins by remaining room, for rooms 1 to capacity. A node is true if a bin lies below it."""

    def __init__(self, capacity: int) -> None:
        self.width = 1 << capacity.bit_length()
        self.filled = [False] * (2 * self.width)
        self.ranges: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _mark(self, room: int) -> None:
        at = room + self.width
        self.filled[at] = bool(self.ranges[room])
        while at > 1:
            at //= 2
            self.filled[at] = self.filled[2 * at] or self.filled[2 * at + 1]

    def push(self, room: int, first: int, n: int) -> None:
        """n bins from number `first` on now have this room; full ones need no place."""
        if n and room:
            held = self.ranges[room]
            if held and sum(held[-1]) == first:
                held[-1] = (held[-1][0], held[-1][1] + n)
            else:
                held.append((first, n))
            self._mark(room)

    def pop(self, room: int) -> tuple[int, int]:
        out = self.ranges[room].pop()
        self._mark(room)
        return out

    def tightest(self, need: int) -> int | None:
        """The smallest room of `need` or more that a bin has."""
        at = need + self.width
        if self.filled[at]:
            return need
        while at > 1:
            if at % 2 == 0 and self.filled[at + 1]:
                at += 1
                while at < self.width:
                    at = 2 * at if self.filled[2 * at] else 2 * at + 1
                return at - self.width
            at //= 2
        return None


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, at, n, bin, each, offset): pieces `at` to `at + n - 1` of a length go to bins from `bin` on, `each` in a bin, from `offset` on.

    At most capacity^2 runs: a length touches each range of bins once and leaves at most two ranges more than it found.
    """
    tree, runs, opened = RoomTree(capacity), [], 0
    for length in sorted(counts, reverse=True):
        at, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first, n = capacity, opened, -(-left // (capacity // length))
                opened += n
            else:
                first, n = tree.pop(room)
            each = room // length  # a bin just used is the tightest until no more fits
            taken = min(left, n * each)
            full, rest = divmod(taken, each)
            runs.append((length, at, taken, first, each, capacity - room))
            tree.push(room, first + full + (rest > 0), n - full - (rest > 0))
            tree.push(room - rest * length, first + full, int(rest > 0))
            tree.push(room - each * length, first, full)
            at, left = at + taken, left - taken
    return runs


def pieces(docs: DataFrame, path: str, length: int = 1024, end_id: int = 2) -> DataFrame:
    """Each document's ids and end id; longer ones are cut into pieces of `length`, of which the first may be shorter. Written once.

    Null text: empty, so one piece with the end id alone. Null ids stay null. Repeated rows give repeated pieces. part: the task; nth:
    the piece's number among those of its task and length.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    end = int(end_id).to_bytes(4, "little")

    def cut_up(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        of, task, met = encoder(path), TaskContext.get().partitionId(), [0] * (length + 1)
        for run in runs(parts):
            out = []
            for (doc, _), ids in zip(run, of.encode([r[1] for r in run]), strict=True):
                ids += end
                total = len(ids) // 4
                first = total % length or length
                edges = [0, *range(min(first, total), total, length), total]
                for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                    own = ids[4 * a : 4 * b]
                    out.append((task, doc, k, a, b - a, zlib.crc32(own), met[b - a], own))
                    met[b - a] += 1
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[c.split()[0] for c in PIECES.split(", ")])

    return cut(rows.mapInArrow(cut_up, PIECES))


def pack(docs: DataFrame, path: str, length: int = 1024, end_id: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset, ids (little-endian unsigned 32-bit).

    Pieces are numbered within their length by task and place in it, so a hot length or repeated rows gather in no task. Sequences are
    filled without gaps; ties between bins of equal room go to the range opened last. Only doc_id and text are read, so other columns can't
    clash. An empty table gives no rows.
    """
    spark = docs.sparkSession
    held = pieces(docs, path, length, end_id)
    counts = cut(held.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")))
    total = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row for each length at most
    runs = spark.createDataFrame(best_fit(total, length), "length long, at long, n long, bin long, each long, first long")
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    base = counts.select("part", F.struct("length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")).alias("b"))
    base = base.groupBy("part").agg(F.map_from_entries(F.collect_list("b")).alias("bases"))
    numbered = held.join(base, "part").withColumn("number", F.element_at("bases", F.col("length")) + F.col("nth")).drop("bases")
    r = F.broadcast(runs.withColumnRenamed("length", "run_length"))
    placed = numbered.join(r, (F.col("length") == F.col("run_length")) & (F.col("number") >= F.col("at")) & (F.col("number") < F.col("at") + F.col("n")))
    within = F.col("number") - F.col("at")
    sequence = F.col("bin") + F.floor(within / F.col("each")).cast("long")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"), (F.col("first") + within % F.col("each") * F.col("length")).alias("offset"), "ids")
