"""Packing token pieces into sequences: first-fit decreasing over a tournament tree of bin capacities, in random groups of documents."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lureline.llm.tokens import encoder, runs

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, grp long, ids binary"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_length long, ids binary"


def first_fit(lengths: list[int], capacity: int) -> list[int]:
    """The bin of each item: the first bin with room, items in the given order (decreasing for first-fit decreasing).

    The tree's leaves are the bins' free room and each inner node is the larger of its two children, so the first bin with room is
    found by one walk from the root.
    """
    width = 1
    while width < len(lengths):
        width *= 2
    tree = [capacity] * (2 * width)
    out = []
    for n in lengths:
        at = 1
        while at < width:
            at *= 2
            if tree[at] < n:
                at += 1
        out.append(at - width)
        tree[at] -= n
        while at > 1:
            at //= 2
            room = max(tree[2 * at], tree[2 * at + 1])
            if tree[at] == room:
                break
            tree[at] = room
    return out


def pieces(docs: DataFrame, path: str, length: int = 1024, end_id: int = 0, group_docs: int = 4_096, with_ids: bool = True, seed: int = 17) -> DataFrame:
    """Each document's ids and end id, cut every `length` ids, with the random group of documents it is packed in.

    The group is drawn from id and text; a row that is met again in a task is drawn anew with the task and the number of times, so that
    repeated rows spread over the groups too. Null text: empty, so one piece with the end id alone. Null ids stay null. Repeated rows give
    repeated pieces. Only doc_id and text are read, so other columns can't clash. with_ids: also the ids of each piece (little-endian
    unsigned 32-bit).
    """
    groups = max(1, -(-docs.count() // group_docs))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("drawn", F.xxhash64("doc_id", "text", F.lit(seed)))
    end = int(end_id).to_bytes(4, "little")

    def cut_up(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        of, task, met = encoder(path), TaskContext.get().partitionId(), Counter()
        kinds = (*[pa.int64()] * 6, pa.binary())
        for run in runs(parts):
            out = []
            for (doc, _, drawn), ids in zip(run, of.encode([r[1] for r in run]), strict=True):
                ids += end
                total = len(ids) // 4
                again, met[drawn] = met[drawn], met[drawn] + 1
                grp = (drawn + zlib.crc32(b"%d %d" % (task, again)) * (again > 0)) % groups
                for at in range(0, total, length):
                    own = ids[4 * at : 4 * (at + length)]
                    out.append((doc, at, len(own) // 4, zlib.crc32(own), total, grp, own if with_ids else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[c.split()[0] for c in PIECES.split(", ")])

    return rows.mapInArrow(cut_up, PIECES)


def placed(group: pa.Table, length: int) -> pa.Table:
    """The sequence, offset and padded length of each piece of one group; the pieces stay where they are."""
    column = {c: group[c].fill_null(0).to_numpy() for c in ("length", "doc_id", "start", "ids_crc32")}
    known = group["doc_id"].is_valid().to_numpy()
    order = np.lexsort((column["ids_crc32"], column["start"], column["doc_id"], known, -column["length"]))
    sizes = column["length"][order]
    full = int((sizes == length).sum())
    bins = np.concatenate([np.arange(full), full + np.array(first_fit(sizes[full:].tolist(), length), dtype=np.int64)]).astype(np.int64)
    line = np.argsort(bins, kind="stable")
    before = np.cumsum(sizes[line]) - sizes[line]
    new = np.r_[True, np.diff(bins[line]) > 0]
    first = before[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
    filled = np.bincount(bins, weights=sizes).astype(np.int64)
    padded = np.where(filled & (filled - 1), length, filled)
    sequence, offset, room = (np.empty(len(bins), np.int64) for _ in range(3))
    sequence[order], room[order] = (group["grp"][0].as_py() << 32) + bins, padded[bins]
    offset[order[line]] = before - first
    out = group.drop_columns(["grp", "ids"])
    for name, own in (("sequence_id", sequence), ("offset", offset), ("padded_length", room)):
        out = out.append_column(name, pa.array(own, pa.int64()))
    return out.append_column("ids", group["ids"])


def pack(docs: DataFrame, path: str, length: int = 1024, end_id: int = 0, group_docs: int = 4_096, with_ids: bool = True) -> DataFrame:
    """Pieces with their sequence, their place in it and their ids.

    Each random group of about `group_docs` documents is packed by itself: a group is bounded however the sources or copies are spread,
    and loses less than a sequence or so of room. Full pieces are sequences of their own. A sequence is padded to `length` (padded_length)
    unless it is filled to a power of two. An empty table gives no rows.
    """
    return pieces(docs, path, length, end_id, group_docs, with_ids).groupBy("grp").applyInArrow(lambda group: placed(group, length), PACKED)
