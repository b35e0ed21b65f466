"""Token ids on disk: fixed-size blocks of ids, transposed into byte or bit planes, each plane compressed with zstandard, with a chunk index.

A file is a Parquet part of segments. A segment is a run of whole documents (about `segment` ids) and holds: the ids of its documents in
order, their numbers of tokens, the chunk index (for each block its first id, its number of ids, its place in the data and the sizes of
its planes), and the data. So any block can be read alone, and a segment needs no other.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lureline.llm.tokens import encoder, runs

SEGMENT = "file int, segment int, first long, n_ids long, doc_ids array<long>, doc_tokens array<long>, chunks array<struct<first:long,n:int,at:long,sizes:array<int>>>, planes string, data binary"


def to_planes(ids: np.ndarray, planes: str) -> np.ndarray:
    """(planes, bytes): byte planes are 4 rows of n bytes; bit planes are 32 rows of n bits, packed."""
    by_byte = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if planes == "byte":
        return np.ascontiguousarray(by_byte.T)
    return np.packbits(np.unpackbits(by_byte, axis=1, bitorder="little").T, axis=1)


def from_planes(rows: list[bytes], n: int, planes: str) -> np.ndarray:
    held = np.stack([np.frombuffer(r, np.uint8) for r in rows])
    if planes == "bit":
        held = np.packbits(np.unpackbits(held, axis=1, count=n).T, axis=1, bitorder="little").T
    return np.ascontiguousarray(held.T).view("<u4").ravel()


def encode_blocks(ids: np.ndarray, block: int, planes: str, level: int) -> tuple[list[dict], bytes]:
    """The chunk index and the data of a run of ids."""
    packer, chunks, data, at = zstandard.ZstdCompressor(level=level), [], [], 0
    for first in range(0, len(ids), block):
        part = ids[first : first + block]
        rows = [packer.compress(r.tobytes()) for r in to_planes(part, planes)]
        chunks.append({"first": first, "n": len(part), "at": at, "sizes": [len(r) for r in rows]})
        data += rows
        at += sum(map(len, rows))
    return chunks, b"".join(data)


def decode_block(chunk: dict, data: bytes, planes: str) -> np.ndarray:
    unpacker, at, rows = zstandard.ZstdDecompressor(), chunk["at"], []
    for size in chunk["sizes"]:
        rows.append(unpacker.decompress(data[at : at + size]))
        at += size
    return from_planes(rows, chunk["n"], planes)


def write_ids(docs: DataFrame, folder: str, path: str, end_id: int = 2, block: int = 65_536, segment: int = 1_000_000, planes: str = "byte", level: int = 3) -> None:
    """Encode whole texts (null: empty), append the end id, and write the ids in ascending order of doc_id.

    Null ids come first; rows with one id are ordered by their text, so a hot id is spread over several files too. Only doc_id and text
    are read. An empty table gives a folder without segments.
    """
    from pyspark import TaskContext

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").drop("tie")
    end = int(end_id).to_bytes(4, "little")

    def segments(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, file = encoder(path), TaskContext.get().partitionId()
        docs_in, held, number, first, n = [], [], 0, 0, 0

        def closed() -> pa.RecordBatch:
            chunks, data = encode_blocks(np.frombuffer(b"".join(held), "<u4"), block, planes, level)
            row = {"file": file, "segment": number, "first": first, "n_ids": n, "doc_ids": [d for d, _ in docs_in], "doc_tokens": [k for _, k in docs_in], "chunks": chunks, "planes": planes, "data": data}
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([("file", pa.int32()), ("segment", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("chunks", pa.list_(pa.struct([("first", pa.int64()), ("n", pa.int32()), ("at", pa.int64()), ("sizes", pa.list_(pa.int32()))]))), ("planes", pa.string()), ("data", pa.binary())]))

        for run in runs(parts):
            for (doc, _), ids in zip(run, of.encode([r[1] for r in run]), strict=True):
                held.append(ids + end)
                docs_in.append((doc, len(ids) // 4 + 1))
                n += len(ids) // 4 + 1
                if n >= segment:
                    yield closed()
                    docs_in, held, number, first, n = [], [], number + 1, first + n, 0
        if docs_in:
            yield closed()

    rows.mapInArrow(segments, SEGMENT).write.option("compression", "uncompressed").parquet(folder)


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Each document read back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and the ids (little-endian, 32 bits)."""

    def documents(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i in range(part.num_rows):
                row = part.slice(i, 1).to_pylist()[0]
                ids = b"".join(decode_block(c, row["data"], row["planes"]).tobytes() for c in row["chunks"])
                ends = np.cumsum(row["doc_tokens"]).tolist()
                own = [ids[4 * (b - k) : 4 * b] for b, k in zip(ends, row["doc_tokens"], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array([row["file"]] * len(own), pa.int32()), pa.array([row["first"] + b - k for b, k in zip(ends, row["doc_tokens"], strict=True)], pa.int64()), pa.array(row["doc_tokens"], pa.int64()), pa.array(map(zlib.crc32, own), pa.int64()), pa.array(own, pa.binary())], names=["doc_id", "file", "within", "n_tokens", "ids_crc32", "ids"])

    stored = spark.read.schema(SEGMENT).parquet(folder)
    # One row for each file: the ids in the files before it.
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = stored.groupBy("file").agg(F.sum("n_ids").alias("n")).select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    found = stored.mapInArrow(documents, "doc_id long, file int, within long, n_tokens long, ids_crc32 long, ids binary")
    return found.join(files, "file").select("doc_id", (F.col("earlier") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", "ids")
