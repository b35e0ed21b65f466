"""R: release evidence."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TRANSIENT = (".tmp", ".partial", ".bak", ".pyc", ".zip")
#: Bytes of a file that travel as one row.
PIECE = 1 << 18
#: Names whose files Spark's text reader would unpack; each of these is read whole.
PACKED = r"(?i)\.(?:gz|bz2|deflate|snappy|lz4|zst|passthrough)$"
_BOM = b"\xef\xbb\xbf"


def included(path: Column) -> Column:
    """No cache folders, hidden parts or transient files."""
    return ~path.rlike(r"(?:^|/)(?:__pycache__(?:/|$)|\.(?!github(?:/|$))[^/]+)") & ~path.rlike(r"(?i)\.(?:tmp|partial|bak|pyc|zip)$")


def _pieces(parts: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Lines of a part of a file, one after the other, as pieces of `most` bytes at most, numbered in the part."""
    held, place = None, 0
    for part in parts:
        if not part.num_rows:
            continue
        file, start, size, line = (part[c] for c in ("file", "start", "file_bytes", "line"))
        ends = np.frombuffer(line.buffers()[1], np.int32)[line.offset : line.offset + part.num_rows + 1].tolist()
        name, at = file.dictionary_encode().indices.to_numpy(), start.to_numpy()
        new = np.flatnonzero(np.r_[True, (name[1:] != name[:-1]) | (at[1:] != at[:-1])]).tolist()
        for a, b in zip(new, [*new[1:], part.num_rows], strict=True):
            own = file[a].as_py(), int(at[a])
            held, place = own, place if own == held else 0
            for k in range(ends[a], ends[b], most):
                piece = line.buffers()[2].slice(k, min(most, ends[b] - k))
                yield pa.RecordBatch.from_arrays([*(pa.array([x]) for x in (*own, place, size[a].as_py())), pa.array([piece.to_pybytes()], pa.binary())], names=["file", "start", "place", "file_bytes", "piece"])
                place += 1


def _hashed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each file from its pieces in order.

    Every line has its end here. The reader does not say whether the file's last line has one, nor whether it left out a byte order mark;
    the file's size does.
    """
    file, size, total, waiting, sums = None, 0, 0, b"", []

    def closed() -> Iterator[pa.RecordBatch]:
        if file is not None:
            ended, marked = total - size in (0, -len(_BOM)), total - size in (-len(_BOM), 1 - len(_BOM))
            if total - size not in (0, 1, -len(_BOM), 1 - len(_BOM)):
                raise ValueError(f"{file}: {total} bytes read of {size}")
            own = sums[marked]
            own.update(waiting if ended else b"")
            yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([own.hexdigest()])], names=["file", "sha256"])

    for part in parts:
        for i in range(part.num_rows):
            piece = memoryview(part["piece"][i].as_buffer())
            if (name := part["file"][i].as_py()) != file:
                yield from closed()
                file, size, total, waiting, sums = name, part["file_bytes"][i].as_py(), 0, b"", [hashlib.sha256(), hashlib.sha256(_BOM)]
            total += len(piece)
            last = len(piece) - (piece[-1] == 10)
            for own in sums:
                own.update(waiting)
                own.update(piece[:last])
            waiting = bytes(piece[last:])  # a line's end, until it is known whether it is the file's last sign
    yield from closed()


def _shown(root: str, path: Column) -> Column:
    """A path below the root, without the store's name."""
    at = F.regexp_replace(path, r"^[a-z]+:/+", "/")
    return F.substring(at, F.lit(len(re.sub(r"^[a-z]+:/+", "/", root).rstrip("/")) + 2), F.length(at))


def build(spark: SparkSession, root: str, piece: int = PIECE) -> DataFrame:
    """Path, size and hash of each file below a folder.

    A file is read in parts by many tasks, as lines of raw bytes, and hashed piece by piece in order, so no task holds it whole. Its hash is
    one chain, which one task follows. Packed files (PACKED) are read whole, each by a task.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    file, packed = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").rlike(PACKED)
    listed = files.select(_shown(root, F.col("path")).alias("path"), F.col("length").alias("size_bytes"), file).where(included(F.col("path")))
    lines = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n").text(root).where(~packed & included(_shown(root, F.col("_metadata.file_path"))))
    line = F.concat(F.col("value").cast("binary"), F.lit(bytearray(b"\n")))
    lines = lines.select(file, F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("file_bytes"), line.alias("line"))
    pieces = lines.mapInArrow(lambda parts: _pieces(parts, piece), "file string, start long, place long, file_bytes long, piece binary")
    sums = pieces.repartition("file").sortWithinPartitions("file", "start", "place").mapInArrow(_hashed, "file string, sha256 string")
    whole = files.where(packed).select(file, F.sha2("content", 256).alias("sha256"))
    empty = F.when(F.col("size_bytes") == len(_BOM), hashlib.sha256(_BOM).hexdigest())  # a mark alone is no line
    return listed.join(sums.unionByName(whole), "file", "left").select("path", "size_bytes", F.coalesce("sha256", empty).alias("sha256"))


def of_rows(rows: DataFrame, path: Column, content: Column) -> DataFrame:
    """The manifest of records kept in a table: path, size and hash of each."""
    raw = F.encode(F.coalesce(content, F.lit("")), "UTF-8")
    return rows.select(path.alias("path"), F.octet_length(raw).cast("bigint").alias("size_bytes"), F.sha2(raw, 256).alias("sha256"))


#: Hex digits of a line's hash that name its leaf, and of a leaf's name that name its branch.
LEAF, BRANCH = 4, 2


def _line() -> Column:
    return F.concat("path", F.lit("\x00"), F.col("size_bytes").cast("string"), F.lit("\x00"), "sha256", F.lit("\n"))


def tree(manifest: DataFrame) -> DataFrame:
    """R2 as a hash tree: node, digest, files, bytes. Lines are dealt to 65,536 leaves by the hash of their path, so no list holds them all;
    a branch is the hash of its leaves in order, the root (node '') that of the branches."""
    dealt = manifest.select(F.substring(F.sha2("path", 256), 1, LEAF).alias("node"), _line().alias("line"), "size_bytes")
    level = dealt.groupBy("node").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("line")), ""), 256).alias("digest"), F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes"))
    out = level
    for digits in (BRANCH, 0):
        child = F.concat("node", F.lit("="), "digest", F.lit("\n"))
        level = level.groupBy(F.substring("node", 1, digits).alias("node")).agg(
            F.sha2(F.array_join(F.sort_array(F.collect_list(child)), ""), 256).alias("digest"), F.sum("files").alias("files"), F.sum("bytes").alias("bytes"))
        out = out.unionByName(level)
    return out


def tree_diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """R3 by trees: only leaves whose digests differ are opened, then compared line by line."""
    e, a = (tree(x).where(F.length("node") == LEAF).select("node", F.col("digest").alias(n)) for x, n in ((expected, "e"), (actual, "a")))
    open_leaves = e.join(a, "node", "full_outer").where(~F.col("e").eqNullSafe(F.col("a"))).select("node")

    def opened(x: DataFrame) -> DataFrame:
        return x.withColumn("node", F.substring(F.sha2("path", 256), 1, LEAF)).join(open_leaves, "node", "left_semi").drop("node")

    return verify(opened(expected), opened(actual))


def digest(manifest: DataFrame) -> DataFrame:
    """R2: one hash over the sorted lines. The list is the manifest, a line per file, not the data."""
    line = F.concat("path", F.lit("\x00"), F.col("size_bytes").cast("string"), F.lit("\x00"), "sha256", F.lit("\n"))
    return manifest.agg(F.sha2(F.array_join(F.sort_array(F.collect_list(line)), ""), 256).alias("release_digest"), F.count(F.lit(1)).alias("file_count"), F.sum("size_bytes").alias("total_size_bytes"))


def verify(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Paths that were changed, added or removed."""
    e = expected.select("path", F.struct("size_bytes", "sha256").alias("e"))
    a = actual.select("path", F.struct("size_bytes", "sha256").alias("a"))
    state = F.when(F.col("e").isNull(), "added").when(F.col("a").isNull(), "removed").otherwise("changed")
    return e.join(a, "path", "full_outer").where(~F.col("e").eqNullSafe(F.col("a"))).select("path", state.alias("state"))


# Fixed gates: id, name, key, owner.
GOVERNANCE = (
    ("G01", "Native-language review", "native_language_review", "Language review lead"), ("G02", "Independent real-world validation", "external_real_world_validation", "Validation lead"),
    ("G03", "Bias, calibration and abstention review", "bias_calibration_review", "ML governance"), ("G04", "Legal and privacy review", "legal_privacy_review", "Legal/privacy"),
    ("G05", "Security release review", "security_release_review", "Security"), ("G06", "Git repository governance", "git_repository_governance", "Repository owner"),
    ("G07", "Production owner approval", "production_owner_approval", "Product owner"),
)


def approved() -> Column:
    said = [F.trim(F.coalesce(F.col(c), F.lit(""))) != "" for c in ("reviewer", "reviewed_at", "evidence")]
    return F.coalesce((F.col("status") == "approved") & said[0] & said[1] & said[2], F.lit(False))


def _empty(rows: DataFrame | None) -> Column:
    """Is there evidence, and does it hold no row? As a scalar of the plan; without evidence: no."""
    return F.lit(False) if rows is None else rows.agg((F.count(F.lit(1)) == 0).alias("none")).scalar()


def gates(checks: DataFrame, attestations: DataFrame, manifest_diff: DataFrame | None = None, external: DataFrame | None = None) -> DataFrame:
    """Technical gates from the checks, the manifest's differences (``verify``) and the external records found in the release; governance
    gates from the attestations. Anything missing blocks: no evidence is no pass."""
    spark = checks.sparkSession
    safe = F.min(F.when(F.col("check").isin("safe_provenance_flags", "reserved_urls_only"), F.col("passed").cast("int")))
    of = checks.agg(F.bool_and("passed").alias("every"), (F.coalesce(safe, F.lit(0)) == 1).alias("safe"))
    technical = of.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("gate"), F.lit(n).alias("name"), F.when(F.coalesce(ok, F.lit(False)), "PASS").otherwise("BLOCKED").alias("state"))
        for i, n, ok in (("T01", "Dataset validation", F.col("every")), ("T02", "Complete release manifest", _empty(manifest_diff)),
                         ("T03", "Synthetic provenance and safe indicators", F.col("safe")), ("T04", "External records excluded", _empty(external)))])))
    dim = spark.createDataFrame([(g, n, k) for g, n, k, _ in GOVERNANCE], "gate string, name string, gate_key string")
    governed = dim.join(attestations, "gate_key", "left").select("gate", "name", F.when(approved(), "PASS").otherwise("BLOCKED").alias("state"))
    return technical.unionByName(governed)


def readiness(gate_rows: DataFrame) -> DataFrame:
    """R5."""
    blocked = F.count(F.when(F.col("state") != "PASS", 1))
    technical = F.count(F.when(F.col("gate").startswith("T") & (F.col("state") != "PASS"), 1))
    return gate_rows.agg(F.when(technical == 0, "PASS").otherwise("BLOCKED").alias("technical_status"), F.when(blocked == 0, "READY_FOR_PRODUCTION").otherwise("NOT_READY_FOR_PRODUCTION").alias("overall_status"), blocked.alias("blocked_gate_count"))
