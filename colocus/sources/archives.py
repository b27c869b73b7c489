"""Members of zip archives, read by byte ranges and held to their checksums; digests of whole files."""

from __future__ import annotations

import hashlib
import io
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colocus.sources.store import open_file, put_file

ENTRY = "archive string, member string, at long, packed long, size long, crc long, method int, flags int"
#: A local file header up to the member's name; the binary column of a row holds less than 2 GiB.
HEADER, SIGNATURE, MOST_BYTES = 30, 0x04034B50, 2**31 - 2**20


def write_archives(rows: DataFrame, folder: str, archive_bytes: int = 64 << 20) -> DataFrame:
    """(archive, members): zip archives of the rows (member, content), at least one a partition that has rows.

    An archive ends when its contents reach ``archive_bytes``. Names and bytes
    depend on the partition alone, so a repeated task writes the same files.
    Null content is an empty member.
    """

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, held, buffer = TaskContext.get().partitionId(), 0, 0, io.BytesIO()
        archive, members = zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED), 0

        def end() -> pa.RecordBatch:
            archive.close()
            uri = f"{folder}/part-{part:05d}-{made:05d}.zip"
            put_file(uri, buffer.getvalue())
            return pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([members], pa.int64())], names=["archive", "members"])

        for batch in stream:
            for member, content in zip(batch.column("member").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if held > archive_bytes:
                    yield end()
                    made, held, members, buffer = made + 1, 0, 0, io.BytesIO()
                    archive = zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED)
                archive.writestr(zipfile.ZipInfo(member), content or b"", zipfile.ZIP_DEFLATED)
                held, members = held + len(content or b"") + len(member), members + 1
        if members:
            yield end()

    return rows.select("member", F.col("content").cast("binary").alias("content")).mapInArrow(run, "archive string, members long")


def members(archives: DataFrame) -> DataFrame:
    """The central directories of the archives (column ``archive``): where each member lies, its sizes and its CRC-32. No member is read."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("archive", pa.string()), ("member", pa.string()), ("at", pa.int64()), ("packed", pa.int64()), ("size", pa.int64()), ("crc", pa.int64()), ("method", pa.int32()), ("flags", pa.int32())])
        for uri in (u for batch in stream for u in batch.column(0).to_pylist()):
            with open_file(uri) as file, zipfile.ZipFile(file) as archive:
                found = [(uri, i.filename, i.header_offset, i.compress_size, i.file_size, i.CRC, i.compress_type, i.flag_bits) for i in archive.infolist() if not i.is_dir()]
            for low in range(0, len(found), 10_000):
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in found[low : low + 10_000]], schema=schema)

    return archives.select("archive").mapInArrow(run, ENTRY)


def unpacked(file, at: int, packed: int, size: int, crc: int, method: int, flags: int) -> tuple[bytes | None, str | None]:
    """A member's bytes, or what is wrong with them."""
    if flags & 1 or method not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        return None, "encrypted" if flags & 1 else f"method {method}"
    if size > MOST_BYTES:
        return None, "larger than a row"
    file.seek(at)
    head = file.read(HEADER)
    if len(head) < HEADER or struct.unpack("<I", head[:4])[0] != SIGNATURE:
        return None, "no member there"
    name, extra = struct.unpack("<HH", head[26:30])
    file.seek(at + HEADER + name + extra)
    raw = file.read(packed)
    try:
        content = raw if method == zipfile.ZIP_STORED else (d := zlib.decompressobj(-15)).decompress(raw, size + 1) + d.flush()
    except zlib.error:
        return None, "damaged"
    if len(raw) < packed or len(content) != size:
        return None, "wrong size"
    return (content, None) if zlib.crc32(content) == crc else (None, "wrong checksum")


def contents(entries: DataFrame, task_bytes: int = 32 << 20, batch_bytes: int = 8 << 20) -> DataFrame:
    """archive, member, content, fault of the entries that ``members`` lists, each read from its own byte range.

    Tasks get some ``task_bytes`` of packed bytes each, also out of one archive;
    a repeated task reads its ranges again and nothing else. A member that does
    not match its size and CRC-32, or cannot be read, has no content and says why
    in ``fault``.
    """
    total = entries.agg(F.sum("packed")).first()[0] or 0
    ordered = entries.repartition(max(1, -(-total // task_bytes)), "archive", "at").sortWithinPartitions("archive", "at")

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held, last, file = 0, None, None

        def batch() -> pa.RecordBatch:
            a, m, c, f = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(m), pa.array(c, pa.binary()), pa.array(f, pa.string())], names=["archive", "member", "content", "fault"])

        for rows in stream:
            for r in rows.to_pylist():
                if r["archive"] != last:
                    if file:
                        file.close()
                    last, file = r["archive"], open_file(r["archive"])
                content, fault = unpacked(file, r["at"], r["packed"], r["size"], r["crc"], r["method"], r["flags"])
                if out and held + len(content or b"") > batch_bytes:
                    yield batch()
                    out, held = [], 0
                out.append((r["archive"], r["member"], content, fault))
                held += len(content or b"") + 64
        if file:
            file.close()
        if out:
            yield batch()

    return ordered.mapInArrow(run, "archive string, member string, content binary, fault string")


def digests(files: DataFrame, block: int = 1 << 20) -> DataFrame:
    """path, bytes, sha256 of whole files, read block by block."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for uri in (u for batch in stream for u in batch.column(0).to_pylist()):
            found, n = hashlib.sha256(), 0
            with open_file(uri) as file:
                while data := file.read(block):
                    found.update(data)
                    n += len(data)
            yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([n], pa.int64()), pa.array([found.hexdigest()])], names=["path", "bytes", "sha256"])

    return files.select("path").mapInArrow(run, "path string, bytes long, sha256 string")


def manifest_faults(files: DataFrame) -> DataFrame:
    """The files (path, bytes, sha256) whose bytes are not what the manifest says: path, bytes, found_bytes, sha256, found_sha256."""
    found = digests(files).select("path", F.col("bytes").alias("found_bytes"), F.col("sha256").alias("found_sha256"))
    return files.select("path", "bytes", "sha256").join(found, "path").filter((F.col("bytes") != F.col("found_bytes")) | (F.lower("sha256") != F.col("found_sha256")))


def listed(spark: SparkSession, uris: list[str], column: str) -> DataFrame:
    """Paths as a table, a few to a task."""
    return spark.createDataFrame([(u,) for u in uris], f"{column} string").repartition(max(1, len(uris) // 4))
