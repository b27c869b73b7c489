"""Token-id files: frequency-ranked ids in byte-aligned codes with separate control bytes.

A file holds the documents of one doc_id range in ascending order. Ids are
replaced by their rank in the file's own frequency table (most frequent: 0),
so that the commonest 256 ids take one byte. Four codes share a control byte
(two bits each: bytes - 1); all control bytes lie before all data bytes.

Layout, little-endian: magic, four counts (documents, ids, ranks, data bytes)
as uint64; rank table uint32; per document doc_id int64, null flag uint8 and
length uint32; control bytes; data bytes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colocus.llm.common import get_file, put_file, range_bounds, range_index, saved, shared_folder, text_of
from colocus.llm.tokens import encoder

MAGIC = b"CLTOKID1"
#: Bytes that each of the 256 control values gives to its four codes, and their sum.
WIDTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1
FILE_BYTES = 48 << 20


def pack_codes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    values = np.asarray(values, np.uint32)
    width = 1 + (values > 0xFF).astype(np.int64) + (values > 0xFFFF) + (values > 0xFFFFFF)
    pad = -len(values) % 4
    codes = np.concatenate([width - 1, np.zeros(pad, np.int64)]).reshape(-1, 4).astype(np.uint8)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    end = np.cumsum(width)
    data = np.zeros(int(end[-1]) if len(end) else 0, np.uint8)
    for k in range(4):
        has = width > k
        data[(end - width)[has] + k] = (values[has] >> np.uint32(8 * k)).astype(np.uint8)
    return control, data


def unpack_codes(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The values again: widths by table lookup, then one gather for each byte place."""
    width = WIDTHS[control].reshape(-1)[:n]
    start = np.cumsum(width) - width
    values = data[start].astype(np.uint32) if n else np.zeros(0, np.uint32)
    for k in range(1, int(width.max(initial=1))):
        has = np.flatnonzero(width > k)
        values[has] |= data[start[has] + k].astype(np.uint32) << np.uint32(8 * k)
    return values


def to_bytes(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    seen, count = np.unique(ids, return_counts=True)
    table = seen[np.lexsort((seen, -count))].astype(np.uint32)
    rank = np.zeros(int(seen.max(initial=0)) + 1, np.uint32)
    rank[table] = np.arange(len(table), dtype=np.uint32)
    control, data = pack_codes(rank[ids])
    head = np.array([len(doc_ids), len(ids), len(table), len(data)], np.uint64)
    known = np.array([0 if d is None else d for d in doc_ids], np.int64)
    missing = np.array([d is None for d in doc_ids], np.uint8)
    return b"".join([MAGIC, head.tobytes(), table.tobytes(), known.tobytes(), missing.tobytes(), np.asarray(lengths, np.uint32).tobytes(), control.tobytes(), data.tobytes()])


def from_bytes(raw) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, lengths and ids of a file."""
    raw = memoryview(raw)
    if bytes(raw[:8]) != MAGIC:
        raise ValueError("not a token-id file")
    docs, n, ranks, data_bytes = (int(x) for x in np.frombuffer(raw, np.uint64, 4, 8))
    at = 40

    def take(kind, count: int) -> np.ndarray:
        nonlocal at
        found = np.frombuffer(raw, kind, count, at)
        at += found.nbytes
        return found

    table, known, missing, lengths = take(np.uint32, ranks), take(np.int64, docs), take(np.uint8, docs), take(np.uint32, docs)
    control, data = take(np.uint8, -(-n // 4)), take(np.uint8, data_bytes)
    ids = table[unpack_codes(control, data, n)] if n else np.zeros(0, np.uint32)
    return [None if m else int(d) for d, m in zip(known, missing, strict=True)], lengths.astype(np.int64), ids


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, rows_each: int = 4096, most_parts: int = 20_000) -> DataFrame:
    """Write all documents; returns the manifest (bucket, seq, uri, n_docs, n_ids) in the order of doc_id.

    docs needs doc_id (whole number) and text; other columns are left out. A
    null text is empty (its end id alone); null doc_ids come first; rows with
    equal doc_ids stay, ordered by their text; an empty table gives no files.
    One range shuffle of the texts; each task writes the files of its ranges
    and a retried task replaces them with equal ones.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))
    n = rows.count()
    parts = max(1, min(most_parts, -(-n // rows_each)))
    bounds = range_bounds(rows, "doc_id", parts)
    ordered = rows.withColumn("bucket", range_index(F.col("doc_id"), bounds)).repartition(max(1, len(bounds) + 1), "bucket").sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_first(), "text")

    def encode(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, held, bucket, seq, size = encoder(tokenizer), [], None, 0, 0

        def flush():
            ids, lengths = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            doc_ids = [d for h in held for d in h[2]]
            uri = f"{folder}/bucket-{bucket:06d}-{seq:04d}.ids"
            put_file(uri, to_bytes(doc_ids, lengths, ids))
            return pa.RecordBatch.from_pydict({"bucket": [bucket], "seq": [seq], "uri": [uri], "n_docs": [len(doc_ids)], "n_ids": [len(ids)]}, schema=schema)

        for batch in stream:
            buckets = batch.column(2).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.diff(buckets)) + 1
            for low, high in zip([0, *edges], [*edges, len(buckets)], strict=True):
                if low == high:
                    continue
                if bucket is not None and (buckets[low] != bucket or size >= FILE_BYTES):
                    yield flush()
                    seq = seq + 1 if buckets[low] == bucket else 0
                    held, size = [], 0
                bucket = int(buckets[low])
                texts = batch.column(1).slice(low, high - low).to_pylist()
                flat, lengths = enc.encode(texts)
                whole = np.full(len(flat) + len(texts), end_id, np.uint32)
                whole[np.arange(len(flat)) + np.repeat(np.arange(len(texts)), lengths)] = flat
                held.append((whole, lengths + 1, batch.column(0).slice(low, high - low).to_pylist()))
                size += whole.nbytes
        if held:
            yield flush()

    schema = pa.schema([("bucket", pa.int32()), ("seq", pa.int32()), ("uri", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
    return ordered.mapInArrow(encode, "bucket int, seq int, uri string, n_docs long, n_ids long")


def read(manifest: DataFrame) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids (array)."""
    return _read(manifest, "ids array<int>", lambda ids: pa.array([ids.astype(np.int32)], pa.list_(pa.int32())))


def digest(manifest: DataFrame) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32."""
    return _read(manifest, "ids_crc32 long", lambda ids: pa.array([zlib.crc32(ids.astype("<u4").tobytes())], pa.int64()))


def _read(manifest: DataFrame, column: str, made) -> DataFrame:
    first = F.sum("n_ids").over(Window.orderBy("bucket", "seq").rowsBetween(Window.unboundedPreceding, -1))  # one row per file
    placed = manifest.withColumn("first", F.coalesce(first, F.lit(0)))
    files = placed.select("uri", "first").repartition(max(1, manifest.count()), "uri")

    def decode(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                doc_ids, lengths, ids = from_bytes(get_file(uri))
                ends = np.cumsum(lengths)
                for low in range(0, len(doc_ids), 2048):
                    high = min(low + 2048, len(doc_ids))
                    parts = [made(ids[e - n : e]) for e, n in zip(ends[low:high], lengths[low:high], strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc_ids[low:high], pa.int64()), pa.array(start + ends[low:high] - lengths[low:high], pa.int64()), pa.array(lengths[low:high], pa.int64()), pa.concat_arrays(parts)],
                        names=["doc_id", "start", "n_tokens", column.split()[0]],
                    )

    return files.mapInArrow(decode, f"doc_id long, start long, n_tokens long, {column}")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "op3")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = saved(write(docs, f"{folder}/ids", default_tokenizer()), f"{folder}/manifest")
    return digest(manifest)
