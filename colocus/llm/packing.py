"""Vector bin packing of token pieces under limits on tokens, segments and loss-bearing tokens.

A sequence is a bin with three capacities. The next piece for a bin is the one
with the largest dot product of its demand and the bin's free space, both as
shares of the capacities. When none fits, the piece that scores best is cut so
that it fills the gap.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colocus.llm.common import batches_of, lean, saved, shared_folder, text_of
from colocus.llm.token_files import default_tokenizer
from colocus.llm.tokens import encoder

MAX_TOKENS, MAX_SEGMENTS = 2048, 256
#: Pieces that compete for the open bin at a time; the rest wait, so time stays in proportion.
BLOCK = 2048
SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("task", pa.int32()), ("local_sequence", pa.int64()), ("offset", pa.int64())])


class Packer:
    """Places runs (document, start, length, loss) into bins; ``closed`` gets (sequence, [(document, start, length)])."""

    def __init__(self, max_tokens: int, max_segments: int, max_loss: int):
        self.limits = np.array([max_tokens, max_segments, max_loss], np.int64)
        self.wait: list[tuple[int, int, int, int]] = []
        self.sequence = 0

    def _close(self, parts: list[tuple[int, int, int]]):
        self.sequence += 1
        return self.sequence - 1, parts

    def add(self, doc: int, total: int, prompt: int = 0):
        """Whole sequences leave at once; the rest of the document waits. The first ``prompt`` ids bear no loss."""
        at, (most, _, loss) = 0, (int(x) for x in self.limits)
        while total - at >= most and (loss >= most or most - max(0, prompt - at) <= loss):
            yield self._close([(doc, at, most)])
            at += most
        while total - at > 0:
            size = min(total - at, most, max(1, max(0, prompt - at) + loss))
            self.wait.append((doc, at, size, max(0, size - max(0, prompt - at))))
            at += size

    def drain(self, last: bool = False):
        """Fill bins from the waiting pieces, a block at a time; unless it is the last call, half a block stays."""
        while len(self.wait) > (0 if last else BLOCK):
            block, self.wait = self.wait[:BLOCK], self.wait[BLOCK:]
            yield from self._block(block, last and not self.wait)

    def _block(self, block: list[tuple[int, int, int, int]], last: bool):
        demand = np.array([(size, 1, loss) for _, _, size, loss in block], np.float64).reshape(-1, 3)
        open_, left = np.ones(len(block), bool), len(block)
        size, loss = (np.ascontiguousarray(demand[:, i]) for i in (0, 2))
        while left and (last or left > BLOCK // 2):
            free, parts = self.limits.astype(np.float64), []
            while left and free[1] >= 1:
                weight = free / self.limits / self.limits
                score = size * weight[0]
                score += loss * weight[2] + weight[1]
                score[~open_ | (size > free[0]) | (loss > free[2])] = -1.0
                best = int(score.argmax())
                if score[best] < 0:
                    break
                doc, at, n, _ = block[best]
                parts.append((doc, at, n))
                free -= demand[best]
                open_[best] = False
                left -= 1
            if left and free[0] >= 1 and free[1] >= 1:
                cut = self._cut(block, demand, open_, free)
                if cut is not None:
                    parts.append(cut)
                    size, loss = (np.ascontiguousarray(demand[:, i]) for i in (0, 2))
            yield self._close(parts)
        self.wait = [block[i] for i in np.flatnonzero(open_)] + self.wait

    def _cut(self, block, demand, open_, free):
        """The head of the largest waiting piece, as long as the gap; its tail stays in the block."""
        i = int(np.where(open_, demand[:, 0], -1).argmax())
        doc, at, size, loss = block[i]
        take = min(int(free[0]), size - 1)
        plain = size - loss
        take = min(take, plain + int(free[2]))
        if take < 1:
            return None
        block[i] = (doc, at + take, size - take, loss - max(0, take - plain))
        demand[i] = (size - take, 1, block[i][3])
        return doc, at, take


def powers(parts: list[tuple[int, int, int]], most: int) -> list[list[tuple[int, int, int]]]:
    """An unfilled last sequence as sequences whose lengths are powers of two, which need no padding."""
    total = sum(x[2] for x in parts)
    if total in (0, most):
        return [parts] if parts else []
    sizes = [1 << k for k in range(total.bit_length() - 1, -1, -1) if total >> k & 1]
    found: list[list[tuple[int, int, int]]] = []
    queue = list(reversed(parts))
    for size in sizes:
        own, need = [], size
        while need:
            doc, at, n = queue.pop()
            take = min(n, need)
            own.append((doc, at, take))
            need -= take
            if take < n:
                queue.append((doc, at + take, n - take))
        found.append(own)
    return found


def pack(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int | None = None, keep_cache: bool = True, prompt: str | None = None) -> DataFrame:
    """Every id of every document in exactly one piece of one sequence.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id (from 0,
    without gaps), offset. docs needs doc_id and text; other columns are left
    out. A null text is empty: its end id alone. Equal rows are packed apart.
    An empty table gives no rows. max_loss limits the loss-bearing ids of a
    sequence (default: no limit but max_tokens). prompt names a column with the
    number of a document's first ids that bear no loss (null, negative: 0; more
    than it has: all); without it all ids bear loss. Each task packs what it reads
    and leaves at most one sequence unfilled, which it splits into powers of
    two; nothing is shuffled but the number of sequences of each task.
    keep_cache: a worker keeps its encoded pieces for its next task; without it
    tasks take longer and workers less memory between them.
    """
    plain = F.lit(0) if prompt is None else F.greatest(F.coalesce(F.col(f"`{prompt}`").cast("long"), F.lit(0)), F.lit(0))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"), plain.cast("long").alias("plain"))
    loss_limit = max_tokens if max_loss is None else max_loss

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer, task = encoder(tokenizer), Packer(max_tokens, max_segments, loss_limit), TaskContext.get().partitionId()
        names: list[int | None] = []
        totals: list[int] = []
        kept: dict[int, np.ndarray] = {}
        waiting_for: dict[int, int] = {}
        out: list[tuple] = []

        def emit(closed):
            number, parts = closed
            offset = 0
            for doc, at, n in parts:
                ids = kept[doc][at : at + n]
                out.append((names[doc], at, n, zlib.crc32(ids.astype("<u4").tobytes()), totals[doc], task, number, offset))
                offset += n
                waiting_for[doc] -= n
                if not waiting_for[doc]:
                    del waiting_for[doc], kept[doc]

        def rows_out():
            batch = pa.RecordBatch.from_pydict({f.name: [r[i] for r in out] for i, f in enumerate(SCHEMA)}, schema=SCHEMA)
            out.clear()
            return batch

        for table in batches_of(stream, 4 << 20):
            flat, lengths = enc.encode(table.column(1).to_pylist())
            ends = np.cumsum(lengths)
            for name, e, n, plain in zip(table.column(0).to_pylist(), ends, lengths, table.column(2).to_pylist(), strict=True):
                doc = len(names)
                names.append(name)
                totals.append(int(n) + 1)
                kept[doc] = np.append(flat[e - n : e], np.uint32(end_id))
                waiting_for[doc] = int(n) + 1
                for closed in packer.add(doc, int(n) + 1, min(plain, int(n) + 1)):
                    emit(closed)
            for closed in packer.drain():
                emit(closed)
            if out:
                yield rows_out()
        unfilled = []
        for closed in packer.drain(last=True):
            if sum(x[2] for x in closed[1]) == max_tokens:
                emit((closed[0] - len(unfilled), closed[1]))
            else:
                unfilled.append(closed)
        number = packer.sequence - len(unfilled)
        for _, parts in unfilled:
            for own in powers(parts, max_tokens):
                emit((number, own))
                number += 1
        if out:
            yield rows_out()
        if not keep_cache:
            enc.forget()

    placed = saved(rows.mapInArrow(lean(run), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task int, local_sequence long, offset long"), f"{folder}/pieces")
    tasks = placed.groupBy("task").agg((F.max("local_sequence") + 1).alias("n"))
    first = F.coalesce(F.sum("n").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row per task
    return placed.join(tasks.select("task", first.alias("first")), "task").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.col("local_sequence")).alias("sequence_id"), "offset"
    )


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, shared_folder(spark, "op10"), default_tokenizer())
