"""SimHash near duplicates by a grid range-join over segment popcounts.

A 64-bit fingerprint is read as 32 segments of two bits; the numbers of set bits
per segment are a point with 32 coordinates from 0 to 2. Flipping a bit moves the
point by one step, so the Manhattan distance of two points is at most the
Hamming distance of their fingerprints. Points are written in unary (00, 01, 11
per coordinate), where the Manhattan distance is a popcount as well.

The range join: two points within 5 steps are within 2 steps in one half of
their coordinates, and then both halves are at most one step from a common cell
of the unit grid. Each fingerprint goes to the cell of either half and to the
cells one step away (some 50 in all). Those who meet in a cell are compared by
Manhattan distance, then by their bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colocus.llm.common import LOWER, batches_of, drop, lean, saved, shared_folder, text_of
from colocus.llm.components import components

WIDTH, SEED, MOST_BITS = 4, 42, 4
BATCH_BYTES, CHUNK = 4 << 20, 100_000
#: Visits to cells that one task handles, and the size up to which cells are compared side by side.
VISITS_EACH, SMALL_CELL = 500_000, 256
U = np.uint64
ODD_BITS = U(0x5555555555555555)


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """Bits set in over half the XXH64 values of a text's word shingles; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n, counts = len(words) - width + 1, np.zeros(64, np.int64)
    for low in range(0, n, CHUNK):
        high = min(n, low + CHUNK)
        spans = zip(starts[low:high].tolist(), ends[low + width - 1 : high + width - 1].tolist(), strict=True)
        h = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), "<u8", high - low)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) for every row of docs."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(stream, BATCH_BYTES):
            found = np.fromiter((fingerprint(t, width) for t in batch.column("text").to_pylist()), U, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").combine_chunks(), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInArrow(lean(run), "doc_id long, fp long")


def points(x: np.ndarray) -> np.ndarray:
    """Set bits of each two-bit segment in unary: 00, 01 or 11."""
    y = x >> U(1)
    return ((x | y) & ODD_BITS) | ((x & y & ODD_BITS) << U(1))


def cells(x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(step, which, cell): the fingerprints that the step leads to a cell of the grid, and the cells.

    Steps 0 and 33 lead to the cells of the lower and the upper half of the
    point, the others to those one unary bit away.
    """
    p = points(x)
    for half in range(2):
        own = (p >> U(32 * half)) & U(0xFFFFFFFF)
        for k in range(33):
            at = own if not k else own ^ (U(1) << U(k - 1))
            valid = np.flatnonzero(~((~at & (at >> U(1))) & ODD_BITS).astype(bool))  # no coordinate is 10
            yield 33 * half + k, valid, at[valid] | U(half << 32)


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the trees of a[i] and b[i]; every entry of parent is a root before and after."""
    while True:
        a, b = parent[a], parent[b]
        apart = a != b
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (parent != (up := parent[parent])).any():
            parent[:] = up


def near(x: np.ndarray, p: np.ndarray, i: np.ndarray, j: np.ndarray, most: int) -> np.ndarray:
    """Which pairs (i, j) are within ``most`` bits; the Manhattan distance of their points comes first."""
    out = np.bitwise_count(p[i] ^ p[j]) <= most
    at = np.flatnonzero(out)
    out[at] = np.bitwise_count(x[i[at]] ^ x[j[at]]) <= most
    return out


def meet(cell: np.ndarray, of: np.ndarray, x: np.ndarray, most: int) -> np.ndarray:
    """Roots of x under the links found in cells; ``of`` are the visitors (places in x) of each entry of ``cell``.

    Small cells are compared all at once, by growing distance of places. In a
    large one, a visitor that is near no earlier leader becomes a leader and is
    compared with all; then only visitors outside its largest tree are left to
    compare. Pairs of one tree are not compared again and pairs are not listed.
    """
    order = np.argsort(cell, kind="stable")
    cell, of = cell[order], of[order]
    p, parent = points(x), np.arange(len(x))
    edges = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]]))
    sizes = np.diff(edges)
    after = np.repeat(edges[1:], sizes) - np.arange(len(cell))  # visitors of the cell from here on, this one included
    places = np.flatnonzero(np.repeat(sizes <= SMALL_CELL, sizes))
    for step in range(1, SMALL_CELL):
        places = places[after[places] > step]
        if not len(places):
            break
        i, j = of[places], of[places + step]
        open_ = parent[i] != parent[j]
        i, j = i[open_], j[open_]
        linked = near(x, p, i, j, most)
        unite(parent, i[linked], j[linked])
    for low, high in zip(edges[:-1][sizes > SMALL_CELL], edges[1:][sizes > SMALL_CELL], strict=True):
        own = of[low:high]
        covered, asked = np.zeros(len(own), bool), np.zeros(len(own), bool)

        def ask(k: int, own=own, covered=covered, asked=asked) -> None:
            asked[k] = True
            linked = near(x, p, np.full(len(own), own[k]), own, most)
            covered[linked] = True
            unite(parent, np.full(int(linked.sum()), own[k]), own[linked])

        for k in range(len(own)):
            if not covered[k]:
                ask(k)
        roots, n = np.unique(parent[own], return_counts=True)
        for k in np.flatnonzero((parent[own] != roots[n.argmax()]) & ~asked):
            ask(int(k))
    return parent


def links(prints: DataFrame, most: int = MOST_BITS, visits_each: int = VISITS_EACH) -> DataFrame:
    """(a, b): edges that connect the distinct fingerprints ``fp`` exactly as links within ``most`` bits (5 at most) do.

    A task's edges form a forest on its fingerprints, so their number does not
    grow with the square of a group.
    """
    if not 0 <= most <= 5:
        raise ValueError("the grid finds pairs within 5 bits")
    shards = max(8, -(-prints.count() * 50 // visits_each))

    def visit(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(stream, 1 << 20):
            x = batch.column("fp").combine_chunks().to_numpy().view(U)
            steps, which, home = [], [], []
            for step, valid, at in cells(x):
                steps.append(np.full(len(valid), step, np.uint8))
                which.append(valid.astype(np.uint32))
                home.append(((at * U(0x9E3779B97F4A7C15)) >> U(33)) % U(shards))
            step, of, shard = (np.concatenate(v) for v in (steps, which, home))
            order = np.lexsort((of, shard))
            step, of, shard = step[order], of[order], shard[order]
            ends = np.searchsorted(shard, np.arange(shards + 1))
            out = []
            for s in np.unique(shard).tolist():
                who, local = np.unique(of[ends[s] : ends[s + 1]], return_inverse=True)
                out.append((s, np.array([len(who), len(local)], "<u4").tobytes() + x[who].tobytes() + local.astype(np.uint32).tobytes() + step[ends[s] : ends[s + 1]].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.int32()), pa.array([b for _, b in out], pa.binary())], names=["shard", "blob"])

    def compare(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xs, ofs, steps, shift = [], [], [], 0
        for blob in (b for batch in stream for b in batch.column(1).to_pylist()):
            n, m = (int(v) for v in np.frombuffer(blob, "<u4", 2))
            xs.append(np.frombuffer(blob, U, n, 8))
            ofs.append(np.frombuffer(blob, np.uint32, m, 8 + 8 * n).astype(np.int64) + shift)
            steps.append(np.frombuffer(blob, np.uint8, m, 8 + 8 * n + 4 * m))
            shift += n
        if not xs:
            return
        x, of, step = np.concatenate(xs), np.concatenate(ofs), np.concatenate(steps).astype(U)
        half, k = step // U(33), step % U(33)
        cell = ((points(x)[of] >> (U(32) * half)) & U(0xFFFFFFFF)) ^ np.where(k > 0, U(1) << (np.maximum(k, U(1)) - U(1)), U(0)) | (half << U(32))
        parent = meet(cell, of, x, most)
        tied = np.flatnonzero(parent != np.arange(len(x)))
        if len(tied):
            yield pa.RecordBatch.from_arrays([pa.array(x[tied].view(np.int64)), pa.array(x[parent[tied]].view(np.int64))], names=["a", "b"])

    return prints.select("fp").mapInArrow(lean(visit), "shard int, blob binary").repartition(shards, "shard").mapInArrow(lean(compare), "a long, b long")


def near_duplicates(docs: DataFrame, folder: str, width: int = WIDTH, most: int = MOST_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id for every row of docs.

    Words are runs of anything but ASCII white space, A-Z lower-cased; shingles
    count as often as they occur; texts with fewer words are one shingle. Null
    and wordless texts have fingerprint zero, which links like any other.
    component_id is the smallest doc_id that links (``most`` differing bits or
    fewer) reach. Equal rows stay; a null doc_id takes part but names a
    component only where there is no other. Other columns are left out. An
    empty table gives no rows.
    """
    spark = docs.sparkSession
    ids = saved(fingerprints(docs, width), f"{folder}/ids")
    prints = saved(ids.groupBy("fp").agg(F.min("doc_id").alias("first")), f"{folder}/prints")
    edges = saved(links(prints, most), f"{folder}/links")
    labels = components(edges, f"{folder}/labels")
    drop(spark, f"{folder}/links")
    named = prints.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    lowest = named.groupBy("label").agg(F.min("first").alias("component_id"))
    named = saved(named.join(lowest, "label").select(F.col("fp").alias("_fp"), "component_id"), f"{folder}/named")
    drop(spark, f"{folder}/labels", f"{folder}/prints")
    return ids.join(named, F.col("fp") == F.col("_fp"), "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_folder(spark, "op11"))
