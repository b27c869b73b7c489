"""Removal of long repeated byte strings by blockwise suffix sorting with a difference cover.

Every string of ``length`` bytes holds a smallest hashed 32-byte gram, its
anchor; equal strings have equal anchors at equal places. Runs of starts with a
common anchor, with the bytes that they cover, are therefore dealt out by the
anchor's hash, and repeats are sought among runs of one anchor only. Runs that
are equal as a whole are settled by their hashes. The distinct runs of an
anchor are laid out in a block and their starts sorted as suffixes, one bucket
(anchor, distance from it) at a time; ties beyond the first bytes are resolved by the
ranks of the suffixes in a difference cover modulo 13. The anchors of a block lie at one residue, so
that the suffixes of a bucket are at the same shift from the cover. Anchors with very many distinct
runs are first split by the bytes that a narrow range of starts has in common.

Two lengths are found one after the other: a longer string can repeat only
within what repeated shorter ones cover, so the second search reads those pieces alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from colocus.llm.common import batches_of, drop, lean, ragged, saved, shared_folder, text_of
from colocus.llm.shingles import U, mix

GRAM = 32
BATCH_BYTES = 3 << 20
#: Text that is suffix-sorted at a time, suffixes of a bucket, distinct runs beyond which an anchor is split, width of its parts.
BLOCK_BYTES, BUCKET, WIDE, STEP = 4 << 20, 1 << 19, 2_000, 48
#: A perfect difference set: any two residues modulo 13 have a common shift into the cover; bytes from a residue to the next cover place.
MODULUS, COVER = 13, (0, 1, 3, 9)
AHEAD = np.array([min((c - r) % MODULUS for c in COVER) for r in range(MODULUS)])
#: Input bytes of an index shard.
SHARD_BYTES = 26 << 20
_BYTE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_POSITION = U((1 << 23) - 1)


def _dense(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1].astype(np.int64)


def heads(text: np.ndarray, more: int) -> np.ndarray:
    """The eight bytes from each place on as a number, with ``more`` places of zeros behind the text."""
    wide = np.concatenate([text, np.zeros(more + 16 - (len(text) + more) % 8, np.uint8)])
    head = np.empty(len(wide) - 8, U)
    for k in range(8):
        head[k::8] = wide[k : k + 8 * len(head[k::8])].view(">u8")
    return head


def cover_ranks(head: np.ndarray, n: int, length: int) -> np.ndarray:
    """Ranks, from 1, of the suffixes at the cover places of a text of n bytes by ``length`` bytes or more; 0 elsewhere and behind it."""
    places = np.flatnonzero(np.isin(np.arange(n) % MODULUS, COVER))
    rank = np.zeros(len(head), np.int64)
    first, rest, bits = _dense(head[places]), (head[places + 8] >> U(24)).astype(np.int64), 40
    if len(places) >> 22:
        rest, bits = _dense(rest), 31
    rank[places] = _dense((first << bits) | rest) + 1
    known = MODULUS
    while len(places) and known < length and rank.max() < len(places):
        rank[places] = _dense(rank[places] * (n + 2) + rank[places + known]) + 1
        known *= 2
    return rank


def repeated_starts(text: np.ndarray, starts: np.ndarray, bucket: np.ndarray, length: int) -> np.ndarray:
    """True for each start whose ``length`` bytes begin at another start of its bucket too.

    All starts of a bucket have one residue. Buckets are sorted a few at a time,
    BUCKET suffixes or one bucket: by the bytes before the next cover place, then by its rank.
    """
    hit = np.zeros(len(starts), bool)
    if len(starts) < 2:
        return hit
    head = heads(text, 2 * length)
    rank = cover_ranks(head, len(text), length)
    ahead = AHEAD[starts % MODULUS]
    before = np.where(ahead > 0, head[starts] >> (U(64) - U(8) * np.maximum(ahead, 1).astype(U)), U(0)).astype(np.int64)
    by_bucket = np.argsort(bucket, kind="stable")
    own = bucket[by_bucket]
    low = 0
    while low < len(own):
        high = min(low + BUCKET, len(own))
        if high < len(own):
            high = int(np.searchsorted(own, own[high - 1], side="right"))
        at = by_bucket[low:high]
        same_bucket = _dense(own[low:high])
        tie = _dense((same_bucket << 40) | before[at])
        after = rank[starts[at] + ahead[at]]
        order = np.argsort(tie * (len(text) + 2) + after)
        at, tie, after = at[order], tie[order], after[order]
        near = np.flatnonzero(tie[1:] == tie[:-1])
        same = after[near] == after[near + 1]  # equal ranks: equal for more than the length, or cut off by the text's end
        x, y = starts[at[near]], starts[at[near + 1]]
        open_ = np.flatnonzero(~same)
        for k in range(0, length, 8):
            k = min(k, length - 8)
            open_ = open_[head[x[open_] + k] == head[y[open_] + k]]
        same[open_] = True
        hit[at[near[same]]] = True
        hit[at[near[same] + 1]] = True
        low = high
    return hit


def anchored_runs(data: np.ndarray, edges: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of starts with a common anchor: document, first and last start, anchor (all as places in ``data``), anchor hash."""
    n, none = len(data), np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, none.astype(U)
    with np.errstate(over="ignore"):
        h, size = _BYTE[data], 1
        factor = U(0x9E3779B97F4A7C15)
        while size < GRAM:
            h = h[:-size] * factor + h[size:]
            factor, size = factor * factor, size * 2
        h = mix(h)
    low = (h & ~_POSITION) | np.arange(len(h), dtype=U)
    window, have = length - GRAM + 1, 1
    while have * 2 <= window:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    rest = window - have
    low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
    anchor = (low & _POSITION).astype(np.int64)
    sizes = np.diff(edges)
    spans = np.maximum(sizes - length + 1, 0)
    starts = ragged(edges[:-1], spans)
    doc = np.repeat(np.arange(len(sizes)), spans)
    anchor = anchor[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return doc[first], starts[first], starts[last], anchor[first], h[anchor[first]]


def _name(doc_id: int | None, data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(data, seed=xxhash.xxh3_64_intdigest(repr(doc_id).encode())) - (1 << 63)


def _pieces(raw: list[bytes]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Documents joined up to a few MB: their numbers, bytes and edges. Longer documents come in parts that overlap (see _runs)."""
    held, size = [], 0
    for i, data in enumerate(raw):
        if held and size + len(data) > BATCH_BYTES:
            yield held, np.frombuffer(b"".join(raw[j] for j in held), np.uint8), np.cumsum([0, *(len(raw[j]) for j in held)])
            held, size = [], 0
        held.append(i)
        size += len(data)
    if held:
        yield held, np.frombuffer(b"".join(raw[j] for j in held), np.uint8), np.cumsum([0, *(len(raw[j]) for j in held)])


def _runs(raw: list[bytes], length: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, first start, last start, anchor, anchor hash) with places inside the document."""
    most = int(_POSITION) - length
    for docs, data, edges in _pieces(raw):
        if len(data) <= most:
            for d, lo, hi, a, h in zip(*(x.tolist() for x in anchored_runs(data, edges, length)), strict=True):
                yield docs[d], lo - int(edges[d]), hi - int(edges[d]), a - int(edges[d]), h
            continue
        step = most - length  # one very long document: parts that share length - 1 bytes have all starts once
        for at in range(0, len(data) - length + 1, step):
            part = data[at : at + step + length - 1]
            for _, lo, hi, a, h in zip(*(x.tolist() for x in anchored_runs(part, np.array([0, len(part)]), length)), strict=True):
                yield docs[0], lo + at, hi + at, a + at, h


#: low is its complement where other runs of the batch, settled there, are equal.
RUN = np.dtype([("hash", "<u8"), ("context", "<u8"), ("name", "<i8"), ("low", "<i4"), ("high", "<i4"), ("anchor", "<i4")])


def _deal(records: np.ndarray, shards: int) -> list[tuple[int, bytes]]:
    shard = (records["hash"] % U(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    edges = np.searchsorted(shard[order], np.arange(shards + 1))
    return [(s, records[order[edges[s] : edges[s + 1]]].tobytes()) for s in range(shards) if edges[s] < edges[s + 1]]


def _indexed(rows: DataFrame, length: int, shards: int) -> DataFrame:
    """A row for each document (shard null), one for each batch and shard with its runs, and one
    for each batch (shard -1) with those that are equal within the batch. Only one of them goes to its shard."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(stream, 4 * BATCH_BYTES):
            ids, raw = batch.column("doc_id").to_pylist(), batch.column("data").to_pylist()
            names = [_name(i, x) for i, x in zip(ids, raw, strict=True)]
            n = len(ids)
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.array(ids, pa.int64()), pa.array(map(len, raw), pa.int64()), pa.array(names, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in raw])], schema=schema)
            digest = xxhash.xxh3_64_intdigest
            # the hash also names the places of the run around its anchor, so equal contexts have equal starts
            found = np.array([(h, digest(raw[d][lo : hi + length], seed=(a - lo) << 32 | hi - a + (1 << 20)), names[d], lo, hi, a) for d, lo, hi, a, h in _runs(raw, length)], RUN)
            found = found[np.lexsort((found["context"], found["hash"]))]
            first = np.ones(len(found), bool)
            first[1:] = (found["hash"][1:] != found["hash"][:-1]) | (found["context"][1:] != found["context"][:-1])
            equal = np.repeat(c := np.diff(np.flatnonzero(first), append=len(found)), c) > 1
            settled = found[equal].tobytes()
            found["low"] = np.where(equal, ~found["low"], found["low"])
            blobs = [*_deal(found[first], shards), *([(-1, settled)] if settled else [])]
            m = len(blobs)
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in blobs], pa.int32()), pa.array([b for _, b in blobs], pa.binary()), *[pa.nulls(m, pa.int64())] * 3, pa.nulls(m, pa.string())], schema=schema)

    schema = pa.schema([("shard", pa.int32()), ("blob", pa.binary()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("name", pa.int64()), ("sha256", pa.string())])
    return rows.mapInArrow(lean(run), "shard int, blob binary, doc_id long, n_bytes long, name long, sha256 string")


_ACT = "name long, hash long, low int, high int, anchor int, kind int, copied boolean"


def _acts(part: np.ndarray, kinds: np.ndarray, copied: np.ndarray) -> Iterator[pa.RecordBatch]:
    for low in range(0, len(part), 50_000):
        p = part[low : low + 50_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array(p["name"].copy()), pa.array(p["hash"].copy().view(np.int64)), *[pa.array(p[c].copy()) for c in ("low", "high", "anchor")], pa.array(kinds[low : low + 50_000].astype(np.int32)), pa.array(copied[low : low + 50_000])],
            names=["name", "hash", "low", "high", "anchor", "kind", "copied"],
        )


def _grouped(index: DataFrame, shards: int) -> DataFrame:
    """Runs to act on: kind 0 repeats as a whole; kinds 1 and 2 (of an anchor with very many distinct runs) must be
    sorted; ``copied``: a run that stands for equal ones, which needs no verdict but must be there."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = [b for batch in stream for b in batch.column(1).to_pylist()]
        if not blobs:
            return
        x = np.frombuffer(b"".join(blobs), RUN)
        del blobs
        known = x["low"] < 0
        x = x.copy()
        x["low"] = np.where(known, ~x["low"], x["low"])
        order = np.lexsort((x["low"], x["name"], x["context"], x["hash"]))
        x, known = x[order], known[order]
        new_hash = np.concatenate([[True], x["hash"][1:] != x["hash"][:-1]])
        new_run = new_hash | np.concatenate([[True], x["context"][1:] != x["context"][:-1]])
        first = np.flatnonzero(new_run)
        copies = np.diff(first, append=len(x))
        twice = (copies > 1) | np.logical_or.reduceat(known, first)
        whole = np.repeat(twice, copies) & ~known
        anchor = np.cumsum(new_hash) - 1
        distinct = np.bincount(anchor[first])
        many = distinct[anchor[first]]
        to_sort = many > 1
        yield from _acts(x[whole], np.zeros(int(whole.sum()), np.int64), np.ones(int(whole.sum()), bool))
        yield from _acts(x[first[to_sort]], np.where(many[to_sort] > WIDE, 2, 1), twice[to_sort])

    def known_runs(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blob in (b for batch in stream for b in batch.column(1).to_pylist()):
            x = np.frombuffer(blob, RUN)
            yield from _acts(x, np.zeros(len(x), np.int64), np.ones(len(x), bool))

    met = index.filter("shard >= 0").repartition(shards, "shard").mapInArrow(lean(run), _ACT)
    return met.union(index.filter("shard < 0").mapInArrow(known_runs, _ACT))


def _verdicts(texts: DataFrame, wanted: DataFrame, length: int, shards: int) -> DataFrame:
    """(name, low, high): starts of the runs to sort that repeat. texts has name and data."""
    runs = wanted.groupBy("name").agg(F.collect_list(F.struct("hash", "low", "high", "anchor", "kind", "copied")).alias("runs"))

    def send(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(stream, 4 * BATCH_BYTES):
            parts: dict[int, list[bytes]] = {}
            for name, raw, own in zip(batch.column("name").to_pylist(), batch.column("data").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                for r in own:
                    lo, hi, a = r["low"], r["high"], r["anchor"]
                    key = r["hash"] & (2**64 - 1)
                    if r["kind"] == 1:
                        cuts = [(key, lo, hi)]
                    else:  # starts in steps around the anchor; the key adds the bytes that all starts of the step have
                        cuts = []
                        for b in range((lo - a) // STEP, (hi - a) // STEP + 1):
                            core = raw[a + b * STEP + STEP - 1 : a + b * STEP + length]
                            cuts.append((xxhash.xxh3_64_intdigest(core, seed=(key + b) % 2**64), max(lo, a + b * STEP), min(hi, a + b * STEP + STEP - 1)))
                    for key_, low, high in cuts:
                        data = raw[low : high + length]
                        head = np.array([key_], U).tobytes() + np.array([name, low, high - low + 1, len(data), int(r["copied"]), low - a], np.int64).tobytes()
                        parts.setdefault(key_ % shards, []).append(head + data)
            yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array([b"".join(x) for x in parts.values()], pa.binary())], names=["shard", "blob"])

    def sort(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = [b for batch in stream for b in batch.column(1).to_pylist()]
        entries = []
        for i, blob in enumerate(blobs):
            at = 0
            while at < len(blob):
                key = int.from_bytes(blob[at : at + 8], "little")
                name, low, count, size, copied, apart = np.frombuffer(blob, np.int64, 6, at + 8).tolist()
                entries.append((key, name, low, count, size, copied, apart, i, at + 56))
                at += 56 + size
        entries.sort(key=lambda e: e[:3])
        found: list[tuple[int, int, int]] = []

        def settle(block):
            """block: (number of the group, entry) of a few groups. Anchors come to lie at multiples of the modulus."""
            pieces, places, at = [], [], 0
            for _, e in block:
                gap = (e[6] - at) % MODULUS
                pieces += (bytes(gap), memoryview(blobs[e[7]])[e[8] : e[8] + e[4]])
                places.append(at + gap)
                at += gap + e[4]
            text = np.frombuffer(b"".join(pieces), np.uint8)
            counts = np.array([e[3] for _, e in block], np.int64)
            apart = ragged(np.array([e[6] for _, e in block], np.int64), counts)
            group = np.repeat(np.array([g for g, _ in block], np.int64), counts)
            hit = repeated_starts(text, ragged(np.array(places, np.int64), counts), _dense((group << 32) + apart), length)
            ends = np.cumsum(counts)
            for (_, e), stop in zip(block, ends.tolist(), strict=True):
                if e[5]:
                    continue
                own = np.flatnonzero(np.diff(np.concatenate([[0], hit[stop - e[3] : stop].astype(np.int8), [0]])))
                found.extend((e[1], e[2] + int(s), e[2] + int(t) - 1) for s, t in own.reshape(-1, 2))

        block, size, low, groups = [], 0, 0, 0
        while low < len(entries):
            high = low
            while high < len(entries) and entries[high][0] == entries[low][0]:
                high += 1
            group = entries[low:high]
            low = high
            if len(group) < 2 or all(e[5] for e in group):
                continue
            more = sum(e[4] for e in group)
            if block and size + more > BLOCK_BYTES:
                settle(block)
                block, size = [], 0
            block += [(groups, e) for e in group]
            groups += 1
            size += more
        if block:
            settle(block)
        if found:
            name, first, last = np.array(found, np.int64).T
            yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], names=["name", "low", "high"])

    return texts.join(runs, "name").mapInArrow(lean(send), "shard int, blob binary").repartition(shards, "shard").mapInArrow(lean(sort), "name long, low int, high int")


def merged(starts: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Byte spans covered by strings that start in the given ranges: ascending, disjoint, not touching."""
    spans: list[tuple[int, int]] = []
    for low, high in sorted(starts):
        if spans and low <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(spans[-1][1], high + length))
        else:
            spans.append((low, high + length))
    return spans


def find(rows: DataFrame, folder: str, length: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ids, texts, starts): doc_id, n_bytes, name, sha256 of every row; name and data of those with repeats; name and their starts.

    rows has doc_id and data (bytes). ``name`` is a hash of both, so equal rows
    share one and count as two places. Data shorter than ``length`` bytes have no repeats;
    an empty table gives empty tables. The three lie in ``folder`` for the reader to drop.
    """
    spark = rows.sparkSession
    shards = max(8, -(-(rows.agg(F.sum(F.octet_length("data"))).first()[0] or 0) // SHARD_BYTES))
    index = saved(_indexed(rows, length, shards), f"{folder}/index")
    ids = saved(index.filter("shard IS NULL").select("doc_id", "n_bytes", "name", "sha256"), f"{folder}/ids")
    runs = saved(_grouped(index.filter("shard IS NOT NULL").select("shard", "blob"), shards), f"{folder}/runs")
    drop(spark, f"{folder}/index")
    wanted = runs.select("name").distinct().join(ids.select("name", "doc_id").distinct(), "name")
    found = rows.join(wanted, rows["doc_id"].eqNullSafe(wanted["doc_id"])).select("name", rows["doc_id"], "data")

    def check(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            names = [_name(i, x) for i, x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield batch.filter(pa.array(np.array(names, np.int64) == batch.column(0).to_numpy())).select(["name", "data"])

    texts = saved(found.mapInArrow(lean(check), "name long, data binary"), f"{folder}/texts")
    later = _verdicts(texts, runs.filter("kind > 0"), length, 2 * shards)
    starts = runs.filter("kind = 0").select("name", "low", "high").union(later).groupBy("name").agg(F.collect_list(F.struct("low", "high")).alias("starts"))
    starts = saved(starts, f"{folder}/starts")
    drop(spark, f"{folder}/runs")
    return ids, texts, starts


def _bytes_rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).cast("binary").alias("data"))


def _pairs(starts: list[dict] | None) -> list[tuple[int, int]]:
    return [(s["low"], s["high"]) for s in starts or ()]


def _covered(texts: DataFrame, starts: DataFrame, short: int, length: int) -> DataFrame:
    """The pieces in which strings of ``length`` bytes may repeat, as rows for find, with name, offset and own (their name there)."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            out = []
            for name, raw, own in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for low, high in merged(_pairs(own), 1):  # all starts from low to high - 1 repeat
                    if high - low > length - short:
                        data = raw[low : high - 1 + short]
                        piece = xxhash.xxh3_64_intdigest(low.to_bytes(8, "little"), seed=name % 2**64) - (1 << 63)
                        out.append((piece, data, name, low, _name(piece, data)))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kind) for i, kind in enumerate((pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int64()))], names=["doc_id", "data", "name", "offset", "own"])

    return texts.join(starts, "name").select("name", "data", "starts").mapInArrow(lean(run), "doc_id long, data binary, name long, offset int, own long")


def digest(docs: DataFrame, folder: str, length: int = 400, passage: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, passage_bytes, n_passages for every row of docs.

    The first are of strings of ``length`` bytes; passage_bytes and n_passages
    are the bytes and runs covered by repeated strings of ``passage`` bytes
    (half the length unless given, and less than it). docs needs doc_id and
    text; other columns are left out, a null text is empty, equal rows are
    places of their own, and an empty table gives no rows.
    """
    spark, short = docs.sparkSession, passage or length // 2
    if not 0 < short < length:
        raise ValueError("a passage must be shorter than the strings that are removed")
    ids, texts, starts = find(_bytes_rows(docs), f"{folder}/short", short)
    pieces = saved(_covered(texts, starts, short, length), f"{folder}/pieces")
    _, _, long = find(pieces.select("doc_id", "data"), f"{folder}/long", length)
    moved = F.transform("starts", lambda s: F.struct((s["low"] + F.col("offset")).alias("low"), (s["high"] + F.col("offset")).alias("high")))
    back = long.select(F.col("name").alias("own"), "starts").join(pieces.select("own", "name", "offset").distinct(), "own").groupBy("name").agg(F.flatten(F.collect_list(moved)).alias("longer"))
    back = saved(back, f"{folder}/back")
    drop(spark, f"{folder}/pieces", f"{folder}/long")

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            out = []
            for name, raw, starts, longer in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                spans, passages = merged(_pairs(longer), length), merged(_pairs(starts), short)
                kept = b"".join(raw[a:b] for a, b in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(raw)], strict=True))
                out.append((name, len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), sum(b - a for a, b in passages), len(passages)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)], names=["_n", "removed", "spans", "kept", "covered", "passages"])

    both = texts.join(starts, "name").join(back, "name", "left").select("name", "data", "starts", "longer")
    cut = saved(both.mapInArrow(lean(run), "_n long, removed long, spans long, kept string, covered long, passages long").distinct(), f"{folder}/cut")
    drop(spark, f"{folder}/short/texts", f"{folder}/short/starts", f"{folder}/back")
    count = lambda c, name: F.coalesce(c, F.lit(0)).alias(name)
    return ids.join(cut, F.col("name") == F.col("_n"), "left").select(
        "doc_id", "n_bytes", count("removed", "n_removed"), count("spans", "n_spans"), F.coalesce("kept", "sha256").alias("kept_sha256"), count("covered", "passage_bytes"), count("passages", "n_passages")
    )


def at_characters(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans without the bytes of characters that they hold only in part."""
    inner = lambda i: i < len(raw) and raw[i] & 0xC0 == 0x80
    found = []
    for low, high in spans:
        while inner(low):
            low += 1
        while inner(high):
            high -= 1
        if low < high:
            found.append((low, high))
    return found


def cut_rows(docs: DataFrame, folder: str, length: int = 400) -> DataFrame:
    """The rows of docs, with all their columns, their texts without what repeats; n_chars, if there, is counted anew.

    Characters that are covered in part stay. Rows whose text becomes blank by
    the removal go; rows that are blank before it stay.
    """
    _, texts, starts = find(_bytes_rows(docs), folder, length)

    def cut(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            out = []
            for raw, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                spans = at_characters(raw, merged(_pairs(own), length))
                out.append(b"".join(raw[a:b] for a, b in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(raw)], strict=True)).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["_n", "_cut"])

    def named(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            names = [_name(i, (t or "").encode("utf-8", "surrogatepass")) for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            yield batch.append_column("_name", pa.array(names, pa.int64()))

    cuts = saved(texts.join(starts, "name").select("name", "data", "starts").mapInArrow(lean(cut), "_n long, _cut string").dropDuplicates(["_n"]), f"{folder}/cuts")
    drop(docs.sparkSession, *(f"{folder}/{x}" for x in ("ids", "texts", "starts")))
    # the row goes as a struct, so that none of its names can clash
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = docs.select(whole, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = StructType([*rows.schema.fields, StructField("_name", LongType())])
    found = rows.mapInArrow(lean(named), schema).join(cuts, F.col("_name") == F.col("_n"), "left")
    found = found.filter("_cut IS NULL OR length(translate(_cut, ' \t\n\r', '')) > 0")

    def column(c: str):
        own = F.col(f"_row.`{c}`")
        if c == "text":
            return F.coalesce(F.col("_cut"), own).alias(c)
        if c == "n_chars":
            return F.when(F.col("_cut").isNull(), own).otherwise(F.length("_cut")).cast(docs.schema[c].dataType).alias(c)
        return own.alias(c)

    return found.select(*[column(c) for c in docs.columns])


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_folder(spark, "op5"))
