"""N-gram Jaccard self-join by universe partition.

Sets lie in size bands so narrow that linked sets share a band or neighbour
ones. For band j, H_j bounds the symmetric difference of linked sets, and the
universe of shingles is hashed into H_j + 1 segments: by pigeonhole linked sets
agree on a whole segment. Agreement on an empty segment costs most and tells
least, so its cost is allocated elsewhere: a set with E empty segments and T of
at most one shingle also indexes the one-deletion neighbourhoods of its first
2E + T segments. If two linked sets agree on c empty segments only, at most
c - 1 segments differ by two or more shingles; among the first 2c + t segments
(t: one side empty, the other with one shingle) one therefore differs by exactly
one shingle and has one left, and there the neighbourhoods meet.

Where sets meet under a common key they are held together with parity sketches,
which differ in no more bits than the sets do in shingles, so that most chance
meetings end there. Within a group of at most ALL_PAIRS sets every pair is
looked at, and a home passes on a forest of least differences over the pairs
that its sketches leave; each edge is verified on the sets. Larger groups compare their
sets with a leader each. Trees with an edge that fails, and all sets of leaders of
which one comparison fails, go on to a second round, an exact prefix join of sets
from different components. Every link is verified on the sets themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from colocus.llm.common import batches_of, drop, lean, planes, ragged, saved, shared_folder, text_of, unplaned
from colocus.llm.components import components
from colocus.llm.shingles import U, mix, set_names, shingle_sets

BATCH_BYTES = 3 << 20
#: Batches whose keys travel together.
BATCHES = 3
#: Ranges of a shard's keys that are held in memory one after the other.
KEY_RANGES = 8
#: Largest group whose pairs are all looked at by their sketches; beyond it leaders stand for their groups.
ALL_PAIRS = 2_000
#: Rows times (100 - percent) for a shard of keys (4 MB of them and more), for a shard of the second round, and for a home, where the repeated keys of shards are met in one task.
KEYS_EACH, ROUND_EACH, HOME_EACH = 80_000, 240_000, 480_000
#: Sketch words that are compared, and keys that are held, at a time.
CHUNK = 1 << 21
#: Sets of a group for each further home that may compare it.
SPREAD = 64
#: Tasks that share the members of one leader.
SALTS = 64
#: Counters of shingles for the second round's order, and how many of the largest come last; any numbers give the same result.
COUNTERS, MOST_HOT = 1 << 22, 1 << 17


class Bands:
    """Size bands and segment counts for a Jaccard of at least percent / 100."""

    def __init__(self, percent: int, longest: int = 1 << 31):
        edges, self.percent = [1], percent
        while edges[-1] <= longest:
            edges.append(max(edges[-1] + 1, edges[-1] * 100 // percent + 1))
        self.edges = np.array(edges, np.int64)
        self.segments = (100 - percent) * 2 * (self.edges[1:] - 1) // (100 + percent) + 1

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, sizes, side="right") - 1


def linked(shared: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int, percent: int):
    return 100 * shared >= percent * (a + b - shared)


def sketch_words(sizes: np.ndarray) -> np.ndarray:
    """Words of 64 bits in a set's sketch: 8 at least, else a power of two of five eighths of a bit a shingle or more.

    The sketches of unrelated sets then differ in clearly more bits than linked sets may.
    """
    bits = np.maximum(1, -(-np.asarray(sizes, np.int64) * 5 // 8 // 512))
    return 8 << np.ceil(np.log2(bits)).astype(np.int64)


def sketches(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parity bits of each set, one after the other, and the number of words of each. Two sets differ in no more bits than shingles."""
    words = sketch_words(sizes)
    base = (np.cumsum(words) - words) * 64
    owner = np.repeat(np.arange(len(sizes)), sizes)
    spread = mix(values + U(0x5DEECE66D)) >> U(20)
    cell = base[owner] + (spread & (words[owner] * 64 - 1).astype(U)).astype(np.int64)
    odd = (np.bincount(cell, minlength=int(words.sum()) * 64) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(U), words


class Sketches:
    """Sets by number: names, sizes and sketches that can be compared at the narrower width."""

    def __init__(self, sizes: np.ndarray, flat: np.ndarray, words: np.ndarray):
        self.sizes, self.flat, self.words, self.start = sizes, flat, words, np.cumsum(words) - words

    def _at(self, which: np.ndarray, wide: int) -> np.ndarray:
        """The sketches folded to ``wide`` words."""
        out = np.empty((len(which), wide), U)
        for own in np.unique(self.words[which]):
            rows = np.flatnonzero(self.words[which] == own)
            bits = self.flat[self.start[which[rows]][:, None] + np.arange(own)].reshape(len(rows), own // wide, wide)
            out[rows] = np.bitwise_xor.reduce(bits, axis=1)
        return out

    def differing(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bits in which the sketches of each pair differ."""
        wide, found = np.minimum(self.words[a], self.words[b]), np.zeros(len(a), np.int64)
        for w in np.unique(wide):
            pairs = np.flatnonzero(wide == w)
            each = max(1, CHUNK // int(w))
            for low in range(0, len(pairs), each):
                at = pairs[low : low + each]
                sets, place = np.unique(np.concatenate([a[at], b[at]]), return_inverse=True)
                table = self._at(sets, int(w))
                found[at] = np.bitwise_count(table[place[: len(at)]] ^ table[place[len(at) :]]).sum(axis=1)
        return found

    def plausible(self, a: np.ndarray, b: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Whether each pair can link by size and sketch, and the bits in which it differs (0 where sizes decide)."""
        x, y = self.sizes[a], self.sizes[b]
        good, bits = 100 * np.minimum(x, y) >= percent * np.maximum(x, y), np.zeros(len(a), np.int64)
        at = np.flatnonzero(good)
        bits[at] = self.differing(a[at], b[at])
        good[at] = bits[at] <= (100 - percent) * (x[at] + y[at]) // (100 + percent)
        return good, bits


def least_forest(a: np.ndarray, b: np.ndarray, count: int) -> np.ndarray:
    """Which of the edges a-b (in order of preference) make the forest of the ``count`` nodes that prefers early edges."""
    label, left, chosen = np.arange(count), np.arange(len(a)), []
    while True:
        x, y = label[a[left]], label[b[left]]
        left, x, y = left[x != y], x[x != y], y[x != y]
        if not len(left):
            return np.sort(np.unique(np.concatenate(chosen))) if chosen else left
        ends, at = np.unique(np.stack([x, y], axis=1), return_index=True)  # the first edge of each tree
        pick = at // 2
        chosen.append(left[pick])
        to = np.arange(count)
        to[ends] = np.where(x[pick] == ends, y[pick], x[pick])
        loop = to[to[ends]] == ends  # two trees that chose the same edge: the smaller one stays
        keep = ends[loop & (ends < to[ends])]
        to[keep] = keep
        while not np.array_equal(to, to[to]):
            to = to[to]
        label = to[label]


def signature_keys(values: np.ndarray, sizes: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all sets and the position of the set of each key."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    owner = np.repeat(np.arange(len(sizes)), sizes)
    spread = mix(values ^ U(0xA5A5A5A5DEADBEEF))
    limbs = [((spread >> U(16 * k)) & U(0xFFFF)).astype(np.float64) for k in range(4)]
    own = bands.of(np.maximum(sizes, 1))
    for up in (0, 1):
        band = own + up
        m = np.where(sizes > 0, bands.segments[band], 0)
        base = np.cumsum(m) - m
        part = (mix(values + U(0x632BE59BD9B4E019)) % np.maximum(m, 1).astype(U)[owner]).astype(np.int64)
        cell, total = base[owner] + part, int(m.sum())
        count = np.bincount(cell, minlength=total)
        content = np.zeros(total, U)
        with np.errstate(over="ignore"):
            for k in range(4):
                content += np.bincount(cell, weights=limbs[k], minlength=total).astype(U) << U(16 * k)
        holder = np.repeat(np.arange(len(sizes)), m)
        number = np.arange(total) - base[holder]
        with np.errstate(over="ignore"):
            place = mix(band.astype(U)[holder] * U(0x1000003) + number.astype(U) * U(2))
            full = count > 0
            found.append((mix(content + place)[full], holder[full]))
            empty = np.bincount(holder, weights=count == 0, minlength=len(sizes)).astype(np.int64)
            small = np.bincount(holder, weights=count <= 1, minlength=len(sizes)).astype(np.int64)
            reach = np.where(empty > 0, np.minimum(2 * empty + small, m), 0)
            chosen = (number < reach[holder]) & full
            found.append((mix(mix(content + place) + U(1))[chosen], holder[chosen]))
            lone = (part < reach[owner]) & (count[cell] > 1)
            c = cell[lone]
            found.append((mix(mix(content[c] - spread[lone] + place[c]) + U(1)), owner[lone]))
    return np.concatenate([k for k, _ in found]), np.concatenate([d for _, d in found])


def _blob(*columns: np.ndarray) -> bytes:
    return b"".join(c.tobytes() for c in columns)


def _dealt(shards: np.ndarray, count: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(shards, kind="stable")
    edges = np.searchsorted(shards[order], np.arange(count + 1))
    for s in range(count):
        if edges[s] < edges[s + 1]:
            yield s, order[edges[s] : edges[s + 1]]


def _sets_of(batch: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    values, sizes = shingle_sets(batch.column("text").to_pylist(), width)
    return values, sizes, set_names(values, sizes)


def _indexed(rows: DataFrame, width: int, bands: Bands, shards: int) -> DataFrame:
    """One row for each document (shard null) and one for each batch and shard with its keys."""

    def dealt(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        shift = np.cumsum([0, *(len(h[2]) for h in held)])
        keys = np.concatenate([h[0] for h in held])
        owner = np.concatenate([h[1] + s for h, s in zip(held, shift, strict=False)])
        names, sizes = (np.concatenate([h[i] for h in held]) for i in (2, 3))
        out = []
        for s, at in _dealt((keys % U(shards)).astype(np.int64), shards):
            out.append((s, _write_index(keys[at], owner[at], names, sizes)))
        return pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.int32()), pa.array([b for _, b in out], pa.binary()), *[pa.nulls(len(out), pa.int64())] * 3, pa.nulls(len(out), pa.binary())], schema=schema)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches_of(stream, BATCH_BYTES):
            values, sizes, names = _sets_of(batch, width)
            n = len(sizes)
            bits, words = sketches(values, sizes)
            stops = np.cumsum(words)
            marks = [bits[stop - w : stop].tobytes() if size else None for stop, w, size in zip(stops, words, sizes, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), batch.column("doc_id").combine_chunks(), pa.array(sizes, pa.int64()), pa.array(names, pa.int64(), mask=sizes == 0), pa.array(marks, pa.binary())], schema=schema)
            firsts = np.sort(np.unique(names, return_index=True)[1])
            ends = np.cumsum(sizes)
            keys, owner = signature_keys(values[ragged((ends - sizes)[firsts], sizes[firsts])], sizes[firsts], bands)
            held.append((keys, owner.astype(np.int32), names[firsts], sizes[firsts]))
            del values, keys, owner
            if len(held) == BATCHES:
                yield dealt(held)
                held = []
        if held:
            yield dealt(held)

    schema = pa.schema([("shard", pa.int32()), ("blob", pa.binary()), ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64()), ("sketch", pa.binary())])
    return rows.mapInArrow(lean(run), "shard int, blob binary, doc_id long, n_shingles long, node long, sketch binary")


def _write_index(keys: np.ndarray, owner: np.ndarray, names: np.ndarray, sizes: np.ndarray) -> bytes:
    """Keys (their first 48 bits, ascending, as differences) and the sets that have them, compressed."""
    short = keys >> U(16)
    order = np.argsort(short, kind="stable")
    here, local = np.unique(owner[order], return_inverse=True)
    kind = np.uint16 if len(here) < 65536 else np.uint32
    raw = planes(names[here]) + planes(sizes[here]) + planes(np.diff(short[order], prepend=U(0))) + planes(local.astype(kind))
    return np.array([len(here), len(keys)], np.int64).tobytes() + zstandard.ZstdCompressor(level=1).compress(raw)


def _read_index(blob: bytes, part: int = 0, parts: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, names and sizes of one of the equal ranges of the keys' values."""
    nodes, n = (int(x) for x in np.frombuffer(blob, np.int64, 2))
    raw = zstandard.ZstdDecompressor().decompress(memoryview(blob)[16:])
    name, size = unplaned(raw, np.int64, nodes, 0), unplaned(raw, np.int64, nodes, 8 * nodes)
    keys = np.cumsum(unplaned(raw, U, n, 16 * nodes), dtype=U)
    local = unplaned(raw, np.uint16 if nodes < 65536 else np.uint32, n, 16 * nodes + 8 * n)
    low, high = np.searchsorted(keys, np.array([part * 2**48 // parts, (part + 1) * 2**48 // parts], U))
    local = local[low:high]
    return keys[low:high].copy(), name[local], size[local]


def leaders(keys: np.ndarray, nodes: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (leader, member, flag) of each group of nodes with a common key.

    The leader is the node with the smallest scrambled name, so that groups with
    common nodes tend to have a common leader. Members whose size rules the
    leader out choose another one; then both leaders are paired too, and both
    with all their members are left to the second round (flag 2). flag 1: the
    group has three or more nodes, and the leader's are left if the pair fails;
    of two, flag 0.
    """
    order = np.lexsort((mix(nodes.view(U)), keys))
    keys, nodes, sizes = keys[order], nodes[order], sizes[order]
    once = np.ones(len(keys), bool)
    once[1:] = (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])
    keys, nodes, sizes = keys[once], nodes[once], sizes[once]
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    group = np.repeat(np.arange(len(start)), np.diff(start, append=len(keys)))
    length = np.diff(start, append=len(keys))
    big = length[group] > 2
    head = start[group]
    open_ = np.arange(len(keys)) != head
    a, b, f = [], [], []
    while open_.any():
        at = np.flatnonzero(open_)
        small, large = np.minimum(sizes[at], sizes[head[at]]), np.maximum(sizes[at], sizes[head[at]])
        fits = 100 * small >= percent * large
        a.append(nodes[head[at[fits]]])
        b.append(nodes[at[fits]])
        f.append(big[at[fits]].astype(np.int32))
        open_[at[fits]] = False
        rest = at[~fits]
        if not len(rest):
            break
        first = np.concatenate([[True], group[rest][1:] != group[rest][:-1]])
        new = rest[first]
        a.append(nodes[head[new]][big[new]])
        b.append(nodes[new][big[new]])
        f.append(np.full(int(big[new].sum()), 2, np.int32))
        head[rest] = np.repeat(new, np.diff(np.flatnonzero(first), append=len(rest)))
        open_[new] = False
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
    return np.concatenate(a), np.concatenate(b), np.concatenate(f)


def _groups(keys: np.ndarray, nodes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys that two or more sets have, ascending; of keys that the same sets have the least one."""
    order = np.lexsort((nodes, keys))
    keys, nodes, sizes = keys[order], nodes[order], sizes[order]
    once = np.ones(len(keys), bool)
    once[1:] = (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])
    keys, nodes, sizes = keys[once], nodes[once], sizes[once]
    if not len(keys):
        return keys, nodes, sizes
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    length = np.diff(start, append=len(keys))
    many = np.flatnonzero(length > 1)
    _, first = np.unique(np.add.reduceat(mix(nodes.view(U)), start)[many], return_index=True)
    keep = np.zeros(len(start), bool)
    keep[many[first]] = True
    keep = np.repeat(keep, length)
    return keys[keep], nodes[keep], sizes[keep]


def _packed(keys: np.ndarray, nodes: np.ndarray, sizes: np.ndarray) -> bytes:
    names, at, owner = np.unique(nodes, return_index=True, return_inverse=True)
    return _write_index(keys << U(16), owner, names, sizes[at])


def _twins(index: DataFrame, shards: int, homes: int) -> DataFrame:
    """Keys that two or more sets have, a row (home, blob) for each shard and range. Each shard has a task of its own."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for batch in stream:
            for s, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault(s, []).append(blob)
            del batch
        for s in held:  # by ranges of its keys
            blobs = []
            for part in range(KEY_RANGES):
                found = _groups(*(np.concatenate(x) for x in zip(*(_read_index(b, part, KEY_RANGES) for b in held[s]), strict=True)))
                if len(found[0]):
                    blobs.append(_packed(*found))
                del found
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(blobs), s % homes, np.int32)), pa.array(blobs, pa.binary())], names=["home", "blob"])

    return index.repartitionById(shards, "shard").mapInArrow(lean(run), "home int, blob binary")


def _led(twins: DataFrame, homes: int) -> DataFrame:
    """The groups of sets with a common key, at the home of their first set: rows (home, blob), and the sets that are met there, (home, node).

    Near copies have a key in common in most shards; with its first set a group
    that recurs has one home, so a set goes to few homes, however many shards
    and homes there are. A group of m sets has the choice of 1 + m / SPREAD
    homes, by its key, so the comparisons of a large one are shared out.
    """

    def held(stream: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """Each home's groups, as much as one blob takes at a time."""
        parts: dict[int, list[tuple[np.ndarray, ...]]] = {}
        for batch in stream:
            for home, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts.setdefault(home, []).append(_read_index(blob))
                if sum(len(x[0]) for x in parts[home]) > CHUNK:
                    parts[home] = [_groups(*(np.concatenate(x) for x in zip(*parts[home], strict=True)))]
                    if len(parts[home][0][0]) > CHUNK // 2:
                        yield home, parts.pop(home)[0]
        for home in parts:
            yield home, _groups(*(np.concatenate(x) for x in zip(*parts[home], strict=True)))

    def deal(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (keys, nodes, sizes) in held(stream):
            start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
            if not len(start):
                continue
            length = np.diff(start, append=len(keys))
            place = mix(keys[start]) % (1 + length // SPREAD).astype(U)
            to = ((np.minimum.reduceat(mix(nodes.view(U)), start) % U(homes) + place) % U(homes)).astype(np.int64)
            out = [(home, _packed(keys[at], nodes[at], sizes[at])) for home, at in _dealt(np.repeat(to, length), homes)]
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in out], pa.int32()), pa.array([b for _, b in out], pa.binary())], names=["home", "blob"])

    def gather(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there: dict[int, np.ndarray] = {}
        for home, (keys, nodes, sizes) in held(stream):
            there[home] = np.union1d(there.get(home, np.zeros(0, np.int64)), nodes)
            yield pa.RecordBatch.from_arrays([pa.array([home], pa.int32()), pa.nulls(1, pa.int64()), pa.array([_packed(keys, nodes, sizes)], pa.binary())], names=["home", "node", "blob"])
        for home, nodes in there.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(nodes), home, np.int32)), pa.array(nodes), pa.nulls(len(nodes), pa.binary())], names=["home", "node", "blob"])

    met = twins.repartitionById(homes, "home").mapInArrow(lean(deal), "home int, blob binary")
    return met.repartitionById(homes, "home").mapInArrow(lean(gather), "home int, node long, blob binary")


def _pairs_of(keys: np.ndarray, at: np.ndarray, sets: Sketches, names: np.ndarray, percent: int, all_pairs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (leader, node, flag) of the sets (numbers ``at``) that have a key in common. Flags: see _candidates."""
    order = np.lexsort((at, keys))
    keys, at = keys[order], at[order]
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    length = np.diff(start, append=len(keys))
    small = np.repeat(length <= all_pairs, length)
    rank = np.arange(len(keys)) - np.repeat(start, length)
    after = np.where(small, np.repeat(length, length) - 1 - rank, 0)  # members of the group behind this one
    steps = np.cumsum(after)
    a, b, bits = (np.zeros(0, np.int64) for _ in range(3))
    low = 0
    while low < len(keys):
        done = steps[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(steps, done + CHUNK, side="right")))
        first = np.repeat(at[low:high], after[low:high])
        second = at[ragged(np.arange(low, high) + 1, after[low:high])]
        low = high
        code = np.unique(first * len(names) + second)
        first, second = code // len(names), code % len(names)
        good, differ = sets.plausible(first, second, percent)
        a, b, bits = np.concatenate([a, first[good]]), np.concatenate([b, second[good]]), np.concatenate([bits, differ[good]])
        if len(a) > CHUNK or low >= len(keys):
            # least differences first; where equal, an order of the names that all tasks share
            x, y = mix(names[a].view(U)), mix(names[b].view(U))
            order = np.lexsort((np.maximum(x, y), np.minimum(x, y), bits * 1_000_000 // (sets.sizes[a] + sets.sizes[b])))
            order = order[least_forest(a[order], b[order], len(names))]
            a, b, bits = a[order], b[order], bits[order]
    flip = mix(names[a].view(U)) > mix(names[b].view(U))
    a, b = np.where(flip, b, a), np.where(flip, a, b)
    head, node, flag = leaders(keys[~small], names[at[~small]], sets.sizes[at[~small]], percent)
    if len(head):
        x, y = np.searchsorted(names, head), np.searchsorted(names, node)
        good, _ = sets.plausible(x, y, percent)
        flag = np.where(good | (flag == 2), flag, 3)
    return np.concatenate([names[a], head]), np.concatenate([names[b], node]), np.concatenate([np.zeros(len(a), np.int32), flag.astype(np.int32)])


def _candidates(led: DataFrame, marks: DataFrame, homes: int, percent: int, all_pairs: int) -> DataFrame:
    """Distinct pairs (leader, node, flag) of all keys. marks: node, n_shingles and sketch of all sets.

    flag 0: an edge of the forest of the small groups of a blob; 1: a leader and a
    member of a larger group; 3: such a pair that its sketches rule out; 2: two
    leaders of one group, parted by size.
    """
    routes = led.filter("node IS NOT NULL").select("home", "node").join(marks, "node").select("home", F.lit(None).cast("binary").alias("blob"), "node", "n_shingles", "sketch")
    blobs = led.filter("blob IS NOT NULL").select("home", "blob", *[F.lit(None).cast(t).alias(c) for c, t in (("node", "long"), ("n_shingles", "long"), ("sketch", "binary"))])

    def meet(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        blobs = table.column("blob").drop_null().to_pylist()
        sets = table.filter(pc.is_valid(table.column("node"))).select(["node", "n_shingles", "sketch"]).sort_by("node")
        del table
        if not blobs:
            return
        names, sizes = sets.column("node").to_numpy(), sets.column("n_shingles").to_numpy()
        flat = np.frombuffer(b"".join(sets.column("sketch").to_pylist()), U)
        known = Sketches(sizes, flat, sketch_words(sizes))
        found = []
        for blob in blobs:
            keys, nodes, _ = _read_index(blob)
            found.append(_pairs_of(keys, np.searchsorted(names, nodes), known, names, percent, all_pairs))
        a, b, flag = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((-flag, b, a))
        a, b, flag = a[order], b[order], flag[order]
        first = np.ones(len(a), bool)
        first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(b[first]), pa.array(flag[first])], names=["leader", "node", "flag"])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in stream:
            home = batch.column("home").to_numpy()
            cuts = [0, *(np.flatnonzero(home[1:] != home[:-1]) + 1), len(home)]
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                if high > low:
                    if held and held[-1].column("home")[0].as_py() != home[low]:
                        yield from meet(held)
                        held = []
                    held.append(batch.slice(low, high - low))
        if held:
            yield from meet(held)

    dealt = routes.unionByName(blobs).repartition(homes, "home").sortWithinPartitions("home")
    return dealt.mapInArrow(lean(run), "leader long, node long, flag int").groupBy("leader", "node").agg(F.max("flag").alias("flag"))


def _likely(pairs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """The pairs with flag 3 instead of 0 or 1 where their sketches rule the link out."""
    of = lambda c, k: marks.select(F.col("node").alias(c), F.col("n_shingles").alias(f"n{k}"), F.col("sketch").alias(f"s{k}"))
    both = pairs.join(of("leader", 0), "leader").join(of("node", 1), "node").select("leader", "node", "flag", "n0", "n1", "s0", "s1")

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            n = batch.num_rows
            if not n:
                continue
            sizes = np.concatenate([batch.column("n0").to_numpy(), batch.column("n1").to_numpy()])
            known = Sketches(sizes, np.frombuffer(b"".join(batch.column("s0").to_pylist() + batch.column("s1").to_pylist()), U), sketch_words(sizes))
            good, _ = known.plausible(np.arange(n), np.arange(n, 2 * n), percent)
            flag = batch.column("flag").to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column("leader"), batch.column("node"), pa.array(np.where(good | (flag > 1), flag, 3).astype(np.int32))], names=["leader", "node", "flag"])

    return both.mapInArrow(lean(run), "leader long, node long, flag int")


def _verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(leader, node, flag, ok) for every pair; texts has node and text of all sets of pairs with flags 0 and 1.

    The members of a leader are dealt over SALTS tasks, and its set goes to those that have one.
    """
    salted = pairs.filter("flag < 2").select("node", "leader", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int").alias("salt"), "flag")
    heads = salted.select(F.col("leader").alias("node"), "leader", "salt", F.lit(-1).alias("flag")).distinct()
    routes = salted.unionByName(heads).groupBy("node").agg(F.collect_list(F.struct("leader", "salt", "flag")).alias("routes"))
    sent = texts.join(routes, "node").select("node", "text", "routes")

    def send(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(stream, BATCH_BYTES):
            values, sizes, names = _sets_of(batch, width)
            ends = np.cumsum(sizes)
            out, held = [], 0
            for i, (node, routes) in enumerate(zip(batch.column("node").to_pylist(), batch.column("routes").to_pylist(), strict=True)):
                if names[i] != node:
                    continue
                data = values[ends[i] - sizes[i] : ends[i]].tobytes()
                for r in routes:
                    out.append((r["leader"], r["salt"], node, r["flag"], data))
                    held += len(data)
                    if held > BATCH_BYTES:
                        yield pa.RecordBatch.from_pydict({f.name: [r[k] for r in out] for k, f in enumerate(schema)}, schema=schema)
                        out, held = [], 0
            if out:
                yield pa.RecordBatch.from_pydict({f.name: [r[k] for r in out] for k, f in enumerate(schema)}, schema=schema)

    schema = pa.schema([("leader", pa.int64()), ("salt", pa.int32()), ("node", pa.int64()), ("flag", pa.int32()), ("data", pa.binary())])

    def compare(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, head = None, None
        for batch in stream:
            a, b, flags, good = [], [], [], []
            for leader, salt, node, flag, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.frombuffer(data, U)
                if flag < 0:
                    held, head = (leader, salt), own
                    continue
                if held != (leader, salt):
                    raise ValueError(f"the set of leader {leader} is missing")
                shared = len(np.intersect1d(head, own, assume_unique=True))
                a.append(leader)
                b.append(node)
                flags.append(flag)
                good.append(bool(linked(shared, len(head), len(own), percent)))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(flags, pa.int32()), pa.array(good, pa.bool_())], names=["leader", "node", "flag", "ok"])

    moved = sent.mapInArrow(lean(send), "leader long, salt int, node long, flag int, data binary")
    done = moved.repartition("leader", "salt").sortWithinPartitions("leader", "salt", "flag").mapInArrow(lean(compare), "leader long, node long, flag int, ok boolean")
    return done.unionByName(pairs.filter("flag >= 2").withColumn("ok", F.lit(False)))


def narrow(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """512 parity bits of each set."""
    cell = np.repeat(np.arange(len(sizes)), sizes) * 512 + (mix(values + U(0x5DEECE66D)) >> U(55)).astype(np.int64)
    odd = (np.bincount(cell, minlength=512 * len(sizes)) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(len(sizes), 512), axis=1).view(U) if len(sizes) else np.zeros((0, 8), U)


def _second_round(texts: DataFrame, labels: DataFrame, width: int, percent: int, shards: int, forest: bool) -> DataFrame:
    """Pairs (leader, node, flag) from different components that share a prefix shingle; texts has node and text.

    Shingles are ordered by the count of their counter among these sets, rarest
    first; any order is exact. n - ceil(t n) + 1 first shingles make the prefix.
    Pairs whose parity sketches differ in more bits than linked sets may differ
    in shingles are dropped where they meet, which loses no link. With
    ``forest`` a shard gives only as many pairs as join its components, so a
    large group of near copies gives a tree; without, it gives all that are left.
    """
    rows = texts.join(labels.select(F.col("node").alias("_n"), "label"), F.col("node") == F.col("_n"), "left").select("node", "text", F.coalesce("label", "node").alias("label"))
    slices = 16

    def count(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.uint32)
        for batch in batches_of(stream, BATCH_BYTES):
            values, _, _ = _sets_of(batch, width)
            total += np.bincount((mix(values) % U(COUNTERS)).astype(np.int64), minlength=COUNTERS).astype(np.uint32)
        if total.any():
            press = zstandard.ZstdCompressor(level=1)
            yield pa.RecordBatch.from_arrays([pa.array(range(slices), pa.int32()), pa.array([press.compress(planes(x)) for x in np.split(total, slices)], pa.binary())], names=["slice", "blob"])

    def frequent(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in stream:
            for k, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                more = unplaned(zstandard.ZstdDecompressor().decompress(blob), np.uint32, COUNTERS // slices, 0).astype(np.int64)
                total[k] = total[k] + more if k in total else more
        for k, n in total.items():
            hot = np.flatnonzero(n >= 8)
            hot = hot[np.argsort(-n[hot], kind="stable")][: MOST_HOT // slices]
            yield pa.RecordBatch.from_arrays([pa.array(hot + k * (COUNTERS // slices)), pa.array(n[hot])], names=["counter", "n"])

    hot = texts.mapInArrow(lean(count), "slice int, blob binary").repartition(slices, "slice").mapInArrow(lean(frequent), "counter long, n long").collect()
    hot_at = np.array(sorted((r["counter"], r["n"]) for r in hot), np.int64).reshape(-1, 2)

    def prefixes(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(stream, BATCH_BYTES):
            values, sizes, names = _sets_of(batch, width)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            n = np.zeros(len(values), np.int64)
            if len(hot_at):
                own = (mix(values) % U(COUNTERS)).astype(np.int64)
                at = np.minimum(np.searchsorted(hot_at[:, 0], own), len(hot_at) - 1)
                n = np.where(hot_at[at, 0] == own, hot_at[at, 1], 0)
            order = np.lexsort((values, n, owner))
            rank = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            look = sizes - -(-percent * sizes // 100) + 1
            take = order[rank < look[owner]]
            label = np.array(batch.column("label").to_pylist(), np.int64)
            bits, out = narrow(values, sizes), []
            for s, at in _dealt((values[take] % U(shards)).astype(np.int64), shards):
                x = take[at]
                here, local = np.unique(owner[x], return_inverse=True)
                head = np.array([len(here), len(x)], np.int64)
                out.append((s, _blob(head, names[here], sizes[here], label[here], bits[here], values[x], local.astype(np.uint32))))
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.int32()), pa.array([b for _, b in out], pa.binary())], names=["shard", "blob"])

    def meet(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, shift = [], 0
        for blob in (b for batch in stream for b in batch.column(1).to_pylist()):
            m, n = (int(v) for v in np.frombuffer(blob, np.int64, 2))
            table = np.frombuffer(blob, np.int64, 3 * m, 16).reshape(3, m)
            bits = np.frombuffer(blob, U, 8 * m, 16 + 24 * m).reshape(m, 8)
            parts.append((*table, bits, np.frombuffer(blob, U, n, 16 + 88 * m), shift + np.frombuffer(blob, np.uint32, n, 16 + 88 * m + 8 * n).astype(np.int64)))
            shift += m
        if not parts:
            return
        node, size, label, bits, key, at = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((size[at], key))
        key, at = key[order], at[order]
        edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        lengths = np.diff(edges)
        found: set[tuple[int, int]] = set()
        above: dict[int, int] = {}

        def top(x: int) -> int:
            while (y := above.get(x, x)) != x:
                above[x] = x = above.get(y, y)
            return x

        for low, high in zip(edges[:-1][lengths > 1], edges[1:][lengths > 1], strict=True):
            own = at[low:high]
            labels_, sizes_ = label[own], size[own]
            if (labels_ == labels_[0]).all():
                continue
            stops = np.searchsorted(sizes_, sizes_ * 100 // percent, side="right")
            for i in range(len(own) - 1):
                rest = np.arange(i + 1, stops[i])
                rest = rest[labels_[rest] != labels_[i]]
                most = (100 - percent) * (sizes_[rest] + sizes_[i]) // (100 + percent)
                rest = rest[np.bitwise_count(bits[own[rest]] ^ bits[own[i]]).sum(axis=1) <= most]
                a = int(node[own[i]])
                for b, of in zip(node[own[rest]].tolist(), labels_[rest].tolist(), strict=True):
                    if a != b and (not forest or top(int(labels_[i])) != top(of)):
                        found.add((min(a, b), max(a, b)))
                        if forest:
                            above[top(of)] = top(int(labels_[i]))
        if found:
            a, b = np.array(sorted(found), np.int64).T
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.zeros(len(a), np.int32))], names=["leader", "node", "flag"])

    met = rows.mapInArrow(lean(prefixes), "shard int, blob binary").repartition(shards, "shard").mapInArrow(lean(meet), "leader long, node long, flag int")
    return met.distinct()


def join(docs: DataFrame, folder: str, width: int = 5, percent: int = 80, all_pairs: int = ALL_PAIRS) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs: see classes."""
    return classes(docs, folder, width, percent, all_pairs).drop("node")


def classes(docs: DataFrame, folder: str, width: int = 5, percent: int = 80, all_pairs: int = ALL_PAIRS) -> DataFrame:
    """doc_id, n_shingles, component_id and node (name of its set) for every row of docs.

    Two documents link when 100 * shared >= percent * union of their distinct
    ``width``-word shingles (A-Z lower-cased). component_id is the smallest
    doc_id that links reach. Null and wordless texts link with nothing and name
    themselves; equal texts with words always link; a null doc_id takes part
    but names no component unless alone. Other columns are left out. An empty
    table gives no rows. Links are exact up to collisions of 64-bit hashes.
    """
    spark = docs.sparkSession
    bands, rows = Bands(percent), docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))
    keys = docs.count() * (100 - percent)  # a set has keys in proportion to 100 - percent
    shards, slots, homes = (max(8, -(-keys // each)) for each in (KEYS_EACH, ROUND_EACH, HOME_EACH))
    index = saved(_indexed(rows, width, bands, shards), f"{folder}/index")
    ids = saved(index.filter("shard IS NULL").select("doc_id", "n_shingles", "node"), f"{folder}/ids")
    marks = saved(index.filter("node IS NOT NULL").select("node", "n_shingles", "sketch").dropDuplicates(["node"]), f"{folder}/marks")
    twins = saved(_twins(index.filter("shard IS NOT NULL").select("shard", "blob"), shards, homes), f"{folder}/twins")
    drop(spark, f"{folder}/index")
    led = saved(_led(twins, homes), f"{folder}/led")
    drop(spark, f"{folder}/twins")
    pairs = saved(_candidates(led, marks, homes, percent, all_pairs), f"{folder}/pairs")
    drop(spark, f"{folder}/led")
    nodes = ids.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    wanted = pairs.select("node").union(pairs.select("leader")).distinct().join(nodes, "node").select("node", "first")
    texts = saved(rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("first"))).select("node", "text"), f"{folder}/texts")
    checked = saved(_verified(pairs, texts, width, percent), f"{folder}/checked")
    drop(spark, f"{folder}/pairs")
    ends = lambda df: df.select(F.col("leader").alias("a"), F.col("node").alias("b"))
    edges = ends(checked.filter("ok"))
    labels = components(edges, f"{folder}/first")
    trees = components(ends(checked.filter("flag = 0")).union(edges), f"{folder}/trees")
    torn = checked.filter("flag = 0 AND NOT ok").select("node").join(trees, "node").select("label").distinct()
    open_ = checked.filter("flag >= 1 AND NOT ok").select("leader").union(checked.filter("flag = 2").select("node")).distinct()
    led = checked.filter("flag >= 1").join(open_, "leader", "left_semi")
    left = led.select("node").union(led.select("leader")).union(trees.join(torn, "label", "left_semi").select("node"))
    again = saved(texts.join(left.distinct(), "node", "left_semi"), f"{folder}/again")
    drop(spark, f"{folder}/texts", f"{folder}/trees")
    done, kept = [f"{folder}/checked"], f"{folder}/first"
    for step, forest in enumerate((True, False)):
        if not again.limit(1).count():
            break
        own = f"{folder}/round-{step}"
        more = _second_round(again, labels, width, percent, slots, forest).join(checked.select("leader", "node"), ["leader", "node"], "left_anti")
        likely = saved(_likely(saved(more, f"{own}/pairs"), marks, percent), f"{own}/likely")
        later = saved(_verified(likely, again, width, percent), f"{own}/checked")
        done.append(f"{own}/checked")
        drop(spark, f"{own}/pairs", f"{own}/likely", kept)
        checked = checked.union(later)
        edges = edges.union(ends(later.filter("ok")))
        labels, kept = components(edges, f"{own}/labels"), f"{own}/labels"
        if forest:  # sets that no failed pair ties together have no further candidates among them
            trees = components(ends(later).union(edges), f"{own}/trees")
            torn = later.filter("NOT ok").select("node").join(trees, "node").select("label").distinct()
            still = trees.join(torn, "label", "left_semi").select("node")
            again = saved(again.join(still, "node", "left_semi"), f"{own}/again")
            drop(spark, f"{folder}/again", f"{own}/trees")
        else:
            drop(spark, f"{folder}/round-0/again")
    named = nodes.join(labels, "node", "left").select("node", "first", "n", F.coalesce("label", "node").alias("label"), F.col("label").isNotNull().alias("tied"))
    lowest = named.groupBy("label").agg(F.min("first").alias("component_id"))
    shared = saved(named.filter("tied OR n > 1").join(lowest, "label").select(F.col("node").alias("_n"), "component_id"), f"{folder}/shared")
    drop(spark, *done, kept, *(f"{folder}/{x}" for x in ("marks", "again")))
    return ids.join(shared, F.col("node") == F.col("_n"), "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "node")


def one_of_each(docs: DataFrame, folder: str, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, without all but one of each group of linked documents.

    The row with the smallest doc_id stays, once where rows repeat. Rows without
    a doc_id go if they are linked to one that has it; else all of them stay.
    """
    spark = docs.sparkSession
    groups = saved(classes(docs, folder, width, percent), f"{folder}/groups")
    drop(spark, f"{folder}/ids", f"{folder}/shared")
    gone = groups.filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = docs.select(whole, F.col("doc_id").cast("long").alias("_id"), text_of(docs).alias("text"))
    # both steps deal the rows out by _id, so they move once
    left = rows.filter("_id IS NOT NULL").withColumn("text", F.xxhash64("text")).join(gone, F.col("_id") == F.col("_gone"), "left_anti")
    once = left.withColumn("_copy", F.row_number().over(Window.partitionBy("_id", "text").orderBy("_id"))).filter("_copy = 1").select("_row")
    linked_nulls = groups.filter("doc_id IS NULL AND component_id IS NOT NULL").select(F.col("node").alias("_node")).distinct()
    return once.unionAll(_unlinked(rows.filter("_id IS NULL"), linked_nulls, width)).select("_row.*")


def _unlinked(rows: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(_row) of the rows whose set is none of the nodes."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(stream, BATCH_BYTES):
            yield pa.RecordBatch.from_arrays([batch.column("_row").combine_chunks(), pa.array(_sets_of(batch, width)[2])], names=["_row", "_node"])

    schema = StructType([rows.schema["_row"], StructField("_node", LongType())])
    return rows.select("_row", "text").mapInArrow(lean(run), schema).join(nodes, "_node", "left_anti").select("_row")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_folder(spark, "op6"), width=4, percent=85)


def op6_sql() -> str:
    return r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
g AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END)) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS id, doc_id AS r FROM documents UNION SELECT reach.id, y FROM reach JOIN both_ways ON reach.r = x)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c.low AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT id, min(r) AS low FROM reach GROUP BY 1) c ON c.id = d.doc_id"""
