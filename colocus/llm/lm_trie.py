"""A smoothed trigram model as Elias-Fano tries, and the scores of whole texts under it.

The vocabulary is one set of files, sorted hashes with counts. N-grams are dealt
out by the word before the scored one, so that a shard has all it needs for its
contexts. A very frequent word before the scored one is dealt out further by the
word before it, so each trigram context still stands whole in one shard; totals
of such a word's bigrams are counted first and sent to the shards that ask.
Each shard's trie is a file of levels: contexts, pointers to their children,
children and quantised log probabilities. Children of all contexts form one
monotone sequence (context rank times vocabulary, plus word id), so a child is
found by a successor search relative to its context, in the pointers' range.
The shard maps its file and looks up every distinct n-gram of all texts.

Smoothing is interpolated absolute discounting down to the add-0.1 unigram
model, the same at every size; trigrams are kept from two occurrences on.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colocus.llm.common import batches_of, get_file, lean, planes, put_file, saved, shared_folder, text_of, unplaned
from colocus.llm.elias_fano import EliasFano
from colocus.llm.shingles import U, mix, word_numbers

BATCH_BYTES, BATCHES = 3 << 20, 6
#: Occurrences in training from which a word's contexts are dealt out over shards, prior weight of the Dirichlet option, discount.
SPLIT, PRIOR, DISCOUNT, LEAST_TRIGRAMS = 50_000, 1_000.0, 0.75, 2
#: Hash of the token that ends a text; words hash to odd numbers only.
END = 2


def is_held_out(doc_id: int | None) -> bool:
    """crc32 of the doc_id as text is divisible by 10; a null doc_id is held out."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) >> 1 | 1 for w in words), np.int64, len(words))


def _by_shard(shards: np.ndarray, count: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(shards, kind="stable")
    edges = np.searchsorted(shards[order], np.arange(count + 1))
    for s in np.flatnonzero(np.diff(edges)):
        yield int(s), order[edges[s] : edges[s + 1]]


def _count_words(rows: DataFrame, folder: str, bits: int) -> DataFrame:
    """Writes the vocabulary of the training texts; one row (shard, words, tokens, docs, most) for each of its files."""

    def count(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def dealt():
            h, at = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate([x for _, x in held])).astype(np.int64)
            out = [(s, h[i].tobytes() + n[i].tobytes()) for s, i in _by_shard(h >> (63 - bits), 1 << bits)]
            return pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.int32()), pa.array([b for _, b in out], pa.binary())], names=["shard", "blob"])

        for batch in batches_of(stream, BATCH_BYTES):
            train = [not is_held_out(i) for i in batch.column("doc_id").to_pylist()]
            texts = [t for t, own in zip(batch.column("text").to_pylist(), train, strict=True) if own]
            flat, _, words = word_numbers(texts)
            held.append((np.append(_hashes(words), END), np.append(np.bincount(flat, minlength=len(words)), len(texts)).astype(np.int64)))
            if len(held) == BATCHES:
                yield dealt()
                held = []
        if held:
            yield dealt()

    def merge(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[bytes]] = {}
        for batch in stream:
            for s, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts.setdefault(s, []).append(blob)
        for s, blobs in parts.items():
            h, at = np.unique(np.concatenate([np.frombuffer(b, np.int64, len(b) // 16) for b in blobs]), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate([np.frombuffer(b, np.int64, len(b) // 16, len(b) // 2) for b in blobs])).astype(np.int64)
            h, n = h[n > 0], n[n > 0]
            put_file(f"{folder}/words-{s:05d}", EliasFano.build(h - (s << (63 - bits))).to_bytes() + n.tobytes())
            ends = int(n[h == END].sum())
            yield pa.RecordBatch.from_pydict({"shard": [s], "words": [len(h)], "tokens": [int(n.sum())], "docs": [ends], "most": [int(n.max(initial=0))]}, schema=schema)

    schema = pa.schema([("shard", pa.int32()), ("words", pa.int64()), ("tokens", pa.int64()), ("docs", pa.int64()), ("most", pa.int64())])
    return rows.mapInArrow(lean(count), "shard int, blob binary").repartition(1 << bits, "shard").mapInArrow(lean(merge), "shard int, words long, tokens long, docs long, most long")


def _sequences(flat: np.ndarray, counts: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every text as its words and one end (m): the two tokens before, or the start (m + 1), and the token."""
    sizes = counts + 1
    last = np.cumsum(sizes) - 1
    w = np.full(int(sizes.sum()), m, np.int32)
    inside = np.ones(len(w), bool)
    inside[last] = False
    w[inside] = flat
    first = last - counts
    u = np.empty_like(w)
    u[1:], u[first] = w[:-1], m + 1
    t = np.empty_like(w)
    t[1:], t[first] = u[:-1], m + 1
    return t, u, w


class Vocabulary:
    """Ids and counts of words by their hashes, from mapped files."""

    def __init__(self, folder: str, bits: int, sizes: dict[int, int]):
        self.folder, self.bits, self.sizes = folder, bits, sizes
        self.first, at = {}, 0
        for s in sorted(sizes):
            self.first[s] = at
            at += sizes[s]
        self.size, self.open = at, {}

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        for s, at in _by_shard(hashes >> (63 - self.bits), 1 << self.bits):
            if not self.sizes.get(s):
                continue
            if s not in self.open:
                buffer = get_file(f"{self.folder}/words-{s:05d}")
                words, end = EliasFano.from_buffer(buffer)
                self.open[s] = words, np.frombuffer(buffer, np.int64, words.n, end)
            words, n = self.open[s]
            own = at[np.argsort(hashes[at], kind="stable")]
            place = words.find(hashes[own] - (s << (63 - self.bits)))
            hit = place >= 0
            ids[own[hit]] = self.first[s] + place[hit]
            counts[own[hit]] = n[place[hit]]
        return ids, counts


def quantise(x: np.ndarray) -> tuple[np.ndarray, float, float]:
    """One byte for each value between the smallest and the largest."""
    low, high = (float(x.min()), float(x.max())) if len(x) else (0.0, 0.0)
    return np.round((x - low) / ((high - low) or 1.0) * 255).astype(np.uint8), low, high


class Level:
    """Contexts with their back-off weights and children with their log10 probabilities."""

    def __init__(self, contexts: EliasFano, pointers: EliasFano, children: EliasFano, weight: np.ndarray, chance: np.ndarray, scale: np.ndarray, span: int):
        self.contexts, self.pointers, self.children, self.weight, self.chance, self.scale, self.span = contexts, pointers, children, weight, chance, scale, span
        self.edges = pointers.get(np.arange(contexts.n + 1))

    @staticmethod
    def pack(contexts: np.ndarray, weights: np.ndarray, owner: np.ndarray, words: np.ndarray, chances: np.ndarray, span: int) -> bytes:
        """contexts ascending; owner (rank of the context) and words ascending together."""
        weight, w_low, w_high = quantise(weights)
        chance, c_low, c_high = quantise(chances)
        edges = np.searchsorted(owner, np.arange(len(contexts) + 1))
        codes = weight.tobytes() + chance.tobytes()
        parts = [EliasFano.build(contexts).to_bytes(), EliasFano.build(edges).to_bytes(), EliasFano.build(owner * span + words).to_bytes()]
        return b"".join([*parts, np.array([w_low, w_high, c_low, c_high], np.float64).tobytes(), np.array([span], np.int64).tobytes(), codes, b"\0" * (-len(codes) % 8)])

    @classmethod
    def from_buffer(cls, buffer, at: int) -> tuple[Level, int]:
        contexts, at = EliasFano.from_buffer(buffer, at)
        pointers, at = EliasFano.from_buffer(buffer, at)
        children, at = EliasFano.from_buffer(buffer, at)
        scale, span = np.frombuffer(buffer, np.float64, 4, at), int(np.frombuffer(buffer, np.int64, 1, at + 32)[0])
        at += 40
        weight, chance = np.frombuffer(buffer, np.uint8, contexts.n, at), np.frombuffer(buffer, np.uint8, children.n, at + contexts.n)
        size = contexts.n + children.n
        return cls(contexts, pointers, children, weight, chance, scale, span), at + size + -size % 8

    def backoff(self, rank: np.ndarray) -> np.ndarray:
        low, high = self.scale[:2]
        return low + self.weight[rank] * ((high - low) / 255)

    def child(self, rank: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each context has the word as its child, and the child's log10 probability."""
        at = self.children.find(rank * self.span + word)
        hit = np.flatnonzero((at >= self.edges[rank]) & (at < self.edges[rank + 1]))
        found, chance = np.zeros(len(rank), bool), np.zeros(len(rank))
        found[hit] = True
        low, high = self.scale[2:]
        chance[hit] = low + self.chance[at[hit]] * ((high - low) / 255)
        return found, chance


class Grams:
    """The distinct n-grams of a shard's occurrences (t, u, w as places in ids) and which occurrence has which."""

    def __init__(self, n: int, t: np.ndarray, u: np.ndarray, w: np.ndarray):
        self.n = n
        self.pair, back = np.unique(u * n + w, return_inverse=True)
        self.of_pair = back.astype(np.int32)
        self.context, back = np.unique(u * n + t, return_inverse=True)
        back *= n
        back += w
        self.gram, back = np.unique(back, return_inverse=True)
        self.of_gram = back.astype(np.int32)
        self.pair_of_gram = np.zeros(len(self.gram), np.int64)
        self.pair_of_gram[self.of_gram] = self.of_pair


class Totals:
    """What a shard is told of very frequent words: their bigrams' occurrences in all shards, and for each word how
    many bigrams it has, how many of these occur LEAST_TRIGRAMS times, and how often these do together."""

    def __init__(self, start: int, words: np.ndarray, deal: int, blobs: list[bytes]):
        self.start, self.words, self.deal, parts = start, words, deal, []
        for blob in blobs:
            n, raw = int(np.frombuffer(blob, np.int64, 1)[0]), zstandard.ZstdDecompressor().decompress(memoryview(blob)[8:])
            parts.append((np.cumsum(unplaned(raw, np.int64, n, 0)), unplaned(raw, np.int64, n, 8 * n)))
        key, total = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 2
        order = np.argsort(key, kind="stable")
        self.key, self.total = key[order], total[order]

    def of_pairs(self, keys: np.ndarray) -> np.ndarray:
        if not len(keys):
            return keys
        at = np.searchsorted(self.key, keys)
        if not len(self.key) or (self.key[np.minimum(at, len(self.key) - 1)] != keys).any():
            raise ValueError("totals of bigrams are missing")
        return self.total[at]

    def of_words(self, ids: np.ndarray) -> np.ndarray:
        return self.words[1:, np.searchsorted(self.words[0], ids)]


def build_shard(
    grams: Grams, ids: np.ndarray, count: np.ndarray, unigram: np.ndarray, train: np.ndarray, span: int, split: int | None = None, totals: Totals | None = None
) -> bytes:
    """The trie of a shard from its training occurrences; unigram: log10 probability per place in ids."""
    n, hot = grams.n, count >= (split or np.inf)
    n2 = np.bincount(grams.of_pair, weights=train, minlength=len(grams.pair)).astype(np.int64)
    wide = np.zeros(0, np.int64)  # contexts whose bigrams stand in other shards too
    if totals:
        pu, pw = grams.pair // n, grams.pair % n
        told = np.flatnonzero((count >= totals.deal)[pu])
        wide = np.unique(pu[told])
        told = told[ids[pw[told]] >= 0]
        n2[told] = totals.of_pairs(ids[pu[told]] * span + ids[pw[told]])
    seen = n2 > 0
    pair, n2 = grams.pair[seen], n2[seen]
    pu, pw = pair // n, pair % n
    total = np.bincount(pu, weights=n2, minlength=n)
    total[hot], total[wide] = count[hot], count[wide]
    taken = np.maximum(n2 - DISCOUNT, 0)
    rest = np.where(hot, PRIOR / (total + PRIOR), 1 - np.bincount(pu, weights=taken, minlength=n) / np.maximum(total, 1))
    if len(wide):
        rest[wide] = DISCOUNT * totals.of_words(ids[wide])[0] / total[wide]
    rest = np.maximum(rest, 1e-9)
    base = 10.0 ** unigram[pw]
    two = np.where(hot[pu], (n2 + PRIOR * base) / (total[pu] + PRIOR), taken / np.maximum(total[pu], 1) + rest[pu] * base)
    contexts = np.union1d(pu, wide)
    owner = np.searchsorted(contexts, pu)
    first = Level.pack(ids[contexts], np.log10(rest[contexts]), owner, ids[pw], np.log10(two), span)

    n3 = np.bincount(grams.of_gram, weights=train, minlength=len(grams.gram)).astype(np.int64)
    own = grams.gram // n
    n3[hot[grams.context[own] // n]] = 0
    total3 = np.bincount(own, weights=n3, minlength=len(grams.context))
    kept = np.flatnonzero(n3 >= LEAST_TRIGRAMS)
    own, n3 = own[kept], n3[kept]
    mass = np.bincount(own, weights=n3 - DISCOUNT, minlength=len(grams.context))
    parted = np.zeros(0, np.int64)  # the start's one context, dealt out by the scored word, is told like its bigrams
    if len(wide) and ids[wide[-1]] == totals.start:
        parted = np.flatnonzero(grams.context // n == wide[-1])
        _, kept_, mass_ = totals.of_words(ids[wide[-1:]])[:, 0]
        total3[parted], mass[parted] = count[wide[-1]], mass_ - DISCOUNT * kept_
    rest3 = np.maximum(1 - mass / np.maximum(total3, 1), 1e-9)
    lower = two[(np.cumsum(seen) - 1)[grams.pair_of_gram[kept]]]
    chance3 = np.log10((n3 - DISCOUNT) / total3[own] + rest3[own] * lower) if len(kept) else np.zeros(0)
    used = np.union1d(own, parted)
    owner3 = np.searchsorted(used, own)
    rank = np.searchsorted(contexts, grams.context[used] // n)
    second = Level.pack(rank * span + ids[grams.context[used] % n], np.log10(rest3[used]), owner3, ids[grams.gram[kept] % n], chance3, span)
    return first + second


def query_shard(buffer, grams: Grams, ids: np.ndarray, unigram: np.ndarray) -> np.ndarray:
    """log10 probability of each occurrence; every distinct n-gram is looked up once."""
    n = grams.n
    two, at = Level.from_buffer(buffer, 0)
    three, _ = Level.from_buffer(buffer, at)
    pu, pw = grams.pair // n, grams.pair % n
    known = np.full(n, -1, np.int64)
    real = np.flatnonzero(ids >= 0)
    known[real] = two.contexts.find(ids[real])
    rank = known[pu]
    chance = unigram[pw].copy()
    has = np.flatnonzero(rank >= 0)
    chance[has] += two.backoff(rank[has])
    ask = has[ids[pw[has]] >= 0]
    found, value = two.child(rank[ask], ids[pw[ask]])
    chance[ask[found]] = value[found]

    cu, ct = known[grams.context // n], ids[grams.context % n]
    rank3 = np.full(len(grams.context), -1, np.int64)
    ask = np.flatnonzero((cu >= 0) & (ct >= 0))
    rank3[ask] = three.contexts.find(cu[ask] * three.span + ct[ask])
    best = chance[grams.pair_of_gram]
    r, word = rank3[grams.gram // n], ids[grams.gram % n]
    live = np.flatnonzero(r >= 0)
    best[live] += three.backoff(r[live])
    ask = live[word[live] >= 0]
    found, value = three.child(r[ask], word[ask])
    best[ask[found]] = value[found]
    return best[grams.of_gram]


def score(docs: DataFrame, folder: str, split: int | None = None, deal: int = SPLIT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs.

    docs needs doc_id and text; other columns are left out. A null text is
    empty: its one token is its end. Equal rows stay and count each. With no
    training text every token is unknown. An empty table gives no rows. The
    model's files stay in ``folder``: words-* (the vocabulary) and trie-*.
    Words seen ``deal`` times in training are dealt out over several shards; the
    scores do not depend on it. With ``split`` they do: contexts seen so often
    get a Dirichlet prior and no trigrams. No query uses that.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))
    n_docs = docs.count()
    bits, shards = max(3, (n_docs // 4_000).bit_length()), max(8, -(-n_docs // 3_000))
    manifest = _count_words(rows, folder, bits).collect()  # one row for each vocabulary file
    sizes = {r["shard"]: r["words"] for r in manifest}
    tokens, train_docs = sum(r["tokens"] for r in manifest), sum(r["docs"] for r in manifest)
    n_words = sum(sizes.values())
    floor = tokens + 0.1 * (n_words + 1)
    start_id, span = n_words, n_words + 1
    unigram = lambda c: np.log10((c + 0.1) / floor)

    def route(ids: np.ndarray, n: np.ndarray, t: np.ndarray, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        splits, by = 1 + n // (split or deal), w
        if split is None:  # the start's only trigram context is as frequent as the start itself
            by = np.where(u == len(ids) - 1, w, t)
        with np.errstate(over="ignore"):
            home = mix(ids.astype(U) * U(2) + U(1))
            sub = (mix(ids.astype(U) + U(77))[by] % splits.astype(U)[u]) * U(0x9E3779B97F4A7C15)
            return (mix(home[u] + sub) % U(shards)).astype(np.uint16 if shards < 65536 else np.int64)

    def ask_pairs(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, squeeze = Vocabulary(folder, bits, sizes), zstandard.ZstdCompressor(level=1)
        end_id, end_count = (int(x[0]) for x in vocabulary.find(np.array([END], np.int64)))
        for batch in batches_of(stream, BATCHES * BATCH_BYTES):
            flat, counts, words = word_numbers(batch.column("text").to_pylist())
            ids, n = vocabulary.find(_hashes(words))
            m = len(words)
            ids, n = np.append(ids, [end_id, start_id]), np.append(n, [end_count, train_docs])
            t, u, w = _sequences(flat, counts, m)
            at = np.flatnonzero((n >= deal)[u] & (ids >= 0)[w])
            if not len(at):
                continue
            train = np.repeat(np.array([not is_held_out(i) for i in batch.column("doc_id").to_pylist()]), counts + 1)[at]
            code = u[at].astype(np.int64) * (m + 2)
            code += w[at]
            code *= shards
            code += route(ids, n, t[at], u[at], w[at])
            del t, u, w
            code, back = np.unique(code, return_inverse=True)
            many = np.bincount(back, weights=train).astype(np.int64)
            pair, asker = code // shards, (code % shards).astype(np.int32)
            key = ids[pair // (m + 2)] * span + ids[pair % (m + 2)]
            out = []
            for s, at in _by_shard((mix(key.astype(U)) % U(shards)).astype(np.int64), shards):
                at = at[np.argsort(key[at], kind="stable")]
                raw = b"".join(map(planes, (np.diff(key[at], prepend=0), many[at], asker[at])))
                out.append((s, np.array([len(at)], np.int64).tobytes() + squeeze.compress(raw)))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.binary())], names=["shard", "blob"])

    def total_pairs(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for batch in stream:
            for s, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault(s, []).append(blob)
        while held:
            parts = []
            for blob in held.popitem()[1]:
                n, raw = int(np.frombuffer(blob, np.int64, 1)[0]), zstandard.ZstdDecompressor().decompress(memoryview(blob)[8:])
                parts.append((np.cumsum(unplaned(raw, np.int64, n, 0)), unplaned(raw, np.int64, n, 8 * n), unplaned(raw, np.int32, n, 16 * n)))
            key, many, asker = (np.concatenate(x) for x in zip(*parts, strict=True))
            del parts
            key, back = np.unique(key, return_inverse=True)
            total = np.bincount(back, weights=many).astype(np.int64)
            asked = np.unique(back * shards + asker)
            back, asker = asked // shards, asked % shards
            for s, at in _by_shard(asker, shards):
                one = back[at]
                raw = planes(np.diff(key[one], prepend=0)) + planes(total[one])
                blob = np.array([len(one)], np.int64).tobytes() + zstandard.ZstdCompressor(level=1).compress(raw)
                yield pa.RecordBatch.from_pydict({"shard": [s], "blob": [blob], "context": [None], "types": [None], "kept": [None], "mass": [None]}, schema=hot_schema)
            context, at = np.unique(key // span, return_inverse=True)
            sums = [np.bincount(at, weights=x).astype(np.int64) for x in (total > 0, total >= LEAST_TRIGRAMS, np.where(total >= LEAST_TRIGRAMS, total, 0))]
            none = pa.nulls(len(context))
            yield pa.RecordBatch.from_arrays([none.cast(pa.int32()), none.cast(pa.binary()), pa.array(context), *map(pa.array, sums)], schema=hot_schema)

    hot_schema = pa.schema([("shard", pa.int32()), ("blob", pa.binary()), *((x, pa.int64()) for x in ("context", "types", "kept", "mass"))])
    hot, hot_words = None, np.zeros((4, 0), np.int64)
    dealt_out = split is None and max((*(r["most"] for r in manifest), train_docs)) >= deal
    if dealt_out:
        pairs = rows.mapInArrow(lean(ask_pairs), "shard int, blob binary").repartition(shards, "shard")
        hot = saved(pairs.mapInArrow(lean(total_pairs), "shard int, blob binary, context long, types long, kept long, mass long"), f"{folder}/hot")
        sums = hot.filter("shard IS NULL").groupBy("context").agg(*(F.sum(x).alias(x) for x in ("types", "kept", "mass")))
        hot_words = np.array(sorted(map(tuple, sums.collect())), np.int64).reshape(-1, 4).T  # one row for each very frequent word

    def occurrences(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, part, block = Vocabulary(folder, bits, sizes), TaskContext.get().partitionId(), 0
        squeeze = zstandard.ZstdCompressor(level=1)
        end_id, end_count = (int(x[0]) for x in vocabulary.find(np.array([END], np.int64)))
        for batch in batches_of(stream, BATCHES * BATCH_BYTES):
            doc_ids = batch.column("doc_id").to_pylist()
            flat, counts, words = word_numbers(batch.column("text").to_pylist())
            ids, n = vocabulary.find(_hashes(words))
            m = len(words)
            ids, n = np.append(ids, [end_id, start_id]), np.append(n, [end_count, train_docs])
            t, u, w = _sequences(flat, counts, m)
            sizes_ = counts + 1
            doc = np.repeat(np.arange(len(counts), dtype=np.int32), sizes_)
            train = np.array([not is_held_out(i) for i in doc_ids], np.uint8)
            known = np.bincount(doc, weights=n[w] > 0, minlength=len(counts)).astype(np.int64)
            base = np.bincount(doc, weights=unigram(n)[w], minlength=len(counts))
            number = part << 24 | block
            block += 1
            missing = np.array([i is None for i in doc_ids], np.int64)
            meta = np.array([[i or 0 for i in doc_ids], missing, 1 - train.astype(np.int64), sizes_, known], np.int64).tobytes() + base.tobytes()
            shard = route(ids, n, t, u, w)
            out = [(number % shards, 1, np.array([number], np.int64).tobytes() + meta)]
            mark, place, by_id = np.zeros(len(ids), bool), np.zeros(len(ids), np.int64), np.argsort(ids, kind="stable")
            for s, at in _by_shard(shard, shards):
                a, b, c = t[at], u[at], w[at]
                mark[:] = False
                mark[a] = mark[b] = mark[c] = True
                here = by_id[mark[by_id]]
                place[here] = np.arange(len(here))
                kind = np.uint16 if max(len(here), len(counts)) < 65536 else np.uint32
                head = np.array([number, len(here), len(at), len(counts), np.dtype(kind).itemsize], np.int64)
                columns = [place[x].astype(kind) for x in (a, b, c)] + [np.diff(doc[at], prepend=0).astype(kind)]
                raw = [planes(np.diff(ids[here], prepend=0)), planes(n[here]), *map(planes, columns), train.tobytes()]
                out.append((s, 0, head.tobytes() + squeeze.compress(b"".join(raw))))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.binary())], names=["shard", "kind", "blob"])

    def learn_and_ask(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        told: dict[int, list[bytes]] = {}
        for batch in stream:
            passed = []
            for s, kind, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 2:
                    told.setdefault(s, []).append(blob)
                elif kind:
                    passed.append(blob)
                else:
                    held.setdefault(s, []).append(blob)
            if passed:
                yield pa.RecordBatch.from_arrays([pa.array([int(np.frombuffer(b, np.int64, 1)[0]) for b in passed], pa.int64()), pa.array([1] * len(passed), pa.int32()), pa.array([b[8:] for b in passed], pa.binary())], names=["block", "kind", "blob"])
        while held:
            s, blobs = held.popitem()
            parts = []
            for blob in blobs:
                number, words, n, docs_, wide = (int(x) for x in np.frombuffer(blob, np.int64, 5))
                kind, raw = (np.uint16 if wide == 2 else np.uint32), zstandard.ZstdDecompressor().decompress(memoryview(blob)[40:])
                ids_, count_ = np.cumsum(unplaned(raw, np.int64, words, 0)), unplaned(raw, np.int64, words, 8 * words)
                at = 16 * words
                columns = [unplaned(raw, kind, n, at + k * wide * n) for k in range(3)]
                columns.append(np.cumsum(unplaned(raw, kind, n, at + 3 * wide * n), dtype=np.int64))
                parts.append((number, docs_, ids_, count_, *columns, np.frombuffer(raw, np.uint8, docs_, at + 4 * wide * n)))
            del blobs
            ids, where, back = np.unique(np.concatenate([p[2] for p in parts]), return_index=True, return_inverse=True)
            count = np.concatenate([p[3] for p in parts])[where]
            shift = np.cumsum([0, *(len(p[2]) for p in parts)])
            t, u, w = (np.concatenate([back[k + p[i].astype(np.int64)] for k, p in zip(shift, parts, strict=False)]) for i in (4, 5, 6))
            train = np.concatenate([p[8][p[7]] for p in parts]).astype(bool)
            chance = unigram(count)
            uri = f"{folder}/trie-{s:06d}"
            sizes_of = [(p[0], p[1], p[7].astype(np.int32)) for p in parts]
            del parts, back
            grams = Grams(len(ids), t, u, w)
            del t, u, w
            totals = Totals(start_id, hot_words, deal, told.pop(s, [])) if dealt_out else None
            put_file(uri, build_shard(grams, ids, count, chance, train, span, split, totals))
            del totals
            value = query_shard(get_file(uri), grams, ids, chance)
            at, out = 0, []
            for number, docs_, own in sizes_of:
                n = len(own)
                seen = np.flatnonzero(np.bincount(own, minlength=docs_))
                sums = np.bincount(own, weights=value[at : at + n], minlength=docs_)[seen]
                packed = planes(np.diff(seen, prepend=0).astype(np.uint32)) + planes(sums.astype(np.float32))
                out.append((number, zstandard.ZstdCompressor(level=1).compress(packed)))
                at += n
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([0] * len(out), pa.int32()), pa.array([o[1] for o in out], pa.binary())], names=["block", "kind", "blob"])

    def gather(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[bytes]] = {}
        metas: dict[int, bytes] = {}
        for batch in stream:
            for number, kind, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind:
                    metas[number] = blob
                else:
                    sums.setdefault(number, []).append(blob)
        for number, blob in metas.items():
            n = len(blob) // 48
            table, base = np.frombuffer(blob, np.int64, 5 * n).reshape(5, n), np.frombuffer(blob, np.float64, n, 40 * n)
            total = np.zeros(n)
            for b in sorted(sums.get(number, [])):
                raw = zstandard.ZstdDecompressor().decompress(b)
                k = len(raw) // 8
                total[np.cumsum(unplaned(raw, np.uint32, k, 0), dtype=np.int64)] += unplaned(raw, np.float32, k, 4 * k)
            yield pa.RecordBatch.from_arrays(
                [pa.array(table[0], mask=table[1] == 1), pa.array(table[2] == 1), pa.array(table[3]), pa.array(table[4]), pa.array(np.full(n, tokens)), pa.array(base), pa.array(total)],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    dealt = rows.mapInArrow(lean(occurrences), "shard int, kind int, blob binary")
    if dealt_out:
        dealt = dealt.union(hot.filter("shard IS NOT NULL").select("shard", F.lit(2).alias("kind"), "blob"))
    dealt = dealt.repartition(shards, "shard")
    asked = dealt.mapInArrow(lean(learn_and_ask), "block long, kind int, blob binary").repartition(shards, "block")
    return asked.mapInArrow(lean(gather), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op1_lm_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_folder(spark, "op1"))
