"""Corpus operators against brute force, with nulls, empty and repeated rows, long texts and clashing columns."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from colocus.llm import elias_fano, html_main, jaccard_join, lm_trie, mixing, packing, quality_rules, spot_signatures, suffix_dedup, token_files, warc
from colocus.llm.common import range_bounds, range_index, shared_folder
from colocus.llm.tokens import encoder

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "one two"), (5, "one two"), (None, "a b c d e f"), (None, "a b c d e f"), (6, "é 日本 🙂 x"), (7, "w " * 3000)]


def words(text):
    return WORD.findall((text or "").encode().translate(LOWER))


@pytest.fixture(scope="module")
def odd(spark):
    """Awkward rows; the other columns have the names of the operators' own."""
    rows = [(i, t, "s" if (i or 0) % 2 else None, 7, 8, "x") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_words long, _n long, label string")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def texts_of(df):
    return [(r[0], r[1]) for r in df.select("doc_id", "text").collect()]


def key(row):
    return [(v is None, str(v)) for v in row]


# quality rules


def test_quality_rules_equal_their_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{FOLDER}/documents.parquet'")
    found = con.execute(quality_rules.op2_sql())
    names = [c[0] for c in found.description]
    df = quality_rules.op2_quality_rules(spark, FOLDER)
    assert sorted(df.collect()) == sorted(tuple(r[names.index(c)] for c in df.columns) for r in found.fetchall())


def _repeats(w):
    n = Counter(zip(w, w[1:], w[2:], strict=False))
    return len({p for i in range(len(w) - 2) if n[w[i], w[i + 1], w[i + 2]] > 1 for p in (i, i + 1, i + 2)})


def test_quality_rules_on_awkward_rows(spark, odd):
    extra = spark.createDataFrame([(20, "a b c " * 4 + "d"), (21, "x " * 60), (22, "a #b\n\na #b\n c|d")], "doc_id long, text string")
    rows = odd.select("doc_id", "text").union(extra)
    got = sorted((tuple(r) for r in quality_rules.score(rows, keep=("doc_id",)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()), key=key)
    want = []
    for i, t in texts_of(rows):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = _repeats(w)
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), r, len(w) < 50 or 2 * r > len(w)))
    assert got == sorted(want, key=key)
    assert quality_rules.kept_rows(odd).columns == odd.columns
    assert quality_rules.score(odd.limit(0)).count() == 0


# token files and packing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.one_of(st.text(alphabet="ab \n'st.é日 \x1c3<|>", max_size=30), st.just("<|endoftext|>")), max_size=4).map("".join), max_size=8))
def test_cached_encoding_equals_the_library(texts):
    flat, n = encoder(token_files.default_tokenizer()).encode(texts)
    want = [x.ids for x in Tokenizer.from_file(token_files.default_tokenizer()).encode_batch(texts, add_special_tokens=False)]
    assert flat.tolist() == [i for x in want for i in x] and n.tolist() == [len(x) for x in want]


def test_shedding_pieces_changes_no_ids(docs, monkeypatch):
    monkeypatch.setattr("colocus.llm.tokens.MOST_PIECES", 500)
    texts, e = [t or "" for _, t in texts_of(docs)], encoder(token_files.default_tokenizer())
    e.forget()
    want = [x.ids for x in Tokenizer.from_file(token_files.default_tokenizer()).encode_batch(texts, add_special_tokens=False)]
    for low in range(0, len(texts), 20):
        flat, n = e.encode(texts[low : low + 20])
        assert flat.tolist() == [i for x in want[low : low + 20] for i in x] and n.tolist() == [len(x) for x in want[low : low + 20]]


def test_long_buckets_are_searched_by_halves(monkeypatch):
    """One context with very many children beside far ones: a search reads a few values, not all of the bucket."""
    values = np.unique(np.concatenate([np.arange(0, 200_000, 7), np.arange(50) * 10**12]))
    coded = elias_fano.EliasFano.from_buffer(elias_fano.EliasFano.build(values).to_bytes())[0]
    ask = np.concatenate([values, values + 1, np.array([10**14, 2**62])])
    read, low_at = [], elias_fano.EliasFano._low_at
    monkeypatch.setattr(elias_fano.EliasFano, "_low_at", lambda self, i: read.append(len(i)) or low_at(self, i))
    at = np.searchsorted(values, ask)
    assert (coded.successor(ask) == at).all()
    assert (coded.find(ask) == np.where(np.isin(ask, values), at, -1)).all()
    assert sum(read) < 40 * len(ask)


def test_words_with_marks_are_kept_by_their_letters():
    """Marks behind a word, or a line feed between two words, make no new piece of it; the ids are the library's."""
    e = encoder(token_files.default_tokenizer())
    e.forget()
    stems = ["alpha", "Bézier", "gamma", "Ñandú", "x"]
    ends = ["", ".", ",", "?!", "$$", ".\n", "\n", "\n\n", ".\r\n", "\n.", "-\n"]
    texts = [f"{a}{m} {b}{k}{a}{m} {a}{m}{b}{k}{a}" for a in stems for b in stems for m in ends for k in ends]
    want = [x.ids for x in Tokenizer.from_file(token_files.default_tokenizer()).encode_batch(texts, add_special_tokens=False)]
    flat, n = e.encode(texts)
    assert flat.tolist() == [i for x in want for i in x] and n.tolist() == [len(x) for x in want]
    e.forget()
    e.encode([f"{a} {a}{m} {a}{k}{b}{m}" for a in stems for b in stems for m in ends[:5] for k in ends[5:7]])
    assert e.pieces.slots <= 1 + 3 * len(stems)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=200), st.integers(0, 4))
def test_codes_round_trip(values, shift):
    v = np.array(values, np.uint32) >> np.uint32(8 * min(shift, 3))
    control, data = token_files.pack_codes(v)
    assert len(control) == -(-len(v) // 4) and (token_files.unpack_codes(control, data, len(v)) == v).all()


def library_ids(texts, end):
    t = Tokenizer.from_file(token_files.default_tokenizer())
    return [np.append(np.array(e.ids, np.uint32), np.uint32(end)) for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def test_token_files_read_back(spark, docs, odd):
    for df in (docs, odd, odd.limit(0)):
        folder = shared_folder(spark, "t")
        manifest = token_files.write(df, folder, token_files.default_tokenizer(), rows_each=40).cache()
        rows = sorted(texts_of(df), key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
        ids = library_ids([t for _, t in rows], 2)
        start = np.cumsum([0, *map(len, ids)])
        want = [(i, int(s), len(x), crc(x)) for (i, _), s, x in zip(rows, start, ids, strict=False)]
        assert sorted((tuple(r) for r in token_files.digest(manifest).collect()), key=key) == sorted(want, key=key)
        back = {r.start: r.ids for r in token_files.read(manifest).collect()}
        assert all(back[int(s)] == x.tolist() for s, x in zip(start, ids, strict=False))


@pytest.mark.parametrize("limits", [(2048, 256, None), (64, 5, None), (64, 256, 40)])
def test_every_id_is_packed_once(spark, docs, odd, limits):
    tokens, segments, loss = limits
    for df in (docs, odd, odd.limit(0)):
        got = packing.pack(df, shared_folder(spark, "p"), token_files.default_tokenizer(), max_tokens=tokens, max_segments=segments, max_loss=loss).collect()
        rows = texts_of(df)
        want = Counter()
        for (i, _), x in zip(rows, library_ids([t for _, t in rows], 1), strict=True):
            want[i, len(x)] += len(x)
        have, lots = Counter(), defaultdict(list)
        for r in got:
            have[r.doc_id, r.doc_tokens] += r.length
            lots[r.sequence_id].append(r)
        assert have == want and sorted(lots) == list(range(len(lots)))
        for own in lots.values():
            own.sort(key=lambda r: r.offset)
            assert [r.offset for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist()
            assert sum(r.length for r in own) <= tokens and len(own) <= segments and (loss is None or sum(r.length for r in own) <= loss)
        if loss is None and segments > 100:
            full = [sum(r.length for r in own) for own in lots.values()]
            assert all(n == tokens or n & (n - 1) == 0 for n in full)
    ids = {i: x for (i, _), x in zip(texts_of(docs), library_ids([t for _, t in texts_of(docs)], 1), strict=True)}
    if limits[0] == 2048:
        for r in packing.pack(docs, shared_folder(spark, "p"), token_files.default_tokenizer()).collect():
            assert r.ids_crc32 == crc(ids[r.doc_id][r.start : r.start + r.length])


def test_prompts_bear_no_loss():
    p = packing.Packer(100, 10, 30)
    closed = [c for doc, (n, prompt) in enumerate([(80, 60), (90, 20), (20, 20), (50, 0)]) for c in p.add(doc, n, prompt)]
    closed += list(p.drain(last=True))
    prompts, seen = [60, 20, 20, 0], Counter()
    for _, parts in closed:
        assert sum(n for _, _, n in parts) <= 100
        assert sum(max(0, at + n - max(at, prompts[d])) for d, at, n in parts) <= 30
        seen.update({d: n for d, _, n in parts})
        for d, _, n in parts:
            pass
    total = Counter()
    for _, parts in closed:
        for d, _, n in parts:
            total[d] += n
    assert total == {0: 80, 1: 90, 2: 20, 3: 50}


# fingerprints


def signature_set(text):
    w = [v.strip(quality_rules.EDGE) for v in re.split(r"[\x20\x09-\x0d]+", (text or "").lower())]
    w = [v for v in w if v]
    stops = set(quality_rules.STOP_WORDS)
    content = [(i, v) for i, v in enumerate(w) if v not in stops]
    if not content:
        return {tuple(w)} if w else set()
    out = set()
    for j, (i, _) in enumerate(content):
        chain = tuple(content[j + k][1] if j + k < len(content) else "" for k in range(3))
        out |= {(a, *chain) for a in (["^"] if j == 0 else []) + w[(content[j - 1][0] + 1 if j else 0) : i]}
    return out


def jaccard(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def test_fingerprints(spark, docs, odd, monkeypatch):
    monkeypatch.setattr(spot_signatures, "ROWS_EACH", 30)
    for df in (docs, odd, odd.limit(1), odd.limit(0)):
        rows = sorted(texts_of(df), key=lambda r: (r[0] is None, -(r[0] or 0), (r[1] or "").encode()))
        texts = [t or "" for _, t in rows]
        want = []
        for (i, _), own, after in zip(rows, texts, texts[1:] + texts[:1], strict=True):
            half = len(own) // 2
            edited = own[: len(own) - half] + after[:half]
            want.append((i, len(own), hashlib.sha256(edited.encode()).hexdigest(), round(jaccard(signature_set(own), signature_set(edited)), 9), round(jaccard(signature_set(own), signature_set(after)), 9)))
        got = [(r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in spot_signatures.fingerprints(df).collect()]
        assert sorted(got, key=key) == sorted(want, key=key)
    prints = defaultdict(set)
    for r in spot_signatures.fingerprints(odd.filter("doc_id = 5 OR doc_id = 4")).collect():
        prints[r.n_chars].add(r.fingerprint)
    assert all(len(v) == 1 for v in prints.values())


def test_range_search_is_the_tree_of_comparisons(spark):
    from pyspark.sql import functions as F

    from colocus.llm.common import range_index, range_search

    values = [None, -(2**63), -5, 0, 1, 2, 3, 7, 8, 2**62]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for bounds in ([], [1], [-5, 2], [0, 1, 2, 3], list(range(-40, 41, 3)), [-(2**63), 2**62]):
        for r in df.select("v", range_search(F.col("v"), bounds).alias("a"), range_index(F.col("v"), bounds).alias("b")).collect():
            assert r.a == r.b == (0 if r.v is None else sum(c <= r.v for c in bounds))


def test_similar_fingerprints_are_all_found(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(200)] + list(quality_rules.STOP_WORDS[:20])
    rows = []
    for _ in range(20):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([20, 60, 120]))]
        for _ in range(4):
            own = list(base)
            own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", spot_signatures.signatures(F_text()).alias("sigs"))
    sets = defaultdict(list)
    for i, t in rows:
        sets[frozenset(signature_set(t))].append(i)
    classes = [(min(v), k) for k, v in sets.items()]
    want = {(min(a, b), max(a, b)) for n, (a, x) in enumerate(classes) for b, y in classes[:n] if 10 * len(x & y) >= 8 * len(x | y)}
    assert {(r.a, r.b) for r in spot_signatures.similar_pairs(df).collect()} == want and want


def F_text():
    from pyspark.sql import functions as F

    return F.coalesce(F.col("text"), F.lit(""))


# repeated strings


def brute_removed(rows, length):
    count = Counter()
    for _, t in rows:
        b = (t or "").encode()
        count.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        hit = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if count[b[p : p + length]] > 1:
                hit[p : p + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~hit])
        out.append((i, len(b), int(hit.sum()), int((np.diff(np.concatenate([[0], hit.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.fixture(scope="module")
def passages(spark):
    rng = random.Random(2)
    shared = ["".join(rng.choice("abé日 ") for _ in range(rng.randint(40, 250))) for _ in range(8)]
    rows = [(i // 2 * 3, "".join(rng.choice([rng.choice(shared), "".join(rng.choice("abé日 ") for _ in range(rng.randint(1, 120)))]) for _ in range(rng.randint(0, 5)))) for i in range(60)]
    rows += [*ODD[:9], (900, "x" * 300), (901, "ab " * 150)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


@pytest.mark.parametrize("wide", [2_000, 2])
def test_repeated_strings_are_removed(spark, passages, monkeypatch, wide):
    monkeypatch.setattr(suffix_dedup, "WIDE", wide)
    rows = texts_of(passages)
    for passage in (50, 99):
        got = [tuple(r) for r in suffix_dedup.digest(passages, shared_folder(spark, "s"), 100, passage).collect()]
        want = [(*long, *short[2:4]) for long, short in zip(brute_removed(rows, 100), brute_removed(rows, passage), strict=True)]
        assert sorted(got, key=key) == sorted(want, key=key)
    assert suffix_dedup.digest(passages.limit(0), shared_folder(spark, "s"), 100).count() == 0


def test_cut_rows_keep_columns_and_characters(spark, odd, passages):
    assert suffix_dedup.cut_rows(odd, shared_folder(spark, "c"), 100).columns == odd.columns
    assert suffix_dedup.cut_rows(odd, shared_folder(spark, "c"), 10_000).count() == len(ODD)
    out = suffix_dedup.cut_rows(passages, shared_folder(spark, "c"), 100)
    assert all("�" not in (r.text or "") for r in out.collect())
    assert [suffix_dedup.at_characters("aé日b".encode(), [x]) for x in ((2, 5), (1, 6), (2, 7))] == [[], [(1, 6)], [(3, 7)]]


@settings(max_examples=25, deadline=None)
@given(st.text(alphabet="ab", min_size=40, max_size=300), st.integers(8, 20), st.integers(3, 200))
def test_suffix_sorting(text, length, bucket):
    data = np.frombuffer(text.encode(), np.uint8)
    starts = np.arange(0, len(data) - length + 1, 2)
    own = starts % suffix_dedup.MODULUS  # suffixes of a bucket have one residue
    was, suffix_dedup.BUCKET = suffix_dedup.BUCKET, bucket
    try:
        got = suffix_dedup.repeated_starts(data, starts, own, length)
    finally:
        suffix_dedup.BUCKET = was
    raw = data.tobytes()
    n = Counter((b, raw[s : s + length]) for s, b in zip(starts, own, strict=True))
    assert got.tolist() == [n[b, raw[s : s + length]] > 1 for s, b in zip(starts, own, strict=True)]


def test_any_two_residues_have_a_common_shift_into_the_cover():
    m, cover = suffix_dedup.MODULUS, suffix_dedup.COVER
    assert all(any((a + d) % m in cover and (b + d) % m in cover for d in range(m)) for a in range(m) for b in range(m))


# n-gram Jaccard join


def brute_components(rows, width, percent):
    sets = []
    for i, t in rows:
        w = words(t)
        sets.append((i, frozenset([tuple(w)]) if 0 < len(w) < width else frozenset(zip(*(w[k:] for k in range(width)), strict=False))))
    up = list(range(len(sets)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (_, x) in enumerate(sets):
        for b in range(a):
            y = sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                up[top(a)] = top(b)
    low = {}
    for a, (i, _) in enumerate(sets):
        if i is not None:
            low[top(a)] = min(low.get(top(a), i), i)
    return sorted(((i, len(s), low.get(top(a))) for a, (i, s) in enumerate(sets)), key=key)


@pytest.mark.parametrize("width,percent,all_pairs", [(4, 85, 2000), (2, 70, 2000), (4, 85, 3), (2, 70, 2), (5, 80, 1)])
def test_join_finds_every_component(spark, width, percent, all_pairs):
    rng = random.Random(width)
    vocabulary = [f"w{i}" for i in range(300)]
    common = [rng.choice(vocabulary) for _ in range(40)]
    rows = []
    for b in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 8, 12, 20, 40, 80]))] + (common if b % 3 == 0 else [])
        for _ in range(rng.randint(1, 10)):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append((len(rows) * 3 + 1, " ".join(own)))
    rows += [(i and i + 100_000, t) for i, t in ODD]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in jaccard_join.join(df, shared_folder(spark, "j"), width, percent, all_pairs).collect()), key=key)
    assert got == brute_components(rows, width, percent)


@pytest.mark.parametrize("lengths,all_pairs", [((15, 17, 20, 21), 2000), ((15, 17, 20, 21), 2), ((15, 17, 20, 23, 27), 2)])
def test_truncated_copies_link(spark, lengths, all_pairs):
    rng, rows = random.Random(5), []
    for _ in range(400):
        base = [f"w{rng.randrange(10**6)}" for _ in range(40)]
        rows += [(len(rows) + k, " ".join(base[: n + 3])) for k, n in enumerate(lengths)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.join(df, shared_folder(spark, "j"), 4, 85, all_pairs).collect()}
    assert got == {i: i - i % len(lengths) for i, _ in rows}  # each length is 85 % of the next, or more


def test_forest_is_the_one_of_the_first_edges():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randint(2, 20)
        edges = [(a, b) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(0, 50))) if a != b]
        up, want = list(range(n)), []
        for i, (a, b) in enumerate(edges):
            if up[a] != up[b]:
                up = [up[b] if x == up[a] else x for x in up]
                want.append(i)
        a, b = (np.array([e[k] for e in edges], np.int64) for k in (0, 1))
        assert jaccard_join.least_forest(a, b, n).tolist() == want


@given(st.integers(0, 2**32), st.integers(1, 3000), st.integers(0, 400))
@settings(max_examples=30, deadline=None)
def test_sketches_differ_in_no_more_bits_than_sets(seed, size, other):
    rng = np.random.default_rng(seed)
    x = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
    y = np.unique(np.concatenate([x[rng.random(len(x)) < 0.8], rng.integers(0, 2**64, other, dtype=np.uint64)]))
    sizes = np.array([len(x), len(y)])
    flat, many = jaccard_join.sketches(np.concatenate([x, y]), sizes)
    known = jaccard_join.Sketches(sizes, flat, many)
    apart = len(np.setxor1d(x, y))
    assert known.differing(np.array([0]), np.array([1]))[0] <= apart
    assert many.tolist() == jaccard_join.sketch_words(sizes).tolist()


def test_rows_without_doc_id_go_only_where_linked(spark):
    own = "a b c d e f g h"
    df = spark.createDataFrame([(1, own), (None, own), (None, "x y z u v w"), (None, None), (2, "q r s t u v")], "doc_id long, text string")
    out = jaccard_join.one_of_each(df, shared_folder(spark, "o"))
    assert sorted((tuple(r) for r in out.collect()), key=key) == sorted([(1, own), (2, "q r s t u v"), (None, "x y z u v w"), (None, None)], key=key)


def test_leaders_that_sizes_part_are_both_open():
    keys, nodes, sizes = np.zeros(4, np.uint64), np.arange(1, 5), np.array([15, 17, 20, 21])
    parted = {(int(a), int(b)) for a, b, f in zip(*jaccard_join.leaders(keys, nodes, sizes, 85), strict=True) if f == 2}
    assert parted and all(100 * min(sizes[a - 1], sizes[b - 1]) < 85 * max(sizes[a - 1], sizes[b - 1]) for a, b in parted)


def test_join_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{FOLDER}/documents.parquet'")
    found = con.execute(jaccard_join.op6_sql())
    assert [c[0] for c in found.description] == ["doc_id", "n_shingles", "component_id"]
    assert sorted(tuple(r) for r in jaccard_join.op6_jaccard_join(spark, FOLDER).collect()) == sorted(found.fetchall())


def test_one_of_each_group_stays(spark, odd):
    out = jaccard_join.one_of_each(odd, shared_folder(spark, "o"))
    assert out.columns == odd.columns
    assert sorted((r.doc_id for r in out.collect() if r.doc_id is not None)) == [1, 2, 3, 4, 6, 7]
    assert jaccard_join.one_of_each(odd.limit(0), shared_folder(spark, "o")).count() == 0


# mixing


def test_mixture_meets_its_targets(spark, docs, odd):
    got = mixing.mix(docs, shared_folder(spark, "m")).toPandas()
    again = mixing.mix(docs.repartition(7), shared_folder(spark, "m")).toPandas()
    order = ["doc_id", "size", "_h"]
    assert got.sort_values(order)[["doc_id", "taken"]].values.tolist() == again.sort_values(order)[["doc_id", "taken"]].values.tolist()
    source = docs.select("doc_id", "source").toPandas().set_index("doc_id").source
    got["source"] = got.doc_id.map(source)
    by = got.groupby("source").agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"), most=("size", "max"))
    assert (got.taken <= 2 * got["size"]).all() and ((by.taken - by.target).abs() <= by.most).all()
    assert by.target.sum() == pytest.approx(1.5 * by["size"].sum()) and (by.target <= 2 * by["size"] + 1e-6).all()
    other = mixing.mix(odd, shared_folder(spark, "m")).toPandas()
    assert len(other) == len(ODD) and sorted(other["size"]) == sorted(len(words(t)) for _, t in ODD)
    rows = mixing.mixed_rows(odd, shared_folder(spark, "m"))
    assert rows.columns == odd.columns and sum(len(words(r.text)) for r in rows.collect()) == other.taken.sum()
    assert mixing.mix(odd.limit(0), shared_folder(spark, "m")).count() == 0


def test_settling_keeps_words_and_expectation():
    rng = np.random.default_rng(0)
    size = rng.integers(1, 500, 200).tolist()
    mean = np.zeros(200)
    for k in range(400):
        whole, hold, held = mixing.settle(size, [0.3] * 200, mixing._uniform(np.arange(200), k).tolist(), False)
        words_ = sum(w * s for w, s in zip(whole, size, strict=True)) + (held * size[hold] if hold >= 0 else 0)
        assert words_ == pytest.approx(0.3 * sum(size))
        if hold >= 0:
            whole[hold] = held
        mean += np.array(whole) / 400
    assert abs(mean.mean() - 0.3) < 0.02 and np.abs(mean - 0.3).max() < 0.15
    assert mixing.water_fill([10, 10, 100], [3, 1, 2], 180) == [20.0, 20.0, 140.0]
    assert mixing.water_fill([0, 10], [1, 1], 15) == [0.0, 15.0]


# language model


def brute_scores(rows, split):
    count, two, three, tokens = Counter(), defaultdict(Counter), defaultdict(Counter), []
    for i, t in rows:
        x = [*words(t), None]
        tokens.append(x)
        if not lm_trie.is_held_out(i):
            count.update(x)
            p = [0, 0, *x]
            for a, w in enumerate(x):
                two[p[a + 1]][w] += 1
                three[p[a], p[a + 1]][w] += 1
    n, v = sum(count.values()), len(count)
    one = lambda w: (count[w] + 0.1) / (n + 0.1 * (v + 1))

    def after(u, w):
        c = two.get(u)
        if not c:
            return one(w)
        total = sum(c.values())
        if total >= split:
            return (c[w] + lm_trie.PRIOR * one(w)) / (total + lm_trie.PRIOR)
        return max(c[w] - lm_trie.DISCOUNT, 0) / total + lm_trie.DISCOUNT * len(c) / total * one(w)

    def chance(t, u, w):
        c = three.get((t, u))
        if not c or sum(two[u].values()) >= split:
            return after(u, w)
        total, kept = sum(c.values()), {a: b - lm_trie.DISCOUNT for a, b in c.items() if b >= lm_trie.LEAST_TRIGRAMS}
        return kept.get(w, 0) / total + (1 - sum(kept.values()) / total) * after(u, w)

    out = []
    for (i, _), x in zip(rows, tokens, strict=True):
        p = [0, 0, *x]
        out.append((i, lm_trie.is_held_out(i), len(x), sum(count[w] > 0 for w in x), n, sum(math.log10(one(w)) for w in x), sum(math.log10(chance(p[a], p[a + 1], w)) for a, w in enumerate(x))))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[2]))


@pytest.mark.parametrize("split", [50_000, 300])
def test_scores_equal_the_model(spark, docs, split):
    for df in (docs, spark.createDataFrame(ODD, "doc_id long, text string")):
        got = sorted((tuple(r) for r in lm_trie.score(df, shared_folder(spark, "l"), split).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
        want = brute_scores(texts_of(df), split)
        assert [g[:5] for g in got] == [w[:5] for w in want]
        assert all(g[5] == pytest.approx(w[5]) and abs(g[6] - w[6]) <= 0.02 * w[2] for g, w in zip(got, want, strict=True))
    held = [g for g in sorted((tuple(r) for r in lm_trie.score(docs, shared_folder(spark, "l")).collect()), key=key) if g[1]]
    assert sum(g[6] for g in held) > sum(g[5] for g in held)
    assert lm_trie.score(docs.limit(0), shared_folder(spark, "l")).count() == 0


@pytest.mark.parametrize("deal", [300, 20])
def test_frequent_words_keep_their_trigrams(spark, docs, deal):
    got = sorted((tuple(r) for r in lm_trie.score(docs, shared_folder(spark, "l"), deal=deal).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    want = brute_scores(texts_of(docs), math.inf)
    assert all(g[:5] == w[:5] and abs(g[6] - w[6]) <= 0.02 * w[2] for g, w in zip(got, want, strict=True))
    assert abs(sum(g[6] - w[6] for g, w in zip(got, want, strict=True))) <= 0.002 * sum(w[2] for w in want)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 2**62), max_size=60), st.lists(st.integers(0, 2**62), max_size=20), st.integers(0, 60))
def test_elias_fano(values, asked, shift):
    v = np.sort(np.array(values, np.int64) >> shift)
    e, _ = elias_fano.EliasFano.from_buffer(elias_fano.EliasFano.build(v).to_bytes())
    q = np.concatenate([v, v + 1, np.array(asked, np.int64) >> shift])
    assert (e.get(np.arange(len(v))) == v).all() and (e.successor(q) == np.searchsorted(v, q)).all()
    assert ((e.find(q) >= 0) == np.isin(q, v)).all()


# main text


def test_main_text_of_layouts():
    for page, main in html_main.labelled_pages():
        assert html_main.main_text(page) == main
    plain = [p for p in html_main.labelled_pages() if "<article" not in p[0] and "<main" not in p[0]]
    held = [p for k, p in enumerate(plain) if k % 4 < 2]
    weights = html_main.fit_weights([p for p in html_main.labelled_pages() if p not in held])
    assert len(held) > 20 and sum(html_main.main_text(p, weights) == m for p, m in held) >= 0.95 * len(held)
    page = """<body><header class="site"><h1>My site</h1></header><div id="cookie-notice">We use cookies</div><div class="main-content"><h1>Title here</h1>
    <p>Some long   text goes here &amp; there&#33;</p><div class="ad-box">Buy now</div><script>var x = "<p>no</p>";</script><ul><li>one item</li></ul><p>Short.</p></div>
    <div class="comments"><p>I liked this very much thanks</p></div><aside>more words</aside><form><p>Your name</p></form><footer>c 2020</footer>"""
    assert html_main.main_text(page) == "Title here\nSome long text goes here & there!\none item\nShort."
    assert html_main.main_text(None) == html_main.main_text("") == html_main.main_text("<p></p>") == ""
    assert html_main.main_text("<article><p>a<nav>b</nav>") == "a"


@pytest.mark.parametrize("name", ['class="layout has-sidebar"', 'class="with-sidebar"', 'class="no-comments"', 'class="header-fixed"', 'id="social-history"', 'class="comments"', 'class="sidebar"'])
def test_wrappers_keep_their_text(name):
    text = "".join(f"<p>{w} runs over the hill and back again</p>" for w in ("alpha", "beta", "gamma"))
    want = "\n".join(f"{w} runs over the hill and back again" for w in ("alpha", "beta", "gamma"))
    foot = '<div class="ad-box">Buy now</div><footer>c 2020</footer>'
    assert html_main.main_text(f"<body><div {name}><article>{text}</article></div>{foot}</body>") == want
    assert html_main.main_text(f"<body><div {name}>{text}</div>{foot}</body>") == want
    assert html_main.main_text(f'<article><div class="post-header"><h1>Title</h1></div><div class="header"><h2>Two</h2></div>{text}<div class="share-links">Tell friends</div></article>') == f"Title\nTwo\n{want}"


def test_main_text_of_pages(spark):
    import html

    for r in html_main.op8_html_main(spark, FOLDER).join(spark.read.parquet(f"{FOLDER}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x))).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


PIECES = ["<p>", "</p>", "<b>", "</b>", "<div>", "</div>", "<nav>", "</nav>", "<div class='ad'>", "<article>", "</article>", "<li>", "<br>", "one two", "three", " ", "&amp;", "<a href='x'>", "</a>", "<script>no</script>", "<option>", "<title>", "<!-- x -->"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=18))
def test_text_is_that_of_the_best_run(pieces):
    """Brute force over all runs of a page: the text is that of a run with the largest sum, less what the weights exclude."""
    page = "".join(pieces)
    tokens, scores = html_main.scored(page, html_main.default_weights())
    best = max([0.0, *(sum(scores[a:b]) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1))])
    low, high = html_main.best_run(scores)
    assert sum(scores[low:high]) == pytest.approx(best)
    words = [w for kind, value, place in tokens[low:high] if kind == "text" and place not in ("@out", "@beside") for w in value.replace("&amp;", "&").split()]
    assert "".join(html_main.main_text(page).split()) == "".join(words)
    shown = re.sub(r"<script>no</script>|<!-- x -->|<[^>]*>", "", page)
    assert "".join("".join(v for k, v, _ in tokens if k == "text").split()) == "".join(shown.split())  # no text is lost on the way


@pytest.mark.parametrize("unit", ["<aside>x ", '<a href="x> y ', "<p>a b</p>", "<b><div></b>", "<", "<a ", "<title>x ", "<!-- ", "<a x=\"'\">y", "<a ' \" ' >y", "<i></b>", "<select><option>x "])
def test_long_pages_take_time_in_proportion(unit):
    import time

    def seconds(n):
        began = time.process_time()
        html_main.main_text(unit * n)
        return time.process_time() - began

    n = 250_000 // len(unit)
    seconds(100)
    assert seconds(4 * n) < 12 * seconds(n) + 0.5


def test_elements_without_an_end_lose_no_text():
    rest = "the rest of the page stays here"
    for opening in ("<datalist><option>a<option>b</datalist>", "<aside>", "<select>", "<object>", "<canvas>", "<title>", "<textarea>", "<nav>", "<div class='ad'>"):
        assert rest in html_main.main_text(f"<body>{opening}<p>{rest}</p></body>"), opening
    assert html_main.main_text("<div class='alert-free'><p>one two three</p></div><div class='alert'>no</div>") == "one two three"
    assert html_main.main_text("<p>1 < 2 and 3 > 2</p>") == "1 < 2 and 3 > 2"


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(-5, 5), max_size=12))
def test_best_run(scores):
    low, high = html_main.best_run([float(s) for s in scores])
    assert sum(scores[low:high]) == max([0, *(sum(scores[a:b]) for a in range(len(scores)) for b in range(a, len(scores) + 1))])


def test_packing_limits_loss_through_the_prompt_column(spark):
    """Instruction data: most ids of some documents are prompt, and a sequence holds at most max_loss of the others."""
    rows = [(i, "word " * (5 + 37 * i % 300), [None, -3, 40, 10_000][i % 4]) for i in range(60)] + [(60, None, 5), (61, "long " * 900, 700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, asked long")
    pieces = packing.pack(docs, shared_folder(spark, "p"), packing.default_tokenizer(), max_tokens=512, max_segments=6, max_loss=200, prompt="asked").collect()
    asked, by = {i: max(0, p or 0) for i, _, p in rows}, {}
    for r in pieces:
        by.setdefault(r.sequence_id, []).append(r)
    for own in by.values():
        assert sum(r.length for r in own) <= 512 and len(own) <= 6
        assert sum(max(0, r.start + r.length - max(asked[r.doc_id], r.start)) for r in own) <= 200
    for i, _, _ in rows:
        own = sorted((r.start, r.length, r.doc_tokens) for r in pieces if r.doc_id == i)
        assert [x[0] for x in own] == [sum(y[1] for y in own[:k]) for k in range(len(own))] and sum(x[1] for x in own) == own[0][2]


# archives


def test_archives_read_back_in_order(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").select("page_id", "url", "html")
    odd_rows = [(None, None, None), (5000, "x", None), (5001, "http://A.example:80/b c#d", ""), (5002, None, "é" * 9), (None, "http://a.example", "é" * 9)]
    rows = pages.union(pages.limit(20).selectExpr("page_id + 1000", "url", "html")).union(spark.createDataFrame(odd_rows, pages.schema))
    for least in (0, 10):
        folder = shared_folder(spark, "w")
        manifest = warc.write_runs(rows.withColumn("first", rows.url), folder, least).cache()
        got = warc.read_captures(warc.merge_index(manifest, folder, 20)).toPandas().sort_values(["range", "place"])
        assert len(got) == rows.count()
        keys = [(warc.url_key(u) if u else "", c) for u, c in zip(got.url, got.captured, strict=True)]
        assert keys == sorted(keys)
        want, first = [], {}
        for r in rows.collect():
            b = (r.html or "").encode()
            if r.page_id is not None:
                first[b] = min(first.get(b, r.page_id), r.page_id)
        for r in rows.collect():
            b = (r.html or "").encode()
            revisit = len(b) >= least and b in first and r.page_id != first[b]
            want.append((r.page_id, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", first[b] if revisit else None))
        have = [(None if x[0] != x[0] else int(x[0]), x[1], x[2], x[3], None if x[4] != x[4] else int(x[4])) for x in got[["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]].itertuples(index=False)]
        assert sorted(have, key=key) == sorted(want, key=key)
    empty = warc.write_runs(pages.limit(0), folder).cache()
    assert warc.read_captures(warc.merge_index(empty, folder)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9), max_size=6), max_size=7))
def test_loser_tree(streams):
    runs = [sorted(s) for s in streams]
    assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


# helpers and the pipeline


def test_range_index(spark):
    df = spark.createDataFrame([(i,) for i in [*range(100), *range(0, 100, 3)]] + [(None,)], "k long")
    bounds = range_bounds(df, "k", 7)
    from pyspark.sql import functions as F

    for r in df.select("k", range_index(F.col("k"), bounds).alias("b")).collect():
        assert r.b == (0 if r.k is None else sum(b <= r.k for b in bounds))


def test_pipeline_stages(spark, docs):
    import corpus_pipeline as P

    rows, seen = docs, {}
    for name, stage in P.STAGES:
        out = stage(spark, rows, FOLDER)
        folder = shared_folder(spark, name)
        out.write.parquet(folder)
        out = spark.read.parquet(folder)
        seen[name] = out
        if name != "packing":
            assert out.columns == docs.columns
        rows = out
    kept = {r.doc_id for r in quality_rules.score(docs, keep=("doc_id",)).filter("kept").collect()}
    assert {r.doc_id for r in seen["quality_rules"].collect()} == kept
    good = texts_of(seen["quality_rules"])
    assert {r.doc_id for r in seen["near_duplicates"].collect()} == {c for _, _, c in brute_components(good, 5, 80)}
    before = dict(texts_of(seen["near_duplicates"]))
    removed = {r[0]: r[2] for r in brute_removed(list(before.items()), P.PASSAGE_BYTES)}
    for i, t in texts_of(seen["repeated_passages"]):
        assert 0 <= removed[i] - (len(before[i].encode()) - len(t.encode())) <= 6 * max(1, removed[i] // P.PASSAGE_BYTES + 1)
    assert {r.doc_id for r in seen["packing"].collect()} == {r.doc_id for r in seen["mixture"].collect()}
    assert P.run(spark, FOLDER).count() == seen["packing"].count()
