"""SimHash near duplicates against brute force over all pairs."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from colocus.llm import simhash
from colocus.llm.common import shared_folder

FOLDER = "/root/testdata/sf0.001"
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def brute_print(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(LOWER))
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(grams))


def brute_roots(prints, most=4):
    """The smallest place that each fingerprint reaches."""
    above = list(range(len(prints)))

    def top(i):
        while above[i] != i:
            i = above[i]
        return i

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= most and top(i) != top(j):
                above[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(len(prints))]


def test_components_equal_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    prints = [brute_print(t) for _, t in rows]
    roots = brute_roots(prints)
    low = {}
    for (i, _), r in zip(rows, roots, strict=True):
        low[r] = min(low.get(r, i), i)
    want = {i: (f"{p:016x}", low[r]) for (i, _), p, r in zip(rows, prints, roots, strict=True)}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op11_simhash(spark, FOLDER).collect()}
    assert got == want and len({c for _, c in want.values()}) < len(want)


def test_awkward_rows(spark):
    long = "Lorem " * 40_000 + "end"
    odd = [(1, None), (2, ""), (3, " \n\t"), (4, "One two"), (5, "one\vtwo"), (5, "one two"), (None, "a b c d e f"), (None, "only here now yes"), (6, "a  B c d e f"), (7, long), (8, "é\xa0日 🙂"), (9, "x\x1cy z w v")]
    df = spark.createDataFrame([(i, t, 1, "fp") for i, t in odd], "doc_id long, text string, fp int, first string")
    got = sorted((tuple(r) for r in simhash.near_duplicates(df, shared_folder(spark, "s")).collect()), key=str)
    prints = [brute_print(t) for _, t in odd]
    roots, low = brute_roots(prints), {}
    for (i, _), r in zip(odd, roots, strict=True):
        if i is not None:
            low[r] = min(low.get(r, i), i)
    assert got == sorted(((i, f"{p:016x}", low.get(r)) for (i, _), p, r in zip(odd, prints, roots, strict=True)), key=str)
    assert simhash.near_duplicates(df.limit(0), shared_folder(spark, "s")).count() == 0
    assert simhash.fingerprint(long) == brute_print(long)


def planted(seed, n, spread):
    """Random fingerprints, each with a few neighbours at random distances."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        x = r.getrandbits(64) & r.getrandbits(64) if r.random() < 0.5 else r.getrandbits(64)
        out.append(x)
        for _ in range(r.randrange(spread)):
            y = r.choice(out[-3:])
            for b in r.sample(range(64), r.randrange(0, 8)):
                y ^= 1 << b
            out.append(y)
    return sorted(set(out))


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32), st.integers(0, 5), st.sampled_from([1, 4, 256]))
def test_cells_find_every_link(seed, most, small):
    prints = planted(seed, 25, 5)
    x = np.array(prints, np.uint64)
    cell, of = [], []
    for _, valid, at in simhash.cells(x):
        cell.append(at)
        of.append(valid)
    was = simhash.SMALL_CELL
    simhash.SMALL_CELL = small  # also through the leaders of large cells
    try:
        parent = simhash.meet(np.concatenate(cell), np.concatenate(of), x, most)
    finally:
        simhash.SMALL_CELL = was
    assert parent.tolist() == brute_roots(prints, most)


@given(st.integers(0, 2**64 - 1), st.integers(0, 2**64 - 1))
def test_manhattan_distance_is_a_lower_bound(a, b):
    counts = [[(v >> 2 * i & 3).bit_count() for i in range(32)] for v in (a, b)]
    p, q = simhash.points(np.array([a, b], np.uint64)).tolist()
    assert (p ^ q).bit_count() == sum(abs(c - d) for c, d in zip(*counts, strict=True)) <= (a ^ b).bit_count()


def test_a_dense_group_is_one_component(spark):
    """Thousands of different fingerprints in one small ball: connected, with edges in proportion."""
    r = random.Random(7)
    base = r.getrandbits(64)
    prints = list({base ^ sum(1 << b for b in r.sample(range(20), 4)) for _ in range(6000)} | {base ^ 0xFFFFFFFF00000000})
    df = spark.createDataFrame([(p - 2**64 if p >= 2**63 else p,) for p in prints], "fp long")
    edges = [tuple(e) for e in simhash.links(df).collect()]
    above = {}

    def top(i):
        while above.get(i, i) != i:
            i = above[i]
        return i

    for a, b in edges:
        if top(a) != top(b):
            above[top(a)] = top(b)
    assert len({top(p - 2**64 if p >= 2**63 else p) for p in prints}) == 2
    assert len(edges) < 60 * len(prints)


def test_more_bits_than_the_grid_finds_are_refused(spark):
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), 6)
