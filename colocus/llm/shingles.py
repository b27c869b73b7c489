"""Sets of hashed word shingles, made for many texts at once."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import xxhash

from colocus.llm.common import LOWER, ragged

U = np.uint64


def mix(z: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    with np.errstate(over="ignore"):
        z = (z ^ (z >> U(30))) * U(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> U(27))) * U(0x94D049BB133111EB)
        return z ^ (z >> U(31))


class WordIds(defaultdict):
    """Word to number, in order of first sight."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def word_numbers(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The words of all texts as numbers, how many each text has, and the distinct words (lower-cased A-Z)."""
    seen, lists, counts = WordIds(), [], []
    for text in texts:
        words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
        lists.append(np.fromiter(map(seen.__getitem__, words), np.int32, len(words)))
        counts.append(len(words))
    flat = np.concatenate(lists) if lists else np.zeros(0, np.int32)
    return flat, np.array(counts, np.int64), list(seen)


def shingle_sets(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and the size of each set.

    A text with fewer words has its whole sequence as its one shingle; a text
    without words has none.
    """
    flat, counts, words = word_numbers(texts)
    table = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), U, len(words))
    h = table[flat] if len(flat) else np.zeros(0, U)
    starts = np.cumsum(counts) - counts
    spans = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    at = ragged(starts, spans)
    doc = np.repeat(np.arange(len(counts)), spans)
    short = counts[doc] < width
    value = np.full(len(at), U(width), U)
    last = max(len(h) - 1, 0)
    with np.errstate(over="ignore"):
        for k in range(width):
            here = h[np.minimum(at + k, last)] if len(h) else h
            inside = ~short | (k < counts[doc])
            value = np.where(inside, mix(value * U(0x9E3779B97F4A7C15) + here + U(k + 1)), value)
        value = np.where(short, mix(value + U(0x51ED270B) * (counts[doc].astype(U) + U(1))), value)
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    first = np.ones(len(value), bool)
    first[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    return value[first], np.bincount(doc[first], minlength=len(counts)).astype(np.int64)


def set_names(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 63-bit name of each set; equal sets have equal names. 0 stands for the empty set."""
    ends = np.cumsum(sizes)
    names = np.zeros(len(sizes), np.int64)
    for i in np.flatnonzero(sizes):
        names[i] = (xxhash.xxh3_64_intdigest(values[ends[i] - sizes[i] : ends[i]].tobytes(), seed=17) >> 1) or 1
    return names
