"""Token ids of whole texts through the tokenizers library, each distinct piece encoded once per worker."""

from __future__ import annotations

import os
import re
from itertools import repeat
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from colocus.llm.common import ragged

#: Pieces that a worker keeps (about 100 bytes each); beyond that those go that were used least.
MOST_PIECES = 400_000
#: Marks that may close a word: a run of them after letters is a pre-token of its own.
TAIL = ".,;:!?$&%#*|"
#: Letters below U+0250, words of which need no more than the model's merges.
LETTERS = "".join(c for c in map(chr, range(0x250)) if c.isalpha())
_INNER_SPACE = re.compile(r"(?<=\S) (?=\S)")
_ID = attrgetter("id")
_ENCODERS: dict[str, "Encoder"] = {}


def _byte_alphabet() -> dict[int, str]:
    """Byte to the printable character that stands for it in a byte-level vocabulary: bytes that print
    as themselves stay, the others take the code points from 256 on in byte order."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Pieces(dict):
    """Piece to slot; a new piece gets the next slot and waits to be encoded. Slot 0: not safe to encode alone.

    A str stands for itself after a space, a tuple for its one text at the start of a text."""

    def __init__(self):
        super().__init__()
        self.waiting: list = []
        self.slots = 1

    def __missing__(self, piece):
        self.slots_of([piece])
        return self[piece]

    def slots_of(self, pieces: list) -> np.ndarray:
        """The slots of distinct pieces, all of one type."""
        found = np.fromiter(map(self.get, pieces, repeat(-1)), np.int64, len(pieces))
        new = np.flatnonzero(found < 0)
        if len(new):
            names = [pieces[i] for i in new.tolist()]
            if type(names[0]) is str:
                safe = np.fromiter((p != "" and p.strip() == p for p in names), bool, len(names))
                if not safe.all():
                    found[new[~safe]] = 0
                    new, names = new[safe], [p for p, x in zip(names, safe.tolist(), strict=True) if x]
                    self.update((pieces[i], 0) for i in np.flatnonzero(found == 0).tolist())
            found[new] = np.arange(self.slots, self.slots + len(new))
            self.update(zip(names, range(self.slots, self.slots + len(new)), strict=True))
            self.slots += len(new)
            self.waiting += names
        return found


def _taken_apart(words: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array, np.ndarray, pa.Array, pa.Array]:
    """What of distinct words can be encoded apart.

    Which words are letters and marks after them, or two such joined by one line
    feed, and the letters and marks (the line feed included) that these begin
    with; which are the joined ones, and their second letters and marks.
    """
    size = lambda x: pc.binary_length(x).to_numpy()
    rest = pc.utf8_ltrim(words, characters=LETTERS)
    after = pc.utf8_ltrim(rest, characters=TAIL)
    begun = size(rest) < size(words)
    mask = begun & (size(after) == 0) & (size(rest) > 0)
    double = np.flatnonzero(begun & pc.starts_with(after, "\n").to_numpy(zero_copy_only=False))
    seconds = pc.utf8_slice_codeunits(after.take(pa.array(double)), 1)
    ends = pc.utf8_ltrim(seconds, characters=LETTERS)
    good = (size(ends) < size(seconds)) & (size(pc.utf8_ltrim(ends, characters=TAIL)) == 0)
    double, seconds, ends = double[good], seconds.filter(pa.array(good)), ends.filter(pa.array(good))
    mask[double] = True
    tailed = np.flatnonzero(mask)
    joined = np.isin(tailed, double)
    own, tails = words.take(pa.array(tailed)), rest.take(pa.array(tailed))
    heads = pc.utf8_rtrim(own.filter(pa.array(joined)), characters=TAIL + LETTERS)
    own = pc.replace_with_mask(own, pa.array(joined), heads)
    tails = pc.replace_with_mask(tails, pa.array(joined), pc.utf8_ltrim(heads, characters=LETTERS))
    return tailed, pc.utf8_rtrim(own, characters=TAIL + "\n"), tails, double, pc.utf8_rtrim(seconds, characters=TAIL), ends


class Encoder:
    """Byte-level BPE ids, as the library gives them with add_special_tokens=False: a special token
    that a text spells out is its one id.

    A lone space between two non-space characters always starts a new
    pre-token, so a text may be cut there and its parts encoded apart with the same result. Special
    tokens are cut out first, and what lies between them is encoded as texts of their own.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = {t.content: i for i, t in added.items()}
        if any(t.lstrip or t.rstrip or t.single_word for t in added.values()):
            raise ValueError(f"{path}: added tokens that take in their surroundings are not supported")
        longest = sorted(self.special, key=len, reverse=True)
        self.special_at = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None
        vocab = self.tokenizer.get_vocab()
        self.starts_word = np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            self.starts_word[i] = token.startswith("Ġ")
        self.model = self.tokenizer.model
        self.tails: dict[str, list[int]] = {"": []}
        self.as_bytes = _byte_alphabet()
        self._reset()

    def forget(self) -> None:
        """Drop all kept pieces."""
        self._reset()

    def _reset(self) -> None:
        self.pieces = _Pieces()
        self.tails = dict(list(self.tails.items())[:1000])
        self.start, self.length, self.uses = (np.zeros(1024, np.int64) for _ in range(3))
        self.table, self.filled = np.zeros(1 << 14, np.uint32), 0

    def _shed(self) -> None:
        """Keep the pieces that were used most since the last time, twice at least, up to half of MOST_PIECES."""
        uses = self.uses[1 : self.pieces.slots]
        least = max(2, int(np.partition(uses, -MOST_PIECES // 2)[-MOST_PIECES // 2]) + 1) if len(uses) > MOST_PIECES // 2 else 2
        kept = [(p, slot) for p, slot in self.pieces.items() if slot and self.uses[slot] >= least]
        slots = np.array([slot for _, slot in kept], np.int64)
        lengths = self.length[slots]
        flat = self.table[ragged(self.start[slots], lengths)]
        self._reset()
        for p, _ in kept:
            dict.__setitem__(self.pieces, p, self.pieces.slots)
            self.pieces.slots += 1
        self._store(np.arange(1, len(kept) + 1), flat, lengths)

    def _store(self, slots: np.ndarray, flat: np.ndarray, lengths: np.ndarray) -> None:
        if self.pieces.slots > len(self.start):
            more = 2 * self.pieces.slots
            self.start, self.length = np.resize(self.start, more), np.resize(self.length, more)
            self.uses = np.concatenate([self.uses, np.zeros(more - len(self.uses), np.int64)])
        if self.filled + len(flat) > len(self.table):
            self.table = np.resize(self.table, 2 * (self.filled + len(flat)))
        self.table[self.filled : self.filled + len(flat)] = flat
        self.start[slots] = self.filled + np.cumsum(lengths) - lengths
        self.length[slots] = lengths
        self.filled += len(flat)

    def _encode_waiting(self) -> None:
        waiting, self.pieces.waiting = self.pieces.waiting, []
        slots = np.arange(self.pieces.slots - len(waiting), self.pieces.slots)  # in order of first sight
        first = np.fromiter((type(p) is tuple for p in waiting), bool, len(waiting))
        whole = pa.array([p[0] if type(p) is tuple else p for p in waiting] if first.any() else waiting, pa.large_string())
        lettered = (pc.binary_length(pc.utf8_ltrim(whole, characters=LETTERS)).to_numpy() == 0) & (pc.binary_length(whole).to_numpy() > 0)
        odd = (first | pc.match_substring(whole, " ").to_numpy(zero_copy_only=False)) & ~lettered
        for at, before in ((lettered & ~first, "Ġ"), (lettered & first, "")):
            if at.any():
                self._encode_lettered(whole.filter(pa.array(at)).to_pylist(), slots[at], before)
        plain, own = whole.filter(pa.array(~lettered & ~odd)).to_pylist(), slots[~lettered & ~odd]
        for at in range(0, len(plain), 2048):
            part = plain[at : at + 2048]
            flat = np.array(self.tokenizer.encode(" " + " ".join(part), add_special_tokens=False).ids, np.uint32)
            starts = np.flatnonzero(self.starts_word[flat])
            self._store(own[at : at + 2048], flat, np.diff(starts, append=len(flat)))
        if odd.any():
            texts = [p if x else " " + p for p, x in zip(whole.filter(pa.array(odd)).to_pylist(), first[odd].tolist(), strict=True)]
            ids = [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
            flat = np.fromiter((i for x in ids for i in x), np.uint32)
            self._store(slots[odd], flat, np.fromiter(map(len, ids), np.int64, len(ids)))

    def _encode_lettered(self, stems: list[str], slots: np.ndarray, before: str) -> None:
        """Words that are letters alone: the model merges each by itself."""
        merge, ids, many = self.model.tokenize, [], []
        for stem in stems:
            found = merge(before + (stem if stem.isascii() else stem.encode().decode("latin-1").translate(self.as_bytes)))
            ids += map(_ID, found)
            many.append(len(found))
        self._store(slots, np.array(ids, np.uint32), np.array(many, np.int64))

    def _tails(self, tails: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each run of marks its place in ids, its length; the ids."""
        coded = tails.dictionary_encode()
        found = []
        for t in coded.dictionary.to_pylist():
            if t not in self.tails:
                self.tails[t] = self.tokenizer.encode(t, add_special_tokens=False).ids
            found.append(self.tails[t])
        many = np.fromiter(map(len, found), np.int64, len(found))
        at = coded.indices.to_numpy()
        return (np.cumsum(many) - many)[at], many[at], np.array([i for x in found for i in x], np.uint32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and the number of ids of each text."""
        special = self.special
        if not any(mark in text for mark in special for text in texts):
            return self._encode(texts)
        parts = [self.special_at.split(text) for text in texts]  # odd places: special tokens
        flat, n = self._encode([p for own in parts for p in own[::2]])
        ends = np.cumsum(n)
        found, lengths, at = [], [], 0
        for own in parts:
            before = len(found)
            for k, p in enumerate(own):
                if k % 2:
                    found.append(np.array([special[p]], np.uint32))
                else:
                    found.append(flat[ends[at] - n[at] : ends[at]])
                    at += 1
            lengths.append(sum(map(len, found[before:])))
        return np.concatenate(found), np.array(lengths, np.int64)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.pieces.slots > MOST_PIECES:
            self._shed()
        slot = self.pieces.__getitem__
        lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        n, parts = lists.value_lengths().to_numpy().astype(np.int64), lists.flatten()
        begin = np.cumsum(n) - n
        coded = parts.dictionary_encode()  # each distinct word of the batch is looked up once
        words, place = coded.dictionary, coded.indices.to_numpy()
        tailed, stems, tails, double, seconds, ends = _taken_apart(words)
        mask = np.zeros(len(words), bool)
        mask[tailed] = True
        keys = pc.replace_with_mask(words, pa.array(mask), stems).dictionary_encode()
        own = self.pieces.slots_of(keys.dictionary.to_pylist())[keys.indices.to_numpy()]
        keys = seconds.dictionary_encode()
        second = self.pieces.slots_of([(p,) for p in keys.dictionary.to_pylist()])[keys.indices.to_numpy()]
        w = len(words)
        slots = place.astype(np.int64)  # below w: a word of the batch; from there on w and the slot of a piece
        unsafe = (own == 0)[place]
        firsts = parts.take(pa.array(begin)).to_pylist()
        slots[begin] = [w + slot((p,)) for p in firsts]
        unsafe[begin] = [p[-1:].isspace() or not p and k > 1 for p, k in zip(firsts, n.tolist(), strict=True)]
        if unsafe.any():
            pieces, done = [], 0
            for i in np.unique(np.searchsorted(begin, np.flatnonzero(unsafe), side="right") - 1).tolist():
                cut = _INNER_SPACE.split(texts[i])
                found = [slot((cut[0],)), *(slot(p) or self._odd(p) for p in cut[1:])]
                pieces += [slots[done : begin[i]], w + np.array(found, np.int64)]
                done = begin[i] + n[i]
                n[i] = len(found)
            slots = np.concatenate([*pieces, slots[done:]])
        self._encode_waiting()
        beyond = np.flatnonzero(slots >= w)
        others, back = np.unique(slots[beyond] - w, return_inverse=True)
        slots[beyond] = w + back
        own = np.concatenate([own, others])
        many = np.bincount(slots, minlength=len(own))
        used = np.bincount(np.concatenate([own, second]), weights=np.concatenate([many, many[double]]), minlength=self.pieces.slots).astype(np.int64)
        self.uses[: len(used)] += used
        # the ids of each word of the batch, then of each other piece: stem and marks, for double words once more
        parts_ = np.zeros((len(own), 4), np.int64)
        parts_[:, 0] = self.length[own]
        at, parts_[tailed, 1], tail_ids = self._tails(tails)
        parts_[double, 2] = self.length[second]
        end_at, parts_[double, 3], end_ids = self._tails(ends)
        whole = parts_.sum(axis=1)
        start = np.cumsum(whole) - whole
        begins = start[:, None] + np.cumsum(parts_, axis=1) - parts_
        table = np.empty(int(whole.sum()), np.uint32)
        for k, rows, ids, source in ((0, np.arange(len(own)), self.table, self.start[own]), (1, tailed, tail_ids, at), (2, double, self.table, self.start[second]), (3, double, end_ids, end_at)):
            table[ragged(begins[rows, k], parts_[rows, k])] = ids[ragged(source, parts_[rows, k])]
        lengths = whole[slots]
        flat = table[ragged(start[slots], lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        edges = np.concatenate([[0], np.cumsum(n)])
        return flat, np.diff(ends[edges])

    def _odd(self, piece: str) -> int:
        """A piece that ends in white space: kept under a key of its own, encoded with its leading space."""
        return self.pieces[(" " + piece,)]


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
