"""md5 of many short texts at once, as arrays."""

from __future__ import annotations

import numpy as np

#: Texts to a pass, so that its arrays stay in a core's cache.
BLOCK = 4096
_SINES = [np.uint32(int(abs(np.sin(i + 1.0)) * 2**32)) for i in range(64)]
_TURNS = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
_WORDS = [i if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else 7 * i % 16 for i in range(64)]
_START = [np.uint32(v) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]


def _leading(words: np.ndarray) -> np.ndarray:
    a, b, c, d = (np.full(words.shape[1], v, np.uint32) for v in _START)
    f, t = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f)
        np.add(f, _SINES[i], out=f)
        np.add(f, words[_WORDS[i]], out=f)
        np.left_shift(f, np.uint32(_TURNS[i]), out=t)
        np.right_shift(f, np.uint32(32 - _TURNS[i]), out=f)
        np.bitwise_or(f, t, out=f)
        np.add(f, b, out=f)
        a, d, c, b, f = d, c, b, f, a
    high, low = (np.add(v, s).byteswap().astype(np.uint64) for v, s in zip((a, b), _START, strict=False))
    return high << np.uint64(32) | low


class Digests:
    """The first 64 bits, as a number, of the md5 of a prefix and each of the given ASCII texts; at most 55 bytes together."""

    def __init__(self, texts: list[str]):
        self.texts = np.array([t.encode("ascii") for t in texts] or [b""])
        self.sizes = np.char.str_len(self.texts)
        self.blocks: dict[int, np.ndarray] = {}

    def _template(self, size: int) -> np.ndarray:
        """The messages (16 words each) after a prefix of so many bytes, which stay 0."""
        wide = self.texts.dtype.itemsize
        if size + wide > 55:
            raise ValueError("texts of more than one md5 block")
        out = np.zeros((len(self.texts), 64), np.uint8)
        out[:, size : size + wide] = self.texts.view(np.uint8).reshape(len(self.texts), wide)
        out[np.arange(len(out)), size + self.sizes] = 0x80
        out[:, 56:58] = (8 * (size + self.sizes)).astype("<u2").view(np.uint8).reshape(-1, 2)
        return np.ascontiguousarray(out.view("<u4").T)

    def after(self, prefix: str) -> np.ndarray:
        raw = prefix.encode("ascii")
        if len(raw) not in self.blocks:
            self.blocks = {len(raw): self._template(len(raw))}  # prefixes of one length follow each other
        words = self.blocks[len(raw)]
        own = np.frombuffer(raw.ljust(64, b"\0"), "<u4")
        parts = []
        for low in range(0, words.shape[1], BLOCK):
            part = words[:, low : low + BLOCK].copy()
            for i in range(-(-len(raw) // 4)):
                part[i] |= own[i]
            parts.append(_leading(part))
        return np.concatenate(parts)
