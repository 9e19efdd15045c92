"""Words of many UTF-8 texts at once, as 64-bit hashes, without a Python object per word."""

from __future__ import annotations

import numpy as np
import xxhash

U = np.uint64
_GOLDEN = U(0x9E3779B97F4A7C15)
#: Longer words are hashed one by one, so that a step over all words never waits for a few.
_LONG = 128
#: Bytes of a block that belong to a word with n bytes left.
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], U)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class Words:
    """Word finder for a byte class. `gap(byte)` says which bytes are between words; all bytes from 0x80 are in words.

    A word's hash starts from its length and takes eight bytes a step; each step is mixed before the next, so words
    that differ in any block part ways for good, whatever regular patterns they are made of.
    """

    def __init__(self, gap, lower: bool = True):
        self.inside = np.array([not gap(b) for b in range(256)])
        self.lower = bytes(b + 32 if lower and 65 <= b <= 90 else b for b in range(256))
        if lower:
            self.inside[65:91] = self.inside[97:123]

    def spans(self, texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        """(buffer, start and end byte of each word, first word of each text and one more)."""
        data = b"\n".join(texts) + b"\n"
        buf = np.frombuffer(data, np.uint8)
        inside = self.inside[buf]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            edges = np.concatenate(([0], edges))
        starts, ends = edges[0::2], edges[1::2]
        first = np.cumsum([0] + [len(t) + 1 for t in texts])
        return data, starts, ends, np.searchsorted(starts, first)

    def hashes(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
        """(hash of each word, first word of each text and one more, starts, ends, buffer)."""
        data, starts, ends, first = self.spans(texts)
        own = data.translate(self.lower) + bytes(8)
        blocks = np.ndarray((len(data),), "<u8", own, strides=(1,))  # the eight bytes from each place on
        size = ends - starts
        h = mix(size.astype(U) * U(0xA0761D6478BD642F))
        rows = np.flatnonzero(size <= _LONG)
        at, left = starts[rows], size[rows]
        while len(rows):
            h[rows] = mix((h[rows] ^ (blocks[at] & _MASKS[np.minimum(left, 8)])) * _GOLDEN + U(0xD6E8FEB86659FD93))
            more = left > 8
            rows, at, left = rows[more], at[more] + 8, left[more] - 8
        for i in np.flatnonzero(size > _LONG).tolist():
            h[i] = xxhash.xxh3_64_intdigest(own[starts[i] : ends[i]], seed=int(size[i]))
        return h, first, starts, ends, data


#: Words between white space: [^\x20\x09-\x0D]+, and the words of letters, digits and all from U+0080.
BY_SPACE = Words(lambda b: b == 0x20 or 0x09 <= b <= 0x0D)
BY_SIGN = Words(lambda b: b < 0x30 or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F)
_STEPS = [U(pow(0xE7037ED1A0B428DB, i + 1, 1 << 64)) for i in range(64)]


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words; entries that cross a text's end are for the caller to leave out."""
    if len(h) < k:
        return np.empty(0, U)
    n = len(h) - k + 1
    out = np.zeros(n, U)
    for i in range(k):
        step = U(pow(int(_STEPS[0]), i + 1, 1 << 64)) if i >= 64 else _STEPS[i]
        out += h[i : i + n] * step
    return mix(out + U(k))
