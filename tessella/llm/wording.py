"""The words of a batch of texts as arrays: where they are, which unit (line or paragraph) each is in, and hashes of runs of them.

Words are what the white space of the text contracts parts, in lower case; a unit's normal form is its words in order. All is done on the batch's
UTF-8 bytes, so that a text costs a few array passes and no Python object per word.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes whose words are hashed together; a longer word gets another hash.
CHUNK = 1 << 20
LONG_WORD = 1 << 16
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_space = np.zeros(256, bool)
_space[[9, 10, 11, 12, 13, 32]] = True


@cache
def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, base & ((1 << 64) - 1), np.uint64)]), dtype=np.uint64)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 to base**n, modulo 2**64."""
    return _powers(base, 1 << max(16, n.bit_length()))[: n + 1]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def sums(codes: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of codes[i] * base**i, and base**-i: what the hash of any run is made of."""
    n = len(codes)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * powers(base, n)[:n], dtype=np.uint64)])
    return total, powers(pow(base, -1, 1 << 64), n)


def runs(codes: np.ndarray, n: int, base: int) -> np.ndarray:
    """A hash of each run of n codes."""
    if len(codes) < n:
        return np.zeros(0, np.uint64)
    total, down = sums(codes, base)
    return mix((total[n:] - total[:-n]) * down[: len(codes) - n + 1])


def stretches(codes: np.ndarray, begins: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """A hash of each stretch of codes from begins to ends."""
    total, down = sums(codes, base)
    return mix((total[ends] - total[begins]) * down[begins] + (ends - begins).astype(np.uint64))


def sliding(values: np.ndarray, width: int, function) -> np.ndarray:
    """function (minimum or maximum) of each `width` values that follow one another."""
    done, have = values, 1
    while have * 2 <= width:
        done, have = function(done[:-have], done[have:]), have * 2
    return function(done[: len(values) - width + 1], done[width - have :]) if width > have else done


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts laid end to end, and the bounds of each."""
    texts = texts.cast(pa.string())
    _, bounds, data = texts.buffers()
    at = np.frombuffer(bounds, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    return np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]], at - at[0]


class Words:
    """The words of texts (null: none): starts and ends in the bytes, bounds: the words of text i are bounds[i] to bounds[i + 1]."""

    def __init__(self, texts: pa.Array):
        self.data, self.at = raw(pc.fill_null(texts, ""))
        inside = ~_space[self.data]
        before, after = np.concatenate([[False], inside[:-1]]), np.concatenate([inside[1:], [False]])
        filled = self.at[1:] > self.at[:-1]
        before[self.at[:-1][filled]] = False
        after[self.at[1:][filled] - 1] = False
        self.starts, self.ends = np.flatnonzero(inside & ~before[: len(inside)]), np.flatnonzero(inside & ~after[: len(inside)]) + 1
        self.bounds = np.searchsorted(self.starts, self.at)

    def codes(self) -> np.ndarray:
        """64 bits of each word."""
        out = np.zeros(len(self.starts), np.uint64)
        up, down = powers(BASES[0], CHUNK + LONG_WORD), powers(pow(BASES[0], -1, 1 << 64), CHUNK + LONG_WORD)
        sizes = self.ends - self.starts
        longer = np.flatnonzero(sizes > LONG_WORD)
        for i in longer.tolist():
            out[i] = int.from_bytes(hashlib.blake2b(self.data[self.starts[i] : self.ends[i]].tobytes(), digest_size=8).digest(), "little")
        usual = np.flatnonzero(sizes <= LONG_WORD)
        i = 0
        while i < len(usual):
            first = int(self.starts[usual[i]])
            j = max(i + 1, int(np.searchsorted(self.starts[usual], first + CHUNK)))
            own = usual[i:j]
            part = self.data[first : self.ends[own[-1]]]
            if len(part) > len(up):  # a long word stands between
                j = i + 1
                own = usual[i:j]
                part = self.data[first : self.ends[own[-1]]]
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], dtype=np.uint64)])
            a, b = self.starts[own] - first, self.ends[own] - first
            out[own] = mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))
            i = j
        return out

    def separators(self, sep: str) -> np.ndarray:
        """Where the literal sep, one or more line feeds, parts units, as str.split does: from the left, without overlap."""
        feeds = np.flatnonzero(self.data == 10)
        if len(sep) == 1 or not len(feeds):
            return feeds
        text = np.searchsorted(self.at, feeds, "right")
        new = np.append(True, (np.diff(feeds) > 1) | (np.diff(text) > 0))
        first = np.flatnonzero(new)
        of = np.cumsum(new) - 1
        place, length = np.arange(len(feeds)) - first[of], np.diff(np.append(first, len(feeds)))[of]
        return feeds[(place % len(sep) == 0) & (place + len(sep) <= length)]

    def units(self, sep: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the units with a word: their first and past-the-last words; and how many of them each text has up to its own (bounds)."""
        cuts = np.searchsorted(self.starts, self.separators(sep))
        begins = np.unique(np.concatenate([cuts, self.bounds[:-1]]))
        begins = begins[begins < len(self.starts)]
        return begins, np.append(begins[1:], len(self.starts))[: len(begins)], np.searchsorted(begins, self.bounds)


def lowered(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(texts.cast(pa.string()))
