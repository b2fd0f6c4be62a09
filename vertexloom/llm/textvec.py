"""Hashes of words, n-grams and word shingles over whole batches of texts.

Texts are laid end to end as UTF-8 bytes, and every hash is a sum of bytes
times fixed multipliers (64 bits, wrapping), so that a batch costs a few numpy
passes and no Python step per word.  All functions are pure: the same text
gives the same numbers in any batch, task or session.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

U = np.uint64
#: Multipliers of the byte at each place of a word; longer words go round.
PLACES = 1 << 12


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: each input bit reaches each output bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_C = mix(np.arange(1, PLACES + 1, dtype=U)) | U(1)


#: Texts above so many characters are split without a list of their words.
LONG = 1 << 18
SPACE = re.compile(r"\s+")
#: Bytes that are hashed at once.
CHUNK = 1 << 18


def words_of(text: str | None) -> str:
    """Lower-cased words joined by single spaces; null: empty."""
    return spaced(text.lower()) if text else ""


def spaced(text: str | None) -> str:
    """Words as they are, joined by single spaces; null: empty."""
    if text and len(text) > LONG:
        return SPACE.sub(" ", text).strip()
    return " ".join(text.split()) if text else ""


class Words:
    """Words of a batch of texts whose words are joined by single spaces.

    hashes: one 64-bit hash a word; doc: its text's index; counts: words of
    each text; data, starts, lengths: the bytes and each word's place there.
    Bytes are hashed ``CHUNK`` at a time, so that a long text needs some bytes
    of memory a byte, and not some numbers a byte.
    """

    def __init__(self, texts: list[str]):
        parts = [t.encode("utf-8", "surrogatepass") for t in texts]
        self.data = np.frombuffer(b" " + b" ".join(parts) + b" ", dtype=np.uint8)
        inside = self.data != 32
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.starts, ends = edge[::2], edge[1::2]
        self.lengths = ends - self.starts
        offsets = np.cumsum([0, *(len(p) + 1 for p in parts)]) + 1
        bounds = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(bounds)
        self.first = bounds[:-1]
        self.doc = np.repeat(np.arange(len(texts), dtype=np.int32), self.counts)
        self.hashes = np.empty(len(self.starts), U)
        for lo, hi in self._runs():
            lengths = self.lengths[lo:hi]
            begin = np.cumsum(lengths) - lengths
            place = np.arange(int(begin[-1] + lengths[-1])) - np.repeat(begin, lengths)
            at = slice(int(self.starts[lo]), int(ends[hi - 1]))
            valued = (self.data[at][inside[at]].astype(U) + U(1)) * _C[place & (PLACES - 1)]
            self.hashes[lo:hi] = mix(np.add.reduceat(valued, begin))

    def _runs(self) -> Iterator[tuple[int, int]]:
        """Ranges of words that have about ``CHUNK`` bytes (one word may have more)."""
        lo = 0
        while lo < len(self.starts):
            hi = max(lo + 1, int(np.searchsorted(self.starts, self.starts[lo] + CHUNK)))
            yield lo, hi
            lo = hi

    def grams(self, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Hash and text index of each run of n > 2 bytes within a word and the
        space on either side of it, ``CHUNK`` bytes at a time."""
        last = len(self.data) - n + 1 if len(self.starts) else 0
        for lo in range(0, last, CHUNK):
            size = min(CHUNK, last - lo)
            data = self.data[lo : lo + size + n - 1]
            space = data == 32
            good = np.ones(size, bool)
            for j in range(1, n - 1):
                good &= ~space[j : j + size]
            at = np.flatnonzero(good)
            total = np.full(len(at), n, U)
            for j in range(n):
                total += (data[at + j].astype(U) + U(1)) * _C[j + 97 * n]
            # a gram's second byte lies in a word, which tells the text
            word = np.searchsorted(self.starts, at + (lo + 1), side="right") - 1
            yield mix(total), self.doc[np.maximum(word, 0)]

    def shingles(self, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text its distinct shingles of k words, ascending, and how
        often each occurs.  A text of 1 to k-1 words has one shingle of all
        its words; a text without words has none."""
        h, n = self.hashes, len(self.hashes)
        if n >= k:
            rolled = np.zeros(n - k + 1, U)
            for j in range(k):
                rolled += h[j : j + n - k + 1] * _C[j]
            rolled = mix(rolled)
        out = []
        for start, count in zip(self.first.tolist(), self.counts.tolist()):
            if count >= k:
                out.append(np.unique(rolled[start : start + count - k + 1], return_counts=True))
            elif count:
                out.append((mix((h[start : start + count] * _C[:count]).sum(dtype=U, keepdims=True) + U(count)), np.ones(1, np.int64)))
            else:
                out.append((np.zeros(0, U), np.zeros(0, np.int64)))
        return out
