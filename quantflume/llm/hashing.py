"""Vectorized hashes of words and word runs over blocks of texts."""

from __future__ import annotations

import numpy as np

_Q = 0xC2B2AE3D27D4EB4F
U = np.uint64

#: Bytes of words hashed at once.
SLICE = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix_one(seed: int) -> int:
    """``mix`` of a number, for seeds far apart."""
    return int(mix(np.array([seed], dtype=np.uint64))[0])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all (the finalizer of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Words:
    """The words (runs of bytes other than space and \\x09-\\x0D) of a block of texts.

    ``hash``: 64 bits of each word's bytes. ``first``: each text's first word;
    ``count``: its number of words. ``start``, ``end``: bytes in ``raw``.
    """

    def __init__(self, texts: list[str], lower: bool):
        raw = [t.encode("utf-8", "replace") for t in texts]
        if lower:
            raw = [r.lower() for r in raw]  # A-Z only
        self.raw = b"\n".join(raw) + b"\n"
        self.data = np.frombuffer(self.raw, dtype=np.uint8)
        space = _SPACE[self.data]
        edge = np.flatnonzero(np.diff(space, prepend=True))
        self.start, self.end = edge[0::2], edge[1::2]
        begins = np.cumsum([0, *(len(r) + 1 for r in raw)])
        bounds = np.searchsorted(self.start, begins)
        self.first, self.count = bounds[:-1], np.diff(bounds)
        self.hash = self.hashes(0)

    def hashes(self, seed: int) -> np.ndarray:
        """64 bits of each word: the sum of a random number for each (byte, place in the word).

        The numbers are ``mix`` of the pair, so no rule ties the sums of
        different words; other seeds give independent hashes.
        """
        n = len(self.start)
        out = np.zeros(n, dtype=np.uint64)
        size = self.end - self.start
        ends, own_seed = np.cumsum(size), U(mix_one(seed))
        a = 0
        while a < n:  # in slices of words, so that a long text's numbers aren't all held at once
            before = int(ends[a] - size[a])
            b = max(a + 1, int(np.searchsorted(ends, before + SLICE, side="right")))
            for first in range(int(self.start[a]), int(self.end[b - 1]), SLICE) if b == a + 1 else [int(self.start[a])]:
                # a word longer than a slice is summed in several
                last = min(int(self.end[b - 1]), first + SLICE) if b == a + 1 else int(self.end[b - 1])
                part = self.data[first:last]
                if b > a + 1:
                    part = part[~_SPACE[part]]
                    begins = ends[a:b] - size[a:b] - before
                    place = np.arange(len(part)) - np.repeat(begins, size[a:b])
                else:
                    begins, place = np.zeros(1, dtype=np.int64), np.arange(first, last) - int(self.start[a])
                own = mix((place.astype(np.uint64) << U(8) | part) + own_seed)
                out[a:b] += np.add.reduceat(own, begins)
            a = b
        return mix(out + size.astype(np.uint64))

    def runs(self, n: int, seed: int = 0) -> np.ndarray:
        """For each word the hash of the n words from it on; it means nothing where a text (or the block) ends before. Other seeds hash the bytes anew."""
        words = self.hashes(seed) if seed else self.hash
        out = np.zeros(len(words), dtype=np.uint64)
        if len(words) >= n:
            # Horner's rule by doubling: the hash of 2k words from two of k words
            have, size, left, done = words, 1, n, None
            while left:
                if left & 1:
                    if done is None:
                        done, length = have, size
                    else:
                        # words [0, size) then [size, size + length)
                        m = len(words) - size - length + 1
                        done, length = mix(have[:m] * U(pow(_Q, length, 1 << 64)) + done[size : size + m]), size + length
                left >>= 1
                if left:
                    have, size = mix(have[: len(have) - size] * U(pow(_Q, size, 1 << 64)) + have[size:]), size * 2
            out[: len(done)] = mix(done)
        return out
