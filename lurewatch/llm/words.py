"""Words of many texts at once, as arrays: where they lie, and 64-bit hashes of them and of their windows."""

from __future__ import annotations

import hashlib

import numpy as np

#: Bytes hashed at a time.
SLICE = 1 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Spread every bit of 64-bit numbers over all others."""
    x = x + _U((salt * 2 + 1) * _BASE % (1 << 64))
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTES = mixed(np.arange(256, dtype=_U), 7)
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[0] = 1
    return np.multiply.accumulate(out)


class Words:
    """The words of a list of texts (UTF-8 bytes): ``text`` (its number), ``start``, ``end`` and ``hash`` of each."""

    def __init__(self, texts: list[bytes]):
        self.buffer = b" ".join(texts) + b" "
        raw = np.frombuffer(self.buffer, np.uint8)
        edges = np.flatnonzero(np.diff(_SPACES[raw].astype(np.int8), prepend=1))
        self.start, self.end = edges[0::2], edges[1::2]
        firsts = np.cumsum([0] + [len(t) + 1 for t in texts])[:-1]
        self.text = np.searchsorted(firsts, self.start, side="right") - 1
        self.cuts = np.searchsorted(self.text, np.arange(len(texts) + 1))
        self.hash = self._hashes(raw)

    def _hashes(self, raw: np.ndarray) -> np.ndarray:
        out, n, i = np.empty(len(self.start), _U), len(self.start), 0
        powers, inverse = _powers(_BASE, 2 * SLICE), _powers(_INVERSE, 2 * SLICE)
        while i < n:
            first = self.start[i]
            j = int(np.searchsorted(self.end, first + 2 * SLICE, side="right"))
            if j == i:  # one word longer than two slices
                digest = hashlib.blake2b(raw[first:self.end[i]].tobytes(), digest_size=8).digest()
                out[i], i = int.from_bytes(digest, "little"), i + 1
                continue
            j = min(j, i + SLICE)
            last = self.end[j - 1]
            values = _BYTES[raw[first:last]] * powers[:last - first]
            values[_SPACES[raw[first:last]]] = 0
            starts = self.start[i:j] - first
            out[i:j] = np.add.reduceat(values, starts) * inverse[starts] + (self.end[i:j] - self.start[i:j]).astype(_U)
            i = j
        return mixed(out)

    def windows(self, length: int, salt: int = 0) -> np.ndarray:
        """Hash of the ``length`` words from each position on (windows that leave a text included)."""
        n = max(0, len(self.hash) - length + 1)
        value = mixed(self.hash, salt) if salt else self.hash
        out = np.zeros(n, _U)
        for j in range(length):
            out = out * _U(_BASE) + value[j:n + j]
        return mixed(out, salt)

    def inside(self, length: int) -> np.ndarray:
        """Whether the window from each position on lies in one text."""
        n = max(0, len(self.text) - length + 1)
        return self.text[:n] == self.text[length - 1:]

    def kept(self, number: int, covered: np.ndarray) -> bytes:
        """The words of a text that are not covered, joined by one space."""
        at = np.flatnonzero(~covered[self.cuts[number]:self.cuts[number + 1]]) + self.cuts[number]
        return b" ".join([self.buffer[a:b] for a, b in zip(self.start[at].tolist(), self.end[at].tolist())])
