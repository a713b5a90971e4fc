"""64-bit hashes of the words of many texts, as array operations.

Words are those of ASCII-lower-cased text between ASCII characters that are no
letter or digit. A hash is the sum over a word's bytes of a random number for
the byte times one for its place, mixed with the length.
"""

from __future__ import annotations

import numpy as np

from rxweave.llm.decontamination import TABLE

_RANDOM = np.random.Generator(np.random.PCG64(20240229))
BYTE = _RANDOM.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
PLACE = _RANDOM.integers(0, 1 << 63, 1024, np.uint64) * np.uint64(2) + np.uint64(1)
FAR_PLACE = np.concatenate([[np.uint64(1)], _RANDOM.integers(0, 1 << 63, 1023, np.uint64) * np.uint64(2) + np.uint64(1)])


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every input bit moves about half of the output bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Words:
    """The words of some texts in order: ``hash``, ``document`` (number of the text) and ``size`` in bytes.

    ``prefix(n)`` gives hashes of the first n bytes of each word.
    """

    def __init__(self, texts: list[str | None]):
        data = [t.encode("utf-8").translate(TABLE) if t else b"" for t in texts]
        # a space before every text, so that no word reaches over two texts
        flat = np.frombuffer(b" " + b" ".join(data) + b" ", np.uint8)
        inside = flat != 32
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        starts, ends = edge[::2], edge[1::2]
        self.size = ends - starts
        self.document = np.searchsorted(np.cumsum([1 + len(d) for d in data]), starts)
        self.at = np.cumsum(self.size) - self.size
        place = np.arange(self.size.sum()) - np.repeat(self.at, self.size)
        self.value = BYTE[flat[inside]] * PLACE[place & 1023]
        if len(self.size) and self.size.max() > 1024:
            self.value = self.value * FAR_PLACE[(place >> 10) & 1023]
        self.place = place
        self.hash = self._summed(self.value, self.size)

    def _summed(self, value: np.ndarray, size: np.ndarray) -> np.ndarray:
        if not len(self.size):
            return np.zeros(0, np.uint64)
        return mixed(np.add.reduceat(value, self.at) + size.astype(np.uint64))

    def prefix(self, n: int) -> np.ndarray:
        return self._summed(np.where(self.place < n, self.value, np.uint64(0)), np.minimum(self.size, n))
