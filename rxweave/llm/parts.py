"""Ids of text parts: equal parts of many texts are encoded once, with bounded memory."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable
from itertools import chain

import numpy as np

#: Parts that a task remembers; its memory is emptied when full.
REMEMBERED = 1 << 19

#: Longer parts are not remembered.
REMEMBERED_LENGTH = 64

#: Code points below this, Latin letters with their marks, are split with plain character classes.
LATIN_END = 0x180

#: Whether a text has a character outside of that range, or the capital whose lower case is outside.
NOT_LATIN = re.compile(f"[^\x00-{chr(LATIN_END - 1)}]|İ").search


def latin_class(kind: str) -> str:
    """The Latin characters whose general category starts with ``kind``, for a character class."""
    return "".join(re.escape(chr(c)) for c in range(LATIN_END) if unicodedata.category(chr(c)).startswith(kind))


def latin_pattern(pattern: str) -> re.Pattern:
    r"""A pattern of \p{L}, \p{N} and \s for the standard library, right for Latin text."""
    letters, numbers, spaces = latin_class("L"), latin_class("N"), "\t\n\x0b\x0c\r \x85\xa0"
    pattern = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{spaces}{letters}{numbers}]")
    for name, members in (("[\\p{L}]", letters), ("[\\p{N}]", numbers), ("\\p{L}", letters), ("\\p{N}", numbers), ("\\s", spaces)):
        pattern = pattern.replace(name, f"[{members}]")
    return re.compile(pattern.replace(r"\S", f"[^{spaces}]"))


class PartIds:
    """Packed ids of parts, from ``encode`` (a list of parts to their ids) or from memory."""

    def __init__(self, encode: Callable[[list[str]], Iterable], kind: str):
        self.encode, self.kind = encode, np.dtype(kind)
        self.known: dict[str, bytes] = {}

    def of(self, parts: set[str]) -> dict[str, bytes]:
        """A dictionary with the packed ids of at least the given parts."""
        new = [p for p in parts if p not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known, new = {}, list(parts)
        ids = list(self.encode(new))
        sizes = np.cumsum([0, *map(len, ids)]) * self.kind.itemsize
        packed = np.fromiter(chain.from_iterable(ids), self.kind).tobytes()
        coded = {p: packed[a:b] for p, a, b in zip(new, sizes.tolist(), sizes[1:].tolist())}
        if len(coded) <= REMEMBERED and max(map(len, new), default=0) <= REMEMBERED_LENGTH:
            self.known.update(coded)
            return self.known
        return self.known | coded

    def joined(self, texts: list[list[str]]) -> list[bytes]:
        """The packed ids of each text given as its parts."""
        ids = self.of(set(chain.from_iterable(texts)))
        return [b"".join(map(ids.__getitem__, parts)) for parts in texts]


def gathered(table: list[bytes]) -> Callable[[np.ndarray], bytes]:
    """A function that joins the table's entries at the given numbers."""
    sizes = np.array([len(x) for x in table], np.int64)
    starts, data = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(table), np.uint8)

    def join(ids: np.ndarray) -> bytes:
        n = sizes[ids]
        ends = np.cumsum(n)
        return data[np.repeat(starts[ids] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)].tobytes()

    return join
