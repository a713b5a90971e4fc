"""Fill-in-the-middle texts, cut at line ends found in a compressed set of boundaries.

The line ends of a text are a sorted set of code point offsets, held as a
compressed bitmap is: the offsets that share their upper 16 bits lie in one
container, which is an array of the lower 16 bits, a bitmap, or a list of runs,
whichever is smallest. Cumulative cardinalities of the containers turn "the k-th
line end" into a search for the container and a select inside it. Two selects
give both cuts of a text.

Two unbiased draws per document, from a hash of the seed and the id, name the
lines at which prefix and middle end. A document keeps its result wherever and
however often it is computed.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from rxweave.llm.common import field, map_texts, quoted

SENTINELS = ("<P>", "<S>", "<M>")

#: Offsets of a container, and the words of its bitmap.
SPAN_BITS = 16
WORDS = (1 << SPAN_BITS) // 64


class Array:
    """Sorted lower bits."""

    def __init__(self, low: np.ndarray):
        self.low = low

    def select(self, k: int) -> int:
        return int(self.low[k])


class Bitmap:
    """A bit per offset; the count of bits before each word leads to the word."""

    def __init__(self, low: np.ndarray):
        bits = np.zeros(1 << SPAN_BITS, np.uint8)
        bits[low] = 1
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        self.before = np.cumsum(np.bitwise_count(self.words), dtype=np.int64) - np.bitwise_count(self.words)

    def select(self, k: int) -> int:
        word = int(np.searchsorted(self.before, k, "right")) - 1
        inside = np.flatnonzero(np.unpackbits(self.words[word:word + 1].view(np.uint8), bitorder="little"))
        return word * 64 + int(inside[k - self.before[word]])


class Runs:
    """First offsets of runs of neighbours and how many offsets lie before each."""

    def __init__(self, low: np.ndarray, first: np.ndarray):
        self.start, self.before = low[first], first

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.before, k, "right")) - 1
        return int(self.start[run]) + k - int(self.before[run])


def container(low: np.ndarray) -> Array | Bitmap | Runs:
    """The smallest form of some sorted lower bits: 2 bytes an offset, 8 KB, or 4 bytes a run."""
    first = np.flatnonzero(np.diff(low, prepend=low[0] - 2) != 1)
    sizes = {Array: 2 * len(low), Bitmap: 8 * WORDS, Runs: 4 * len(first)}
    kind = min(sizes, key=sizes.get)
    return Runs(low, first) if kind is Runs else kind(low)


class BoundarySet:
    """A set of offsets, given in ascending order without repeats."""

    def __init__(self, offsets: np.ndarray):
        self.high, first, count = np.unique(offsets >> SPAN_BITS, return_index=True, return_counts=True)
        self.before = np.concatenate([[0], np.cumsum(count)])
        low = (offsets & ((1 << SPAN_BITS) - 1)).astype(np.int32)
        self.containers = [container(low[a:a + n]) for a, n in zip(first, count)]

    def __len__(self) -> int:
        return int(self.before[-1])

    def select(self, k: int) -> int:
        """The k-th offset, counted from 0."""
        at = int(np.searchsorted(self.before, k, "right")) - 1
        return (int(self.high[at]) << SPAN_BITS) + self.containers[at].select(k - int(self.before[at]))

    def cuts(self, first: int, second: int) -> tuple[int, int]:
        """The offsets after so many units each; 0 units end at 0."""
        a, b = (self.select(k - 1) if k else 0 for k in (first, second))
        return a, b


def line_ends(text: str) -> np.ndarray:
    """Offsets after every line of a text, in code points; a last line needs no line feed."""
    data = np.frombuffer(text.encode(), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le"), "<u4")
    ends = np.flatnonzero(data == 10) + 1
    return ends if not len(data) or data[-1] == 10 else np.append(ends, len(data))


def draws(seed: int, doc_id) -> list[int]:
    """Four unsigned 32-bit numbers for a document; a null id is written as no digits."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i:i + 8], 16) for i in range(0, 32, 8)]


def transformed(text: str, draw: list[int], fim_percent: int, spm_percent: int, sentinels=SENTINELS) -> tuple:
    """Number of lines, form, code points of prefix and middle, and the new text."""
    ends = line_ends(text)
    n = len(ends)
    if not text or any(s in text for s in sentinels) or draw[2] % 100 >= fim_percent:
        return n, "plain", None, None, text
    a, b = BoundarySet(ends).cuts(*sorted((draw[0] % (n + 1), draw[1] % (n + 1))))
    before, middle, after = text[:a], text[a:b], text[b:]
    p, s, m = sentinels
    if draw[3] % 100 < spm_percent:
        return n, "spm", a, b - a, f"{s}{after}{p}{before}{m}{middle}"
    return n, "psm", a, b - a, f"{p}{before}{s}{after}{m}{middle}"


def restored(output: str, form: str, sentinels=SENTINELS) -> str:
    """The original text of a transformed one."""
    p, s, m = sentinels
    if form == "plain":
        return output
    first, second = (p, s) if form == "psm" else (s, p)
    one, _, rest = output.removeprefix(first).partition(second)
    two, _, middle = rest.partition(m)
    return one + middle + two if form == "psm" else two + middle + one


FIELDS = [field("n", "long"), field("form", "string"), field("prefix_chars", "long"), field("middle_chars", "long"), field("output", "string")]


def fill_in_middle(docs: DataFrame, seed: int = 7, fim_percent: int = 100, spm_percent: int = 50, sentinels=SENTINELS,
                   doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n`` (lines), ``form`` (plain, psm or spm), ``prefix_chars``, ``middle_chars`` and ``output``.

    Null counts as empty. Empty texts, texts that hold a sentinel, and those
    beyond ``fim_percent`` stay plain, with null lengths. Rows of one id draw
    the same numbers, so equal rows give equal results; a null id draws those
    of an empty number. An empty table gives none; other columns are ignored,
    whatever their names. One scan, no shuffle; a text is held in whole.
    """
    chosen = docs.selectExpr(f"{quoted(doc_id)} AS doc_id", f"{quoted(text)} AS text", f"CAST({quoted(doc_id)} AS STRING) AS digits")
    # ids travel beside their texts, behind a fixed-width number of digits
    packed = chosen.selectExpr("doc_id", "concat(lpad(coalesce(length(digits), 0), 4, '0'), coalesce(digits, ''), coalesce(text, '')) AS text")

    def make():
        def compute(texts):
            rows = []
            for held in texts:
                size = 4 + int(held[:4])
                rows.append(transformed(held[size:], draws(seed, held[4:size]), fim_percent, spm_percent, sentinels))
            return list(zip(*rows)) if rows else [[] for _ in FIELDS]

        return compute

    return map_texts(packed, ["doc_id"], "text", FIELDS, make)


def restored_texts(outputs: DataFrame, sentinels=SENTINELS, keep: tuple[str, ...] = ("doc_id", "form"), output: str = "output") -> DataFrame:
    """The ``keep`` columns, among them the form, and the text rebuilt from each output; null outputs count as empty."""
    names = [*keep]
    packed = outputs.selectExpr(*[quoted(c) for c in names], f"concat(rpad(coalesce(form, 'plain'), 5, ' '), coalesce({quoted(output)}, '')) AS __held")

    def make():
        return lambda held: [[restored(x[5:], x[:5].strip(), sentinels) for x in held]]

    return map_texts(packed, names, "__held", [field("restored", "string")], make)
