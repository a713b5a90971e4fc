"""Benchmark decontamination with one Aho-Corasick automaton.

The windows of all benchmark items (13 consecutive words, or the whole item
where it is shorter) are patterns of one automaton over normalised text: ASCII
lower case, words joined by single spaces. Each document is normalised by a
byte table that keeps its length and scanned once; the end of a match leads to
its last word, and word positions lead back to offsets of the original text.

The benchmark is shipped to the tasks in blocks of a bounded size. A usual
benchmark is one block; a larger one takes a pass per block, and the words and
items hit so far travel with the document, so the answer is the same.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rxweave.llm.common import field, pieces, quoted, sha256_hex

WINDOW = 13

#: Bytes of benchmark text in one automaton; more text takes more passes.
BLOCK_BYTES = 8 << 20

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

#: Bytes: A-Z to lower case, other ASCII that is no word character to a space.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

FIELDS = [field("n_words", "long"), field("n_hit", "long"), field("n_items", "long"), field("items_sha256", "string"),
          field("contaminated", "boolean"), field("spans", "string")]


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8").translate(TABLE).split() if text else []


def build_automaton(items: list[tuple]) -> ahocorasick.Automaton | None:
    """Patterns with their number of words and the ids of the items that hold them."""
    holders: dict[str, set] = defaultdict(set)
    lengths: dict[str, int] = {}
    for item_id, text in items:
        words = words_of(text)
        size = min(WINDOW, len(words))
        for i in range(len(words) - size + 1) if size else ():
            key = (b" " + b" ".join(words[i:i + size]) + b" ").decode("latin-1")
            holders[key].update([item_id] if item_id is not None else [])
            lengths[key] = size
    if not lengths:
        return None
    automaton = ahocorasick.Automaton()
    for key, size in lengths.items():
        automaton.add_word(key, (size, tuple(holders[key])))
    automaton.make_automaton()
    return automaton


def scan(automaton, words: list[bytes], hit: np.ndarray, found: set) -> None:
    """Marks the words inside matches and adds the items found."""
    if automaton is None or not words:
        return
    ends, sizes = [], []
    for end, (size, items) in automaton.iter((b" " + b" ".join(words) + b" ").decode("latin-1")):
        ends.append(end)
        sizes.append(size)
        found.update(items)
    if ends:
        after = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        last = np.searchsorted(after, np.array(ends)) + 1
        step = np.zeros(len(words) + 1, np.int64)
        np.add.at(step, last - np.array(sizes), 1)
        np.add.at(step, last, -1)
        hit |= np.cumsum(step[:-1]) > 0


def spans_of(text: str, hit: np.ndarray) -> str:
    """Maximal runs of hit words as start:end in code points of the original text."""
    if not hit.any():
        return ""
    at = [m.span() for m in WORD.finditer(text.translate(UPPER))]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    return ",".join(f"{at[a][0]}:{at[b - 1][1]}" for a, b in edge.reshape(-1, 2))


def _finished(text: str | None, n_words: int, hit: np.ndarray, found: set) -> tuple:
    n_hit = int(hit.sum())
    items = ",".join(sorted(map(str, found)))
    return n_words, n_hit, len(found), sha256_hex(items), n_hit > 0 and 20 * n_hit >= n_words, spans_of(text or "", hit)


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int) -> tuple[DataFrame, int]:
    items = benchmark.select(F.col(quoted(item_id)).alias("item_id"), F.col(quoted(text)).cast("string").alias("text")).where("text IS NOT NULL").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    return items, max(1, math.ceil(total / block_bytes))


def scan_documents(docs: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text", item_id: str = "item_id", item_text: str = "text",
                   block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The ``keep`` columns of each document and its FIELDS.

    Null texts have no words; an item without words has no window; rows of the
    same item id count as one item and an item without id marks words only.
    """
    items, n_blocks = _blocks(benchmark, item_id, item_text, block_bytes)
    spark = docs.sparkSession
    names = [f"__k{i}" for i in range(len(keep))]
    frame = docs.select(*[F.col(quoted(c)).alias(n) for c, n in zip(keep, names)], F.col(quoted(text)).cast("string").alias("__text"),
                        F.lit(None).cast("binary").alias("__hit"), F.lit(None).cast("array<string>").alias("__found"))
    at = len(keep)
    for block in range(n_blocks):
        part = items if n_blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == block)
        shipped = spark.sparkContext.broadcast([(None if r[0] is None else str(r[0]), r[1]) for r in part.collect()])
        last = block == n_blocks - 1
        schema = T.StructType([*frame.schema.fields[:at], *FIELDS]) if last else frame.schema
        frame = frame.mapInArrow(_pass(shipped, at, to_arrow_schema(schema), last), schema)
    return frame.withColumnsRenamed(dict(zip(names, keep)))


def _pass(shipped, at: int, arrow: pa.Schema, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = build_automaton(shipped.value)
        for batch in batches:
            for piece in pieces(batch, at):
                out = []
                for text, bits, before in zip(*(piece.column(at + i).to_pylist() for i in range(3))):
                    words, found = words_of(text), set(before or ())
                    hit = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(words)).astype(bool) if bits else np.zeros(len(words), bool)
                    scan(automaton, words, hit, found)
                    out.append(_finished(text, len(words), hit, found) if last else (text, np.packbits(hit).tobytes(), sorted(found)))
                columns = zip(*out) if out else [[] for _ in range(len(arrow) - at)]
                arrays = [piece.column(i).cast(arrow.field(i).type) for i in range(at)]
                yield pa.RecordBatch.from_arrays(arrays + [pa.array(c, type=arrow.field(at + i).type) for i, c in enumerate(columns)], schema=arrow)

    return run


def keep_clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents that are not contaminated, with all their columns; no shuffle."""
    packed = docs.select(F.struct("*").alias("row"), F.col(quoted(text)).alias("text"))
    return scan_documents(packed, benchmark, ["row"]).where("NOT contaminated").select("row.*")
