"""Byte-level BPE with a sentencepiece model written out from a vocabulary of ranks.

The model is put together field by field, not trained: every vocabulary entry is
a piece whose bytes are mapped to printable characters, its score is the
negative rank, and normalisation is the identity, so the library's merges are
those of the ranks. Text is split by the given pattern; every match is encoded
by itself. Decoding maps ids to pieces and pieces to bytes.
"""

from __future__ import annotations

import base64
import struct

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rxweave.llm.common import field, map_texts, quoted, sha256_hex
from rxweave.llm.parts import NOT_LATIN, PartIds, gathered, latin_pattern

def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is one, else one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: per line a token in base 64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _number(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def _block(number: int, value: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialised_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model file: pieces in order of rank, then one for unknown text.

    Field numbers are those of the public model format: pieces 1 (text 1, score
    2, kind 3), training settings 2 (model type 3, size 4), normalisation 3
    (name 1, dummy prefix 3, white space 4 and 5).
    """
    characters = byte_characters()
    ordered = sorted(ranks, key=ranks.get)
    if [ranks[t] for t in ordered] != list(range(len(ordered))):
        raise ValueError("ranks must count from 0 without gaps")
    pieces = [("".join(characters[b] for b in token), -float(rank), 1) for rank, token in enumerate(ordered)]
    pieces.append(("<unk>", 0.0, 2))
    out = [_block(1, _block(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _number(3, kind)) for text, score, kind in pieces]
    out.append(_block(2, _number(3, 2) + _number(4, len(pieces)) + _number(40, len(pieces) - 1)))
    out.append(_block(3, _block(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)))
    return b"".join(out)


class Coder:
    """Encodes and decodes text by a vocabulary of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialised_model(ranks))
        self.latin = latin_pattern(pattern).findall
        #: Unicode white space, as the pattern means it; this library's also has U+001C to U+001F.
        space = r"\p{White_Space}"
        self.split = regex.compile(pattern.replace(r"[^\s", f"[^{space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", space)).findall
        self.whole = {token: (rank,) for token, rank in ranks.items()}
        self.matches = PartIds(self._encode_matches, "<u2" if len(ranks) <= 1 << 16 else "<u4")
        back = {c: b for b, c in enumerate(byte_characters())}
        tokens = [bytes(back[c] for c in self.model.id_to_piece(i)) for i in range(len(ranks))]
        self.decode = gathered(tokens)
        self.decimals = gathered([b" %d" % i for i in range(len(ranks))])

    def _encode_matches(self, matches: list[str]) -> list[tuple]:
        """A match that is a token as a whole is that token; the model merges the bytes of the others."""
        data = [m.encode("utf-8") for m in matches]
        merged = iter(self.model.encode([d.decode("latin-1").translate(MAPPED) for d in data if d not in self.whole], num_threads=1))
        return [self.whole[d] if d in self.whole else next(merged) for d in data]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each whole text."""
        packed = self.matches.joined([(self.split if NOT_LATIN(t) else self.latin)(t) for t in texts])
        return [np.frombuffer(p, self.matches.kind) for p in packed]


MAPPED = dict(enumerate(byte_characters()))

#: Bytes of text split and encoded at once; the lists of matches are many times as large.
TEXT_BYTES = 2 << 20

FIELDS = [field("n_tokens", "long"), field("ids_sha256", "string"), field("decoded_sha256", "string")]


def _coder(path: str, pattern: str) -> Coder:
    return Coder(read_ranks(path), pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its id, ``n_tokens``, and digests of its ids and of the decoded bytes.

    Null counts as empty: no tokens. Repeated rows give one row each, an empty
    table none; other columns are ignored. ``path`` is read on every executor,
    where the vocabulary is installed. One scan, no shuffle.
    """
    def make():
        coder = _coder(path, pattern)

        def digests(texts):
            ids = coder.encode([t or "" for t in texts])
            return [len(x) for x in ids], [sha256_hex(coder.decimals(x)[1:]) for x in ids], [sha256_hex(coder.decode(x)) for x in ids]

        return digests

    return map_texts(docs, [doc_id], text, FIELDS, make, TEXT_BYTES)


def token_ids(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The id of each document and the ids of its tokens."""
    def make():
        coder = _coder(path, pattern)
        return lambda texts: [coder.encode([t or "" for t in texts])]

    return map_texts(docs, [doc_id], text, [field("ids", "longs")], make, TEXT_BYTES)


def decode_tokens(tokens: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """The id of each document and its decoded text; null for null ids."""
    chosen = tokens.select(F.col(quoted(doc_id)), F.col(quoted(ids)).cast("array<long>").alias("ids"))
    schema = T.StructType([chosen.schema.fields[0], field("text", "string")])

    def run(batches):
        coder = _coder(path, pattern)
        for batch in batches:
            texts = [None if x is None else coder.decode(np.array(x, np.int64)).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[doc_id, "text"])

    return chosen.mapInArrow(run, schema)
