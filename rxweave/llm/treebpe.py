"""Byte-level BPE by tree concatenation: halves encoded in parallel, joined exactly.

A text is cut by the tokenizer's own pattern; merges never cross its parts. A
long part, one that nothing splits, is halved down to leaves. Leaves are encoded
each by itself, and encodings are joined pair by pair up the tree.

At a join the bytes of a few tokens on either side are encoded again. If the
result begins with the token that the window began with, and ends with the one
it ended with, it takes the window's place; else the window grows, at last to
both sides in whole. That is exact: merges have an order, so a sequence of
tokens is the encoding of its bytes if and only if every two neighbours are the
encoding of theirs. Neighbours inside a side or inside the window come from an
encoding, and the agreeing end tokens make the two pairs at the window's edges
pairs of the side they lie in.

Leaves of parts beyond ``SPREAD`` bytes are rows of their own, dealt over all
tasks, so that one huge part does not keep a single task busy; their tokens meet
again in a group that holds one text's tokens.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rxweave.llm.bpe import MAPPED, byte_characters
from rxweave.llm.common import field, pieces, quoted, sha256_hex
from rxweave.llm.parts import NOT_LATIN, REMEMBERED, PartIds, gathered, latin_pattern
from rxweave.session import cut_lineage

#: Parts of more bytes than this are halved until no piece is longer.
LEAF = 8

#: Parts of more bytes than this are encoded by many tasks, in leaves of at most so many bytes.
SPREAD = 1 << 18
SPREAD_LEAF = 1 << 15

#: Tokens on either side that are encoded again at first.
WINDOW = 2


def mapped(part: str) -> str:
    """A part's bytes as the printable characters that stand for them."""
    return part.encode().decode("latin-1").translate(MAPPED)


class TreeCoder:
    """Encodes and decodes as the tokenizers library does with a byte-level BPE file.

    The merges of a piece are the library's. Special tokens found in a text are
    tokens, as by default there; a file whose added tokens strip spaces, stand
    for single words or are normalised, or that normalises text, is refused.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as rules:
            rules = json.load(rules)
        cutter, added = rules["pre_tokenizer"], rules["added_tokens"]
        plain = not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added)
        if not plain or rules["normalizer"] or cutter["type"] != "ByteLevel" or cutter["add_prefix_space"] or not cutter["use_regex"] or rules["model"].get("ignore_merges"):
            raise ValueError("only byte-level BPE without normalisation and with plain added tokens")
        self.special = {t["content"]: t["id"] for t in added}
        self.cut_special = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")").split if added else lambda t: [t]
        self.latin = latin_pattern(public_tokenizers.PATTERN).findall
        vocab = self.tokenizer.get_vocab()
        self.size = max(vocab.values()) + 1
        back = {c: b for b, c in enumerate(byte_characters())}
        self.tokens = [""] * self.size  # in mapped characters
        for token, i in vocab.items():
            self.tokens[i] = token
        special = set(self.special.values())
        data = [t.encode() if i in special else bytes(back[c] for c in t) for i, t in enumerate(self.tokens)]
        self.join_bytes, self.decimals = gathered(data), gathered([b",%d" % i for i in range(self.size)])
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.leaf_ids: dict[str, list[int]] = {}
        self.of_mapped = PartIds(self.whole, self.kind.str)
        self.of_raw = PartIds(lambda parts: self.whole([mapped(p) for p in parts]), self.kind.str)

    def merged(self, mapped: str) -> list[int]:
        """The library's ids of one piece, by its merges alone."""
        return [t.id for t in self.tokenizer.model.tokenize(mapped)]

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two encoded neighbours' bytes."""
        k = WINDOW
        while True:
            a, b = max(len(left) - k, 0), min(k, len(right))
            window = self.merged("".join(self.tokens[i] for i in left[a:] + right[:b]))
            if (not a or window[0] == left[a]) and (b == len(right) or window[-1] == right[b - 1]):
                return left[:a] + window + right[b:]
            k *= 2

    def tree(self, encoded: list[list[int]]) -> list[int]:
        """The encoding of neighbouring pieces, joined pair by pair; none for none."""
        while len(encoded) > 1:
            encoded = [self.joined(*encoded[i:i + 2]) if i + 1 < len(encoded) else encoded[i] for i in range(0, len(encoded), 2)]
        return encoded[0] if encoded else []

    def leaves(self, mapped: str, most: int) -> list[str]:
        """Halves of halves down to at most so many bytes, in order."""
        count = 1
        while -(-len(mapped) // count) > most:
            count *= 2
        edges = [len(mapped) * i // count for i in range(count + 1)]
        return [mapped[a:b] for a, b in zip(edges, edges[1:])]

    def whole(self, parts: list[str]) -> list[list[int]]:
        """The ids of parts of any length, in mapped characters."""
        cut = [self.leaves(p, LEAF) for p in parts]
        if len(self.leaf_ids) > REMEMBERED:
            self.leaf_ids = {}
        for leaf in chain.from_iterable(cut):
            if leaf not in self.leaf_ids:
                self.leaf_ids[leaf] = self.merged(leaf)
        return [self.tree([self.leaf_ids[x] for x in leaves]) for leaves in cut]

    def sections(self, text: str) -> Iterator[tuple[PartIds | None, list]]:
        """The text's sections in order: parts and what encodes them, or the ids of special tokens."""
        for i, section in enumerate(self.cut_special(text)):
            if i % 2:
                yield None, [self.special[section]]
            elif NOT_LATIN(section):
                yield self.of_mapped, [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(section)]
            else:
                yield self.of_raw, self.latin(section)

    def encode(self, texts: list[str], spread: int | None = None) -> list[list]:
        """Packed ids of each text, as a list of one; with ``spread``, parts of more bytes come as mapped text between the ids."""
        cut = [list(self.sections(t)) for t in texts]
        size = {self.of_raw: lambda p: len(p.encode()), self.of_mapped: len}
        huge: set[int] = set()  # of texts that may hold such a part
        if spread is not None:
            huge = {i for i, t in enumerate(texts) if 4 * len(t) > spread and any(coder and size[coder](p) > spread for coder, parts in cut[i] for p in parts)}
        known = {coder: coder.of({p for i, row in enumerate(cut) for c, parts in row if c is coder for p in parts if i not in huge or size[coder](p) <= spread}) for coder in size}
        out = []
        for i, row in enumerate(cut):
            done, held = [], []
            for coder, parts in row:
                if coder is None:
                    held += [self.kind.type(x).tobytes() for x in parts]
                elif i not in huge:
                    held += map(known[coder].__getitem__, parts)
                else:
                    for p in parts:
                        if size[coder](p) > spread:
                            done += [b"".join(held), p if coder is self.of_mapped else mapped(p)]
                            held = []
                        else:
                            held.append(known[coder][p])
            done.append(b"".join(held))
            out.append(done)
        return out

    def ids(self, packed: bytes) -> np.ndarray:
        return np.frombuffer(packed, self.kind)

    def decode(self, ids: np.ndarray) -> str:
        """The text of some ids; bytes that are no UTF-8 become replacement characters, unknown ids nothing."""
        ids = np.asarray(ids, np.int64)
        return self.join_bytes(ids[(ids >= 0) & (ids < self.size)]).decode("utf-8", "replace")


def _encoder(path: str, spread: int, leaf: int, schema: pa.Schema):
    """Rows of (doc_id, row, text) to rows of a whole text's ids (seq 0), or of the pieces of a text with a huge part.

    Pieces are numbered: at even places of the text's list are ids, at odd ones
    the leaves of a part. ``leaf`` counts those, -1 marks ids.
    """
    def run(batches):
        coder = TreeCoder(path)
        for batch in batches:
            for piece in pieces(batch, 2):
                found = []
                for i, row in enumerate(coder.encode([t or "" for t in piece.column(2).to_pylist()], spread)):
                    if len(row) == 1:
                        found.append((i, 0, -1, True, row[0]))
                        continue
                    for seq, part in enumerate(row):
                        if seq % 2:
                            found += [(i, seq, n, False, x.encode()) for n, x in enumerate(coder.leaves(part, leaf))]
                        elif part:
                            found.append((i, seq, -1, False, part))
                which = pa.array([f[0] for f in found], pa.int64())
                rest = [pa.array([f[k] for f in found], schema.field(k + 1).type) for k in range(1, 5)]
                yield pa.RecordBatch.from_arrays([piece.column(0).take(which), piece.column(1).take(which), *rest], schema=schema)

    return run


def _leaf_encoder(path: str):
    def run(batches):
        coder = TreeCoder(path)
        for batch in batches:
            data = [d if n < 0 else np.array(coder.whole([d.decode()])[0], coder.kind).tobytes()
                    for n, d in zip(batch.column("leaf").to_pylist(), batch.column("data").to_pylist())]
            yield batch.set_column(batch.schema.get_field_index("data"), "data", pa.array(data, pa.binary()))

    return run


def _tree_joiner(path: str, schema: pa.Schema):
    """All pieces of one text to the text's ids."""
    def run(table: pa.Table) -> pa.Table:
        coder = TreeCoder(path)
        table = table.sort_by([("seq", "ascending"), ("leaf", "ascending")])
        out, seq, leaf, data = [], *(table.column(c).to_pylist() for c in ("seq", "leaf", "data"))
        i = 0
        while i < len(seq):
            j = i + 1
            while j < len(seq) and seq[j] == seq[i]:
                j += 1
            out.append(data[i] if leaf[i] < 0 else np.array(coder.tree([coder.ids(d).tolist() for d in data[i:j]]), coder.kind).tobytes())
            i = j
        return pa.Table.from_arrays([table.column("doc_id").slice(0, 1), pa.chunked_array([pa.array([b"".join(out)], pa.binary())])], schema=schema)

    return run


def encoded_documents(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", spread: int = SPREAD, leaf: int = SPREAD_LEAF) -> DataFrame:
    """Per row of ``docs``: ``doc_id`` and ``ids``, packed little-endian unsigned integers of 2 bytes, or 4 if the vocabulary needs them.

    Null counts as empty: no ids. Repeated rows and ids give a row each, an
    empty table none; other columns are ignored, whatever their names. ``path``
    is read on every executor. One scan; only the pieces of texts with a part of
    more than ``spread`` bytes are shuffled, in the end to one text a group.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = docs.select(F.col(quoted(doc_id)).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(quoted(text)).cast("string").alias("text"))
    schema = T.StructType([rows.schema["doc_id"], field("row", "long"), field("seq", "int"), field("leaf", "int"), field("whole", "boolean"), field("data", "binary")])
    first = cut_lineage(docs.sparkSession, rows.mapInArrow(_encoder(path, spread, leaf, to_arrow_schema(schema)), schema), "encoded")
    result = T.StructType([rows.schema["doc_id"], field("ids", "binary")])
    split = first.where("NOT whole").repartition("row", "seq", "leaf").mapInArrow(_leaf_encoder(path), first.schema)
    joined = split.groupBy("row").applyInArrow(_tree_joiner(path, to_arrow_schema(result)), result)
    return first.where("whole").select("doc_id", F.col("data").alias("ids")).unionByName(joined)


def decoded_documents(encoded: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), ids: str = "ids") -> DataFrame:
    """The ``keep`` columns and ``text`` from packed ids; null for null."""
    def decode(coder, packed):
        return [None if p is None else coder.decode(coder.ids(p)) for p in packed]

    return _mapped(encoded, path, keep, ids, [field("text", "string")], lambda coder, packed: [decode(coder, packed)])


def digests(encoded: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), ids: str = "ids") -> DataFrame:
    """The ``keep`` columns, ``n_tokens``, and digests of the decimal ids and of the text decoded from them."""
    def compute(coder, packed):
        rows = [coder.ids(p or b"") for p in packed]
        return [[len(r) for r in rows], [sha256_hex(coder.decimals(r)[1:]) for r in rows], [sha256_hex(coder.decode(r)) for r in rows]]

    return _mapped(encoded, path, keep, ids, [field("n_tokens", "long"), field("ids_sha256", "string"), field("decoded_sha256", "string")], compute)


def _mapped(encoded: DataFrame, path: str, keep, ids: str, fields: list, compute) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    chosen = encoded.select(*[F.col(quoted(c)) for c in keep], F.col(quoted(ids)).alias("__ids"))
    schema = T.StructType([*chosen.schema.fields[:-1], *fields])
    arrow, at = to_arrow_schema(schema), len(keep)

    def run(batches):
        coder = TreeCoder(path)
        for batch in batches:
            for piece in pieces(batch, at):
                columns = compute(coder, piece.column(at).to_pylist())
                arrays = [piece.column(i).cast(arrow.field(i).type) for i in range(at)] + [pa.array(c, type=arrow.field(at + i).type) for i, c in enumerate(columns)]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return chosen.mapInArrow(run, schema)
