"""Token ids in flat binary files, with 64-bit offsets, memory-mapped for reading.

Documents are range-partitioned by id and sorted; each partition writes one
shard: ``.bin``, its ids as flat unsigned integers (16 bits where the vocabulary
fits, else 32), and ``.idx``, the number of documents and, as 64-bit integers,
their ids, whether an id is null, and the end offset of each. The manifest has
one row per shard; prefix sums over it give each shard the number of ids before
it. A task that is run again writes shards of other names; only those named in
the manifest count.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rxweave.llm.bpe import MAPPED
from rxweave.llm.common import pieces, quoted
from rxweave.llm.parts import NOT_LATIN, PartIds, latin_pattern
from rxweave.session import cut_lineage, shared_folder

MANIFEST = "shard int, name string, n_docs long, n_ids long, width int"


class WordCoder:
    """Encodes texts with a tokenizers file of lower-case words.

    Such a file normalises text, cuts it into words by its pattern, dropping
    white space, and merges each word by itself. The merges are the library's;
    equal words are merged once. Latin text is cut here by the file's pattern,
    with lower case as the one normalisation it needs; any other text, or one
    with a special token's string, goes through the library's steps in whole.
    """

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as rules:
            pattern = json.load(rules)["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.latin = latin_pattern(pattern).findall
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        size = max(self.tokenizer.get_vocab_size(), end_id + 1)
        tokenize = self.tokenizer.model.tokenize
        self.words = PartIds(lambda words: [[t.id for t in tokenize(w.encode().decode("latin-1").translate(MAPPED))] for w in words], "<u2" if size <= 1 << 16 else "<u4")

    def encode(self, texts: list[str]) -> list[bytes]:
        """The packed ids of each whole text."""
        whole = {i for i, t in enumerate(texts) if NOT_LATIN(t) or any(s in t for s in self.special)}
        out = self.words.joined([[] if i in whole else self.latin(t.lower()) for i, t in enumerate(texts)])
        for i in whole:
            out[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, self.words.kind).tobytes()
        return out


def open_files(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def write_tokens(docs: DataFrame, path: str, end_id: int, folder: str | None = None, doc_id: str = "doc_id", text: str = "text",
                 shards: int | None = None) -> tuple[str, DataFrame]:
    """Encodes, writes the shards below ``folder`` (default: in the shared folder) and returns it and the manifest.

    Order: doc_id, null first, then a hash of the text, then the text, so that
    the rows of one repeated id may still lie in several shards. Null texts are
    empty: their end id alone is written. An empty table has an empty manifest.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "tokens")
    rows = docs.select(F.col(quoted(doc_id)).cast("long").alias("doc_id"), F.coalesce(F.col(quoted(text)).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    spread = rows.repartitionByRange(shards, "doc_id", "tie") if shards else rows.repartitionByRange("doc_id", "tie")
    ordered = spread.sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    manifest = cut_lineage(spark, ordered.mapInArrow(_writer(path, end_id, folder), MANIFEST), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    return folder, manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def _writer(path: str, end_id: int, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = WordCoder(path, end_id)
        width, end = coder.words.kind.itemsize, np.array([end_id], coder.words.kind).tobytes()
        files, top = open_files(folder)
        files.create_dir(top, recursive=True)
        shard = TaskContext.get().partitionId()
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}"
        keys, ends, n_ids = [], [], 0
        with files.open_output_stream(f"{top}/{name}.bin") as out:
            for piece in (p for batch in batches for p in pieces(batch, 1)):
                keys.extend(piece.column(0).to_pylist())
                for ids in coder.encode(piece.column(1).to_pylist()):
                    n_ids += len(ids) // width + 1
                    ends.append(n_ids)
                    out.write(ids + end)
        index = [len(keys), *(k or 0 for k in keys), *(int(k is None) for k in keys), *ends]
        with files.open_output_stream(f"{top}/{name}.idx") as out:
            out.write(np.array(index, "<i8").tobytes())
        if keys:
            columns = [[shard], [name], [len(keys)], [n_ids], [width]]
            types = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["shard", "name", "n_docs", "n_ids", "width"])

    return run


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, ``start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32`` over 32-bit little-endian ids.

    One task per shard: a partition number that is given is not merged, however small the manifest.
    """
    shards = manifest.select("shard", "name", "width", "base").repartitionByRange(max(manifest.count(), 1), "shard").select("name", "width", "base")
    return shards.mapInArrow(_reader(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def mapped(files: fs.FileSystem, path: str, kind: str) -> np.ndarray:
    """A file as an array: memory-mapped where the file system is local to the task, else read."""
    if isinstance(files, fs.LocalFileSystem):
        return np.memmap(path, dtype=kind, mode="r") if os.path.getsize(path) else np.zeros(0, kind)
    with files.open_input_file(path) as f:
        return np.frombuffer(f.readall(), kind)


def _reader(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = open_files(folder)
        for batch in batches:
            for row in batch.to_pylist():
                index = mapped(files, f"{top}/{row['name']}.idx", "<i8")
                n = int(index[0])
                keys, null, ends = np.array(index[1:1 + n]), np.array(index[1 + n:1 + 2 * n], bool), np.array(index[1 + 2 * n:])
                starts = np.concatenate([[0], ends[:-1]])
                ids = mapped(files, f"{top}/{row['name']}.bin", f"<u{row['width']}")
                sums = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(starts, ends)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64(), mask=null), pa.array(starts + row["base"], pa.int64()),
                                                  pa.array(ends - starts, pa.int64()), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def token_files(spark: SparkSession, docs: DataFrame, path: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the token files of ``docs`` and returns what reading them back gives."""
    folder, manifest = write_tokens(docs, path, end_id, doc_id=doc_id, text=text)
    return read_tokens(manifest, folder)
