"""Repeated 100-byte strings by a depth-limited radix sort of suffixes.

Suffixes are ordered by their first 100 bytes only, digit by digit from the most
significant one; groups of equal digits are split by the next digit, a group of
one leaves at once, and the groups left after the last digit are exactly the
repeated strings. Digits are chosen so that little is shuffled:

1. The first digit of a suffix is its minimiser, the least of the 32-byte grams
   within its 100 bytes. It depends on those bytes only, so equal suffixes have
   equal minimisers, and neighbouring suffixes share one: a run of suffixes is
   one record, some 35 bytes of text apart from the next.
2. The second digit is the run as a whole: all bytes of its suffixes. Runs equal
   in both digits are equal suffix by suffix, so all but the first are repeats.
3. Where one minimiser has several different runs, the first of each kind is
   taken apart: its bytes, some 135, go to where those of the same minimiser go,
   and its suffixes are grouped by their full 100 bytes.

Digits are compared by hashes: 64 bits of the minimiser to group, with 64 more
of the run, and 128 bits in the last pass. Each piece of text drops what it holds
twice before the shuffle, so a passage in a third of all documents gives a record
per piece. Order is (doc_id, null first, start); suffixes never cross documents.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rxweave.llm.common import field, pieces, quoted, sha256_hex
from rxweave.llm.wordhash import mixed
from rxweave.session import cut_lineage

DEPTH = 100
GRAM = 32

#: Bytes of text whose suffixes are handled at once.
PIECE_BYTES = 2 << 20

#: Bytes of text per bucket of the first two passes.
BUCKET_BYTES = 16 << 20

#: Stands for a null id, and is taken for one; other ids are larger.
NULL_ID = -(1 << 63)

#: A record's start and number of suffixes in one number.
RUN_BITS = 7

_RANDOM = np.random.Generator(np.random.PCG64(20240307))
LETTERS = _RANDOM.integers(0, 1 << 63, (3, 256), np.uint64) * np.uint64(2) + np.uint64(1)
FACTOR = 0x9E3779B97F4A7C15
INVERSE = pow(FACTOR, -1, 1 << 64)


class Powers:
    """Powers of the factor and of its inverse, as many as were asked for so far."""

    up = down = np.zeros(0, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up, cls.down = (np.cumprod(np.append(np.uint64(1), np.full(n, x, np.uint64)), dtype=np.uint64) for x in (FACTOR, INVERSE))
        return cls.up[:n], cls.down[:n]


class Prefixes:
    """Hashes of any substring of some bytes: differences of prefix sums, moved to a common place."""

    def __init__(self, data: np.ndarray, letters: int):
        up, self.down = Powers.of(len(data))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(LETTERS[letters][data] * up)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start])


def sliding_least(value: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    done = 1
    while done * 2 <= width:
        value = np.minimum(value[:-done], value[done:])
        done *= 2
    return np.minimum(value[:len(value) - (width - done)], value[width - done:]) if width > done else value


def runs(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of suffixes with one minimiser: text number, start in the text, number of suffixes, and both digits."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    if len(data) < DEPTH:
        return none
    grams = Prefixes(data, 0)
    at = np.arange(len(data) - GRAM + 1)
    first = grams.of(at, at + GRAM)
    bits = np.uint64(max(1, int(len(data)).bit_length()))
    ranked = (first >> bits << bits) | at.astype(np.uint64)  # of equal grams the leftmost one
    choice = sliding_least(ranked, DEPTH - GRAM + 1) & ((np.uint64(1) << bits) - np.uint64(1))
    ends = np.cumsum(sizes)
    text = np.repeat(np.arange(len(sizes)), sizes)[:len(choice)]
    valid = np.flatnonzero(np.arange(len(choice)) + DEPTH <= ends[text])
    if not len(valid):
        return none
    chosen = choice[valid].astype(np.int64)
    new = np.ones(len(valid), bool)
    new[1:] = chosen[1:] != chosen[:-1]
    begin = np.flatnonzero(new)
    start, count = valid[begin], np.diff(np.append(begin, len(valid)))
    text, anchor = text[start], chosen[begin]
    whole = Prefixes(data, 1).of(start, start + count - 1 + DEPTH)
    whole = mixed(whole ^ (((anchor - start) * 128 + count).astype(np.uint64)))
    return text, start - (ends - sizes)[text], count, first[anchor], whole


def firsts(*digits: np.ndarray) -> np.ndarray:
    """Whether a record is the first with its digits; the records are in order."""
    order = np.lexsort(digits)  # stable
    new = np.ones(len(order), bool)
    new[1:] = np.any([d[order][1:] != d[order][:-1] for d in digits], axis=0)
    out = np.zeros(len(order), bool)
    out[order[new]] = True
    return out


def packed(gram: np.ndarray, whole: np.ndarray, key: np.ndarray, tie: np.ndarray, run: np.ndarray) -> bytes:
    """Records as bytes: digits as they are, the rest (ascending ids) as differences, compressed."""
    step = np.diff(key, prepend=np.zeros(1, np.int64))
    rest = zlib.compress(b"".join(x.astype("<i8").tobytes() for x in (step, tie)) + run.astype("<i8").tobytes(), 1)
    return np.int64(len(key)).tobytes() + gram.tobytes() + whole.tobytes() + rest


def unpacked(data: bytes) -> tuple[np.ndarray, ...]:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    gram, whole = np.frombuffer(data, np.uint64, n, 8), np.frombuffer(data, np.uint64, n, 8 + 8 * n)
    step, tie, run = np.frombuffer(zlib.decompress(data[8 + 16 * n:]), "<i8").reshape(3, n)
    return gram, whole, np.cumsum(step), tie, run


def sorted_texts(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Keys, ties and UTF-8 texts of a piece in order, rows equal in key and tie once."""
    key, tie = (piece.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
    order = np.lexsort((tie, key))
    order = order[firsts(tie[order], key[order])]
    texts = piece.column(2).cast(pa.binary()).to_pylist()
    return key[order], tie[order], [texts[i] for i in order]


def _first_pass(n_buckets: int):
    """Per piece and bucket the records that are the first of their kind in the piece, and, anywhere, the others as known repeats."""
    def run(batches):
        for batch in batches:
            for piece in pieces(batch, 2, PIECE_BYTES):
                key, tie, texts = sorted_texts(piece)
                text, start, count, gram, whole = runs(np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts], np.int64))
                record = start << RUN_BITS | count
                new = firsts(whole, gram)
                bucket = (gram % np.uint64(n_buckets)).astype(np.int64)
                out = []
                order = np.flatnonzero(new)[np.argsort(bucket[new], kind="stable")]
                cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
                for a, b in zip(cuts, cuts[1:]):
                    x = order[a:b]
                    out.append((int(bucket[x[0]]), True, packed(gram[x], whole[x], key[text[x]], tie[text[x]], record[x])))
                x = np.flatnonzero(~new)
                if len(x):
                    out.append((int(bucket[x[0]]), False, packed(gram[x], whole[x], key[text[x]], tie[text[x]], record[x])))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.bool_(), pa.binary()))], names=["bucket", "new", "records"])

    return run


def _second_pass(frame: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket: repeats of whole runs, and the first runs of grams that have several kinds, to be taken apart."""
    out, bucket = [], int(frame["bucket"].iloc[0])
    for new, part in frame.groupby("new"):
        gram, whole, key, tie, run = (np.concatenate(x) for x in zip(*map(unpacked, part["records"])))
        if not new:
            out.append((key, tie, run, np.zeros(len(key), bool)))
            continue
        order = np.lexsort((run, tie, key))
        gram, whole, key, tie, run = (x[order] for x in (gram, whole, key, tie, run))
        once = firsts(run, tie, key)  # rows equal in id and text are one document
        gram, whole, key, tie, run = (x[once] for x in (gram, whole, key, tie, run))
        kind = firsts(whole, gram)
        _, number, kinds = np.unique(gram[kind], return_inverse=True, return_counts=True)
        apart = np.flatnonzero(kind)[kinds[number] > 1]
        out.append((key[~kind], tie[~kind], run[~kind], np.zeros(int((~kind).sum()), bool)))
        out.append((key[apart], tie[apart], run[apart], np.ones(len(apart), bool)))
    key, tie, run, apart = (np.concatenate(x) for x in zip(*out))
    return pd.DataFrame({"key": key, "tie": tie, "run": run, "bucket": np.where(apart, bucket, -1)})


def _taken_apart(batches):
    """Per piece and bucket the open runs with their bytes."""
    for batch in batches:
        for piece in pieces(batch, 2, PIECE_BYTES):
            texts = piece.column(2).cast(pa.binary()).to_pylist()
            held: dict[int, list] = {}
            for key, tie, text, runs_of, buckets in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), texts, piece.column(3).to_pylist(), piece.column(4).to_pylist()):
                for run, bucket in zip(runs_of, buckets):
                    start, count = run >> RUN_BITS, run & ((1 << RUN_BITS) - 1)
                    held.setdefault(bucket, []).append((key, tie, run, text[start:start + count - 1 + DEPTH]))
            columns = [[], []]
            for bucket, rows in held.items():
                key, tie, run, data = zip(*rows)
                columns[0].append(bucket)
                columns[1].append(np.int64(len(rows)).tobytes() + zlib.compress(np.array([key, tie, run], "<i8").tobytes() + b"".join(data), 1))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary())], names=["bucket", "records"])


def _third_pass(frame: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket: the suffixes of open runs whose 100 bytes come earlier in another one, again as runs."""
    numbers, texts = [], []
    for record in frame["records"]:
        n, rest = int(np.frombuffer(record, np.int64, 1)[0]), zlib.decompress(record[8:])
        numbers.append(np.frombuffer(rest, "<i8", 3 * n).reshape(3, n))
        texts.append(np.frombuffer(rest, np.uint8, -1, 24 * n))
    key, tie, run = np.concatenate(numbers, axis=1)
    count = run & ((1 << RUN_BITS) - 1)
    size = count - 1 + DEPTH
    offset = np.cumsum(size) - size
    order = np.lexsort((run, tie, key))
    order = order[firsts(run[order], tie[order], key[order])]  # rows equal in id and text are one document
    key, tie, run, count, offset = (x[order] for x in (key, tie, run, count, offset))
    data = np.concatenate(texts)
    record = np.repeat(np.arange(len(run)), count)
    step = np.arange(len(record)) - np.repeat(np.cumsum(count) - count, count)
    at = offset[record] + step
    again = np.flatnonzero(~firsts(Prefixes(data, 1).of(at, at + DEPTH), Prefixes(data, 2).of(at, at + DEPTH)))
    new = np.ones(len(again), bool)
    new[1:] = (np.diff(again) > 1) | (record[again][1:] != record[again][:-1])
    begin = np.flatnonzero(new)
    first = again[begin]
    length = np.diff(np.append(begin, len(again)))
    which = record[first]
    return pd.DataFrame({"key": key[which], "tie": tie[which], "run": ((run[which] >> RUN_BITS) + step[first]) << RUN_BITS | length})


FIELDS = [field("n_bytes", "long"), field("n_removed", "long"), field("n_spans", "long"), field("kept_sha256", "string")]


def removed_mask(size: int, repeats: list) -> np.ndarray:
    """Which bytes of a text lie in a repeated suffix's 100 bytes."""
    run = np.array(repeats, np.int64)
    begin = run >> RUN_BITS
    end = begin + (run & ((1 << RUN_BITS) - 1)) - 1 + DEPTH
    step = np.bincount(begin, minlength=size + 1) - np.bincount(end, minlength=size + 1)
    return np.cumsum(step[:size]) > 0


def _finished(kept_text: bool):
    def run(batches):
        for batch in batches:
            for piece in pieces(batch, 1, 4 * PIECE_BYTES):
                ids, texts, whole, single = (piece.column(i) for i in range(4))
                out = []
                for text, w, s in zip(texts.cast(pa.binary()).to_pylist(), whole.to_pylist(), single.to_pylist()):
                    mask = removed_mask(len(text), (w or []) + (s or []))
                    kept = np.frombuffer(text, np.uint8)[~mask].tobytes() if mask.any() else text
                    spans = int((np.diff(mask.astype(np.int8), prepend=0) == 1).sum())
                    out.append((len(text), int(mask.sum()), spans, kept if kept_text else sha256_hex(kept)))
                types = [pa.int64()] * 3 + [pa.binary() if kept_text else pa.string()]
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(zip(*out), types))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept" if kept_text else "kept_sha256"])

    return run


def repeated_strings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", kept_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, ``n_bytes``, ``n_removed``, ``n_spans`` and the digest of the bytes that stay (or, with ``kept_text``, the bytes).

    Null texts are empty. Rows equal in id and text are one document and get
    equal results; different texts under one id follow in the order of their
    hashes; null ids come first. Texts of under 100 bytes lose nothing.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(quoted(doc_id)).cast("long").alias("doc_id"), F.coalesce(F.col(quoted(text)).cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("ids"), F.sum(F.octet_length("text")).alias("bytes")).collect()[0]
    unique = size["n"] == size["ids"]  # only repeated or null ids need a tie
    tie, by = (F.lit(0).cast("long"), ["key"]) if unique else (F.xxhash64("text"), ["key", "tie"])
    rows = rows.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("key"), tie.alias("tie"), "text")
    n_buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil((size["bytes"] or 0) / BUCKET_BYTES))
    records = rows.mapInArrow(_first_pass(n_buckets), "bucket long, new boolean, records binary")
    found = cut_lineage(spark, records.groupBy("bucket").applyInPandas(_second_pass, "key long, tie long, run long, bucket long"), "runs")
    listed = F.collect_list(F.struct("run", "bucket"))
    opened = found.where("bucket >= 0").groupBy(*by).agg(listed.alias("open"))
    # both joins below read the same shuffle of the texts
    apart = rows.hint("merge").join(opened, by).select("key", rows["tie"], "text", F.col("open.run").alias("runs"), F.col("open.bucket").alias("buckets"))
    single = apart.mapInArrow(_taken_apart, "bucket long, records binary").groupBy("bucket").applyInPandas(_third_pass, "key long, tie long, run long")
    single = single.groupBy(*by).agg(F.collect_list("run").alias("single"))
    whole = found.where("bucket < 0").groupBy(*by).agg(F.collect_list("run").alias("whole"))
    full = rows.hint("merge").join(whole, by, "left").join(single, by, "left")
    full = full.select(F.nullif("key", F.lit(NULL_ID)).alias("doc_id"), "text", "whole", "single")
    fields = [T.StructField("doc_id", T.LongType()), *FIELDS[:3], field("kept", "binary") if kept_text else FIELDS[3]]
    return full.mapInArrow(_finished(kept_text), T.StructType(fields))
