"""Shared steps of the operators: texts mapped in bounded pieces, column types, digests."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Bytes of text handled at once in a task.
PIECE_BYTES = 8 << 20

_TEXT = "__text"


def quoted(name: str) -> str:
    """A column name that may hold dots or backticks, for F.col."""
    return "`" + name.replace("`", "``") + "`"


def sha256_hex(data: str | bytes) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def pieces(batch: pa.RecordBatch, column: int, max_bytes: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``max_bytes`` of text each, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and held + size > max_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(size)
    if start < len(sizes):
        yield batch.slice(start)


def map_texts(docs: DataFrame, keep: list[str], text: str, fields: list[T.StructField], make: Callable[[], Callable],
              max_bytes: int = PIECE_BYTES) -> DataFrame:
    """The ``keep`` columns and new ``fields`` computed from each text, in place of all other columns.

    ``make()`` runs once per task and returns a function from a list of texts
    (None where null) to one list of values per field. There is no shuffle.
    """
    chosen = docs.select(*[F.col(quoted(c)) for c in keep], F.col(quoted(text)).cast("string").alias(_TEXT))
    schema = T.StructType([*chosen.schema.fields[:-1], *fields])
    arrow = to_arrow_schema(schema)
    at = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            for piece in pieces(batch, at, max_bytes):
                columns = compute(piece.column(at).to_pylist())
                arrays = [piece.column(i).cast(arrow.field(i).type) for i in range(at)]
                arrays += [pa.array(c, type=arrow.field(at + i).type) for i, c in enumerate(columns)]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return chosen.mapInArrow(run, schema)


def replace_texts(docs: DataFrame, text: str, make: Callable[[], Callable]) -> DataFrame:
    """All rows and columns with each text replaced; ``make()`` as above, giving one list of texts."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            for piece in pieces(batch, at):
                new = pa.array(compute(piece.column(at).to_pylist()), type=piece.schema.field(at).type)
                yield piece.set_column(at, piece.schema.field(at), new)

    return docs.mapInArrow(run, docs.schema)


def field(name: str, kind: str) -> T.StructField:
    kinds = {"long": T.LongType(), "string": T.StringType(), "boolean": T.BooleanType(), "double": T.DoubleType(), "int": T.IntegerType(),
             "strings": T.ArrayType(T.StringType()), "binary": T.BinaryType(), "longs": T.ArrayType(T.LongType())}
    return T.StructField(name, kinds[kind])
