"""Raw files by the hundred thousand: written, listed and read by tasks.

Spark's own file source keeps the names of all files that ever came in the
driver and lists them again for each arrival, and its writer has the driver
rename a folder for each file. Here the driver sees folders only. A folder is
announced when its files are complete; the stream takes up announcements, and
tasks list the folders and read the files.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes read at a time, and files of one batch of rows.
_CHUNK, _ROWS = 1 << 20, 1000


def address(spark: SparkSession, folder: str) -> str:
    """The folder with its store, as Spark understands it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()


def reachable(spark: SparkSession, folder: str) -> bool:
    """Whether tasks can open the files of a folder, by Arrow; a store that it doesn't know is left to Spark's own source."""
    try:
        fs.FileSystem.from_uri(address(spark, folder))
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return True


def write_texts(rows: DataFrame, folder: str, announced: str) -> None:
    """Each row of ``name, value`` a file of its own, the text and a line end, in up to 256 folders that are announced when all is written.

    Equal names must have equal texts: a task that is run again replaces files by equal ones, each in one step.
    """
    chosen = rows.select("name", F.substring(F.md5("name"), 1, 2).alias("part"), F.col("value").cast("binary").alias("value"))
    folders = chosen.mapInArrow(_writer(address(rows.sparkSession, folder)), "value string")
    folders.distinct().write.mode("append").text(announced)


def _writer(top: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = fs.FileSystem.from_uri(top)
        there, own = set(), uuid.uuid4().hex
        for batch in batches:
            names, parts = (batch.column(i).to_pylist() for i in (0, 1))
            for name, part, value in zip(names, parts, batch.column(2)):
                if part not in there:
                    files.create_dir(f"{path}/{part}", recursive=True)
                    there.add(part)
                with files.open_output_stream(f"{path}/{part}/.{own}") as out:  # a hidden name
                    out.write(value.as_buffer())
                    out.write(b"\n")
                files.move(f"{path}/{part}/.{own}", f"{path}/{part}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([f"{top}/{part}" for part in sorted(there)], pa.string())], names=["value"])

    return run


def stream_folders(spark: SparkSession, announced: str, tasks: int | None = None) -> DataFrame:
    """Raw files of announced folders as a stream, each folder taken up once: path, length and fingerprint of the bytes.

    Below ``announced`` lie text files with a folder a line. All that are there make one micro-batch, whose folders are dealt
    to ``tasks``, by default 64 or one for each core; a task holds a piece of one file and the rows of a thousand.
    """
    tasks = tasks or max(64, spark.sparkContext.defaultParallelism)
    folders = spark.readStream.schema("value string").text(announced)
    return folders.repartition(tasks, "value").mapInArrow(_read, "path string, length long, upload_hash string")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for folder in (x for batch in batches for x in batch.column(0).to_pylist()):
        files, path = fs.FileSystem.from_uri(folder)
        found = [x.path for x in files.get_file_info(fs.FileSelector(path, recursive=True)) if x.type == fs.FileType.File and not x.base_name.startswith((".", "_"))]
        for start in range(0, len(found), _ROWS):
            some = found[start:start + _ROWS]
            lengths, hashes = zip(*[_fingerprint(files, x) for x in some])
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array(lengths, pa.int64()), pa.array(hashes, pa.string())], names=["path", "length", "upload_hash"])


def _fingerprint(files: fs.FileSystem, path: str) -> tuple[int, str]:
    length, digest = 0, hashlib.sha256()
    with files.open_input_stream(path) as file:
        while piece := file.read(_CHUNK):
            length += len(piece)
            digest.update(piece)
    return length, digest.hexdigest()
