"""File sources."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rxweave.refdata.tables import ALL_TABLES


def scan_annotations(spark: SparkSession, folder: str, limit: int | None = None) -> DataFrame:
    """One JSON object per file; ``stem`` is the file name without suffix."""
    files = (
        spark.read.schema("ground_truth string").option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)
        .select(F.col("_metadata.file_name").alias("file_name"), "ground_truth"))
    rows = files.select(F.regexp_replace("file_name", r"\.json$", "").alias("stem"), "file_name", "ground_truth")
    return rows.orderBy("file_name").limit(limit) if limit is not None else rows


def scan_metadata_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with the malformed ones in ``bad_line``."""
    schema = "file_name string, ground_truth string, bad_line string"
    return spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "bad_line").json(path)


def scan_label_csv(spark: SparkSession, path: str) -> DataFrame:
    schema = "IMAGE string, MEDICINE_NAME string, GENERIC_NAME string"
    return spark.read.schema(schema).option("header", True).csv(path)


#: What the binary file source gives.
FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


#: Bytes that opening a file counts for when files are dealt to tasks; Spark's own 4 MB make a task of each few small files.
_OPEN_COST = 64 * 1024


@contextmanager
def many_files(spark: SparkSession, tasks: int = 64) -> Iterator[None]:
    """Folders are listed by this many tasks, by Spark's own choice one for each folder, up to 10,000; a task reads hundreds of small files."""
    wanted = {"spark.sql.sources.parallelPartitionDiscovery.parallelism": str(tasks), "spark.sql.files.openCostInBytes": str(_OPEN_COST)}
    before = {key: spark.conf.get(key) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def scan_document_files(spark: SparkSession, folder: str) -> DataFrame:
    """Raw files below a folder, with the fingerprint of their bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", "length", F.sha2("content", 256).alias("upload_hash"))


def stream_document_files(spark: SparkSession, folder: str, files_per_batch: int | None = 1000) -> DataFrame:
    """Raw files below a folder as a stream, each taken up once: path, length and fingerprint of its bytes.

    The bytes are read and dropped in the scan; nothing behind it carries them.
    Without ``files_per_batch`` all files that are there make one micro-batch.
    """
    source = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", True)
    if files_per_batch:
        source = source.option("maxFilesPerTrigger", files_per_batch)
    return source.load(folder).select("path", "length", F.sha2("content", 256).alias("upload_hash"))


def fingerprint(docs: DataFrame, column: str = "text") -> DataFrame:
    return docs.withColumn("upload_hash", F.sha2(F.col(column).cast("binary"), 256))


def first_uploads(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """One document per distinct content, the one with the lowest key. Only
    key and hash are shuffled and grouped; the texts stay where they are until
    the semi-join on the key."""
    keep = docs.groupBy("upload_hash").agg(F.min(key).alias(key)).select(key)
    return docs.join(keep, key, "left_semi")


def scan_tables(spark: SparkSession, folder: str, tables: list[str]) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{folder}/{t}.parquet") for t in tables}


def scan_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int) -> DataFrame:
    """A stored table read in parallel key ranges."""
    return spark.read.jdbc(url, table, column=key, lowerBound=low, upperBound=high, numPartitions=parts)


def scan_reference(spark: SparkSession) -> dict[str, DataFrame]:
    return {name: build(spark) for name, build in ALL_TABLES.items()}
