"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
PARSE_CONF = "rxweave.parse.partitions"


def build_session(app: str = "rxweave", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with UTC times and adaptive execution.

    On a cluster the master, the memory and the shared checkpoint folder come
    from spark-submit; only settings the jobs rely on are fixed here.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder.

    A machine-local folder is used only in local mode with no folder set, so
    that every executor can always read what another one wrote.
    """
    base = spark.conf.get(CHECKPOINT_CONF, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp" if os.path.isdir("/tmp") else None)
    return f"{run_folder(spark, base)}/{purpose}-{uuid.uuid4().hex}"


def run_folder(spark: SparkSession, base: str) -> str:
    """Where this application keeps its intermediate results below the shared folder."""
    return f"{base.rstrip('/')}/rxweave-{spark.sparkContext.applicationId}"


def remove_results(spark: SparkSession) -> None:
    """Remove what this application wrote below the shared folder; for the end of a job, when no result is read any more."""
    base = spark.conf.get(CHECKPOINT_CONF, None)
    if base:
        path = spark._jvm.org.apache.hadoop.fs.Path(run_folder(spark, base))
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(spark: SparkSession, df, purpose: str):
    """Write a result once and read it back, so that several consumers share it
    and a lost executor costs a read instead of a recomputation."""
    path = shared_folder(spark, purpose)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df):
    """Rows dealt out to as many partitions as the setting rxweave.parse.partitions says; unset, the scan stays as it is.

    For CPU-heavy parsing of a table that lies in a single file.
    """
    wanted = df.sparkSession.conf.get(PARSE_CONF, None)
    return df.repartition(int(wanted)) if wanted else df
