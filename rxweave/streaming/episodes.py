"""Episodes from a stream of prescription lines, with one row of state per patient and drug.

Event time is the prescription's day. The watermark of a micro-batch is the
newest day of all batches before it, less a delay. Rows not newer than it are
late: they go to ``late`` and change nothing. The others wait, at prescription
× drug grain, until the watermark of the following batch has reached their day;
then all rows of that day are there, in whatever order they came, and the day is
folded into the open episode of its patient and drug. So the state is one open
episode per patient and drug and the rows within the delay; neither grows with
the history, which is never read again.

Open episodes lie in hash buckets. A batch reads and rewrites only the buckets
of the keys that it folds; each bucket remembers the batch that wrote it last.
Everything a batch writes carries its number and is written in overwrite mode,
and it reads only what earlier batches have committed, so a repeated batch
replaces its own output. The commit comes last.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rxweave.operators import episodes as E
from rxweave.session import shared_folder
from rxweave.streaming.files import delete, put, run_available

KEYS = ["patient_id", "inn"]
BUCKETS = 64

COMMIT = T.StructType([
    T.StructField("newest", T.DateType()), T.StructField("watermark", T.DateType()), T.StructField("versions", T.ArrayType(T.IntegerType()))])


def _bucket(n: int):
    return F.pmod(F.xxhash64(*KEYS), F.lit(n)).cast("int")


def read_paths(spark: SparkSession, schema: T.StructType, paths: list[str]) -> DataFrame:
    """The rows of some folders; none for no folders."""
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def commit_of(spark: SparkSession, folder: str, batch_id: int, buckets: int) -> T.Row:
    """What a batch left: newest day, watermark, and which batch wrote each bucket; nothing before the first batch."""
    if batch_id < 0:
        return T.Row(newest=None, watermark=None, versions=[-1] * buckets)
    return spark.read.schema(COMMIT).parquet(f"{folder}/commits/batch_id={batch_id}").first()


def _state_paths(folder: str, versions: list[int], wanted: list[int]) -> list[str]:
    return [f"{folder}/open/version={versions[k]}/bucket={k}" for k in wanted if versions[k] >= 0]


def fold(days: DataFrame, state: DataFrame) -> DataFrame:
    """Episodes (as ``grouped_days``) of days that follow the open episodes of ``state``.

    An open episode counts as one day before the new ones, with its known end;
    that is all the gap rule needs of what came before.
    """
    touched = state.join(days.select(*KEYS).distinct(), KEYS, "left_semi")
    prior = touched.select(
        *KEYS, F.col("last_date").alias("rx_date"), F.col("prescription_count").alias("n_rx"), F.col("estimated_end_date").alias("day_end"),
        F.col("latest").alias("day_latest"), "gap_days")
    grouped = E.grouped_days(E.number_days(days.unionByName(prior)))
    opened = touched.select(*KEYS, (F.col("episode_no") - 1).alias("_before"), F.col("start_date").alias("_start"))
    joined = grouped.join(opened, KEYS, "left")
    return joined.withColumns({
        "start_date": F.when(F.col("episode_no") == 1, F.coalesce("_start", "start_date")).otherwise(F.col("start_date")),
        "episode_no": F.col("episode_no") + F.coalesce("_before", F.lit(0))}).drop("_before", "_start")


def stream_episodes(lines: DataFrame, delay_days: int, folder: str | None = None, buckets: int = BUCKETS) -> str:
    """Fold a stream of prescription lines into episodes; returns the folder.

    ``episodes`` holds what is final: completed episodes and as-needed
    snapshots; ``late`` the rows that came after their day had been folded, and
    rows without a day. ``current_episodes`` adds what is open. A folder keeps
    its number of buckets.
    """
    spark = lines.sparkSession
    out = folder or shared_folder(spark, "episodes")

    def sink(batch: DataFrame, batch_id: int) -> None:
        fold_batch(batch, batch_id, out, delay_days, buckets)

    run_available(lines, sink, f"{out}/_checkpoint")
    return out


def fold_batch(lines: DataFrame, batch_id: int, out: str, delay_days: int, buckets: int) -> None:
    spark = lines.sparkSession
    before = commit_of(spark, out, batch_id - 1, buckets)
    _forget(spark, out, batch_id, before)
    put(E.named_lines(lines), f"{out}/arrived", batch_id)
    arrived = spark.read.parquet(f"{out}/arrived/batch_id={batch_id}")
    # rows of one prescription and drug may come in several batches; its first line counts, found in one pass with the batch's own
    put(E.least_lines(arrived.unionByName(waiting(spark, out, batch_id - 1, before["watermark"], arrived.schema))), f"{out}/pool", batch_id)
    pool = read_paths(spark, arrived.schema, [f"{out}/pool/batch_id={batch_id}"])
    late = F.col("rx_date").isNull() | (F.col("rx_date") <= F.lit(before["watermark"])) if before["watermark"] else F.col("rx_date").isNull()
    put(E.line_columns(pool.where(late)), f"{out}/late", batch_id)
    newest = max(filter(None, [before["newest"], pool.agg(F.max("rx_date")).first()[0]]), default=None)
    watermark = newest - dt.timedelta(delay_days) if newest else None

    due = E.line_columns(pool.where(~late & (F.col("rx_date") <= F.lit(watermark))))
    days = E.prescription_days(due)
    scheduled = E.with_defaults(due).where("NOT is_prn")
    wanted = sorted(r[0] for r in scheduled.select(_bucket(buckets).alias("b")).distinct().collect())  # at most as many as there are buckets
    versions = list(before["versions"])
    state = read_paths(spark, state_schema(days), _state_paths(out, versions, wanted))
    put(fold(days, state), f"{out}/folded", batch_id)
    folded = spark.read.parquet(f"{out}/folded/batch_id={batch_id}")
    put(E.shaped_episodes(folded.where("closed")).unionByName(E.prn_episodes(due)), f"{out}/episodes", batch_id)
    kept = state.join(folded.select(*KEYS).distinct(), KEYS, "left_anti")
    opened = folded.where("NOT closed").select(*state.columns).unionByName(kept)
    opened.withColumn("bucket", _bucket(buckets)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/open/version={batch_id}")
    for k in wanted:
        versions[k] = batch_id
    put(spark.createDataFrame([(newest, watermark, versions)], COMMIT), f"{out}/commits", batch_id)


def waiting(spark: SparkSession, out: str, batch_id: int, watermark: dt.date | None, schema: T.StructType) -> DataFrame:
    """Rows that a batch left unfolded: those newer than its watermark."""
    rows = read_paths(spark, schema, [f"{out}/pool/batch_id={batch_id}"] if batch_id >= 0 else [])
    return rows.where(F.col("rx_date") > F.lit(watermark) if watermark else F.col("rx_date").isNotNull())


def state_schema(days: DataFrame) -> T.StructType:
    """Columns of an open episode, with the types of the ``prescription_days`` that it is folded from."""
    kind = {f.name: f.dataType for f in days.schema}
    types = {**{k: kind[k] for k in KEYS}, "episode_no": T.LongType(), "start_date": kind["rx_date"], "estimated_end_date": kind["day_end"], "prescription_count": kind["n_rx"],
             "gap_days": kind["gap_days"], "latest": kind["day_latest"], "last_date": kind["rx_date"]}
    return T.StructType([T.StructField(n, t) for n, t in types.items()])


def _forget(spark: SparkSession, out: str, batch_id: int, before: T.Row) -> None:
    """Remove what no later batch reads: this is called when the batch before is committed by the stream as well."""
    for name in ("pool", "folded", "commits"):
        delete(spark, f"{out}/{name}/batch_id={batch_id - 2}")
    for version in range(batch_id - 1):
        if version not in before["versions"] and version >= batch_id - 1 - len(before["versions"]):
            delete(spark, f"{out}/open/version={version}")


def current_episodes(spark: SparkSession, folder: str) -> DataFrame:
    """All episodes so far: final ones, open ones, and those of rows that still wait."""
    last = spark.read.parquet(f"{folder}/commits").agg(F.max_by(F.struct("batch_id", "watermark", "versions"), "batch_id").alias("c")).first()["c"]
    batch_id, versions = int(last["batch_id"]), list(last["versions"])
    arrived = spark.read.parquet(f"{folder}/arrived/batch_id={batch_id}").schema
    rest = E.line_columns(waiting(spark, folder, batch_id, last["watermark"], arrived))
    days = E.prescription_days(rest)
    state = read_paths(spark, state_schema(days), _state_paths(folder, versions, list(range(len(versions)))))
    folded = fold(days, state)
    quiet = state.join(days.select(*KEYS).distinct(), KEYS, "left_anti").withColumn("closed", F.lit(False))
    final = spark.read.parquet(f"{folder}/episodes").drop("batch_id")
    return final.unionByName(E.shaped_episodes(folded.unionByName(quiet))).unionByName(E.prn_episodes(rest))


def late_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that came too late to be folded, with the batch that brought them."""
    return spark.read.parquet(f"{folder}/late")
