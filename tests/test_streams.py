"""Streaming jobs against plain loops over the rows in their order of arrival."""

import datetime as dt
import os
import random
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from rxweave.catalog import CHECKS, QUERIES, streams
from rxweave.operators import episodes as E
from rxweave.operators import labs as L
from rxweave.refdata import tables
from rxweave.sources import rawfiles, readers
from rxweave.streaming import episodes as SE
from rxweave.streaming import ingest as I
from rxweave.streaming import uploads as U
from rxweave.streaming.files import file_stream
from tests.compare import compare, connect
from tests.test_clinical import DAY, GAPS, fold

LINE = ("patient_id long, inn string, rx_id long, rx_date date, line_no int, dosage_value double, dosage_unit string, frequency string, duration_days int, doctor_id long, raw_drug_name string")


def line(p, inn, rx, day, days, no=1):
    return (p, inn, rx, day, no, float(rx % 3), "mg", "od", days, rx % 5, inn)


def arrive(spark, tmp_path, batches, delay, buckets=4):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in batches:
        spark.createDataFrame(rows, LINE).coalesce(1).write.mode("append").parquet(source)
        SE.stream_episodes(file_stream(spark, source, "*.parquet", spark.read.parquet(source).schema), delay, out, buckets)
    return out


def plain_late(batches, delay):
    """Rows not newer than the newest day of the batches before, less the delay."""
    newest, late, rest = None, [], []
    for rows in batches:
        mark = newest and newest - dt.timedelta(delay)
        for r in rows:
            (late if r[3] is None or mark and r[3] <= mark else rest).append(r)
        newest = max([d for d in [newest, *(r[3] for r in rows)] if d], default=None)
    return late, rest


@pytest.mark.parametrize("delay", [0, 30, 400])
def test_stream_equals_the_loop_over_arrivals(spark, tmp_path, delay):
    r = random.Random(delay)
    rows = [line(r.randint(1, 3), r.choice(["metformin", "tramadol", "unlisted", "salbutamol"]), i // 2, DAY + dt.timedelta(r.randint(0, 600)), r.choice([None, 0, 5, 30, 90])) for i in range(160)]
    rows = [(*x[:3], DAY + dt.timedelta(x[2] * 7 % 600), *x[4:]) for x in rows]  # one day per prescription
    rows.append((*rows[0][:3], None, *rows[0][4:]))
    seen = sorted(rows, key=lambda x: ((x[3] or DAY) + dt.timedelta(r.choice([0, 0, 20, 29, 90, 250])), x[2]))
    batches = [seen[i:i + 40] for i in range(0, len(seen), 40)]
    out = arrive(spark, tmp_path, batches, delay)
    late, rest = plain_late(batches, delay)
    key = lambda x: (x[0], x[1], x[2])
    assert {(x.patient_id, x.inn, x.rx_id) for x in SE.late_lines(spark, out).collect()} == set(map(key, late))
    want = E.medication_episodes(E.prescription_drugs(spark.createDataFrame(rest, LINE)))
    got = SE.current_episodes(spark, out)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))
    plain = {}
    for p, inn, _, day, days in {(x[0], x[1], x[2], x[3], min((y[8] or -1, y[4]) for y in rest if key(y) == key(x))[0]) for x in rest if x[1] in GAPS}:
        plain.setdefault((p, inn), []).append((day, days))
    counts = {k: len(fold([(d, None if n < 1 else n) for d, n in v], GAPS[k[1]])) for k, v in plain.items()}
    found = {}
    for x in got.where("dispensing_type = 'scheduled'").collect():
        found[x.patient_id, x.inn] = found.get((x.patient_id, x.inn), 0) + 1
    assert set(found) == set(counts)


def size(paths):
    return sum(os.path.getsize(os.path.join(d, f)) for p in paths for d, _, names in os.walk(p) for f in names if f.endswith(".parquet"))


def test_what_a_batch_reads_does_not_grow(spark, tmp_path, monkeypatch):
    """Twenty batches: the state that is read stays as large as the keys, while the history grows."""
    read, per_batch = [], []
    plain = SE.read_paths
    monkeypatch.setattr(SE, "read_paths", lambda spark, schema, paths: read.append(size(paths)) or plain(spark, schema, paths))
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for b in range(20):
        rows = [line(p, "metformin", b * 100 + p, DAY + dt.timedelta(b * 40 + p % 9), 10) for p in range(60)]
        spark.createDataFrame(rows, LINE).coalesce(1).write.mode("append").parquet(source)
        read.clear()
        SE.stream_episodes(file_stream(spark, source, "*.parquet", spark.read.parquet(source).schema), 20, out, 2)
        per_batch.append(sum(read))
    assert max(per_batch[10:]) < 1.2 * max(per_batch[3:6])
    assert size([f"{out}/arrived"]) > 15 * size([f"{out}/arrived/batch_id=19"])
    assert len(os.listdir(f"{out}/open")) <= 3 and len([d for d in os.listdir(f"{out}/pool") if d.startswith("batch")]) <= 2
    got = SE.current_episodes(spark, out).agg(F.sum("prescription_count"), F.max("episode_no"), F.count_if(F.col("status") == "active")).first()
    assert tuple(got) == (1200, 1, 60)


def test_a_repeated_batch_replaces_its_output(spark, tmp_path, monkeypatch):
    batches = [[line(p, inn, b * 50 + p, DAY + dt.timedelta(b * 100 + p), 30) for p in range(6) for inn in ("metformin", "tramadol")] for b in range(3)]
    clean = arrive(spark, tmp_path / "a", batches, 10)
    plain, calls = SE.put, []

    def failing(df, path, batch_id):
        calls.append(path)
        if batch_id == 1 and len(calls) in fail_at:
            raise OSError("lost")
        plain(df, path, batch_id)

    fail_at = {9, 15, 21}
    monkeypatch.setattr(SE, "put", failing)
    source, out = str(tmp_path / "b" / "in"), str(tmp_path / "b" / "out")
    for rows in batches:
        spark.createDataFrame(rows, LINE).coalesce(1).write.mode("append").parquet(source)
        for _ in range(5):
            try:
                SE.stream_episodes(file_stream(spark, source, "*.parquet", spark.read.parquet(source).schema), 10, out, 4)
                break
            except Exception as e:  # the stream's own error, with the cause in its text
                assert "lost" in str(e)
    rows = lambda f: sorted(map(str, SE.current_episodes(spark, f).collect()))
    assert len(calls) > 18 and rows(out) == rows(clean)


# --- uploads and ingest ---------------------------------------------------------------

def test_first_uploads_of_batches(spark, tmp_path):
    r = random.Random(1)
    rows = [(i, r.choice(["a", "b", "", None, "x" * 50, f"t{i % 60}"])) for i in range(400)]
    batches = [rows[:100], rows[300:], [], rows[100:300]]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in batches:
        spark.createDataFrame(part, "doc_id long, text string").coalesce(1).write.mode("append").parquet(source)
        U.stream_first_uploads(file_stream(spark, source, "*.parquet", "doc_id long, text string"), out, buckets=8)
    seen, want = set(), set()
    for part in batches:
        for i, t in sorted(part, key=lambda x: x[0]):
            if (t or "") not in seen:
                want.add(i)
            seen.add(t or "")
    assert {x.doc_id for x in spark.read.parquet(f"{out}/first").collect()} == want
    U.first_of_batch(spark.createDataFrame(batches[3], "doc_id long, text string"), 3, out, buckets=8)  # repeated
    assert {x.doc_id for x in spark.read.parquet(f"{out}/first").collect()} == want


def history(spark):
    brands = spark.createDataFrame([("bloodthin", "warfarin"), ("painaway", "ibuprofen"), ("sugarlow", "metformin")], "brand_name string, inn string")
    rx = spark.createDataFrame([(1, 7, DAY)], "rx_id long, patient_id long, created_at date")
    med = spark.createDataFrame([(1, "warfarin", None, True)], "rx_id long, inn string, duration_days int, is_active boolean")
    labs = L.latest_labs(spark.createDataFrame([(1, 8, "CREATININE", 2.0, "mg/dL", "0.7 - 1.3", "high", DAY, dt.datetime(2024, 1, 1))],
                                               "result_id long, patient_id long, analyte_name string, value double, unit string, ref_range string, flag string, report_date date, created_at timestamp"))
    return I.History(brands, rx, med, labs, tables.baseline_rules(spark).where("false"), DAY)


GOOD = "Reg. MH{0}\nAge: 40 yrs\nDate: 01/01/2024\nTab. {1} 50mg BD x 5 days"
UPLOADS = [
    [(10, 7, GOOD.format(1, "Painaway")), (11, 8, GOOD.format(2, "Sugarlow")), (12, 9, "noise"), (13, 9, None), (14, None, GOOD.format(3, "Painaway"))],
    [(20, 8, GOOD.format(4, "Bloodthin")), (21, 7, GOOD.format(1, "Painaway")), (22, 9, "noise")],
    [(30, 8, GOOD.format(5, "Painaway")), (30, 8, GOOD.format(5, "Painaway"))],
]


def ingested(spark, path, known):
    source, out = str(path / "in"), str(path / "out")
    for rows in UPLOADS:
        spark.createDataFrame(rows, "doc_id long, patient_id long, text string").coalesce(1).write.mode("append").parquet(source)
        for _ in range(12):
            try:
                I.stream_ingest(file_stream(spark, source, "*.parquet", "doc_id long, patient_id long, text string"), known, out)
                break
            except Exception as e:
                assert "lost" in str(e)
    return out


def stored(spark, out):
    return {s: sorted(map(str, I.committed(spark, out, s).collect())) for s in I.SINKS}


def test_sinks_of_failed_batches_equal_a_clean_run(spark, tmp_path, monkeypatch):
    known = history(spark)
    clean = ingested(spark, tmp_path / "clean", known)
    rows = stored(spark, clean)
    pairs = {(x.doc_id, x.drug_1, x.drug_2) for x in I.committed(spark, clean, "drug_interactions").collect()}
    # 10 with the stored drug, 30 with one of an earlier batch; 21, 22 and the second 30 are repeated uploads
    assert pairs == {(10, "ibuprofen", "warfarin"), (30, "ibuprofen", "warfarin")}
    assert {x.doc_id for x in I.committed(spark, clean, "prescriptions").collect()} == {10, 11, 14, 20, 30}
    assert sorted(x.item_id for x in I.committed(spark, clean, "review_queue").collect()) == [12, 13]
    assert {(x.doc_id, x.severity) for x in I.committed(spark, clean, "safety_alerts").collect()} == {(11, "critical")}
    assert len(rows["medications"]) == 5 and len(rows["prescriptions"]) == 5
    plain, calls, broken = I.put, [], []

    def failing(df, path, batch_id):
        calls.append(path)
        if len(calls) in (3, 7, 20):
            broken.append((path, stored(spark, path.rsplit("/", 1)[0]) if batch_id else None))
            raise OSError("lost")
        plain(df, path, batch_id)

    monkeypatch.setattr(I, "put", failing)
    again = ingested(spark, tmp_path / "again", known)
    assert len(broken) == 3 and stored(spark, again) == rows
    first = {s: [x for x in v if "batch_id=0" in x] for s, v in rows.items()}
    assert all(seen is None or all(set(v) <= set(rows[s]) for s, v in seen.items()) for _, seen in broken) and first["prescriptions"]
    I.ingest_batch(spark.createDataFrame(UPLOADS[2][:1], "doc_id long, patient_id long, text string"), 2, again, known)  # has its marker
    assert stored(spark, again) == rows


def test_equal_files_of_one_arrival_are_told_apart_by_name(spark, monkeypatch):
    """However many files an arrival has: a limit of files per batch must not cut it."""
    monkeypatch.setattr(readers.stream_document_files, "__defaults__", (20,))
    key, sf = "stream_document_files", "/root/testdata/sf0.001"
    status, n, _, note = compare(spark, connect(sf), sf, key, QUERIES[key], CHECKS[key])
    assert status == "ok" and n > 0, note


def test_a_document_is_one_file_and_no_name_is_kept_in_the_driver(spark, tmp_path, monkeypatch):
    """A folder and a checksum file for each document took three times the disk, and the driver listed all files for each arrival."""
    monkeypatch.setattr(streams, "shared_folder", lambda _, purpose: str(tmp_path / purpose))
    QUERIES["stream_document_files"](spark, "/root/testdata/sf0.001").collect()
    below = lambda folder: [(Path(d), x) for d, _, names in os.walk(tmp_path / folder) for x in names]
    assert len(below("files")) == 200 and len({d for d, _ in below("files")}) < 200
    taken_up = [line for d, x in below("uploads/_checkpoint/sources/0") if x.isdigit() for line in (d / x).read_text().splitlines()[1:]]
    assert 3 <= len(taken_up) <= 24


@pytest.mark.parametrize("arrow", [True, False])
def test_raw_files_of_odd_documents(spark, tmp_path, monkeypatch, arrow):
    """Ids below 0, repeated or missing; with Arrow, and for stores that only Spark reaches."""
    monkeypatch.setattr(rawfiles, "reachable", lambda *_: arrow)
    rows = [(5, "a"), (2, "a"), (-4, "a"), (-4, "b"), (-4, "b"), (7, "b"), (-2, "c"), (9, "c"), (None, "c"), (None, "d"), (None, "d"), (11, None), (3, ""), (8, "\n"), (8, "e\r\né"), (10 ** 11, "e\r\né"), (1, "x" * 3_000_000)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    key = "stream_document_files"
    status, n, _, note = compare(spark, con, str(tmp_path), key, QUERIES[key], CHECKS[key])
    assert (status, n) == ("ok", 8), note


def test_small_files_share_a_task(spark, tmp_path):
    """Each small file counted as 4 MB, so that a task read three or four."""
    for n in range(300):
        (tmp_path / str(n)).write_text("x")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16m")
    try:
        with readers.many_files(spark):
            assert readers.scan_document_files(spark, str(tmp_path)).rdd.getNumPartitions() <= 16
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_a_folder_is_taken_up_once(spark, tmp_path):
    """Nothing of an earlier arrival is listed or read again, and unfinished files aren't read."""
    announced, out = str(tmp_path / "announced"), str(tmp_path / "out")
    for k in range(2):
        rows = spark.createDataFrame([(f"{i}", f"{i % 7} {k * (i % 2)}") for i in range(k * 40, k * 40 + 40)], "name string, value string")
        rawfiles.write_texts(rows, str(tmp_path / f"in{k}"), announced)
        next((tmp_path / f"in{k}").iterdir()).joinpath(".unfinished").write_text("y")
        files = rawfiles.stream_folders(spark, announced).withColumn("doc_id", F.regexp_extract("path", r"([0-9]+)$", 1).cast("long"))
        U.stream_first_uploads(files, out, buckets=4, of_content=("length",))
        (tmp_path / f"in{k}").rename(tmp_path / f"taken{k}")
    got = {(x.doc_id, x.length, x.batch_id) for x in spark.read.parquet(f"{out}/first").collect()}
    assert got == {(i, 4, 0) for i in range(7)} | {(i, 4, 1) for i in range(41, 55, 2)}


def test_arrivals_are_derived_once(spark):
    """A batch number costs no pass of its own over the rows."""
    passes = spark.sparkContext.accumulator(0)
    rows = spark.range(90, numPartitions=1).rdd.map(lambda r: (passes.add(1), (r[0],))[1]).toDF("id long")
    parts = streams._parts(spark, rows, F.when(F.col("id") < 80, F.col("id") % 3), 3)
    assert [p.count() for p in parts] == [27, 27, 26] and passes.value == 90
