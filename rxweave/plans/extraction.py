"""Documents to medications and lab results, without any shuffle.

A document's lines stay in an array beside its key, so headers, medication
lines and the confidence of a document come out of one narrow projection;
rows are only exploded where a row per line is the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxweave.functions import labs as L
from rxweave.functions import payloads as J
from rxweave.functions import prescription as P
from rxweave.functions.text import once
from rxweave.refdata import corpus as C

HEADER = ["doctor_reg", "patient_age", "prescription_date", "diagnosis"]


def extract_prescriptions(docs: DataFrame) -> DataFrame:
    """Add header fields, the medication array and the confidence."""
    lines = docs.withColumn("_lines", P.text_lines(F.col("text")))
    rest = lines.withColumn("_rest", P.without_registration_line(F.col("_lines")))
    read = rest.withColumns({
        "doctor_reg": P.first_of(F.col("_lines"), P.registration),
        "patient_age": P.first_of(F.col("_rest"), P.age),
        "prescription_date": P.first_of(F.col("_rest"), P.written_date),
        "diagnosis": P.first_of(F.col("_rest"), P.diagnosis),
        "medications": P.medications_of(F.col("_rest")),
    })
    chars = F.aggregate("medications", F.lit(0), lambda n, m: n + F.length(m["raw_drug_name"]))
    score = P.confidence(F.size("medications"), chars, *[F.col(c) for c in ("doctor_reg", "diagnosis", "prescription_date", "patient_age")])
    return read.withColumn("confidence", score).drop("_lines", "_rest")


def medication_rows(extracted: DataFrame, *keep: str) -> DataFrame:
    """One row per medication. The outer form keeps the optimizer from adding a
    size test below, which would parse every text a second time."""
    rows = extracted.select(*keep, F.posexplode_outer("medications").alias("line_no", "m"))
    return rows.where(F.col("line_no").isNotNull()).select(*keep, "line_no", "m.*")


def parse_lines(lines: DataFrame, *keep: str) -> DataFrame:
    """Medication rows of a table that holds one text line per row (``line``)."""
    found = P.medications_of(F.array("line"))
    rows = lines.select(*keep, F.explode_outer(found).alias("m"))
    return rows.where(F.col("m").isNotNull()).select(*keep, "m.*")


def extract_labs(docs: DataFrame) -> DataFrame:
    """Add lab name, date, result array and confidence."""
    lines = docs.withColumn("_lines", L.report_lines(F.col("text")))
    read = lines.withColumns({
        "lab_name": L.lab_name(F.col("_lines")),
        "report_date": L.lab_date(F.col("text"), F.col("_lines")),
        "results": L.results(F.col("_lines")),
    })
    n = F.size("results")
    return read.withColumn("n_results", n).withColumn("confidence", L.confidence(F.col("report_date"), n)).drop("_lines")


def lab_rows(extracted: DataFrame, *keep: str) -> DataFrame:
    rows = extracted.select(*keep, F.explode_outer("results").alias("r"))
    return rows.where(F.col("r").isNotNull()).select(*keep, "r.*")


def model_records(payloads: DataFrame) -> DataFrame:
    """Tidy model answers; answers without any content are dropped."""
    clean = once(payloads, "_json", J.strip_fences(F.col("raw"))).where(F.col("_json").isNotNull())
    return once(clean, "record", J.normalize_model_json(F.col("_json"))).where(J.has_content(F.col("record"))).drop("_json")


def choose_extractor(docs: DataFrame, service: DataFrame, model: DataFrame) -> DataFrame:
    """Best available result per document (doc_id, text): service, then model, then rules.

    ``service`` and ``model``: doc_id, medications_found, confidence,
    extractor_mode. Rules read the texts that neither of them answered.
    """
    fields = ["medications_found", "confidence", "extractor_mode"]
    packed = lambda df, name: df.select("doc_id", F.struct(*fields).alias(name))
    joined = (
        docs.select("doc_id", "text").join(packed(service, "_s"), "doc_id", "left").join(packed(model, "_m"), "doc_id", "left")
        .select("doc_id", "text", F.coalesce("_s", "_m").alias("_given")))
    read = extract_prescriptions(joined.withColumn("text", F.when(F.col("_given").isNull(), F.col("text"))))
    rules = F.struct(F.size("medications").alias("medications_found"), F.col("confidence"), F.lit(C.RULES_MODE).alias("extractor_mode"))
    return read.select("doc_id", F.coalesce("_given", rules).alias("x")).select("doc_id", "x.*")


def queue_drafts(items: DataFrame) -> DataFrame:
    """Draft per queue item: its stored JSON when it is one with medications,
    else the rules extraction of its text.

    Columns in: item_id, raw_text. Only texts that are not JSON are parsed,
    and all items are read in one pass.
    """
    text = F.trim("raw_text")
    looks_json = F.startswith(text, F.lit("{")) & F.endswith(text, F.lit("}"))
    payload = F.when(looks_json & F.try_parse_json(text).isNotNull(), text)
    has_meds = F.array_contains(F.json_object_keys(payload), "medications")
    split = once(items, "_payload", F.when(has_meds, payload))
    is_json = F.col("_payload").isNotNull()
    parsed = extract_prescriptions(split.select("item_id", "_payload", F.when(~is_json, F.col("raw_text")).alias("text")))
    stored = F.coalesce(F.get_json_object("_payload", "$.confidence").try_cast("double"), F.lit(C.SERVICE_CONFIDENCE))
    return parsed.select(
        "item_id", F.when(is_json, "json").otherwise("rules").alias("origin"),
        F.when(is_json, F.size(J.medication_maps(F.col("_payload")))).otherwise(F.size("medications")).alias("n_meds"),
        F.when(is_json, stored).otherwise(F.col("confidence")).alias("confidence"))
