"""Domain tables as deterministic projections of the given tables.

The given data is a general star schema; these functions read it as clinical
tables. A deployment with real clinical tables skips this module and hands its
own DataFrames to the operators.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rxweave.functions.labs import lab_flag
from rxweave.refdata import events as E
from rxweave.refdata.tables import analyte_rules, local_table

CATALOG = [
    "metformin", "warfarin", "ibuprofen", "aspirin", "atorvastatin", "clarithromycin",
    "levothyroxine", "ramipril", "spironolactone", "sertraline", "tramadol", "omeprazole",
    "clopidogrel", "methotrexate", "amiodarone", "azithromycin", "salbutamol", "metformin + glibenclamide",
    "furosemide", "rifampicin", "insulin", "glimepiride", "paracetamol", "amlodipine",
]
BRANDS = [
    "Sugarlow", "Bloodthin", "Painaway", "Heartsafe", "Lipidown", "Claribest",
    "Thyrowell", "Pressurex", "Potasave", "Moodlift", "Tramaquik", "Gastrosafe",
    "Plateguard", "Rheumatex", "Rhythmol", "Azibest", "Breatheasy", "Sugarduo",
    "Waterlow", "Tubercure", "Insulbest", "Glimebest", "Fevernil", "Amlobest",
]
FREQUENCIES = [("once daily", 1), ("twice daily", 2), ("three times daily", 3), ("as needed", 0)]
SPECIALITIES = [
    "Cardiologist", "Cardiovascular Surgery", "Pulmonology", "Neurology", "Psychiatry",
    "General Medicine", "Nephrology", "Rheumatology", "Gastroenterology", "Dental",
]
SCOPES = ["rx", "lab", "both"]
REACTION_TYPES = ["allergy", "intolerance", "adr", "contraindication", "unknown"]
REACTION_SEVERITIES = ["mild", "moderate", "severe", "life_threatening"]
AS_OF_RX = dt.date(2001, 8, 1)

# event_type, parity of event_id, analyte, base, step, steps (hundredths)
LAB_BINDING = [
    ("purchase", 0, "HBA1C", 400, 10, 100),
    ("purchase", 1, "FASTING_BLOOD_SUGAR", 5000, 100, 150),
    ("view", 0, "CREATININE", 40, 1, 200),
    ("view", 1, "LDL", 6000, 100, 120),
    ("click", 0, "HEMOGLOBIN", 700, 10, 100),
    ("click", 1, "TRIGLYCERIDES", 8000, 100, 200),
    ("error", 0, "TSH", 10, 1, 800),
    ("error", 1, "TLC", 200, 1, 900),
    ("signup", 0, "PLATELET_COUNT", 5000, 100, 300),
    ("signup", 1, "NEUTROPHILS", 2000, 100, 60),
]
EVENT_TYPES = sorted(E.REQUIRED_KEYS)
OVERSIGHT_TYPES = ["error", "purchase"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def pick(values: list, index: Column) -> Column:
    """Element of a literal list at ``index`` modulo its length."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def patients(spark, sf) -> DataFrame:
    return read(spark, sf, "customer").select(
        F.col("c_custkey").alias("patient_id"), F.col("c_name").alias("phone"), F.col("c_nationkey").alias("facility_id"))


def facilities(spark, sf) -> DataFrame:
    return read(spark, sf, "nation").select(F.col("n_nationkey").alias("facility_id"), F.col("n_name").alias("name"))


def prescriptions(spark, sf) -> DataFrame:
    key = F.col("o_orderkey")
    return read(spark, sf, "orders").select(
        key.alias("rx_id"), F.col("o_custkey").alias("patient_id"), F.to_date("o_orderdate").alias("created_at"),
        ((key % 100) / F.lit(100.0)).alias("confidence"))


def medication_lines(spark, sf) -> DataFrame:
    return medication_line_rows(read(spark, sf, "lineitem"))


def medication_line_rows(lineitem: DataFrame) -> DataFrame:
    """Medication lines without their prescription."""
    part, line = F.col("l_partkey"), F.col("l_linenumber")
    return lineitem.select(
        F.col("l_orderkey").alias("rx_id"), line.alias("line_no"),
        pick(CATALOG, part).alias("inn"), pick(BRANDS, part).alias("raw_drug_name"),
        F.col("l_quantity").alias("dosage_value"), F.lit("mg").alias("dosage_unit"),
        pick([f for f, _ in FREQUENCIES], line).alias("frequency"),
        pick([n for _, n in FREQUENCIES], line).alias("freq_per_day"),
        F.when(F.col("l_returnflag") == "A", 7).when(F.col("l_returnflag") == "R", 30).alias("duration_days"),
        F.when(line % 5 != 0, F.lit("oral")).alias("route"),
        F.col("l_suppkey").alias("doctor_id"), (line % 7 != 0).alias("is_active"))


def dated_medications(spark, sf) -> DataFrame:
    """Medication lines with the patient and date of their prescription."""
    rx = prescriptions(spark, sf).select("rx_id", "patient_id", F.col("created_at").alias("rx_date"))
    return medication_lines(spark, sf).join(rx, "rx_id")


def doctors(spark, sf) -> DataFrame:
    key = F.col("s_suppkey")
    return read(spark, sf, "supplier").select(
        key.alias("doctor_id"), F.col("s_name").alias("name"), F.concat(F.lit("MH - "), key).alias("registration_number"),
        pick(SPECIALITIES, key).alias("speciality"))


def doctor_mentions(spark, sf) -> DataFrame:
    """Doctor details as read from prescription lines, noisy and incomplete."""
    key, line = F.col("l_suppkey"), F.col("l_linenumber")
    reg = (F.when(line % 4 == 0, F.concat(F.lit("mh-"), key)).when(line % 4 == 1, F.concat(F.lit("MH - "), key))
           .when(line % 4 == 2, F.concat(F.lit("M.H. "), key)))
    name = F.when(line % 7 < 3, F.concat(F.lit("Dr S"), key)).when(line % 7 < 5, F.concat(F.lit("DR. S"), key))
    return read(spark, sf, "lineitem").select(
        reg.alias("reg_number"), name.alias("name"),
        F.when(line % 3 == 0, pick(SPECIALITIES, key)).alias("speciality"),
        F.col("l_orderkey").alias("seen_order"), line.alias("seen_line"))


def lab_results(spark, sf) -> DataFrame:
    """Lab result rows with the columns of their report."""
    binding = local_table(spark, LAB_BINDING, {
        "event_type": "string", "parity": "bigint", "analyte_name": "string", "base": "bigint", "step": "bigint", "steps": "bigint"})
    rules = analyte_rules(spark).select("analyte_name", "unit", "ref_range", "low_below", "high_above", "high_from")
    spec = binding.join(F.broadcast(rules), "analyte_name")
    female = (F.col("analyte_name") == "CREATININE") & (F.col("user_id") % 2 == 0)
    cents = F.round(F.col("value") * 100).cast("bigint")
    rows = read(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", cents.alias("cents"), (F.col("event_id") % 2).alias("parity"))
    value = (F.col("base") + F.col("step") * (F.col("cents") % F.col("steps"))) / F.lit(100.0)
    return rows.join(F.broadcast(spec), ["event_type", "parity"]).select(
        F.col("event_id").alias("result_id"), F.col("event_id").alias("report_id"), F.col("user_id").alias("patient_id"),
        "analyte_name", value.alias("value"), "unit",
        F.when(female, F.lit("0.5 - 1.1 mg/dL")).otherwise(F.col("ref_range")).alias("ref_range"),
        lab_flag(value, F.col("low_below"), F.col("high_above"), F.col("high_from")).alias("flag"),
        F.when(F.col("event_id") % 9 != 0, F.to_date("ts")).alias("report_date"), F.col("ts").alias("created_at"))


def review_queue(spark, sf) -> DataFrame:
    key = F.col("o_orderkey")
    return read(spark, sf, "orders").where(key % 100 < 50).select(
        key.alias("item_id"), F.when(key % 13 != 0, F.col("o_custkey")).alias("patient_id"),
        F.when(key % 10 != 0, F.col("o_custkey") % 25).alias("facility_id"),
        F.when(key % 3 == 0, "lab").otherwise("prescription").alias("item_type"),
        ((key % 100) / F.lit(100.0)).alias("confidence"), (F.col("o_orderstatus") == "F").alias("resolved"),
        F.to_date("o_orderdate").alias("created_at"))


def clinicians(spark, sf) -> DataFrame:
    key = F.col("s_suppkey")
    return read(spark, sf, "supplier").select(
        key.alias("clinician_id"), F.col("s_name").alias("name"),
        F.concat(F.lower("s_name"), F.lit("@example.org")).alias("email"),
        pick(SCOPES, key).alias("scopes"), F.col("s_nationkey").alias("active_facility_id"))


def clinician_facilities(spark, sf) -> DataFrame:
    own = read(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("clinician_id"),
        F.explode(F.array(F.col("s_nationkey"), (F.col("s_nationkey") + 7) % 25)).alias("facility_id"))
    return own.distinct()


def audit_logs(spark, sf) -> DataFrame:
    return read(spark, sf, "events").select(
        F.col("event_id").alias("log_id"), F.col("user_id").alias("clinician_id"),
        (F.col("event_id") % 30).alias("facility_id"), F.col("event_type").alias("action"),
        F.col("event_type").isin(OVERSIGHT_TYPES).alias("needs_admin_oversight"), F.col("ts").alias("created_at"))


def history_events(spark, sf) -> DataFrame:
    return history_event_rows(read(spark, sf, "events"))


def history_event_rows(events: DataFrame) -> DataFrame:
    """Typed events whose payload carries only part of the required keys."""
    k = F.get_json_object("props", "$.k")
    payload = F.to_json(F.struct(
        F.col("event_type").alias("inn"), k.alias("episode_id"),
        F.when(F.col("event_id") % 3 == 0, F.col("value").cast("string")).alias("dosage"),
        F.when(F.col("event_id") % 4 == 0, F.lit("x")).alias("condition_code"),
        F.when(F.col("event_id") % 2 == 0, F.lit("y")).alias("severity")))
    return events.select(
        "event_id", pick(EVENT_TYPES, F.col("event_id")).alias("event_type"), F.lit(1).alias("payload_schema_version"),
        F.col("user_id").alias("patient_id"), payload.alias("payload"), F.col("ts").alias("created_at"))


def reactions(spark, sf) -> DataFrame:
    key = F.col("c_custkey")
    return read(spark, sf, "customer").select(
        key.alias("patient_id"), pick(CATALOG, key).alias("inn"),
        F.array(pick(CATALOG, key + 1), pick(CATALOG, key + 2)).alias("cross_reactive_inns"),
        pick(REACTION_TYPES, key).alias("reaction_type"), pick(REACTION_SEVERITIES, key).alias("severity"),
        (F.col("c_acctbal") > 0).alias("is_active"))


STORED_CODES = [("E11", "Type 2 Diabetes Mellitus", "metabolic"), ("I10", "Hypertension", "cardiovascular"),
                ("E78", "Dyslipidemia", "metabolic"), ("K21", "GERD / Peptic Ulcer", "gastrointestinal")]
STORED_STATUS = ["probable", "confirmed", "rejected", "resolved"]


def stored_conditions(spark, sf) -> DataFrame:
    """Conditions already on file: one per patient, all four statuses."""
    key = F.col("c_custkey")
    return read(spark, sf, "customer").select(
        key.alias("patient_id"), pick([c for c, _, _ in STORED_CODES], key).alias("condition_code"),
        pick([n for _, n, _ in STORED_CODES], key).alias("condition_name"),
        pick([g for _, _, g in STORED_CODES], key).alias("condition_group"),
        pick(STORED_STATUS, (key / 4).cast("bigint")).alias("status"), ((key % 50 + 50) / F.lit(100.0)).alias("confidence"))


def brand_dictionary(spark, sf) -> DataFrame:
    """Brand names and their generic names, one row per brand."""
    brands = read(spark, sf, "part").groupBy(F.lower("p_name").alias("brand_name")).agg(F.min("p_partkey").alias("k"))
    return brands.select("brand_name", pick(CATALOG, F.col("k")).alias("inn"))


def written_names(spark, sf) -> DataFrame:
    """Drug names as written: exact, misspelt, with extra words, or unknown."""
    key, name = F.col("p_partkey"), F.col("p_name")
    written = (
        F.when(key % 5 == 0, F.concat(F.lit("Tab. "), name, F.lit(" 50mg daily")))
        .when(key % 5 == 1, F.concat(F.substring(name, 1, 3), F.expr("substring(p_name, 5)")))
        .when(key % 5 == 2, F.upper(name))
        .when(key % 5 == 3, F.concat(F.lit("unlisted"), key % 7))
        .otherwise(F.concat(name, F.lit("x"))))
    return read(spark, sf, "part").select(key.alias("name_id"), written.alias("raw_drug_name"))


def medication_texts(spark, sf) -> DataFrame:
    """One written prescription line per medication line, seven styles."""
    line, brand = F.col("l_linenumber"), pick(BRANDS, F.col("l_partkey"))
    qty = F.col("l_quantity").cast("int").cast("string")
    text = (
        F.when(line == 1, F.concat(F.lit("Tab. "), brand, F.lit(" "), qty, F.lit("mg BD x 5 days")))
        .when(line == 2, F.concat(brand, F.lit(" "), qty, F.lit(" TDS")))
        .when(line == 3, F.concat(F.lit("Syp. "), brand, F.lit(" "), qty, F.lit(" ml HS for 2 weeks")))
        .when(line == 4, F.concat(F.lit("1. "), brand, F.lit(" 5O0 mg OD")))
        .when(line == 5, F.concat(F.lit("Inj. "), brand, F.lit(" "), qty, F.lit(" mcg IV stat")))
        .when(line == 6, F.concat(F.lit("Patient name: "), brand))
        .otherwise(F.concat(brand, F.lit(" Z00 my SOS x 1 month"))))
    return read(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("rx_id"), line.alias("line_no"), F.col("l_partkey").alias("part"), F.col("l_quantity").alias("qty"), text.alias("line"))


def rx_documents(spark, sf) -> DataFrame:
    return rx_document_rows(read(spark, sf, "orders"))


def rx_document_rows(orders: DataFrame) -> DataFrame:
    return orders.select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("patient_id"), _rx_text().alias("text"))


def _rx_text() -> Column:
    """One prescription text per order: header lines and up to two medications."""
    key = F.col("o_orderkey")
    dose = (key % 40 + 10).cast("string")
    header = F.concat_ws(
        "\n",
        F.when(key % 5 != 0, F.concat(F.lit("Reg. MH"), 10000 + F.col("o_custkey"))).otherwise("City Care Hospital"),
        F.when(key % 4 != 0, F.concat(F.lit("Age: "), 20 + F.col("o_custkey") % 60, F.lit(" yrs"))).otherwise("Outpatient visit"),
        F.when(key % 7 != 0, F.concat(F.lit("Date: "), F.date_format("o_orderdate", "dd/MM/yyyy"))).otherwise("No date"),
        F.when(F.col("o_orderstatus") == "F", "Diagnosis: Fever").otherwise("Clinic hours vary"))
    first = F.when(key % 3 != 0, F.concat(F.lit("Tab. "), pick(BRANDS, key), F.lit(" "), dose, F.lit("mg BD x 5 days")))
    second = F.when(key % 6 < 2, F.concat(pick(BRANDS, key + 1), F.lit(" "), dose, F.lit(" TDS")))
    return F.concat_ws("\n", header, first, second)


def lab_documents(spark, sf) -> DataFrame:
    """One lab report text per event."""
    key = F.col("event_id")
    cents = F.round(F.col("value") * 100).cast("bigint")
    number = F.concat((cents % 20).cast("string"), F.lit("."), (cents % 9 + 1).cast("string"))
    labs = pick(["Thyrocare Laboratory", "SRL Diagnostics Unit 4", "Village Hospital"], key)
    date = F.date_format("ts", "dd/MM/yyyy")
    day = F.when(key % 4 == 0, F.lit("Sample collected today")).when(key % 4 == 1, F.concat(F.lit("Sample of "), date)).otherwise(F.concat(F.lit("Report Date: "), date))
    first = F.when(key % 3 != 0, F.concat(F.lit("HbA1c "), number, F.lit(" % (4.0 - 5.6)")))
    second = F.when(key % 5 == 0, F.concat(F.lit("Serum Creatinine: "), number, F.lit(" mg/dL 0.6-1.2")))
    return read(spark, sf, "events").select(
        key.alias("doc_id"), F.col("user_id").alias("patient_id"), F.concat_ws("\n", labs, day, first, second).alias("text"))


def annotations(spark, sf) -> DataFrame:
    """One annotated training text per order."""
    key = F.col("o_orderkey")
    unit = pick(["mg", "ml", "mcg"], key)
    dose = (key % 50 + 1).cast("string")
    meds = F.concat(
        F.lit("- "), pick(BRANDS, key), F.lit(" "), dose, F.lit(" "), unit, F.lit(" - As needed - "),
        pick(BRANDS, key + 1), F.lit(" "), dose, F.lit(" mg twice daily"),
        F.when(key % 2 == 0, F.concat(F.lit(" - "), pick(BRANDS, key + 2), F.lit(" - Before meals"))).otherwise(F.lit("")))
    text = F.concat(
        F.lit("<s_ocr> doctor_name: Dr. A"), F.when(key % 3 == 0, F.concat(F.lit(" Reg: MH"), key)).otherwise(F.lit("")),
        F.lit(" clinic_name: Care Clinic clinic_address: Main Street patient_name: Patient "), F.col("o_custkey"),
        F.lit(" patient_age: "), F.col("o_custkey") % 60 + 20, F.lit(" date: "), F.date_format("o_orderdate", "yyyy-MM-dd"),
        F.lit(" medications: "), meds, F.lit(" signature: A </s>"))
    return read(spark, sf, "orders").select(key.alias("doc_id"), text.alias("ground_truth"))


def model_payloads(spark, sf) -> DataFrame:
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("patient_id"), _model_text().alias("raw"))


def queue_texts(spark, sf) -> DataFrame:
    """Text of each queue item: stored JSON for three of five items, recognised text for the rest."""
    key = F.col("o_orderkey")
    return read(spark, sf, "orders").select(key.alias("item_id"), F.when((key % 5).isin(1, 2, 4), _model_text()).otherwise(_rx_text()).alias("raw_text"))


def _model_text() -> Column:
    """Model and service answers: fenced, single object, wrapped, or broken."""
    key = F.col("o_orderkey")
    brand, dose = pick(BRANDS, key), (key % 40 + 10).cast("string")
    med = F.concat(F.lit('{"drug_name": "'), brand, F.lit('", "dosage_value": '), dose, F.lit(', "dosage_unit": "mg"}'))
    return (
        F.when(key % 5 == 0, F.concat(F.lit('```json\n{"doctor_name": "Dr A", "confidence": 0.9, "medications": ['), med, F.lit("]}\n```")))
        .when(key % 5 == 1, F.concat(F.lit('{"medications": '), med, F.lit("}")))
        .when(key % 5 == 2, F.concat(F.lit('{"medications": [{"el": '), med, F.lit('}, {"raw_drug_name": "Other", "route": "iv"}]}')))
        .when(key % 5 == 3, F.lit("the model gave no answer"))
        .otherwise(F.lit('{"medications": []}')))


def lab_payloads(spark, sf) -> DataFrame:
    key = F.col("event_id")
    cents = F.round(F.col("value") * 100).cast("bigint")
    value = (F.when(key % 4 == 0, F.concat(F.lit('"'), cents % 100, F.lit('"'))).when(key % 4 == 1, (cents % 100).cast("string"))
             .when(key % 4 == 2, F.lit("null")).otherwise(F.lit('"trace"')))
    raw = F.concat(
        F.lit('{"lab_name": "City Lab", "results": [{"test_name": "A", "analyte_name": "HBA1C", "value": '), value,
        F.lit(', "flag": "'), pick(["HIGH", "odd", "low"], key), F.lit('"}, {"test_name": "B"}]}'))
    return read(spark, sf, "events").select(key.alias("doc_id"), raw.alias("raw"))


def evaluation_documents(spark, sf) -> DataFrame:
    """One document per order with two gold medications and the predictions of
    a reader that is right, incomplete, misspelt, partly wrong or empty."""
    key = F.col("o_orderkey")
    dose = (key % 40 + 10).cast("double")

    def med(name, inn, value, freq):
        return F.struct(
            name.alias("drug_name"), name.alias("raw_drug_name"), F.lower(name).alias("clean_name"), inn.alias("inn"), value.alias("dosage_value"),
            F.lit("mg").alias("dosage_unit"), F.lit(freq).alias("frequency"), F.lit("oral").alias("route"))

    a, b = pick(BRANDS, key), pick(BRANDS, key + 12)
    ia, ib = pick(CATALOG, key), pick(CATALOG, key + 12)
    none, typo = F.lit(None).cast("double"), F.concat(F.lit("X"), F.substring(a, 2, 50))
    first, second = med(a, ia, dose, "twice daily"), med(b, ib, dose + 1, "once daily")
    pred = (
        F.when(key % 5 == 0, F.array(first, second))
        .when(key % 5 == 1, F.array(med(a, F.lit("other"), none, "twice daily"), second))
        .when(key % 5 == 2, F.array(med(typo, ia, dose, "twice daily")))
        .when(key % 5 == 3, F.array(med(F.lit("zzzz"), F.lit("other"), F.lit(999.0), "twice daily"), second))
        .otherwise(F.filter(F.array(first), lambda m: F.lit(False))))
    return read(spark, sf, "orders").select(
        key.alias("doc_id"), F.array(first, second).alias("gold"), pred.alias("pred"), ((key % 100) / F.lit(100.0)).alias("confidence"),
        F.lit("ocr").alias("extractor"), ((key % 10) / F.lit(10.0)).alias("latency_s"))


def model_documents(spark, sf) -> DataFrame:
    """The same documents read by a model that gets every second one right."""
    docs = evaluation_documents(spark, sf)
    right = F.col("doc_id") % 2 == 0
    return docs.withColumn("pred", F.when(right, F.col("gold")).otherwise(F.filter("gold", lambda m: F.lit(False)))).withColumn(
        "extractor", F.lit("model")).withColumn("latency_s", F.col("latency_s") + 1)


def field_values(spark, sf) -> DataFrame:
    """Gold and read values of three header fields for two extractors."""
    key = F.col("o_orderkey")
    gold = {
        "doctor_name": F.concat(F.lit("Dr Alpha "), key), "clinic_name": F.concat(F.lit("Care Clinic "), key % 100),
        "patient_age": F.when(key % 11 != 0, (key % 60 + 20).cast("string"))}
    base = read(spark, sf, "orders").select(key.alias("doc_id"), *[v.alias(k) for k, v in gold.items()])
    rows = base.unpivot(["doc_id"], list(gold), "field", "gold").withColumn("extractor", F.explode(F.array(F.lit("ocr"), F.lit("model"))))
    v, value = (F.col("doc_id") + F.when(F.col("extractor") == "model", 1).otherwise(0)) % 5, F.col("gold")
    read_as = (F.when(v == 0, value).when(v == 1, F.concat(F.lit("X"), F.substring(value, 2, 99)))
               .when(v == 3, F.upper(value)).when(v == 4, F.lit("qqqq")))
    return rows.select("extractor", "field", "gold", read_as.alias("pred"))


def labelled_words(spark, sf) -> DataFrame:
    """Labelled word images with the text a reader saw."""
    key, name = F.col("p_partkey"), F.col("p_name")
    seen = (F.when(key % 4 == 0, name).when(key % 4 == 1, F.concat(F.lit("X"), F.substring(name, 2, 99))).when(key % 4 == 2, F.lit("")).otherwise(F.lit("qqqq")))
    return read(spark, sf, "part").select(
        F.lpad(key.cast("string"), 12, "0").alias("image"), name.alias("word"), pick(CATALOG, key).alias("generic"), seen.alias("read"),
        F.when(key % 3 == 0, pick(CATALOG, key)).otherwise("none").alias("inn"))
