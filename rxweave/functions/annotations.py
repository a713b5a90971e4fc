"""Column expressions that read the annotated training texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rxweave.functions.text import bind, first_case, has, regex
from rxweave.refdata import corpus as C

_FIRST_LETTERS = "".join(sorted({name[0] for name in C.ANNOTATION_FIELDS}))
# the first letter is tested before the names, as most places are none
_BOUNDARY = f"(?=[{_FIRST_LETTERS}])(?:" + "|".join(f"{name}:" for name in C.ANNOTATION_FIELDS) + ")"
TRIM = " \t\r\n:-"


def clean_whitespace(text: Column) -> Column:
    """Without task tokens, single-spaced, trimmed of blanks, colons, dashes."""
    spaced = F.regexp_replace(F.regexp_replace(text, C.TASK_TOKEN_PATTERN, " "), r"(?U)\s+", " ")
    return F.btrim(spaced, F.lit(TRIM))


def annotation_field(text: Column, name: str) -> Column:
    """Text between ``name:`` and the next known field."""
    pattern = rf"(?isU)\b{name}:\s*(.*?)\s*(?={_BOUNDARY}|</s>|$)"
    return clean_whitespace(F.regexp_extract(text, pattern, 1))


def annotation_registration(doctor_name: Column) -> Column:
    return F.nullif(F.regexp_extract(doctor_name, regex(C.ANNOTATION_REG_PATTERN), 1), F.lit(""))


def frequency_per_day(text: Column) -> Column:
    hits = lambda low: first_case([(low.contains(phrase), rate) for phrase, rate in C.FREQUENCY_PER_DAY])
    return F.when(F.length(text) > 0, bind(F.lower(clean_whitespace(text)), hits))


def _item(item: Column) -> Column:
    """One list item, read as a dosed drug or an instruction."""
    part = lambda group: F.regexp_extract(item, "(?is)" + C.ANNOTATION_DOSAGE_PATTERN[4:] + "(.*)$", group)
    # the parts of an item without a dose are never used
    return bind(has(item, C.ANNOTATION_DOSAGE_PATTERN), lambda dosed: F.struct(
        item.alias("text"),
        dosed.alias("dosed"),
        F.lower(F.element_at(F.split(item, " "), 1)).isin(C.INSTRUCTION_STARTS).alias("instruction"),
        F.when(dosed, clean_whitespace(part(1))).alias("drug"),
        F.when(dosed, part(2).try_cast("double")).alias("value"),
        F.when(dosed, F.lower(part(3))).alias("unit"),
        F.when(dosed, bind(clean_whitespace(part(4)), lambda t: F.when(t != "", t))).alias("trailing"),
    ))


def annotation_medications(text: Column) -> Column:
    """Medication structs of an annotation.

    An item with a dose starts a medication; an instruction item that follows
    one becomes its frequency (the last one counts); any other item is a drug
    without a dose.
    """
    block = annotation_field(text, "medications")
    items = F.filter(F.transform(F.split(F.concat(F.lit(" "), block), r"(?U)\s+-\s+"), clean_whitespace), lambda i: i != "")
    read = F.transform(items, _item)

    def build(rows: Column) -> Column:
        starts = F.filter(
            F.transform(rows, lambda r, i: F.when((i == 0) | r["dosed"] | ~r["instruction"], i)),
            lambda i: i.isNotNull())

        def per_start(starting: Column) -> Column:
            def one(start: Column, position: Column) -> Column:
                row = F.element_at(rows, start + 1)
                after = F.coalesce(F.try_element_at(starting, position + 2), F.size(rows))
                freq = F.when(after - start > 1, F.element_at(rows, after)["text"]).otherwise(F.when(row["dosed"], row["trailing"]))
                return F.struct(
                    F.when(row["dosed"], row["drug"]).otherwise(row["text"]).alias("drug_name"),
                    F.when(row["dosed"], row["value"]).alias("dosage_value"),
                    F.when(row["dosed"], row["unit"]).alias("dosage_unit"),
                    freq.alias("frequency"),
                    frequency_per_day(freq).alias("freq_per_day"),
                    F.lit(None).cast("int").alias("duration_days"),
                    F.lit("oral").alias("route"),
                )
            return F.transform(starting, one)

        return bind(starts, per_start)

    return F.filter(bind(read, build), lambda m: m["drug_name"] != "")


def annotation_record(text: Column) -> Column:
    """The structured target of one annotation, blanks as NULL."""
    value = lambda name: bind(annotation_field(text, name), lambda v: F.when(v != "", v))
    meds = bind(annotation_medications(text), lambda m: F.when(F.size(m) > 0, m))
    return bind(value("doctor_name"), lambda doctor: F.struct(
        doctor.alias("doctor_name"),
        annotation_registration(doctor).alias("doctor_reg"),
        value("clinic_name").alias("clinic_name"),
        value("patient_name").alias("patient_name"),
        value("patient_age").alias("patient_age"),
        value("patient_gender").alias("patient_gender"),
        value("date").alias("prescription_date"),
        value("diagnosis").alias("diagnosis"),
        meds.alias("medications"),
    ))


SORTED_MED_FIELDS = ["dosage_unit", "dosage_value", "drug_name", "duration_days", "freq_per_day", "frequency", "route"]
SORTED_FIELDS = [
    "clinic_name", "diagnosis", "doctor_name", "doctor_reg", "medications", "patient_age",
    "patient_gender", "patient_name", "prescription_date",
]


def sorted_record(record: Column) -> Column:
    """The record with its keys in alphabetical order."""
    meds = F.transform(record["medications"], lambda m: F.struct(*[m[k].alias(k) for k in SORTED_MED_FIELDS]))
    return F.struct(*[(meds if k == "medications" else record[k]).alias(k) for k in SORTED_FIELDS])


def compact_json(record: Column) -> Column:
    """JSON text without NULL keys."""
    return F.to_json(record, {"ignoreNullFields": "true"})


def target_sequence(record: Column) -> Column:
    """Tagged text of a record, keys in alphabetical order."""
    tag = lambda name, value: F.when(
        value.isNotNull() & (value.cast("string") != ""),
        F.concat(F.lit(f"<s_{name}>"), value.cast("string"), F.lit(f"</s_{name}>"))).otherwise(F.lit(""))
    element = lambda m: F.concat(F.lit("<s_el>"), *[tag(k, m[k]) for k in SORTED_MED_FIELDS], F.lit("</s_el>"))
    meds = F.array_join(F.transform(record["medications"], element), "")
    parts = [tag(k, meds if k == "medications" else record[k]) for k in SORTED_FIELDS]
    return F.concat(F.lit(C.TARGET_START), *parts, F.lit(C.TARGET_END))
