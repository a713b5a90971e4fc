"""Column expressions that tidy JSON payloads of models and services."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rxweave.functions.text import bind, drop, strip
from rxweave.refdata import corpus as C

_HEADER = [*C.CLINICAL_FIELDS]
_MAP = "map<string,string>"


def strip_fences(raw: Column) -> Column:
    """Payload text without Markdown fences; NULL when it is not JSON."""
    text = strip(drop(drop(strip(raw), r"(?i)^```(?:json)?\s*"), r"\s*```$"))
    return bind(text, lambda t: F.when(F.try_parse_json(t).isNotNull(), t))


def _with_header(payload: Column, names: list[str], body) -> Column:
    """``body`` of the named fields; the payload is read once, not once per field."""
    read = F.from_json(payload, "struct<" + ",".join(f"{n}:string" for n in names) + ">")
    return bind(read, lambda r: body({n: r[n] for n in names}))


def _objects(json_list: Column) -> Column:
    """The objects of a JSON list as string maps; other elements are skipped."""
    items = F.coalesce(F.from_json(json_list, "array<string>"), F.array().cast("array<string>"))
    kept = F.filter(items, lambda i: F.startswith(F.ltrim(i), F.lit("{")))
    return F.transform(kept, lambda i: F.from_json(i, _MAP))


def medication_maps(payload: Column) -> Column:
    """Medications of a payload as string maps: a list, one object, or a list
    of objects wrapped in ``el``."""
    block = F.from_json(payload, "struct<medications:string>")["medications"]
    single = bind(block, lambda b: F.when(F.startswith(F.ltrim(b), F.lit("{")), F.concat(F.lit("["), b, F.lit("]"))).otherwise(b))
    return F.transform(_objects(single), lambda m: F.coalesce(F.from_json(F.try_element_at(m, F.lit("el")), _MAP), m))


def _medication(m: Column, name: Column) -> Column:
    get = lambda key: F.try_element_at(m, F.lit(key))
    route = F.when(F.map_contains_key(m, "route"), get("route")).otherwise(F.lit("oral"))
    return F.struct(
        name.alias("raw_drug_name"), get("dosage_value").try_cast("double").alias("dosage_value"),
        get("dosage_unit").alias("dosage_unit"), get("frequency").alias("frequency"),
        get("freq_per_day").try_cast("int").alias("freq_per_day"), get("duration_days").try_cast("int").alias("duration_days"),
        route.alias("route"), get("instructions").alias("instructions"))


def _payload(payload: Column, default_confidence: float, name_of, mode: str) -> Column:
    meds = F.transform(medication_maps(payload), lambda m: _medication(m, name_of(m)))
    return _with_header(payload, _HEADER + ["confidence"], lambda head: F.struct(
        *[head[n].alias(n) for n in _HEADER],
        meds.alias("medications"),
        F.coalesce(head["confidence"].try_cast("double"), F.lit(default_confidence)).alias("confidence"),
        F.lit(mode).alias("extractor_mode")))


def normalize_rx_json(payload: Column, mode: str = C.SERVICE_MODE) -> Column:
    name_of = lambda m: F.coalesce(F.try_element_at(m, F.lit("drug_name")), F.lit(""))
    return _payload(payload, C.SERVICE_CONFIDENCE, name_of, mode)


def normalize_model_json(payload: Column) -> Column:
    get = lambda m, key: F.nullif(F.try_element_at(m, F.lit(key)), F.lit(""))
    name_of = lambda m: F.coalesce(get(m, "drug_name"), get(m, "raw_drug_name"), F.lit(""))
    return _payload(payload, C.MODEL_CONFIDENCE, name_of, C.MODEL_MODE)


def has_content(record: Column) -> Column:
    """At least one clinical field or one medication was read."""
    return F.coalesce(*[record[n] for n in _HEADER]).isNotNull() | (F.size(record["medications"]) > 0)


def normalize_lab_json(payload: Column) -> Column:
    maps = _objects(F.from_json(payload, "struct<results:string>")["results"])
    get = lambda m, key: F.try_element_at(m, F.lit(key))
    value = lambda m: F.when(F.map_contains_key(m, "value"), get(m, "value").try_cast("double")).otherwise(F.lit(0.0))

    def flag(m: Column) -> Column:
        low = F.lower(get(m, "flag"))
        return F.when(low.isin("high", "low", "normal"), low).otherwise("normal")

    kept = F.filter(maps, lambda m: value(m).isNotNull())
    rows = F.transform(kept, lambda m: F.struct(
        F.coalesce(get(m, "test_name"), F.lit("")).alias("raw_name"),
        F.coalesce(get(m, "analyte_name"), F.lit(C.ANALYTE_DEFAULT)).alias("analyte_name"),
        value(m).alias("value"), get(m, "unit").alias("unit"), get(m, "ref_range").alias("ref_range"), flag(m).alias("flag")))
    names = ["lab_name", "patient_name", "patient_age", "report_date", "clinical_notes", "confidence"]
    return _with_header(payload, names, lambda head: F.struct(
        F.coalesce(head["lab_name"], F.lit("Unknown Diagnostics")).alias("lab_name"),
        head["patient_name"].alias("patient_name"), head["patient_age"].alias("patient_age"),
        head["report_date"].alias("report_date"), rows.alias("results"), head["clinical_notes"].alias("clinical_notes"),
        F.coalesce(head["confidence"].try_cast("double"), F.lit(C.SERVICE_CONFIDENCE)).alias("confidence")))


def render_alert(template: Column, value: Column, unit: Column, threshold: Column, decimals: int = 2) -> Column:
    """Fill the value, unit and threshold of an alert text."""
    shown = F.format_string(f"%.{decimals}f", value)
    limit = F.coalesce(F.format_string("%.2f", threshold), F.lit(""))
    limit = F.when(threshold.isNull(), F.lit("")).otherwise(limit)
    text = F.replace(F.coalesce(template, F.lit("")), F.lit("{value}"), shown)
    return F.replace(F.replace(text, F.lit("{unit}"), F.coalesce(unit, F.lit(""))), F.lit("{threshold}"), limit)
