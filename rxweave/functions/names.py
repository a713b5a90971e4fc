"""Name, number and date clean-up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rxweave.functions.text import drop, first_case, strip
from rxweave.refdata import prescribing as P
from rxweave.refdata import signals as S


def clean_name(raw: Column) -> Column:
    """Drug name in lower case without form prefix and trailing dose."""
    name = drop(strip(F.lower(raw)), P.CLEAN_FORM_PATTERN)
    return strip(drop(name, P.CLEAN_DOSAGE_PATTERN))


def first_word(name: Column) -> Column:
    return F.element_at(F.split(name, r"\s+"), 1)


def normalize_registration(raw: Column) -> Column:
    return F.nullif(F.regexp_replace(F.upper(raw), "[^A-Z0-9]", ""), F.lit(""))


def speciality_group(speciality: Column) -> Column:
    low = F.lower(speciality)
    cases = [(low.contains(word), group) for word, group in S.SPECIALITY_GROUPS]
    return F.when(speciality.isNull() | (speciality == ""), F.lit(None).cast("string")).otherwise(
        first_case(cases, S.SPECIALITY_DEFAULT))


def parse_date(raw: Column, formats: list[str] = P.DATE_FORMATS) -> Column:
    """First format that parses; month names in any case; NULL otherwise."""
    tidy = F.initcap(strip(raw))
    return F.coalesce(*[F.try_to_date(tidy, f) for f in formats])


def fdc_components(inn: Column) -> Column:
    """Parts of a fixed-dose combination, NULL for a single drug."""
    parts = F.transform(F.split(inn, r"\+"), strip)
    return F.when(inn.contains("+"), parts)


def dosage_text(value: Column, unit: Column) -> Column:
    """"500.0 mg", or NULL when nothing is known; a zero dose counts as unknown."""
    shown = F.when(value != 0, value.cast("string"))
    return F.nullif(strip(F.concat_ws(" ", F.coalesce(shown, F.lit("")), F.coalesce(unit, F.lit("")))), F.lit(""))


def title(text: Column) -> Column:
    return F.initcap(text)
