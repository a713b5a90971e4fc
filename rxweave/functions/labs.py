"""Column expressions that read a lab report."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rxweave.functions.text import bind, drop, first, grab, has, lines, plain_digits
from rxweave.refdata import analytes as A


def report_lines(text: Column) -> Column:
    return lines(text, "\n")


def lab_name(line_array: Column) -> Column:
    hits = F.filter(F.transform(line_array, lambda l: grab(l, A.LAB_NAME_PATTERN)), lambda v: v.isNotNull())
    return F.coalesce(F.initcap(first(hits)), F.lit(A.LAB_NAME_DEFAULT))


def lab_date(text: Column, line_array: Column) -> Column:
    """Date on a line about a date or report, else the first date anywhere."""
    marked = F.filter(line_array, lambda l: F.lower(l).rlike("|".join(A.LAB_DATE_WORDS)))
    dates = F.filter(F.transform(marked, lambda l: grab(l, A.LAB_DATE_PATTERN, 0)), lambda v: v.isNotNull())
    return F.coalesce(first(dates), grab(text, A.LAB_DATE_PATTERN, 0))


def lab_value(line: Column) -> Column:
    """First number that is not part of a date, a range or a threshold."""
    rest = drop(drop(drop(line, A.LAB_DATE_PATTERN), A.RANGE_PATTERN), A.THRESHOLD_PATTERN)
    return plain_digits(grab(rest, A.VALUE_PATTERN)).try_cast("double")


def lab_flag(value: Column, low_below: Column, high_above: Column, high_from: Column) -> Column:
    """high / low / normal from limits that may be NULL."""
    high = F.coalesce(value > high_above, F.lit(False)) | F.coalesce(value >= high_from, F.lit(False))
    low = F.coalesce(value < low_below, F.lit(False))
    return F.when(high, "high").when(low, "low").otherwise("normal")


def results(line_array: Column) -> Column:
    """One struct per analyte: its first line that yields a number."""
    numbered = F.filter(
        F.transform(line_array, lambda l: F.struct(l.alias("line"), lab_value(l).alias("value"))),
        lambda x: x["value"].isNotNull())

    def one(rule, rows: Column) -> Column:
        _, name, pattern, unit, ref, low, above, since = rule
        hit = F.filter(rows, lambda x: has(x["line"], "(?i)" + pattern))
        limit = lambda v: F.lit(v).cast("double")
        return F.transform(F.slice(hit, 1, 1), lambda x: F.struct(
            x["line"].alias("raw_name"), F.lit(name).alias("analyte_name"), x["value"].alias("value"),
            F.lit(unit).alias("unit"), F.lit(ref).alias("ref_range"),
            lab_flag(x["value"], limit(low), limit(above), limit(since)).alias("flag")))

    return bind(numbered, lambda rows: F.flatten(F.array(*[one(rule, rows) for rule in A.ANALYTES])))


def confidence(report_date: Column, n_results: Column) -> Column:
    score = (
        F.lit(1.0)
        - F.when(report_date.isNull(), F.lit(A.NO_DATE_PENALTY)).otherwise(F.lit(0.0))
        - F.when(n_results == 0, F.lit(A.NO_RESULT_PENALTY)).otherwise(F.lit(0.0))
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(score, 4)))


def route_reason(report_date: Column, n_results: Column) -> Column:
    return (
        F.when(report_date.isNull(), F.lit(A.REASON_NO_DATE))
        .when(n_results == 0, F.lit(A.REASON_NO_RESULTS))
        .otherwise(F.lit(A.REASON_LOW_CONFIDENCE))
    )
