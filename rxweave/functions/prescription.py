"""Column expressions that read one line or one text of a prescription."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from rxweave.functions.text import bind, drop, first_case, grab, has, lines, lookup, plain_digits, strip
from rxweave.refdata import prescribing as P

EDGE_NOISE = r"[\s\-–•*#.:,;()]+"
PLAIN_EDGE_NOISE = " -*#.:,;()"


def fix_ocr_digits(text: Column) -> Column:
    fixed = reduce(lambda c, fix: F.regexp_replace(c, fix[0], fix[1]), P.DIGIT_FIXES, text)
    return F.when(has(text, P.MISREAD_DIGIT), fixed).otherwise(text)


def has_frequency(text: Column) -> Column:
    return has(text, P.ANY_FREQUENCY)


def frequency_text(text: Column) -> Column:
    return F.when(has_frequency(text), _ordered_frequency(text))


def _ordered_frequency(text: Column) -> Column:
    return first_case([(has(text, p), name) for p, name, _ in P.FREQUENCIES])


def frequency_rate(text: Column) -> Column:
    return first_case([(has(text, p), rate) for p, _, rate in P.FREQUENCIES])


def rate_of(frequency: Column) -> Column:
    """Times per day of a frequency text produced by ``frequency_text``."""
    return lookup(frequency, {name: rate for _, name, rate in P.FREQUENCIES})


NUMBER = r"\b(\d+(?:\.\d+)?)\b"


def dosage_value(text: Column, timed: Column | None = None) -> Column:
    """Number with a unit, else any number when a frequency is present."""
    timed = has_frequency(text) if timed is None else timed
    return plain_digits(F.coalesce(grab(text, P.DOSAGE_PATTERN, 1), F.when(timed, grab(text, NUMBER)))).try_cast("double")


def dosage_unit(text: Column, timed: Column | None = None) -> Column:
    timed = has_frequency(text) if timed is None else timed
    return F.coalesce(
        lookup(F.lower(grab(text, P.DOSAGE_PATTERN, 2)), P.UNITS),
        F.when(timed & has(text, NUMBER), F.lit(P.IMPLIED_UNIT)),
    )


def duration_days(text: Column) -> Column:
    """Days of the first duration found; NULL for one beyond ``P.LONGEST_DURATION``, which no date can follow."""
    days = F.coalesce(*[F.try_multiply(plain_digits(grab(text, p)).try_cast("long"), F.lit(days).cast("long")) for p, days in P.DURATIONS])
    return F.when(days <= P.LONGEST_DURATION, days.cast("int"))


def route(text: Column) -> Column:
    return F.coalesce(lookup(F.lower(grab(text, P.ROUTE_PATTERN)), P.ROUTES), F.lit(P.DEFAULT_ROUTE))


def drug_name(line: Column) -> Column:
    """What is left of a line once form, dose, frequency, duration and route
    are taken out; NULL when it is too short or only a number.

    A line whose parts cannot meet is read in one pass for all frequencies and
    one for all durations, any other pattern by pattern; both give the same name.
    """
    name = F.when(has(line, P.NUMBERED_PATTERN), strip(drop(line, P.NUMBERED_PATTERN))).otherwise(line)
    name = reduce(drop, [P.FORM_PATTERN, P.DOSAGE_PATTERN], name)
    keep = lambda n: F.when((F.length(n) >= 3) & ~has(n, r"(?i)^\d+(\.\d+)?\s*(mg|ml|mcg|g|iu)?$"), n)
    return bind(F.when(_parts_apart(line), _name_at_once(name)).otherwise(_name_in_turn(name)), keep)


def _parts_apart(line: Column) -> Column:
    """Plain text with neither a shape such as 1-0-1 nor a phrase nor two kinds of duration.

    What is taken out of such a line ends where no letter or digit follows, so
    that no word comes into being, and no two patterns find the same word.
    """
    day, week, month = [F.contains(F.lower(line), F.lit(w)) for w in P.DURATION_WORDS]
    shape = F.contains(line, F.lit("-0")) | F.contains(line, F.lit("-1"))
    return has(line, P.PLAIN_PATTERN) & ~shape & ~has(line, P.PHRASE_PATTERN) & ~(day & (week | month)) & ~(week & month)


def _name_at_once(text: Column) -> Column:
    """For plain text, in which a space is the only white space and Unicode classes are not needed."""
    patterns = [P.ONE_WORD_FREQUENCY, P.ANY_DURATION, P.ROUTE_PATTERN, r" +\d+(?:\.\d+)? *$"]
    name = F.btrim(reduce(lambda t, p: F.regexp_replace(t, p, ""), patterns, text), F.lit(PLAIN_EDGE_NOISE))
    return F.rtrim(reduce(lambda n, end: F.substring_index(n, end, 1), ["/", "+", "  "], name))


def _name_in_turn(text: Column) -> Column:
    """The frequency patterns are only applied where one combined test finds any."""
    name = bind(text, lambda t: F.when(has_frequency(t), reduce(drop, [p for p, _, _ in P.FREQUENCIES], t)).otherwise(t))
    name = strip(reduce(drop, [p for p, _ in P.DURATIONS] + [P.ROUTE_PATTERN], name))
    name = strip(drop(name, r"\s+\d+(\.\d+)?\s*$"))
    name = drop(drop(name, "^" + EDGE_NOISE), EDGE_NOISE + "$")
    return strip(drop(name, r"(?:\s{2,}|/|\+)[\s\S]*"))


def is_medication_line(line: Column) -> Column:
    has_dose = has(line, P.DOSAGE_PATTERN)
    has_form = has(line, P.FORM_PATTERN)
    rejected = (
        has(line, P.NON_MEDICATION_PATTERN)
        | (has(line, P.BARE_LABEL_PATTERN) & ~has_dose & ~has_form)
        | (F.length(F.regexp_replace(line, "[^A-Za-z]", "")) < 5)
    )
    accepted = (
        has_dose
        | has_form
        | has(line, P.NUMBERED_PATTERN)
        | (has(line, r"\b\d+\b") & has_frequency(line))
        | has(line, P.KNOWN_DRUGS_PATTERN)
    )
    return ~rejected & accepted


def medication(line: Column) -> Column:
    """One line as a medication struct; ``raw_drug_name`` NULL drops it."""
    def build(fixed: Column) -> Column:
        return bind(frequency_text(fixed), lambda freq: F.struct(
            drug_name(fixed).alias("raw_drug_name"),
            dosage_value(fixed, freq.isNotNull()).alias("dosage_value"),
            dosage_unit(fixed, freq.isNotNull()).alias("dosage_unit"),
            freq.alias("frequency"),
            rate_of(freq).alias("freq_per_day"),
            duration_days(fixed).alias("duration_days"),
            route(fixed).alias("route"),
        ))
    return bind(fix_ocr_digits(line), build)


def registration(line: Column) -> Column:
    return grab(line, P.REGISTRATION_PATTERN)


def age(line: Column) -> Column:
    years = F.coalesce(grab(line, P.AGE_PATTERN, 1), grab(line, P.AGE_PATTERN, 2))
    return F.concat(years, F.lit(" yrs"))


def written_date(line: Column) -> Column:
    return strip(grab(line, P.DATE_PATTERN, 0))


def diagnosis(line: Column) -> Column:
    return strip(grab(line, P.DIAGNOSIS_PATTERN))


def first_of(line_array: Column, extract) -> Column:
    """First non-NULL value of an extractor over the lines; later lines are not searched."""
    return F.aggregate(line_array, F.lit(None).cast("string"), lambda found, line: F.coalesce(found, extract(line)))


def medications_of(line_array: Column) -> Column:
    found = F.transform(F.filter(line_array, is_medication_line), medication)
    return F.filter(found, lambda m: m["raw_drug_name"].isNotNull())


def without_registration_line(line_array: Column) -> Column:
    """The first line with a registration number carries nothing else."""
    found = F.array_position(F.transform(line_array, lambda l: has(l, P.REGISTRATION_PATTERN)), True)
    return bind(found, lambda hit: F.when(hit == 0, line_array).otherwise(F.filter(line_array, lambda _, i: i + 1 != hit)))


def text_lines(text: Column) -> Column:
    return lines(text)


def confidence(n_meds: Column, name_chars: Column, reg: Column, diag: Column, date: Column, years: Column) -> Column:
    """Sum of the evidence found in a prescription, clamped to [0, 1].

    ``name_chars`` is the total length of the drug names.
    """
    add = lambda flag, amount: F.when(flag, F.lit(amount)).otherwise(F.lit(0.0))
    score = (
        F.when(n_meds > 0, F.lit(P.CONFIDENCE_WITH_MEDS)).otherwise(F.lit(P.CONFIDENCE_WITHOUT_MEDS))
        + add(reg.isNotNull(), P.CONFIDENCE_REGISTRATION)
        + add(diag.isNotNull(), P.CONFIDENCE_DIAGNOSIS)
        + add(date.isNotNull(), P.CONFIDENCE_DATE)
        + add(years.isNotNull(), P.CONFIDENCE_AGE)
        + add((n_meds > 0) & (name_chars < n_meds * P.SHORT_NAME_LENGTH), P.CONFIDENCE_SHORT_NAMES)
    )
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)), 4)
