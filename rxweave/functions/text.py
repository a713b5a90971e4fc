"""Small text helpers shared by the column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: All decimal digits of the basic plane but 0-9, and their values.
DIGITS = tuple("".join(x) for x in zip(*((chr(c), str(unicodedata.decimal(chr(c)))) for c in range(0x80, 0x10000) if unicodedata.decimal(chr(c), None) is not None)))

WHITESPACE = " \t\n\r\x0b\x0c"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def regex(pattern: str) -> str:
    """Turn on Unicode word, digit and space classes, so that accented words
    keep their word boundaries."""
    return "(?iU)" + pattern[4:] if pattern.startswith("(?i)") else "(?U)" + pattern


def has(text: Column, pattern: str) -> Column:
    return F.rlike(text, F.lit(regex(pattern)))


def grab(text: Column, pattern: str, group: int = 1) -> Column:
    """First match, NULL when there is none (or it is empty)."""
    return F.nullif(F.regexp_extract(text, regex(pattern), group), F.lit(""))


def drop(text: Column, pattern: str, replacement: str = "") -> Column:
    return F.regexp_replace(text, regex(pattern), replacement)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def lines(text: Column, pattern: str = LINE_BREAK) -> Column:
    """Non-blank lines of a text, trimmed, in order."""
    return F.filter(F.transform(F.split(text, pattern), strip), lambda line: line != "")


def plain_digits(text: Column) -> Column:
    """Decimal digits of other scripts as 0-9, so that what a digit class matches can be read as a number."""
    return F.translate(text, DIGITS[0], DIGITS[1])


def first(array: Column) -> Column:
    """First element, NULL for an empty array."""
    return F.try_element_at(array, F.lit(1))


def lookup(key: Column, table: dict) -> Column:
    """Value of a small literal map, NULL for an unknown key."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def first_case(cases, default=None) -> Column:
    """Ordered choice: the value of the first condition that holds."""
    result = None
    for condition, value in cases:
        value = value if isinstance(value, Column) else F.lit(value)
        result = F.when(condition, value) if result is None else result.when(condition, value)
    return result if default is None else result.otherwise(F.lit(default))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column whose conditions stay above it: they read the value and never compute it again."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)
