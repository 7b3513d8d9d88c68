"""Standard book numbers: cleaning, check digits, conversion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(c: Column) -> Column:
    return F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9Xx]", ""))


def _once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f has it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def _sum(c: Column, n: int, weight: Callable[[int], int]) -> Column:
    """The weighted digits of the first n places; X counts ten."""
    return sum(((F.instr(F.lit("0123456789X"), F.substring(c, i, 1)) - 1) * weight(i) for i in range(1, n + 1)), F.lit(0))


def valid13(c: Column) -> Column:
    return F.when(c.rlike("^[0-9]{13}$"), _sum(c, 13, lambda i: 3 - i % 2 * 2) % 10 == 0).otherwise(False)


def valid10(c: Column) -> Column:
    return F.when(c.rlike("^[0-9]{9}[0-9X]$"), _sum(c, 10, lambda i: 11 - i) % 11 == 0).otherwise(False)


def valid(c: Column) -> Column:
    """Whether a raw value, cleaned, has a right check digit."""
    return _once(clean(c), lambda x: valid10(x) | valid13(x))


def rescued(c: Column) -> Column:
    """The cleaned number; of a longer value that isn't valid, its first 13 places if they are."""
    long = lambda x: _once(F.substring(x, 1, 13), lambda head: F.when(valid13(head), head).otherwise(x))
    return _once(clean(c), lambda x: F.when(F.length(x) > 13, long(x)).otherwise(x))


def shaped(c: Column) -> Column:
    """Whether a value has the form of a number; its check digit isn't looked at."""
    return c.rlike("^([0-9]{13}|[0-9]{9}[0-9X])$")


def to10(c: Column) -> Column:
    """The short form of a 978 number, null for others."""
    body = F.substring(c, 4, 9)
    d = (11 - _sum(body, 9, lambda i: 11 - i) % 11) % 11
    return F.when(c.rlike("^978[0-9]{10}$"), F.concat(body, F.when(d == 10, "X").otherwise(d.cast("string"))))
