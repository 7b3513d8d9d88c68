"""Text keys. Two normalisers differ: key() drops punctuation, fold() keeps it."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType


_OTHER, _MARKS = re.compile(r"[^a-z0-9]+"), re.compile("[\u0300-\u036f]+")
#: White space as Unicode has it, with the four separators U+001C to U+001F; Java's own class knows ASCII only.
SPACES = "[\\s\\x1c-\\x1f\\x85\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"


def present(c: Column) -> Column:
    """Whether a value counts as given; the empty string is the missing value."""
    return F.coalesce(c, F.lit("")) != ""


def _key(t: str | None) -> str:
    t = t or ""
    if not t.isascii():
        t = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
    return _OTHER.sub(" ", t.casefold()).strip()


def _fold(t: str | None) -> str:
    t = t or ""
    return (t if t.isascii() else _MARKS.sub("", unicodedata.normalize("NFD", t))).lower().strip()


@F.pandas_udf(StringType())
def key(t: pd.Series) -> pd.Series:
    """Compatibility decomposition without marks, case-folded, runs of other than a-z and 0-9 as one space."""
    return t.map(_key)


@F.pandas_udf(ArrayType(StringType()))
def keys(t: pd.Series) -> pd.Series:
    """key() of each of a list's texts, without empty and repeated ones, in order."""
    return t.map(lambda x: list(dict.fromkeys(k for k in map(_key, () if x is None else x) if k)))


@F.pandas_udf(StringType())
def fold(t: pd.Series) -> pd.Series:
    """Canonical decomposition without U+0300 to U+036F, lower case, trimmed; punctuation stays."""
    return t.map(_fold)


@F.pandas_udf(StringType())
def unescape(t: pd.Series) -> pd.Series:
    """HTML entities as characters."""
    return t.map(lambda x: html.unescape(x or ""))


@F.pandas_udf(StringType())
def nfc(t: pd.Series) -> pd.Series:
    return t.map(lambda x: unicodedata.normalize("NFC", x or ""))


def collapsed(c: Column) -> Column:
    """One space for each run of white space, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), SPACES, " "))


def clean_cell(c: Column) -> Column:
    """collapsed(), composed (NFC)."""
    return nfc(collapsed(c))


def holds(hay: Column, needle: str) -> Column:
    """Whether hay holds needle, without regard to case or accents; stays in the JVM."""
    return F.contains(F.collate(hay, "UNICODE_CI_AI"), F.collate(F.lit(needle.strip()), "UNICODE_CI_AI"))


def split_authors(c: Column) -> Column:
    """Names of a list packed with bars, cleaned, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\|"), collapsed), lambda x: x != "")


def first_author(c: Column) -> Column:
    """What stands before the first bar, trimmed; it may be empty."""
    return F.trim(F.substring_index(F.coalesce(c, F.lit("")), "|", 1))


YEAR = r"(?<![\p{L}\p{N}_])((18|19|20)[0-9]{2})(?![\p{L}\p{N}_])"


def parse_year(c: Column) -> Column:
    """The first year from 1800 to 2099 that stands alone."""
    return F.regexp_extract(F.coalesce(c, F.lit("")), YEAR, 1).try_cast("int")


def has_year(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(YEAR)


def years(c: Column) -> Column:
    """The distinct years of a list of texts, one of each text at most, in order of size."""
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(c, parse_year))))


def numeric_year(c: Column) -> Column:
    """The year if it is the whole value."""
    return F.when(c.rlike(r"^(18|19|20)[0-9]{2}$"), c).try_cast("int")


def decade(year: Column) -> Column:
    return (F.floor(year / 10) * 10).cast("int")


def fnv1a32(c: Column) -> Column:
    """FNV-1a over UTF-16 code units, as an unsigned 32-bit number."""
    units = F.hex(F.encode(c, "UTF-16BE"))
    at = F.sequence(F.lit(1), F.greatest(F.length(units), F.lit(1)), F.lit(4))
    step = lambda h, i: F.when(F.substr(units, i, F.lit(4)) == "", h).otherwise(h.bitwiseXOR(F.conv(F.substr(units, i, F.lit(4)), 16, 10).cast("long")) * F.lit(16777619) % F.lit(4294967296))
    return F.aggregate(at, F.lit(2166136261).cast("long"), step)


def add_param(url: Column, name: str, value: Column) -> Column:
    """url with a parameter before its fragment."""
    base, mark = F.substring_index(url, "#", 1), F.when(F.contains(url, F.lit("#")), F.concat(F.lit("#"), F.regexp_replace(url, "^[^#]*#", ""))).otherwise("")
    joiner = F.when(F.contains(base, F.lit("?")), "&").otherwise("?")
    return F.concat(base, joiner, F.lit(f"{name}="), value, mark)


def jsonp(c: Column) -> Column:
    """The JSON between callback( and ); null for any other form."""
    inner = F.regexp_extract(c, r"(?s)^\s*[\w.$]+\((.*)\);?\s*$", 1)
    return F.when(inner != "", inner)
