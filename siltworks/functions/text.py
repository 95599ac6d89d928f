"""Scalar functions on text columns, as Catalyst expressions. All take and return columns."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DATE_TARGETS

#: White space as Unicode has it, with the four separators U+001C to U+001F.
SPACE = r"[\s\x1c-\x1f]"

# Shapes that decide what a value is.
EMAIL = r"[\w._%+\-]+@[\w.\-]+\.[a-zA-Z]{2,}"
PHONE = r"\+?[\d]{1,4}[-.\s]?\(?\d{2,4}\)?[-.\s]?\d{2,4}[-.\s]?\d{2,6}"
URL_START = r"(https?://|www\.)"
CURRENCY = r"[\$€£¥₹]?\s?\d[\d,]*(\.\d{1,4})?"
PERCENT = r"\d+\.?\d*\s?%"
NUMBER = r"[-+]?\d+(\.\d+)?([eE][-+]?\d+)?"
MONTH = r"(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*"
DATE_SHAPES = (
    r"\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2})?)?",
    r"\d{1,2}/\d{1,2}/\d{2,4}",
    r"\d{1,2}-\d{1,2}-\d{4}",
    r"\d{4}/\d{2}/\d{2}",
    MONTH + r"[\s,]+\d{1,2}[,\s]+\d{2,4}",
    r"\d{1,2}\s+" + MONTH + r"\s+\d{4}",
    MONTH + r"\s+\d{4}",
)
#: More shapes that a lenient date parser takes: compact, year and month, dotted, with time, time alone.
DATE_MORE = (r"\d{8}", r"\d{4}-\d{2}", r"\d{1,2}\.\d{1,2}\.\d{4}", r"\d{4}\.\d{1,2}\.\d{1,2}", r"\d{1,2}:\d{2}(:\d{2})?")
DATE_WITHIN = r"(\d{4}[-/]\d{2}[-/]\d{2}|\d{1,2}[-/]\d{1,2}[-/]\d{2,4}|" + MONTH + r"[\s,]+\d)"
#: Date formats in the order in which they are tried: day before month where both fit.
DATE_FORMATS = ("yyyy-M-d", "yyyy/M/d", "d/M/yyyy", "M/d/yyyy", "d-M-yyyy", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy", "MMMM d yyyy", "MMM d yyyy")
#: After those: date-times, compact and dotted dates.
DATE_FALLBACKS = ("yyyy-M-d H:m:s", "yyyy-M-d H:m", "yyyy-M-d'T'H:m:s", "yyyy-M-d'T'H:m", "yyyyMMdd", "d.M.yyyy", "yyyy.M.d")
#: The characters that Windows-1252 has at 0x80 to 0x9F, and those bytes as Latin-1.
CP1252 = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
CP1252_BYTES = "".join(c.encode("cp1252").decode("latin-1") for c in CP1252)


def full(c: Column, pattern: str) -> Column:
    return c.rlike(f"(?U)^(?:{pattern})\\z")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"(?U)^{SPACE}+|{SPACE}+\\z", "")


def trim_spaces(c: Column) -> Column:
    """Runs of white space become a space, the ends are stripped, and what is left empty is null."""
    return F.nullif(F.trim(F.regexp_replace(c.cast("string"), f"(?U){SPACE}+", " ")), F.lit(""))


def normalize_email(c: Column) -> Column:
    """Stripped and lower-cased where that is an email address; else the value as it was."""
    clean = F.lower(strip(c))
    return F.when(full(clean, EMAIL), clean).otherwise(c)


def invalid_email(c: Column) -> Column:
    return c.isNotNull() & ~full(F.lower(strip(c)), EMAIL)


def normalize_phone(c: Column) -> Column:
    """The digits, after a leading plus; the value as it was if it has none."""
    s = strip(c)
    digits = F.regexp_replace(s, r"(?U)[^\d]", "")
    return F.when(digits == "", c).otherwise(F.concat(F.when(s.startswith("+"), "+").otherwise(""), digits))


@F.pandas_udf(T.TimestampType())
def _lenient(values: pd.Series) -> pd.Series:
    """The general parser, for values that no listed format took; run on each distinct value once."""
    known = {v: pd.to_datetime(v, format="mixed", errors="coerce") for v in values.dropna().unique()}
    return pd.to_datetime(values.map(known), errors="coerce")


def parse_date(c: Column, lenient: bool = False) -> Column:
    """The first format that parses the whole value; null if none does."""
    s = F.regexp_replace(strip(c), f"(?U){SPACE}+", " ")
    found = F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in DATE_FORMATS + DATE_FALLBACKS])
    return F.coalesce(found, _lenient(F.when(found.isNull(), s))) if lenient else found


def normalize_date(c: Column, target: str = "%Y-%m-%d", lenient: bool = False) -> Column:
    """The date in the target format; blank is null; what does not parse stays as it was."""
    return F.when(strip(c) == "", F.lit(None)).otherwise(F.coalesce(F.date_format(parse_date(c, lenient), DATE_TARGETS[target]), c))


def fix_encoding(c: Column) -> Column:
    """Repairs UTF-8 that was read as Latin-1 or Windows-1252, where the repair is valid UTF-8; else the value as it was."""
    as_bytes = F.translate(c, CP1252, CP1252_BYTES)
    broken = as_bytes.rlike(r"[\xc2-\xf4][\x80-\xbf]") & as_bytes.rlike(r"^[\x00-\xff]*\z")
    again = F.try_validate_utf8(F.encode(F.when(broken, as_bytes), "ISO-8859-1").cast("string"))
    return F.when(broken, F.coalesce(again, c)).otherwise(c)


def changed(old: Column, new: Column) -> Column:
    """Whether a cell differs; null to null does not, value to null does."""
    return ~old.cast("string").eqNullSafe(new.cast("string"))


def snake_case(c: Column) -> Column:
    """As headers.snake_case, for values."""
    runs = F.regexp_extract_all(c, F.lit(r"(?U)[\w&&[^_]]+"), F.lit(0))
    words = F.flatten(F.transform(runs, lambda run: F.split(run, "(?<=[a-z0-9])(?=[A-Z])")))
    return F.lower(F.array_join(words, "_"))


def fuzzy_key(*columns: Column) -> Column:
    """Lower-cased columns with single spaces, joined by ' | '; null if all are null."""
    parts = [F.coalesce(F.trim(F.regexp_replace(F.lower(c.cast("string")), f"(?U){SPACE}+", " ")), F.lit("")) for c in columns]
    every = reduce(lambda a, b: a & b, [c.isNull() for c in columns])
    return F.when(~every, F.concat_ws(" | ", *parts))


def token_sorted(key: Column) -> Column:
    return F.array_join(F.array_sort(F.split(key, " ")), " ")


def looks_date(c: Column) -> Column:
    s = strip(c)
    return s.rlike("(?iU)^(?:" + "|".join(DATE_SHAPES + DATE_MORE) + r")\z")


def looks_phone(c: Column) -> Column:
    s = strip(c)
    digits = F.length(F.regexp_replace(s, r"(?U)[^\d]", ""))
    return ~looks_date(c) & digits.between(7, 15) & full(s, PHONE)


def looks_number(c: Column) -> Column:
    return full(strip(c), NUMBER)


def has_date(c: Column) -> Column:
    return strip(c).rlike("(?i)" + DATE_WITHIN)


def looks_email(c: Column) -> Column:
    return full(strip(c), EMAIL)


def looks_url(c: Column) -> Column:
    """Starts like a URL. (A whole-value match of the start alone would never hold.)"""
    return strip(c).rlike("(?i)^" + URL_START)


def looks_currency(c: Column) -> Column:
    return full(strip(c), CURRENCY)


def looks_percent(c: Column) -> Column:
    return full(strip(c), PERCENT)
