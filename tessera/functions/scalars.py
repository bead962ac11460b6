"""String, date, array and JSON scalars used by the readers and reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_date_of_path(path: Column) -> Column:
    """Date in a file name of exactly eight digits and ``.txt``; NULL otherwise."""
    digits = F.regexp_extract(path, r"(?:^|/)(\d{8})\.txt$", 1)
    return F.when(digits != "", F.to_date(F.try_to_timestamp(digits, F.lit("yyyyMMdd"))))


def compact_date(text: Column) -> Column:
    """Dates such as 19JUL04; NULL if malformed."""
    shaped = F.concat(F.substring(text, 1, 2), F.initcap(F.lower(F.substring(text, 3, 3))), F.substring(text, 6, 2))
    return F.when(text.rlike("(?i)^[0-9]{2}[A-Z]{3}[0-9]{2}$"), F.to_date(F.try_to_timestamp(shaped, F.lit("yyMMMdd"))))


def int_date(yyyymmdd: Column) -> Column:
    return F.to_date(F.try_to_timestamp(yyyymmdd.cast("string"), F.lit("yyyyMMdd")))


def stem(path: Column) -> Column:
    return F.upper(F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1))


def numbered(prefix: str, n: Column, width: int = 2) -> Column:
    return F.concat(F.lit(prefix), F.lpad(n.cast("string"), width, "0"))


def joined(values: Column, sep: str = ";") -> Column:
    return F.array_join(F.transform(values, lambda v: v.cast("string")), sep)


def linspace(low: Column | float, high: Column | float, n: int) -> Column:
    """Array of ``n`` evenly spaced values, both ends included."""
    low, high = (x if isinstance(x, Column) else F.lit(float(x)) for x in (low, high))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: low + (high - low) * i / max(1, n - 1))


def json_number(text: Column, path: str) -> Column:
    return F.get_json_object(text, path).try_cast("double")
