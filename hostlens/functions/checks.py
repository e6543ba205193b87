"""Building blocks of the validation rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stripped(text: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(F.regexp_replace(text, r"^(?U)\s+", ""), r"(?U)\s+$", "")


def text_in(text: Column, shortest: int, longest: int) -> Column:
    return text.isNotNull() & F.length(text).between(shortest, longest)


def no_control(text: Column) -> Column:
    return ~text.rlike(r"[\x00-\x1f]")


def number_in(number: Column, low, high) -> Column:
    """Null, NaN and out-of-range numbers fail."""
    return number.isNotNull() & (number >= low) & (number <= high)


def errors_of(good: dict[str, Column]) -> Column:
    """Names of the fields whose check does not hold."""
    marks = [F.when(~F.coalesce(check, F.lit(False)), F.lit(name)) for name, check in good.items()]
    return F.array_compact(F.array(*marks))
