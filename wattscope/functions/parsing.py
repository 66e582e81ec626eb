"""Text to typed values, with the failure kept visible instead of raised."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted spellings of a flag, case-insensitive.
TRUE_WORDS = ("true", "t", "yes", "y", "1")
FALSE_WORDS = ("false", "f", "no", "n", "0", "", "nan")


def text(raw: Column) -> Column:
    """Trimmed text; NULL becomes empty."""
    return F.trim(F.coalesce(raw, F.lit("")))


def number(raw: Column) -> Column:
    """Double or NULL; NaN also becomes NULL."""
    value = text(raw).try_cast("double")
    return F.when(~F.isnan(value), value)


def number_fault(raw: Column) -> Column:
    """NULL when ``raw`` is a usable number, else what is wrong with it."""
    value = text(raw).try_cast("double")
    return (F.when(value.isNull(), F.lit("NOT_A_NUMBER"))
            .when(F.isnan(value), F.lit("NUMBER_MISSING")))


def flag(raw: Column) -> Column:
    """True, false, or NULL when the spelling is unknown."""
    word = F.lower(text(raw))
    return (F.when(word.isin(*TRUE_WORDS), F.lit(True))
            .when(word.isin(*FALSE_WORDS), F.lit(False)))


def iso_date(raw: Column) -> Column:
    """Date from the first ten characters, NULL when they are not an ISO date."""
    head = F.substring(text(raw), 1, 10)
    return F.when(head.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(head, "yyyy-M-d"))
