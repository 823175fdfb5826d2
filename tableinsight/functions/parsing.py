"""Text to number and text to date, as native expressions that yield NULL instead of failing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and words that decide conversions.
DECIMAL_COMMA = r"^-?\d+,\d+$"
LEADING_ZERO = r"^0\d"
DATE_KEYWORDS = ["date", "time", "jour", "mois", "annee", "année", "year"]

_INTEGER = r"^[+-]?\d+$"
_NUMBER = r"^[+-]?(\d+[.,]?\d*|[.,]\d+)([eE][+-]?\d+)?$|^[+-]?(?i:inf|infinity)$"
# Unicode white space plus the four separator controls.
_SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
_VISIBLE = r"(?U)[^\s\x1c-\x1f]"

_YEAR_FIRST = r"^\d{4}[-/. ]\d{1,2}[-/. ]\d{1,2}(\D|$)"
_COMPACT = r"^\d{8}$"
_YEAR_LAST = r"^\d{1,2}[-/. ]\d{1,2}[-/. ]\d{4}(\s|$)"
_SHORT_YEAR_LAST = r"^\d{1,2}[-/. ]\d{1,2}[-/. ]\d{2}(\s|$)"
_DAY_MONTH_NAME = r"^\d{1,2} [A-Za-z]{3,9} \d{4}$"
_MONTH_NAME_DAY = r"^[A-Za-z]{3,9} \d{1,2},? \d{4}$"
_TIME = "[ H:mm[:ss[.SSSSSS][.SSS]]]"
_HALF_DAY = " h:mm[:ss] a"
_HALF_DAY_SHAPE = r"(?i)[ap]m$"


def stripped(value: Column) -> Column:
    """Trimmed of all white space; blank becomes NULL. Plain spaces go first, which is cheap; the
    other kinds are rare, so the ends are looked at before trimming those too."""
    trimmed = F.trim(value)
    spaced = F.substring(trimmed, 1, 1).isin(*_SPACES) | F.substring(trimmed, -1, 1).isin(*_SPACES)
    return F.nullif(
        F.when(spaced, F.trim(trimmed, F.lit(_SPACES))).otherwise(trimmed), F.lit("")
    )


def has_text(value: Column) -> Column:
    """Not NULL and not blank; stops at the first character that is no white space."""
    return value.rlike(_VISIBLE)


def comma_to_point(value: Column) -> Column:
    return F.replace(value, F.lit(","), F.lit("."))


def has_comma(value: Column) -> Column:
    return F.contains(value, F.lit(","))


def is_number_or_comma(value: Column) -> Column:
    """A number once its comma, if any, is read as the decimal point."""
    return value.rlike(_NUMBER)


def is_decimal_comma(value: Column) -> Column:
    return has_comma(value) & value.rlike(DECIMAL_COMMA)


def is_zero_led(value: Column) -> Column:
    return F.startswith(value, F.lit("0")) & value.rlike(LEADING_ZERO)


def to_number(value: Column) -> Column:
    """The cast alone would also take ``1d`` or ``NaN`` for numbers."""
    return F.when(is_number_or_comma(value) & ~has_comma(value), value.try_cast("double"))


def to_integer(value: Column) -> Column:
    # A failing cast costs an exception, so only text that can be a whole number gets there.
    return F.when(value.rlike(_INTEGER), value.try_cast("bigint"))


def to_date_time(value: Column) -> Column:
    """ISO first, then day before month, month before day where the day reading is impossible.

    Each format is tried only on text of its shape, so no value costs a failed parse per format.
    """
    slashed = F.regexp_replace(value, r"^(\d{1,2})[-/. ](\d{1,2})[-/. ]", "$1/$2/")
    iso = F.regexp_replace(value, r"^(\d{4})[-/. ](\d{1,2})[-/. ]", "$1-$2-")
    capital = F.initcap(F.replace(value, F.lit(","), F.lit("")))

    def parsed(text: Column, *formats: str) -> Column:
        return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])

    return (
        F.when(value.rlike(_YEAR_FIRST), iso.try_cast("timestamp"))
        .when(value.rlike(_COMPACT), parsed(value, "yyyyMMdd"))
        .when(value.rlike(r"^\d{4}-\d{2}$"), value.try_cast("timestamp"))
        .when(
            value.rlike(_YEAR_LAST) & value.rlike(_HALF_DAY_SHAPE),
            parsed(F.upper(slashed), f"d/M/yyyy{_HALF_DAY}", f"M/d/yyyy{_HALF_DAY}"),
        )
        .when(value.rlike(_YEAR_LAST), parsed(slashed, f"d/M/yyyy{_TIME}", f"M/d/yyyy{_TIME}"))
        .when(value.rlike(_SHORT_YEAR_LAST), parsed(slashed, f"d/M/yy{_TIME}", f"M/d/yy{_TIME}"))
        .when(value.rlike(_DAY_MONTH_NAME), parsed(capital, "d MMM yyyy", "d MMMM yyyy"))
        .when(value.rlike(_MONTH_NAME_DAY), parsed(capital, "MMM d yyyy", "MMMM d yyyy"))
    )
