"""Dates in text: ISO forms, day-first forms and spreadsheet serials as one expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewright.functions.text import let, strip

#: Other ways to write a date, and the same in ISO order; years of two digits turn at 69.
REWRITES = [
    (r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})(\D.*)?\z", "$3-$2-$1$4"),
    (r"^(\d{1,2})[-/.](\d{1,2})[-/.]([0-5]\d|6[0-8])(\D.*)?\z", "20$3-$2-$1$4"),
    (r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{2})(\D.*)?\z", "19$3-$2-$1$4"),
    (r"^(\d{4})[/.](\d{1,2})[/.](\d{1,2})(\D.*)?\z", "$1-$2-$3$4"),
    (r"^(\d{4})(\d{2})(\d{2})\z", "$1-$2-$3"),
    (r"(:\d{2}(?:\.\d+)?)\s*(?:Z|[+-]\d{2}:?\d{2})\z", "$1"),
]
ISO = r"^\d{4}(-\d{1,2}(-\d{1,2}([T ]\d{1,2}:\d{2}(:\d{2}(\.\d{1,9})?)?)?)?)?\z"
SERIAL = r"^\d{5}(\.\d+)?\z"


def parse_date(c: Column, *, short: bool = False) -> Column:
    """Text as a timestamp without zone: ISO (also yyyy, yyyy-mm, yyyymmdd), day-first with - / or ., serial day numbers.

    Offsets are dropped.  Times of day alone and swapped days and months are no dates.  With ``short`` intermediate values
    are bound, which keeps generated code short where many dates are parsed at once but leaves whole-stage code.
    """
    bind = let if short else lambda value, use: use(value)
    return bind(strip(c.cast("string")), lambda s: bind(in_iso_order(s), lambda made: moment(s, made, bind)))


def in_iso_order(s: Column) -> Column:
    """A stripped text that begins with a digit, its date in ISO order; null for others."""
    made = s
    for pattern, instead in REWRITES:
        made = F.regexp_replace(made, pattern, instead)
    return F.when(s.rlike(r"^\d"), made)


def moment(s: Column, made: Column, bind=lambda value, use: use(value)) -> Column:
    """The timestamp of a stripped text, of which ``made`` is the ISO order."""

    def serial(days: Column) -> Column:
        return F.expr("timestamp_ntz'1899-12-30 00:00:00'") + F.make_dt_interval(days.cast("int"), F.lit(0), F.lit(0), ((days % 1) * 86400).cast("decimal(18,6)"))

    return F.when(s.rlike(SERIAL), bind(s.try_cast("double"), serial)).when(made.rlike(ISO), made.try_cast("timestamp_ntz"))


def looks_dated(c: Column) -> Column:
    """Whether a text holds three groups of digits as dates do."""
    return c.rlike(r"\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}")
