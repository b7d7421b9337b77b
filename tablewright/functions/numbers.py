"""Numbers in text: which sign is the decimal one, and the number itself, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewright.functions.text import let, strip

COMMA, POINT = "coma", "punto"
#: Evidence for a style, strong then weak: (name, pattern).
EVIDENCE = [
    ("comma_after_points", r"^-?\d{1,3}(\.\d{3})+,\d+\z"),
    ("comma_not_thousands", r"^-?\d+,(\d{1,2}|\d{4,})\z"),
    ("point_after_commas", r"^-?\d{1,3}(,\d{3})+\.\d+\z"),
    ("point_not_thousands", r"^-?\d+\.(\d{1,2}|\d{4,})\z"),
    ("thousands_by_point", r"^-?\d{1,3}(\.\d{3})+\z"),
    ("thousands_by_comma", r"^-?\d{1,3}(,\d{3})+\z"),
]
#: What a floating-point literal may look like once signs and letters are sorted out.
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z"


def evidence(c: Column) -> list[Column]:
    """Counts of the six kinds of evidence over a column."""
    s = strip(c.cast("string"))
    return [F.count_if(s.rlike(pattern)).alias(name) for name, pattern in EVIDENCE]


def style_of(counts: dict[str, int]) -> str:
    """The decimal sign that a column's evidence speaks for; the comma where it is silent."""
    n = {k: counts.get(k) or 0 for k, _ in EVIDENCE}
    comma, point = n["comma_after_points"] + n["comma_not_thousands"], n["point_after_commas"] + n["point_not_thousands"]
    if comma == point:
        comma, point = n["thousands_by_point"], n["thousands_by_comma"]
    return POINT if point > comma else COMMA


def to_double(c: Column) -> Column:
    """A plain literal as double, anything else as null."""
    return F.when(c.rlike(NUMBER), c.try_cast("double"))


def parse_number(c: Column, style: str = COMMA) -> Column:
    """1.234,56, 1,234.56, $ 1 234 or 15% as double; null if it is no number.

    The last of two signs is the decimal one.  A lone comma is decimal in comma style, else it parts
    thousands; points part thousands if repeated or, in comma style, before exactly three last digits of a number that doesn't start with 0.
    """

    def read(kept: Column) -> Column:
        without = lambda sign: F.replace(kept, F.lit(sign), F.lit(""))
        comma, point = F.instr(kept, ","), F.instr(kept, ".")
        several = lambda sign: F.substring_index(kept, sign, 2) != kept
        comma_decimal = F.replace(without("."), F.lit(","), F.lit("."))
        comma_last = F.instr(F.reverse(kept), ",") < F.instr(F.reverse(kept), ".")
        lone, parts = without(","), several(".")
        if style == COMMA:
            parts = parts | ((F.length(kept) - point == 3) & ~kept.rlike(r"^[+-]*0"))
            lone = F.when(several(","), lone).otherwise(F.replace(kept, F.lit(","), F.lit(".")))
        text = F.when((comma > 0) & (point > 0), F.when(comma_last, comma_decimal).otherwise(without(","))).when(comma > 0, lone).when((point > 0) & parts, without(".")).otherwise(kept)
        return let(text, to_double)

    def number(s: Column) -> Column:
        value = let(F.regexp_replace(s, r"(?U)[^\d,.\-+eE]", ""), read)
        return F.when(s.endswith("%"), value / 100).otherwise(value)

    return let(strip(c.cast("string")), lambda s: F.when(s.rlike(r"\d"), number(s)))


def sums_before(counts: dict[int, int]) -> Column:
    """Rows before each range, of which ``counts`` has the rows, as one array literal: looked up by index, whatever their number."""
    sums, base = [], 0
    for part in range(max(counts, default=0) + 1):
        sums.append(base)
        base += counts.get(part, 0)
    return F.split(F.lit(",".join(map(str, sums))), ",").cast("array<bigint>")
