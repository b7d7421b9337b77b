"""Similarity of texts and the kind of a difference."""

from __future__ import annotations

import html
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.dates import looks_dated, parse_date
from tablewright.functions.numbers import to_double
from tablewright.functions.text import collapse, fold, strip

LEVENSHTEIN, JARO_WINKLER = "Levenshtein", "Jaro-Winkler"

# The kinds of difference.
SAME = "Sin diferencia"
CASE = "Mayúsculas/minúsculas"
ACCENTS = "Tildes/acentos"
CASE_ACCENTS = "Mayúsculas y tildes"
SPACES = "Espacios en blanco"
TEXT_FORM = "Formato de texto (espacios, mayúsculas, tildes)"
DATE_FORM = "Formato de fecha/hora"
DATE_OTHER = "Fecha distinta"
NUMBER_NEAR = "Numérico dentro de tolerancia"
NUMBER_OTHER = "Numérico distinto"
MISSING = "Valor faltante en un archivo"
TEXT_OTHER = "Texto distinto"
COSMETIC = [CASE, ACCENTS, CASE_ACCENTS, SPACES, TEXT_FORM, DATE_FORM, NUMBER_NEAR]


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 1 for two empty texts."""
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def jaro_of(a: str, b: str) -> float:
    """Jaro similarity with greedy matches inside the window."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    free = list(b)
    left, taken = [], []
    for i, c in enumerate(a):
        low = max(0, i - reach)
        try:
            j = free.index(c, low, min(len(b), i + reach + 1))
        except ValueError:
            continue
        free[j] = ""
        left.append(c)
        taken.append(j)
    m = len(left)
    if not m:
        return 0.0
    swaps = sum(c != b[j] for c, j in zip(left, sorted(taken), strict=True)) // 2
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def jaro_winkler_of(a: str, b: str) -> float:
    """Jaro similarity raised by a tenth of the rest for each of up to four equal first characters."""
    base, prefix = jaro_of(a, b), 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return base + prefix * 0.1 * (1 - base)


def _of_pairs(of):
    @F.pandas_udf(T.DoubleType())
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series([of(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")

    return run


def jaro(a: Column, b: Column) -> Column:
    """Jaro similarity, in Arrow batches."""
    return _of_pairs(jaro_of)(a, b)


def jaro_winkler(a: Column, b: Column) -> Column:
    """Jaro-Winkler similarity, in Arrow batches."""
    return _of_pairs(jaro_winkler_of)(a, b)


def similarity(a: Column, b: Column, algorithm: str = JARO_WINKLER) -> Column:
    """Similarity from 0 to 1; null counts as empty."""
    return levenshtein_ratio(a, b) if algorithm == LEVENSHTEIN else jaro_winkler(a, b)


def as_text(c: Column, kind: T.DataType) -> Column:
    """A value as a person reads it: timestamps show a time only if they have one."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.when(F.date_format(c, "HH:mm:ss") == "00:00:00", F.date_format(c, "yyyy-MM-dd")).otherwise(F.date_format(c, "yyyy-MM-dd HH:mm:ss"))
    if isinstance(kind, T.BooleanType):
        return F.when(c, "True").when(~c, "False")
    return c.cast("string")


def _as_number(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.NumericType) or isinstance(kind, T.BooleanType):
        return c.cast("double")
    return to_double(strip(c)) if isinstance(kind, T.StringType) else F.lit(None).cast("double")


def _as_date(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return c.cast("timestamp_ntz")
    return F.when(looks_dated(c), parse_date(c, short=True)) if isinstance(kind, T.StringType) else F.lit(None).cast("timestamp_ntz")


def with_difference(df: DataFrame, a: str, b: str, kind: T.DataType = T.StringType(), *, algorithm: str = JARO_WINKLER, tolerance: float = 0.0, dates_by_day: bool = True) -> DataFrame:
    """The frame with kind and sim of two columns: the first sort that fits of missing, number, date and the text forms.

    Forms are columns of their own, computed once in steps small enough to be compiled; similarity is computed only
    where the kind alone doesn't settle it.
    """
    x, y = F.col(a), F.col(b)
    df = df.withColumns({"_ta": as_text(x, kind), "_tb": as_text(y, kind), "_na": _as_number(x, kind), "_nb": _as_number(y, kind)})
    df = df.withColumns({"_da": _as_date(x, kind), "_db": _as_date(y, kind), "_sa": collapse(F.col("_ta")), "_sb": collapse(F.col("_tb"))})
    df = df.withColumns({"_fa": fold(F.col("_sa")), "_fb": fold(F.col("_sb")), "_ga": fold(F.col("_ta")), "_gb": fold(F.col("_tb"))})
    c = {k: F.col(f"_{k}") for k in ("ta", "tb", "na", "nb", "da", "db", "sa", "sb", "fa", "fb", "ga", "gb")}
    near = (F.abs(c["na"] - c["nb"]) <= tolerance) if tolerance else F.lit(False)
    same_day = (c["da"] == c["db"]) | (F.to_date(c["da"]) == F.to_date(c["db"])) if dates_by_day else c["da"] == c["db"]
    found = (
        F.when(c["ta"].isNull() & c["tb"].isNull(), SAME)
        .when(c["ta"].isNull() | c["tb"].isNull(), MISSING)
        .when(c["ta"] == c["tb"], SAME)
        .when(c["na"].isNotNull() & c["nb"].isNotNull(), F.when(c["na"] == c["nb"], SAME).when(near, NUMBER_NEAR).otherwise(NUMBER_OTHER))
        .when(c["da"].isNotNull() & c["db"].isNotNull(), F.when(same_day, DATE_FORM).otherwise(DATE_OTHER))
        .when(c["sa"] == c["sb"], SPACES)
        .when(F.lower(c["sa"]) == F.lower(c["sb"]), CASE)
        .when(c["fa"] == c["fb"], ACCENTS)
        .when(F.lower(c["fa"]) == F.lower(c["fb"]), CASE_ACCENTS)
        .when(F.lower(c["ga"]) == F.lower(c["gb"]), TEXT_FORM)
        .otherwise(TEXT_OTHER)
    )
    df = df.withColumn("kind", found)
    open_ = F.col("kind").isin(TEXT_OTHER, NUMBER_OTHER, DATE_OTHER)
    sim = similarity(F.when(open_, c["ta"]), F.when(open_, c["tb"]), algorithm)
    df = df.withColumn("sim", F.when(open_, sim).when(F.col("kind") == MISSING, 0.0).otherwise(1.0))
    return df.drop(*[f"_{k}" for k in c])


EMPTY = '<span class="diff-empty">(vacío)</span>'


def marked(a: str | None, b: str | None) -> tuple[str, str]:
    """Two texts as HTML in which the characters that differ are marked."""
    a, b = a or "", b or ""
    out: tuple[list[str], list[str]] = ([], [])
    for op, *spans in SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        for k, (text, css) in enumerate(((a[spans[0] : spans[1]], "diff-del"), (b[spans[2] : spans[3]], "diff-ins"))):
            shown = html.escape(text).replace(" ", "&nbsp;")
            if shown:
                out[k].append(shown if op == "equal" else f'<span class="{css}">{shown}</span>')
    return "".join(out[0]) or EMPTY, "".join(out[1]) or EMPTY


@F.pandas_udf(T.StructType([T.StructField("html_a", T.StringType()), T.StructField("html_b", T.StringType())]))
def char_diff(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """The marked HTML of each pair of texts."""
    return pd.DataFrame([marked(x, y) for x, y in zip(a, b, strict=True)], columns=["html_a", "html_b"])
