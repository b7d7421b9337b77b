"""Structural cleaning and normalisation of free text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.text import plain_title, strip, tidy_email

# Words in column names.
ID_WORDS = {"id", "key", "identificador", "ident", "codigo", "code", "uuid", "serial", "serialnumber"}
MAIL_WORDS = {"email", "correo", "mail"}
TEXT = "Texto"


def _text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def clean_data(df: DataFrame, *, order: str = "fila") -> DataFrame:
    """Trim names and texts, empty texts to null, drop rows without values and all but the first of equal rows."""
    df = df.toDF(*[c.strip() for c in df.columns])
    data = [c for c in df.columns if c != order]
    texts = set(_text_columns(df))
    df = df.select(*[F.nullif(strip(F.col(f"`{c}`")), F.lit("")).alias(c) if c in texts and c != order else F.col(f"`{c}`") for c in df.columns])
    df = df.dropna("all", subset=[f"`{c}`" for c in data])
    same = Window.partitionBy(*[F.col(f"`{c}`") for c in data]).orderBy(order)
    return df.withColumn("__n", F.row_number().over(same)).where("__n = 1").drop("__n")


def is_id_name(name: str) -> bool:
    """Whether a column's name speaks of an identifier."""
    return any(t in ID_WORDS or t.endswith(("id", "key")) for t in re.split(r"[^a-z0-9]+", name.lower()) if t)


def is_mail_name(name: str) -> bool:
    """Whether a column's name speaks of e-mail."""
    return any(t in MAIL_WORDS or "email" in t or "correo" in t for t in re.split(r"[^a-z0-9]+", name.lower()) if t)


def normalize_text_data(df: DataFrame, schema: dict[str, str] | None = None) -> DataFrame:
    """Free text as unaccented words in title case.

    With a schema only its text columns; without one by name: identifiers are trimmed, addresses tidied, other texts normalised.
    """
    own: dict[str, Column] = {}
    for c in _text_columns(df):
        col = F.col(f"`{c}`")
        if schema is not None:
            if schema.get(c) == TEXT:
                own[c] = plain_title(col)
        elif is_id_name(c):
            own[c] = strip(col)
        elif is_mail_name(c):
            own[c] = tidy_email(col)
        else:
            own[c] = plain_title(col)
    return df.withColumns(own) if own else df


def changed_cells(before: DataFrame, after: DataFrame, columns: list[str], *, order: str = "fila") -> DataFrame:
    """order and the names of the text columns whose value the cleaning changed."""
    a = before.select(F.col(order), *[F.col(f"`{c}`").cast("string").alias(f"a{i}") for i, c in enumerate(columns)])
    b = after.select(F.col(order), *[F.col(f"`{c}`").cast("string").alias(f"b{i}") for i, c in enumerate(columns)])
    differs = [F.when(F.coalesce(F.col(f"a{i}"), F.lit("")) != F.coalesce(F.col(f"b{i}"), F.lit("")), F.lit(c)) for i, c in enumerate(columns)]
    return a.join(b, order).select(order, F.array_compact(F.array(*differs)).alias("cambios"))


def changed_count(changes: DataFrame) -> DataFrame:
    """One row: the cells that ``changed_cells`` names."""
    return changes.agg(F.coalesce(F.sum(F.size("cambios")), F.lit(0)).cast("long").alias("celdas"))
