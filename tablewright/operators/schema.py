"""Logical types: inference over one or several tables, casting with a report of what doesn't fit."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions import numbers
from tablewright.functions.dates import looks_dated, parse_date
from tablewright.functions.text import EMAIL_TYPED, collapse, present, strip, typed_email
from tablewright.sources.files import stored

# Logical types, truth words, words in column names.
TEXT, ID, EMAIL, INTEGER, DECIMAL, DATE, BOOLEAN = "Texto", "Identificador / Código", "Email", "Entero", "Decimal (Float)", "Fecha", "Booleano (Sí/No)"
TYPES = [TEXT, ID, EMAIL, INTEGER, DECIMAL, DATE, BOOLEAN]
TRUE = ["si", "sí", "s", "true", "verdadero", "v", "1", "x", "yes", "y"]
FALSE = ["no", "n", "false", "falso", "f", "0", "-"]
ID_WORDS = {"id", "key", "identificador", "ident", "codigo", "código", "code", "uuid", "serial", "nit", "rut", "sku", "cod", "placa", "serie"}
MAIL_WORDS = {"email", "correo", "mail"}
DATE_WORDS = {"fecha", "date", "vencimiento", "inicio", "fin"}
KEEP, LOSE = "Siguen como están, aunque no son direcciones.", "Se pierden al convertir; como «Texto» o «Identificador» seguirían."
SAMPLE, EXAMPLES, REPORTED, PREVIEW = 500, 3, 5, 50


def name_words(name: str) -> list[str]:
    """Lower-case words of a column name."""
    return [t for t in re.split(r"[^a-z0-9áéíóúñ]+", name.lower()) if t]


def _id_name(name: str) -> bool:
    return any(t in ID_WORDS or (t.endswith("id") and len(t) <= 6) for t in name_words(name))


def _mail_name(name: str) -> bool:
    return any(t in MAIL_WORDS or "correo" in t or "email" in t for t in name_words(name))


def measures() -> dict[str, Column]:
    """What inference wants to know of a sample with s (stripped value), n (as number) and d (as date)."""
    s, n, low = F.col("s"), F.col("n"), F.lower("s")
    share = lambda cond: F.avg(F.coalesce(cond, F.lit(False)).cast("int"))
    return {
        "n": F.count(s), "email": share(s.rlike(EMAIL_TYPED)), "leading_zero": share(s.rlike(r"^0\d+\z")), "truth": F.coalesce(F.bool_and(low.isin(TRUE + FALSE)), F.lit(False)), "kinds": F.count_distinct(low),
        "digits": F.coalesce(F.bool_and(s.rlike(r"^\d+\z")), F.lit(False)), "number": share(n.isNotNull()), "whole": F.coalesce(F.bool_and(n % 1 == 0), F.lit(True)), "cents": F.coalesce(F.bool_or(s.rlike(r"[.,]\d{1,2}\z")), F.lit(False)),
        "date_like": share(looks_dated(s)), "date": share(F.col("d").isNotNull()),
    }


def decide(name: str, m: dict) -> str:
    """The type that a column's name and measures speak for."""
    if _mail_name(name):
        return EMAIL
    if not m["n"]:
        return ID if _id_name(name) else TEXT
    if m["email"] >= 0.8:
        return EMAIL
    if _id_name(name) or m["leading_zero"] > 0.1:
        return ID
    if m["truth"] and m["kinds"] <= 2 and not m["digits"]:
        return BOOLEAN
    if m["number"] >= 0.95:
        return INTEGER if m["whole"] and not m["cents"] else DECIMAL
    dated = m["date_like"] >= 0.8 or (m["date_like"] >= 0.5 and not DATE_WORDS.isdisjoint(name_words(name)))
    return DATE if dated and m["date"] >= 0.8 else TEXT


def samples(dfs: tuple[DataFrame, ...], columns: list[str], order: str = "fila", n: int = SAMPLE) -> DataFrame:
    """i (the column's number), file, at, v and s (stripped) of the first ``n`` non-blank values of every column over all tables.

    One scan a table; each task keeps ``n`` values a column before anything is shuffled.
    """
    parts = []
    for file, df in enumerate(dfs):
        cells = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"`{c}`").cast("string").alias("v")) for i, c in enumerate(columns) if c in df.columns])
        parts.append(df.select(F.lit(file).alias("file"), F.col(order).alias("at"), F.explode(cells).alias("x")).select("file", "at", "x.*"))
    rows = reduce(DataFrame.unionByName, parts).where(present(F.col("v")))
    first = F.row_number().over(Window.partitionBy("i").orderBy("file", "at"))
    return rows.withColumn("k", first).where(F.col("k") <= n).select("i", "file", "at", "v", strip(F.col("v")).alias("s"))


def infer_schema(*dfs: DataFrame, order: str = "fila", overrides: dict[str, str] | None = None) -> list[dict]:
    """Column, detected type, type (that of ``overrides`` where it has one), examples and nulls over the union of the tables' columns."""
    columns = list(dict.fromkeys(c for df in dfs for c in df.columns if c != order))
    if not columns:
        return []
    if wrong := {c: t for c, t in (overrides or {}).items() if c not in columns or t not in TYPES}:
        raise ValueError(f"no such columns or types: {wrong}")
    nulls = [df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns if c != order]).first().asDict() if len(df.columns) > 1 else {} for df in dfs]
    rows = samples(dfs, columns, order).withColumns({"n": numbers.parse_number(F.col("s")), "d": parse_date(F.col("s"), short=True)})
    some = F.slice(F.array_sort(F.collect_list(F.struct("file", "at", "v"))), 1, EXAMPLES)["v"]  # of SAMPLE values
    found = {r.i: r.asDict() for r in rows.groupBy("i").agg(*[v.alias(k) for k, v in measures().items()], some.alias("some")).collect()}  # one row a column
    out = []
    for i, c in enumerate(columns):
        kind = decide(c, found.get(i, {"n": 0}))
        examples = found[i]["some"] if i in found else []
        out.append({"Columna": c, "Tipo detectado": kind, "Tipo de dato": (overrides or {}).get(c, kind), "Ejemplos": " | ".join(examples), "Vacíos": sum(n.get(c, 0) for n in nulls)})
    return out


def decimal_styles(schema: dict[str, str], *dfs: DataFrame) -> dict[str, str]:
    """Decimal sign of each number column, by all tables together: one aggregate pass a table."""
    wanted = [c for c, t in schema.items() if t in (INTEGER, DECIMAL) and any(c in df.columns for df in dfs)]
    total: dict[str, dict[str, int]] = {c: {} for c in wanted}
    for df in dfs:
        own = [c for c in wanted if c in df.columns]
        if not own:
            continue
        row = df.agg(*[v.alias(f"{i}_{name}") for i, c in enumerate(own) for (name, _), v in zip(numbers.EVIDENCE, numbers.evidence(F.col(f"`{c}`")), strict=True)]).first()
        for i, c in enumerate(own):
            for name, _ in numbers.EVIDENCE:
                total[c][name] = total[c].get(name, 0) + row[f"{i}_{name}"]
    return {c: numbers.style_of(n) for c, n in total.items()}


def cast_boolean(c: Column) -> Column:
    """Truth words as booleans, anything else null."""
    low = F.lower(strip(c.cast("string")))
    return F.when(low.isin(TRUE), True).when(low.isin(FALSE), False)


def cast(c: Column, kind: str, style: str = numbers.COMMA) -> Column:
    """A column as a logical type; what doesn't fit is null, save addresses, which stay."""
    text = c.cast("string")
    if kind == ID:
        return strip(text)
    if kind == TEXT:
        return collapse(text)
    if kind == EMAIL:
        return typed_email(text)
    if kind in (INTEGER, DECIMAL):
        n = numbers.parse_number(c, style)
        return F.when(n % 1 == 0, n).try_cast("bigint") if kind == INTEGER else n
    return parse_date(c, short=True) if kind == DATE else cast_boolean(c)


def unfit(c: Column, typed: Column, kind: str) -> Column:
    """Whether a present value doesn't fit its type, given the typed column."""
    if kind in (ID, TEXT):
        return F.lit(False)
    return present(c) & (~F.coalesce(typed.rlike(EMAIL_TYPED), F.lit(False)) if kind == EMAIL else typed.isNull())


def _typed(df: DataFrame, schema: dict[str, str], styles: dict[str, str] | None) -> tuple[DataFrame, dict[str, str], dict[str, Column]]:
    """The table with its typed columns beside the others, the types of the columns that have one, and the typed columns."""
    known = {c: t for c, t in schema.items() if c in df.columns and t in TYPES}
    styles = (styles or {}) | decimal_styles({c: t for c, t in known.items() if c not in (styles or {})}, df)
    both = df.withColumns({f"__typed_{i}": cast(F.col(f"`{c}`"), t, styles.get(c, numbers.COMMA)) for i, (c, t) in enumerate(known.items())})
    return both, known, {c: F.col(f"__typed_{i}") for i, c in enumerate(known)}


_CELL = "array<struct<Columna: string, `Tipo asignado`: string, Valor: string>>"


def _unfit(known: dict[str, str], at: dict[str, Column]) -> Column:
    """A row's values that don't fit their types."""
    return F.array_compact(F.array(*[F.when(unfit(F.col(f"`{c}`"), at[c], t), F.struct(F.lit(c).alias("Columna"), F.lit(t).alias("Tipo asignado"), F.col(f"`{c}`").cast("string").alias("Valor"))) for c, t in known.items()])).cast(_CELL)


def _exploded(rows: DataFrame, order: str) -> DataFrame:
    return rows.select(F.col(f"`{order}`").cast("long").alias("fila"), F.explode("__unfit").alias("x")).select("fila", "x.*")


def unfit_cells(df: DataFrame, schema: dict[str, str], styles: dict[str, str] | None = None, *, order: str = "fila") -> DataFrame:
    """fila, Columna, Tipo asignado and Valor of every value that doesn't fit its type."""
    both, known, at = _typed(df, schema, styles)
    return _exploded(both.withColumn("__unfit", _unfit(known, at)), order)


def apply_schema(df: DataFrame, schema: dict[str, str], styles: dict[str, str] | None = None, *, order: str = "fila") -> tuple[DataFrame, DataFrame]:
    """The typed table, and for each column with unfit values their count, first examples and fate (``unfit_cells`` has them all).

    One pass over the table: typed rows are written with what didn't fit beside them, and the report reads that alone.
    """
    both, known, at = _typed(df, schema, styles)
    rows = stored(both.select(*[at[c].alias(c) if c in at else F.col(f"`{c}`") for c in df.columns], _unfit(known, at).alias("__unfit")), "typed")
    typed, cells = rows.drop("__unfit"), _exploded(rows, order)
    fate = F.when(F.col("Tipo asignado") == EMAIL, KEEP).otherwise(LOSE)
    counts = cells.groupBy("Columna", "Tipo asignado").agg(F.count("*").alias("Valores no válidos"))
    first = cells.withColumn("k", F.row_number().over(Window.partitionBy("Columna").orderBy("fila"))).where(F.col("k") <= REPORTED)
    some = first.groupBy("Columna").agg(F.array_sort(F.collect_list(F.struct("fila", "Valor"))).alias("some"))
    return typed, counts.join(some, "Columna").select("Columna", "Tipo asignado", "Valores no válidos", F.array_join("some.Valor", " | ").alias("Ejemplos"), fate.alias("Qué pasará"))


def cast_preview(df: DataFrame, schema: dict[str, str], styles: dict[str, str] | None = None, *, order: str = "fila", n: int = PREVIEW) -> DataFrame:
    """The first ``n`` rows as they are, with ``__no_validas``: the names of the columns whose value doesn't fit."""
    head = df.orderBy(order).limit(n)
    styles = (styles or {}) | decimal_styles({c: t for c, t in schema.items() if c not in (styles or {})}, df)  # judged by the whole table
    both, known, at = _typed(head, schema, styles)
    bad = F.array_compact(F.array(*[F.when(unfit(F.col(f"`{c}`"), at[c], t), F.lit(c)) for c, t in known.items()])) if known else F.array().cast("array<string>")
    return both.select(*[F.col(f"`{c}`") for c in df.columns], bad.alias("__no_validas"))


def union_reports(reports: dict[str, DataFrame]) -> DataFrame:
    """Reports of several files as one, with the file's label in ``Archivo``."""
    return reduce(DataFrame.unionByName, [r.select(F.lit(label).alias("Archivo"), "*") for label, r in reports.items()])
