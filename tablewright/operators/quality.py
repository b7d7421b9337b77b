"""Completeness, profiles, repeated keys, verdicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a table up to which no key is looked after by itself.
CALM = 1_000_000


def null_counts(df: DataFrame) -> DataFrame:
    """columna and nulos of every column: one scan."""
    counts = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"c{i}") for i, c in enumerate(df.columns)])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("columna"), F.col(f"c{i}").alias("nulos")) for i, c in enumerate(df.columns)])).alias("x")).select("x.*")


def column_types(df: DataFrame) -> list[tuple[str, str]]:
    """columna and tipo of every column."""
    return df.dtypes


def completeness(df: DataFrame) -> DataFrame:
    """One row: percent of cells with a value; 0 without cells."""
    cells = F.count("*") * len(df.columns)
    nulls = reduce(lambda a, b: a + b, [F.count_if(F.col(f"`{c}`").isNull()) for c in df.columns], F.lit(0))
    return df.agg(F.when(cells > 0, F.round(100 * (1 - nulls / cells), 2)).otherwise(0.0).alias("score"))


#: Bits that the bitmaps of a column may spend for each of its values, over all tasks: beyond it values are counted one by one.
SPARSE = 64
#: Words of 64 bits in a row of a bitmap (a power of two): rows are made by a hash aggregate, without a sort.
WORDS = 8


def _whole(name: str, kind: T.DataType) -> list[tuple[Column, Column | None]]:
    """Ways to see a column's values as whole numbers, one number a value, each with the test that it holds for a value (None: always)."""
    c = F.col(f"`{name}`")
    if isinstance(kind, T.BooleanType):
        return [(c.cast("bigint"), None)]
    if isinstance(kind, T.IntegralType):
        return [(c.cast("bigint"), None)]
    if isinstance(kind, T.DecimalType) and kind.precision < 18:
        return [((c * 10**kind.scale).cast("bigint"), None)]
    if isinstance(kind, T.DateType):
        return [(F.unix_date(c).cast("bigint"), None)]
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return [(F.unix_date(F.to_date(c)).cast("bigint"), c == F.date_trunc("day", c))]
    if isinstance(kind, T.DoubleType):  # whole numbers, and amounts with two decimals
        return [(F.round(c * k).try_cast("bigint"), (F.abs(c) < 1e13) & (c == F.round(c * k) / k)) for k in (1, 100)]
    return []


def profile(df: DataFrame) -> DataFrame:
    """columna, tipo, nulos and unicos (exact distinct values) of every column.

    A first pass counts nulls, tries which columns hold whole numbers (days and amounts in cents among them) and finds how far
    each task's values lie apart.  Columns of dense whole numbers are then counted by bitmaps, a bit a value, which are
    made before anything is shuffled; the others by their distinct values in their own type, all of a type in one shuffle.
    0.0 and -0.0 are one value, as are all NaN; both are values, not nulls.  Values of types that can't be grouped are told apart as text.
    """
    ways = {f"w{i}_{k}": (i, c, fits) for i, f in enumerate(df.schema) for k, (c, fits) in enumerate(_whole(f.name, f.dataType))}
    seen = [F.count("*").alias("rows"), *[F.count(F.col(f"`{f.name}`")).alias(f"n{i}") for i, f in enumerate(df.schema)]]
    total = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("rows", *[f"n{i}" for i in range(len(df.columns))])]
    for name, (_, c, fits) in ways.items():
        c = c if fits is None else F.when(fits, c)
        seen += [F.count(c).alias(f"{name}_n"), F.min(c).alias(f"{name}_low"), F.max(c).alias(f"{name}_high")]
        total += [F.sum(f"{name}_n").alias(f"{name}_n"), F.min(f"{name}_low").alias(f"{name}_low"), F.sum(F.col(f"{name}_high").cast("double") - F.col(f"{name}_low")).alias(f"{name}_wide")]
    first = df.groupBy(F.spark_partition_id().alias("task")).agg(*seen).agg(*total).first()  # a row for each task is shuffled
    bits, other = {}, []
    for i, f in enumerate(df.schema):
        fit = [name for name, (j, _, _) in ways.items() if j == i and first[f"{name}_n"] == first[f"n{i}"] > 0 and first[f"{name}_wide"] <= SPARSE * first[f"n{i}"]]
        if fit:
            bits[i] = ways[fit[0]][1] - F.lit(first[f"{fit[0]}_low"])
        elif first[f"n{i}"]:
            other.append((i, f))
    counts = []
    if bits:
        cells = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), c.alias("v")) for i, c in bits.items()])).alias("x")).select("x.*").where("v IS NOT NULL")
        word, bit = F.shiftright("v", 6), F.expr("shiftleft(1L, CAST(v & 63 AS INT))")
        cells = cells.select("i", F.shiftright(word, WORDS.bit_length() - 1).alias("row"), word.bitwiseAND(WORDS - 1).alias("word"), bit.alias("bit"))
        rows = cells.groupBy("i", "row").agg(*[F.bit_or(F.when(F.col("word") == k, F.col("bit")).otherwise(F.lit(0).cast("long"))).alias(f"b{k}") for k in range(WORDS)])
        counts.append(rows.groupBy("i").agg(F.sum(reduce(lambda a, b: a + b, [F.bit_count(f"b{k}") for k in range(WORDS)])).alias("u")))
    groups: dict[str, list[tuple[int, Column]]] = {}
    for i, f in other:
        plain = isinstance(f.dataType, (T.AtomicType, T.StringType))
        groups.setdefault(f.dataType.simpleString() if plain else "string", []).append((i, F.col(f"`{f.name}`") if plain else F.col(f"`{f.name}`").cast("string")))
    for columns in groups.values():
        cells = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), c.alias("v")) for i, c in columns])).alias("x")).select("x.*").where("v IS NOT NULL")
        counts.append(cells.distinct().groupBy("i").agg(F.count("*").alias("u")))
    spark = df.sparkSession
    named = spark.createDataFrame([(i, f.name, t, first["rows"] - first[f"n{i}"]) for i, (f, (_, t)) in enumerate(zip(df.schema, df.dtypes, strict=True))], "i int, columna string, tipo string, nulos long")
    if not counts:
        return named.select("columna", "tipo", "nulos", F.lit(0).cast("long").alias("unicos"))
    return named.join(F.broadcast(reduce(DataFrame.unionByName, counts)), "i", "left").select("columna", "tipo", "nulos", F.coalesce("u", F.lit(0)).cast("long").alias("unicos"))


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """All rows whose key (nulls are equal) occurs more than once; none without keys.

    Counts are aggregated before the shuffle and joined back.  Keys with more than a thousandth of a large table's rows
    (fewer than a thousand such keys exist) are broadcast, so their rows stay where they are.
    """
    if not keys:
        return df.limit(0)
    often = df.groupBy(*[F.col(f"`{k}`") for k in keys]).count().where("count > 1")

    def among(rows: DataFrame, found: DataFrame, how: str) -> DataFrame:
        same = reduce(lambda a, b: a & b, [F.col(f"l.`{k}`").eqNullSafe(F.col(f"r.`{k}`")) for k in keys])
        return rows.alias("l").join(found.alias("r"), same, how)

    total = df.count()
    if total <= CALM:
        return among(df, often.drop("count"), "left_semi")
    hot = F.broadcast(often.where(F.col("count") > total // 1000).drop("count"))
    return among(df, hot, "left_semi").unionByName(among(among(df, hot, "left_anti"), often.drop("count"), "left_semi"))


def effective_score(rules: Column, complete: Column) -> Column:
    """The rules' score, or completeness where that is missing or 0."""
    return F.when(rules.isNull() | (rules == 0), complete).otherwise(rules)


def verdict(score: Column) -> Column:
    """Conforme from 90, Advertencia from 75, else Rechazado."""
    return F.when(score >= 90, "Conforme").when(score >= 75, "Advertencia").otherwise("Rechazado")


def light(score: Column) -> Column:
    """Traffic light: green from 90, yellow from 70, else red."""
    return F.when(score >= 90, "verde").when(score >= 70, "amarillo").otherwise("rojo")
