"""Numbering rows, of a whole table or within keys of which one may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.numbers import sums_before
from tablewright.sources.files import stored

#: Rows of a key that one task numbers without concern.
CALM = 1_000_000


def numbered(df: DataFrame, order: str | list[str], name: str = "pos") -> DataFrame:
    """The frame, written once, with gap-free positions from 1 by ``order`` (any sortable columns, nulls first).

    Rows are dealt into sorted ranges by bounds that Spark samples; each keeps its range and its place there.  The sums of
    the ranges before it, one number a range, are all that passes the driver.  Rows equal in ``order`` share a range: give
    columns that tell them apart where many are equal.
    """
    by = [F.col(f"`{c}`") for c in ([order] if isinstance(order, str) else order)]
    ranged = df.repartitionByRange(*by).sortWithinPartitions(*by)
    rows = stored(ranged.withColumn("__at", F.monotonically_increasing_id()), "numbered")  # range << 33 | place in it
    counts = {r[0]: r[1] for r in rows.groupBy(_range(F.col("__at")).alias("range")).count().collect()}
    return rows.withColumn(name, sums_before(counts)[_range(F.col("__at"))] + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__at")


def _range(at: Column) -> Column:
    return F.shiftright(at, 33).cast("int")


def number_within(df: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """The frame with ``name``: 1, 2, ... within each key by ``order``, of any sortable type.  Keys hold no nulls.

    Rows of keys with more than ``CALM`` rows and a thousandth of all (fewer than a thousand such keys exist) are numbered
    in sorted ranges of (key, order), over as many tasks as a shuffle has; a key's first position is then taken off.
    """
    plain = F.row_number().over(Window.partitionBy(*keys).orderBy(order)).cast("long")
    total = df.count()
    if total <= CALM:
        return df.withColumn(name, plain)
    hot = df.groupBy(*keys).count().where(F.col("count") > max(CALM, total // 1000)).drop("count")
    rows = hot.collect()  # fewer than a thousand
    if not rows:
        return df.withColumn(name, plain)
    hot = F.broadcast(df.sparkSession.createDataFrame(rows, hot.schema))
    ranged = numbered(df.join(hot, keys, "left_semi"), [*keys, order], name)
    first = F.broadcast(ranged.groupBy(*keys).agg(F.min(name).alias("__first")))
    own = ranged.join(first, keys).withColumn(name, F.col(name) - F.col("__first") + 1)
    return df.join(hot, keys, "left_anti").withColumn(name, plain).unionByName(own.select(*df.columns, name))
