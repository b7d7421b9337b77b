"""Row against row: strictly by position, or aligned as a sequence."""

from __future__ import annotations

import heapq
from bisect import bisect_right
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.operators.compare import CompareOptions, normal
from tablewright.operators.occurrence import numbered
from tablewright.sources.files import stored

# Kinds of row, labels.
SHIFTED, OTHER, ONLY_A, ONLY_B = "Desplazada", "Contenido distinto en la misma posición", "Solo en Archivo 1", "Solo en Archivo 2"
NONE = "—"
#: Rows that an alignment's detail shows; runs or blocks that one task looks at in order, as a power of two; rows of a chunk.
MOST_DETAIL, RANGE_BITS, CHUNK = 500, 16, 4_096


@dataclass(frozen=True)
class PositionalResult:
    """Counters of an alignment, and its first differing rows."""

    iguales: int = 0
    desplazadas: int = 0
    distintas: int = 0
    solo_en_a: int = 0
    solo_en_b: int = 0
    detalle: DataFrame | None = None

    @property
    def mismo_orden(self) -> bool:
        return not (self.desplazadas or self.distintas or self.solo_en_a or self.solo_en_b)


def signatures(df: DataFrame, columns: list[str], opts: CompareOptions, order: str) -> DataFrame:
    """fila, pos and the normalised row as one text (tolerances don't apply)."""
    own = {f"c{i}": df.schema[c].dataType for i, c in enumerate(columns)}
    rows = numbered(df.select(F.col(f"`{order}`").alias("fila"), *[F.col(f"`{c}`").alias(n) for n, c in zip(own, columns, strict=True)]), "fila")
    parts = [F.coalesce(normal(F.col(n), kind, opts), F.lit("∅")) for n, kind in own.items()]  # after the rows are dealt: the sampling needs none of it
    return rows.select("fila", "pos", F.concat_ws("‖", *parts).alias("firma"))


def _both(old: DataFrame, new: DataFrame, columns: list[str], opts: CompareOptions, order: str) -> tuple[DataFrame, DataFrame]:
    """The signatures of both tables, which are dealt at the same time."""
    with ThreadPoolExecutor(2) as pool:
        a, b = pool.map(lambda df: signatures(df, columns, opts, order), (old, new))
    return a, b


def strict(old: DataFrame, new: DataFrame, columns: list[str], opts: CompareOptions | None = None, *, order: str = "fila") -> DataFrame:
    """One row of counters: row N against row N.  Distributed; a row inserted early makes all later ones differ."""
    opts = opts or CompareOptions()
    a, b = _both(old, new, columns, opts, order)
    both = a.select("pos", F.col("firma").alias("a")).join(b.select("pos", F.col("firma").alias("b")), "pos", "full_outer")
    return both.agg(F.count_if(F.col("a") == F.col("b")).alias("iguales"), F.count_if(F.col("a") != F.col("b")).alias("distintas"), F.count_if(F.col("b").isNull()).alias("solo_en_a"), F.count_if(F.col("a").isNull()).alias("solo_en_b"))


def _array(values: list[int]) -> Column:
    """Numbers as one array literal: looked up by index, whatever their number."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _range() -> Column:
    return F.shiftright(F.col("k") - 1, RANGE_BITS).cast("int")


def _running(df: DataFrame, total: Column, name: str) -> DataFrame:
    """The frame, numbered by k, with the sum of ``total`` over the rows before each; one sum a range passes the driver."""
    rows = stored(df.withColumn("__own", total), "aligned")
    sums = {r.r: r.s for r in rows.groupBy(_range().alias("r")).agg(F.sum("__own").alias("s")).collect()}
    base = [0]
    for r in range(max(sums, default=0)):
        base.append(base[-1] + sums.get(r, 0))
    before = F.sum("__own").over(Window.partitionBy(_range()).orderBy("k").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn(name, F.coalesce(before, F.lit(0)) + _array(base)[_range()]).drop("__own")


def _runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """i, j, n: all longest runs of equal rows, row i + x of one table equal to row j + x of the other for x < n."""

    def beside(df: DataFrame) -> DataFrame:
        rows = df.select("pos", "firma")
        for name, step in (("before", 1), ("after", -1)):
            rows = rows.join(df.select((F.col("pos") + step).alias("pos"), F.col("firma").alias(name)), "pos", "left")
        return rows

    x, y = beside(a).select("firma", F.col("pos").alias("i"), F.col("before").alias("xb"), F.col("after").alias("xa")), beside(b).select("firma", F.col("pos").alias("j"), F.col("before").alias("yb"), F.col("after").alias("ya"))
    ends = {name: ~F.coalesce(F.col(f"x{name[0]}") == F.col(f"y{name[0]}"), F.lit(False)) for name in ("before", "after")}
    met = x.join(y, "firma").select("i", "j", (F.col("j") - F.col("i")).alias("d"), ends["before"].alias("first"), ends["after"].alias("last")).where("first OR last")
    met = stored(met, "runs")
    # On each diagonal first and last rows take turns, so the k-th of all first rows and the k-th of all last rows belong together.
    first, last = (numbered(met.where(which).select("d", "i", "j"), ["d", "i"], "k") for which in ("first", "last"))
    return first.join(last.select("k", F.col("i").alias("to")), "k").select("i", "j", (F.col("to") - F.col("i") + 1).alias("n"))


def _grouped(runs: DataFrame) -> DataFrame:
    """Runs with g: those of different groups stand before or after each other in both tables, so that neither cuts the other."""
    rows = numbered(runs, ["i", "j"], "k")
    seen = {r.r: r for r in rows.groupBy(_range().alias("r")).agg(F.max(F.col("i") + F.col("n")).alias("i"), F.max(F.col("j") + F.col("n")).alias("j"), F.min("j").alias("low")).collect()}
    n = max(seen, default=0) + 1
    ends, after = [(0, 0)], [1 << 60]
    for r in range(n - 1):
        ends.append((max(ends[-1][0], seen[r].i), max(ends[-1][1], seen[r].j)))
    for r in range(n - 1, 0, -1):
        after.append(min(after[-1], seen[r].low))
    order = Window.partitionBy(_range()).orderBy("k")
    earlier, later = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    end = [F.greatest(F.coalesce(F.max(F.col(c) + F.col("n")).over(earlier), F.lit(0)), _array([e[k] for e in ends])[_range()]) for k, c in enumerate("ij")]
    low = F.least(F.min("j").over(later), _array(after[::-1])[_range()])
    cut = rows.withColumn("cut", ((end[0] <= F.col("i")) & (end[1] <= low)).cast("long"))
    return _running(cut, F.col("cut"), "g").select("i", "j", "n", (F.col("g") + F.col("cut")).alias("g"))


def longest_first(runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The blocks that difflib's matcher takes: the longest run, of equals the first, and so on before and after it.

    A run that a block cuts comes back as its rests; as cutting only shortens, the longest uncut one is always next.
    """
    heap = [(-n, i, j) for i, j, n in runs]
    heapq.heapify(heap)
    at: tuple[list[int], ...] = ([], [], [], [])  # beginnings and ends in both tables, in order
    while heap:
        n, i, j = heapq.heappop(heap)
        n = -n
        k = min(bisect_right(at[2], i), bisect_right(at[3], j))  # the first block that doesn't stand before this run
        if k == len(at[0]) or (at[0][k] >= i + n and at[1][k] >= j + n):
            for values, v in zip(at, (i, j, i + n, j + n), strict=True):
                values.insert(k, v)
            continue
        before, after = min(at[0][k] - i, at[1][k] - j), max(at[2][k] - i, at[3][k] - j)
        if before > 0:
            heapq.heappush(heap, (-min(before, n), i, j))
        if after < n:
            heapq.heappush(heap, (after - n, i + after, j + after))
    return [(i, j, to - i) for i, j, to in zip(*at[:3], strict=True)]


def _blocks(a: DataFrame, b: DataFrame) -> DataFrame:
    """i, j, n of all blocks of equal rows that the alignment keeps."""

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(longest_first(list(rows[["i", "j", "n"]].itertuples(index=False, name=None))), columns=["i", "j", "n"])

    runs = stored(_grouped(_runs(a, b)), "groups")
    size = runs.groupBy("g").agg(F.count("*").alias("size"), F.first("i").alias("i"), F.first("j").alias("j"), F.first("n").alias("n"))
    alone = size.where("size = 1").select("i", "j", "n")  # nothing cuts it
    among = runs.join(size.where("size > 1").select("g"), "g", "left_semi")
    return alone.unionByName(among.groupBy("g").applyInPandas(choose, "i long, j long, n long"))


def aligned_rows(old: DataFrame, new: DataFrame, columns: list[str], opts: CompareOptions | None = None, *, order: str = "fila", most_rows: int | None = None) -> DataFrame:
    """orden, Tipo, both row labels and an explanation for every aligned row that isn't equal in place, and how many are.

    The blocks are those of difflib's matcher.  Runs of equal rows are found by a join; where runs cross, the longest is taken first, by a
    task for each group of runs that cut each other, which holds the runs of its group and no row.  Tables with more than ``most_rows``
    (None: no limit) are refused.
    """
    opts = opts or CompareOptions()
    if most_rows is not None:
        for df in (old, new):
            if df.limit(most_rows + 1).count() > most_rows:
                raise ValueError(f"an alignment takes {most_rows} rows at most; use strict()")
    a, b = (stored(df, "signatures") for df in _both(old, new, columns, opts, order))
    end = old.sparkSession.createDataFrame([(a.count() + 1, b.count() + 1, 0)], "i long, j long, n long")
    blocks = stored(numbered(_blocks(a, b).unionByName(end), "i", "k"), "blocks")
    ends = blocks.select((F.col("k") + 1).alias("k"), (F.col("i") + F.col("n")).alias("i0"), (F.col("j") + F.col("n")).alias("j0"))
    gaps = blocks.join(ends, "k", "left").withColumns({c: F.coalesce(c, F.lit(1).cast("long")) for c in ("i0", "j0")})
    gaps = gaps.withColumns({"na": F.col("i") - F.col("i0"), "nb": F.col("j") - F.col("j0"), "moved": F.when(F.col("i") == F.col("j"), F.lit(0).cast("long")).otherwise(F.col("n"))})
    gaps = _running(gaps, F.greatest("na", "nb") + F.col("moved"), "orden")
    spans = gaps.select(F.lit(False).alias("same"), "i0", "j0", "na", "nb", "orden").unionByName(
        gaps.where("moved > 0").select(F.lit(True).alias("same"), F.col("i").alias("i0"), F.col("j").alias("j0"), F.col("n").alias("na"), F.col("n").alias("nb"), (F.col("orden") + F.greatest("na", "nb")).alias("orden"))
    )
    size = F.greatest("na", "nb")
    chunks = spans.where(size > 0).withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), size - 1, F.lit(CHUNK).cast("long")))).repartition(F.col("orden") + F.col("from"))
    rows = chunks.withColumn("x", F.explode(F.sequence("from", F.least(F.col("from") + CHUNK, size) - 1)))
    rows = rows.select("same", (F.col("orden") + F.col("x")).alias("orden"), *[F.when(F.col("x") < F.col(n), F.col(at) + F.col("x")).alias(c) for c, at, n in (("i", "i0", "na"), ("j", "j0", "nb"))])
    for c, df in (("i", a), ("j", b)):
        rows = rows.join(df.select(F.col("pos").alias(c), F.col("fila").cast("string").alias(f"fila_{c}")), c, "left")
    i, j = (F.col(c).cast("string") for c in "ij")
    kinds = [
        (F.col("same"), SHIFTED, F.concat(F.lit("Pasa de la posición "), i, F.lit(" a la "), j, F.lit(" sin cambiar."))), (F.col("i").isNotNull() & F.col("j").isNotNull(), OTHER, F.lit("Cada archivo tiene otro contenido en este lugar de la secuencia.")),
        (F.col("i").isNotNull(), ONLY_A, F.concat(F.lit("La posición "), i, F.lit(" del Archivo 1 no tiene pareja."))), (F.lit(True), ONLY_B, F.concat(F.lit("La posición "), j, F.lit(" del Archivo 2 no tiene pareja."))),
    ]
    kind = F.coalesce(*[F.when(when, F.struct(F.lit(name).alias("Tipo"), text.alias("Detalle"))) for when, name, text in kinds])
    label = lambda c: F.when(F.col(c).isNull(), NONE).otherwise(F.coalesce(f"fila_{c}", F.lit("None")))
    found = rows.withColumn("kind", kind).select("orden", "kind.Tipo", label("i").alias("Fila en Archivo 1"), label("j").alias("Fila en Archivo 2"), "kind.Detalle", F.lit(0).cast("long").alias("iguales"))
    equal = blocks.agg(F.coalesce(F.sum(F.when(F.col("i") == F.col("j"), F.col("n"))), F.lit(0)).alias("iguales"))
    lit = lambda v, name: F.lit(v).alias(name)
    return found.unionByName(equal.select(F.lit(-1).cast("long").alias("orden"), lit("", "Tipo"), lit(NONE, "Fila en Archivo 1"), lit(NONE, "Fila en Archivo 2"), lit("", "Detalle"), "iguales"))


def aligned(old: DataFrame, new: DataFrame, columns: list[str], opts: CompareOptions | None = None, *, order: str = "fila", most_detail: int = MOST_DETAIL) -> PositionalResult:
    """Counters of the alignment and its first ``most_detail`` differing rows; without columns all is in order."""
    columns = [c for c in columns if c in old.columns and c in new.columns]
    if not columns:
        return PositionalResult()
    rows = aligned_rows(old, new, columns, opts, order=order).persist()
    n = {r.Tipo: r.n for r in rows.groupBy("Tipo").agg(F.sum(F.when(F.col("Tipo") == "", F.col("iguales")).otherwise(1)).alias("n")).collect()}
    detail = rows.where("Tipo <> ''").orderBy("orden").limit(most_detail).drop("orden", "iguales")
    return PositionalResult(n.get("", 0), n.get(SHIFTED, 0), n.get(OTHER, 0), n.get(ONLY_A, 0), n.get(ONLY_B, 0), detail)
