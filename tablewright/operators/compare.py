"""Keyed comparison of two tables: one full outer join, everything else a view of it.

The n-th row of a key in one table meets the n-th of the other.  Keys are normalised and their nulls become the empty text,
which no normalised key equals, so the join is a plain equality join.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.dates import parse_date
from tablewright.functions.similarity import COSMETIC, JARO_WINKLER, as_text, with_difference
from tablewright.functions.text import collapse, fold, strip
from tablewright.operators.occurrence import number_within

# States, labels.
ADDED, REMOVED, CHANGED, UNCHANGED = "Alta", "Baja", "Modificación", "Sin cambios"
STATES = [ADDED, REMOVED, CHANGED, UNCHANGED]
BEFORE, AFTER = " (Archivo 1)", " (Archivo 2)"
HELP = {
    ADDED: "Solo está en el Archivo 2.",
    REMOVED: "Solo está en el Archivo 1, que por eso no queda incluido del todo en el otro.",
    CHANGED: "Su clave está en los dos, pero algún valor comparado difiere.",
    UNCHANGED: "Está en los dos con los mismos valores.",
}


@dataclass(frozen=True)
class CompareOptions:
    """How values are held to be equal, and what a fuzzy search does."""

    ignore_case: bool = False
    ignore_accents: bool = False
    ignore_spaces: bool = True
    numeric_tolerance: float = 0.0
    date_tolerance: bool = True
    excluded: tuple[str, ...] = field(default_factory=tuple)
    fuzzy_enabled: bool = False
    fuzzy_algorithm: str = JARO_WINKLER
    fuzzy_threshold: float = 0.85

    def describe(self) -> str:
        """What counts as equal, in words."""
        forms = [name for name, off in (("las mayúsculas", self.ignore_case), ("las tildes", self.ignore_accents), ("los espacios de más", self.ignore_spaces)) if off]
        told = ["Dan igual " + " y ".join(forms) if forms else "Cuenta cada signo de un texto"]
        told.append(f"los números difieren desde {self.numeric_tolerance:g}" if self.numeric_tolerance else "los números difieren desde cualquier cantidad")
        told.append("una fecha vale lo mismo en cualquier formato" if self.date_tolerance else "una fecha vale por su texto")
        if self.excluded:
            told.append(f"quedan fuera {', '.join(self.excluded)}")
        return "; ".join(told) + "."


def column_sets(old: DataFrame, new: DataFrame, *, order: str = "fila") -> tuple[list[str], list[str], list[str]]:
    """Columns of both tables, of the old one alone and of the new one alone, in their tables' order."""
    a, b = ([c for c in df.columns if c != order] for df in (old, new))
    return [c for c in a if c in b], [c for c in a if c not in b], [c for c in b if c not in a]


def disjoint(keys: list[str], columns: list[str], excluded: tuple[str, ...] = ()) -> tuple[list[str], list[str], list[str], dict[str, str]]:
    """Keys, compared and excluded columns that no two share, and for each column that was taken out of one what it stays in.

    A key is neither compared nor excluded; an excluded column is not compared.
    """
    keys = list(dict.fromkeys(keys))
    out = [c for c in dict.fromkeys(excluded) if c not in keys]
    stay = [c for c in dict.fromkeys(columns) if c not in keys and c not in out]
    moved = {c: "clave" for c in [*columns, *excluded] if c in keys} | {c: "excluida" for c in columns if c in out}
    return keys, stay, out, moved


def normal(c: Column, kind: T.DataType, opts: CompareOptions, *, key: bool = False) -> Column:
    """A value as comparable text, null if nothing is left."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        s = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    elif isinstance(kind, T.StringType):
        s = collapse(c) if opts.ignore_spaces or key else strip(c)
    else:
        s = as_text(c, kind)
    s = fold(s) if opts.ignore_accents else s
    return F.nullif(F.lower(s) if opts.ignore_case else s, F.lit(""))


def equal(a: Column, b: Column, kind: T.DataType, opts: CompareOptions) -> Column:
    """Whether two values of a column count as equal; two nulls do."""
    if isinstance(kind, T.NumericType):
        x, y = a.cast("double"), b.cast("double")
        gap = F.abs(x - y)
        near = gap <= opts.numeric_tolerance if opts.numeric_tolerance else (x == y) | (gap <= 1e-12 + 1e-12 * F.abs(y))
        same = near & ~F.isnan(x) & ~F.isnan(y)
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)) and opts.date_tolerance:
        same = F.date_trunc("second", a) == F.date_trunc("second", b)
    else:
        same = normal(a, kind, opts) == normal(b, kind, opts)
        if opts.date_tolerance and isinstance(kind, T.StringType):
            same = F.coalesce(same, F.lit(False)) | F.coalesce(parse_date(a) == parse_date(b), F.lit(False))
    return F.coalesce(same, F.lit(False)) | (a.isNull() & b.isNull())


class Comparison:
    """Two tables matched by key and occurrence.  ``base`` is the join; all other frames are projections of it.

    Each table needs a column (``order``) that numbers its rows.  Call ``cache`` if several results are wanted.
    """

    def __init__(self, old: DataFrame, new: DataFrame, keys: list[str], columns: list[str], options: CompareOptions | None = None, *, order: str = "fila") -> None:
        self.options = options or CompareOptions()
        self.keys, stay, _, self.moved = disjoint(keys, columns, self.options.excluded)
        self.columns = [c for c in stay if c in old.columns and c in new.columns]
        self.kinds = {}
        for c in self.keys + self.columns:
            a, b = old.schema[c].dataType, new.schema[c].dataType
            if a != b:
                raise TypeError(f"column {c} is {a.simpleString()} in one table and {b.simpleString()} in the other")
            self.kinds[c] = a
        self.old, self.new = self._side(old, order, "a"), self._side(new, order, "b")

    def _side(self, df: DataFrame, order: str, tag: str) -> DataFrame:
        names = [f"k{i}" for i in range(len(self.keys))]
        normed = [F.coalesce(normal(F.col(f"`{k}`"), self.kinds[k], self.options, key=True), F.lit("")).alias(n) for n, k in zip(names, self.keys, strict=True)]
        own = [F.col(f"`{c}`").alias(f"{tag}_{c}") for c in dict.fromkeys(self.keys + self.columns)]
        return number_within(df.select(*normed, F.col(f"`{order}`").alias(f"{tag}__fila"), *own), names, f"{tag}__fila", "occ")

    @cached_property
    def base(self) -> DataFrame:
        """One row per matched pair or lone row: keys, occ, both sides' values, changed (column names) and estado."""
        on = [f"k{i}" for i in range(len(self.keys))] + ["occ"]
        both = self.old.join(self.new, on, "full_outer")
        differs = [F.when(~equal(F.col(f"`a_{c}`"), F.col(f"`b_{c}`"), self.kinds[c], self.options), F.lit(c)) for c in self.columns]
        changed = F.array_compact(F.array(*differs)) if differs else F.array().cast("array<string>")
        paired = F.col("a__fila").isNotNull() & F.col("b__fila").isNotNull()
        both = both.withColumn("changed", F.when(paired, changed).otherwise(F.array().cast("array<string>")))
        state = F.when(F.col("a__fila").isNull(), ADDED).when(F.col("b__fila").isNull(), REMOVED).when(F.size("changed") > 0, CHANGED).otherwise(UNCHANGED)
        return both.withColumn("estado", state)

    def cache(self) -> Comparison:
        """Keep the join for several results (memory and disk)."""
        self.base = self.base.persist()
        return self

    @cached_property
    def repeated(self) -> bool:
        """Whether any key occurs more than once in a table: then results show the occurrence."""
        return bool(self.base.where("occ > 1").head(1))

    # -- results

    def _lead(self, show: bool | None) -> list[Column]:
        return [F.col("occ").alias("Ocurrencia")] if (self.repeated if show is None else show) else []

    def _values(self, tag: str) -> list[Column]:
        return [F.col(f"`{tag}_{c}`").alias(c) for c in self.keys + self.columns]

    def added(self, show: bool | None = None) -> DataFrame:
        """Rows only the new table has."""
        return self.base.where(F.col("estado") == ADDED).select(*self._lead(show), *self._values("b"))

    def removed(self, show: bool | None = None) -> DataFrame:
        """Rows only the old table has."""
        return self.base.where(F.col("estado") == REMOVED).select(*self._lead(show), *self._values("a"))

    def unchanged(self, show: bool | None = None) -> DataFrame:
        """Matched rows without a difference, as the new table has them."""
        return self.base.where(F.col("estado") == UNCHANGED).select(*self._lead(show), *self._values("b"))

    def changed(self, show: bool | None = None, first: list[str] | None = None) -> DataFrame:
        """Matched rows that differ: keys, the changed columns, and both values of every column side by side.

        Columns with any difference come first; ``first`` names them if they are known already.
        """
        rows = self.base.where(F.col("estado") == CHANGED)
        if first is None:
            found = {r[0] for r in rows.select(F.explode("changed")).distinct().collect()}  # column names only
            first = [c for c in self.columns if c in found]
        order = sorted(self.columns, key=lambda c: c not in first)
        pairs = [F.col(f"`{t}_{c}`").alias(c + s) for c in order for t, s in (("a", BEFORE), ("b", AFTER))]
        return rows.select(*self._lead(show), *[F.col(f"`b_{k}`").alias(k) for k in self.keys], F.array_join("changed", ", ").alias("Columnas con cambios"), *pairs, F.col("changed").alias("__changed"))

    def consolidated(self, show: bool | None = None) -> DataFrame:
        """All rows with their state; ``__orden`` and ``__fila`` sort them as changed, added, removed, unchanged."""
        rank = F.when(F.col("estado") == CHANGED, 0).when(F.col("estado") == ADDED, 1).when(F.col("estado") == REMOVED, 2).otherwise(3)
        values = [F.when(F.col("estado") == REMOVED, F.col(f"`a_{c}`")).otherwise(F.col(f"`b_{c}`")).alias(c) for c in self.keys + self.columns]
        fila = F.when(F.col("estado") == REMOVED, F.col("a__fila")).otherwise(F.col("b__fila"))
        return self.base.select(F.col("estado").alias("Estado"), *self._lead(show), *values, rank.alias("__orden"), fila.alias("__fila"), F.col("changed").alias("__changed"))

    def shown(self, states: list[str] | None = None, show: bool | None = None) -> DataFrame:
        """The consolidated rows of some states; by default of all but the unchanged, or of these if there are no others."""
        if states is None:
            some = bool(self.base.where(F.col("estado") != UNCHANGED).head(1))
            states = [x for x in STATES if x != UNCHANGED] if some else STATES
        return self.consolidated(show).where(F.col("Estado").isin(states))

    def key_text(self) -> Column:
        """The key as shown: its parts joined by a bar."""
        return F.concat_ws(" | ", *[F.col(f"k{i}") for i in range(len(self.keys))])

    def details(self, show: bool | None = None) -> DataFrame:
        """A row for each differing cell with the kind of difference and the similarity in percent."""
        opts, parts = self.options, []
        rows = self.base.where(F.col("estado") == CHANGED)
        groups: dict[str, list[str]] = {}
        for c in self.columns:
            groups.setdefault(self.kinds[c].simpleString(), []).append(c)
        for columns in groups.values():
            kind = self.kinds[columns[0]]
            cells = F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"`a_{c}`").alias("a"), F.col(f"`b_{c}`").alias("b")) for c in columns])
            differing = F.filter(cells, lambda x: F.array_contains("changed", x["c"]))
            cell = rows.select(self.key_text().alias("Clave"), "occ", F.explode(differing).alias("x"))
            cell = with_difference(cell.select("Clave", "occ", F.col("x.c").alias("Columna"), F.col("x.a").alias("a"), F.col("x.b").alias("b")), "a", "b", kind, algorithm=opts.fuzzy_algorithm, tolerance=opts.numeric_tolerance, dates_by_day=opts.date_tolerance)
            parts.append(cell.select("Clave", *self._lead(show), "Columna", as_text(F.col("a"), kind).alias("Valor en Archivo 1"), as_text(F.col("b"), kind).alias("Valor en Archivo 2"), F.col("kind").alias("Tipo de diferencia"), F.round(F.col("sim") * 100, 1).alias("Similitud")))
        if not parts:
            return rows.sparkSession.createDataFrame([], "Clave string, Columna string, `Valor en Archivo 1` string, `Valor en Archivo 2` string, `Tipo de diferencia` string, Similitud double")
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def frequencies(self) -> DataFrame:
        """Keys that both tables have, but not equally often; the most unbalanced first."""
        names = [f"k{i}" for i in range(len(self.keys))]
        counts = self.base.groupBy(*names).agg(F.count("a__fila").alias("n1"), F.count("b__fila").alias("n2")).where("n1 <> n2 AND n1 > 0 AND n2 > 0")
        where = F.when(F.col("n1") > F.col("n2"), "Archivo 1 (bajas)").otherwise("Archivo 2 (altas)")
        out = counts.select(self.key_text().alias("Clave"), F.col("n1").alias("Veces en Archivo 1"), F.col("n2").alias("Veces en Archivo 2"), F.abs(F.col("n1") - F.col("n2")).alias("Sin pareja"), where.alias("Quedan sin par en"))
        return out.orderBy(F.desc("Sin pareja"), "Clave")

    def orphans(self) -> DataFrame:
        """One row: occurrences without a partner on either side, of keys that both tables have."""
        side = lambda s: F.coalesce(F.sum(F.when(F.col("Quedan sin par en").startswith(s), F.col("Sin pareja"))), F.lit(0))
        return self.frequencies().agg(side("Archivo 1").alias("huerfanos_a"), side("Archivo 2").alias("huerfanos_b"))

    def states(self) -> DataFrame:
        """Rows of each state."""
        return self.base.groupBy("estado").count().select("estado", F.col("count").alias("n"))

    def totals(self) -> DataFrame:
        """One row: rows of each state and their sum."""
        n = lambda s: F.count_if(F.col("estado") == s)
        return self.base.agg(n(ADDED).alias("altas"), n(REMOVED).alias("bajas"), n(CHANGED).alias("modificaciones"), n(UNCHANGED).alias("sin_cambios"), F.count("*").alias("total_keys"))

    def inclusion(self) -> DataFrame:
        """One row: how far the new table holds the old one, with a verdict."""
        n = lambda c: F.count_if(c)
        both = F.col("a__fila").isNotNull() & F.col("b__fila").isNotNull()
        t = self.base.agg(
            F.count("a__fila").alias("total_a"), F.count("b__fila").alias("total_b"), n(both).alias("encontrados"), n(F.col("estado") == UNCHANGED).alias("identicos"), n(F.col("estado") == REMOVED).alias("faltantes"), n(F.col("estado") == CHANGED).alias("m")
        )
        share = lambda c: F.when(F.col("total_a") > 0, F.round(100 * F.col(c) / F.col("total_a"), 2)).otherwise(0.0)
        keyed = F.col("faltantes") == 0
        verdict = F.when(keyed & (F.col("m") == 0), "SÍ").when(keyed, "PARCIAL").otherwise("NO")
        return t.select("total_a", "total_b", "encontrados", "identicos", "faltantes", share("encontrados").alias("cobertura_clave"), share("identicos").alias("cobertura_exacta"), (keyed & (F.col("m") == 0)).alias("contenido"), keyed.alias("contenido_por_clave"), verdict.alias("veredicto"))

    def histogram(self) -> DataFrame:
        """Cells of each kind of difference, most first."""
        kind = F.col("Tipo de diferencia")
        return self.details(False).groupBy(kind).agg(F.count("*").alias("n")).orderBy(F.desc("n"), kind)

    def figures(self) -> DataFrame:
        """One row with all counts of the comparison: rows are added up by key, keys by table, in one pass over the join."""
        n = lambda s: F.count_if(F.col("estado") == s)
        keys = self.base.groupBy(*[f"k{i}" for i in range(len(self.keys))]).agg(F.count("a__fila").alias("n1"), F.count("b__fila").alias("n2"), n(ADDED).alias("altas"), n(REMOVED).alias("bajas"), n(CHANGED).alias("modificaciones"), n(UNCHANGED).alias("sin_cambios"))
        total = lambda c: F.coalesce(F.sum(c), F.lit(0))
        both = F.col("n1") - F.col("n2")
        lone = lambda gap: total(F.when((F.col("n1") > 0) & (F.col("n2") > 0) & (gap > 0), gap))
        return keys.agg(total("n1").alias("total_a"), total("n2").alias("total_b"), *[total(c).alias(c) for c in ("altas", "bajas", "modificaciones", "sin_cambios")], lone(both).alias("huerfanos_a"), lone(-both).alias("huerfanos_b"))

    def summary(self) -> DataFrame:
        """The comparison in ten named figures."""
        share = lambda c: F.when(F.col("total_a") > 0, F.round(100 * c / F.col("total_a"), 2)).otherwise(0.0)
        named = {
            "Registros en Archivo 1": F.col("total_a"), "Registros en Archivo 2": F.col("total_b"), "Altas": F.col("altas"), "Bajas": F.col("bajas"), "Modificaciones": F.col("modificaciones"), "Sin cambios": F.col("sin_cambios"),
            "Cobertura por clave (%)": share(F.col("modificaciones") + F.col("sin_cambios")), "Cobertura exacta (%)": share(F.col("sin_cambios")), "Sin par en Archivo 1": F.col("huerfanos_a"), "Sin par en Archivo 2": F.col("huerfanos_b"),
        }
        return self.figures().select(F.explode(F.array(*[F.struct(F.lit(k).alias("Indicador"), c.cast("double").alias("Valor")) for k, c in named.items()])).alias("x")).select("x.*")


def of_kinds(details: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """Only differences of some kinds; by default all."""
    return details if kinds is None else details.where(F.col("Tipo de diferencia").isin(kinds))


def cosmetic(details: DataFrame) -> DataFrame:
    """Only differences of form."""
    return of_kinds(details, COSMETIC)
