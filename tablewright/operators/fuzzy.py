"""Suggested matches between removed and added records by text similarity.

Where texts differ, pairs are found through an inverted index of tokens, the rarest first, and only those whose lengths and shared
tokens can reach the threshold are measured.  Texts of one form share so many tokens that next to all pairs would meet there: these
are dealt into blocks, each task bounds all pairs of two blocks at once and measures those that can still win.  Neither way leaves
a pair out that reaches the threshold.  Interactive use stops at a stated number of pairs and says so.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.nearest import nearest
from tablewright.functions.similarity import LEVENSHTEIN, as_text, similarity, with_difference
from tablewright.operators.compare import ADDED, REMOVED, Comparison
from tablewright.sources.files import stored

#: Pairs up to which the search runs, and suggestions it returns.
MOST_PAIRS, TOP = 40_000, 200
#: Similarities at which matches are looked for first, and removed and added records of a block where no index helps.
LEVELS, REMOVED_BLOCK, BLOCK = (0.94,), 4_096, 65_536
#: Pairs for each that meets in the index if the index is to be worth its joins, and records of a side by which that is judged.
WORTH, JUDGED = 200, 1_000
NOTHING = "Nada que buscar: falta alguna baja o alguna alta."


def _records(comparison: Comparison) -> tuple[DataFrame, DataFrame]:
    """Removed and added records, the comparison computed once for both and all that is asked of them."""

    def fields(tag: str) -> Column:
        def text(columns: list[str]) -> Column:
            return F.concat_ws(" | ", *[F.coalesce(as_text(F.col(f"`{tag}_{c}`"), comparison.kinds[c]), F.lit("")) for c in columns])

        return F.struct(F.col(f"{tag}__fila").alias("fila"), text(comparison.keys).alias("clave"), text(comparison.keys + comparison.columns).alias("registro"))

    rows = comparison.base.where(F.col("estado").isin(REMOVED, ADDED))
    rows = stored(rows.select("estado", F.when(F.col("estado") == REMOVED, fields("a")).otherwise(fields("b")).alias("r")), "fuzzy-sides")
    return tuple(rows.where(F.col("estado") == state).select(*[F.col(f"r.{c}").alias(f"{tag}_{c}") for c in ("fila", "clave", "registro")]) for state, tag in ((REMOVED, "a"), (ADDED, "b")))


def _best(found: DataFrame) -> DataFrame:
    """The most similar added record of each removed one, the first of equals."""
    better = F.min_by(F.struct("sim", "b_fila", "b_clave", "b_registro"), F.struct(-F.col("sim"), "b_fila")).alias("b")
    return found.where("sim > 0").groupBy("a_fila", "a_clave", "a_registro").agg(better).select("a_fila", "a_clave", "a_registro", "b.*")


def best_matches(removed: DataFrame, added: DataFrame, algorithm: str, threshold: float, *, block: int = BLOCK) -> DataFrame:
    """For each removed record the most similar added one (the first of equals) if it reaches the threshold.

    Both frames have fila (unique), clave and registro, prefixed a_ and b_.  All pairs are compared in blocks where the threshold is too
    low for an index (``_Levenshtein.least``, ``_JaroWinkler.least``) or more than one pair in ``WORTH`` would meet there.  The latter is
    judged by some ``JUDGED`` records of each side, before any index is built; either way the result is the same.
    """
    bounds = (_Levenshtein if algorithm == LEVENSHTEIN else _JaroWinkler)()
    n_a, n_b = removed.count(), added.count()
    if threshold >= bounds.least:
        a, b = (df.where(F.pmod(F.xxhash64(df.columns[0]), F.lit(max(1, n // JUDGED))) == 0) for df, n in ((removed, n_a), (added, n_b)))
        a, b = _tokened(a, b, bounds)
        whole = n_a < 2 * JUDGED and n_b < 2 * JUDGED  # then all records were looked at
        if _meetings(a, b, bounds, threshold) * WORTH <= (float(n_a) * n_b if whole else float(a.count()) * b.count()):
            return _by_index(*((a, b) if whole else _tokened(removed, added, bounds)), bounds, algorithm, threshold)
    return _all_pairs(removed, added, algorithm, threshold, block, n_a, n_b)


def _by_index(a: DataFrame, b: DataFrame, bounds: _Levenshtein | _JaroWinkler, algorithm: str, threshold: float) -> DataFrame:
    """``best_matches`` of records with tokens.

    The search starts at the highest of ``LEVELS``: a record that finds a match there needs no other, as all pairs that similar are
    candidates; the rest asks again, at last at the threshold.
    """
    found, rest = None, a
    for level in sorted({threshold, *[x for x in LEVELS if x > threshold]}, reverse=True):
        own = stored(_best(candidates(rest, b, bounds, level).withColumn("sim", similarity(F.col("a_registro"), F.col("b_registro"), algorithm)).where(F.col("sim") >= level)), "fuzzy-found")
        rest = rest.join(own.select("a_fila"), "a_fila", "left_anti")
        found = own if found is None else found.unionByName(own)
    return found


def _all_pairs(removed: DataFrame, added: DataFrame, algorithm: str, threshold: float, block: int, n_a: int | None = None, n_b: int | None = None) -> DataFrame:
    """All pairs: each task compares a block of removed records with one of about ``block`` added ones; n_a and n_b: their numbers, if known."""
    n_a, n_b = removed.count() if n_a is None else n_a, added.count() if n_b is None else n_b
    blocks_a = max(1, -(-n_a // min(REMOVED_BLOCK, max(256, n_a // 64))))
    blocks_b = max(1, -(-n_b // block))
    tasks = 2 * blocks_a * blocks_b  # blocks meet by hash; few share a task

    def dealt(df: DataFrame, own: str, n: int, other: str, copies: int) -> DataFrame:
        row = df.withColumn(own, F.pmod(F.xxhash64(df.columns[0]), F.lit(n)))
        return row.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).repartition(tasks, "block_a", "block_b")

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        b = b.sort_by("b_fila")
        best, which = nearest(a.column("a_registro").to_pylist(), b.column("b_registro").to_pylist(), algorithm, threshold)
        rows = np.flatnonzero(which >= 0)
        left, right = a.take(rows).select(removed_columns), b.take(which[rows]).select(added_columns)
        return pa.table([*left.columns, pa.array(best[rows]), *right.columns], names=[*removed_columns, "sim", *added_columns])

    removed_columns, added_columns = removed.columns, added.columns
    kinds = {**{f.name: f.dataType.simpleString() for f in removed.schema}, "sim": "double", **{f.name: f.dataType.simpleString() for f in added.schema}}
    sides = dealt(removed, "block_a", blocks_a, "block_b", blocks_b), dealt(added, "block_b", blocks_b, "block_a", blocks_a)
    groups = [df.withColumns({k: F.col(k).cast("long") for k in ("block_a", "block_b")}).groupBy("block_a", "block_b") for df in sides]
    return _best(groups[0].cogroup(groups[1]).applyInArrow(search, ", ".join(f"{k} {v}" for k, v in kinds.items())))


# ---------------------------------------------------------------- index


class _Levenshtein:
    """Tokens are the q-grams of a text, padded at both ends and numbered where they repeat; an edit changes q of them."""

    q = 3
    least = 0.76

    def tokens(self, text: Column) -> Column:
        padded = F.concat(F.repeat(F.lit("\x01"), self.q - 1), text, F.repeat(F.lit("\x02"), self.q - 1))
        return F.transform(F.sequence(F.lit(1), F.length(text) + self.q - 1), lambda i: F.substring(padded, i, self.q))

    def size(self, length: Column) -> Column:
        return length + self.q - 1

    def prefixes(self, length: Column, level: float) -> list[tuple[int, Column]]:
        """For each class of pairs the characters they begin with alike and how many of a text's tokens are looked up."""
        return [(0, self.q * _edits(length, level) + 1)]

    def shared(self, _: int, a: Column, b: Column, level: float) -> tuple[Column, Column]:
        """Whether lengths allow a pair, and how many tokens it must share."""
        edits = _edits(F.greatest(a, b), level)
        return F.abs(a - b) <= edits, F.greatest(F.lit(1), self.size(F.greatest(a, b)) - self.q * edits)


def _edits(longest: Column, level: float) -> Column:
    return F.floor((1 - level) * longest + 1e-6).cast("int")


class _JaroWinkler:
    """Tokens are the characters of a text, numbered where they repeat; pairs are told apart by how many first ones are equal."""

    least = 0.7

    def tokens(self, text: Column) -> Column:
        return F.when(F.length(text) == 0, F.array(F.lit(""))).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text))), lambda i: F.substring(text, i, 1)))

    def size(self, length: Column) -> Column:
        return F.greatest(F.lit(1), length)

    @staticmethod
    def jaro(p: int, level: float) -> float:
        """The Jaro similarity that a pair with p equal first characters needs."""
        return (level - 0.1 * p) / (1 - 0.1 * p)

    def prefixes(self, length: Column, level: float) -> list[tuple[int, Column]]:
        return [(p, (self.size(length) - F.ceil(max(0.0, 3 * self.jaro(p, level) - 2) * length - 1e-6) + 1).cast("int")) for p in range(5)]

    def shared(self, p: int, a: Column, b: Column, level: float) -> tuple[Column, Column]:
        """Matched characters are at most those shared; with m of them Jaro is (m / a + m / b + 1) / 3 at most."""
        need = 3 * self.jaro(p, level) - 1
        fits = F.least(a, b) >= (need - 1) * F.greatest(a, b) - 1e-6
        return fits, F.greatest(F.lit(1), F.ceil(need * a * b / F.greatest(F.lit(1), a + b) - 1e-6).cast("int"))


def _tokened(removed: DataFrame, added: DataFrame, bounds: _Levenshtein | _JaroWinkler) -> tuple[DataFrame, DataFrame]:
    """Both sides with their length and tokens, those first that the fewest records have."""

    def exploded(df: DataFrame, tag: str) -> DataFrame:
        each = df.select(F.col(f"{tag}_fila").alias("fila"), F.explode(bounds.tokens(F.col(f"{tag}_registro"))).alias("t")).groupBy("fila", "t").count()
        return each.select("fila", F.explode(F.transform(F.sequence(F.lit(1), F.col("count").cast("int")), lambda k: F.concat("t", k.cast("string")))).alias("t"))

    sides = {tag: exploded(df, tag) for df, tag in ((removed, "a"), (added, "b"))}
    often = stored(sides["a"].select("t").unionAll(sides["b"].select("t")).groupBy("t").agg(F.count("*").alias("n")), "fuzzy-tokens")
    out = []
    for df, tag in ((removed, "a"), (added, "b")):
        own = sides[tag].join(often, "t").groupBy("fila").agg(F.array_sort(F.collect_list(F.struct("n", "t")))["t"].alias(f"{tag}_tokens"))
        out.append(stored(df.join(own.withColumnRenamed("fila", f"{tag}_fila"), f"{tag}_fila").withColumn(f"{tag}_n", F.length(f"{tag}_registro")), "fuzzy-records"))
    return out[0], out[1]


def _looked_up(df: DataFrame, tag: str, bounds: _Levenshtein | _JaroWinkler, level: float) -> DataFrame:
    """A row for each token of a record that is looked up, with its class of pairs (p, first) and its place."""
    text, n, tokens = F.col(f"{tag}_registro"), F.col(f"{tag}_n"), F.col(f"{tag}_tokens")
    keys = [F.when(n >= p, F.struct(F.lit(p).alias("p"), F.substring(text, 1, p).alias("first"), F.slice(tokens, 1, F.greatest(F.lit(1), F.least(bounds.size(n), size))).alias("t"))) for p, size in bounds.prefixes(n, level)]
    each = df.withColumn("k", F.explode(F.array_compact(F.array(*keys))))
    return each.select(*df.columns, "k.p", "k.first", F.posexplode("k.t").alias(f"{tag}_at", "t"))


def _meetings(a: DataFrame, b: DataFrame, bounds: _Levenshtein | _JaroWinkler, level: float) -> float:
    """How many pairs meet at a token that both look up."""
    each = [_looked_up(df, tag, bounds, level).groupBy("p", "first", "t").agg(F.count("*").cast("double").alias(f"n_{tag}")) for df, tag in ((a, "a"), (b, "b"))]
    return each[0].join(each[1], ["p", "first", "t"]).agg(F.sum(F.col("n_a") * F.col("n_b"))).first()[0] or 0.0


def candidates(a: DataFrame, b: DataFrame, bounds: _Levenshtein | _JaroWinkler, level: float) -> DataFrame:
    """All pairs that can reach the level, each once: it meets at the rarest token that its texts share.

    Tokens stand in one order in all records, so two texts that share enough of them share one among their first few.
    """
    met = _looked_up(a, "a", bounds, level).join(_looked_up(b, "b", bounds, level), ["p", "first", "t"])
    fits, need = F.lit(False), F.lit(1)
    for p, _ in bounds.prefixes(F.lit(1), level):
        allowed, own = bounds.shared(p, F.col("a_n"), F.col("b_n"), level)
        fits, need = F.when(F.col("p") == p, allowed).otherwise(fits), F.when(F.col("p") == p, own).otherwise(need)
    if isinstance(bounds, _JaroWinkler):  # of the class of exactly p equal first characters
        after = [F.substring(f"{t}_registro", F.col("p") + 1, F.lit(1)) for t in ("a", "b")]
        fits = fits & ((F.col("p") == 4) | (F.least("a_n", "b_n") == F.col("p")) | (after[0] != after[1]))
    room = [F.col(f"{t}_at") < bounds.size(F.col(f"{t}_n")) - need + 1 for t in ("a", "b")]
    both = met.where(fits & room[0] & room[1]).withColumn("both", F.array_intersect("a_tokens", "b_tokens"))
    return both.where((F.col("both")[0] == F.col("t")) & (F.size("both") >= need)).select("a_fila", "a_clave", "a_registro", "b_fila", "b_clave", "b_registro")


def suggestions(comparison: Comparison, *, most_pairs: int | None = MOST_PAIRS, top: int | None = TOP) -> tuple[DataFrame | None, str]:
    """The suggested matches, most similar first, and a note where there are none.

    More than ``most_pairs`` pairs (None: no limit) are not compared at all; the note says so.
    """
    opts = comparison.options
    if not opts.fuzzy_enabled:
        return None, ""
    removed, added = _records(comparison)
    a, b = removed.count(), added.count()
    if not a or not b:
        return None, NOTHING
    if most_pairs is not None and a * b > most_pairs:
        return None, f"No se buscó: {a:,} bajas por {b:,} altas superan {most_pairs:,} combinaciones."
    best = best_matches(removed, added, opts.fuzzy_algorithm, opts.fuzzy_threshold).withColumnRenamed("sim", "best")
    found = with_difference(best, "a_registro", "b_registro", algorithm=opts.fuzzy_algorithm)
    out = found.select(
        F.col("a_clave").alias("Baja en Archivo 1"), F.col("b_clave").alias("Posible alta equivalente en Archivo 2"), F.round(F.col("best") * 100, 1).alias("Similitud"), F.col("kind").alias("Tipo de diferencia"),
        F.col("a_registro").alias("Registro en Archivo 1"), F.col("b_registro").alias("Registro en Archivo 2"), "a_fila",
    )
    if top is None:
        return out.drop("a_fila"), ""
    out = out.orderBy(F.desc("Similitud"), "a_fila").limit(top).drop("a_fila")
    return out, "" if out.head(1) else f"Ninguna alta alcanza el {opts.fuzzy_threshold:.0%} de parecido con una baja."
