"""The fuzzy join's index against all pairs, profiles against plain counts, issues against their rows."""

import random

import pytest
from pyspark.sql import functions as F

from tablewright.functions.similarity import JARO_WINKLER, LEVENSHTEIN, similarity
from tablewright.operators import fuzzy, quality, rules


def sides(spark, a, b):
    return [spark.createDataFrame([(i, f"k{i}", t) for i, t in enumerate(x)], f"{tag}_fila long, {tag}_clave string, {tag}_registro string") for tag, x in (("a", a), ("b", b))]


def words(n, seed):
    r = random.Random(seed)
    base = ["".join(r.choice("aeioubcdlmnrstñé") for _ in range(r.randint(0, 14))) for _ in range(n // 3)]
    out = []
    for _ in range(n):
        t = list(r.choice(base))
        for _ in range(r.choice([0, 1, 1, 2, 4])):
            t[r.randint(0, len(t)) : r.randint(0, len(t))] = r.choice(["", "x", "é", "ab", "\U0001f600"])
        out.append("".join(t))
    return [*out, "", "", "aaaaaaa", "aaaaaab", "111", "11", "ab", "ba"]


@pytest.mark.parametrize("algorithm", [LEVENSHTEIN, JARO_WINKLER])
@pytest.mark.parametrize("threshold", [0.77, 0.85, 0.95, 1.0, 0.3])
def test_index_finds_what_all_pairs_find(spark, algorithm, threshold):
    a, b = sides(spark, words(90, 1), words(90, 1)[::-2] + words(60, 2))
    got = sorted(map(tuple, fuzzy.best_matches(a, b, algorithm, threshold, block=50).collect()))
    want = sorted(map(tuple, fuzzy._all_pairs(a, b, algorithm, threshold, 10**6).collect()))
    assert got == want and len(got) > 10


def people(n, seed):
    r = random.Random(seed)
    part = lambda k: "".join(r.choice("bcdfglmnprstv") + r.choice("aeiou") for _ in range(k)).capitalize()
    return [f"{part(3)} {part(4)}, {part(5)} {r.randint(1, 9999)}" for _ in range(n)]


@pytest.mark.parametrize("algorithm", [LEVENSHTEIN, JARO_WINKLER])
def test_few_pairs_are_measured(spark, algorithm):
    """Of four million pairs under 1 percent; copies with a typing error are found all the same."""
    old = people(2_000, 3)
    new = people(1_800, 4) + [t[:7] + t[8:] for t in old[:200]]
    a, b = sides(spark, old, new)
    bounds = (fuzzy._Levenshtein if algorithm == LEVENSHTEIN else fuzzy._JaroWinkler)()
    a, b = fuzzy._tokened(a.repartition(4), b.repartition(4), bounds)
    pairs = fuzzy.candidates(a, b, bounds, 0.9).select("a_fila", "b_fila", similarity(F.col("a_registro"), F.col("b_registro"), algorithm).alias("s"))
    found = pairs.agg(F.count("*").alias("n"), F.countDistinct("a_fila", "b_fila").alias("d"), F.count_if((F.col("b_fila") == F.col("a_fila") + 1_800) & (F.col("s") >= 0.9)).alias("copies")).first()
    assert found.n == found.d < 40_000 and found.copies == 200


def test_profiles_of_all_types(spark):
    rows = spark.range(3000).select(
        F.col("id").alias("dense"), (F.col("id") * 10**15 + 1).alias("sparse"), F.when(F.col("id") % 3 > 0, (F.col("id") % 7).cast("smallint")).alias("small"), (F.col("id") % 500 / 100).alias("cents"), F.sqrt("id").alias("real"),
        F.expr("CASE id % 5 WHEN 0 THEN 0.0D WHEN 1 THEN -0.0D WHEN 2 THEN double('NaN') WHEN 3 THEN double('infinity') END").alias("odd"), F.expr("CAST(id % 11 AS DECIMAL(9, 2)) / 4").alias("amount"), (F.col("id") % 2 == 0).alias("yes"),
        F.expr("TIMESTAMP_NTZ '2024-01-01' + make_dt_interval(int(id % 40))").alias("day"), F.expr("TIMESTAMP_NTZ '2024-01-01 10:00:00' + make_dt_interval(0, int(id % 90))").alias("hour"), F.date_add(F.lit("1969-12-01").cast("date"), (F.col("id") % 60).cast("int")).alias("date"),
        (F.col("id") % 13).cast("string").alias("text"), F.array(F.col("id") % 4).alias("list"), F.lit(None).cast("int").alias("nothing"), F.when(F.col("id") < 5, -F.col("id")).alias("few"), F.col("id").cast("float").alias("single"), F.when(F.col("id") % 2 == 0, 1e300).alias("huge"),
    )
    got = {r.columna: (r.tipo, r.nulos, r.unicos) for r in quality.profile(rows).collect()}
    kinds = dict(rows.dtypes)
    want = {"dense": (0, 3000), "sparse": (0, 3000), "small": (1000, 7), "cents": (0, 500), "real": (0, 3000), "odd": (600, 3), "amount": (0, 11), "yes": (0, 2), "day": (0, 40), "hour": (0, 90), "date": (0, 60), "text": (0, 13), "list": (0, 4), "nothing": (3000, 0), "few": (2995, 5), "single": (0, 3000), "huge": (1500, 1)}
    assert got == {k: (kinds[k], *v) for k, v in want.items()}
    assert {tuple(r)[2:] for r in quality.profile(rows.limit(0)).collect()} == {(0, 0)}


def test_problems_without_a_join_are_those_with_one(spark):
    rows = spark.range(60).select(F.col("id").alias("fila"), F.concat(F.lit("host"), F.col("id").cast("string"), F.when(F.col("id") % 3 == 0, ".com").otherwise("_")).alias("Dominio"), F.when(F.col("id") % 4 == 0, "Lima").otherwise("Chile").alias("Pais"))
    joined = rules.problem_rows(rows, rules.validate("Dominios", rows))
    alone = rules.problems("Dominios", rows)
    assert "Join" not in alone._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, alone.collect())) == sorted(map(tuple, joined.collect())) and alone.count() > 30


def one_form(n, seed):
    """Texts of one form, as keys with names are: nearly all share most of their tokens; some are longer than a machine word."""
    r = random.Random(seed)
    return [f"{k} | Customer#{k:09d} | {r.choice(['BUILDING', 'MACHINERY', 'FURNITURE'])}{' ñ\U0001f600x' * (r.random() < 0.2) * r.randint(1, 12)}" for k in r.sample(range(10**6), n)]


@pytest.mark.parametrize("algorithm", [LEVENSHTEIN, JARO_WINKLER])
def test_texts_of_one_form_in_blocks(spark, algorithm):
    """The blocks' bounds and word-wide measures against the plain measure of every pair; no index joins where all texts meet."""
    for left, right in ((one_form(150, 1), one_form(170, 2)), (words(80, 3), words(60, 4))):
        a, b = sides(spark, left, right)
        pairs = a.crossJoin(b).withColumn("sim", similarity(F.col("a_registro"), F.col("b_registro"), algorithm)).where("sim >= 0.85")
        want = sorted(map(tuple, fuzzy._best(pairs).collect()))
        whole = fuzzy.best_matches(a, b, algorithm, 0.85)
        assert "CoGroup" in whole._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, whole.collect())) == want and len(want) > 5
        bounds = (fuzzy._Levenshtein if algorithm == LEVENSHTEIN else fuzzy._JaroWinkler)()
        assert sorted(map(tuple, fuzzy._by_index(*fuzzy._tokened(a, b, bounds), bounds, algorithm, 0.85).collect())) == want


def test_rules_are_computed_once_a_row(spark):
    """No filter on the issues is moved to the rows they are made from: each rule's pattern stands in one operator of the plan."""
    rows = spark.range(60).select(F.col("id").alias("fila"), F.concat(F.lit(" host"), F.col("id").cast("string")).alias("Dominio"), F.lit("01/02/2024").alias("Fecha Inicio / Vencimiento"), F.when(F.col("id") % 2 == 0, "31/01/2024").otherwise("no").alias("Fecha Vencimiento"))
    for found in (rules.validate("Dominios", rows), rules.problems("Dominios", rows)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert len([line for line in plan.split("\n") if "[a-zA-Z0-9-]" in line or "a-z" in line]) == 1
    assert {(r.regla, r.severidad): r.n for r in rules.validate("Dominios", rows).groupBy("regla", "severidad").agg(F.count("*").alias("n")).collect()} == {("DOM1", "error"): 60, ("DOM5", "error"): 30, ("DOM5", "advertencia"): 30}


def test_no_index_of_all_records_where_all_pairs_are_compared(spark, monkeypatch):
    """Which way is taken is judged by some records: where next to all pairs meet, the others' tokens are never made."""
    a, b = sides(spark, one_form(400, 5), one_form(420, 6))
    want = sorted(map(tuple, fuzzy.best_matches(a, b, JARO_WINKLER, 0.85).collect()))
    seen, tokened = [], fuzzy._tokened
    monkeypatch.setattr(fuzzy, "JUDGED", 50, raising=False)
    monkeypatch.setattr(fuzzy, "_tokened", lambda x, y, bounds: seen.append((x.count(), y.count())) or tokened(x, y, bounds))
    assert sorted(map(tuple, fuzzy.best_matches(a, b, JARO_WINKLER, 0.85).collect())) == want and len(want) > 300
    assert len(seen) == 1 and 0 < max(seen[0]) < 120
