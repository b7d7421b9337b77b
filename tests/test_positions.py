"""Gap-free positions and occurrences over many ranges, of any order, with hot keys."""

import pytest
from pyspark.sql import functions as F

from tablewright.operators import occurrence, positional


@pytest.fixture
def many_partitions(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "1000")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_positions_over_a_thousand_ranges(spark, many_partitions):
    rows = spark.range(20_000).select((F.col("id") * 7919 % 20_000).alias("fila"), F.pmod(F.col("id"), F.lit(5)).cast("string").alias("v"))
    got = occurrence.numbered(rows, "fila")
    assert got.select(F.count_if(F.col("pos") != F.col("fila") + 1).alias("n")).first().n == 0
    out = positional.strict(rows, rows.where("fila <> 0"), ["v"]).first()
    assert out.iguales + out.distintas == 19_999 and out.solo_en_a == 1 and out.solo_en_b == 0


@pytest.mark.parametrize("order", ["struct(at, fila)", "concat('x', lpad(at, 12, '0'), fila)", "CAST(at AS DECIMAL(20, 3))", "CASE WHEN at % 2 = 0 THEN DOUBLE('NaN') ELSE at END", "CASE WHEN at % 3 > 0 THEN at END"])
def test_any_order_numbers_without_gaps(spark, order):
    rows = spark.range(500).select("id", (F.col("id") * F.col("id") % 1009).alias("at"), F.col("id").alias("fila")).withColumn("o", F.expr(order))
    got = occurrence.numbered(rows.repartition(7), ["o", "id"]).collect()
    want = rows.orderBy("o", "id").collect()
    assert [r.id for r in sorted(got, key=lambda r: r.pos)] == [r.id for r in want] and sorted(r.pos for r in got) == list(range(1, 501))
    assert occurrence.numbered(rows.limit(0), "o").count() == 0


def test_half_of_all_rows_under_one_key_are_spread(spark, monkeypatch, many_partitions):
    """Orders are structs, so unevenly spread that equal-width slices would leave all rows in one."""
    monkeypatch.setattr(occurrence, "CALM", 1000)
    rows = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 997).cast("string"))).alias("k"), F.struct(F.pow(F.lit(1.0005), F.col("id")).alias("x"), F.lit("t").alias("y")).alias("o"), "id")
    written = []
    monkeypatch.setattr(occurrence, "stored", lambda df, label, keep=occurrence.stored: written.append(keep(df, label)) or written[-1])
    got = occurrence.number_within(rows, ["k"], "o", "occ")
    assert got.where("k = 'hot'").select(F.count_if(F.col("occ") != F.col("id") / 2 + 1).alias("n")).first().n == 0
    ends = got.where("k <> 'hot'").groupBy("k").agg(F.count("*").alias("n"), F.max("occ").alias("m"), F.countDistinct("occ").alias("d"))
    assert ends.where("n <> m OR n <> d").count() == 0 and got.count() == 40_000
    spread = written[0].groupBy(F.shiftright("__at", 33).alias("r")).count()
    assert spread.count() > 100 and spread.agg(F.max("count")).first()[0] < 20_000 / 50


def test_alignment_is_that_of_difflib(spark):
    """Runs that cross and cut each other, repeated rows, empty tables: every row as difflib's blocks give it."""
    import random
    from difflib import SequenceMatcher

    r = random.Random(5)

    def moved(rows, at, to, n):
        rest = rows[:at] + rows[at + n :]
        return rest[:to] + rows[at : at + n] + rest[to:]

    base = [f"r{k}" for k in range(120)]
    cases = [(base, moved(moved(base, 10, 70, 25), 50, 3, 9)[:90] + ["x", "y"]), ([r.choice("abc") for _ in range(40)], [r.choice("abc") for _ in range(47)]), (["p"] * 7, ["p"] * 4 + ["q"] + ["p"] * 5), (base[:30], base[:30][::-1]), (["a", "b"], []), ([], ["a"])]
    for a, b in cases:
        want, equal = [], 0
        for op, i1, i2, j1, j2 in SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
            for k in range(max(i2 - i1, j2 - j1)):
                i, j = (i1 + k if i1 + k < i2 else None), (j1 + k if j1 + k < j2 else None)
                if op == "equal" and i == j:
                    equal += 1
                    continue
                kind = positional.SHIFTED if op == "equal" else positional.ONLY_B if i is None else positional.ONLY_A if j is None else positional.OTHER
                want.append((len(want), kind, *["—" if v is None else str(v) for v in (i, j)], 0))
        sides = [spark.createDataFrame([(k, v) for k, v in enumerate(x)], "fila long, v string") for x in (a, b)]
        got = positional.aligned_rows(*sides, ["v"]).select("orden", "Tipo", "Fila en Archivo 1", "Fila en Archivo 2", "iguales").orderBy("orden").collect()
        assert list(map(tuple, got)) == [(-1, "", "—", "—", equal), *want]


def test_alignment_takes_any_number_of_rows(spark):
    rows = spark.range(120_000).select(F.col("id").alias("fila"), F.col("id").alias("v"))
    r = positional.aligned(rows, rows.where("fila <> 60000"), ["v"])
    assert (r.iguales, r.desplazadas, r.distintas, r.solo_en_a, r.solo_en_b) == (60_000, 59_999, 0, 1, 0)
