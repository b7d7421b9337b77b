"""Documents of which many share an id or have none: dealt out, and teaching once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.llm import digest, packing, quality


@pytest.mark.parametrize("own", ["CASE WHEN id % 3 > 0 THEN id END", "CASE WHEN id % 3 > 0 THEN id ELSE 77 END"])
def test_rows_without_an_id_of_their_own_are_dealt_out(spark, own):
    """A third of all rows has no id, or one and the same: no task gets much more than its share, and each row meets the next."""
    docs = spark.range(4000).select(F.expr(own).alias("doc_id"), F.concat_ws(" ", F.lit("text number"), F.col("id").cast("string"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int"))).alias("text")).repartition(4)
    dealt = digest._in_order(docs, "doc_id", "text")
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= 4 and max(sizes) < 2 * 4000 / len(sizes)
    rows = dealt.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()).orderBy("at").collect()
    kept = [(r.doc_id if "doc_id" in r else r.id, r.text) for r in rows if not r.extra]
    want = docs.orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text").collect()
    assert kept == [(r.doc_id, r.text) for r in want]
    for part in {r.part for r in rows}:  # ends with the row that follows
        mine = [r for r in rows if r.part == part]
        last = next(r.text for r in mine if r.extra)
        after = kept.index((mine[0].id, mine[0].text)) + sum(not r.extra for r in mine)
        assert last == kept[after % len(kept)][1]


def test_copies_of_a_labelled_id_teach_once(spark):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("Good prose about things, number "), F.col("id").cast("string"))).otherwise(F.concat(F.lit("!!! | BUY | 77 "), F.col("id").cast("string"))).alias("text"))
    labels = spark.range(0, 200, 3).select(F.col("id").alias("doc_id"), (F.col("id") % 2 == 0).cast("int").alias("quality"))
    marked = quality.taught(labels)
    again = docs.where("doc_id = 3").crossJoin(spark.range(2000)).drop("id")
    plain, copied = quality.learn(docs, marked), quality.learn(docs.unionByName(again), marked)
    assert np.array_equal(plain.weights, copied.weights) and np.array_equal(plain.edges, copied.edges)


def test_packing_goes_on_until_a_round_saves_nothing(spark, monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(packing, "PART", 60)
    monkeypatch.setattr(packing, "LEAST", 20)
    docs = spark.range(900).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), (20 + F.col("id") * 37 % 700).cast("int")).alias("text"))
    path = public_tokenizers.path("byte_bpe_50k.json")
    first, last = packing.pack(docs, path, rounds=0), packing.pack(docs, path)
    assert last.bound <= last.bins <= first.bins and last.places.count() == last.pieces.count()
    assert all(r["gap"] == r["bins"] - r["bound"] >= 0 for r in last.report)
