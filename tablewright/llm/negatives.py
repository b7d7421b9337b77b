"""Hard negatives: for each anchor and positive the best rows of other labels inside a window below the positive's score.

Candidates are sorted by norm and cut into buckets; buckets are dealt into stripes, so that every stripe holds buckets of all
norms, longest first.  A task walks a stripe's buckets for all anchors of a block at once.  An anchor leaves a bucket out
where its own norm times the bucket's greatest (Cauchy-Schwarz) stays below what it still needs: its window's lower limit
or the score of the last row that it keeps (the running k-th), whichever is higher; as norms only fall, it then leaves out the rest.
Stripes are walked in rounds, each as long as all before it, and hand on the k-th scores reached, so that what is
shuffled grows with the anchors times the number of rounds.  Positives are found by the same walk, with the same label and no window.

Scores are integers and exact: products are summed in single precision while no sum can pass 2 ** 24, else in double precision
(2 ** 53), else in integers.

Defined results: rows with a null id, label or vector, any null or non-finite component, another than the commonest length,
or integer components too large for 64-bit scores take no part; of rows with equal ids the least label and vector does;
a label outside 0 to 9 of a row whose id 7 divides moves into them; anchors without positives, and pairs without rows in their
window, give none; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.shared import prepare, stored, wanted
from tablewright.operators.occurrence import numbered

#: Rows of a bucket, buckets of a stripe, bytes of anchors that are broadcast at once.
BUCKET, BUCKETS, BLOCK_BYTES = 1024, 8, 16 << 20
#: A window's lower and upper limit in hundredths of the positive's score.
LOW, HIGH = 30, 90
_LEAST, _MOST = -(1 << 62), 1 << 62


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, label, v (array of long) and norm2 of the rows that take part."""
    rows = wanted(vectors, id_col, label_col, vec_col).select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("x"))
    fine = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND size(x) > 0 AND forall(x, e -> e IS NOT NULL AND NOT isnan(e) AND abs(e) < double('infinity')) AND aggregate(x, 0D, (a, e) -> a + e * e) < 1e13")
    common = fine.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    fine = fine.where(F.size("x") == (common[0].d if common else 0))
    moved = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    whole = fine.select("vec_id", moved.alias("label"), F.transform("x", lambda e: F.floor(256 * e).cast("long")).alias("v"))
    one = whole.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v")
    return one.withColumn("norm2", F.aggregate("v", F.lit(0).cast("long"), lambda a, e: a + e * e))


_STRIPES = "stripe long, bucket long, most long, ids binary, labels binary, vectors binary"


def build(rows: DataFrame, bucket: int = BUCKET, buckets: int = BUCKETS) -> DataFrame:
    """The buckets, longest vectors first, as a written table: number, stripe, greatest squared norm, members by id."""
    prepare(rows.sparkSession)
    placed = numbered(rows.withColumn("short", -F.col("norm2")), ["short", "vec_id"])
    stripes = max(1, -(-placed.count() // (bucket * buckets)))
    own = placed.withColumn("bucket", F.floor((F.col("pos") - 1) / bucket).cast("long"))

    def pack(key, table):
        table = table.sort_by("vec_id").combine_chunks()
        number = key[0].as_py()
        held = [table.column(c).to_numpy().astype("<i8").tobytes() for c in ("vec_id", "label")]
        v = table.column("v").combine_chunks()
        return pa.table({"stripe": pa.array([number % stripes], pa.int64()), "bucket": pa.array([number], pa.int64()), "most": pa.array([max(table.column("norm2").to_pylist())], pa.int64()), "ids": [held[0]], "labels": [held[1]], "vectors": [v.flatten().to_numpy().astype("<i8").tobytes()]})

    return stored(own.select("bucket", "vec_id", "label", "v", "norm2").groupBy("bucket").applyInArrow(pack, _STRIPES), "negatives-buckets")


class Anchors:
    """Anchors of a block with their windows: lower and upper score limits, and the k best so far of each."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> None:
        self.ids, self.labels, self.x, self.low, self.high, self.k, self.same = ids, labels, vectors, low, high, k, same
        self.norm = np.sqrt((vectors.astype(np.float64) ** 2).sum(1))
        self.reached = np.full(low.shape, _LEAST)  # the k-th best score so far

    def walk(self, buckets: Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, int]:
        """Scores and ids (-1: none) of each window's best rows in some buckets, longest first; anchors times rows compared."""
        n, w = self.low.shape
        best, names = np.full((n, w, self.k), _LEAST), np.full((n, w, self.k), -1)
        reached, done = self.reached.copy(), 0
        for most, ids, labels, x in buckets:
            needs = np.maximum(self.low, reached).min(1)
            reach = self.norm * np.sqrt(float(most)) * (1 + 1e-9)
            live = np.flatnonzero(((needs <= reach) | (needs <= 0)) & (self.high >= self.low).any(1))
            if not len(live):
                continue
            done += len(live) * len(ids)
            score = _products(self.x[live], x, float(self.norm[live].max()) * np.sqrt(float(most)))
            other = (self.labels[live][:, None] == labels) == self.same
            other &= self.ids[live][:, None] != ids
            for j in range(w):
                fits = other & (score >= np.maximum(self.low[live, j], reached[live, j])[:, None]) & (score <= self.high[live, j][:, None])
                row, col = np.nonzero(fits)
                if not len(row):
                    continue
                # The kept rows and the new ones of each anchor in order: score, then id.
                new = live[row]
                old = np.unique(new)
                at = np.concatenate([new, np.repeat(old, self.k)])
                value = np.concatenate([score[row, col], best[old, j].reshape(-1)])
                name = np.concatenate([ids[col], names[old, j].reshape(-1)])
                order = np.lexsort((name, -value, at))
                at, value, name = at[order], value[order], name[order]
                first = np.searchsorted(at, old)
                rank = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
                keep = rank < self.k
                best[at[keep], j, rank[keep]], names[at[keep], j, rank[keep]] = value[keep], name[keep]
                reached[old, j] = np.maximum(reached[old, j], best[old, j, -1])
        return best, names, done


def _products(a: np.ndarray, b: np.ndarray, bound: float) -> np.ndarray:
    """Exact integer inner products of all rows of a and b; no part of a sum passes the bound in size."""
    if bound < 1 << 53:
        kind = np.float32 if bound < 1 << 24 else np.float64
        return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)
    return a @ b.T


_FOUND = "anchor long, win int, score long, vec_id long"


def _walker(sent):
    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        anchors: Anchors = sent.value
        rows = ((r.most, np.frombuffer(r.ids, "<i8"), np.frombuffer(r.labels, "<i8"), np.frombuffer(r.vectors, "<i8").reshape(-1, anchors.x.shape[1])) for r in pdf.sort_values("bucket").itertuples())
        best, names, _ = anchors.walk(rows)
        a, w, k = np.nonzero(names >= 0)
        return pd.DataFrame({"anchor": a, "win": w.astype(np.int32), "score": best[a, w, k], "vec_id": names[a, w, k]})

    return walk


def _searched(index: DataFrame, stripes: int, anchors: Anchors) -> DataFrame:
    """anchor (its place in the block), win, score and vec_id: the k best of each window over all stripes, as a written table.

    Rounds of 1, 1, 2, 4, ... stripes, each with the k-th scores that those before it reached.
    """
    spark, found, at = index.sparkSession, None, 0
    while at < stripes:
        to = min(stripes, max(1, 2 * at))
        own, sent = index.where((F.col("stripe") >= at) & (F.col("stripe") < to)), spark.sparkContext.broadcast(anchors)
        part = own.groupBy("stripe").applyInPandas(_walker(sent), _FOUND)
        both = part if found is None else part.unionByName(found)
        ranked = both.withColumn("r", F.row_number().over(Window.partitionBy("anchor", "win").orderBy(F.desc("score"), "vec_id")))
        found = stored(ranked.where(F.col("r") <= anchors.k).drop("r"), "negatives-found")
        if to < stripes:
            last = found.groupBy("anchor", "win").agg(F.count("*").alias("n"), F.min("score").alias("s")).where(F.col("n") == anchors.k).toPandas()  # of one block
            anchors.reached[last["anchor"].to_numpy(np.int64), last["win"].to_numpy(np.int64)] = last["s"].to_numpy(np.int64)
        at = to
    return found


_OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(rows: DataFrame, *, every: int = 100, positives: int = 5, negatives: int = 10, index: DataFrame | None = None) -> DataFrame:
    """For each anchor (id divisible by ``every``) and each of its positives the first ``negatives`` rows of the window."""
    spark = rows.sparkSession
    if index is None:
        rows = stored(rows, "negatives-rows")
        index = build(rows)
    stripes = (index.agg(F.max("stripe")).first()[0] or 0) + 1
    asked = stored(rows.where(F.col("vec_id") % every == 0).select("vec_id", "label", "v"), "negatives-anchors")
    head = asked.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    blocks = max(1, -(-head.n * (head.d or 1) * 8 // BLOCK_BYTES))
    out = None
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toArrow()  # about BLOCK_BYTES
        if not len(block):
            continue
        ids, labels = block.column("vec_id").to_numpy(), block.column("label").to_numpy()
        x = block.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        everything = np.full((len(ids), 1), _LEAST), np.full((len(ids), 1), _MOST)
        near = _searched(index, stripes, Anchors(ids, labels, x, *everything, positives, True)).toPandas()  # of one block: a few a row
        near = near.sort_values(["anchor", "score", "vec_id"], ascending=[True, False, True])
        place = near.groupby("anchor").cumcount().to_numpy()
        low, high, known = np.full((len(ids), positives), 1), np.full((len(ids), positives), 0), np.full((len(ids), positives), -1)
        score, a = near["score"].to_numpy(np.int64), near["anchor"].to_numpy(np.int64)
        low[a, place], high[a, place], known[a, place] = -(-LOW * score // 100), HIGH * score // 100, near["vec_id"]
        found = _searched(index, stripes, Anchors(ids, labels, x, low, high, negatives, False))
        pairs = spark.createDataFrame(pd.DataFrame({"anchor": a, "win": place.astype(np.int32), "anchor_id": ids[a], "positive_id": known[a, place], "positive_score": score}), "anchor long, win int, anchor_id long, positive_id long, positive_score long")
        rank = F.row_number().over(Window.partitionBy("anchor", "win").orderBy(F.desc("score"), "vec_id"))
        part = found.withColumn("rank", rank).join(pairs, ["anchor", "win"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], _OUT) if out is None else out


def oracle(table: str = "embeddings") -> str:
    """DuckDB SQL for the mined rows, all anchors against all rows."""
    return f"""WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM {table}
 WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM r AS a JOIN r AS b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.a = s.a AND NOT s.same AND {LOW} * p.score <= 100 * s.score AND 100 * s.score <= {HIGH} * p.score WINDOW w AS (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) QUALIFY row_number() OVER w <= 10"""
