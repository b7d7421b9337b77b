"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

A logistic model over binned statistics of a text gives each document's evidence.  Grouped aggregation turns it, or the
label where a document has one, into rates of good documents for every path within every host; the strength of each level's
prior comes from how much the rates vary beyond chance, so sparse paths shrink towards their host and sparse hosts towards all
documents.  A document's quality is its evidence, shifted by its path's rate without itself against the overall rate.

The model learns from a bounded sample of labelled rows (``SAMPLE``, by hash), which also count as labels in the rates; rates
use all documents.  Host and path are named columns: where a table has no addresses, as here, its source stands for
the host and its language for the path.

Defined results: null and empty texts have the statistics of an empty text; null host and path are values of their own; rows with
equal or null ids are scored one by one; null labels teach nothing, of several labels of an id the least counts, and without
both classes evidence is the overall share; an empty table gives an empty result; other columns are passed by.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.llm.shared import LOWER, TextBlock, attach, blocks, column, owned, prepare, span_keys, stored, wanted, word_spans

#: Labelled documents that teach at most; bins of a statistic.
SAMPLE, BINS = 40_000, 10
STATISTICS = ["log_bytes", "log_words", "word_length", "upper", "digit", "mark", "pipe", "bang", "odd_mark", "capital", "again", "distinct", "short", "no_letter", "line_words", "line_again", "high"]


def statistics(block: TextBlock) -> np.ndarray:
    """One row of STATISTICS for each text."""
    buf, n = block.buf, len(block)
    size = np.diff(block.offs).astype(float)
    owner = np.repeat(np.arange(n), np.diff(block.offs))

    def share(mask: np.ndarray) -> np.ndarray:
        return np.bincount(owner[mask], minlength=n) / np.maximum(size, 1)

    kind = _KINDS[buf]
    starts, ends, rows = word_spans(block)
    words = np.bincount(rows, minlength=n).astype(float)
    w = np.maximum(words, 1)
    keys = span_keys(LOWER[buf], starts, ends)
    per = lambda mask: np.bincount(rows[mask], minlength=n) / w
    again = np.zeros(len(keys), bool)
    again[1:] = (keys[1:] == keys[:-1]) & (rows[1:] == rows[:-1])
    order = np.lexsort((keys, rows))
    k, r = keys[order], rows[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
    # In long texts common words repeat anyway: the share of distinct words is set against what Heaps' law expects.
    distinct = np.bincount(r[new], minlength=n) / np.maximum(words, 1) ** 0.85
    letters = np.concatenate([[0], np.cumsum((kind == 1) | (kind == 2) | (kind == 6))])
    no_letter = letters[ends] == letters[starts]
    lines, line_ends, line_rows = _lines(block)
    line_keys = span_keys(buf, lines, line_ends)
    order = np.lexsort((line_keys, line_rows))
    lk, lr = line_keys[order], line_rows[order]
    same = np.zeros(len(lk), bool)
    same[1:] = (lk[1:] == lk[:-1]) & (lr[1:] == lr[:-1])
    n_lines = np.maximum(np.bincount(line_rows, minlength=n), 1)
    out = [
        np.log1p(size), np.log1p(words), size / w, share(kind == 1), share(kind == 3), share(kind >= 7), share(buf == 124), share(buf == 33), share(kind == 8), per(kind[starts] == 1),
        per(again), distinct, per(ends - starts <= 3), per(no_letter), np.log1p(words / n_lines), np.bincount(lr[same], minlength=n) / n_lines, share(kind == 6),
    ]
    return np.stack(out, 1)


_KINDS = np.full(256, 7, np.uint8)  # other marks
_KINDS[65:91], _KINDS[97:123], _KINDS[48:58], _KINDS[128:] = 1, 2, 3, 6
_KINDS[[32, 9, 10, 11, 12, 13]] = 4
_KINDS[list(b"#$%&*@^~<>{}[]\\|=+_")] = 8


def _lines(block: TextBlock) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(block.buf)
    cut = np.zeros(n + 1, bool)
    cut[block.offs] = True
    cut[1:] |= block.buf == 10
    marks = np.flatnonzero(cut)
    starts, ends = marks[:-1], marks[1:]
    return starts, ends, np.searchsorted(block.offs, starts, "right") - 1


@dataclass
class Model:
    """Bin edges of each statistic and the weights of the bins."""

    edges: np.ndarray
    weights: np.ndarray

    def design(self, stats: np.ndarray) -> np.ndarray:
        out = np.ones((len(stats), 1 + stats.shape[1] * BINS), np.float32)
        out[:, 1:] = 0
        for k in range(stats.shape[1]):
            out[np.arange(len(stats)), 1 + k * BINS + np.searchsorted(self.edges[k], stats[:, k], "right")] = 1
        return out

    def evidence(self, stats: np.ndarray) -> np.ndarray:
        """Probability that each document is good."""
        z = np.full(len(stats), self.weights[0])
        for k in range(stats.shape[1]):
            z += self.weights[1 + k * BINS :][np.searchsorted(self.edges[k], stats[:, k], "right")]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(stats: np.ndarray, good: np.ndarray) -> Model:
    """Penalised logistic regression by Newton's method."""
    y = np.asarray(good, float)
    edges = np.stack([np.quantile(stats[:, k], np.linspace(0, 1, BINS + 1)[1:-1]) if len(stats) else np.zeros(BINS - 1) for k in range(len(STATISTICS))])
    model = Model(edges, np.zeros(1 + len(STATISTICS) * BINS))
    share = (y.sum() + 0.5) / (len(y) + 1)
    model.weights[0] = np.log(share / (1 - share))
    if len(set(y.tolist())) < 2:
        return model
    x = model.design(stats).astype(float)
    penalty = np.full(x.shape[1], 1.0)
    penalty[0] = 1e-6
    for _ in range(15):
        p = 1 / (1 + np.exp(-np.clip(x @ model.weights, -30, 30)))
        grad = x.T @ (p - y) + penalty * model.weights
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty), grad)
        model.weights -= step
        if np.abs(step).max() < 1e-6:
            break
    return model


def taught(labels: DataFrame, *, sample: int = SAMPLE, folds: int = 3, held_out: int = 1) -> DataFrame:
    """doc_id and quality of the first ``sample`` labelled ids by hash, outside the held-out fold, as a written table."""
    prepare(labels.sparkSession)
    marked = wanted(labels, "doc_id", "quality").where("quality IN (0, 1) AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("quality"))
    marked = marked.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != held_out).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return stored(marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "quality-labels")


def learn(docs: DataFrame, marked: DataFrame) -> Model:
    """Fit on the documents of a ``taught`` table; only statistics reach the driver."""
    prepare(docs.sparkSession)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                yield pa.RecordBatch.from_pydict({"quality": batch.column(0).slice(block.first, len(block)), "s": pa.array(list(statistics(block)), pa.list_(pa.float64()))})

    texts = wanted(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    # Of several texts under one id the least teaches: rows that reach the driver are ids of the table, whatever their copies.
    one = texts.join(F.broadcast(marked), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    got = one.select("quality", "text").mapInArrow(measure, "quality int, s array<double>").toArrow()
    stats = got.column("s").combine_chunks().flatten().to_numpy().reshape(-1, len(STATISTICS))
    order = np.lexsort(stats.T)  # the same model whatever order the rows come in
    return fit(stats[order], got.column("quality").to_numpy()[order])


# ---------------------------------------------------------------- rates of hosts and paths

_SITE = ["__host", "__path"]


def _named(docs: DataFrame, marked: DataFrame | None, host: str, path: str, text: str) -> DataFrame:
    """The documents under neutral names, with their site (null is a value of its own), text and label, if they have one."""
    rows, first = owned(docs)
    site = {n: F.coalesce(F.concat(F.lit("="), column(first, c)), F.lit("")) for n, c in zip(_SITE, (host, path), strict=True)}
    rows = rows.withColumns(site | {"__t": column(first, text), "__id": column(first, "doc_id", "long")})
    if marked is None:
        return rows.withColumn("__label", F.lit(None).cast("int"))
    return rows.join(F.broadcast(marked.toDF("__id", "__label")), "__id", "left")  # `sample` rows at most


def _worth(ev: np.ndarray, label: pa.Array) -> np.ndarray:
    """What each document adds to its site's good ones: its label, or else its evidence."""
    known = label.to_numpy(zero_copy_only=False).astype(float)
    return np.where(np.isnan(known), ev, known)


def rates(docs: DataFrame, model: Model, marked: DataFrame | None = None, *, host: str = "source", path: str = "lang", text: str = "text") -> tuple[DataFrame, float]:
    """__host, __path, n, good, host_rate and strength of every path as a written table, and the overall rate."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ev = np.concatenate([*[sent.value.evidence(statistics(b)) for b in blocks(batch.column(2))], np.zeros(0)])
            own = pa.Table.from_arrays([batch.column(0), batch.column(1), pa.array(_worth(ev, batch.column(3)))], ["__host", "__path", "p"]).group_by(_SITE).aggregate([("p", "sum"), ("p", "count")])
            yield from own.select([*_SITE, "p_count", "p_sum"]).rename_columns([*_SITE, "n", "good"]).combine_chunks().to_batches()

    sites = _named(docs, marked, host, path, text).select(*_SITE, "__t", "__label").mapInArrow(add, "__host string, __path string, n long, good double")
    paths = stored(sites.groupBy(*_SITE).agg(F.sum("n").alias("n"), F.sum("good").alias("good")), "quality-paths")
    hosts = paths.groupBy("__host").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good"))
    whole = hosts.agg(F.sum("host_n").alias("n"), F.sum("host_good").alias("good")).first()
    mean = (whole.good + 0.5) / (whole.n + 1) if whole.n else 0.5
    k0 = _strength(hosts.select((F.col("host_good") / F.col("host_n")).alias("r"), F.lit(mean).alias("m"), F.col("host_n").alias("n")))
    hosts = hosts.select("__host", ((F.col("host_good") + k0 * mean) / (F.col("host_n") + k0)).alias("host_rate"))
    both = attach(paths, stored(hosts, "quality-hosts"), ["__host"])
    k1 = _strength(both.select((F.col("good") / F.col("n")).alias("r"), F.col("host_rate").alias("m"), "n"))
    return stored(both.withColumn("strength", F.lit(float(k1))), "quality-rates"), float(mean)


def _strength(groups: DataFrame) -> float:
    """Prior rows of a beta prior by moments: how much the groups' rates r vary about m beyond what n rows explain."""
    g = groups.agg(F.sum(F.col("n") * (F.col("r") - F.col("m")) ** 2).alias("spread"), F.sum(F.col("m") * (1 - F.col("m"))).alias("chance"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m") * (1 - F.col("m"))).alias("mass")).first()
    if not g.n:
        return 1.0
    between = max((g.spread - g.chance) / g.n, 1e-9)
    return float(min(max(g.mass / g.n / between - 1, 1.0), 1e6))


def assess(docs: DataFrame, model: Model, marked: DataFrame | None = None, *, host: str = "source", path: str = "lang", text: str = "text", threshold: float = 0.5, only_kept: bool = False) -> DataFrame:
    """All columns of the documents with __evidence, __host_rate, __path_rate, __quality and __keep.

    With ``only_kept`` only the documents that stay, with their own columns.
    """
    prepare(docs.sparkSession)
    table, mean = rates(docs, model, marked, host=host, path=path, text=text)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    site = ["__n", "__good", "__rate", "__strength"]
    rows = attach(_named(docs, marked, host, path, text), table.select(*_SITE, "n", "good", "host_rate", "strength").toDF(*_SITE, *site), _SITE)
    kept = docs.toDF(*[f"__own_{i}" for i in range(len(docs.columns))]).schema.fields
    names = [f.name for f in kept]
    rows = rows.select(*names, *site, "__t", "__label")
    logit = lambda p: np.log(p) - np.log1p(-p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sum_, host_rate, strength = (batch.column(len(names) + k).to_numpy(zero_copy_only=False) for k in range(4))
            ev = np.concatenate([*[sent.value.evidence(statistics(b)) for b in blocks(batch.column(len(names) + 4))], np.zeros(0)])
            # The path's rate without the document itself.
            rate = (np.maximum(sum_ - _worth(ev, batch.column(len(names) + 5)), 0) + strength * host_rate) / (n - 1 + strength)
            rate = np.clip(rate, 1e-6, 1 - 1e-6)
            z = logit(np.clip(ev, 1e-9, 1 - 1e-9)) + logit(rate) - logit(mean)
            quality = 1 / (1 + np.exp(-z))
            keep = quality >= threshold
            own = batch.select(list(range(len(names))))
            if only_kept:
                yield own.filter(pa.array(keep))
                continue
            arrays = [*own.columns, pa.array(ev), pa.array(host_rate), pa.array(rate), pa.array(quality), pa.array(keep)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*own.schema.names, "__evidence", "__host_rate", "__path_rate", "__quality", "__keep"])

    extra = [] if only_kept else [T.StructField(c, T.DoubleType()) for c in ("__evidence", "__host_rate", "__path_rate", "__quality")] + [T.StructField("__keep", T.BooleanType())]
    return rows.mapInArrow(run, T.StructType([*kept, *extra])).toDF(*docs.columns, *[f.name for f in extra])
