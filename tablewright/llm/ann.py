"""Approximate nearest neighbours: a hierarchical navigable small-world graph for each shard, results merged.

Equal vectors are one node that keeps the k + 1 smallest ids, so that copies can't wall off a part of the graph and
a hot vector's rows are cut down before they are shuffled.  Nodes are dealt into shards of bounded size by hash.  A
shard's graph grows by batches: each batch searches the layers built so far, links to diverse neighbours and is linked
back; the layers are stored as flat neighbour arrays in a written table.  Queries are broadcast in blocks of
bounded size; each task walks its shards' graphs for all queries of a block at once and hands on its k best.

Every query walks every shard: vectors without clusters leave no shard out (on such ones, half of 64 clusters had to be
asked to find nine tenths of the neighbours), so what can be saved is saved by large shards, whose walk grows far slower than they.

Distances steer the search in single precision; those returned are computed in double precision from the vectors.

Defined results: vectors that are null, zero, of another than the commonest length, or hold a null or non-finite component
take no part; of queries with equal ids the least vector asks; ties go to the smaller id; with fewer than k candidates
all are returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.shared import prepare, stored, wanted

#: Vectors of a shard on average; links of a node above the ground layer and on it; candidates kept while building and while searching.
SHARD, LINKS, GROUND, BUILD, SEARCH = 16_384, 16, 32, 64, 224
#: Vectors inserted at once, and bytes of queries that are broadcast at once.
BATCH, BLOCK_BYTES = 256, 32 << 20


class Graph:
    """Layers of a small-world graph: for each its nodes and their neighbours in one flat array (-1: none)."""

    def __init__(self, vectors: np.ndarray, nodes: list[np.ndarray] | None = None, links: list[np.ndarray] | None = None) -> None:
        self.x = np.ascontiguousarray(vectors, np.float32)
        self.norm = np.einsum("ij,ij->i", self.x, self.x)
        n = len(self.x)
        if nodes is not None:
            self.nodes, self.links = nodes, links
            self.rows = [self._rows(a) for a in nodes]
            self.entry = int(nodes[-1][0])
            return
        # Heights fall geometrically; seeded by the position in the shard, so a rerun builds the same graph.
        height = np.floor(-np.log(np.random.default_rng(n).random(n)) / np.log(LINKS)).astype(np.int64)
        order = np.argsort(-height, kind="stable") if n else np.zeros(0, np.int64)
        self.entry = int(order[0]) if n else -1
        self.nodes = [np.flatnonzero(height >= lv) for lv in range(int(height.max(initial=0)) + 1)]
        self.rows = [self._rows(a) for a in self.nodes]
        self.links = [np.full((len(a), LINKS if lv else GROUND), -1, np.int32) for lv, a in enumerate(self.nodes)]
        # The highest go first: every layer is whole before the one under it needs it as a way in.
        at = 0
        while at < n:
            to = min(n, at + max(1, min(BATCH, at)))
            self._insert(order[at:to], height)
            at = to

    def _rows(self, nodes: np.ndarray) -> np.ndarray:
        out = np.full(len(self.x), -1, np.int32)
        out[nodes] = np.arange(len(nodes))
        return out

    def _distances(self, q: np.ndarray, qn: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.maximum(qn[:, None] + self.norm[at] - 2 * np.einsum("qd,qkd->qk", q, self.x[at]), 0)

    def search(self, q: np.ndarray, entry: np.ndarray, ef: int, layer: int, wide: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Best-first search of a layer for many queries at once: nodes (-1: none) and squared distances, nearest first."""
        m, n = len(q), len(self.x)
        qn = np.einsum("ij,ij->i", q, q)
        node, far = np.full((m, ef), -1, np.int64), np.full((m, ef), np.inf, np.float32)
        k = min(ef, entry.shape[1])
        node[:, :k], far[:, :k] = entry[:, :k], np.where(entry[:, :k] >= 0, self._distances(q, qn, entry[:, :k]), np.inf)
        done = node < 0
        seen = np.zeros((m, n + 1), bool)  # the last column takes the gaps
        np.put_along_axis(seen, np.where(node >= 0, node, n), True, 1)
        live = np.arange(m)
        wide = min(wide, ef)
        while len(live):
            own_done, own_far = done[live], far[live]
            # The nearest few that haven't been expanded; rows without any are finished.
            rank = np.where(own_done, np.inf, own_far)
            pick = np.argsort(rank, axis=1)[:, :wide] if wide > 1 else np.argmin(rank, axis=1)[:, None]
            open_ = np.isfinite(np.take_along_axis(rank, pick, 1))
            going = open_.any(1)
            live, pick, open_ = live[going], pick[going], open_[going]
            if not len(live):
                break
            mark = done[live]
            np.put_along_axis(mark, pick, True, 1)
            done[live] = mark
            source = np.where(open_, np.take_along_axis(node[live], pick, 1), -1)
            near = np.where(source[:, :, None] >= 0, self.links[layer][self.rows[layer][np.maximum(source, 0)]], -1).reshape(len(live), -1)
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1  # the same neighbour of two nodes
            near[np.take_along_axis(seen[live], np.where(near >= 0, near, n), 1)] = -1
            flat = np.where(near >= 0, near, n)
            seen[live[:, None], flat] = True
            dist = np.where(near >= 0, self._distances(q[live], qn[live], np.maximum(near, 0)), np.inf).astype(np.float32)
            dist = np.where(dist < far[live][:, -1:], dist, np.inf)
            all_far = np.concatenate([far[live], dist], 1)
            keep = np.argsort(all_far, axis=1, kind="stable")[:, :ef]
            far[live] = np.take_along_axis(all_far, keep, 1)
            node[live] = np.where(np.isfinite(far[live]), np.take_along_axis(np.concatenate([node[live], near], 1), keep, 1), -1)
            done[live] = np.take_along_axis(np.concatenate([done[live], np.zeros(dist.shape, bool)], 1), keep, 1) | (node[live] < 0)
        return node, far

    def _select(self, near: np.ndarray, far: np.ndarray, most: int) -> np.ndarray:
        """Up to ``most`` of each row's candidates (nearest first): those nearer to the row's node than to one already chosen, then the nearest of the rest."""
        m, k = near.shape
        vec = self.x[np.maximum(near, 0)]
        norm = self.norm[np.maximum(near, 0)]
        between = norm[:, :, None] + norm[:, None, :] - 2 * np.einsum("mkd,mjd->mkj", vec, vec, optimize=True)
        good = near >= 0
        kept = np.zeros((m, k), bool)
        for j in range(k):
            hidden = (kept[:, :j] & (between[:, j, :j] < far[:, j : j + 1])).any(1)
            kept[:, j] = good[:, j] & ~hidden & (kept[:, :j].sum(1) < most)
        order = np.argsort(np.where(good, np.where(kept, 0, 1), 2), axis=1, kind="stable")[:, :most]
        return np.where(np.take_along_axis(good, order, 1), np.take_along_axis(near, order, 1), -1)

    def _insert(self, new: np.ndarray, height: np.ndarray) -> None:
        q = self.x[new]
        first = new[0] == self.entry
        entry = np.full((len(new), 1), -1 if first else self.entry, np.int64)
        for layer in range(len(self.nodes) - 1, -1, -1):
            stays = height[new] >= layer
            if not first and (~stays).any():
                got, _ = self.search(q[~stays], entry[~stays][:, :1], 1, layer, 1)
                entry[~stays, 0] = got[:, 0]
            own = np.flatnonzero(stays)
            if not len(own):
                continue
            near, far = self.search(q[own], entry[own], BUILD, layer) if not first else (np.full((len(own), 1), -1), np.full((len(own), 1), np.inf, np.float32))
            # Members of the same batch see each other directly.
            mates = np.broadcast_to(new[own], (len(own), len(own)))
            apart = self._distances(q[own], self.norm[new[own]], mates)
            np.fill_diagonal(apart, np.inf)
            near, far = np.concatenate([near, np.where(np.isfinite(apart), mates, -1)], 1), np.concatenate([far, apart], 1)
            best = np.argsort(far, axis=1, kind="stable")[:, :BUILD]
            near, far = np.take_along_axis(near, best, 1), np.take_along_axis(far, best, 1)
            near = np.where(np.isfinite(far), near, -1)
            chosen = self._select(near, far, LINKS)
            self.links[layer][self.rows[layer][new[own]], : chosen.shape[1]] = chosen
            self._link_back(layer, new[own], chosen)
            if not first:
                entry[own, 0] = np.where(near[:, 0] >= 0, near[:, 0], entry[own, 0])

    def _link_back(self, layer: int, new: np.ndarray, chosen: np.ndarray) -> None:
        links = self.links[layer]
        most = links.shape[1]
        to, source = chosen.reshape(-1), np.repeat(new, chosen.shape[1])
        source, to = source[to >= 0], to[to >= 0]
        order = np.argsort(to, kind="stable")
        to, source = to[order], source[order]
        targets, start, count = np.unique(to, return_index=True, return_counts=True)
        for at in range(0, len(targets), 512):
            t, c = targets[at : at + 512], count[at : at + 512]
            more = np.full((len(t), int(c.max())), -1, np.int64)
            fill = np.arange(more.shape[1])[None] < c[:, None]
            more[fill] = source[start[at] : start[at] + c.sum()]
            both = np.concatenate([links[self.rows[layer][t]].astype(np.int64), more], 1)
            both.sort(axis=1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            far = np.where(both >= 0, self._distances(self.x[t], self.norm[t], np.maximum(both, 0)), np.inf)
            best = np.argsort(far, axis=1, kind="stable")[:, : 2 * most]
            both, far = np.take_along_axis(both, best, 1), np.take_along_axis(far, best, 1)
            full = (both >= 0).sum(1) > most
            out = both[:, :most].copy()
            if full.any():
                out[full] = self._select(both[full], far[full], most)
            links[self.rows[layer][t], : out.shape[1]] = out
            links[self.rows[layer][t], out.shape[1] :] = -1

    def nearest(self, q: np.ndarray, k: int, ef: int = SEARCH) -> np.ndarray:
        """The k nearest nodes found for each query (-1: none)."""
        q = np.ascontiguousarray(q, np.float32)
        entry = np.full((len(q), 1), self.entry, np.int64)
        for layer in range(len(self.nodes) - 1, 0, -1):
            entry = self.search(q, entry, 1, layer, 1)[0]
        return self.search(q, entry, max(ef, k), 0)[0][:, :k]


# ---------------------------------------------------------------- shards


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id and v (array of float) of the rows that take part."""
    rows = wanted(vectors, id_col, vec_col).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<float>").alias("v"))
    fine = rows.where("vec_id IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(v, x -> x <> 0)")
    common = fine.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return fine.where(F.size("v") == (common[0].d if common else 0))


def build(rows: DataFrame, k: int = 10) -> DataFrame:
    """The index: one row per shard with its vectors, member ids and flat layers, as a written table."""
    prepare(rows.sparkSession)
    own = rows.withColumn("at", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("at") <= k + 1)
    nodes = stored(own.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "ann-nodes")
    shards = max(1, -(-nodes.count() // SHARD))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held or not sum(map(len, held)):
            return
        table = pa.Table.from_batches(held).combine_chunks()
        v, ids = table.column("v").combine_chunks(), table.column("ids").combine_chunks()
        x = v.flatten().to_numpy(zero_copy_only=False).reshape(len(table), -1)
        order = np.lexsort(x.T[::-1])  # whatever order the rows come in, the graph is the same
        x, ids = x[order], ids.take(pa.array(order))
        g = Graph(x)
        counts = np.diff(np.concatenate([[0], np.cumsum([len(i) for i in ids])]))
        yield pa.RecordBatch.from_pydict({
            "dim": pa.array([x.shape[1]], pa.int32()), "vectors": pa.array([x.astype("<f4").tobytes()], pa.binary()), "ids": pa.array([ids.flatten().to_pylist()], pa.list_(pa.int64())), "counts": pa.array([counts.astype("<i4").tobytes()], pa.binary()),
            "nodes": pa.array([[a.astype("<i4").tobytes() for a in g.nodes]], pa.list_(pa.binary())), "links": pa.array([[a.astype("<i4").tobytes() for a in g.links]], pa.list_(pa.binary())),
        })

    schema = "dim int, vectors binary, ids array<long>, counts binary, nodes array<binary>, links array<binary>"
    return stored(nodes.repartitionById(shards, F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int")).mapInArrow(make, schema), "ann-index")


def search(index: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k nearest; queries: vec_id and v."""
    spark = index.sparkSession
    asked = stored(queries.groupBy("vec_id").agg(F.min("v").alias("v")), "ann-queries")
    head = asked.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    blocks = max(1, -(-head.n * (head.d or 1) * 4 // BLOCK_BYTES))
    shards = index.repartition(max(1, index.count()))
    found = None
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toArrow()  # about BLOCK_BYTES
        if not len(block):
            continue
        names = block.column("vec_id").to_numpy()
        vectors = block.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(names), -1)
        sent = spark.sparkContext.broadcast((names, vectors))

        def walk(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            names, vectors = sent.value
            parts = []
            for pdf in batches:
                for r in pdf.itertuples():
                    x = np.frombuffer(r.vectors, "<f4").reshape(-1, r.dim)
                    nodes = [np.frombuffer(a, "<i4") for a in r.nodes]
                    g = Graph(x, nodes, [np.frombuffer(a, "<i4").reshape(len(nodes[i]), -1) for i, a in enumerate(r.links)])
                    counts = np.frombuffer(r.counts, "<i4").astype(np.int64)
                    ids, first = np.asarray(r.ids), np.cumsum(counts) - counts
                    for at in range(0, len(names), 512):
                        got = g.nearest(vectors[at : at + 512], k + 1)
                        row, col = np.nonzero(got >= 0)
                        node = got[row, col]
                        score = np.sqrt(((vectors[at : at + 512][row].astype(np.float64) - x[node].astype(np.float64)) ** 2).sum(1))
                        n = counts[node]
                        member = np.repeat(first[node] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                        part = pd.DataFrame({"query_id": np.repeat(names[at : at + 512][row], n), "vec_id": ids[member], "score": np.repeat(score, n)})
                        parts.append(part[part["query_id"] != part["vec_id"]])
                    if len(parts) > 8:
                        parts = [_best(parts, k)]
            if parts:
                yield _best(parts, k)

        part = stored(shards.mapInPandas(walk, "query_id long, vec_id long, score double"), "ann-found")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _best(parts: list[pd.DataFrame], k: int) -> pd.DataFrame:
    rows = pd.concat(parts).sort_values(["query_id", "score", "vec_id"])
    return rows.groupby("query_id", sort=False).head(k)
