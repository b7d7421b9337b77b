"""A Merkle manifest of a dataset: a tree of 16 children over the rows of each source, one over the sources' roots, proofs and folds.

Rows become leaves in the JVM; texts go no further.  Leaves get gap-free positions by sampled ranges, and every block of
leaves of a source is reduced by one task to its root.  Blocks' roots are reduced the same way, round by round, until
a few thousand remain: that small top tree is built by the driver, and each of its nodes' ways up to the root (the hashes
before and after it on every level) is broadcast.  On the way back each round's blocks pass on their ways, and the tasks of
the last one finish proofs and folds, a row at a time.  A group holds a block at most, whatever the sources' sizes.

Defined results: rows are ordered by source (null first, then bytewise), id (null first) and leaf, so rows with equal ids have a
fixed order and equal rows have any; null and empty texts differ (``-`` against ``0:``); a source with one row is that
leaf, a table with one source has that source's root, an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.shared import attach, prepare, stored, wanted
from tablewright.operators.occurrence import numbered

#: Children of a node.
ARITY = 16
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text: str) -> str:
    """Lower-case hexadecimal SHA-256."""
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*fields: Column) -> Column:
    """A row's leaf: each field is its number of bytes, a colon and itself, or a hyphen for null."""
    told = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.sha2(F.concat(*told), 256)


def tampered(doc_id: Column) -> Column:
    """Rows whose text is lower-cased: 5 divides the CRC-32 of the id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


class Levels:
    """The levels of a tree over some nodes; ``depth``: how many there are above the nodes (None: up to a single node)."""

    def __init__(self, nodes: list[str], depth: int | None = None) -> None:
        self.runs: list[list[str]] = []  # on each level the hashes of each run, joined
        while len(nodes) > 1 if depth is None else len(self.runs) < depth:
            self.runs.append(["".join(nodes[i : i + ARITY]) for i in range(0, len(nodes), ARITY)])
            nodes = [digest(run) for run in self.runs[-1]]
        self.root = nodes[0]

    def way(self, at: int) -> list[tuple[str, str]]:
        """What stands before and after the node in its run, level by level."""
        out = []
        for runs in self.runs:
            run, own = runs[at // ARITY], at % ARITY * 64
            out.append((run[:own], run[own + 64 :]))
            at //= ARITY
        return out


@dataclass(frozen=True)
class Shape:
    """Leaves or nodes that one task reduces (a power of ARITY), and nodes of the top tree at most."""

    block: int = 4096
    top: int = 4096

    def levels(self, nodes: list[str], size: int) -> Levels:
        """Of one block of a list of ``size`` nodes: the blocks of a longer list rise by as many levels each."""
        return Levels(nodes, None if size <= self.block else (self.block.bit_length() - 1) // (ARITY.bit_length() - 1))


#: Hashes before and after a node on every level up to the root, and the root of its source.
Way = tuple[list[str], list[str], str]
_WAY = "list long, at long, before array<string>, after array<string>, subroot string"


def _reduced(nodes: DataFrame, shape: Shape) -> DataFrame:
    """The roots of all blocks: list, at (from 0), h and n (nodes of the list), for nodes with the same."""

    def reduce(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        first = pdf.iloc[0]
        return pd.DataFrame({"list": [first["list"]], "at": [first["at"] // shape.block], "h": [shape.levels(pdf["h"].tolist(), first["n"]).root], "n": [-(-first["n"] // shape.block)]})

    found = nodes.groupBy("list", _block(shape)).applyInPandas(reduce, "list long, at long, h string, n long")
    return stored(found, "merkle-blocks")


def _block(shape: Shape) -> Column:
    return F.floor(F.col("at") / shape.block).cast("long").alias("block")


def _top(nodes: DataFrame) -> tuple[dict[tuple[int, int], Way], str]:
    """The ways of at most ``top`` nodes up to the root, and the root: built by the driver."""
    lists: dict[int, list[str]] = {}
    for r in nodes.select("list", "at", "h").orderBy("list", "at").collect():
        lists.setdefault(r.list, []).append(r.h)
    trees = {k: Levels(v) for k, v in lists.items()}
    above, ways = Levels([t.root for t in trees.values()]), {}
    for i, (k, t) in enumerate(trees.items()):
        for at in range(len(lists[k])):
            way = t.way(at) + above.way(i)
            ways[k, at] = ([x for x, _ in way], [x for _, x in way], t.root)
    return ways, above.root


def _opened(nodes: DataFrame, ways: dict[tuple[int, int], Way] | DataFrame, shape: Shape, schema: str, rows: Callable) -> DataFrame:
    """``rows(nodes, levels, way up, subroot)`` of each block; ways that the driver built are broadcast, others meet their blocks."""

    def open_(pdf: pd.DataFrame, way: Way) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        levels = shape.levels(pdf["h"].tolist(), pdf["n"].iloc[0])
        return rows(pdf, levels, list(zip(way[0], way[1], strict=True)), way[2])

    if isinstance(ways, dict):
        sent = nodes.sparkSession.sparkContext.broadcast(ways)
        return nodes.groupBy("list", _block(shape)).applyInPandas(lambda key, pdf: open_(pdf, sent.value[int(key[0]), int(key[1])]), schema)
    return nodes.groupBy("list", _block(shape)).cogroup(ways.groupBy("list", "at")).applyInPandas(lambda _, pdf, way: open_(pdf, tuple(way.iloc[0][["before", "after", "subroot"]])), schema)


def _ways(nodes: DataFrame, shape: Shape) -> tuple[dict[tuple[int, int], Way] | DataFrame, str]:
    """The ways of all nodes (list, at, h, n) up to the root, and the root."""
    spark = nodes.sparkSession
    if nodes.limit(shape.top + 1).count() <= shape.top:
        return _top(nodes)
    if nodes.where("n > 1").head(1):

        def own(pdf: pd.DataFrame, levels: Levels, up: list, subroot: str) -> pd.DataFrame:
            ways = [levels.way(i) + up for i in range(len(pdf))]
            return pd.DataFrame({"list": pdf["list"], "at": pdf["at"], "before": [[x for x, _ in w] for w in ways], "after": [[x for _, x in w] for w in ways], "subroot": subroot})

        ways, root = _ways(_reduced(nodes, shape), shape)
        return stored(_opened(nodes, ways, shape, _WAY, own), "merkle-ways"), root
    # Every source has come down to its root, and there are many: from here on they are one list.
    roots = numbered(nodes, "list", "place").select(F.lit(0).cast("long").alias("list"), (F.col("place") - 1).alias("at"), "h", F.lit(nodes.count()).cast("long").alias("n"), F.col("list").alias("own"))
    ways, root = _ways(roots.drop("own"), shape)
    if isinstance(ways, dict):
        ways = spark.createDataFrame([(*k, *w) for k, w in ways.items()], _WAY)
    back = roots.select("at", "own", "h").join(ways.select("at", "before", "after"), "at")
    return stored(back.select(F.col("own").alias("list"), F.lit(0).cast("long").alias("at"), "before", "after", F.col("h").alias("subroot")), "merkle-ways"), root


_OUT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def manifest(docs: DataFrame, shape: Shape = Shape()) -> DataFrame:  # noqa: B008
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row."""
    prepare(docs.sparkSession)
    rows = wanted(docs, *FIELDS)
    fields = [F.col(c) for c in FIELDS]
    other = F.when(tampered(F.col("doc_id")), leaf(*fields[:-1], F.translate(F.col("text").cast("string"), UPPER, LOWER)))
    leaves = stored(rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), leaf(*fields).alias("h"), other.alias("tampered")), "merkle-leaves")
    placed = numbered(leaves, ["source", "doc_id", "h"])
    # A source is known by its place among the sources; its first position makes places of its own.
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))  # null is a source, too
    sources = numbered(placed.groupBy("source").agg(F.min("pos").alias("first"), F.count("*").alias("n")), "source", "list")
    sources = stored(sources.select(key.alias("key"), F.col("list").cast("long").alias("list"), "first", "n"), "merkle-sources")
    nodes = stored(attach(placed.withColumn("key", key), sources, ["key"]).select("list", (F.col("pos") - F.col("first")).alias("at"), "h", "n", "doc_id", "tampered"), "merkle-nodes")
    if not nodes.head(1):
        return docs.sparkSession.createDataFrame([], _OUT)
    ways, root = _ways(_reduced(nodes.select("list", "at", "h", "n"), shape), shape)

    def finish(pdf: pd.DataFrame, levels: Levels, up: list, subroot: str) -> pd.DataFrame:
        rest = "".join(a + b for a, b in up)
        proofs, folded = [], []
        for i, (h, changed) in enumerate(zip(pdf["h"], pdf["tampered"], strict=True)):
            own, now = levels.way(i), changed or h
            proofs.append(digest("".join(a + b for a, b in own) + rest))
            for a, b in own + up:
                now = digest(a + now + b)
            folded.append(now)
        return pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "leaf": pdf["h"], "subroot": subroot, "root": root, "proof_sha256": proofs, "folded_root": folded, "verified": [x == root for x in folded]})

    return _opened(nodes, ways, shape, _OUT, finish)


#: CRC-32 of a text of ASCII characters, by the bits of its reflected polynomial.
_CRC32 = "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split({}, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, x: list_reduce(list_prepend(xor(a, x), [CAST(0 AS BIGINT) for i in range(8)]), lambda r, i: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)), 4294967295)"


def oracle(table: str = "documents") -> str:
    """DuckDB SQL for ``manifest``, level by level."""
    told = [f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in FIELDS[:-1]]
    text, low = "coalesce(strlen(text) || ':' || text, '-')", f"coalesce(strlen(text) || ':' || translate(text, '{UPPER}', '{LOWER}'), '-')"
    crc = _CRC32.format("CAST(doc_id AS VARCHAR)")
    return f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, source, sha256({' || '.join([*told, text])}) AS h, CASE WHEN {crc} % 5 = 0 THEN sha256({' || '.join([*told, low])}) END AS other FROM {table}),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h, rid) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n, dense_rank() OVER (ORDER BY source NULLS FIRST) AS list FROM d),
t AS (SELECT 0 AS level, list, pos, h, n FROM p UNION ALL SELECT level + 1, list, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), (n + 15) // 16 FROM t WHERE n > 1 GROUP BY level, list, pos // 16, n),
s AS (SELECT list, h FROM t WHERE n = 1),
u AS (SELECT 0 AS level, row_number() OVER (ORDER BY list) - 1 AS pos, h, count(*) OVER () AS n FROM s UNION ALL SELECT level + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), (n + 15) // 16 FROM u WHERE n > 1 GROUP BY level, pos // 16, n),
root AS (SELECT h FROM u WHERE n = 1),
nodes AS (SELECT list, level, pos, h FROM t WHERE n > 1 UNION ALL SELECT -1, level, pos, h FROM u WHERE n > 1),
depth AS (SELECT list, max(level) + 1 AS deep FROM t GROUP BY list),
place AS (SELECT list, row_number() OVER (ORDER BY list) - 1 AS pos FROM s),
f AS (SELECT rid, 0 AS level, list, p.pos, coalesce(other, h) AS now, '' AS proof, deep - 1 AS deep, q.pos AS place FROM p JOIN depth USING (list) JOIN place AS q USING (list)
UNION ALL SELECT f.rid, f.level + 1, f.list, CASE WHEN f.level + 1 = f.deep THEN f.place ELSE f.pos // 16 END, CASE WHEN count(o.h) = 0 THEN f.now ELSE sha256(string_agg(CASE WHEN o.pos = f.pos THEN f.now ELSE o.h END, '' ORDER BY o.pos)) END, f.proof || coalesce(string_agg(CASE WHEN o.pos <> f.pos THEN o.h END, '' ORDER BY o.pos), ''), f.deep, f.place
FROM f LEFT JOIN nodes AS o ON o.list = CASE WHEN f.level < f.deep THEN f.list ELSE -1 END AND o.level = CASE WHEN f.level < f.deep THEN f.level ELSE f.level - f.deep END AND o.pos // 16 = CASE WHEN f.level = f.deep AND f.deep = 0 THEN f.place ELSE f.pos END // 16
WHERE f.level < f.deep + (SELECT max(level) FROM u) GROUP BY f.rid, f.level, f.list, f.pos, f.now, f.proof, f.deep, f.place)
SELECT p.doc_id, p.h AS leaf, s.h AS subroot, root.h AS root, sha256(f.proof) AS proof_sha256, f.now AS folded_root, f.now = root.h AS verified
FROM p JOIN s USING (list) CROSS JOIN root JOIN f USING (rid) WHERE f.level = f.deep + (SELECT max(level) FROM u)"""
