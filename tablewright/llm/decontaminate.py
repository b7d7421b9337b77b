"""Benchmark decontamination: Wu-Manber search of all windows of benchmark items in all documents.

Symbols are words.  All windows of a length are searched together: a table of shifts, by the hash of a block of two words,
tells how far a search may skip from where such a block ends; where it may not skip, the block's bucket gives the
windows that end in it, and their bytes are compared with the document's.  Tasks walk many stretches of text in step, in numpy:
a step looks at one word pair of each stretch and moves each on by its own shift.

Windows travel in blocks of bounded bytes, broadcast one after another; a block marks what it finds on the rows as they pass, so
neither texts nor hits are shuffled, however many blocks a benchmark fills.  A text may have any length.

Defined results: null and empty texts have no words and no hits; items without words have no windows; words of windows of items
without an id are hit, but such items are neither counted nor listed; items with equal ids are one in counts and lists; repeated
documents are rows of their own; an empty benchmark hits nothing; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.shared import LOWER, blocks, mix, prepare, stored, wanted

#: Words of a window; bytes of windows that are broadcast at once; words of a stretch that is walked in step with others.
WORDS, BLOCK_BYTES, STRETCH = 10, 8 << 20, 256
#: Slots of a table of shifts for each block of words in the windows.
SLOTS = 16

# Bytes of words: digits, letters and all of other characters' bytes; capitals become small ones.
_WORDY = np.zeros(256, bool)
_WORDY[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOW = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Words:
    """The words of some texts, lower-cased, one blank after each: bytes, starts and ends of words, their texts' numbers."""

    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray

    @classmethod
    def of(cls, buf: np.ndarray, offs: np.ndarray) -> Words:
        """Of texts given by their bytes and offsets."""
        size = np.diff(offs)
        apart = np.full(len(buf) + len(size), 32, np.uint8)  # a blank after each text
        if len(size) == 1:
            apart[:-1] = buf
        else:
            apart[np.arange(len(buf)) + np.repeat(np.arange(len(size)), size)] = buf
        solid = _WORDY[apart]
        after = np.zeros(len(solid), bool)
        after[1:] = solid[:-1] & ~solid[1:]
        starts = np.flatnonzero(solid & ~np.concatenate([[False], solid[:-1]]))
        rows = np.searchsorted(offs[1:] + np.arange(1, len(size) + 1), starts, "right")
        out = np.where(solid, LOWER[apart], 32).astype(np.uint8)[solid | after]
        ends = np.flatnonzero(out == 32)
        return cls(out, np.concatenate([[0], ends[:-1] + 1]).astype(np.int64)[: len(ends)], ends, rows)

    def __len__(self) -> int:
        return len(self.starts)

    def eights(self) -> np.ndarray:
        """The eight bytes from each place on."""
        padded = np.zeros(len(self.buf) + 8, np.uint8)
        padded[: len(self.buf)] = self.buf
        return np.ndarray((len(self.buf) + 1,), "<u8", padded, strides=(1,))

    def keys(self, eights: np.ndarray, at: np.ndarray) -> np.ndarray:
        """A key of each word by its first eight bytes and its length: equal for equal words, seldom for others."""
        size = self.ends[at] - self.starts[at]
        return mix((eights[self.starts[at]] & _LOW[np.minimum(size, 8)]) * _ODD + size.astype(np.uint64))

    def block(self, eights: np.ndarray, at: np.ndarray, two: bool) -> np.ndarray:
        """The hash of the block that ends in each word: of two words, or of one."""
        own = self.keys(eights, at)
        return mix(own + self.keys(eights, at - 1) * _ODD) if two else own


class Tables:
    """Shifts, suffix buckets and windows of one length (in words)."""

    def __init__(self, length: int, texts: list[bytes], items: list[list[str]]) -> None:
        self.length, self.texts, self.items = length, texts, items
        sizes = np.array([len(t) + 1 for t in texts])
        w = Words.of(np.frombuffer(b" ".join(texts), np.uint8), np.append(0, np.cumsum(sizes)).clip(max=max(0, int(sizes.sum()) - 1)))
        self.two = length > 1
        eights, first = w.eights(), np.arange(len(texts)) * length
        self.bits = max(12, int(np.ceil(np.log2(len(texts) * length * SLOTS))))
        self.shift = np.full(1 << self.bits, max(1, length - 1), np.int16)
        for j in range(1 if self.two else 0, length):  # the block that ends in word j of a window stands length - 1 - j words before its end
            np.minimum.at(self.shift, self._slot(w.block(eights, first + j, self.two)), length - 1 - j)
        last = w.block(eights, first + length - 1, self.two)
        order = np.argsort(last, kind="stable")
        self.suffix, self.window = last[order], order

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def search(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Last words and windows of all occurrences, each within one text."""
        n, m = len(words), self.length
        if n < m:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        eights = words.eights()
        at = np.arange(m - 1, n, STRETCH)
        stop = np.minimum(at + STRETCH, n)
        places, windows = [], []
        while len(at):
            h = words.block(eights, at, self.two)
            skip = self.shift[self._slot(h)].astype(np.int64)
            still = np.flatnonzero(skip == 0)
            if len(still):
                ends = at[still]
                whole = words.rows[ends - m + 1] == words.rows[ends]
                ends, own = ends[whole], h[still[whole]]
                low, high = np.searchsorted(self.suffix, own, "left"), np.searchsorted(self.suffix, own, "right")
                count = high - low
                if count.any():
                    places.append(np.repeat(ends, count))
                    windows.append(self.window[np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())])
            at = at + np.maximum(skip, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        if not places:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ends, windows = np.concatenate(places), np.concatenate(windows)
        held = words.buf.tobytes()
        a, b = words.starts[ends - m + 1].tolist(), words.ends[ends].tolist()
        same = np.fromiter((held[x:y] == self.texts[k] for x, y, k in zip(a, b, windows.tolist(), strict=True)), bool, len(a))
        return ends[same], windows[same]


def windows(benchmark: DataFrame, words: int = WORDS) -> DataFrame:
    """length, window and item of every distinct window of the items, as a written table (item null: without an id)."""
    prepare(benchmark.sparkSession)
    rows = wanted(benchmark, "item_id", "text").select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                w = Words.of(block.buf, block.offs)
                count = np.bincount(w.rows, minlength=len(block))
                first, held = np.cumsum(count) - count, w.buf.tobytes()
                for k in np.flatnonzero(count).tolist():
                    m, n, at = min(words, int(count[k])), int(count[k]), int(first[k])
                    texts = [held[w.starts[i] : w.ends[i + m - 1]] for i in range(at, at + n - m + 1)]
                    yield pa.RecordBatch.from_pydict({"length": pa.array([m] * len(texts), pa.int32()), "window": pa.array(texts, pa.binary()), "item": pa.array([batch.column("item")[block.first + k].as_py()] * len(texts), pa.string())})

    return stored(rows.mapInArrow(cut, "length int, window binary, item string").distinct(), "decontaminate-windows")


def _blocks(spark: SparkSession, found: DataFrame, most: int) -> Iterator[list[Tables]]:
    """The tables of each block of windows, of about ``most`` bytes of windows and ids, one after another."""
    total = found.agg(F.coalesce(F.sum(F.length("window") + F.coalesce(F.length("item"), F.lit(0)) + 16), F.lit(0))).first()[0]
    many = max(1, -(-int(total) // most))
    for b in range(many):
        rows = found.where(F.pmod(F.xxhash64("window", "item"), F.lit(many)) == b).collect() if total else []  # about ``most`` bytes
        by: dict[int, dict[bytes, list[str]]] = {}
        for r in rows:
            by.setdefault(r.length, {}).setdefault(bytes(r.window), []).extend([r.item] if r.item is not None else [])
        yield [Tables(m, list(t), list(t.values())) for m, t in sorted(by.items())]


_HELD = "doc_id long, text string, spans binary, items array<string>"
_OUT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def marked(docs: DataFrame, benchmark: DataFrame, *, words: int = WORDS, most: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document."""
    spark = docs.sparkSession
    prepare(spark)
    rows = wanted(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tables = list(_blocks(spark, windows(benchmark, words), most)) if most else []
    for own in tables[:-1]:
        rows = rows.withColumns({"spans": F.lit(None).cast("binary"), "items": F.lit(None).cast("array<string>")}) if "spans" not in rows.columns else rows
        rows = rows.mapInArrow(_pass(spark.sparkContext.broadcast(own), False), _HELD)
    return rows.mapInArrow(_pass(spark.sparkContext.broadcast(tables[-1] if tables else []), True), _OUT)


def _pass(sent, last: bool):
    """Marks the spans (first and last word) and items that one block of windows finds; the last one gives the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = "spans" in batch.schema.names
            for block in blocks(batch.column("text")):
                w = Words.of(block.buf, block.offs)
                n = len(block)
                first = np.searchsorted(w.rows, np.arange(n))
                spans: list[list[np.ndarray]] = [[] for _ in range(n)]
                items: list[set[str]] = [set() for _ in range(n)]
                if held:
                    for k, (s, i) in enumerate(zip(batch.column("spans").slice(block.first, n).to_pylist(), batch.column("items").slice(block.first, n).to_pylist(), strict=True)):
                        spans[k] += [np.frombuffer(s, "<i4").reshape(-1, 2)] if s else []
                        items[k].update(i or ())
                for t in sent.value:
                    ends, found = t.search(w)
                    if len(ends):
                        row = w.rows[ends]
                        own = np.stack([ends - t.length + 1, ends], 1) - first[row][:, None]
                        order = np.argsort(row, kind="stable")
                        cut = np.unique(row[order], return_index=True)
                        for k, part in zip(cut[0].tolist(), np.split(order, cut[1][1:]), strict=True):
                            spans[k].append(own[part].astype("<i4"))
                            for f in np.unique(found[part]).tolist():
                                items[k].update(t.items[f])
                ids = batch.column("doc_id").slice(block.first, n)
                if not last:
                    joined = [np.unique(np.concatenate(s), axis=0).astype("<i4").tobytes() if s else None for s in spans]
                    yield pa.RecordBatch.from_pydict({"doc_id": ids, "text": batch.column("text").slice(block.first, n).cast(pa.string()), "spans": pa.array(joined, pa.binary()), "items": pa.array([sorted(i) for i in items], pa.list_(pa.string()))})
                    continue
                count = np.bincount(w.rows, minlength=n)
                hit = [_covered(np.concatenate(s), int(c)) if s else 0 for s, c in zip(spans, count, strict=True)]
                listed = [hashlib.sha256(",".join(sorted(i)).encode()).hexdigest() for i in items]
                yield pa.RecordBatch.from_pydict({"doc_id": ids, "n_words": pa.array(count, pa.int64()), "n_hit": pa.array(hit, pa.int64()), "n_items": pa.array([len(i) for i in items], pa.int64()), "items_sha256": listed, "contaminated": [h > 0 for h in hit]})

    return run


def _covered(spans: np.ndarray, n: int) -> int:
    """Words inside any span."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, spans[:, 0], 1)
    np.add.at(edge, spans[:, 1] + 1, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def oracle(docs: str = "documents", benchmark: str = "benchmark") -> str:
    """DuckDB SQL for ``marked``: documents' runs of words joined with the windows of the same length."""
    cut = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {cut} AS w FROM {benchmark} WHERE text IS NOT NULL),
c AS (SELECT item, w, least({WORDS}, len(w)) AS m FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, m, array_to_string(w[i:i + m - 1], ' ') AS t FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS i FROM c)),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce({cut}, []) AS w FROM {docs}),
run AS (SELECT rid, m, i, array_to_string(w[i:i + m - 1], ' ') AS t FROM (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM win) WHERE len(w) >= m)),
hit AS (SELECT rid, m, i, item FROM run JOIN win USING (m, t)),
words AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + m)) AS p FROM hit) GROUP BY rid),
items AS (SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT rid, item FROM hit WHERE item IS NOT NULL) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)"""
