"""Document fingerprints as improbable-feature digests.

Every window of 64 bytes gets its entropy, exactly and in passes over whole blocks; windows are ranked by how rare
their entropy is.  In each run of 64 neighbouring windows the leftmost of the lowest rank wins; windows that win 16
runs or more are the document's features.  Features go in order into a chain of Bloom filters of 2,048 bits, 160 features
each, five bits a feature.  Two digests are as like as the overlap of their filters' bits beyond chance, normalised by
the smaller filter, averaged over the filters of the digest with fewer.

Defined results: null text is empty; empty text has a digest without filters, like itself (1) and nothing else (0);
a text too short for runs has its rarest window, and one under 64 bytes itself, as its only feature; equal texts have
equal digests; rows with equal ids are ordered by text; null ids come first; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.shared import prepare, span_keys, wanted

WINDOW, RUN, WINS, FEATURES, BITS = 64, 64, 16, 160, 2048
#: Entropies of 64-byte windows of prose, in thousandths of six bits: mean and deviation.  Windows under WEAK are too plain.
USUAL, SPREAD, WEAK = 650.0, 45.0, 250
#: Bytes that one pass works on, so that its arrays stay in the processor's cache.
CHUNK = 1 << 17
#: Rows of the sample that bounds are taken from, for each partition on average.
SAMPLED = 64

_G = np.array([0] + [round(c * np.log2(c) * 65536) for c in range(1, WINDOW + 1)], np.int64)
#: What one more byte adds to a window's sum of c log2 c, when c are there.
_STEP = np.diff(_G)
_DULL = 1 << 20


def rarity_ranks() -> np.ndarray:
    """Rank of each entropy from 0 to 1000 thousandths: the rarer, the lower; weak ones last."""
    e = np.arange(1001)
    rank = np.round(10_000 / (1 + ((e - USUAL) / SPREAD) ** 2)).astype(np.int64)
    rank[e < WEAK] = _DULL
    return rank


_RANKS = rarity_ranks()


def window_entropies(buf: np.ndarray) -> np.ndarray:
    """Entropy of every 64-byte window, in thousandths of six bits."""
    n = len(buf)
    ahead, behind = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for k in range(1, min(WINDOW, n)):
        same = (buf[:-k] == buf[k:]).view(np.uint8)
        ahead[:-k] += same
        behind[k:] += same
    total = np.cumsum(_STEP[behind])[WINDOW - 1 :]
    total[1:] -= np.cumsum(_STEP[ahead])[: n - WINDOW]
    return 1000 - total * 1000 // (WINDOW * 6 * 65536)


def _features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the features of all rows, in order, and their rows."""
    sizes = np.diff(offs)
    windows = np.maximum(sizes - WINDOW + 1, 0)
    if not windows.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    n = len(buf) - WINDOW + 1
    row = np.repeat(np.arange(len(sizes)), sizes)[:n]
    at = np.arange(n)
    inside = at < (offs[:-1] + windows)[row]
    rank = np.where(inside, _RANKS[window_entropies(buf)], 2 * _DULL)
    key = (rank << 32) | at
    low = key
    k = 1
    while k < RUN and len(low) > k:
        low = np.minimum(low[:-k], low[k:])
        k *= 2
    # Runs count where all their windows lie in the row.
    runs = at[: len(low)]
    good = runs < (offs[:-1] + windows - RUN + 1)[row[: len(low)]] if k >= RUN else np.zeros(len(low), bool)
    wins = np.bincount(low[good] & 0xFFFFFFFF, minlength=n)
    picked = np.flatnonzero((wins >= WINS) & (rank < _DULL))
    lone = np.flatnonzero((windows > 0) & (np.bincount(row[picked], minlength=len(sizes)) == 0))
    if len(lone):
        best = [int(key[offs[r] : offs[r] + windows[r]].min() & 0xFFFFFFFF) for r in lone]
        picked = np.sort(np.concatenate([picked, best]))
    return picked, row[picked]


class Digest:
    """Features inserted and the chain of filters, one row of 256 bytes each."""

    __slots__ = ("features", "filters", "ones")

    def __init__(self, features: int, filters: np.ndarray) -> None:
        self.features, self.filters = features, filters.view(np.uint64)
        self.ones = np.bitwise_count(self.filters).sum(1).astype(np.int64)

    def __str__(self) -> str:
        return f"{self.features}:{len(self.filters)}:{base64.b64encode(self.filters.tobytes()).decode()}"

    @classmethod
    def parse(cls, text: str) -> Digest:
        features, n, data = text.split(":")
        return cls(int(features), np.frombuffer(base64.b64decode(data), np.uint8).reshape(int(n), BITS // 8).copy())


def digests(buf: np.ndarray, offs: np.ndarray) -> list[Digest]:
    """The digest of every row of a block of bytes."""
    out: list[Digest] = []
    at = 0
    while at < len(offs) - 1:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + CHUNK, "right")) - 1)
        own, cut = buf[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        n = to - at
        picked, row = _features(own, cut)
        keys = span_keys(own, picked, picked + WINDOW)
        small = np.flatnonzero((np.diff(cut) > 0) & (np.diff(cut) < WINDOW))
        if len(small):
            keys = np.concatenate([keys, span_keys(own, cut[small], cut[small + 1])])
            row = np.concatenate([row, small])
        # A feature that its row already has is not inserted again.
        first = _first_of(row, keys)
        order = first[np.argsort(row[first], kind="stable")]
        keys, row = keys[order], row[order]
        count = np.bincount(row, minlength=n)
        chain = -(-count // FEATURES)
        base = np.cumsum(chain) - chain
        place = base[row] + (np.arange(len(row)) - (np.cumsum(count) - count)[row]) // FEATURES
        bits = np.zeros((int(chain.sum()), BITS), bool)
        for k in range(5):
            bits[place, ((keys >> np.uint64(11 * k)) & np.uint64(BITS - 1)).astype(np.int64)] = True
        packed = np.packbits(bits, axis=1, bitorder="little")
        out += [Digest(int(c), packed[b : b + k]) for c, b, k in zip(count.tolist(), base.tolist(), chain.tolist(), strict=True)]
        at = to
    return out


def _first_of(row: np.ndarray, keys: np.ndarray) -> np.ndarray:
    order = np.lexsort((keys, row))
    new = np.ones(len(order), bool)
    new[1:] = (row[order][1:] != row[order][:-1]) | (keys[order][1:] != keys[order][:-1])
    return np.sort(order[new])


def likeness(a: Digest, b: Digest) -> float:
    """How alike two digests are, from 0 to 1."""
    if not len(a.filters) or not len(b.filters):
        return float(len(a.filters) == len(b.filters))
    if len(a.filters) > len(b.filters):
        a, b = b, a
    total = 0.0
    for own, ones in zip(a.filters, a.ones.tolist(), strict=True):
        both = np.bitwise_count(own & b.filters).sum(1)
        chance = ones * b.ones / BITS
        noise = 3 * np.sqrt(chance * (1 - ones / BITS) * (1 - b.ones / BITS))
        most = np.minimum(ones, b.ones)
        score = np.where(both - chance > noise, (both - chance) / np.maximum(most - chance, 1e-9), 0)
        score[both == most] = 1.0
        total += float(min(1.0, score.max()))
    return total / len(a.filters)


def _sortable(key: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Pairs of signed numbers as 16 bytes each that sort as they do."""
    flip = np.uint64(1 << 63)
    return np.stack([key.astype(np.int64).view(np.uint64) ^ flip, h.astype(np.int64).view(np.uint64) ^ flip], 1).astype(">u8").view("S16").reshape(-1)


def _in_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text and extra, range-partitioned and sorted: each partition ends with an extra copy of the row that follows.

    Rows are ordered by id, then by their text's hash, so many rows with equal or missing ids are dealt out as well.
    """
    spark = docs.sparkSession
    low = -(1 << 63)
    source = wanted(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumns({"key": F.coalesce("id", F.lit(low)), "h": F.xxhash64("text")})
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    # Rows that exist are the bounds, so every partition has a first row and that row is known beforehand: some SAMPLED a partition, by hash.
    total = docs.count()
    every = max(1, total // (SAMPLED * n))
    some = source.where(F.pmod(F.xxhash64("key", "h"), F.lit(every)) == 0).select("key", "h").distinct()
    least = source.agg(F.min(F.struct("key", "h")).alias("r")).select("r.key", "r.h").where("key IS NOT NULL")
    got = some.unionByName(least).distinct().toPandas()
    if not len(got):
        return source.select("id", "text", F.lit(False).alias("extra"))
    found = np.sort(_sortable(got["key"].to_numpy(), got["h"].to_numpy()))
    bounds = found[np.unique(np.linspace(0, len(found), n, endpoint=False).astype(np.int64))]

    def parts(key: pd.Series, h: pd.Series) -> pd.DataFrame:
        own = _sortable(key.to_numpy(), h.to_numpy())
        part = np.searchsorted(bounds, own, "right") - 1
        return pd.DataFrame({"part": part, "before": np.where(bounds[part] == own, (part - 1) % len(bounds), -1)})

    where = F.pandas_udf(parts, "part int, before int")
    dealt = source.withColumn("w", where("key", "h")).withColumn("to", F.explode(F.expr("IF(w.before >= 0, array(struct(w.part AS part, false AS extra), struct(w.before AS part, true AS extra)), array(struct(w.part AS part, false AS extra)))")))
    dealt = dealt.select("id", "text", "key", "h", F.col("to.part").alias("part"), F.col("to.extra").alias("extra"))
    return dealt.repartitionById(len(bounds), F.col("part")).sortWithinPartitions("extra", "key", "h", "text").select("id", "text", "extra")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every text and its edited text: digest strings, and how like the digest is to the edited and the next text's.

    The edited text has its last floor(n / 2) code points replaced by the first as many of the next text in
    ascending id order (after the last: the first).
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        own: Digest | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([held, rows]).combine_chunks() if held is not None else rows
            extra = rows.column("extra").to_numpy(zero_copy_only=False)
            stop = int(np.argmax(extra)) + 1 if extra.any() else len(rows)
            rows = rows.slice(0, stop)
            if len(rows) > 1:
                out, own = _compared(rows, own)
                yield out
            held = rows.slice(len(rows) - 1)
            if extra.any():
                return

    def _compared(rows: pa.Table, known: Digest | None) -> tuple[pa.RecordBatch, Digest]:
        text = rows.column("text").combine_chunks().cast(pa.large_string()).fill_null("")
        offs = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[offs[0] : offs[-1]]
        offs = offs - offs[0]
        first = np.flatnonzero((data & 0xC0) != 0x80)  # of each code point
        marks = np.append(first, len(data))
        at = np.searchsorted(first, offs)
        chars = np.diff(at)
        half = chars[:-1] // 2
        keep = marks[at[:-2] + chars[:-1] - half] if len(chars) > 1 else np.zeros(0, np.int64)
        more = marks[at[1:-1] + np.minimum(half, chars[1:])]
        raw = data.tobytes()
        edited = [raw[a:b] + raw[c:d] for a, b, c, d in zip(offs[:-2].tolist(), keep.tolist(), offs[1:-1].tolist(), more.tolist(), strict=True)]
        cut = np.cumsum([0, *map(len, edited)])
        theirs = digests(np.frombuffer(b"".join(edited), np.uint8), cut)
        skip = int(known is not None)
        mine = ([known] if skip else []) + digests(data[offs[skip] :], offs[skip:] - offs[skip])
        return pa.RecordBatch.from_pydict({
            "doc_id": rows.column("id").slice(0, len(edited)).combine_chunks(), "n_chars": pa.array(chars[:-1], pa.int64()), "edited_sha256": pa.array([hashlib.sha256(e).hexdigest() for e in edited]),
            "fingerprint": pa.array([str(d) for d in mine[:-1]]), "edited_fingerprint": pa.array([str(d) for d in theirs]),
            "near_edited": pa.array([likeness(a, b) for a, b in zip(mine, theirs, strict=False)], pa.float64()), "near_next": pa.array([likeness(a, b) for a, b in zip(mine, mine[1:], strict=False)], pa.float64()),
        }), mine[-1]

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return _in_order(docs, id_col, text_col).mapInArrow(run, schema)
