"""What the training-data operators share: scratch folders, Arrow text blocks and vectorised words.

Texts never become Python strings on the hot paths.  A ``TextBlock`` is the UTF-8 buffer of an Arrow
column and its offsets; words are found, hashed and looked up with numpy over the whole block.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.sources.files import scratch

#: Bytes of text that one vectorised pass handles; larger texts form a block of their own.
BLOCK_BYTES = 1 << 20

# With the C library's own rising threshold freed arrays stay in the process, and an executor keeps several idle workers:
# from 256 kB on arrays are mapped, and go back to the system at once (mallopt's M_MMAP_THRESHOLD is -3).
with contextlib.suppress(AttributeError, OSError):
    ctypes.CDLL(None).mallopt(-3, 1 << 18)


# ---------------------------------------------------------------- session and shared folder


#: Rows of an Arrow batch at most: texts may be long.  Frames are given back unevaluated, so this stays set in the session.
BATCH_ROWS, _BATCH = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def prepare(spark: SparkSession) -> None:
    """Make this package importable in Python workers and bound the Arrow batches that they get (a lower bound of the caller's stays)."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))


@contextlib.contextmanager
def wide_batches(spark: SparkSession, rows: int = 50_000) -> Iterator[None]:
    """Larger Arrow batches for what is evaluated in here, of short rows; then the session's own again."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def stored(df: DataFrame, name: str, *, compression: str = "zstd") -> DataFrame:
    """Write a frame as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def wanted(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; a missing one becomes null, extra and clashing ones go."""
    have = {}
    for i, c in enumerate(df.columns):
        have.setdefault(c, i)
    if len(set(df.columns)) != len(df.columns):
        df = df.toDF(*[c if have[c] == i else f"__again_{i}" for i, c in enumerate(df.columns)])
    return df.select(*[df[f"`{n}`"] if n in have else F.lit(None).alias(n) for n in names])


def owned(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The frame with neutral column names, by place, and the neutral name of each old one: nothing added can clash."""
    neutral = [f"__own_{i}" for i in range(len(df.columns))]
    first: dict[str, str] = {}
    for name, new in zip(df.columns, neutral, strict=True):
        first.setdefault(name, new)
    return df.toDF(*neutral), first


def column(first: dict[str, str], name: str, kind: str = "string"):
    """A column of an ``owned`` frame by its old name, null if there is none."""
    return (F.col(first[name]) if name in first else F.lit(None)).cast(kind)


def join_skewed(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", share: int = 1000) -> DataFrame:
    """Join many rows to a unique-key side without sending a hot key to one task.

    Keys that hold more than a ``share``-th of the left rows number fewer than ``share``, so their right rows
    are broadcast under that proven bound; all other keys go through an ordinary shuffle join.  Null keys
    match nothing.
    """
    total = left.count()
    if not total:
        return left.join(right, keys, how)
    heavy = [r[:-1] for r in left.groupBy(*keys).count().where(F.col("count") > max(1000, total // share)).collect()]
    heavy = [h for h in heavy if None not in h]
    if not heavy:
        return left.join(right, keys, how)
    hot = left.sparkSession.createDataFrame(heavy, left.select(*keys).schema)
    cold_left, hot_left = left.join(F.broadcast(hot), keys, "left_anti"), left.join(F.broadcast(hot), keys, "left_semi")
    hot_right = right.join(F.broadcast(hot), keys, "left_semi")
    return cold_left.join(right, keys, how).unionByName(hot_left.join(F.broadcast(hot_right), keys, how))


def attach(left: DataFrame, right: DataFrame, keys: list[str], most: int = 100_000) -> DataFrame:
    """Left join to a written unique-key table of short rows: broadcast up to a checked row count, else spread out."""
    if right.limit(most + 1).count() <= most:
        return left.join(F.broadcast(right), keys, "left")
    return join_skewed(left, right, keys)


# ---------------------------------------------------------------- texts and words in numpy


@dataclass
class TextBlock:
    """UTF-8 bytes of some rows, their offsets (rows + 1) and the number of the first row in its batch."""

    buf: np.ndarray
    offs: np.ndarray
    first: int

    def __len__(self) -> int:
        return len(self.offs) - 1


def blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[TextBlock]:
    """Cut a string column (null: empty) into blocks of whole rows of about ``most`` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
        yield TextBlock(data[offs[at] : offs[to]], offs[at : to + 1] - offs[at], at)
        at = to


#: The white space that separates words: blank, tab, line feed, vertical tab, form feed, carriage return.
WHITE = np.zeros(256, bool)
WHITE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit keys so that every bit depends on all others."""
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def exact_keys(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit halves that tell spans of bytes apart.

    Up to 15 bytes they are the bytes themselves with their number, so different spans never agree; longer
    spans have a cryptographic digest (BLAKE2b) with a mark that no number of bytes has.
    """
    size = ends - starts
    padded = np.zeros(len(buf) + 16, np.uint8)
    padded[: len(buf)] = buf
    eight = np.ndarray((len(buf) + 9,), "<u8", padded, strides=(1,))
    a = eight[starts] & _LOW[np.minimum(size, 8)]
    b = eight[starts + 8] & _LOW[np.clip(size - 8, 0, 7)] | size.astype(np.uint64) << np.uint64(56)
    for i in np.flatnonzero(size > 15).tolist():
        digest = int.from_bytes(hashlib.blake2b(padded[starts[i] : ends[i]], digest_size=15).digest(), "little")
        a[i], b[i] = digest & 0xFFFFFFFFFFFFFFFF, digest >> 64 | 0xFF << 56
    return a, b


def folded(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One 64-bit key of both halves, never 0."""
    h = mix(a * _ODD + mix(b ^ _MIX2))
    h[h == 0] = 1
    return h


def span_keys(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit key for each span of bytes: equal spans have equal keys, others by chance only."""
    return folded(*exact_keys(buf, starts, ends))


def word_spans(block: TextBlock) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of all words: maximal runs of bytes that are no white space."""
    buf, n = block.buf, len(block.buf)
    cut = np.zeros(n + 1, bool)
    cut[block.offs] = True
    white = WHITE[buf]
    solid = ~white
    before, after = cut[:-1].copy(), cut[1:].copy()
    before[1:] |= white[:-1]
    after[:-1] |= white[1:]
    starts, ends = np.flatnonzero(solid & before), np.flatnonzero(solid & after) + 1
    rows = np.searchsorted(block.offs, starts, "right") - 1
    return starts, ends, rows


class KeyTable:
    """Open-addressing table from 64-bit keys to row numbers; all operations work on arrays."""

    def __init__(self, bits: int = 12) -> None:
        self.bits, self.size = bits, 0
        self.keys, self.rows = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where absent."""
        out = np.full(len(keys), -1, np.int64)
        mask = np.int64((1 << self.bits) - 1)
        slot = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        got = self.keys[slot]
        hit = got == keys
        out[hit] = self.rows[slot[hit]]
        open_ = np.flatnonzero(~hit & (got != 0))
        slot = slot[open_]
        while len(open_):
            slot = (slot + 1) & mask
            got = self.keys[slot]
            hit = got == keys[open_]
            out[open_[hit]] = self.rows[slot[hit]]
            more = ~hit & (got != 0)
            open_, slot = open_[more], slot[more]
        return out

    def add(self, keys: np.ndarray, rows: np.ndarray) -> None:
        """Add distinct keys that are not there yet."""
        while (self.size + len(keys)) * 2 > len(self.keys):
            old = self.keys != 0
            keys_, rows_ = self.keys[old], self.rows[old]
            self.bits += 1
            self.size = 0
            self.keys, self.rows = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
            self._put(keys_, rows_)
        self._put(keys, rows)

    def _put(self, keys: np.ndarray, rows: np.ndarray) -> None:
        self.size += len(keys)
        mask = np.int64((1 << self.bits) - 1)
        slot = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(keys):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[free]
            won = self.keys[slot] == keys
            self.rows[slot[won]] = rows[won]
            keys, rows, slot = keys[~won], rows[~won], (slot[~won] + 1) & mask
