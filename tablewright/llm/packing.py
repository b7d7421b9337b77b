"""Best-fit packing with certified bin counts.

Every document is tokenised once into pieces of at most ``capacity`` ids, written as a table.  Full pieces are
sequences of their own; the others are dealt into parts of bounded size, and each part is packed by best-fit
decreasing.  Dual feasible functions over a part's lengths give a lower bound on the bins that any packing needs; a part that
meets its bound is certified and done.  Parts with a gap exchange documents: those of their bins that are not
full meet in common parts, best-fit decreasing runs again, and the better packing stays, until a round saves no bin.  A part that is alone with its gap
exchanges with the certified part that has most room.  The bound over all lengths certifies the whole.

Defined results: null text is empty and holds the end id alone; null ids stay null; repeated rows are packed as often as
they occur; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.shared import blocks, prepare, stored, wanted
from tablewright.llm.tokens import encoder

#: Pieces that a part holds at most on average, parts that small inputs are dealt into, and their least pieces.
PART, FEW, LEAST = 50_000, 16, 2_000


@dataclass
class Packed:
    """pieces: key, doc_id, piece, start, length, ids (little-endian uint32); places: key, sequence_id, offset.

    bins: sequences used; bound: sequences that any packing of these pieces needs; report: bins and bounds of the parts that
    each round packed.
    """

    pieces: DataFrame
    places: DataFrame
    capacity: int
    bins: int = 0
    bound: int = 0
    report: list[dict] = field(default_factory=list)

    def sequences(self) -> DataFrame:
        """sequence_id and its ids as one binary value, pieces in place."""
        rows = self.places.join(self.pieces.select("key", "ids"), "key")
        return rows.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p")).select("sequence_id", F.expr("aggregate(p, X'', (a, x) -> concat(a, x.ids))").alias("ids"))


# ---------------------------------------------------------------- one part


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Best-fit decreasing: bin and offset of each length, and the number of bins.  Ties go by position."""
    order = np.argsort(-lengths, kind="stable")
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    has, bins = 0, 0  # bit r of has: a bin with room r exists
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = has >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            own = open_[room]
            b = own.pop()
            if not own:
                has ^= 1 << room
        else:
            room, b = capacity, bins
            bins += 1
        where[i], offset[i] = b, capacity - room
        if left := room - n:
            open_[left].append(b)
            has |= 1 << left
    return where, offset, bins


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs, by dual feasible functions over the lengths.

    Two families: lengths over ``capacity - t`` count as whole and those under ``t`` as nothing, for every t;
    and lengths rounded down to k-ths of the capacity (kept where they are whole (k+1)-ths), for k to 50.
    """
    return bound_of(np.bincount(lengths, minlength=capacity + 1).astype(np.int64), capacity)


def bound_of(count: np.ndarray, capacity: int) -> int:
    """``lower_bound`` from the number of lengths of each size."""
    if not count.any():
        return 0
    size = np.arange(capacity + 1)
    n, mass = np.cumsum(count), np.cumsum(count * size)
    t = np.arange(0, capacity // 2 + 1)
    whole = n[-1] - n[capacity - t]
    middle = mass[capacity - t] - np.where(t > 0, mass[t - 1], 0)
    best = int((-(-(whole * capacity + middle) // capacity)).max())
    for k in range(1, 51):
        part, rest = np.divmod((k + 1) * size, capacity)
        value = np.where(rest == 0, size * k, part * capacity)  # in 1 / (k * capacity)
        best = max(best, -(-int((value * count).sum()) // (k * capacity)))
    return best


# ---------------------------------------------------------------- all parts


def tokenised(docs: DataFrame, tokenizer: str, *, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All pieces as a written table; of a document over the capacity only the first piece may be shorter."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        e, key = encoder(tokenizer), TaskContext.get().partitionId() << 36
        for batch in batches:
            for block in blocks(batch.column(1)):
                ids, offs = e.encode(block)
                flat = np.insert(ids, offs[1:], end_id).astype("<u4")
                total = np.diff(offs) + 1
                pieces = -(-total // capacity)
                first = total - (pieces - 1) * capacity
                piece = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = np.where(piece > 0, np.repeat(first, pieces) + (piece - 1) * capacity, 0)
                length = np.where(piece > 0, capacity, np.repeat(first, pieces))
                bounds = np.concatenate([[0], np.cumsum(length)]).astype(np.int64) * 4
                ids_of = batch.column(0).slice(block.first, len(block)).take(pa.array(np.repeat(np.arange(len(block)), pieces)))
                data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(piece), [None, pa.py_buffer(bounds), pa.py_buffer(flat)]).cast(pa.binary())
                yield pa.RecordBatch.from_pydict({"key": pa.array(key + np.arange(len(piece))), "doc_id": ids_of, "piece": pa.array(piece.astype(np.int32)), "start": pa.array(start), "length": pa.array(length), "ids": data})
                key += len(piece)

    source = wanted(docs, id_col, text_col).select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return stored(source.mapInArrow(cut, "key long, doc_id long, piece int, start long, length long, ids binary"), "pieces")


def pack(docs: DataFrame, tokenizer: str, *, end_id: int = 2, capacity: int = 1024, rounds: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> Packed:
    """Tokenise and pack all documents; ``report`` tells bins, bound and gap after each round.

    Rounds go on until one saves no bin (or for ``rounds`` at most): the gap that stays is then told by the last report.
    """
    prepare(docs.sparkSession)
    pieces = tokenised(docs, tokenizer, end_id=end_id, capacity=capacity, id_col=id_col, text_col=text_col)
    whole = pieces.where(F.col("length") == capacity).select("key", (-F.col("key") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    loose = pieces.where(F.col("length") < capacity).select("key", "length")
    n = loose.count()
    parts = max(-(-n // PART), min(FEW, -(-n // LEAST)), 1)
    schema = "key long, length long, part long, bin long, offset long, fill long, bins long, bound long"

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "key"], ascending=[False, True])
        lengths = pdf["length"].to_numpy()
        where, offset, bins = best_fit(lengths, capacity)
        fill = np.bincount(where, weights=lengths)[where].astype(np.int64)
        return pdf.assign(bin=where, offset=offset, fill=fill, bins=bins, bound=lower_bound(lengths, capacity))

    def again(pdf: pd.DataFrame) -> pd.DataFrame:
        """Documents of several parts' bins that aren't full; their old bins stay unless fewer suffice."""
        pdf = pdf.sort_values(["length", "key"], ascending=[False, True])
        lengths = pdf["length"].to_numpy()
        where, offset, bins = best_fit(lengths, capacity)
        old = pdf.groupby(["old", "bin"], sort=False).ngroup().to_numpy()
        if bins >= old.max() + 1:
            where, offset, bins = old, pdf["offset"].to_numpy(), old.max() + 1
        fill = np.bincount(where, weights=lengths)[where].astype(np.int64)
        return pdf.drop(columns="old").assign(bin=where, offset=offset, fill=fill, bins=bins, bound=lower_bound(lengths, capacity))

    packed = stored(loose.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts))).groupBy("part").applyInPandas(first, schema), "packed")
    place = ["key", "part", "bin", "offset"]
    done, free, report = [packed.where(F.col("fill") == capacity).select(*place)], packed.where(F.col("fill") < capacity), []
    used, before = parts, None
    for at in itertools.count():
        # One row per part with a gap comes to the driver: a part holds PART pieces on average.
        total = packed.groupBy("part").agg(F.first("bins").alias("bins"), F.first("bound").alias("bound")).agg(F.sum("bins").alias("bins"), F.sum("bound").alias("bound")).first()
        report.append({"round": at, "bins": total.bins or 0, "bound": total.bound or 0, "gap": (total.bins or 0) - (total.bound or 0)})
        if at == rounds or before is not None and total.bins >= before:
            break
        room = free.groupBy("part").agg(F.first("bins").alias("bins"), F.first("bound").alias("bound"), F.count("*").alias("free"))
        gaps = sorted(tuple(r) for r in room.where("bins > bound").select("part", "free").collect())
        if len(gaps) == 1:
            gaps += [tuple(r) for r in room.where("bins <= bound").orderBy(F.desc("free"), "part").limit(1).select("part", "free").collect()]
        if len(gaps) < 2:
            break
        # Neighbours in this list meet: as many as make a part of bounded size, two at least.
        meet, held, group = [], 0, used
        for part, size in gaps:
            if held and held + size > PART and len(meet) > 1 and meet[-2][1] == group:
                group, held = group + 1, 0
            meet.append((part, group))
            held += size
        if len(meet) > 2 and meet[-2][1] != group:  # a lone last part joins those before it
            meet[-1] = (meet[-1][0], meet[-2][1])
        used = group + 1
        plan = docs.sparkSession.createDataFrame(meet, "part long, new long")
        both = free.join(F.broadcast(plan) if len(meet) < 100_000 else plan, "part", "left")
        moved = both.where("new IS NOT NULL").select("key", "length", F.col("new").alias("part"), "bin", "offset", F.col("part").alias("old"))
        before = moved.select("old", "bin").distinct().count()  # bins that meet
        packed = stored(moved.groupBy("part").applyInPandas(again, schema), "repacked")
        done.append(packed.where(F.col("fill") == capacity).select(*place))
        free = both.where("new IS NULL").drop("new").select(*packed.columns).unionByName(packed.where(F.col("fill") < capacity))
    done.append(free.select(*place))
    places = done[0]
    for more in done[1:]:
        places = places.unionByName(more)
    # A part's bins are numbered below 2 ** 32; kept bins never share a part number with new ones.
    places = stored(places.select("key", F.expr("part * 4294967296 + bin").alias("sequence_id"), "offset").unionByName(whole), "packed-places")
    count = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():  # `capacity` rows at most
        count[r.length] = r["count"]
    # Every bin has one piece at its start.
    return Packed(pieces, places, capacity, places.where("offset = 0").count(), bound_of(count, capacity), report)
