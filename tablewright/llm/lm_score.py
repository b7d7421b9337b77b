"""Language-model scores from a log-frequency Bloom filter that grows with the corpus.

Texts are dealt into portions of bounded size.  A portion sends the distinct 1- to 3-grams of its tokens, with the times that
they occur in training documents, to buckets of their hash; the number of buckets follows the bytes of text, so a
bucket stays small however large the corpus is.  A bucket sums the counts, quantises them to half powers of two and enters
every n-gram of level q into its segment of the filter once for every level up to q: no count is too small to enter.  It
then answers each portion by repeated membership probes, until the first miss.  Segments meet their probes by this
shuffle and are not broadcast, because no bound holds for a filter that has everything.

Probabilities are interpolated with absolute discounts: P(w|uv) = max(c(uvw) - D, 0) / c(uv) + (1 - s) P(w|v), where s is
the share of the context level's mass that the discounted filter holds, measured over all training events.

The base score needs exact counts of words: buckets of 1-grams know words by their exact keys (shared.exact_keys) and answer
with exact counts.

Defined results: null text is empty (its end token is scored); null ids train and are not held out; repeated rows train
and are scored as often as they occur; with no training rows every count is 0; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.shared import LOWER, TextBlock, blocks, exact_keys, folded, mix, prepare, stored, wanted, word_spans

#: Bytes of text in a portion, and of all portions' text for each bucket.
PORTION, BUCKET = 4 << 20, 8 << 20
#: Hash functions of the filter, its bits an entry, and bits of a segment at least.
PROBES, ENTRY_BITS, SEGMENT = 4, 16, 1 << 13
#: Highest level: counts to 2 ** 47.
LEVELS = 96
DISCOUNT = 0.75
#: Keys of the end token (its second exact half too, which no word has) and of what stands before a document.
END, END_HALF, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0xFE << 56), np.uint64(0x14057B7EF767814F)
_A, _B = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F)


def level(count: np.ndarray) -> np.ndarray:
    """Quantised counts: 1 + floor(2 log2(count)), 0 for none."""
    return np.where(count > 0, 1 + np.floor(2 * np.log2(np.maximum(count, 1)) + 1e-9), 0).astype(np.int64)


def level_counts() -> np.ndarray:
    """The count that each level stands for; level 0 for none."""
    j = np.arange(1, LEVELS + 1)
    low, high = np.ceil(2 ** ((j - 1) / 2) - 1e-9), np.ceil(2 ** (j / 2) - 1e-9) - 1
    return np.concatenate([[0], np.sqrt(low * np.maximum(low, high))])


# ---------------------------------------------------------------- events of a portion


@dataclass
class Events:
    """All tokens of some texts, each text's end among them.

    w, a, b: key and exact halves of the token; first: whether it is its text's first; row: its text; pair, triple: keys
    of the 2- and 3-gram that end at it.
    """

    w: np.ndarray
    a: np.ndarray
    b: np.ndarray
    first: np.ndarray
    row: np.ndarray
    pair: np.ndarray
    triple: np.ndarray


def events(block: TextBlock) -> Events:
    block = TextBlock(LOWER[block.buf], block.offs, block.first)
    starts, ends, rows = word_spans(block)
    n = np.bincount(rows, minlength=len(block))
    at = np.cumsum(n + 1) - 1  # of each row's end token
    inner = np.ones(len(rows) + len(block), bool)
    inner[at] = False
    w, a, b = (np.empty(len(inner), np.uint64) for _ in range(3))
    a[inner], b[inner] = exact_keys(block.buf, starts, ends)
    a[at], b[at] = 0, END_HALF
    w[inner], w[at] = folded(a[inner], b[inner]), END
    first = np.zeros(len(inner), bool)
    first[at - n] = True
    v = np.empty_like(w)
    v[1:] = w[:-1]
    v[first] = START
    u = np.empty_like(w)
    u[1:] = v[:-1]
    u[first] = START
    pair = mix(v * _A + w * _B)
    return Events(w, a, b, first, np.repeat(np.arange(len(block)), n + 1), pair, mix(mix(u * _A + v * _B) * _A + w * _B + np.uint64(3)))


def distinct(e: Events, order: int, bucket_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct n-grams of an order: cuts between buckets, what names them in a bucket, the token that each comes first at, and each token's n-gram.

    1-grams are named by their exact halves, others by 32 bits of their key that follow the bucket's.
    """
    keys = e.w if order == 1 else (e.pair if order == 2 else e.triple) >> np.uint64(32 - bucket_bits)
    order_ = np.argsort(keys, kind="stable")
    k = keys[order_]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    if order == 1:  # words whose keys clash stay apart
        a, b = e.a[order_], e.b[order_]
        new[1:] |= (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    gram = np.empty(len(k), np.int64)
    gram[order_] = new.cumsum() - 1
    lead = order_[new]
    bucket = (keys[lead] >> np.uint64(64 - bucket_bits if order == 1 else 32)).astype(np.int64)
    names = np.stack([e.a[lead], e.b[lead]], 1) if order == 1 else keys[lead].astype("<u4")
    return np.searchsorted(bucket, np.arange((1 << bucket_bits) + 1)), names, lead, gram


# ---------------------------------------------------------------- filter


class Segment:
    """The filter's bits for the n-grams of one bucket; ids: 32-bit names in the bucket."""

    def __init__(self, ids: np.ndarray, levels: np.ndarray, entry_bits: int = ENTRY_BITS) -> None:
        self.size = max(SEGMENT, int(levels.sum()) * entry_bits)
        bits = np.zeros(self.size, bool)
        for j in range(1, int(levels.max(initial=0)) + 1):
            h = _hash(ids[levels >= j], j)
            for i in range(PROBES):
                bits[self._position(h, i)] = True
        self.bits = np.packbits(bits, bitorder="little")

    def _position(self, h: np.ndarray, i: int) -> np.ndarray:
        step = (h >> np.uint64(32)) | np.uint64(1)
        return ((((h + np.uint64(i) * step) & np.uint64(0xFFFFFFFF)) * np.uint64(self.size)) >> np.uint64(32)).astype(np.int64)

    def levels(self, ids: np.ndarray) -> np.ndarray:
        """Levels by probing from the first level until a miss; 0 where that one is missing."""
        out, live = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for j in range(1, LEVELS + 1):
            h, left = _hash(ids[live], j), np.arange(len(live))
            for i in range(PROBES):
                at = self._position(h[left], i)
                left = left[(self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
            live = live[left]
            if not len(live):
                break
            out[live] = j
        return out


def _hash(ids: np.ndarray, j: int) -> np.ndarray:
    return mix(ids.astype(np.uint64) * _A + np.uint64(j))


# ---------------------------------------------------------------- portions, questions, answers


def pressed(values: np.ndarray) -> bytes:
    """Numbers as compressed planes: all first bytes, all second bytes, and so on."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpressed(data: bytes, dtype: str, width: int = 1) -> np.ndarray:
    """Numbers of ``pressed``, in rows of ``width`` where that is over 1."""
    size = np.dtype(dtype).itemsize * width
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    out = np.ascontiguousarray(planes.reshape(size, -1).T).view(dtype)
    return out if width > 1 else out.reshape(-1)


def _joined(parts: list[np.ndarray], dtype: str) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def portions(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, teaches, text) dealt into portions, one row each, as a written table: portion, size (bytes of text), ids, teaches, ends, texts.

    texts: all UTF-8 bytes, compressed; ends: where each text ends in them.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            ids, teaches = (pa.concat_arrays([h[k] for h in held]) for k in (0, 1))
            ends = pa.array(np.cumsum(np.concatenate([np.diff(h[2].offs) for h in held])))
            texts = zstandard.ZstdCompressor(level=1).compress(b"".join(h[2].buf.tobytes() for h in held))
            whole = pa.array([0, len(ids)], pa.int32())
            lists = {c: pa.ListArray.from_arrays(whole, x) for c, x in (("ids", ids), ("teaches", teaches), ("ends", ends))}
            return pa.RecordBatch.from_pydict({"portion": pa.array([number]), "size": pa.array([size]), **lists, "texts": pa.array([texts], pa.binary())})

        for batch in batches:
            for block in blocks(batch.column(2), PORTION):
                if held and size + len(block.buf) > PORTION:
                    yield out()
                    held, size, number = [], 0, number + 1
                held.append((*(batch.column(k).slice(block.first, len(block)) for k in (0, 1)), block))
                size += len(block.buf)
        if held:
            yield out()

    return stored(rows.mapInArrow(deal, "portion long, size long, ids array<long>, teaches array<boolean>, ends array<long>, texts binary"), "lm-portions", compression="uncompressed")


def _block(ends: pa.Array, texts: bytes) -> TextBlock:
    return TextBlock(np.frombuffer(zstandard.ZstdDecompressor().decompress(texts), np.uint8), np.concatenate([[0], ends.to_numpy()]), 0)


def asked(parts: DataFrame, bucket_bits: int) -> DataFrame:
    """Of each portion, order and bucket: the distinct n-grams and how often training documents have them."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                e = events(_block(batch.column(2)[i].values, batch.column(3)[i].as_py()))
                teaches = batch.column(1)[i].values.to_numpy(zero_copy_only=False).astype(np.float64)[e.row]
                for order in (1, 2, 3):
                    cuts, names, _, gram = distinct(e, order, bucket_bits)
                    counts = np.bincount(gram, weights=teaches, minlength=len(names)).astype("<u4")
                    full = np.flatnonzero(np.diff(cuts)).tolist()
                    cut = [slice(cuts[b], cuts[b + 1]) for b in full]
                    own = [names[c] if order == 1 else np.diff(names[c], prepend=names.dtype.type(0)) for c in cut]  # sorted: as steps
                    yield pa.RecordBatch.from_pydict({
                        "portion": pa.array([batch.column(0)[i].as_py()] * len(full), pa.int64()), "bucket": pa.array(full, pa.int32()), "order": pa.array([order] * len(full), pa.int32()),
                        "names": pa.array([pressed(x) for x in own], pa.binary()), "counts": pa.array([pressed(counts[c]) for c in cut], pa.binary()),
                    })

    return parts.select("portion", "teaches", "ends", "texts").mapInArrow(ask, "portion long, bucket int, order int, names binary, counts binary")


def answer(group: pa.Table, entry_bits: int = ENTRY_BITS) -> pa.Table:
    """A bucket's answers to its portions: of 1-grams exact counts (8 bytes each), of others levels from the filter (1 byte)."""
    order, each = group.column("order")[0].as_py(), lambda c, *kind: [unpressed(x, *kind) for x in group.column(c).to_pylist()]
    counts = each("counts", "<u4")
    lengths = np.array([len(c) for c in counts])
    counts = np.concatenate(counts).astype(np.int64)
    tokens = types = 0
    if order == 1:
        names = np.concatenate(each("names", "<u8", 2))
        sort = np.lexsort((names[:, 0], names[:, 1]))
        new = np.ones(len(sort), bool)
        new[1:] = (names[sort[1:]] != names[sort[:-1]]).any(1)
    else:
        names = np.concatenate([np.cumsum(x, dtype=np.uint32) for x in each("names", "<u4")])
        sort = np.argsort(names, kind="stable")
        new = np.ones(len(sort), bool)
        new[1:] = names[sort[1:]] != names[sort[:-1]]
    total = np.add.reduceat(counts[sort], np.flatnonzero(new))
    if order == 1:
        tokens, types, found = int(total.sum()), int((total > 0).sum()), total.astype("<i8")
    else:
        ids, q = names[sort[new]], level(total)
        found = Segment(ids[q > 0], q[q > 0], entry_bits).levels(ids).astype(np.uint8)
    out = np.empty(len(sort), found.dtype)
    out[sort] = found[new.cumsum() - 1]
    ends = np.cumsum(lengths)
    data = [pressed(out[e - n : e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
    once = [1, *[0] * (len(data) - 1)]
    return pa.table({
        "portion": group.column("portion").combine_chunks(), "order": group.column("order").combine_chunks(), "bucket": group.column("bucket").combine_chunks(), "found": pa.array(data, pa.binary()),
        "tokens": pa.array([tokens * k for k in once], pa.int64()), "types": pa.array([types * k for k in once], pa.int64()),
    })


# ---------------------------------------------------------------- scores


def read(e: Events, answers: pa.Table, bucket_bits: int, ends: int) -> tuple[np.ndarray, np.ndarray]:
    """Exact count of every token's word, and levels of its 1-, 2- and 3-gram, none above its parts' (ends: level of the end token)."""
    by = {1: [], 2: [], 3: []}
    for r in answers.select(["order", "bucket", "found"]).sort_by([("order", "ascending"), ("bucket", "ascending")]).to_pylist():
        by[r["order"]].append(unpressed(r["found"], "<i8" if r["order"] == 1 else "u1"))
    count = _joined(by[1], "<i8")[distinct(e, 1, bucket_bits)[3]]
    q = np.zeros((3, len(count)), np.int64)
    q[0] = level(count)
    for order in (2, 3):
        q[order - 1] = _joined(by[order], "u1")[distinct(e, order, bucket_bits)[3]]
    before = contexts(q, e.first, ends)
    q[1] = np.minimum(q[1], np.minimum(q[0], before[0]))
    q[2] = np.minimum(q[2], np.minimum(q[1], contexts(q, e.first, ends)[1]))
    return count, q


def contexts(q: np.ndarray, first: np.ndarray, ends: int) -> np.ndarray:
    """Levels of what stands before each token: one token (the start: as many as there are ends), and two (0 at the first token)."""
    out = np.zeros((2, q.shape[1]), np.int64)
    out[:, 1:] = q[:2, :-1]
    out[0, first], out[1, first] = ends, 0
    return out


def _joint(q: np.ndarray, first: np.ndarray, ends: int, teaches: np.ndarray) -> np.ndarray:
    """For 2- and 3-grams: number of training events by the context's level and their own."""
    context = contexts(q, first, ends)
    return np.stack([np.bincount(context[k][teaches] * (LEVELS + 1) + q[k + 1][teaches], minlength=(LEVELS + 1) ** 2) for k in (0, 1)])


def shares(joint: np.ndarray) -> np.ndarray:
    """Of each context level's mass the share that discounted n-grams hold, from the events of ``_joint``."""
    joint = joint.reshape(2, LEVELS + 1, LEVELS + 1).astype(float)
    kept = np.concatenate([[0], 1 - DISCOUNT / np.maximum(level_counts()[1:], 1)])
    seen = joint.sum(2)
    out = np.where(seen > 0, np.minimum((joint * kept).sum(2) / np.maximum(seen, 1), 0.999), 0)
    out[:, 0] = 0
    return out


def probabilities(q: np.ndarray, first: np.ndarray, ends: int, share: np.ndarray, tokens: int, types: int) -> np.ndarray:
    """log10 P of each token."""
    value, context = level_counts(), contexts(q, first, ends)
    p = (value[q[0]] + 1) / (tokens + types + 1)
    for k in (0, 1):
        got, own = value[q[k + 1]], np.maximum(value[context[k]], 1)
        p = np.where(got > 0, np.maximum(got - DISCOUNT, 0) / own, 0) + (1 - share[k][context[k]]) * p
    return np.log10(np.clip(p, 1e-300, 1))


def score_by(rows: DataFrame, *, entry_bits: int = ENTRY_BITS) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of rows (doc_id, teaches, text), learnt from those that teach."""
    spark = rows.sparkSession
    prepare(spark)
    parts = portions(rows)
    size = parts.agg(F.sum("size").alias("n")).first().n or 0
    bits = max(1, (-(-size // BUCKET) - 1).bit_length())
    reply = "portion long, order int, bucket int, found binary, tokens long, types long"
    replies = stored(asked(parts, bits).groupBy("bucket", "order").applyInArrow(lambda group: answer(group, entry_bits), reply), "lm-replies")
    total = replies.agg(F.sum("tokens").alias("n"), F.sum("types").alias("v")).first()
    tokens, types = total.n or 0, total.v or 0
    n_ends = parts.agg(F.sum(F.expr("size(filter(teaches, x -> x))")).alias("n")).first().n or 0
    ends, whole = int(level(np.array([n_ends]))[0]), np.log10(tokens + types + 1)

    def look(own: pa.Table, answers: pa.Table) -> pa.Table:
        ids, teaches, stops = (own.column(c).combine_chunks().flatten() for c in ("ids", "teaches", "ends"))
        e = events(_block(stops, own.column("texts")[0].as_py()))
        count, q = read(e, answers, bits, ends)
        n = len(ids)
        at = np.concatenate([[0], np.cumsum(np.bincount(e.row, minlength=n))]) * 3
        joint = _joint(q, e.first, ends, teaches.to_numpy(zero_copy_only=False)[e.row])
        full = np.flatnonzero(joint)
        once = pa.array([0, *[len(full)] * n], pa.int32())  # the portion's sums stand in its first row
        levels = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(q.T.astype(np.uint8)))])
        return pa.table({
            "doc_id": ids, "n_tokens": pa.array(np.diff(at) // 3), "n_known": pa.array(np.bincount(e.row[count > 0], minlength=n)), "base_score": pa.array(np.bincount(e.row, weights=np.log10(count + 1.0) - whole, minlength=n)),
            "levels": levels.cast(pa.binary()), "kind": pa.ListArray.from_arrays(once, pa.array(full.astype(np.int64))), "events": pa.ListArray.from_arrays(once, pa.array(joint.reshape(-1)[full])),
        })

    met = parts.select("portion", "ids", "teaches", "ends", "texts").groupBy("portion").cogroup(replies.select("portion", "order", "bucket", "found").groupBy("portion"))
    found = stored(met.applyInArrow(look, "doc_id long, n_tokens long, n_known long, base_score double, levels binary, kind array<long>, events array<long>"), "lm-levels")
    joint = np.zeros(2 * (LEVELS + 1) ** 2, np.int64)
    for r in found.select(F.explode(F.arrays_zip("kind", "events")).alias("e")).groupBy("e.kind").agg(F.sum("e.events").alias("n")).collect():  # as many as there are pairs of levels
        joint[r.kind] = r.n
    share = shares(joint)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(1).to_numpy()
            out = np.zeros(len(batch))
            at = 0
            while at < len(batch):  # about a portion's tokens at once
                to = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), PORTION // 4, "right")) + at)
                n = sizes[at:to]
                q = np.frombuffer(b"".join(x.as_buffer() for x in batch.column(4).slice(at, to - at)), np.uint8).reshape(-1, 3).T.astype(np.int64)
                first = np.zeros(q.shape[1], bool)
                first[np.cumsum(n) - n] = True
                out[at:to] = np.bincount(np.repeat(np.arange(len(n)), n), weights=probabilities(q, first, ends, share, tokens, types), minlength=len(n))
                at = to
            own = {c: batch.column(c) for c in ("doc_id", "n_tokens", "n_known")}
            yield pa.RecordBatch.from_pydict({**own, "train_tokens": pa.array([tokens] * len(batch), pa.int64()), "base_score": batch.column(3), "score": pa.array(out)})

    names = ["doc_id", "n_tokens", "n_known", "base_score", "levels"]
    return found.select(*names).mapInArrow(score, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def remainder(id_col: str, mod: int) -> Column:
    """crc32 of an id's decimal text, modulo."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % mod, F.lit(-1))


def train_and_score(docs: DataFrame, *, folds: int = 7, held_out: int = 2, entry_bits: int = ENTRY_BITS) -> DataFrame:
    """Learn from all folds but one, score all documents."""
    apart = remainder("doc_id", folds) == held_out
    rows = wanted(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = score_by(rows.select("doc_id", (~apart).alias("teaches"), "text"), entry_bits=entry_bits)
    return out.select("doc_id", apart.alias("held_out"), *out.columns[1:])
