"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word is the embedding of its hashed form beside the scaled sum of its hashed byte 3- to 7-grams.  Both directions
read windows of 32 words that overlap by half; attention pools the states of a window to one logit, and a document's
score is the calibrated greatest logit of all its windows.  Labels belong to documents, so training looks for the windows: a
toxic document teaches with its currently worst window, a clean one with its worst and a random one.

Learning uses a bounded sample of labelled rows (``SAMPLE`` of each class, by hash); of these, as of all texts that are scored,
every window is read.

Defined results: null and empty texts are scored as one window without words; rows that are repeated or have no id are scored
alike; null labels teach nothing, and of several labels of an id the lesser teaches; without labels of both classes every score is 0.5 x the share of class 1; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.shared import LOWER, KeyTable, TextBlock, blocks, column, mix, owned, prepare, span_keys, stored, wanted, word_spans

#: Labelled documents of each class that teach at most, with all their windows; bytes of text that are read at once, and windows that are scored.
SAMPLE, PORTION, AT_ONCE = 1000, 1 << 18, 4096
#: Words in a window and between windows; hidden units a direction; sizes of the embeddings and of their hash tables.
WINDOW, STRIDE, HIDDEN, WORD, CHARS, BUCKETS = 32, 16, 8, 8, 16, 1 << 16
GRAMS = (3, 4, 5, 6, 7)
#: Documents that a word or n-gram must occur in to be learnt, and the share of words whose own embedding is hidden in a training step.
KNOWN, HIDE = 4, 0.3
#: Words whose vectors a worker keeps.
CACHE = 300_000


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


# ---------------------------------------------------------------- words


def char_grams(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte n-grams of words between marks (<word>), and their number for each word."""
    sizes = ends - starts + 2
    to = np.cumsum(sizes)
    first = to - sizes
    marked = np.empty(int(to[-1]) if len(to) else 0, np.uint64)
    inner = np.ones(len(marked), bool)
    inner[first] = inner[to - 1] = False
    marked[first], marked[to - 1] = 2, 3
    where = np.repeat(starts - first - 1, sizes) + np.arange(len(marked))
    marked[inner] = buf[where[inner]]
    left = np.repeat(to, sizes) - np.arange(len(marked))  # bytes up to the word's end
    word = np.repeat(np.arange(len(starts)), sizes)
    out, owner = [], []
    for n in GRAMS:
        if len(marked) < n:
            continue
        h = np.full(len(marked) - n + 1, n, np.uint64)
        for k in range(n):
            h = h * np.uint64(257) + marked[k : len(marked) - n + 1 + k]
        good = left[: len(h)] >= n
        out.append((mix(h[good]) & np.uint64(BUCKETS - 1)).astype(np.int32))
        owner.append(word[: len(h)][good])
    if not out:
        return np.zeros(0, np.int64), np.zeros(len(starts), np.int64)
    own, flat = np.concatenate(owner), np.concatenate(out)
    order = np.argsort(own, kind="stable")
    return flat[order], np.bincount(own, minlength=len(starts))


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of words and row of every window; counts: words of each row."""
    n = np.maximum(1, -(-(counts - WINDOW) // STRIDE) + 1)
    row = np.repeat(np.arange(len(counts)), n)
    at = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * STRIDE
    base = np.cumsum(counts) - counts
    return base[row] + at, np.minimum(WINDOW, counts[row] - at), row


class Vocabulary:
    """Distinct words of some texts: their buckets and n-grams, and the word numbers of all texts in order.

    Blocks are taken one by one, so only word numbers grow with the texts.
    """

    def __init__(self, *texts: TextBlock) -> None:
        self._read(texts)

    @classmethod
    def of(cls, texts: Iterable[TextBlock]) -> Vocabulary:
        """The vocabulary of blocks that come one by one and are not kept."""
        out = cls.__new__(cls)
        out._read(texts)
        return out

    def _read(self, texts: Iterable[TextBlock]) -> None:
        table, keys, grams, n_grams, words, counts = KeyTable(12), [], [], [], [], []
        known = 0
        for block in texts:
            block = TextBlock(LOWER[block.buf], block.offs, block.first)
            starts, ends, rows = word_spans(block)
            own = span_keys(block.buf, starts, ends)
            new, first = np.unique(own, return_index=True)
            lost = table.find(new) < 0
            new, first = new[lost], first[lost]
            table.add(new, np.arange(known, known + len(new)))
            known += len(new)
            flat, n = char_grams(block.buf, starts[first], ends[first])
            keys.append(new)
            grams.append(flat)
            n_grams.append(n)
            words.append(table.find(own).astype(np.int32))
            counts.append(np.bincount(rows, minlength=len(block)))
        if not keys:
            keys, grams, n_grams, words, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        self.keys, self.grams, self.n_grams = (np.concatenate(x) for x in (keys, grams, n_grams))
        self.words, self.counts = np.concatenate(words), np.concatenate(counts)
        self.bucket = (self.keys & np.uint64(BUCKETS - 1)).astype(np.int64)


# ---------------------------------------------------------------- network


class Network:
    """Parameters, forward and backward passes."""

    def __init__(self, seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        d, h = WORD + CHARS, HIDDEN
        f = lambda *s, k: (r.normal(size=s) * k).astype(np.float32)
        self.p = {
            "word": np.zeros((BUCKETS, WORD), np.float32), "char": np.zeros((BUCKETS, CHARS), np.float32), "wx": f(2, d, 3 * h, k=0.3), "b": np.zeros((2, 3 * h), np.float32), "u": f(2, h, 3 * h, k=0.3),
            "wa": f(2 * h, h, k=0.5), "va": f(h, k=0.5), "wo": f(2 * h, k=0.5), "bo": np.full(1, -1.0, np.float32),
        }
        self.scale, self.shift = 1.0, 0.0

    def vectors(self, bucket: np.ndarray, grams: np.ndarray, n_grams: np.ndarray) -> np.ndarray:
        """Word vectors: hashed word beside the sum of its n-grams over the root of their number (every word has one at least)."""
        out = np.empty((len(bucket), WORD + CHARS), np.float32)
        out[:, :WORD] = self.p["word"][bucket]
        ends = np.cumsum(n_grams)
        for at in range(0, len(bucket), 4096):
            n = n_grams[at : at + 4096]
            stop = ends[at : at + 4096]
            low = int(stop[0] - n[0])
            out[at : at + 4096, WORD:] = np.add.reduceat(self.p["char"][grams[low : stop[-1]]], stop - n - low, axis=0) / np.sqrt(n)[:, None]
        return out

    def project(self, vectors: np.ndarray) -> np.ndarray:
        """Inputs to the gates of both directions; one row more, of zeros, for places without a word."""
        out = np.zeros((len(vectors) + 1, 2, 3 * HIDDEN), np.float32)
        for k in (0, 1):
            out[:-1, k] = vectors @ self.p["wx"][k] + self.p["b"][k]
        return out

    def states(self, gates: np.ndarray, place: np.ndarray, tape: list | None = None) -> np.ndarray:
        """States of both directions; place: rows of ``gates`` (last: no word) for windows x words."""
        m, t = place.shape
        h_, out = HIDDEN, np.zeros((t, m, 2 * HIDDEN), np.float32)
        none = len(gates) - 1
        for k in (0, 1):
            h, u = np.zeros((m, h_), np.float32), self.p["u"][k]
            g = np.ascontiguousarray(gates[:, k])
            for s in range(t) if k == 0 else range(t - 1, -1, -1):
                own = place[:, s]
                x, a = g[own], h @ u
                zr = _fast_sigmoid(x[:, : 2 * h_] + a[:, : 2 * h_])
                z, r = zr[:, :h_], zr[:, h_:]
                n = np.tanh(x[:, 2 * h_ :] + r * a[:, 2 * h_ :])
                new = n + z * (h - n)
                on = (own != none)[:, None]
                if tape is not None:
                    tape.append((k, s, h, z, r, n, a[:, 2 * h_ :], on))
                h = np.where(on, new, h)
                out[s, :, k * h_ : (k + 1) * h_] = h
        return out

    def pool(self, states: np.ndarray, on: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Logit of each window, and what the backward pass needs."""
        e = np.tanh(states @ self.p["wa"])
        a = np.where(on, e @ self.p["va"], -1e9)
        a = np.exp(a - a.max(0))
        a *= on
        a /= np.maximum(a.sum(0), 1e-9)
        pooled = np.einsum("tm,tmh->mh", a, states)
        return pooled @ self.p["wo"] + self.p["bo"][0], pooled, a, e

    def logits(self, gates: np.ndarray, place: np.ndarray) -> np.ndarray:
        out = np.empty(len(place), np.float32)
        for at in range(0, len(place), 4096):
            own = place[at : at + 4096]
            out[at : at + 4096] = self.pool(self.states(gates, own), (own != len(gates) - 1).T)[0]
        return out

    def gradients(self, vocab: Vocabulary, place: np.ndarray, y: np.ndarray, hide: np.ndarray | None = None) -> dict:
        """Gradients of the mean loss of some windows; those of the embeddings by touched row.  hide: random numbers, one a word."""
        p, h_ = self.p, HIDDEN
        n = len(vocab.keys)
        used = np.unique(place[place < n])
        back = np.full(n + 1, len(used))
        back[used] = np.arange(len(used))
        own = back[place]
        first = np.cumsum(vocab.n_grams) - vocab.n_grams
        size = vocab.n_grams[used]
        grams = vocab.grams[np.repeat(first[used] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        vec = self.vectors(vocab.bucket[used], grams, size)
        shown = np.float32(1) if hide is None else (hide[: len(used), None] >= HIDE).astype(np.float32)
        vec[:, :WORD] *= shown
        gates = self.project(vec)
        tape: list = []
        states = self.states(gates, own, tape)
        on = (own != len(used)).T
        logit, pooled, a, e = self.pool(states, on)
        d = ((_sigmoid(logit) - y) / len(y)).astype(np.float32)
        g = {"u": np.zeros_like(p["u"]), "wx": np.zeros_like(p["wx"]), "b": np.zeros_like(p["b"])}
        g["wo"], g["bo"] = pooled.T @ d, d.sum(keepdims=True)
        dp = d[:, None] * p["wo"]
        da = np.einsum("tmh,mh->tm", states, dp)
        de = a * (da - (a * da).sum(0))
        g["va"] = np.einsum("tm,tmk->k", de, e)
        dk = de[:, :, None] * p["va"] * (1 - e * e)
        g["wa"] = np.tensordot(states, dk, ([0, 1], [0, 1]))
        ds = a[:, :, None] * dp + dk @ p["wa"].T
        dx = np.zeros((2, own.shape[1], len(own), 3 * h_), np.float32)
        carry = [np.zeros((len(own), h_), np.float32) for _ in (0, 1)]
        for k, s, h, z, r, nn, an, live in reversed(tape):
            dh = carry[k] + ds[s, :, k * h_ : (k + 1) * h_]
            new = np.where(live, dh, 0)
            dn = new * (1 - z) * (1 - nn * nn)
            dz, dr = new * (h - nn) * z * (1 - z), dn * an * r * (1 - r)
            du = np.concatenate([dz, dr, dn * r], 1)
            dx[k, s, :, : 2 * h_], dx[k, s, :, 2 * h_ :] = du[:, : 2 * h_], dn
            carry[k] = np.where(live, 0, dh) + new * z + du @ p["u"][k].T
            g["u"][k] += h.T @ du
        dv = np.zeros_like(vec)
        for k in (0, 1):
            dg = _by_row(own.T.reshape(-1), dx[k].reshape(-1, 3 * h_), len(used) + 1)[:-1]
            g["wx"][k], g["b"][k] = vec.T @ dg, dg.sum(0)
            dv += dg @ p["wx"][k].T
        dv[:, :WORD] *= shown
        fine = vocab.common[vocab.bucket[used]]
        sparse = {"word": (vocab.bucket[used][fine], dv[:, :WORD][fine])}
        fine = vocab.common_grams[grams]
        sparse["char"] = (grams[fine], np.repeat(dv[:, WORD:] / np.sqrt(size)[:, None], size, axis=0)[fine])
        for name, (rows, values) in sparse.items():
            at, back = np.unique(rows, return_inverse=True)
            g[name] = (at, _by_row(back, values, len(at)))
        return g


def _by_row(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the values of each row."""
    out = np.zeros((n, values.shape[1]), np.float32)
    if len(rows):
        order = np.argsort(rows, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(rows[order]) != 0]))
        out[rows[order][first]] = np.add.reduceat(values[order], first, axis=0)
    return out


def _fast_sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


# ---------------------------------------------------------------- training


def _places(vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of every window (the number of words: none) and the windows' rows."""
    first, size, row = windows(vocab.counts)
    return _placed(vocab, first, size), row


def _placed(vocab: Vocabulary, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Word numbers of some windows, by their first words and numbers of words."""
    none = np.int32(len(vocab.keys))
    if not len(vocab.words):
        return np.full((len(first), WINDOW), none)
    at = np.minimum(first[:, None] + np.arange(WINDOW), len(vocab.words) - 1)
    return np.where(np.arange(WINDOW) < size[:, None], vocab.words[at], none)


def _portions(rows: Iterable[tuple[str, int]], marks: list[int]) -> Iterator[TextBlock]:
    """The texts in blocks, a portion at a time; their marks are appended to ``marks``."""
    held, size = [], 0
    for text, mark in rows:
        marks.append(mark)
        held.append(text)
        size += len(text)
        if size >= PORTION:
            yield from blocks(pa.array(held, pa.large_string()), PORTION)
            held, size = [], 0
    yield from blocks(pa.array(held, pa.large_string()), PORTION)


def train(rows: Iterable[tuple[str, int]], *, steps: int = 210, batch: int = 128, rounds: int = 6) -> Network:
    """Learn from whole documents' labels (text, toxic); seeded, so equal samples give equal networks.

    Texts are read in portions; what stays of them is a word's number for each word and the places of the windows.
    """
    net, rng = Network(), np.random.default_rng(11)
    marks: list[int] = []
    vocab = Vocabulary.of(_portions(rows, marks))
    y = np.asarray(marks, np.int64)
    net.shift = float(np.log(max(y.mean(), 1e-3) / max(1 - y.mean(), 1e-3))) if len(y) else -3.0
    if len(set(marks)) < 2:
        net.scale = 0.0
        return net
    start, length, row = windows(vocab.counts)
    place = lambda own: _placed(vocab, start[own], length[own])

    def scored(of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        return np.concatenate([of(place(slice(at, at + AT_ONCE))) for at in range(0, len(row), AT_ONCE)])

    # The first guess at toxic windows, and at the embeddings' first dimension: how much oftener toxic documents have a bucket.
    seed = {}
    for name in ("word", "char"):
        n1, n0 = _documents_with(vocab, y, name)
        odds = np.log(n1 / (y.sum() + 1)) - np.log(n0 / ((1 - y).sum() + 1))
        # Only what chance doesn't explain counts; rare buckets are never learnt, or they would name documents.
        seed[name] = np.sign(odds) * np.maximum(np.abs(odds) - 2 * np.sqrt(1 / n1 + 1 / n0), 0)
        known = n0 + n1 > KNOWN
        if name == "word":
            vocab.common = known
        else:
            vocab.common_grams = known
        net.p[name][known] = rng.normal(size=(int(known.sum()), net.p[name].shape[1])).astype(np.float32) * 0.05
        net.p[name][:, 0] = np.clip(seed[name], -2, 4)
    first = np.cumsum(vocab.n_grams) - vocab.n_grams
    evidence = np.maximum(seed["word"][vocab.bucket], np.maximum.reduceat(seed["char"][vocab.grams], first)) if len(first) else np.zeros(0)
    padded = np.append(evidence, -9)
    score = scored(lambda own: padded[own].max(1))
    moment = {k: np.zeros_like(v) for k, v in net.p.items()}
    power = {k: np.zeros_like(v) for k, v in net.p.items()}
    done = 0
    for _ in range(rounds):
        order = np.lexsort((-score, row))
        worst = order[np.concatenate([[True], row[order][1:] != row[order][:-1]])]
        pos, neg = worst[y[row[worst]] == 1], worst[y[row[worst]] == 0]
        other = np.flatnonzero(y[row] == 0)
        for _ in range(steps // rounds):
            picked = np.concatenate([rng.choice(pos, batch // 2), rng.choice(neg, batch // 4), rng.choice(other, batch // 4)])
            g = net.gradients(vocab, place(picked), y[row[picked]].astype(np.float32), rng.random(len(picked) * WINDOW))
            done += 1
            rate = 0.02 * min(1, done / 10) * (1 - 0.8 * done / steps)
            for k, own in g.items():
                at, own = own if isinstance(own, tuple) else (slice(None), own)
                moment[k][at] += 0.1 * (own - moment[k][at])
                power[k][at] += 0.01 * (own * own - power[k][at])
                net.p[k][at] -= rate * (moment[k][at] / (1 - 0.9**done)) / (np.sqrt(power[k][at] / (1 - 0.99**done)) + 1e-5)
        gates = net.project(net.vectors(vocab.bucket, vocab.grams, vocab.n_grams))
        score = scored(lambda own: net.logits(gates, own))
    # Calibrate the greatest logits on the documents: a logistic curve by Newton's method with a mild prior.
    top = np.full(len(y), -np.inf)
    np.maximum.at(top, row, score)
    a, b = 1.0, 0.0
    for _ in range(30):
        s = _sigmoid(a * top + b)
        w = s * (1 - s) + 1e-6
        ga, gb = ((s - y) * top).sum() + (a - 1), (s - y).sum() + b * 0.1
        haa, hab, hbb = (w * top * top).sum() + 1, (w * top).sum(), w.sum() + 0.1
        det = haa * hbb - hab * hab
        a, b = a - (hbb * ga - hab * gb) / det, b - (haa * gb - hab * ga) / det
    net.scale, net.shift = float(max(a, 0.05)), float(b)
    return net


def _documents_with(vocab: Vocabulary, y: np.ndarray, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Toxic and clean documents that each bucket occurs in (plus a half), a few documents at a time."""
    n1, n0 = np.full(BUCKETS, 0.5), np.full(BUCKETS, 0.5)
    first = np.cumsum(vocab.n_grams) - vocab.n_grams
    ends = np.cumsum(vocab.counts)
    at = 0
    for d in range(len(y)):
        words = np.unique(vocab.words[at : ends[d]])
        at = int(ends[d])
        if name == "word":
            flat = vocab.bucket[words]
        else:
            n = vocab.n_grams[words]
            flat = vocab.grams[np.repeat(first[words] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        (n1 if y[d] else n0)[np.unique(flat)] += 1
    return n1, n0


# ---------------------------------------------------------------- scoring


class Scorer:
    """A network with a cache of the gate inputs of words."""

    def __init__(self, net: Network) -> None:
        self.net = net
        self._clear()

    def _clear(self) -> None:
        self.table, self.gates, self.n = KeyTable(14), np.zeros((1 << 14, 2, 3 * HIDDEN), np.float32), 0

    def scores(self, block: TextBlock) -> np.ndarray:
        block = TextBlock(LOWER[block.buf], block.offs, block.first)
        starts, ends, rows = word_spans(block)
        keys = span_keys(block.buf, starts, ends)
        if self.n > CACHE:
            self._clear()
        found = self.table.find(keys)
        lost = np.flatnonzero(found < 0)
        if len(lost):
            new, first = np.unique(keys[lost], return_index=True)
            at = lost[first]
            made = self.net.project(self.net.vectors((new & np.uint64(BUCKETS - 1)).astype(np.int64), *char_grams(block.buf, starts[at], ends[at])))[:-1]
            while self.n + len(new) + 1 > len(self.gates):
                self.gates = np.concatenate([self.gates, np.zeros_like(self.gates)])
            self.gates[self.n : self.n + len(new)] = made
            self.table.add(new, np.arange(self.n, self.n + len(new)))
            self.n += len(new)
            found[lost] = self.table.find(keys[lost])
        counts = np.bincount(rows, minlength=len(block))
        first, size, row = windows(counts)
        words = np.append(found, self.n)
        self.gates[self.n] = 0
        out = np.full(len(block), -np.inf)
        for at in range(0, len(first), 4096):
            to = at + 4096
            place = np.where(np.arange(WINDOW) < size[at:to, None], words[np.minimum(first[at:to, None] + np.arange(WINDOW), len(found))], self.n)
            np.maximum.at(out, row[at:to], self.net.logits(self.gates[: self.n + 1], place))
        return _sigmoid(self.net.scale * out + self.net.shift)


_scorers: dict[int, Scorer] = {}


def score(docs: DataFrame, net: Network, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row."""
    spark = docs.sparkSession
    prepare(spark)
    sent = spark.sparkContext.broadcast(net)  # its size is fixed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(sent.value)
        for batch in batches:
            for block in blocks(batch.column(1)):
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(block.first, len(block)), "score": pa.array(s.scores(block))})

    rows = wanted(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, "doc_id long, score double")


def keep_civil(docs: DataFrame, net: Network, *, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The documents, with all their columns, whose score is below the threshold."""
    spark = docs.sparkSession
    prepare(spark)
    sent = spark.sparkContext.broadcast(net)
    rows, first = owned(docs)
    width = len(rows.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(sent.value)
        for batch in batches:
            bad = np.concatenate([*[s.scores(b) for b in blocks(batch.column(width))], np.zeros(0)]) >= threshold
            yield batch.select(list(range(width))).filter(pa.array(~bad))

    return rows.withColumn("__text", column(first, text_col)).mapInArrow(run, rows.schema).toDF(*docs.columns)


def learn(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> Network:
    """Train on a bounded sample of the labelled documents: of each class the first ``sample`` by hash.

    Only labels of documents that are there count, one for each id (the lesser of several).
    """
    marked = wanted(labels, "doc_id", "toxic").where("toxic IN (0, 1) AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), F.col("toxic").cast("int"))
    texts = wanted(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    there = texts.select("doc_id").where("doc_id IS NOT NULL").distinct()
    known = stored(marked.groupBy("doc_id").agg(F.min("toxic").alias("toxic")).join(there, "doc_id", "left_semi"), "toxicity-labels")
    order = F.xxhash64("doc_id")
    some = known.where("toxic = 1").orderBy(order, "doc_id").limit(sample).unionByName(known.where("toxic = 0").orderBy(order, "doc_id").limit(sample))
    chosen = texts.join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.min(F.coalesce("text", F.lit(""))).alias("text"))
    # The parts come one at a time in order of ids, so the driver never holds all the texts.
    parts = stored(chosen, "toxicity-taught").repartitionByRange(16, "doc_id").sortWithinPartitions("doc_id")
    return train((r.text, r.toxic) for r in parts.toLocalIterator())


def classify(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, folds: int = 3, held_out: int = 1) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; the held-out fold's labels are never looked at."""
    prepare(docs.sparkSession)
    remainder = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds, F.lit(-1))
    net = learn(docs, labels.where(remainder != held_out))
    return score(docs, net).select("doc_id", (remainder == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
