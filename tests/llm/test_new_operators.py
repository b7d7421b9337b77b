"""Decontamination, the Merkle manifest and hard negatives on odd rows, against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tablewright.llm import decontaminate, merkle, negatives, shared

R = random.Random(8)
VOCAB = ["".join(R.choice("abdeinorstéñ") for _ in range(R.randint(1, 9))) for _ in range(60)]


def prose(n, seed):
    r = random.Random(seed)
    return "".join(r.choice(VOCAB) + r.choice([" ", ", ", ".\n", "-", "  "]) for _ in range(n))


# ---------------------------------------------------------------- decontamination

ITEMS = [
    (1, prose(40, 1)), (2, prose(10, 2)), (3, prose(11, 3)), (4, "Short one"), (5, "únÍco"), (6, prose(40, 1)), (6, prose(25, 4)), (10, " ".join(["again"] * 14)), (11, None), (12, ""), (13, "-- !"), (None, prose(12, 5)), (14, prose(9, 6)),
]
PASSAGE = prose(40, 1)
DOCS = [
    (0, "nothing of that kind"), (1, f"lead {PASSAGE} tail"), (2, PASSAGE.upper().replace("É", "é").replace("Ñ", "ñ")), (3, prose(40, 1)[30:90] + " cut"), (4, None), (5, ""), (6, "a SHORT... one, shorter one"), (7, "x únÍco; ÚNÍCO"), (8, " ".join(["again"] * 30)),
    (9, prose(10, 2) + prose(11, 3)), (10, " ".join(prose(10, 2).split()[:5])), (10, " ".join(prose(10, 2).split()[5:])), (None, prose(12, 5)), (11, prose(20_000, 9) + PASSAGE + prose(5000, 10)), (12, prose(9, 6)), (13, "x" * 300_000), *[(20 + i, prose(200, 50 + i)) for i in range(20)],
]


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))


def hits(text, items):
    own, hit, found = split(text), set(), set()
    for item, other in items:
        w = split(other)
        m = min(10, len(w))
        wins = {tuple(w[i : i + m]) for i in range(len(w) - m + 1)} if m else set()
        at = [i for i in range(len(own) - m + 1) if tuple(own[i : i + m]) in wins] if m else []
        hit.update(p for i in at for p in range(i, i + m))
        found.update([str(item)] if at and item is not None else [])
    return len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("most", [decontaminate.BLOCK_BYTES, 1500])
def test_decontamination_equals_brute_force(spark, most):
    docs = spark.createDataFrame([(i, t, "s", "w") for i, t in DOCS], "doc_id long, text string, spans string, items string").repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = sorted(map(tuple, decontaminate.marked(docs, items, most=most).collect()), key=repr)
    assert got == sorted(((i, *hits(t, ITEMS)) for i, t in DOCS), key=repr)
    assert len({r[4] for r in got}) > 5


def test_decontamination_of_nothing(spark):
    docs, items = spark.createDataFrame(DOCS[:4], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert {tuple(r)[2:4] + (r.contaminated,) for r in decontaminate.marked(docs, items).collect()} == {(0, 0, False)}
    assert decontaminate.marked(docs.limit(0), items).count() == 0
    assert decontaminate.marked(docs, docs.selectExpr("doc_id AS item_id", "text AS other")).where("n_hit > 0").count() == 0


def test_shifts_skip_most_words():
    """Words that no window has are passed over almost a window at a time."""
    texts = [" ".join(f"w{i}" for i in range(k, k + 10)).encode() for k in range(100)]
    t = decontaminate.Tables(10, texts, [["1"]] * 100)
    looked = []
    block = decontaminate.Words.block
    own = next(shared.blocks(pa.array([" ".join(f"other{i}" for i in range(5000)) + " " + texts[3].decode()])))
    words = decontaminate.Words.of(own.buf, own.offs)
    words.block = lambda e, at, two: looked.append(len(at)) or block(words, e, at, two)
    ends, found = t.search(words)
    assert ends.tolist() == [len(words) - 1] and found.tolist() == [3] and sum(looked) < len(words) / 4


# ---------------------------------------------------------------- manifest


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def brute_manifest(rows):
    def leaf(*v):
        return digest("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in v))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([digest("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
        return levels

    def climb(levels, at, now, proof):
        for nodes in levels[:-1]:
            run, own = nodes[at // 16 * 16 :][:16], at % 16
            proof += "".join(run[:own] + run[own + 1 :])
            run[own] = now
            now, at = digest("".join(run)), at // 16
        return now, proof

    by = collections.defaultdict(list)
    for d, s, la, n, t in rows:
        low = t and t.translate({i: i + 32 for i in range(65, 91)})
        by[s].append((d, leaf(d, s, la, n, t), leaf(d, s, la, n, low) if d is not None and zlib.crc32(str(d).encode()) % 5 == 0 else None))
    keys = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for own in by.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    trees = [tree([h for _, h, _ in by[k]]) for k in keys]
    top = tree([t[-1][0] for t in trees])
    for i, k in enumerate(keys):
        for at, (d, h, other) in enumerate(by[k]):
            now, proof = climb(trees[i], at, other or h, "")
            now, proof = climb(top, i, now, proof)
            yield d, h, trees[i][-1][0], top[-1][0], digest(proof), now, now == top[-1][0]


MANIFEST = [(i if i % 11 else None, f"s{i % 3}" if i % 3 else None, "en" if i % 4 else None, i, f"Text {i // 2} É" if i % 5 else None) for i in range(300)] + [(1000 + i, f"é{i}", None, None, "") for i in range(60)] + [(7, "s1", "en", 7, "A")] * 3


@pytest.mark.parametrize("shape", [merkle.Shape(), merkle.Shape(16, 4096), merkle.Shape(16, 5), merkle.Shape(16, 1), merkle.Shape(256, 3)])
def test_manifest_equals_brute_force(spark, shape):
    """Also with blocks and a top tree so small that nodes climb in several rounds, sources' roots among them."""
    docs = spark.createDataFrame([(*r, "clash") for r in MANIFEST], "doc_id long, source string, lang string, n_chars long, text string, h string").repartition(4)
    got = sorted(map(tuple, merkle.manifest(docs, shape).collect()), key=repr)
    assert got == sorted(brute_manifest(MANIFEST), key=repr)


@pytest.mark.parametrize("n", [0, 1, 2, 16, 17])
def test_small_manifests(spark, n):
    rows = [(i, "one", "en", i, f"Abc {i}") for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = merkle.manifest(docs).collect()
    assert sorted(map(tuple, got)) == (sorted(brute_manifest(rows)) if n else [])
    assert n != 1 or got[0].root == got[0].subroot == got[0].leaf and got[0].proof_sha256 == digest("")


# ---------------------------------------------------------------- hard negatives


def brute_negatives(rows):
    kept = {}
    for i, v, label in sorted(rows, key=repr):
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        whole = [int(np.floor(256 * np.float64(np.float32(x)))) for x in v]
        own = ((label + 1) % 10 if i % 7 == 0 else label, whole)
        kept[i] = min(kept.get(i, own), own)
    for a, (la, va) in kept.items():
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(va, v, strict=True)), b, lb) for b, (lb, v) in kept.items() if b != a)
        for ps, p, _ in [x for x in scored if x[2] == la][:5]:
            window = [(-s, b) for s, b, lb in scored if lb != la and 30 * -ps <= 100 * -s <= 90 * -ps][:10]
            yield from ((a, p, k, b, -ps, s) for k, (s, b) in enumerate(window, 1))


def vectors(n, scale=1.0):
    r = np.random.default_rng(3)
    x = (r.normal(size=(n, 8)) * r.choice([0.05, 0.3, 1.0], size=(n, 1)) * scale).round(2)
    x[n // 2 : n // 2 + n // 3] = x[0]  # a third of all rows is one vector
    return [(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, r.integers(0, 4, n), strict=True))]


ODD = [(5000, None, 1), (5100, [0.1] * 8, None), (5200, [0.1] * 7 + [None], 1), (5300, [0.1] * 7 + [float("nan")], 2), (5400, [0.0] * 8, 3), (None, [0.2] * 8, 1), (5500, [0.3] * 8, 77), (0, [9.0] * 8, 9), (5600, [-0.4] * 8, 1)]


@pytest.mark.parametrize("scale", [1.0, 40.0])
@pytest.mark.parametrize(("bucket", "buckets"), [(negatives.BUCKET, negatives.BUCKETS), (16, 2)])
def test_negatives_equal_brute_force(spark, bucket, buckets, scale):
    """Small buckets and stripes make many rounds, each with the scores that those before it reached."""
    rows = vectors(700, scale) + ODD
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, norm2 int, short int").repartition(5)
    own = negatives.usable(table)
    got = sorted(map(tuple, negatives.mine(own, index=negatives.build(own, bucket, buckets)).collect()))
    assert got == sorted(brute_negatives(rows)) and len(got) > 100


def test_negatives_of_nothing(spark):
    table = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert negatives.mine(negatives.usable(table)).count() == 0
    alone = spark.createDataFrame([(100, [0.5, 0.5], 1)], "vec_id long, embedding array<float>, label int")
    assert negatives.mine(negatives.usable(alone)).count() == 0


def test_short_vectors_are_left_out():
    """Where norms differ, buckets that can't reach the running k-th score are never multiplied."""
    r = np.random.default_rng(1)
    x = (r.normal(size=(4096, 16)) * np.geomspace(1000, 1, 4096)[:, None]).astype(np.int64)
    ids, labels = np.arange(4096), np.zeros(4096, np.int64)
    order = np.argsort(-(x**2).sum(1), kind="stable")
    buckets = [(int((x[b] ** 2).sum(1).max()), np.sort(b), labels[b], x[np.sort(b)]) for b in np.split(order, 64)]
    q = r.normal(size=(20, 16)) * 100
    anchors = negatives.Anchors(np.full(20, -5), np.ones(20, np.int64), q.astype(np.int64), np.full((20, 1), 1), np.full((20, 1), 1 << 40), 10, False)
    best, names, done = anchors.walk(iter(buckets))
    exact = q.astype(np.int64) @ x.T
    assert all(best[i, 0].tolist() == sorted(exact[i].tolist())[::-1][:10] for i in range(20)) and done < 20 * 4096 / 3 and (names >= 0).all()


@pytest.mark.parametrize("size", [1, 1 << 13, 1 << 30])
def test_products_are_exact(size):
    r = np.random.default_rng(2)
    a, b = r.integers(-size, size + 1, (5, 6)), r.integers(-size, size + 1, (7, 6))
    bound = float(np.sqrt((a.astype(float) ** 2).sum(1).max() * (b.astype(float) ** 2).sum(1).max()))
    assert negatives._products(a, b, bound).tolist() == [[int(sum(int(x) * int(y) for x, y in zip(u, v, strict=True))) for v in b] for u in a]
