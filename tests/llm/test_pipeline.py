"""The corpus pipeline from documents to sequences: on the smallest tables, and stage by stage against brute force."""

import collections
import hashlib
import random
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from test_operators import naive_toxicity, prose, tokenizer

from tablewright.llm import mixing, quality, shared, toxicity
from tablewright.llm.shared import stored

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stored(stage(spark, docs, SF), f"test-{name}")
        if name != "packing":
            assert docs.columns == columns
            assert docs.select("doc_id").distinct().count() == docs.count()
            assert docs.join(before, "doc_id", "left_anti").count() == 0
            sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > sizes[0] * 0.4
    assert docs.select("doc_id").distinct().count() == sizes[-1]
    assert corpus_pipeline.ORACLE_SQL is None and 4 <= len(corpus_pipeline.STAGES) <= 5


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __key string, part int, score double, __own_0 string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Prose, junk, toxic texts, near copies, copies, rows without id, text, language or source, and columns with clashing names."""
    r = random.Random(6)
    rows = []
    for i in range(260):
        words = prose(r.randint(30, 120), 700 + i).split()
        if i % 8 == 0:
            words = [w.upper() + "!!" for w in words]
        if i % 7 == 0:
            for _ in range(4):
                words.insert(r.randrange(len(words)), "zugg" + r.choice(["an", "e", "est", "ly", "or"]))
        rows.append((i, " ".join(words), i % 8 == 0, i % 7 == 0))
    rows += [(300 + i, rows[i][1] + " end", rows[i][2], rows[i][3]) for i in range(20)]  # near copies
    rows += [(400 + i, rows[30 + i][1], rows[30 + i][2], rows[30 + i][3]) for i in range(10)] + [rows[41]] * 2  # copies, and a row three times
    rows += [(500, None, False, False), (501, "", False, False), (502, prose(6000, 5), False, False), (None, prose(50, 9001), False, False), (None, prose(50, 9002), False, False), (None, rows[50][1], False, False)]
    table = [(i, t, ["en", "de", "fr", None][(i or 0) % 4], [f"src{(i or 0) % 11}", "src0", None][(i or 0) % 3], len(t or ""), "k", 1, 0.5, "x") for i, t, *_ in rows]
    path = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(table, SCHEMA).repartition(4).write.parquet(f"{path}/documents.parquet")
    labels = {i: (int(not junk), int(bad)) for i, _, junk, bad in rows if i is not None and i % 5}
    spark.createDataFrame([(i, *y) for i, y in labels.items()] + [(7777, 1, 0), (None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def plain(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def test_quality_stage_by_brute_force(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.learn(docs, marked := quality.taught(labels))
    known = {r.doc_id: r.quality for r in marked.collect()}
    rows = [(r.doc_id, r.text, ("" if r.source is None else "=" + r.source), ("" if r.lang is None else "=" + r.lang)) for r in docs.collect()]
    evidence = [float(model.evidence(quality.statistics(next(shared.blocks(pa.array([t or ""])))))[0]) for _, t, *_ in rows]
    worth = [known.get(i, e) if i is not None else e for (i, *_), e in zip(rows, evidence, strict=True)]
    n, good = collections.Counter(), collections.Counter()
    for (_, _, host, path), w in zip(rows, worth, strict=True):
        for key in ((host, path), (host,), ()):
            n[key] += 1
            good[key] += w
    mean = (good[()] + 0.5) / (n[()] + 1)

    def strength(groups):
        total = sum(k for *_, k in groups)
        spread, chance = sum(k * (r - m) ** 2 for r, m, k in groups), sum(m * (1 - m) for _, m, _ in groups)
        return min(max(sum(k * m * (1 - m) for _, m, k in groups) / total / max((spread - chance) / total, 1e-9) - 1, 1), 1e6)

    hosts, paths = [k for k in n if len(k) == 1], [k for k in n if len(k) == 2]
    k0 = strength([(good[h] / n[h], mean, n[h]) for h in hosts])
    rate = {h: (good[h] + k0 * mean) / (n[h] + k0) for h in hosts}
    k1 = strength([(good[s] / n[s], rate[s[:1]], n[s]) for s in paths])
    logit = lambda p: np.log(np.clip(p, 1e-9, 1 - 1e-9) / (1 - np.clip(p, 1e-9, 1 - 1e-9)))
    want = collections.Counter()
    for (i, t, *site), e, w in zip(rows, evidence, worth, strict=True):
        s = tuple(site)
        z = logit(e) + logit(np.clip((max(good[s] - w, 0) + k1 * rate[s[:1]]) / (n[s] - 1 + k1), 1e-6, 1 - 1e-6)) - logit(mean)
        if z >= 0:
            want[i, t] += 1
    got = STAGES["quality"](spark, docs, folder)
    assert got.columns == docs.columns and collections.Counter(plain(got)) == want
    assert 200 < sum(want.values()) < len(rows) - 20


def test_toxicity_stage_by_brute_force(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    net = toxicity.learn(docs, labels)
    scores = {t: naive_toxicity(net, t) for _, t in set(plain(docs))}
    got = STAGES["toxicity"](spark, docs, folder)
    sure = lambda rows: collections.Counter((i, t) for i, t in rows if abs(scores[t] - 0.7) > 1e-3)
    assert got.columns == docs.columns and sure(plain(got)) == sure((i, t) for i, t in plain(docs) if scores[t] < 0.7)
    bad, left = (sum("zugg" in (t or "") for _, t in plain(x)) for x in (docs, got))
    assert left <= bad // 5 and got.count() > docs.count() - bad - 10


def test_near_duplicate_stage_by_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = sorted(set(plain(docs)), key=lambda x: (x[0] is None, x[0] or 0, x[1] or ""))
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    name = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if name[i] != name[j] and (sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])):
                low, high = sorted((name[i], name[j]))
                name = [low if x == high else x for x in name]
    got = STAGES["near_duplicates"](spark, docs, folder)
    left = plain(got)
    assert got.columns == docs.columns and len(left) == len(set(name))
    by = {row: name[k] for k, row in enumerate(rows)}
    assert sorted(by[row] for row in left) == sorted(set(name))
    assert sorted(i for i, _ in left if i is not None) == sorted(rows[k][0] for k in set(name) if rows[k][0] is not None)


def test_mixing_stage_by_brute_force(spark, folder):
    docs, recipe = spark.read.parquet(f"{folder}/documents.parquet"), corpus_pipeline.RECIPE
    leaf, rows = collections.Counter(), collections.defaultdict(list)
    for r in docs.collect():
        source, lang, n = r.source or "", r.lang or "", len((r.text or "").encode().split())
        key = ("crawl" if source == "src0" else "forum" if len(source) == 4 else "reference", lang, source)
        leaf[key] += n
        rows[key].append((hashlib.md5(f"{recipe.seed}:%d:{'' if r.doc_id is None else r.doc_id}".encode()), n, r.doc_id, r.text))
    budgets = mixing.budgets(spark.createDataFrame([(*k, n) for k, n in leaf.items() if n], "domain string, lang string, source string, tokens long"), recipe).collect()
    want = collections.Counter()
    for b in budgets:
        key = (b.domain, b.lang, b.source)
        epochs, rest = divmod(b.budget, leaf[key])
        own = sorted(((hashlib.md5(f"{recipe.seed}:{epochs}:{'' if i is None else i}".encode()).hexdigest(), n, i, t) for _, n, i, t in rows[key]), key=lambda x: x[:2])
        for h, n, i, t in own:
            uses = epochs + (sum(m for g, m, *_ in own if (g, m) <= (h, n)) <= rest)
            if uses:
                want[i, t] += uses
    got = STAGES["mixing"](spark, docs, folder)
    assert got.columns == docs.columns and collections.Counter(plain(got)) == want and len(want) > 150


def test_packing_stage_by_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    t = tokenizer("byte_bpe_50k.json")
    want = collections.Counter()
    for i, text in plain(docs):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        first = len(ids) - (-(-len(ids) // 1024) - 1) * 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            want[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    got = STAGES["packing"](spark, docs, folder).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    assert all([o for o, _ in sorted(b)] == np.cumsum([0, *[n for _, n in sorted(b)]])[:-1].tolist() and sum(n for _, n in b) <= 1024 for b in bins.values())
    assert len(bins) <= -(-sum(k[3] * n for k, n in want.items()) // 1024) + 2
    assert public_tokenizers.path("byte_bpe_50k.json")


def test_pipeline_without_rows(spark, folder, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_runs_through(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = corpus_pipeline.run(spark, folder)
    assert 0 < got.select("doc_id").distinct().count() < docs.count() and got.where("length > 1024 OR offset + length > 1024").count() == 0
