"""Each training-data operator on small tables with odd rows, against brute force."""

import collections
import hashlib
import math
import random
import time
import zlib
from html.parser import HTMLParser

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tablewright.llm import ann, digest, html_extract, lm_score, mixing, packing, quality, shared, simhash, token_output, toxicity
from tablewright.llm.tokens import Encoder

WORD, BYTE = "word_bpe_49k.json", "byte_bpe_50k.json"
R = random.Random(5)
VOCAB = ["".join(R.choice("abdeinorst") for _ in range(R.randint(1, 8))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) for _ in range(n))


LONG = prose(30_000, 1)
BASE = prose(300, 2)
TEXTS = [
    (0, "Hello world, it's 5 o'clock."), (1, None), (2, ""), (3, LONG), (4, BASE), (5, BASE), (6, BASE.replace(BASE.split()[10], "changed", 1)), (7, "one"), (8, "a  b\n\tc   d"),
    (9, "É ñ 中文 \U0001f600 İ ς"), (10, prose(80, 3)), (10, prose(80, 3)), (11, "   "), (None, prose(20, 4)), *[(20 + i, prose(60 + i, 100 + i)) for i in range(30)],
]
SCHEMA = "doc_id long, text string, lang string, source string, n string, key string, part int, __id string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if (i or 0) % 3 else None, f"src{(i or 0) % 4}" if i != 7 else None, "n", "k", 1, "x") for i, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def tokenizer(name):
    return Tokenizer.from_file(P.path(name))


@pytest.mark.parametrize("name", [WORD, BYTE])
def test_encoder_equals_the_library(name):
    odd = ["a  b\n\nc \t d ", " lead", "trail ", "é é ü", "Don't we'll 'tis 123 4.5", "<|endoftext|> hi", "中文 字 ’ a ” b", "İstanbul ΣΑΣ ς", "\x1c a \x85 b", "ß ÿ × ÷ µ", "　 　 x", "a\xa0 \xa0b   c", "", "word,word. (x)", *[t or "" for _, t in TEXTS]]
    e, t = Encoder(P.path(name)), tokenizer(name)
    for block in shared.blocks(pa.array(odd), 200):
        ids, offs = e.encode(block)
        for k in range(len(block)):
            text = block.buf[block.offs[k] : block.offs[k + 1]].tobytes().decode()
            assert ids[offs[k] : offs[k + 1]].tolist() == t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", [WORD, BYTE])
def test_special_tokens_are_what_the_library_makes_of_them(name):
    """At starts and ends, inside words, across lines and at the borders of blocks."""
    e, t, r = Encoder(P.path(name)), tokenizer(name), random.Random(3)
    special = [x.content for x in t.get_added_tokens_decoder().values()] or ["<|endoftext|>"]
    bits = [*special, *special, "<|", "|>", " ", "  ", "\n", "a", "hello", " world", "é", "中", ".", "<|endoftext", "\t"]
    texts = [*special, *["".join(r.choice(bits) for _ in range(r.randint(1, 9))) for _ in range(2000)]]
    for block in shared.blocks(pa.array(texts), 500):
        ids, offs = e.encode(block)
        for k in range(len(block)):
            text = block.buf[block.offs[k] : block.offs[k + 1]].tobytes().decode()
            assert ids[offs[k] : offs[k + 1]].tolist() == t.encode(text, add_special_tokens=False).ids, text
    as_text = Encoder(P.path(name), special_as_text=True)
    assert set(as_text.encode(next(shared.blocks(pa.array(special))))[0].tolist()).isdisjoint(t.get_added_tokens_decoder())


@pytest.mark.parametrize("name", [WORD, BYTE])
@pytest.mark.parametrize("size", [1024, 2048, 4096])
def test_encoder_tells_words_of_equal_sums_apart(name, size):
    parity = "".join("ab"[i.bit_count() & 1] for i in range(size))  # and its complement: equal under polynomial hashes modulo 2 ** 64
    texts = [parity, parity.translate(str.maketrans("ab", "ba")), parity]
    e, t = Encoder(P.path(name)), tokenizer(name)
    for text in texts:
        assert e.encode(next(shared.blocks(pa.array([text]))))[0].tolist() == t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", [WORD, BYTE])
def test_closing_marks_and_line_feeds_teach_no_new_units(name):
    """A word is learnt once as it stands and once behind a blank, whatever closes it and whatever line follows."""
    r, marks = random.Random(8), [".", ",", "!!", "###", "***", ".\n", "?\n", "\n", ""]
    texts = ["".join(r.choice(VOCAB) + (m := r.choice(marks)) + ("" if m.endswith("\n") else " ") for _ in range(200)) + "x" for _ in range(100)]
    e, t = Encoder(P.path(name)), tokenizer(name)
    for block in shared.blocks(pa.array(texts), 5000):
        ids, offs = e.encode(block)
        for k in range(len(block)):
            assert ids[offs[k] : offs[k + 1]].tolist() == t.encode(texts[block.first + k], add_special_tokens=False).ids
    assert e.units <= 2 * len(VOCAB) + 20


@pytest.mark.parametrize("name", [WORD, BYTE])
def test_units_are_cut_where_the_library_cuts(name):
    """Letters, marks, digits, blanks of all kinds and special tokens side by side in any order."""
    bits = ["a", "Z", "the", "é", "É", "ß", "ÿ", "×", "÷", "'", "'s", "'LL", ".", "...", "<", "|", ">", "_", "\n", "\n\n", "\r\n", "\t", " ", "  ", "\x85", "\xa0", "\u2003", "\u2028", "7", "123", "٣", "½", "\u0301", "\u0338", "中", "\U0001f600", "Σ", "İ", "\x00", "\x1c", "\x7f", "<|endoftext|>", "endoftext"]
    r = random.Random(12)
    texts = ["".join(r.choice(bits) for _ in range(r.randint(1, 12))) for _ in range(5000)]
    e, want = Encoder(P.path(name)), tokenizer(name).encode_batch(texts, add_special_tokens=False)
    for block in shared.blocks(pa.array(texts), 300):
        ids, offs = e.encode(block)
        for k in range(len(block)):
            assert ids[offs[k] : offs[k + 1]].tolist() == want[block.first + k].ids, texts[block.first + k]


def test_encoder_survives_clashing_keys(monkeypatch):
    monkeypatch.setattr("tablewright.llm.tokens.folded", lambda a, b: (a & np.uint64(7)) + np.uint64(1 << 63))
    e, t = Encoder(P.path(WORD)), tokenizer(WORD)
    for text in [BASE, LONG[:2000], BASE]:
        assert e.encode(next(shared.blocks(pa.array([text]))))[0].tolist() == t.encode(text, add_special_tokens=False).ids


def test_exact_keys_are_exact():
    r = random.Random(4)
    words = sorted({bytes(r.choice(b"ab\0") for _ in range(r.randint(1, 20))) for _ in range(4000)})
    ends = np.cumsum([len(w) for w in words])
    a, b = shared.exact_keys(np.frombuffer(b"".join(words), np.uint8), np.concatenate([[0], ends[:-1]]), ends)
    assert len(set(zip(a.tolist(), b.tolist(), strict=True))) == len(words)


def test_token_files_need_ids_that_fit(spark, docs):
    with pytest.raises(Exception, match="does not fit"):
        token_output.write_tokens(docs, P.path(WORD), end_id=1 << 16)


def test_token_files_round_trip(spark, docs, none):
    files = token_output.write_tokens(docs, P.path(WORD), end_id=1)
    rows = token_output.read_tokens(spark, token_output.open_tokens(files.path)).orderBy("start").collect()
    t, at = tokenizer(WORD), 0
    assert [r.doc_id for r in rows] == sorted((i for i, _ in TEXTS), key=lambda i: -1 if i is None else i)
    by = collections.defaultdict(list)
    for i, text in TEXTS:
        by[i].append(t.encode(text or "", add_special_tokens=False).ids + [1])
    for r in rows:
        assert r.start == at and r.ids in by[r.doc_id] and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    assert token_output.read_tokens(spark, token_output.write_tokens(none, P.path(WORD))).count() == 0


def test_packing_covers_all_and_meets_bounds(spark, docs, none):
    packed = packing.pack(docs, P.path(BYTE), end_id=2, capacity=1024)
    rows = packed.pieces.join(packed.places, "key").collect()
    t, seq = tokenizer(BYTE), collections.defaultdict(list)
    want = collections.Counter((i, tuple(t.encode(x or "", add_special_tokens=False).ids + [2])) for i, x in TEXTS)
    whole = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: r.key):
        whole[r.doc_id].append((r.piece, np.frombuffer(r.ids, "<u4").tolist()))
        seq[r.sequence_id].append((r.offset, r.length))
        assert r.length <= 1024 and (r.piece == 0 or r.length == 1024)
    got = collections.Counter()
    for i, parts in whole.items():
        ids = []
        for piece, own in parts:
            if piece == 0 and ids:
                got[i, tuple(ids)] += 1
                ids = []
            ids += own
        got[i, tuple(ids)] += 1
    assert got == want
    for own in seq.values():
        assert [o for o, _ in sorted(own)] == np.cumsum([0, *[n for _, n in sorted(own)]])[:-1].tolist() and sum(n for _, n in own) <= 1024
    total = sum(len(k[1]) * n for k, n in want.items())
    assert len(seq) <= -(-total // 1024) + 1
    assert packed.sequences().count() == len(seq) == packed.bins >= packed.bound >= -(-total // 1024)
    assert packing.pack(none, P.path(BYTE)).places.count() == 0


def test_bounds_are_bounds():
    r = np.random.default_rng(1)
    for _ in range(30):
        lengths = r.integers(1, 101, r.integers(1, 9))
        _, _, bins = packing.best_fit(lengths, 100)

        def least(items, free):
            if not items:
                return 0
            best = 99
            for k, room in enumerate(free):
                if room >= items[0]:
                    best = min(best, least(items[1:], [*free[:k], room - items[0], *free[k + 1 :]]))
            return min(best, 1 + least(items[1:], [*free, 100 - items[0]]))

        exact = least(sorted(lengths.tolist(), reverse=True), [])
        assert packing.lower_bound(lengths, 100) <= exact <= bins


def test_packing_exchanges_between_parts(spark, monkeypatch):
    monkeypatch.setattr(packing, "PART", 40)
    monkeypatch.setattr(packing, "LEAST", 10)
    texts = spark.createDataFrame([(i, prose(40 + i * 7 % 300, i)) for i in range(160)], "doc_id long, text string")
    packed = packing.pack(texts, P.path(BYTE))
    last = packed.places.select("sequence_id").distinct().count()
    assert packed.report[0]["bins"] >= last and len(packed.report) >= 2 and packed.places.count() == packed.pieces.count()
    assert packed.bins == last >= packed.bound
    full = packed.places.join(packed.pieces, "key").groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    assert all(r.n == r.end <= 1024 for r in full)


def fingerprint(text, words=4):
    w = text.encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + words]), 42) for i in range(max(1, len(w) - words + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_equals_brute_force(spark, docs, none):
    got = simhash.near_duplicates(docs).collect()
    prints = {(i, t): fingerprint(t or "") for i, t in TEXTS}
    assert collections.Counter((r.doc_id, r.fp & (2**64 - 1)) for r in got) == collections.Counter((i, prints[i, t]) for i, t in TEXTS)
    groups = {}
    for p in set(prints.values()):
        hit = [g for g in groups if any((p ^ q).bit_count() <= 4 for q in groups[g])]
        groups[p] = {p}.union(*[groups.pop(g) for g in hit])
    name = {}
    for own in groups.values():
        ids = [i for (i, _), p in prints.items() if p in own and i is not None]
        name |= dict.fromkeys(own, min(ids) if ids else None)
    assert all(r.component_id == name[r.fp & (2**64 - 1)] for r in got)
    assert simhash.near_duplicates(none).count() == 0


def test_simhash_links_across_flips_and_tiles(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 16)
    r = np.random.default_rng(3)
    seeds = r.integers(0, 2**63, 6, dtype=np.uint64)
    points = set()
    for s in seeds.tolist():
        for _ in range(120):
            x = s
            for b in r.choice(64, r.integers(0, 6), replace=False).tolist():
                x ^= 1 << b
            points.add(x)
    points = sorted(points)
    frame = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) * 2 for p in points], "node long, fp long")
    roots = {row.node & (2**64 - 1): row.root for row in simhash.components(simhash.links(frame)).collect()}
    a = np.array(points, np.uint64)
    parent = list(range(len(a)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i] ^ a) <= 4):
            parent[find(i)] = find(int(j))
    want = collections.defaultdict(set)
    for i, p in enumerate(points):
        want[find(i)].add(p)
    got = collections.defaultdict(set)
    for p in points:
        got[roots.get(p, ("alone", p))].add(p)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, got.values()))


def test_dedup_keeps_one_of_each_group(docs):
    kept = simhash.keep_first(docs)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns and 4 in ids and 5 not in ids and 6 not in ids
    assert ids.count(10) == 1 and {20 + i for i in range(30)} <= set(ids) and None in ids


def test_dedup_tells_rows_apart_without_ids(spark):
    rows = [*[(None, prose(60, 500 + i), "a") for i in range(6)], (None, prose(60, 500), "b"), (3, prose(60, 501), "c"), (8, prose(60, 520), "d"), (8, prose(60, 521), "e"), (8, prose(60, 521), "e"), (None, None, "f"), (None, "", "f")]
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string, note string").repartition(3)).collect()
    texts = [r.text for r in kept if r.text]
    assert sorted(texts) == sorted({t for _, t, _ in rows if t})
    assert [r.doc_id for r in kept if r.text == prose(60, 501)] == [3]
    assert sum(not r.text for r in kept) == 1 and len(kept) == len(texts) + 1


@pytest.mark.parametrize("tile", [4096, 8])
def test_dedup_links_block_edits_and_nothing_else(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE_TEXTS", tile)
    if tile == 8:  # and every bucket that the 64th part shows twice is hot
        monkeypatch.setattr(simhash, "HOT", 0)
        monkeypatch.setattr(simhash, "SHARE", 10**9)
    r = random.Random(9)
    texts = []
    for i in range(120):  # one block of each text replaced, appended or cut, to similarities around 0.8
        words = prose(r.randint(120, 400), 1000 + i).split()
        n = round(len(words) * r.uniform(0.03, 0.2))
        other = prose(n, 2000 + i).split()
        at = r.choice([0, len(words) - n, r.randrange(len(words) - n)])
        texts += [words, r.choice([words[:at] + other + words[at + n :], words + other, words[:at] + words[at + n :]])]
    for k in range(24):  # a chain that only neighbours link, and a group
        texts.append(prose(400, 1)[:1600].split()[10 * k : 10 * k + 200])
        words = prose(150, 3000).split()
        words[r.randrange(150)] = "changed"
        texts.append(words)
    r.shuffle(texts)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in texts]
    name = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and name[i] != name[j]:
                low, high = sorted((name[i], name[j]))
                name = [low if x == high else x for x in name]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string").repartition(3)
    assert sorted(x.doc_id for x in simhash.keep_first(docs).collect()) == sorted(set(name))
    assert 60 < len(texts) - len(set(name)) < 160


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


def test_lm_base_score_is_exact_and_model_helps(spark, none):
    rows = [(i, t) for i, t in TEXTS] + [(100 + i, prose(50, i % 7)) for i in range(60)]
    docs = spark.createDataFrame([(*r, "x", 0.5) for r in rows], "doc_id long, text string, portion string, score double")
    count = collections.Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(count.values()), len(count)
    want = collections.Counter()
    for i, t in rows:
        w = tokens(t)
        want[i, held(i), len(w), sum(count[x] > 0 for x in w), round(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), 6)] += 1
    got = lm_score.train_and_score(docs.repartition(5)).collect()
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert {r.train_tokens for r in got} == {n}
    assert all(r.score <= 0 for r in got) and sum(r.score for r in got) > sum(r.base_score for r in got)
    assert lm_score.train_and_score(none).count() == 0
    untaught = lm_score.score_by(docs.select("doc_id", F.lit(False).alias("teaches"), "text")).collect()
    assert len(untaught) == len(rows) and all(r.n_known == r.train_tokens == 0 and r.base_score == 0 for r in untaught)


def test_lm_score_by_brute_force(spark):
    rows = [(i, prose(5 + i % 30, i % 50)) for i in range(90)] + [(200, None), (201, prose(300, 9)), (202, prose(300, 9))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    grams = [collections.Counter() for _ in range(3)]
    for i, t in rows:
        if not held(i):
            w = [0, 0, *tokens(t)]
            for k in range(2, len(w)):
                for o in range(3):
                    grams[o][tuple(w[k - o : k + 1])] += 1
    value = lm_score.level_counts()
    q = lambda c: 1 + math.floor(2 * math.log2(c) + 1e-9) if c else 0
    ends, total, types = q(sum(not held(i) for i, _ in rows)), sum(grams[0].values()), len(grams[0])

    def levels(t):  # of each token: its 1-, 2- and 3-gram and the contexts of the latter two
        w, out = [0, 0, *tokens(t)], []
        for k in range(2, len(w)):
            one = q(grams[0][w[k],])
            before = ends if k == 2 else out[-1][0]
            two = min(q(grams[1][w[k - 1], w[k]]), one, before)
            above = 0 if k == 2 else out[-1][1]
            out.append((one, two, min(q(grams[2][tuple(w[k - 2 : k + 1])]), two, above), before, above))
        return out

    seen, mass = collections.Counter(), collections.Counter()
    for i, t in rows:
        if not held(i):
            for _, two, three, c2, c3 in levels(t):
                for k, own, c in ((0, two, c2), (1, three, c3)):
                    seen[k, c] += 1
                    mass[k, c] += 1 - 0.75 / value[own] if own else 0
    share = lambda k, c: min(mass[k, c] / seen[k, c], 0.999) if c and seen[k, c] else 0
    want = {}
    for i, t in rows:
        want[i] = 0
        for one, two, three, c2, c3 in levels(t):
            p = (value[one] + 1) / (total + types + 1)
            for k, own, c in ((0, two, c2), (1, three, c3)):
                p = (max(value[own] - 0.75, 0) / max(value[c], 1) if own else 0) + (1 - share(k, c)) * p
            want[i] += math.log10(min(p, 1))
    got = {r.doc_id: r.score for r in lm_score.train_and_score(docs, entry_bits=4096).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 * max(1, abs(want[i])) for i in want)


def test_lm_knows_words_of_equal_sums_apart(spark):
    parity = "".join("ab"[i.bit_count() & 1] for i in range(1024))
    other = parity.translate(str.maketrans("ab", "ba"))
    rows = [(0, True, f"{parity} x"), (1, False, f"{other} x")]
    got = {r.doc_id: r for r in lm_score.score_by(spark.createDataFrame(rows, "doc_id long, teaches boolean, text string")).collect()}
    assert got[0].n_known == 3 and got[1].n_known == 2  # the word x and the end
    assert abs(got[1].base_score - sum(math.log10((c + 1) / 7) for c in (0, 1, 1))) < 1e-12


def test_lm_filter_keeps_every_count():
    r = np.random.default_rng(1)
    ids = np.unique(r.integers(0, 1 << 32, 20_000, dtype=np.uint32))
    counts = np.minimum(r.zipf(1.3, len(ids)), 1 << 40)
    got = lm_score.Segment(ids, lm_score.level(counts)).levels(ids)
    assert (got >= lm_score.level(counts)).all() and (got == lm_score.level(counts)).mean() > 0.99
    new = np.setdiff1d(r.integers(0, 1 << 32, 20_000, dtype=np.uint32), ids)
    assert (lm_score.Segment(ids, lm_score.level(counts)).levels(new) > 0).mean() < 0.01


def test_digests(spark, docs, none):
    got = digest.fingerprints(docs).collect()
    order = sorted(TEXTS, key=lambda x: -1 if x[0] is None else x[0])
    assert len(got) == len(TEXTS)
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        assert any(r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() for r in by[i])
    assert by[4][0].fingerprint == by[5][0].fingerprint and by[4][0].near_next == 1.0 and by[5][0].near_next > 0.8
    assert by[20][0].near_next < 0.2 and digest.fingerprints(none).count() == 0
    d = digest.Digest.parse(by[3][0].fingerprint)
    assert digest.likeness(d, d) == 1.0 and len(d.filters) > 5


def naive_digest(text):
    """Sets of bits of every filter of a text's digest, and its number of features, window by window."""
    data, ranks = text.encode(), digest.rarity_ranks()
    if not data:
        return 0, []
    windows = len(data) - 63
    if windows <= 0:
        found = [data]
    else:
        rank = []
        for p in range(windows):
            n = collections.Counter(data[p : p + 64])
            rank.append(int(ranks[1000 - sum(round(c * math.log2(c) * 65536) for c in n.values()) * 1000 // (64 * 6 * 65536)]))
        wins = collections.Counter(min(range(s, s + 64), key=lambda p: (rank[p], p)) for s in range(windows - 63))
        at = sorted(p for p, n in wins.items() if n >= 16 and rank[p] < 1 << 20) or [min(range(windows), key=lambda p: (rank[p], p))]
        found = [data[p : p + 64] for p in at]
    found = list(dict.fromkeys(found))
    filters = []
    for k in range(0, len(found), 160):
        bits = set()
        for piece in found[k : k + 160]:
            key = int(shared.span_keys(np.frombuffer(piece, np.uint8), np.array([0]), np.array([len(piece)]))[0])
            bits |= {key >> 11 * i & 2047 for i in range(5)}
        filters.append(bits)
    return len(found), filters


def naive_likeness(a, b):
    if not a or not b:
        return float(len(a) == len(b))
    a, b = (b, a) if len(a) > len(b) else (a, b)
    total = 0
    for x in a:
        best = 0
        for y in b:
            chance = len(x) * len(y) / 2048
            over, most = len(x & y) - chance, min(len(x), len(y))
            noise = 3 * math.sqrt(chance * (1 - len(x) / 2048) * (1 - len(y) / 2048))
            best = max(best, 1 if len(x & y) == most else min(1, over / max(most - chance, 1e-9)) if over > noise else 0)
        total += best
    return total / len(a)


def test_digests_by_brute_force():
    texts = ["", "short", "x" * 64, "ab" * 100, BASE, BASE[:700], BASE.replace(" ", "  ", 20), prose(2000, 8) + BASE, "é中" * 60, "".join(chr(33 + i * i % 90) for i in range(400)), BASE + BASE, prose(12, 1), prose(9000, 4)]
    data = [t.encode() for t in texts]
    got = digest.digests(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    want = [naive_digest(t) for t in texts]
    for d, (features, filters) in zip(got, want, strict=True):
        bits = [set(np.flatnonzero(np.unpackbits(f.view(np.uint8), bitorder="little")).tolist()) for f in d.filters]
        assert (d.features, bits) == (features, filters)
        assert str(digest.Digest.parse(str(d))) == str(d)
    for i, a in enumerate(got):
        for j, b in enumerate(got):
            assert abs(digest.likeness(a, b) - naive_likeness(want[i][1], want[j][1])) < 1e-9
    assert len(want[-1][1]) > 2  # a chain of several filters


def test_window_entropies_are_exact():
    buf = np.frombuffer(LONG[:3000].encode(), np.uint8)
    got = digest.window_entropies(buf)
    for p in (0, 1, 63, 64, 500, len(buf) - 64):
        n = np.bincount(buf[p : p + 64])
        h = -sum(c / 64 * math.log2(c / 64) for c in n if c)
        assert abs(got[p] - h * 1000 / 6) <= 1


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body><header class="site"><a href="/">Home</a> Site</header><nav><ul><li>Menu<li>More</ul></nav><div id="cookie-notice">Cookies!</div>
<div class="wrap w{0}"><div class="sidebar"><p>Side text that is long enough to look like prose</p></div><div class="post-content"><h1>Title &amp; more</h1><p>First <b>bo</b>ld para {0} with &eacute;.<p>Second<br>line.</p><ul><li>one<li>two</ul><div class="ad">Buy!</div><form>Search</form></div>
<section id="comments"><p>Nice article!</p></section></div><footer>(c)</footer><script>if (a < b) {{ x = "</p>" }}</script></body></html>"""


def test_html(spark, none):
    rows = [(i, f"https://www.Host.example.com/p/{i}", PAGE.format(i)) for i in range(5)]
    rows += [(5, None, None), (6, "x", ""), (7, "http://a.example.org/", "just text"), (8, "http://a.example.org/", "<div><p>cut off <b>here</b> and <a hre"), (0, rows[0][1], rows[0][2]), (9, "http://b.example.org/", "<div>" * 3000 + "deep")]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, host string, paths string")
    got = collections.defaultdict(list)
    for r in html_extract.extract(pages).collect():
        got[r.page_id].append(r)
        assert r.n_chars == len(r.text)
    for i in range(5):
        assert got[i][0].text == f"Title & more First bold para {i} with é. Second line. one two"
    assert len(got[0]) == 2 and got[5][0].text == got[6][0].text == "" and got[7][0].text == "just text" and got[8][0].text == "cut off here and" and got[9][0].text == "deep"
    assert html_extract.host_of("HTTP://www.A.com:80/x") == "a.com"
    assert html_extract.extract(pages.limit(0)).count() == 0


def main_text(source):
    page = html_extract.Page(source)
    best = page.best()
    return page.text(best[0][1]) if best else ""


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("<article><p>a</p><svg><svg></svg><text>leak</text></svg><p>b</p></article>", "a b"),
        ("<article><p>a</p><svg><text>drawn</text><p>b</p></article>", "a b"),
        ("<article><section id='related-work'><p>Work of others.</p></section><p class='search-tree'>A tree.</p><div class='related-posts'>x</div></article>", "Work of others. A tree."),
        ("<article><p>text</p><div id='search-results-for-you'><a>one</a> <a>two</a></div></article>", "text"),
        ("<article><p>let <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> be</p></article>", "let x=1 be"),
        ("<article><p>AT&<b>amp;</b>T &amp;lt; &eacute;</p></article>", "AT&amp;T &lt; é"),
        (f"<article><p title='{'x' * 20_050} > y'>good</p></article>", "good"),
        ("<div><p title=\"abc>text</p><p>more</p></div>", "text more"),
        ("<article><p>a<!-- x -- y > z -->b<!-->c</p></article>", "abc"),
        ("<body><table><tr><td>a<td>b<tr><td>c</table></body>", "a b c"),
        ("<p>1 < 2 and 3 <4</p>", "1 < 2 and 3 <4"),
        ("<article>x<xmp><b>y</b></xmp><textarea>z</textarea></article>", "x <b>y</b>"),
        ("<article><table><tr><td>in</div> cell</td></tr></table> after</article>", "in cell after"),
        ("<article>" + "<div>" * 500 + "<p>deep</p></article>", "deep"),
    ],
)
def test_html_cases(source, want):
    assert main_text(source) == want


@pytest.mark.parametrize("source", ["<b>" * 30_000 + "</i>" * 30_000, "<ul><li>" + "<b>" * 20_000 + "<li>a" * 20_000, "<a title=\"" * 30_000, "<a title='x " * 30_000, "<!-- " * 30_000, "<p " + 'a="b" ' * 100_000 + ">x"])
def test_html_takes_linear_time(source):
    began = time.process_time()
    html_extract.Page(source).best()
    assert time.process_time() - began < 2


def test_deep_paths_differ():
    page = html_extract.Page("<div>" * 100 + "<p class='a'>x</p><p class='b'>y</p>")
    assert len(set(page.path[-2:])) == 2 and max(map(len, page.path)) < 1000


def test_html_equals_a_parser_on_all_pages(spark):
    class Articles(HTMLParser):  # of pages whose text is their article, without notices in it
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.inside, self.ad, self.out = 0, 0, []

        def handle_starttag(self, tag, attrs):
            self.inside += tag == "article"
            self.ad += tag == "div" and (self.ad > 0 or dict(attrs).get("class") == "ad")
            self.out.append(" " * (tag not in ("a", "b")))

        def handle_endtag(self, tag):
            self.inside -= tag == "article"
            self.ad -= tag == "div" and self.ad > 0
            self.out.append(" " * (tag not in ("a", "b")))

        def handle_data(self, data):
            if self.inside and not self.ad:
                self.out.append(data)

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in html_extract.extract(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows) > 200
    for r in rows:
        naive = Articles()
        naive.feed(r.html or "")
        naive.close()
        assert got[r.page_id].text == " ".join("".join(naive.out).split()) and got[r.page_id].url == r.url


def test_consensus_overrules_one_page(spark):
    usual = "<body><main class='m1'><p>" + prose(60, 1) + "</p></main><div class='x'><p>{}</p></div></body>"
    rows = [(i, "http://h.example.com/", usual.format("short")) for i in range(8)] + [(9, "http://h.example.com/", usual.format(prose(300, 2)))]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9] == prose(60, 1)


def test_neighbours(spark, none, monkeypatch):
    monkeypatch.setattr(ann, "SHARD", 150)
    r = np.random.default_rng(2)
    x = r.normal(size=(600, 12)).astype(np.float32)
    x[400:500] = x[0]  # a hot vector
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(1000, None, 0), (1100, [0.0] * 12, 0), (1200, [float("nan")] * 12, 0), (1300, [1.0] * 5, 0), (1400, [None] + [1.0] * 11, 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, v int")
    use = ann.usable(frame)
    got = collections.defaultdict(list)
    for row in ann.search(ann.build(use), use.where("vec_id % 100 = 0")).collect():
        got[row.query_id].append((row["rank"], row.vec_id, row.score))
    assert sorted(got) == [0, 100, 200, 300, 400, 500]
    hits = 0
    for q, found in got.items():
        far = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        want = [i for i in np.lexsort((np.arange(600), far)) if i != q][:10]
        assert [k for k, *_ in sorted(found)] == list(range(1, 11))
        hits += len({v for _, v, _ in found} & set(map(int, want)))
        assert all(abs(s - far[v]) < 1e-12 for _, v, s in found)
    assert hits / 60 >= 0.95
    assert [v for _, v, _ in sorted(got[0])] == list(range(400, 410))
    few = use.where("vec_id < 4")
    assert ann.search(ann.build(few), few.where("vec_id = 0")).count() == 3
    empty = ann.usable(frame.limit(0))
    assert ann.search(ann.build(empty), empty).count() == 0


def test_neighbours_over_shards_of_full_size(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(2 * ann.SHARD + 500, 24)).astype(np.float32)  # three shards
    frame = spark.createDataFrame(pa.table({"vec_id": pa.array(np.arange(len(x))), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), 24).cast(pa.list_(pa.float32()))}))
    use = ann.usable(frame.repartition(8))
    index = ann.build(use)
    assert index.count() == 3
    hits = 0
    for row in ann.search(index, use.where("vec_id % 300 = 0")).groupBy("query_id").agg(F.collect_list("vec_id").alias("ids")).collect():
        far = ((x - x[row.query_id]) ** 2).sum(1)
        far[row.query_id] = np.inf
        hits += len(set(row.ids) & set(np.argpartition(far, 10)[:10].tolist()))
    assert hits / (10 * len(range(0, len(x), 300))) >= 0.95


def test_gradients_are_right():
    texts = [prose(40, i) for i in range(6)]
    vocab = toxicity.Vocabulary(*shared.blocks(pa.array(texts, pa.large_string()), 300))
    vocab.common = vocab.common_grams = np.ones(toxicity.BUCKETS, bool)
    net = toxicity.Network()
    r = np.random.default_rng(0)
    for k in ("word", "char"):
        net.p[k] = r.normal(size=net.p[k].shape) * 0.3
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    place, row = toxicity._places(vocab)
    y = (row % 2).astype(np.float64)

    def loss():
        z = net.logits(net.project(net.vectors(vocab.bucket, vocab.grams, vocab.n_grams)), place).astype(float)
        return float(np.mean(np.log1p(np.exp(-np.where(y == 1, z, -z)))))

    g = net.gradients(vocab, place, y)
    for k in ("wx", "u", "wa", "va", "wo", "b"):
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        old, h = net.p[k][at], 1e-2
        net.p[k][at] = old + h
        up = loss()
        net.p[k][at] = old - h
        down = loss()
        net.p[k][at] = old
        assert abs((up - down) / (2 * h) - g[k][at]) < 0.03 * abs(g[k][at]) + 2e-5, k


def naive_toxicity(net, text):
    """Score of a text, word by word and window by window."""
    mask, full = toxicity.BUCKETS - 1, (1 << 64) - 1
    finish = lambda h: int(shared.mix(np.array([h & full], np.uint64))[0])
    sig = lambda x: 1 / (1 + np.exp(-x))

    def vector(word):
        raw = np.frombuffer(word, np.uint8)
        key = int(shared.span_keys(raw, np.array([0]), np.array([len(raw)]))[0])
        marked, grams = [2, *word, 3], []
        for n in toxicity.GRAMS:
            for i in range(len(marked) - n + 1):
                h = n
                for byte in marked[i : i + n]:
                    h = (h * 257 + byte) & full
                grams.append(finish(h) & mask)
        return np.concatenate([net.p["word"][key & mask], sum(net.p["char"][g].astype(float) for g in grams) / math.sqrt(len(grams))]).astype(float)

    words = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()).split()
    h_, best, at = toxicity.HIDDEN, -math.inf, 0
    while True:
        own = words[at : at + toxicity.WINDOW]
        states = np.zeros((len(own), 2 * h_))
        for k, order in ((0, range(len(own))), (1, reversed(range(len(own))))):
            h = np.zeros(h_)
            for i in order:
                x, a = vector(own[i]) @ net.p["wx"][k] + net.p["b"][k], h @ net.p["u"][k]
                z, r = sig(x[:h_] + a[:h_]), sig(x[h_ : 2 * h_] + a[h_ : 2 * h_])
                new = np.tanh(x[2 * h_ :] + r * a[2 * h_ :])
                h = (1 - z) * new + z * h
                states[i, k * h_ : (k + 1) * h_] = h
        weight = np.exp(np.tanh(states @ net.p["wa"]) @ net.p["va"])
        pooled = weight @ states / weight.sum() if len(own) else np.zeros(2 * h_)
        best = max(best, float(pooled @ net.p["wo"] + net.p["bo"][0]))
        if at + toxicity.WINDOW >= len(words):
            return float(sig(net.scale * best + net.shift))
        at += toxicity.STRIDE


def test_toxicity_scores_by_brute_force(spark):
    net, r = toxicity.Network(), np.random.default_rng(8)
    for k in net.p:
        net.p[k] = (r.normal(size=net.p[k].shape) * 0.5).astype(np.float32)
    texts = [None, "", "one", "ÉCOLE Für İ 中文 WORD", BASE, prose(32, 1), prose(33, 2), prose(48, 3), prose(49, 4), "x" * 3000, prose(4000, 5)]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(texts)], "doc_id long, text string, score double").repartition(3)
    for row in toxicity.score(docs, net).collect():
        assert abs(row.score - naive_toxicity(net, texts[row.doc_id])) < 1e-4


def test_toxicity_generalises(spark, none):
    r = random.Random(3)
    rows = []
    for i in range(400):
        words = prose(r.randint(30, 200), i).split()
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                words.insert(r.randrange(len(words)), "zugg" + r.choice(["an", "e", "est", "ly", "or"]))
        rows.append((i, " ".join(words), int(bad)))
    docs = spark.createDataFrame([(i, t, "z") for i, t, _ in rows] + [(1000, None, "z"), (1001, "", "z"), (None, "zuggest " * 5, "z")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(1000, None)], "doc_id long, toxic int")
    got = {x.doc_id: x for x in toxicity.classify(docs, labels).collect()}
    held = [(got[i].predicted, y) for i, _, y in rows if got[i].held_out]
    assert len(held) > 80 and sum(p == y for p, y in held) / len(held) > 0.95
    assert all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.7) for x in got.values()) and got[1000].score == got[1001].score < 0.5 < got[None].score
    kept = toxicity.keep_civil(docs, toxicity.learn(docs, labels))
    assert kept.columns == docs.columns and 250 < kept.count() < 330
    assert toxicity.classify(none, labels).count() == 0


def test_toxicity_learns_from_whole_texts(spark):
    r = random.Random(4)
    rows = []
    for i in range(240):  # over 6,000 characters each; what is toxic stands at the end
        words = prose(1300, 4000 + i).split()
        if i % 4 == 0:
            words[-20:-17] = ["zugg" + r.choice(["an", "e", "est", "ly", "or"]) for _ in range(3)]
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    assert min(len(t) for _, t, _ in rows) > 6000
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    got = toxicity.classify(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")).collect()
    held = [(x.predicted, rows[x.doc_id][2]) for x in got if x.held_out]
    assert len(held) > 50 and sum(p == y for p, y in held) / len(held) > 0.95


def test_toxicity_sample_is_of_documents_there(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "train", list)
    docs = spark.createDataFrame([*[(i, f"text {i}") for i in range(20)], (None, "none")], "doc_id long, text string")
    labels = [(i, i % 2) for i in range(20)] + [(3, 1)] * 50 + [(4, 0)] * 50 + [(i, i % 2) for i in range(100, 400)]
    taught = toxicity.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), sample=8)
    assert len(set(taught)) == len(taught) == 16 and sum(y for _, y in taught) == 8
    assert all(int(t.split()[1]) % 2 == y for t, y in taught)


def test_quality(spark, none, docs):
    rows = []
    for i in range(600):
        t = prose(80, i)
        bad = i % 5 == 0
        rows.append((i, t.upper().replace(" ", "!! ") if bad else t, "en" if i % 3 else None, "hot" if i % 2 else f"s{i % 40}", int(not bad), "x"))
    docs_ = spark.createDataFrame([r[:4] + r[5:] for r in rows], "doc_id long, text string, lang string, source string, good string")
    labels = spark.createDataFrame([(r[0], r[4]) for r in rows], "doc_id long, quality int")
    labels = labels.unionByName(labels.limit(40)).unionByName(spark.createDataFrame([(5000, 1), (None, 0)], labels.schema))
    marked = quality.taught(labels, sample=300)
    known = {r.doc_id: r.quality for r in marked.collect()}
    assert len(known) == 300 and all(zlib.crc32(str(i).encode()) % 3 != 1 for i in known)
    model = quality.learn(docs_, marked)
    found = quality.assess(docs_, model, marked).collect()
    got = {r.doc_id: r for r in found}
    assert len(found) == len(got) == 600 and sum(got[r[0]]["__keep"] == bool(r[4]) for r in rows) >= 594
    # All rates by brute force: paths shrink to their host, hosts to all, each document without itself.
    worth = {i: known.get(i, r["__evidence"]) for i, r in got.items()}
    site = {r[0]: (r[3], r[2]) for r in rows}
    n, good = collections.Counter(), collections.Counter()
    for i, (host, path) in site.items():
        for key in ((host, path), host, "all"):
            n[key] += 1
            good[key] += worth[i]
    mean = (good["all"] + 0.5) / (n["all"] + 1)

    def strength(groups):  # (rate, mean, rows)
        total = sum(k for *_, k in groups)
        spread, chance = sum(k * (r - m) ** 2 for r, m, k in groups), sum(m * (1 - m) for _, m, _ in groups)
        return min(max(sum(k * m * (1 - m) for _, m, k in groups) / total / max((spread - chance) / total, 1e-9) - 1, 1), 1e6)

    hosts = {h for h, _ in site.values()}
    k0 = strength([(good[h] / n[h], mean, n[h]) for h in hosts])
    rate = {h: (good[h] + k0 * mean) / (n[h] + k0) for h in hosts}
    k1 = strength([(good[s] / n[s], rate[s[0]], n[s]) for s in set(site.values())])
    logit = lambda p: math.log(p / (1 - p))
    for i, r in got.items():
        s = site[i]
        path_rate = (good[s] - worth[i] + k1 * rate[s[0]]) / (n[s] - 1 + k1)
        assert abs(r["__host_rate"] - rate[s[0]]) < 1e-9 and abs(r["__path_rate"] - path_rate) < 1e-6
        z = logit(min(max(r["__evidence"], 1e-9), 1 - 1e-9)) + logit(min(max(path_rate, 1e-6), 1 - 1e-6)) - logit(mean)
        assert abs(r["__quality"] - 1 / (1 + math.exp(-z))) < 1e-6
    assert quality.assess(docs_, model, marked, only_kept=True).columns == docs_.columns
    assert quality.assess(docs, model).count() == len(TEXTS) and quality.assess(none, model, marked).count() == 0


def test_mixing_by_brute_force(spark, docs, none):
    recipe = mixing.RECIPE
    rows = mixing.selected(docs, recipe).collect()
    count = lambda t: len((t or "").encode().split())
    leaf = collections.Counter()
    of = {}
    for r in docs.collect():
        source, lang = r.source or "", r.lang or ""
        domain = "crawl" if source == "src0" else "forum" if len(source) == 4 else "reference"
        of.setdefault((r.doc_id, r.text), (domain, lang, source))
        leaf[domain, lang, source] += count(r.text)
    used = collections.Counter()
    for r in rows:
        used[r.domain, r.lang, r.source] += r.n_tokens
    assert sum(used.values()) <= sum(leaf.values()) * 6 // 10
    assert all(n <= 3 * leaf[k] for k, n in used.items()) and {r.epoch for r in rows} <= {0, 1, 2}
    # Every leaf's prefix by brute force: whole epochs, then documents in seeded order as long as they fit.
    plan = {(r.domain, r.lang, r.source): r.budget for r in mixing.budgets(spark.createDataFrame([(*k, n) for k, n in leaf.items() if n], "domain string, lang string, source string, tokens long"), recipe).collect()}
    want = collections.Counter()
    for key, budget in plan.items():
        epochs, rest = divmod(budget, leaf[key])
        own = sorted((hashlib.md5(f"{recipe.seed}:{epochs}:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest(), count(r.text), -1 if r.doc_id is None else r.doc_id) for r in docs.collect() if of[r.doc_id, r.text] == key)
        for h, n, i in own:
            inside = sum(m for g, m, _ in own if (g, m) <= (h, n)) <= rest
            want.update({(i, n, e): 1 for e in range(epochs + inside)} if epochs + inside else {})
    assert collections.Counter((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.epoch) for r in rows) == want
    copies = mixing.mixed(docs, recipe)
    assert copies.count() == len(rows) and copies.columns == docs.columns and mixing.selected(none).count() == 0


def test_shortage_goes_to_siblings_first(spark):
    recipe = mixing.Recipe(domain_sql="substr(source, 1, 1)", domains={"a": 1, "b": 1}, tenths=10, epochs=1)
    sums = spark.createDataFrame([("a", "x", "a1", 10), ("a", "y", "a2", 1000), ("b", "x", "b1", 500)], "domain string, lang string, source string, tokens long")
    got = {(r.domain, r.lang): r.budget for r in mixing.budgets(sums, recipe).collect()}
    assert got == {("a", "x"): 10, ("a", "y"): 1000, ("b", "x"): 500}
    half = {(r.domain, r.lang): r.budget for r in mixing.budgets(sums, mixing.Recipe(domain_sql="", tenths=4, epochs=1)).collect()}
    assert half == {("a", "x"): 10, ("a", "y"): 292, ("b", "x"): 302}


@pytest.mark.parametrize("ranked", [256, 1])
def test_mixing_sql_agrees(spark, tmp_path, monkeypatch, ranked):
    import duckdb

    monkeypatch.setattr(mixing, "RANKED", ranked)  # with 1 buckets are cut down to single hashes

    rows = [(i, prose(5 + i % 40, i), ["en", "de", "fr", "es"][i % 4], f"src{i * i % 13}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs.coalesce(1).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    cursor = con.execute(mixing.oracle())
    names = [d[0] for d in cursor.description]
    got = sorted(tuple(r[c] for c in names) for r in mixing.selected(docs).collect())
    assert got == sorted(cursor.fetchall()) and len(got) > 100


def test_skewed_join_is_a_join(spark):
    left = spark.createDataFrame([("hot", i) for i in range(3000)] + [(f"k{i}", i) for i in range(50)] + [(None, 1)], "k string, i int")
    right = spark.createDataFrame([("hot", 1), ("k1", 2)], "k string, v int")
    got = shared.join_skewed(left, right, ["k"])
    assert got.count() == 3051 and got.where("v = 1").count() == 3000 and got.where("v = 2").count() == 1


def test_near_copies_take_simhash_components_as_candidates(spark):
    """Without a single minhash band the pipeline's stage still finds what SimHash links, and only links that the sets bear out."""
    words = [f"w{k * 7919 % 1009}" for k in range(600)]
    texts = [" ".join(words), " ".join([*words[:-1], "otra"]), " ".join(words[::-1]), "", " ", "uno dos", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    linked = {r.fp for r in simhash.near_duplicates(rows.where("doc_id < 2")).select("component_id", F.col("component_id").alias("fp")).collect()}
    assert linked == {0}
    assert sorted(r.doc_id for r in simhash.keep_first(rows, simhash.Overlap(bands=0)).collect()) == [0, 2, 3, 5]
