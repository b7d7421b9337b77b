"""SimHash near-duplicates with pigeonring filtering.

A fingerprint of ``bits`` bits is cut into ``distance + 1`` segments on a ring.  If two fingerprints differ in at
most ``distance`` bits, then from some segment on every chain of ``l`` consecutive segments differs in at most
``l * distance / (distance + 1)`` bits, that is in ``l - 1`` or fewer.  So the first segment of the chain is equal
and the second has one flipped bit or none: both form the key of a bucket.  Every distinct fingerprint stands in a bucket
for each start (its own two segments) and asks in the buckets that one flip more reaches; longer chains prune the
candidates before the full Hamming check.  Nothing is capped.

Equal fingerprints are one class from the start.  Pairs are compared in numpy inside a bucket and leave it only
as a spanning forest, so rows out grow with rows in.  Buckets with many members are dealt out as a grid of tiles.
Components are found by contraction: every node takes its least neighbour's label until no edge is left.

Near copies of the pipeline (``keep_first``) are held by shared shingles, exactly: SimHash's components (``near_duplicates``) are
candidates, so are texts that share a minhash band, since pairs at 0.8 may differ in more bits than 64 can tell; the sets decide.

Defined results: null and empty texts have fingerprint zero and link like any other; fewer words than a
shingle form one shingle; repeated rows fall in one class and are all returned; null ids are returned with their
class, whose smallest id ignores them; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.shared import LOWER, TextBlock, attach, blocks, column, join_skewed, mix, owned, prepare, span_keys, stored, wanted, wide_batches, word_spans

#: Members of a bucket on either side beyond which it is dealt out in tiles.
TILE = 4096
#: Pairs that one numpy pass compares.
PAIRS = 1 << 20


@dataclass(frozen=True)
class Closeness:
    """How texts are held to be near: fingerprints over ``words``-word shingles within ``distance`` bits.

    With ``sketch_words`` the buckets are built over these fingerprints, and a pair links only if besides its
    128-bit SimHash over ``sketch_words``-word shingles differs in at most ``sketch_distance`` bits.
    """

    words: int = 4
    distance: int = 4
    sketch_words: int = 0
    sketch_distance: int = 0


#: Four words, four bits.
FOUR_BITS = Closeness()


@dataclass(frozen=True)
class Overlap:
    """How texts are held to be near copies: sets of ``words``-word shingles of a Jaccard similarity of ``least`` or more.

    Pairs are looked for in the components that SimHash links (``FOUR_BITS``) and in ``bands`` tables of ``rows`` minhashes each, and
    every link is checked on the sets themselves.
    """

    words: int = 5
    least: float = 0.8
    bands: int = 32
    rows: int = 5


#: Five words, 0.8: wherever a pair differs, the chance that no band finds it is (1 - 0.8 ** 5) ** 32 = 3e-6 at 0.8, less above.
FIVE_WORDS = Overlap()
#: A bucket with over a SHARE-th of the rows is dealt out by SALTS; HOT: nodes of a 64th part that it must have at least.
SHARE, SALTS, HOT = 2000, 64, 32
#: Shingles and texts of a group of candidates beyond which it is dealt out in tiles.
TILE_SHINGLES, TILE_TEXTS = 1 << 21, 4096
#: Smaller groups are dealt out as well, in parts of this many texts, into this many parts at most.
TILE_LEAST, TILES = 256, 16


# ---------------------------------------------------------------- fingerprints

_LANES = np.array([sum(((b >> k) & 1) << (8 * k) for k in range(8)) for b in range(256)], np.uint64)


def _majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each row the bits that are set in over half of its hashes; counts: hashes of each row, in order."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    n = counts[full]
    # Byte lanes count to 255, so each row is summed in runs of 255 hashes at most.
    runs = -(-n // 255)
    first = np.cumsum(n) - n
    own = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
    lanes = _LANES[hashes.view(np.uint8).reshape(-1, 8)]
    sums = np.add.reduceat(lanes, np.repeat(first, runs) + own * 255, axis=0).view(np.uint8).reshape(-1, 64)
    bits = np.add.reduceat(sums, np.cumsum(runs) - runs, axis=0, dtype=np.int64) * 2 > n[:, None]
    out[full] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).reshape(-1)
    return out


def shingle_hashes(block: TextBlock, words: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 (seed 42) of all shingles of a block, repeats included, and their number in each row."""
    data, offs = LOWER[block.buf].tobytes(), block.offs.tolist()
    digest = xxhash.xxh64_intdigest
    hashes, counts = [], []
    for a, b in zip(offs[:-1], offs[1:], strict=True):
        parts = data[a:b].split()
        if not parts:
            counts.append(0)
            continue
        text = b" ".join(parts)
        if len(parts) <= words:
            hashes.append(digest(text, 42))
            counts.append(1)
            continue
        ends, at = [], -1
        for w in parts:
            at += len(w) + 1
            ends.append(at)
        starts = [0, *[e + 1 for e in ends]]
        own = [digest(text[s:e], 42) for s, e in zip(starts, ends[words - 1 :], strict=False)]
        hashes += own
        counts.append(len(own))
    return np.array(hashes, np.uint64), np.array(counts, np.int64)


def _distinct_word_hashes(block: TextBlock) -> tuple[np.ndarray, np.ndarray]:
    block = TextBlock(LOWER[block.buf], block.offs, block.first)
    starts, ends, rows = word_spans(block)
    keys = span_keys(block.buf, starts, ends)
    order = np.lexsort((keys, rows))
    keys, rows = keys[order], rows[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])
    return keys[new], np.bincount(rows[new], minlength=len(block))


def fingerprints(docs: DataFrame, how: Closeness = FOUR_BITS, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint (as a signed long) of every row; with a sketch also s0 and s1."""
    prepare(docs.sparkSession)
    two = how.sketch_words > 0

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                cols = {"doc_id": batch.column(0).slice(block.first, len(block))}
                hashes = _distinct_word_hashes(block) if two and how.words == 1 else shingle_hashes(block, how.words)
                cols["fp"] = pa.array(_majority(*hashes).view(np.int64))
                if two:
                    own, counts = shingle_hashes(block, how.sketch_words)
                    cols |= {"s0": pa.array(_majority(own, counts).view(np.int64)), "s1": pa.array(_majority(mix(own), counts).view(np.int64))}
                yield pa.RecordBatch.from_pydict(cols)

    source = wanted(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(make, "doc_id long, fp long" + ", s0 long, s1 long" * two)


# ---------------------------------------------------------------- candidates and links


def ring(distance: int) -> list[tuple[int, int]]:
    """First bit and width of each of the ``distance + 1`` segments."""
    m = distance + 1
    widths = [64 // m + (k < 64 % m) for k in range(m)]
    return [(sum(widths[:k]), widths[k]) for k in range(m)]


def _keys(distance: int) -> tuple[list, list]:
    """For each start: shifts and masks of the chain's first two segments, and the flips that a question makes."""
    segs = ring(distance)
    chains, flips = [], []
    for i, (at, width) in enumerate(segs):
        then, wide = segs[(i + 1) % len(segs)]
        chains.append((i, at, (1 << width) - 1, then, (1 << wide) - 1, wide))
        flips.append([0, *[1 << b for b in range(wide)]])
    return chains, flips


def _find(parent: np.ndarray) -> np.ndarray:
    while not np.array_equal(up := parent[parent], parent):
        parent = up
    return parent


def _merge(parent: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Roots of a forest after adding links u-v; parent holds roots."""
    while True:
        a, b = parent[u], parent[v]
        apart = a != b
        if not apart.any():
            return parent
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        parent[np.maximum(a, b)] = np.minimum(a, b)
        parent = _find(parent)


def _linker(how: Closeness):
    segs = ring(how.distance)
    masks = []
    for i in range(len(segs)):
        got, own = 0, []
        for k in range(len(segs)):
            at, width = segs[(i + k) % len(segs)]
            got |= ((1 << width) - 1) << at
            own.append(got)
        masks.append(own)
    masks = np.array(masks, np.uint64)

    def links(key: np.ndarray, tile: np.ndarray, asks: np.ndarray, fp: np.ndarray, sketch: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers of linked pairs in spanning-forest form.  Rows are sorted by key, tile, asks."""
        run = np.concatenate([[True], (key[1:] != key[:-1]) | (tile[1:] != tile[:-1])]).cumsum() - 1
        held = np.bincount(run[~asks], minlength=run[-1] + 1)
        start = np.searchsorted(run, np.arange(run[-1] + 1))
        ask = np.flatnonzero(asks & (held[run] > 0))
        parent = np.unique(fp, return_inverse=True)[1] if not sketch else np.arange(len(fp))
        if not sketch:  # rows of the same fingerprint are one node
            lead = np.full(parent.max() + 1, len(fp))
            np.minimum.at(lead, parent, np.arange(len(fp)))
            parent = lead[parent]
        node = parent.copy()
        n = held[run[ask]]
        done = np.cumsum(n)
        at = 0
        while at < len(ask):
            to = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + PAIRS, "right")))
            own = n[at:to]
            right = np.repeat(ask[at:to], own)
            left = np.arange(len(right)) - np.repeat(np.cumsum(own) - own, own) + np.repeat(start[run[ask[at:to]]], own)
            x = fp[left] ^ fp[right]
            chain = masks[(key[right] >> 56).astype(np.int64)]
            if not sketch:
                keep = np.flatnonzero(x != 0)
                left, right, x, chain = left[keep], right[keep], x[keep], chain[keep]
            for l in range(2, len(segs)):  # noqa: E741  chains of l + 1 segments may differ in l bits
                keep = np.flatnonzero(np.bitwise_count(x & chain[:, l]) <= l)
                left, right, x, chain = left[keep], right[keep], x[keep], chain[keep]
            keep = np.flatnonzero(np.bitwise_count(x) <= how.distance)
            left, right = left[keep], right[keep]
            if sketch:
                far = sum(np.bitwise_count(s[left] ^ s[right]).astype(np.int64) for s in sketch)
                left, right = left[far <= how.sketch_distance], right[far <= how.sketch_distance]
            parent = _merge(parent, node[left], node[right])
            at = to
        moved = np.flatnonzero((parent[node] != node) & (node == np.arange(len(node))))
        return moved, parent[moved]

    return links


def links(classes: DataFrame, how: Closeness = FOUR_BITS) -> DataFrame:
    """Edges (a, b) between the classes' nodes that connect whatever links connect; classes: node, fp, sketch."""
    spark = classes.sparkSession
    sketch = ["s0", "s1"] if how.sketch_words else []
    chains, flips = _keys(how.distance)

    def key(chain: tuple, flip) -> F.Column:
        i, at, mask, then, wide_mask, wide = chain
        first = F.shiftrightunsigned("fp", at).bitwiseAND(F.lit(mask))
        second = F.shiftrightunsigned("fp", then).bitwiseAND(F.lit(wide_mask)).bitwiseXOR(flip)
        return F.lit(i << 56).cast("long").bitwiseOR(F.shiftleft(first, wide)).bitwiseOR(second)

    held = classes.select("node", "fp", *sketch, F.explode(F.array(*[key(c, F.lit(0).cast("long")) for c in chains])).alias("key"), F.lit(False).alias("asks"))
    asked = classes.select("node", "fp", *sketch, F.explode(F.array(*[key(c, F.lit(f).cast("long")) for c, own in zip(chains, flips, strict=True) for f in own])).alias("key"), F.lit(True).alias("asks"))

    # Buckets that need tiles: what stands in them, and what asks there, follow from the counts of the first alone.
    counts = stored(held.groupBy("key").count().where(F.col("count") > TILE // (1 + max(map(len, flips)))), "simhash-counts")
    around = F.expr("filter(transform(array({}), x -> CASE WHEN x.i = shiftrightunsigned(key, 56) THEN key ^ x.f END), x -> x IS NOT NULL)".format(", ".join(f"struct({i} AS i, {f}L AS f)" for i, own in enumerate(flips) for f in own)))
    asks = counts.select(F.explode(around).alias("key"), "count").groupBy("key").agg(F.sum("count").alias("n_ask"))
    grid = stored(
        counts.select("key", F.col("count").alias("n_held"))
        .join(asks, "key", "full")
        .select("key", F.ceil(F.coalesce("n_held", F.lit(1)) / TILE).cast("int").alias("r"), F.ceil(F.coalesce("n_ask", F.lit(1)) / TILE).cast("int").alias("s"))
        .where("r > 1 OR s > 1"),
        "simhash-grid",
    )
    both = held.unionByName(asked)
    hot = grid.count()
    if hot:
        both = both.join(F.broadcast(grid) if hot < 100_000 else grid, "key", "left").withColumns({"r": F.coalesce("r", F.lit(1)), "s": F.coalesce("s", F.lit(1))})
        mine = F.pmod(F.xxhash64("node"), F.when(F.col("asks"), F.col("s")).otherwise(F.col("r"))).cast("int")
        tiles = F.when(F.col("asks"), F.transform(F.sequence(F.lit(0), F.col("r") - 1), lambda k: k * F.col("s") + mine)).otherwise(F.transform(F.sequence(F.lit(0), F.col("s") - 1), lambda k: mine * F.col("s") + k))
        both = both.withColumn("tile", F.explode(tiles))
    else:
        both = both.withColumn("tile", F.lit(0))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, kept, size = _linker(how), [], 0

        def edges(rows: pa.Table) -> pa.RecordBatch:
            col = lambda c: rows.column(c).to_numpy()
            node = col("node")
            a, b = find(col("key"), col("tile"), col("asks").astype(bool), col("fp").view(np.uint64), [col(s).view(np.uint64) for s in sketch])
            return pa.RecordBatch.from_pydict({"a": pa.array(node[a]), "b": pa.array(node[b])})

        for batch in batches:
            kept.append(batch)
            size += len(batch)
            if size < 200_000:
                continue
            rows = pa.Table.from_batches(kept).combine_chunks()
            keys, tiles = rows.column("key").to_numpy(), rows.column("tile").to_numpy()
            new = np.flatnonzero((keys[1:] != keys[:-1]) | (tiles[1:] != tiles[:-1]))
            if not len(new):
                continue
            cut = int(new[-1]) + 1  # the last bucket may go on in the next batch
            yield edges(rows.slice(0, cut))
            kept, size = rows.slice(cut).to_batches(), len(rows) - cut
        if kept and size:
            yield edges(pa.Table.from_batches(kept).combine_chunks())

    columns = both.select("key", "tile", "asks", "node", "fp", *sketch)
    with wide_batches(spark):
        return stored(columns.repartition("key", "tile").sortWithinPartitions("key", "tile", "asks").mapInArrow(scan, "a long, b long"), "simhash-links")


# ---------------------------------------------------------------- components


def components(edges: DataFrame) -> DataFrame:
    """node and root: one root for all nodes that the edges (a, b) connect.  Written tables cut the lineage.

    Each round every node moves to its least neighbour under a hashed order, which leaves a fraction of the
    nodes; the moves are composed backwards at the end.
    """
    order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))
    moves = []
    while True:
        pairs = stored(edges.where("a <> b").distinct(), "component-pairs")
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(order("b")).alias("m")).select("a", F.least(order("a"), "m")["n"].alias("to"))
        least = stored(least, "component-moves")
        if not least.head(1):
            break
        moves.append(least)
        to = lambda c: least.select(F.col("a").alias(c), F.col("to").alias(f"{c}_to"))
        # A node may hold most edges: moves are attached to both ends without sending it to one task.
        edges = stored(attach(attach(pairs, to("a"), ["a"]), to("b"), ["b"]).where("a_to <> b_to").select(F.col("a_to").alias("a"), F.col("b_to").alias("b")).distinct(), "component-edges")
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).where("false")
    roots = moves.pop().select(F.col("a").alias("node"), F.col("to").alias("root"))
    while moves:
        last = moves.pop()
        above = stored(roots.select(F.col("node").alias("to"), "root"), "component-above")
        roots = stored(attach(last, above, ["to"]).select(F.col("a").alias("node"), F.coalesce("root", "to").alias("root")), "component-roots")
    return roots


def near_duplicates(docs: DataFrame, how: Closeness = FOUR_BITS, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (signed long) and component_id, the smallest doc_id that links reach, for every row."""
    sketch = ["s0", "s1"] if how.sketch_words else []
    prints = fingerprints(docs, how, id_col=id_col, text_col=text_col)
    node = F.xxhash64("fp", *sketch) if sketch else F.col("fp")
    prints = stored(prints.withColumn("node", node), "simhash-prints")
    classes = stored(prints.groupBy("node", "fp", *sketch).agg(F.min("doc_id").alias("first")), "simhash-classes")
    roots = components(links(classes.drop("first"), how))
    whole = stored(classes.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root")), "simhash-roots")
    least = stored(whole.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n")), "simhash-least")
    # Most nodes are components of their own; only the others are joined to their component's smallest id.
    several = attach(whole.where("node <> root").select("node", "root"), least.where("n > 1").select("root", "component_id"), ["root"]).select("node", "component_id")
    named = stored(several.unionByName(least.select(F.col("root").alias("node"), "component_id")), "simhash-components")
    return join_skewed(prints.select("doc_id", "fp", "node"), named, ["node"]).select("doc_id", "fp", "component_id")


# ---------------------------------------------------------------- near copies by shingles


def shingle_sets(block: TextBlock, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all rows of a block, sorted in each row, and their number in each row."""
    hashes, counts = shingle_hashes(block, words)
    rows = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    return hashes[new], np.bincount(rows[new], minlength=len(counts))


def _bands(hashes: np.ndarray, counts: np.ndarray, how: Overlap) -> tuple[np.ndarray, np.ndarray]:
    """A key of each row's whole set (0: empty), and for each row with shingles the keys of its bands."""
    full = np.flatnonzero(counts)
    node, keys = np.zeros(len(counts), np.uint64), np.zeros((len(full), how.bands), np.uint64)
    if not len(full):
        return node, keys
    first = (np.cumsum(counts) - counts)[full]
    node[full] = mix(np.add.reduceat(mix(hashes), first) + counts[full].astype(np.uint64))
    seeds = mix(np.arange(1, 2 * how.bands * how.rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(how.bands, how.rows, 2)
    for band in range(how.bands):
        key = np.full(len(full), band + 1, np.uint64)
        for flip, times in seeds[band]:
            key = mix(key + np.minimum.reduceat((hashes ^ flip) * (times | np.uint64(1)), first))
        keys[:, band] = key
    return node, keys


def linked(hashes: np.ndarray, counts: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets of the given similarity or more that connect whatever all such pairs connect, by breadth-first search."""
    m, ends = len(counts), np.cumsum(counts)
    starts = ends - counts
    if m == 2:
        both = len(np.intersect1d(hashes[: ends[0]], hashes[ends[0] :], assume_unique=True))
        near = np.arange(int(both >= least * (counts.sum() - both) - 1e-9))
        return near, near + 1
    terms, ids = np.unique(hashes, return_inverse=True)
    owner, left, indexed = np.repeat(np.arange(m), counts), np.ones(m, bool), 2 * m + 2
    own = at = np.zeros(0, np.int64)
    u, v = [], []
    for s in range(m):
        if not left[s]:
            continue
        left[s] = False
        queue = [s]
        while queue and (rest := int(left.sum())):
            if rest * 2 < indexed:  # of the sets, only those not reached yet
                keep = np.flatnonzero(left[owner])
                keep = keep[np.argsort(ids[keep], kind="stable")]
                own, at, indexed = owner[keep], np.searchsorted(ids[keep], np.arange(len(terms) + 1)), rest
            x = queue.pop()
            mine = ids[starts[x] : ends[x]]
            size = at[mine + 1] - at[mine]
            both = np.bincount(own[np.repeat(at[mine] - (np.cumsum(size) - size), size) + np.arange(size.sum())], minlength=m)
            near = np.flatnonzero(left & (both >= least * (counts[x] + counts - both) - 1e-9))
            left[near] = False
            u += [x] * len(near)
            v += near.tolist()
            queue += near.tolist()
    return np.array(u, np.int64), np.array(v, np.int64)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (bucket, node) sorted by bucket: pairs of each bucket's first node with every other one."""
    bucket, lead = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        if not len(batch):
            continue
        keys, nodes = np.concatenate([bucket, batch.column(0).to_numpy()]), np.concatenate([lead, batch.column(1).to_numpy()])
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        leads = nodes[np.flatnonzero(new)][new.cumsum() - 1]
        other = leads != nodes
        bucket, lead = keys[-1:], leads[-1:]
        yield pa.RecordBatch.from_pydict({"a": pa.array(leads[other]), "b": pa.array(nodes[other])})


def near_copies(texts: DataFrame, how: Overlap = FIVE_WORDS) -> tuple[DataFrame, DataFrame]:
    """Of texts (key: unique, id, text): the written table of their nodes (key, id, node), and node and root of those with near copies.

    Equal sets are one node.  Nodes that share a SimHash component or a band, directly or through others, form a group; inside a group all pairs are
    compared by their sets, except those that links connect already.  Large groups are dealt out as a grid of tiles.
    """
    spark = texts.sparkSession
    prepare(spark)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(2)):
                hashes, counts = shingle_sets(block, how.words)
                node, keys = _bands(hashes, counts, how)
                offs = np.concatenate([[0], np.cumsum((counts > 0) * how.bands)]).astype(np.int32)
                own = [batch.column(k).slice(block.first, len(block)) for k in (0, 1)]
                yield pa.RecordBatch.from_pydict({"key": own[0], "id": own[1], "node": pa.array(node.view(np.int64)), "size": pa.array(counts), "bands": pa.ListArray.from_arrays(pa.array(offs), pa.array(keys.reshape(-1).view(np.int64)))})

    near = near_duplicates(texts.select(F.col("key").alias("doc_id"), "text"), FOUR_BITS).select(F.col("doc_id").alias("key"), "component_id")
    prints = texts.select("key", "id", "text").mapInArrow(make, "key long, id long, node long, size long, bands array<long>").join(near, "key")
    # A component is one bucket more; texts without words are one node anyway.
    bucket = F.when(F.col("size") > 0, F.array_append("bands", F.xxhash64("component_id", F.lit("simhash")))).otherwise(F.col("bands"))
    prints = stored(prints.withColumn("bands", bucket).drop("component_id"), "copies-prints")
    classes = prints.groupBy("node").agg(F.min("key").alias("key"), F.max("size").alias("size"))
    # Buckets that seem to hold over a SHARE-th of all rows, judged by a 64th of the nodes, are dealt out by salt; their salts' first nodes meet after.
    some = prints.where(F.pmod(F.xxhash64("node"), F.lit(64)) == 0).select("node", "bands").dropDuplicates(["node"])
    seen = stored(some.select(F.explode("bands").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n")), "copies-some")
    least = max(HOT, (seen.agg(F.sum("n").alias("n")).first().n or 0) // SHARE)
    hot = F.broadcast(seen.where(F.col("n") > least).select("bucket", F.lit(True).alias("hot")))  # fewer than SHARE rows
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("node", F.lit(1)), F.lit(SALTS))).otherwise(0).cast("int").alias("salt")
    spread = lambda rows, how: rows.select("node", F.explode("bands").alias("bucket")).join(hot, "bucket", how).select("bucket", salt, "node")
    # Equal sets go before their bands are spread out.
    wide = spread(prints.select("node", "bands").dropDuplicates(["node"]), "left").select(F.xxhash64("bucket", "salt").alias("bucket"), "node")
    stars = wide.repartition("bucket").sortWithinPartitions("bucket", "node").mapInArrow(_stars, "a long, b long")
    leads = spread(prints, "inner").groupBy("bucket", "salt").agg(F.min("node").alias("node")).select("bucket", "node")  # SHARE x SALTS rows at most
    with wide_batches(spark):
        stars = stored(stars.unionByName(leads.repartition("bucket").sortWithinPartitions("bucket", "node").mapInArrow(_stars, "a long, b long")), "copies-candidates")
    groups = stored(components(stars).join(classes, "node"), "copies-groups")
    parts = F.greatest(F.least(F.ceil(F.count("*") / TILE_LEAST), F.lit(TILES)), F.ceil(F.count("*") / TILE_TEXTS), F.ceil(F.sum("size") / TILE_SHINGLES)).cast("int")
    large = stored(groups.groupBy("root").agg(parts.alias("r")).where("r > 1"), "copies-large")
    mine = F.pmod(F.xxhash64("node"), "r").cast("int")
    dealt = attach(groups, large, ["root"]).withColumn("r", F.coalesce("r", F.lit(1))).withColumn("mine", mine)
    tile = F.transform(F.sequence(F.lit(0), F.col("r") - 1), lambda k: F.least("mine", k) * F.col("r") + F.greatest("mine", k))
    members = texts.select("key", "text").join(dealt.select("key", "node", "root", F.explode(tile).alias("tile")), "key").select("root", "tile", "node", "text")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0

        def edges(rows: pa.Table) -> pa.RecordBatch:
            sets = [shingle_sets(block, how.words) for block in blocks(rows.column("text"))]
            hashes, counts = (np.concatenate(x) for x in zip(*sets, strict=True))
            root, tiles, node = (rows.column(c).to_numpy() for c in ("root", "tile", "node"))
            cuts = [0, *(np.flatnonzero((root[1:] != root[:-1]) | (tiles[1:] != tiles[:-1])) + 1).tolist(), len(root)]
            ends = np.concatenate([[0], np.cumsum(counts)])
            a, b = [], []
            for at, to in zip(cuts[:-1], cuts[1:], strict=True):
                if to - at > 1:
                    u, v = linked(hashes[ends[at] : ends[to]], counts[at:to], how.least)
                    a.append(node[at + u])
                    b.append(node[at + v])
            none = [np.zeros(0, np.int64)]
            return pa.RecordBatch.from_pydict({"a": pa.array(np.concatenate(a or none)), "b": pa.array(np.concatenate(b or none))})

        for batch in batches:
            kept.append(batch)
            size += batch.nbytes
            if size < 1 << 23:
                continue
            rows = pa.Table.from_batches(kept).combine_chunks()
            root, tiles = rows.column("root").to_numpy(), rows.column("tile").to_numpy()
            new = np.flatnonzero((root[1:] != root[:-1]) | (tiles[1:] != tiles[:-1]))
            if not len(new):
                continue
            cut = int(new[-1]) + 1  # the last group may go on in the next batch
            yield edges(rows.slice(0, cut))
            kept = rows.slice(cut).to_batches()
            size = sum(b.nbytes for b in kept)
        if sum(map(len, kept)):
            yield edges(pa.Table.from_batches(kept).combine_chunks())

    found = stored(members.repartition("root", "tile").sortWithinPartitions("root", "tile", "node").mapInArrow(check, "a long, b long"), "copies-links")
    return prints.select("key", "id", "node"), components(found)


def keep_first(docs: DataFrame, how: Overlap = FIVE_WORDS) -> DataFrame:
    """The documents without all but one of each group of near copies: the one with the smallest id stays.

    Rows are told apart by a 64-bit key of id and text, so repeated or missing ids join nothing that isn't near.  Of
    rows with equal ids and texts one stays; a row without an id stays if no row with an id is near it, and of
    several such near each other the one with the smallest key.  Texts without words are near copies of each other.
    """
    rows, first = owned(docs)
    ident, text = column(first, "doc_id", "long"), column(first, "text")
    rows = stored(rows.withColumn("__key", F.xxhash64(ident, text)).dropDuplicates(["__key"]), "copies-rows")
    nodes, roots = near_copies(rows.select(F.col("__key").alias("key"), ident.alias("id"), text.alias("text")), how)
    least = nodes.groupBy("node").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("least"))
    chosen = least.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("least").alias("least")).select(F.col("least.key").alias("__key"))
    return rows.join(chosen, "__key", "left_semi").drop("__key").toDF(*docs.columns)


__all__ = ["FIVE_WORDS", "FOUR_BITS", "Closeness", "Overlap", "components", "fingerprints", "keep_first", "linked", "links", "near_copies", "near_duplicates", "ring", "shingle_hashes", "shingle_sets"]
