"""The most similar text of a block for each text of another: bounds for all pairs at once, measures for the few that can win.

Shared tokens are counted by a product of 0/1 matrices, which bounds the similarity of every pair from above; pairs are measured
from the highest bound down, a machine word holding a text's places (longer texts one by one), until no bound reaches the best.
"""

from __future__ import annotations

import numpy as np

from tablewright.functions.similarity import LEVENSHTEIN, jaro_winkler_of

#: Texts of each side that are looked at together, tokens told apart, pairs of a text measured first, and pairs measured together.
TILE, SLICE, DISTINCT, FIRST, CHUNK = 128, 4_096, 512, 16, 1 << 14
#: Places that a machine word holds, and room for rounding in bounds.
WORD, SLACK = 64, 1e-5
_BELOW = np.array([(1 << k) - 1 for k in range(WORD + 1)], np.uint64)  # the lowest k bits
_ONE = np.uint64(1)


def levenshtein_of(a: str, b: str) -> int:
    """Edit distance of texts of any length, column by column in one integer (Myers, Hyyrö)."""
    if not a:
        return len(b)
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, score = full, 0, len(a)
    for c in b:
        eq = places.get(c, 0)
        xv, xh = eq | down, (((eq & up) + up) ^ up) | eq
        ph, mh = down | (~(xh | up) & full), up & xh
        score += bool(ph & last) - bool(mh & last)
        ph, mh = (ph << 1 | 1) & full, (mh << 1) & full
        up, down = mh | (~(xv | ph) & full), ph & xv
    return score


class _Side:
    """Texts as codes, padded to a word; those longer than a word are told by ``long``."""

    def __init__(self, texts: list[str], alphabet: np.ndarray) -> None:
        self.texts, self.n = texts, np.array([len(t) for t in texts], np.int64)
        self.long = self.n > WORD
        width = int(min(WORD, max(1, self.n.max(initial=0))))
        raw = np.array([t[:width] for t in texts], f"U{width}").view(np.uint32).reshape(len(texts), width)
        at = np.searchsorted(alphabet, raw)
        known = alphabet[np.minimum(at, len(alphabet) - 1)] == raw if len(alphabet) else np.zeros(raw.shape, bool)
        self.codes = np.where(known & (np.arange(width) < self.n[:, None]), at, len(alphabet))  # the last code: a sign that the other side lacks

    def places(self, size: int) -> np.ndarray:
        """For each text and code the bits of its places."""
        out = np.zeros((len(self.texts), size + 1), np.uint64)
        rows = np.arange(len(self.texts))
        for i in range(self.codes.shape[1]):
            out[rows, self.codes[:, i]] |= _ONE << np.uint64(i)
        out[:, size] = 0
        return out


def _signs(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All signs of texts and the row of each."""
    n = np.array([len(t) for t in texts], np.int64)
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), np.repeat(np.arange(len(texts)), n)


def _tokens(texts: list[str], q: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens (q-grams of padded texts, numbered where they repeat) as keys, and the row of each."""
    codes, rows = _signs(["\x01" * (q - 1) + t + "\x02" * (q - 1) for t in texts])
    key = codes.astype(np.uint64)
    if q == 2:
        inner = rows[1:] == rows[:-1]
        key, rows = (key[:-1] << np.uint64(21) | key[1:])[inner], rows[1:][inner]
    order = np.lexsort((key, rows))
    key, rows = key[order], rows[order]
    new = np.r_[True, (key[1:] != key[:-1]) | (rows[1:] != rows[:-1])] if len(key) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0)) if len(key) else np.zeros(0, np.int64)
    often = np.minimum(np.arange(len(key)) - start, (1 << 22) - 1).astype(np.uint64)
    return key << np.uint64(22) | often, rows


def _shared(a: list[str], b: list[str], q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """0/1 matrices of both sides whose product counts shared tokens, and for each text how many of its tokens have no column."""
    (ka, ra), (kb, rb) = _tokens(a, q), _tokens(b, q)
    both = np.intersect1d(ka, kb)
    sides = []
    for key, rows, n in ((ka, ra, len(a)), (kb, rb, len(b))):
        place = np.searchsorted(both, key)
        ok = place < len(both)
        ok[ok] = both[place[ok]] == key[ok]
        sides.append((place[ok], rows[ok], n))
    share = sum(np.bincount(place, minlength=len(both)) / max(1, n) for place, _, n in sides) / 2
    kept = np.sort(np.argsort(np.abs(share - 0.5), kind="stable")[:DISTINCT])  # those that all or none have tell nothing apart
    column = np.full(len(both) + 1, -1)
    column[kept] = np.arange(len(kept))
    out = []
    for place, rows, n in sides:
        c = column[place]
        matrix = np.zeros((n, len(kept)), np.float32)
        matrix[rows[c >= 0], c[c >= 0]] = 1
        out.append((matrix, np.bincount(rows[c < 0], minlength=n).astype(np.float32)))
    (at, rest_a), (bt, rest_b) = out
    return at, bt, rest_a, rest_b


def _levenshtein(a: _Side, b: _Side, places: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Edit distances of pairs of texts of a word at most."""
    n, m = a.n[i], b.n[j]
    last = _ONE << np.maximum(n - 1, 0).astype(np.uint64)
    up, down = np.full(len(i), ~np.uint64(0)), np.zeros(len(i), np.uint64)
    score, out = n.copy(), np.where(n == 0, m, n)
    for k in range(min(int(m.max(initial=0)), b.codes.shape[1])):
        eq = places[i, b.codes[j, k]]
        xv, xh = eq | down, (((eq & up) + up) ^ up) | eq
        ph, mh = down | ~(xh | up), up & xh
        score += ((ph & last) != 0).astype(np.int64) - ((mh & last) != 0)
        ph, mh = ph << _ONE | _ONE, mh << _ONE
        up, down = mh | ~(xv | ph), ph & xv
        np.copyto(out, score, where=(m == k + 1) & (n > 0))
    return out


def _jaro(a: _Side, b: _Side, places: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Jaro similarities of pairs of texts of a word at most, as ``jaro_of`` gives them."""
    n, m = a.n[i], b.n[j]
    reach = np.maximum(np.maximum(n, m) // 2 - 1, 0)
    free, left, taken = np.full(len(i), ~np.uint64(0)), np.zeros(len(i), np.uint64), np.zeros(len(i), np.uint64)
    for k in range(min(int(n.max(initial=0)), a.codes.shape[1])):
        window = _BELOW[np.minimum(np.minimum(m, k + reach + 1), WORD)] & ~_BELOW[np.clip(k - reach, 0, WORD)]
        x = places[j, a.codes[i, k]] & window & free
        low = x & (~x + _ONE)
        free, taken = free & ~low, taken | low
        left |= (x != 0).astype(np.uint64) << np.uint64(k)
    met = np.bitwise_count(left).astype(np.int64)
    swaps = np.zeros(len(i), np.int64)
    for k in range(int(met.max(initial=0))):
        x, y = left & (~left + _ONE), taken & (~taken + _ONE)
        p, r = np.bitwise_count(x - _ONE), np.bitwise_count(y - _ONE)
        swaps += (k < met) & (a.codes[i, np.minimum(p, a.codes.shape[1] - 1)] != b.codes[j, np.minimum(r, b.codes.shape[1] - 1)])
        left, taken = left ^ x, taken ^ y
    d = np.maximum(met, 1)
    return np.where(met > 0, (met / np.maximum(n, 1) + met / np.maximum(m, 1) + (met - swaps // 2) / d) / 3, np.where((n == 0) & (m == 0), 1.0, 0.0))


def _beginnings(texts: list[str], none: int) -> np.ndarray:
    """The first four signs of each text."""
    return np.array([[*map(ord, t[:4]), *[none] * (4 - len(t[:4]))] for t in texts], np.int64).reshape(len(texts), 4)


def _raise(a: list[str], b: list[str], jaro: bool, best: np.ndarray, which: np.ndarray, base: int) -> None:
    """Raise the best similarity of each text of a, and which text has it, by texts of b; their numbers begin at ``base``."""
    alphabet = np.intersect1d(_signs(a)[0], _signs(b)[0])
    x, y = _Side(a, alphabet), _Side(b, alphabet)
    in_a, in_b, rest_a, rest_b = _shared(a, b, 1 if jaro else 2)
    places = (y if jaro else x).places(len(alphabet))
    na, nb = x.n.astype(np.float32), y.n.astype(np.float32)[None, :]
    begin_a, begin_b = _beginnings(a, -1), _beginnings(b, -2)

    def measure(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i))
        for at in range(0, len(i), CHUNK):
            p, r = i[at : at + CHUNK], j[at : at + CHUNK]
            if jaro:
                s = _jaro(x, y, places, p, r)
                s = s + np.logical_and.accumulate(begin_a[p] == begin_b[r], axis=1).sum(axis=1) * 0.1 * (1 - s)
            else:
                longer = np.maximum(x.n[p], y.n[r])
                s = np.where(longer == 0, 1.0, 1 - _levenshtein(x, y, places, p, r) / np.maximum(longer, 1))
            for k in np.flatnonzero(x.long[p] | y.long[r]):
                t, u = a[p[k]], b[r[k]]
                s[k] = jaro_winkler_of(t, u) if jaro else 1 - levenshtein_of(t, u) / max(len(t), len(u))
            out[at : at + CHUNK] = s
        return out

    def take(i: np.ndarray, j: np.ndarray) -> None:
        s = measure(i, j)
        order = np.lexsort((j, -s, i))
        i, j, s = i[order], j[order], s[order]
        head = np.r_[True, i[1:] != i[:-1]]
        i, j, s = i[head], j[head] + base, s[head]
        better = (s > 0) & ((s > best[i]) | ((s == best[i]) & ((which[i] < 0) | (j < which[i]))))
        best[i[better]], which[i[better]] = s[better], j[better]

    for at in range(0, len(a), TILE):
        own = slice(at, at + TILE)
        bound = in_a[own] @ in_b.T  # tokens shared at most
        if rest_a.any() and rest_b.any():
            bound += np.minimum(rest_a[own, None], rest_b[None, :])
        n = na[own, None]
        if jaro:
            none = (n == 0) & (nb == 0)
            bound = (bound * (1 / np.maximum(n, 1) + 1 / np.maximum(nb, 1)) + 1) / 3
            alike, rest = True, 1 - bound
            for k in range(4):
                alike = alike & (begin_a[own, k, None] == begin_b[None, :, k])
                bound += np.where(alike, 0.1, 0).astype(np.float32) * rest
            bound[none] = 1
        else:
            longest = np.maximum(n, nb)
            edits = np.maximum(np.abs(n - nb), np.ceil((longest + 1 - bound) / 2 - 1e-3))
            bound = 1 - edits / np.maximum(longest, 1)
        i, j = np.nonzero(bound >= (best[own] - SLACK).astype(np.float32)[:, None])
        u, i = bound[i, j], i + at
        while len(i):
            order = np.lexsort((-u, i))
            i, j, u = i[order], j[order], u[order]
            rank = np.arange(len(i)) - np.maximum.accumulate(np.where(np.r_[True, i[1:] != i[:-1]], np.arange(len(i)), 0))
            now = rank < FIRST if rank.max() >= 4 * FIRST else rank >= 0
            take(i[now], j[now])
            still = ~now & (u >= best[i] - SLACK)
            i, j, u = i[still], j[still], u[still]


def nearest(a: list[str], b: list[str], algorithm: str, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For each text of a the best similarity that reaches the threshold, and the first text of b that has it (-1: none)."""
    best, which = np.full(len(a), float(threshold)), np.full(len(a), -1, np.int64)
    for base in range(0, len(b), SLICE):
        _raise(a, b[base : base + SLICE], algorithm != LEVENSHTEIN, best, which, base)
    return best, which
