"""Exact tokenisation with the tokenizers library behind a cache of text units.

Encoding is a function of units: a tokenizer that drops white space encodes every run of other
characters by itself; a byte-level one that keeps it never merges across a lone blank or line feed between two visible
characters.  Neither merges a Latin letter with the punctuation behind it, so words and what closes them are units of their own.
Each unit is therefore encoded once per worker and found again by a 64-bit key, all in numpy; what is
found counts only if its exact key (shared.exact_keys) agrees too, so units whose keys clash are still told apart.
Units of plain Latin letters, of punctuation, or of digits where these stay together, skip the library's normaliser and splitter, whose
effect on them is known, and go to its BPE model in joined strings; all other units go through the whole library.
"""

from __future__ import annotations

import json
import os

import numpy as np

from tablewright.llm.shared import LOWER, WHITE, KeyTable, TextBlock, exact_keys, folded, word_spans

#: Units that a worker keeps; beyond it the cache starts anew.
CACHE_UNITS = 1_000_000
#: Pieces that the library gets at once: it holds some hundred bytes for each token.
AT_ONCE = 512

#: Kinds of bytes, one bit each.  C3 and the trail bytes that it has for letters count as letters.
LETTER, PUNCTUATION, DIGIT, BLANK, FEED, OTHER = 1, 2, 4, 8, 16, 32
_KIND = np.full(256, OTHER, np.uint8)
_KIND[33:127] = PUNCTUATION
_KIND[48:58] = DIGIT
_KIND[65:91] = _KIND[97:123] = _KIND[0x80:0xC0] = _KIND[0xC3] = LETTER
_KIND[[0x97, 0xB7]] = OTHER  # behind C3 the signs of multiplication and division
_KIND[32], _KIND[10] = BLANK, FEED
#: Lower case of the letters' bytes, as wide as they are.
_LOWER = LOWER.copy()
_LOWER[0x80:0x9F] += 32


def byte_letters() -> list[str]:
    """The printable letter that byte-level BPE puts for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Encoder:
    """Token ids of whole texts, equal to the library's ``encode(text, add_special_tokens=False)``.

    A special token in a text becomes its id, as the library has it; with ``special_as_text`` it is encoded like any text.
    Bytes that are no UTF-8 count as the replacement character.
    """

    def __init__(self, path: str, special_as_text: bool = False) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = special_as_text
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.dtype = np.uint16 if self.whole.get_vocab_size() <= 1 << 16 else np.uint32
        first, pre, norm = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        parts = pre.get("pretokenizers", [pre])
        self.words = parts[0].get("type") == "Split" and parts[0].get("invert") is True and parts[0].get("behavior") == "Removed"
        self.spaced = not norm and parts[0].get("type") == "ByteLevel" and parts[0].get("use_regex") and not parts[0].get("add_prefix_space")
        self.suffix = first.get("end_of_word_suffix") or ""
        bare = {**spec, "normalizer": None, "post_processor": None, "added_tokens": [], "pre_tokenizer": {"type": "Split", "pattern": {"String": "\n"}, "behavior": "Removed", "invert": False}}
        self.bare = Tokenizer.from_str(json.dumps(bare))
        self.letters = np.array([ord(c) for c in byte_letters()], "<u2")
        self.plain = [LETTER, PUNCTUATION, DIGIT, FEED] if self.spaced else [LETTER, PUNCTUATION]
        self.joint = np.zeros((256, 256), bool)  # neighbours in a special token, which is cut nowhere
        for token in self.whole.get_added_tokens_decoder().values():
            own = list(token.content.encode())
            self.joint[own[:-1], own[1:]] = True
        self.width = np.zeros(max(first["vocab"].values()) + 2, np.int64)
        for piece, i in first["vocab"].items():
            self.width[i] = len(piece.removesuffix(self.suffix)) if self.suffix else len(piece)
        self._clear()

    def _clear(self) -> None:
        self.table = KeyTable(16)
        self.pool, self.used = np.zeros(1 << 16, self.dtype), 0
        self.start, self.count, self.units = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32), 0
        self.a, self.b = np.zeros(1 << 14, np.uint64), np.zeros(1 << 14, np.uint64)

    # -- units

    def _spans(self, block: TextBlock) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        buf, n, offs = block.buf, len(block.buf), block.offs
        cut = np.zeros(n + 1, bool)
        cut[offs] = True
        if self.words:
            starts, ends, rows = word_spans(block)
            if len(more := (at := self._closings(buf))[~cut[at]]):
                starts, ends = (np.sort(np.concatenate([x, more]), kind="stable") for x in (starts, ends))
                rows = np.searchsorted(offs, starts, "right") - 1
            return starts, ends, rows
        if self.spaced and n > 2:
            dull = (buf <= 32) | (buf == 127)
            # A last byte from 0x80 counts as visible only after a two-byte lead other than C2 (no Unicode blank ends so).
            lead = (buf >= 0xC3) & (buf <= 0xDF)
            seen = ~dull & (buf < 0x80)
            seen[1:] |= (buf[1:] >= 0x80) & (buf[1:] < 0xC0) & lead[:-1]
            lone = buf == 32
            lone[0] = lone[-1] = False
            lone[1:] &= seen[:-1]
            lone[:-1] &= ~dull[1:]
            # A blank that ends its row is followed by another row's byte: not lone.
            last = offs[1:][offs[1:] > offs[:-1]] - 1
            lone[last] = False
            lone[offs[:-1][offs[:-1] < n]] = False
            cut[:-1] |= lone
            cut[self._closings(buf)] = True
            # A lone line feed is a unit: visible characters are on both sides.
            at = np.flatnonzero(buf[1:-1] == 10) + 1
            at = at[seen[at - 1] & (~dull[at + 1] & (buf[at + 1] < 0x80) | lead[at + 1]) & ~self.joint[buf[at - 1], 10] & ~self.joint[10, buf[at + 1]]]
            cut[at] = cut[at + 1] = True
        marks = np.flatnonzero(cut)
        starts, ends = marks[:-1], marks[1:]
        return starts, ends, np.searchsorted(offs, starts, "right") - 1

    def _closings(self, buf: np.ndarray) -> np.ndarray:
        """Places of punctuation right behind a Latin letter."""
        at = np.flatnonzero(_KIND[buf] == PUNCTUATION)
        at = at[at > 0]
        before = buf[at - 1]
        letter = (_KIND[before] == LETTER) & ((before < 0x80) | (before < 0xC0) & (at > 1) & (buf[at - 2] == 0xC3))
        return at[letter & ~self.joint[before, buf[at]]]

    def _learn(self, block: TextBlock, at: np.ndarray, starts: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Encode the spans ``at`` and keep them as units; the units' numbers."""
        size = ends[at] - starts[at]
        to = np.cumsum(size)
        own = block.buf[np.repeat(starts[at] - (to - size), size) + np.arange(to[-1])]
        kind, first = _KIND[own], to - size
        # Letters of two bytes: C3 and a trail byte, both of this unit.
        trail, lead = (own >= 0x80) & (own < 0xC0), own == 0xC3
        inner = np.ones(len(own), bool)
        inner[first] = False
        kind[trail & ~(np.concatenate([[False], lead[:-1]]) & inner)] = OTHER
        kind[lead & ~(np.concatenate([trail[1:], [False]]) & np.concatenate([inner[1:], [False]]))] = OTHER
        kind[first[kind[first] == BLANK]] = 0
        kinds = np.bitwise_or.reduceat(kind, first)
        easy = np.isin(kinds, self.plain) & ((kinds != FEED) | (size == 1))
        plain, odd = np.flatnonzero(easy), np.flatnonzero(~easy)
        count = np.zeros(len(at), np.int64)
        flats = []
        if len(plain):
            # The units' bytes as letters, each unit closed by a line feed, which the bare tokenizer drops.
            chars = np.full(int(size[plain].sum()) + len(plain), 10, "<u2")
            close = np.cumsum(size[plain] + 1)
            text = np.ones(len(chars), bool)
            text[close - 1] = False
            mine = own[np.repeat(easy, size)]
            chars[text] = self.letters[_LOWER[mine] if self.words else mine]
            edges = [0, *close[AT_ONCE - 1 : -1 : AT_ONCE].tolist(), len(chars)]
            joined = [chars[i : j - 1].tobytes().decode("utf-16-le") for i, j in zip(edges[:-1], edges[1:], strict=True)]
            # One at a time: the ids alone stay.
            ids = np.concatenate([np.array(self.bare.encode_batch_fast([x], add_special_tokens=False)[0].ids, np.int64) for x in joined])
            bounds = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum(size[plain]), "left") + 1
            count[plain] = np.diff(bounds, prepend=0)
            flats.append(ids)
        for i in odd.tolist():
            text = own[first[i] : to[i]].tobytes().decode("utf-8", "replace")
            ids = self.whole.encode_batch_fast([text], add_special_tokens=False)[0].ids
            count[i] = len(ids)
            flats.append(np.array(ids, np.int64))
        order = np.concatenate([plain, odd])
        flat = np.concatenate(flats) if flats else np.zeros(0, np.int64)
        rows = np.empty(len(order), np.int64)
        rows[order] = np.arange(self.units, self.units + len(order))
        self.pool = _grown(self.pool, self.used + len(flat))
        self.pool[self.used : self.used + len(flat)] = flat
        self.start, self.count, self.a, self.b = (_grown(x, self.units + len(order)) for x in (self.start, self.count, self.a, self.b))
        got = count[order]
        self.start[rows[order]] = self.used + np.cumsum(got) - got
        self.count[rows], self.a[rows], self.b[rows] = count, a[at], b[at]
        self.used += len(flat)
        self.units += len(order)
        return rows

    # -- texts

    def encode(self, block: TextBlock) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block and the offsets of its rows in them."""
        if not (self.words or self.spaced):
            data, offs = block.buf.tobytes(), block.offs.tolist()
            texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(offs[:-1], offs[1:], strict=True)]
            got = [np.array(x.ids, self.dtype) for x in self.whole.encode_batch(texts, add_special_tokens=False)]
            return np.concatenate([*got, np.zeros(0, self.dtype)]), np.cumsum([0, *map(len, got)])
        starts, ends, rows = self._spans(block)
        a, b = exact_keys(block.buf, starts, ends)
        keys = folded(a, b)
        if self.units > CACHE_UNITS:
            self._clear()
        found = self.table.find(keys)
        if len(lost := np.flatnonzero(found < 0)):
            new, first = np.unique(keys[lost], return_index=True)
            self.table.add(new, self._learn(block, lost[first], starts, ends, a, b))
            found[lost] = self.table.find(keys[lost])
        if len(other := np.flatnonzero((self.a[found] != a) | (self.b[found] != b))):
            found[other] = self._learn(block, other, starts, ends, a, b)  # their key is another unit's
        count = self.count[found].astype(np.int64)
        to = np.cumsum(count)
        total = int(to[-1]) if len(to) else 0
        where = np.repeat(self.start[found] - (to - count), count)
        where += np.arange(total)
        per_row = np.bincount(rows, weights=count, minlength=len(block)).astype(np.int64)
        return self.pool[where], np.concatenate([[0], np.cumsum(per_row)])


def _grown(a: np.ndarray, n: int) -> np.ndarray:
    if n <= len(a):
        return a
    out = np.zeros(max(n, len(a) * 3 // 2), a.dtype)
    out[: len(a)] = a
    return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for a tokenizer file; its cache lives as long as the worker."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]


__all__ = ["Encoder", "WHITE", "byte_letters", "encoder"]
