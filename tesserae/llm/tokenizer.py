"""The tokenizers library behind a bounded table of words, one in each Python worker."""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np

from tesserae.llm.textbytes import U64, gathered, span_hashes

#: Bytes of the longest word that is kept, words that are looked up at once, and ids that are kept.
KEPT, WINDOW, POOL = 256, 1 << 17, 1 << 22


class WordIds:
    """Ids of words. Those not yet known are encoded by the library, together.

    A word is known by two 64-bit hashes of its bytes. The table has open addressing over a fixed number of slots, and
    the ids of its words stand in one array; when half the slots or POOL ids are in use, the words that were met
    again stay, and the others go. So memory is bounded whatever the words; words of over KEPT bytes are never kept.
    """

    def __init__(self, path: str, bits: int = 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.kind = np.uint16 if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.uint32
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.bits = bits
        self._clear()

    def _clear(self) -> None:
        n = 1 << self.bits
        self.h1, self.h2 = np.zeros(n, U64), np.zeros(n, U64)
        self.start, self.size, self.again = np.zeros(n, np.int32), np.zeros(n, np.int16), np.zeros(n, bool)
        self.pool, self.end, self.count = np.zeros(1 << 16, self.kind), 0, 0

    def _first_slot(self, h1: np.ndarray) -> np.ndarray:
        return (h1 >> U64(64 - self.bits)).astype(np.int64)

    def _find(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The slot of each word, -1 for unknown ones."""
        slot, out, todo = self._first_slot(h1), np.full(len(h1), -1), np.arange(len(h1))
        while len(todo):
            s = slot[todo]
            key = self.h1[s]
            same = (key == h1[todo]) & (self.h2[s] == h2[todo])
            out[todo[same]] = s[same]
            todo = todo[~same & (key != 0)]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
        return out

    def _add(self, h1: np.ndarray, h2: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Different words that are not in the table."""
        if self.end + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.end], np.zeros(self.end + len(ids), self.kind)])
        self.pool[self.end : self.end + len(ids)] = ids
        begin = self.end + np.cumsum(sizes) - sizes
        self.end += len(ids)
        self.count += len(h1)
        slot, todo = self._first_slot(h1), np.arange(len(h1))
        while len(todo):
            free = todo[self.h1[slot[todo]] == 0]
            took = free[np.unique(slot[free], return_index=True)[1]]
            s = slot[took]
            self.h1[s], self.h2[s], self.start[s], self.size[s], self.again[s] = h1[took], h2[took], begin[took], sizes[took], False
            todo = np.setdiff1d(todo, took, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def _make_room(self) -> None:
        """Keep the words that were met again, as far as they fill a quarter of the table."""
        keep = np.flatnonzero(self.again)
        keep = keep[np.cumsum(self.size[keep], dtype=np.int64) <= POOL // 2][: 1 << (self.bits - 2)]
        h1, h2, sizes = self.h1[keep], self.h2[keep], self.size[keep].astype(np.int64)
        ids = gathered(self.pool, self.start[keep].astype(np.int64), sizes)
        self._clear()
        self._add(h1, h2, ids, sizes)

    def by_library(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after the other, and how many each has."""
        ids = [e.ids for e in self.library.encode_batch_fast(words, add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((i for x in ids for i in x), self.kind, int(sizes.sum())), sizes

    def encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words at these places of UTF-8 bytes, one after the other, and how many each has."""
        parts = [self._window(data, starts[i : i + WINDOW], ends[i : i + WINDOW]) for i in range(0, len(starts), WINDOW)]
        if len(parts) == 1:
            return parts[0]
        return np.concatenate([np.zeros(0, self.kind), *(p[0] for p in parts)]), np.concatenate([np.zeros(0, np.int64), *(p[1] for p in parts)])

    def _window(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, high = int(starts[0]), int(ends[-1])  # places go up
        data, starts, ends = data[low:high], starts - low, ends - low
        if self.count > 1 << (self.bits - 1) or self.end > POOL:
            self._make_room()
        h1, h2 = (span_hashes(data, starts, ends, seed) for seed in (1, 2))
        h1 |= U64(1)  # zero marks a free slot
        kept = ends - starts <= KEPT
        at = self._find(h1, h2)
        self.again[at[at >= 0]] = True
        unknown = np.flatnonzero((at < 0) & kept)
        while len(unknown):
            fresh = unknown[np.unique(h1[unknown], return_index=True)[1]]
            raw = data.tobytes()
            ids, sizes = self.by_library([raw[s:e].decode() for s, e in zip(starts[fresh].tolist(), ends[fresh].tolist())])
            self._add(h1[fresh], h2[fresh], ids, sizes)
            at[unknown] = self._find(h1[unknown], h2[unknown])
            unknown = unknown[at[unknown] < 0]
        if kept.all():
            sizes = self.size[at].astype(np.int64)
            return gathered(self.pool, self.start[at].astype(np.int64), sizes), sizes
        long_ = np.flatnonzero(~kept)
        more, many = self.by_library([data[s:e].tobytes().decode() for s, e in zip(starts[long_].tolist(), ends[long_].tolist())])
        begin, sizes = self.start[at].astype(np.int64), self.size[at].astype(np.int64)
        begin[long_], sizes[long_] = self.end + np.cumsum(many) - many, many
        return gathered(np.concatenate([self.pool[: self.end], more]), begin, sizes), sizes


@lru_cache(1)
def byte_level(path: str) -> WordIds:
    """For byte-level BPE whose pattern puts at most one space before a word, and never goes from a word into white space."""
    return WordIds(path)


#: The last byte of white space beyond ASCII, by the byte before it: no cut is made after such a pair.
_WIDE = {0xC2: (0x85, 0xA0), 0x9A: (0x80,), 0x80: (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF), 0x81: (0x9F,)}
_WIDE_PAIR = np.zeros(1 << 16, bool)
_WIDE_PAIR[[a << 8 | b for a, bs in _WIDE.items() for b in bs]] = True
_NO_SPACE = np.ones(256, bool)
_NO_SPACE[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = False
#: Kinds of ASCII bytes: 1 letters, 2 digits, 3 marks, 4 the apostrophe. Others, 0, are not told apart.
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 3
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[48:58], _KIND[39] = 2, 4


def kind_changes(data: np.ndarray, special: list[bytes]) -> np.ndarray:
    """Whether a piece of its own starts at each byte after the first, as letters, digits and marks never share a token's word.

    After an apostrophe none does, because of words like 's; nor where the texts hold a special token.
    """
    raw = data.tobytes()
    if any(x in raw for x in special):
        return np.zeros(max(len(data) - 1, 0), bool)
    kind = _KIND[data]
    a, b = kind[:-1], kind[1:]
    return (a > 0) & (a < 4) & (b > 0) & (a != b) & ~((a == 3) & (b == 4))


def byte_level_spans(data: np.ndarray, offsets: np.ndarray, special: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of pieces that no token of such a pattern crosses, and the rows' offsets in them.

    A cut stands before a space or line end that follows no white space, after a line end that stands between
    two solid characters, and where kind_changes() has one.
    """
    n = len(data)
    cut = np.zeros(n + 1, bool)
    if n > 1:
        solid = _NO_SPACE[data]
        space = (data[1:] == 0x20) | (data[1:] == 0x0A)
        at = np.flatnonzero(space & solid[:-1]) + 1
        at = at[~((data[at - 1] >= 0x80) & _WIDE_PAIR[data[np.maximum(at - 2, 0)].astype(np.int64) << 8 | data[at - 1]])]
        cut[at] = True
        line = at[data[at] == 0x0A] + 1
        line = line[line < n]
        cut[line[solid[line] & (data[line] < 0x80)]] = True
        cut[1:n] |= kind_changes(data, special)
    cut[offsets] = True
    cut[n] = False
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], n) if len(starts) else starts
    return starts, ends, np.searchsorted(starts, offsets)
