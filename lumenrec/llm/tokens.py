"""Exact byte-level BPE ids, faster for prose: words are looked up with their ids, many at once.

The ids are those of tokenizers.Tokenizer.encode(text, add_special_tokens=False).
The vocabulary's pattern never joins a visible character with a space after it,
and makes a lone line end a token of its own. So where all white space of a text
is single spaces and single line ends between visible characters, it can be cut
before each of them, and each word's ids looked up in a table of words seen
before; new words go to the library. Any other text goes to the library whole.
The pattern also parts a letter from a mark after it, so a single mark that ends
a word is a word of its own here.

The table knows a word by 128 bits of hash: one that depends on the order of its
bytes and one that does not.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import _power, mix, utf8

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
VOCABULARY = "byte_bpe_50k.json"
END = 2
#: Words that a worker remembers; beyond that it starts anew, which changes no result.
REMEMBERED = 2_000_000
#: Bytes cut at once; longer texts are cut before a space or line end.
PIECE = 1 << 18

_rng = np.random.Generator(np.random.PCG64(3))
_BYTE, _SUM = (_rng.integers(0, 1 << 64, 256, dtype=np.uint64) for _ in range(2))
_ODD = np.zeros(256, bool)  # white space and controls that make a text odd, and the byte that stands between texts
_ODD[[0, 9, 11, 12, 13, 28, 29, 30, 31]] = True
_WORD = np.ones(256, bool)
_WORD[[0, 10, 32]] = False
_KIND = np.zeros(256, np.uint64)  # what a word follows: the begin of a text, a line end or a space
_KIND[[0, 10, 32]] = (1, 2, 3)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[list(b".,;:!?")] = True
#: Words of these letters are one pre-token, which the library's model takes as a string with one character for each byte.
_PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ſ]+").fullmatch
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_CHARACTER = dict(zip([*_SHOWN, *(b for b in range(256) if b not in _SHOWN)], [*_SHOWN, *range(256, 512 - len(_SHOWN))]))


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _wide_space(data: np.ndarray) -> np.ndarray:
    """Places of characters beyond ASCII that are, or may be, white space."""
    at = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))
    at = at[at < len(data) - 1]
    a, b = data[at], data[at + 1]
    c = data[np.minimum(at + 2, len(data) - 1)]
    bad = (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & ((b == 0x9A) | (b == 0xA0) & (c == 0x8E)) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
    bad |= (a == 0xE2) & ((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F))
    return at[bad]


class Encoder:
    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.newline = self._whole("\n")
        self._forget()

    def _forget(self) -> None:
        self.slots = np.full(1 << 16, -1, np.int32)
        self.n = self.used = 0
        self.keys, self.sums = np.zeros((2, 1 << 15), np.uint64)
        self.at = np.zeros((1 << 15) + 1, np.int64)
        self.pool = np.zeros(1 << 18, "<u4")

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    # the table: open addressing, all probes of many words side by side

    def _find(self, keys: np.ndarray, sums: np.ndarray) -> np.ndarray:
        """Numbers of the words, -1 where unknown."""
        out = np.full(len(keys), -1, np.int64)
        mask = np.uint64(len(self.slots) - 1)
        slot = (keys & mask).astype(np.int64)
        open_ = np.arange(len(keys))
        while len(open_):
            got = self.slots[slot]
            used = got >= 0
            open_, slot, got = open_[used], slot[used], got[used]
            same = (self.keys[got] == keys[open_]) & (self.sums[got] == sums[open_])
            out[open_[same]] = got[same]
            open_, slot = open_[~same], slot[~same] + 1 & len(self.slots) - 1
        return out

    def _place(self, numbers: np.ndarray) -> None:
        slot = (self.keys[numbers] & np.uint64(len(self.slots) - 1)).astype(np.int64)
        while len(numbers):
            free = np.flatnonzero(self.slots[slot] < 0)
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.slots[slot[won]] = numbers[won]
            rest = np.ones(len(numbers), bool)
            rest[won] = False
            numbers, slot = numbers[rest], slot[rest] + 1 & len(self.slots) - 1

    def _add(self, keys: np.ndarray, sums: np.ndarray, words: list[str], kinds: list[int]) -> None:
        """New words: 3 follows a space, 2 a line end, 1 nothing, 0 a letter."""
        one, many = self.library.model.tokenize, []
        ids: list[list[int] | None] = []
        for w, k in zip(words, kinds):
            if _PLAIN(w):
                ids.append([t.id for t in one((f" {w}" if k == 3 else w).encode().decode("latin-1").translate(_CHARACTER))])
            else:
                ids.append(None)
                many.append(f" {w}" if k == 3 else w)
        rest = iter(self.library.encode_batch_fast(many, add_special_tokens=False))
        newline = self.newline.tolist()
        ids = [newline + x if k == 2 else x for x, k in zip((next(rest).ids if x is None else x for x in ids), kinds)]
        size = np.array([len(x) for x in ids])
        n, total = self.n + len(ids), self.used + int(size.sum())
        while n > len(self.keys):
            self.keys, self.sums = (np.concatenate([x, np.zeros_like(x)]) for x in (self.keys, self.sums))
            self.at = np.concatenate([self.at, np.zeros(len(self.at) - 1, np.int64)])
        while total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.keys[self.n : n], self.sums[self.n : n] = keys, sums
        self.at[self.n + 1 : n + 1] = self.used + np.cumsum(size)
        self.pool[self.used : total] = [i for x in ids for i in x]
        before, self.n, self.used = self.n, n, total
        if 2 * n > len(self.slots):
            while 2 * n > len(self.slots):
                self.slots = np.full(2 * len(self.slots), -1, np.int32)
            before = 0
        self._place(np.arange(before, n))

    def _lookup(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of the words in data, which begins with what the first word follows; all ids, and where each word's begin."""
        edge = np.flatnonzero(np.diff(_WORD[data].view(np.int8), append=np.int8(0)))
        starts, ends = edge[::2] + 1, edge[1::2] + 1
        kind = _KIND[data[starts - 1]]
        last = data[ends - 2]
        letter = _LETTER[last] | (data[ends - 3] == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7)
        tail = np.flatnonzero(_MARK[data[ends - 1]] & letter & (ends - starts > 1))
        marks = tail + np.arange(1, len(tail) + 1)
        cut = ends[tail] - 1
        starts, ends = np.insert(starts, tail + 1, cut), np.insert(ends, tail + 1, ends[tail])
        ends[marks - 1] = cut
        kind = np.insert(kind, tail + 1, np.uint64(0))
        total = np.zeros((2, len(data) + 1), np.uint64)
        np.cumsum(_BYTE[data] * _power("up", len(data))[: len(data)], out=total[0, 1:])
        np.cumsum(_SUM[data], out=total[1, 1:])
        keys = mix((total[0, ends] - total[0, starts]) * _power("down", len(data))[starts] + kind)
        sums = total[1, ends] - total[1, starts] + kind
        if self.n > REMEMBERED:
            self._forget()
        found = self._find(keys, sums)
        new = np.flatnonzero(found < 0)
        if len(new):
            _, first = np.unique(keys[new], return_index=True)
            new = new[first]
            raw = data.tobytes()
            words = [raw[a:b].decode() for a, b in zip(starts[new].tolist(), ends[new].tolist())]
            self._add(keys[new], sums[new], words, kind[new].tolist())
            found = self._find(keys, sums)
        begin = self.at[found]
        size = self.at[found + 1] - begin
        out = np.concatenate([[0], np.cumsum(size)])
        return starts, self.pool[np.arange(out[-1]) + np.repeat(begin - out[:-1], size)], out

    def _even(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which texts can be cut: not empty, and white space only as single spaces and line ends between visible characters."""
        space = (data == 32) | (data == 10)
        bad = _ODD[data]
        bad[:-1] |= space[:-1] & space[1:]
        bad[_wide_space(data)] = True
        filled = np.flatnonzero(np.diff(offsets))
        bad[offsets[filled]] |= space[offsets[filled]]
        bad[offsets[filled + 1] - 1] |= space[offsets[filled + 1] - 1]
        even = np.diff(offsets) > 0
        even[np.searchsorted(offsets, np.flatnonzero(bad), "right") - 1] = False
        return even

    def encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text of a string column as unsigned 32-bit integers; null counts as empty."""
        data, offsets = utf8(column)
        even = self._even(data, offsets)
        i, n = 0, len(offsets) - 1
        while i < n:
            low, high = int(offsets[i]), int(offsets[i + 1])
            if not even[i]:
                yield self._whole(data[low:high].tobytes().decode()) if low < high else np.zeros(0, "<u4")
                i += 1
            elif high - low > PIECE:
                parts, piece = [], np.concatenate([np.zeros(1, np.uint8), data[low:high]])
                at = 0
                while at < len(piece):
                    cut = min(at + PIECE, len(piece))
                    while cut < len(piece) and _WORD[piece[cut]]:
                        cut += 1
                    parts.append(self._lookup(piece[at:cut])[1])
                    at = cut
                yield np.concatenate(parts)
                i += 1
            else:
                j = i
                while j < n and even[j] and offsets[j + 1] - low <= PIECE:
                    j += 1
                size = np.diff(offsets[i : j + 1])
                padded = np.zeros(int(offsets[j]) - low + j - i, np.uint8)
                padded[np.arange(int(offsets[j]) - low) + np.repeat(np.arange(1, j - i + 1), size)] = data[low : offsets[j]]
                starts, ids, begin = self._lookup(padded)
                first = begin[np.searchsorted(starts, offsets[i : j + 1] - low + np.arange(j - i + 1))].tolist()
                yield from (ids[a:b] for a, b in zip(first[:-1], first[1:]))
                i = j


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary and worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
