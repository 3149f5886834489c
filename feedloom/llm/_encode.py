"""Byte-level BPE of whole texts: pieces are found and looked up in numpy, each distinct one is encoded once."""

from __future__ import annotations

import json
import os
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa

from feedloom.llm._shared import utf8
from feedloom.llm._words import BLOCK, block_hashes

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pieces a worker's table holds before it starts anew, and the longest piece (bytes) that it keeps.
ENTRIES, LONGEST = 1_000_000, 60
#: Bytes of text looked at together.
RUN = 1 << 20

_LETTER, _DIGIT, _SIGN, _BLANK = 1, 2, 3, 4
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = _SIGN
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[48:58] = _DIGIT
_KIND[0x20] = _BLANK
#: Whether a piece ends between characters of two kinds, the row's before the column's.
_ENDS = np.zeros((5, 5), bool)
_ENDS[_LETTER, [_DIGIT, _SIGN]] = _ENDS[_DIGIT, [_LETTER, _SIGN]] = _ENDS[_SIGN, [_LETTER, _DIGIT]] = True
_ENDS = _ENDS.ravel()
#: White space of one byte, and the first bytes of white space of two or three.
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]] = True
_LEADS = np.zeros(256, bool)
_LEADS[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces start: each text, each blank before another character, and some changes of kind within ASCII.

    The pattern that splits text before the merges ends a match at each of these places, whatever stands around them,
    so the ids of the pieces, one after another, are those of the text. An apostrophe before a letter is left whole.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    kind = _KIND[data]
    at = np.zeros(n, bool)
    at[1:] = _ENDS.take(kind[:-1] * np.uint8(5) + kind[1:])
    mark = np.flatnonzero(data[:-1] == 0x27)
    at[mark[kind[mark + 1] == _LETTER] + 1] = False
    blank = np.flatnonzero(kind[:-1] == _BLANK)
    after = data[blank + 1]
    blank = blank[~_WHITE[after]]
    some = np.flatnonzero(_LEADS[data[blank + 1]])  # of these few characters, those that are white space begin no piece
    if len(some):
        first = blank[some] + 1
        wide = [data[np.minimum(first + k, n - 1)].astype(np.int64) for k in range(3)]
        two, three = wide[0] << 8 | wide[1], wide[0] << 16 | wide[1] << 8 | wide[2]
        white = np.isin(two, (0xC285, 0xC2A0)) | np.isin(three, (0xE19A80, 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080)) | ((three >= 0xE28080) & (three <= 0xE2808A))
        blank = np.delete(blank, some[white])
    at[blank] = True
    starts = offsets[:-1][np.diff(offsets) > 0]
    last = starts[1:] - 1  # a blank that ends a text belongs to what stands before it
    last = last[kind[last] == _BLANK]
    at[last[last > 0]] = False
    at[starts] = True
    return np.flatnonzero(at)


def gather(table: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs ``table[start : start + size]`` laid end to end."""
    ends = np.cumsum(sizes)
    kind = np.int32 if len(table) < 1 << 31 and (not len(ends) or ends[-1] < 1 << 31) else np.int64
    at = np.repeat((starts - (ends - sizes)).astype(kind), sizes)
    at += np.arange(len(at), dtype=kind)
    return table.take(at)


class _Table:
    """Open addressing from a piece's hash to its bytes and ids; bytes are compared, so equal hashes do no harm."""

    def __init__(self, dtype: np.dtype):
        self.slots = np.full(1 << 22, -1, np.int32)
        self.n = self.n_bytes = self.n_ids = 0
        self.hashes = np.zeros(1 << 14, np.uint64)
        self.place = np.zeros((4, 1 << 14), np.int32)  # start and length of the bytes, start and number of the ids
        self.bytes, self.ids = np.zeros(1 << 17, np.uint8), np.zeros(1 << 16, dtype)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The entry of each hash, -1 if there is none."""
        mask = np.uint64(len(self.slots) - 1)
        slot = (h & mask).astype(np.int64)
        out = self.slots[slot]
        open_ = np.flatnonzero((out >= 0) & (self.hashes[out] != h))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & int(mask)
            got = self.slots[slot[open_]]
            out[open_] = got
            open_ = open_[(got >= 0) & (self.hashes[got] != h[open_])]
        return out

    def add(self, h: np.ndarray, data: np.ndarray, sizes: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Enter distinct hashes that are not there yet."""
        end = self.n + len(h)
        while end > len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
            self.place = np.concatenate([self.place, np.zeros_like(self.place)], 1)
        while self.n_bytes + len(data) > len(self.bytes):
            self.bytes = np.concatenate([self.bytes, np.zeros_like(self.bytes)])
        while self.n_ids + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        at = slice(self.n, end)
        self.hashes[at] = h
        self.place[:, at] = self.n_bytes + np.cumsum(sizes) - sizes, sizes, self.n_ids + np.cumsum(counts) - counts, counts
        self.bytes[self.n_bytes : self.n_bytes + len(data)], self.ids[self.n_ids : self.n_ids + len(ids)] = data, ids
        self.n_bytes, self.n_ids = self.n_bytes + len(data), self.n_ids + len(ids)
        todo, mask = np.arange(self.n, end, dtype=np.int32), len(self.slots) - 1
        slot = (h & np.uint64(mask)).astype(np.int64)
        while len(todo):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = todo[free]  # of several that want one slot, the last gets it
            out = self.slots[slot] != todo
            todo, slot = todo[out], (slot[out] + 1) & mask
        self.n = end


class Encoder:
    """Ids of texts, equal to ``encode(text, add_special_tokens=False)`` of the tokenizers library.

    Texts are cut where the vocabulary's pattern always cuts, and the library encodes each distinct piece once for as
    long as it stays in the worker's table; long pieces are encoded whenever they are met. For a tokenizer that splits
    in another way every text is a piece. The strings of special tokens are ordinary text.
    """

    def __init__(self, path: str | None = None):
        from tokenizers import Tokenizer

        path = path or tokenizer_path()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        split = made.get("pre_tokenizer") or {}
        self.pieces = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not made.get("normalizer")
        self.table = self.new_table()

    def new_table(self) -> _Table:
        return _Table(self.dtype)

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where pieces start: the ids of pieces, one after another, are those of the text."""
        return cuts(data, offsets)

    def _library(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, their numbers) of the pieces, straight from the library."""
        whole = data.tobytes()
        texts = [str(whole[a:b], "utf-8", "surrogatepass") for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        got = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(chain.from_iterable(got), self.dtype, sizes.sum()), sizes

    def _run(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = self.cuts(data, offsets) if self.pieces else offsets[:-1][np.diff(offsets) > 0]
        ends = np.append(starts[1:], len(data))[: len(starts)]
        sizes = ends - starts
        short = np.flatnonzero(sizes <= LONGEST) if self.pieces else np.zeros(0, np.int64)
        if self.table.n > ENTRIES:
            self.table = self.new_table()
        h = block_hashes(data, starts[short], ends[short])
        entry = np.full(len(starts), -1, np.int32)
        entry[short] = self.table.find(h)
        missing = np.flatnonzero(entry[short] < 0)
        if len(missing):
            new, first = np.unique(h[missing], return_index=True)
            a = short[missing[first]]
            ids, counts = self._library(data, starts[a], ends[a])
            self.table.add(new, gather(data, starts[a], sizes[a]), sizes[a], ids, counts)
            entry[short[missing]] = self.table.find(h[missing])
        place = self.table.place
        held = np.flatnonzero(entry >= 0)
        e = entry[held]
        same = place[1, e] == sizes[held]
        differ = gather(data, starts[held[same]], sizes[held[same]]) != gather(self.table.bytes, place[0, e[same]].astype(np.int64), sizes[held[same]])
        if not same.all() or differ.any():  # equal hashes of other bytes: those pieces are encoded by themselves
            bad = np.repeat(held[same], sizes[held[same]])[differ]
            entry[held[~same]], entry[bad] = -1, -1
        counts = np.where(entry >= 0, place[3, entry], 0).astype(np.int64)
        odd = np.flatnonzero(entry < 0)
        odd_ids, counts[odd] = self._library(data, starts[odd], ends[odd])
        known = entry >= 0
        ids = gather(self.table.ids, place[2, entry[known]].astype(np.int64), counts[known])
        if len(odd):
            out = np.empty(counts.sum(), self.dtype)
            whose = np.repeat(known, counts)
            out[whose], out[~whose] = ids, odd_ids
            ids = out
        upto = np.concatenate(([0], np.cumsum(counts)))
        return ids, np.diff(upto[np.searchsorted(starts, offsets)])

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, number of each) for an Arrow column of strings without nulls."""
        data, offsets = utf8(column)
        if len(offsets) < 2:
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        ids, sizes = [], []
        i, n = 0, len(offsets) - 1
        while i < n:  # runs of whole texts; a longer text is a run of its own, and hashed in blocks
            j = min(max(int(np.searchsorted(offsets, offsets[i] + RUN, side="right")) - 1, i + 1), n)
            got, count = self._long(data[offsets[i] : offsets[j]]) if j == i + 1 and offsets[j] - offsets[i] > BLOCK else self._run(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            ids.append(got)
            sizes.append(count)
            i = j
        return np.concatenate(ids), np.concatenate(sizes)

    def _long(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One text longer than a block, in runs that end where a piece does."""
        if not self.pieces:
            return self._run(data, np.array([0, len(data)]))
        starts = self.cuts(data, np.array([0, len(data)]))
        out, at = [], 0
        while at < len(data):
            k = int(np.searchsorted(starts, at + RUN, side="right")) - 1
            end = len(data) if at + RUN >= len(data) else int(starts[k])
            if end <= at:  # a piece longer than a run
                end = int(starts[k + 1]) if k + 1 < len(starts) else len(data)
            out.append(self._run(data[at:end], np.array([0, end - at]))[0])
            at = end
        ids = np.concatenate(out)
        return ids, np.array([len(ids)])

    def raw(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned integers of ``dtype``."""
        ids, sizes = self.encode(pa.array(texts, pa.large_string()))
        ends = np.cumsum(sizes)
        return [ids[a:b].tobytes() for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]


@lru_cache(2)
def encoder(path: str | None = None) -> Encoder:
    """One encoder for each worker process: its table serves all tasks that run there."""
    return Encoder(path)
