"""Alignment of two tokenizers over a corpus: groups of tokens that cover equal bytes, and counts of linked id pairs.

An A token and a B token of a text are linked where their byte ranges overlap. For an id pair it is asked how many
documents hold it linked, for each link whether its count is the highest of its A id. The pair-document records are
counted outside memory:

1. Documents are encoded in chunks. A chunk's records (pair, document, times) are sorted and dealt by a radix of the A id
   into runs, compressed by zstd and written to the shared folder: for each pair of the run how many of the chunk's
   documents hold it, then those documents.
2. The runs of a bucket are merged, at most about FAN at once, through a heap over their blocks; counts of equal pairs add
   up. Levels go on until a bucket has one run. Pairs are in the order of their A id, so its highest count is known when
   the run has passed it.
3. Counts stream back: a merged run gives each of its parts the counts of that part's pairs, level by level down to the
   chunks' runs, where they are added up by document.

A frequent pair costs a number for each chunk and a small integer for each document; no task gathers its documents.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm._encode import _KIND, _LETTER, Encoder, gather, tokenizer_path
from feedloom.llm._encode import encoder as byte_encoder
from feedloom.llm._shared import materialize, ship, utf8

#: Runs of a chunk, merged runs at once, blocks of a run in the heap.
RADIX, FAN, RUN_BLOCK = 32, 64, 1 << 14
#: Bytes of text and rows of a chunk; bytes looked at together.
CHUNK, CHUNK_ROWS, BLOCK = 4 << 20, 1 << 14, 1 << 20
#: Records sorted at once.
RECORDS = 8_000_000

COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")


class PieceEncoder(Encoder):
    """Ids of texts that begin with a blank, equal to those of the piece model for what follows it.

    Where no piece of the vocabulary has a blank after another character, texts are cut before each run of blanks; where
    none has a line break, also before those. Each distinct part is encoded once for as long as it is in the table.
    """

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        self.tokenizer = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.tokenizer.get_piece_size()
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.names = [self.tokenizer.id_to_piece(i) for i in range(self.size)]
        spec = proto.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        plain = not spec.normalizer_spec.precompiled_charsmap and spec.normalizer_spec.add_dummy_prefix and not spec.normalizer_spec.remove_extra_whitespaces and spec.trainer_spec.model_type == 2
        special = [i for i in range(self.size) if spec.pieces[i].type == 4]
        self.pieces = plain and not special and not any("▁" in x.lstrip("▁") for x in self.names)
        self.lines = self.pieces and not any("\n" in x for x in self.names)
        x, more = self.tokenizer.encode(["x", "x "])
        self.blank = more[len(x) :]
        self.table = self.new_table()

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        blank = data == 0x20
        at = blank.copy()
        at[1:] &= ~blank[:-1]
        if self.lines:
            at |= data == 0x0A
        at[offsets[:-1][np.diff(offsets) > 0]] = True
        return np.flatnonzero(at)

    def _library(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        whole = data.tobytes()
        texts = [str(whole[a:b], "utf-8", "surrogatepass") for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        got = self.tokenizer.encode([t[1:] if t[0] == " " else t for t in texts], num_threads=1)
        ids = [self.blank if t == " " else x if t[0] == " " else x[1:] for t, x in zip(texts, got, strict=True)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.array([i for x in ids for i in x], self.dtype), sizes


@lru_cache(1)
def piece_encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


class Bytes:
    """The bytes of each id, end to end."""

    def __init__(self, tokens: list[bytes]):
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(tokens), np.uint8)


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, then from U+0100 on."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(0x100 + i): b for i, b in enumerate(rest)}


@lru_cache(1)
def byte_tokens(path: str) -> Bytes:
    letters = _byte_letters()
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    ids = made["model"]["vocab"] | {t["content"]: t["id"] for t in made.get("added_tokens", [])}
    out = [b""] * (max(ids.values()) + 1)
    for token, i in ids.items():
        out[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
    return Bytes(out)


@lru_cache(1)
def piece_tokens(path: str) -> Bytes:
    made = piece_encoder(path)
    return Bytes([bytes([int(x[3:5], 16)]) if made.tokenizer.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(made.names)])


def _decimals(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Digits of 0 to ``size`` - 1, left in their row, and how many they are."""
    width = len(str(max(1, size - 1)))
    ids = np.arange(size)
    lengths = np.ones(size, np.int64)
    for k in range(1, width):
        lengths += ids >= 10**k
    out = np.zeros((size, width + 1), np.uint8)
    for k in range(width):
        has = lengths > k
        out[has, k] = 48 + ids[has] // 10 ** (lengths[has] - 1 - k) % 10
    return out, lengths


def parts(data: np.ndarray, most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """A text's byte ranges of about ``most`` bytes, cut before a blank between two letters, where tokens of both end."""
    at = 0
    while at < len(data):
        end = len(data)
        look = at + most
        while look < len(data) - 1:
            window = slice(look, min(look + most, len(data) - 1))
            kind = _KIND[data[window.start - 1 : window.stop + 1]]
            found = np.flatnonzero((data[window] == 0x20) & (kind[:-2] == _LETTER) & (kind[2:] == _LETTER))
            if len(found):
                end = look + int(found[0])
                break
            look = window.stop
        yield at, end
        at = end


class Aligner:
    """Tokens, groups and links of texts; one for each worker process."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = byte_encoder(a_path), piece_encoder(b_path)
        self.a_bytes, self.b_bytes = byte_tokens(a_path), piece_tokens(b_path)
        self.digits, self.n_digits = _decimals(max(self.a.size, self.b.size))
        self.per = -(-self.a.size // RADIX)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A pair's number: ascending by bucket, then by A id, then by B id."""
        a = a.astype(np.int64)
        return (a % RADIX * self.per + a // RADIX) * self.b.size + b

    def block(self, data: np.ndarray, offsets: np.ndarray) -> dict:
        """Figures of segments of text that lie end to end, each with its blank before; ``good`` where A and B both
        give back the bytes. ``records`` are (segment, pair) of every link of good ones."""
        n = len(offsets) - 1
        column = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
        sides = []
        good = np.ones(n, bool)
        for encoder, tokens in ((self.a, self.a_bytes), (self.b, self.b_bytes)):
            ids, counts = encoder.encode(column)
            ids = ids.astype(np.int64)
            sizes = tokens.sizes[ids]
            upto = np.r_[0, np.cumsum(sizes)][np.r_[0, np.cumsum(counts)]]
            good &= np.diff(upto) == np.diff(offsets)
            sides.append([ids, counts, sizes, tokens])
        for side in sides:  # the bytes of segments whose lengths agree
            ids, counts, sizes, tokens = side
            keep = np.repeat(good, counts)
            made = gather(tokens.data, tokens.starts[ids[keep]], sizes[keep])
            whose = np.repeat(np.arange(n), np.where(good, np.diff(offsets), 0))
            given = data if good.all() else data[np.repeat(good, np.diff(offsets))]
            good[np.unique(whose[made != given])] = False
        for side in sides:
            keep = np.repeat(good, side[1])
            if not good.all():
                side[0], side[2] = side[0][keep], side[2][keep]
            side[1] = np.where(good, side[1], 0)
        (a, n_a, len_a, _), (b, n_b, len_b, _) = sides
        end_a, end_b = np.cumsum(len_a), np.cumsum(len_b)
        total = int(end_a[-1]) if len(a) else 0
        mark = np.zeros(total + 1, bool)
        mark[end_b] = True
        both_a = mark[end_a]
        mark[:] = False
        mark[end_a] = True
        both_b = mark[end_b]
        bound_a, bound_b = np.r_[0, np.cumsum(n_a)], np.r_[0, np.cumsum(n_b)]
        groups = np.diff(np.r_[0, np.cumsum(both_a)][bound_a])
        at_byte = np.repeat(np.arange(len(b), dtype=np.int32), len_b)
        low = at_byte[end_a - len_a]
        many = at_byte[end_a - 1] + 1 - low
        upto = np.r_[0, np.cumsum(many, dtype=np.int64)]
        links = np.diff(upto[bound_a])
        linked_b = b[np.repeat(low - upto[:-1], many) + np.arange(upto[-1])]
        pairs = np.repeat(self.pair(a, np.int64(0)), many) + linked_b
        text, text_bounds = self._render(a, b, both_a, both_b, bound_a, bound_b)
        return {"good": good, "n_a": n_a, "n_b": n_b, "n_groups": groups, "n_links": links, "pairs": pairs, "text": text, "bounds": text_bounds}

    def _render(self, a, b, both_a, both_b, bound_a, bound_b) -> tuple[np.ndarray, np.ndarray]:
        """``a1,a2|b1;`` of every group, and where each segment's text begins."""
        last_a, last_b = np.flatnonzero(both_a) + 1, np.flatnonzero(both_b) + 1
        group_a, group_b = np.cumsum(both_a) - both_a, np.cumsum(both_b) - both_b
        at_a, at_b = np.arange(len(a)) + np.r_[0, last_b][group_a], np.arange(len(b)) + last_a[group_b]
        ids, sign = np.empty(len(a) + len(b), np.int64), np.empty(len(a) + len(b), np.uint8)
        ids[at_a], ids[at_b] = a, b
        sign[at_a], sign[at_b] = np.where(both_a, ord("|"), ord(",")), np.where(both_b, ord(";"), ord(","))
        rows, length = self.digits[ids], self.n_digits[ids]
        rows[np.arange(len(ids)), length] = sign
        text = rows[np.arange(rows.shape[1]) <= length[:, None]]
        return text, np.r_[0, np.cumsum(length + 1)][bound_a + bound_b]


@lru_cache(1)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def _squeeze(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(x).tobytes())


def _open(blob: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), kind)


def _pack_pairs(pairs: np.ndarray) -> bytes:
    return _squeeze(np.diff(pairs, prepend=np.int64(0)))


def _open_pairs(blob: bytes) -> np.ndarray:
    return np.cumsum(_open(blob, np.int64))


def _pack_small(x: np.ndarray) -> bytes:
    """Numbers in the fewest bytes that hold them all; the first byte says how many."""
    kind = np.min_scalar_type(int(x.max()) if len(x) else 0)
    return bytes([kind.itemsize]) + _squeeze(x.astype(kind))


def _open_small(blob: bytes) -> np.ndarray:
    return _open(blob[1:], f"<u{blob[0]}").astype(np.int64)


class Chunk:
    """Collects documents' records until the chunk is full, and gives its rows."""

    def __init__(self, number: int):
        self.number = number
        self.ids: list[pa.Array] = []
        self.rows: list[tuple] = []
        self.raw: list[np.ndarray] = []
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.n_raw = self.size = 0

    def add(self, keys: np.ndarray) -> None:
        self.raw.append(keys)
        self.n_raw += len(keys)
        if self.n_raw > RECORDS:
            self.settle()

    def settle(self) -> None:
        if self.raw:
            keys = np.sort(np.concatenate(self.raw))
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
            self.held.append((keys[first], np.diff(np.r_[first, len(keys)])))
            self.raw, self.n_raw = [], 0

    def records(self, bad: set[int]) -> tuple[np.ndarray, np.ndarray]:
        self.settle()
        keys, times = (np.concatenate(x) for x in zip(*self.held, strict=True)) if self.held else (np.zeros(0, np.int64),) * 2
        if len(self.held) > 1:
            order = np.argsort(keys, kind="stable")
            keys, times = keys[order], times[order]
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            keys, times = keys[first], np.add.reduceat(times, first)
        if bad:
            stay = ~np.isin(keys & (CHUNK_ROWS - 1), np.array(sorted(bad)))
            keys, times = keys[stay], times[stay]
        return keys, times

    def output(self, schema: pa.Schema, widest: int, bad: set[int]) -> pa.RecordBatch:
        """A row with the chunk's documents (bucket -1) and a row for each run."""
        keys, times = self.records(bad)
        pairs = keys >> (CHUNK_ROWS.bit_length() - 1)
        cut = np.searchsorted(pairs, np.arange(RADIX + 1) * widest)
        ids = pa.concat_arrays(self.ids)
        one = lambda x, i: pa.ListArray.from_arrays(pa.array([0, len(x)] + [len(x)] * (n - 1), pa.int32()), x, mask=pa.array([False] + [True] * (n - 1))) if i else None
        runs = [(k, int(a), int(b)) for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
        n = 1 + len(runs)
        columns = [pa.array([self.number] * n, pa.int64()), pa.array([-1] + [k for k, _, _ in runs], pa.int32()), one(ids, 1)]
        for k, name in enumerate(COLUMNS):
            columns.append(one(pa.array([r[k] for r in self.rows], pa.string() if name == COLUMNS[-1] else pa.int64()), 1))
        blobs: list[list] = [[None], [None], [None], [None]]
        for _, a, b in runs:
            p = pairs[a:b]
            first = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
            for out, blob in zip(blobs, (_pack_pairs(p[first]), _pack_small(np.diff(np.r_[first, len(p)])), _pack_small(keys[a:b] & (CHUNK_ROWS - 1)), _pack_small(times[a:b])), strict=True):
                out.append(blob)
        return pa.RecordBatch.from_arrays([*columns, *(pa.array(x, pa.binary()) for x in blobs)], schema=schema)


def encode_runs(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(chunk, bucket, ids, figures as arrays, pairs, holders, docs, times): chunks' documents and runs."""
    kind = docs.schema[id_col].dataType.simpleString()
    figures = ", ".join(f"{c} array<{'string' if c == COLUMNS[-1] else 'long'}>" for c in COLUMNS)
    schema = f"chunk long, bucket int, ids array<{kind}>, {figures}, pairs binary, holders binary, docs binary, times binary"

    def scan(batches):
        made = aligner(a_path, b_path)
        first = (TaskContext.get().partitionId()) << 33
        number, chunk, bad, shape = 0, None, set(), None
        widest = made.per * made.b.size

        def flush():
            return chunk.output(shape, widest, bad)

        for batch in batches:
            if shape is None:
                lists = [pa.field("ids", pa.list_(batch.column(0).type)), *(pa.field(c, pa.list_(pa.string() if c == COLUMNS[-1] else pa.int64())) for c in COLUMNS)]
                shape = pa.schema([pa.field("chunk", pa.int64()), pa.field("bucket", pa.int32()), *lists, *(pa.field(c, pa.binary()) for c in ("pairs", "holders", "docs", "times"))])
            data, offsets = utf8(batch.column(1))
            i = 0
            while i < batch.num_rows:
                if chunk is None:
                    chunk, bad = Chunk(first + number), set()
                    number += 1
                # rows that fit in a block, or one longer row in parts
                j = min(max(int(np.searchsorted(offsets, offsets[i] + BLOCK, side="right")) - 1, i + 1), batch.num_rows, i + CHUNK_ROWS - len(chunk.rows))
                own = data[offsets[i] : offsets[j]]
                if j == i + 1 and len(own) > BLOCK and made.b.pieces and made.a.pieces:
                    rows = _long(made, chunk, own, bad)
                else:
                    rows = _short(made, chunk, own, offsets[i : j + 1] - offsets[i])
                chunk.rows += rows
                chunk.ids.append(batch.column(0).slice(i, j - i))
                chunk.size += len(own)
                i = j
                if chunk.size >= CHUNK or len(chunk.rows) >= CHUNK_ROWS:
                    yield flush()
                    chunk = None
        if chunk is not None:
            yield flush()

    given = F.when(F.length(text) > 0, F.concat(F.lit(" "), text)).otherwise("")
    return docs.select(F.col(id_col), given.alias("text")).mapInArrow(scan, schema)


_NONE = (0, 0, 0, 0, "")


def _short(made: Aligner, chunk: Chunk, data: np.ndarray, offsets: np.ndarray) -> list[tuple]:
    """Figures of a block of whole texts; their records go to the chunk."""
    if not len(data):
        return [_NONE] * (len(offsets) - 1)
    x = made.block(data, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1) + len(chunk.rows), x["n_links"])
    chunk.add(x["pairs"] << (CHUNK_ROWS.bit_length() - 1) | doc)
    whole, at = x["text"].tobytes(), x["bounds"].tolist()
    rows = []
    for k, figures in enumerate(zip(*(x[c].tolist() for c in COLUMNS[:-1]), strict=True)):
        rows.append((*figures, hashlib.sha256(whole[at[k] : at[k + 1] - 1]).hexdigest()) if figures[0] else _NONE)
    return rows


def _long(made: Aligner, chunk: Chunk, data: np.ndarray, bad: set[int]) -> list[tuple]:
    """Figures of one text that is looked at in parts."""
    total, digest, end = np.zeros(4, np.int64), hashlib.sha256(), b""
    for a, b in parts(data):
        x = made.block(data[a:b], np.array([0, b - a]))
        if not x["good"][0]:
            bad.add(len(chunk.rows))
            return [_NONE]
        chunk.add(x["pairs"] << (CHUNK_ROWS.bit_length() - 1) | len(chunk.rows))
        total += [int(x[c][0]) for c in COLUMNS[:-1]]
        digest.update(end + x["text"][:-1].tobytes())
        end = b";"
    return [(*total.tolist(), digest.hexdigest())]


def merge_runs(runs: list[tuple[np.ndarray, np.ndarray]], block: int = RUN_BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct pairs of sorted runs (pairs, counts) with their counts added up.

    A heap holds the last pair of each run's open block. Up to the least of them all open blocks are complete, so that
    much leaves every block, is added up and put out, and the runs whose block is used up open their next.
    """
    at = [0] * len(runs)
    heap = [(int(p[min(block, len(p)) - 1]), k) for k, (p, _) in enumerate(runs) if len(p)]
    heapq.heapify(heap)
    out_p, out_c = [], []
    while heap:
        limit = heap[0][0]
        taken = []
        for _, k in heap:
            p, c = runs[k]
            a = at[k]
            b = a + int(np.searchsorted(p[a : a + block], limit, side="right"))
            if b > a:
                taken.append((p[a:b], c[a:b]))
                at[k] = b
        p, c = (np.concatenate(x) for x in zip(*taken, strict=True))
        order = np.argsort(p, kind="stable")
        p, c = p[order], c[order]
        first = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
        out_p.append(p[first])
        out_c.append(np.add.reduceat(c, first))
        while heap and heap[0][0] <= limit:
            k = heapq.heappop(heap)[1]
            p = runs[k][0]
            if at[k] < len(p):
                heapq.heappush(heap, (int(p[min(at[k] + block, len(p)) - 1]), k))
    return (np.concatenate(out_p), np.concatenate(out_c)) if out_p else (np.zeros(0, np.int64),) * 2


def _merged(runs: DataFrame, groups: int) -> DataFrame:
    """One run (bucket, part, pairs, counts) for the runs of each bucket whose ``part`` is equal modulo ``groups``."""

    def merge(key, table):
        rows = zip(table.column("pairs").to_pylist(), table.column("counts").to_pylist(), strict=True)
        pairs, counts = merge_runs([(_open_pairs(p), _open_small(c)) for p, c in rows])
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int64()), "pairs": [_pack_pairs(pairs)], "counts": [_pack_small(counts)]})

    dealt = runs.select("bucket", F.pmod("part", F.lit(groups)).alias("part"), "pairs", "counts")
    return dealt.groupBy("bucket", "part").applyInArrow(merge, "bucket int, part long, pairs binary, counts binary")


def _with_best(merged: DataFrame, b_size: int) -> DataFrame:
    """Add to whole runs which pairs have the highest count of their A id."""

    def scan(batches):
        for batch in batches:
            best = []
            for p, c in zip(batch.column("pairs").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                side, counts = _open_pairs(p) // b_size, _open_small(c)
                first = np.flatnonzero(np.r_[True, side[1:] != side[:-1]])
                best.append(_squeeze(counts == np.repeat(np.maximum.reduceat(counts, first), np.diff(np.r_[first, len(side)]))))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("bucket", "part", "pairs", "counts")), pa.array(best, pa.binary())], names=["bucket", "part", "pairs", "counts", "best"])

    return merged.mapInArrow(scan, "bucket int, part long, pairs binary, counts binary, best binary")


def _shared_out(whole: DataFrame, below: DataFrame, groups: int) -> DataFrame:
    """The runs of ``below`` with the counts and marks that the merged runs ``whole`` have for their pairs."""

    def give(left, right):
        if not right.num_rows or not left.num_rows:
            return pa.table({"bucket": pa.array([], pa.int32()), "part": pa.array([], pa.int64()), "pairs": pa.array([], pa.binary()), "counts": pa.array([], pa.binary()), "best": pa.array([], pa.binary())})
        pairs, counts, best = _open_pairs(right.column("pairs")[0].as_py()), _open_small(right.column("counts")[0].as_py()), _open(right.column("best")[0].as_py(), bool)
        at = [np.searchsorted(pairs, _open_pairs(p)) for p in left.column("pairs").to_pylist()]
        return pa.table({"bucket": left.column("bucket"), "part": left.column("part"), "pairs": left.column("pairs"), "counts": [_pack_small(counts[x]) for x in at], "best": [_squeeze(best[x]) for x in at]})

    parts = below.select("bucket", "part", "pairs", F.pmod("part", F.lit(groups)).alias("up"))
    tops = whole.select("bucket", F.col("part").alias("up"), "pairs", "counts", "best")
    return parts.groupBy("bucket", "up").cogroup(tops.groupBy("bucket", "up")).applyInArrow(give, "bucket int, part long, pairs binary, counts binary, best binary")


def _contributions(runs: DataFrame, counted: DataFrame, groups: int) -> DataFrame:
    """(chunk, best, total) of each run: by document of the chunk, links that are best and the sum of counts."""

    def give(left, right):
        out: dict[str, list] = {"chunk": [], "best": [], "total": []}
        if left.num_rows and right.num_rows:
            pairs, counts, best = _open_pairs(right.column("pairs")[0].as_py()), _open_small(right.column("counts")[0].as_py()), _open(right.column("best")[0].as_py(), bool)
            for chunk, p, holders, docs, times in zip(*(left.column(c).to_pylist() for c in ("chunk", "pairs", "holders", "docs", "times")), strict=True):
                at = np.repeat(np.searchsorted(pairs, _open_pairs(p)), _open_small(holders))
                docs, times, c = _open_small(docs), _open_small(times), counts[at]
                total = np.zeros(int(docs.max()) + 1, np.int64)
                for k in (0, 20, 40):  # sums of doubles stay exact by 20 bits at a time
                    total += np.bincount(docs, (c >> k & 0xFFFFF) * times).astype(np.int64) << k
                out["chunk"].append(chunk)
                out["best"].append(_pack_small(np.bincount(docs, times * best[at]).astype(np.int64)))
                out["total"].append(_pack_small(total))
        return pa.table({"chunk": pa.array(out["chunk"], pa.int64()), "best": pa.array(out["best"], pa.binary()), "total": pa.array(out["total"], pa.binary())})

    mine = runs.select("bucket", "chunk", "pairs", "holders", "docs", "times", F.pmod(F.xxhash64("chunk"), F.lit(groups)).alias("up"))
    tops = counted.select("bucket", F.col("part").alias("up"), "pairs", "counts", "best")
    return mine.groupBy("bucket", "up").cogroup(tops.groupBy("bucket", "up")).applyInArrow(give, "chunk long, best binary, total binary")


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text: str = "text", fan: int = FAN) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of ``docs``.

    ``a_path`` is a byte-level vocabulary of the tokenizers library, encoding a blank and the text; ``b_path`` a piece model
    that adds the blank itself. Strings of special tokens are ordinary text. Null and empty texts, and texts that either
    tokenizer doesn't give back byte for byte, have zeros and an empty string, and hold no pair. Rows that repeat, or
    have no doc_id, are documents of their own. A text of any length is encoded whole, in parts that end where tokens of
    both end. Other columns of ``docs`` are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    a_path, b_path = a_path or tokenizer_path(), b_path or tokenizer_path("piece_bpe_32k.model")
    kind = docs.schema[id_col].dataType.simpleString()
    made = materialize(encode_runs(docs, a_path, b_path, id_col, text), "runs")
    rows, runs = made.where("bucket = -1"), made.where("bucket >= 0")
    sizes = [rows.count()]
    while not sizes[1:] or sizes[-1] > 1:
        sizes.append(max(1, -(-sizes[-1] // fan)))
    groups = sizes[1:]
    b_size = piece_encoder(b_path).size
    level = runs.select("bucket", F.pmod(F.xxhash64("chunk"), F.lit(groups[0])).alias("part"), "pairs", F.col("holders").alias("counts"))
    levels = []
    for n in groups:  # a part's number modulo the next number of groups is the part it is merged into
        level = materialize(_merged(level, n), "merged")
        levels.append(level)
    counted = _with_best(levels[-1], b_size)
    for below, n in zip(levels[-2::-1], groups[:0:-1], strict=True):
        counted = materialize(_shared_out(counted, below, n), "counted")
    gains = _contributions(runs, counted, groups[0])
    names = [*COLUMNS[:-1], "n_best", "count_sum", COLUMNS[-1]]

    def total(left, right):
        ids = left.column("ids")[0].values if left.num_rows else None
        n = len(ids) if ids is not None else 0
        sums = {"best": np.zeros(n, np.int64), "total": np.zeros(n, np.int64)}
        for c, x in sums.items():
            for blob in right.column(c).to_pylist():
                part = _open_small(blob)
                x[: len(part)] += part
        if ids is None:
            return None
        figures = {c: left.column(c)[0].values for c in COLUMNS} | {"n_best": pa.array(sums["best"]), "count_sum": pa.array(sums["total"])}
        return pa.table({"doc_id": ids} | {c: figures[c] for c in names})

    types = ", ".join(f"{c} {'string' if c == COLUMNS[-1] else 'long'}" for c in names)
    mine = rows.select("chunk", "ids", *COLUMNS)
    return mine.groupBy("chunk").cogroup(gains.groupBy("chunk")).applyInArrow(total, f"doc_id {kind}, {types}")
