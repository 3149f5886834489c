"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

The patterns are the runs of 13 consecutive words of every benchmark item, and whole items of fewer words. For the
patterns of one length a table of two-word blocks says how far the search may jump from a position; where the jump is
0, the bucket of that last block gives the patterns to compare, word by word. Documents stream through without a
shuffle; the benchmark is broadcast a block of bounded size at a time. One block holds any usual benchmark; a larger one
takes a pass over the documents for each block, whose hits are written beside the rows, so driver, broadcast and workers
hold one block at once.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm._shared import materialize, ship, text_of

WINDOW = 13
#: Characters of benchmark text in one broadcast block; a worker's tables take about 50 bytes for each.
BLOCK_CHARS = 4_000_000

#: Separators are all ASCII characters but letters and digits; A-Z become a-z; bytes above 0x7F belong to words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

COLUMNS = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Patterns:
    """Wu-Manber tables for each length of pattern, over numbers of words.

    Words of the patterns are numbered; a document's other words are -1. A pattern is four bytes a word in one string, a
    block of two words is one number, and a bucket lists the patterns that end in its block; bytes decide.
    """

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.number: dict[bytes, int] = {}
        self.names = sorted({item for item, _ in items})
        place = {name: i for i, name in enumerate(self.names)}
        found: dict[int, dict[bytes, int | tuple[int, ...]]] = defaultdict(dict)  # by length: pattern to its item or items
        for item, text in items:
            ids = np.array([self.number.setdefault(x, len(self.number)) for x in words(text)], "<i4")
            m, raw, own = min(window, len(ids)), ids.tobytes(), place[item]
            for i in range(len(ids) - m + 1 if m else 0):
                old = found[m].setdefault(raw[4 * i : 4 * (i + m)], own)
                if old != own and (isinstance(old, int) or own not in old):
                    found[m][raw[4 * i : 4 * (i + m)]] = (old, own) if isinstance(old, int) else (*old, own)
        self.base = len(self.number) + 1
        self.by_length = {m: self._tables(m, found.pop(m)) for m in sorted(found)}

    def _tables(self, m: int, owners: dict[bytes, int | tuple[int, ...]]) -> tuple[dict[int, int], dict[int, list[int]], bytes, list, int]:
        block, far = min(2, m), m - min(2, m) + 1
        shift: dict[int, int] = {}
        bucket: dict[int, list[int]] = {}
        rows = np.frombuffer(b"".join(owners), "<i4").reshape(-1, m)
        for end in range(block, m + 1):
            for key in np.unique(self.keys(rows[:, end - 2], rows[:, end - 1]) if block == 2 else rows[:, end - 1]).tolist():
                shift[key] = min(shift.get(key, far), m - end)
        last = self.keys(rows[:, m - 2], rows[:, m - 1]) if block == 2 else rows[:, m - 1]
        for p, key in enumerate(last.tolist()):
            bucket.setdefault(key, []).append(p)
        return shift, bucket, b"".join(owners), list(owners.values()), far

    def keys(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The numbers of two-word blocks; of blocks with an unknown word, numbers that no known block has."""
        return a.astype(np.int64) * self.base + b + 1

    def search(self, w: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans of words hit, and the items found."""
        found, items, n = [], set(), len(w)
        if not n or not self.by_length:
            return found, items
        number = self.number.get
        ids = np.fromiter([number(x, -1) for x in w], "<i4", n)
        raw, two = ids.tobytes(), [0, *self.keys(ids[:-1], ids[1:]).tolist()]
        for m, (shift, bucket, patterns, owners, far) in self.by_length.items():
            keys, at, get, size = two if m > 1 else ids.tolist(), m, shift.get, 4 * m
            while at <= n:
                key = keys[at - 1]
                jump = get(key, far)
                if not jump:
                    text = raw[4 * (at - m) : 4 * at]
                    for p in bucket[key]:
                        if patterns[size * p : size * (p + 1)] == text:
                            found.append((at - m, at))
                            own = owners[p]
                            items.update([self.names[own]] if isinstance(own, int) else [self.names[k] for k in own])
                            break  # patterns of a length differ
                    jump = 1
                at += jump
        return found, items


def merge_length(found: list[tuple[int, int]]) -> int:
    total, reach = 0, -1
    for a, b in sorted(found):
        total += max(0, b - max(a, reach))
        reach = max(reach, b)
    return total


def _digest(items: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def benchmark_blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> list[DataFrame]:
    """The benchmark in parts of about ``block_chars`` characters at most, split by a hash of the item."""
    total = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total * 2 // block_chars)) if total > block_chars else 1
    return [benchmark if n == 1 else benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) for i in range(n)]


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS, carry: list[str] | None = None) -> DataFrame:
    """Add ``n_words, n_hit, n_items, items_sha256, contaminated`` to every row of ``docs``.

    ``carry``: the columns of ``docs`` to return beside them, by default all.

    A document is contaminated when words inside an occurrence of a benchmark window are at least a twentieth of its
    words, and more than none. Null and empty texts have no words and are clean; items without words have no window; a
    null item_id counts as an item named by the empty string; repeated items and rows change nothing; an empty benchmark
    hits nothing. Columns of ``docs`` that have the names of results are replaced.
    """
    spark = docs.sparkSession
    ship(spark)
    names = [x.split()[0] for x in COLUMNS.split(", ")]
    keep = docs.drop(*[n for n in names if n != text])
    carried = [f for f in keep.schema.fields if f.name not in names and (carry is None or f.name in carry)]
    kept = [f.name for f in carried]
    state = "_hits"
    while state in docs.columns:
        state += "_"
    rows = keep.select(*dict.fromkeys([*kept, text]))
    *others, last = benchmark_blocks(benchmark, block_chars)
    if others:
        rows = rows.withColumn(state, F.lit(None).cast(_STATE))
    for block in others:
        table = _table(block)
        rows = materialize(_searched(rows, table, text, state, window, rows.columns, ""), "hits")
        table.unpersist()
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in carried), COLUMNS])
    return _searched(rows, _table(last), text, state, window, kept, schema)


_STATE = "struct<spans: array<struct<a: int, b: int>>, items: array<string>>"
_STATE_ARROW = pa.struct([("spans", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))), ("items", pa.list_(pa.string()))])
_built: dict[tuple[str, int], Patterns] = {}  # the tables of the block that a worker process searched last


def _table(block: DataFrame):
    items = block.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), text_of()).collect()
    return block.sparkSession.sparkContext.broadcast([tuple(r) for r in items])


def _searched(rows: DataFrame, table, text: str, state: str, window: int, kept: list[str], schema: str) -> DataFrame:
    """One block's search. With ``schema``, the columns ``kept`` and the results over all blocks; else ``rows``, with the
    hits of this block added to those in the column ``state``."""
    key = (uuid.uuid4().hex, window)
    given = state in rows.columns
    names = [x.split()[0] for x in COLUMNS.split(", ")]
    out_schema = schema or ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def scan(batches):
        if key not in _built:
            _built.clear()
            _built[key] = Patterns(table.value, window)
        patterns = _built[key]
        for batch in batches:
            states, out = [], defaultdict(list)
            earlier = batch.column(state).to_pylist() if given else [None] * batch.num_rows
            for t, old in zip(batch.column(text), earlier, strict=True):
                w = words(t.as_py() or "")
                found, items = patterns.search(w)
                if old:
                    found += [(s["a"], s["b"]) for s in old["spans"]]
                    items = items.union(old["items"])
                if not schema:
                    states.append({"spans": [{"a": a, "b": b} for a, b in found], "items": sorted(items)})
                    continue
                hit = merge_length(found)
                for name, value in zip(names, (len(w), hit, len(items), _digest(items), hit > 0 and 20 * hit >= len(w)), strict=True):
                    out[name].append(value)
            if not schema:
                columns = [batch.column(f) if f != state else pa.array(states, _STATE_ARROW) for f in kept]
                yield pa.RecordBatch.from_arrays(columns, names=kept)
                continue
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
            arrays = [pa.array(out[name], kind) for name, kind in zip(names, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(f) for f in kept), *arrays], names=[*kept, *names])

    return rows.mapInArrow(scan, out_schema)
