"""Ranked lexical search: documents of each item are grouped by the mask of terms that they hold.

One pass over the documents keeps, for blocks of rows, only the postings of terms that some item has: (term, row, count),
beside the row's length, and counts what makes the collection's figures N, L and df. They fix every term's weight. A second pass
over those blocks, a small part of the texts, ranks: for an item, bitmaps of its terms over the block's rows are laid into
one mask a row, rows of equal masks are a group, and a mask's highest possible score is the sum of its terms' best parts
within the block. Groups are evaluated in descending order of that score until it falls below the k-th best score that
the task has found for the item so far; what comes after can't rank. A task passes on k rows an item at most, and a
window over items leaves the best k of all.

The items are a stated query set: their terms are broadcast in blocks of bounded size, with a ranking pass for each.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm._shared import materialize, ship, text_of, utf8
from feedloom.llm._words import LOWER, block_hashes

TOP = 50
#: Characters of items' texts in one broadcast block.
BLOCK_CHARS = 4_000_000
#: Rows, and postings, of a block of documents.
ROWS, POSTINGS = 1 << 15, 2_000_000
#: Bytes of text looked at together, or one longer text; longer words are hashed by themselves.
RUN, LONG_WORD = 1 << 21, 1 << 16
#: Rows evaluated at once to begin with, in whole groups.
FIRST = 256

_TERM = np.ones(256, bool)
_TERM[:0x30] = _TERM[0x3A:0x41] = _TERM[0x5B:0x61] = _TERM[0x7B:0x80] = False


def term_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the terms of texts that lie end to end; none crosses from one text to the next."""
    inside = _TERM[data]
    first = offsets[:-1][offsets[:-1] < len(data)]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    begins[first] = inside[first]
    last = first[first > 0] - 1
    ends[last] = inside[last]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sizes = ends - starts
    out = np.empty(len(starts), np.uint64)
    short = sizes <= LONG_WORD
    out[short] = block_hashes(data, starts[short], ends[short])
    for i in np.flatnonzero(~short):
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].data)
    return out


class Terms:
    """Numbers of a fixed list of distinct byte strings; hashes find candidates, bytes decide."""

    def __init__(self, terms: list[bytes]):
        data = np.frombuffer(b"".join(terms), np.uint8)
        ends = np.cumsum([len(t) for t in terms]).astype(np.int64)
        starts = np.r_[0, ends[:-1]].astype(np.int64)
        h = _hashes(data, starts, ends) if terms else np.zeros(0, np.uint64)
        self.order = np.argsort(h, kind="stable")
        self.h, self.data, self.starts, self.sizes = h[self.order], data, starts[self.order], (ends - starts)[self.order]
        self.twins = int(np.unique(self.h, return_counts=True)[1].max()) if terms else 0
        self.longest = int(self.sizes.max()) if terms else 0

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of the term in each span, -1 if it is none."""
        out = np.full(len(starts), -1, np.int32)
        sizes = ends - starts
        able = np.flatnonzero(sizes <= self.longest)
        if not len(able):
            return out
        h = _hashes(data, starts[able], ends[able])
        low = np.searchsorted(self.h, h)
        for step in range(self.twins):
            at = np.minimum(low + step, len(self.h) - 1)
            same = np.flatnonzero((self.h[at] == h) & (self.sizes[at] == sizes[able]) & (out[able] < 0))
            mine, theirs = able[same], at[same]
            equal = np.ones(len(same), bool)
            n = sizes[mine]
            for k in range(0, int(n.max()) if len(n) else 0):  # words are short: a byte of all of them at a time
                more = np.flatnonzero(n > k)
                equal[more] &= data[starts[mine[more]] + k] == self.data[self.starts[theirs[more]] + k]
            out[mine[equal]] = self.order[theirs[equal]]
        return out


def item_terms(items: list[str | None]) -> list[list[bytes]]:
    """The distinct terms of each text, sorted."""
    out = []
    for text in items:
        raw = LOWER[np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)]
        starts, ends = term_spans(raw, np.array([0, len(raw)]))
        whole = raw.tobytes()
        out.append(sorted({whole[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)}))
    return out


@dataclass
class Queries:
    """A block of items: their terms' numbers, and the list of terms."""

    items: list
    members: list[np.ndarray]
    terms: list[bytes]

    @staticmethod
    def of(rows: list[tuple]) -> Queries:
        by_item: dict = {}
        for item, text in rows:
            by_item.setdefault(item, set()).update(item_terms([text])[0])
        terms = sorted(set().union(*by_item.values()))
        number = {t: i for i, t in enumerate(terms)}
        return Queries(list(by_item), [np.array(sorted(number[t] for t in s), np.int64) for s in by_item.values()], terms)


_tables: dict[str, Terms] = {}  # of the block of items that a worker process looked for last

_POSTINGS = "ids array<{kind}>, sizes array<long>, terms array<int>, rows array<int>, counts array<int>, present array<int>, holders array<int>"


def postings(docs: DataFrame, terms: list[bytes], id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Blocks of rows that have terms: their ids and lengths in terms, and (term, row, count) of the given ``terms``,
    sorted by term and row, with the number of rows that hold each term."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    shared, key = spark.sparkContext.broadcast(terms), uuid.uuid4().hex

    def scan(batches):
        if key not in _tables:
            _tables.clear()
            _tables[key] = Terms(shared.value)
        table = _tables[key]
        ids, sizes, parts, rows, held = [], [], [], 0, 0
        names = ["ids", "sizes", "terms", "rows", "counts", "present", "holders"]

        def block():
            t, r, c = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(t, kind="stable")
            present, holders = np.unique(t, return_counts=True)
            lists = [pa.concat_arrays(ids), pa.array(np.concatenate(sizes)), pa.array(t[order]), pa.array(r[order]), pa.array(c[order]), pa.array(present), pa.array(holders.astype(np.int32))]
            one = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists]
            return pa.RecordBatch.from_arrays(one, names=names)

        for batch in batches:
            data, offsets = utf8(batch.column(1))
            data = LOWER[data]
            i = 0
            while i < batch.num_rows:
                j = min(max(int(np.searchsorted(offsets, offsets[i] + RUN, side="right")) - 1, i + 1), batch.num_rows, i + ROWS)
                own, part = offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]]
                starts, ends = term_spans(part, own)
                bounds = np.searchsorted(starts, own)
                n = np.diff(bounds)
                found = table.find(part, starts, ends)
                whose = np.repeat(np.arange(j - i, dtype=np.int64), n)
                keep = found >= 0
                width = max(1, len(table.h))
                both, count = np.unique(whose[keep] * width + found[keep], return_counts=True)
                some = np.flatnonzero(n)  # rows without terms rank nowhere
                place = np.cumsum(n > 0) - 1 + rows
                ids.append(batch.column(0).slice(i, j - i).take(pa.array(some)))
                sizes.append(n[some])
                parts.append(((both % width).astype(np.int32), place[both // width].astype(np.int32), count.astype(np.int32)))
                rows, held, i = rows + len(some), held + len(both), j
                if rows >= ROWS or held >= POSTINGS:
                    yield block()
                    ids, sizes, parts, rows, held = [], [], [], 0, 0
        if rows:
            yield block()

    return docs.select(F.col(id_col), text_of(text)).mapInArrow(scan, _POSTINGS.format(kind=kind))


def weights(n: int, df: dict[int, int], terms: int) -> np.ndarray:
    """floor(1000 ln((2 N + 2) / (2 df + 1))) of every term."""
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df.get(t, 0) + 1))) for t in range(terms)], np.int64)


class _Best:
    """The k best (score, id) of an item so far; equal scores by ascending id, null ids last."""

    def __init__(self, k: int):
        self.k, self.rows, self.least = k, [], 0

    def add(self, scores: list[int], ids: list) -> None:
        self.rows += [(-s, i is None, i) for s, i in zip(scores, ids, strict=True) if s > 0]
        if len(self.rows) >= self.k:  # sorted at k rows too: the last one is the bar from then on
            self.rows.sort(key=lambda r: (r[0], r[1], 0 if r[2] is None else r[2]))
            del self.rows[self.k :]
        self.least = -self.rows[-1][0] if len(self.rows) == self.k else 0


def rank_block(queries: Queries, w: np.ndarray, n_docs: int, n_terms: int, block: tuple, best: list[_Best]) -> int:
    """Take a block's rows into the items' best; the number of rows evaluated."""
    ids, sizes, terms, rows, counts = block
    m = 100 - 50 + (50 * sizes * n_docs) // n_terms
    part = w[terms] * ((1_000_000_000 * counts) // (1000 * counts + 20 * m[rows]))
    numbers = np.arange(len(queries.terms) + 1)
    bounds = np.searchsorted(terms, numbers)
    highest = np.zeros(len(queries.terms), np.int64)
    there = np.flatnonzero(np.diff(bounds))
    if len(there):
        highest[there] = np.maximum.reduceat(part, bounds[there])
    evaluated = 0
    for q, members in enumerate(queries.members):
        mine = members[highest[members] > 0]
        if not len(mine):
            continue
        words = -(-len(mine) // 64)
        masks = np.zeros((words, len(sizes)), np.uint64)
        for k, t in enumerate(mine.tolist()):
            masks[k // 64, rows[bounds[t] : bounds[t + 1]]] |= np.uint64(1 << (k % 64))
        hit = np.flatnonzero(masks.any(0))
        masks = masks[:, hit]
        order = np.lexsort(masks)
        masks = masks[:, order]
        starts = np.flatnonzero(np.r_[True, (masks[:, 1:] != masks[:, :-1]).any(0)])
        top = np.zeros(len(starts), np.int64)
        for k, t in enumerate(mine.tolist()):
            top += highest[t] * ((masks[k // 64, starts] >> np.uint64(k % 64)) & np.uint64(1)).astype(np.int64)
        groups = np.argsort(-top, kind="stable")
        lengths = np.diff(np.r_[starts, len(hit)])[groups]
        upto = np.cumsum(lengths)
        at, step = 0, FIRST
        while at < len(groups) and (top[groups[at]] >= best[q].least):
            end = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + step)) + 1
            end = min(max(end, at + 1), len(groups))
            # a group whose highest score is below the k-th best so far can't rank, and none after it
            end = min(end, int(np.searchsorted(-top[groups], -best[q].least, side="right")))
            chosen = groups[at:end]
            spread = np.repeat(starts[chosen] - np.r_[0, np.cumsum(lengths[at:end])[:-1]], lengths[at:end]) + np.arange(int(lengths[at:end].sum()))
            found = np.sort(hit[order[spread]])
            score = np.zeros(len(found), np.int64)
            for t in mine.tolist():
                own = rows[bounds[t] : bounds[t + 1]]
                place = np.minimum(np.searchsorted(own, found), len(own) - 1)
                score += np.where(own[place] == found, part[bounds[t] + place], 0)
            evaluated += len(found)
            good = np.flatnonzero((score > 0) & (score >= best[q].least))
            if len(good) > 4 * best[q].k:
                good = good[score[good] >= np.partition(score[good], len(good) - best[q].k)[len(good) - best[q].k]]
            best[q].add(score[good].tolist(), ids.take(pa.array(found[good])).to_pylist())
            at, step = end, step * 2
    return evaluated


def _item_blocks(items: DataFrame, block_chars: int) -> list[DataFrame]:
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total * 2 // block_chars)) if total > block_chars else 1
    return [items if n == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i) for i in range(n)]


def _ranked(found: DataFrame, stats: tuple[int, int, dict], queries: Queries, k: int, id_kind: str, item_kind: str, item_type) -> DataFrame:
    spark = found.sparkSession
    n_docs, n_terms, df = stats
    shared = spark.sparkContext.broadcast((queries, weights(n_docs, df, len(queries.terms))))

    def scan(batches):
        queries, w = shared.value
        best = [_Best(k) for _ in queries.items]
        ids_type = None
        for batch in batches:
            for i in range(batch.num_rows):
                ids, *rest = (batch.column(c)[i].values for c in range(5))
                ids_type = ids.type
                sizes, terms, rows, counts = (x.to_numpy().astype(np.int64) for x in rest)
                rank_block(queries, w, n_docs, n_terms, (ids, sizes, terms, rows, counts), best)
        for item, b in zip(queries.items, best, strict=True):
            if b.rows:
                columns = [pa.array([item] * len(b.rows), item_type), pa.array([r[2] for r in b.rows], ids_type), pa.array([-r[0] for r in b.rows], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["item_id", "doc_id", "score"])

    return found.select("ids", "sizes", "terms", "rows", "counts").mapInArrow(scan, f"item_id {item_kind}, doc_id {id_kind}, score long")


def search(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best rows of ``docs`` for each item_id of ``items(item_id, text)``.

    Terms are maximal runs of ASCII letters, digits and characters beyond ASCII, with only A-Z folded. Equal scores rank by
    ascending doc_id, null ids last; only scores above 0 rank, so an item without terms, or whose terms no document
    holds, has no rows. Null texts have no terms. Texts of one item_id are one item with the terms of all; a null item_id
    is an item too. Rows that repeat a doc_id rank each by itself. Other columns of both tables are not read. Empty
    tables give no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    ship(spark)
    id_kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    out = None
    for block in _item_blocks(items.select("item_id", "text"), block_chars):
        queries = Queries.of([tuple(r) for r in block.collect()])
        found = materialize(postings(docs, queries.terms, id_col, text), "postings")
        n_docs, n_terms = found.agg(F.sum(F.size("sizes")), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()
        held = found.select(F.explode(F.arrays_zip("present", "holders")).alias("x")).groupBy("x.present").agg(F.sum("x.holders"))
        df = {r[0]: r[1] for r in held.collect()}
        ranked = _ranked(found, (n_docs or 0, n_terms or 0, df), queries, k, id_kind, item_kind, to_arrow_type(items.schema["item_id"].dataType))
        out = ranked if out is None else out.unionByName(ranked)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
