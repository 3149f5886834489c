"""Near duplicates by Jaccard similarity of word shingles: prefix filters under several global orders.

Two sets of sizes n whose intersection is at least PERCENT hundredths of their union share a token among the first
n - ceil(n * PERCENT / 100) + 1 of each, whatever order the tokens have, as long as all sets use the same. So a pair is a
candidate only if it shares a prefix token under every one of several orders. All orders put frequent tokens last, by a
table of counters of fixed size over all documents (tokens that fall on one counter add up, which makes an order no less
global), and break ties by different hashes. Frequent passages therefore end in no prefix unless a text has little else.

Sets that are equal are one class, told by a digest of 128 bits, and everything runs on classes.

1. The first order's prefixes are exploded; a token of more than one class is a list. The pairs of lists of at most FEW
   classes are taken as they are. In longer lists each class is paired with the list's least class only (a *star*). Both
   are linear in the lists.
2. Pairs must agree in size and in a bound (the tokens of a set are counted in BUCKETS buckets, and the counts of two sets
   can't differ by more than the sets do), then share tokens of the other orders' prefixes. What is left is verified on
   whole sets, which are made from the texts again for the classes that need them.
3. Components of the links found so far. Longer lists that still hold several components go on: all their pairs of
   classes in different components are tested by the filters of step 2 in blocks of BLOCK members, as arrays. First each
   class is verified with only the nearest by the bound that passes, in WAVES rounds, each over the components of the one
   before. What then still passes between different components is verified, all of it.

So no link between different components is lost, and a family of copies costs its members, not its pairs. A token is a
64-bit hash of its words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm._shared import doc_chunks, exchange_parts, materialize, ship, text_of, utf8
from feedloom.llm._words import LOWER, MIX1, mix, shingles, word_hashes
from feedloom.llm.graph import components

WIDTH = 4
PERCENT = 85
#: Counters of token frequency, and the slices in which tasks send them.
SLOTS, SLICES = 1 << 24, 64
#: Bits of the filter that tells which texts are fetched again.
FILTER_BITS = 1 << 26
#: Seeds of the orders; the first makes the lists.
ORDERS = (1, 2, 3)
BUCKETS = 128
#: Classes of a list whose pairs are all taken at once; members of a longer list compared as one block.
FEW, BLOCK = 8, 1024
WAVES = 1
#: Bytes of text hashed at once, or one longer text.
CHUNK = 2_000_000


def shingle_sets(column: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    """The ascending distinct shingle hashes of each text of an Arrow column without nulls."""
    data, offsets = utf8(column)
    for i, j in doc_chunks(offsets, CHUNK):
        own = offsets[i : j + 1] - offsets[i]
        joined = LOWER[np.insert(data[offsets[i] : offsets[j]], own[1:-1], 0x20)]
        h, starts, _ = word_hashes(joined)
        bounds = np.searchsorted(starts, own + np.arange(len(own)))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            yield np.unique(shingles(h[a:b], width))


def digest(tokens: np.ndarray) -> tuple[int, int]:
    """Two sums of mixed hashes: equal for equal sets, 128 bits in all."""
    a, b = mix(tokens).sum(dtype=np.uint64), mix(tokens * MIX1 + np.uint64(len(tokens))).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def prefix(tokens: np.ndarray, levels: np.ndarray, order: int, percent: int = PERCENT) -> np.ndarray:
    """The tokens of a set that come first in an order: rarest level first, then by a hash of the order's own."""
    n = len(tokens)
    most = n - -(-percent * n // 100) + 1
    if most >= n:
        return tokens
    seed = np.uint64(order * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    level = levels[(tokens & np.uint64(len(levels) - 1)).astype(np.int64)].astype(np.uint64)
    rank = level << np.uint64(56) | mix(tokens ^ seed) >> np.uint64(8)
    return tokens[np.argpartition(rank, most - 1)[:most]]


def token_levels(docs: DataFrame, text: str = "text", width: int = WIDTH, slots: int = SLOTS) -> np.ndarray:
    """The counts of each slot over the shingles of all documents, as 16 times their binary logarithm: ``slots`` bytes.

    Every task counts its own rows and sends SLICES compressed parts, which are added up by slice.
    """
    ship(docs.sparkSession)
    step = slots // SLICES

    def count(batches):
        total = np.zeros(slots, np.uint32)
        held, size = [], 0
        pack = zstandard.ZstdCompressor(1).compress

        def settle():
            at, n = np.unique(np.concatenate(held), return_counts=True)
            total[at] += n.astype(np.uint32)
            held.clear()

        for batch in batches:
            for tokens in shingle_sets(batch.column(0), width):
                held.append((tokens & np.uint64(slots - 1)).astype(np.int32))
                size += len(tokens)
                if size > 2_000_000:
                    settle()
                    size = 0
        if held:
            settle()
        if total.any():
            parts = [pack(total[k * step : (k + 1) * step].tobytes()) for k in range(SLICES)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(SLICES, dtype=np.int32)), pa.array(parts, pa.binary())], names=["slice", "counts"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                got = np.frombuffer(unpack(blob.as_py()), np.uint32)
                sums[k] = sums[k] + got if k in sums else got.astype(np.uint64)
        if sums:
            parts = [np.minimum(16 * np.log2(x + 1.0), 255).astype(np.uint8).tobytes() for x in sums.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(parts, pa.binary())], names=["slice", "levels"])

    counted = docs.select(text_of(text).alias("text")).mapInArrow(count, "slice int, counts binary")
    summed = counted.repartition(min(SLICES, exchange_parts(docs.sparkSession)), "slice").mapInArrow(add, "slice int, levels binary")
    out = np.zeros(slots, np.uint8)
    for k, blob in summed.collect():
        out[k * step : (k + 1) * step] = np.frombuffer(blob, np.uint8)
    return out


_HEADS = tuple(f"p{k}" for k in ORDERS[1:])


def _cards(docs: DataFrame, levels, id_col: str, text: str, width: int, percent: int) -> DataFrame:
    """(doc_id, text_hash, n, d1, d2, prefix, counts, p2, p3): of equal sets, a task gives the last ones with the first only."""
    kind = docs.schema[id_col].dataType.simpleString()

    def scan(batches):
        table, seen = levels.value, set()
        for batch in batches:
            sizes, ds, prefixes, counts, heads = [], [], [], [], [[] for _ in _HEADS]
            for tokens in shingle_sets(batch.column(2), width):
                d = digest(tokens)
                fresh = len(tokens) and d not in seen
                if fresh:
                    seen.add(d)
                sizes.append(len(tokens))
                ds.append(d)
                prefixes.append(prefix(tokens, table, ORDERS[0], percent).view(np.int64) if fresh else None)
                counts.append(np.minimum(np.bincount((tokens >> np.uint64(65 - BUCKETS.bit_length())).astype(np.int64), minlength=BUCKETS), 255).astype(np.uint8).tobytes() if fresh else None)
                for out, k in zip(heads, ORDERS[1:], strict=True):
                    out.append(prefix(tokens, table, k, percent).astype(np.uint32).tobytes() if fresh else None)
            two = np.array(ds, np.int64).reshape(-1, 2)
            made = [pa.array(sizes, pa.int64()), pa.array(two[:, 0]), pa.array(two[:, 1]), pa.array(prefixes, pa.list_(pa.int64())), *(pa.array(x, pa.binary()) for x in (counts, *heads))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["doc_id", "text_hash", "n", "d1", "d2", "prefix", "counts", *_HEADS])

    rows = docs.select(F.col(id_col), F.xxhash64(text_of(text)).alias("text_hash"), text_of(text).alias("text"))
    return rows.mapInArrow(scan, f"doc_id {kind}, text_hash long, n long, d1 long, d2 long, prefix array<long>, counts binary, " + ", ".join(f"{x} binary" for x in _HEADS))


def _text_filter(hashes: DataFrame) -> np.ndarray:
    """A bit for each text hash, by its lowest bits: FILTER_BITS bits whatever the number of rows."""
    at = F.pmod(F.col("text_hash"), F.lit(FILTER_BITS)) + 1  # the functions count from 1
    made = hashes.select(F.bitmap_bucket_number(at).alias("k"), F.bitmap_bit_position(at).alias("at")).groupBy("k").agg(F.bitmap_construct_agg("at").alias("bits"))
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for k, bits in made.collect():
        out[(k - 1) * 4096 : k * 4096] = np.frombuffer(bits, np.uint8)
    return out


def _sets(docs: DataFrame, wanted: DataFrame, text: str, width: int) -> DataFrame:
    """(cls, tokens) of the classes in ``wanted(cls, text_hash, n, d1, d2)``, made from the texts again."""
    bits = docs.sparkSession.sparkContext.broadcast(_text_filter(wanted))

    def scan(batches):
        mask, seen = bits.value, set()
        for batch in batches:
            at = batch.column(0).to_numpy() % FILTER_BITS
            there = np.flatnonzero(mask[at >> 3] >> (at & 7).astype(np.uint8) & 1)
            out: dict[str, list] = {x: [] for x in ("d1", "d2", "n", "tokens")}
            for tokens in shingle_sets(batch.column(1).take(pa.array(there)), width):
                d = digest(tokens)
                if d in seen or not len(tokens):
                    continue
                seen.add(d)
                for x, v in zip(out, (*d, len(tokens), tokens.tobytes()), strict=True):
                    out[x].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), [pa.int64()] * 3 + [pa.binary()], strict=True)], names=list(out))

    rows = docs.select(F.xxhash64(text_of(text)).alias("text_hash"), text_of(text).alias("text"))
    made = rows.mapInArrow(scan, "d1 long, d2 long, n long, tokens binary")
    return made.join(wanted.select("cls", "n", "d1", "d2"), ["n", "d1", "d2"]).dropDuplicates(["cls"]).select("cls", "tokens")


def _room(na: np.ndarray, nb: np.ndarray, ca: np.ndarray, cb: np.ndarray, percent: int) -> np.ndarray:
    """How far pairs are from being ruled out by their sizes and bucket counts; below 0, they are."""
    total = na + nb
    ok = np.minimum(na, nb) * 100 >= np.maximum(na, nb) * percent
    differ = np.abs(ca.astype(np.int16) - cb.astype(np.int16)).sum(-1, dtype=np.int64)
    return np.where(ok, (100 - percent) - differ * (100 + percent) / total, -1.0)


def _both(pairs: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """``pairs(a, b)`` with ``columns`` of both from ``table(cls, ...)``."""
    for side in ("a", "b"):
        pairs = pairs.join(table.select(F.col("cls").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns]), side)
    return pairs


def _filtered(pairs: DataFrame, keep: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
    def scan(batches):
        for batch in batches:
            if batch.num_rows:
                ok = pa.array(keep(batch), pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(ok) for c in ("a", "b")], names=["a", "b"])

    return pairs.mapInArrow(scan, "a long, b long")


def _arrays(batch: pa.RecordBatch, name: str, kind) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in batch.column(name).to_pylist()]


def _sift(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The ``pairs(a, b)`` that the bound and all other orders leave."""

    def bound(batch):
        sizes = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
        return _room(*sizes, *(np.stack(_arrays(batch, c, np.uint8)) for c in ("counts_a", "counts_b")), percent) >= 0

    def orders(batch):
        ok = np.ones(batch.num_rows, bool)
        for head in _HEADS:
            x, y = _arrays(batch, f"{head}_a", np.uint32), _arrays(batch, f"{head}_b", np.uint32)
            for i in np.flatnonzero(ok):
                ok[i] = len(np.intersect1d(x[i], y[i])) > 0
        return ok

    near = _filtered(_both(pairs, classes, ["n", "counts"]), bound)
    return _filtered(_both(near, classes, list(_HEADS)), orders)


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links among ``pairs(a, b)``, by whole sets."""

    def test(batch):
        ok = []
        for x, y in zip(_arrays(batch, "tokens_a", np.uint64), _arrays(batch, "tokens_b", np.uint64), strict=True):
            both = np.sort(np.concatenate([x, y]), kind="stable")
            shared = int((both[1:] == both[:-1]).sum())
            ok.append(100 * shared >= percent * (len(both) - shared))
        return np.array(ok)

    return _filtered(_both(pairs, sets, ["tokens"]), test)


def _block_pairs(lists: DataFrame, classes: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """(a, b) that may link, of different components, from ``lists(token, members, least, cls, component)``.

    Blocks of a list meet each other block once; the pairs of a list's least class are left out, they were tested. With
    ``nearest``, of a class's pairs in a block only the nearest by the bound.
    """
    fields = ["cls", "component", "n", "counts", *_HEADS]
    full = lists.where("cls <> least").join(classes, "cls")
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("cls"), blocks).cast("int")
    packed = full.groupBy("token", block.alias("block")).agg(F.collect_list(F.struct(*fields)).alias("rows"))
    a, b = packed.select("token", F.col("block").alias("i"), F.col("rows").alias("a")), packed.select("token", F.col("block").alias("j"), F.col("rows").alias("b"))

    def arrays(rows):
        take = lambda f: [r[f] for r in rows]
        return np.array(take("cls")), np.array(take("component")), np.array(take("n")), np.array([np.frombuffer(x, np.uint8) for x in take("counts")]), [[np.frombuffer(x, np.uint32) for x in take(h)] for h in _HEADS]

    def meet(batches):
        for batch in batches:
            out_a, out_b = [], []
            for i, j, left, right in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                x = arrays(left)
                y = x if i == j else arrays(right)
                for k in range(len(x[0])):
                    may = y[1] != x[1][k]
                    if i == j:
                        may[: k + 1] = False
                    at = np.flatnonzero(may)
                    room = _room(x[2][k], y[2][at], x[3][k], y[3][at], percent)
                    for m in at[np.argsort(-room, kind="stable")[: int((room >= 0).sum())]]:
                        if all(len(np.intersect1d(p[k], q[m])) for p, q in zip(x[4], y[4], strict=True)):
                            out_a.append(x[0][k])
                            out_b.append(y[0][m])
                            if nearest:
                                break
            one, two = np.array(out_a, np.int64), np.array(out_b, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two))], names=["a", "b"])

    met = a.join(b, "token").where("i <= j")
    return met.select("i", "j", "a", F.when(F.col("i") < F.col("j"), F.col("b")).alias("b")).mapInArrow(meet, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT, slots: int = SLOTS, watch: Callable[[str, DataFrame], None] | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id): the class of every row of ``docs``.

    Texts are folded from A-Z to a-z and cut at white space; a text of fewer words than ``width`` is one shingle. Two rows
    link when 100 * intersection >= ``percent`` * union of their sets. ``component_id`` is the least doc_id that can be
    reached. Null and empty texts have no shingles and link with nothing, also not with each other: their component is
    their own id. Rows that repeat a doc_id keep a row each; a null doc_id takes part in links, and component_id is null
    only if all ids of the component are. An empty table gives no rows; columns of ``docs`` beside the two named are not
    read. ``watch`` is called with the name and the rows of what the filters pass on.
    """
    spark = docs.sparkSession
    ship(spark)
    levels = spark.sparkContext.broadcast(token_levels(docs, text, width, slots))
    cards = materialize(_cards(docs, levels, id_col, text, width, percent).withColumn("key", F.monotonically_increasing_id()), "cards")
    same = ["n", "d1", "d2"]
    # the prefixes stay with the first row of a set in each task; the class is the least key, whose row has them
    classes = materialize(cards.where("n > 0").groupBy(*same).agg(F.min("key").alias("cls"), F.min("doc_id").alias("least_id")), "classes")
    ids = classes.select("cls")
    heads = cards.where("prefix IS NOT NULL").withColumnRenamed("key", "cls")
    postings = heads.select("cls", "prefix").join(ids, "cls", "left_semi").select(F.explode("prefix").alias("token"), "cls").repartition("token")
    lists = postings.groupBy("token").agg(F.count("*").alias("members"), F.min("cls").alias("least")).where("members > 1")
    live = materialize(postings.join(lists, "token"), "lists")
    few, many = live.where(F.col("members") <= FEW), live.where(F.col("members") > FEW)
    all_pairs = few.select("token", F.col("cls").alias("a")).join(few.select("token", F.col("cls").alias("b")), "token").where("a < b").select("a", "b")
    star = many.where("cls <> least").select(F.col("least").alias("a"), F.col("cls").alias("b"))
    figures = heads.select("cls", "n", "counts", *_HEADS)
    sifted = materialize(_sift(all_pairs.unionByName(star).distinct(), figures, percent), "pairs")
    needed = sifted.select(F.explode(F.array("a", "b")).alias("cls")).unionByName(many.select("cls")).distinct()
    wanted = materialize(needed.join(cards.select(F.col("key").alias("cls"), "text_hash", *same), "cls"), "wanted")
    sets = materialize(_sets(docs, wanted, text, width), "sets")
    first = materialize(_verify(sifted, sets, percent), "links")
    links, tried = first, []
    for wave in range(WAVES + 1):
        so_far = components(links)
        placed = many.join(so_far, F.col("cls") == F.col("id"), "left").select("token", "members", "least", "cls", F.coalesce("component", "cls").alias("component"))
        mixed = placed.where("cls <> least").groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
        rest = placed.join(mixed.select("token"), "token", "left_semi")
        tried.append(materialize(_block_pairs(rest, figures, percent, nearest=wave < WAVES), "pairs"))
        if tried[-1].isEmpty():
            break
        so_far = None
        links = materialize(links.unionByName(_verify(tried[-1], sets, percent)), "links")
    if watch:
        for name, df in (("lists", lists), ("few", all_pairs), ("star", star), ("sifted", sifted), ("sets", sets), ("links", first), *((f"wave {k}", x) for k, x in enumerate(tried)), ("all links", links)):
            watch(name, df)
    joined = components(links) if so_far is None else so_far
    final = ids.join(joined, F.col("cls") == F.col("id"), "left").select("cls", F.coalesce("component", "cls").alias("component"))
    labels = classes.join(final, "cls").join(final.join(classes, "cls").groupBy("component").agg(F.min("least_id").alias("component_id")), "component")
    matched = cards.join(labels.select(*same, "component_id"), same, "left")
    return matched.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
