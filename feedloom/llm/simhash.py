"""SimHash near-duplicates through tables of distances to reference fingerprints (pivots).

Linked fingerprints differ in at most RADIUS = 2 of 64 bits, so by the triangle inequality their distances to any
reference differ by at most 2. Two groups of references are used.

*Grid references*: the zero fingerprint and, for each of the 32 pairs of bits, the fingerprint with just that pair set.
From the distances d(f, 0) and d(f, r_j) follows c_j = (d(f, 0) + 2 - d(f, r_j)) / 2, the ones of f within pair j. The
32 small numbers c_j, packed in a long, are the cell of f in the distance table. Fingerprints at distance at most 2 have
cells that are at most two unit steps apart, and so have a common cell among their own and those one step away. Each
distinct fingerprint is put in those cells, 49 on average, and only fingerprints that meet in a cell are compared.

*Spread references*: eight fixed fingerprints. Their distances are computed once for each fingerprint, packed in a long
and carried along. A pair that meets is discarded when any of these coordinates differs by more than 2; the pairs that
remain are verified by counting bits.

A cell with more than CROWD members (a large family of near copies) would emit all its pairs. Its members are linked
exactly in another way: each goes to the 65 fingerprints within one bit of it, and all that meet in one are, by that,
within two bits; a link to the least of them keeps their components. That is linear in the members.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm._shared import exchange_parts, materialize, release, ship, text_of
from feedloom.llm.graph import components

WIDTH = 3
SEED = 42
#: The exact method above holds for this radius.
RADIUS = 2
#: Members of a cell beyond which it is linked through single-bit neighbours instead of pairs.
CROWD = 24
#: Shingles hashed at once, which bounds memory on very long texts.
BLOCK = 200_000

#: The spread references, successive outputs of splitmix64 from state 0.
REFERENCES = (0xE220A8397B1DCDAF, 0x6E789E6AA1B965F4, 0x06C45D188009454F, 0xF88BB8A8724C81EC, 0x1B39896A51A8749B, 0x53CB9F0C747EA2EA, 0x2C829ABE1F4532E1, 0xC584133AC916AB3C)

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprint(text: str) -> int:
    """SimHash of a text as an unsigned 64-bit integer; 0 if it has no words."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    n = max(1, len(w) - WIDTH + 1)
    lengths = np.fromiter(map(len, w), np.int64, len(w))
    starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    ends = (starts + lengths)[min(WIDTH, len(w)) - 1 :].tolist()
    line, starts = b" ".join(w), starts[:n].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        h = np.array([digest(line[a:b], SEED) for a, b in zip(starts[at : at + BLOCK], ends[at : at + BLOCK], strict=True)], np.uint64)
        octets = h.view(np.uint8).reshape(-1, 8)
        for k in range(8):
            counts[8 * k : 8 * k + 8] += np.bincount(octets[:, k], minlength=256) @ _BITS
    return int(((2 * counts > n).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp long): a row for each row of ``docs``; null and empty texts have fingerprint 0."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def scan(batches):
        for batch in batches:
            fp = [fingerprint(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fp, np.uint64).view(np.int64))], names=["doc_id", "fp"])
        release()

    return docs.select(F.col(id_col), text_of(text)).mapInArrow(scan, f"doc_id {kind}, fp long")


def _cells(fp: Column) -> Column:
    """The cell of a fingerprint in the distance table and those one unit step away within the grid."""
    low = F.lit(0x5555555555555555)
    a, b = fp.bitwiseAND(low), F.shiftrightunsigned(fp, 1).bitwiseAND(low)
    at = a.bitwiseXOR(b).bitwiseOR(F.shiftleft(a.bitwiseAND(b), 1))  # a + b in every pair of bits
    steps = [at]
    for j in range(32):  # 0 to 1 and back flips a pair's low bit, 1 to 2 and back flips both
        c = F.shiftrightunsigned(at, 2 * j).bitwiseAND(F.lit(3))
        steps += [F.when(c < 2, at.bitwiseXOR(F.lit(_signed(1 << (2 * j))))), F.when(c > 0, at.bitwiseXOR(F.lit(_signed(3 << (2 * j)))))]
    return F.array_compact(F.array(*steps))


def _table(fp: Column) -> Column:
    """Distances to the spread references, eight bits each."""
    packed = F.lit(0).cast("long")
    for k, r in enumerate(REFERENCES):
        packed = packed.bitwiseOR(F.shiftleft(F.bit_count(fp.bitwiseXOR(F.lit(_signed(r)))).cast("long"), 8 * k))
    return packed


def _near(a: Column, b: Column) -> Column:
    """No coordinate of two distance tables differs by more than the radius."""
    ok = F.lit(True)
    for k in range(len(REFERENCES)):
        x, y = (F.shiftrightunsigned(c, 8 * k).bitwiseAND(F.lit(127)) for c in (a, b))
        ok = ok & (F.abs(x - y) <= RADIUS)
    return ok


def links(fps: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(a, b): links between distinct fingerprints ``fps(fp long)`` that keep the components of "differ in <= 2 bits".

    Every pair that meets in a cell of at most ``crowd`` members is tested; the members of fuller cells are linked
    through their single-bit neighbours. No pair within the radius is lost from its component.
    """
    ship(fps.sparkSession)
    # a fingerprint becomes 49 rows with its cells, so adaptive execution must not join the parts that are small before;
    # dealt by the key they already have, the exchange would be left out
    spread_out = fps.repartition(exchange_parts(fps.sparkSession), F.xxhash64("fp"))
    placed = spread_out.select("fp", _table(F.col("fp")).alias("table"), F.explode(_cells(F.col("fp"))).alias("cell"))
    met = placed.groupBy("cell").agg(F.count("*").alias("members")).where("members > 1")
    # Spark takes exploded rows to be as large as the rows before and would broadcast them: these joins are by merge
    live = materialize(placed.hint("merge").join(met, "cell"), "cells")
    few = live.where(F.col("members") <= crowd)
    a, b = few.select("cell", F.col("fp").alias("a"), F.col("table").alias("ta")), few.select("cell", F.col("fp").alias("b"), F.col("table").alias("tb"))
    tested = a.hint("merge").join(b, "cell").where("a < b").where(_near(F.col("ta"), F.col("tb"))).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)
    crowded = live.where(F.col("members") > crowd).select("fp").distinct()
    near = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << j))) for j in range(64)])
    spread = crowded.select("fp", F.explode(near).alias("key"))
    least = spread.groupBy("key").agg(F.min("fp").alias("b"), F.max("fp").alias("most")).where("b < most")
    starred = spread.hint("merge").join(least, "key").where("fp <> b").select(F.col("fp").alias("a"), "b")
    return tested.select("a", "b").unionByName(starred).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id): the class of every row of ``docs``.

    ``component_id`` is the least doc_id that can be reached over links of at most two differing bits. Null and empty
    texts have fingerprint zero and are linked like any other. Rows that repeat a doc_id keep a row each. A row with a
    null doc_id takes part in links; if all of a component's ids are null, component_id is null. An empty table gives
    no rows. Copies are joined to their fingerprint, never to each other.
    """
    fps = materialize(fingerprints(docs, id_col, text), "fingerprints")
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    joined = components(links(distinct.select("fp")))
    named = distinct.join(joined, F.col("fp") == F.col("id"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    labels = named.where("component <> fp").join(ids, "component").select("fp", "component_id")
    own = ids.select(F.col("component").alias("fp"), "component_id")
    return fps.join(labels.unionByName(own), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component of near duplicates: one of the least doc_id, columns kept.

    Rows are told apart by a key written once with them, not by doc_id: of rows that repeat the least doc_id of a
    component one stays, whatever other components the doc_id is in. Null ids come last, so a row with a null doc_id
    stays only if all ids of its component are null, and then one of them does.
    """
    rows = materialize(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("key")), "rows")
    row_id = F.col("row")[id_col]
    order = F.struct(row_id.isNull().alias("none"), row_id.alias("id"), F.col("key").alias("key"))
    classes = near_duplicates(rows.select(order.alias("order"), F.col("row")[text].alias("text")), "order", "text")
    stay = classes.where(F.col("doc_id.key") == F.col("component_id.key")).select("doc_id.key")
    return rows.join(stay, "key", "left_semi").select("row.*")
