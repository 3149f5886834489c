"""Bottom-k sketches of documents: the k least distinct 64-bit hashes of their five-word shingles.

Sketches of parts merge into the sketch of the whole: the k least of both. Two sketches estimate resemblance,
containment, and one the number of distinct shingles.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm._shared import exchange_parts, range_ids, ship, text_of
from feedloom.llm._words import LOWER, shingles, word_hashes

K = 128
WIDTH = 5


def sketch(text: str, k: int = K, width: int = WIDTH) -> np.ndarray:
    """The k least distinct shingle hashes, ascending; A-Z count as a-z. A text of fewer words is one shingle."""
    data = LOWER[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    h = shingles(word_hashes(data)[0], width)
    if len(h) > 4 * k:
        for room in (2 * k, 16 * k):
            least = np.unique(np.partition(h, min(room, len(h) - 1))[:room])
            if len(least) >= k:
                return least[:k]
    return np.unique(h)[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of two parts taken together."""
    return np.unique(np.concatenate((a, b)))[:k]


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[-1]) + 1) / 2.0**64)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated shared part of all distinct shingles; 1 for two empty sketches, 0 if only one is empty."""
    if not len(a) and not len(b):
        return 1.0
    both = merge(a, b, k)
    return len(np.intersect1d(np.intersect1d(a, b, True), both, True)) / len(both)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated part of a's distinct shingles that b has too."""
    if not len(a):
        return 1.0
    if len(a) < k and len(b) < k:
        return len(np.intersect1d(a, b, True)) / len(a)
    return min(1.0, resemblance(a, b, k) * distinct(merge(a, b, k), k) / distinct(a, k))


def encode(a: np.ndarray) -> str:
    return a.astype(">u8").tobytes().hex()


def decode(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u8").astype(np.uint64)


def edit(text: str, following: str) -> str:
    """The last quarter of the text's code points replaced by as many of the next text's first."""
    m = len(text) // 4
    return text[: len(text) - m] + following[:m]


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Sketches of every document and of its edited text, with their likeness and that to the next document.

    Documents follow each other in ascending doc_id; after the last comes the first. One exchange deals them into
    ranges of doc_id; the smallest document of each range goes to the range before as well, as a guest, so every task
    has the successor of its last document. Null texts are empty; rows with a null id come first; rows that repeat an
    id follow in the order of their texts; a single row is its own successor; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    n = exchange_parts(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text).alias("text"))
    dealt, firsts = range_ids(rows, "doc_id", n)
    nulls = rows.where("doc_id IS NULL").limit(1).count()
    guests = [(None if part == 0 and nulls else first, firsts[i - 1][0]) for i, (part, first) in enumerate(firsts)]
    guests = spark.createDataFrame(guests, f"_first {kind}, _before int")  # a row for each part at most
    home = F.struct(F.col("_part").alias("part"), F.lit(0).alias("guest"))
    visit = F.struct(F.col("_before").alias("part"), F.lit(1).alias("guest"))
    visits = F.when(F.col("_before").isNull(), F.array(home)).otherwise(F.array(home, visit))
    dealt = dealt.join(F.broadcast(guests), F.col("doc_id").eqNullSafe(F.col("_first")), "left")
    spread = dealt.withColumn("_visit", F.explode(visits)).select("doc_id", "text", F.col("_visit.part").alias("_part"), F.col("_visit.guest").alias("guest"))
    spread = spread.repartitionById(n, "_part").sortWithinPartitions("guest", "doc_id", "text")

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def line(doc_id, text, own, following, next_own):
        edited = edit(text, following)
        changed = sketch(edited)
        digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        return doc_id, len(text), digest, encode(own), encode(changed), resemblance(own, changed), resemblance(own, next_own)

    def scan(batches):
        held = None
        done = False
        for batch in batches:
            out = []
            for doc_id, t, guest in zip(batch.column("doc_id"), batch.column("text"), batch.column("guest").to_pylist(), strict=True):
                if done:
                    continue
                t = t.as_py()
                own = sketch(t)
                if held is not None:
                    out.append(line(*held, t, own))
                held, done = (doc_id.as_py(), t, own), guest > 0
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.column(0).type), *map(pa.array, cols[1:])], names=names)

    return spread.mapInArrow(scan, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
