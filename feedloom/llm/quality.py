"""Quality classifier: nearest labelled neighbours in a latent-semantic space vote, weighted by similarity.

Terms are pairs of neighbouring characters over 64 classes of bytes, and the kinds of neighbouring words (a word like the
one before, a word seen in capitals, a word that ends in a symbol). Counts of whole texts are damped by a logarithm,
weighted by inverse document frequency and brought to unit length; a truncated SVD of the labelled rows gives the space.
The labelled vectors, a bounded sample, are broadcast, and every document is compared with all of them by exact cosine
products in blocks.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm._shared import doc_chunks, release, ship, text_of, utf8
from feedloom.llm._words import LOWER, word_hashes

#: Labelled rows taken for each label at most: the bound of the fit and of the broadcast.
MOST_LABELLED = 2000
DIMENSIONS = 40
NEIGHBOURS = 25
#: Votes count by similarity to this power.
SHARPNESS = 8
THRESHOLD = 0.3
CLASSES = 64
KINDS = 8
TERMS = CLASSES * CLASSES + KINDS
#: How much a word kind's count weighs against a pair of characters.
KIND_WEIGHT = 6.0
CHUNK = 2_000_000


def _classes() -> np.ndarray:
    """Byte to class: capitals one class, digits one, lower-case letters and frequent signs their own."""
    out = np.full(256, 63, np.int64)
    out[65:91] = 0
    out[97:123] = np.arange(1, 27)
    out[48:58] = 27
    for i, c in enumerate(b" \n\t.,;:!?'\"-()[]{}<>/\\|*#$%&=+@_~^`"):
        out[c] = 28 + min(i, 33)
    out[0xC0:] = 62
    out[0x80:0xC0] = 61
    return out


_CLASS = _classes()
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_PLAIN = np.zeros(256, bool)
_PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256), *b".,;:'\"!?)-"]] = True


def term_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of TERMS for each text of an Arrow-like (bytes, offsets)."""
    n = len(offsets) - 1
    out = np.zeros((n, TERMS), np.float32)
    for i, j in doc_chunks(offsets, CHUNK):
        part = data[offsets[i] : offsets[j]]
        if not len(part):
            continue
        own = offsets[i : j + 1] - offsets[i]
        doc = np.repeat(np.arange(j - i), np.diff(own))
        c = _CLASS[part]
        same = doc[1:] == doc[:-1]
        pairs = ((doc[1:] * CLASSES + c[:-1]) * CLASSES + c[1:])[same]
        out[i:j, : CLASSES * CLASSES] = np.bincount(pairs, minlength=(j - i) * CLASSES * CLASSES).reshape(j - i, -1)
        cut = part.copy()
        joined = np.insert(cut, own[1:-1], 0x20) if j - i > 1 else cut
        shift = own + np.arange(len(own))
        h, starts, ends = word_hashes(joined)
        if not len(h):
            continue
        owner = np.searchsorted(shift, starts, side="right") - 1
        folded = word_hashes(LOWER[joined])[0]
        back1 = np.r_[False, (folded[1:] == folded[:-1]) & (owner[1:] == owner[:-1])]
        caps = np.r_[0, np.cumsum(_UPPER[joined])]
        capital = (caps[ends] - caps[starts]) * 2 > ends - starts
        signs = ~_PLAIN[joined[ends - 1]]
        lone = signs & (ends - starts == 1)
        long_word = ends - starts > 24
        kinds = (np.ones(len(h), bool), back1, capital & (ends - starts > 1), signs & ~lone, lone, long_word)
        base = CLASSES * CLASSES
        for k, flag in enumerate(kinds):
            out[i:j, base + k] = np.bincount(owner[flag], minlength=j - i)
        order = np.lexsort((folded, owner))
        fresh = np.r_[True, (np.diff(folded[order]) != 0) | (np.diff(owner[order]) != 0)]
        out[i:j, base + 6] = out[i:j, base] - np.bincount(owner[order][fresh], minlength=j - i)
    return out


def _weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Damped shares times idf, unit length; an empty text is the zero vector."""
    base = CLASSES * CLASSES
    x = counts.copy()
    pairs, words = x[:, :base], np.maximum(x[:, base : base + 1], 1)
    pairs *= 100 / np.maximum(pairs.sum(1, keepdims=True), 1)
    np.log1p(pairs, out=pairs)
    x[:, base:] *= KIND_WEIGHT / words
    x[:, base] = 0
    x *= idf
    x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-9)[:, None]
    return x


class Model:
    """The latent space and its labelled vectors; ``counts`` is overwritten."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray, dimensions: int = DIMENSIONS, seed: int = 7):
        seen = (counts > 0).sum(0)
        self.idf = np.log((1 + len(counts)) / (1 + seen)).astype(np.float32) + 1
        self.idf[CLASSES * CLASSES :] = 1
        x = counts
        for i in range(0, len(x), 256):  # in place: the driver holds the table once
            x[i : i + 256] = _weigh(x[i : i + 256], self.idf)
        d = min(dimensions, *x.shape)
        q = x @ np.random.default_rng(seed).standard_normal((x.shape[1], d + 8)).astype(np.float32)
        for _ in range(4):
            q = np.linalg.qr(x.T @ np.linalg.qr(q)[0])[0]
            q = x @ q
        left = np.linalg.qr(q)[0]
        self.axes = np.linalg.svd(left.T @ x, full_matrices=False)[2][:d].T.astype(np.float32)
        self.vectors, self.labels = self.project(x).astype(np.float32), labels.astype(np.float32)
        self.prior = float(labels.mean())

    def project(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.axes
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def score(self, counts: np.ndarray, block: int = 512) -> np.ndarray:
        """Share of the neighbours' votes for label 1; the prior where no neighbour is similar at all."""
        z = self.project(_weigh(counts, self.idf))
        out = np.empty(len(z))
        k = min(NEIGHBOURS, len(self.labels))
        for i in range(0, len(z), block):
            near = z[i : i + block] @ self.vectors.T
            top = np.argpartition(near, len(self.labels) - k, axis=1)[:, len(self.labels) - k :]
            w = np.maximum(np.take_along_axis(near, top, 1), 0).astype(float) ** SHARPNESS
            total = w.sum(1)
            out[i : i + block] = np.where(total > 1e-12, (w * self.labels[top]).sum(1) / np.maximum(total, 1e-12), self.prior)
        return np.clip(out, 0, 1)


def held_out(id_col: str = "doc_id"):
    """True for the fifth of the rows whose labels are never learnt: crc32 of the id as text is divisible by five."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def _features(rows: DataFrame, extra: list[str], schema: str) -> DataFrame:
    def scan(batches):
        for batch in batches:
            if batch.num_rows:
                counts = term_counts(*utf8(batch.column("text")))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in extra), pa.array([zlib.compress(c.tobytes(), 1) for c in counts], pa.binary())], names=[*extra, "counts"])
        release()

    return rows.mapInArrow(scan, schema)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", most: int = MOST_LABELLED) -> Model | None:
    """Fit on at most ``most`` labelled rows of each label: of the first ids in the order of a hash, the first rows.

    Rows of the held-out fifth and rows with a null id or label are not used; an id with several labels counts once for
    each. Of ids that ``docs`` repeats all rows are candidates, in the order of a hash of id and text, and the bound is on
    rows. None if nothing is labelled.
    """
    ship(docs.sparkSession)
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out("doc_id")).select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    there = usable.join(docs.select(F.col(id_col).cast(labels.schema["doc_id"].dataType).alias("doc_id")).distinct(), "doc_id", "left_semi")
    picked = [there.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for q in (0, 1)]
    sample = F.broadcast(picked[0].unionByName(picked[1]))
    rows = docs.select(F.col(id_col).cast(labels.schema["doc_id"].dataType).alias("doc_id"), text_of(text).alias("text"))
    order = Window.partitionBy("quality").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"))
    taken = rows.join(sample, "doc_id").withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= most)
    got = _features(taken.select("doc_id", "quality", "text"), ["doc_id", "quality"], f"doc_id {labels.schema['doc_id'].dataType.simpleString()}, quality int, counts binary").collect()
    if not got:
        return None
    got.sort(key=lambda r: (r[0], r[1], bytes(r[2])))
    counts = np.empty((len(got), TERMS), np.float32)
    for i, r in enumerate(got):
        counts[i] = np.frombuffer(zlib.decompress(bytes(r[2])), np.float32)
    return Model(counts, np.array([r[1] for r in got]))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Add ``held_out, score, predicted`` to every row of ``docs``; its own columns of these names are replaced.

    ``carry``: the columns of ``docs`` to return beside them, by default all; the id is always there.

    Only the text makes the score. Null and empty texts are compared like any other: as vectors they are zero, so they
    get the share of label 1 in the sample. Rows that repeat get equal scores, but for the
    rounding of single-precision products in other batches; without any labels all scores are 0.5.
    """
    model = fit(docs, labels, id_col, text)
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    kept = [f for f in docs.schema.fields if f.name not in ("held_out", "score", "predicted") and (carry is None or f.name in (*carry, id_col))]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    names = [f.name for f in kept]

    def scan(batches):
        model = shared.value
        for batch in batches:
            texts = batch.column(text)
            texts = pa.array(["" if t is None else t for t in texts.to_pylist()], pa.string()) if texts.null_count else texts
            score = model.score(term_counts(*utf8(texts))) if model is not None else np.full(batch.num_rows, 0.5)
            predicted = (score >= THRESHOLD).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(score), pa.array(predicted)], names=[*names, "score", "predicted"])
        release()

    out = docs.select(*dict.fromkeys([*names, text])).mapInArrow(scan, f"{schema}, score double, predicted int")
    return out.withColumn("held_out", held_out(id_col))
