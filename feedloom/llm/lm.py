"""Language-model scores: a causal self-attention model on subword ids, and add-one unigrams of whole words.

*Rows.* The OWN most frequent subword ids of the training documents have an embedding row each, all others share HASHED
rows by a hash of the id. Rows are sorted by the leading directions of what follows them, by halves, into GROUPS groups of
SLOTS rows that come in like contexts.

*Models.* One layer of causal self-attention; the id within a shared row is an add-one estimate over all training
documents that does not depend on the context. The values of ``"distributions"``, which is what documents are scored by
unless another model is asked for, are distributions of the next row (``attend.py``). Those of ``"states"`` are, as its
queries and keys, projections of the embeddings: HEADS heads have a bias for each distance, their output is added to the
token's own embedding, and from the sum follow the probability of the next token's group, and that of its row within the
group, each by a softmax. It takes about four times as long, and predicts better where a part learns from some millions
of tokens or more (README).

*Windows.* Every document is laid out from a multiple of STEP on; a window is the STEP positions scored and the STEP
before them, so windows overlap by half, each token is scored once, with STEP to 2 STEP - 1 tokens of context where the
document has them, and a text's score does not depend on what it is batched with.

*Training.* Counts of ids, of pairs of rows within windows and of words cover all training documents. The values of
``"distributions"`` are made of the pairs; the embeddings and the output rows of ``"states"`` start from a truncated
singular value decomposition of the counts of rows in a row. Then every window of every training document is learnt from once, in one of ROUNDS rounds, which its document's key decides. In every part, Adam runs over the
round's windows and the parts' weights are averaged, by parameter, in Spark; the weights depend on the number of parts.

*Base.* Words are compared by 64-bit hashes. The HEAD most frequent words are broadcast, a table of fixed size; all
other words of the documents are joined to the full counts.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm import attend
from feedloom.llm._encode import encoder, tokenizer_path
from feedloom.llm._shared import doc_chunks, exchange_parts, materialize, ship, text_of, utf8
from feedloom.llm._words import LOWER, mix, word_hashes
from feedloom.operators.vectors import vector_sum

OWN, HASHED = 896, 128
GROUPS, SLOTS = 32, 32
ROWS = GROUPS * SLOTS
HEADS, WIDTH = 2, 32
KEY, VALUE = 8, 16
STEP = 16
ROUNDS = 2
#: Adam's rate by model.
RATES = {"distributions": 0.04, "states": 0.002}
HEAD = 200_000
#: Windows scored, and windows of a training step, at once.
BATCH, STEPS_OF = 256, 192
#: Rows of the counts of pairs that are summed as one value.
SLICE = 4
#: Distinct words a task holds before it passes their counts on.
HELD = 800_000
#: The hash that stands for the end of a text among word hashes.
END_WORD = np.uint64(0x5EED0F7E87E0D001)
CHUNK = 8_000_000


def held_out(id_col: str = "doc_id") -> Column:
    """True for the seventh of the rows that nothing is learnt from: crc32 of the id as text leaves 2 when divided by 7."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


# ---- ids and their bytes -----------------------------------------------------------------------------------------


@lru_cache(1)
def vocabulary(path: str) -> tuple[np.ndarray, np.ndarray, int]:
    """(bytes of all ids in a row, offsets, end id)."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the alphabet of byte-level vocabularies
    other = [b for b in range(256) if b not in set(plain)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
    tok = encoder(path).tokenizer
    end = tok.token_to_id("<|endoftext|>")
    parts = [b"" if i == end else bytes(byte_of[c] for c in tok.id_to_token(i)) for i in range(tok.get_vocab_size())]
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate(([0], np.cumsum([len(p) for p in parts]))), end


def decode_bytes(ids: np.ndarray, path: str) -> np.ndarray:
    """The bytes that the ids stand for."""
    table, offsets, _ = vocabulary(path)
    sizes = np.diff(offsets)[ids]
    ends = np.cumsum(sizes)
    shift = np.repeat(offsets[ids] - (ends - sizes), sizes)
    return table[shift + np.arange(len(shift))]


def rows_of(counts: np.ndarray, path: str) -> np.ndarray:
    """Embedding row of each id: the end and the most frequent ids alone, the others by a hash."""
    end = vocabulary(path)[2]
    ids = np.arange(len(counts), dtype=np.uint64)
    out = OWN + (mix(ids + np.uint64(1)) % np.uint64(HASHED)).astype(np.int64)
    frequent = np.argsort(-counts, kind="stable")
    frequent = frequent[frequent != end][: OWN - 1]
    out[frequent] = 1 + np.arange(len(frequent))
    out[end] = 0
    return out


# ---- the model ---------------------------------------------------------------------------------------------------

_Q, _K = HEADS * KEY, 2 * HEADS * KEY
SHAPES = {
    "emb": (ROWS, WIDTH),
    "project": (WIDTH, _K + HEADS * VALUE),
    "place": (HEADS, 2 * STEP),
    "mix": (HEADS * VALUE, WIDTH),
    "group": (WIDTH, GROUPS),
    "group_bias": (GROUPS,),
    "slot": (ROWS, WIDTH),
    "slot_bias": (ROWS,),
}
PARAMETERS = sum(int(np.prod(s)) for s in SHAPES.values())
_DISTANCE = np.maximum(np.arange(STEP)[:, None] + STEP - np.arange(2 * STEP)[None], 0)
_CAUSAL = (np.arange(STEP)[:, None] + STEP >= np.arange(2 * STEP)[None]).astype(np.float32)
_MOST = 60.0  # exponentials are taken of at most this, and at least its negative
_ONES = np.ones((max(SLOTS, GROUPS), 1), np.float32)


def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in SHAPES.items():
        size = int(np.prod(shape))
        out[name] = flat[at : at + size].reshape(shape)
        at += size
    return out


def grouped(pairs: np.ndarray) -> np.ndarray:
    """A permutation of the rows, position to row: halved again and again at the median of their leading direction.

    ``pairs[a, b]`` counts row b after row a. Rows that follow the same rows come into the same group.
    """
    seen = pairs / np.sqrt((pairs.sum(1, keepdims=True) + 1) * (pairs.sum(0) + 1))
    parts = [np.arange(len(pairs))]
    while len(parts) < GROUPS:
        halves = []
        for rows in parts:
            m = seen[:, rows]
            m = m - m.mean(1, keepdims=True)
            lead = np.linalg.eigh(m.T @ m)[1][:, -1]
            order = rows[np.argsort(lead * np.sign(lead[np.abs(lead).argmax()]), kind="stable")]
            halves += [order[: len(order) // 2], order[len(order) // 2 :]]
        parts = halves
    return np.concatenate(parts)


def start_weights(pairs: np.ndarray, seed: int = 3) -> np.ndarray:
    """Weights whose scores are a low-rank fit of the smoothed counts ``pairs`` of rows in a row, with random attention."""
    rng = np.random.default_rng(seed)
    flat = rng.normal(0, 0.1, PARAMETERS).astype(np.float32)
    w = unpack(flat)
    seen = pairs.sum(1, keepdims=True)
    share = (pairs.sum(0) + 0.5) / (pairs.sum() + 0.5 * ROWS)
    p = (pairs + 20 * share) / (seen + 20)
    group = p.reshape(ROWS, GROUPS, SLOTS).sum(2)
    group_share = share.reshape(GROUPS, SLOTS).sum(1)
    within = np.log(p / np.repeat(group, SLOTS, 1)) - np.log(share / np.repeat(group_share, SLOTS))
    target = np.concatenate([np.log(group / group_share), within], 1)
    weight = np.sqrt(np.maximum(seen, 1) / max(1, seen.sum()))
    across = np.concatenate([np.sqrt(group_share), np.sqrt(share)])
    u, size, v = np.linalg.svd(weight * target * across, full_matrices=False)
    root = np.sqrt(size[:WIDTH])
    scale = np.sqrt(root.mean() + 1e-9)  # both sides about as large as each other
    w["emb"][:] = u[:, :WIDTH] * root / weight / np.sqrt(ROWS) / scale
    out = (v[:WIDTH].T * root / across[:, None]) * np.sqrt(ROWS) * scale
    w["group"][:], w["slot"][:] = out[:GROUPS].T, out[GROUPS:]
    w["group_bias"][:], w["slot_bias"][:] = np.log(group_share), np.log(share)
    w["place"][:] = -0.1 * np.arange(2 * STEP)
    w["mix"][:] *= 0.1
    return flat


def layout(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start of each document in the stream, first block flags, length in blocks) for ``sizes`` positions each."""
    blocks = -(-sizes // STEP)
    first_block = np.concatenate(([0], np.cumsum(blocks)))
    first = np.zeros(first_block[-1], bool)
    first[first_block[:-1]] = True
    return first_block[:-1] * STEP, first, blocks


def _unshifted(d: np.ndarray) -> np.ndarray:
    """Each position's slopes, from those (blocks, HEADS, 2 * STEP, n) of the blocks and of the ones before them."""
    out = d[:, :, STEP:].copy()
    out[:-1] += d[1:, :, :STEP]
    return out.swapaxes(1, 2).reshape(len(d) * STEP, -1)


class Attention:
    """Forward and backward passes over consecutive blocks of STEP positions, each seeing the block before."""

    def __init__(self, flat: np.ndarray):
        self.flat = flat.astype(np.float32)
        self.w = unpack(self.flat)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
        """Queries, keys and values (with a last 1) of all rows, and whether no exponent can be beyond _MOST."""
        w = self.w
        p = w["emb"] @ w["project"]
        v = np.ones((ROWS, HEADS, VALUE + 1), np.float32)
        v[..., :VALUE] = p[:, _K:].reshape(ROWS, HEADS, VALUE)
        q, k = p[:, :_Q].copy(), p[:, _Q:_K].copy()
        longest = [np.sqrt((t.reshape(ROWS, HEADS, KEY) ** 2).sum(2).max(0)) for t in (q, k)]
        return q, k, v.reshape(ROWS, -1), bool((longest[0] * longest[1] + np.abs(w["place"]).max(1)).max() < _MOST)

    def forward(self, x: np.ndarray, first: np.ndarray, tables: tuple | None = None):
        """Masked attention of consecutive blocks of rows; what the backward pass needs, the last state at the end.

        Queries, keys and values depend on the row alone, so they are projected once for each row and looked up.
        """
        w, n = self.w, x.size
        q, k, v, small = tables or self.tables()
        both = np.empty((len(x), 2 * STEP), x.dtype)  # rows of the block before, then of the block
        both[:, STEP:] = x
        both[1:, :STEP] = x[:-1]
        both[0, :STEP] = 0
        e = w["emb"].take(x.ravel(), 0)
        q = q.take(x.ravel(), 0).reshape(-1, STEP, HEADS, KEY).swapaxes(1, 2)
        k = k.take(both, 0).reshape(-1, 2 * STEP, HEADS, KEY).swapaxes(1, 2)
        v = v.take(both, 0).reshape(-1, 2 * STEP, HEADS, VALUE + 1).swapaxes(1, 2)
        a = q @ k.swapaxes(2, 3)
        if small:
            np.exp(a, out=a)
            a *= np.exp(w["place"])[:, _DISTANCE] * _CAUSAL
        else:
            a += w["place"][:, _DISTANCE]
            np.clip(a, -_MOST, _MOST, out=a)
            np.exp(a, out=a)
            a *= _CAUSAL
        a[first, :, :, :STEP] = 0
        o = a @ v
        total = o[..., VALUE:].copy()  # the last value is 1
        o /= total
        o = o[..., :VALUE].swapaxes(1, 2).reshape(n, HEADS * VALUE)
        return e, q, k, v, a, total, o, e + o @ w["mix"]

    def _choices(self, h: np.ndarray, y: np.ndarray):
        """Group logits, and slot logits in the order of the groups of ``y``: (group, slot, order, bounds)."""
        group = h @ self.w["group"]
        group += self.w["group_bias"]
        order = np.argsort((y // SLOTS).astype(np.uint8), kind="stable")
        bounds = np.concatenate(([0], np.cumsum(np.bincount(y // SLOTS, minlength=GROUPS))))
        sorted_h = h.take(order, 0)
        slot = np.empty((len(h), SLOTS), np.float32)
        rows = self.w["slot"].reshape(GROUPS, SLOTS, WIDTH)
        bias = self.w["slot_bias"].reshape(GROUPS, SLOTS)
        for g in range(GROUPS):
            a, b = bounds[g], bounds[g + 1]
            if b > a:
                np.matmul(sorted_h[a:b], rows[g].T, out=slot[a:b])
                slot[a:b] += bias[g]
        return group, slot, order, bounds, sorted_h

    def log_prob(self, x: np.ndarray, y: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Natural log probability of the rows ``y`` after the rows ``x``; both (blocks, STEP), the first block a first."""
        out, tables = np.empty(x.shape, np.float32), self.tables()
        for i in range(0, len(x), BATCH):
            lead = 1 if i else 0  # the block before is context only
            at = slice(i - lead, i + BATCH)
            h = self.forward(x[at], first[at], tables)[-1][lead * STEP :]
            want = y[i : i + BATCH].ravel()
            group, slot, order, *_ = self._choices(h, want)
            line = np.arange(len(want))
            found = _log_share(group, line, want // SLOTS)
            found[order] += _log_share(slot, line, want[order] % SLOTS)
            out[i : i + BATCH] = found.reshape(-1, STEP)
        return out

    def gradient(self, x: np.ndarray, y: np.ndarray, first: np.ndarray, real: np.ndarray) -> tuple[float, np.ndarray]:
        """Mean loss over the ``real`` positions and its gradient."""
        w, n = self.w, max(1, int(real.sum()))
        e, q, k, v, a, total, o, h = self.forward(x, first)
        want, weight = y.ravel(), real.ravel().astype(np.float32) / n
        group, slot, order, bounds, sorted_h = self._choices(h, want)
        line = np.arange(len(want))
        loss = 0.0
        for z, hit, share in ((group, want // SLOTS, weight), (slot, want[order] % SLOTS, weight[order])):
            np.clip(z, -_MOST, _MOST, out=z)
            np.exp(z, out=z)
            z /= z @ _ONES
            loss -= float((np.log(np.maximum(z[line, hit], 1e-12)) * share).sum())
            z[line, hit] -= 1
            z *= share[:, None]
        flat = np.zeros(PARAMETERS, np.float32)
        g = unpack(flat)
        g["group"][:] = h.T @ group
        g["group_bias"][:] = group.sum(0)
        dh = group @ w["group"].T
        back = np.empty_like(sorted_h)
        rows, g_rows, g_bias = (t.reshape(GROUPS, SLOTS, -1) for t in (w["slot"], g["slot"], g["slot_bias"]))
        for c in range(GROUPS):
            i, j = bounds[c], bounds[c + 1]
            if j > i:
                np.matmul(slot[i:j].T, sorted_h[i:j], out=g_rows[c])
                np.matmul(slot[i:j], rows[c], out=back[i:j])
                g_bias[c, :, 0] = slot[i:j].sum(0)
        place = np.empty_like(order)
        place[order] = line
        dh += back.take(place, 0)
        g["mix"][:] = o.T @ dh
        do = (dh @ w["mix"].T).reshape(-1, STEP, HEADS, VALUE).swapaxes(1, 2)
        a /= total
        dv = a.swapaxes(2, 3) @ do
        ds = do @ v[..., :VALUE].swapaxes(2, 3)
        ds -= (do * o.reshape(-1, STEP, HEADS, VALUE).swapaxes(1, 2)) @ _ONES[:VALUE]
        ds *= a
        for t in range(HEADS):
            g["place"][t] = np.bincount(_DISTANCE.ravel(), ds[:, t].sum(0).ravel(), 2 * STEP)
        dq = (ds @ k).swapaxes(1, 2).reshape(x.size, -1)
        dp = np.concatenate([dq, _unshifted(ds.swapaxes(2, 3) @ q), _unshifted(dv)], 1)
        g["project"][:] = e.T @ dp
        dh += dp @ w["project"].T
        at = np.argsort(x.ravel(), kind="stable")
        ids = x.ravel()[at]
        edge = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        g["emb"][ids[edge]] = np.add.reduceat(dh.take(at, 0), edge, 0)
        return loss, flat


def _log_share(z: np.ndarray, line: np.ndarray, hit: np.ndarray) -> np.ndarray:
    """Log of softmax at ``hit`` in each line; ``z`` is overwritten."""
    np.clip(z, -_MOST, _MOST, out=z)
    out = z[line, hit]
    np.exp(z, out=z)
    out -= np.log(z @ _ONES)[:, 0]
    return out


class Trainer:
    """Adam over runs of consecutive windows."""

    def __init__(self, net: Attention | attend.Mixture, rate: float):
        self.net, self.rate, self.t = net, rate, 0
        self.m, self.v = np.zeros_like(net.flat), np.zeros_like(net.flat)
        self.seen, self.loss = 0, 0.0

    def step(self, x, y, first, real) -> None:
        loss, g = self.net.gradient(x, y, first, real)
        self.t += 1
        self.m += np.float32(0.1) * (g - self.m)
        np.multiply(g, g, out=g)
        g -= self.v
        g *= np.float32(0.01)
        self.v += g
        rate = self.rate * min(1, self.t / 20, (200 / self.t) ** 0.5)
        np.divide(self.v, np.float32(1 - 0.99**self.t), out=g)
        np.sqrt(g, out=g)
        g += np.float32(1e-6)
        np.divide(self.m, g, out=g)
        g *= np.float32(rate / (1 - 0.9**self.t))
        self.net.flat -= g
        self.seen += int(real.sum())
        self.loss += loss * int(real.sum())


_SHAPE = attend.Shape(ROWS, STEP, KEY)


def _net(flat: np.ndarray, values: tuple | None) -> Attention | attend.Mixture:
    """The model of these weights: of distributions where their ``values`` are given, of states otherwise."""
    return Attention(flat) if values is None else attend.Mixture(_SHAPE, flat, values)


# ---- passes ------------------------------------------------------------------------------------------------------

_U2 = np.dtype("<u2")


def _encoded(docs: DataFrame, id_col: str, text: str, path: str) -> DataFrame:
    """(doc_id, key, held_out, ids): every document's subword ids, with a key of its own even where doc_ids repeat."""
    kind = docs.schema[id_col].dataType.simpleString()

    def scan(batches):
        enc = encoder(path)
        base, count = TaskContext.get().partitionId() << 33, 0  # as monotonically_increasing_id has it
        for batch in batches:
            for i, j in doc_chunks(utf8(batch.column(2))[1], CHUNK):
                part = batch.slice(i, j - i)
                ids, sizes = enc.encode(part.column(2))
                ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64) * 2
                raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(ids.astype(_U2))])
                keys = pa.array(base + np.arange(count, count + len(sizes)))
                count += len(sizes)
                yield pa.RecordBatch.from_arrays([part.column(0), keys, part.column(1), raw.cast(pa.binary())], names=["doc_id", "key", "held_out", "ids"])

    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), text_of(text).alias("text"))
    return rows.mapInArrow(scan, f"doc_id {kind}, key long, held_out boolean, ids binary")


def _texts(batch: pa.RecordBatch, chunk_ids: int = 150_000):
    """(rows, ids laid end to end, sizes) in runs of bounded size, so small that freed arrays are used again."""
    raws = [x.as_buffer() for x in batch.column("ids")]
    i = 0
    while i < len(raws):
        j, size = i, 0
        while j < len(raws) and (j == i or size + raws[j].size // 2 <= chunk_ids):
            size += raws[j].size // 2
            j += 1
        yield slice(i, j), np.frombuffer(b"".join(raws[i:j]), _U2).astype(np.int64), np.array([r.size // 2 for r in raws[i:j]], np.int64)
        i = j


def _words(ids: np.ndarray, sizes: np.ndarray, path: str, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every word, ends of texts included; A-Z count as a-z."""
    bounds = np.cumsum(sizes)
    stops = np.insert(ids, bounds, -1) if len(ids) else np.full(len(sizes), -1)
    table, offsets, _ = vocabulary(path)
    width = np.diff(offsets)
    lengths = np.where(stops < 0, 1, width[np.maximum(stops, 0)])
    ends = np.cumsum(lengths)
    shift = np.repeat(np.where(stops < 0, 0, offsets[np.maximum(stops, 0)]) - (ends - lengths), lengths)
    data = LOWER[table[np.minimum(shift + np.arange(len(shift)), len(table) - 1)]]
    blank = ends[stops < 0] - 1
    data[blank] = 0x20
    h, starts, _ = word_hashes(data)
    row = np.searchsorted(blank, starts)
    return np.concatenate([h, np.full(len(sizes), END_WORD)]), np.concatenate([row, np.arange(len(sizes))])


def _slots(known: np.ndarray) -> np.ndarray:
    """Places in ``known`` by hash, -1 where none is: open addressing, at most half full."""
    slots = np.full(1 << max(4, (2 * len(known)).bit_length()), -1, np.int32)
    mask, todo = len(slots) - 1, np.arange(len(known), dtype=np.int32)
    slot = (known & np.uint64(mask)).astype(np.int64)
    while len(todo):
        free = slots[slot] < 0
        slots[slot[free]] = todo[free]  # of several that want one slot, the last gets it
        out = slots[slot] != todo
        todo, slot = todo[out], (slot[out] + 1) & mask
    return slots


def _find(known: np.ndarray, slots: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The place of each of ``h`` in ``known``, -1 where it isn't there."""
    slot = (h & np.uint64(len(slots) - 1)).astype(np.int64)
    at = slots.take(slot)
    other = np.flatnonzero((at >= 0) & (known.take(at, mode="clip") != h)) if len(known) else np.zeros(0, np.int64)
    while len(other):
        slot[other] = (slot[other] + 1) & (len(slots) - 1)
        at[other] = got = slots.take(slot[other])
        other = other[(got >= 0) & (known.take(got, mode="clip") != h[other])]
    return at


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


def _id_counts(encoded: DataFrame, path: str) -> np.ndarray:
    """How often each id, the end included, is in the training documents: a sum over as many rows as ids for each part."""

    def scan(batches):
        end, n_ids = vocabulary(path)[2], len(vocabulary(path)[1]) - 1
        seen = np.zeros(n_ids, np.int64)
        for batch in batches:
            batch = batch.filter(pa.compute.invert(batch.column("held_out")))
            for _, ids, sizes in _texts(batch):
                seen += np.bincount(ids, minlength=n_ids)
                seen[end] += len(sizes)
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(seen[some])], names=["item", "n"])

    counts = encoded.select("held_out", "ids").mapInArrow(scan, "item int, n long").groupBy("item").agg(F.sum("n").alias("n"))
    out = np.zeros(len(vocabulary(path)[1]) - 1, np.int64)
    for item, n in counts.collect():  # at most as many as the vocabulary has ids
        out[item] = n
    return out


def _counted(encoded: DataFrame, path: str) -> DataFrame:
    """(word, n): how often each word, by its hash, is in the training documents."""

    def scan(batches):
        end, held, size = vocabulary(path)[2], [], 0

        def out(keys, counts):
            for i in range(0, len(keys), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 50_000].view(np.int64)), pa.array(counts[i : i + 50_000])], names=["word", "n"])

        for batch in batches:
            batch = batch.filter(pa.compute.invert(batch.column("held_out")))
            for _, ids, sizes in _texts(batch):
                h = np.sort(_words(ids, sizes, path, end)[0])
                at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
                held.append((h[at], np.diff(np.append(at, len(h)))))
                size += len(at)
                if size > HELD:
                    held = [_merge(held)]
                    size = len(held[0][0])
                    if size > HELD // 2:
                        yield from out(*held[0])
                        held, size = [], 0
        if held:
            yield from out(*_merge(held))

    return encoded.select("held_out", "ids").mapInArrow(scan, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _pair_counts(encoded: DataFrame, row_of: np.ndarray, path: str) -> np.ndarray:
    """Counts (TABLES, ROWS, ROWS) of the pairs of rows that the training documents' windows hold.

    Tables are summed in slices of a few rows, which are dealt to tasks, so their size does not depend on the input.
    """
    spark = encoded.sparkSession
    shared = spark.sparkContext.broadcast(row_of)

    def out(slices):
        slices = list(slices)
        for i in range(0, len(slices), 256):
            part = slices[i : i + 256]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in part], pa.int32()), pa.array([c.tobytes() for _, c in part], pa.binary())], names=["slice", "cells"])

    def scan(batches):
        end, rows, pairs = vocabulary(path)[2], shared.value, attend.Pairs(ROWS, STEP)
        for batch in batches:
            batch = batch.filter(pa.compute.invert(batch.column("held_out")))
            for _, ids, sizes in _texts(batch):
                x, y, first, real, _ = _stream(ids, sizes, end)
                pairs.add(rows[x], rows[y], first, real)
        counts = pairs.counts().reshape(-1, SLICE * ROWS)
        yield from out((k, c) for k, c in enumerate(counts) if c.any())

    def add(batches):
        sums = {}
        for batch in batches:
            for k, cells in zip(batch.column("slice").to_pylist(), batch.column("cells"), strict=True):
                more = np.frombuffer(cells.as_buffer(), np.int64)
                sums[k] = sums[k] + more if k in sums else more.copy()
        yield from out(sums.items())

    kind = "slice int, cells binary"
    slices = encoded.select("held_out", "ids").mapInArrow(scan, kind).repartition(exchange_parts(spark), "slice").mapInArrow(add, kind)
    counts = np.zeros((attend.TABLES * ROWS // SLICE, SLICE * ROWS), np.int64)
    for k, cells in slices.collect():  # at most the tables
        counts[k] = np.frombuffer(cells, np.int64)
    return counts.reshape(attend.TABLES, ROWS, ROWS)


def _stream(ids: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(inputs, targets, first block flags, real positions, document starts); each text after an end, and ended by one."""
    starts, first, blocks = layout(sizes + 1)
    n = len(first) * STEP
    x, y, real = np.full(n, end), np.full(n, end), np.zeros(n, bool)
    place = np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(len(ids))
    x[place + 1], y[place] = ids, ids
    real[place] = True
    real[starts + sizes] = True
    return x.reshape(-1, STEP), y.reshape(-1, STEP), first, real.reshape(-1, STEP), starts


def _of_round(keys: np.ndarray, turn: int) -> np.ndarray:
    """The documents whose windows are learnt from in round ``turn``."""
    return np.flatnonzero(keys % ROUNDS == turn)


def _trained(encoded: DataFrame, weights: np.ndarray, values: tuple | None, row_of: np.ndarray, path: str, rate: float, turn: int) -> np.ndarray:
    """Round ``turn``: each part's Adam from the same weights, then the mean weighted by the tokens seen."""
    shared = encoded.sparkSession.sparkContext.broadcast((weights, values, row_of))

    def scan(batches):
        flat, table, rows = shared.value
        end, trainer = vocabulary(path)[2], Trainer(_net(flat, table), rate)
        for batch in batches:
            batch = batch.filter(pa.compute.invert(batch.column("held_out")))
            batch = batch.take(pa.array(_of_round(batch.column("key").to_numpy(), turn)))
            for _, ids, sizes in _texts(batch):
                x, y, first, real, _ = _stream(ids, sizes, end)
                x, y = rows[x], rows[y]
                steps = max(1, round(len(x) / STEPS_OF))
                for part in np.array_split(np.arange(len(x)), steps):
                    at = slice(max(0, part[0] - 1), part[-1] + 1)  # the block before is context only
                    learnt = real[at].copy()
                    learnt[: part[0] - at.start] = False
                    trainer.step(x[at], y[at], first[at], learnt)
        if trainer.seen:
            weighed = np.concatenate([[trainer.seen], trainer.net.flat.astype(np.float64) * trainer.seen])
            yield pa.RecordBatch.from_arrays([pa.array([weighed], pa.list_(pa.float64()))], names=["v"])

    parts = encoded.select("key", "held_out", "ids")
    total = vector_sum(parts.mapInArrow(scan, "v array<double>"), parts.rdd.getNumPartitions())
    return weights if total is None else (total[1:] / total[0]).astype(np.float32)


def _scored(encoded: DataFrame, model: tuple, head: tuple[np.ndarray, np.ndarray], path: str) -> DataFrame:
    """Each document's model score, its base sum over frequent words, and its other words with their counts."""
    shared = encoded.sparkSession.sparkContext.broadcast((model, head))
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def scan(batches):
        (flat, table, row_of, emit), (known, logs) = shared.value
        end, net, slots = vocabulary(path)[2], _net(flat, table), _slots(known)
        for batch in batches:
            outs = []
            for rows, ids, sizes in _texts(batch):
                x, y, first, real, starts = _stream(ids, sizes, end)
                logp = net.log_prob(row_of[x], row_of[y], first).astype(np.float64)
                logp += emit[y]
                logp *= real
                score = np.add.reduceat(logp.ravel(), starts) / np.log(10) if len(starts) else np.zeros(0)
                h, row = _words(ids, sizes, path, end)
                n_tokens = np.bincount(row, minlength=len(sizes))
                at = _find(known, slots, h)
                found = at >= 0
                base = np.bincount(row[found], logs[at[found]], len(sizes))
                n_known = np.bincount(row[found], minlength=len(sizes))
                order = np.lexsort((h[~found], row[~found]))
                tail, owner = h[~found][order], row[~found][order]
                edge = np.flatnonzero(np.r_[True, (tail[1:] != tail[:-1]) | (owner[1:] != owner[:-1])]) if len(tail) else np.zeros(0, np.int64)
                times = np.diff(np.append(edge, len(tail))).astype(np.int32)
                cut = np.searchsorted(owner[edge], np.arange(len(sizes) + 1)).astype(np.int32)
                words = pa.ListArray.from_arrays(pa.array(cut), pa.array(tail[edge].view(np.int64)))
                counts = pa.ListArray.from_arrays(pa.array(cut), pa.array(times))
                part = batch.slice(rows.start, rows.stop - rows.start)
                outs.append(pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), part.column("held_out"), pa.array(n_tokens), pa.array(n_known), pa.array(base), pa.array(score), words, counts], names=["doc_id", "key", "held_out", "n_tokens", "n_known", "base", "score", "words", "times"]))
            yield from outs

    return encoded.mapInArrow(scan, f"doc_id {kind}, key long, held_out boolean, n_tokens long, n_known long, base double, score double, words array<long>, times array<int>")


def score_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", tokenizer: str | None = None, model: str = "distributions") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    Null and empty texts are just the end. Rows that repeat a doc_id keep a row each and learn each; a row with a null
    id is training. With no training document at all, counts are 0 and the model is uniform over rows. An empty
    table gives no rows. Texts of any length are scored whole, in runs of bounded size unless one text is longer.
    ``model`` is ``"distributions"`` or ``"states"``.
    """
    if model not in RATES:
        raise ValueError(f"no model {model!r}: {', '.join(RATES)}")
    spark = docs.sparkSession
    ship(spark)
    path = tokenizer or tokenizer_path()
    encoded = materialize(_encoded(docs, id_col, text, path), "subwords")
    seen = _id_counts(encoded, path)
    row_of = rows_of(seen, path)
    words = materialize(_counted(encoded, path), "counts")
    total, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    pairs = _pair_counts(encoded, row_of, path)
    order = grouped(pairs[0].astype(np.float64))
    place = np.empty(ROWS, np.int64)
    place[order] = np.arange(ROWS)
    row_of, pairs = place[row_of], pairs[:, order[:, None], order]
    mass, members = np.bincount(row_of, seen, ROWS), np.bincount(row_of, minlength=ROWS)
    emit = np.log((seen + 1) / (mass + members)[row_of])
    states = model == "states"
    weights = start_weights(pairs[0].astype(np.float64)) if states else _SHAPE.start()
    learnt = None if states else attend.values(pairs, left_out=1)
    for k in range(ROUNDS if total else 0):
        weights = _trained(encoded, weights, learnt, row_of, path, RATES[model] / (1 + k), k)
    values = None if states else attend.values(pairs)
    ladder = words.groupBy("n").agg(F.count("*").alias("m")).withColumn("upto", F.sum("m").over(Window.orderBy(F.desc("n"))))
    least = ladder.where(F.col("upto") <= HEAD).agg(F.min("n")).first()[0]
    top = words.where(F.col("n") >= least if least else F.lit(False)).toPandas()  # at most HEAD rows
    keys = top["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    head = (keys[order], np.log10(top["n"].to_numpy(np.float64)[order] + 1))
    rows = materialize(_scored(encoded, (weights, values, row_of, emit), head, path), "scores")
    rest = rows.select("key", F.explode(F.arrays_zip("words", "times")).alias("x")).select("key", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    hits = rest.join(words, "word").groupBy("key").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more"), F.sum("times").alias("also"))
    joined = rows.drop("words", "times").join(hits, "key", "left")
    base = F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(float(total + kinds + 1)))
    return joined.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("also", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
