"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes for what they miss.

The patterns (e-mail, address of a host, payment card, international phone) give the base spans. The field is trained
on a small labelled table of sentences and adds spans that have no fixed pattern here: e-mail addresses written out
("jo (at) mail (dot) com"), national phone numbers, personal id numbers, secrets behind a name ("token = ..."), and cards
that the pattern runs together with other digits, if their own digits pass Luhn. Every word of every text is labelled, by
Viterbi over overlapping windows of equal length in numpy batches: a window's middle takes its labels, MARGIN words on
either side are context. Windows in which no word's labels can outweigh being outside, whatever the path, are not walked.
Added spans that touch a base span are left out, so base spans always stay as they are.
"""

from __future__ import annotations

import hashlib
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm._shared import doc_chunks, ship, text_of, utf8
from feedloom.llm._words import mix, word_hashes

KINDS = ("email", "ip", "card", "phone", "id", "secret")
LABELS = ("O", "email", "phone", "id", "secret", "card")
BUCKETS = 1 << 12
#: Words of a window, and those on either side that only give context; windows decoded together; bytes of text at once.
WINDOW, MARGIN = 64, 8
WINDOWS = 4096
CHUNK = 4_000_000
#: Distinct words whose shapes a worker keeps.
KEPT = 300_000

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, reach, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > reach and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-")):
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            reach = m.end()
        at = text.find("@", m.end() if m else at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the fixed patterns: leftmost, not overlapping within a kind; matches that fail are dropped."""
    out = [(a, "email", b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:4] or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), "ip", m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), "card", m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), "phone", m.end()))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[1])))


_MARKS = ("at", "dot")
_STRIP_RIGHT, _STRIP_LEFT = ".,;:!?*#$%&\"'|", "\"'*|"
_KEY = re.compile(r"(?=(?:[^0-9]*[0-9]){3})(?=(?:[^A-Za-z]*[A-Za-z]){3})[0-9A-Za-z_+/-]{20,}=*")


def shape(word: str) -> str:
    """Digits by number, letters by case, signs as they are; long mixtures of both are keys; names of secrets and
    written-out marks keep their letters."""
    bare = word.strip("()[]{}").lower()
    if bare in _MARKS and bare != word.lower():
        return f"<{bare}>"
    if bare in ("dot", "token", "secret", "password", "key", "api_key", "bearer"):
        return bare
    if _KEY.fullmatch(word):
        return "K"
    s = re.sub(r"[0-9]{6,}", lambda m: "N" if not 14 <= len(m[0]) <= 19 else "L", word)
    s = re.sub(r"[0-9]+", lambda m: str(len(m[0])), s)
    s = re.sub(r"[^\W\d_]*[a-zß-ÿ][^\W\d_]*", "x", s)
    return re.sub(r"[^\W\d_xNL]+", "X", s)


class _Shapes:
    """From a word's hash to (code of its shape, signs stripped left, right), for as long as it is kept."""

    def __init__(self):
        self.known: dict[int, tuple[int, int, int]] = {}

    def __call__(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(codes, starts, ends) of the words of UTF-8 ``data``, without the signs around them."""
        h, starts, ends = word_hashes(data)
        one, first, where = np.unique(h, return_index=True, return_inverse=True)
        if len(self.known) > KEPT:
            self.known = {}
        known, rows = self.known, []
        for x, i in zip(one.tolist(), first.tolist(), strict=True):
            got = known.get(x)
            if got is None:
                word = data[starts[i] : ends[i]].tobytes().decode("utf-8", "surrogatepass")
                left, right = len(word) - len(word.lstrip(_STRIP_LEFT)), len(word) - len(word.rstrip(_STRIP_RIGHT))
                if left + right >= len(word):
                    left = right = 0
                code = hashlib.blake2b(shape(word[left : len(word) - right]).encode("utf-8", "surrogatepass"), digest_size=8).digest()
                got = known[x] = (int.from_bytes(code, "little"), left, right)
            rows.append(got)
        table = np.array([r[0] for r in rows], np.uint64)
        strip = np.array([r[1:] for r in rows], np.int64).reshape(-1, 2)[where]
        return table[where] if len(rows) else np.zeros(0, np.uint64), starts + strip[:, 0], ends - strip[:, 1]


def features(codes: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Feature buckets (words, 6): shape, neighbours' shapes and their pairs; ``docs`` tells which text a word is in."""
    n = len(codes)

    def beside(k: int) -> np.ndarray:
        out = np.full(n, np.uint64(k + 3))  # one value for each distance over the edge
        i = np.arange(max(0, -k), n - max(0, k))
        inside = i[docs[i] == docs[i + k]]
        out[inside] = codes[inside + k]
        return out

    before, after, far_before, far_after = beside(-1), beside(1), beside(-2), beside(2)
    with np.errstate(over="ignore"):
        joint = (codes, before * np.uint64(3) + np.uint64(1), after * np.uint64(5) + np.uint64(2), before * np.uint64(7) + codes * np.uint64(11), codes * np.uint64(13) + after * np.uint64(17), far_before * np.uint64(19) + codes * np.uint64(23) + far_after * np.uint64(29))
        return np.stack([(mix(j) % np.uint64(BUCKETS)).astype(np.int64) for j in joint], 1)


class Field:
    """A linear-chain conditional random field: weights for feature buckets and for pairs of labels."""

    def __init__(self):
        k = len(LABELS)
        self.emit, self.move = np.zeros((BUCKETS, k)), np.zeros((k, k))

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.emit[x].sum(-2)

    def train(self, sentences: list[tuple[np.ndarray, np.ndarray]], steps: int = 120, rate: float = 0.1, decay: float = 1e-3) -> None:
        """Adam on the mean log-likelihood, all sentences at once; sentences are padded and masked."""
        n, t, k = len(sentences), max(len(y) for _, y in sentences), len(LABELS)
        x, y, real = np.zeros((n, t, 6), np.int64), np.zeros((n, t), np.int64), np.zeros((n, t), bool)
        for i, (a, b) in enumerate(sentences):
            x[i, : len(b)], y[i, : len(b)], real[i, : len(b)] = a, b, True
        both = real[:, 1:] & real[:, :-1]
        gold_move = np.zeros((k, k))
        np.add.at(gold_move, (y[:, :-1][both], y[:, 1:][both]), 1)
        memory = [np.zeros_like(self.emit), np.zeros_like(self.emit), np.zeros_like(self.move), np.zeros_like(self.move)]
        for step in range(1, steps + 1):
            e = np.where(real[..., None], self.scores(x), 0)
            alpha, beta = np.zeros((n, t, k)), np.zeros((n, t, k))
            alpha[:, 0] = e[:, 0]
            for j in range(1, t):
                z = alpha[:, j - 1, :, None] + self.move
                alpha[:, j] = np.where(real[:, j, None], np.logaddexp.reduce(z, 1) + e[:, j], alpha[:, j - 1])
            for j in range(t - 2, -1, -1):
                z = self.move + (e[:, j + 1] + beta[:, j + 1])[:, None, :]
                beta[:, j] = np.where(real[:, j + 1, None], np.logaddexp.reduce(z, 2), 0)
            total = np.logaddexp.reduce(alpha[:, -1], 1)
            p = np.exp(alpha + beta - total[:, None, None]) * real[..., None]
            g = -p
            np.put_along_axis(g, y[..., None], np.take_along_axis(g, y[..., None], 2) + real[..., None], 2)
            grad_emit = np.zeros_like(self.emit)
            for f in range(6):
                np.add.at(grad_emit, x[..., f][real], g[real])
            pair = alpha[:, :-1, :, None] + self.move + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - total[:, None, None, None]
            grad_move = gold_move - (np.exp(np.where(both[..., None, None], pair, -np.inf))).sum((0, 1))
            for w, g_, m, v in ((self.emit, grad_emit, *memory[:2]), (self.move, grad_move, *memory[2:])):
                g_ = g_ / n - decay * w
                m += 0.1 * (g_ - m)
                v += 0.01 * (g_ * g_ - v)
                w += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)

    def decode(self, x: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """The label of every word; ``x`` are its features and ``docs`` ascending numbers of the texts."""
        n, k = len(x), len(LABELS)
        out = np.zeros(n, np.int64)
        if not n:
            return out
        e = self.scores(x).astype(np.float32)
        gain = (e[:, 1:] - e[:, :1]).max(1)
        slack = 2 * max(0.0, float((self.move - self.move[0, 0]).max()))  # a path of m words inside has m + 1 other moves
        hot = np.flatnonzero(gain + slack >= 0)
        if not len(hot):
            return out
        first = np.searchsorted(docs, docs, side="left")
        step = WINDOW - 2 * MARGIN
        begin = np.unique(first[hot] + (hot - first[hot]) // step * step)  # middles with such words; the others are outside
        begin = np.unique(np.concatenate([begin, begin - step, begin + step]))
        begin = begin[(begin >= 0) & (begin < n)]
        begin = begin[(begin - first[begin]) % step == 0]
        move = self.move.astype(np.float32)
        for i in range(0, len(begin), WINDOWS):
            some = begin[i : i + WINDOWS]
            at = some[:, None] - MARGIN + np.arange(WINDOW)
            safe = np.clip(at, 0, n - 1)
            real = (at == safe) & (docs[safe] == docs[some][:, None])
            score = e[safe]
            score[~real] = [0, *[-1e9] * (k - 1)]
            best, back = score[:, 0], np.empty((len(some), WINDOW, k), np.int8)
            for t in range(1, WINDOW):
                z = best[:, :, None] + move
                back[:, t] = z.argmax(1)
                best = z.max(1) + score[:, t]
            y = np.empty((len(some), WINDOW), np.int64)
            y[:, -1] = best.argmax(1)
            for t in range(WINDOW - 1, 0, -1):
                y[:, t - 1] = np.take_along_axis(back[:, t], y[:, t, None], 1)[:, 0]
            middle = np.zeros(WINDOW, bool)
            middle[MARGIN : WINDOW - MARGIN] = True
            keep = real & middle
            out[at[keep]] = y[keep]
        return out


#: The labelled sentences, as patterns. "9" is any digit, "w" a lower-case word, "W" a capitalised word, "C" one in capitals,
#: "K" a key of letters and digits, "L" 16 digits, and names of secrets stand for themselves;
#: what stands in {kind: ...} has that label.
LABELLED = (
    "W w w {email:w (at) w (dot) w} w w.",
    "W w {email:w.w [at] w [dot] w} w w w",
    "w {email:w99 (at) w9 dot w} w",
    "w w {email:w (at) w dot w}, w w.",
    "W {email:w_w {at} w {dot} w} w w",
    "W w w {phone:(999) 999-9999} w w.",
    "w {phone:999-999-9999} w w w",
    "W w {phone:999.999.9999}, w w",
    "w w {phone:(999) 999 9999} w",
    "W w {phone:999 999 9999} w w",
    "w {phone:0999 9999999} w w",
    "W w {phone:1-999-999-9999} w.",
    "W w w {id:999-99-9999} w w",
    "w {id:999-99-9999}. W w w",
    "W w w w w. W w w, w w w.",
    "w 9999 w w 99 w w.",
    "W 9.9. W w w w",
    "W w w 9.9 w w W w",
    "W w w +9 (999) 999-9999 w w",
    "w w 99.999.99.999 w w.",
    "W 9999-99-99 w w 99:99 w",
    "w w 99% w w 999,999 w",
    "W w 9999 9999 9999 9999 w w",
    "w w. 999 w w, 99-99 w w",
    "W w 99/99/9999 w w w.",
    "W w w.99@w9.w.w w w",
    "w w at w w w. W w",
    "w 999 w 999 w 9999 w",
    "W 99 999 w w w",
    "w $99.99 w w 9,999.99 w",
    "w w 9.9.9 w v9.9 w",
    "w 999999 w 99999 w w 9999999 w",
    "(w 9999) w [99] w w",
    "w w 9999999999 w 99999999999 w",
    "WWW!! W!! 99!! W!! w",
    "w*** w### 999.999.99.99*** w&&&",
    "C!! C.!! +9 (999) 999-9999!! C!! C!!",
    "C C 999.99.999.99 C C C",
    "w w token = {secret:\"K\"} w w w",
    "w. W token = {secret:K} w w",
    "W w api_key: {secret:K}, w w",
    "w password = {secret:\"K\"}. W w",
    "w key = {secret:K} w w",
    "W w secret {secret:K} w w",
    "w bearer {secret:K} w w",
    "w*** token = {secret:\"K\"}### w&&& w",
    "C!! C!! token = {secret:\"K\"}!! C!! C,!! C!!",
    "w w K w w w",
    "W K. W w",
    "w w token w w w. W w",
    "w key w w, w secret w w",
    "w w token = w w w",
    "w w {card:L} w w w",
    "w w {card:L} {card:L} w w",
    "W {card:L}, {card:L} w w.",
    "w | w | {card:L} | w | w",
    "C!! C!! {card:L}!! C!! C,!! C!!",
    "w*** {card:L}$$$ w,&&& w%%% w",
)


def labelled_table(spark: SparkSession, copies: int = 12) -> DataFrame:
    """(sentence, text, spans): the labelled sentences the field is trained on, each pattern filled ``copies`` times."""
    return spark.createDataFrame([(i, t, [(a, b, k) for a, b, k in s]) for i, (t, s) in enumerate(_sentences(copies))], "sentence int, text string, spans array<struct<start: int, end: int, kind: string>>")


def _sentences(copies: int, seed: int = 5, parts: tuple[str, ...] = ("an", "der", "ti", "on", "ou", "la", "mi", "en", "re", "st", "ha", "é", "ció")) -> list[tuple[str, list[tuple[int, int, str]]]]:
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice((24, 32, 40, 64))))
    made = {"9": lambda: rng.choice("0123456789"), "w": word, "W": lambda: word().capitalize(), "C": lambda: word().upper(), "K": key, "L": lambda: "".join(rng.choice("0123456789") for _ in range(16))}
    out = []
    for pattern in LABELLED:
        for _ in range(copies):
            text, spans, kind, start = "", [], "", 0
            for m in re.finditer(r"\{(email|phone|id|secret|card):|\}(?=[ .,!#$]|$)|\b(at|dot|token|api_key|password|key|secret|bearer|v)(?=\b|[0-9])|.", pattern):
                if m[1]:
                    kind, start = m[1], len(text)
                elif m[0] == "}" and kind and not re.search(r"\{(at|dot)$", text):
                    spans.append((start, len(text), kind))
                    kind = ""
                else:
                    text += made.get(m[0], lambda m=m: m[0])()
            out.append((text, spans))
    return out


@lru_cache(1)
def trained(copies: int = 12) -> Field:
    """The field fitted to the labelled table; the same in every run."""
    data, shapes = [], _Shapes()
    for text, spans in _sentences(copies):
        codes, starts, ends = shapes(np.frombuffer(text.encode(), np.uint8))
        upto = np.cumsum(np.frombuffer(text.encode(), np.uint8) & 0xC0 != 0x80)  # from bytes to code points
        s, e = upto[starts] - 1, upto[ends - 1]
        y = [next((LABELS.index(k) for a, b, k in spans if i < b and j > a), 0) for i, j in zip(s, e, strict=True)]
        data.append((features(codes, np.zeros(len(codes), np.int64)), np.array(y)))
    field = Field()
    field.train(data)
    return field


_shapes = _Shapes()  # one for each worker process


def added_spans(texts: pa.Array, base: list[list[tuple[int, str, int]]], field: Field) -> list[list[tuple[int, str, int]]]:
    """What the field finds beside the base spans, for each text of an Arrow column without nulls."""
    out: list[list[tuple[int, str, int]]] = [[] for _ in base]
    for i, j in doc_chunks(utf8(texts)[1], CHUNK):
        _add(*utf8(texts.slice(i, j - i)), base[i:j], field, out[i:j])
    return out


def _add(data: np.ndarray, offsets: np.ndarray, base: list, field: Field, out: list) -> None:
    gaps = np.insert(data, offsets[1:-1], 0x20)  # a blank between texts, so that no word spans two
    offsets = offsets + np.arange(len(offsets))
    offsets[-1] -= 1
    codes, starts, ends = _shapes(gaps)
    docs = np.searchsorted(offsets[1:-1], starts, side="right")
    y = field.decode(features(codes, docs), docs)
    inside = np.flatnonzero(y)
    if not len(inside):
        return
    apart = (np.diff(inside) > 1) | (np.diff(y[inside]) != 0) | (np.diff(docs[inside]) != 0) | (y[inside[1:]] == LABELS.index("card"))
    for run in np.split(inside, np.flatnonzero(apart) + 1):
        d, kind = int(docs[run[0]]), LABELS[y[run[0]]]
        text = gaps[offsets[d] : ends[run[-1]]]
        if kind == "card":
            digits = [chr(c) for c in gaps[starts[run[0]] : ends[run[0]]] if 48 <= c < 58]
            if not (14 <= len(digits) <= 19 and luhn("".join(digits))):
                continue
        whole = text & 0xC0 != 0x80
        a, b = int(whole[: starts[run[0]] - offsets[d]].sum()), int(whole.sum())
        if not any(s < b and e > a for s, _, e in base[d]):
            out[d].append((a, kind, b))


def _line(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in sorted(spans, key=lambda s: (s[0], KINDS.index(s[1]), s[2])))


COLUMNS = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of ``docs``: counts of base spans by kind, their digest, and all spans.

    Null and empty texts have no spans; repeated rows give repeated results; an empty table gives no rows; other columns
    are not read. Work and memory go with the text: no pattern backtracks over a long run of characters.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    shared = spark.sparkContext.broadcast(trained())
    names = ["doc_id", *(x.split()[0] for x in COLUMNS.split(", "))]

    def scan(batches):
        field = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            base = [base_spans(t) for t in texts]
            added = added_spans(batch.column(1), base, field)
            counts = [pa.array([sum(s[1] == k for s in b) for b in base], pa.int64()) for k in KINDS[:4]]
            digests = pa.array([hashlib.sha256(_line(b).encode()).hexdigest() for b in base], pa.string())
            every = pa.array([_line([*b, *a]) for b, a in zip(base, added, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digests, every], names=names)

    return docs.select(F.col(id_col).alias("doc_id"), text_of(text).alias("text")).mapInArrow(scan, f"doc_id {kind}, {COLUMNS}")
