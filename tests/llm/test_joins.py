"""Jaccard join, ranked search and token alignment against brute force, with odd rows, ties and large groups."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from feedloom.llm import align, jaccard, search
from tests.conftest import SF
from tests.llm.test_operators import LOWER, WORD, docs, odd

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


# ---- op11

def naive_classes(rows, width=4, percent=85):
    """(doc_id, n_shingles, component_id) of (doc_id, text) by all pairs that share a shingle."""
    sets = []
    for _, text in rows:
        w = WORD.findall((text or "").translate(LOWER))
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, len(s), least.get(find(k))) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def family(rng, base, edits, n):
    """``n`` versions of ``base`` with up to ``edits`` words changed."""
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_jaccard_families_with_hot_lists(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    texts = []
    for edits in (2, 4, 6):
        texts += family(rng, [rng.choice(words) for _ in range(60)], edits, 60)
    passage = " ".join(rng.choice(words) for _ in range(40))
    texts += [passage + " " + " ".join(rng.choice(words) for _ in range(30)) for _ in range(80)]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 9))) for _ in range(60)] + ["a a a a a", "A a a a a", "x", "X", None, "", " \t"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    seen = {}
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), slots=1 << 12, watch=lambda k, df: seen.__setitem__(k, df.count()))
    assert sorted(map(tuple, got.collect()), key=repr) == naive_classes(rows)
    assert seen["star"] and seen["few"] and seen["wave 0"]


def test_jaccard_small_blocks_change_nothing(spark, monkeypatch):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(300)]
    rows = list(enumerate(family(rng, [rng.choice(words) for _ in range(50)], 5, 70)))
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    monkeypatch.setattr(jaccard, "WAVES", 0)
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), slots=1 << 12)
    assert sorted(map(tuple, got.collect()), key=repr) == naive_classes(rows)


def test_jaccard_odd_rows(spark):
    rows = [tuple(r) for r in odd(spark).select("doc_id", "text").collect()] + [(9, "One two three four five six"), (None, "null id"), (None, None)]
    table = odd(spark).unionByName(odd(spark, [(9, "One two three four five six", None), (None, "null id", None), (None, None, "s")]))
    got = jaccard.near_duplicates(table, slots=1 << 12)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect()), key=repr) == naive_classes(rows)
    assert jaccard.near_duplicates(odd(spark).limit(0), slots=1 << 12).count() == 0


def test_equal_sets_share_prefix_tokens_in_every_order():
    rng = np.random.default_rng(3)
    levels = rng.integers(0, 255, 1 << 10).astype(np.uint8)
    for _ in range(200):
        a = np.unique(rng.integers(0, 2**64, 100, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: rng.integers(85, 101)], rng.integers(0, 2**64, 5, dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 85 * (len(a) + len(b) - both):
            for k in jaccard.ORDERS:
                assert len(np.intersect1d(jaccard.prefix(a, levels, k), jaccard.prefix(b, levels, k)))


# ---- op12

def naive_search(rows, items, k=50):
    terms = [collections.Counter(TERM.findall((t or "").translate(LOWER))) for _, t in rows]
    n, length = sum(bool(t) for t in terms), sum(sum(t.values()) for t in terms)
    df = collections.Counter(x for t in terms for x in t)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(TERM.findall((text or "").translate(LOWER)))
    out = []
    for item, ts in wanted.items():
        scored = []
        for (i, _), tf in zip(rows, terms, strict=True):
            m = 50 + (50 * sum(tf.values()) * n) // length if tf else 0
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * tf[t]) // (1000 * tf[t] + 20 * m)) for t in ts if tf[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


def test_search_ties_masks_and_odd_rows(spark, monkeypatch):
    rng = random.Random(8)
    words = [f"t{k}" for k in range(90)]
    rows = [(k // 2 if k % 5 else k, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 40)))) for k in range(400)]
    rows += [(None, "t1 t2 T3"), (7, None), (8, ""), (9, "t1-t2_t3 é日 T4"), (10, "..."), *[(1000 + k, "t5 t6") for k in range(30)]]
    items = [(1, "t1 t2 t3 t3"), (2, " ".join(words)), (3, "none here"), (4, None), (1, "T9"), (None, "é日 t5"), (5, "t5")]
    monkeypatch.setattr(search, "ROWS", 64)
    monkeypatch.setattr(search, "FIRST", 4)
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rank", F.lit("clash")).withColumn("score", F.lit(None)).repartition(3)
    wanted = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit("clash"))
    for k, chars in ((50, 10**6), (3, 40)):
        got = search.search(table, wanted, k, block_chars=chars)
        assert sorted(map(tuple, got.collect()), key=repr) == naive_search(rows, items, k)
    assert search.search(table.limit(0), wanted).count() == 0 and search.search(table, wanted.limit(0)).count() == 0


def test_search_leaves_masks_unread_when_safe(monkeypatch):
    monkeypatch.setattr(search, "FIRST", 16)
    terms = [b"a", b"b"]
    queries = search.Queries([1], [np.array([0, 1])], terms)
    n = 4000
    rows = np.r_[np.arange(50), np.arange(n)]
    block = (pa.array(range(n)), np.full(n, 10), np.r_[np.zeros(50, int), np.ones(n, int)], rows, np.ones(n + 50, int))
    best = [search._Best(50)]
    seen = search.rank_block(queries, np.array([900, 100]), n, 10 * n, block, best)
    assert seen < n and sorted(r[2] for r in best[0].rows) == list(range(50))


def test_search_bar_of_exactly_k_rows_is_the_least_of_them():
    """The first block has k rows, the best of them last; a row of the next block that beats all but that one must rank."""
    k = 3
    queries, best = search.Queries([1], [np.array([0])], [b"a"]), [search._Best(k)]
    for ids, counts in (([1, 2, 3], [1, 1, 9]), ([4, 5], [3, 1])):
        n = len(ids)
        search.rank_block(queries, np.array([1000]), 5, 50, (pa.array(ids), np.full(n, 10), np.zeros(n, int), np.arange(n), np.array(counts)), best)
    best[0].add([], [])
    assert [r[2] for r in best[0].rows] == [3, 4, 1]


def test_term_lookup_compares_bytes(monkeypatch):
    words = [b"ab", b"ba", b"abc", b"zz"]
    monkeypatch.setattr(search, "_hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    made = search.Terms(words)
    data = np.frombuffer(b"abc zz xx ba ab", np.uint8)
    starts, ends = search.term_spans(data, np.array([0, len(data)]))
    assert made.find(data, starts, ends).tolist() == [2, 3, -1, 1, 0]


# ---- op13

def naive_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(align.tokenizer_path())
    t.encode_special_tokens = True
    p = sentencepiece.SentencePieceProcessor(model_file=align.tokenizer_path("piece_bpe_32k.model"))
    letters = align._byte_letters()
    out, held, counts = [], [], collections.Counter()
    for i, text in rows:
        links, figures = collections.Counter(), (0, 0, 0, "")
        if text:
            a, b = t.encode(" " + text, add_special_tokens=False).ids, p.encode(text)
            bytes_a = [bytes(letters[c] for c in t.id_to_token(k)) for k in a]
            bytes_b = [bytes([int(p.id_to_piece(k)[3:5], 16)]) if p.is_byte(k) else p.id_to_piece(k).replace("▁", " ").encode() for k in b]
            if b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
                ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
                bounds = sorted(set(ends_a) & set(ends_b))
                groups = [([x for x, e in zip(a, ends_a, strict=True) if s < e <= u], [x for x, e in zip(b, ends_b, strict=True) if s < e <= u]) for s, u in zip([0, *bounds], bounds, strict=False)]
                for x, ex, nx in zip(a, ends_a, map(len, bytes_a), strict=True):
                    for y, ey, ny in zip(b, ends_b, map(len, bytes_b), strict=True):
                        if max(ex - nx, ey - ny) < min(ex, ey):
                            links[x, y] += 1
                said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
                figures = (len(a), len(b), len(groups), hashlib.sha256(said.encode()).hexdigest())
        counts.update(links.keys())
        out.append((i, *figures))
        held.append(links)
    best = collections.Counter()
    for (x, _), c in counts.items():
        best[x] = max(best[x], c)
    return sorted(((i, a, b, g, sum(l.values()), sum(m for q, m in l.items() if counts[q] == best[q[0]]), sum(m * counts[q] for q, m in l.items()), d) for (i, a, b, g, d), l in zip(out, held, strict=True)), key=repr)


NASTY = [" ", "  ", "a▁b", "x\x00y <|endoftext|> <s></s>", "\n\n a\n b  c \n", "é日本語 😀  x", " lead   trail  ", "it's  \t tab", "\r\n", "ﬁ ½ Ａ", "x" * 300, "the the the"]


def test_alignment_of_nasty_texts(spark):
    rows = [(k, t) for k, t in enumerate([None, "", *NASTY, *NASTY])] + [(None, "the end"), (3, "the end")]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_a", F.lit("clash")).repartition(3)
    assert sorted(map(tuple, align.align(table).collect()), key=repr) == naive_alignment(rows)
    assert align.align(table.limit(0)).count() == 0


def test_alignment_in_parts_chunks_and_levels(spark, monkeypatch):
    """Blocks, chunks and merges of any size give the same rows; a long text is looked at in parts."""
    rows = [(r["doc_id"], r["text"][:1500]) for r in docs(spark).orderBy("doc_id").limit(40).collect()]
    rows += [(900, " ".join(t for _, t in rows[:4])), (901, "y" * 3000 + " a b▁c " + "z z " * 400)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = naive_alignment(rows)
    monkeypatch.setattr(align.encode_runs, "__defaults__", align.encode_runs.__defaults__)
    made = [sorted(map(tuple, align.align(table, fan=fan).collect()), key=repr) for fan in (64, 2)]
    assert made[0] == want and made[1] == want
    small = align.aligner(align.tokenizer_path(), align.tokenizer_path("piece_bpe_32k.model"))
    text = " " + rows[40][1]
    data = np.frombuffer(text.encode(), np.uint8)
    cut = list(align.parts(data, 700))
    assert len(cut) > 2 and cut[0][0] == 0 and cut[-1][1] == len(data) and all(x[1] == y[0] for x, y in zip(cut, cut[1:], strict=False))
    monkeypatch.setattr(align, "parts", lambda data, most=700: iter(cut))
    chunk, bad = align.Chunk(0), set()
    figures = align._long(small, chunk, data, bad)[0]
    whole = next(r for r in want if r[0] == 900)
    assert not bad and figures == (*whole[1:5], whole[7])
    monkeypatch.setattr(align, "RECORDS", 50)
    other = align.Chunk(0)
    align._long(small, other, data, bad)
    assert all(np.array_equal(x, y) for x, y in zip(chunk.records(set()), other.records(set()), strict=True))
    assert not len(other.records({0})[0])


def test_merge_of_runs_by_blocks():
    rng = np.random.default_rng(4)
    runs = []
    for size in (0, 1, 50, 200, 200):
        p = np.unique(rng.integers(0, 300, size))
        runs.append((p, rng.integers(1, 9, len(p))))
    want = collections.Counter()
    for p, c in runs:
        want.update(dict(zip(p.tolist(), c.tolist(), strict=True)))
    for block in (1, 7, 1000):
        p, c = align.merge_runs(runs, block)
        assert dict(zip(p.tolist(), c.tolist(), strict=True)) == dict(want) and (np.diff(p) > 0).all()
    assert len(align.merge_runs([])[0]) == 0


@pytest.mark.parametrize("k", [0, 255, 70_000])
def test_small_numbers_come_back(k):
    x = np.array([0, k, 3])
    assert align._open_small(align._pack_small(x)).tolist() == x.tolist() and align._open_pairs(align._pack_pairs(np.array([2, 5, 2**40]))).tolist() == [2, 5, 2**40]


def test_tables_are_given(spark):
    assert SF and docs(spark).count() > 0
