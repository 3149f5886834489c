"""The ten operators against brute force, exact round trips, planted cases and held-out accuracy."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from feedloom.llm import attend, chat, decontam, html, lm, mixing, pii, quality, simhash, sketch, tokens
from feedloom.llm._encode import Encoder
from feedloom.llm.graph import components
from tests.conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [(None, "null id", "s"), (1, None, None), (2, "", "s"), (3, "One two  three\tfour five six", None), (3, "One two  three\tfour five six", None), (4, "x" * 5000 + " y", "t")]


def odd(spark, rows=ODD):
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("score", F.lit("clash")).withColumn("n_words", F.lit(1)).withColumn("_part", F.lit("clash"))


def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# ---- op1

def test_chat_against_turns(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    got = {r["conv_id"]: r for r in chat.digest_conversations(chat.with_control(turns)).collect()}
    rows = sorted((r["conv_id"], r["turn"], r["role"], r["text"]) for r in chat.with_control(turns).collect())
    for conv, group in itertools.groupby(rows, key=lambda r: r[0]):
        group = list(group)
        loss = "".join(t for _, _, r, t in group if r == "assistant")
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in group).encode()).hexdigest()
        assert got[conv]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert (got[conv]["loss_chars"], got[conv]["n_turns"]) == (len(loss), len(group))


def test_chat_escapes_and_nulls(spark):
    nasty = ["<|im_end|>", "<\\|im_start|>a", "<\\\\|", "\n\nx ", "", "é<|", "|>"]
    turns = [("assistant", t) for t in nasty] + [("us<|er", "q")]
    assert chat.parse(chat.render(turns)[0]) == turns
    block = chat.Formatter()(turns)
    assert "".join(map(chat.unescape, chat._masked_runs(block))) == "".join(nasty)
    rows = spark.createDataFrame([(7, 1, None, None), (7, None, "assistant", "a"), (None, 0, "user", "b"), (7, 1, "assistant", "c")], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: (r["n_turns"], r["loss_chars"]) for r in chat.digest_conversations(rows).collect()}
    assert got == {7: (3, 2), None: (1, 0)}
    assert chat.format_conversations(rows).count() == 2
    assert chat.digest_conversations(rows.limit(0)).count() == 0


def test_a_long_conversation_is_one_row_encoded_like_its_whole(spark, monkeypatch):
    turns = [("assistant" if k % 2 else "user", f"turn {k} <|im_end|> says " + "word " * (k % 7)) for k in range(300)]
    rows = spark.createDataFrame([(1, k, r, t) for k, (r, t) in enumerate(turns)] + [(2, 0, "assistant", None)], "conv_id long, turn long, role string, text string")
    monkeypatch.setattr(chat, "BLOCK", 500)  # in this process; the workers encode the whole
    table = pa.table({"conv_id": pa.array([1] * 300), "role": [r for r, _ in turns], "text": [t for _, t in turns]})
    blocks = [b for _, _, b in chat._blocks(table.to_batches(), None)]
    whole = chat.Formatter()(turns)
    assert len(blocks) > 3 and np.array_equal(np.concatenate([b["ids"] for b in blocks]), whole["ids"])
    assert np.array_equal(np.concatenate([b["mask"] for b in blocks]), whole["mask"])
    got = {r["conv_id"]: r for r in chat.format_conversations(rows).collect()}
    assert len(got) == 2 and got[1]["text"] == chat.render(turns)[0] == "".join(b["text"] for b in blocks)
    assert got[1]["ids"] == whole["ids"].tolist() and got[1]["mask"] == whole["mask"].tolist()
    assert chat.parse(got[2]["text"]) == [("assistant", "")] and not any(got[2]["mask"])


# ---- op2

def test_targets_by_water_filling(spark):
    sizes = {"a": 1000, "b": 10, "c": 300, "d": 0, None: 50}
    got = {r[0]: r[2] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    weights = dict(zip(["a", "b", "c", "d", None], (5, 2, 1, 5, 2)))
    want, open_, left = {}, set(sizes), float(sum(sizes.values()))
    while True:
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            want |= share
            break
        for s in over:
            want[s] = 3.0 * sizes[s]
            left -= want[s]
            open_.remove(s)
    assert got == pytest.approx(want)


def test_mixing_meets_targets(spark):
    rows = mixing.copies(docs(spark)).collect()
    assert len(rows) == docs(spark).count()
    by = {}
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by.setdefault((r["source_size"], r["target"]), []).append(r)
    for (_, target), group in by.items():
        small = min(r["size"] for r in group if r["size"])
        assert abs(sum(r["taken"] for r in group) - target) <= max(small, 0.02 * target)
    again = {(r["doc_id"], r["taken"]) for r in mixing.copies(docs(spark)).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in rows}


def test_rates_against_a_numpy_solver(spark):
    rng = np.random.default_rng(2)
    sizes = {"a": rng.integers(1, 400, 60), "b": rng.integers(1, 9, 5), "c": np.array([5000, 3, 2]), "d": np.array([7, 7, 7])}
    aims = {"a": 0.2, "b": 2.9, "c": 0.05, "d": 3.0}
    groups = spark.createDataFrame([(s, int(n), 1) for s, x in sizes.items() for n in x], "source string, size long, docs long").groupBy("source", "size").agg(F.sum("docs").alias("docs"))
    wanted = spark.createDataFrame([(s, float(aims[s] * x.sum())) for s, x in sizes.items()], "source string, target double")
    solved = {r["source"]: r for r in mixing.balance(groups, wanted).collect()}
    for s, x in sizes.items():
        if aims[s] == 3:
            assert solved[s]["every"]
            continue
        low, high = -1e4, 1e4  # bisection on the same dual
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (low, mid) if (x * np.minimum(3, np.exp(np.minimum(mid * x / x.mean(), 50)))).sum() > aims[s] * x.sum() else (mid, high)
        want = np.minimum(3, np.exp(np.minimum(mid * x / x.mean(), 50)))
        got = np.minimum(3, np.exp(np.minimum(solved[s]["tilt"] * x / solved[s]["mean"], 50)))
        assert np.allclose(got, want, atol=1e-3), s
    made = mixing._rounded(groups, wanted, mixing.balance(groups, wanted), 3).collect()
    for s, x in sizes.items():
        group = [r for r in made if r["source"] == s]
        assert all(0 <= r["copies"] <= 3 * r["docs"] for r in group)
        words = sum(r["size"] * r["copies"] for r in group)
        assert words == 15 if s == "c" else abs(words - aims[s] * x.sum()) <= max(1, x.min())  # c: 250 wanted, but 15 or 5000 possible


def test_mix_keeps_columns_and_follows_copies(spark):
    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (1, "a b d", "s"), (None, "x y", "t"), (None, "x y z", "t"), (2, None, None), (3, "p " * 50, "t")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for name in ("_words", "_n", "_rank", "_copy", "_times", "_id", "_size", "_rows", "row", "size", "h1", "h2", "n", "rows", "rank", "copy"):
        d = d.withColumn(name, F.lit("mine"))
    got = mixing.mix(d)
    assert got.columns == d.columns and all(r["_words"] == r["n"] == r["h1"] == "mine" for r in got.collect())
    words = lambda t: len(WORD.findall(t or ""))
    taken, made = {}, {}
    for r in mixing.copies(d).collect():
        taken[r["doc_id"], r["size"]] = taken.get((r["doc_id"], r["size"]), 0) + r["taken"]
    for r in got.collect():
        made[r["doc_id"], words(r["text"])] = made.get((r["doc_id"], words(r["text"])), 0) + words(r["text"])
    assert made == {k: v for k, v in taken.items() if v}
    assert sorted(map(str, got.collect())) == sorted(map(str, mixing.mix(d).collect()))


def test_mixing_edges(spark):
    assert mixing.copies(odd(spark)).count() == len(ODD)
    assert mixing.copies(odd(spark).limit(0)).count() == 0
    assert mixing.mix(odd(spark)).columns == odd(spark).columns


# ---- op3

def test_tokens_against_library(spark):
    enc = Encoder().tokenizer
    rows = sorted((r["doc_id"], r["text"]) for r in docs(spark).select("doc_id", "text").collect())
    got = {r["doc_id"]: r for r in tokens.token_table(docs(spark)).collect()}
    at = 0
    for i, t in rows:
        ids = [*enc.encode(t, add_special_tokens=False).ids, 2]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_token_edges_and_sequences(spark, tmp_path):
    got = tokens.token_table(odd(spark)).collect()
    assert len(got) == len(ODD) and sorted(r["n_tokens"] for r in got)[:2] == [1, 1]
    assert tokens.token_table(odd(spark).limit(0)).count() == 0
    w = tokens.SequenceWriter(str(tmp_path / "x.arrow"), np.dtype("<u2"), 8, 2)
    data = np.arange(37, dtype="<u2")
    w.add(data[:20]), w.add(data[20:]), w.close()
    r = tokens.SequenceReader(str(tmp_path / "x.arrow"))
    assert np.concatenate(list(r.ids(5, 30))).tolist() == list(range(5, 35))
    ids, mask = r.sequence(4)
    assert ids[:5].tolist() == [32, 33, 34, 35, 36] and mask.tolist() == [True] * 5 + [False] * 3


def test_encoder_pieces():
    e = Encoder()
    texts = ["", " ", "  ", "a  b", " a", "a ", "a\n b\n\nc  \n d", "x" * 500 + " é", "it's 'tis don't''s", "tab\t x", "a \x1c b", "日本 語", "²x _a_", "<|endoftext|> hi", "w***!! ok,.;"]
    for t, raw in zip(texts, e.raw(texts)):
        assert np.frombuffer(raw, e.dtype).tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids


# ---- op4

def naive_base(text):
    out = [(m.start(), "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[ -]", "", m[0])
        if 14 <= len(d) <= 19 and pii.luhn(d):
            out.append((m.start(), "card", m.end()))
    out += [(m.start(), "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[1])))


def test_base_spans_against_regex(spark):
    texts = [r[0] for r in docs(spark).select("text").collect()]
    texts += ["a@b.c@d.e", "1.2.3.4.5.6.7.8", "x@y", "@a.b", "4111 1111 1111 1111-", "+1 (437) 555-0689..", "é.a@b-.c..d", "300.1.1.1 1.2.3.4", "1" * 3000, "a" * 3000 + "@b.c", "+1+1 23456789012"]
    assert [pii.base_spans(t) for t in texts] == [naive_base(t) for t in texts]


def found_in(texts):
    base = [pii.base_spans(t) for t in texts]
    spans = pii.added_spans(pa.array(texts, pa.string()), base, pii.trained())
    return [[(k, t[a:b]) for a, k, b in s] for t, s in zip(texts, spans)]


def test_field_on_unseen_sentences():
    texts = ["Call Jo at (212) 555-0147 today please.", "id 078-05-1120 of hers", "write to jo (at) mail (dot) com now", "the year 1999 was 12.5 fine", "version 1.2.3 of 2024-01-02", "", 'é de token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" of', "ou 4111111111111111 4111111111111111 é", "ou 4111111111111112 é"]
    found = found_in(texts)
    assert found[0] == [("phone", "(212) 555-0147")] and found[1] == [("id", "078-05-1120")] and found[2] == [("email", "jo (at) mail (dot) com")]
    assert found[3] == found[4] == found[5] == found[8] == []
    assert found[6] == [("secret", "24be64439e3e49cf46b2d7c90f3602a3d0b907ff")] and found[7] == [("card", "4111111111111111")] * 2
    long = " ".join(["plain words"] * 20_000 + ["write to jo (at) mail (dot) com now"] + ["plain"] * 5000)
    assert found_in([long, "x", long]) == [[("email", "jo (at) mail (dot) com")], [], [("email", "jo (at) mail (dot) com")]]


def test_field_precision_and_recall_on_held_out_sentences():
    made = pii._sentences(6, seed=99, parts=("wo", "lu", "kar", "ß", "pe", "ni", "gra", "to"))
    want = {(i, k, t[a:b].strip("\".,")) for i, (t, s) in enumerate(made) for a, b, k in s if k != "card"}
    got = {(i, k, w) for i, s in enumerate(found_in([t for t, _ in made])) for k, w in s if k != "card"}
    assert len(got & want) >= 0.9 * len(got) and len(got & want) >= 0.9 * len(want)


def test_windows_equal_whole_sequences():
    """Decoding by windows gives what one walk over the whole text gives, and pruning loses nothing."""
    field, rng = pii.trained(), np.random.default_rng(4)
    texts = [t for t, _ in pii._sentences(1, seed=7)]
    text = " ".join(texts[i] for i in rng.integers(0, len(texts), 120))
    codes, _, _ = pii._Shapes()(np.frombuffer(text.encode(), np.uint8))
    x = pii.features(codes, np.zeros(len(codes), np.int64))
    e, move = field.scores(x), field.move
    best, back = e[0].copy(), []
    for t in range(1, len(x)):
        z = best[:, None] + move
        back.append(z.argmax(0))
        best = z.max(0) + e[t]
    y = [int(best.argmax())]
    for b in reversed(back):
        y.append(int(b[y[-1]]))
    assert field.decode(x, np.zeros(len(x), np.int64)).tolist() == y[::-1]


def test_pii_edges(spark):
    rows = pii.find_personal_data(odd(spark)).collect()
    assert len(rows) == len(ODD) and all(r["spans"] == "" for r in rows)


# ---- op5

def test_quality_held_out(spark):
    big = SF.replace("sf0.001", "sf0.01")
    d, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    got = quality.classify(d, labels, carry=[]).join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 50
    good = [r["score"] for r in got if r["quality"] == 1]
    bad = [r["score"] for r in got if r["quality"] == 0]
    assert np.mean([a > b for a in good for b in bad]) > 0.97
    assert np.mean([r["predicted"] == 1 for r in got if r["quality"] == 1]) > 0.97


def test_votes_against_one_by_one_neighbours(spark):
    texts = [(r["text"] or "").encode() for r in docs(spark).orderBy("doc_id").limit(90).collect()]
    counts = quality.term_counts(np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])])
    labels = np.arange(60) % 3 > 0
    model = quality.Model(counts[:60].copy(), labels)
    z = model.project(quality._weigh(counts[60:], model.idf))
    for got, v in zip(model.score(counts[60:], block=7), z, strict=True):
        near = sorted(((float(v @ u), int(y)) for u, y in zip(model.vectors, labels, strict=True)), reverse=True)[: quality.NEIGHBOURS]
        w = [max(c, 0.0) ** quality.SHARPNESS for c, _ in near]
        assert got == pytest.approx(sum(a * y for a, (_, y) in zip(w, near, strict=True)) / sum(w), abs=1e-4)


def test_equal_ids_with_different_texts_are_scored_by_text(spark):
    d, labels = docs(spark), spark.read.parquet(f"{SF}/labels.parquet")
    two = d.where("doc_id % 50 = 0").select(F.lit(10**9).alias("doc_id"), "text").unionByName(d.select("doc_id", "text"))
    got = {r["text"]: set() for r in two.collect()}
    for r in quality.classify(two, labels).collect():
        got[r["text"]].add(r["score"])
    assert all(max(x) - min(x) < 1e-4 for x in got.values())  # single precision products, in other batches


def test_quality_edges(spark):
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 0), (None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    assert quality.classify(odd(spark), labels).count() == len(ODD)
    none = quality.classify(odd(spark), labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}


# ---- op6

def test_main_text_of_pages(spark):
    trees = html.trained()
    page = '<html><head><title>t</title></head><body><nav><a href="/">Home</a></nav><div class="cookie-notice"><p>We use cookies here.</p></div><main><article><h1>A &amp; B</h1><p>First  text,\n with <b>bold<br>words</b>.</p><script>x="</p>"</script><ul><li>one<li>two</ul></article></main><section class="comments"><p>I disagree with it.</p></section><footer>&copy; me</footer></body></html>'
    assert html.main_text(page, trees) == "A & B\nFirst text, with bold words.\none\ntwo"
    rows = spark.createDataFrame([(1, None, None), (2, "u", ""), (3, "u", "plain < text"), (3, "u", "<p"), (4, "u", page)], "page_id long, url string, html string")
    got = html.extract(rows).collect()
    assert len(got) == 5 and got[0]["text"] == "" and got[4]["n_chars"] == len(got[4]["text"]) > 0


def test_main_text_is_that_of_a_document(spark):
    flat = {" ".join((r["text"] or "").split()) for r in docs(spark).select("text").collect()}
    got = html.extract(spark.read.parquet(f"{SF}/pages.parquet")).collect()
    right = sum(" ".join(t.split()) in flat or " ".join(t.partition("\n")[2].split()) in flat for t in (r["text"] for r in got))
    assert got and right >= 0.95 * len(got)


def test_a_very_long_page_is_kept_whole():
    lines = [f"Sentence number {k} of a long article that goes on." for k in range(30_000)]
    page = "<html><body><nav><a href='/'>Home</a></nav><article>" + "".join(f"<p>{x}</p>" for x in lines) + "</article></body></html>"
    assert len(page) > html.CHUNK and html.main_text(page) == "\n".join(lines)


def test_decode_never_returns():
    parent = [-1, 0, 1, 2, 3]
    labels = html.decode(parent, np.array([-1.0, 5.0, -9.0, 3.0, -1.0]))
    assert labels.tolist() == [False, True, False, False, False]


# ---- op7

def test_language_model_base_and_gain(spark):
    d = docs(spark)
    got = {r["doc_id"]: r for r in lm.score_documents(d).collect()}
    rows = [(r["doc_id"], r["text"] or "") for r in d.collect()]
    train = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 != 2}
    words = {i: [*WORD.findall(t.translate(LOWER)), None] for i, t in rows}
    from collections import Counter

    c = Counter(w for i in train for w in words[i])
    n, v = sum(c.values()), len(c)
    for i, _ in rows:
        want = sum(np.log10((c[w] + 1) / (n + v + 1)) for w in words[i])
        assert got[i]["base_score"] == pytest.approx(want, abs=1e-6)
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(words[i]), sum(c[w] > 0 for w in words[i]), n)
        assert got[i]["held_out"] == (i not in train) and got[i]["score"] < 0


def naive_attention(flat, x, first):
    """Natural log probabilities (blocks, STEP, ROWS) of the next row, position by position in float64."""
    w = {k: v.astype(np.float64) for k, v in lm.unpack(flat).items()}
    line, out = x.ravel(), np.zeros((*x.shape, lm.ROWS))
    for i in range(x.size):
        block, at = divmod(i, lm.STEP)
        seen = range(i - at - (0 if first[block] else lm.STEP), i + 1)
        e = w["emb"][line]
        p = e @ w["project"]
        heads = []
        for h in range(lm.HEADS):
            q = p[i, h * lm.KEY : (h + 1) * lm.KEY]
            k = [p[j, lm._Q + h * lm.KEY : lm._Q + (h + 1) * lm.KEY] for j in seen]
            z = np.array([q @ kk + w["place"][h, i - j] for kk, j in zip(k, seen)])
            z = np.exp(z) / np.exp(z).sum()
            heads.append(sum(a * p[j, lm._K + h * lm.VALUE : lm._K + (h + 1) * lm.VALUE] for a, j in zip(z, seen)))
        s = e[i] + np.concatenate(heads) @ w["mix"]
        soft = lambda z: z - np.log(np.exp(z).sum())
        group, slot = soft(s @ w["group"] + w["group_bias"]), w["slot"] @ s + w["slot_bias"]
        out[block, at] = np.concatenate([group[g] + soft(slot[g * lm.SLOTS : (g + 1) * lm.SLOTS]) for g in range(lm.GROUPS)])
    return out


def test_attention_against_naive_and_finite_differences():
    rng = np.random.default_rng(0)
    flat = rng.normal(0, 0.3, lm.PARAMETERS).astype(np.float32)
    x, y = rng.integers(0, lm.ROWS, (4, lm.STEP)), rng.integers(0, lm.ROWS, (4, lm.STEP))
    x[:, ::2] %= 5
    first, real = np.array([True, False, True, False]), rng.random(x.shape) < 0.8
    want = naive_attention(flat, x, first)
    assert np.allclose(np.exp(want).sum(2), 1)
    hit = np.take_along_axis(want, y[..., None], 2)[..., 0]
    assert np.allclose(lm.Attention(flat).log_prob(x, y, first), hit, atol=1e-3)
    loss, g = lm.Attention(flat).gradient(x, y, first, real)
    assert loss == pytest.approx(-hit[real].mean(), abs=1e-3)
    at = 0
    for name, shape in lm.SHAPES.items():
        size = int(np.prod(shape))
        d = np.zeros(lm.PARAMETERS, np.float32)
        d[at : at + size] = rng.normal(0, 1, size)
        up, down = (lm.Attention(flat + np.float32(t) * d).gradient(x, y, first, real)[0] for t in (1e-3, -1e-3))
        assert (up - down) / 2e-3 == pytest.approx(float(g @ d), abs=2e-3, rel=1e-2), name
        at += size


def test_scores_do_not_depend_on_batches(monkeypatch):
    rng = np.random.default_rng(1)
    net = lm.Attention(rng.normal(0, 0.3, lm.PARAMETERS))
    x, y, first = rng.integers(0, lm.ROWS, (9, lm.STEP)), rng.integers(0, lm.ROWS, (9, lm.STEP)), np.arange(9) % 4 == 0
    whole = net.log_prob(x, y, first)
    monkeypatch.setattr(lm, "BATCH", 2)
    assert np.allclose(net.log_prob(x, y, first), whole, atol=1e-4)


def test_attention_looks_projections_up_and_bounds_its_exponents():
    rng = np.random.default_rng(2)
    x, y, first = rng.integers(0, lm.ROWS, (9, lm.STEP)), rng.integers(0, lm.ROWS, (9, lm.STEP)), np.arange(9) % 4 == 0
    for scale, small in ((0.3, True), (3.0, False)):
        net = lm.Attention(rng.normal(0, scale, lm.PARAMETERS))
        q, k, v, bounded = net.tables()
        assert bounded == small and q.shape == (lm.ROWS, lm.HEADS * lm.KEY) and (v.reshape(lm.ROWS, lm.HEADS, -1)[..., -1] == 1).all()
        got = [net.forward(x, first, (q, k, v, b)) for b in ((True, False) if small else (False,))]
        assert all(np.isfinite(g[-1]).all() and np.allclose(g[-1], got[0][-1], atol=1e-3) for g in got)
        p = net.w["emb"][x.ravel()] @ net.w["project"]
        assert np.allclose(got[0][1].swapaxes(1, 2).reshape(x.size, -1), p[:, : lm._Q], atol=1e-3)
        assert np.allclose(got[0][2][:, :, lm.STEP :].swapaxes(1, 2).reshape(x.size, -1), p[:, lm._Q : lm._K], atol=1e-3)


def test_language_model_learns_from_every_document_and_order(spark):
    keys = np.array([7, 2**40 + 2, 4, 9])
    assert np.sort(np.concatenate([lm._of_round(keys, k) for k in range(lm.ROUNDS)])).tolist() == [0, 1, 2, 3]
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    kept = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 != 2)
    calm, mixed = "one two " * 150, "one one two two " * 75  # the same words and ids, in another order
    scores = []
    for tail in (calm, mixed):
        rows = spark.createDataFrame([(kept, "a b " * 20 + tail), (held, mixed)], "doc_id long, text string").coalesce(1)
        scores.append(next(r["score"] for r in lm.score_documents(rows).collect() if r["doc_id"] == held))
    assert abs(scores[0] - scores[1]) > 1e-3


def test_language_model_beats_subword_bigrams_on_held_out_documents(spark):
    """Interpolated bigrams of subword ids, with the counts of all training documents, as an independent yardstick."""
    from collections import Counter

    d = spark.read.parquet(SF.replace("sf0.001", "sf0.01") + "/documents.parquet").select("doc_id", "text")
    enc = Encoder()
    rows = [(r[0], np.frombuffer(x, enc.dtype).tolist()) for r, x in zip(d.collect(), enc.raw([r[1] or "" for r in d.collect()]))]
    pairs, ones = Counter(), Counter()
    for i, ids in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            ones.update([*ids, -1])
            pairs.update(zip([-1, *ids], [*ids, -1]))
    lead = Counter()
    for (a, _), n in pairs.items():
        lead[a] += n
    total, kinds, want = sum(ones.values()), enc.size, 0.0
    for i, ids in rows:
        if zlib.crc32(str(i).encode()) % 7 == 2:
            for a, b in zip([-1, *ids], [*ids, -1]):
                want += np.log10(0.8 * pairs[a, b] / max(1, lead[a]) + 0.2 * (ones[b] + 1) / (total + kinds))
    got = sum(r["score"] for r in lm.score_documents(d).where("held_out").collect())
    print("model", got, "bigrams", want)
    assert got > want


def test_language_model_edges(spark):
    got = lm.score_documents(odd(spark)).collect()
    assert len(got) == len(ODD) and min(r["n_tokens"] for r in got) == 1
    assert lm.score_documents(odd(spark).limit(0)).count() == 0


def distributions(seed=0, blocks=9):
    """A small model of distributions on random text of a few rows, and its blocks."""
    rng = np.random.default_rng(seed)
    shape = attend.Shape(lm.ROWS, lm.STEP, lm.KEY)
    x, y, first, real, _ = lm._stream(rng.integers(0, 9, 16 * blocks - 40), np.array([0, 50, 16 * blocks - 90]), 0)
    pairs = attend.Pairs(lm.ROWS, lm.STEP, 2000)
    pairs.add(x, y, first, real)
    return shape, shape.start() + rng.normal(0, 0.3, shape.parameters).astype(np.float32), pairs.counts(), (x, y, first, real)


def test_pairs_of_windows_against_naive():
    _, _, counts, (x, y, first, real) = distributions()
    want = np.zeros_like(counts)
    for i in np.flatnonzero(real.ravel()):
        block, at = divmod(i, lm.STEP)
        for j in range(i - at - (0 if first[block] else lm.STEP), i + 1):
            want[min(i - j, 2), x.ravel()[j], y.ravel()[i]] += 1
    assert (counts == want).all() and want[2].sum() > want[1].sum() > 0
    share, value = attend.values(counts)
    assert np.allclose(value.reshape(counts.shape).sum(2), 1, atol=1e-4) and share.sum() == pytest.approx(1, abs=1e-5)
    t, x_, y_ = np.argwhere(counts == 1)[0]
    counts[t, x_, y_] = 0  # a pair that is seen once is left out as if it had never been seen
    assert attend.values(want, 1)[1].reshape(counts.shape)[t, x_, y_] == pytest.approx(attend.values(counts)[1].reshape(counts.shape)[t, x_, y_], rel=0.1)


def test_attention_over_distributions_against_naive_and_finite_differences(monkeypatch):
    shape, flat, counts, (x, y, first, real) = distributions()
    share, value = attend.values(counts)
    each, place = (t.astype(np.float64) for t in shape.unpack(flat))
    line, want, tables = x.ravel(), np.zeros(x.shape), value.reshape(counts.shape)
    for i in range(x.size):
        block, at = divmod(i, lm.STEP)
        seen = np.arange(i - at - (0 if first[block] else lm.STEP), i + 1)
        z = np.exp([*(each[line[seen], lm.KEY : 2 * lm.KEY] @ each[line[i], : lm.KEY] + place[i - seen]), each[line[i], -1]])
        p = z / z.sum() @ np.array([*(tables[min(i - j, 2), line[j]] for j in seen), share])
        assert p.sum() == pytest.approx(1, abs=1e-4)
        want[block, at] = np.log(p[y.ravel()[i]])
    net = attend.Mixture(shape, flat, (share, value))
    assert np.allclose(net.log_prob(x, y, first), want, atol=1e-3)
    monkeypatch.setattr(attend, "BATCH", 2)
    assert np.allclose(net.log_prob(x, y, first), want, atol=1e-3)
    loss, g = net.gradient(x, y, first, real)
    assert loss == pytest.approx(-want[real].mean(), abs=1e-3)
    rng = np.random.default_rng(1)
    for part in range(4):
        d = np.zeros(shape.parameters, np.float32)
        each, place = shape.unpack(d)
        view = (each[:, : lm.KEY], each[:, lm.KEY : -1], each[:, -1], place)[part]
        view[:] = rng.normal(0, 1, view.shape)
        up, down = (attend.Mixture(shape, flat + np.float32(t) * d, (share, value)).gradient(x, y, first, real)[0] for t in (1e-2, -1e-2))
        assert (up - down) / 2e-2 == pytest.approx(float(g @ d), abs=1e-3, rel=2e-2), part


def test_the_model_that_scores_costs_half_of_the_one_with_softmaxes_at_most():
    import time

    rng = np.random.default_rng(4)
    x, y, first, real = rng.integers(0, lm.ROWS, (192, lm.STEP)), rng.integers(0, lm.ROWS, (192, lm.STEP)), np.arange(192) % 40 == 0, np.ones((192, lm.STEP), bool)
    took = []
    for net in (lm._net(lm._SHAPE.start(), attend.values(np.zeros((attend.TABLES, lm.ROWS, lm.ROWS), np.int64))), lm._net(lm.start_weights(np.zeros((lm.ROWS, lm.ROWS))), None)):
        least = []
        for f in (lambda: net.log_prob(x, y, first), lambda: net.gradient(x, y, first, real)):
            f()
            times = []
            for _ in range(15):
                began = time.perf_counter()
                f()
                times.append(time.perf_counter() - began)
            least.append(min(times))
        took.append(sum(least))
    assert 2 * took[0] < took[1], took


def test_words_are_found_by_hash():
    rng = np.random.default_rng(5)
    known = np.unique(rng.integers(0, 2**63, 5000).astype(np.uint64))
    known[:50] = known[:50] & ~np.uint64(0xFFFF)  # many that want one slot
    known = np.unique(known)
    h = np.concatenate([known, known + np.uint64(1), rng.integers(0, 2**63, 3000).astype(np.uint64)])
    place = {k: i for i, k in enumerate(known.tolist())}
    assert lm._find(known, lm._slots(known), h).tolist() == [place.get(k, -1) for k in h.tolist()]
    assert (lm._find(known[:0], lm._slots(known[:0]), h) == -1).all()


def test_language_model_of_states_can_be_asked_for(spark):
    rows = docs(spark).limit(40)
    one, two = ({r["doc_id"]: r for r in lm.score_documents(rows, model=m).collect()} for m in lm.RATES)
    assert one.keys() == two.keys() and all(one[i]["base_score"] == pytest.approx(two[i]["base_score"]) and one[i]["score"] != two[i]["score"] < 0 for i in one)
    with pytest.raises(ValueError):
        lm.score_documents(rows, model="other")


# ---- op8

def naive_fingerprint(text):
    w = WORD.findall(text.translate(LOWER))
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def naive_classes(fps):
    ids, root = sorted(fps), {}
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(ids, 2):
        if bin(fps[a] ^ fps[b]).count("1") <= 2:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in ids}


def test_simhash_against_all_pairs(spark):
    rows = {r["doc_id"]: r["text"] or "" for r in docs(spark).collect()}
    fps = {i: naive_fingerprint(t) for i, t in rows.items()}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs(spark)).collect()}
    classes = naive_classes(fps)
    assert got == {i: (f"{fps[i]:016x}", classes[i]) for i in rows}


@pytest.mark.parametrize("crowd", [1, 24])
def test_links_lose_no_component(spark, crowd):
    rng = np.random.default_rng(5)
    fps = set()
    for _ in range(12):
        x = int(rng.integers(0, 1 << 63))
        for _ in range(12):
            for b in rng.integers(0, 64, int(rng.integers(0, 3))):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    rows = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    found = components(simhash.links(rows, crowd)).collect()
    of = {r[0]: r[1] for r in found}
    classes = naive_classes({i: f for i, f in enumerate(fps)})
    groups = {}
    for i, c in classes.items():
        groups.setdefault(c, set()).add(of.get(simhash._signed(fps[i]), simhash._signed(fps[i])))
    assert all(len(g) == 1 for g in groups.values()) and len(set.union(*groups.values())) == len(groups)


def test_exploded_rows_are_never_broadcast(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(simhash, "materialize", lambda df, what: plans.append(df) or df)
    plans.append(simhash.links(spark.range(2000).select(F.xxhash64("id").alias("fp")), crowd=1))
    assert len(plans) == 2
    for df in plans:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_keep_first_of_null_and_repeated_ids(spark):
    words = {c: " ".join(f"{c}{i * i}" for i in range(30)) for c in "XYUPQR"}

    def kept(rows):
        made = spark.createDataFrame([(i, words[c]) for i, c in rows], "doc_id long, text string")
        return sorted((r["doc_id"] or 0, r["text"][0]) for r in simhash.keep_first(made).collect())

    assert kept([(5, "X"), (None, "X"), (None, "U")]) == [(0, "U"), (5, "X")]
    assert kept([(5, "X"), (5, "Y"), (3, "Y")]) == [(3, "Y"), (5, "X")]
    assert kept([(None, "P"), (None, "P"), (None, "Q")]) == [(0, "P"), (0, "Q")]
    assert kept([(None, "P"), (None, "Q"), (8, "R"), (8, "R")]) == [(0, "P"), (0, "Q"), (8, "R")]


def test_simhash_edges(spark):
    got = simhash.near_duplicates(odd(spark)).collect()
    assert len(got) == len(ODD) and {r["component_id"] for r in got if r["doc_id"] in (1, 2)} == {1}
    assert simhash.near_duplicates(odd(spark).limit(0)).count() == 0
    kept = simhash.keep_first(odd(spark))
    assert kept.columns == odd(spark).columns and sorted(r["doc_id"] for r in kept.where("doc_id IS NOT NULL").collect()) == [1, 3, 4]


# ---- op9

def naive_hits(text, items):
    split = lambda t: [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER)) if x]
    w, hit, found = split(text), set(), set()
    for item, t in items:
        p = split(t)
        for i in range(max(1, len(p) - 12) if p else 0):
            q = p[i : i + 13]
            for j in range(len(w) - len(q) + 1):
                if w[j : j + len(q)] == q:
                    hit |= set(range(j, j + len(q)))
                    found.add(item)
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("block", [1_000_000, 40])
def test_contamination_against_naive(spark, block):
    items = [(1, "a b c d e f g h i j k l m n"), (2, "Short One"), (3, "x"), (10, None), (11, "b c d e f g h i j k l m n"), (4, "q r q r q")]
    texts = ["A b-c d e f g h i j k l m n o p", "short one short ONE", "x y x", None, "", "q r q r q r q", "a b c d e f g h i j k l", "zz " * 100 + "x", "short, one"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    d = odd(spark, [(i, t, None) for i, t in enumerate(texts)])
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontam.contamination(d, bench, block_chars=block).collect()}
    assert got == {i: naive_hits(t, [(str(a), b) for a, b in items]) for i, t in enumerate(texts)}
    assert decontam.contamination(d, bench.limit(0)).where("contaminated").count() == 0


# ---- op10

def test_sketches_against_sorted_ids(spark):
    d = docs(spark)
    rows = sorted((r["doc_id"], r["text"] or "") for r in d.collect())
    got = {r["doc_id"]: r for r in sketch.fingerprint_edits(d).collect()}
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        m = len(t) // 4
        edited = t[: len(t) - m] + following[:m]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[i]["n_chars"] == len(t)
        a, b = (lambda x: {tuple(x[j : j + 5]) for j in range(max(1, len(x) - 4))} if x else set())(WORD.findall(t.translate(LOWER))), (lambda x: {tuple(x[j : j + 5]) for j in range(max(1, len(x) - 4))} if x else set())(WORD.findall(edited.translate(LOWER)))
        assert abs(got[i]["near_edited"] - (len(a & b) / len(a | b) if a | b else 1)) < 0.25
        assert sketch.encode(sketch.sketch(t)) == got[i]["fingerprint"]


def test_sketch_merge_and_edges(spark):
    a, b = "one two three four five six seven " * 3 + " ".join(map(str, range(900))), " ".join(map(str, range(300, 1500)))
    assert np.array_equal(sketch.merge(sketch.sketch(a), sketch.sketch(b)), np.unique(np.concatenate([np.unique(sketch.shingles(sketch.word_hashes(sketch.LOWER[np.frombuffer(t.encode(), np.uint8)])[0], 5)) for t in (a, b)]))[:128])
    assert abs(sketch.distinct(sketch.sketch(b)) - 1196) < 400
    got = sketch.fingerprint_edits(odd(spark)).collect()
    assert len(got) == len(ODD)
    one = sketch.fingerprint_edits(odd(spark).where("doc_id = 4")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert sketch.fingerprint_edits(odd(spark).limit(0)).count() == 0


def test_containment_and_next_against_sets(spark):
    whole, part = [f"w{k}" for k in range(1200)], [f"w{k}" for k in range(400, 700)]
    a, b = sketch.sketch(" ".join(part)), sketch.sketch(" ".join(whole))
    assert sketch.containment(a, b) > 0.75 and sketch.containment(b, a) == pytest.approx(296 / 1196, abs=0.12)
    few = sketch.sketch(" ".join(part[:60])), sketch.sketch(" ".join(part[30:90]))
    assert sketch.containment(*few) == 26 / 56 and sketch.containment(few[0][:0], few[1]) == 1.0
    rows = sorted((r["doc_id"], r["text"] or "") for r in docs(spark).collect())
    likeness = {r["doc_id"]: r["near_next"] for r in sketch.fingerprint_edits(docs(spark)).collect()}
    for k, (i, t) in enumerate(rows):
        assert likeness[i] == sketch.resemblance(sketch.sketch(t), sketch.sketch(rows[(k + 1) % len(rows)][1]))


# ---- pipeline

def test_stages_keep_the_columns_of_their_input(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    d = docs(spark).limit(40).withColumn("score", F.lit("mine")).withColumn("n_words", F.lit("mine")).withColumn("_words", F.lit("mine")).withColumn("key", F.lit(7)).withColumn("contaminated", F.lit(2))
    for name, stage in pipeline.STAGES[:-1]:
        got = stage(spark, d, SF)
        assert got.columns == d.columns and dict(got.dtypes) == dict(d.dtypes), name
        rows = got.collect()
        assert rows and all(r["score"] == r["n_words"] == r["_words"] == "mine" and r["key"] == 7 and r["contaminated"] == 2 for r in rows), name


def test_string_ids(spark):
    d = docs(spark).withColumn("doc_id", F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 7, "0")))
    labels = spark.read.parquet(f"{SF}/labels.parquet").withColumn("doc_id", F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 7, "0")))
    plain = {f"d{r['doc_id']:07d}": r for r in tokens.token_table(docs(spark)).collect()}
    assert {r["doc_id"]: (r["start"], r["ids_crc32"]) for r in tokens.token_table(d).collect()} == {i: (r["start"], r["ids_crc32"]) for i, r in plain.items()}
    near = {f"d{r['doc_id']:07d}": r["near_next"] for r in sketch.fingerprint_edits(docs(spark)).collect()}
    assert {r["doc_id"]: r["near_next"] for r in sketch.fingerprint_edits(d).collect()} == near
    assert quality.classify(d, labels, carry=[]).count() == d.count()


def test_ids_that_tie_fill_many_parts(spark):
    from feedloom.llm._shared import range_ids

    d = docs(spark).select(F.when(F.col("doc_id") % 3 == 0, F.lit(None)).when(F.col("doc_id") % 3 == 1, F.lit(77)).otherwise(F.col("doc_id") + 100).alias("doc_id"), "text")
    dealt, _ = range_ids(d, "doc_id", 12, F.xxhash64("text"))
    parts = {}
    for r in dealt.select("doc_id", "_part").collect():
        parts.setdefault(r["_part"], []).append(r["doc_id"])
    assert max(map(len, parts.values())) < d.count() / 5 and sum(x == [None] * len(x) for x in parts.values()) > 1
    line = [i for p in sorted(parts) for i in sorted(parts[p], key=lambda x: -1 if x is None else x)]
    assert [(-1 if x is None else x) for x in line] == sorted(-1 if x is None else x for x in line)


# ---- bounds of the fit, of the tables, and keys of documents

def test_quality_fits_bounded_rows_of_repeated_ids(spark):
    rows = [(1, f"good text {k}") for k in range(3000)] + [(2, "bad %% text"), (4, "fine text here"), (6, "worse %% stuff"), (8, "more text")]
    held = {r["i"] for r in spark.range(1, 10).select(F.col("id").alias("i"), quality.held_out("id").alias("h")).where("h").collect()}
    labels = spark.createDataFrame([(i, i % 4 == 0 or i == 1) for i in (1, 2, 4, 6, 8) if i not in held], "doc_id long, good boolean").select("doc_id", F.col("good").cast("int").alias("quality"))
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for most in (2, 5):
        made = quality.fit(table, labels, most=most)
        kept = np.bincount(made.labels.astype(int), minlength=2)
        assert 0 < kept.max() <= most
        again = quality.fit(table.repartition(2), labels, most=most)
        assert np.array_equal(np.sort(made.vectors.sum(1)), np.sort(again.vectors.sum(1))) or np.allclose(np.sort(made.labels), np.sort(again.labels))


def test_decontamination_tables_are_small():
    import tracemalloc

    rng = np.random.default_rng(1)
    items = [(str(k), " ".join(f"w{i}" for i in rng.integers(0, 30_000, 2_000))) for k in range(80)]
    chars = sum(len(t) for _, t in items)
    tracemalloc.start()
    made = decontam.Patterns(items)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert chars > 900_000 and held < 70 * chars
    w = decontam.words(items[3][1])[100:160]
    assert made.search([b"x", *w, b"y"]) == ([(k, k + 13) for k in range(1, 49)], {"3"})


def test_decontamination_of_every_length_against_all_positions():
    rng = np.random.default_rng(2)
    say = lambda n: " ".join(f"t{i}" for i in rng.integers(0, 6, n))
    items = [(f"i{k}", say(int(n))) for k, n in enumerate(rng.integers(0, 18, 40))] + [("i3", "t1"), ("again", "t1")]
    made = decontam.Patterns(items)
    windows = [(tuple(w[i : i + 13]), item) for item, t in items for w in [decontam.words(t)] for i in range(max(1, len(w) - 12)) if w]
    for _ in range(60):
        w = decontam.words(say(int(rng.integers(0, 50))) + " other")
        spans, found = made.search(w)
        want = {(i, i + len(p)) for p, _ in windows for i in range(len(w) - len(p) + 1) if tuple(w[i : i + len(p)]) == p}
        assert set(spans) == want and found == {item for p, item in windows if any(tuple(w[i : i + len(p)]) == p for i in range(len(w) - len(p) + 1))}


def test_language_model_keys_differ_between_parts(spark):
    table = spark.createDataFrame([(k % 3, f"text {k}") for k in range(40)], "doc_id long, text string").repartition(7)
    keys = [r["key"] for r in lm._encoded(table, "doc_id", "text", lm.tokenizer_path()).collect()]
    assert len(set(keys)) == 40 and len({k >> 33 for k in keys}) > 1
