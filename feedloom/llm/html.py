"""Main text of web pages: boosted trees over DOM nodes, decoded over the tree.

A page is read into nodes (elements and their runs of text). Boosted trees give every node with text the log-odds of
being main text, from its tag and its ancestors' tags, the words of class, id and role attributes up the path, depth,
text and link density of its subtree and of its siblings. A dynamic programme over the tree then picks the labels with
the greatest total: along every path from the root the labels go "not yet", "main", "left again", and never back. So
nothing inside a dropped part of an article comes back, and two nodes on one path can't contradict each other.

The trees are trained on pages that a small generator makes with known main text, in many layouts.
"""

from __future__ import annotations

import html
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm._boost import Boosted
from feedloom.llm._shared import ship

_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?>[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|[="'])*+)(?:>|\Z))""", re.S)
_MARKS = re.compile(r"""\b(?:class|id|role|aria-label|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)

# What HTML says of its elements.
RAW = frozenset("script style textarea title noscript iframe template svg math object select option datalist button canvas audio video xmp noembed noframes".split())
RAW_TEXT = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table caption tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("td th tr tbody thead tfoot caption html body".split())
CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dd": ("dd dt", ("dl",)), "dt": ("dd dt", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}

#: Tags and attribute words that the features count.
TAGS = ("article", "main", "section", "div", "p", "h1", "h2", "h3", "ul", "ol", "li", "a", "nav", "header", "footer", "aside", "form", "table", "td", "blockquote", "pre", "span", "b", "i", "em", "strong", "label", "figure", "figcaption", "dl", "address", "body")
WORDS = (
    ("article", "content", "main", "post", "entry", "story", "body", "text", "articlebody"),
    ("nav", "navigation", "menu", "navbar", "breadcrumb", "breadcrumbs", "pagination", "tabs", "toc"),
    ("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "banner", "promotion"),
    ("sidebar", "aside", "related", "widget", "rail", "recommended", "trending", "complementary"),
    ("footer", "copyright", "legal", "foot", "contentinfo", "colophon"),
    ("header", "masthead", "head", "topbar", "logo"),
    ("comment", "comments", "reply", "replies", "discussion", "disqus", "respond"),
    ("cookie", "consent", "notice", "gdpr", "modal", "popup", "alert", "subscribe", "newsletter", "share", "social", "login", "signup", "search"),
)
_WORD_OF = {w: k for k, words in enumerate(WORDS) for w in words}
_TAG_OF = {t: i for i, t in enumerate(TAGS)}
_SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")


class Page:
    """Nodes of a page in document order: parent, tag, marks, and runs of text (node, text)."""

    def __init__(self, source: str):
        self.parent, self.tag, self.marks, self.hidden = [-1], ["#root"], [0], [False]
        self.runs: list[tuple[int, str]] = []
        self.breaks: set[int] = set()
        at, stack = 0, [0]
        find = _TAG.search
        while True:
            lt = source.find("<", at)
            m = _TAG.match(source, lt) if lt >= 0 else None
            if lt >= 0 and m is None:
                following = source.find("<", lt + 1)
                end = following if following >= 0 else len(source)
                self._text(stack[-1], source[at:end])
                at = end
                if at >= len(source):
                    break
                continue
            self._text(stack[-1], source[at : lt if lt >= 0 else len(source)])
            if m is None:
                break
            at = m.end()
            if not m[2]:
                continue
            name = m[2].lower()
            if m[1]:
                self._close(stack, name)
                continue
            if name == "br" or name == "wbr":
                self._text(stack[-1], " " if name == "br" else "")
                continue
            if name in CLOSES_P:
                self._close(stack, "p", True)
            if name in CLOSES:
                names, stops = CLOSES[name]
                for i in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[i]] in stops:
                        break
                    if self.tag[stack[i]] in names.split():
                        del stack[i:]
                        break
            if name in VOID:
                if name in BLOCK:
                    self._node(stack[-1], name, m[3])
                continue
            if name in RAW_TEXT:
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(source, at)
                at = end.end() if end else len(source)
                continue
            node = self._node(stack[-1], name, m[3])
            if not m[3].rstrip().endswith("/") or name in BLOCK:
                stack.append(node)

    def _node(self, parent: int, name: str, attributes: str) -> int:
        self.parent.append(parent)
        self.tag.append(name)
        marks = 0
        if attributes and not attributes.isspace():
            for a, b, c in _MARKS.findall(attributes):
                for w in _SPLIT.split(a or b or c):
                    k = _WORD_OF.get(w.lower())
                    marks |= 0 if k is None else 1 << k
        self.marks.append(marks)
        self.hidden.append(name in RAW or name == "head" or bool(attributes and _HIDDEN.search(attributes)))
        return len(self.tag) - 1

    def _text(self, node: int, text: str) -> None:
        if text:
            self.runs.append((node, text))

    def _close(self, stack: list[int], name: str, scoped: bool = False) -> None:
        for i in range(len(stack) - 1, 0, -1):
            tag = self.tag[stack[i]]
            if tag == name:
                del stack[i:]
                return
            if scoped and tag in BLOCK or not scoped and name not in BLOCK and tag in BLOCK:
                return


def page_features(page: Page) -> tuple[np.ndarray, np.ndarray]:
    """(features of each node, characters of its own text)."""
    n = len(page.tag)
    own = np.zeros(n)
    marks_of_text = np.zeros(n)
    for node, text in page.runs:
        bare = len(text.strip())
        own[node] += bare
        marks_of_text[node] += text.count(".") + text.count(",")
    parent = page.parent
    text, links, below, signs, paragraphs = own.tolist(), [0.0] * n, [1.0] * n, marks_of_text.tolist(), [0.0] * n
    tag = [_TAG_OF.get(t, -1) for t in page.tag]
    for i in range(n - 1, 0, -1):
        p = parent[i]
        if page.tag[i] == "a":
            links[i] = text[i]
        if page.tag[i] == "p":
            paragraphs[i] += 1
        text[p] += text[i]
        links[p] += links[i]
        below[p] += below[i]
        signs[p] += signs[i]
        paragraphs[p] += paragraphs[i]
    depth, path_tags, path_marks = [0.0] * n, [0] * n, [0] * n
    count, rank = [0.0] * n, [0.0] * n
    for i in range(1, n):
        p = parent[i]
        depth[i] = depth[p] + 1
        path_tags[i] = path_tags[p] | (1 << tag[i] if tag[i] >= 0 else 0)
        path_marks[i] = path_marks[p] | page.marks[i]
        rank[i] = count[p]
        count[p] += 1
    path_tags, path_marks, own_marks = (np.array(v, np.int64) for v in (path_tags, path_marks, page.marks))
    up = np.array(parent)
    up[0] = 0
    tag, text, links, below, signs, paragraphs, depth, count, rank = (np.array(v, float) for v in (tag, text, links, below, signs, paragraphs, depth, count, rank))
    total = max(text[0], 1)
    key = ("nav", "header", "footer", "aside", "form", "article", "main", "section", "a", "ul", "table", "label")
    bits = lambda v, ks: (v[:, None] >> np.array(ks)) & 1
    cols = [tag, tag[up], depth, np.log1p(text), np.log1p(own), text / total, links / np.maximum(text, 1), np.log1p(text / below), np.log1p(below), signs / np.maximum(text, 1) * 100, paragraphs, rank, count[up], text / np.maximum(text[up], 1), links[up] / np.maximum(text[up], 1), np.log1p(text[up]), paragraphs[up], np.arange(n) / n]
    every = range(len(WORDS))
    flags = [bits(path_tags, [_TAG_OF[t] for t in key]), bits(own_marks, every), bits(path_marks, every)]
    return np.concatenate([np.stack(cols, 1), *flags], 1), own


def decode(parent: list[int], gain: np.ndarray) -> np.ndarray:
    """Main nodes: labels 0 "not yet", 1 "main", 2 "left again" that never fall along a path, of greatest total gain.

    ``gain`` is what a node gives when it is main; it gives 0 otherwise.
    """
    n = len(parent)
    before, main = [0.0] * n, gain.tolist()  # the best of a subtree whose root is "not yet", or "main"; "left again" gives 0
    for i in range(n - 1, 0, -1):
        p, a, b = parent[i], before[i], main[i]
        before[p] += a if a > b else b
        main[p] += b if b > 0 else 0.0
    label = [0] * n
    label[0] = int(main[0] > before[0])
    for i in range(1, n):
        at = label[parent[i]]
        label[i] = 2 if at == 2 else (1 if main[i] > 0 else 2) if at == 1 else int(main[i] > before[i])
    return np.array(label) == 1


def blocks(page: Page, keep: np.ndarray) -> str:
    """Text of the kept nodes: blocks in page order, white space turned into one blank, one newline between."""
    out: list[str] = []
    held: list[str] = []
    last = -1
    block = [0] * len(page.tag)
    for i in range(1, len(page.tag)):
        block[i] = i if page.tag[i] in BLOCK else block[page.parent[i]]
    seen = 0
    for node, text in page.runs:
        fresh = any(page.tag[k] in BLOCK for k in range(seen + 1, node + 1)) if node > seen else False
        if block[node] != last or fresh:
            out.append("".join(held))
            held, last = [], block[node]
        seen = max(seen, node)
        if keep[node]:
            held.append(text)
    out.append("".join(held))
    clean = (" ".join(html.unescape(x).split()) for x in out)
    return "\n".join(x for x in clean if x)


# ---- training pages ----------------------------------------------------------------------------------------------

_FILL = ("the", "of", "and", "der", "die", "que", "de", "la", "thing", "ment", "tion", "keit", "ción", "over", "with", "ander", "ontion", "elle", "für", "has")


def training_page(rng: random.Random) -> str:
    """A page whose main text stands in elements marked with the attribute ``m``."""
    say = lambda a, b, end=".": " ".join(rng.choice(_FILL) + rng.choice(("", "", "s", ",")) for _ in range(rng.randint(a, b))).capitalize() + end
    pick = rng.choice
    links = lambda k: "<ul>" + "".join(f'<li><a href="/{i}">{say(1, 3, "")}</a></li>' for i in range(k)) + "</ul>"

    def named(tag: str, names: str, inner: str) -> str:
        how = rng.random()
        if how < 0.5:
            return f"<{tag}>{inner}</{tag}>" if tag != "div" else f'<div class="{pick(names.split())}">{inner}</div>'
        return f'<{pick(("div", tag, "section"))} {pick(("class", "id"))}="{pick(("", "site-", "page ", "x"))}{pick(names.split())}">{inner}</div>'

    def paragraph() -> str:
        words = rng.choice(((1, 3), (4, 20), (20, 90), (60, 300)))
        tag = pick(("p", "p", "p", "p", "h2", "blockquote", "li", "div", "pre"))
        inner = say(*words)
        if rng.random() < 0.2:
            inner += f' <a href="/x">{say(1, 4, "")}</a> {say(2, 12)}'
        if rng.random() < 0.15:
            inner = f"<{pick(('b', 'em', 'span'))} m>{inner}" + pick(("", "</b>"))
        text = f"<{tag} m>{inner}</{tag}>"
        if tag == "li":
            more = "".join(f"<li m>{say(1, pick((2, 5, 30)))}" + pick(("</li>", "")) for _ in range(rng.randint(0, 5)))
            return (f"<{pick(('ul', 'ol'))} m>" if rng.random() < 0.9 else "<ul m>") + text + more + "</ul></ol>"
        return text

    advert = lambda: named("div", "ad ads advert promo sponsored banner", f"<p>{say(2, 25)}</p>" if rng.random() < 0.4 else say(2, 25))
    before = [named("nav", "nav menu navbar breadcrumb", links(rng.randint(2, 9)))]
    if rng.random() < 0.6:
        before.insert(0, named("header", "header masthead topbar", f"<h1>{say(1, 4, '')}</h1><p>{say(2, 8)}</p>" if rng.random() < 0.5 else say(1, 5)))
    if rng.random() < 0.6:
        before.append(advert())
    if rng.random() < 0.4:
        before.append(named("div", "cookie notice consent alert popup", f"<p>{say(6, 30)}</p><button>ok</button>"))
    if rng.random() < 0.3:
        before.append(named("form", "search login newsletter signup", f"<label>{say(1, 4)}</label><input><p>{say(2, 10)}</p>"))
    body = [f"<h1 m>{say(2, 9, '')}</h1>"] if rng.random() < 0.8 else []
    for _ in range(pick((1, 2, 4, 8, 15))):
        body.append(paragraph())
        if rng.random() < 0.06:
            body.append(advert())
    if rng.random() < 0.15:
        body.append(named("aside", "related sidebar recommended", f"<h3>{say(1, 3)}</h3>{links(3)}"))
    inner = "".join(body)
    main = pick((f"<article m>{inner}</article>", f"<main m>{inner}</main>", f"<main><article m>{inner}</article></main>", f'<div {pick(("class", "id"))}="{pick(("content", "post", "entry-content", "article-body", "story", "main"))}" m>{inner}</div>', f"<section m>{inner}</section>", f"<div><div m>{inner}</div></div>"))
    after = []
    if rng.random() < 0.5:
        after.append(named("section", "comments comment replies discussion", "".join(f'<div class="{pick(("comment", "reply", "c"))}"><b>{say(1, 2, "")}</b><p>{say(3, 60)}</p></div>' for _ in range(rng.randint(1, 6)))))
    if rng.random() < 0.5:
        after.append(named("aside", "sidebar related widget rail", f"<h3>{say(1, 3)}</h3>{links(rng.randint(2, 6))}<p>{say(3, 30)}</p>"))
    if rng.random() < 0.4:
        after.append(advert())
    after.append(named("footer", "footer copyright legal", f"&copy; {say(2, 20)}" if rng.random() < 0.6 else f"<p>{say(3, 20)}</p>{links(3)}"))
    if rng.random() < 0.25:
        before, after = before[:1], before[1:] + after
    return f"<html><head><title>{say(2, 6)}</title></head><body>{''.join(before)}{main}{''.join(after)}</body></html>"


@lru_cache(1)
def trained(pages: int = 500, seed: int = 11) -> Boosted:
    """Trees fitted to generated pages; the same in every run."""
    rng = random.Random(seed)
    xs, ys, ws = [], [], []
    for _ in range(pages):
        source = training_page(rng)
        page = Page(source)
        x, own = page_features(page)
        main = _marked(source)
        y = np.zeros(len(page.tag))
        for i in range(1, len(page.tag)):
            y[i] = main[i]
        xs.append(x[1:])
        ys.append(y[1:])
        ws.append(np.where(own[1:] > 0, 1.0, 0.5))
    x, y, w = np.concatenate(xs), np.concatenate(ys), np.concatenate(ws)
    return Boosted().fit(x, y, w)


def _marked(source: str) -> list[bool]:
    """Which nodes carry the mark ``m``, in the order in which ``Page`` numbers them."""
    out: list[bool] = []

    class Probe(Page):
        def _node(self, parent, name, attributes):
            out.append(bool(re.search(r"(?:^|\s)m$", attributes)))
            return super()._node(parent, name, attributes)

    Probe(source)
    return [False, *out]


def main_text(source: str, trees: Boosted | None = None) -> str:
    """Main text of one page; see ``extract``."""
    return main_texts([source], trees or trained())[0]


def main_texts(sources: list[str], trees: Boosted) -> list[str]:
    pages = [Page(s) for s in sources]
    feats = [page_features(p) for p in pages]
    scores = trees.score(np.concatenate([x for x, _ in feats])) if feats else np.zeros(0)
    out, at = [], 0
    for page, (x, own) in zip(pages, feats, strict=True):
        s = scores[at : at + len(x)]
        at += len(x)
        gain = np.clip(s, -6, 6) * (0.3 + np.log1p(own) / 4)
        gain[0] = -1.0
        hidden = page.hidden[:]
        for i in range(1, len(hidden)):
            hidden[i] = hidden[i] or hidden[page.parent[i]]
        gain = np.where(hidden, -1e6, gain)
        out.append(blocks(page, decode(page.parent, gain)))
    return out


#: Characters of pages read into nodes at once.
CHUNK = 1_000_000


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages(page_id, url, html)``, repeated rows and nulls included.

    Null and empty pages give an empty text, as do pages without main text. A page is kept whole whatever its length;
    a page cut off within a tag ends there. Other columns are not read.
    """
    spark = pages.sparkSession
    ship(spark)
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    shared = spark.sparkContext.broadcast(trained())

    def scan(batches):
        trees = shared.value
        for batch in batches:
            sources, texts, i = batch.column(2).to_pylist(), [], 0
            while i < len(sources):
                j, size = i, 0
                while j < len(sources) and (j == i or size + len(sources[j]) <= CHUNK):
                    size += len(sources[j])
                    j += 1
                texts += main_texts(sources[i:j], trees)
                i = j
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    return rows.mapInArrow(scan, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
