"""Main text of web pages by a recurrent block labeller.

A page is cut into blocks: runs of text between the tags that start or end a block. Each block has a tag path (open elements with their
classes and ids) and words. Both are hashed into vectors: the innermost element, all elements around it, and all words. A bidirectional LSTM in
numpy reads the page's sequence of blocks and labels each as
main text or not, so every label sees the whole page. The network is trained on pages made by a seeded rule, with navigation,
adverts, notices, sidebars, forms, comments and footers around articles of many layouts. It is about 100 kB and trained once per process.

What a reader never sees is not a block: scripts, styles, templates, comments in the markup, the head, drop-down lists and drawings.

Text: character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined by line feeds in page order.

Defined cases. Null or empty html: empty text. Markup that is cut off or not closed is read as far as it goes; an unclosed tag at the end is
markup. A quote opens a value only after ``=``, and only if it is closed before white space or the tag's end; else the tag ends at the next ``>``. An unclosed
element that isn't seen ends with the element around it; scripts and styles alone run to the end of the page, as in browsers.
Pages without a block of main text: empty. A block's label depends on its page alone; ties go to main text.
Null ids and repeated rows stay as they are. Empty table: empty result. Pages of any length and depth are read whole, in linear time. Extra columns are
not read, so their names cannot clash.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import map_batches

# Fixed values of HTML: elements without content, with raw text, with content that isn't shown, of these the ones that blocks end, those that go with the flow of a line, that end a
# paragraph, that end one of their own kind, and that stand in the head.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
RAW = set("script style textarea title iframe xmp".split())
HIDDEN = set("head noscript object select svg template datalist math".split())
BROKEN_OUT_OF = ("select", "svg", "datalist", "math")
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
CLOSED_BY_P = set("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ENDS_ITS_KIND = set("li tr td th dt dd option".split())
IN_HEAD = set("base link meta noscript script style template title".split())

LEAF_DIM, PATH_DIM, WORD_DIM, EXTRA, HIDDEN_DIM = 64, 128, 32, 8, 24
#: Words of a block that add up as they are; the sum over more is scaled to the length of one over so many.
WORDS = 24
MODEL_PAGES, EPOCHS = 1200, 8
#: Blocks whose inputs are multiplied at once, and blocks of a batch of pages with their padding.
STEPS, BLOCKS = 4096, 20_000

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<![^>]*+(?:>|\Z)|<\?[^>]*+(?:>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')(?=[\s/>])|=)*+)(?:>|\Z)""",
    re.S,
)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_UNSEEN = re.compile(r"display\s*:\s*none", re.I)
_SPACE = re.compile(r"\s+")
_PART = re.compile(r"[a-z]+")


class Element:
    """An open element: tag, names (tag and parts of classes, ids and roles; none for those in the flow of a line) and the element around it."""

    __slots__ = ("hidden", "names", "tag", "up", "vector")

    def __init__(self, tag: str, names: tuple[str, ...], up: Element | None):
        self.tag, self.names, self.up = tag, names, up
        self.hidden = tag in HIDDEN
        self.vector: tuple[np.ndarray, np.ndarray] | None = None


Block = tuple[Element | None, str, int]


def path(element: Element | None) -> tuple[str, ...]:
    """Elements from the outside in, each a tag with its names, as ``div.ad``."""
    out = []
    while element:
        if element.names:
            out.append(".".join(element.names))
        element = element.up
    return tuple(reversed(out))


def _names_of(tag: str, attributes: str) -> tuple[str, ...]:
    names = [tag]
    for kind, value in _NAMES.findall(attributes):
        kind = kind.lower()
        if kind == "style":
            names += ["hidden"] if _UNSEEN.search(value) else []
        else:
            names += [kind] if kind in ("hidden", "aria-hidden") else _PART.findall(value.lower())
    return tuple(names)


class _Reader:
    def __init__(self) -> None:
        self.out: list[Block] = []
        self.stack: list[Element] = []
        self.open: Counter[str] = Counter()
        self.unseen = self.linked = 0
        self.held: list[str] = []

    def text(self, text: str) -> None:
        if not self.unseen:
            self.held.append(text)
            if self.open["a"]:
                self.linked += len(text)

    def flush(self) -> None:
        text = _SPACE.sub(" ", html.unescape("".join(self.held))).strip() if self.held else ""
        if text:
            inner = self.stack[-1] if self.stack else None
            while inner and not inner.names:
                inner = inner.up
            self.out.append((inner, text, self.linked))
        self.held.clear()
        self.linked = 0

    def pop_to(self, tag: str) -> None:
        while self.open[tag]:
            gone = self.stack.pop()
            self.open[gone.tag] -= 1
            self.unseen -= gone.hidden
            if gone.tag == tag:
                return

    def start(self, tag: str, attributes: str) -> None:
        if self.open["head"] and tag not in IN_HEAD:
            self.pop_to("head")
        if tag not in INLINE and tag not in BROKEN_OUT_OF and tag != "object":
            if not self.unseen:
                self.flush()
            if tag in CLOSED_BY_P and self.unseen:
                for outer in BROKEN_OUT_OF:
                    self.pop_to(outer)
                if not self.unseen:
                    self.flush()
            if tag in CLOSED_BY_P and self.open["p"]:
                self.pop_to("p")
            elif tag in ENDS_ITS_KIND and self.stack and self.stack[-1].tag == tag:
                self.pop_to(tag)
        if tag in VOID or attributes.endswith("/") and tag in HIDDEN:
            return
        up = self.stack[-1] if self.stack else None
        self.stack.append(Element(tag, () if tag in INLINE else _names_of(tag, attributes), up))
        self.open[tag] += 1
        self.unseen += tag in HIDDEN

    def end(self, tag: str) -> None:
        if not self.open[tag]:
            return
        unseen = self.unseen
        if unseen and tag not in INLINE:  # what is left of it around the element that ends
            for one in reversed(self.stack):
                if one.tag == tag:
                    unseen += one.tag in BROKEN_OUT_OF or tag == "object"
                    break
                unseen -= one.hidden
        if not unseen and tag not in INLINE:
            self.flush()
        self.pop_to(tag)


def blocks(page: str) -> list[Block]:
    """Innermost element, text and length of linked text of each block."""
    reader, at, n = _Reader(), 0, len(page)
    ends: dict[str, int] = {}  # of elements with raw text: where the last end tag is known to start, or the page's end
    while at < n:
        m = _TAG.search(page, at)
        if not m:
            reader.text(page[at:])
            break
        if m.start() > at:
            reader.text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            reader.end(tag)
        elif tag not in RAW:
            reader.start(tag, m[3])
        else:
            if not reader.unseen:
                reader.flush()
            if ends.get(tag, -1) < at:
                end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*(?:>|\\Z)", re.I).search(page, at)
                ends[tag] = end.end() if end else n + 1
            if ends[tag] <= n:
                at = ends[tag]
            elif tag in ("script", "style"):
                at = n
    reader.flush()
    return reader.out


def _hash(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass"))


@lru_cache(maxsize=100_000)
def _short_slot(word: str) -> int:
    """Place of a word among WORD_DIM, and WORD_DIM more for the negative ones."""
    h = _hash(word)
    return h % WORD_DIM + (0 if h >> 16 & 1 else WORD_DIM)


def _slot(word: str) -> int:
    return _short_slot(word) if len(word) <= 40 else _short_slot.__wrapped__(word)


@lru_cache(maxsize=20_000)
def _element_vectors(names: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Of an element alone: its vector as the innermost and as one of the path."""
    leaf, own = np.zeros(LEAF_DIM, np.float32), np.zeros(PATH_DIM, np.float32)
    for word in (f"tag {names[0]}", *(f"name {x}" for x in names[1:])):
        h = _hash(word)
        sign = 1.0 if h >> 16 & 1 else -1.0
        leaf[h % LEAF_DIM] += sign
        own[h % PATH_DIM] += sign
    return leaf, own


def _vector(element: Element) -> tuple[np.ndarray, np.ndarray]:
    """Of the innermost element, and of all the path: a name counts once, however many elements have it and wherever they are."""
    chain = []
    while element and element.vector is None:
        chain.append(element)
        element = element.up
    for one in reversed(chain):
        above = one.up.vector[1] if one.up else np.zeros(PATH_DIM, np.float32)
        if one.names:
            leaf, own = _element_vectors(one.names) if len(one.names) < 12 else _element_vectors.__wrapped__(one.names)
            one.vector = leaf, np.clip(above + own, -1, 1)
        else:
            one.vector = np.zeros(LEAF_DIM, np.float32), above
    return chain[0].vector if chain else element.vector


def vectors(page: list[Block]) -> np.ndarray:
    """A row for each block."""
    out = np.zeros((len(page), LEAF_DIM + PATH_DIM + WORD_DIM + EXTRA), np.float32)
    for row, (element, text, linked) in zip(out, page, strict=True):
        if element:
            row[:LEAF_DIM], row[LEAF_DIM : LEAF_DIM + PATH_DIM] = _vector(element)
        words = text.lower().split()
        share = 0.15 * min(1.0, (WORDS / max(1, len(words))) ** 0.5)
        counts = np.bincount([_slot(w) for w in words], minlength=2 * WORD_DIM)
        row[LEAF_DIM + PATH_DIM : -EXTRA] = share * (counts[:WORD_DIM] - counts[WORD_DIM:])
        size = len(text)
        row[-EXTRA:] = (np.log2(1 + size) / 5, len(words) > 8, text[-1:] in ".!?\u3002\uff01\uff1f", min(1.0, linked / size), "\u00a9" in text or "copyright" in text.lower(), text.isupper(), size < 20, 1.0)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Bidirectional LSTM: forward and backward states of each block, and a logistic layer on both."""

    def __init__(self, seed: int = 42):
        rng = np.random.default_rng(seed)
        d, h = LEAF_DIM + PATH_DIM + WORD_DIM + EXTRA, HIDDEN_DIM
        self.par = []
        for _ in range(2):
            bias = np.zeros(4 * h, np.float32)
            bias[h : 2 * h] = 1
            self.par += [rng.normal(0, 0.1, (d, 4 * h)).astype(np.float32), rng.normal(0, 0.15, (h, 4 * h)).astype(np.float32), bias]
        self.par += [rng.normal(0, 0.2, 2 * h).astype(np.float32), np.zeros(1, np.float32)]

    @staticmethod
    def _step(z: np.ndarray, h: np.ndarray, c: np.ndarray, m: np.ndarray) -> tuple:
        """Gates and the new states. Padding (m = 0) keeps the state."""
        i, f, o = (_sigmoid(z[:, k * HIDDEN_DIM : (k + 1) * HIDDEN_DIM]) for k in range(3))
        g = np.tanh(z[:, 3 * HIDDEN_DIM :])
        c2 = m * (f * c + i * g) + (1 - m) * c
        th = np.tanh(c2)
        return i, f, o, g, th, m * (o * th) + (1 - m) * h, c2

    def _steps(self, k: int, x: np.ndarray, mask: np.ndarray) -> list[tuple]:
        """x: pages x blocks x features; k: 0 forward, 1 back. What the gradients need of each step."""
        w, u, b = self.par[3 * k : 3 * k + 3]
        n, steps, _ = x.shape
        h = c = np.zeros((n, HIDDEN_DIM), np.float32)
        inputs = x @ w + b
        out: list[tuple] = [()] * steps
        for t in range(steps - 1, -1, -1) if k else range(steps):
            i, f, o, g, th, h2, c2 = self._step(inputs[:, t] + h @ u, h, c, mask[:, t, None])
            out[t] = (h, c, i, f, o, g, th, h2)
            h, c = h2, c2
        return out

    def forward(self, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, list[list[tuple]], np.ndarray]:
        runs = [self._steps(k, x, mask) for k in range(2)]
        states = np.concatenate([np.stack([s[7] for s in run], axis=1) for run in runs], axis=2)
        return _sigmoid(states @ self.par[6] + self.par[7]), runs, states

    def probabilities(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """As ``forward``, but of each step only its share of the result is kept."""
        n, steps, _ = x.shape
        total = np.zeros((n, steps), np.float32)
        for k in range(2):
            w, u, b = self.par[3 * k : 3 * k + 3]
            out = self.par[6][k * HIDDEN_DIM : (k + 1) * HIDDEN_DIM]
            h = c = np.zeros((n, HIDDEN_DIM), np.float32)
            spans = range(0, steps, STEPS)
            for s in reversed(spans) if k else spans:
                inputs = x[:, s : s + STEPS] @ w + b
                own = range(inputs.shape[1])
                for t in reversed(own) if k else own:
                    *_, h, c = self._step(inputs[:, t] + h @ u, h, c, mask[:, s + t, None])
                    total[:, s + t] += h @ out
        return _sigmoid(total + self.par[7])

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        p, runs, states = self.forward(x, mask)
        d = (p - y) * mask / mask.sum()
        grads: list[np.ndarray] = []
        for k, run in enumerate(runs):
            w, u, b = self.par[3 * k : 3 * k + 3]
            d_states = d[:, :, None] * self.par[6][k * HIDDEN_DIM : (k + 1) * HIDDEN_DIM]
            dz_all, du = np.zeros((*x.shape[:2], 4 * HIDDEN_DIM), np.float32), np.zeros_like(u)
            dh = dc = np.zeros((len(x), HIDDEN_DIM), np.float32)
            for t in range(x.shape[1]) if k else range(x.shape[1] - 1, -1, -1):
                h, c, i, f, o, g, th, _ = run[t]
                m = mask[:, t, None]
                dh = dh + d_states[:, t]
                own_h = dh * m
                own_c = dc * m + own_h * o * (1 - th * th)
                dz = np.concatenate([own_c * g * i * (1 - i), own_c * c * f * (1 - f), own_h * th * o * (1 - o), own_c * i * (1 - g * g)], axis=1)
                dz_all[:, t] = dz
                du += h.T @ dz
                dh = dh * (1 - m) + dz @ u.T
                dc = dc * (1 - m) + own_c * f
            flat = dz_all.reshape(-1, 4 * HIDDEN_DIM)
            grads += [x.reshape(-1, x.shape[2]).T @ flat, du, flat.sum(axis=0)]
        return [*grads, np.einsum("nt,nth->h", d, states), np.array([d.sum()], np.float32)]

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Which blocks of each page are main text. Pages of like length go together, so padding stays small."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and end - at < 128 and len(pages[order[end]]) <= 1.3 * len(pages[order[at]]) + 4 and (end - at) * len(pages[order[end]]) < BLOCKS:
                end += 1
            own = order[at:end]
            x, mask = padded([pages[k] for k in own])
            p = self.probabilities(x, mask)
            for k, row in zip(own, p, strict=True):
                out[k] = row[: len(pages[k])] >= 0.5
            at = end
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x = np.zeros((len(pages), steps, pages[0].shape[1]), np.float32)
    mask = np.zeros((len(pages), steps), np.float32)
    for k, p in enumerate(pages):
        x[k, : len(p)], mask[k, : len(p)] = p, 1
    return x, mask


SYLLABLES = "ka lo mi ser tan vel dor ine est al per con ti ra sul gra ne vo pi ment ura eck sto lin au fer ge ba ro da".split()


class _Maker:
    """Pages by rule, and for each of their blocks whether it is main text. Words say little, layout and neighbours much."""

    def __init__(self, rng: random.Random):
        self.rng, self.parts, self.labels = rng, [], []
        self.noise = rng.choice(["", "", "", "", "&amp; ", "### ", "!! "])
        self.script = rng.choice(["latin"] * 7 + ["han", "kana", "cyrillic"])

    def word(self) -> str:
        rng = self.rng
        if self.script == "latin":
            return "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4)))
        first, last = {"han": (0x4E00, 0x5E00), "kana": (0x3041, 0x3090), "cyrillic": (0x430, 0x44F)}[self.script]
        return "".join(chr(rng.randint(first, last)) for _ in range(rng.randint(2, 7)))

    def line(self, a: int, b: int) -> str:
        rng = self.rng
        noise = self.noise if rng.random() < 0.5 else ""
        words = [self.word() + (f" {noise.strip()}" if noise and rng.random() < 0.6 else "") for _ in range(rng.randint(a, b))]
        joint = "" if self.script in ("han", "kana") and not noise else " "
        end = "\u3002" if self.script in ("han", "kana") else "."
        return joint.join(words).capitalize() + rng.choice([end, end, end, "", "?"])

    def put(self, markup: str, *marks: bool) -> None:
        self.parts.append(markup)
        self.labels.extend(marks)

    def boxed(self, boxes: list[str], inner: str, *marks: bool) -> None:
        """inner in one of the boxes, a tag with attributes; sometimes in further elements without a name."""
        rng = self.rng
        box = rng.choice(boxes)
        around = ["div"] * rng.choice([0, 0, 0, 1, 1, 2, rng.randint(2, 20)]) if rng.random() < 0.5 else []
        self.put(f"<{box}>{''.join(f'<{x}>' for x in around)}{inner}{''.join(f'</{x}>' for x in around)}</{box.split()[0]}>", *marks)

    def links(self, n: int) -> str:
        one = self.rng.choice(['<li><a href="/{0}">{0}</a></li>', "<li><a href={0}.html>{0}</a>", '<div><a href="#{0}">{0}</a></div>', '<td><a href="/{0}">{0}</a></td>'])
        own = "".join(one.format(self.word()) for _ in range(n))
        return f"<ul>{own}</ul>" if "li" in one else f"<table><tr>{own}</tr></table>" if "td" in one else own

    def junk(self) -> None:
        rng, line, word = self.rng, self.line, self.word
        kind = rng.randint(0, 15)
        n = rng.randint(1, 6)
        paragraphs = "".join(f"<p>{line(3, 30)}</p>" for _ in range(n))
        if kind <= 1:
            self.boxed(["nav", 'div class="menu"', 'div id="navigation"', 'ul class="breadcrumb"', 'div class="topbar nav"', "menu", 'nav class="site"', 'div role="navigation"', 'div class="toolbar"'], self.links(n + 1), *[False] * (n + 1))
        elif kind <= 3:
            self.boxed(['div class="ad"', 'div class="advert banner"', 'aside class="sponsored"', 'div id="ads"', 'div class="promo"', 'section class="advertisement"', 'div class="ad-slot"', 'div class="sponsor-box"'], line(2, 40), False)
        elif kind == 4:
            self.boxed(["aside", 'div class="sidebar"', 'div id="sidebar"', 'div class="related"', 'section class="widget"', 'div class="side"', 'aside id="right"', 'div class="see-also related-posts"'], f"<h3>{word()} {word()}</h3>{paragraphs if rng.random() < 0.5 else self.links(n)}", *[False] * (n + 1))
        elif kind == 5:
            self.boxed(['div class="cookie-notice"', 'div id="cookie-banner"', 'div class="consent"', 'div class="notice"', 'div role="alert"', 'div class="popup modal"', 'section class="gdpr"', 'div class="alert warning"'], f"<p>{line(5, 60)}</p><button>{word()}</button>", False, False)
        elif kind == 6:
            self.boxed(['form action="/s"', 'form method=post', 'div class="newsletter"><form', 'div class="login"><form'], f'<p>{line(3, 14)}</p><label>{word()}</label> <input name="q"><select><option>{word()}<option>{word()}</select><button>{word()}</button></form>', False, False, False)
        elif kind <= 9:
            boxes = ['section class="comments"', 'div id="comments"', 'div class="comment-list"', 'ol class="commentlist"', 'div class="discussion replies"', 'section id="reader-comments"', 'div class="responses"', 'div id="disqus-thread comments"']
            one = rng.choice(['<div class="comment"><b>{0}</b><p>{1}</p></div>', '<article class="comment"><h4>{0}</h4><p>{1}</p></article>', "<li><div>{0}</div><p>{1}</li>", '<div class="reply"><div><span>{0}</span></div><div>{1}</div></div>'])
            self.boxed(boxes, f"<h2>{word()}</h2>" + "".join(one.format(word(), line(5, 60)) for _ in range(n)), False, *[False] * (2 * n))
        elif kind == 10:
            self.boxed(['div class="share social"', 'div class="tags"', 'ul class="social-links"', 'div class="pagination"', 'div class="author-bio"', 'div class="meta-box"'], "".join(f"<div>{line(1, 7)}</div>" for _ in range(n)), *[False] * n)
        elif kind == 11:
            self.boxed(["header", 'div class="header"', 'div id="masthead"', 'header class="site-header"', 'div class="logo"'], f"<div>{line(1, 4)}</div><p>{line(2, 9)}</p>", False, False)
        elif kind == 12:
            code = rng.choice(["if (a < b) { f('<div>'); }", "window.x = {y: 1};", "document.write('<p>' + z)", "// </div>\n", ".a > .b { color: red }"])
            tag = rng.choice(["script", "style", "noscript", "template"])
            self.put(f"<!-- {line(1, 5)} --><{tag}>{code if tag in ('script', 'style') else line(2, 9)}</{tag}>")
        else:
            sign = rng.choice(["&copy; ", "", "Copyright ", "\u00a9 2020 "])
            self.boxed(["footer", "footer", 'div class="footer"', 'div id="bottom"', 'footer class="site-footer"', 'div class="legal copyright"'], f"{sign}{word()}.{word()} &middot; {line(2, 20)}" + "".join(f"<p>{line(2, 12)}</p>" for _ in range(n - 1)), *[False] * n)

    def piece(self) -> None:
        """A part of the article."""
        rng, line, word = self.rng, self.line, self.word
        kind = rng.random()
        if kind < 0.7:
            body = line(1, rng.choice([3, 30, 90, 200]))
            if rng.random() < 0.08:
                body = " ".join([word()] * rng.randint(5, 60))
            if rng.random() < 0.2:
                cut, tag = body.split(), rng.choice(["a href=/x", "b", "em", "span class=x", "code"])
                body = f"{' '.join(cut[:2])} <{tag}>{' '.join(cut[2:4])}</{tag.split()[0]}> {' '.join(cut[4:])} {word()}"
            form = rng.random()
            if form < 0.8:
                self.put(f"<p>{body}{rng.choice(['</p>', '</p>', ''])}", True)
            elif form < 0.87:
                self.put(f"<p><{(t := rng.choice(['b', 'strong', 'i', 'span']))}>{body}{rng.choice([f'</{t}></p>', '</p>', '<br>', ''])}", True)
            elif form < 0.95:
                self.put(f"<div>{body}</div>", True)
            else:
                self.put(f"<p>{body}<br>{line(3, 20)}<br/>{line(1, 30)}</p>", True, True, True)
        elif kind < 0.78:
            self.put(f"<{(h := rng.choice(['h2', 'h3', 'h4']))}>{line(1, 8)}</{h}>", True)
        elif kind < 0.86:
            k = rng.randint(1, 6)
            self.put(f"<{(u := rng.choice(['ul', 'ol']))}>" + "".join(f"<li>{line(1, 20)}{rng.choice(['</li>', '</li>', ''])}" for _ in range(k)) + f"</{u}>", *[True] * k)
        elif kind < 0.9:
            self.put(f"<blockquote>{line(4, 40)}</blockquote>", True)
        elif kind < 0.92:
            self.put(f"<pre>{line(2, 12)}</pre>", True)
        elif kind < 0.94:
            rows, cols = rng.randint(1, 4), rng.randint(1, 4)
            row = lambda t: "<tr>" + "".join(f"<{t}>{line(1, 6)}</{t}>" for _ in range(cols)) + "</tr>"
            self.put(f"<table>{row(rng.choice(['th', 'td']))}{''.join(row('td') for _ in range(rows - 1))}</table>", *[True] * (rows * cols))
        elif kind < 0.95:
            self.put(f"<figure><img src=x><figcaption>{line(2, 14)}</figcaption></figure>", True)
        else:
            self.put(f'<div {rng.choice(["class", "class", "id"])}="{rng.choice("ad ads ad-box related newsletter share advert promo sponsored".split())}">{line(2, 20)}</div>', False)

    def article(self) -> None:
        rng, line = self.rng, self.line
        n = rng.randint(0, rng.choice([3, 14, 14, 60]))
        boxes = ["article", "article", "article", "article", "main", "main><article", 'main id="main"><div class="article"', 'div class="main"><div class="article"', 'div id="content"><article', "div", "div><div"]
        boxes += [f'{t} {a}="{x}"' for t, a, x in (("div", "class", "content"), ("div", "id", "article-body"), ("div", "class", "post entry"), ("section", "class", "story"), ("div", "class", "main"), ("div", "class", "text body"), ("div", "id", "content"), ("section", "id", "post"), ("div", "role", "main"))]
        box = rng.choice(boxes) if rng.random() < 0.92 else ""
        self.put(f"<{box}>" if box else "")
        if rng.random() < 0.85:
            tag = rng.choice(["h1", "h1", "h1", "h2"])
            title = f"<{tag}>{line(2, 12)}</{tag}>"
            if rng.random() < 0.2:
                under = rng.random() < 0.4
                self.put(f"<header>{title}{f'<p>{line(4, 20)}</p>' if under else ''}</header>", *[True] * (1 + under))
            else:
                self.put(title, True)
        depth = rng.randint(1, 12) if rng.random() < 0.1 else 0
        self.put("<div>" * depth)
        for _ in range(n):
            self.piece()
        *outer, inner = [x.split()[0] for x in box.split("><") if x] or [""]
        self.put("</div>" * depth + (f"</{inner}>" if inner else ""))
        if outer:
            for _ in range(rng.randint(0, 2)):
                self.junk()
            self.put(f"</{outer[0]}>")

    def page(self) -> tuple[str, list[bool]]:
        rng, line = self.rng, self.line
        self.put(rng.choice([f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{line(2, 8)}</title></head><body>', f"<html><head><title>{line(1, 9)}</title><body>", f"<title>{line(1, 5)}</title>", f"<html><head><style>p {{ margin: 0 }}</style><title>{line(1, 9)}</title><link href=x></head><body class='{rng.choice(['home', 'page', 'single'])}'>"]))
        wraps = rng.choice([[], [], [], ["page", "wrapper"], ["container"], ["root", "layout", "row", "col"]])
        self.put("".join(f'<div {rng.choice(["id", "class"])}="{x}">' for x in wraps))
        for _ in range(rng.randint(0, 5)):
            self.junk()
        self.article()
        for _ in range(rng.randint(0, 5)):
            self.junk()
        self.put("</div>" * len(wraps) + rng.choice(["</body></html>", "</body></html>", "", "</html>"]))
        return "".join(self.parts), self.labels


def made_page(rng: random.Random) -> tuple[str, list[bool]]:
    """A page by rule, and for each of its blocks whether it is main text."""
    return _Maker(rng).page()


def train(pages: int = MODEL_PAGES, epochs: int = EPOCHS, seed: int = 42, batch: int = 32, rate: float = 0.015) -> Labeller:
    """Adam on cross-entropy over made pages; a page of which blocks and labels don't match in number is left out."""
    rng, net = random.Random(seed), Labeller(seed)
    data = []
    for _ in range(pages):
        page, labels = made_page(rng)
        x = vectors(blocks(page))
        if len(x) and len(x) == len(labels):
            data.append((x, np.array(labels, np.float32)))
    data.sort(key=lambda d: len(d[0]))
    lots = [data[k : k + batch] for k in range(0, len(data), batch)]
    first, second = [np.zeros_like(p) for p in net.par], [np.zeros_like(p) for p in net.par]
    step = 0
    for epoch in range(epochs):
        rng.shuffle(lots)
        for lot in lots:
            x, mask = padded([d[0] for d in lot])
            y = np.zeros(mask.shape, np.float32)
            for row, (_, labels) in zip(y, lot, strict=True):
                row[: len(labels)] = labels
            step += 1
            pace = rate * (1 - epoch / (epochs + 1)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for q, g, a, b in zip(net.par, net.gradients(x, mask, y), first, second, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                q -= (pace * a / (np.sqrt(b) + 1e-8)).astype(np.float32)
    return net


@lru_cache(maxsize=1)
def trained() -> Labeller:
    return train()


def main_texts(net: Labeller, pages: list[str | None]) -> list[tuple[str, int, int]]:
    """Main text, blocks and blocks of main text of each page."""
    found = [blocks(p or "") for p in pages]
    kept = net.label([vectors(b) for b in found])
    return [("\n".join(text for (_, text, _), k in zip(b, own, strict=True) if k), len(b), int(own.sum())) for b, own in zip(found, kept, strict=True)]


SCHEMA = "page_id long, url string, text string, n_chars long, n_blocks long, n_main long"


def _extractor(net: Labeller):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = main_texts(net, batch.column(2).to_pylist())
            cols = [batch.column(0), batch.column(1), pa.array([m[0] for m in made], pa.string()), pa.array([len(m[0]) for m in made], pa.int64()), pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in SCHEMA.split(", ")])

    return run


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", net: Labeller | None = None) -> DataFrame:
    """page_id, url, text, n_chars (code points), n_blocks, n_main of each page."""
    own = df.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{url_col}`").cast("string").alias("_url"), F.col(f"`{html_col}`").cast("string").alias("_html"))
    return map_batches(own, _extractor(net or trained()), SCHEMA)
