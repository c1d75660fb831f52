"""Main text of web pages by a recurrent block labeller.

A page is read once into its leaf blocks: the runs of text between block-level tags, each with the
path of block-level elements it stands in. A block becomes a vector of hashed tags, classes and ids
of its path, hashed words, and a few numbers (length, share of links, depth). A bidirectional
LSTM in numpy reads the blocks of the whole page forwards and backwards and labels each one as main
text or not, so that a paragraph among readers' comments is told from one of the article by what
stands around it.

The weights are trained on the driver, once in a process, on pages that are made up here from a
seed: articles in many kinds of containers, among menus, headers, footers, sidebars, notices,
adverts, forms and comments. They have a fixed size and are broadcast.

Results: a null or empty page, or one without main text, gives an empty text. Character references
are decoded, white space inside a block becomes one space, and blocks are joined by one newline in
page order; nothing else is dropped or cut. Scripts, styles, comments, the labels of buttons and other
text that is not shown are not blocks; the text of formulas is. Unclosed and wrongly nested tags are
taken as a browser would where that is simple: values in quotes may hold tags, a tag that never ends
is left out, and scripts, styles, titles and text areas that never end hide the rest. Of other hidden
elements that are never closed only the tag goes. A very long page is labelled in pieces through which
the network's states are carried. Equal pages give equal texts, and a block whose odds are even is not
main text. Columns other than the named ones are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from passagelake.llm.common import arrow_map

SEED = 11
PATH_BITS, WORD_BITS, NUMBERS, HIDDEN = 9, 5, 7, 24
PATH, WORDS = 1 << PATH_BITS, 1 << WORD_BITS
INPUT = PATH + WORDS + NUMBERS
PAGES, EPOCHS, BATCH, RATE = 1500, 10, 24, 0.01
#: Blocks (steps times pages) that the network reads at once, and pages read at once.
STEPS, TOGETHER = 1 << 14, 256

# HTML element kinds.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split())
HIDDEN_TEXT = frozenset("script style title textarea noscript template iframe svg annotation annotation-xml object audio video canvas button head".split())
#: Of these, those that hide all that follows if they are never closed; of the others the tag alone is left out then.
RAW = frozenset("script style title textarea".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS_P = BLOCK - {"body", "html", "option", "select", "legend", "caption"}
SAME_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "p": ("p",)}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}

#: What follows a tag's name: names, and values after "=", which may hold anything between quotes. A quote that is never closed is part of its value.
ATTRIBUTES = r"(?:[\s/]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+)|[^\s/>=]++)*+"
TAG = re.compile(rf"<(?:!--(?:-?>|.*?--!?>|.*\Z)|([a-zA-Z][^\s/>]*+)({ATTRIBUTES})(?:>|\Z)|/([a-zA-Z][^\s/>]*+){ATTRIBUTES}(?:>|\Z)|[!?/][^>]*+(?:>|\Z))", re.S)
NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
CLOSING = {n: re.compile(rf"</{n}(?=[\s/>])[^>]*>", re.I) for n in HIDDEN_TEXT}
HEAD_ENDS = re.compile(r"</head\s*>|<body(?=[\s/>])", re.I)


class Block:
    __slots__ = ("links", "path", "text")

    def __init__(self, text: str, path: tuple, links: int):
        self.text, self.path, self.links = text, path, links


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks of a page in order, each with its path of (tag, names) and the characters in links."""
    out: list[Block] = []
    page = page or ""
    stack: list[tuple[str, str]] = []
    parts: list[str] = []
    links, in_link, at = 0, False, 0
    unclosed: set[str] = set()  # hidden elements that no later tag closes
    unescape = entities.unescape

    def flush() -> None:
        nonlocal links
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                out.append(Block(text, tuple(stack), min(links, len(text))))
            parts.clear()
        links = 0

    def close(names: tuple[str, ...], scope: tuple[str, ...]) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in names:
                del stack[k:]
                return
            if stack[k][0] in scope:
                return

    position = 0
    while (m := TAG.search(page, position)) is not None:
        if m.start() > at:
            piece = page[at : m.start()]
            parts.append(piece)
            if in_link:
                links += len(piece.strip())
        position = at = m.end()
        name = m[1]
        if name is not None:
            name = name.lower()
            if name in HIDDEN_TEXT:
                if not m[2].endswith("/") or name in RAW:
                    if name == "head":
                        end = HEAD_ENDS.search(page, at)
                        position = at = at if end is None else end.start() if end[0][1] != "/" else end.end()
                    else:
                        end = None if name in unclosed else CLOSING[name].search(page, at)
                        if end is not None:
                            position = at = end.end()
                        elif name in RAW:
                            position = at = len(page)
                        else:
                            unclosed.add(name)
            elif name in BLOCK:
                flush()
                in_link = False
                if name in ENDS_P:
                    close(("p",), ("td", "th", "li", "div", "section", "article", "aside", "main", "table", "blockquote", "form"))
                if name in SAME_CLOSES and name != "p":
                    close(SAME_CLOSES[name], SCOPE[name])
                if name not in VOID and not m[2].endswith("/"):
                    stack.append((name, m[2]))
            elif name == "br" or name == "wbr":
                parts.append(" " if name == "br" else "")
            elif name == "a":
                in_link = True
        elif m[3] is not None:
            name = m[3].lower()
            if name in BLOCK:
                flush()
                in_link = False
                if any(x[0] == name for x in stack):
                    close((name,), ())
            elif name == "a":
                in_link = False
    if at < len(page):
        parts.append(page[at:])
        if in_link:
            links += len(page) - at
    flush()
    return out


def hashed(word: str, bits: int) -> int:
    """Bucket and sign of a word: the bucket, negative minus one for a negative sign."""
    h = zlib.crc32(word.encode())
    return -1 - (h & ((1 << bits) - 1)) if h >> 31 else h & ((1 << bits) - 1)


_PATHS: dict[tuple, np.ndarray] = {}
_WORDS: dict[str, int] = {}


def path_vector(path: tuple) -> np.ndarray:
    """Hashed tags, and words of classes, ids and roles; those nearest to the block count most."""
    v = _PATHS.get(path)
    if v is None:
        v = np.zeros(PATH, np.float32)
        for k, (tag, attributes) in enumerate(reversed(path)):
            weight = 1.0 if k == 0 else 0.8
            words = [f"<{tag}"]
            for m in NAMES.finditer(attributes):
                words += [f".{w.lower()}" for w in PIECES.findall(m[1] or m[2] or m[3] or "")]
            for w in dict.fromkeys(words):
                h = hashed(w, PATH_BITS)
                v[h if h >= 0 else -1 - h] += weight if h >= 0 else -weight
        if len(_PATHS) > 20_000:
            _PATHS.clear()
        _PATHS[path] = v
    return v


def vectors(found: list[Block]) -> np.ndarray:
    """One row for each block of a page."""
    n = len(found)
    x = np.zeros((n, INPUT), np.float32)
    index: list[int] = []
    counts = []
    for b in found:
        words = b.text.lower().split(" ")
        counts.append(len(words))
        for w in words:
            h = _WORDS.get(w)
            if h is None:
                if len(_WORDS) > 500_000:
                    _WORDS.clear()
                h = _WORDS[w] = hashed(w, WORD_BITS)
            index.append(h)
    if not n:
        return x
    h = np.array(index)
    sign = np.where(h >= 0, 1.0, -1.0)
    owner = np.repeat(np.arange(n), counts)
    words = np.bincount(owner * WORDS + np.where(h >= 0, h, -1 - h), sign, minlength=n * WORDS).reshape(n, WORDS)
    words /= 2 * np.maximum(np.linalg.norm(words, axis=1, keepdims=True), 1)
    x[:, PATH : PATH + WORDS] = words
    length = np.array([len(b.text) for b in found], np.float32)
    for i, b in enumerate(found):
        x[i, :PATH] = path_vector(b.path)
        t = b.text
        x[i, -1] = t[-1] in ".!?…:;\"'»”"
        x[i, -2] = "©" in t
        x[i, -3] = min(len(b.path), 20) / 10
    x[:, -4] = np.log1p(length) / 6
    x[:, -5] = np.array([b.links for b in found]) / length
    x[:, -6] = np.log1p(counts) / 4
    x[:, -7] = 1
    return x


class Labeller:
    """Bidirectional LSTM with one output for each step; gates in the order input, forget, output, cell."""

    def __init__(self, rng: np.random.Generator):
        h = HIDDEN
        self.w = {}
        for d in "fb":
            self.w[f"x{d}"] = (rng.standard_normal((INPUT, 4 * h)) * 0.08).astype(np.float32)
            self.w[f"h{d}"] = (rng.standard_normal((h, 4 * h)) / np.sqrt(h)).astype(np.float32)
            self.w[f"c{d}"] = np.zeros(4 * h, np.float32)
            self.w[f"c{d}"][h : 2 * h] = 1
            self.w[f"o{d}"] = (rng.standard_normal(h) * 0.1).astype(np.float32)
        self.w["skip"] = np.zeros(INPUT, np.float32)
        self.w["bias"] = np.zeros(1, np.float32)

    def pass_(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool, state: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, list, tuple[np.ndarray, np.ndarray]]:
        """States of one direction, from a state on, and the last; x is steps x pages x inputs."""
        n, m, _ = x.shape
        z_x = (x.reshape(n * m, -1) @ self.w[f"x{d}"] + self.w[f"c{d}"]).reshape(n, m, -1)
        h, c = state or (np.zeros((m, HIDDEN), np.float32), np.zeros((m, HIDDEN), np.float32))
        out = np.zeros((n, m, HIDDEN), np.float32)
        tape = []
        for t in range(n) if d == "f" else range(n - 1, -1, -1):
            z = z_x[t] + h @ self.w[f"h{d}"]
            gates = 1 / (1 + np.exp(-np.clip(z[:, : 3 * HIDDEN], -30, 30)))
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            k = mask[t][:, None]
            c_new = f * c + i * g
            tanh = np.tanh(c_new)
            if keep:
                tape.append((t, h, c, i, f, o, g, tanh, k))
            c = np.where(k, c_new, c)
            h = np.where(k, o * tanh, h)
            out[t] = h
        return out, tape, (h, c)

    def logits(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        f, tape_f, _ = self.pass_(x, mask, "f", keep)
        b, tape_b, _ = self.pass_(x, mask, "b", keep)
        y = f @ self.w["of"] + b @ self.w["ob"] + x @ self.w["skip"] + self.w["bias"]
        return y, (f, b, tape_f, tape_b)

    def gradients(self, x: np.ndarray, mask: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        y, (f, b, tape_f, tape_b) = self.logits(x, mask, True)
        p = 1 / (1 + np.exp(-np.clip(y, -30, 30)))
        dy = (np.where(mask, p - label, 0) / mask.sum()).astype(np.float32)
        g = {"bias": np.array([dy.sum()], np.float32), "skip": np.tensordot(dy, x, ([0, 1], [0, 1])), "of": np.tensordot(dy, f, ([0, 1], [0, 1])), "ob": np.tensordot(dy, b, ([0, 1], [0, 1]))}
        for d, tape in (("f", tape_f), ("b", tape_b)):
            dz_all = np.zeros((*mask.shape, 4 * HIDDEN), np.float32)
            dh = np.zeros((x.shape[1], HIDDEN), np.float32)
            dc = np.zeros_like(dh)
            gh = np.zeros_like(self.w[f"h{d}"])
            for t, h, c, i, fg, o, cell, tanh, k in reversed(tape):
                dh = dh + dy[t][:, None] * self.w[f"o{d}"]
                own, rest = np.where(k, dh, 0), np.where(k, 0, dh)
                dct = np.where(k, dc + own * o * (1 - tanh * tanh), 0)
                dz = np.concatenate([dct * cell * i * (1 - i), dct * c * fg * (1 - fg), own * tanh * o * (1 - o), dct * i * (1 - cell * cell)], 1)
                gh += h.T @ dz
                dz_all[t] = dz
                dh = rest + dz @ self.w[f"h{d}"].T
                dc = np.where(k, dct * fg, dc)
            flat = dz_all.reshape(-1, 4 * HIDDEN)
            g[f"h{d}"], g[f"c{d}"] = gh, flat.sum(0)
            g[f"x{d}"] = x.reshape(-1, INPUT).T @ flat
        loss = -np.where(mask, label * np.log(p + 1e-9) + (1 - label) * np.log(1 - p + 1e-9), 0).sum() / mask.sum()
        return float(loss), g

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Whether each block of each page is main text."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if len(p)), key=lambda i: len(pages[i]))
        while order:
            n = len(pages[order[-1]])
            some = order[-max(1, STEPS // n) :]
            del order[-len(some) :]
            x, mask = padded([pages[i] for i in some])
            y, _ = self.logits(x, mask)
            for k, i in enumerate(some):
                out[i] = y[: len(pages[i]), k] > 0
        return out


    def label_long(self, found: list[Block]) -> np.ndarray:
        """The same for the blocks of one page of any length: of all its steps only the states of one direction are held."""
        back, state = np.zeros((len(found), HIDDEN), np.float32), None
        starts = range(0, len(found), STEPS)
        pieces = lambda lo: (vectors(found[lo : lo + STEPS])[:, None], np.ones((min(STEPS, len(found) - lo), 1), bool))
        for lo in reversed(starts):
            h, _, state = self.pass_(*pieces(lo), "b", False, state)
            back[lo : lo + STEPS] = h[:, 0]
        main, state = np.zeros(len(found), bool), None
        for lo in starts:
            x, mask = pieces(lo)
            h, _, state = self.pass_(x, mask, "f", False, state)
            main[lo : lo + STEPS] = h[:, 0] @ self.w["of"] + back[lo : lo + STEPS] @ self.w["ob"] + x[:, 0] @ self.w["skip"] + self.w["bias"] > 0
        return main


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    n = max(map(len, pages))
    x = np.zeros((n, len(pages), INPUT), np.float32)
    mask = np.zeros((n, len(pages)), bool)
    for k, p in enumerate(pages):
        x[: len(p), k] = p
        mask[: len(p), k] = True
    return x, mask


# Words of pages that are made up for training.
CONTENT_NAMES = ["content", "main", "article", "post", "entry", "story", "body", "text", "page-content", "article-body", "post-content", "entry-content", "story-body", "main-content", "primary", "blog-post", "articleBody"]
NEUTRAL_NAMES = ["wrap", "wrapper", "container", "row", "col", "inner", "outer", "grid", "box", "section", "layout", "site", "page", "block", "clearfix", "column", "panel", ""]
AD_NAMES = ["ad", "ads", "advert", "advertisement", "ad-banner", "ad-slot", "adbox", "sponsor", "sponsored", "promo", "banner", "dfp-ad", "google-ad", "advertising"]
SIDE_NAMES = ["sidebar", "side", "aside", "widget", "widgets", "related", "recommended", "trending", "popular", "secondary", "rail", "more-stories"]
NOTICE_NAMES = ["cookie", "cookie-notice", "consent", "gdpr", "notice", "alert", "cookies-banner", "popup", "modal", "paywall", "subscribe", "newsletter", "signup"]
COMMENT_NAMES = ["comments", "comment", "comment-list", "disqus", "replies", "discussion", "responses", "reader-comments", "comment-body", "commentlist"]
MENU_NAMES = ["nav", "menu", "navbar", "navigation", "breadcrumb", "breadcrumbs", "topbar", "main-menu", "tabs", "links", "pagination", "tags"]
HEADER_NAMES = ["header", "site-header", "masthead", "top", "logo", "branding", "hero-header"]
FOOTER_NAMES = ["footer", "site-footer", "bottom", "copyright", "legal", "foot", "credits"]
SHARE_NAMES = ["share", "social", "sharing", "share-buttons", "follow", "byline-tools", "toolbar"]
SHORT_WORDS = "home about contact login news sports search subscribe help privacy terms menu more archive next previous share tweet sign up jobs shop blog press faq rss".split()
NOTICE_WORDS = "we use cookies to improve your experience accept all settings by continuing you agree to our privacy policy subscribe to our newsletter enter your email".split()
AD_WORDS = "advertisement sponsored buy now sale offer best price click here limited deal free shipping save".split()
COMMENT_WORDS = "comments reply posted by says ago likes report user log in to comment great post thanks i agree".split()
SYLLABLES = "the er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve ing ion ly ble au eau que ment ch sch ung keit ó ción ñ os é è ß ü a o i".split()
START = "\ue000"


class Maker:
    """Made-up pages; the words of main text begin with START, which is taken off before anything else sees them."""

    def __init__(self, seed: int):
        self.r = np.random.Generator(np.random.PCG64(seed))

    def chance(self, p: float) -> bool:
        return self.r.random() < p

    def one(self, x):
        return x[int(self.r.integers(len(x)))]

    def word(self) -> str:
        return "".join(self.one(SYLLABLES) for _ in range(int(self.r.integers(1, 4))))

    def words(self, low: int, high: int, special: list[str] | None = None, p: float = 0.0) -> str:
        return " ".join(self.one(special) if special and self.chance(p) else self.word() for _ in range(int(self.r.integers(low, high + 1))))

    def sentence(self, low: int = 3, high: int = 22) -> str:
        w = self.words(low, high)
        if self.chance(0.06):
            w = w.replace(" ", self.one([" | ", "&amp;&amp; ", "%%% ", "### "]))
        return w[:1].upper() + w[1:] + self.one([".", ".", ".", "!", "?", ""])

    def prose(self) -> str:
        return " ".join(self.sentence() for _ in range(int(self.r.integers(1, 5))))

    def names(self, own: list[str]) -> str:
        x = self.one(own)
        if self.chance(0.25):
            x = f"{self.one(['c', 'js', 'm', 'l', 'td', self.word()])}-{x}"
        if self.chance(0.2):
            x += f" {self.word()}"
        return self.one([f' class="{x}"', f' class="{x}"', f' id="{x}"', f" class='{x}' id='{self.word()}'"])

    def neutral(self) -> str:
        x = self.one(NEUTRAL_NAMES)
        return "" if not x or self.chance(0.3) else f' class="{x}"' if self.chance(0.7) else f' class="{self.word()}"'

    def links(self) -> str:
        n = int(self.r.integers(2, 9))
        text = lambda: self.one(SHORT_WORDS) if self.chance(0.5) else self.words(1, 3)
        kind = self.r.random()
        if kind < 0.6:
            return "<ul>" + "".join(f'<li{self.neutral() if self.chance(0.1) else ""}><a href="/{self.word()}">{text()}</a></li>' for _ in range(n)) + "</ul>"
        if kind < 0.8:
            return self.one([" ", " | ", " &raquo; "]).join(f'<a href="#">{text()}</a>' for _ in range(n))
        return "".join(f'<div><a href="#">{text()}</a></div>' for _ in range(n))

    def boiler(self, kind: str) -> str:
        r = self.r.random()
        if kind == "menu":
            tag = self.one(["nav", "nav", "div", "ul"])
            names = self.names(MENU_NAMES) if tag != "nav" or r < 0.4 else ""
            return f"<{tag}{names}>{self.links()}</{tag}>"
        if kind == "header":
            tag = self.one(["header", "div"])
            names = self.names(HEADER_NAMES) if tag != "header" or r < 0.4 else ""
            return f"<{tag}{names}>{self.one(['<h1>', '<p>', '<div>', ''])}{self.words(1, 4)}{'<p>' + self.words(2, 8) + '</p>' if self.chance(0.4) else ''}{self.links() if self.chance(0.3) else ''}</{tag}>"
        if kind == "footer":
            tag = self.one(["footer", "footer", "div"])
            names = self.names(FOOTER_NAMES) if tag != "footer" or r < 0.4 else ""
            mark = self.one(["&copy; ", "© 2020 ", "Copyright ", "", "&copy; "])
            text = f"{mark}{self.words(1, 4)}{' &middot; ' + self.prose() if self.chance(0.5) else ''}"
            return f"<{tag}{names}>{self.one(['<p>', '', '<div>'])}{text}{self.links() if self.chance(0.5) else ''}</{tag}>"
        if kind == "ad":
            tag = self.one(["div", "div", "aside", "section", "p"])
            text = self.prose() if self.chance(0.6) else self.words(2, 12, AD_WORDS, 0.5)
            return f"<{tag}{self.names(AD_NAMES)}>{self.one(['', '<p>', '<a href=x>'])}{text}</{tag}>"
        if kind == "notice":
            tag = self.one(["div", "div", "section", "dialog", "p"])
            text = self.words(4, 25, NOTICE_WORDS, 0.7) if self.chance(0.7) else self.prose()
            return f"<{tag}{self.names(NOTICE_NAMES)}>{self.one(['', '<p>', '<span>'])}{text}{'<button>' + self.words(1, 2) + '</button>' if self.chance(0.5) else ''}</{tag}>"
        if kind == "form":
            return f"<form{self.neutral()}>{self.one(['<label>', '<p>', ''])}{self.words(1, 6, NOTICE_WORDS, 0.5)}<input name=q>{'<select><option>' + self.words(1, 2) + '<option>' + self.words(1, 2) + '</select>' if self.chance(0.3) else ''}<button>{self.words(1, 2)}</button></form>"
        if kind == "side":
            tag = self.one(["aside", "aside", "div", "section"])
            names = self.names(SIDE_NAMES) if tag != "aside" or r < 0.5 else ""
            inside = "".join(self.one([f"<h3>{self.words(1, 5)}</h3>", self.links(), f"<p>{self.prose()}</p>", f"<div>{self.words(2, 9)}</div>"]) for _ in range(int(self.r.integers(1, 5))))
            return f"<{tag}{names}>{inside}</{tag}>"
        if kind == "share":
            return f"<div{self.names(SHARE_NAMES)}>{self.links() if self.chance(0.6) else self.words(1, 5, SHORT_WORDS, 0.6)}</div>"
        tag, item = self.one([("div", "div"), ("section", "div"), ("section", "article"), ("ol", "li"), ("ul", "li"), ("div", "p")])
        inside = "".join(f"<{item}{self.names(COMMENT_NAMES) if self.chance(0.4) else ''}>{self.words(1, 6, COMMENT_WORDS, 0.5)}<p>{self.prose()}</p></{item}>" for _ in range(int(self.r.integers(1, 6))))
        title = f"<h3>{self.words(1, 3, COMMENT_WORDS, 0.7)}</h3>" if self.chance(0.6) and tag not in ("ol", "ul") else ""
        return f"<{tag}{self.names(COMMENT_NAMES)}>{title}{inside}</{tag}>"

    def marked(self, text: str) -> str:
        return START + text

    def main(self) -> str:
        out = []
        if self.chance(0.85):
            h = self.one(["h1", "h1", "h2"])
            out.append(f"<{h}>{self.marked(self.words(2, 12) + self.one(['', '', '.', '&amp;']))}</{h}>")
        if self.chance(0.15):
            out.append(f"<div{self.names(['byline', 'author', 'date', 'dek', 'summary'])}>{self.marked(self.words(2, 8))}</div>")
        for _ in range(int(self.r.choice([1, 2, 4, 8, 14, 25, 60], p=[0.15, 0.15, 0.2, 0.2, 0.15, 0.1, 0.05]))):
            k = self.r.random()
            text = self.marked(self.prose())
            if k < 0.45:
                out.append(f"<p{self.neutral() if self.chance(0.1) else ''}>{text}</p>")
            elif k < 0.6:
                out.append(f"<p><b>{text}<br>")
            elif k < 0.66:
                out.append(f"<p>{self.marked(self.one([self.word().capitalize() + '.', self.words(1, 3)]))}</p>")
            elif k < 0.72:
                out.append(f'<p>{text} <a href="x">{self.words(1, 4)}</a> {self.words(1, 8)}.</p>')
            elif k < 0.78:
                out.append(f"<{(h := self.one(['h2', 'h3']))}>{self.marked(self.words(1, 8))}</{h}>")
            elif k < 0.84:
                out.append("<ul>" + "".join(f"<li>{self.marked(self.words(1, 14))}</li>" for _ in range(3)) + "</ul>")
            elif k < 0.88:
                out.append(f"<blockquote>{text}</blockquote>")
            elif k < 0.91:
                out.append("<table><tr>" + "".join(f"<td>{self.marked(self.words(1, 4))}</td>" for _ in range(4)) + "</tr></table>")
            elif k < 0.94:
                out.append(f"<figure><img src=x><figcaption>{self.marked(self.words(2, 9))}</figcaption></figure>")
            elif k < 0.97:
                out.append(f"<div{self.neutral()}>{text}</div>")
            else:
                out.append(f"<section{self.neutral()}><p>{text}</p></section>")
            if self.chance(0.05):
                out.append(self.boiler(self.one(["ad", "share", "form", "notice", "side"])))
        inside = "".join(out)
        tag = self.one(["article", "article", "main", "div", "div", "section", "td"])
        names = self.names(CONTENT_NAMES) if tag in ("div", "section", "td") and self.chance(0.85) or self.chance(0.2) else ""
        inside = f"<{tag}{names}>{inside}</{tag}>"
        return f"<table><tr>{inside}</tr></table>" if tag == "td" else inside

    def page(self) -> str:
        before = ["menu"] * self.chance(0.8) + ["header"] * self.chance(0.5) + ["ad"] * self.chance(0.5) + ["notice"] * self.chance(0.3) + ["form"] * self.chance(0.2) + ["menu"] * self.chance(0.2) + ["side"] * self.chance(0.15)
        after = ["share"] * self.chance(0.2) + ["comments"] * self.chance(0.35) + ["side"] * self.chance(0.35) + ["ad"] * self.chance(0.25) + ["form"] * self.chance(0.15) + ["menu"] * self.chance(0.1) + ["notice"] * self.chance(0.1) + ["footer"] * self.chance(0.85)
        if self.chance(0.3):
            self.r.shuffle(before)
        main = self.main() if self.chance(0.97) else ""
        out = "".join(map(self.boiler, before)) + main
        for _ in range(int(self.r.integers(0, 3))):
            if self.chance(0.5):
                out = f"<div{self.neutral()}>{out}</div>"
        return f"<!DOCTYPE html><html><head><title>{self.words(1, 5)}</title><style>p{{}}</style></head><body>{out}{''.join(map(self.boiler, after))}</body></html>"


def training_pages(n: int, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    maker = Maker(seed)
    for _ in range(n):
        found = blocks(maker.page())
        label = np.array([START in b.text for b in found], np.float32)
        for b in found:
            b.text = b.text.replace(START, "") or "x"
        if len(found):
            yield vectors(found), label


_TRAINED: list[Labeller] = []


def trained() -> Labeller:
    """The network, trained once in a process; the same seed gives the same weights."""
    if not _TRAINED:
        rng = np.random.Generator(np.random.PCG64(SEED))
        pages = sorted(training_pages(PAGES, SEED), key=lambda p: len(p[0]))
        batches = [pages[i : i + BATCH] for i in range(0, len(pages), BATCH)]
        net = Labeller(rng)
        mean = {k: np.zeros_like(v) for k, v in net.w.items()}
        square = {k: np.zeros_like(v) for k, v in net.w.items()}
        step = 0
        for epoch in range(EPOCHS):
            for i in rng.permutation(len(batches)):
                x, mask = padded([p for p, _ in batches[i]])
                label = np.zeros(mask.shape, np.float32)
                for k, (_, y) in enumerate(batches[i]):
                    label[: len(y), k] = y
                _, g = net.gradients(x, mask, label)
                norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
                step += 1
                rate = RATE * (1 - epoch / EPOCHS) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for k, v in g.items():
                    v = v / max(1.0, norm)
                    mean[k] = 0.9 * mean[k] + 0.1 * v
                    square[k] = 0.999 * square[k] + 0.001 * v * v
                    net.w[k] -= (rate * mean[k] / (np.sqrt(square[k]) + 1e-8)).astype(np.float32)
        _TRAINED.append(net)
    return _TRAINED[0]


def main_texts(pages: list[str | None], net: Labeller) -> list[str]:
    found = [blocks(p) for p in pages]
    labels = net.label([vectors(f) if len(f) <= STEPS else np.zeros((0, INPUT), np.float32) for f in found])
    for i, f in enumerate(found):
        if len(f) > STEPS:
            labels[i] = net.label_long(f)
    return ["\n".join(b.text for b, main in zip(f, y, strict=True) if main) for f, y in zip(found, labels, strict=True)]


def extract(pages: DataFrame, keep: list[str], html: str = "html") -> DataFrame:
    """keep, text and n_chars of every page."""
    held = pages.sparkSession.sparkContext.broadcast(trained())

    def run(x: dict[str, pa.Array]) -> dict[str, pa.Array]:
        column = x[html]
        texts: list[str] = []
        for i in range(0, len(column), TOGETHER):
            texts += main_texts(column.slice(i, TOGETHER).to_pylist(), held.value)
        return {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}

    return arrow_map(pages, keep, [html], run, [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
