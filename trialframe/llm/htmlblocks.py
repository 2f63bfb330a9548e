"""Main-text extraction: a bidirectional LSTM labels every block of a page, using the whole page as context."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_texts

#: Tags that end a block where they open or close. All others, known or not, are inline.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html iframe legend li main menu nav object ol option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
#: Tags without content; they are never on the path.
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is never text of the page.
SKIP_TAGS = ("script", "style", "template", "noscript", "svg", "math", "canvas")
#: Tags that close themselves when the next of the kind (or, for p, any block) opens.
SELF_CLOSING = {"p": BLOCK_TAGS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
#: A tag with well-formed attributes; failing that, such as with a quote that has no partner, all up to the next ``>``.
_ATTRIBUTES = r"""(?:\s*+/|\s++[^\s"'<>/=]++(?:\s*+=\s*+(?:"[^"]*+"(?=[\s/>])|'[^']*+'(?=[\s/>])|[^\s"'<>][^\s<>]*+))?)*+\s*+"""
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)({_ATTRIBUTES}(?=>)|[^>]*)>|<[!?][^>]*>", re.S)
_NAME = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPACE = re.compile(r"\s+")
_NAMED = re.compile(r"[^\W_]+")


WIDTH = 160
_PATH, _NAMES, _WORDS = 60, 60, 36  # hashed tag paths, names and words; the rest are plain numbers


def _slot(word: str, salt: str, size: int) -> int:
    return zlib.crc32((salt + word).encode("utf-8", "surrogatepass")) % size


@lru_cache(maxsize=1 << 16)
def _word_slot(word: str) -> int:
    return _slot(word, "w", _WORDS)


@dataclass
class Block:
    """Text of one leaf; ``above`` tells the hashed tags above it and the names (class, id, role) that they bear, all of them."""

    text: str
    above: np.ndarray
    link_chars: int


class _Path:
    """The open block tags, with how many of them fall into each slot: pushing and popping costs the same at any depth."""

    def __init__(self):
        self.tags: list[tuple[str, list[int]]] = []
        self.open: Counter = Counter()
        self.slots = np.zeros(_PATH + _NAMES, np.int32)

    def push(self, tag: str, names: list[str]) -> None:
        at = [_slot(tag, "t", _PATH), *(_PATH + _slot(n, "n", _NAMES) for n in names)]
        for i in at:
            self.slots[i] += 1
        self.tags.append((tag, at))
        self.open[tag] += 1

    def pop(self) -> str:
        tag, at = self.tags.pop()
        for i in at:
            self.slots[i] -= 1
        self.open[tag] -= 1
        return tag

    def close(self, tag: str) -> None:
        """Leave the innermost ``tag`` and all within it; nothing if there is none."""
        while self.open[tag]:
            if self.pop() == tag:
                return

    def above(self) -> np.ndarray:
        out = (self.slots > 0).astype(np.float32)
        if self.tags:
            out[_slot(self.tags[-1][0], "leaf", _PATH)] += 1.0
        return out


def blocks(html: str) -> list[Block]:
    """Leaf blocks of a page in order. Works on any text: unclosed, crossing and unknown tags are fine.

    Scripts, styles, comments and markup give no text; character references are decoded, white space becomes
    one space; a ``<br>`` is white space. A quote without a partner ends with its tag.
    """
    out: list[Block] = []
    path = _Path()
    parts: list[str] = []
    link = in_link = 0

    def flush() -> None:
        nonlocal link
        text = _SPACE.sub(" ", unescape("".join(parts))).strip()
        parts.clear()
        if text:
            out.append(Block(text, path.above(), link))
        link = 0

    at, skip_to = 0, -1
    for m in _TOKEN.finditer(html):
        if m.start() < skip_to:
            continue
        if m.start() > at:
            parts.append(html[at : m.start()])
            link += in_link * (m.start() - at)
        at = m.end()
        tag = m[2] and m[2].lower()
        if not tag:
            continue
        if m[1]:
            if tag == "a":
                in_link = 0
            if tag in BLOCK_TAGS:
                flush()
                path.close(tag)
        elif tag in SKIP_TAGS:
            if not m[3].endswith("/"):
                end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
                at = skip_to = end.end() if end else len(html)
        elif tag in BLOCK_TAGS:
            flush()
            while path.tags and tag in SELF_CLOSING.get(path.tags[-1][0], ()):
                path.pop()
            if tag not in VOID_TAGS:
                path.push(tag, [w.lower() for n in _NAME.finditer(m[3]) for w in _NAMED.findall(n[2] or n[3] or n[4] or "")])
        elif tag == "br":
            parts.append(" ")
        elif tag == "a":
            in_link = 1
    if at < len(html):
        parts.append(html[at:])
    flush()
    return out


# ---- features -------------------------------------------------------------------------------------------------

def vectors(page: list[Block]) -> np.ndarray:
    """One row for each block: hashed tag path, hashed names, hashed words (all of the block, as shares) and plain numbers such as length and link share."""
    out = np.zeros((len(page), WIDTH), np.float32)
    k = _PATH + _NAMES
    for i, b in enumerate(page):
        row = out[i]
        row[:k] = b.above
        words = b.text.lower().split()
        row[k : k + _WORDS] = np.bincount([_word_slot(w) for w in words], minlength=_WORDS) * (1.0 / (len(words) + 3))
        n = len(b.text)
        row[k + _WORDS] = np.log1p(n) / 5
        row[k + _WORDS + 1] = min(1.0, b.link_chars / n)
        row[k + _WORDS + 2] = i / len(page)
        row[k + _WORDS + 3] = 1.0
    return out


# ---- network --------------------------------------------------------------------------------------------------


class BiLstm:
    """A bidirectional LSTM with a logistic output for each block, in numpy, trained by Adam on whole sequences."""

    def __init__(self, width: int = WIDTH, hidden: int = 12, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.p = {}
        for d in "fb":
            self.p["x" + d] = (rng.standard_normal((width, 4 * hidden)) / np.sqrt(width)).astype(np.float32)
            self.p["h" + d] = (rng.standard_normal((hidden, 4 * hidden)) / np.sqrt(hidden)).astype(np.float32)
            self.p["c" + d] = np.zeros(4 * hidden, np.float32)
            self.p["c" + d][hidden : 2 * hidden] = 1.0  # remember at first
        self.p["o"] = (rng.standard_normal(2 * hidden) / np.sqrt(2 * hidden)).astype(np.float32)
        self.p["ob"] = np.zeros(1, np.float32)

    def _run(self, d: str, x: np.ndarray, mask: np.ndarray, keep: bool):
        """x: batch, time, width; mask: batch, time (0 past a page's end, where the state stands still)."""
        n, t, _ = x.shape
        z = self.hidden
        pre = x @ self.p["x" + d] + self.p["c" + d]
        h, c = np.zeros((n, z), np.float32), np.zeros((n, z), np.float32)
        out, saved = np.zeros((n, t, z), np.float32), []
        for k in range(t) if d == "f" else range(t - 1, -1, -1):
            a = pre[:, k] + h @ self.p["h" + d]
            gate = 1 / (1 + np.exp(-a[:, : 3 * z]))
            i, f, o = gate[:, :z], gate[:, z : 2 * z], gate[:, 2 * z :]
            g = np.tanh(a[:, 3 * z :])
            m = mask[:, k : k + 1]
            new_c = m * (f * c + i * g) + (1 - m) * c
            tc = np.tanh(new_c)
            new_h = m * (o * tc) + (1 - m) * h
            if keep:
                saved.append((k, i, f, o, g, c, h, tc, m))
            h, c = new_h, new_c
            out[:, k] = h
        return out, saved

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Probability that a block is main text."""
        h = np.concatenate([self._run("f", x, mask, False)[0], self._run("b", x, mask, False)[0]], 2)
        return 1 / (1 + np.exp(-(h @ self.p["o"] + self.p["ob"])))

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        z = self.hidden
        runs = {d: self._run(d, x, mask, True) for d in "fb"}
        h = np.concatenate([runs["f"][0], runs["b"][0]], 2)
        p = 1 / (1 + np.exp(-(h @ self.p["o"] + self.p["ob"])))
        total = mask.sum()
        loss = -float((mask * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).sum() / total)
        ds = mask * (p - y) / total
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        grad["o"], grad["ob"] = np.einsum("nt,ntk->k", ds, h), ds.sum().reshape(1)
        for j, d in enumerate("fb"):
            up = ds[:, :, None] * self.p["o"][j * z : (j + 1) * z]
            dh, dc = np.zeros((len(x), z), np.float32), np.zeros((len(x), z), np.float32)
            for k, i, f, o, g, c, before, tc, m in reversed(runs[d][1]):
                dh = dh + up[:, k]
                do = m * dh * tc
                dnew = dc + m * dh * o * (1 - tc * tc)
                di, df, dg = m * dnew * g, m * dnew * c, m * dnew * i
                da = np.concatenate([di * i * (1 - i), df * f * (1 - f), do * o * (1 - o), dg * (1 - g * g)], 1)
                grad["x" + d] += x[:, k].T @ da
                grad["h" + d] += before.T @ da
                grad["c" + d] += da.sum(0)
                dh = da @ self.p["h" + d].T + (1 - m) * dh
                dc = m * dnew * f + (1 - m) * dnew
        return loss, grad

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = 8, rate: float = 0.02, batch: int = 32, seed: int = 5) -> BiLstm:
        """``pages`` are (vectors, labels) of whole pages."""
        rng = np.random.default_rng(seed)
        one, two, step = {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}, 0
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(len(pages)), max(1, len(pages) // batch)):
                x, mask = padded([pages[i][0] for i in part])
                y = np.zeros(mask.shape, np.float32)
                for r, i in enumerate(part):
                    y[r, : len(pages[i][1])] = pages[i][1]
                _, grad = self.gradients(x, mask, y)
                step += 1
                for k, g in grad.items():
                    g = np.clip(g, -1, 1)
                    one[k] = 0.9 * one[k] + 0.1 * g
                    two[k] = 0.999 * two[k] + 0.001 * g * g
                    self.p[k] = (self.p[k] - rate * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


def padded(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    t = max(map(len, seqs))
    x, mask = np.zeros((len(seqs), t, WIDTH), np.float32), np.zeros((len(seqs), t), np.float32)
    for i, s in enumerate(seqs):
        x[i, : len(s)], mask[i, : len(s)] = s, 1.0
    return x, mask


# ---- training pages -------------------------------------------------------------------------------------------

#: Names that pages give to what is not their main text, and to what is.
SIDE_NAMES = {
    "nav": ("nav", "navbar", "menu", "breadcrumbs", "topnav", "pagination", "site-nav"), "header": ("header", "masthead", "banner", "top-bar", "logo"),
    "footer": ("footer", "site-footer", "copyright", "legal", "colophon"), "aside": ("sidebar", "widget", "related", "recommended", "popular", "trending"),
    "ad": ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner-ad"), "notice": ("cookie", "consent", "gdpr", "notice", "popup", "modal", "alert", "newsletter", "subscribe"),
    "comments": ("comments", "comment", "comment-list", "replies", "reply", "disqus", "discussion"), "share": ("share", "social", "tags", "toolbar"), "form": ("search", "login", "signup", "form"),
}
#: Words that menus, notices, adverts and comments often use.
SIDE_WORDS = {
    "nav": "home about contact news products services login search blog archive help start impressum kontakt accueil inicio", "footer": "copyright rights reserved privacy terms imprint contact legal datenschutz mentions aviso",
    "ad": "advertisement sponsored buy now sale offer discount free shipping deal anzeige publicité anuncio", "notice": "we use cookies to improve your experience accept privacy policy consent subscribe newsletter cookie",
    "comments": "reply thanks great i agree said posted commented comment report like antworten répondre responder",
}
MAIN_NAMES = ("", "", "content", "post", "entry", "article-body", "story", "main", "text", "post-content")


def made_up_page(rng: np.random.Generator) -> tuple[str, list[bool]]:
    """A page of random make, and for each of its blocks whether it is main text."""
    letters = "".join("abcdefghijklmnopqrstuvwxyzéüñ  "[k] for k in rng.integers(0, 31, 2000))
    word = lambda: letters[(k := rng.integers(0, 1980)) : k + rng.integers(1, 9)].replace(" ", "") or "a"

    def say(a: int, b: int) -> str:
        n, k = 6 * rng.integers(a, b), rng.integers(0, 1000)
        return (letters[k : k + n].strip() or "a") + pick(("", ".", ".", "!"))

    pick = lambda xs: xs[rng.integers(len(xs))]
    html, main = [], []

    def aside(kind: str, a: int, b: int) -> str:
        """Text of a side block: in part of them, words that are usual there."""
        if kind not in SIDE_WORDS or rng.random() < 0.5:
            return say(a, b)
        own = SIDE_WORDS[kind].split()
        return " ".join(pick(own) for _ in range(max(1, rng.integers(a, b))))

    def add(text: str, is_main: bool, tag: str = "p") -> None:
        close = "" if tag in ("p", "li") and rng.random() < 0.15 else f"</{tag}>"
        wrap = pick(("", "", "", "b", "i", "em", "span", "strong"))
        html.append(f"<{tag}>" + (f"<{wrap}>{text}</{wrap}>" if wrap and rng.random() < 0.5 else text) + close)
        main.append(is_main)

    def opened(tag: str, name: str = "") -> None:
        html.append(f"<{tag} {pick(('class', 'class', 'id'))}=\"{name}\">" if name else f"<{tag}>")

    def side(kind: str) -> None:
        own = {"nav": ("nav", "nav", "div", "ul"), "header": ("header", "div"), "footer": ("footer", "footer", "div"), "aside": ("aside", "aside", "div"), "form": ("form", "form", "div")}
        plain = kind in ("nav", "header", "footer", "aside", "form")
        tag = pick(own.get(kind, ("div", "div", "section", "p" if kind in ("ad", "notice") else "div", "aside")))
        name = pick(SIDE_NAMES[kind]) if tag in ("div", "p", "section", "ul", "aside") or rng.random() < 0.4 else ""
        name = pick(SIDE_NAMES[kind]) if not plain else name
        if tag == "p":
            html.append(f'<p class="{name}">{aside(kind, 3, 40)}</p>')
            main.append(False)
            return
        opened(tag, name)
        if kind == "nav" or (kind in ("aside", "share") and rng.random() < 0.5):
            if tag != "ul":
                html.append("<ul>")
            for _ in range(rng.integers(2, 9)):
                add(f'<a href="/{word()}">{aside(kind, 1, 4)}</a>', False, "li")
            html.append("</ul>" if tag != "ul" else "")
        elif kind == "comments":
            for _ in range(rng.integers(1, 5)):
                if rng.random() < 0.5:
                    opened("div", "comment")
                    add(aside(kind, 4, 70), False)
                    html.append("</div>")
                else:
                    add(aside(kind, 4, 70), False, pick(("p", "li", "div")))
        elif kind == "form":
            add(aside(kind, 1, 5), False, pick(("button", "legend", "p")))
        elif rng.random() < 0.4:
            html.append(aside(kind, 2, 40))
            main.append(False)
        else:
            for _ in range(rng.integers(1, 4)):
                add(aside(kind, 2, 50), False, pick(("p", "p", "div", "h3")))
        html.append(f"</{tag}>")

    html.append("<!DOCTYPE html><html><head>")
    if rng.random() < 0.9:
        html.append(f"<title>{say(1, 12)}</title>")
        main.append(False)
    html.append("</head><body>")
    for kind in ("header", "notice", "nav", "ad", "share", "form", "aside"):
        if rng.random() < (0.75 if kind == "nav" else 0.3):
            side(kind)
    box = pick(("article", "article", "article", "main", "div", "section"))
    opened(box, pick(MAIN_NAMES[2:]) if box in ("div", "section") else pick(MAIN_NAMES))
    if rng.random() < 0.9:
        add(say(1, 14), True, pick(("h1", "h1", "h2")))
    for _ in range(rng.integers(1, 12)):
        kind = rng.random()
        if kind < 0.72:
            add(say(1, 110), True)
        elif kind < 0.78:
            add(say(1, 8), True, pick(("h2", "h3")))
        elif kind < 0.84:
            html.append("<ul>")
            for _ in range(rng.integers(1, 5)):
                add(say(1, 25), True, "li")
            html.append("</ul>")
        elif kind < 0.88:
            add(say(3, 50), True, pick(("blockquote", "pre", "td", "dd")))
        elif kind < 0.94:
            side(pick(("ad", "share", "aside", "notice")))
        else:
            add(f'<a href="/{word()}">{say(1, 6)}</a> {say(4, 40)}', True)
    html.append(f"</{box}>")
    for kind in ("ad", "comments", "share", "aside", "form", "nav", "notice", "footer"):
        if rng.random() < (0.8 if kind == "footer" else 0.35):
            side(kind)
    html.append("</body></html>")
    return "".join(html), main


def train(n_pages: int = 500, epochs: int = 6, seed: int = 11) -> BiLstm:
    """A model fitted on ``n_pages`` made-up pages: their blocks' labels are known, and no page of the corpus is needed."""
    rng = np.random.default_rng(seed)
    pages = []
    while len(pages) < n_pages:
        html, main = made_up_page(rng)
        found = blocks(html)
        if found and len(found) == len(main):
            pages.append((vectors(found), np.array(main, np.float32)))
    return BiLstm().fit(pages, epochs)


def main_text(pages: list[str | None], model: BiLstm, threshold: float = 0.5) -> list[str]:
    """Main text of each page: its main blocks joined by an empty line."""
    found = [blocks(h) if h else [] for h in pages]
    out = [""] * len(pages)
    # Pages of like length run together, so padding is small; a very long page runs alone.
    order = sorted((i for i in range(len(pages)) if found[i]), key=lambda i: len(found[i]))
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and end - at < 256 and (end + 1 - at) * len(found[order[end]]) <= 16_384:
            end += 1
        part = order[at:end]
        x, mask = padded([vectors(found[i]) for i in part])
        for i, s in zip(part, model.scores(x, mask)):
            out[i] = "\n\n".join(b.text for b, p in zip(found[i], s) if p > threshold)
        at = end
    return out


def extract(pages: DataFrame, model: BiLstm | None = None) -> DataFrame:
    """Main text of every row of ``pages`` (columns page_id, url, html) from its whole html.

    Returns ``page_id, url, text, n_chars`` (code points). Null and empty html, and pages without a main block, have empty
    text. Repeated rows give a row each; an empty table an empty one; extra columns are ignored.
    """
    model = train() if model is None else model
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        text = main_text(b.column(2).to_pylist(), model)
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return map_texts(pages.select("page_id", "url", "html"), run, f"page_id {kind}, url string, text string, n_chars long")
