"""Main text of web pages: a bidirectional LSTM labels the blocks of a page in their order."""

from __future__ import annotations

import functools
import html as references
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: element classes of HTML
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd mark q rp rt ruby s samp "
             "small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "noscript", "template", "iframe", "svg", "textarea")
CLOSES = {"li": {"li"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
          "td": {"td", "th"}, "th": {"td", "th"}, "body": {"head", "title"}}

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    r"|<(?P<raw>" + "|".join(RAW) + r")(?=[\s/>])[^>]*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)"
    r"|(?P<text>[^<]++|<)", re.S | re.I)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PIECES = re.compile(r"[a-z]+")


PATH_DIMS, WORD_DIMS, NUMBERS = 192, 48, 8


@functools.lru_cache(maxsize=1 << 16)
def _slots(token: str, dims: int) -> tuple[int, int]:
    h = zlib.crc32(token.encode("utf-8", "surrogatepass"))
    return h % dims, (h >> 16) % dims


class Tag:
    """An open element: its name and classes, the element around it, and what the whole path to it says, as one bit set."""
    __slots__ = ("names", "above", "depth", "bits")

    def __init__(self, names: tuple[str, ...], above: Tag | None):
        self.names, self.above = names, above
        self.depth, self.bits = (above.depth + 1, above.bits) if above else (1, 0)
        for name in names:
            for slot in _slots(name, PATH_DIMS):
                self.bits |= 1 << slot


@dataclass
class Block:
    """A leaf text block: its innermost element, its text, and the share of the text inside links."""
    tag: Tag | None
    text: str
    linked: float = 0.0

    @property
    def path(self) -> tuple[tuple[str, ...], ...]:
        """The names on the path to the block, outermost first."""
        names, tag = [], self.tag
        while tag:
            names.append(tag.names)
            tag = tag.above
        return tuple(reversed(names))


@dataclass
class _Page:
    """Open elements, counted by name, and counted by name among the inline ones since each block element.

    So whether an end tag closes anything is known without a look through
    the open elements, and every element is opened and closed once: the work
    grows with the page, however deep it is nested.
    """
    stack: list[tuple[str, Tag]] = field(default_factory=list)
    open: Counter = field(default_factory=Counter)
    inline: list[Counter] = field(default_factory=lambda: [Counter()])
    text: list[str] = field(default_factory=list)
    linked: int = 0
    blocks: list[Block] = field(default_factory=list)

    def flush(self) -> None:
        # references are decoded over the whole block, then white space becomes one space
        said = " ".join(references.unescape("".join(self.text)).split())
        if said:
            raw = sum(len(t) for t in self.text)
            self.blocks.append(Block(self.stack[-1][1] if self.stack else None, said, min(1.0, self.linked / max(1, raw))))
        self.text, self.linked = [], 0

    def push(self, tag: str, names: tuple[str, ...]) -> None:
        self.stack.append((tag, Tag(names, self.stack[-1][1] if self.stack else None)))
        self.open[tag] += 1
        if tag in INLINE:
            self.inline[-1][tag] += 1
        else:
            self.inline.append(Counter())

    def pop(self) -> str:
        tag, _ = self.stack.pop()
        self.open[tag] -= 1
        if tag in INLINE:
            self.inline[-1][tag] -= 1
        else:
            self.inline.pop()
        return tag

    def close(self, tag: str) -> None:
        """End the innermost element of this name and all in it; an inline one only up to the block element around."""
        if (self.inline[-1] if tag in INLINE else self.open)[tag]:
            while self.pop() != tag:
                pass


def parse(page: str | None) -> list[Block]:
    """The leaf text blocks of a page in order, with the names on their tag path; scripts and styles are none."""
    p = _Page()
    for m in _TOKEN.finditer(page or ""):
        if (text := m["text"]) is not None:
            p.text.append(text)
            if p.open["a"]:
                p.linked += len(text)
            continue
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        end, attrs = m["end"] or m["end2"], m["attrs"] or m["attrs2"] or ""
        if tag in INLINE:
            if tag in ("br", "img", "input", "wbr"):
                p.text.append(" " if tag != "wbr" else "")
            elif end:
                p.close(tag)
            else:
                p.push(tag, (tag,))
            continue
        p.flush()
        if end:
            p.close(tag)
            continue
        p.close("p")  # a block ends an open paragraph
        while p.stack and p.stack[-1][0] in INLINE:
            p.pop()
        if tag in CLOSES:
            while p.stack and p.stack[-1][0] in CLOSES[tag]:
                p.pop()
        if tag not in VOID:
            named = " ".join("".join(g) for g in _NAMED.findall(attrs)).lower()  # one of the three quotings matched
            p.push(tag, (tag, *("." + x for x in _PIECES.findall(named))))
    p.flush()
    return p.blocks


def features(blocks: list[Block]) -> np.ndarray:
    """[block, feature]: hashed tag path, hashed words, and a few numbers."""
    x = np.zeros((len(blocks), PATH_DIMS + WORD_DIMS + NUMBERS), np.float32)
    for i, b in enumerate(blocks):
        if b.tag:
            x[i, :PATH_DIMS] = np.unpackbits(np.frombuffer(b.tag.bits.to_bytes(PATH_DIMS // 8, "little"), np.uint8), bitorder="little")
        ws = b.text.split()
        for w in set(ws):
            x[i, PATH_DIMS + _slots(w, WORD_DIMS)[0]] += 1
        x[i, PATH_DIMS:PATH_DIMS + WORD_DIMS] /= max(1, len(ws))
        n = len(b.text)
        x[i, -NUMBERS:] = (np.log1p(n) / 8, b.linked, len(ws) <= 3, b.text[-1] in ".!?", "©" in b.text,
                           sum(map(b.text.count, ".,;")) / max(1, len(ws)), i / max(1, len(blocks) - 1), (b.tag.depth if b.tag else 0) / 10)
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM with a logistic output per block; all state in numpy arrays."""

    def __init__(self, inputs: int, hidden: int = 16, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.h = hidden
        self.w: dict[str, np.ndarray] = {"out": rng.normal(0, 0.2, 2 * hidden), "bias": np.zeros(1)}
        for d in "fb":
            self.w["x" + d] = rng.normal(0, 0.1, (inputs, 4 * hidden))
            self.w["h" + d] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden))
            self.w["b" + d] = np.repeat([0.0, 1.0, 0.0, 0.0], hidden)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """Hidden states [batch, step, hidden] of one direction; steps beyond a page's end pass state on."""
        n, steps, _ = x.shape
        put = x @ self.w["x" + d] + self.w["b" + d]
        kind = put.dtype
        h, c, out = np.zeros((n, self.h), kind), np.zeros((n, self.h), kind), np.zeros((n, steps, self.h), kind)
        for t in range(steps) if d == "f" else reversed(range(steps)):
            i, f, o, g = np.split(put[:, t] + h @ self.w["h" + d], 4, axis=1)
            i, f, o, g = _sigmoid(i), _sigmoid(f), _sigmoid(o), np.tanh(g)
            m = mask[:, t, None]
            c2 = np.where(m, f * c + i * g, c)
            h2 = np.where(m, o * np.tanh(c2), h)
            if keep is not None:
                keep.append((t, h, c, i, f, o, g, c2))
            h, c = h2, c2
            out[:, t] = h
        return out

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(x, mask, d) for d in "fb"], axis=2)
        return both @ self.w["out"] + self.w["bias"]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        kept: dict[str, list] = {"f": [], "b": []}
        both = np.concatenate([self._run(x, mask, d, kept[d]) for d in "fb"], axis=2)
        p = _sigmoid(both @ self.w["out"] + self.w["bias"])
        err = (p - y) * mask / max(1, mask.sum())
        grad = {"out": np.einsum("nt,nth->h", err, both), "bias": np.array([err.sum()])}
        for k, d in enumerate("fb"):
            wh = self.w["h" + d]
            dput = np.zeros((*x.shape[:2], 4 * self.h))
            gh = np.zeros_like(wh)
            dh, dc = np.zeros((len(x), self.h)), np.zeros((len(x), self.h))
            down = self.w["out"][k * self.h:(k + 1) * self.h]
            for t, h0, c0, i, f, o, g, c2 in reversed(kept[d]):
                m = mask[:, t, None]
                dh = dh + err[:, t, None] * down
                th = np.tanh(c2)
                dc2 = dc + dh * o * (1 - th * th)
                z = np.concatenate([dc2 * g * i * (1 - i), dc2 * c0 * f * (1 - f), dh * th * o * (1 - o),
                                    dc2 * i * (1 - g * g)], axis=1) * m
                dput[:, t] = z
                gh += h0.T @ z
                dh = np.where(m, z @ wh.T, dh)
                dc = np.where(m, dc2 * f, dc)
            grad["x" + d] = np.einsum("nti,ntj->ij", x, dput, optimize=True)
            grad["h" + d], grad["b" + d] = gh, dput.sum(axis=(0, 1))
        return grad

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = 10, batch: int = 24, rate: float = 0.02,
            seed: int = 5) -> "Labeller":
        rng, step = np.random.default_rng(seed), 0
        first, second = ({k: np.zeros_like(v) for k, v in self.w.items()} for _ in range(2))
        for _ in range(epochs):
            for at in np.array_split(rng.permutation(len(pages)), max(1, len(pages) // batch)):
                x, mask = _padded([pages[i][0] for i in at])
                y = np.zeros(mask.shape)
                for r, i in enumerate(at):
                    y[r, :len(pages[i][1])] = pages[i][1]
                step += 1
                for k, g in self.gradients(x, mask, y).items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    self.w[k] -= rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-8)
        return self


def _padded(xs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(x) for x in xs)
    out, mask = np.zeros((len(xs), steps, xs[0].shape[1]), np.float32), np.zeros((len(xs), steps), bool)
    for i, x in enumerate(xs):
        out[i, :len(x)], mask[i, :len(x)] = x, True
    return out, mask


# fixed values: names and phrases that pages use outside their main text
ASIDE = {
    "header": ["header", "masthead", "topbar", "site-header", "banner"], "nav": ["nav", "menu", "navbar", "breadcrumb"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsored", "promo"],
    "notice": ["notice", "cookie", "consent", "cookie-banner", "alert", "gdpr"],
    "sidebar": ["sidebar", "related", "widget", "recommended", "trending", "aside"],
    "comments": ["comments", "comment", "comment-list", "discussion", "replies", "reader-comments"],
    "form": ["form", "newsletter", "subscribe", "signup", "search", "login"],
    "footer": ["footer", "site-footer", "copyright", "colophon", "legal"], "share": ["share", "social", "tags"],
}
MAIN = ["content", "post", "entry", "article", "article-body", "story", "main", "text"]
PHRASES = {
    "notice": "We use cookies to improve your experience. Accept all", "form": "Enter your email address to subscribe",
    "comments": "Reply Posted by", "footer": "© All rights reserved. Privacy Terms Contact", "ad": "Advertisement",
    "share": "Share this on", "sidebar": "Related articles", "nav": "Home About Contact", "header": "Sign in",
}


class PageMaker:
    """Training pages: generated markup of many layouts whose blocks' labels are known."""

    def __init__(self, seed: int = 3):
        self.rng = np.random.default_rng(seed)
        syllables = ["".join(p) for p in zip("bcdfglmnprstv" * 5, "aeiouaeioéüaeiouö" * 4, "nrslt" * 13)]
        self.vocabulary = ["".join(self.rng.choice(syllables, self.rng.integers(1, 4))) for _ in range(900)]

    def one(self, xs):
        return xs[int(self.rng.integers(len(xs)))]

    def chance(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def prose(self, low: int = 1, high: int = 90) -> str:
        n = int(np.exp(self.rng.uniform(np.log(low), np.log(high + 1))))
        ws = [self.one(self.vocabulary) for _ in range(max(1, n))]
        ws = [w + "," if self.chance(0.08) else w + "." if self.chance(0.1) else w for w in ws]
        return " ".join(ws).capitalize() + ("." if self.chance(0.8) else "")

    def item(self, kind: str) -> str:
        said = self.prose(1, 30) if self.chance(0.6) else f"{PHRASES[kind]} {self.prose(1, 4)}"
        tag = self.one(["p", "div", "span", "h3", "li", "h2"])
        link = f'<a href="/{self.one(self.vocabulary)}">{said}</a>' if self.chance(0.4) else said
        return f"<{tag}>{link}</{tag}>"

    def outside(self, kind: str) -> list[tuple[str, int]]:
        """Markup of one part that is not main text, as (markup, label) pieces."""
        own = {"header": "header", "nav": "nav", "sidebar": "aside", "footer": "footer", "form": "form"}.get(kind)
        tag = own if own and self.chance(0.6) else self.one(["div", "section", "ul"] if kind != "ad" else ["div", "aside"])
        named = tag == own and self.chance(0.6)
        start = f"<{tag}>" if named else f'<{tag} {self.one(["class", "class", "id"])}="{self.one(ASIDE[kind])}">'
        if kind == "nav":
            inner = "<ul>" + "".join(f'<li><a href="/x">{self.prose(1, 3)}</a></li>' for _ in range(
                self.rng.integers(2, 9))) + "</ul>"
        elif kind == "form":
            inner = f'<label>{self.prose(1, 5)}</label><input name="q"><button>{self.prose(1, 2)}</button>'
        elif kind == "footer" and self.chance(0.6):
            inner = f"&copy; {self.prose(1, 12)}"
        elif self.chance(0.4):
            inner = self.prose(2, 40)
        else:
            inner = "".join(self.item(kind) for _ in range(self.rng.integers(1, 6)))
        return [(f"{start}{inner}</{tag}>", 0)]

    def main(self) -> list[tuple[str, int]]:
        tag = self.one(["article", "article", "article", "main", "div", "section"])
        start = f"<{tag}>" if tag in ("article", "main") and self.chance(0.7) else f'<{tag} class="{self.one(MAIN)}">'
        out = [(start, 1)]
        if self.chance(0.85):
            out.append((f"<h1>{self.prose(2, 12)}</h1>", 1))
        for _ in range(self.rng.integers(1, 14)):
            if self.chance(0.12):
                out += self.outside(self.one(["ad", "notice", "form", "share", "sidebar", "comments"]))
            kind = self.one(["p"] * 9 + ["h2", "ul", "blockquote", "pre", "table", "figure", "bad", "bad"])
            said = self.prose()
            out.append(({"ul": f"<ul><li>{said}</li><li>{self.prose(1, 20)}</li></ul>",
                         "blockquote": f"<blockquote><p>{said}</p></blockquote>", "bad": f"<p><b>{said}<br>",
                         "table": f"<table><tr><td>{self.prose(1, 5)}</td><td>{said}</td></tr></table>",
                         "figure": f"<figure><figcaption>{said}</figcaption></figure>"}.get(
                kind, f"<{kind}>{said}</{kind}>"), 1))
        return [*out, (f"</{tag}>", 1)]

    def page(self) -> tuple[list[Block], np.ndarray]:
        """Blocks of a page and their labels: 1 for main text."""
        parts = [(f"<html><head><title>{self.prose(2, 12)}</title><style>p{{}}</style></head><body>", 0)]
        for kind in ("header", "nav", "notice", "ad", "form", "sidebar"):
            if self.chance(0.45):
                parts += self.outside(kind)
        parts += self.main()
        for kind in ("share", "ad", "comments", "sidebar", "form", "notice", "nav", "footer"):
            if self.chance(0.4):
                parts += self.outside(kind)
        text = "".join(f"{markup}" for markup, _ in parts)
        blocks = parse(text + ("</body></html>" if self.chance(0.9) else ""))
        # a block's label: that of the piece of markup its text comes from, found in order
        at, k, labels = 0, 0, []
        plain = [" ".join(b.text for b in parse(m)) for m, _ in parts]
        for b in blocks:
            while k < len(plain) and plain[k].find(b.text, at) < 0:
                k, at = k + 1, 0
            labels.append(parts[k][1] if k < len(parts) else 0)
            at = plain[k].find(b.text, at) + len(b.text) if k < len(plain) else 0
        return blocks, np.array(labels, float)


@functools.lru_cache(maxsize=2)
def trained(pages: int = 400, seed: int = 3) -> Labeller:
    """The labeller, fitted on ``pages`` generated pages; the same weights on every run."""
    maker = PageMaker(seed)
    made = [(features(b), y) for b, y in (maker.page() for _ in range(pages)) if b]
    model = Labeller(PATH_DIMS + WORD_DIMS + NUMBERS).fit(made)
    model.w = {k: v.astype(np.float32) for k, v in model.w.items()}
    return model


#: Blocks, padding included, that are labelled at once.
BATCH_BLOCKS = 8192


def main_texts(pages: list[str | None], model: Labeller) -> list[str]:
    """The main text of each page: its blocks labelled as such, joined by blank lines."""
    blocks = [parse(p) for p in pages]
    out = [""] * len(pages)
    todo = sorted((i for i, b in enumerate(blocks) if b), key=lambda i: len(blocks[i]))
    while todo:  # pages of like length together
        n = len(todo)
        while n > 1 and n * len(blocks[todo[n - 1]]) > BATCH_BLOCKS:
            n -= max(1, n // 2)
        own, todo = todo[:n], todo[n:]
        x, mask = _padded([features(blocks[i]) for i in own])
        for i, z in zip(own, model.logits(x, mask)):
            out[i] = "\n\n".join(b.text for b, v in zip(blocks[i], z) if v > 0)
    return out


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """One row per page row: id, the columns in ``keep``, text, n_chars.

    The text is the main text, empty if a page has none; null and empty pages
    have none. Every block is labelled with the whole page as context. Repeated
    rows, and rows with a null id, are pages of their own; very long and very
    deeply nested pages are read whole, in time that grows with their length.
    Other columns of the table do not matter, also ones named text or n_chars
    (unless kept: ``keep`` must not name those two).
    """
    model = pages.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(main_texts(batch.tolist(), model.value), dtype=object)

    return pages.select(id_col, *keep, F.pandas_udf(run, "string")(F.col(html_col)).alias("text")).withColumn(
        "n_chars", F.char_length("text").cast("long"))
