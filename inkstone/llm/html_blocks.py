"""Operator 4: main text of web pages by a recurrent block labeller.

A page is read as a sequence of leaf blocks: runs of text between block-level
tags. Each block becomes a vector of its hashed tag path (with class and id
words), its hashed words and a few measures. A bidirectional LSTM in numpy
reads the sequence in both directions, so that the label of a block depends on
the whole page, and marks each block as main text or not.

The labeller is trained here, on pages that ``sample_page`` makes up: articles
of many layouts among menus, headers, notices, adverts, sidebars, forms, reader
comments and footers, with and without telling names. Training is seeded,
bounded (``TRAIN_PAGES``) and done once in a process.
"""

from __future__ import annotations

import functools
import html
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Widths of the hashed tag path and words, other measures, cells of a direction.
PATH, WORDS, MEASURES, CELLS = 96, 32, 8, 24
#: Pages to train on, rounds over them, pages in a step; blocks labelled together.
TRAIN_PAGES, ROUNDS, STEP_PAGES = 1_200, 8, 24
BATCH_BLOCKS = 4_096

# Names of tags by what they do to the text.
_BLOCK = frozenset("address article aside blockquote body button caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html iframe label legend li main nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title noscript template textarea svg iframe".split())
_ENDS_ITSELF = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_NAME = re.compile("[A-Za-z][A-Za-z0-9]*")
_TAG_PART = re.compile("""[>"']""")
_NAMES = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME_WORD = re.compile(r"[a-z]+")
#: Lower case of ASCII letters alone: places stay what they are.
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Block:
    """A leaf block: its text, the summed hashes of the tags and names around it, characters in links."""

    __slots__ = ("text", "path", "linked")

    def __init__(self, text: str, path: np.ndarray, linked: int):
        self.text, self.path, self.linked = text, path, linked


def tokens(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, closing, attributes) of all markup, in order; the name
    is empty for comments and declarations, and a raw element (such as a script)
    is one token with its contents. One way forward: whatever is found missing
    once (an end of comment, of a tag, of a quote) is not looked for again, so
    the time is linear whatever the page holds."""
    low, size, at = page.translate(_LOWER), len(page), 0
    quotes = True  # until a quote turns out to be open to the end of the page
    while (start := page.find("<", at)) >= 0:
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = size if end < 0 else end + 3
            yield start, at, "", False, ""
            continue
        closing = page.startswith("/", start + 1)
        name = _NAME.match(low, start + 1 + closing)
        if not name and page[start + 1 : start + 2] not in ("!", "?", "/"):
            at = start + 1
            continue
        end = -1
        if name and quotes:
            look = name.end()
            while part := _TAG_PART.search(page, look):
                if part[0] == ">":
                    end = part.start()
                    break
                look = page.find(part[0], part.end()) + 1
                if not look:
                    break
            quotes = end >= 0
        if end < 0:
            end = page.find(">", start)
            if end < 0:
                return  # no tag ends any more: the rest is text
        at = end + 1
        if name and name[0] in _RAW and not closing:
            over = low.find(f"</{name[0]}", at)
            over = page.find(">", over) if over >= 0 else -1
            at = size if over < 0 else over + 1
            yield start, at, "", False, ""
        else:
            yield start, at, name[0] if name else "", closing, page[name.end() : end] if name else ""


@functools.lru_cache(maxsize=20_000)
def _hashed(name: str) -> tuple[int, int]:
    h = zlib.crc32(name.encode())
    return h % PATH, 1 if h >> 31 else -1


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks of a page in order, character references of each run of text
    decoded and white space folded. Malformed markup is read as far as it goes."""
    out: list[Block] = []
    stack: list[tuple[str, np.ndarray]] = []
    held: Counter[str] = Counter()
    parts: list[tuple[str, bool]] = []
    link, outside = False, np.zeros(PATH, np.int32)
    page = page or ""

    def close_block() -> None:
        if parts:
            text = " ".join("".join(t for t, _ in parts).split())
            if text:
                linked = sum(len(t) for t, in_link in parts if in_link)
                out.append(Block(text, stack[-1][1] if stack else outside, linked))
            parts.clear()

    def leave(at: int) -> None:
        held.subtract(t for t, _ in stack[at:])
        del stack[at:]

    at = 0
    for start, end, tag, closing, attributes in tokens(page):
        if start > at:
            parts.append((html.unescape(page[at:start]), link))
        at = end
        if tag == "a":
            link = not closing
        elif tag == "br":
            parts.append((" ", link))
        elif tag in _BLOCK:
            close_block()
            if closing:
                if held[tag] > 0:
                    leave(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag))
                link = False
                continue
            ends = _ENDS_ITSELF.get(tag, ())
            if any(held[t] > 0 for t in ends):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in ends:
                        leave(i)
                        break
                    if stack[i][0] not in _ENDS_ITSELF:
                        break
            if tag not in _VOID:
                path = (stack[-1][1] if stack else outside).copy()
                names = [w for n in _NAMES.findall(attributes) for w in _NAME_WORD.findall("".join(n).lower())] if attributes else []
                for name in (tag, *(f".{w}" for w in names)):
                    slot, sign = _hashed(name)
                    path[slot] += sign
                stack.append((tag, path))
                held[tag] += 1
    if at < len(page):
        parts.append((html.unescape(page[at:]), link))
    close_block()
    return out


def features(found: list[Block]) -> np.ndarray:
    """(blocks, PATH + WORDS + MEASURES) for one page's blocks."""
    size = len(found)
    words = [b.text.lower().encode("utf-8", "surrogatepass").split() for b in found]
    per = np.fromiter(map(len, words), np.int64, size)
    h = np.fromiter((zlib.crc32(w) for of in words for w in of), np.int64, int(per.sum()))
    slot = np.repeat(np.arange(size), per) * WORDS + h % WORDS
    hashed = np.bincount(slot, np.where(h >> 31, 1.0, -1.0), size * WORDS).reshape(size, WORDS) / per[:, None]
    n = np.fromiter((len(b.text) for b in found), np.int64, size)
    linked = np.fromiter((b.linked for b in found), np.int64, size)
    ends = np.array([sum(map(b.text.count, ".!?")) for b in found])
    commas = np.array([b.text.count(",") for b in found])
    digits = np.array([sum(map(b.text.count, "0123456789")) for b in found])
    capital = np.array([b.text[:1].isupper() for b in found])
    measures = (np.log1p(n) / 6, np.minimum(1, linked / n), np.log1p(per) / 4, ends / per, commas / per, digits / n, np.arange(size) / size, capital)
    return np.concatenate([np.clip(np.array([b.path for b in found]), -2, 2), hashed, np.column_stack(measures)], axis=1).astype(np.float32)


class Labeller:
    """A bidirectional LSTM with a logistic output for each block."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        d, h = PATH + WORDS + MEASURES, CELLS
        self.p = {}
        for way in "fb":
            self.p["w" + way] = rng.standard_normal((d, 4 * h), np.float32) * np.float32(0.5 / np.sqrt(d))
            self.p["u" + way] = rng.standard_normal((h, 4 * h), np.float32) / np.float32(np.sqrt(h))
            self.p["c" + way] = np.r_[np.zeros(h), np.ones(h), np.zeros(2 * h)].astype(np.float32)
        self.p["o"], self.p["z"] = rng.standard_normal(2 * h, np.float32) * np.float32(0.1), np.zeros(1, np.float32)

    def _run(self, x: np.ndarray, mask: np.ndarray, way: str, keep: list | None = None) -> np.ndarray:
        steps, n, _ = x.shape
        h = c = np.zeros((n, CELLS), np.float32)
        out = np.zeros((steps, n, CELLS), np.float32)
        given = x @ self.p["w" + way] + self.p["c" + way]
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            a = given[t] + h @ self.p["u" + way]
            gates = 1 / (1 + np.exp(-a[:, : 3 * CELLS]))
            i, f, o = np.split(gates, 3, axis=1)
            g = np.tanh(a[:, 3 * CELLS :])
            m = mask[t][:, None]
            c2 = f * c + i * g
            th = np.tanh(c2)
            if keep is not None:
                keep.append((t, h, c, i, f, o, g, th, m))
            c, h = m * c2 + (1 - m) * c, m * (o * th) + (1 - m) * h
            out[t] = h
        return out

    def probabilities(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """(blocks, pages) from (blocks, pages, features) and a 0/1 mask."""
        both = np.concatenate([self._run(x, mask, "f"), self._run(x, mask, "b")], axis=2)
        return 1 / (1 + np.exp(-(both @ self.p["o"] + self.p["z"])))

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict:
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        kept = {"f": [], "b": []}
        hidden = {way: self._run(x, mask, way, kept[way]) for way in "fb"}
        both = np.concatenate([hidden["f"], hidden["b"]], axis=2)
        error = (1 / (1 + np.exp(-(both @ self.p["o"] + self.p["z"]))) - y) * mask / mask.sum()
        grads["o"], grads["z"] = np.tensordot(error, both, 2), np.array([error.sum()])
        for k, way in enumerate("fb"):
            down = error[:, :, None] * self.p["o"][k * CELLS : (k + 1) * CELLS]
            dh = dc = np.zeros(x.shape[1:2] + (CELLS,))
            for t, h, c, i, f, o, g, th, m in reversed(kept[way]):
                dh = dh + down[t]
                own = dh * m
                dct = dc * m + own * o * (1 - th * th)
                a = np.concatenate([dct * g * i * (1 - i), dct * c * f * (1 - f), own * th * o * (1 - o), dct * i * (1 - g * g)], axis=1)
                grads["w" + way] += x[t].T @ a
                grads["u" + way] += h.T @ a
                grads["c" + way] += a.sum(axis=0)
                dh, dc = dh * (1 - m) + a @ self.p["u" + way].T, dct * f + dc * (1 - m)
        return grads

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], rounds: int = ROUNDS, seed: int = 5) -> Labeller:
        rng = np.random.default_rng(seed)
        m1, m2 = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        step = 0
        pages = sorted(pages, key=lambda p: len(p[1]))
        groups = [pages[i : i + STEP_PAGES] for i in range(0, len(pages), STEP_PAGES)]
        for at in range(rounds):
            for g in rng.permutation(len(groups)):
                x, mask = padded([p[0] for p in groups[g]])
                y = np.zeros(mask.shape)
                for j, (_, label) in enumerate(groups[g]):
                    y[: len(label), j] = label
                step += 1
                for k, d in self.gradients(x, mask, y).items():
                    m1[k] = 0.9 * m1[k] + 0.1 * d
                    m2[k] = 0.99 * m2[k] + 0.01 * d * d
                    rate = 0.02 * (1 - at / rounds) + 0.001
                    self.p[k] = (self.p[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(1, *map(len, pages)) if pages else 1
    x, mask = np.zeros((steps, len(pages), PATH + WORDS + MEASURES), np.float32), np.zeros((steps, len(pages)), np.float32)
    for j, page in enumerate(pages):
        x[: len(page), j], mask[: len(page), j] = page, 1
    return x, mask


def sample_page(rng: random.Random) -> str:
    """A made-up page. Blocks of its article carry the mark U+E000 at their start."""
    syllables = ["".join(rng.choice("aeioubcdlmnprstvéäñ") for _ in range(rng.randint(1, 3))) for _ in range(30)]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    style = rng.choice(["", "", "", "!!", "%%%", "###", "&amp;&amp;"])  # pages of junk have the same layouts
    loud = style == "!!"
    few = lambda a, b: " ".join(word() + (style if rng.random() < 0.9 else "") for _ in range(rng.randint(a, b))).capitalize()

    def sentences(a: int, b: int) -> str:
        text = " ".join(few(1, rng.choice([2, 8, 18, 18])) + rng.choice(["", "", ","]) + rng.choice(".....!?") for _ in range(rng.randint(a, b)))
        return text.upper().replace("&AMP;", "&amp;") if loud else text

    named = rng.random() < 0.8

    def tag(name: str, inside: str, *names: str) -> str:
        kind = f' {rng.choice(["class", "class", "id"])}="{rng.choice(names)}"' if names and named and rng.random() < 0.9 else ""
        return f"<{name}{kind}>{inside}</{name}>"

    def links(n: int) -> str:
        return "".join(tag("li", f'<a href="/{word()}">{few(1, 3)}</a>') for _ in range(n))

    nav = lambda: tag(rng.choice(["nav", "nav", "div"]), tag("ul", links(rng.randint(2, 9))), "nav", "menu", "navbar", "breadcrumb", "main-menu", "navigation", "topnav")
    ad = lambda: tag(rng.choice(["div", "div", "aside"]), rng.choice([sentences(1, 3), f"<p>{sentences(1, 2)}</p>", f'<a href="#">{few(2, 8)}</a>']), "ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner", "ad-slot")
    header = lambda: tag(rng.choice(["header", "div"]), f'<a href="/">{few(1, 4)}</a><p>{few(2, 8)}</p>', "header", "masthead", "site-header", "top")
    notice = lambda: tag(rng.choice(["div", "section", "dialog"]), f"<p>{sentences(1, 3)}</p><button>{few(1, 2)}</button>", "cookie", "cookie-notice", "notice", "consent", "alert", "gdpr-banner", "popup", "notification")
    side = lambda: tag(rng.choice(["aside", "aside", "div"]), f"<h3>{few(1, 4)}</h3>" + rng.choice([tag("ul", links(rng.randint(2, 7))), f"<p>{sentences(1, 3)}</p>"]), "sidebar", "related", "widget", "side", "recommended", "trending", "rail")
    form = lambda: tag("form", f'<label>{few(1, 3)}</label><input name="q"><p>{few(2, 9)}</p><button>{few(1, 2)}</button>', "newsletter", "subscribe", "search", "signup", "contact-form", "login")
    comment = lambda: tag(rng.choice(["div", "li", "article"]), f"<b>{few(1, 2)}</b> <p>{sentences(1, 4)}</p>", "comment", "reply", "response", "comment-body")
    comments = lambda: tag(rng.choice(["section", "div", "ol"]), f"<h3>{few(1, 3)}</h3>" + "".join(comment() for _ in range(rng.randint(1, 6))), "comments", "comment-list", "discussion", "responses", "reader-comments")
    footer = lambda: tag(rng.choice(["footer", "footer", "div"]), rng.choice(["&copy; ", "&#169; ", ""]) + f"{word()}.example.org &middot; {sentences(1, 2)}" + rng.choice(["", tag("ul", links(3)), f"<p>{few(2, 9)}</p>"]), "footer", "site-footer", "bottom", "copyright")
    mark = "\ue000"

    def part() -> str:
        r = rng.random()
        if r < 0.62:
            return f"<p>{mark}{rng.choice(['', '', '<b>'])}{sentences(1, rng.choice([1, 3, 8]))}" + rng.choice(["</p>", "</p>", "<br>"])
        if r < 0.74:
            return f"<h2>{mark}{few(1, 7)}</h2>"
        if r < 0.82:
            return "<ul>" + "".join(f"<li>{mark}{sentences(1, 1)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>"
        if r < 0.88:
            return f"<blockquote>{mark}{sentences(1, 3)}</blockquote>"
        if r < 0.93:
            return "<table>" + "".join(f"<tr><td>{mark}{few(1, 3)}</td><td>{mark}{rng.randint(1, 999)}</td></tr>" for _ in range(rng.randint(2, 4))) + "</table>"
        if r < 0.96:
            return f'<p>{mark}{few(3, 9)} <a href="#">{few(1, 4)}</a> {sentences(1, 3)}</p>'
        return rng.choice([ad, form, side])()

    body = "".join(part() for _ in range(rng.randint(1, rng.choice([6, 16, 28]))))
    title = rng.choice([f"<h1>{mark}{few(2, 10)}</h1>"] * 4 + ["", f"<header><h1>{mark}{few(2, 9)}</h1></header>"])
    inside = title + body
    kind = rng.choice(["article"] * 4 + ["main", "div", "section"])
    article = tag(kind, inside, *([] if kind == "article" and rng.random() < 0.6 else ["content", "article", "post", "entry-content", "story", "main", "article-body"]))
    if rng.random() < 0.2:
        article = f"<main>{article}</main>"
    before = [x for x in (header, nav, notice, ad, form) if rng.random() < 0.5]
    after = [x for x in (side, ad, form, comments, footer, nav, notice) if rng.random() < 0.5]
    rng.shuffle(before)
    if footer in after and rng.random() < 0.9:
        after.remove(footer)
        after.append(footer)
    page = "".join(x() for x in before) + article + "".join(x() for x in after)
    if rng.random() < 0.2:
        page = tag("div", page, "page", "wrapper", "container")
    if rng.random() < 0.1:  # a page that breaks off
        page = page[: rng.randint(len(page) // 2, len(page))]
    return f"<!DOCTYPE html><html><head><title>{few(1, 6)}</title></head><body>{page}</body></html>"


@functools.lru_cache(maxsize=1)
def trained(pages: int = TRAIN_PAGES, rounds: int = ROUNDS, seed: int = 5) -> Labeller:
    """The labeller, fitted to ``pages`` made-up pages."""
    rng = random.Random(seed)
    made = []
    for _ in range(pages):
        found = blocks(sample_page(rng))
        labels = np.array(["\ue000" in b.text for b in found], float)
        for b in found:
            b.text = b.text.replace("\ue000", "") or "."
        made.append((features(found), labels))
    return Labeller(seed).fit(made, rounds, seed)


def label(pages: list[list[Block]], labeller: Labeller) -> list[np.ndarray]:
    """For each page, which of its blocks are main text. Pages of like length
    are labelled together, as many as bound the padded blocks."""
    out: list = [np.zeros(0, bool)] * len(pages)
    todo = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
    while todo:
        n = max(1, min(len(todo), BATCH_BLOCKS // len(pages[todo[-1]])))
        now, todo = todo[-n:], todo[:-n]
        x, mask = padded([features(pages[i]) for i in now])
        p = labeller.probabilities(x, mask)
        for j, i in enumerate(now):
            out[i] = p[: len(pages[i]), j] >= 0.5
    return out


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", labeller: Labeller | None = None) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks, n_main: one row per row of ``pages``.

    ``text`` joins the blocks labelled main, in page order, by ``\\n``; it is
    empty for null and empty pages and where no block is main. Whole pages are
    read; ids and urls only pass through, null or repeated.
    """
    sent = pages.sparkSession.sparkContext.broadcast(labeller or trained())

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(0, len(frame), 256):
                part = frame.iloc[i : i + 256]
                found = [blocks(h) for h in part["h"]]
                chosen = label(found, sent.value)
                texts = ["\n".join(b.text for b, c in zip(f, k) if c) for f, k in zip(found, chosen)]
                yield pd.DataFrame({"page_id": part["id"].astype("Int64").to_numpy(), "url": part["u"].to_numpy(), "text": texts, "n_chars": list(map(len, texts)), "n_blocks": list(map(len, found)), "n_main": [int(k.sum()) for k in chosen]})

    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("u"), F.col(html_col).alias("h"))
    return rows.mapInPandas(of, "page_id long, url string, text string, n_chars long, n_blocks long, n_main long")
