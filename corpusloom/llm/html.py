"""Main text of web pages: a linear-chain CRF over the leaf blocks of the page, decoded by Viterbi.

A page is read once, tag by tag, tolerant of tags that are left open, closed twice or cut off. Block-level
tags part it into leaf blocks, inline tags and line breaks don't. Scripts, styles, form controls and
other elements without running text never make blocks. A block's features are the tags, classes, ids and
roles of its ancestors, its own tag, and its text: length, share of links, punctuation, telling words.

The CRF is fitted by maximum likelihood on labelled pages: pages made up from common ways of marking up
articles and what surrounds them, which carry their labels, and a bounded sample of the table's pages that
have an article element, whose blocks are labelled by the elements around them. Half of the training
sequences are shown without their article elements, so that the other features have to explain them.
Every page is extracted from its whole source, row by row, without a shuffle.

Null html is an empty page, and a page without blocks has the empty text. Rows are independent, so
repeated ids don't matter; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 15
#: Pages of the table that are learned from, and the longest part of one that is a training sequence.
SAMPLE, SEQUENCE = 100, 100
MADE_UP = 800

BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody "
    "td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
#: Foreign elements: they nest, end at their own "/>" or with what is around them, and no block stands in them.
FOREIGN_TAGS = ("svg", "math")
SILENT_TAGS = frozenset("head select option button object canvas audio video map datalist".split()) | {*FOREIGN_TAGS}
#: What can stand in a head; any other tag, or text, ends it.
HEAD_TAGS = frozenset("html head title base basefont bgsound link meta style script noscript noframes template".split())
#: An opening tag of the first kind ends open elements of the second kind.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Elements, and words in classes and ids, around text that is not the article.
SURROUNDING_TAGS = frozenset("nav header footer aside form menu dialog fieldset".split())
SURROUNDING_WORDS = frozenset(
    "ad ads advert advertisement advertorial adbox banner breadcrumb breadcrumbs comment comments cookie cookies consent "
    "disqus footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice pager pagination "
    "popup promo promoted reader recommended related reply replies share sharing sidebar signup skip social sponsor "
    "sponsored subscribe tags teaser toc toolbar widget hidden".split()
)
ARTICLE_TAGS = frozenset(("article", "main"))
ARTICLE_WORDS = frozenset("article body content entry main post story text".split())
_ABOUT = frozenset(f"<{t}" for t in SURROUNDING_TAGS) | SURROUNDING_WORDS
_ARTICLE = frozenset(f"<{t}" for t in ARTICLE_TAGS)
TELLING = re.compile(
    r"©|copyright|all rights reserved|cookie|subscribe|newsletter|sign in|sign up|log in|privacy|terms of|advert|"
    r"sponsored|share|comment|repl(?:y|ies)|related|read more|follow us|contact",
    re.I,
)
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)"""
    r"""|<[!?/][^>]*+(?:>|\Z)|[^<]++|<""",
    re.S,
)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""\bhidden\b|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_PARTS = re.compile(r"[^a-z0-9]+")


@dataclass
class Block:
    text: str
    tag: str
    around: frozenset[str]
    linked: float


def marks(tag: str, attributes: str) -> tuple[str, ...]:
    """What an element tells about the text inside: its tag, and the words of its class, id and role."""
    out = [f"<{tag}"]
    if attributes:
        for found in _NAMES.finditer(attributes):
            value = (found[2] or found[3] or found[4] or "").lower()
            out += [w for w in _PARTS.split(value) if w and not w.isdigit()]
        if _HIDDEN.search(attributes):
            out.append("hidden")
    return tuple(dict.fromkeys(out))


class _Reader:
    def __init__(self):
        self.known: dict[tuple[str, str], tuple[str, ...]] = {}

    def blocks(self, source: str) -> list[Block]:
        out: list[Block] = []
        stack: list[tuple[str, tuple[str, ...]]] = []
        open_, around = Counter(), {}
        parts: list[str] = []
        linked, silent = 0, 0
        tag, context = "", frozenset()

        def flush() -> None:
            nonlocal linked
            if parts:
                text = "".join(parts)
                text = " ".join((entities.unescape(text) if "&" in text else text).split())
                if text:
                    out.append(Block(text, tag, context, min(1.0, linked / len(text))))
                parts.clear()
            linked = 0

        def pop() -> str:
            nonlocal silent
            name, own = stack.pop()
            open_[name] -= 1
            silent -= name in SILENT_TAGS
            for mark in own:
                around[mark] -= 1
                if not around[mark]:
                    del around[mark]
            return name

        tags: dict[str, tuple[list[int], list[bool]]] = {}

        def closes_ahead(name: str, at: int) -> bool:
            """Whether the next tag of the name closes it."""
            if name not in tags:
                every = list(re.finditer(f"<(/?){name}(?=[\\s/>])", source, re.I))
                tags[name] = [m.start() for m in every], [bool(m[1]) for m in every]
            place = bisect_left(tags[name][0], at)
            return place < len(tags[name][0]) and tags[name][1][place]

        at = 0
        while at < len(source):
            found = _TOKEN.match(source, at)
            at = found.end()
            name = found[2] or found[5]
            if name is None:
                if found[0][0] == "<" and len(found[0]) > 1:
                    continue
                if stack and stack[-1][0] == "head" and not found[0].isspace():
                    pop()
                if not silent:
                    piece = found[0]
                    if not parts:
                        if piece.isspace():
                            continue
                        context = frozenset(around)
                        tag = next((n for n, _ in reversed(stack) if n in BLOCK_TAGS), "")
                    parts.append(piece)
                    if open_["a"]:
                        linked += len(piece)
                continue
            name, closing = name.lower(), found[1] or found[4]
            if closing:
                if name in BLOCK_TAGS:
                    flush()
                if open_[name]:
                    while pop() != name:
                        pass
                elif name == "p":
                    flush()
                continue
            if open_["head"] and name not in HEAD_TAGS:
                while pop() != "head":
                    pass
            if name in RAW_TAGS:
                end = re.compile(f"</{re.escape(name)}[^>]*(?:>|\\Z)", re.I).search(source, at)
                at = end.end() if end else len(source)
                continue
            if name == "br" or name == "wbr":
                if parts:
                    parts.append("\n" if name == "br" else "")
                continue
            if name in BLOCK_TAGS:
                flush()
                for other in FOREIGN_TAGS:
                    while open_[other]:
                        pop()
                for other in ("button", "select", "option"):
                    inside = other == "option" and (open_["select"] or open_["datalist"])
                    if open_[other] and not inside and not closes_ahead(other, at):
                        while pop() != other:
                            pass
                if open_["p"]:
                    while pop() != "p":
                        pass
                for other in CLOSES.get(name, ()):
                    if stack and any(n == other for n, _ in stack[-3:]):
                        while pop() != other:
                            pass
            if name in VOID_TAGS or (found[3] or found[6] or "").endswith("/"):
                continue
            key = (name, found[3] or found[6] or "")
            own = self.known.get(key)
            if own is None:
                if len(self.known) > 50_000:
                    self.known.clear()
                own = self.known[key] = marks(*key)
            stack.append((name, own))
            open_[name] += 1
            silent += name in SILENT_TAGS
            for mark in own:
                around[mark] = around.get(mark, 0) + 1
        flush()
        return out


def _number(feature: str) -> int:
    return zlib.crc32(feature.encode()) & ((1 << BITS) - 1)


def features(blocks: list[Block], without: frozenset[str] = frozenset()) -> list[list[int]]:
    """Feature numbers of each block. ``without``: ancestor features that are not shown."""
    out, n = [], len(blocks)
    for i, block in enumerate(blocks):
        text = block.text
        size = len(text).bit_length()
        link = 0 if block.linked == 0 else 1 if block.linked < 0.4 else 2 if block.linked < 0.8 else 3
        numbers = [
            *_element_features(block.tag, block.around, without),
            *_shape_features(size, link, text[-1] in ".!?…\"”’)", 10 * i // n if n > 2 else -1),
        ]
        if size < 9:
            numbers += [_number(f"says {w.lower()}") for w in set(TELLING.findall(text))]
        out.append(numbers)
    return out


@lru_cache(maxsize=100_000)
def _element_features(tag: str, around: frozenset[str], without: frozenset[str]) -> tuple[int, ...]:
    off, on = bool(_ABOUT & around), bool((_ARTICLE | ARTICLE_WORDS) & (around - without))
    names = ["bias", f"tag {tag}", f"off {off}", f"off {off} on {on}", f"off {off} on {on} tag {tag}"]
    return tuple(_number(f) for f in names + [f"in {a}" for a in sorted(around - without)])


@lru_cache(maxsize=10_000)
def _shape_features(size: int, link: int, stop: bool, place: int) -> tuple[int, ...]:
    names = (f"size {size}", f"link {link}", f"size {size} link {link}", f"stop {stop}", f"place {place}")
    return tuple(_number(f) for f in names)


def labels_by_elements(blocks: list[Block]) -> list[int] | None:
    """1 for blocks in an article or main element and in nothing that surrounds one; None without any."""
    if not any(_ARTICLE & b.around for b in blocks):
        return None
    return [int(bool(_ARTICLE & b.around) and not _ABOUT & b.around) for b in blocks]


_WORDS = "the of light and water over stone a small river ran in winter people wrote to north with old paper house".split()


def made_up_pages(count: int, seed: int = 11) -> list[tuple[list[Block], list[int]]]:
    """Labelled pages: an article in one of its usual containers, and surroundings in theirs."""
    rng = np.random.default_rng(seed)

    def prose(low: int, high: int) -> str:
        words = [_WORDS[k] for k in rng.integers(0, len(_WORDS), rng.integers(low, high))]
        return " ".join(words).capitalize() + "."

    def pick(options):
        return options[rng.integers(0, len(options))]

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{k}">{pick(_WORDS)} {pick(_WORDS)}</a></li>' for k in range(n)) + "</ul>"

    article = ("article", "main", 'div class="content"', 'div id="main-content"', 'div class="post entry"', 'section class="article-body"', 'div class="story text"', "div", 'div role="main"', "body")
    menus = ("nav", 'div class="menu"', "header", 'div id="header"', 'div class="navbar top"', 'div role="navigation"', 'ul class="breadcrumbs"')
    sides = ("aside", 'div class="sidebar"', 'div id="sidebar"', 'div class="related"', 'div class="widget"', 'section class="recommended"', 'div role="complementary"')
    notices = ('div class="ad"', 'div class="advert"', 'div class="banner"', 'div id="cookie-notice"', 'div class="cookie-consent"', 'div class="newsletter signup"', 'div class="promo"', 'div class="sponsored"', "form", 'div class="notice"', 'div class="share social"', 'div class="popup modal"', 'div role="banner"')
    ends = ("footer", 'div class="footer"', 'div id="footer"', 'div class="copyright"', 'div role="contentinfo"')
    talks = ('section class="comments"', 'div id="comments"', 'div class="comment"', 'div class="reader-comments"', 'ol class="replies"', 'div id="disqus"')
    words = sorted(SURROUNDING_WORDS)
    says = ("© All rights reserved", "We use cookies", "Subscribe to our newsletter", "Sign in", "Share this", "Contact us")

    def around(options) -> str:
        return f'{pick(("div", "div", "section", "ul"))} {pick(("class", "id"))}="{pick(words)}"' if rng.random() < 0.4 else pick(options)

    def element(opening: str, inside: str) -> str:
        return f"<{opening}>{inside}</{opening.split()[0]}>"

    pages = []
    for _ in range(count):
        if rng.random() < 0.05:
            blocks = _Reader().blocks(pick(("<p>", "<div>", "<body>")) + prose(2, 60))
            pages.append((blocks, [1] * len(blocks)))
            continue
        parts: list[tuple[str, int]] = [(element(around(menus), f"<h1>{prose(1, 4)[:-1]}</h1>" * int(rng.random() < 0.3) + links(rng.integers(2, 8))), 0)]
        if rng.random() < 0.6:
            parts.append((element(around(notices), f"<p>{pick(says)} {prose(3, 60)}</p>"), 0))
        if rng.random() < 0.4:
            parts.append((element(around(sides), f"<h3>{prose(2, 4)}</h3>{links(3)}<p>{prose(5, 70)}</p>"), 0))
        holder = pick(article)
        heading = f"<h1>{prose(3, 9)[:-1]}</h1>" * int(rng.random() < 0.8)
        if rng.random() < 0.15:
            heading = element("header", heading)
        body = [heading] + [pick((f"<p>{prose(1, 90)}</p>", f"<p>{prose(20, 90)}</p>", f"<h2>{prose(2, 6)[:-1]}</h2>", f"<ul><li>{prose(2, 12)}</li><li>{prose(2, 12)}</li></ul>", f"<blockquote>{prose(8, 40)}</blockquote>")) for _ in range(rng.integers(2, 12))]
        inner = [(x, 1) for x in body]
        if rng.random() < 0.4:
            spot = rng.integers(1, len(inner) + 1)
            inner.insert(spot, (element(around(notices + sides), f"<p>{prose(2, 60)}</p>"), 0))
        if rng.random() < 0.3:
            inner.append((element(around(talks), f"<p>{prose(3, 80)}</p><p>{prose(3, 80)}</p>"), 0))
        tail: list[tuple[str, int]] = []
        if rng.random() < 0.5:
            tail.append((element(around(talks), f"<h3>Comments</h3><p>{prose(3, 80)}</p><p>{prose(3, 80)}</p>"), 0))
        if rng.random() < 0.4:
            tail.append((element(around(sides), f"<p>{prose(5, 70)}</p>{links(3)}"), 0))
        tail.append((element(around(ends), f"{pick(says)} {prose(1, 12)}"), 0))
        reader, blocks, labels = _Reader(), [], []
        for group, wrap in ((parts, "body"), (inner, holder), (tail, "body")):
            for source, label in group:
                got = reader.blocks(f"<html><body><{wrap}>{source}")
                blocks += got
                labels += [label] * len(got)
        pages.append((blocks, labels))
    return pages


@dataclass(frozen=True)
class Crf:
    """Weight of each feature for the label 1 against 0, and of each pair of neighbouring labels."""

    weight: np.ndarray
    step: np.ndarray

    def decode(self, rows: list[list[int]]) -> list[int]:
        """The best labels of a page by Viterbi."""
        (s00, s01), (s10, s11) = self.step.tolist()
        flat = np.fromiter((f for row in rows for f in row), np.int64)
        ends = np.cumsum([0] + [len(row) for row in rows])[:-1]
        best0, best1, back = 0.0, 0.0, []
        for i, score in enumerate(np.add.reduceat(self.weight[flat], ends).tolist()):
            if i:
                from0, from1 = best1 + s10 > best0 + s00, best1 + s11 > best0 + s01
                best0, best1 = max(best0 + s00, best1 + s10), max(best0 + s01, best1 + s11)
                back.append((from0, from1))
            best1 += score
        labels = [int(best1 > best0)]
        for choice in reversed(back):
            labels.append(int(choice[labels[-1]]))
        return labels[::-1]


def fit(pages: list[tuple[list[list[int]], list[int]]], rounds: int = 200, penalty: float = 1e-5) -> Crf:
    """Maximum likelihood by forward and backward sums over all sequences at once, with Adam."""
    pages = sorted((p for p in pages if p[1]), key=lambda p: -len(p[1]))
    lengths = np.array([len(y) for _, y in pages])
    longest = int(lengths[0])
    place = np.full((len(pages), longest), -1)
    place[np.arange(longest)[None, :] < lengths[:, None]] = np.arange(lengths.sum())
    y = np.concatenate([y for _, y in pages])
    sizes = np.array([len(row) for rows, _ in pages for row in rows])
    flat = np.fromiter((f for rows, _ in pages for row in rows for f in row), np.int64)
    of, ends = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes
    inner = (place[:, :-1] >= 0) & (place[:, 1:] >= 0)
    before, after = place[:, :-1][inner], place[:, 1:][inner]
    seen = np.bincount(2 * y[before] + y[after], minlength=4).reshape(2, 2)
    theta, first, second = np.zeros((1 << BITS) + 4), 0.0, 0.0
    for turn in range(1, rounds + 1):
        step = theta[-4:].reshape(2, 2)
        score = np.zeros((len(y), 2))
        score[:, 1] = np.add.reduceat(theta[flat], ends)
        ahead, behind = np.zeros((len(y), 2)), np.zeros((len(y), 2))
        ahead[place[:, 0]] = score[place[:, 0]]
        for t in range(1, longest):
            n = int((lengths > t).sum())
            a, b = place[:n, t - 1], place[:n, t]
            ahead[b] = score[b] + np.logaddexp.reduce(ahead[a][:, :, None] + step, axis=1)
        for t in range(longest - 1, 0, -1):
            n = int((lengths > t).sum())
            a, b = place[:n, t - 1], place[:n, t]
            behind[a] = np.logaddexp.reduce(step + (score[b] + behind[b])[:, None, :], axis=2)
        total = np.logaddexp.reduce(ahead + behind, axis=1)
        chance = np.exp(ahead[:, 1] + behind[:, 1] - total)
        pair = np.exp(ahead[before][:, :, None] + step + (score[after] + behind[after])[:, None, :] - total[before][:, None, None])
        gradient = np.concatenate([np.bincount(flat, (y - chance)[of], 1 << BITS), (seen - pair.sum(axis=0)).reshape(-1)])
        gradient = gradient / len(y) - penalty * theta
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        theta = theta + 0.1 * (first / (1 - 0.9**turn)) / (np.sqrt(second / (1 - 0.99**turn)) + 1e-8)
    return Crf(theta[:-4], theta[-4:].reshape(2, 2))


def _sequences(blocks: list[Block], labels: list[int], bare: bool) -> list[tuple[list[list[int]], list[int]]]:
    out = []
    for hidden in (frozenset(), _ARTICLE) if bare else (frozenset(),):
        rows = features(blocks, hidden)
        out += [(rows[a : a + SEQUENCE], labels[a : a + SEQUENCE]) for a in range(0, len(rows), SEQUENCE)]
    return out


def train(pages: DataFrame, key: str = "page_id", source: str = "html", sample: int = SAMPLE) -> Crf:
    """A model of the made-up pages and of a bounded sample of these, in the order of a hash of their ids."""

    @F.arrow_udf("array<struct<features:array<int>,label:int>>")
    def learned(column: pa.Array) -> pa.Array:
        reader, out = _Reader(), []
        for value in column:
            blocks = reader.blocks(value.as_py() or "")
            labels = labels_by_elements(blocks)
            parts = _sequences(blocks, labels, True) if labels else []
            out.append([{"features": f, "label": y} for rows, ys in parts for f, y in zip(rows, ys, strict=True)])
        return pa.array(out, pa.list_(pa.struct([("features", pa.list_(pa.int32())), ("label", pa.int32())])))

    ids = pages.select(key).filter(F.col(key).isNotNull()).orderBy(F.xxhash64(key), key).limit(sample).distinct()
    rows = pages.join(F.broadcast(ids), key, "left_semi").select(key, learned(F.col(source).cast("string")).alias("blocks"))
    found = []
    for row in rows.toArrow().sort_by([(key, "ascending")])["blocks"].to_pylist():
        if row:
            for a in range(0, len(row), SEQUENCE):
                part = row[a : a + SEQUENCE]
                found.append(([b["features"] for b in part], [b["label"] for b in part]))
    for blocks, labels in made_up_pages(MADE_UP):
        found += _sequences(blocks, labels, True)
    return fit(found)


def extract(pages: DataFrame, model: Crf, source: str = "html", to: str = "text") -> DataFrame:
    """Adds the main text of each page; a column of the name ``to`` is replaced."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("string")
    def texts(column: pa.Array) -> pa.Array:
        reader, own, out = _Reader(), shared.value, []
        for value in column:
            blocks = reader.blocks(value.as_py() or "")
            chosen = own.decode(features(blocks)) if blocks else []
            out.append("\n\n".join(b.text for b, label in zip(blocks, chosen, strict=True) if label))
        return pa.array(out, pa.string())

    return pages.withColumn(to, texts(F.col(source).cast("string")))
