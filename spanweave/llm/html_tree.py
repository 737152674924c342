"""Main text of web pages by a tree-structured graphical model.

A page's block elements and the texts between block boundaries are the nodes of a tree; each is content or boilerplate.
A node's potential is log-linear in its tag, the words of its class and id, its length and its share of link text; a
parent and child have a potential for their pair of labels. Sum-product messages go up from the leaves and down from the
root, for a whole batch of pages at once, one tree level at a time; what they give are the exact marginals. The same
messages give the likelihood's gradient when the potentials are trained from labelled pages.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.llm import _support as S

TRAINING_PAGES, SEED, STEPS, RATE, RIDGE = 260, 11, 260, 0.6, 5e-5

_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img picture source br".split()
)
#: Formulas stand within their paragraph.
_MATH = frozenset("math semantics mrow mi mo mn ms mtext mspace msup msub msubsup mfrac msqrt mroot mover munder munderover mtable mtr mtd mstyle mfenced menclose mpadded mphantom".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page. An unclosed one takes the rest of the page only if HTML reads it as raw text.
_RAW = frozenset("script style noscript template svg iframe object canvas textarea select video audio title".split())
_SWALLOWS = frozenset("script style iframe textarea title".split())
_CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)), "body": (("head",), ("html",)),
}
_TAG = re.compile(r"<(?:!--|([/!?]?)([a-zA-Z\[][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>)")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|aria-label|hidden|style|data-y)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_WHITE = re.compile(r"\s+")

_GROUPS = {
    tag: i
    for i, tags in enumerate(
        ("#text", "html body", "article main", "section", "div center", "p", "h1", "h2 h3 h4 h5 h6", "ul ol dl menu", "li dt dd", "nav", "header hgroup", "footer address", "aside dialog",
         "form fieldset button input legend", "table thead tbody tfoot tr td th caption", "blockquote pre figure figcaption details summary", "#other")
    )
    for tag in tags.split()
}
_OTHER = _GROUPS["#other"]
#: Beginnings of class and id words, by kind; short ones must be the whole word.
_KINDS = (
    "article content post entry story main text body prose", "nav menu breadcrumb toolbar pagination pager tabs", "header masthead logo topbar", "footer copyright legal colophon",
    "sidebar aside rail widget secondary", "ad ads advert sponsor promo banner adsense", "cookie consent notice alert popup modal newsletter subscribe gdpr overlay paywall notification",
    "search login signup form register contact", "comment comments reply replies disqus discussion respond reader", "share social related recommend tags byline meta popular trending",
)
_KIND_OF = [(i, w) for i, words in enumerate(_KINDS) for w in words.split()]
_LENGTHS, _LINKS = (0, 15, 60, 200, 800), (0.001, 0.3, 0.7)
_N_GROUP, _N_KIND = len(set(_GROUPS.values())), len(_KINDS) + 1
_AT_KIND = _N_GROUP
_AT_LENGTH = _AT_KIND + _N_KIND
_AT_LINK = _AT_LENGTH + 2 * (len(_LENGTHS) + 1)
N_FEATURES = _AT_LINK + 2 * (len(_LINKS) + 1)


@lru_cache(maxsize=50_000)
def _kind_of_word(word: str) -> int:
    return max((i + 1 for i, k in _KIND_OF if word == k or len(k) > 3 and word.startswith(k)), default=0)


def _kind(names: str) -> int:
    """The kind that the words of a class or id tell, the last of _KINDS first: content-sidebar is a sidebar."""
    return max((_kind_of_word(w.lower()) for w in _WORDS.findall(names)), default=0)


class Page:
    """Nodes in page order, a parent before its children: parent (-1 for the root), depth, group, kind, chars, link chars,
    text, y. y comes from the attribute data-y of training pages (labelled) and is -1 in all others."""

    def __init__(self, html: str, labelled: bool = False):
        self.parent, self.depth, self.group, self.kind, self.chars, self.linked, self.text, self.y = [-1], [0], [_GROUPS["html"]], [0], [0], [0], [""], [-1]
        self._parse(html, labelled)

    def _node(self, parent: int, group: int, kind: int, text: str, linked: int, y: int) -> int:
        values = (parent, self.depth[parent] + 1, group, kind, len(text), linked, text, y)
        for column, value in zip((self.parent, self.depth, self.group, self.kind, self.chars, self.linked, self.text, self.y), values):
            column.append(value)
        return len(self.parent) - 1

    def _parse(self, html: str, labelled: bool) -> None:
        stack: list[tuple[str, int]] = [("#root", 0)]
        opened: defaultdict[str, list[int]] = defaultdict(list)  # where each open element stands in the stack
        endless: set[str] = set()  # elements that nothing closes from here on
        pieces: list[str] = []
        links = linked = 0
        pos, n, last = 0, len(html), html.rfind(">")

        def close(to: int) -> None:
            while len(stack) > to:
                opened[stack.pop()[0]].pop()

        def flush() -> None:
            nonlocal linked
            if pieces:
                raw = "".join(pieces)
                text = _WHITE.sub(" ", entities.unescape(raw) if "&" in raw else raw).strip()
                if text:
                    top = stack[-1][1]
                    self._node(top, 0, 0, text, min(linked, len(text)), self.y[top])
                pieces.clear()
            linked = 0

        def add(text: str) -> None:
            nonlocal linked
            pieces.append(text)
            if links:
                linked += len(text)

        while pos < n:
            at = html.find("<", pos)
            if at < 0:
                add(html[pos:])
                break
            if at > pos:
                add(html[pos:at])
            m = _TAG.match(html, at) if at < last else None
            if not m:
                add("<")
                pos = at + 1
                continue
            pos = m.end()
            name = m[2]
            if name is None:  # a comment
                end = html.find("-->", at + 4)
                pos = end + 3 if end >= 0 else n
                continue
            name = name.lower()
            if m[1] in ("!", "?"):
                continue
            if m[1]:
                if name in _INLINE or name in _MATH:
                    links = 0 if name == "a" else links
                    if name == "br":
                        add(" ")
                elif opened[name]:
                    flush()
                    links = 0
                    close(opened[name][-1])
                continue
            unclosed = False
            if name in _RAW or name == "head":
                if not m[3].endswith("/"):
                    end = None if name in endless else re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, pos)
                    if not end:
                        endless.add(name)
                    if end:
                        pos = end.end()
                    elif name in _SWALLOWS:
                        pos = n
                    elif name != "head":
                        unclosed = True
                if not unclosed:
                    continue
            if name in _INLINE or name in _MATH:
                if name == "a":
                    links = 1
                elif name == "br":
                    add(" ")
                continue
            flush()
            links = 0
            if stack[-1][0] == "p":
                close(len(stack) - 1)
            if name in _CLOSES:
                ends, within = ([opened[x][-1] for x in names if opened[x]] for names in _CLOSES[name])
                outer = max(within, default=0)
                inner = [i for i in ends if i > outer]
                if inner:
                    close(max(inner))
            if name == "html" or name in _VOID:
                continue
            top, kind, y = stack[-1][1], 0, self.y[stack[-1][1]]
            if "=" in m[3]:
                words = []
                for k, *values in _ATTRIBUTE.findall(m[3]):
                    value = values[0] or values[1] or values[2]
                    if k.lower() == "data-y":
                        y = int(value) if labelled else y
                    elif k.lower() != "style":
                        words.append(value)
                kind = _kind(" ".join(words)) if words else 0
            opened[name].append(len(stack))
            stack.append((name, self._node(top, _GROUPS.get(name, _OTHER), kind, "", 0, y)))
        flush()


@dataclass(frozen=True)
class Forest:
    """The nodes of some pages: parents (-1: root), their levels, and the features that each node has."""

    parent: np.ndarray
    levels: list[np.ndarray]
    features: np.ndarray
    leaf: np.ndarray

    @staticmethod
    def of(pages: list[Page]) -> Forest:
        base = np.cumsum([0, *(len(p.parent) for p in pages)])[:-1] if pages else []
        join = lambda k: np.array([v for p in pages for v in getattr(p, k)], np.int64)
        shift = np.repeat(np.array(base, np.int64), [len(p.parent) for p in pages])
        parent = join("parent")
        parent = np.where(parent < 0, -1, parent + shift)
        depth = join("depth")
        levels = np.split(np.argsort(depth, kind="stable"), np.cumsum(np.bincount(depth))[:-1]) if len(depth) else []
        chars, linked, group = join("chars"), join("linked"), join("group")
        for level in levels[:0:-1]:
            np.add.at(chars, parent[level], chars[level])
            np.add.at(linked, parent[level], linked[level])
        leaf = group == 0
        share = linked / np.maximum(chars, 1)
        columns = (group, _AT_KIND + join("kind"), _AT_LENGTH + np.searchsorted(_LENGTHS, chars, side="left") + leaf * (len(_LENGTHS) + 1), _AT_LINK + np.searchsorted(_LINKS, share) + leaf * (len(_LINKS) + 1))
        return Forest(parent, levels, np.stack(columns, 1) if len(parent) else np.zeros((0, 4), np.int64), leaf)


@dataclass(frozen=True)
class Potentials:
    """unary: log potential of label 1 against 0 per feature. pair: [child is text, parent's label, child's label]."""

    unary: np.ndarray
    pair: np.ndarray


def _sum_product(forest: Forest, p: Potentials) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of label 1 for each node, and of (parent's, child's label) for each node with a parent (0 for roots)."""
    n = len(forest.parent)
    belief = np.zeros((n, 2))
    belief[:, 1] = p.unary[forest.features].sum(1)
    pair = p.pair[forest.leaf.astype(int)]  # n, parent, child
    up = np.zeros((n, 2))
    for level in forest.levels[:0:-1]:
        up[level] = np.logaddexp.reduce(pair[level] + belief[level][:, None, :], axis=2)
        up[level] -= up[level].max(1, keepdims=True)
        for k in (0, 1):
            belief[:, k] += np.bincount(forest.parent[level], up[level, k], n)
    own = belief.copy()  # what a node gets from itself and below
    edge = np.zeros((n, 2, 2))
    for level in forest.levels[1:]:
        above = belief[forest.parent[level]] - up[level]  # the parent without this child
        joint = above[:, :, None] + pair[level] + own[level][:, None, :]
        joint -= joint.max((1, 2), keepdims=True)
        edge[level] = np.exp(joint) / np.exp(joint).sum((1, 2), keepdims=True)
        down = np.logaddexp.reduce(above[:, :, None] + pair[level], axis=1)
        belief[level] = own[level] + down - down.max(1, keepdims=True)
    return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -50, 50))), edge


def marginals(forest: Forest, p: Potentials) -> np.ndarray:
    return _sum_product(forest, p)[0]


def train(pages: list[str], steps: int = STEPS) -> Potentials:
    """Maximum likelihood from pages whose elements carry data-y="0" or "1"; it holds for what stands below until overruled."""
    parsed = [Page(h, labelled=True) for h in pages]
    forest = Forest.of(parsed)
    y = np.maximum(np.array([v for p in parsed for v in p.y]), 0)
    # A container of content is content itself.
    for level in forest.levels[:0:-1]:
        np.maximum.at(y, forest.parent[level], y[level])
    child = np.flatnonzero(forest.parent >= 0)
    kind = forest.leaf.astype(int)
    seen = np.zeros((2, 2, 2))
    np.add.at(seen, (kind[child], y[forest.parent[child]], y[child]), 1)
    unary, pair = np.zeros(N_FEATURES), np.zeros((2, 2, 2))
    squares = [np.full(N_FEATURES, 1e-8), np.full((2, 2, 2), 1e-8)]
    has = lambda weight: np.bincount(forest.features.ravel(), np.repeat(weight, forest.features.shape[1]), N_FEATURES)
    told = has(y)
    for _ in range(steps):
        one, edge = _sum_product(forest, Potentials(unary, pair))
        both = np.stack([edge[child[kind[child] == k]].sum(0) for k in (0, 1)])
        grads = ((told - has(one)) / len(y) - RIDGE * unary, (seen - both) / len(y) - RIDGE * pair)
        for value, grad, square in zip((unary, pair), grads, squares):
            square += grad * grad
            value += RATE * grad / np.sqrt(square)
    return Potentials(unary, pair)


def labelled_pages(n: int = TRAINING_PAGES, seed: int = SEED) -> list[str]:
    """Pages of many layouts with known content, for training: articles among menus, notices, adverts, forms and comments."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    link = lambda a, b: f'<a href="/{word()}">{words(a, b)}</a>'
    pick = lambda *x: r.choice(x)

    def items(text) -> str:
        return "<ul>" + "".join(f"<li>{text()}</li>" for _ in range(r.randint(2, 8))) + "</ul>"

    def junk(kind: str) -> str:
        y = ' data-y="0"'
        attr = lambda *names: f' {pick("class", "id")}="{pick(*names)}{pick("", "-" + word(), " " + word())}"'
        if kind == "nav":
            return pick(f"<nav{y}>{items(lambda: link(1, 2))}</nav>", f"<div{attr('nav', 'menu', 'breadcrumb', 'topmenu nav')}{y}>{items(lambda: link(1, 2))}</div>", f"<ul{attr('menu', 'navigation')}{y}>{''.join(f'<li>{link(1, 2)}</li>' for _ in range(5))}</ul>")
        if kind == "header":
            return pick(f"<header{y}><div>{words(1, 4)}</div>{link(1, 2)}</header>", f"<div{attr('header', 'masthead', 'logo')}{y}><p>{words(2, 40)}</p></div>")
        if kind == "footer":
            return pick(f"<footer{y}>&copy; {words(2, 60)}</footer>", f"<footer{y}><p>{words(2, 40)}</p>{items(lambda: link(1, 2))}</footer>", f"<div{attr('footer', 'copyright', 'legal')}{y}><p>{words(3, 60)}</p></div>")
        if kind == "side":
            return pick(f"<aside{y}><h3>{words(1, 3)}</h3>{items(lambda: link(2, 6))}</aside>", f"<div{attr('sidebar', 'widget', 'rail')}{y}><p>{words(6, 90)}</p></div>", f"<aside{y}><p>{words(8, 120)}</p></aside>")
        if kind == "ad":
            return pick(f"<div{attr('ad', 'ads', 'advert', 'sponsored', 'promo')}{y}>{words(3, 90)}</div>", f"<div{attr('ad', 'banner', 'sponsor')}{y}><p>{words(4, 80)}</p>{link(1, 3)}</div>", f"<section{attr('promo', 'advertisement')}{y}><h2>{words(1, 4)}</h2><p>{words(5, 30)}</p></section>")
        if kind == "notice":
            return pick(f"<div{attr('cookie', 'consent', 'notice', 'alert', 'popup', 'newsletter')}{y}><p>{words(6, 40)}</p><button>{words(1, 2)}</button></div>", f'<div role="alert"{y}>{words(4, 20)}</div>', f"<dialog{y}><p>{words(5, 30)}</p></dialog>")
        if kind == "form":
            return pick(f"<form{y}><label>{words(1, 3)}</label><input><button>{word()}</button></form>", f"<div{attr('search', 'login', 'signup')}{y}><form><p>{words(1, 9)}</p></form></div>")
        if kind == "share":
            return f"<div{attr('share', 'related', 'social', 'recommended')}{y}>{pick(items(lambda: link(1, 8)), '<p>' + link(2, 6) + '</p>')}</div>"
        one = lambda: f"<div{pick('', attr('comment', 'reply'))}><p>{words(4, 120)}</p>{pick('', '<p>' + words(1, 30) + '</p>')}</div>"
        return f"<{(t := pick('section', 'div', 'ul'))}{attr('comments', 'discussion', 'replies', 'responses comment')}{y}><h3>{words(1, 3)}</h3>{''.join(one() for _ in range(r.randint(1, 5)))}</{t}>"

    def content() -> str:
        parts = [pick(f"<h1>{words(2, 9)}</h1>", "")]
        for _ in range(r.randint(1, 12)):
            text = pick(words(1, 2), words(3, 12), words(10, 80), words(20, 150))
            parts.append(
                pick(*[f"<p>{text}</p>"] * 6, f"<p><b>{text}<br><p>{words(4, 40)}</p>", f"<p>{text} {link(1, 3)} {words(3, 20)}</p>", f"<h2>{words(1, 6)}</h2>", f"<blockquote><p>{text}</p></blockquote>",
                     f"<ul>{''.join(f'<li>{words(2, 20)}</li>' for _ in range(3))}</ul>", f"<table><tr><td>{words(1, 3)}</td><td>{words(1, 3)}</td></tr></table>", f"<pre>{text}</pre>", f"<div>{text}</div>")
            )
            if r.random() < 0.12:
                parts.append(junk(pick("ad", "share", "notice", "form")))
        if r.random() < 0.25:
            parts.append(junk(pick("comment", "share", "side", "form")))
        return "".join(parts)

    out = []
    for _ in range(n):
        box = pick('<article data-y="1">{}</article>', '<article data-y="1">{}</article>', '<main data-y="1">{}</main>', '<main><article data-y="1">{}</article></main>', '<div class="content" data-y="1">{}</div>',
                   '<div id="main-text" data-y="1"><div class="post">{}</div></div>', '<div class="wrap"><div class="entry" data-y="1">{}</div></div>', '<section class="story" data-y="1">{}</section>')
        before = [junk(k) for k in ("notice", "header", "nav", "ad", "form", "side") if r.random() < 0.5]
        after = [junk(k) for k in ("comment", "share", "side", "ad", "form", "nav", "notice", "footer") if r.random() < 0.45]
        r.shuffle(before)
        if r.random() < 0.04:
            out.append(f"<html><body>{''.join(before + after)}</body></html>")
        else:
            page = "".join(before) + box.format(content()) + "".join(after)
            out.append(f"<html><head><title>{words(1, 5)}</title></head><body>{pick(page, page, f'<div class=' + chr(34) + 'page' + chr(34) + f'>{page}</div>')}</body></html>")
    return out


@lru_cache(maxsize=1)
def trained() -> Potentials:
    return train(labelled_pages())


def main_texts(pages: list[str | None], potentials: Potentials) -> list[str]:
    """For each page the texts of its content nodes, in page order, joined by an empty line."""
    parsed = [Page(h or "") for h in pages]
    keep = marginals(Forest.of(parsed), potentials) >= 0.5
    out, at = [], 0
    for p in parsed:
        out.append("\n\n".join(t for t, k, g in zip(p.text, keep[at : at + len(p.text)].tolist(), p.group) if k and g == 0))
        at += len(p.text)
    return out


def extract(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html", potentials: Potentials | None = None) -> DataFrame:
    """key, url, text, n_chars (code points) of every page; a null or empty page, or one without content, has empty text.

    White space within a block (an element's text between block boundaries) is one space, <br> included. Repeated rows
    and null keys stay; other columns are left out. One scan without a shuffle.
    """
    model = potentials or trained()
    rows = pages.select(F.col(key).alias("_k"), F.col(url).alias("_u"), F.col(html).alias("_h"))
    kind = rows.schema["_k"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in S.slices(batches, 128):
            texts = main_texts(batch.column(2).to_pylist(), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [key, url, "text", "n_chars"])

    return rows.mapInArrow(scan, f"`{key}` {kind}, `{url}` string, text string, n_chars long")
