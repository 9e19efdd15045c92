"""Operator 6: main text of web pages by a tree-structured graphical model over the DOM.

A page becomes a tree of block elements whose leaves are runs of text; inline elements are only remembered as link
text. Each node is content or boilerplate: a node score from its tag, the words of its class, id and role, and a
leaf's length, link share and punctuation; and a parent-child potential, by the child's kind. Sum-product messages
up and then down the tree give each leaf's marginal; leaves at 0.5 or more are the main text. The weights are fitted
to labelled pages by gradient steps on the conditional log-likelihood, whose expectations come from the same
messages. The labelled pages are generated by a seeded rule over many layouts, since the tables label none.

Scripts, styles, comments, the head and markup never are text; a script or style ends at its end tag alone, however its
own tag is written. Formulas, drawings, embedded objects and what is meant for readers without scripts are text like
any other. Only <a href> makes link text; one that nothing closes ends with its block. Character references are decoded, white space inside a
leaf becomes one space, empty leaves go, leaves are joined by a line feed in page order; nothing is cut. Null or
empty html has empty text. Unclosed or crossed tags are closed as browsers do for paragraphs, list items and table
cells, or else at the nearest open match. Repeated rows give repeated results; an empty table gives an empty one;
further columns are not looked at.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from symdex.llm.shared import keyed, map_texts, table, texts_of

_REST_OF_TAG = re.compile(r"[^>\"']*+(?:(?:\"[^\"]*+\"|'[^']*+')[^>\"']*+)*+>")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")
#: Comments that end where they begin, and what ends others.
_EMPTY_COMMENT, _COMMENT_END = re.compile("<!---?>"), re.compile("--!?>")
_HREF = re.compile(r"\bhref\s*=", re.I)
_LINK, _END_OF_LINK = re.compile(r"<a\s", re.I), re.compile(r"</a[\s/>]", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

INLINE = frozenset("a abbr acronym b bdi bdo big canvas cite code data dfn em font i img ins del kbd mark nobr noscript object q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Drawings and formulas: their text flows with the text around them, whether they are closed or not.
INLINE |= frozenset("svg g path rect circle ellipse line polyline polygon text tspan textpath defs use symbol desc lineargradient radialgradient stop clippath mask pattern filter marker image animate foreignobject".split())
INLINE |= frozenset("math mrow mi mo mn ms mtext mspace msup msub msubsup mfrac msqrt mroot mover munder munderover mtable mtr mtd mstyle mpadded mphantom menclose mfenced mmultiscripts mprescripts none semantics annotation annotation-xml".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup, or never shown: skipped up to their end tag.
RAW = frozenset("script style template title iframe head textarea noframes".split())
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "optgroup": ("option", "optgroup")}
_SCOPE = frozenset("ul ol dl table select".split())

KINDS = ("article", "main", "section", "div", "body", "p", "heading", "list", "item", "nav", "header", "footer", "aside", "form", "table", "cell", "quote", "figure", "leaf", "other")
_KIND = {
    **{k: k for k in ("article", "main", "section", "div", "body", "p", "nav", "header", "footer", "aside", "table", "figure")},
    **dict.fromkeys("h1 h2 h3 h4 h5 h6".split(), "heading"), **dict.fromkeys("ul ol dl menu".split(), "list"), **dict.fromkeys("li dt dd".split(), "item"),
    **dict.fromkeys("form fieldset button label legend dialog select option optgroup".split(), "form"), **dict.fromkeys("tr td th".split(), "cell"), **dict.fromkeys("blockquote pre".split(), "quote"), "html": "body", "figcaption": "figure",
}
#: Words of class, id and role by what they tell.
HINTS = {
    "menu": "nav navigation navbar menu breadcrumb breadcrumbs pager pagination toolbar tabs skip sitemap toc",
    "head": "header head masthead topbar logo brand hero tagline top",
    "foot": "footer foot copyright legal bottom colophon imprint",
    "side": "sidebar side aside rail widget widgets related recommended recommend more popular trending promo share social newsletter subscribe tags teaser complementary",
    "advert": "ad ads adv advert advertisement adverts sponsor sponsored banner promotion dfp outbrain taboola",
    "notice": "cookie cookies consent notice gdpr alert popup modal overlay privacy warning message notification",
    "reader": "comment comments reply replies respond discussion disqus thread feedback reader",
    "form": "form login signin signup search contact register subscribe",
    "content": "article content contents post entry story main body text prose page single",
}
_HINT = {w: i for i, (_, words) in enumerate(HINTS.items()) for w in words.split()}
N_FEATURES = len(KINDS) + len(HINTS) + 10


class Page:
    """Nodes of one page in document order: parent, kind, hints, and for leaves the text and its link share."""

    __slots__ = ("depth", "hints", "kinds", "labels", "leaves", "parents")

    def __init__(self):
        self.parents, self.kinds, self.hints, self.depth, self.labels = [-1], [KINDS.index("body")], [()], [0], [None]
        self.leaves: list[tuple[int, str, float]] = []

    def add(self, parent: int, kind: str, hints: tuple[int, ...], label: int | None = None) -> int:
        self.parents.append(parent)
        self.kinds.append(KINDS.index(kind))
        self.hints.append(hints)
        self.depth.append(self.depth[parent] + 1)
        self.labels.append(self.labels[parent] if label is None else label)
        return len(self.parents) - 1


def _hints(attributes: str) -> tuple[tuple[int, ...], int | None]:
    hints, label = set(), None
    for name, value in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name in ("class", "id", "role", "aria-label"):
            hints |= {_HINT[w.lower()] for w in _WORD.findall(value) if w.lower() in _HINT}
        elif name == "data-main":
            label = int(value.strip("\"'"))
    return tuple(sorted(hints)), label


def parse(html: str, labelled: bool = False) -> Page:
    """The tree of a page. Labels are read from data-main only on request; features never see them."""
    page, stack = Page(), [("html", 0)]
    parts: list[tuple[str, bool]] = []
    in_link, i, n = False, 0, len(html)
    low, link_end, last_close = None, -1, n  # the next end tag of a link; from where on there is none

    def end_of_link(at: int) -> int:
        """Where the link that begins here is closed, or -1 if another begins before that or nothing closes it."""
        nonlocal link_end, last_close
        if at >= last_close:
            return -1
        if link_end < at:
            found = _END_OF_LINK.search(html, at)
            if not found:
                last_close = at
                return -1
            link_end = found.start()
        return -1 if _LINK.search(html, at, link_end) else link_end

    def flush() -> None:
        nonlocal parts
        if parts:
            text = " ".join("".join(t for t, _ in parts).split())
            if text:
                linked = sum(len(t) for t, x in parts if x) / max(1, sum(len(t) for t, _ in parts))
                at = page.add(stack[-1][1], "leaf", ())
                page.leaves.append((at, text, linked))
            parts = []

    closes_at = -1
    endless: set[str] = set()
    while i < n:
        j = html.find("<", i)
        if j < 0:
            parts.append((unescape(html[i:]), in_link))
            break
        if j > i:
            parts.append((unescape(html[i:j]), in_link))
        c = html[j + 1 : j + 2]
        if c == "!" or c == "?":
            if html.startswith("<!--", j):
                own = _EMPTY_COMMENT.match(html, j) or _COMMENT_END.search(html, j + 4)
                i = own.end() if own else n
            else:
                end = html.find(">", j)
                i = n if end < 0 else end + 1
            continue
        closing = c == "/"
        m = _NAME.match(html, j + 1 + closing)
        if not m:
            if closing:
                end = html.find(">", j)
                i = n if end < 0 else end + 1
            else:
                parts.append(("<", in_link))
                i = j + 1
            continue
        tag = m[0].lower()
        rest = _REST_OF_TAG.match(html, m.end())
        end = rest.end() if rest else html.find(">", m.end()) + 1 or n
        attributes = html[m.end() : end]
        i = end
        if tag in RAW:
            if tag == "head" or closing:
                if tag == "head":
                    flush()
                continue
            if low is None:
                low = html.lower()
                if len(low) != n:
                    low = re.sub("[A-Z]", lambda x: x[0].lower(), html)
            end = -1 if tag in endless else low.find(f"</{tag}", i)
            if end >= 0:
                i = html.find(">", end) + 1 or n
                continue
            endless.add(tag)  # nor is there an end tag after any later place
            if not attributes.endswith("/>"):
                i = n
            continue
        if tag == "br":
            parts.append((" ", in_link))
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = not closing and _HREF.search(attributes) is not None
                closes_at = end_of_link(i) if in_link else -1
            continue
        flush()
        in_link = in_link and i <= closes_at
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        if tag in VOID:
            continue
        if stack[-1][0] in ("select", "option", "optgroup") and tag not in ("option", "optgroup"):
            while stack[-1][0] in ("select", "option", "optgroup"):  # nothing but options can be in it
                stack.pop()
        if tag in _CLOSES_P and any(x == "p" for x, _ in stack[-2:]):
            while stack[-1][0] != "p":
                stack.pop()
            stack.pop()
        if tag in _SAME:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in _SAME[tag]:
                    del stack[k:]
                    if tag != "tr":
                        break
                elif stack[k][0] in _SCOPE:
                    break
        hints, label = _hints(attributes) if len(attributes) > 1 else ((), None)
        if tag in ("html", "body"):
            continue
        stack.append((tag, page.add(stack[-1][1], _KIND.get(tag, "other"), hints, label if labelled else None)))
    flush()
    return page


@dataclass
class Forest:
    """Nodes of many pages; parents come before their children."""

    x: np.ndarray
    parent: np.ndarray
    depth: np.ndarray
    kind: np.ndarray  # 1 for leaves

    @classmethod
    def of(cls, pages: list[Page]) -> Forest:
        shift = np.cumsum([0] + [len(p.parents) for p in pages])
        n = int(shift[-1])
        x = np.zeros((n, N_FEATURES), np.float32)
        kinds = np.concatenate([p.kinds for p in pages]) if pages else np.empty(0, int)
        x[np.arange(n), kinds] = 1
        base = len(KINDS)
        parents = []
        for p, s in zip(pages, shift, strict=False):
            parents += [q + s if q >= 0 else -1 for q in p.parents]
            for i, hints in enumerate(p.hints):
                for h in hints:
                    x[s + i, base + h] = 1
        base += len(HINTS)
        for p, s in zip(pages, shift, strict=False):
            for i, text, linked in p.leaves:
                k = len(text)
                row = x[s + i]
                row[base + (0 if k < 20 else 1 if k < 80 else 2 if k < 300 else 3)] = 1
                row[base + 4] = linked
                row[base + 5] = linked > 0.8
                row[base + 6] = text[-1] in ".!?\"'»”:;,"
                row[base + 7] = "©" in text
                row[base + 8] = "·" in text
        x[:, base + 9] = 1
        return cls(x, np.array(parents, np.int64), np.concatenate([p.depth for p in pages]) if pages else np.empty(0, int), (kinds == KINDS.index("leaf")).astype(np.int64))

    def marginals(self, weights: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(P(content) of each node, P(parent state, child state) of each node's edge upward)."""
        n = len(self.parent)
        score = np.stack([np.zeros(n), np.clip(self.x @ weights, -30, 30)], 1)
        up, message = score.copy(), np.zeros((n, 2))
        levels = [np.flatnonzero(self.depth == d) for d in range(int(self.depth.max(initial=0)) + 1)]
        for rows in levels[:0:-1]:
            message[rows] = np.logaddexp.reduce(edges[self.kind[rows]] + up[rows][:, None, :], axis=2)
            np.add.at(up, self.parent[rows], message[rows])
        belief = up.copy()
        pair = np.zeros((n, 2, 2))
        for rows in levels[1:]:
            above = belief[self.parent[rows]] - message[rows]
            joint = above[:, :, None] + edges[self.kind[rows]] + up[rows][:, None, :]
            belief[rows] = np.logaddexp.reduce(joint, axis=1)
            joint -= np.logaddexp.reduce(joint.reshape(len(rows), 4), axis=1)[:, None, None]
            pair[rows] = np.exp(joint)
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -50, 50))), pair


@dataclass
class Model:
    weights: np.ndarray
    edges: np.ndarray  # [leaf or element, parent state, child state]

    def texts(self, htmls: list[str]) -> list[str]:
        pages = [parse(h) for h in htmls]
        p, _ = Forest.of(pages).marginals(self.weights, self.edges)
        out, at = [], 0
        for page in pages:
            out.append("\n".join(text for i, text, _ in page.leaves if p[at + i] >= 0.5))
            at += len(page.parents)
        return out


def fit(htmls: list[str], rounds: int = 200, l2: float = 2e-4) -> Model:
    """Learn from pages whose elements say in data-main whether their text is content; an element counts as content
    if most of its text is."""
    pages = [parse(h, labelled=True) for h in htmls]
    f = Forest.of(pages)
    y, at = np.zeros(len(f.parent)), 0
    for page in pages:
        size, main = np.zeros(len(page.parents)), np.zeros(len(page.parents))
        for i, text, _ in page.leaves:
            size[i], main[i] = len(text), len(text) * (page.labels[i] or 0)
        for i in range(len(page.parents) - 1, 0, -1):
            size[page.parents[i]] += size[i]
            main[page.parents[i]] += main[i]
        y[at : at + len(size)] = 2 * main > size
        at += len(size)
    inner = np.flatnonzero(f.parent >= 0)
    observed = np.zeros((2, 2, 2))
    np.add.at(observed, (f.kind[inner], y[f.parent[inner]].astype(int), y[inner].astype(int)), 1)
    weights, edges = np.zeros(N_FEATURES), np.zeros((2, 2, 2))
    m1, m2 = np.zeros(N_FEATURES + 8), np.zeros(N_FEATURES + 8)
    for t in range(1, rounds + 1):  # Adam
        p, pair = f.marginals(weights, edges)
        expected = np.stack([pair[inner[f.kind[inner] == k]].sum(0) for k in (0, 1)])
        g = np.concatenate([f.x.T @ (y - p), (observed - expected).reshape(-1)]) / len(y)
        g -= l2 * np.concatenate([weights, edges.reshape(-1)])
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        step = 0.1 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-9)
        weights, edges = weights + step[:-8], edges + step[-8:].reshape(2, 2, 2)
    return Model(weights, edges)


def labelled_pages(n: int = 320, seed: int = 11) -> list[str]:
    """Pages over many layouts, with data-main on what is content (1) or boilerplate (0)."""
    r = random.Random(seed)
    syllables = "an er on th re in ti es or te of ed is it al ar st nd to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur".split()

    def word() -> str:
        return "".join(r.choices(syllables, k=r.randint(1, 4)))

    def words(a: int, b: int) -> str:
        return " ".join(word() for _ in range(r.randint(a, b)))

    def sentence(a: int = 2, b: int = 18) -> str:
        return words(a, b).capitalize() + r.choice("...!?")

    def prose(a: int = 1, b: int = 8) -> str:
        return " ".join(sentence(1 if r.random() < 0.2 else 3) for _ in range(r.randint(a, b)))

    def links(a: int, b: int, close: bool = True) -> str:
        return "".join(f'<li><a href="/{word()}">{words(1, 3)}</a>' + ("</li>" if close else "") for _ in range(r.randint(a, b)))

    def pick(*names: str) -> str:
        return r.choice(names) + r.choice(("", "", f"-{word()}", f" {word()}", " box"))

    def menu() -> str:
        body = f"<ul>{links(2, 9, r.random() < 0.8)}</ul>" if r.random() < 0.7 else " | ".join(f'<a href="#">{words(1, 2)}</a>' for _ in range(r.randint(3, 8)))
        return r.choice((f"<nav data-main=0>{body}</nav>", f'<div class="{pick("menu", "navbar", "nav", "breadcrumbs")}" data-main=0>{body}</div>', f'<ul id="{pick("menu", "main-nav")}" data-main=0>{links(3, 8)}</ul>'))

    def head() -> str:
        body = f"<h1>{words(1, 4)}</h1>" * (r.random() < 0.5) + f"<p>{words(2, 8)}</p>" * (r.random() < 0.6) + f'<a href="/">{words(1, 2)}</a>' + menu() * (r.random() < 0.4)
        return r.choice((f"<header data-main=0>{body}</header>", f'<div id="{pick("header", "masthead", "topbar")}" data-main=0>{body}</div>'))

    def foot() -> str:
        body = r.choice((f"&copy; {words(1, 2)} &middot; {sentence()}", f"<p>&copy; 2020 {words(1, 3)}</p><p>{prose(1, 2)}</p>", f"<ul>{links(2, 6)}</ul>", f"<p>{sentence()}</p>"))
        return r.choice((f"<footer data-main=0>{body}</footer>", f'<div class="{pick("footer", "site-footer", "copyright")}" data-main=0>{body}</div>'))

    def side() -> str:
        body = f"<h3>{words(1, 3)}</h3>" + r.choice((f"<ul>{links(3, 8)}</ul>", f"<p>{prose(1, 3)}</p>", f"<div><p>{sentence()}</p></div>"))
        return r.choice((f"<aside data-main=0>{body}</aside>", f'<div class="{pick("sidebar", "related", "widget", "share", "newsletter", "promo")}" data-main=0>{body}</div>', f'<section class="{pick("related", "more", "popular")}" data-main=0>{body}</section>'))

    def advert() -> str:
        body = r.choice((sentence(), f"<p>{prose(1, 3)}</p>", f'<a href="/x">{sentence()}</a>'))
        return f'<div {r.choice(("class", "id"))}="{pick("ad", "ads", "advert", "sponsored", "banner")}" data-main=0>{body}</div>'

    def notice() -> str:
        body = f"<p>{prose(1, 3)}</p>" + f"<button>{words(1, 2)}</button>" * (r.random() < 0.5)
        return f'<{(t := r.choice(("div", "section", "p")))} class="{pick("cookie", "notice", "consent", "alert", "popup")}" data-main=0>{body if t != "p" else prose(1, 2)}</{t}>'

    def form() -> str:
        return f'<form data-main=0 action="/s"><label>{words(1, 3)}</label><input name="q"><p>{sentence()}</p><button>{words(1, 2)}</button></form>'

    def comments() -> str:
        one = lambda: r.choice((f'<div class="comment"><b>{word()}</b><p>{prose(1, 4)}</p></div>', f"<li><p>{prose(1, 5)}</p></li>", f"<p>{prose(1, 4)}</p>", f"<article class=comment><p>{prose(1, 4)}</p></article>"))
        return f'<{(t := r.choice(("div", "section", "ol")))} {r.choice(("id", "class"))}="{pick("comments", "reader-comments", "discussion", "replies")}" data-main=0>' + "".join(one() for _ in range(r.randint(1, 8))) + f"</{t}>"

    def block() -> str:
        kind = r.random()
        if kind < 0.6:
            text = prose(1, 8) if r.random() < 0.7 else r.choice((words(1, 6), word(), f"{sentence(1, 2)}", " | ".join(words(1, 2) for _ in range(r.randint(2, 12))), " ".join(word().upper() + "!!" for _ in range(9)), prose(1, 3).replace(" ", r.choice(("### ", "*** ", "&amp;&amp; ")))))
            if r.random() < 0.2:
                text += f' <a href="/a">{words(1, 3)}</a> {sentence()}'
            return r.choice((f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}<br><p>{prose(1, 3)}</p>", f"<p><em>{words(1, 3)}</em> {text}</p>"))
        if kind < 0.7:
            return f"<h{(k := r.randint(2, 4))}>{words(1, 6)}</h{k}>"
        if kind < 0.8:
            return "<ul>" + "".join(f"<li>{sentence()}</li>" for _ in range(r.randint(1, 6))) + "</ul>"
        if kind < 0.86:
            return f"<blockquote>{r.choice((prose(1, 3), f'<p>{prose(1, 3)}</p>'))}</blockquote>"
        if kind < 0.9:
            return f"<pre>{words(3, 30)}</pre>"
        if kind < 0.94:
            return "<table>" + "".join(f"<tr><td>{words(1, 3)}</td><td>{words(1, 6)}</td></tr>" for _ in range(r.randint(1, 5))) + "</table>"
        if kind < 0.97:
            return f"<figure><img src=x><figcaption>{sentence()}</figcaption></figure>"
        return f"<div>{prose(1, 4)}</div>"

    def main() -> str:
        few = r.random() < 0.15
        body = f"<h1>{words(1, 9)}{r.choice(('', '.', '&amp;'))}</h1>" * (r.random() < 0.85) + "".join(block() for _ in range(r.randint(1, 2) if few else r.randint(2, 14)))
        for extra in (advert, side, form, comments):
            if r.random() < 0.15:
                body += extra()
                if r.random() < 0.7:
                    body += block()
        shape = r.random()
        if shape < 0.45:
            return f"<article{r.choice(('', '', f' class={chr(34)}' + pick('post', 'entry', 'story') + chr(34)))} data-main=1>{body}</article>"
        if shape < 0.6:
            return f"<main><article data-main=1>{body}</article>{comments() if r.random() < 0.3 else ''}</main>"
        if shape < 0.7:
            return f"<main data-main=1>{body}</main>"
        if shape < 0.9:
            return f'<div {r.choice(("class", "id"))}="{pick("content", "post-content", "entry", "article-body", "story", "main")}" data-main=1>{body}</div>'
        if shape < 0.94:
            aside_cell = f'<td class="{pick("menu", "nav", "sidebar")}" data-main=0>' + r.choice((menu(), f"<p>{prose(1, 2)}</p>", "<br>".join(f'<a href="/{word()}">{words(1, 2)}</a>' for _ in range(r.randint(2, 6))))) + "</td>"
            return f'<table><tr>{aside_cell}<td class="{pick("content", "main", "text")}" data-main=1>{body}</td></tr></table>'
        if shape < 0.97:
            return f'<section class="{pick("article", "text")}" data-main=1>{body}</section>'
        return f"<div><div data-main=1>{body}</div></div>"

    pages = []
    for _ in range(n):
        before = [f() for f, p in ((notice, 0.25), (head, 0.5), (menu, 0.7), (advert, 0.5), (form, 0.15), (side, 0.2)) if r.random() < p]
        after = [f() for f, p in ((comments, 0.4), (side, 0.45), (advert, 0.2), (form, 0.15), (notice, 0.15), (foot, 0.8)) if r.random() < p]
        r.shuffle(before)
        middle = main()
        if r.random() < 0.3:
            middle = f'<div class="{r.choice(("wrapper", "container", "layout", "row"))}">{middle}{side() if r.random() < 0.5 else ""}</div>'
        pages.append(f"<!DOCTYPE html><html><head><title>{words(1, 5)}</title></head><body>{''.join(before)}{middle}{''.join(after)}</body></html>")
    return pages


def extract(df: DataFrame, model: Model, key: str = "page_id", html: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """(key, kept columns, text, n_chars) of each page."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    cols = [df[key].alias("key"), df[html].alias("html"), *[df[c].alias(f"k{i}") for i, c in enumerate(keep)]]
    schema = keyed(df, key, "text string, n_chars bigint")
    schema = T.StructType([schema[0], *[T.StructField(f"k{i}", df.schema[c].dataType) for i, c in enumerate(keep)], *schema[1:]])
    names = ["key", *[f"k{i}" for i in range(len(keep))], "text", "n_chars"]

    def make():
        m = shared.value

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = m.texts(texts_of(batch, "html"))
            return pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names)

        return each

    out = map_texts(df.select(*cols), "html", make, schema)
    return out.toDF(key, *keep, "text", "n_chars")


def op6_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"), fit(labelled_pages()))
