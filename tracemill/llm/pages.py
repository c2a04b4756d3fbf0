"""Main text of web pages: boosted trees over DOM nodes, then hierarchical decoding.

Block elements of a page form a tree. Each gets the trees' probability of belonging to the article
from its tag, attribute tokens, depth, siblings and the density of text and links below it. The
decoding takes the most probable labelling in which no node is kept under a dropped one, so ancestors
and descendants cannot contradict each other. Text that stands in no block but the page's body is a block of
its own.
"""

from __future__ import annotations

import html as entities
import random
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .gbt import Trees, train

# Elements by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg iframe object canvas select textarea button head".split())
BLOCK = frozenset("html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd nav header footer aside form fieldset table thead tbody tfoot tr td th figure figcaption blockquote pre address details summary center dialog".split())
CLOSES_P = BLOCK - {"html", "body"}
SAME_CLOSES = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "p": ()}
GOOD = ("article", "content", "post", "entry", "story", "main", "body", "text", "prose")
BAD = ("nav", "menu", "foot", "head", "side", "ad", "ads", "advert", "advertisement", "banner", "comment", "share", "social", "promo", "sponsor", "cookie", "consent", "notice", "alert", "related", "recommend", "widget", "form", "login", "subscribe", "newsletter", "breadcrumb", "pagination", "modal", "popup", "tags", "toolbar", "reply", "discussion")
BAD_GROUPS = (("nav", "menu", "breadcrumb", "pagination", "toolbar"), ("foot", "footer"), ("head", "header", "masthead"), ("side", "sidebar", "aside", "rail", "widget"), ("ad", "ads", "advert", "advertisement", "banner", "sponsor", "sponsored", "promo"), ("comment", "comments", "reply", "replies", "discussion", "disqus", "respond"), ("cookie", "consent", "notice", "alert", "gdpr", "modal", "popup"), ("related", "recommend", "recommended", "share", "social", "tags", "more"), ("form", "login", "subscribe", "newsletter", "signup", "search"))
#: Parts of a token that tells how a page is set out ("no-sidebar", "comments-open"), not what the element is.
STATE = frozenset("no has with without on off open opened closed fixed sticky static enabled disabled dark light is not hide hidden show shown status category tag style layout mode count supports".split())
TAG_GROUPS = (("article",), ("main",), ("section",), ("div",), ("p",), ("h1", "h2", "h3", "h4", "h5", "h6"), ("ul", "ol", "dl"), ("li", "dt", "dd"), ("nav",), ("header",), ("footer",), ("aside",), ("form", "fieldset"), ("table", "tbody", "tr", "td", "th"), ("blockquote", "pre", "figure", "figcaption"), ("text",))
_TAG_AT = {t: i for i, g in enumerate(TAG_GROUPS) for t in g}
_BAD_AT = {t: i for i, g in enumerate(BAD_GROUPS) for t in g}
_GOOD = frozenset(GOOD)

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?|[^<]+|<", re.S)
_NAMES = re.compile(r"(?:^|\s)(class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*display\s*:\s*none)", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_CLOSERS: dict[str, re.Pattern] = {}


class Page:
    """Block nodes of a page in order: tag, parent, depth, attribute flags, and the text blocks they own; `text` is the tag of text that stands in the page or its body."""

    __slots__ = ("tags", "parents", "depths", "attrs", "block_nodes", "block_texts", "own_chars", "link_chars", "n_links", "n_inline")

    def __init__(self, source: str):
        self.tags, self.attrs = ["html"], [()]
        self.parents, self.depths = array("i", [-1]), array("i", [0])
        self.own_chars, self.link_chars, self.n_links, self.n_inline = (array("i", [0]) for _ in range(4))
        self.block_nodes, self.block_texts = array("i"), []
        stack, open_tags, n_open = [0], ["html"], {"html": 1}
        links, parts, node = 0, [], 0
        linked = n_links = 0  # characters in links, and links, of the block that is being read
        at, n = 0, len(source)
        match = _TOKEN.match

        def add(tag: str, parent: int, flags: tuple[int, ...]) -> int:
            self.tags.append(tag)
            self.attrs.append(flags)
            self.parents.append(parent)
            self.depths.append(len(stack))
            for counts in (self.own_chars, self.link_chars, self.n_links, self.n_inline):
                counts.append(0)
            return len(self.tags) - 1

        def flush() -> None:
            nonlocal linked, n_links
            owner = node
            if parts:
                text = " ".join(entities.unescape("".join(parts)).split())
                parts.clear()
                if text:
                    if self.tags[node] in ("html", "body"):
                        owner = add("text", node, ())
                    self.block_nodes.append(owner)
                    self.block_texts.append(text)
                    self.own_chars[owner] += len(text)
            self.link_chars[owner] += linked
            self.n_links[owner] += n_links
            linked = n_links = 0

        def close(back: int) -> None:
            for tag in open_tags[back:]:
                n_open[tag] -= 1
            del open_tags[back:], stack[back:]

        def innermost(tag: str) -> int:
            back = len(open_tags) - 1
            while open_tags[back] != tag:
                back -= 1
            return back

        while at < n:
            m = match(source, at)
            at = m.end()
            name = m[2]
            if name is None:
                found = m[0]
                if found[0] != "<" or found == "<":
                    parts.append(found)
                    if links:
                        linked += len(found)
                continue
            name = name.lower()
            if m[1]:
                if name == "a":
                    links = max(0, links - 1)
                elif name in BLOCK:
                    if n_open.get(name) and name not in ("html", "body"):
                        flush()
                        close(innermost(name))
                        node = stack[-1]
                        links = 0
                elif name == "br":
                    parts.append(" ")
                continue
            if name in RAW:
                if m[0][-2:] != "/>":
                    closer = _CLOSERS.get(name) or _CLOSERS.setdefault(name, re.compile(f"</{name}\\s*>|<body[\\s>]" if name == "head" else f"</{name}\\s*>", re.I))
                    end = closer.search(source, at)
                    at = n if end is None else end.start() if end[0][1] in "bB" else end.end()
                continue
            if name == "a":
                links += 1
                n_links += 1
                continue
            if name not in BLOCK:
                self.n_inline[node] += 1
                if name == "br" or name == "hr":
                    parts.append(" ")
                continue
            if name == "html" or (name == "body" and n_open.get("body")):
                continue
            flush()
            links = 0
            if name in CLOSES_P and open_tags[-1] == "p":
                close(len(stack) - 1)
            if name in SAME_CLOSES and n_open.get(name):
                back = innermost(name)
                if not any(t in SAME_CLOSES[name] for t in open_tags[back + 1 :]):
                    close(back)
            found = m[3]
            node = add(name, stack[-1], _flags(found) if "=" in found or "hidden" in found else ())
            stack.append(node)
            open_tags.append(name)
            n_open[name] = n_open.get(name, 0) + 1
        flush()


_flag_memo: dict[str, tuple[int, ...]] = {}


#: Flags besides those of the bad groups: all bad words are parts of longer tokens; a bad word in a token that describes the page.
_PARTLY, _STATE = 1 + len(BAD_GROUPS), 2 + len(BAD_GROUPS)


def _group(word: str) -> int | None:
    found = _BAD_AT.get(word)
    return _BAD_AT.get(word[:-1]) if found is None and word.endswith("s") else found


def _flags(attrs: str) -> tuple[int, ...]:
    """Attribute tokens of a node: 0 good, 1 + group bad, _PARTLY, _STATE, -1 hidden."""
    known = _flag_memo.get(attrs)
    if known is not None:
        return known
    out = {-1} if _HIDDEN.search(attrs) else set()
    whole = False
    for m in _NAMES.finditer(attrs):
        for token in (m[2] or m[3] or m[4] or "").split():
            parts = [x.lower() for x in _PART.findall(token)]
            if not _GOOD.isdisjoint(parts):
                out.add(0)
            bad = {g for g in map(_group, parts) if g is not None}
            if bad and not STATE.isdisjoint(parts):
                out.add(_STATE)
                continue
            out.update(1 + g for g in bad)
            whole |= bool(bad) and len(parts) == 1
    if not whole and any(0 < f < _PARTLY for f in out):
        out.add(_PARTLY)
    if len(_flag_memo) > 20_000:
        _flag_memo.clear()
    _flag_memo[attrs] = tuple(out)
    return _flag_memo[attrs]


N_FEATURES = len(TAG_GROUPS) + len(BAD_GROUPS) + 4 + 3 + 18
_NODES = 20_000  # of which features are held at once


def features(page: Page) -> Iterator[np.ndarray]:
    """Features of the nodes in order, _NODES rows at a time, so that a page of any size needs a few numbers a node."""
    n = len(page.tags)
    parents, tags = page.parents, page.tags
    chars, links, n_links, paragraphs, nodes = array("q", page.own_chars), array("q", page.link_chars), array("q", page.n_links), array("q", [t == "p" for t in tags]), array("q", [1]) * n
    children, place = array("i", bytes(4 * n)), array("i", bytes(4 * n))
    for i in range(1, n):
        place[i] = children[parents[i]]
        children[parents[i]] += 1
    for i in range(n - 1, 0, -1):
        p = parents[i]
        chars[p] += chars[i]
        links[p] += links[i]
        n_links[p] += n_links[i]
        paragraphs[p] += paragraphs[i]
        nodes[p] += nodes[i]
    n_tags, n_flags = len(TAG_GROUPS), len(BAD_GROUPS) + 4
    inherited, within = [()] * n, bytearray(n)
    c, l, nl, own = (np.frombuffer(v, v.typecode).astype(np.float32) for v in (chars, links, n_links, page.own_chars))  # noqa: E741
    up, depth, order, count, n_p, n_below = (np.frombuffer(v, v.typecode) for v in (parents, page.depths, place, children, paragraphs, nodes))
    for low in range(0, n, _NODES):
        high = min(n, low + _NODES)
        x = np.zeros((high - low, N_FEATURES), np.float32)
        for i in range(low, high):
            row = x[i - low]
            t = _TAG_AT.get(tags[i])
            if t is not None:
                row[t] = 1
            for f in page.attrs[i]:
                row[n_tags + (f if f >= 0 else n_flags - 1)] = 1
            if i:
                p = parents[i]
                within[i] = within[p] or tags[p] in ("article", "main")
                # What the page and its body say holds for all of it, so it tells no node from another.
                above = () if tags[p] in ("html", "body") else page.attrs[p] or inherited[p]
                inherited[i] = above
                if above:
                    bad = any(0 < f < _PARTLY for f in above)
                    row[n_tags + n_flags] = bad and _PARTLY not in above
                    row[n_tags + n_flags + 1] = bad and _PARTLY in above
                    row[n_tags + n_flags + 2] = 0 in above
        part, over = slice(low, high), np.maximum(up[low:high], 0)
        cols = (
            depth[part], order[part], count[over], count[part], np.log1p(own[part]), np.log1p(c[part]), l[part] / np.maximum(c[part], 1), c[part] / max(c[0], 1),
            c[part] / n_below[part], n_p[part], nl[part], np.log1p(c[over]), l[over] / np.maximum(c[over], 1), np.arange(low, high) / n, np.frombuffer(within, np.uint8)[part],
            c[part] / np.maximum(c[over], 1), n_p[over], own[part] / np.maximum(c[part], 1),
        )
        for k, col in enumerate(cols):
            x[:, n_tags + n_flags + 3 + k] = col
        yield x


def decode(page: Page, log_odds: np.ndarray) -> list[bool]:
    """The labelling with the largest sum of log probabilities in which a kept node's parent is kept; the page and its body are no choice."""
    n = len(page.tags)
    keep, drop = array("d", -np.logaddexp(0, -log_odds)), array("d", -np.logaddexp(0, log_odds))
    for i in range(n - 1, 0, -1):
        p = page.parents[i]
        keep[p] += max(keep[i], drop[i])
        drop[p] += drop[i]
    out = [True] * n
    for i in range(1, n):
        out[i] = out[page.parents[i]] and (keep[i] > drop[i] or page.tags[i] == "body")
    return out


def _training_page(rng: random.Random) -> tuple[str, set[str]]:
    """A page laid out at random and the text blocks of its article."""
    stems = [("ka", "lo", "mi", "ter", "an", "sol", "ve", "ri"), ("in", "the", "er", "on", "of", "ti", "nd", "ea"), ("ch", "ung", "der", "ge", "en", "st")][rng.randrange(3)]
    word = lambda: "".join(rng.choice(stems) for _ in range(rng.choice((1, 1, 2, 2, 3, 4))))
    sentence = lambda low=4, high=18: " ".join(word() for _ in range(rng.randint(low, high))).capitalize() + rng.choice("...!?")
    para = lambda low=1, high=6: " ".join(sentence() for _ in range(rng.randint(low, high)))
    kept: set[str] = set()

    def main(text: str) -> str:
        kept.add(" ".join(text.split()))
        return text

    link = lambda n=1: f'<a href="/{word()}">{" ".join(word() for _ in range(n))}</a>'
    items = lambda low, high, k=2: "<ul>" + "".join(f"<li>{link(rng.randint(1, k))}</li>" for _ in range(rng.randint(low, high))) + "</ul>"
    name = lambda *options: rng.choice(options)
    ad = lambda: f'<div class="{name("ad", "ads", "advert", "ad-slot", "banner", "sponsored", "promo-box")}">{name(sentence(), para(1, 2), link(3))}</div>'

    bad_word = lambda: rng.choice(rng.choice(BAD_GROUPS))
    state = lambda: rng.choice((lambda w: f"{rng.choice(('no', 'has', 'with', 'hide', 'category', word()))}-{w}", lambda w: f"{w}-{rng.choice(('open', 'on', 'fixed', 'dark', 'status-open', word()))}", lambda w: f"{word()}-with-{w}", lambda w: w))(bad_word())

    def states(chance: float, also: str = "") -> str:
        """A class attribute with `also` and, sometimes, tokens that describe the page."""
        found = [also] if also else []
        if rng.random() < chance:
            found += [rng.choice((state, state, word))() for _ in range(rng.randint(1, 4))]
            rng.shuffle(found)
        return f' class="{" ".join(found)}"' if found else ""

    if rng.random() < 0.05:  # a few paragraphs and nothing else
        whole = "".join(f"<p>{main(para(1, 3))}</p>" for _ in range(rng.choice((1, 1, 2, 3))))
        return rng.choice(("{}", "<body>{}</body>", "<div>{}</div>", "<html><body>{}</body></html>")).format(whole), kept
    blocks = []
    if rng.random() < 0.85:
        blocks.append(f"<h1>{main(sentence(3, 12))}</h1>")
    if rng.random() < 0.2:
        blocks.append(f'<p class="{name("byline", "meta", "author")}">{main(sentence(2, 5))}</p>')
    bare = rng.random() < 0.15  # a page or a fragment whose text is not all in blocks
    style = 1.0 if bare else rng.random()
    if rng.random() < 0.15:  # a note whose only paragraph is short and may repeat the title
        text = main(sentence(1, 12)) if rng.random() < 0.5 or not kept else sorted(kept)[0]
        blocks.append(f"<p>{text}</p>")
    linked = rng.random() < 0.3  # an article whose paragraphs are full of links

    def rich(text: str) -> str:
        """Some words of a text as links; rarely all of it."""
        found = text.split(" ")
        if rng.random() < 0.06:
            return f'<a href="/{word()}">{text}</a>'
        for _ in range(rng.randint(1, 1 + len(found) // 12)):
            at = rng.randrange(len(found))
            end = min(len(found), at + rng.randint(1, 3))
            if not any("<" in x or ">" in x for x in found[at:end]):
                found[at], found[end - 1] = f'<a href="/{word()}">{found[at]}', f"{found[end - 1]}</a>" if end - 1 > at else f'<a href="/{word()}">{found[at]}</a>'
        return " ".join(found)

    for _ in range(0 if len(blocks) > 1 and blocks[-1].count("<") == 2 else rng.choice((1, 2, 3, 5, 8, 12, 20))):
        kind = rng.random()
        if kind < 0.06:  # a part of the article in an element of its own, whatever its name
            inside = "".join(f"<p>{main(para())}</p>" for _ in range(rng.randint(1, 4)))
            if rng.random() < 0.4:
                inside = f"<h{rng.randint(2, 4)}>{main(sentence(2, 8))}</h2>" + inside
            tag = name("section", "div")
            said = name("", f"{bad_word()}-{word()}", f"{word()}-{bad_word()}-{word()}", f"{bad_word()}-{word()}-story", state())
            blocks.append(f'<{tag} class="{said}">{inside}</{tag}>' if said else f"<{tag}>{inside}</{tag}>")
        elif kind < 0.72 and linked and rng.random() < 0.6:
            blocks.append(f"<p>{rich(main(para()))}</p>")
        elif kind < 0.72:
            text = main(para())
            if bare and rng.random() < 0.6 and (not blocks or blocks[-1][-1] == ">"):
                blocks.append(text)
            elif style < 0.35 and rng.random() < 0.4:
                blocks.append(f"<p><b>{text}<br>")
            elif style < 0.5:
                blocks.append(f"<p>{text}")
            elif style < 0.6:
                blocks.append(f"<div>{text}</div>")
            else:
                blocks.append(f"<p>{text}</p>")
        elif kind < 0.82:
            blocks.append(f"<h{rng.randint(2, 4)}>{main(sentence(2, 8))}</h2>")
        elif kind < 0.88:
            blocks.append("<ul>" + "".join(f"<li>{main(sentence())}</li>" for _ in range(rng.randint(2, 6))) + "</ul>")
        elif kind < 0.9:
            blocks.append(f"<blockquote>{main(para(1, 3))}</blockquote>" if rng.random() < 0.5 else f"<blockquote><p>{main(para(1, 3))}</p></blockquote>")
        elif kind < 0.91:
            blocks.append(f"<pre>{main(' '.join(word() for _ in range(rng.randint(4, 40))))}</pre>")
        elif kind < 0.93:
            blocks.append("<table>" + "".join(f"<tr><td>{main(sentence(1, 4))}</td><td>{main(sentence(1, 4))}</td></tr>" for _ in range(3)) + "</table>")
        elif kind < 0.955:
            blocks.append(ad())
        elif kind < 0.975:
            tag = name("p", "div")
            blocks.append(f'<{tag} class="{name("notice", "newsletter", "subscribe", "alert", "disclaimer-notice")}">{name(sentence(), para(1, 3))}</{tag}>')
        else:
            blocks.append(f'<div class="{name("related", "share", "social-links", "more")}">{name(items(2, 5, 5), sentence(1, 4))}</div>')
    if rng.random() < 0.15:
        blocks.insert(rng.randint(1, len(blocks)) if blocks else 0, f'<form action="/x">{name("", f"<p>{sentence(2, 6)}</p>")}<label>{word()}</label><input name="q"></form>')
    if rng.random() < 0.15:
        blocks.append(f"<footer>{name(sentence(2, 6), items(2, 4))}</footer>")
    shell = 0.93 if bare and rng.random() < 0.8 else rng.random()
    inner = "\n".join(blocks)
    if shell < 0.08 and inner.startswith("<h1>"):  # a title in a header of the article's own
        title, _, rest = inner.partition("</h1>")
        body = f"<article{states(0.4)}><header>{title}</h1></header>{rest}</article>"
    elif shell < 0.45:
        body = f"<article{states(0.4)}>{inner}</article>"
    elif shell < 0.6:
        body = f"<main{states(0.3)}>{inner}</main>"
    elif shell < 0.85:
        kind = name("content", "post", "entry-content", "article-body", "story", "main", "post-text", "page")
        body = f"<div{states(0.3, kind)}>{inner}</div>" if rng.random() < 0.6 else f'<div id="{kind}"{states(0.2)}>{inner}</div>'
    elif shell < 0.91:
        body = f"<section{states(0.3)}>{inner}</section>"
    elif shell < 0.95:
        body = inner
    else:
        body = f"<table><tr><td>{inner}</td></tr></table>"
    head, tail = [], []
    if rng.random() < 0.85:
        head.append(f"<nav>{items(3, 9)}</nav>" if rng.random() < 0.6 else f'<div class="{name("menu", "navbar", "top-nav")}">{items(3, 9)}</div>')
    if rng.random() < 0.4:
        head.insert(0, f"<header><h1>{sentence(1, 4)}</h1><p>{sentence(2, 8)}</p></header>" if rng.random() < 0.6 else f'<div id="{name("header", "masthead")}">{sentence(1, 6)}</div>')
    if rng.random() < 0.3:
        head.append(f'<div class="{name("cookie-notice", "consent", "notice", "alert")}"><p>{para(1, 2)}</p></div>')
    if rng.random() < 0.5:
        head.append(ad())
    if rng.random() < 0.45:
        side = f"<h3>{sentence(1, 4)}</h3>" + items(2, 8, 6) + "".join(f"<p>{para(1, 2)}</p>" for _ in range(rng.randint(0, 3)))
        rng.choice((head, tail)).append(f"<aside>{side}</aside>" if rng.random() < 0.5 else f'<div class="{name("sidebar", "side", "widget", "rail")}">{side}</div>')
    if rng.random() < 0.4:
        notes = "".join(f"<{t}>{name('', f'<b>{word()}</b> ')}{para(1, 4)}</{t}>" for t in [name("p", "li", "div")] * rng.randint(1, 7))
        tail.append(f'<{name("div", "section")} {name("class", "id")}="{name("comments", "comment-list", "replies", "discussion")}"><h3>{sentence(1, 3)}</h3>{notes}</div>')
    if rng.random() < 0.3:
        rng.choice((head, tail)).append(f'<form action="/x"><p>{sentence()}</p><label>{word()}</label><input name="q"></form>')
    if rng.random() < 0.25:
        tail.insert(0, f'<div class="{name("share", "social", "share-bar")}">{name(sentence(1, 3), items(2, 4))}</div>')
    if rng.random() < 0.3:
        tail.append(f'<div class="{name("related", "recommended", "more-stories")}"><h2>{sentence(2, 4)}</h2>{items(2, 6, 8)}</div>')
    if rng.random() < 0.85:
        foot = f"&copy; {word()}.com &middot; {para(1, 2)}" + (items(2, 6) if rng.random() < 0.4 else "")
        tail.append(f"<footer>{foot}</footer>" if rng.random() < 0.65 else f'<div class="{name("footer", "site-footer", "foot")}"><p>{foot}</p></div>')
    if rng.random() < 0.15:  # words that stand in no block
        rng.choice((head, tail)).append(f"{sentence(1, 4)}<hr>" if rng.random() < 0.5 else f"{link(2)} | {link(1)} | {link(2)}")
    if bare and rng.random() < 0.5:
        head, tail = [], []
    whole = "".join(head) + body + "".join(tail)
    if bare and rng.random() < 0.5:
        return whole, kept
    if rng.random() < 0.4 and not bare:
        whole = f"<div{states(0.3, name('wrapper', 'container', 'page', 'site'))}>{whole}</div>"
    return f"<!DOCTYPE html><html{states(0.2)}><head><title>{word()}</title></head><body{states(0.5)}>{whole}</body></html>", kept


@cache
def fit(n_pages: int = 800, seed: int = 11) -> Trees:
    """Trees trained on n_pages pages laid out at random (their size bounds the sample, whatever the input); fitted once in a process."""
    rng = random.Random(seed)
    xs, ys = [], []
    for _ in range(n_pages):
        source, kept = _training_page(rng)
        page = Page(source)
        label = [False] * len(page.tags)
        for node, text in zip(page.block_nodes, page.block_texts, strict=True):
            if text in kept:
                while node >= 0 and not label[node]:
                    label[node] = True
                    node = page.parents[node]
        choice = [i > 0 and t != "body" for i, t in enumerate(page.tags)]
        xs.append(np.concatenate(list(features(page)))[choice])
        ys.append(np.array(label)[choice])
    return train(np.concatenate(xs).astype(float), np.concatenate(ys).astype(float), n_trees=80, depth=5)


def _kept_text(page: Page, log_odds: np.ndarray) -> str:
    kept = decode(page, log_odds)
    return "\n\n".join(text for node, text in zip(page.block_nodes, page.block_texts, strict=True) if kept[node])


def extract(sources: Iterable[str], trees: Trees) -> list[str]:
    """Main text of each page: its kept blocks in order, joined by an empty line.

    Small pages are judged together, up to _NODES nodes at a time; a larger one alone, in parts.
    """
    out: list[str] = []
    held: list[Page] = []
    size = 0

    def judge() -> None:
        nonlocal size
        odds, at = trees.log_odds(np.concatenate([x for p in held for x in features(p)])), 0
        for p in held:
            out.append(_kept_text(p, odds[at : at + len(p.tags)]))
            at += len(p.tags)
        held.clear()
        size = 0

    for source in sources:
        page = Page(source)
        if held and size + len(page.tags) > _NODES:
            judge()
        if len(page.tags) > _NODES:
            out.append(_kept_text(page, np.concatenate([trees.log_odds(x) for x in features(page)])))
        else:
            held.append(page)
            size += len(page.tags)
            if sum(map(len, page.block_texts)) > _NODES * 20:
                judge()
    if held:
        judge()
    return out


def main_text(pages: DataFrame, n_training_pages: int = 800, seed: int = 11) -> DataFrame:
    """page_id, url, text and n_chars (code points of text) of every row of pages (page_id, url, html).

    The trees are fitted on n_training_pages generated pages. Null and empty html, and pages
    without an article, give an empty text; html of any length and depth is taken whole; some small pages
    are held at once; repeated rows are kept; other columns are ignored; an empty table gives no rows.
    """
    shared = pages.sparkSession.sparkContext.broadcast(fit(n_training_pages, seed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = extract((s.as_py() or "" for s in batch.column("html")), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return pages.select("page_id", "url", F.col("html").cast("string").alias("html")).mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
