"""Main text of web pages by a tree-structured graphical model.

Every element and every run of text of a page is a node that is content or not. Nodes see features (tag, words of
class and id, share of link text, length), with one table of log-likelihoods for each label; a parent and a child
are joined by a 2 x 2 table of potentials. Sum-product messages, upward from the leaves and then downward from the
root, give the exact marginal of each node; runs of text that are content with a marginal of at least 1/2 are the
main text. The tables are smoothed counts over labelled pages, which label_pages() writes: pages of many layouts
whose true main text is known.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_text, table, without

# Fixed values of the HTML standard: elements that hold no children, whose content is raw text, that stand in a
# line of text, and that end an open paragraph.
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp noscript template".split())
_TEMPLATE = re.compile(r"<(/?)template(?=[\s/>])", re.I)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label map mark meter nobr output picture progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
#: An open element of the key is ended by a start tag of the values, up to an element of the scope.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option", "optgroup"}, {"select", "datalist"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}),
}
#: Where markup starts: a comment, a tag with its name, or what is read as a comment; and what ends a tag or opens a value.
_OPEN = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][^\s/>]*)|[!?/])")
_STOP = re.compile(r">|=\s*+([\"'])")
_ATTR = re.compile(r"\b(class|id|role|hidden|style|aria-label)(?:\s*+=\s*+(?:\"([^\"]*+)(?:\"|\Z)|'([^']*+)(?:'|\Z)|([^\s\"'>]+)))?", re.I)
_WORDS = re.compile(r"[a-z]+")

#: Elements of an article whose class may name their subject.
PROSE = frozenset("p pre blockquote h1 h2 h3 h4 h5 h6 li dd td figcaption".split())

#: A header inside an article holds its headline, not the page's.
HEADLINE = "article-header"

#: Words of class, id and role by what they say about an element.
HINTS = {
    "ad": "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion adsense adbox".split(),
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc sitemap tabs".split(),
    "head": "header masthead topbar logo branding".split(),
    "foot": "footer copyright legal imprint colophon bottom".split(),
    "side": "sidebar aside widget related recommended complementary teaser trending popular".split(),
    "notice": "cookie cookies consent gdpr notice popup modal overlay alert newsletter subscribe paywall disclaimer".split(),
    "talk": "comment comments reply replies discussion disqus respond commentlist".split(),
    "form": "form search login signup contact feedback".split(),
    "share": "share sharing social buttons toolbar".split(),
    "main": "article articlebody content main post entry story body text prose page".split(),
    "gone": "hidden none invisible".split(),
}
_HINT = {w: k for k, ws in HINTS.items() for w in ws}


class Tree:
    """The nodes of a page, parents first: parent, tag, hint words, and for runs of text their text; depth bounds nothing."""

    __slots__ = ("parent", "tag", "hints", "text", "links")

    def __init__(self):
        self.parent, self.tag, self.hints, self.text, self.links = [-1], ["#root"], [()], [None], [0]

    def add(self, parent: int, tag: str, hints: tuple[str, ...], text: str | None, links: int) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.hints.append(hints)
        self.text.append(text)
        self.links.append(links)
        return len(self.parent) - 1


def _hints(attrs: str, whole: bool = False) -> tuple[str, ...]:
    """_hints_of, remembered for short attributes."""
    return (_remembered if len(attrs) < 500 else _hints_of)(attrs, whole)


def _hints_of(attrs: str, whole: bool) -> tuple[str, ...]:
    """What an element's attributes say of it; with whole a name counts only if all its words are known, as in cookie-notice."""
    found = set()
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "style" and "display:none" in value.replace(" ", ""):
            found.add("gone")
        elif name not in ("hidden", "style"):
            for token in value.split():
                words = _WORDS.findall(token)
                if not whole or all(w in _HINT for w in words):
                    found.update(_HINT[w] for w in words if w in _HINT)
    return tuple(sorted(found))


_remembered = lru_cache(4096)(_hints_of)


def _tag_end(page: str, at: int) -> int:
    """Where the tag ends whose name ends at that place: after a > that stands in no quoted value.

    A value that is never closed ends with the tag, at the next >; a tag that is never closed takes the rest."""
    n = len(page)
    while True:
        m = _STOP.search(page, at)
        if not m:
            return n
        if not m[1]:
            return m.end()
        shut = page.find(m[1], m.end())
        if shut < 0:
            return page.find(">", m.end()) + 1 or n
        at = shut + 1


def parse(page: str) -> Tree:
    """The tree of block elements and runs of text; broken markup is mended as browsers mend it, as far as blocks go.

    Time grows in proportion to the page: a cursor passes each character once, and the open elements of each name are kept
    apart, so that an end tag finds its element without a search."""
    t, stack, run, links, in_a, at, n = Tree(), [0], [], 0, False, 0, len(page)
    places: dict[str, list[int]] = {}  # places in the stack of the open elements of a name

    def flush() -> None:
        nonlocal run, links
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            if text:
                t.add(stack[-1], "#text", (), text, links)
            run, links = [], 0

    def close(name: str, scope: set[str] | frozenset[str] = frozenset()) -> None:
        own = places.get(name)
        if not own or any(places.get(x) and places[x][-1] > own[-1] for x in scope):
            return
        flush()
        to = own[-1]
        while len(stack) > to:
            places[names.pop()].pop()
            stack.pop()

    names = ["#root"]  # of the stack
    places["#root"] = [0]
    while at < n:
        m = _OPEN.search(page, at)
        piece = page[at : m.start()] if m else page[at:]
        if piece:
            run.append(piece)
            if in_a:
                links += len(piece)
        if not m:
            break
        if not m[3]:
            mark = "-->" if m[1] else "]]>" if page.startswith("<![CDATA[", m.start()) else ">"
            end = page.find(mark, m.end())
            at = end + len(mark) if end >= 0 else n
            continue
        at = _tag_end(page, m.end())
        tag, attrs = m[3].lower(), page[m.end() : at - 1]
        if m[2]:
            if tag == "a":
                in_a = False
            elif tag == "header" and places.get(HEADLINE):
                close(HEADLINE)
            elif tag not in INLINE and tag not in VOID:
                close(tag, frozenset({"table"}) if tag in ("p", "li") else frozenset())
            continue
        if tag == "br":
            run.append("\n")
        if tag == "a":
            in_a = True
        if tag in INLINE or tag in VOID and tag != "hr":
            continue
        if tag in ENDS_P:
            close("p", frozenset({"table", "td", "th", "button"}))
        if tag in SIBLINGS:
            ended, scope = SIBLINGS[tag]
            for name in ended:
                close(name, scope)
        if tag not in RAW or tag in ("textarea", "title"):
            flush()
        if tag == "hr":
            continue
        if tag in RAW:  # never text of the page
            end = _template_end(page, at) if tag == "template" else re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            at = page.find(">", end.end()) + 1 or n if end else n
            continue
        if tag == "header" and places.get("article"):
            tag = HEADLINE
        own = t.add(stack[-1], tag, _hints(attrs, tag in PROSE) if attrs else (), None, 0)
        if not attrs.endswith("/") or tag not in ("svg", "path"):
            places.setdefault(tag, []).append(len(stack))
            stack.append(own)
            names.append(tag)
            in_a = False
    flush()
    return t


def _template_end(page: str, at: int) -> re.Match | None:
    """The closing tag of a template whose content begins at a place; templates may hold templates."""
    open_ = 1
    for m in _TEMPLATE.finditer(page, at):
        open_ += -1 if m[1] else 1
        if not open_:
            return m
    return None


def features(t: Tree) -> list[list[str]]:
    """What each node sees of itself."""
    out = []
    for tag, hints, text, links in zip(t.tag, t.hints, t.text, t.links, strict=True):
        if text is None:
            out.append([f"tag={tag}", *(f"hint={h}" for h in hints)] if hints else [f"tag={tag}"])
        else:
            n = len(text)
            size = 0 if n < 15 else 1 if n < 60 else 2 if n < 200 else 3
            out.append([f"link={min(3, 4 * links // max(n, 1))}", f"size={size}", f"stop={text[-1] in '.!?:;…»”\"'}"])
    return out


#: Elements that stand for something beside the text.
BOXES = frozenset("nav aside footer form header button select menu dialog".split())
PAGE = frozenset(("#root", "html", "body", "head"))


def kinds(t: Tree) -> list[int]:
    """0 plain element, 1 run of text, 2 box (by its tag or a hint of something beside the text), 3 the page itself."""
    out = []
    for tag, hints, text in zip(t.tag, t.hints, t.text, strict=True):
        out.append(1 if text is not None else 3 if tag in PAGE else 2 if tag in BOXES or any(h != "main" for h in hints) else 0)
    return out


class Model:
    """Log-likelihood ratios of features, and log-potentials of (kind of parent, kind of child, parent label, child label)."""

    def __init__(self, pages: list[tuple[Tree, list[int]]], smooth: float = 0.5):
        seen, size, pair = Counter(), Counter(), Counter()
        names: dict[str, set[str]] = {}
        for t, y in pages:
            kind = kinds(t)
            for i, fs in enumerate(features(t)):
                for f in fs:
                    seen[f, y[i]] += 1
                    names.setdefault(f.partition("=")[0], set()).add(f)
                if i:
                    pair[kind[t.parent[i]], kind[i], y[t.parent[i]], y[i]] += 1
                size[y[i], t.text[i] is not None] += 1
        self.unary: dict[str, float] = {}
        for name, fs in names.items():
            is_text = name in ("link", "size", "stop")
            for f in fs:
                p, q = ((seen[f, y] + smooth) / (size[y, is_text] + smooth * (len(fs) + 1)) for y in (1, 0))
                self.unary[f] = float(np.log(p / q))
        self.pair = np.zeros((4, 4, 2, 2))
        for k in range(4):
            for c in range(4):
                for a in (0, 1):
                    n = sum(pair[k, c, a, b] for b in (0, 1)) + 2 * smooth
                    self.pair[k, c, a] = [np.log((pair[k, c, a, b] + smooth) / n) for b in (0, 1)]
        self.ratio = np.exp(self.pair).tolist()

    def marginals(self, t: Tree) -> list[float]:
        """P(content) of each node: messages upward (children to parents), then downward, each as the odds of label 1 to 0."""
        n, get, kind = len(t.parent), self.unary.get, kinds(t)
        exp, log = math.exp, math.log
        own = [sum([get(f, 0.0) for f in fs]) for fs in features(t)]  # log-odds of a node's features, then of its children's messages too
        own[0] -= 20.0  # the document itself is no content
        up = [0.0] * n
        for i in range(n - 1, 0, -1):
            r = self.ratio[kind[t.parent[i]]][kind[i]]
            o = exp(max(-60.0, min(60.0, own[i])))
            up[i] = log((r[1][0] + r[1][1] * o) / (r[0][0] + r[0][1] * o))
            own[t.parent[i]] += up[i]
        for i in range(1, n):
            r = self.ratio[kind[t.parent[i]]][kind[i]]
            o = exp(max(-60.0, min(60.0, own[t.parent[i]] - up[i])))  # the parent's belief without this child's message
            own[i] += log((r[0][1] + r[1][1] * o) / (r[0][0] + r[1][0] * o))
        return [1 / (1 + exp(-max(-60.0, min(60.0, x)))) for x in own]

    def text(self, page: str) -> str:
        t = parse(page)
        return "\n".join(x for x, p in zip(t.text, self.marginals(t), strict=True) if x is not None and p >= 0.5)


def label_pages(n: int = 600, seed: int = 7) -> list[tuple[Tree, list[int]]]:
    """Labelled pages: layouts drawn by rule, with semantic tags or with div and class, some with broken markup.

    Text that belongs to the article starts with a mark that says so; the mark goes once the labels are taken."""
    rng = random.Random(seed)
    mark = "\x02"

    def say(words: int, own: bool) -> str:
        w = ["".join(rng.choice("abcdeilmnorstuä") for _ in range(rng.randint(2, 9))) for _ in range(words)]
        return (mark if own else "") + " ".join(w).capitalize() + rng.choice([".", ".", ".", "!", "?"] if words > 3 else ["", ".", ""])

    def box(kind: str, inner: str) -> str:
        tags = {"menu": ["nav"], "head": ["header"], "foot": ["footer"], "side": ["aside"], "form": ["form"]}.get(kind, [])
        if tags and rng.random() < 0.6:
            return f"<{tags[0]}>{inner}</{tags[0]}>"
        name = rng.choice(HINTS[kind])
        tag = rng.choice(["div", "section", "div"])
        return f'<{tag} {rng.choice(["class", "id"])}="{name}">{inner}</{tag}>'

    def links(k: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/x">{say(rng.randint(1, 3), False)}</a></li>' for _ in range(k)) + "</ul>"

    def paragraph() -> str:
        words = rng.choice([1, 2, 4, 9, 20, 60, 150])
        body = say(words, True)
        return rng.choice([f"<p>{body}</p>"] * 6 + [f"<p>{body}", f"<p><b>{body}<br>", f"<p>{body} <a href='/y'>{say(2, False)}</a></p>"])

    def article() -> str:
        parts = [f"<h1>{say(rng.randint(1, 12), True)}</h1>"] if rng.random() < 0.8 else []
        for _ in range(rng.randint(1, 14)):
            x = rng.random()
            if x < 0.75:
                parts.append(paragraph())
            elif x < 0.82:
                h = rng.choice(["h2", "h3", "h4"])
                parts.append(f"<{h}>{say(rng.randint(1, 6), True)}</{h}>")
            elif x < 0.88:
                parts.append("<ul>" + "".join(f"<li>{say(rng.randint(1, 15), True)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif x < 0.92:
                parts.append(f"<blockquote>{say(30, True)}</blockquote>")
            elif x < 0.935:
                g = rng.choice(["section", "div", "figure"])
                parts.append(f"<{g}>{paragraph()}{paragraph()}</{g}>")
            elif x < 0.95:
                parts.append(f"<table><tr><td>{say(2, True)}</td><td>{say(3, True)}</td></tr></table>")
            elif x < 0.97:
                parts.append(f"<pre>{say(8, True)}</pre>")
            else:
                parts.append(box("ad", say(rng.randint(2, 12), False)))
        return "".join(parts)

    def extra(kind: str) -> str:
        if kind in ("menu", "share"):
            return box(kind, links(rng.randint(2, 9)))
        if kind == "talk":
            return box(kind, "".join(f"<div class='comment'><p>{say(rng.randint(3, 40), False)}</p></div>" for _ in range(rng.randint(1, 5))))
        if kind == "side":
            return box(kind, rng.choice([links(4), f"<h3>{say(2, False)}</h3><p>{say(15, False)}</p>"]))
        if kind == "form":
            return box(kind, f"<label>{say(2, False)}</label><input><button>{say(1, False)}</button>")
        if kind == "head":
            return box(kind, rng.choice([links(3), f"<h1>{say(3, False)}</h1><p>{say(6, False)}</p>", say(3, False)]))
        return box(kind, rng.choice([say(rng.randint(2, 20), False), f"<p>{say(rng.randint(2, 20), False)}</p>"]))

    pages = []
    for _ in range(n):
        main = article()
        inside = rng.random()
        if inside < 0.15:
            main += extra("talk")
        elif inside < 0.25:
            main += extra("share")
        wrap = rng.random()
        if wrap < 0.15:
            main = f"<article><header><h1>{say(rng.randint(2, 12), True)}</h1></header>{main}</article>"
        elif wrap < 0.55:
            main = f"<article>{main}</article>"
        elif wrap < 0.65:
            main = f"<main>{main}</main>"
        elif wrap < 0.75:
            main = f"<main><article>{main}</article></main>"
        elif wrap < 0.9:
            main = f'<div {rng.choice(["class", "id"])}="{rng.choice(HINTS["main"])}">{main}</div>'
        before = "".join(extra(k) for k in rng.sample(["menu", "head", "ad", "notice", "side", "form"], rng.randint(0, 4)))
        after = "".join(extra(k) for k in rng.sample(["foot", "side", "talk", "ad", "notice", "form", "share", "menu"], rng.randint(0, 4)))
        head = f"<head><title>{say(5, False)}</title><script>var t='</p>';</script></head>"
        t = parse(f"<!DOCTYPE html><html>{head}<body>{before}{main}{after}" + rng.choice(["", "</body></html>"]))
        own = [x is not None and mark in x for x in t.text]
        t.text = [x.replace(mark, "") if x else x for x in t.text]
        # An element is content if more of the text below it is content than not.
        yes, no = [int(o) * len(x or "") for o, x in zip(own, t.text, strict=True)], [int(not o) * len(x or "") for o, x in zip(own, t.text, strict=True)]
        for i in range(len(t.parent) - 1, 0, -1):
            yes[t.parent[i]] += yes[i]
            no[t.parent[i]] += no[i]
        y = [int(o) if x is not None else int(a > 0 and g not in ("html", "body", "#root") and a > b) for o, x, a, b, g in zip(own, t.text, yes, no, t.tag, strict=True)]
        pages.append((t, y))
    return pages


_FIELDS = [T.StructField("text", T.StringType(), False), T.StructField("n_chars", T.LongType(), False)]


def train(pages: list[tuple[Tree, list[int]]] | None = None) -> Model:
    return Model(label_pages() if pages is None else pages)


def extract(pages: DataFrame, model: Model | None = None, page: str = "html") -> DataFrame:
    """pages with text (blocks in page order, joined by newlines; empty if there are none) and n_chars (its code points).

    The page itself is left out. A null or empty page has no text; pages are read whole, however long or deep;
    repeated rows get equal texts; an empty table gives an empty result. Columns named like result columns are replaced."""
    model = model or train()

    def work(pages: list[bytes]) -> list[pa.Array]:
        found = [model.text(p.decode("utf-8", "replace")) for p in pages]
        return [pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())]

    return map_text(pages, page, without(pages, ["text", "n_chars", page]), _FIELDS, work)


def op5_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


#: The main text of pages whose article is marked as such, holds headings, paragraphs and inline tags, and no boxes.
ORACLE = r"""
WITH a AS (SELECT page_id, url, unnest(regexp_split_to_array(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1), '</?(p|h1)>')) AS b,
  generate_subscripts(regexp_split_to_array(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1), '</?(p|h1)>'), 1) AS i FROM pages),
t AS (SELECT page_id, url, i, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(b, '<[^>]*>', ' ', 'g'),
  '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '\s+', ' ', 'g')) AS x FROM a),
j AS (SELECT page_id, url, coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (x <> ''), '') AS text FROM t GROUP BY 1, 2)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM j
"""
