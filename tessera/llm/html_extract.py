"""HTML extraction with a tree-structured graphical model.

A page becomes a tree of blocks. Each node is content or not: its own features (tag, names in class and id, link density,
lengths, place) give a unary potential, and each parent-child edge a potential by the kind of the child. Sum-product
messages pass from the leaves up and from the root down, and the marginals decide which blocks are printed.

Potentials are trained on labelled pages: ``labelled_page`` writes pages of many layouts whose blocks are known to be
article or not. A logistic regression and log ratios of label pairs are the start; then unary and edge potentials are fitted
together to the likelihood of whole pages, whose gradient is what the pages have less what the messages expect.

Result: the article's blocks in page order, white space inside a block as one blank, character references decoded, joined
by two line feeds. Cases: null or empty html, pages without content and pages of bare markup give an empty text; broken,
unclosed or cut-off markup is closed at the end of the page; plain text without tags is one block; very long and very
deep pages are read whole (no recursion); repeated pages give equal results; an empty table gives an empty table; other
columns are carried along, those with a result's name are replaced.
"""

from __future__ import annotations

import html as entities
import random
import re
from functools import lru_cache
from math import exp, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Only a quote right after "=" opens a value; any other is a character like others, as in the standard.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
READ = frozenset("class id role aria-label style hidden aria-hidden itemprop".split())
# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title template xmp noembed noframes".split())
#: Unclosed, these hide the rest of the page, as in browsers; other raw tags without an end are passed over.
TO_END = frozenset(("script", "style"))
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "thead": {"tbody"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}, "option": {"option"}, "body": {"head"}}
SCOPE = frozenset("ul ol dl table article section div main body html aside nav".split())
NAMES = [
    ("good", r"article|content|post|entry|story|main|body|text|prose|chapter"),
    ("menu", r"\bnav|menu|breadcrumb|crumbs|pagination|pager|toc\b|tabs"),
    ("head", r"header|masthead|logo|topbar|brand|site-title"),
    ("foot", r"footer|copyright|colophon|legal|bottom"),
    ("side", r"sidebar|\baside|widget|rail|secondary"),
    ("advert", r"\bads?\b|\bad[-_]|[-_]ads?\b|advert|sponsor|promo|banner|dfp|adsense|outbrain|taboola"),
    ("notice", r"cookie|consent|notice|alert|modal|popup|overlay|gdpr|subscribe|newsletter|paywall|toast|disclaimer|announce"),
    ("comment", r"comment|repl(?:y|ies)|disqus|discussion|respond|feedback|thread"),
    ("share", r"share|social|follow|related|recommend|more-|read-next|popular|trending|tags|author-bio|byline|meta\b"),
    ("form", r"\bform|search|login|signup|sign-up|contact"),
    ("hidden", r"hidden|sr-only|skip|print-only|noprint|display:\s*none"),
]
NAMED = [(k, re.compile(p, re.I)) for k, p in NAMES]
TAGS = "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th blockquote pre figure figcaption header footer nav aside form label button fieldset address span a #other".split()
BAD = frozenset(k for k, _ in NAMES[1:])
SPACE = re.compile(r"\s+")
BOILER_TAGS = frozenset(("nav", "aside", "footer", "form", "button", "label", "fieldset"))
#: Tags of which a node knows whether it lies within one.
TOLD = BOILER_TAGS | {"article", "main", "header"}
NOTHING: frozenset = frozenset()
#: Blocks of running text: inline elements in them are text, whatever their names say.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th blockquote pre figcaption".split())


class Node:
    __slots__ = ("tag", "parent", "children", "parts", "names", "own", "linked", "chars", "links", "stops", "inherited", "within")

    def __init__(self, tag: str, parent, names: frozenset):
        self.tag, self.parent, self.names = tag, parent, names
        self.children, self.parts = [], []
        self.own = self.linked = self.chars = self.links = self.stops = 0
        above = NOTHING if parent is None else parent.inherited
        self.inherited = above if names <= above else names | above
        around = NOTHING if parent is None else parent.within
        self.within = around | {tag} if tag in TOLD and tag not in around else around


@lru_cache(4096)
def _names(attributes: str) -> frozenset:
    if not attributes:
        return frozenset()
    found = []
    seen = set()
    for key, value in ATTRIBUTE.findall(attributes):
        key = key.lower()
        if key not in READ or key in seen:
            continue  # of repeated attributes the first counts
        seen.add(key)
        if key == "hidden":
            found.append("hidden")
        elif key == "aria-hidden":
            found += ["hidden"] * ("true" in value)
        else:
            found.append(value.strip("\"'"))
    text = " ".join(found)
    return frozenset(k for k, p in NAMED if p.search(text))


def parse(page: str) -> list[Node]:
    """The nodes of a page, parents first. A node's ``parts`` are its own strings and child nodes in page order."""
    root = Node("html", None, frozenset())
    nodes, stack, links, at, end = [root], [(root.tag, root)], 0, 0, len(page)
    counts: dict[str, int] = {}

    def add(raw: str) -> None:
        nonlocal links
        if raw:
            node = stack[-1][1]
            text = entities.unescape(raw) if "&" in raw else raw
            node.parts.append(text)
            n = len(text) - text.count(" ")
            node.own += n
            node.linked += n if links else 0
            node.stops += text.count(".") + text.count(",")

    def pop_to(k: int) -> None:
        nonlocal links
        links -= sum(1 for t, _ in stack[k:] if t == "a")
        for t, _ in stack[k:]:
            counts[t] -= 1
        del stack[k:]

    while at < end:
        m = TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if m[1] is not None:
            add(m[1])
        if not m[3]:
            continue
        tag = m[3].lower()
        if m[2]:
            for k in range(len(stack) - 1, 0, -1) if counts.get(tag) else ():
                if stack[k][0] == tag:
                    pop_to(k)
                    break
                if tag in INLINE and stack[k][0] not in INLINE:
                    break
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*(?:>|\Z)", re.I).search(page, at)
            if not m[4].rstrip().endswith("/"):
                at = close.end() if close else end if tag in TO_END else at
            continue
        if tag == "html":
            continue
        if tag in VOID:
            if tag == "br" or tag == "wbr":
                stack[-1][1].parts.append("\n" if tag == "br" else "")
            elif tag == "hr":
                node = stack[-1][1]
                node.parts.append(None)
            continue
        if tag == "head":
            continue
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    pop_to(k)
                    break
                if stack[k][0] not in INLINE:
                    break
        if tag in SAME:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in SAME[tag]:
                    pop_to(k)
                    if tag not in ("tr", "tbody", "tfoot"):
                        break
                elif stack[k][0] in SCOPE:
                    break
        names = _names(m[4]) if m[4] else frozenset()
        parent = stack[-1][1]
        counts[tag] = counts.get(tag, 0) + 1
        if tag in INLINE and (parent.tag in TEXTUAL or not (names & BAD)):
            stack.append((tag, parent))
        else:
            node = Node(tag, parent, names)
            parent.children.append(node)
            parent.parts.append(node)
            nodes.append(node)
            stack.append((tag, node))
        if tag == "a":
            links += 1
    for node in reversed(nodes):
        node.chars += node.own
        node.links += node.linked
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.links += node.links
            node.parent.stops += node.stops
    return nodes


NUMBER = {t: i for i, t in enumerate(TAGS)}
OWN_AT = len(TAGS)
ABOVE_AT = OWN_AT + len(NAMES)
REST_AT = ABOVE_AT + len(NAMES)
NAME_NUMBER = {k: i for i, (k, _) in enumerate(NAMES)}
N_FEATURES = REST_AT + 16


def describe(node: Node, total: int) -> list[tuple[int, float]]:
    """Sparse features of a node."""
    out = [(NUMBER.get(node.tag, len(TAGS) - 1), 1.0)]
    out += [(OWN_AT + NAME_NUMBER[k], 1.0) for k in node.names]
    if node.parent is not None:
        out += [(ABOVE_AT + NAME_NUMBER[k], 1.0) for k in node.parent.inherited]
    chars = node.chars
    density = node.links / chars if chars else 0.0
    tags = node.within
    at = REST_AT
    out += [(at, 1.0), (at + 1, density), (at + 2, log1p(chars) / 6), (at + 3, min(3.0, 20 * node.stops / (chars + 20))), (at + 4, chars / (total + 1))]
    if density > 0.6:
        out.append((at + 5, 1.0))
    if not chars:
        out.append((at + 6, 1.0))
    if "article" in tags or "main" in tags:
        out.append((at + 7, 1.0))
    if tags & BOILER_TAGS:
        out.append((at + 8, 1.0))
    if "header" in tags:
        out.append((at + 9, 1.0 if "article" not in tags else 0.3))
    if chars < 40:
        out.append((at + 10, 1.0))
    if node.own > 80:
        out.append((at + 11, 1.0))
    if (node.names | node.inherited) & BAD:
        out.append((at + 12, 1.0))
    return out


def kind(node: Node) -> int:
    """The edge class of a child: boilerplate by name or tag, container, heading or text."""
    if node.names & BAD or node.tag in BOILER_TAGS:
        return 0
    if node.tag in ("div", "section", "main", "article", "body", "header", "ul", "ol", "table", "figure"):
        return 1
    return 2 if node.tag in ("h1", "h2", "h3", "h4", "h5", "h6") else 3


def messages(unary: list[float], up_at: list[int], tables: list) -> tuple[list[float], list[float], list[float]]:
    """(log odds of each node, those without its parent's part, messages to the parents): sum-product on a tree whose parents
    come first, up from the leaves and down from the root."""
    inner, message = list(unary), [0.0] * len(unary)
    for i in range(len(unary) - 1, 0, -1):
        (e00, e01), (e10, e11) = tables[i]
        x = inner[i]
        message[i] = _lse(e10, e11 + x) - _lse(e00, e01 + x)
        inner[up_at[i]] += message[i]
    belief = list(inner)
    for i in range(1, len(unary)):
        (e00, e01), (e10, e11) = tables[i]
        x = belief[up_at[i]] - message[i]
        belief[i] += _lse(e01, e11 + x) - _lse(e00, e10 + x)
    return belief, inner, message


def sigmoid(x: float) -> float:
    return 1 / (1 + exp(-max(-40.0, min(40.0, x))))


class Model:
    def __init__(self, weights: np.ndarray, edges: np.ndarray):
        self.w, self.edges = weights.tolist(), edges.tolist()

    def marginals(self, nodes: list[Node]) -> list[float]:
        """The probability of content of each node."""
        total, w = nodes[0].chars, self.w
        unary = [sum(w[k] * v for k, v in describe(n, total)) for n in nodes]
        belief, _, _ = messages(unary, parents(nodes), [self.edges[kind(n)] for n in nodes])
        return [sigmoid(b) for b in belief]


def parents(nodes: list[Node]) -> list[int]:
    place = {id(n): i for i, n in enumerate(nodes)}
    return [-1 if n.parent is None else place[id(n.parent)] for n in nodes]


def together(w: np.ndarray, edges: np.ndarray, pages: list[tuple], epochs: int = 20, rate: float = 0.02) -> Model:
    """Unary and edge potentials fitted to the joint likelihood of the pages' labels. ``pages``: (features (n, N_FEATURES),
    place of each parent, kind of each edge, labels)."""
    theta = np.concatenate([w, edges.ravel()])
    m, s, step = np.zeros_like(theta), np.zeros_like(theta), 0
    start = theta.copy()
    for _ in range(epochs):
        for x, up_at, kinds, labels in pages:
            e = theta[len(w) :].reshape(edges.shape)
            listed = e.tolist()
            belief, inner, message = messages((x @ theta[: len(w)]).tolist(), up_at, [listed[k] for k in kinds])
            g = np.zeros_like(theta)
            g[: len(w)] = x.T @ (labels - 1 / (1 + np.exp(-np.clip(belief, -40, 40))))
            if len(labels) > 1:
                up, k, y = np.array(up_at[1:]), np.array(kinds[1:]), labels.astype(int)
                # The pair's log weights: the edge, the child without its parent, the parent without this child.
                pair = e[k] + np.array(inner[1:])[:, None, None] * [[0, 1], [0, 1]] + (np.array(belief)[up] - np.array(message[1:]))[:, None, None] * [[0, 0], [1, 1]]
                pair = np.exp(pair - pair.max(axis=(1, 2), keepdims=True))
                expected = pair / pair.sum(axis=(1, 2), keepdims=True)
                expected[np.arange(len(k)), y[up], y[1:]] -= 1
                own = np.zeros(edges.shape)
                np.subtract.at(own, k, expected)
                g[len(w) :] = own.ravel()
            g = g / len(labels) - 1e-3 * (theta - start)
            step += 1
            m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
            theta = theta + rate / epochs * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)
    return Model(theta[: len(w)], theta[len(w) :].reshape(edges.shape))


def _lse(a: float, b: float) -> float:
    return a + log1p(exp(b - a)) if a > b else b + log1p(exp(a - b))


def blocks(nodes: list[Node], content: list[bool]) -> list[str]:
    """The blocks of content nodes in page order; a child node ends its parent's block unless it is an inline one."""
    place = {id(n): i for i, n in enumerate(nodes)}
    out, buffer = [], []

    def flush() -> None:
        text = SPACE.sub(" ", "".join(buffer)).strip()
        buffer.clear()
        if text:
            out.append(text)

    stack = [(nodes[0], iter(nodes[0].parts))]
    while stack:
        node, parts = stack[-1]
        keep = content[place[id(node)]]
        for part in parts:
            if part is None:
                flush()
            elif isinstance(part, str):
                if keep:
                    buffer.append(part)
            else:
                if part.tag not in INLINE:
                    flush()
                stack.append((part, iter(part.parts)))
                break
        else:
            stack.pop()
            if node.tag not in INLINE:
                flush()
    flush()
    return out


def extract(page: str | None, model: Model) -> str:
    if not page:
        return ""
    nodes = parse(page)
    if not nodes[0].chars:
        return ""
    if len(nodes) == 1:
        return "\n\n".join(blocks(nodes, [True]))
    return "\n\n".join(blocks(nodes, [m >= 0.5 for m in model.marginals(nodes)]))


# Labelled pages -------------------------------------------------------------------------------------------------------

SYLLABLES = "an be ca do el fi go ha in jo ka le mo na or pe qui re sa to un ve wi xo ya zu th er on st ing ion".split()


def _words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(n))


def _sentences(rng: random.Random, n: int) -> str:
    return " ".join((_words(rng, rng.randint(1, 14)).capitalize() + rng.choice([".", ".", "!", ",", "?"])) for _ in range(n))


def _tag(tag: str, names: str, inner: str, label: int) -> str:
    mark = f' data-y="{label}"'
    return f"<{tag}{names}{mark}>{inner}</{tag}>"


def labelled_page(rng: random.Random) -> str:
    """A page of a random layout; data-y tells each block's label."""
    pick, some = rng.choice, lambda p: rng.random() < p

    def named(*options: str) -> str:
        o = pick(options)
        return f' {pick(["class", "class", "id"])}="{o}"' if o else ""

    def links(n: int, label: int) -> str:
        return _tag("ul", "", "".join(_tag("li", "", f'<a href="/{i}">{_words(rng, rng.randint(1, 4))}</a>', label) for i in range(n)), label)

    def paragraph(label: int = 1) -> str:
        text = _sentences(rng, pick([1, 1, 2, 4, 8]))
        if some(0.2):
            text = f"<b>{text}<br>" if some(0.5) else f'{text} <a href="#">{_words(rng, 2)}</a> {_sentences(rng, 1)} <em>{_words(rng, 2)}</em>.'
        return f'<p data-y="{label}">{text}' + ("</p>" if some(0.8) else "")

    def boiler() -> str:
        what = rng.randint(0, 11)
        if what == 0:
            return _tag(pick(["nav", "nav", "div", "ul"]), named("nav", "menu", "main-menu", "breadcrumbs", "pagination", ""), links(rng.randint(2, 8), 0), 0)
        if what == 1:
            return _tag(pick(["div", "aside", "section"]), named("ad", "ads", "advert", "ad-slot", "sponsored", "promo", "banner-ad"), pick([_sentences(rng, rng.randint(1, 3)), paragraph(0), f'<a href="/x">{_words(rng, 5)}</a>']), 0)
        if what == 2:
            return _tag(pick(["aside", "div"]), named("sidebar", "side", "widget", "right-rail") if some(0.8) else "", _tag("h3", "", _words(rng, 2), 0) + links(rng.randint(2, 6), 0) + (paragraph(0) if some(0.4) else ""), 0)
        if what == 3:
            return _tag(pick(["div", "section", "aside"]), named("cookie", "cookie-notice", "notice", "alert", "consent-banner", "newsletter", "subscribe-box"), pick([_sentences(rng, 2), paragraph(0)]) + (_tag("button", "", _words(rng, 1), 0) if some(0.5) else ""), 0)
        if what == 4:
            return _tag("form", named("search", "login", "signup", ""), _tag("label", "", _words(rng, 2), 0) + '<input type="text">' + _tag("button", "", _words(rng, 1), 0) + (paragraph(0) if some(0.3) else ""), 0)
        if what == 5:
            return _tag("div", named("share", "social", "related", "recommended", "tags"), links(rng.randint(2, 5), 0), 0)
        return ""

    def article() -> str:
        parts = [_tag(pick(["h1", "h1", "h2"]), "", _words(rng, rng.randint(2, 9)).capitalize(), 1)] if some(0.9) else []
        if some(0.25):
            parts = [_tag("header", "", "".join(parts) + (_tag("p", "", _sentences(rng, 1), 1) if some(0.4) else ""), 1)]
        for _ in range(rng.randint(1, 12)):
            r = rng.random()
            if r < 0.75:
                parts.append(paragraph())
            elif r < 0.82:
                parts.append(_tag(pick(["h2", "h3"]), "", _words(rng, rng.randint(1, 6)), 1))
            elif r < 0.88:
                parts.append(_tag(pick(["ul", "ol"]), "", "".join(_tag("li", "", _sentences(rng, 1), 1) for _ in range(rng.randint(2, 5))), 1))
            elif r < 0.91:
                parts.append(_tag("blockquote", "", paragraph(), 1))
            elif r < 0.93:
                parts.append(_tag("pre", "", _words(rng, 12), 1))
            elif r < 0.95:
                parts.append(_tag("table", "", "".join(_tag("tr", "", "".join(_tag("td", "", _words(rng, 2), 1) for _ in range(3)), 1) for _ in range(2)), 1))
            elif r < 0.96:
                parts.append(_tag("figure", "", "<img src=x>" + _tag("figcaption", "", _sentences(rng, 1), 1), 1))
            else:
                parts.append(boiler())
        tag, names = pick([("article", ""), ("article", ""), ("article", named("post", "entry")), ("main", ""), ("div", named("content", "article-body", "post-content", "entry", "story", "main-text")), ("section", named("content", "article", "")), ("div", "")])
        return _tag(tag, names, "".join(parts), 1)

    def comments() -> str:
        one = lambda: _tag(pick(["div", "li", "article"]), named("comment", "reply", "comment-body", ""), paragraph(0), 0)
        return _tag(pick(["section", "div", "ol"]), named("comments", "comment-list", "discussion", "disqus_thread", "responses"), (_tag("h3", "", _words(rng, 1), 0) if some(0.6) else "") + "".join(one() for _ in range(rng.randint(1, 5))), 0)

    top = [boiler() for _ in range(rng.randint(0, 4))]
    if some(0.6):
        top.insert(0, _tag(pick(["header", "header", "div"]), named("header", "site-header", "masthead", "top"), pick([_tag("h1", "", _words(rng, 2), 0), _tag("div", named("logo", "site-title"), _words(rng, 2), 0), _words(rng, 3)]) + (_tag("nav", "", links(4, 0), 0) if some(0.5) else ""), 0))
    middle = [article()]
    if some(0.4):
        middle.append(comments())
    middle += [boiler() for _ in range(rng.randint(0, 3))]
    if some(0.3):
        middle.insert(0, boiler())
    inner = "".join(middle)
    if some(0.4):
        inner = _tag(pick(["div", "main"]), named("wrapper", "container", "page", "main", ""), inner, 1)
    bottom = _tag(pick(["footer", "footer", "div"]), named("footer", "site-footer", "copyright"), pick([f"&copy; {_words(rng, 2)} &middot; {_sentences(rng, 1)}", paragraph(0), links(3, 0) + _sentences(rng, 1)]), 0) if some(0.8) else ""
    return f"<html><head><title>x</title></head><body>{''.join(top)}{inner}{bottom}</body></html>"


LABEL = re.compile(r'\s*data-y="([01])"')


@lru_cache(1)
def trained(pages: int = 800, seed: int = 11, steps: int = 300) -> Model:
    """The model, from ``pages`` labelled pages; the same for the same arguments."""
    rng = random.Random(seed)
    rows, y, pairs, each = [], [], np.ones((4, 2, 2)), []
    for _ in range(pages):
        page = labelled_page(rng)
        nodes, labels = parse(LABEL.sub("", page)), []
        for node in _labels(page):
            labels.append(node)
        total = nodes[0].chars
        up_at, kinds = parents(nodes), [kind(n) for n in nodes]
        each.append((len(rows), up_at, kinds))
        for i in range(1, len(nodes)):
            pairs[kinds[i], labels[up_at[i]], labels[i]] += 1
        for node, label in zip(nodes, labels):
            rows.append(describe(node, total))
            y.append(label)
    x = np.zeros((len(rows), N_FEATURES), np.float32)
    for i, row in enumerate(rows):
        for k, v in row:
            x[i, k] = v
    t, w, m, s = np.array(y, np.float32), np.zeros(N_FEATURES), np.zeros(N_FEATURES), np.zeros(N_FEATURES)
    for step in range(1, steps + 1):  # Adam on the logistic loss
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - t) / len(t) + 1e-4 * w
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    joint = pairs / pairs.sum(axis=(1, 2), keepdims=True)
    independent = joint.sum(axis=2, keepdims=True) * joint.sum(axis=1, keepdims=True)
    whole = [(x[at : at + len(up_at)], up_at, kinds, t[at : at + len(up_at)]) for at, up_at, kinds in each[::2]]
    return together(w, np.log(joint / independent), whole)


def _labels(page: str) -> list[int]:
    """The labels in the order of the nodes of ``parse``; wrappers without one count as content."""
    out = []
    keep = re.compile(r"<([a-zA-Z][^\s/>]*)([^>]*)>")
    out.append(1)
    for m in keep.finditer(page):
        tag = m[1].lower()
        if tag in ("html", "head", "title") or tag in VOID or tag in RAW:
            continue
        if tag in INLINE and not (_names(LABEL.sub("", m[2])) & BAD):
            continue
        found = LABEL.search(m[2])
        out.append(int(found[1]) if found else 1)
    return out


def main_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with text, the main text of each whole page."""
    keep = [c for c in pages.columns if c != "text"]
    rows = pages.select(*keep)
    sent = pages.sparkSession.sparkContext.broadcast(trained())

    def run(batches):
        model = sent.value
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                texts = [extract(p, model) for p in part.column(part.schema.get_field_index(html)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*keep, "text"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("text", T.StringType())]))


__all__ = ["Model", "extract", "labelled_page", "main_text", "parse", "trained"]
