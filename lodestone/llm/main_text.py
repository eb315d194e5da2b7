"""Main text of web pages by a tree-structured graphical model.

A page becomes a tree: its block-level elements, and as leaves its runs of inline text.  Every node has a hidden mark, content
or not; an element is content if some leaf under it is.  Potentials of nodes come from their markup and the shape of the text
under them, potentials of edges from the marks of parent and child.  Sum-product messages up and down the tree give exact
marginals, and leaves whose marginal is at least one half are the text.  The potentials are trained, by the same messages, as
a conditional likelihood on labelled pages: pages of the table that mark their article, and made-up ones.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import giving_back, text_of

# --- pages to trees ---------------------------------------------------------------------------------------------------

#: Elements that end a run of inline text where they begin and where they end (fixed values of HTML's rendering).
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre "
    "search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose content is never text of the page: programs, styles, embedded objects, controls of forms, the head's title.
SILENT = frozenset("script style noscript template iframe svg canvas object audio video textarea select button datalist title noembed noframes".split())
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What a new element of a kind closes, if it is open and no element of the second set stands between.
_ROWS = frozenset(["tr", "td", "th"])
CLOSES = {
    **dict.fromkeys(BLOCKS - {"body", "html"}, (frozenset(["p"]), frozenset(["table", "td", "th", "li", "div", "article", "section", "aside", "main", "blockquote", "form", "footer", "header", "nav"]))),
    "li": (frozenset(["li", "p"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd", "p"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd", "p"]), frozenset(["dl"])),
    "td": (frozenset(["td", "th", "p"]), frozenset(["table", "tr"])),
    "th": (frozenset(["td", "th", "p"]), frozenset(["table", "tr"])),
    "tr": (_ROWS | {"p"}, frozenset(["table"])),
}

#: A comment, a declaration, or a tag with its attributes; what is cut off at the page's end still counts.
_MARKUP = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))*+)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|style|hidden|aria-hidden)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]*)))?""", re.I | re.S)
_NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Page:
    """Nodes in page order, parents before children: parent (-1 at the root), tag, names (words of class, id and role), and for
    leaves text and the number of its characters inside links, else None and 0."""

    def __init__(self) -> None:
        self.parent, self.tag, self.names, self.text, self.linked = [-1], ["html"], [()], [None], [0]

    def add(self, parent: int, tag: str, names: tuple[str, ...] = (), text: str | None = None, linked: int = 0) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.names.append(names)
        self.text.append(text)
        self.linked.append(linked)
        return len(self.parent) - 1


def _names(attributes: str) -> tuple[str, ...]:
    out = []
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        value, key = html.unescape(a or b or c), key.lower()
        if key in ("class", "id", "role"):
            out += [w.lower() for w in _NAME_WORDS.findall(value)[:12]]
        elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            out.append("(hidden)")
    return tuple(dict.fromkeys(out))


def parse(source: str) -> Page:
    """The tree of a page, in one pass over its markup and in linear time.  A less-than sign that begins no markup is text."""
    page = Page()
    stack = [(0, "html")]
    run: list[str] = []  # of inline text, references decoded
    state = [0, 0]  # open links; characters of the run inside links

    def flush() -> None:
        text = " ".join("".join(run).split())
        if text:
            page.add(stack[-1][0], "#text", (), text, min(state[1], len(text)))
        run.clear()
        state[1] = 0

    def say(piece: str) -> None:
        if piece:
            piece = html.unescape(piece) if "&" in piece else piece
            run.append(piece)
            if state[0]:
                state[1] += len(piece.strip())

    def close(tags: frozenset[str], walls: frozenset[str]) -> None:
        for depth in range(len(stack) - 1, max(0, len(stack) - 60), -1):
            if stack[depth][1] in tags:
                del stack[depth:]
                break
            if stack[depth][1] in walls:
                break

    at, size = 0, len(source)
    while at < size:
        m = _MARKUP.search(source, at)
        if m is None:
            say(source[at:])
            break
        say(source[at : m.start()])
        at = m.end()
        end, tag = m[1], (m[2] or "").lower()
        if not tag:
            continue
        if tag in SILENT and not end:
            if m[3].endswith("/") and tag in ("svg", "canvas"):
                continue
            closing = re.compile(rf"</{tag}(?=[\s/>])[^>]*+>?", re.I).search(source, at)
            at = closing.end() if closing else size
            run.append(" ")
        elif tag == "a":
            state[0] = 0 if end else 1
        elif tag == "br":
            run.append(" ")
        elif tag == "head" or tag not in BLOCKS:
            continue
        elif end:
            flush()
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][1] == tag:
                    del stack[depth:]
                    break
            state[0] = 0
        else:
            flush()
            if tag in CLOSES:
                close(*CLOSES[tag])
            if tag == "html":
                continue
            if tag not in VOID and len(stack) < 400:  # deeper elements join the one they stand in
                stack.append((page.add(stack[-1][0], tag, _names(m[3]) if m[3] else ()), tag))
    flush()
    return page


def pruned(page: Page) -> tuple[np.ndarray, list[int]]:
    """Parents of the nodes that are text or have some under them, renumbered, and their old numbers."""
    n = len(page.parent)
    live = [t is not None for t in page.text]
    for v in range(n - 1, 0, -1):
        if live[v]:
            live[page.parent[v]] = True
    old = [v for v in range(n) if live[v]]
    new = {v: k for k, v in enumerate(old)}
    return np.array([new.get(page.parent[v], -1) for v in old], np.int64), old


# --- features ---------------------------------------------------------------------------------------------------------

#: Width of the table of weights; features are hashed into it.
WIDTH = 1 << 13
#: Kinds of edges by the child: a leaf, a grouping element, any other element.
GROUPS = frozenset("article aside body div footer form header main nav section table ul ol dl fieldset".split())
_STOPS = re.compile(r"[.!?。！？…]")


class _Slots(dict):
    """Features to columns; emptied when it holds 100,000."""

    def __missing__(self, key: str) -> int:
        if len(self) >= 100_000:
            self.clear()
        self[key] = out = crc32(key.encode()) % WIDTH
        return out


def _bin(x: float) -> int:
    """The number of bits; all from 1,024 on are one bin, so that no length is unlike what was trained on."""
    return min(11, int(x).bit_length())


def features(page: Page, slots: _Slots) -> tuple[list[int], list[int], np.ndarray, np.ndarray, list[int]]:
    """Columns of all nodes in one list, how many each node has, parents, kinds of edges, and the nodes' numbers in the page."""
    parent, old = pruned(page)
    n = len(old)
    chars, linked, stops, leaves, size = [0] * n, [0] * n, [0] * n, [0] * n, parent.tolist()
    for k in range(n - 1, -1, -1):
        text = page.text[old[k]]
        if text is not None:
            chars[k], linked[k], stops[k], leaves[k] = len(text), page.linked[old[k]], len(_STOPS.findall(text)), 1
        if size[k] >= 0:
            for total in (chars, linked, stops, leaves):
                total[size[k]] += total[k]
    flat, ends = [], []
    for k, v in enumerate(old):
        tag, up = page.tag[v], page.tag[old[size[k]]] if size[k] >= 0 else ""
        density = int(4 * linked[k] / chars[k] + 0.5)
        shape = f"{_bin(chars[k])}"
        own = ["1", f"t{tag}"]
        if tag == "#text":
            text = page.text[v]
            own += [f"u{up}", f"l{shape}", f"d{density}", f"s{min(3, stops[k])}", f"us{up}{min(1, stops[k])}", f"ul{up}{_bin(chars[k]) // 2}", f"ud{up}{density}"]
            if text[0] in "©®™" or "©" in text:
                own.append("©")
        else:
            own += [f"a{w}" for w in page.names[v]]
            own += [f"D{density}", f"tD{tag}{density}", f"L{shape}", f"S{_bin(100 * stops[k] / chars[k])}", f"n{_bin(leaves[k])}"]
            if not page.names[v]:
                own.append("noname")
        if size[k] >= 0:
            own += [f"p{w}" for w in page.names[old[size[k]]]]
        flat += [slots[f] for f in own]
        ends.append(len(own))
    kind = np.array([0 if page.tag[v] == "#text" else 1 if page.tag[v] in GROUPS else 2 for v in old], np.int64)
    return flat, ends, parent, kind, old


class Forest:
    """Trees side by side, ordered by depth so that messages pass level by level."""

    def __init__(self, pages: list[Page]) -> None:
        slots = _Slots()
        flat, ends, parents, kinds, self.old, self.starts, at = [], [], [], [], [], [0], 0
        for page in pages:
            f, e, parent, kind, old = features(page, slots)
            flat += f
            ends += e
            parents.append(np.where(parent >= 0, parent + at, -1))
            kinds.append(kind)
            self.old.append(old)
            at += len(old)
            self.starts.append(at)
        self.flat, self.ends = np.array(flat, np.int64), np.array(ends, np.int64)
        self.of = np.repeat(np.arange(at), self.ends)
        self.parent = np.concatenate(parents) if parents else np.zeros(0, np.int64)
        self.kind = np.concatenate(kinds) if kinds else np.zeros(0, np.int64)
        self.size = at
        depth = np.zeros(at, np.int64)
        inner = self.parent >= 0
        todo = np.flatnonzero(inner)
        while len(todo):  # one round for each level
            deeper = depth[self.parent[todo]] + 1
            changed = deeper != depth[todo]
            depth[todo] = deeper
            todo = todo[changed]
        order = np.argsort(depth, kind="stable")
        cuts = np.searchsorted(depth[order], np.arange(1, depth.max(initial=0) + 2))
        self.levels = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:])]  # of depth 1, 2, ...


def marginals(forest: Forest, unary: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Sum-product in both directions: P(content) of each node, P of (parent, child) marks of each edge, and the sum of log Z.

    unary is the log potential of content (that of no content is 0); pair[kind, parent's mark, child's mark] that of an edge.
    """
    n = forest.size
    below = np.zeros((n, 2))  # log potential of a node with all that is under it
    below[:, 1] = unary
    up = np.zeros((n, 2))  # message to the parent
    for level in reversed(forest.levels):
        edge, b = pair[forest.kind[level]], below[level]
        for mark in (0, 1):
            up[level, mark] = np.logaddexp(edge[:, mark, 0] + b[:, 0], edge[:, mark, 1] + b[:, 1])
        to = forest.parent[level]
        for mark in (0, 1):
            below[:, mark] += np.bincount(to, up[level, mark], n)
    down = np.zeros((n, 2))  # message from the parent
    for level in forest.levels:
        to, edge = forest.parent[level], pair[forest.kind[level]]
        rest = below[to] + down[to] - up[level]  # the parent without this child
        for mark in (0, 1):
            down[level, mark] = np.logaddexp(edge[:, 0, mark] + rest[:, 0], edge[:, 1, mark] + rest[:, 1])
        down[level] -= down[level].max(axis=1, keepdims=True)  # scale is free, and would grow with depth
    total = below + down
    content = 1 / (1 + np.exp(np.clip(total[:, 0] - total[:, 1], -500, 500)))
    inner = np.flatnonzero(forest.parent >= 0)
    to = forest.parent[inner]
    joint = (below[to] + down[to] - up[inner])[:, :, None] + pair[forest.kind[inner]] + below[inner][:, None, :]
    joint -= joint.max(axis=(1, 2), keepdims=True)
    joint = np.exp(joint)
    joint /= joint.sum(axis=(1, 2), keepdims=True)
    roots = np.flatnonzero(forest.parent < 0)
    return content, joint, float(np.logaddexp(below[roots, 0], below[roots, 1]).sum())


class Model:
    """Weights of node features and log potentials of edges."""

    def __init__(self, weights: np.ndarray, pair: np.ndarray) -> None:
        self.weights, self.pair = weights, pair

    def unary(self, forest: Forest) -> np.ndarray:
        return np.bincount(forest.of, self.weights[forest.flat], forest.size)

    def texts(self, sources: list[str], threshold: float = 0.5) -> list[str]:
        """The main text of each page."""
        pages = [parse(s) for s in sources]
        forest = Forest(pages)
        content = marginals(forest, self.unary(forest), self.pair)[0]
        out = []
        for page, old, start in zip(pages, forest.old, forest.starts):
            out.append("\n".join(page.text[v] for k, v in enumerate(old) if page.text[v] is not None and content[start + k] >= threshold))
        return out


def spread_up(page: Page, old: list[int], leaf: list[bool]) -> list[bool]:
    """Marks of the nodes in old: leaves as given by page number, elements content if a leaf under them is."""
    mark = list(leaf)
    for v in range(len(page.parent) - 1, 0, -1):
        if mark[v]:
            mark[page.parent[v]] = True
    return [mark[v] for v in old]


def fit(labelled: list[tuple[Page, list[bool]]], *, steps: int = 150, rate: float = 0.15, ridge: float = 1.0) -> Model:
    """Full-batch Adam on the conditional log-likelihood with a ridge penalty: observed less expected features, by sum-product."""
    forest = Forest([p for p, _ in labelled])
    y = np.array([m for (page, leaf), old in zip(labelled, forest.old) for m in spread_up(page, old, leaf)], float)
    inner = np.flatnonzero(forest.parent >= 0)
    kind, a, b = forest.kind[inner], y[forest.parent[inner]].astype(int), y[inner].astype(int)
    seen = np.zeros((3, 2, 2))
    np.add.at(seen, (kind, a, b), 1)
    theta, k = np.zeros(WIDTH + 12), max(len(labelled), 1)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        unary = np.bincount(forest.of, theta[forest.flat], forest.size)
        content, joint, _ = marginals(forest, unary, theta[WIDTH:].reshape(3, 2, 2))
        expected = np.stack([np.array([np.bincount(kind, joint[:, i, j], 3) for j in (0, 1)]) for i in (0, 1)]).transpose(2, 0, 1)
        g = np.concatenate([np.bincount(forest.flat, (content - y)[forest.of], WIDTH), (expected - seen).ravel()])
        g = (g + ridge * theta) / k
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return Model(theta[:WIDTH], theta[WIDTH:].reshape(3, 2, 2))


# --- labelled pages ---------------------------------------------------------------------------------------------------

#: Elements, and words of class, id or role, that are no text of an article even inside one.
APART_TAGS = frozenset(["nav", "aside", "footer", "form", "menu", "dialog"])
APART_WORDS = (
    "ad ads advert advertisement advertising banner breadcrumb breadcrumbs byline captcha comment comments consent contentinfo cookie cookies disqus footer "
    "login menu meta modal nav navbar navigation newsletter notice pager pagination popup promo promoted related replies reply respond search share sharing "
    "sidebar signup skip social sponsor sponsored subscribe tags teaser toolbar topbar widget complementary alert dialog"
).split()
_APART = frozenset(APART_WORDS)


def labels_of(page: Page) -> list[bool] | None:
    """Which nodes are text of the article, by the page's own markup; None if it doesn't mark exactly one outermost article or main."""
    n = len(page.parent)
    inside, apart, tops = [False] * n, [False] * n, 0
    for v in range(1, n):
        p, tag = page.parent[v], page.tag[v]
        own = tag in ("article", "main") or "main" in page.names[v] and page.tag[v] != "#text" and "role" in page.names[v]
        if own and not inside[p]:
            tops += 1
        inside[v] = inside[p] or own
        header = tag == "header" and not (inside[p] and not apart[p])
        apart[v] = apart[p] or header or tag in APART_TAGS or not _APART.isdisjoint(page.names[v]) or "(hidden)" in page.names[v]
    return [inside[v] and not apart[v] and page.text[v] is not None for v in range(n)] if tops == 1 else None


class Writer:
    """Made-up pages with their labels: seeded layouts in the manners of common sites, of words without meaning."""

    def __init__(self, seed: int) -> None:
        self.draw = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        d = self.draw
        return " ".join("".join(d.choices("etaoinshrdlucmfwypéüñо的", k=d.randint(1, 9))) for _ in range(d.randint(low, high)))

    def sentence(self, low: int = 4, high: int = 24) -> str:
        return self.words(low, high).capitalize() + self.draw.choice("...?!")

    def prose(self, most: int = 6) -> str:
        return " ".join(self.sentence() for _ in range(self.draw.randint(1, most)))

    def link(self) -> str:
        return f'<a href="/{self.draw.getrandbits(20)}">{self.words(1, 4)}</a>'

    def element(self, tag: str, names: list[str], inside: str) -> str:
        """The element, or in half of the pages that are `plain` a div, with one or two of the names, perhaps in a compound."""
        d = self.draw
        tag = "div" if self.plain and tag not in ("p", "ul", "ol", "table", "form") else tag
        if d.random() < (0.95 if tag in ("div", "ul", "p") else 0.4):
            name = d.choice(names)
            name = d.choice([name, name, name, f"{d.choice(['site', 'page', 'js', 'c', 'post', 'main' if tag == 'header' else 'block'])}-{name}", f"{name}-{d.choice(['box', 'wrap', 'list', 'area', 'inner'])}"])
            return f'<{tag} {d.choice(["class", "class", "id"])}="{name}">{inside}</{tag}>'
        return f"<{tag}>{inside}</{tag}>"

    def links(self, low: int = 3, high: int = 9) -> str:
        d = self.draw
        if d.random() < 0.7:
            return "<ul>" + "".join(f"<li>{self.link()}</li>" for _ in range(d.randint(low, high))) + "</ul>"
        return d.choice([" ", " | ", " · "]).join(self.link() for _ in range(d.randint(low, high)))

    def apart(self) -> str:
        """A part that is no text of the article."""
        d = self.draw
        say = lambda: d.choice([self.sentence(), self.prose(2), f"<p>{self.prose(2)}</p>", self.words(2, 6)])
        kind = d.randrange(9)
        if kind == 0:
            return self.element("nav", ["menu", "nav", "navigation", "navbar", "breadcrumb", "pagination"], self.links())
        if kind == 1:
            body = d.choice(["", f"<h3>{self.words(1, 3)}</h3>"]) + self.links() if d.random() < 0.4 else f"<h3>{self.words(1, 4)}</h3>" + d.choice([say(), self.links(), f"<p>{self.prose(3)}</p>"])
            return self.element("aside", ["sidebar", "related", "widget", "teaser", "promo", "complementary"], body)
        if kind == 2:
            return self.element("div", ["ad", "ads", "advert", "advertisement", "banner", "sponsored", "sponsor", "promo", "promoted"], say())
        if kind == 3:
            return self.element("div", ["notice", "cookie", "cookies", "consent", "alert", "popup", "modal", "dialog"], say() + d.choice(["", self.link(), "<button>ok</button>"]))
        if kind == 4:
            body = f"<label>{self.words(1, 4)}</label> <input name=q> {d.choice(['', self.sentence(), '<p>' + self.sentence() + '</p>'])}<button>{self.words(1, 2)}</button>"
            return f'<form class="{d.choice(["search", "login", "newsletter", "signup", "subscribe", "f"])}">{body}</form>'
        if kind == 5:
            one = lambda: d.choice(["<li>{}</li>", "<div>{}</div>", '<div class="reply">{}</div>', "<p>{}</p>", '<article class="comment">{}</article>']).format(d.choice(["<b>%s</b> " % self.words(1, 2), "", "<p>%s</p>" % self.words(1, 3)]) + d.choice([self.prose(5), f"<p>{self.prose(5)}</p>"]))
            said = "".join(one() for _ in range(d.randint(1, 6)))
            said = d.choice(["{}", "<ul>{}</ul>", "<ol>{}</ol>", "<div>{}</div>", '<ol class="comment-list">{}</ol>']).format(said)
            return self.element("section", ["comments", "comment", "replies", "disqus", "respond", "comments"], d.choice(["", f"<h3>{self.words(1, 3)}</h3>"]) + said)
        if kind == 6:
            return self.element("div", ["share", "sharing", "social", "tags", "meta", "byline", "toolbar"], d.choice([self.words(1, 6), self.links(2, 5)]))
        if kind == 7:
            return self.element("header", ["header", "banner", "topbar", "masthead"], d.choice([f"<h1>{self.link()}</h1>", f"<p>{self.words(2, 6)}</p>", self.words(1, 4)]) + d.choice(["", self.element("nav", ["menu", "nav"], self.links())]))
        return self.element("footer", ["footer", "contentinfo", "bottom", "copyright"], d.choice(["&copy; ", "© 2020 ", ""]) + d.choice([self.words(2, 8) + " " + self.prose(1), self.links(), f"<p>{self.prose(2)}</p>"]))

    def piece(self) -> str:
        """A part of the article; all its text is content."""
        d = self.draw
        kind = d.random()
        mixed = lambda: " ".join(d.choice([self.sentence(), self.sentence(), self.link() + " " + self.sentence(), f"<b>{self.words(1, 3)}</b> {self.sentence()}", f"<em>{self.sentence()}</em>"]) for _ in range(d.randint(1, 6)))
        if kind < 0.6:
            return f"<p>{mixed()}</p>" if d.random() < 0.8 else f"<p>{mixed()}"
        if kind < 0.66:
            return f"<p>{self.words(1, 4)}.</p>"
        if kind < 0.76:
            return f"<h{(h := d.randint(2, 4))}>{self.words(1, 7)}</h{h}>"
        if kind < 0.84:
            return "<ul>" + "".join(f"<li>{d.choice([self.sentence(), self.words(2, 8), self.link() + ' ' + self.sentence()])}</li>" for _ in range(d.randint(2, 6))) + "</ul>"
        if kind < 0.88:
            return f"<blockquote>{d.choice([self.prose(3), '<p>' + self.prose(3) + '</p>'])}</blockquote>"
        if kind < 0.92:
            return "<table>" + "".join(f"<tr><td>{self.words(1, 4)}</td><td>{self.words(1, 4)}</td></tr>" for _ in range(d.randint(2, 5))) + "</table>"
        if kind < 0.95:
            return f"<figure><img src=x><figcaption>{self.sentence()}</figcaption></figure>"
        return d.choice([f"<pre>{self.prose(2)}</pre>", f"<div>{mixed()}</div>", f"<section><h2>{self.words(1, 5)}</h2><p>{mixed()}</p></section>"])

    def page(self) -> tuple[Page, list[bool]]:
        """A page and its labels: parts of the article are written with a mark that is taken off after parsing."""
        d = self.draw
        self.plain = d.random() < 0.4
        some = lambda low, high: [self.apart() for _ in range(d.randint(low, high))]
        mark = "\x01"
        title = f"<h1>{self.words(2, 10)}</h1>"
        if d.random() < 0.2 and not self.plain:
            title = f"<header>{title}</header>"
        inside = [title] if d.random() < 0.9 else []
        for _ in range(d.randint(1, 14)):
            inside.append(self.piece())
        inside = [re.sub(r">(?=[^<])", f">{mark}", f"<i>{p}</i>" if not p.startswith("<") else p) for p in inside]
        for _ in range(d.choice([0, 0, 1, 2, 3])):
            inside.insert(d.randint(1, len(inside)), self.apart())
        body = "".join(inside)
        tag, names = d.choice([("article", ["post", "article", "entry", "story"]), ("main", ["content", "main", "body"]), ("div", ["content", "article", "post", "entry", "text", "story", "body"]), ("div", ["article-body", "post-content", "entry-content", "main"])])
        body = self.element(tag, names, body)
        if d.random() < 0.3:
            body = self.element(d.choice(["main", "div", "section"]), ["content", "main", "page", "container", "row"], body + "".join(some(0, 2)))
        parts = [*some(0, 4), body, *some(0, 4)]
        if d.random() < 0.5:
            parts = [f'<div class="{d.choice(["wrapper", "container", "page", "row", "grid"])}">', *parts, "</div>"]
        page = parse(f"<html><head><title>{self.words(2, 8)}</title></head><body>{''.join(parts)}</body></html>")
        leaf = [t is not None and mark in t for t in page.text]
        page.text = [t and t.replace(mark, "") or (t and " ") for t in page.text]
        return page, leaf


def train(pages: DataFrame, *, html_col: str = "html", max_pages: int = 400, max_chars: int = 30_000, made_up: int = 700, seed: int = 42, **how) -> Model:
    """Fits the model to at most max_pages pages that mark one article, none of over max_chars, and to made-up ones.

    The sample is the first pages in a seeded order of their contents; without any, only made-up ones are used.  Each is taken once
    as it is and once with its grouping elements turned into nameless ones or divs, so that other signs are learned too.
    """
    source, key = F.col(html_col), F.xxhash64(html_col, F.lit(seed)).alias("k")
    marked = pages.where(source.isNotNull() & (F.length(source) <= max_chars) & (F.instr(F.lower(source), "<article") + F.instr(F.lower(source), "<main") > 0))
    first = marked.select(key).distinct().orderBy("k").limit(max_pages)  # hashes alone are shuffled
    rows = marked.select(key, source.alias("h")).join(F.broadcast(first), "k").groupBy("k").agg(F.min("h").alias("h")).orderBy("k").collect()  # max_pages of max_chars at most
    labelled = []
    for r in rows:
        page = parse(r["h"])
        leaf = labels_of(page)
        if leaf is not None:
            labelled.append((page, leaf))
            bare = parse(re.sub(r"<(/?)(article|main|section|footer|header|nav|aside)\b", r"<\1div", r["h"]))
            if len(bare.text) == len(page.text) and crc32(r["h"].encode()) % 2:
                labelled.append((bare, leaf))
    writer = Writer(seed)
    labelled += [writer.page() for _ in range(made_up)]
    return fit(labelled, **how)


def extract(pages: DataFrame, model: Model, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = 0.5, batch_chars: int = 4_000_000) -> DataFrame:
    """One row per input row: page_id, url, text, n_chars (code points of the text).

    Null and empty pages, and pages without text or without content, give an empty text.  Every text run of a page is judged, however long
    it is; runs are never cut.  Repeated rows and null ids or urls are kept; other columns are not read.  Pages are handled in groups of
    about batch_chars characters.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                sources, size = [], 0
                while at + len(sources) < batch.num_rows and (not sources or size < batch_chars):
                    sources.append(batch.column(2)[at + len(sources)].as_py())
                    size += len(sources[-1])
                texts = model.texts(sources, threshold)
                part = batch.slice(at, len(sources))
                at += len(sources)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), text_of(html_col).alias("html"))
    return rows.mapInArrow(giving_back(run), "page_id long, url string, text string, n_chars long")


def main_texts(pages: DataFrame, **how) -> DataFrame:
    """Trains on the table's own marked pages and made-up ones, and extracts the main text of every page."""
    return extract(pages, train(pages, **how))
