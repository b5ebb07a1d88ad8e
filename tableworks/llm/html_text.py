"""Main text of web pages by a tree-structured graphical model over the DOM.

Every block element is a binary variable (content or not). Features of the element give its own
potential; each parent and child share a potential that depends on the kind of the child. Sum-product
messages go up and down the tree and yield exact marginals, which also give the gradient that trains the
potentials from labelled pages. All pages of a batch are one forest, handled level by level.
"""

from __future__ import annotations

import functools
import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableworks.llm.batches import map_texts, strings
from tableworks.llm.labelled_pages import MARK, labelled_pages

#: Elements are content from this marginal on.
LEAST_MARGINAL = 0.5

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[^<]+|<(?=[^A-Za-z/!?])|<",
    re.S)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_PARTS = re.compile(r"[a-z]+")

# fixed values: element classes of the HTML standard
_RAW = {"script", "style", "template", "iframe", "svg", "textarea", "select"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img",
    "input", "ins", "kbd", "label", "mark", "meter", "output", "progress", "q", "s", "samp", "small", "span", "strike",
    "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
    # formulas, and elements whose content is shown where they cannot be
    "math", "mi", "mn", "mo", "ms", "mtext", "mrow", "mfrac", "msqrt", "mroot", "msub", "msup", "msubsup", "munder", "mover",
    "munderover", "mstyle", "mpadded", "menclose", "mtable", "mtr", "mtd", "semantics", "annotation", "noscript", "object",
    "canvas", "button",
}
_ENDS_P = {
    "address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre",
    "section", "table", "ul",
}
#: An element that opens ends an open one of the second set, unless one of the third stands between.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "body": ({"head"}, set()),
}
_KINDS = {
    "article": 1, "main": 1, "section": 2, "div": 2, "body": 2, "html": 2, "td": 2, "table": 2, "tbody": 2, "tr": 2,
    "p": 3, "blockquote": 3, "pre": 3, "figure": 3, "figcaption": 3, "h1": 4, "h2": 4, "h3": 4, "h4": 4, "h5": 4, "h6": 4,
    "ul": 5, "ol": 5, "li": 5, "dl": 5, "dt": 5, "dd": 5, "nav": 6, "header": 6, "footer": 6, "aside": 6, "head": 6,
    "form": 7, "dialog": 7, "fieldset": 7, "menu": 7, "title": 6,
}
_KIND_COUNT = 9
_TAGS = sorted(set(_KINDS))
_HINTS = {
    "ad": "ad ads advert adverts advertisement sponsor sponsored promo promotion banner",
    "nav": "nav navigation menu breadcrumb breadcrumbs navbar toolbar tabs skip",
    "side": "side sidebar aside complementary widget left right rail",
    "head": "header masthead topbar top logo",
    "foot": "footer foot bottom contentinfo copyright legal",
    "comment": "comment comments reply replies respond responses discussion disqus reader",
    "notice": "notice cookie cookies consent alert warning popup modal overlay gdpr privacy",
    "form": "form newsletter subscribe signup login search subscription",
    "more": "related recommended share sharing social more tags pagination pager author byline meta teaser",
    "main": "content article main post entry story text body page",
}
_HINT = {w: n for n, words in enumerate(_HINTS.values()) for w in words.split()}
_SIZES = np.array([1, 21, 81, 201, 601])
_SHARES = np.array([0.001, 0.3, 0.7])
_BASES = np.cumsum([0, len(_TAGS) + 1, len(_HINTS) + 1, 6, 4, 3, 6, 4, 4])
_FEATURES = int(_BASES[-1]) + 1


class Page:
    """Elements of a page that are judged, and its blocks of text in page order.

    Block elements are judged, and inline ones that say by name what they are. Only block elements end a block, so a block may hold text of several elements: ``parts`` has the (element, text)
    of each block, ``runs`` its innermost block element and whole text.
    """

    def __init__(self, source: str):
        self.parent, self.tag, self.hints, self.marked = [-1], ["#"], [()], [False]
        self.runs: list[tuple[int, str]] = []
        self.parts: list[list[tuple[int, str]]] = []
        self.chars, self.linked, self.stops = [0], [0], [0]
        self._stack, self._links, self._pieces = [0], 0, []
        # places on the stack by tag, elements that are open by inline tag (-1: not judged), and their blocks
        self._at: dict[str, int] = {}
        self._inline: dict[str, list[int]] = {}
        self._depth, self._block = [0], [0]
        self._read(source)
        self._flush()

    def _flush(self) -> None:
        if self._pieces:
            text = " ".join("".join(t for _, t in self._pieces).split())
            if text:
                self.runs.append((self._block[self._stack[-1]], text))
                self.parts.append(self._pieces)
            self._pieces = []

    def _text(self, raw: str) -> None:
        text = html.unescape(raw) if "&" in raw else raw
        self._pieces.append((self._stack[-1], text))
        node, size = self._stack[-1], len(text.strip())
        self.chars[node] += size
        if self._links:
            self.linked[node] += size
        self.stops[node] += sum(map(text.count, (". ", "! ", "? "))) + text.rstrip().endswith((".", "!", "?"))

    def _cut(self, depth: int) -> None:
        """Takes the elements from this place of the stack on off it."""
        for node in self._stack[depth:]:
            self._at[self.tag[node]] -= 1
        del self._stack[depth:]

    def _pop(self, tags: set, until: set) -> None:
        if not any(self._at.get(t) for t in tags):  # nothing to look for, however deep the stack is
            return
        for depth in range(len(self._stack) - 1, 0, -1):
            tag = self.tag[self._stack[depth]]
            if tag in tags:
                self._cut(depth)
                return
            if tag in until:
                return

    def _open(self, tag: str, attributes: str) -> None:
        hints = ()
        if attributes and ("class" in attributes or "id" in attributes or "role" in attributes or "CLASS" in attributes):
            words = _PARTS.findall(" ".join(m[1] for m in _NAMES.findall(attributes)).lower())
            hints = tuple({_HINT[w] for w in words if w in _HINT})
        if tag in _INLINE:
            if tag == "a":
                self._links += 1
            if tag == "br":
                self._pieces.append((self._stack[-1], " "))
            if tag not in _VOID and not attributes.endswith("/"):
                if hints:
                    self._push(tag, attributes, hints, self._block[self._stack[-1]])
                self._inline.setdefault(tag, []).append(self._stack[-1] if hints else -1)
            return
        self._flush()
        self._links = 0
        if tag in _ENDS_P:
            self._pop({"p"}, {"td", "th", "table", "button", "#"})
        if tag in _ENDS:
            self._pop(*_ENDS[tag])
        if tag in _VOID:
            return
        self._push(tag, attributes, hints, len(self.tag))

    def _push(self, tag: str, attributes: str, hints: tuple, block: int) -> None:
        self._block.append(block)
        self._depth.append(len(self._stack))
        self._at[tag] = self._at.get(tag, 0) + 1
        self.parent.append(self._stack[-1])
        self.tag.append(tag)
        self.hints.append(hints)
        self.marked.append(MARK in attributes or self.marked[self._stack[-1]])
        for counts in (self.chars, self.linked, self.stops):
            counts.append(0)
        self._stack.append(len(self.tag) - 1)

    def _close(self, tag: str) -> None:
        if tag in _INLINE:
            if tag == "a":
                self._links = max(0, self._links - 1)
            open_ = self._inline.get(tag)
            node = open_.pop() if open_ else -1
            # it may have been closed with the block around it
            depth = self._depth[node]
            if 0 < depth < len(self._stack) and node >= 0 and self._stack[depth] == node:
                if any(self._block[n] != self._block[node] for n in self._stack[depth:]):
                    self._flush()
                self._cut(depth)
        elif self._at.get(tag):
            self._flush()
            self._pop({tag}, set())

    def _read(self, source: str) -> None:
        at, end = 0, len(source)
        while at < end:
            found = _TOKEN.match(source, at)
            at = found.end()
            token, tag = found[0], found[2]
            if tag:
                tag = tag.lower()
                if found[1]:
                    self._close(tag)
                elif tag in _RAW:
                    if not found[3].endswith("/") or tag != "svg":
                        close = re.compile(f"</{tag}(?=[\\s/>]|\\Z)[^>]*(?:>|\\Z)", re.I).search(source, at)
                        at = close.end() if close else end
                else:
                    self._open(tag, found[3])
            elif token[0] != "<":
                self._text(token)
            elif token == "<":
                rest = source[at:at + 1]
                if rest and (rest.isalpha() or rest == "/"):
                    # a tag that never ends: nothing of it is text
                    close = source.find(">", at)
                    at = close + 1 if close >= 0 else end
                else:
                    self._text("<")


def _features(pages: list[Page]) -> tuple:
    """Parents, depths, kinds and active features (one column of indexes per family) of all nodes."""
    parent, offset, owner = [], 0, []
    for n, page in enumerate(pages):
        parent += [p + offset if p >= 0 else -1 for p in page.parent]
        offset += len(page.parent)
        owner += [n] * len(page.parent)
    parent, owner = np.array(parent, np.int64), np.array(owner, np.int64)
    flat = lambda name: np.array([x for page in pages for x in getattr(page, name)], float)
    chars, linked, stops = flat("chars"), flat("linked"), flat("stops")
    depth = np.zeros(len(parent), np.int64)
    for n, p in enumerate(parent.tolist()):  # parents come first
        if p >= 0:
            depth[n] = depth[p] + 1
    all_chars, all_linked, all_stops = chars.copy(), linked.copy(), stops.copy()
    order = np.argsort(-depth, kind="stable")
    levels = np.split(order, np.flatnonzero(np.diff(-depth[order])) + 1) if len(order) else []
    for level in levels[:-1]:
        for total in (all_chars, all_linked, all_stops):
            np.add.at(total, parent[level], total[level])
    page_chars = np.bincount(owner, chars, len(pages))[owner] if len(parent) else chars
    tags = [t for page in pages for t in page.tag]
    hints = [h for page in pages for h in page.hints]
    number = {t: n for n, t in enumerate(_TAGS)}
    share = lambda a, b: np.divide(a, b, out=np.zeros(len(a)), where=b > 0)
    columns = [
        np.array([number.get(t, len(_TAGS)) for t in tags], np.int64),
        np.array([h[0] if h else len(_HINTS) for h in hints], np.int64),
        np.searchsorted(_SIZES, chars, "right"), np.searchsorted(_SHARES, share(linked, chars), "right"),
        np.minimum(stops, 2).astype(np.int64), np.searchsorted(_SIZES, all_chars, "right"),
        np.searchsorted(_SHARES, share(all_linked, all_chars), "right"),
        np.searchsorted(np.array([0.05, 0.3, 0.7]), share(all_chars, page_chars), "right"),
    ]
    active = np.stack([c + b for c, b in zip(columns, _BASES)], axis=1) if len(parent) else np.zeros((0, 8), np.int64)
    more = [(n, _BASES[1] + h) for n, hs in enumerate(hints) for h in hs[1:]]
    kind = np.array([_KINDS.get(t, 8) for t in tags], np.int64)
    return parent, levels, kind, active, np.array(more, np.int64).reshape(-1, 2)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def marginals(parent, levels, kind, active, more, unary, pair) -> tuple[np.ndarray, np.ndarray]:
    """Content marginals of the nodes, and of parent and child together (zero for roots).

    ``pair[kind, parent state, child state]`` are log potentials.
    """
    n = len(parent)
    score = unary[active].sum(1)
    if len(more):
        np.add.at(score, more[:, 0], unary[more[:, 1]])
    up = np.zeros((n, 2))
    up[:, 1] = score
    message = np.zeros((n, 2))
    for level in levels[:-1]:  # deepest first
        message[level] = _lse(pair[kind[level]] + up[level][:, None, :], 2)
        np.add.at(up, parent[level], message[level])
    total, both = up.copy(), np.zeros((n, 2, 2))
    for level in reversed(levels[:-1]):
        cavity = total[parent[level]] - message[level]
        joint = pair[kind[level]] + cavity[:, :, None]
        total[level] = up[level] + _lse(joint, 1)
        joint = joint + up[level][:, None, :]
        joint = np.exp(joint - joint.max((1, 2), keepdims=True))
        both[level] = joint / joint.sum((1, 2), keepdims=True)
    return 1 / (1 + np.exp(np.clip(total[:, 0] - total[:, 1], -500, 500))), both


@functools.cache
def trained() -> tuple[np.ndarray, np.ndarray]:
    """Potentials that maximise the likelihood of the labelled pages; the same wherever it runs."""
    return fit(labelled_pages())


def fit(sources: list[str], steps: int = 250) -> tuple[np.ndarray, np.ndarray]:
    """Potentials of the features and of parent and child, by adaptive steps on the likelihood of labelled pages."""
    pages = [Page(p) for p in sources]
    forest = _features(pages)
    parent, _, kind, active, more = forest
    label = np.array([m for page in pages for m in page.marked], float)
    child = parent >= 0
    seen = np.zeros((_KIND_COUNT, 2, 2))
    np.add.at(seen, (kind[child], label[parent[child]].astype(int), label[child].astype(int)), 1)
    unary, pair = np.zeros(_FEATURES), np.zeros((_KIND_COUNT, 2, 2))
    state = [np.zeros_like(unary), np.zeros_like(unary), np.zeros_like(pair), np.zeros_like(pair)]
    for step in range(1, steps + 1):
        p, both = marginals(*forest, unary, pair)
        error = p - label
        g = np.bincount(active.ravel(), np.repeat(error, active.shape[1]), _FEATURES)
        if len(more):
            g += np.bincount(more[:, 1], error[more[:, 0]], _FEATURES)
        expected = np.zeros_like(pair)
        np.add.at(expected, kind[child], both[child])
        for value, grad, m, v in ((unary, g / len(p) + 1e-4 * unary, *state[:2]),
                                  (pair, (expected - seen) / len(p) + 1e-4 * pair, *state[2:])):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad ** 2 - v)
            value -= 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return unary, pair


def main_texts(
    sources: list[str], least: float = LEAST_MARGINAL, potentials: tuple[np.ndarray, np.ndarray] | None = None,
) -> list[str]:
    """The main text of each page: its content blocks joined by empty lines."""
    pages = [Page(s) for s in sources]
    p, _ = marginals(*_features(pages), *(potentials or trained()))
    out, offset = [], 0
    for page in pages:
        blocks = (" ".join("".join(t for node, t in parts if p[offset + node] >= least).split()) for parts in page.parts)
        out.append("\n\n".join(b for b in blocks if b))
        offset += len(page.parent)
    return out


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars``.

    A null or empty page, or one without main text, has an empty text. Repeated rows are extracted each;
    null identifiers and addresses stay null; an empty table gives an empty result; other columns are
    ignored. Pages without any markup are kept or dropped like any other block.
    """
    named = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                         F.col(html_col).cast("string").alias("html"))

    def run(batch):
        texts = main_texts(strings(batch, "html"))
        return {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(texts, pa.string()),
                "n_chars": pa.array(map(len, texts), pa.int64())}

    return map_texts(named, run, "page_id long, url string, text string, n_chars long")
