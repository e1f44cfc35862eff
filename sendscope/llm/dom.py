"""A tolerant reader of HTML pages into block nodes and their statistics.

Only block elements are nodes; inline elements are part of the text run they
stand in. A run (text between two block boundaries) is a leaf of its block.
Nodes are in page order, so a subtree is a range of nodes and its sums are
differences of running sums.
"""

from __future__ import annotations

import html
import re

import numpy as np

# Element names by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var label img br wbr input".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
NO_TEXT = frozenset("head noscript template svg math canvas audio video object select button datalist map".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form "
                     "h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul summary search".split())
# A start tag ends an open element of these kinds, up to the element that holds it.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
        "tr": ({"tr"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
        "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}), "body": ({"head"}, set())}

_TAG = re.compile(r"""<(?:!--(?:-?>|.*?--!?>|.*)|[!?][^>]*+>|(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>)""", re.S)
_LOOSE = re.compile(r"<(?:!--(?:-?>|.*?--!?>|.*)|[!?][^>]*+>|(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>)", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_TOKEN = re.compile(r"[A-Z]?[a-z]{2,}|[A-Z]{2,}")
_NAMED = frozenset("class id role itemprop aria-label".split())

RUN = "#text"
#: Columns of a node's own counts.
COUNTS = ["chars", "link_chars", "words", "stops", "links", "inputs", "p_chars", "runs", "elements"]


class Page:
    """The nodes of a page in page order. Node 0 is the page itself."""

    def __init__(self, source: str):
        self.tags: list[str] = ["#page"]
        self.tokens: list[tuple[str, ...]] = [()]
        self.parent: list[int] = [-1]
        self.depth: list[int] = [0]
        self.end: list[int] = [0]
        self.counts: list[tuple[int, ...]] = [(0,) * len(COUNTS)]
        self.texts: dict[int, str] = {}
        self._open = [0]
        self._hidden = 0  # open elements whose text is none of the page's
        self._pieces: list[str] = []
        self._linked = self._links = self._inputs = 0
        self._link = False
        self._read(source)
        self._flush()
        while self._open:
            self._close()

    def _read(self, source: str) -> None:
        at, begin, n, failures, tag = 0, 0, len(source), 0, _TAG
        while True:
            at = source.find("<", at)
            if at < 0:
                break
            found = tag.match(source, at)
            if not found and at + 1 < n and (source[at + 1].isalpha() or source[at + 1] == "/"):
                found = _LOOSE.match(source, at)  # an attribute whose quote is never closed
                failures += 1
                if failures > 8:
                    tag = _LOOSE
            if not found:
                at += 1
                continue
            if at > begin:
                self._text(source[begin:at])
            at = begin = found.end()
            name = found[2]
            if not name:
                continue
            name = name.lower()
            if found[1]:
                self._end_tag(name)
                continue
            self._start_tag(name, found[3])
            if name in RAW:  # its content is no text of the page
                closing = re.compile(rf"</{name}(?=[\s/>])[^>]*>|\Z", re.I).search(source, at)
                at = begin = closing.end() if closing else n
        if begin < n:
            self._text(source[begin:])

    def _text(self, piece: str) -> None:
        if self._hidden:
            return
        if "&" in piece:
            piece = html.unescape(piece)
        self._pieces.append(piece)
        if self._link:
            self._linked += len(piece.strip())

    def _start_tag(self, name: str, rest: str) -> None:
        if name in RAW:
            return
        if name in INLINE:
            if name == "a":
                self._link = "href" in rest
                self._links += self._link
            elif name == "br":
                self._pieces.append(" ")
            elif name == "input":
                self._inputs += "hidden" not in rest
            return
        self._flush()
        if name in CLOSES_P:
            self._end_until({"p"}, {"table", "td", "th", "button"})
        if name in ENDS:
            self._end_until(*ENDS[name])
        if name in VOID or name == "html":
            return
        tokens: tuple[str, ...] = ()
        if "=" in rest:
            found = (html.unescape(v.strip("\"'")) for k, v in _ATTR.findall(rest) if k.lower() in _NAMED)
            tokens = tuple(sorted({t.lower() for v in found for t in _TOKEN.findall(v)}))
        self._add(name, tokens, (0,) * (len(COUNTS) - 1) + (1,))
        self._open.append(len(self.tags) - 1)
        self._hidden += name in NO_TEXT

    def _end_tag(self, name: str) -> None:
        if name in INLINE:
            if name == "a":
                self._link = False
            return
        if name in RAW or name in ("html", "body"):
            return
        for k in range(len(self._open) - 1, 0, -1):
            if self.tags[self._open[k]] == name:
                self._flush()
                while len(self._open) > k:
                    self._close()
                return

    def _end_until(self, kinds: set[str], stops: set[str]) -> None:
        for k in range(len(self._open) - 1, 0, -1):
            tag = self.tags[self._open[k]]
            if tag in kinds:
                while len(self._open) > k:
                    self._close()
                return
            if tag in stops:
                return

    def _add(self, tag: str, tokens: tuple[str, ...], counts: tuple[int, ...]) -> None:
        self.tags.append(tag)
        self.tokens.append(tokens)
        self.parent.append(self._open[-1])
        self.depth.append(len(self._open))
        self.end.append(len(self.tags))
        self.counts.append(counts)

    def _close(self) -> None:
        node = self._open.pop()
        self.end[node] = len(self.tags)
        self._hidden -= self.tags[node] in NO_TEXT

    def _flush(self) -> None:
        """End the open text run."""
        words = "".join(self._pieces).split()
        if words or self._links or self._inputs:
            text = " ".join(words)
            stops = sum(text.count(c) for c in ".,;:!?")
            linked = min(self._linked, len(text))
            in_p = len(text) if self.tags[self._open[-1]] == "p" else 0
            if text:
                self.texts[len(self.tags)] = text
            self._add(RUN, (), (len(text), linked, len(words), stops, self._links, self._inputs, in_p, 1 if text else 0, 0))
        self._pieces, self._linked, self._links, self._inputs = [], 0, 0, 0


def statistics(pages: list[Page], weight_of_tag, weight_of_token) -> np.ndarray:
    """One row of features per node of all pages, one after another.

    ``weight_of_tag`` and ``weight_of_token`` give the learned weight of a name
    (0 if it was never seen).
    """
    sizes = np.array([len(p.tags) for p in pages], np.int64)
    base = np.repeat(np.cumsum(sizes) - sizes, sizes)
    n = len(base)
    counts = np.array([c for p in pages for c in p.counts], np.float64).reshape(n, len(COUNTS))
    parent = np.array([k for p in pages for k in p.parent], np.int64) + base
    root = parent < base
    at = np.arange(n)
    parent[root] = at[root]
    end = np.array([k for p in pages for k in p.end], np.int64) + base
    depth = np.array([k for p in pages for k in p.depth], np.int64)
    running = np.zeros((n + 1, len(COUNTS)))
    np.cumsum(counts, axis=0, out=running[1:])
    total = running[end] - running[at]
    chars, link_chars, words, stops, links, inputs, p_chars, runs, elements = total.T
    page = base  # each page's first node holds the sums of the page
    link_share = link_chars / np.maximum(chars, 1)

    # neighbours below the same parent
    first_child = at == parent + 1
    order = np.lexsort((at, parent))
    ranked = parent[order]
    head = np.concatenate([[True], ranked[1:] != ranked[:-1]]) if n else np.zeros(0, bool)
    place = np.empty(n, np.int64)
    place[order] = at - at[head][np.cumsum(head) - 1] if n else at
    siblings = np.bincount(parent, minlength=n)[parent]
    before, after = np.full(n, -1), np.full(n, -1)
    if n:
        inner = ~head[1:]
        before[order[1:][inner]] = order[:-1][inner]
        after[order[:-1][inner]] = order[1:][inner]

    def beside(values: np.ndarray, of: np.ndarray) -> np.ndarray:
        return np.where(of >= 0, values[of], -1.0)

    own_tag = np.array([weight_of_tag(t) for p in pages for t in p.tags])
    weights = [[weight_of_token(t) for t in ts] for p in pages for ts in p.tokens]
    low = np.array([min(w, default=0.0) for w in weights])
    high = np.array([max(w, default=0.0) for w in weights])
    above = np.zeros((n, 4))
    for d in range(1, int(depth.max()) + 1 if n else 0):  # from each parent to its children
        of = np.flatnonzero(depth == d) if d < 64 else None
        if of is None:
            of = np.flatnonzero(depth >= d)
        up = parent[of]
        above[of, 0] = np.minimum(above[up, 0], low[up])
        above[of, 1] = np.maximum(above[up, 1], high[up])
        above[of, 2] = np.minimum(above[up, 2], own_tag[up])
        above[of, 3] = np.maximum(above[up, 3], own_tag[up])
        if d >= 64:  # the few deeper nodes take their ancestor's values at once
            break
    size = np.log1p(chars)
    return np.stack([
        size, link_share, words / np.maximum(runs, 1), stops / np.maximum(words, 1), np.log1p(chars / (elements + 1)),
        chars / np.maximum(chars[page], 1), chars / np.maximum(chars[parent], 1), depth,
        place / np.maximum(siblings - 1, 1), np.log1p(siblings),
        (running[at, 0] - running[page, 0]) / np.maximum(chars[page], 1),
        beside(link_share, before), beside(link_share, after), beside(size, before), beside(size, after),
        p_chars / np.maximum(chars, 1), np.log1p(links), np.log1p(inputs), np.log1p(runs), np.log1p(elements),
        own_tag, low, high, above[:, 0], above[:, 1], above[:, 2], above[:, 3], counts[:, 7] > 0, link_share[parent],
        own_tag[parent], low[parent], high[parent], first_child, beside(own_tag, before), beside(own_tag, after),
    ], 1) if n else np.zeros((0, 35))
