"""Main text of HTML pages by gradient-boosted trees over DOM nodes.

Trees score every block node by its subtree's text density, links, attribute
tokens, depth and siblings. Choices are then decoded over the tree: a node is
kept only below kept nodes, and the kept set has the largest sum of log odds of
all such sets, so an ancestor and a descendant never contradict each other.

Pages carry no labels, so the trees learn from a bounded sample of pages that
is labelled in two ways: by the pages' own landmarks (``article``, ``main``)
where they have them, and by setting the pages' texts anew in varied layouts
whose parts are known.
"""

from __future__ import annotations

import pickle
import random
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_bytes
from .dom import RUN, Page, statistics
from .quality import Forest, fit_forest

#: Distinct pages that the trees learn from, characters used of each, layouts
#: made of each, and nodes learned from of a page and in all, at most.
SAMPLE_PAGES, SAMPLE_CHARS, LAYOUTS, PAGE_NODES, SAMPLE_NODES = 200, 30_000, 4, 60, 40_000
#: Log odds in favour of keeping a node, beside what the trees say: a lost
#: block of the main text weighs more than a block too many.
LEANING = 1.0
#: Marks the main text's runs in a layout (a private code point).
_MARK = ""

# Names that pages give to their parts (fixed values for the layouts).
CONTENT_TAGS = ["article", "main", "div", "div", "section", "td"]
CONTENT_NAMES = ["article", "content", "post", "entry", "main", "story", "body", "text", "post-content", "entry-content",
                 "article-body", "page-content", "main-content", "story-body", "prose", "post-body"]
WRAPPER_NAMES = ["wrapper", "container", "page", "site", "layout", "row", "col", "inner", "outer", "grid", "app", "root"]
PARTS = {
    "menu": (["nav", "nav", "div", "ul"], "nav navigation navbar menu main-menu topnav breadcrumb breadcrumbs toc tabs site-nav links pagination pager"),
    "header": (["header", "header", "div"], "header site-header masthead logo top topbar brand page-header head hero"),
    "footer": (["footer", "footer", "div"], "footer site-footer bottom copyright legal colophon site-info foot page-footer"),
    "sidebar": (["aside", "aside", "div", "section"], "sidebar side aside widget widgets rail related recommended secondary trending popular more sidebar-left sidebar-right"),
    "notice": (["div", "section", "aside", "p"], "notice cookie cookies consent cookie-banner cookie-notice alert banner popup modal newsletter "
               "warning message gdpr overlay disclaimer toast paywall announcement"),
    "advert": (["div", "div", "aside", "section", "p"], "ad ads advert advertisement adverts advertising sponsored sponsor promo promotion adslot ad-box banner-ad teaser commercial"),
    "form": (["form", "form", "div"], "form search search-form login signup contact subscribe newsletter register feedback"),
    "comments": (["section", "div", "ol", "ul", "aside"], "comments comment respond replies reply discussion disqus thread reviews responses comment-list user-comments comments-area"),
    "share": (["div", "ul"], "share social sharing tools meta tags actions byline author-box post-meta buttons"),
}


def _attributes(r: random.Random, names: list[str], chance: float) -> str:
    if r.random() > chance:
        return ""
    some = " ".join(r.sample(names, min(len(names), r.choice([1, 1, 2]))))
    return f' {r.choice(["class", "class", "id"])}="{some}"'


class _Layout:
    """A page with known parts, from a page's main texts and its other texts."""

    def __init__(self, main: list[str], other: list[str], seed: int):
        self.r = random.Random(seed)
        self.words = [w.replace("<", "").replace("&", "") for t in [*main, *other] for w in t.split()][:4000] or ["a"]
        self.named = self.r.choice([0.0, 0.6, 0.9, 1.0])
        self.html = self._page(main)

    def _some(self, low: int, high: int) -> str:
        k = self.r.randrange(len(self.words))
        return " ".join(self.words[k: k + self.r.randint(low, high)])

    def _links(self, low: int, high: int) -> str:
        item = self.r.choice(["<li><a href='/x'>{}</a></li>", "<a href='/x'>{}</a> ", "<li><a href='/y'>{}</a>", "<p><a href='#'>{}</a></p>"])
        inside = "".join(item.format(self._some(1, 4)) for _ in range(self.r.randint(low, high)))
        return f"<ul>{inside}</ul>" if "<li>" in item else inside

    def _heading(self) -> str:
        return f"<h{self.r.randint(2, 4)}>{self._some(1, 4)}</h{self.r.randint(2, 4)}>" if self.r.random() < 0.6 else ""

    def part(self, kind: str) -> str:
        r = self.r
        tags, names = PARTS[kind]
        tag = r.choice(tags)
        # a plain element says nothing by itself: it needs a name
        inside = {
            "menu": lambda: self._links(2, 9),
            "header": lambda: r.choice([self._some(1, 5), f"<h1>{self._some(1, 4)}</h1>", f"<p>{self._some(2, 8)}</p>", f"<a href='/'>{self._some(1, 3)}</a>"])
            + (self._links(2, 6) if r.random() < 0.4 else ""),
            "footer": lambda: r.choice(["&copy; ", ""]) + r.choice([self._some(2, 20), f"<p>{self._some(3, 25)}</p>"]) + (self._links(2, 8) if r.random() < 0.4 else ""),
            "sidebar": lambda: self._heading() + r.choice([self._links(2, 8), f"<p>{self._some(4, 40)}</p>", f"<div>{self._some(5, 30)}</div>{self._links(2, 5)}"]),
            "notice": lambda: r.choice([self._some(4, 30), f"<p>{self._some(4, 40)}</p>"]) + r.choice(["", f"<button>{self._some(1, 2)}</button>", f"<a href='/p'>{self._some(1, 3)}</a>"]),
            "advert": lambda: r.choice([self._some(3, 30), f"<p>{self._some(3, 40)}</p>", f"<a href='/b'>{self._some(2, 10)}</a>", f"<span>{self._some(3, 25)}</span>"]),
            "form": lambda: "".join(f"<label>{self._some(1, 3)}</label><input name=a>" for _ in range(r.randint(1, 4)))
            + r.choice(["", f"<p>{self._some(3, 20)}</p>"]) + f"<button>{self._some(1, 2)}</button>",
            "comments": lambda: self._heading() + "".join(
                r.choice(["<div class='comment'>{a}<p>{t}</p></div>", "<li>{a}<p>{t}</p></li>", "<p><b>{a}</b>: {t}</p>", "<article class='comment'><p>{t}</p></article>",
                          "<div>{a}</div><div>{t}</div>"]).format(a=self._some(1, 2), t=self._some(4, 80)) for _ in range(r.randint(1, 5))),
            "share": lambda: self._links(1, 5) if r.random() < 0.7 else self._some(2, 8),
        }[kind]()
        inner = "li" if tag in ("ul", "ol") and "<li" not in inside else None
        if inner:
            inside = f"<li>{inside}</li>"
        certain = tag in ("div", "section", "p", "ul", "ol") and (kind in ("advert", "notice", "comments") or self.named > 0)
        return f"<{tag}{_attributes(r, names.split(), 1.0 if certain else max(self.named, 0.4))}>{inside}</{tag}>"

    def _block(self, text: str) -> str:
        r = self.r
        words = text.replace("&", "&amp;").replace("<", "&lt;").split()
        for _ in range(r.choice([0, 0, 1, 2])):
            k = r.randrange(len(words))
            tag = r.choice(["b", "em", "a href='/z'", "span", "code", "strong"])
            words[k] = f"<{tag}>{words[k]}</{tag.split()[0]}>"
        form = r.choice(["<p>{}</p>"] * 9 + ["<p>{}", "<div>{}</div>", "<ul><li>{}</li></ul>", "<blockquote><p>{}</p></blockquote>", "<h2>{}</h2>", "<h3>{}</h3>",
                                             "<pre>{}</pre>", "<table><tr><td>{}</td></tr></table>", "<ol><li>{}</ol>", "<figure><figcaption>{}</figcaption></figure>",
                                             "<p><b>{}<br>", "{}<br><br>", "<section><p>{}</p></section>"])
        return form.format(_MARK + " ".join(words))

    def _page(self, main: list[str]) -> str:
        r = self.r
        main = main[: r.choice([1, 2, 4, 8, 30, 200])]
        if r.random() < 0.04:  # a very long page
            main = [r.choice(main) for _ in range(r.choice([300, 800]))]
        blocks = [self._block(t) for t in main]
        if r.random() < 0.7 and main:
            title = f"<h1>{_MARK}{' '.join(main[0].replace('&', '').replace('<', '').split()[:8])}</h1>"
            blocks.insert(0, f"<header>{title}</header>" if r.random() < 0.1 else title)
        for _ in range(r.choice([0, 0, 1, 2])):  # parts that stand in the text
            blocks.insert(r.randint(0, len(blocks)), self.part(r.choice(["advert", "share", "notice", "sidebar", "menu", "form"])))
        if r.random() < 0.3:
            blocks.append(self.part(r.choice(["comments", "share", "advert", "sidebar", "comments"])))
        tag = r.choice(CONTENT_TAGS)
        body = f"<{tag}{_attributes(r, CONTENT_NAMES, self.named)}>{''.join(blocks)}</{tag}>"
        if tag == "td":
            body = f"<table><tr>{f'<td>{self._links(2, 6)}</td>' if r.random() < 0.5 else ''}{body}</tr></table>"
        for _ in range(r.choice([0, 1, 1, 2, 3])):  # wrappers around the text and some parts
            beside = [self.part(k) for k in r.sample(["sidebar", "advert", "comments", "notice", "share", "menu"], r.choice([0, 0, 1, 2]))]
            k = r.randint(0, len(beside))
            wrap = r.choice(["div", "div", "section", "main", "form"] if r.random() < 0.3 else ["div", "main"])
            body = f"<{wrap}{_attributes(r, WRAPPER_NAMES + CONTENT_NAMES[:6], self.named)}>{''.join([*beside[:k], body, *beside[k:]])}</{wrap}>"
        much, more = r.choice([0, 0.3, 0.6]), r.choice([0, 0.3, 0.6])
        top = [self.part(k) for k in ("notice", "header", "menu", "advert", "form") if r.random() < much]
        end = [self.part(k) for k in ("comments", "sidebar", "menu", "advert", "footer", "notice", "form") if r.random() < more]
        r.shuffle(top)
        return f"<html><head><title>x</title></head><body>{''.join(top)}{body}{''.join(end)}"


def _landmark_labels(page: Page) -> np.ndarray | None:
    """Whether each node is or holds main text, told by the page's landmarks
    and the names of its parts. None for a page without landmark."""
    holders = [k for k, t in enumerate(page.tags) if t in ("article", "main")]
    if not holders:
        return None
    names = {t for _, v in PARTS.values() for t in v.replace("-", " ").split()} - {"main", "text", "more", "head", "top", "body", "page"}
    n = len(page.tags)
    inside, out = np.zeros(n, bool), np.zeros(n, bool)
    for k in holders:
        inside[k: page.end[k]] = True
    for k in range(n):
        if page.tags[k] in ("nav", "aside", "footer", "form") or set(page.tokens[k]) & names:
            out[k: page.end[k]] = True
    return _upwards(page, [k for k in page.texts if inside[k] and not out[k]])


def _upwards(page: Page, kept: list[int]) -> np.ndarray:
    keep = np.zeros(len(page.tags), bool)
    for k in kept:
        while k >= 0 and not keep[k]:
            keep[k] = True
            k = page.parent[k]
    return keep


@dataclass
class Extractor:
    """The fitted trees and the learned weights of tag names and attribute tokens."""

    forest: Forest
    tags: dict[str, float]
    tokens: dict[str, float]

    def features(self, pages: list[Page]) -> np.ndarray:
        return statistics(pages, lambda t: self.tags.get(t, 0.0), lambda t: self.tokens.get(t, 0.0))

    def texts(self, pages: list[Page]) -> list[str]:
        p = np.clip(self.forest.probability(self.features(pages)), 1e-6, 1 - 1e-6)
        odds = (np.log(p / (1 - p)) + LEANING).tolist()
        out, at = [], 0
        for page in pages:
            keep = decode(page.parent, odds[at: at + len(page.tags)])
            out.append("\n\n".join(t for k, t in page.texts.items() if keep[k]))
            at += len(page.tags)
        return out


def decode(parent: list[int], odds: list[float]) -> list[bool]:
    """The kept set of nodes (in page order, each after its parent) that is
    closed under parents and has the largest sum of ``odds``. The first node is
    always kept."""
    gain = list(odds)
    for k in range(len(gain) - 1, 0, -1):
        if gain[k] > 0:
            gain[parent[k]] += gain[k]
    keep = [True] * len(gain)
    for k in range(1, len(gain)):
        keep[k] = keep[parent[k]] and gain[k] > 0
    return keep


def train(sources: list[str]) -> Extractor | None:
    """Trees learned from some pages' sources, in their order."""
    learned: list[tuple[Page, np.ndarray]] = []
    for number, source in enumerate(sources):
        page = Page(source)
        known = _landmark_labels(page)
        texts = list(page.texts.items())
        if known is not None:
            learned.append((page, known))
        main = [t for k, t in texts if (known is None or known[k]) and len(t) > 1]
        other = [t for k, t in texts if known is not None and not known[k]]
        for k in range(LAYOUTS if main else 0):
            made = Page(_Layout(main, other, 1000 * number + k).html)
            marked = [i for i, t in made.texts.items() if _MARK in t]
            learned.append((made, _upwards(made, marked)))
    if not learned:
        return None

    def weights(names_of) -> dict[str, float]:
        seen: defaultdict[str, list[int]] = defaultdict(lambda: [0, 0])
        for page, known in learned:
            for names, y in zip(names_of(page), known):
                for name in names:
                    seen[name][int(y)] += 1
        return {name: float(np.log((b + 3) / (a + 3))) for name, (a, b) in sorted(seen.items()) if a + b >= 3}

    model = Extractor(fit_forest(np.zeros((0, 1)), np.zeros(0), [0]), weights(lambda p: [(t,) for t in p.tags]), weights(lambda p: p.tokens))
    x, y, r = [], [], np.random.default_rng(7)
    for page, known in learned:
        some = r.permutation(len(known))[: PAGE_NODES]  # a long page counts as a usual one
        x.append(model.features([page])[some])
        y.append(known[some])
    x, y = np.concatenate(x), np.concatenate(y).astype(np.float64)
    some = r.permutation(len(y))[: SAMPLE_NODES]
    x, y = x[some], y[some]
    model.forest = fit_forest(x, y, [0] * x.shape[1], trees=60, depth=5, rate=0.25, bins=32)
    return model


def fit(pages: DataFrame, sample: int = SAMPLE_PAGES) -> Extractor | None:
    """Learn from ``sample`` distinct pages at most, those with the smallest
    hashes of their html, and SAMPLE_CHARS characters of each. They are learned
    in one task; only the fitted trees and weights reach the driver. None if no
    page has html."""
    hashed = pages.where(F.col("html").isNotNull() & (F.col("html") != "")).select(
        F.xxhash64("html").alias("h"), F.substring("html", 1, SAMPLE_CHARS).alias("html"))
    chosen = [r["h"] for r in hashed.select("h").distinct().orderBy("h").limit(sample).collect()]
    if not chosen:
        return None

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sources = [s for batch in batches for s in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(sources))], pa.binary())], ["model"])

    rows = (hashed.where(F.col("h").isin(chosen)).groupBy("h").agg(F.min("html").alias("html"))
            .repartition(1).sortWithinPartitions("h").select("html"))
    return next((pickle.loads(bytes(m)) for m in (r["model"] for r in rows.mapInArrow(learn, "model binary").collect())), None)


def extract(pages: DataFrame, model: Extractor | None) -> DataFrame:
    """page_id, url and text: the kept blocks of every whole page in page order,
    two line feeds between them.

    White space inside a block is one space; character references are decoded.
    A page that is null, empty or has no main text gives the empty text, as does
    every page without a model; repeated rows each give a row; page_id and url
    stay as they are, null too.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = text_bytes(batch.column("html"))
            for i, j in slices(off):
                found = [Page(buf[off[k]: off[k + 1]].tobytes().decode("utf-8")) for k in range(i, j)]
                texts = model.texts(found) if model else [""] * (j - i)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("page_id").slice(i, j - i), batch.column("url").slice(i, j - i), pa.array(texts, pa.string())],
                    ["page_id", "url", "text"])

    return (pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
            .mapInArrow(read, "page_id long, url string, text string"))
