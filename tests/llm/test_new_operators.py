"""Extraction, phrases and periodic runs against brute force, on texts with
nulls, ties, repeated rows, very long texts and extra columns."""

import hashlib
import html
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from sendscope.llm import dom, extraction, periodic, phrases, queries

SCHEMA = "doc_id long, text string, lang string, h long, shard int, n long, a long, runs string"
SEPARATORS = re.compile(r"[.,;:!?\x0A-\x0D]")


# --- periodic runs ------------------------------------------------------------------

def _runs(w):
    found = set()
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - s + q >= max(6, 4 * q) and i > s and not any((s, i - s + q, d) in found for d in range(1, q)):
                found.add((s, i - s + q, q))
            i += 1
    return sorted((s, length, q) for s, length, q in found)


def test_samples_cover_every_difference():
    pairs = {(a - b) % periodic.COVER for a in periodic.SAMPLES.tolist() for b in periodic.SAMPLES.tolist()}
    assert pairs == set(range(periodic.COVER))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"a", b"c"]), max_size=70), min_size=1, max_size=5), st.integers(1, 9), st.integers(2, 9))
def test_runs_equal_brute_force(texts, period, times):
    texts = [*texts, [*texts[0], *(texts[0][:period] * times), *texts[-1]], [b"x"] * 40]
    got = periodic._described([None] * len(texts), texts).column("runs").to_pylist()
    assert [sorted((r["start"], r["length"], r["period"]) for r in g) for g in got] == [_runs(w) for w in texts]


def test_extensions_over_long_repeats():
    r = np.random.default_rng(1)
    part = r.integers(0, 3, 4000)
    x = np.concatenate([part, part, r.integers(0, 3, 500), part[:2500], [99]])
    extend = periodic.Extensions(x)
    i = np.concatenate([r.integers(0, 4000, 300), np.arange(50)])
    j = np.concatenate([i[:300] + 4000, np.arange(50) + 8500])
    want = []
    for a, b in zip(i.tolist(), j.tolist()):
        k = 0
        while max(a, b) + k < len(x) and x[a + k] == x[b + k]:
            k += 1
        want.append(k)
    assert extend(i, j).tolist() == want


def _documents():
    r = random.Random(4)
    words = ["the", "of", "new", "york", "city", "Émile", "in", "a"] + [f"w{k}" for k in range(30)]
    texts = [" ".join(r.choice(words) + r.choice(["", "", "", ",", "\n", ".", "\t"]) for _ in range(r.randint(0, 120))) for _ in range(60)]
    texts += ["New York City " * 30, "new york city. " * 5, None, "", " \n", "a", "x y " * 3000, "ab\x0bcd\x1c ef", texts[0], texts[0],
              " ".join(r.choice(words) for _ in range(40000))]
    rows = [(i, t, r.choice(["en", "de", None, "und"]), 1, 2, 3, 4, "r") for i, t in enumerate(texts)]
    return rows + [rows[2], (None, texts[1], None, None, None, None, None, None), (None, "z z z z z z z z", "en", 0, 0, 0, 0, None)]


ROWS = _documents()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(5)


def _sorted(rows):
    return sorted(rows, key=repr)


def _planted(doc_id, w):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def test_periodic_query_equals_brute_force(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect()]
    want = []
    for i, t, *_ in ROWS:
        w = _planted(i, re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        if len(w) > 10000:  # one word or no long repeats at all: brute force is slow there
            runs = [(s, n, q) for s, n, q in _short_runs(w)]
        else:
            runs = _runs(w)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        best = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else None
        want.append((i, len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4),
                     hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
                     hashlib.sha256(" ".join(v for k, v in enumerate(w) if k not in gone).encode()).hexdigest()))
    assert _sorted(got) == _sorted(want)


def _short_runs(w):
    """Runs of a long random text: periods that could hold four times, by words' places."""
    x = np.unique(np.array(w), return_inverse=True)[1]
    found = []
    for q in range(1, len(x) // 4 + 1):
        same = np.concatenate([[False], x[:-q] == x[q:], [False]])
        edge = np.flatnonzero(same[1:] != same[:-1]).reshape(-1, 2)
        for s, e in edge[edge[:, 1] - edge[:, 0] + q >= max(6, 4 * q)].tolist():
            if not any((s, e - s + q) == f[:2] for f in found):
                found.append((s, e - s + q, q))
    return sorted(found, key=lambda f: (f[0], f[2]))


def test_empty_table_has_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert periodic.run_table(none).collect() == []
    assert phrases.collocations(none).collect() == []
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert extraction.extract(pages, extraction.fit(pages)).collect() == []


# --- phrases ----------------------------------------------------------------------------

def _collocations(rows, support, limit):
    f, total = Counter(), Counter()
    for _, t, lang, *_ in rows:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        for piece in SEPARATORS.split(text):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            f.update((lang or "und", tuple(w[i: i + k])) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    out = []
    for lang in total:
        kept = []
        for (of, p), a in f.items():
            if of != lang or len(p) < 2 or a < support:
                continue
            longer = [b for (o, v), b in f.items() if o == lang and len(v) > len(p) and b >= support and any(v[i: i + len(p)] == p for i in range(2))]
            if any(100 * b >= 50 * a for b in longer):
                continue
            score, _, left, right = min((1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            kept.append((" ".join(p), a, left, right, total[lang], score))
        kept.sort(key=lambda r: (-r[5], -r[1], r[0].encode()))
        out += [(lang, k + 1, *r) for k, r in enumerate(kept[:limit])]
    return out


@pytest.mark.parametrize("support,limit,shards,parts", [(10, 2000, 3, 5), (10, 7, 3, 2), (3, 2000, 1, 4), (4, 2000, 8, 16)])
def test_collocations_equal_brute_force(docs, support, limit, shards, parts):
    got = phrases.collocations(docs.repartition(parts), support, limit, shards)
    assert _sorted(map(tuple, got.collect())) == _sorted(_collocations(ROWS, support, limit))


def test_a_crowded_bitmap_changes_no_count(docs):
    some = phrases.count_all(docs, phrases.mine(docs, 10, bits=8), bits=8).where("f >= 10")
    every = phrases.count_all(docs, phrases.mine(docs, 10)).where("f >= 10")
    assert _sorted(map(tuple, some.collect())) == _sorted(map(tuple, every.collect()))


def test_scores_beyond_64_bits(spark):
    big = 3_000_000_000
    counts = spark.createDataFrame([("en", 0, "", 10 * big), ("en", 1, "a", 2 * big + 1), ("en", 1, "b", big), ("en", 2, "a b", big - 1)],
                                   "lang string, size int, phrase string, f long")
    row = phrases.score(counts).first()
    assert row["score"] == 1000000 * (big - 1) ** 2 // ((2 * big + 1) * big)


# --- extraction ---------------------------------------------------------------------------

def _blocks(source):
    page = dom.Page(source)
    return list(page.texts.values())


@pytest.mark.parametrize("source,blocks", [
    ("<p>a &amp; b<br>c</p><p>d", ["a & b c", "d"]),
    ("<p>one<p>two<div>three</div>four", ["one", "two", "three", "four"]),
    ("<script>var t='</p>';</script><style>p{}</style><!-- x --><p>y</p>", ["y"]),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", ["a", "b", "c", "d"]),
    ("<table><tr><td>1<td>2<tr><td>3</table>", ["1", "2", "3"]),
    ("a < b &lt; c &am &#233;&nbsp;x", ["a < b < c &am é x"]),
    ("<p title=\"a>b\">x</p><p title='never closed>y</p>", ["x", "y"]),
    ("<head><title>t</title></head><body>u<select><option>v</select>", ["u"]),
    ("<p>w<script>never closed", ["w"]), ("", []), ("   ", []), ("<", ["<"]), ("<div><p></div></p></nothing>", []),
])
def test_blocks_of_a_page(source, blocks):
    assert _blocks(source) == blocks


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<>/!-&;'\"= pdivaulscrt\n", max_size=120))
def test_any_text_is_read(source):
    page = dom.Page(source)
    assert all(p < k for k, p in enumerate(page.parent)) and all(k < e <= len(page.tags) for k, e in enumerate(page.end))
    dom.statistics([page, dom.Page("")], lambda t: 0.5, lambda t: -0.5)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(-5, 5)), max_size=9))
def test_decoding_is_the_best_closed_set(nodes):
    parent = [-1] + [p % (k + 1) for k, (p, _) in enumerate(nodes)]
    odds = [-1.0] + [float(o) for _, o in nodes]
    best = max(sum(o for o, k in zip(odds, keep) if k) for keep in itertools.product([False, True], repeat=len(odds))
               if keep[0] and all(not k or p < 0 or keep[p] for k, p in zip(keep, parent)))
    keep = extraction.decode(parent, odds)
    assert keep[0] and all(not k or p < 0 or keep[p] for k, p in zip(keep, parent))
    assert sum(o for o, k in zip(odds, keep) if k) == best


def _article(source):
    inside = source[source.index("<article>") + 9:].split("</article>")[0]
    parts = (" ".join(html.unescape(re.sub(r"</?b>", "", re.sub("<br>", " ", p))).split()) for p in re.split("</?(?:h1|p)>", inside))
    return "\n\n".join(p for p in parts if p)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet("/root/testdata/sf0.01/pages.parquet")


@pytest.fixture(scope="module")
def model(pages):
    return extraction.fit(pages)


def test_extraction_of_the_given_pages(spark, pages, model):
    """Nearly every page exactly its article, also pages that were not learned from."""
    rest = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").where("page_id % 4 = 3 and page_id > 300")
    rows = rest.select("page_id", "html").collect()
    got = {r["page_id"]: r["text"] for r in extraction.extract(rest, model).collect()}
    exact = sum(got[r["page_id"]] == _article(r["html"]) for r in rows)
    assert exact >= 0.98 * len(rows)


def test_extraction_of_other_layouts(model):
    """Layouts that were not learned from: what is kept is the main text."""
    shares = []
    r = random.Random(2)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(500)]
    for k in range(150):
        main = [" ".join(r.choice(vocabulary) for _ in range(r.randint(15, 90))) + "." for _ in range(r.randint(2, 12))]
        page = dom.Page(extraction._Layout(main, [], 10**6 + k).html)
        want = Counter(w for t in page.texts.values() if extraction._MARK in t for w in t.split())
        got = Counter(model.texts([page])[0].split())
        shares.append(2 * sum((want & got).values()) / max(sum(want.values()) + sum(got.values()), 1))
    assert sum(shares) / len(shares) > 0.93


def test_extraction_of_odd_rows(spark, model):
    deep = "<div>" * 300 + "<p>deep</p>"
    rows = [(1, "u", None, 9, "t"), (2, None, "", 9, "t"), (None, "u", "<article><p>" + "word and more. " * 40 + "</p></article>", 9, "t"),
            (3, "u", deep, 9, "t"), (3, "u", deep, 9, "t"), (4, "u", "<nav><a href='/x'>y</a></nav><article>" + "<p>A long text, of many words here.</p>" * 20000 + "</article><footer>z</footer>", 9, "t")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text long, n_chars string")
    got = extraction.extract(table, model).collect()
    assert sorted((r["page_id"] or 0, r["url"] or "") for r in got) == sorted((r[0] or 0, r[1] or "") for r in rows)
    by = {r["page_id"]: r["text"] for r in got}
    assert by[1] == by[2] == "" and by[4].count("\n\n") == 19999
    assert by[None] == ("word and more. " * 40).strip()
    hot = table.select(F.lit(1).cast("long").alias("page_id"), "url", "html")
    assert extraction.fit(hot) is not None
    assert all(r["text"] == "" for r in extraction.extract(table, None).collect())
