"""Main text by line blocks, ranked search over tries, threshold joins: against plain recomputation, on small rows."""

from __future__ import annotations

import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from taxlake.llm import fp_search, hard_negatives, line_blocks

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


# ---------------------------------------------------------------- main text

PROSE = "The quick brown fox jumps over the lazy dog while nobody in the small village looks on."

PAGES = {
    "plain article": (
        f"<html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href=x>Home</a></ul></nav>"
        f"<!-- ad --><div class='ad'>{PROSE}</div><article><h1>Title &amp; more</h1><p>{PROSE}</p><p>Short.</p><p>a&nbsp;b<br>c</p></article>"
        f"<footer>&copy; all rights {PROSE}</footer></body></html>",
        ["Title & more", PROSE, "Short.", "a b c"],
    ),
    "advert, form and script inside the article": (
        f"<article><h1>Head</h1><p>{PROSE}<div class='advert-box'>Buy {PROSE}</div><form><p>Your mail</p><input></form><p>End <b>bold"
        f"<script>x('<p>no</p>')</script></p></article>",
        ["Head", PROSE, "End bold"],
    ),
    "reader comments, also as articles": (
        f"<main><article><p>{PROSE}</p></article><section id='comments'><article><p>I disagree. {PROSE}</p></article></section>"
        f"<article class='comment'><p>Me too. {PROSE}</p></article></main>",
        [PROSE],
    ),
    "no article element, sidebar and notice by name": (
        f"<body><header><p>{PROSE}</p></header><div id='cookie-notice'>We use cookies. {PROSE}</div><div class='with-sidebar'><h1>Head</h1><p>{PROSE}</p>"
        f"<p>Short end.</p></div><div class='sidebar'><p>{PROSE}</p></div><div>Contact</div></body>",
        ["Head", PROSE, "Short end."],
    ),
    "menus without names dive": (
        f"<div><ul><li><a>One</a><li><a>Two</a><li><a>Three</a><li><a>Four</a></ul></div><div><p>{PROSE}</p><p>{PROSE} Twice.</p></div>"
        "<div><ul><li><a>Five</a><li><a>Six</a><li><a>Seven</a><li><a>Eight</a></ul></div>",
        [PROSE, f"{PROSE} Twice."],
    ),
    "an article inside a menu without an end, a page inside a form": (
        f"<form id=aspnet><nav><a>Home</a><article><h1>Head</h1><p>{PROSE}</p></article></form>", ["Head", PROSE],
    ),
    "hidden parts and links around the end": (
        f"<article><p hidden>{PROSE}</p><p style='display: none'>{PROSE}</p><p>{PROSE} <a href=y>linked</a> words</p>"
        "<ul><li><a>Next</a></li><li><a>Last</a></li></ul></article>",
        [f"{PROSE} linked words"],
    ),
    "quotes with signs and odd tags": (
        f"<article><p title='a > b' data-x=\"<p>\">{PROSE} 1 < 2 &lt; 3</p><P>Upper</P></article>", [f"{PROSE} 1 < 2 < 3", "Upper"],
    ),
    "nothing but what is outside": ("<body><nav>a</nav><footer>b</footer></body>", []),
    "text without markup": ("just  some\n text", ["just some text"]),
    "an article cut off": (f"<article><h1>Head</h1><p>{PROSE}</p><p>And th", ["Head", PROSE, "And th"]),
}


@pytest.mark.parametrize("name", PAGES)
def test_main_text(name):
    page, blocks = PAGES[name]
    assert line_blocks.main_text(page) == "\n\n".join(blocks)


@pytest.mark.parametrize(
    "unit", ["<!--", "<script>", "<a ", '<a "', '<a ">', "<div>", "<b>", "<form>x", "<", "&", "<p>x", "<span class=ad>", "<title>", "<a><div>", "</div>", "<svg>", "<article><nav>"]
)
def test_main_text_takes_one_scan(unit):
    started = time.perf_counter()
    line_blocks.main_text("<article>" + unit * 40_000 + PROSE)
    assert time.perf_counter() - started < 8


def test_main_text_rows(spark):
    rows = [(1, "u", PAGES["plain article"][0]), (1, "u", PAGES["plain article"][0]), (None, None, None), (2, None, ""), (9007199254740993, "v", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("n_chars", F.lit("x"))
    got = line_blocks.extracted(pages).collect()
    text = "\n\n".join(PAGES["plain article"][1])
    expected = [(1, "u", text, len(text))] * 2 + [(None, None, "", 0), (2, None, "", 0), (9007199254740993, "v", "x", 1)]
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)
    assert line_blocks.extracted(pages.where("false")).count() == 0


# ---------------------------------------------------------------- ranked search


def lowered(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranked_by_force(docs, items, k):
    vectors = [(i, Counter(lowered(t))) for i, t in docs]
    vectors = [(i, c) for i, c in vectors if c]
    n_docs, n_terms = len(vectors), sum(sum(c.values()) for _, c in vectors)
    df = Counter(t for _, c in vectors for t in c)
    wanted = defaultdict(set)
    for item, text in items:
        wanted[item] |= set(lowered(text))
    out = []
    for item, terms in wanted.items():
        scores = []
        for doc, c in vectors:
            m = 50 + 50 * sum(c.values()) * n_docs // n_terms
            score = 0
            for t in terms & set(c):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m))
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scores, key=lambda s: s[:3])[:k])]
    return out


def search_rows(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"W{i}é" if i % 7 == 0 else f"word{i}" for i in range(120)]
    weights = [1 / (i + 1) for i in range(120)]
    docs = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.choice((1, 5, 40, 300)))).replace(" ", rng.choice((" ", "-", "\n")))) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, " .,"), (n + 3, docs[0][1]), (0, docs[0][1]), (None, docs[1][1]), (n + 4, "word1 " * 30_000)]
    docs += [(n + 10 + i, "word2 word3 word4 word60") for i in range(90)]  # one path, many ties
    items = [(i, " ".join(rng.choices(vocabulary, k=12))) for i in range(8)]
    return docs, items + [(20, None), (21, "!!"), (22, "unheardof"), (3, "word2 WORD3"), (23, "word2 word3 word4 word60"), (None, "word5 word6")]


@pytest.mark.parametrize("leaf,tree,pairs", [(32, 32_768, 1_000_000), (2, 64, 1_000_000), (1, 32_768, 30)])
def test_ranked_search_against_brute_force(spark, monkeypatch, leaf, tree, pairs):
    monkeypatch.setattr(fp_search, "LEAF", leaf)
    monkeypatch.setattr(fp_search, "TREE_DOCS", tree)
    docs, items = search_rows(leaf, 250)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumn("rank", F.lit(1)).withColumn("item_id", F.lit(2))
    of = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(2)).withColumn("term", F.lit("x"))
    got = [tuple(r) for r in fp_search.ranked(df, of, 7, pairs).collect()]
    assert sorted(got, key=str) == sorted(ranked_by_force(docs, items, 7), key=str)


def test_tree_bounds_hold_and_leave_out():
    rng = np.random.default_rng(5)
    sizes = rng.integers(0, 12, 3_000)
    terms = np.concatenate([np.sort(rng.choice(60, s, replace=False, p=np.r_[np.full(10, 0.06), np.full(50, 0.008)])) for s in sizes])
    counts, m = rng.integers(1, 6, len(terms)), rng.integers(60, 400, len(sizes))
    tree = fp_search.Tree(np.arange(3_000), np.zeros(3_000, bool), m, sizes, terms, counts, np.arange(60))
    ranges = sorted((a, b) for a, b, c in zip(tree.low, tree.high, tree.children) if not c)
    assert [a for a, _ in ranges] == [0, *(b for _, b in ranges[:-1])] and ranges[-1][1] == 3_000
    seen = []

    class Watch(fp_search.Best):
        def offer(self, score, ids, null):
            seen.append(len(ids))
            super().offer(score, ids, null)

    best = Watch(5)
    tree.search(np.array([3, 30, 45]), np.array([500, 4_000, 4_000]), np.zeros(60, np.int64), best)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    weight = {3: 500, 30: 4_000, 45: 4_000}
    force = [
        sum(weight.get(int(t), 0) * int(fp_search.parts_of_score(c, m[d])) for t, c in zip(terms[starts[d] : starts[d + 1]], counts[starts[d] : starts[d + 1]]))
        for d in range(3_000)
    ]
    assert best.score.tolist() == sorted(force, reverse=True)[:5]
    assert sum(seen) < 1_000


def test_ranked_search_empty(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert fp_search.ranked(docs, items).count() == 0
    assert fp_search.ranked(items.select(F.col("item_id").alias("doc_id"), "text"), items.where("false")).count() == 0


# ---------------------------------------------------------------- hard negatives


def negatives_by_force(rows, anchors, positives, window, low, high):
    """``rows`` are (id, label, vector of whole numbers); ids may repeat and then count with their best score."""
    out = []

    def score(a, b):
        return sum(x * y for x, y in zip(a, b))

    def first(found, n):
        top = {}
        for s, i in found:
            top[i] = max(s, top.get(i, s))
        return sorted(((s, i) for i, s in top.items()), key=lambda e: (-e[0], e[1]))[:n]

    for anchor, label, v in anchors:
        for positive, p in first([(score(v, w), i) for i, of, w in rows if of == label and i != anchor], positives):
            inside = [(score(v, w), i) for i, of, w in rows if of != label]
            inside = [(s, i) for s, i in inside if low * positive <= 100 * s <= high * positive]
            out += [(anchor, p, r + 1, i, positive, s) for r, (s, i) in enumerate(first(inside, window))]
    return out


def vector_rows(seed, n, dims):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, dims))
    labels = rng.choice(4, n, p=[0.7, 0.2, 0.08, 0.02])
    spread = rng.choice([0.1, 1.0, 3.0], n)
    vectors = np.rint(100 * (centres[labels] * rng.choice([0, 1, 1], n)[:, None] + spread[:, None] * rng.normal(size=(n, dims))))
    return [(int(i), int(labels[i]), [int(x) for x in vectors[i]]) for i in range(n)]


@pytest.mark.parametrize("dims,block,pilot", [(24, 4_096, 2_048), (40, 3, 20), (5, 4_096, 1)])
def test_hard_negatives_against_brute_force(spark, monkeypatch, dims, block, pilot):
    monkeypatch.setattr(hard_negatives, "BLOCK", 64)
    rows = vector_rows(dims, 400, dims)
    rows += [(400 + i, 1, rows[0][2]) for i in range(30)] + rows[:3] + [(500, 2, [0] * dims), (501, 3, []), (502, 0, [7])]
    anchors = [r for r in rows[:400] if r[0] % 20 == 0] + [(500, 2, [0] * dims), (501, 3, [])]
    df = spark.createDataFrame(rows, "id long, label long, v array<int>").repartition(3)
    got = hard_negatives.hard_negatives(df, spark.createDataFrame(anchors, df.schema), block=block, pilot=pilot)
    assert sorted(map(tuple, got.collect())) == sorted(negatives_by_force(rows, anchors, 5, 10, 30, 90))


def test_index_leaves_out_dimensions_and_finds_all():
    rng = np.random.default_rng(3)
    x = np.rint(200 * rng.normal(size=(500, 40)) * np.linspace(0.1, 2, 40))
    q = np.rint(200 * rng.normal(size=40) * np.linspace(0.1, 2, 40))
    norms = hard_negatives.prefix_norms(q[None, :])[0]
    for least in (-1e9, 0, 200_000, 700_000, 1e9):
        index = hard_negatives.Index(np.arange(500), np.zeros(500), x, least, norms[-1])
        rows, score = index.search(q, norms, least)
        force = (x @ q).astype(int)
        assert sorted(index.ids[rows]) == list(np.flatnonzero(force >= least)) and (score == force[index.ids[rows]]).all()
        if least >= 700_000:
            assert (index.postings != 0).sum() < 0.9 * (x != 0).sum()


def test_mined_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.normal(size=6)], int(i % 10)) for i in range(0, 330)]
    odd = [(None, [1.0] * 6, 1), (1000, None, 1), (1001, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (1002, [inf] * 6, 1), (1003, [nan] * 6, 1), (1100, [1.0] * 6, None), (1004, [1e30] * 6, 9), (1200, [], 4)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").withColumn("id", F.lit("x")).withColumn("list", F.lit(1))
    whole = [
        (i, (label + 1) % 10 if i % 7 == 0 else label, [max(min(math.floor(256 * float(np.float32(x))), 2**25), -(2**25)) for x in v])
        for i, v, label in rows + [odd[6], odd[7]]
    ]
    got = sorted(map(tuple, hard_negatives.mined(df).collect()))
    assert got == sorted(negatives_by_force(whole, [r for r in whole if r[0] % 100 == 0], 5, 10, 30, 90))
    assert hard_negatives.mined(df.where("false")).count() == 0
    assert hard_negatives.mined(df.where("vec_id = 100")).count() == 0
