"""Templates decide what is main text: with all marks taken away, pages give the same texts."""

import os
import re

import pytest

from cairnflow.llm import extract
from cairnflow.llm.html_tokens import Page

SF = "/root/testdata/sf0.001"


def without_marks(html):
    """Every element that says what it is becomes a plain one."""
    return re.sub(r"<(/?)(?:nav|article|main|footer|header|aside|section)\b[^>]*>", r"<\1div>", re.sub(r' (?:class|id|role)="[^"]*"', "", html))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pages_without_marks_give_the_same_text(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    marked = {r.page_id: r.text for r in extract.extract(pages).collect()}
    rows = [(r.page_id, r.url, without_marks(r.html)) for r in pages.collect()]
    plain = {r.page_id: r.text for r in extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert plain == marked
    shown = {r.page_id: " ".join(t for _, t in Page(r.html).pieces).split() for r in pages.collect()}
    assert all(len(marked[k].split()) < len(w) for k, w in shown.items())  # the template leaves something out of every page


def test_template_overrules_the_mark(spark):
    """A wrapper that is named like a menu holds the articles, and an element that calls itself an article a fixed notice."""
    make = lambda i: (
        f"<body class='has-sidebar'><article>Subscribe to us now</article><div class='footer'><p>Story {i}, told at length on page {i * 7}, "
        f"has {i + 3} parts and an end.</p></div></body>"
    )
    rows = [(i, "http://odd.example/%d" % i, make(i)) for i in range(30)]
    for r in extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        assert r.text.startswith(f"Story {r.page_id}, told") and "Subscribe" not in r.text


def test_names_that_speak_of_the_page_only(spark):
    html = "<body class='has-sidebar comments-open'><article><header class='entry-header'><h1>T</h1></header><p>Text of it.</p></article></body>"
    assert extract.main_text(html) == "T\n\nText of it."


@pytest.mark.parametrize(
    "html",
    ["<a " * 350_000, '<p x="' * 160_000, "<a b='\"> <c \"' " * 70_000, "<div>" * 100_000 + "x", "<div>" * 50_000 + "</section></p>" * 50_000,
     "< " * 300_000, "<script>" * 100_000, "<!--" * 200_000, "<div class='a b'><p>hello</div>" * 20_000],
    ids=["open tags", "odd quotes", "mixed quotes", "deep", "unmatched", "signs", "scripts", "comments", "flat"],
)
def test_long_pages_take_linear_time(html):
    import time

    began = time.process_time()
    extract.main_text(html)
    assert time.process_time() - began < 20  # a quadratic pass takes many minutes


def words(seed, n):
    """Sentences of their own for every page."""
    import random

    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefghij", k=r.randrange(2, 9))) for _ in range(n))


SHAPES = {
    "marked block": lambda i, k: f"<nav><ul><li><a href=/a>Home</a></li></ul></nav><article><h1>{words(i, 6)}</h1><p>{words(i + 500, 60)}</p></article><div class='comments'><p>{words(i + 900, k)}</p></div><footer>All rights</footer>",
    "marked block beside a plain one": lambda i, k: f"<div><a href=/a>Home</a></div><div><h1>{words(i, 6)}</h1><p>{words(i + 500, 60)}</p></div><div id='comments'><p>{words(i + 900, k)}</p></div><div>All rights</div>",
    "inside the article": lambda i, k: f"<article><h1>{words(i, 6)}</h1><p>{words(i + 500, 60)}</p><section class='comments'>{''.join(f'<div><b>{words(i + j, 1)}</b><p>{words(i * 9 + j, k // 4)}</p></div>' for j in range(4))}</section></article>",
    "plain article before an unmarked list": lambda i, k: f"<div><a href=/a>Home</a></div><div><h1>{words(i, 6)}</h1><p>{words(i + 500, 60)}</p></div><div>{''.join(f'<div><b>{words(i + j, 1)}</b><span>{words(i + j + 7, 1)}</span><p>{words(i * 9 + j, k // 3)}</p></div>' for j in range(3 + i % 3))}</div><div>All rights</div>",
    "article before an unmarked list": lambda i, k: f"<article><h1>{words(i, 6)}</h1><p>{words(i + 500, 60)}</p></article><div>{''.join(f'<div><b>{words(i + j, 1)}</b><span>{words(i + j + 7, 1)}</span><p>{words(i * 9 + j, k // 3)}</p></div>' for j in range(3 + i % 3))}</div>",
    "adverts and related pages": lambda i, k: f"<div class='ad'>{words(i + 77, k)}</div><article><h1>{words(i, 6)}</h1><p>{words(i + 500, 60)}</p><aside class='related'><p>{words(i + 31, k // 2)}</p></aside></article><div class='related'><ul><li><a href=/x>{words(i + 3, k)}</a></li></ul></div>",
}


@pytest.mark.parametrize("shape", sorted(SHAPES))
def test_comments_of_any_length_stay_out(spark, shape):
    """From a fifth of the article to five times as long; twelve pages of a host each."""
    rows = [(100 * n + i, f"http://h{n}.example/{i}", f"<html><body>{SHAPES[shape](100 * n + i, k)}</body></html>") for n, k in enumerate((12, 60, 80, 300)) for i in range(12)]
    got = {r.page_id: r.text for r in extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for page, text in got.items():
        assert text == f"{words(page, 6)}\n\n{words(page + 500, 60)}", (shape, page)


def test_articles_in_parts_are_whole(spark):
    """Parts of an article are alike too, but they are no list that follows it, and an introduction is not all."""
    parts = lambda i: "".join(f"<section><h2>{words(i + j, 3)}</h2><p>{words(i * 7 + j, 40)}</p></section>" for j in range(4))
    rows = [(i, f"http://parts.example/{i}", f"<body><div><a href=/>Home</a></div><div><p>{words(i + 50, 30)}</p>{parts(i)}</div><div>All rights</div></body>") for i in range(15)]
    rows += [(100 + i, f"http://only.example/{i}", f"<body><div><a href=/>Home</a></div><div>{parts(i)}</div><div>All rights</div></body>") for i in range(15)]
    got = {r.page_id: r.text for r in extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(15):
        whole = "\n\n".join(f"{words(i + j, 3)}\n\n{words(i * 7 + j, 40)}" for j in range(4))
        assert got[100 + i] == whole and got[i] == f"{words(i + 50, 30)}\n\n{whole}"


def test_labels_other_than_zero_and_one_are_none(spark):
    from cairnflow.llm import quality, toxicity

    docs = spark.createDataFrame([(i, ("bad awful rot " if i % 2 else "fine clear good ") * 9) for i in range(60)], "doc_id long, text string")
    odd = spark.createDataFrame([(i, 2 if i < 10 else -1 if i < 14 else i % 2, 2 if i < 10 else i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    plain = odd.where("doc_id >= 14")
    for module in (quality, toxicity):
        scores = [sorted((r.doc_id, r.score) for r in module.score(docs, module.fit(docs, labels)).collect()) for labels in (odd if module is quality else odd.where("toxic < 2 AND doc_id >= 14"), plain)]
        assert scores[0] == scores[1]
    module = toxicity
    assert module.score(docs, module.fit(docs, odd)).count() == 60
