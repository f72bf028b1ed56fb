import random
import re
from html import unescape

import numpy as np
import pytest

from sparsegrove.llm.html_extract import ChainField, blocks_of, extract_main_text, labelled_page, trained_field


@pytest.fixture(scope="module")
def field():
    return trained_field(200)


def test_viterbi_finds_the_best_chain(field):
    import itertools

    for seed in range(20):
        page = blocks_of(labelled_page(random.Random(seed)))[:9]
        active = field.active(page)

        def total(labels):
            s = field.begin[labels[0]] + sum(field.weights[f, y].sum() for f, y in zip(active, labels))
            return s + sum(field.steps[a, b] for a, b in zip(labels, labels[1:]))

        best = max(itertools.product((0, 1), repeat=len(page)), key=total)
        assert abs(total(best) - total([int(x) for x in field.decode(page)])) < 1e-9


def test_training_raises_the_likelihood():
    pages = [blocks_of(labelled_page(random.Random(i))) for i in range(10)]
    names = sorted({"bias", "first", "last", "between", *(n for p in pages for b in p for n in b[1].features())})
    trained = ChainField(names).train([p for p in pages if p], rounds=60)
    right = [(b[3] == "1") == y for p in pages for b, y in zip(p, trained.decode(p))]
    assert np.mean(right) > 0.9


def test_held_out_pages(field):
    rng = random.Random(77)
    right = [(b[3] == "1") == y for _ in range(150) for p in [blocks_of(labelled_page(rng))] for b, y in zip(p, field.decode(p))]
    assert np.mean(right) >= 0.98


def test_pages_and_edge_cases(spark, field):
    d = "/root/testdata/sf0.001"
    pages = spark.read.parquet(f"{d}/pages.parquet")
    for r in extract_main_text(pages, field).join(pages.select("page_id", "html"), "page_id").collect():
        inside = re.search("<article>(.*?)</article>", r["html"], re.S).group(1)
        assert r["text"] == " ".join(unescape(re.sub("<[^>]+>", " ", inside)).split())
    page = "<html><body><nav><a href=/>Menu</a></nav><article><h1>T &amp; U</h1><p>One\n two&nbsp;three<p>Four<b>teen</b>.<script>var x='<p>'</script></article><div id=comments><p>Nice!</p></div><footer>&copy; me</footer>"
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (None, "u", page), (4, "u", "<<<>&#xD800;<p"), (5, "u", "<article><p>" + "word " * 60_000)]
    got = {r["page_id"]: r["text"] for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), field).collect()}
    assert got[1] == got[None] == "T & U One two three Fourteen." and got[2] == got[3] == "" and len(got[5]) == 5 * 60_000 - 1
    assert extract_main_text(pages.where("false"), field).count() == 0


def test_a_deep_page_needs_memory_and_time_in_proportion(field):
    import tracemalloc

    deep = "<body><article>" + "".join(f"<div class='c{i % 7} body'>a{i} <b>" for i in range(80_000))
    tracemalloc.start()
    page = blocks_of(deep, field.index)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(deep) > 2_000_000 and len(page) == 80_000 and peak < 250e6 and len(field.decode(page)) == 80_000
    assert len(blocks_of("<div>" * 30_000 + "x" + "</section>" * 30_000, field.index)) == 1


def test_math_comments_doctypes_and_long_blocks(spark, field):
    long = " ".join(["The story goes on and on about many things."] * 30 + ["A cookie was eaten, and comments were made."])
    rows = [
        (1, "<body><article><p>As <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> shows.</p></article>"),
        (2, "<body><article><p>Said and done.</p></article><!-- not <p>closed"),
        (3, "<!DOCTYPE html [ <!ENTITY a 'b'> ]><html><body><article><p>Said and done.</p></article>"),
        (4, f"<body><nav><a href=/>Menu</a></nav><article><h1>Title</h1><p>{long}</p></article>"),
        (5, "<body><script>if (a <!-- b) {}</script><article><p>Said and done.</p></article>"),
    ]
    clash = spark.createDataFrame([(i, "u", h, "x") for i, h in rows], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r["text"] for r in extract_main_text(clash, field).collect()}
    assert got == {1: "As x=2 shows.", 2: "Said and done.", 3: "Said and done.", 4: "Title " + long, 5: "Said and done."}


ARTICLE = "<article><h1>Title</h1><p>One two three four five six seven.</p></article>"


@pytest.mark.parametrize(
    "before",
    [
        '<div title="a <!-- b"></div>',
        "<style><!-- p{} </style>",
        "<form><textarea><!-- x</textarea></form>",
        "<!-- x --!>",
        "<!-->",
        "<!--->",
        "<!---->",
        "<script>var a = '<!-- b';</script>",
        "<script><!-- document.write('<script>x</script>'); --></script>",
        "<script>//<![CDATA[\nvar x = '<p>';//]]></script>",
        "<style>p{}</style x='1'>",
        "<![CDATA[ hidden ]]>",
        "<![foo[ hidden ]]>",
        "<! hidden>",
        "<?php hidden ?>",
        "<![ 5>",
        "<title>A <!-- title</title>",
        "<iframe><!-- none</iframe>",
    ],
)
def test_marks_of_comments_elsewhere_hide_nothing(field, before):
    page = blocks_of(f"<html><body>{before}{ARTICLE}</body></html>", field.index)
    assert " ".join(b[0] for b, keep in zip(page, field.decode(page)) if keep) == "Title One two three four five six seven."


def test_comments_hide_what_they_hold():
    texts = lambda html: [b[0] for b in blocks_of(html)]
    assert texts("<p>a</p><!-- <p>b</p> --><p>c</p>") == ["a", "c"] and texts("<p>a</p><!-- <p>b</p>") == ["a"]
    assert texts("<p>a<!-- x --!>b</p>") == ["ab"] and texts("<svg><text><![CDATA[a<b]]></text></svg>") == ["a<b"]
    assert texts("<p>a</p><script>b") == ["a"] and texts("<textarea>x<p>open</p>") == [] and texts("<p>a</p><!doctype") == ["a"]
