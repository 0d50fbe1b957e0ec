import re

import numpy as np

from millrace.llm import html_extract as op
from millrace.llm import lstm
from millrace.llm.html_blocks import blocks_of
from millrace.llm.train_blocks import labelled


def brute(page):
    """What stands in the article element, for pages that have one with plain paragraphs and headings."""
    return "\n".join(text for _, text, _ in blocks_of(re.search(r"<article>(.*?)</article>", page, re.S).group(1)))


def test_blocks():
    page = "<title>no</title><script>var t='</p>';</script><p>a &amp;  b<br>c<p>d &#233;<!-- x --><li>one<li>two</ul><div>e<b>f</b>\n g</div>h"
    assert [t for _, t, _ in blocks_of(page)] == ["a & b c", "d é", "one", "two", "ef g", "h"]
    assert blocks_of("") == [] and blocks_of("<p>") == [] and [t for _, t, _ in blocks_of("plain <")] == ["plain <"]


def test_query_equals_the_article_of_every_page(spark):
    pages = {r.page_id: r for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    got = op.query(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == brute(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_held_out_layouts():
    made = [m for m in map(labelled, range(900_000, 900_300)) if len(m[2])]  # the training's seeds are smaller
    odds = lstm.scores(op.weights(), [m[1] for m in made])
    right = np.concatenate([(o > 0) == (m[2] > 0) for o, m in zip(odds, made)])
    assert right.mean() > 0.985


def test_gradient_equals_differences():
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in lstm.fresh(5, 3, 0).items()}
    x, mask = lstm.padded([rng.standard_normal((4, 5)), rng.standard_normal((2, 5))])
    y = (rng.random(mask.shape) > 0.5) * mask
    _, g = lstm.gradient(w, x.astype(np.float64), mask, y)
    for k in w:
        at = np.unravel_index(rng.integers(w[k].size), w[k].shape)
        e = {n: v.copy() for n, v in w.items()}
        e[k][at] += 1e-3
        up = lstm.gradient(e, x, mask, y)[0]
        e[k][at] -= 2e-3
        assert abs((up - lstm.gradient(e, x, mask, y)[0]) / 2e-3 - g[k][at]) < 2e-3


def test_edges(spark):
    rows = [(1, "u", None, "c"), (2, None, "", "c"), (None, "u", "<p>", "c"), (4, "u", "<article><p>" + "Thand er ing. " * 20_000 + "</p></article>", "c"), (4, "u", "", "c"), (4, "u", "", "c")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, Text string")
    got = op.extracted(df).collect()
    assert len(got) == 6 and sum(r.n_chars for r in got) == len("Thand er ing. " * 20_000) - 1
    assert op.extracted(df.limit(0)).collect() == []


def test_open_hidden_elements_end():
    texts = lambda page: [t for _, t, _ in blocks_of(page)]
    for start in ("<body>", "", "<body class=x><hr>"):
        assert texts(f"<html><head><meta charset=x><title>no</title><style>p {{}}</style>{start}<article><p>one<p>two</article>") == ["one", "two"]
    assert texts("<head><title>no</title><link href=x>plain <p>one") == ["plain", "one"]
    assert texts("<head><title>no</title><img src=x>plain") == texts("<head><title>no</title><span>plain</span>") == ["plain"]
    assert texts("<head><noscript><link href=x><body><p>one") == texts("<head><title>no<body><p>one") == ["one"]
    for tag in ("noscript", "iframe", "object", "svg", "canvas", "select", "math", "datalist", "textarea", "template"):
        assert texts(f"<p>one</p><{tag}>no<p>two</p><{tag}>no<p>no</p></{tag}><p>three</p>") == ["one", "two", "three"], tag
        assert texts(f"<p>one <b><{tag}>no</b> two</p><{tag}/><p>three") == ["one two", "three"], tag
        assert texts(f"<{tag}>no<p>no<div>no</div></{tag}><p>one") == ["one"], tag
    assert texts("<object>no<svg><p>no</p></svg><p>one</p>") == ["one"]
    assert texts("<select><option>no<option>no<p>one</p>") == ["one"]


def test_deep_and_unclosed_markup_takes_linear_time():
    import time

    def seconds(n):
        page = "<article><p>one</p>" + "<div><span>x</b></i>" * n + "</article><p>two"
        began = time.process_time()
        found = blocks_of(page)
        assert len(found) == n + 2
        return time.process_time() - began

    seconds(100)
    assert seconds(40_000) < 12 * max(0.2, seconds(5_000))


def test_rows_at_once_change_nothing(monkeypatch):
    rng = np.random.default_rng(1)
    w = lstm.fresh(6, 4, 0)
    pages = [rng.standard_normal((n, 6)).astype(np.float32) for n in (1, 7, 23)]
    want = lstm.scores(w, pages)
    monkeypatch.setattr(lstm, "ROWS", 5)
    assert all(np.allclose(a, b, atol=1e-6) for a, b in zip(want, lstm.scores(w, pages)))


def test_articles_in_many_wrappers_are_whole():
    words = [f"Paragraph {i} has some words that stand in the article, and more of them. It goes on." for i in range(12)]
    article = "<article><h1>Title of it</h1>" + "".join(f"<p>{p}</p>" for p in words) + "</article>"
    for n in (0, 3, 10, 40):
        for wrap, end in (("<div>", "</div>"), ("<div class=container><section class=row>", "</section></div>"), ("<div><span>", "")):
            page = "<html><body><nav class=menu><ul><li>Home<li>News</ul></nav>" + wrap * n + article + end * n + "<footer>All rights reserved.</footer>"
            assert op.texts_of([page], op.weights()) == ["\n".join(["Title of it", *words])], (n, wrap)
