"""HTML extraction: ratio, smoothing and threshold decide; pages with known articles through the registered query."""

import random

import numpy as np
import pytest

from pixelrel.llm import html

LONG = "<p>A paragraph of plain text that is long enough to be the content of the page, surely it is.</p>"
TEXT = "A paragraph of plain text that is long enough to be the content of the page, surely it is."
LINKS = "".join(f"<li><a href=/x{i}>Link number {i}</a></li>" for i in range(6))
PAGES = {
    "link column and rights around text without an article": (f"<body><div><ul>{LINKS}</ul>{LONG * 4}<p>Copyright 2024</p></div></body>", " ".join([TEXT] * 4)),
    "list of links in an article, without a known word": (f"<article>{LONG * 3}<ul>{LINKS}</ul>{LONG}</article>", " ".join([TEXT] * 4)),
    "breadcrumbs in main before its article": (f"<main><div><a>Home</a> &gt; <a>News</a></div><article><h1>T</h1>{LONG * 3}</article></main>", " ".join(["T"] + [TEXT] * 3)),
    "teaser after main": (f"<main><h1>T</h1>{LONG * 5}</main><article><h2>Teaser</h2><p>Short text of a teaser.</p></article>", " ".join(["T"] + [TEXT] * 5)),
    "teaser beside the article": (f"<article><h1>T</h1>{LONG * 5}</article><article><h2>Teaser</h2><p>Short text.</p></article>", " ".join(["T"] + [TEXT] * 5)),
    "a wrapper named after a part of the page": (f"<div class='has-sidebar'><h1>T</h1>{LONG * 3}<div class=sidebar><p>Most read</p></div></div>", " ".join(["T"] + [TEXT] * 3)),
    "a teaser is no article if the text stands outside": (f"<div>{LONG * 8}</div><div class=side><article><p>Teaser</p></article></div>", " ".join([TEXT] * 8)),
    "one link between paragraphs": (f"<article>{LONG}<p><a href=/>Read the paper</a></p>{LONG}</article>", f"{TEXT} Read the paper {TEXT}"),
    "only links": ("<article><p><a href=/>One</a></p></article>", "One"),
    "short article beside a longer advert": ("<div class='ad'>Buy this now, it is cheap and good and here.</div><article><h1>Hi</h1><p>Yes</p></article>", "Hi Yes"),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages_without_usual_marks(name):
    page, want = PAGES[name]
    assert html.main_text(page) == want


def test_the_threshold_decides(monkeypatch):
    before = {name: html.main_text(page) for name, (page, _) in PAGES.items()}
    monkeypatch.setattr(html, "THRESHOLD", 0.0)
    changed = {name for name, (page, _) in PAGES.items() if html.main_text(page) != before[name]}
    assert {"list of links in an article, without a known word", "teaser after main", "short article beside a longer advert"} <= changed


def test_smoothing_decides(monkeypatch):
    page, want = PAGES["one link between paragraphs"]
    monkeypatch.setattr(html, "_KERNEL", np.eye(7)[3])
    assert html.main_text(page) != want


def test_articles_come_back_through_the_query(spark, tmp_path):
    own = random.Random(11)
    word = lambda: "".join(own.choices("abcdefghé", k=own.randrange(1, 9)))
    words = lambda n: " ".join(word() for _ in range(n))
    rows, want = [(None, None, None)], {(None, None): ""}
    for i in range(120):
        blocks = [words(own.choice([1, 2, 8, 40, 200])) for _ in range(own.randrange(1, 12))]
        body = "".join(f"<{t}>{b.replace('é', '&eacute;')}</{t}>" for b, t in ((b, own.choice(["p", "p", "blockquote", "h2", "li"])) for b in blocks))
        nav = "".join(f"<li><a href=/{j}>{word()}</a>" for j in range(own.randrange(8)))
        extra = own.choice(["", f'<div class="ad">{words(9)}</div>', f"<aside>{words(30)}</aside>", f'<div id="cookie-banner"><p>{words(12)}</p></div>', f"<form><label>{word()}</label></form>"])
        comments = f'<div class="comments"><p>{words(60)}</p></div>' if i % 3 == 0 else ""
        rows.append((i, f"http://h/{i}", f"<html><head><title>{word()}</title></head><body><nav><ul>{nav}</ul></nav>{extra}<article>{body}{comments}</article>{extra}<footer>&copy; {words(20)}</footer></body></html>"))
        want[i, f"http://h/{i}"] = " ".join(blocks)
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = html.op7_html_extraction(spark, str(tmp_path)).collect()
    assert {(r.page_id, r.url): r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def test_no_pages(spark):
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
