"""Cases in which an operator once did less than its whole job."""

import math
import random
from itertools import combinations

import pytest

from pixelrel.llm import decontaminate, html, lines


def test_repeated_rows_keep_a_line(spark):
    rows = [(1, "a b c"), (1, "a b c"), (2, "a b c"), (2, "x y z\nx y z"), (2, "x y z\nx y z")]
    got = sorted((r.doc_id, r.text) for r in lines.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, "a b c"), (1, "a b c"), (2, ""), (2, "x y z"), (2, "x y z")]


ARTICLE = "<p>The first paragraph of an ordinary page, long enough to count as text.</p><p>Short end.</p>"


@pytest.mark.parametrize("wrapper", ['class="has-sidebar"', 'class="layout-with-sidebar"', 'class="no-sidebar wide"', 'class="sticky-header"', 'id="search-page"', 'class="has-comments"'])
@pytest.mark.parametrize("tag", ["article", "section"])
def test_html_wrappers_named_after_a_part(wrapper, tag):
    page = f'<body><nav>Menu</nav><div {wrapper}><{tag}>{ARTICLE}</{tag}><div class="sidebar"><a>Some</a> <a>other</a></div></div><footer>Imprint</footer></body>'
    assert html.main_text(page) == "The first paragraph of an ordinary page, long enough to count as text. Short end."


def test_html_head_of_an_article():
    for name in ("entry-header", "post-header", "header"):
        assert html.main_text(f'<article><div class="{name}"><h1>Title</h1></div>{ARTICLE}<div class="share">Share this</div></article>').startswith("Title The first")
        assert "Share" not in html.main_text(f'<article><div class="{name}"><h1>Title</h1></div>{ARTICLE}<div class="share">Share this</div></article>')
    hidden = f'<article>{ARTICLE}</article><section class="comment-list"><article><p>{"Remarks of a reader. " * 20}</p></article></section><aside><article>{ARTICLE}</article></aside>'
    assert html.main_text(hidden).count("Short end.") == 1 and "Remarks" not in html.main_text(hidden)


@pytest.mark.parametrize("n", range(1, 12))
def test_masks_of_short_items_miss_nothing(n):
    for differ in combinations(range(n), n - math.ceil(n * decontaminate.AGREE)):
        assert any(not any(mask[j - at] == "1" for j in differ if at <= j < at + len(mask)) for at, mask in decontaminate.short_masks(n))


def test_decontamination_of_short_items(spark):
    rnd = random.Random(8)
    docs, bench, want = [], [], {}
    for n in range(1, 13):
        item = [f"w{n}x{k}" for k in range(n)]
        bench.append((n, " ".join(item)))
        may = n - math.ceil(n * decontaminate.AGREE)
        for differ in [(), *combinations(range(n), may), tuple(range(may + 1))]:
            text = ["swapped" if k in differ else w for k, w in enumerate(item)]
            # at the start, in the middle and at the end of a text; differing ends fall off it
            for around in (lambda t: [*t, "z"], lambda t: ["z", *t, "z"], lambda t: ["z", *t], lambda t: [w for w in t if w != "swapped"] if differ == tuple(range(len(differ))) else t):
                docs.append((len(docs), " ".join(around(text))))
                if len(differ) <= may:
                    want[len(docs) - 1, n] = n - len(differ)
    rnd.shuffle(docs)
    d, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(bench, "item_id long, text string")
    assert {(r.doc_id, r.item_id): r.matched for r in decontaminate.overlaps(d, b).collect()} == want
