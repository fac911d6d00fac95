"""HTML extraction over the given pages: article text by a plain reading of their markup, defined cases."""

import html
import re

import helpers as H
from pairlab.llm import html_blocks, html_labels


def article(page):
    inner = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
    inner = re.sub(r"<[a-zA-Z/!][^<>]*$", "", inner)
    blocks = [" ".join(html.unescape(re.sub("</?b>", "", x).replace("<br>", " ")).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
    return "\n\n".join(b for b in blocks if b)


def test_given_pages(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["page_id"]: r for r in html_blocks.extract(spark.read.parquet(f"{sf}/pages.parquet")).collect()}
    rows = H.rows_of(sf, "pages", "page_id, url, html")
    assert len(got) == len(rows)
    for i, url, page in rows:
        assert got[i]["text"] == article(page) and got[i]["url"] == url and got[i]["n_chars"] == len(got[i]["text"])


def test_held_out_labelled_pages():
    """The tree of two thirds of the labelled pages decides the others."""
    import numpy as np

    found = [html_blocks.blocks(p) for p in html_labels.pages()]
    x = [html_blocks.features(f) for f in found]
    y = [np.array([b[7] for b in f], float) for f in found]
    held = [i for i in range(len(found)) if i % 3 == 0]
    rest = [i for i in range(len(found)) if i % 3]
    tree = html_blocks.grow(np.concatenate([x[i] for i in rest]), np.concatenate([y[i] for i in rest]))
    wrong = sum(((html_blocks.predict(tree, x[i]) >= 0.5) != (y[i] > 0)).sum() for i in held)
    assert wrong <= 0.01 * sum(len(y[i]) for i in held)


NAV = "<ul><li><a href='/'>Home</a></li><li><a href='/news'>Latest news</a></li><li><a href='/about'>About us</a></li></ul>"
LONG = ("The harbour was built in the last century when fishing boats still came in every morning and the market sold its catch before "
        "noon, and many of the old sheds are now used by painters and small shops.")


def test_pages_written_by_hand():
    """Layouts that are not among the labelled ones: names inside an article, short paragraphs, no article at all."""
    keep = html_blocks.main_text
    page = f"<body><nav>{NAV}</nav><article><div class='entry-header'><h1>Old harbour</h1></div><p>{LONG}</p></article><footer>All rights reserved</footer></body>"
    assert keep(page) == f"Old harbour\n\n{LONG}"
    page = f"<body><main><h1>Markets</h1><p>{LONG}</p><p class='share-price'>Shares rose by two.</p><p>{LONG}</p><div class='ad'>Buy now</div></main></body>"
    assert keep(page) == f"Markets\n\n{LONG}\n\nShares rose by two.\n\n{LONG}"
    page = f"<body>{NAV}<div><h1>Old harbour</h1><p>{LONG}</p><p>It rained all day.</p><p>{LONG}</p><p>So it goes.</p></div><p>Terms <a href='/t'>and conditions</a> <a href='/p'>privacy</a></p></body>"
    assert keep(page) == f"Old harbour\n\n{LONG}\n\nIt rained all day.\n\n{LONG}\n\nSo it goes."
    page = f"<body>{NAV}<article><h1><a href='/a'>Old harbour</a></h1><p>{LONG}</p><p>See <a href='/b'>the new harbour</a></p><ul><li><a href='/c'>All harbours</a></li></ul></article></body>"
    assert keep(page) == f"Old harbour\n\n{LONG}\n\nSee the new harbour\n\nAll harbours"
    page = f"<body><article><p>{LONG}</p><p>{LONG}</p><div class='related-posts'>{NAV}</div><section class='comments'><p>{LONG}</p></section></article></body>"
    assert keep(page) == f"{LONG}\n\n{LONG}"


def used(tree):
    return set() if len(tree) == 1 else {html_blocks.FEATURES[tree[0]]} | used(tree[2]) | used(tree[3])


def test_the_tree_reads_counts_of_the_block_and_its_neighbours():
    counts = {"words", "links", "words_before", "links_before", "words_after", "links_after"}
    assert len(used(html_blocks.trained()) & counts) >= 4


def test_defined_cases(spark):
    rows = [(1, None, None, "n"), (None, "u", "", "n"), (2, "u", "<p>", "n"), (3, "v", "<article><p>Hello there.</p></article>", "n"),
            (3, "v", "<article><p>Hello there.</p></article>", "n"), (4, "w", "<article>" + "<p>word word.</p>" * 20_000 + "</article>", "n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = H.by_id(html_blocks.extract(pages), "page_id")
    assert got[1][0]["text"] == got[None][0]["text"] == got[2][0]["text"] == "" and got[2][0]["n_chars"] == 0
    assert [r["text"] for r in got[3]] == ["Hello there."] * 2
    assert got[4][0]["n_chars"] == 20_000 * 12 - 2
    assert html_blocks.extract(pages.limit(0)).count() == 0
