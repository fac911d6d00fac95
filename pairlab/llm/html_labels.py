"""A small labelled table for the block classifier: pages of the usual layouts, filled by rule.

Every element with ``data-main`` holds main text; all other text is boilerplate. The layouts are written by hand, sizes and
words come from a seeded generator: with and without <article>, with hints in class names only, with neither, where
word counts and link density of a block and its neighbours must decide, and with names such as ``entry-header`` inside an article.
"""

import random

_WORDS = ("the quick study of rivers shows that water moves stone and soil over long times while people settle near banks and "
          "build towns whose trade follows the stream from hills to sea and whose stories keep the memory of floods").split()


def _text(n: int, at: int = 0) -> str:
    return " ".join(_WORDS[(at + i) % len(_WORDS)] for i in range(n)).capitalize() + "."


def _links(n: int, at: int = 0) -> str:
    return "".join(f'<li><a href="/{i}">{" ".join(_WORDS[(at + i + j) % len(_WORDS)] for j in range(1 + i % 4))}</a></li>' for i in range(n))


def _main(sizes: list[int], at: int = 0) -> str:
    return "".join(f"<p data-main>{_text(n, at + n)}</p>" for n in sizes)


def pages() -> list[str]:
    """The labelled pages."""
    out = []
    draw = random.Random(5)
    for k in range(60):
        size = lambda: 1 + draw.randrange(draw.choice((1, 5, 20, 60, 200)))
        sizes = [size() for _ in range(1 + k % 6)]
        h1 = f"<h1 data-main>{_text(1 + k % 11, k)}</h1>"
        quote = f"<blockquote data-main>{_text(11, k)}</blockquote><ul data-main><li>{_text(4, k)}</li><li>{_text(9, k)}</li></ul>"
        linked = f'<p data-main>{_text(14, k)} <a href="/x">{_text(3, k)}</a> {_text(8, k)}</p>'
        subhead = f"<h2 data-main>{_text(3, k + 4)}</h2>"
        nav = f"<nav><ul>{_links(3 + k % 7, k)}</ul></nav>"
        menu = f'<div class="main-menu"><ul>{_links(2 + k % 8, k)}</ul></div>'
        ad = f'<div class="ad">{_text(size(), k)}</div>'
        foot = f"<footer>&copy; site &middot; {_text(size(), k)}</footer>"
        side = f'<aside><h3>{_text(1 + k % 9, k)}</h3><p>{_text(size(), k)}</p><ul>{_links(3, k)}</ul></aside>'
        sidebar = f'<div id="sidebar"><p>{_text(size(), k)}</p></div>'
        notice = f'<div class="cookie-notice"><p>{_text(size(), k)}</p><button>{_text(1)}</button></div>'
        form = f'<form action="/s"><label>{_text(3)}</label><input name="q"><button>{_text(1)}</button></form>'
        comments = f'<section class="comments"><h2>{_text(1 + k % 8)}</h2><div><p>{_text(size(), k)}</p></div><p>{_text(6, k)}</p></section>'
        teaser = f"<div><h3>{_text(1 + k % 10, k)}</h3><p>{_text(size(), k)}</p></div><p>{_text(1, k)}</p>"
        crumbs = f'<div><a href="/">{_text(1, k)}</a> <a href="/b">{_text(2, k)}</a></div>'
        head = f"<header><p>{_text(3, k)}</p><ul>{_links(3)}</ul></header>"
        # short paragraphs and titles between long paragraphs, without article or telling names
        long = lambda: 25 + draw.randrange(draw.choice((20, 60, 150)))
        short = lambda: 1 + draw.randrange(12)
        mixed = _main([n for _ in range(1 + k % 4) for n in (long(), short(), long())], k)
        last = _main([short()], k + 5)
        title = f"<h1 data-main>{_text(1 + k % 12, k)}</h1>"
        under = f"<h2 data-main>{_text(1 + k % 6, k + 2)}</h2>"
        bits = "".join(f"<div><h4>{_text(1 + (k + i) % 6, i)}</h4><p>{_text(1 + (k + 2 * i) % 9, i)}</p></div>" for i in range(3))
        legal = f"<p>{_text(1 + k % 8, k)} <a href='/t'>{_text(1 + k % 3)}</a> <a href='/p'>{_text(2)}</a></p>"
        entry = f"<div class='entry-header'><h1 data-main>{_text(1 + k % 9, k)}</h1><p data-main>{_text(short(), k)}</p></div>"
        price = f"<p class='share-price' data-main>{_text(size(), k)}</p><p id='side-effects' data-main>{_text(size(), k + 3)}</p>"
        related = f"<div class='{('related-posts', 'share-buttons')[k % 2]}'><ul>{_links(2 + k % 5, k)}</ul></div>"
        anchors = f"<h1 data-main><a href='/x'>{_text(1 + k % 9, k)}</a></h1>"
        sources = f"<p data-main><a href='/x'>{_text(short(), k)}</a> {_text(short(), k)}</p><ul data-main>{_links(1 + k % 6, k)}</ul>"
        site = f"<div class='site-header'><p>{_text(1 + k % 7, k)}</p></div>"
        out += [
            f"<html><body><ul>{_links(4 + k % 5, k)}</ul><div>{title}{_main([long()], k)}{mixed}{last}</div>{legal}</body></html>",
            f"<html><body>{crumbs}<ul>{_links(5, k)}</ul><div>{_main([long()], k)}{under}{_main([long()], k + 1)}</div>{bits}{legal}</body></html>",
            f"<html><body>{site}<ul>{_links(3 + k % 4, k)}</ul><div>{title}{mixed}{under}{mixed}{last}</div><ul>{_links(6, k)}</ul>{bits}</body></html>",
            f"<html><body>{site}{nav}<article>{entry}{_main(sizes, k)}{price}{related}</article>{bits}{foot}</body></html>",
            f"<html><body>{nav}<article>{anchors}{_main(sizes, k)}{sources}{related}</article>{bits}{legal}</body></html>",
            f"<html><body>{title}{mixed}{under}{mixed}{last}</body></html>",
            f"<html><body>{menu}<main>{anchors}{sources}{_main(sizes, k)}{related}{sources}</main><ul>{_links(3, k)}</ul></body></html>",
            f"<html><body>{menu}<article>{title}{price}{_main(sizes, k)}{under}{related}{_main([size()], k)}</article>{site}{legal}</body></html>",
            f"<html><body>{nav}{ad}<article>{h1}{_main(sizes, k)}</article>{foot}</body></html>",
            f"<html><body>{crumbs}<article>{h1}{_main(sizes, k)}</article>{teaser}<ul>{_links(6, k)}</ul></body></html>",
            f"<html><body>{teaser}<main>{h1}{subhead}{_main(sizes, k)}{quote}</main>{crumbs}</body></html>",
            f"<html><body>{head}{nav}{notice}<article>{h1}{_main(sizes, k)}{linked}{subhead}{quote}</article>{side}{comments}{foot}</body></html>",
            f"<html><body>{menu}<main>{h1}{_main(sizes, k)}{ad}{linked}{form}</main>{sidebar}{foot}</body></html>",
            f"<html><body>{head}{menu}<div class='content'>{h1}{_main([n + 12 for n in sizes], k)}{linked}</div>{sidebar}{comments}{foot}</body></html>",
            f"<html><body>{nav}<article>{h1}{_main(sizes, k)}{ad}{form}{side}{subhead}{linked}{comments}</article>{notice}{foot}</body></html>",
            f"<html><body><ul>{_links(9, k)}</ul><div>{_main([n + 25 for n in sizes], k)}</div><ul>{_links(7, k)}</ul></body></html>",
        ]
    return out
