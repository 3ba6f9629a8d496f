"""The small labelled table of the block classifier: pages written for it, whose main blocks carry ``data-label="main"``.

The classifier sees lengths, links and places, not words, so a page is laid out from an
article, what it stands in, and what stands around it.
"""

from __future__ import annotations

import random
import re

_POOL = "the survey of northern rivers took four summers and covered more than two hundred crossings most of which had never been measured before".split()
_M = ' data-label="main"'
_NOT = ' data-label="none"'


def _words(n: int) -> str:
    return " ".join((_POOL * (n // len(_POOL) + 1))[:n])


def _p(*lengths: int, tag: str = "p") -> str:
    return "".join(f"<{tag}>{_words(n)}</{tag}>" for n in lengths)


def _linked(*lengths: int, tag: str = "p") -> str:
    return "".join(f'<{tag}><a href="/{i}">{_words(n)}</a></{tag}>' for i, n in enumerate(lengths))


def _line_of_links(*lengths: int, tag: str = "div") -> str:
    return f"<{tag}>" + " ".join(f'<a href="/{i}">{_words(n)}</a>' for i, n in enumerate(lengths)) + f"</{tag}>"


def _part_linked(words: int, share: float) -> str:
    n = round(words * share)
    return f'<p>{_words(words - n)} <a href="/x">{_words(n)}</a></p>'


_MENU = f"<ul>{_linked(1, 1, 2, 1, 2, tag='li')}</ul>"

#: Articles whose lengths alone tell them from what stands around.
_ARTICLES = [
    _p(6, tag="h1") + _p(45, 30, 3, 60, 1, 25),
    _p(4, tag="h1") + _p(70) + _p(3, tag="h2") + _p(40) + _p(35, 52),
    _p(9, tag="h1") + _p(38) + _part_linked(60, 0.2) + _p(24, tag="blockquote") + _p(90, 7, 33),
    _p(28, 19, 16, 23, 31, 22),
    _p(7, tag="h2") + _p(140) + _part_linked(44, 0.3) + _p(85, 4),
    _p(5, tag="h1") + _p(55, 2, 48, 5, 66, 3),
    _p(3, tag="h1") + _p(26, 24),
    _p(4, tag="h2") + _p(31, 29, 23),
    _p(5, tag="h1") + _p(60) + f'<div class="ad"{_NOT}>{_p(8)}</div>' + _p(75, 3) + f'<div id="comments"{_NOT}>{_p(2, 95, 4, 110, 1)}</div>',
]
#: Articles that only their element tells.
_SHORT_ARTICLES = [
    _p(4, tag="h1") + _p(2),
    _p(1, tag="h1") + _p(1, 1, 3),
    _p(8, tag="h1") + _p(6, 1, 4, 12) + f"<ul>{_p(1, 2, 3, tag='li')}</ul>" + _p(2),
    _p(3, tag="h1") + "<table><tr>" + _p(1, 2, tag="td") + "</tr><tr>" + _p(1, 2, tag="td") + "</tr></table>" + _p(1),
    _p(2, tag="h1") + _linked(3) + _p(14) + _linked(6, 2) + _p(1) + _p(40),
    _p(12, 5, 1),
    _p(1),
    f"<ul>{_linked(4, 2, 7, tag='li')}</ul>" + _p(3) + _p(30, 2, 2),
]
#: What an article may stand in: before and after it.
_WRAPPERS = [
    ("<div>", "</div>"),
    ('<div class="page with-sidebar"><div>', "</div></div>"),
    ('<div class="content-side">', "</div>"),
    ('<main><section class="banner">', "</section></main>"),
    ('<form id="pageForm"><div class="header-and-body">', "</div></form>"),
    ('<table><tr><td class="search-result">', "</td></tr></table>"),
    ('<div id="promo-wrap"><div>', "</div></div>"),
]
#: What stands before articles, then what stands after them; first by their names, then by lengths and links alone.
_BEFORE = [
    "",
    f"<nav>{_MENU}</nav>",
    f'<header>{_p(3, tag="h1")}{_p(6)}</header><div id="menu">{_MENU}</div>',
    f'<div class="cookie-notice">{_p(22)}</div><div class="ad">{_p(9)}</div>',
    f'<div class="site-header">{_p(2, tag="h1")}{_p(35)}</div>{_MENU}',
    f'<div class="sponsored">{_p(90, 70)}</div><nav>{_MENU}</nav><div class="ad">{_p(14)}</div>',
    _line_of_links(1, 1, 2, 1),
    _p(3) + _line_of_links(1, 2, 1, tag="p") + _p(2) + _line_of_links(4, 3),
    _MENU + _p(5) + _linked(7, 6, 9),
    _line_of_links(6, 8, 9, 5) + _linked(1, 1),
    f'<nav>{_p(1, 2, 1, tag="li")}</nav><div hidden>{_p(40)}</div>',
]
_AFTER = [
    "",
    f"<footer>{_p(7)}{_MENU}{_p(45, 60)}</footer>",
    f'<div class="comments">{_p(2, tag="h3")}{_p(40, 3, 90, 66, 120, 150, 75)}</div><footer>{_p(4)}</footer>',
    f'<aside>{_p(3, tag="h3")}{_MENU}{_p(28)}</aside><form>{_p(14)}<label>{_words(1)}</label></form>',
    f'<div id="sidebar">{_p(18)}{_linked(6, 7)}{_p(33)}</div><div class="related">{_p(12)}{_linked(4)}{_p(16)}</div>',
    f'<section class="comments"><article>{_p(2, tag="h4")}{_p(25)}</article><article>{_p(36)}</article></section><div class="newsletter">{_p(21)}</div>',
    f'<div class="reader-comments">{_p(80, 2, 130, 5, 70, 1)}</div>',
    f'<div class="ad">{_p(6)}</div><div class="replies">{_p(1, 50, 2)}</div>',
    _linked(9, 2) + _p(5) + _line_of_links(1, 1),
    _linked(6) + _p(13) + _linked(2, 7) + _p(11) + _linked(2, 8) + _p(15) + _linked(2),
    _line_of_links(3, 2, 4) + _p(8) + _line_of_links(1, 1, 1),
    _linked(12, 14, 9) + _p(6),
    f'<div class="share">{_linked(1, 1)}</div>{_linked(3)}<p>{_words(4)}</p>{_linked(1)}',
]


#: Wordy columns that stand beside long articles only.
_LONG_ARTICLE = _p(7, tag="h1") + _p(120, 90, 8, 110, 60, 75)
_COLUMNS = [f'<div class="sidebar">{_p(60, 45, 50)}</div>', f'<div id="newsletter">{_p(70, 44)}</div>', f'<div class="related">{_p(40, 35, 42, 38)}</div>']
#: What stands inside an article's element and is no part of it.
_INSIDE = [
    "",
    f'<aside{_NOT}>{_p(17)}</aside><div class="share"{_NOT}>{_linked(1, 1)}</div>',
    f'<section id="comments"{_NOT}>{_p(1, 60, 12)}</section><p class="ad"{_NOT}>{_words(5)}</p>',
]


def _varied(page: str, seed: int) -> str:
    """The page with 0.6 to 1.6 times as many words in each run of text, and on most pages plain furniture of any length at its ends."""
    lot = random.Random(seed)
    page = re.sub(r">([^<]+)", lambda run: ">" + _words(max(1, round(len(run[1].split()) * lot.uniform(0.6, 1.6)))) + " ", page)
    first, last = (f"<{tag}>{_words(round(1.08 ** lot.randrange(60)))}</{tag.split()[0]}>" if lot.random() < 0.6 else "" for tag in (lot.choice(["header", "nav", "div class=ad", "aside"]), lot.choice(["footer", "aside", "div class=ad", "footer", "div class=comments"])))
    return page.replace("<body>", "<body>" + first).replace("</body>", last + "</body>")


def pages() -> list[str]:
    """For every pair of surroundings, articles in two wrappers and two in an element of their own; then long ones beside columns."""
    out = [f"<body>{opening}<div{_M}>{_LONG_ARTICLE}</div>{ending}{column}</body>" for opening, ending in _WRAPPERS for column in _COLUMNS]
    for i, before in enumerate(_BEFORE):
        for j, after in enumerate(_AFTER):
            k = i * len(_AFTER) + j
            for n in (k, 5 * k + 3):
                opening, ending = _WRAPPERS[n % len(_WRAPPERS)]
                out.append(f"<body>{before}{opening}<div{_M}>{_ARTICLES[(n + i) % len(_ARTICLES)]}</div>{ending}{after}</body>")
                article, tag = (_SHORT_ARTICLES + _ARTICLES)[(n + j) % (len(_SHORT_ARTICLES) + len(_ARTICLES))], ("article", "main")[n % 5 == 0]
                out.append(f"<body>{before}<{tag}{_M}>{article}{_INSIDE[n % len(_INSIDE)]}</{tag}>{after}</body>")
    return [_varied(page, 4 * i + n) for i, page in enumerate(out) for n in range(4)]
