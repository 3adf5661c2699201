"""Main texts of pages as they are commonly built; every text is told apart by its words."""

import time

import pytest

from zonecraft.llm import html_extract

LONG = "This paragraph of the article says something at length, with a comma or two, and ends as sentences do."
A, B = f"First. {LONG}", f"Second. {LONG}"
NAV = '<nav><a href="/">Home</a> <a href="/n">News</a></nav>'
FOOT = "<footer>&copy; 2024 Somebody. All rights reserved.</footer>"
OFFER = "Buy one now and get another one for free, only this week and only in this shop, while there are some left to sell."
COMMENTS = "".join(f"<div class='comment'><b>Reader {i}</b><p>I have read it all and think that it is great, thanks a lot for writing this text down.</p></div>" for i in range(30))

PAGES = {
    "wrapper named after its sidebar": (f'<body><div class="layout sidebar-left">{NAV}<div class="content"><h1>Title</h1><p>{A}</p></div><div class="sidebar">{OFFER}</div></div>{FOOT}', f"Title {A}"),
    "wrapper named right-sidebar, nothing else named": (f'<body><div id="page" class="right-sidebar"><div><h1>Title</h1><p>{A}</p><p>{B}</p></div></div>{FOOT}', f"Title {A} {B}"),
    "body class with widgets": (f'<body class="has-sidebar cookie-consent-open"><article><p>{A}</p></article><div class="cookie-consent">{OFFER}</div>', A),
    "form around the page": (f'<body><form method="post" action="./default.aspx" id="form1"><input type="hidden" name="x">{NAV}<div class="page"><h1>Title</h1><p>{A}</p><p>{B}</p></div></form>{FOOT}', f"Title {A} {B}"),
    "form inside the article": (f"<article><p>{A}</p><form><label>Your mail</label><input><button>Send</button> {OFFER}</form><p>{B}</p></article>", f"{A} {B}"),
    "title in a div entry-header": (f'<div class="site-header">Site name</div><div class="entry-header"><h1 class="entry-title">Title</h1></div><div class="entry-content"><p>{A}</p></div><div class="entry-footer">{OFFER}</div>', f"Title {A}"),
    "title in a header entry-header": (f'<article class="post"><header class="entry-header"><h1>Title</h1></header><div class="entry-content"><p>{A}</p></div><footer class="entry-footer">Filed under things</footer></article>', f"Title {A}"),
    "title in a header beside the text": (f'<header class="post-header"><h2>Title</h2></header><section class="post-content"><p>{A}</p></section><header class="site-header"><p>{OFFER}</p></header>', f"Title {A}"),
    "list of links in the article": (f'<article><p>{A}</p><ul><li><a href="/a">One entry</a></li><li><a href="/b">Two</a></li><li><a href="/c">Three more entries</a></li></ul><p>{B}</p></article>{NAV}', f"{A} One entry Two Three more entries {B}"),
    "more comments than article": (f'<body><div class="main"><h1>Title</h1><p>{A}</p></div><section id="comments">{COMMENTS}</section>{FOOT}', f"Title {A}"),
    "comments as articles": (f"<main><h1>Title</h1><p>{A}</p></main><section class='comments'>{COMMENTS.replace('div', 'article')}</section>", f"Title {A}"),
    "teasers as articles in an aside": (f"<body><div><h1>Title</h1><p>{A}</p><p>{B}</p><p>{A}</p></div><aside><article><a href='/x'>Another story to read</a></article><article><a href='/y'>And one more</a></article></aside>{FOOT}", f"Title {A} {B} {A}"),
    "short article, long footer": (f"<article><h1>Title</h1><p>Short text.</p></article><footer>{OFFER} {OFFER} {OFFER}</footer>", "Title Short text."),
    "advert in the article": (f'<article><p>{A}</p><div class="ad-container"><p>{OFFER}</p></div><div class="share-bar"><a href="#">Share</a></div><p>{B}</p></article>', f"{A} {B}"),
    "modal at the end": (f'<main><p>{A}</p></main><div role="dialog"><p>{OFFER}</p></div><div hidden><p>{OFFER}</p></div><div style="display: none">{OFFER}</div>', A),
    "tables for the layout": (f"<table><tr><td><a href='/'>Home</a><br><a href='/n'>News</a></td><td><h1>Title</h1><p>{A}<p>{B}</td></tr></table>", f"Title {A} {B}"),
    "no markup around": (f"{A}<br><br>{B}", f"{A} {B}"),
    "body text beside nothing named": (f"<h1>Title</h1>{NAV}<p>{A}</p><p>{B}</p><ul class='menu'><li><a href='/'>Home</a></li></ul>", f"Title {A} {B}"),
}


@pytest.mark.parametrize("name", PAGES)
def test_page(name):
    page, want = PAGES[name]
    assert " ".join(html_extract.main_blocks(page)) == want


def test_time_is_linear_in_depth():
    def took(n):
        page = "<article>" + "<div>text here " * n + "</div>" * n + "</p>" * n
        best = min(_timed(page) for _ in range(3))
        assert len(html_extract.main_blocks(page)) == n
        return best

    assert took(8000) < 7 * took(2000) + 0.2


def _timed(page):
    start = time.process_time()
    html_extract.main_blocks(page)
    return time.process_time() - start
