"""Labelled pages for the extraction model.

``data-content`` marks an element's label (1: main text, 0: not); elements
without it take their parent's.  The pages are written here, from skeletons
filled with plain sentences, and cover the usual page parts: menus, headers,
footers, sidebars, notices, adverts, forms, reader comments and articles in
semantic and in generic markup.
"""

from __future__ import annotations

_LONG = ("The river rose two metres in a single night and the lower meadows were under water by morning. Farmers moved "
         "their animals to the hill before the road was closed. Nobody was hurt, but the mill will stay shut for weeks. "
         "A warm spring and old dams made it worse than in any year that people here remember.")
_MID = "Most of the bridges held, although two of them must be repaired before heavy carts may cross."
_SHORT = "It was quiet again by noon."
_HEAD = "Water in the lower meadows"
_LINKS = '<a href="/a">Home</a>', '<a href="/b">News</a>', '<a href="/c">Sport</a>', '<a href="/d">Contact us</a>'

_MENU = "<nav data-content=0><ul>" + "".join(f"<li>{a}</li>" for a in _LINKS) + "</ul></nav>"
_DIV_MENU = '<div class="menu" data-content=0><ul>' + "".join(f"<li>{a}</li>" for a in _LINKS) + "</ul></div>"
_FOOT = "<footer data-content=0>&copy; 2020 The Paper. All rights reserved.</footer>"
_FOOT_P = '<footer data-content=0><p>&copy; 2020 The Paper.</p><p><a href="/x">Imprint</a> <a href="/y">Privacy</a></p></footer>'
_DIV_FOOT = '<div id="footer" data-content=0><p>Copyright The Paper, Mill Lane 4.</p></div>'
_ADVERT = '<div class="ad" data-content=0>Buy two pairs of boots and get the third one free today.</div>'
_ADVERT_P = f'<div class="sponsored" data-content=0><p>{_MID}</p><p><a href="/buy">Order now</a></p></div>'
_SIDE = ('<aside data-content=0><h3>Most read</h3><ul><li><a href="/1">A mill is sold to its workers</a></li>'
         '<li><a href="/2">Snow in May</a></li></ul></aside>')
_SIDE_P = f"<aside data-content=0><h4>About us</h4><p>{_MID}</p></aside>"
_DIV_SIDE = f'<div class="sidebar" data-content=0><div><h3>Related</h3><p>{_MID}</p><p>{_SHORT}</p></div></div>'
_NOTICE = '<div class="cookie-notice" data-content=0><p>We use cookies to make this site work. You can change this at any time.</p></div>'
_NOTICE_DIV = '<div id="consent" data-content=0>By reading on you agree to our terms and to our use of cookies.</div>'
_FORM = ('<form data-content=0><p>Get our letter every week, free of charge.</p><label>Name</label><input name="n">'
         '<button>Send</button></form>')
_FORM_DIV = '<form action="/s" data-content=0><div><label>Search this site</label><input></div></form>'
_REMARKS = (f'<section class="comments" data-content=0><h2>Comments</h2><div class="comment"><p>{_MID}</p></div>'
            f'<div class="comment"><p>I saw it from my window. {_SHORT}</p></div></section>')
_REMARKS_LIST = f'<div id="comments" data-content=0><h3>2 replies</h3><ol><li><p>{_LONG}</p></li><li>{_SHORT}</li></ol></div>'
_HEADER = f"<header data-content=0><h1>The Paper</h1><p>News from the valley since 1887</p>{_MENU}</header>"
_DIV_HEADER = '<div class="header" data-content=0><div>The Paper</div><p>News from the valley</p></div>'

_BODY = f"<h1>{_HEAD}</h1><p>{_LONG}</p><p>{_MID}</p><p>{_SHORT}</p><p>{_LONG}</p>"
_LOOSE = f"<h1>{_HEAD}</h1><p><b>{_MID}<br><p>{_LONG}</p><p>{_SHORT}</p><p>Yes</p>"
_RICH = (f"<h1>{_HEAD}</h1><p>{_LONG}</p><h2>After the flood</h2><p>{_MID} <a href='/z'>The report</a> says so.</p>"
         f"<ul><li>{_SHORT}</li><li>Two bridges are shut</li></ul><blockquote><p>{_MID}</p></blockquote>"
         f"<figure><figcaption>The mill in April</figcaption></figure><table><tr><td>Dam</td><td>{_SHORT}</td></tr></table><p>{_LONG}</p>")
_PLAIN = f"<div><p>{_LONG}</p><p>{_MID}</p></div><div>{_LONG}</div>"


def _page(before: str, body: str, after: str) -> str:
    return f"<!DOCTYPE html><html><head><title>{_HEAD}</title></head><body>{before}{body}{after}</body></html>"


def _article(inner: str) -> str:
    return f"<article data-content=1>{inner}</article>"


def _main(inner: str) -> str:
    return f"<main data-content=1>{inner}</main>"


def _div(cue: str, inner: str) -> str:
    return f'<div class="{cue}" data-content=1>{inner}</div>'


#: every frame with every body in turn
_FRAMES = [
    (_MENU + _ADVERT, _FOOT), (_HEADER + _NOTICE, _SIDE + _FOOT_P), (_DIV_HEADER + _DIV_MENU, _DIV_SIDE + _DIV_FOOT),
    (_NOTICE_DIV + _MENU, _REMARKS + _FOOT), (_HEADER + _FORM_DIV, _ADVERT_P + _REMARKS_LIST + _DIV_FOOT),
    (_DIV_MENU + _ADVERT, _FORM + _SIDE_P + _FOOT), (_MENU, _REMARKS_LIST + _FORM + _FOOT_P),
]
_BODIES = [_article(_BODY), _article(_LOOSE), _article(_RICH), _main(_article(_BODY)), _main(_RICH), _div("content", _BODY),
           _div("post-body", _RICH), _div("entry", _PLAIN), _article(f"<h1>{_HEAD}</h1><p>{_SHORT}</p>"),
           _article(f"<div>{_BODY}</div>" + _ADVERT + f"<p>{_LONG}</p>"), _main(f"<section>{_BODY}</section>" + _SIDE),
           _article(f"<header><h1>{_HEAD}</h1></header><section><h2>Dams</h2><p>{_LONG}</p></section>" + _REMARKS),
           _article(f"<p>{_SHORT}</p>"), _article(_HEAD)]

PAGES = [_page(before, body, after) for body in _BODIES for before, after in _FRAMES]
