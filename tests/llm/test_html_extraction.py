"""Main text of pages: hand-marked pages, a plain second version, broken markup, and what the ratios are good for."""

from math import exp, log1p

import numpy as np
import pyarrow.parquet as pq
import pytest
from helpers_llm import FOLDER

from orderflow.llm import html_extract

LONG = "The river had risen in the night, and those who lived by the mill had carried their beds and their clocks up the hill before the first light came."
MORE = "Nobody spoke of it at the market, where the price of hay and the wedding of the miller's son were the two things that mattered to people that week."
SHORT = "So it was."
LINKS = "".join(f"<li><a href='/{k}'>Section {k}</a></li>" for k in range(12))
ADVERT = "Buy two pairs of our boots today and get the third one for nothing, delivered to your door within a day wherever you live, no questions asked at all."
BODY = f"<h1>A flood</h1><p>{LONG}</p><p>{SHORT}</p><p>{MORE} <a href='/x'>more</a></p>"
WANTED = f"A flood {LONG} {SHORT} {MORE} more"

MARKED = {
    "article": f"<html><head><title>t</title><style>p{{}}</style></head><body><nav><ul>{LINKS}</ul></nav><article>{BODY}</article><footer>Imprint</footer></body>",
    "no names": f"<body><div><ul>{LINKS}</ul></div><div>{BODY}</div><div><ul>{LINKS}</ul></div></body>",
    "no container": f"<body><ul>{LINKS}</ul>{BODY}<ul>{LINKS}</ul><div>Imprint</div></body>",
    "in sections": f"<body><div><ul>{LINKS}</ul></div><div><div><h1>A flood</h1><p>{LONG}</p><p>{SHORT}</p></div><div><p>{MORE} <a href='/x'>more</a></p></div></div></body>",
    "in a cell": f"<table><tr><td>{''.join(f'<a href=/{k}>Section {k}</a><br>' for k in range(12))}</td><td>{BODY}</td></tr></table>",
    "long advert": f"<body><article>{BODY.replace('<p>So', f'<div class=ad-slot><p>{ADVERT}</p><p>{ADVERT}</p></div><p>So')}</article></body>",
    "advert beside": f"<body><div><p id='sponsored'>{ADVERT}</p></div><div>{BODY}</div></body>",
    "comments": f"<body><main>{BODY}<section class='comments'><article><p>{MORE}</p></article><article><p>{LONG} {LONG} {MORE}</p></article></section></main></body>",
    "teasers": f"<body><article><a href='/'>First</a></article><article>{BODY}</article><article><a href='/'>Second</a></article></body>",
    "header within": f"<body><header>Site <p>{ADVERT}</p></header><article><header><h1>A flood</h1></header>{BODY.removeprefix('<h1>A flood</h1>')}</article></body>",
    "forms": f"<body><div>{BODY}<form><p>{ADVERT}</p><select><option>a</select></form><script>var x = '<p>{LONG}</p>';</script><noscript>{LONG}</noscript></div></body>",
    "cookie note": f"<body><div class='cookie-consent'><p>{ADVERT} {ADVERT} {ADVERT}</p></div><div>{BODY}</div></body>",
    "roles": f"<body><div role=navigation>{LONG}</div><div>{BODY}</div><div aria-hidden=true>{LONG}</div></body>",
    "references": f"<body><article>{BODY.replace('A flood', '&#65; fl&ouml;&ouml;d').replace('flöö', 'floo')}</article></body>".replace("fl&ouml;&ouml;d", "f&#108;ood"),
    "blanks": f"<body><article>{BODY.replace(' ', chr(10) + chr(9) + ' ')}</article></body>".replace("<a\n\t href", "<a href"),
}


@pytest.mark.parametrize("name", MARKED)
def test_marked_pages(name):
    assert html_extract.main_text(MARKED[name]) == WANTED


BROKEN = {
    "<p>a</p><![foo[bar]]>b": "a b",
    "a<![ %x": "a",
    "a<![CDATA[x]]>b": "ab",
    "<p>a</p><!": "a",
    "<p>a<!>b": "ab",
    "<p>a<!doctype html>b": "ab",
    "<p>a<!-- never <p>ends": "a",
    "<p>a<!-->b": "ab",
    "<p>a<!-- x --!>b": "ab",
    "<p>a<?php echo 1 ?>b": "ab",
    "<p>a<?": "a",
    "<p>a</p><div class='x": "a",
    "<p>a</p><p title='x>b</p><p>c": "a b c",
    "<p>a</p></": "a </",
    "<p>a</p></p": "a",
    "a < b &amp; c > d": "a < b & c > d",
    "a <": "a <",
    "&amp": "&",
    "<script>x": "",
    "</div></p>a": "a",
    "<!ELEMENT br EMPTY><p>a": "a",
    "": "",
    "<p></p>": "",
}


@pytest.mark.parametrize("html", BROKEN)
def test_broken_markup(html):
    assert html_extract.main_text(html) == BROKEN[html]


@pytest.mark.parametrize("unit", ["<!--", "<![", "<?", "</", "<a b='", "<!x", "&#", "<", "<p", "<b><p>w "])
def test_long_broken_markup_takes_linear_time(unit):
    html_extract.main_text(unit * 100_000)


def plain_version(html):
    """The definition, line by line and element by element."""
    parser = html_extract._Lines()
    parser.feed(html)
    parser.close()
    lines, n = parser.lines, len(parser.lines)
    if not lines:
        return ""
    above = []
    for x in lines:
        path, e = [], x.element
        while e is not None:
            path.insert(0, e)
            e = e.parent
        above.append(path)
    ratio = [0.0 if x.element.named else log1p(len(x.text) / max(1, x.tags)) for x in lines]
    smooth = []
    for i in range(n):
        near = [(exp(-((i - j) ** 2) / 2 / html_extract.SIGMA**2), ratio[j]) for j in range(n) if abs(i - j) <= int(3 * html_extract.SIGMA)]
        smooth.append(sum(w * r for w, r in near) / sum(w for w, _ in near))
    low, high = min(smooth), max(smooth)
    for _ in range(20):
        upper, lower = [v for v in smooth if v >= (low + high) / 2], [v for v in smooth if v < (low + high) / 2]
        if not upper or not lower:
            low = high = min(smooth)
            break
        low, high = sum(lower) / len(lower), sum(upper) / len(upper)
    cut = (low + high) / 2
    block = [next((e for e in reversed(p) if e.tag in html_extract.BLOCKS), p[0]).tag for p in above]
    good = [s >= cut - 1e-9 and (b in html_extract.TEXTUAL or r >= cut - 1e-9) and not x.element.named for s, b, r, x in zip(smooth, block, ratio, lines, strict=True)]
    able = {}
    for k, path in enumerate(above):
        for depth, e in enumerate(path):
            if depth == 0 or e.tag in html_extract.REGIONS and not e.named:
                inside = [i for i in range(n) if e in above[i]]
                able[e] = (sum(len(lines[i].text) * (1 if good[i] else -1) for i in inside), depth, inside[0])
    most = max(b for b, _, _ in able.values())
    for tag in ("article", "main"):
        named = [(b, -first, -depth, e) for e, (b, depth, first) in able.items() if e.tag == tag and b >= max(most, 1) / 2]
        if named:
            region = max(named, key=lambda t: t[:3])[3]
            break
    else:
        fit = [(depth, -first, e) for e, (b, depth, first) in able.items() if b >= html_extract.SHARE * most or depth == 0]
        region = max(fit, key=lambda t: t[:2])[2]
    out = []
    for i, x in enumerate(lines):
        short = block[i] in html_extract.HEADINGS or block[i] in html_extract.TEXTUAL and x.linked < 0.8 * len(x.text)
        if region in above[i] and not x.element.named and (region.tag in ("article", "main") or good[i] or short):
            out.append(x.text)
    return " ".join(out)


def given_pages():
    return [r["html"] for r in pq.read_table(f"{FOLDER}/pages.parquet").to_pylist()]


def without_names(html):
    for tag in ("article", "nav", "footer"):
        html = html.replace(f"<{tag}>", "<div>").replace(f"</{tag}>", "</div>")
    return html.replace(' class="ad"', "")


def test_same_as_the_plain_version():
    for html in (*MARKED.values(), *BROKEN, *given_pages(), *map(without_names, given_pages())):
        assert html_extract.main_text(html) == plain_version(html)


def article_of(html):
    return html_extract.main_text("<article>" + html.split("<article>")[1].split("</article>")[0] + "</article>")


def test_given_pages():
    """A page's article, word for word; with all names taken away most are found still."""
    pages = given_pages()
    assert [html_extract.main_text(x) for x in pages] == [article_of(x) for x in pages]
    assert sum(html_extract.main_text(without_names(x)) == article_of(x) for x in pages) >= 0.85 * len(pages)


def test_constant_ratios_do_worse(monkeypatch):
    """Where no name helps, the ratios do."""
    pages = [(without_names(x), article_of(x)) for x in given_pages()]
    pages += [(MARKED[k], WANTED) for k in ("no names", "no container", "in sections", "in a cell")] * 3
    right = lambda: sum(html_extract.main_text(x) == y for x, y in pages)
    with_ratios = right()
    monkeypatch.setattr(html_extract, "_ratios", lambda lines: np.ones(len(lines)))
    assert with_ratios >= right() + len(pages) // 5


def test_elements_that_never_close():
    """Time grows with the length of a page, not with how deep its elements stand."""
    for html, text in (("<b>word ", "word"), ("<p>w<b>", "w"), ("<p></x>a", "a")):
        assert html_extract.main_text(html * 20_000) == " ".join([text] * 20_000)
    assert set(html_extract.main_text("<div>word " * 20_000).split()) == {"word"}


def test_names_that_only_hold_a_mark_decide_nothing():
    """Slugs of headings and sections within an article; menus, comments and lists of links go all the same."""
    text = lambda word: "".join(f"<p>{(word + ' ') * 60}</p>" for _ in range(3))
    page = (
        '<body><div class="nav"><ul>' + "".join(f"<li><a href=x>menu {k}</a></li>" for k in range(12)) + "</ul></div><article>" + text("intro") + '<h2 id="related-work">Related work</h2>' + text("word")
        + '<section id="header-files">' + text("files") + '</section><section id="login-guide"><h3 id="login">Login</h3>' + text("guide") + '</section><p id="cookie">crumb</p><div class="comments">' + text("nice")
        + '</div><div id="related-articles-elsewhere"><ul><li><a href=x>one two three</a></li><li><a href=y>four five six</a></li></ul></div>' + text("last") + "</article><footer>foot</footer></body>"
    )
    assert list(dict.fromkeys(html_extract.main_text(page).split())) == "intro Related work word files Login guide crumb last".split()
