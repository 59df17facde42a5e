"""Main text of pages: labelled layouts, densities by brute force, hostile markup."""

from __future__ import annotations

import html as html_lib
import math
import random
import re

import pytest

from sieveworks.llm import main_text

P = ["The council met on Monday to settle the budget of the coming year, and sat until late.", "Three members spoke against it; two more had left by then, as the minutes say.", "A vote follows in May &amp; the mayor signs it&nbsp;then."]
WANT = "Budget settled\n\n" + "\n\n".join(html_lib.unescape(p).replace("\xa0", " ") for p in P)
BODY = "<h1>Budget settled</h1>" + "".join(f"<p>{p}</p>" for p in P)
NAV = '<nav><ul><li><a href="/a">Home</a><li><a href="/b">News of the region</a></ul></nav>'
FOOT = "<footer><p>&copy; 2024 The Paper, all rights reserved, set in a small town far away from here.</p></footer>"


def page(body, head="<title>Budget</title><style>p{}</style><script>var t='</p>';</script>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


@pytest.mark.parametrize(
    "body",
    [
        f"{NAV}<article>{BODY}</article>{FOOT}",
        f"<header><h2>The Paper</h2><p>A daily of the region</p></header>{NAV}<main>{BODY}<aside><p>More from us about many things you may like to read today or tomorrow.</p></aside></main>{FOOT}",
        f'<div class="top-menu"><a href="/">Home</a> <a href="/x">All the other pages of ours</a></div><div id="content"><article>{BODY}<section class="comments"><p>I do not agree with a word of this, and said so at length before.</p></section></article></div>',
        f'<div id="cookieNotice">We use cookies to make this page better for you and for all of our partners.</div><div class="page has-sidebar"><div class="story">{BODY}</div><div class="sidebar"><p>Weather today is fine in most places of the region.</p></div></div>{FOOT}',
        f'<form action="/all"><div class="wrap">{NAV}<main>{BODY}<form><label>Mail</label><input><button>Send</button></form></main></div></form>',
        f'<div class="ad">Buy now, the best there is, for a price that is nearly nothing at all, today only.</div><article>{BODY}<article><p>A reader writes that this is wrong in a number of ways.</p></article></article>',
        f'<table><tr><td><a href="/">Menu</a> <a href="/2">Other</a></td><td><div>{BODY}</div></td></tr></table>',
        f'<div><a href="/1">One</a> <a href="/2">Two</a> <a href="/3">Three things more to see</a></div><div><div>{BODY}</div></div><div><a href="/4">Last</a></div>',
        f'<div role="dialog"><p>Sign up for our letter and never miss a thing that happens here.</p></div><main class="with-comments"><header>{BODY[:23]}</header>{BODY[23:]}</main>',
        f"<noscript>Please turn on scripts to see this page as it is meant to be seen.</noscript><article>{BODY}",
    ],
)
def test_labelled_layouts(body):
    assert main_text.extract(page(body)) == WANT


def test_blocks_white_space_and_references():
    got = main_text.extract(page("<article><h1> A\n\t title </h1>x <b>y</b>z<br>w<p>one<p>t&#119;o &lt;b&gt; &eacute;&hellip; &unknown; &amp<ul><li>i<li>j</ul><table><tr><th>k<td>1<tr><td>m<td>2</table><pre> a\n b </pre><!-- c -->tail</article>"))
    assert got.split("\n\n") == ["A title", "x yz w", "one", "two <b> é… &unknown; &", "i", "j", "k 1", "m 2", "a b", "tail"]


def test_short_articles_win_over_long_notices():
    assert main_text.extract(page(f'{NAV}<div class="ad">A very long advert that says a great many things about nothing.</div><article><h1>No.</h1><p><b>No.<br></article>{FOOT}')) == "No.\n\nNo."


@pytest.mark.parametrize("text", [None, "", "   ", "<", "<p", "</p></div>", "<!-- never closed", "<script>x", "<html><head><title>t</title></head><body></body></html>", "&#0;&#xD800;"])
def test_nothing_to_find(text):
    assert main_text.extract(text).strip("<�") == ""


def test_hostile_markup_takes_linear_time():
    assert main_text.extract("<div>" * 60_000 + "deep text" + "</div>" * 10) == "deep text"
    assert main_text.extract("<p><b>" * 40_000 + "x") == "x"
    assert main_text.extract("<body>" + "<p>some words here</p>" * 50_000).count("\n\n") == 49_999
    assert len(main_text.extract("<article><p>" + "word " * 700_000)) == 3_499_999


def brute(html):
    """Densities and sums of all nodes, from their definition, by recursion."""
    p = main_text.Page()
    p.feed(html)
    p.finish()
    gone = main_text._prune(p)
    kids = {k: [j for j in range(1, len(p.tag)) if p.parent[j] == k and not gone[j]] for k in range(len(p.tag))}
    under = lambda k: [k] + [x for j in kids[k] for x in under(j)]
    size = lambda nodes, links: sum(len(re.sub(r"\s", "", t)) for t, o, a in zip(p.pieces, p.owner, p.linked) if t and o in nodes and (a or not links))
    body = p.tag.index("body") if "body" in p.tag else 0
    ratio = size(under(body), True) / max(size(under(body), False), 1)

    def dens(nodes, t, lt):
        c, lc = size(nodes, False), size(nodes, True)
        if not c:
            return 0.0
        base = max(math.e, math.log(c / max(c - lc, 1) * lc + ratio * c + math.e))
        return c / t * math.log(c / max(lc, 1) * t / max(lt, 1)) / math.log(base)

    block = lambda k: k == 0 or p.tag[k] in main_text._BLOCK
    inline = lambda k: [x for j in kids[k] if not block(j) for x in [j, *inline(j)]]
    below = lambda k: [x for j in kids[k] for x in ([j] if block(j) else below(j))]
    each = {k: dens(under(k), len(under(k)), sum(p.tag[j] == "a" for j in under(k))) for k in range(len(p.tag)) if not gone[k]}
    sums = {k: dens([k, *inline(k)], 1 + len(inline(k)), sum(p.tag[j] == "a" for j in inline(k))) + sum(each[j] for j in below(k)) for k in each if block(k)}
    return p, gone, each, sums


def test_densities_are_those_of_their_definition():
    rng = random.Random(4)
    for _ in range(60):
        html = ["<body>"]
        for _ in range(rng.randrange(3, 60)):
            html.append(rng.choice(["<div>", "</div>", "<p>", "</p>", "<a href=x>", "</a>", "<b>", "</b>", "<br>", "<ul><li>", "</ul>", "<nav>", "</nav>", " some words ", "w", "<section class=ad>", "</section>"]))
        p, gone, each, sums = brute("".join(html))
        d = main_text.Densities(p, gone)
        for k, v in each.items():
            assert d.density[k] == pytest.approx(v), (k, html)
        for k, v in sums.items():
            assert d.sum[k] == pytest.approx(v), (k, html)


def test_rows_of_every_kind(spark):
    rows = [(1, "u", page(f"<article>{BODY}</article>"), "x", 5), (1, "u", page(f"<article>{BODY}</article>"), "x", 5), (None, None, None, "x", 5), (2, "v", "", "x", 5), (2**60 + 1, "w", "<p>a b " + "c" * 100_000, "x", 5)]
    got = sorted((tuple(r) for r in main_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")).collect()), key=repr)
    assert got == sorted([(1, "u", WANT, len(WANT)), (1, "u", WANT, len(WANT)), (None, None, "", 0), (2, "v", "", 0), (2**60 + 1, "w", "a b " + "c" * 100_000, 100_004)], key=repr)
    assert main_text.main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_articles_of_the_test_pages(spark):
    path = "/root/testdata/sf0.001/pages.parquet"
    for r in spark.read.parquet(path).collect():
        inner = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S)[1]
        blocks = [" ".join(html_lib.unescape(re.sub(r"<[^>]+>", " ", re.sub("</?b>", "", b))).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert main_text.extract(r.html) == "\n\n".join(b for b in blocks if b)
