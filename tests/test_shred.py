"""The tree builder alone, without Spark."""

import time
from html.parser import HTMLParser

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.functions import shred as S


def tree(html):
    nodes, runs, error = S.read_page(html)
    assert error is None
    return nodes, runs


def texts(html):
    nodes, runs = tree(html)
    return {(n.pre, n.tag): "".join(runs[n.t0 : n.t1]) for n in nodes}


def test_unclosed_tags_nest():
    nodes, _ = tree("<p>a<b>x<p>c</div></b>d")
    assert [(n.tag, n.parent, n.last) for n in nodes] == [("p", -1, 2), ("b", 0, 2), ("p", 1, 2)]


def test_end_tag_closes_nearest():
    nodes, _ = tree("<div><div><p>x</div>y</div><i></i>")
    assert [(n.tag, n.parent) for n in nodes] == [("div", -1), ("div", 0), ("p", 1), ("i", -1)]
    assert [n.child_idx for n in nodes] == [1, 1, 1, 2]


def test_void_and_self_closing():
    nodes, _ = tree("<p>a<br>b</br><img src=x>c<div/>d</p>")
    assert [(n.tag, n.parent) for n in nodes] == [("p", -1), ("br", 0), ("img", 0), ("div", 0)]


def test_hidden_text_and_comments():
    got = texts("<div>a<script>if (a<b) {}</script><!-- c --><style>p{}</style>b</div>")
    assert got[(0, "div")] == "ab"
    _, runs = tree("<p>a<!-- c -->b</p>")
    assert runs == ["a", "b"]


def test_own_string():
    own = lambda html: tree(html)[0][0].own
    assert own("<h1>Rules</h1>") == "Rules"
    assert own("<h1><b><i>Rules</i></b></h1>") == "Rules"
    assert own("<h1>Our <b>rules</b></h1>") is None
    assert own("<h1>Rules<!-- x --></h1>") is None
    assert own("<h1></h1>") is None


def test_entities():
    assert tree("<p>a &amp; b &eacute; &#233; &#x41; &nope; &#150;</p>")[1] == ["a & b é é A &nope –"]
    nodes, runs = tree("<p>x &amp; y</p><p>&#65;&eacute;</p>")
    assert runs == ["x & y", "Aé"]


def test_attributes():
    node = tree('<a HREF="/u?x=1&amp;y=2" class="b  c" hidden>z</a>')[0][0]
    assert dict(node.attrs) == {"href": "/u?x=1&y=2", "class": "b  c", "hidden": None}


def test_bad_page_is_reported():
    nodes, runs, error = S.read_page("<p>a</p><![other[x]]>")
    assert nodes == [] and runs == [] and error.startswith("AssertionError")


PIECES = st.sampled_from(
    [
        "<div>", "</div>", "<p>", "</p>", "<b>", "</b>", "<br>", "<br/>", "<LI>", "</li >", "text", " ", "\n",
        "&amp;", "&", "&#65;", "&bad;", "<!-- c -->", "<a href='x'>", '<a href="/u" class="k m">', "</a>", "<",
        ">", "</", '<img src="a&b">', "<script>", "</script>", "<i x>", "<i/>", "<title>", "</title>", "<p\n>",
        '<p a="1"b="2">', "<!DOCTYPE html>", "<?pi?>", "<style>", "</style>", "<h1 >", "a<b",
    ]
)


class _Slow(S.Shredder):
    parse_starttag = HTMLParser.parse_starttag
    parse_endtag = HTMLParser.parse_endtag


def _dump(parser, html):
    try:
        parser.feed(html)
        nodes, runs = parser.finish()
    except Exception as exc:
        return type(exc).__name__
    return (
        [(n.pre, n.last, n.parent, n.tag, dict(n.attrs), n.own, n.t0, n.t1, n.child_idx) for n in nodes],
        runs,
    )


@settings(max_examples=400, deadline=None)
@given(st.lists(PIECES, max_size=25))
def test_short_cuts_change_nothing(pieces):
    html = "".join(pieces)
    assert _dump(S.Shredder(), html) == _dump(_Slow(), html)


@settings(max_examples=200, deadline=None)
@given(st.lists(PIECES, max_size=25))
def test_intervals_nest(pieces):
    nodes, runs, error = S.read_page("".join(pieces))
    if error:
        return
    assert [n.pre for n in nodes] == list(range(len(nodes)))
    for n in nodes:
        assert n.pre <= n.last < len(nodes) and n.t0 <= n.t1 <= len(runs)
        if n.parent >= 0:
            up = nodes[n.parent]
            assert up.pre < n.pre and n.last <= up.last and up.t0 <= n.t0 and n.t1 <= up.t1


def test_many_void_tags_stay_linear():
    def took(n):
        html = "<br>" * n + "<p>x</p>" * n
        start = time.process_time()
        nodes, runs, error = S.read_page(html)
        assert error is None and len(nodes) == 2 * n and len(runs) == n
        return time.process_time() - start

    took(1000)
    assert took(20_000) < 12 * max(took(4_000), 0.02)
