"""HTML extraction against main texts written by hand: frames of well-known kinds of sites around articles."""

import time

import pytest

from commerce_lake.llm import op2_html_extraction as N

#: Frames; the article stands for %s. Nothing else on the page belongs to the main text.
FRAMES = {
    "plain article": "<!doctype html><html><head><title>T</title></head><body><article>%s</article></body></html>",
    "bare body": "<html><head><title>T</title><body>%s</body></html>",
    "no head or body tags": "<title>T</title>%s",
    "blog theme": (
        '<html><body class="home single"><header id="masthead" class="site-header"><div class="site-branding"><a href="/">My Blog</a></div><nav id="site-navigation" class="main-navigation"><ul><li><a href="/a">About</a></li><li><a href="/c">Contact</a></li></ul></nav></header>'
        '<div id="content" class="site-content"><main id="main"><article id="post-12" class="post type-post"><div class="entry-content">%s</div></article></main>'
        '<aside id="secondary" class="widget-area"><section class="widget"><h2>Recent posts</h2><ul><li><a href="/1">One thing</a></li><li><a href="/2">Another thing</a></li></ul></section></aside></div>'
        '<footer id="colophon" class="site-footer"><p>Proudly powered by a blog engine.</p></footer></body></html>'
    ),
    "news with cookies": (
        '<html><body><div id="cookie-banner" class="cookie-consent"><p>We use cookies to give you the best experience. You can change your settings at any time.</p><button>Accept</button></div><nav class="navbar"><ul><li><a href="/w">World</a></li><li><a href="/s">Sport</a></li><li><a href="/m">Money</a></li></ul></nav>'
        '<main><article class="story">%s</article></main><div class="advertisement"><p>Buy now and save a lot of money.</p></div><section class="related"><h3>More on this story</h3><ul><li><a href="/x">What we know so far</a></li><li><a href="/y">The day in pictures</a></li></ul></section><footer><p>Copyright 2024 The Paper. All rights reserved.</p></footer></body></html>'
    ),
    "with reader comments": (
        '<html><body><nav><a href="/">Home</a> <a href="/blog">Blog</a></nav><article>%s</article><section id="comments" class="comments-area"><h2>3 thoughts</h2><ol class="comment-list"><li class="comment"><p>Great read. I learned something new today, thank you.</p></li><li class="comment"><p>I do not agree at all. You forget the costs.</p></li></ol>'
        '<form><p>Leave a reply. Your address will not be published.</p><textarea></textarea></form></section><footer>About us</footer></body></html>'
    ),
    "table layout": (
        '<html><body><table><tr><td class="menu"><ul><li><a href="a.html">Start</a></li><li><a href="b.html">Links</a></li><li><a href="c.html">Guestbook</a></li></ul></td><td class="body">%s</td></tr></table></body></html>'
    ),
    "unclosed page": '<html><body><div class="topbar"><a href="/">Home</a></div><div class="content">%s',
    "page in a form": (
        '<html><body><form method="post" action="page.aspx" id="aspnetForm"><div class="header"><a href="/">Home</a></div><div class="menu"><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></div><div class="content">%s</div><div class="footer">All rights reserved</div></form></body></html>'
    ),
    "scripts and styles": (
        '<html><head><style>p{color:red}</style><script>document.write("<p>no</p>")</script></head><body><script>var a = 1 < 2;</script><div id="main-content">%s<script type="text/javascript">track("x");</script></div><noscript><p>Please switch on scripts.</p></noscript><style>.x{}</style></body></html>'
    ),
    "newsletter and sharing": (
        '<html><body><main><article>%s<div class="share-buttons"><a href="#">Share</a> <a href="#">Post</a></div><div class="newsletter"><p>Sign up for our newsletter. It is free.</p><form><input><button>Go</button></form></div></article></main></body></html>'
    ),
    "comments in markup": '<html><!-- top > of page --><body><!-- <p>old text that went.</p> --><div role="main">%s</div><!-- end --></body></html>',
    "documentation": (
        '<html><body><div class="breadcrumbs"><ul><li><a href="/">Docs</a></li><li><a href="/x">Guide</a></li></ul></div><nav class="sidebar"><ul><li><a href="1">Install</a></li><li><a href="2">Use</a></li><li><a href="3">Extend</a></li></ul></nav><div class="document"><section id="guide">%s</section></div><footer><p>Built with a generator.</p></footer></body></html>'
    ),
    "upper case and single quotes": "<HTML><BODY><DIV CLASS='navbar'><A HREF='/'>Home</A></DIV><DIV ID='content'>%s</DIV><DIV CLASS='footer'>Imprint</DIV></BODY></HTML>",
}
#: Articles and their texts.
ARTICLES = [
    (
        "<h1>On rivers</h1><p>Rivers carve the land. They do so slowly, over many thousands of years.</p><p>Some run dry in summer &amp; fill again in autumn.</p>",
        "On rivers\nRivers carve the land. They do so slowly, over many thousands of years.\nSome run dry in summer & fill again in autumn.",
    ),
    (
        '<p>A  recipe for <a href="/bread">good bread</a> needs\n time. Mix the flour with water, then wait.</p><ul><li>500 g of flour</li><li>350 g of water</li><li>10 g of salt</li></ul><p>Bake it until it is brown. It <ins>should</ins> sound hollow.</p>',
        "A recipe for good bread needs time. Mix the flour with water, then wait.\n500 g of flour\n350 g of water\n10 g of salt\nBake it until it is brown. It should sound hollow.",
    ),
    (
        "<h2>The match</h2><p>It was a long game<br>and nobody scored before the break.<p>Then came the rain. &ldquo;We could not see the ball,&rdquo; the keeper said.<blockquote><p>We will be back next year, he said.</p></blockquote><p>The crowd went home.",
        "The match\nIt was a long game and nobody scored before the break.\nThen came the rain. “We could not see the ball,” the keeper said.\nWe will be back next year, he said.\nThe crowd went home.",
    ),
    (
        '<p data-id="sidebar-ad" data-y="12px">The first paragraph of the report is here. It has two sentences.</p><p title=\'a "b" c\'>The 2 &lt; 3 rule holds. It always has, as far as we know.</p>',
        "The first paragraph of the report is here. It has two sentences.\nThe 2 < 3 rule holds. It always has, as far as we know.",
    ),
]


@pytest.mark.parametrize("frame", sorted(FRAMES))
@pytest.mark.parametrize("k", range(len(ARTICLES)))
def test_layout(frame, k):
    body, want = ARTICLES[k]
    assert N.main_text(FRAMES[frame].replace("%s", body), N.default_model()) == want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<body><p>Just one paragraph of plain text.</p></body>", "Just one paragraph of plain text."),
        ("<div><form><input></div><article><p>The text of the page is here. It is long enough.</p></article>", "The text of the page is here. It is long enough."),
        ('<body><svg><path d="x"><p>The text of the page is here. It is long enough.</p></body>', "The text of the page is here. It is long enough."),
        ("<body><select><option>a<p>The text of the page is here. It is long enough.</p></body>", "a\nThe text of the page is here. It is long enough."),
        ("<article><p title=\"it's>Hello there, this is a text. Is it?</p><p>And <a href=\"x\">more</a> of it.</p></article>", "Hello there, this is a text. Is it?\nAnd more of it."),
        ("<article><p>One <button>press</button> two and three. Four, five.</p></article>", "One two and three. Four, five."),
        ("<article><p>Before the script. It is cut off.</p><script>var x = 1;</article>", "Before the script. It is cut off."),
        ("<article><p>Nested <b>bold <i>text</b> here</i>. It goes on for a while.</p></article>", "Nested bold text here. It goes on for a while."),
        ("<article><p>If a < b then b > a. That much is clear to all.</p></article>", "If a < b then b > a. That much is clear to all."),
        ("<article><p>x &#233; &eacute; &bogus; &#x41; is here. Yes.</p></article>", "x é é &bogus; A is here. Yes."),
    ],
)
def test_broken_markup(page, want):
    assert N.main_text(page, N.default_model()) == want


@pytest.mark.parametrize("page", ["<a " * 350_000, "<a " * 350_000 + ">", "<!-- " * 200_000, "<script>" * 100_000, '<p a="' * 150_000, "<div>" * 100_000, "<button>" * 100_000, "</section>" * 100_000, "<b" * 400_000])
def test_hostile_pages_take_linear_time(page):
    model, began = N.default_model(), time.process_time()
    N.main_text(page, model)
    assert time.process_time() - began < 8
