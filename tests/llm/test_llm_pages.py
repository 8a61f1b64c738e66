"""Pages whose names and markup mislead: the article stays whole, what isn't it goes, in linear time."""

import time

import pytest

from tickflow.llm import op7_html as o7

LONG = "A sentence of the article that is long enough to be found, and it goes on for some more words."
ANCHORS = ("search-engines social-contract legal-history alert-levels comments related share navigation notice-boards "
           "copyright menu footer advertising").split()  # fmt: skip


def article(*parts, tag="article"):
    return f"<body><nav><a href=/>Home</a></nav><{tag}>{''.join(parts)}</{tag.split()[0]}><footer>Site</footer></body>"


@pytest.mark.parametrize("tag", ["article", "main", "div", 'div class="content"'])
def test_headings_with_ids(tag):
    parts = [f"<h2 id='{a}'>About {a}</h2><p>{LONG}</p>" for a in ANCHORS]
    want = "\n".join(f"About {a}\n{LONG}" for a in ANCHORS)
    assert o7.main_text(article(*parts, tag=tag)) == want


@pytest.mark.parametrize("attrs", ['id="related-work"', 'id="discussion"', 'class="search-engines"', 'id="legal"', 'class="legal"',
                                   'data-testid="header"', 'data-class="ad"', 'title="the hidden gem"', "id=copyright"])
def test_sections_of_an_article(attrs):
    html = article(f"<p>{LONG}</p>", f"<section {attrs}><h2>Title</h2><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></section>", f"<p {attrs}>{LONG}</p>" if "title" in attrs else "")
    assert o7.main_text(html).count(LONG) == (5 if "title" in attrs else 4)


@pytest.mark.parametrize("open_, close", [('<div class="has-sidebar">', "</div>"), ('<div class="page-with-sidebar">', "</div>"),
                                          ('<div class="content no-menu">', "</div>"), ("<form action=/x>", "</form>"),
                                          ('<div id="search">', "</div>"), ('<div style="display:none">', "</div>"),
                                          ('<div class="modal">', "</div>"), ("<header>", "</header>")])
@pytest.mark.parametrize("inner", ["article", "main", "div"])
def test_wrappers(open_, close, inner):
    html = f"<body>{open_}<nav><a href=/>Menu</a></nav><{inner}><h1>T</h1><p>{LONG}</p><p>{LONG}</p></{inner}>{close}<footer>F</footer></body>"
    if inner == "div" and "modal" in open_:
        return  # a name that leaves no doubt, and no article within
    assert o7.main_text(html) == f"T\n{LONG}\n{LONG}"


@pytest.mark.parametrize("part", ['<section class="comments"><h2>3 comments</h2><p>{0}</p><p>{0}</p><p>{0}</p></section>',
                                  '<div id="comment-list"><p>{0}</p></div>', '<div id="disqus_thread"><p>{0}</p></div>',
                                  '<article class="comment"><p>{0}</p></article>', '<div class="ad-banner"><p>{0}</p></div>',
                                  '<p class="ad">Buy</p>', '<div class="siteFooter"><p>{0}</p></div>', '<div class="cookieNotice">{0}</div>',
                                  '<div class="related-posts"><a href=1>{0}</a><a href=2>{0}</a></div>', '<div class="notice">Short.</div>',
                                  '<div role="navigation"><p>{0}</p></div>', '<div hidden><p>Not shown</p></div>', '<div aria-hidden="true">x</div>',
                                  '<div class="social-links">Follow us</div>', '<form><p>{0}</p></form>', '<h3 class="share">Share</h3>'])
@pytest.mark.parametrize("tag", ["article", "div"])
def test_what_goes(part, tag):
    html = article("<h1>T</h1>", f"<p>{LONG}</p>" * 4, part.format("Said by others, at some length, and with more words."), f"<p>{LONG}</p>", tag=tag)
    assert o7.main_text(html) == "\n".join(["T", *[LONG] * 5])


def test_the_distribution_chooses_among_articles():
    """Teasers are articles too; the one whose text surges is the page's."""
    teasers = "".join(f"<article><h3><a href={i}>Teaser {i}</a></h3><p>In short.</p></article><nav>x</nav>" for i in range(8))
    html = f"<body>{teasers}<article><h1>T</h1><p>{LONG}</p><p>{LONG}</p><p>Short end.</p></article>{teasers}</body>"
    assert o7.main_text(html) == f"T\n{LONG}\n{LONG}\nShort end."


def test_the_only_article_whatever_its_name():
    assert o7.main_text(f'<body><article class="post sponsored"><p>{LONG}</p></article></body>') == LONG


@pytest.mark.parametrize("unit", ["<nav>", "<a ", "<a '", '<a "', "<div>", "<div class=ad>", "<![CDATA[", "<!--", "<!x ", "<textarea>", "</p>",
                                  "<a href='x>y'", "<p", "<title>", "<section id=comments><p>x", "<table><td>", "<", "<b x=\"<b '"])
def test_a_megabyte_of_it_takes_a_moment(unit):
    page = f"<article><p>{LONG}</p></article>" + unit * (1_000_000 // len(unit))
    begun = time.process_time()
    o7.main_text(page)
    assert time.process_time() - begun < 6  # some are 500,000 elements; the time doubles with the page
    begun = time.process_time()
    o7.main_text(page[: len(page) // 4])
    quarter = time.process_time() - begun
    begun = time.process_time()
    o7.main_text(page)
    assert time.process_time() - begun < 9 * quarter + 0.3


def test_attributes():
    found = o7.attributes(" class='a b' ID=x data-id=\"y\" hidden a=b=c class=z")
    assert found == {"class": "a b", "id": "x", "data-id": "y", "hidden": "", "a": "b=c"}


def test_strength():
    assert [o7.strength(n) for n in ("ad", "Sidebar", "site-footer", "commentList", "related", "related-work", "has-sidebar", "content", "menu-2", "")] == [
        2, 2, 2, 2, 1, 0, 0, 0, 1, 0,
    ]
