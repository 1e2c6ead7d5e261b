from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm.pages import class_says, container, equivalence_classes, extract_main_text, group_texts, main_text, read_page, template, template_frame, template_texts

RICH = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body class="page">
<div id="cookie-banner">We use cookies <button>OK</button></div><header><h1>Site</h1></header><nav><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></nav>
<aside class=sidebar><p>Side</p></aside><div class="ad">Buy</div>
<article class="post"><h1>Title&nbsp;{n}</h1><p><b>First &amp; <i>second</i> para{n}.<br><p>Line
one   two<br>three{n}</p><div class="ad-slot">Advert</div><ul><li>Item {n} one<li>Item {n} <a href="x">two</a></ul><form><input>Send</form><!-- note --><blockquote>Quote &#8212; x{n}</blockquote>
<section id="comments"><h2>Comments</h2><p>Nice!</p></section></article>
<div class="comments"><p>reader comment</p></div><footer>&copy; me</footer></body></html>"""
BARE = """<html><body><div class=top><a href=1>Home</a> <a href=2>News</a></div><div id=c{i}x><h2>Story {n}</h2><p>Body text number {n} is here.<p>And more {n}.</div><div class=bottom><a href=3>About</a></div>"""


def test_rich_page():
    page = read_page(RICH.format(n=7))
    for frame in (set(), template_frame([page]), template_frame([page] + [read_page(RICH.format(n=i)) for i in range(5)])):
        assert main_text(page, frame) == "Title 7\nFirst & second para7.\nLine one two three7\nItem 7 one\nItem 7 two\nQuote — x7"


def test_page_without_names():
    pages = [read_page(BARE.format(n=i, i=1)) for i in range(6)]
    frame = template_frame(pages)
    assert main_text(pages[3], frame) == "Story 3\nBody text number 3 is here.\nAnd more 3."


def test_classes():
    pages = [read_page("<body><ul>" + "<li><a>x</a></li>" * n + "</ul><p>t</p></body>") for n in (2, 3, 5)]
    classes = equivalence_classes(pages)
    assert any(c[:2] == ["/body", "/body/ul"] for c in classes)
    assert ["/body/ul/li", "/body/ul/li/a", "//body/ul/li/a", "//body/ul/li"] in classes


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<b>", "</b>", "<div class='ad'>", "</div>", "<article>", "</article>", "<", ">", "&amp;", "&#x;", "text ", "<!--", "-->", "<script>", "</script>", "<br/>", "<a href=\"", "\"", "<li>", "</ul>", "\x00", "<![CDATA[", "]]>"]), max_size=30))
def test_any_markup(parts):
    page = read_page("".join(parts))
    assert isinstance(main_text(page, template_frame([page])), str)


def test_pages(spark):
    rows = [(i, f"http://h.example/{i}", RICH.format(n=i), "x") for i in range(200)] + [(1000, None, None, "x"), (1001, "http://q.example/", "", "x"), (1001, "http://q.example/", "", "x"), (None, "nonsense", "<article>a<p>b", "x"), (1002, "http://l.example", "<article><p>" + "long text " * 50_000 + "</article>", "x")]
    got = Counter((r.page_id, r.url, r.text) for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, host string").repartition(4)).collect())
    want = Counter((i, f"http://h.example/{i}", f"Title {i}\nFirst & second para{i}.\nLine one two three{i}\nItem {i} one\nItem {i} two\nQuote — x{i}") for i in range(200))
    want += Counter([(1000, None, ""), (1001, "http://q.example/", ""), (1001, "http://q.example/", ""), (None, "nonsense", "a\nb"), (1002, "http://l.example", ("long text " * 50_000).strip())])
    assert got == want
    assert extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


UNNAMED = """<html><body><div class=k1><p>We are the best shop of the town.</p></div><div class=k2><h2>Story {n}</h2><p>Body text number {n} is here.<p>All rights reserved by us, on every page.{more}</div>
<div class=k3>{links}</div></body></html>"""


def test_repeated_text_is_the_templates(spark):
    """No element names the article: what every page of the host repeats is dropped; a nested list of links is a slot of its own."""
    more = [f"<p>Another paragraph {i}." * (i % 3) for i in range(12)]
    rows = [(i, f"http://u.example/{i}", UNNAMED.format(n=i, more=more[i], links="".join(f"<li><a href={k}>Link {i} {k}</a></li>" for k in range(2 + i % 2)))) for i in range(12)]
    copies = [(100 + i, "http://copies.example/", UNNAMED.format(n=5, more="", links="")) for i in range(5)]
    got = {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(rows + copies, "page_id long, url string, html string")).collect()}
    for i in range(12):
        assert got[i] == "\n".join([f"Story {i}", f"Body text number {i} is here."] + [f"Another paragraph {i}."] * (i % 3)), got[i]
    assert all("All rights reserved" in got[100 + i] and "Body text number 5" in got[100 + i] for i in range(5))


def test_nested_classes():
    pages = [read_page("<body><div><h1>t</h1>" + "<ul>" + f"<li><a>x{n}</a></li>" * n + "</ul></div></body>") for n in (2, 3, 5)]
    frame, nested = template(pages)
    assert "/body/div/ul" in frame and "/body/div/ul/li" in nested and "/body/div/ul/li/a" not in nested


BLANK = """<html><body><div class=z1><ul><li><a href=/>Home</a><li><a href=/c>Contact us today</a></ul></div><div class=z2><h2>Headline {n}</h2>{body}</div>
<div class=z3><p>Bargain {n}: buy {n} now.</div><div class=z4><p>All rights held by the owner.</p></div></body></html>"""


def blank_page(n):
    """A page whose elements say nothing, and its article, by the parts it is made of."""
    body = [f"Paragraph {k} of story {n}, with some words of its own." for k in range(2 + n % 4)]
    linked = f"See <a href=/{n}>the report {n} and all its many pages</a> too."
    html = "".join(f"<p>{b}</p>" for b in body[:1]) + f"<p>{linked}</p>" + "".join(f"<p>{b}</p>" for b in body[1:])
    return BLANK.format(n=n, body=html), "\n".join([f"Headline {n}", body[0], f"See the report {n} and all its many pages too.", *body[1:]])


def test_template_decides_where_nothing_is_named():
    """No element or class names anything: constant texts, menus and the short slots go, the article stays, with its paragraph of links."""
    pages = [blank_page(n) for n in range(8)]
    assert [t for t in group_texts([h for h, _ in pages])] == [t for _, t in pages]
    pages = [blank_page(n) for n in range(40)]
    assert group_texts([h for h, _ in pages]) == [t for _, t in pages]


def test_container_needs_the_frame():
    """With the frame empty there is no container: the template is what finds the article on these pages."""
    pages = [read_page(blank_page(n)[0]) for n in range(8)]
    repeated = template_texts(pages)
    assert container(pages, template_frame(pages), repeated).startswith("/html/body/div") and container(pages, set(), repeated) is None


def test_article_keeps_all_kinds_of_text():
    body = "<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be.</p><object data=a>Fallback</object><svg><text>Label</text></svg><select><option>No</select><p>End"
    assert main_text(read_page(f"<nav>menu</nav><article>{body}</article>"), set()) == "Let x=2 be.\nFallback\nLabel\nEnd"


def test_deep_pages_take_memory_in_proportion():
    import tracemalloc

    took = []
    for depth in (1000, 4000):
        source = "".join(f"<div>text {i}" for i in range(depth))
        tracemalloc.start()
        page = read_page(f"<article>{source}")
        took.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert main_text(page, set()) == "\n".join(f"text {i}" for i in range(depth))
    assert took[1] < 6 * took[0]


def article(n):
    """A story of its own: paragraphs, and a heading."""
    return f"Story {n}", [f"Paragraph {k} of story {n} has words of its own, {n * 7 + k} of them." for k in range(3 + n % 3)]


BLOG = """<html><body class="home blog has-sidebar"><header id="masthead" class="site-header"><h2 class="site-title">My blog</h2></header><div id="page" class="hfeed site sidebar-layout"><div class="content-area with-footer">
<article id="post-{n}" class="post-{n} post type-post status-publish format-standard hentry category-news tag-python tag-menu"><header class="entry-header"><h1 class="entry-title">{title}</h1></header>
<div class="entry-content clearfix">{body}<p>This post may hold affiliate links, see our terms.</p><ul class="more"><li><a href="/x{n}">Read story {n} next</a></li><li><a href="/y{n}">Or story {n} b</a></li></ul><div class="sharedaddy share-buttons"><p>Share this {n}</p></div></div>
<footer class="entry-footer"><p>Posted in news {n}</p></footer></article><div id="comments" class="comments-area"><ol class="comment-list"><li><article id="div-comment-{n}" class="comment-body"><p>A reader says {n} things.</p></article></li></ol></div></div>
<aside id="secondary" class="widget-area"><p>Recent posts {n}</p></aside></div><footer id="colophon" class="site-footer"><p>Proudly {n}</p></footer></body></html>"""
CMS = """<html><body><div class="navbar-fixed page-wrapper"><div class="region region-header"><p>Portal {n}</p></div><main class="l-main main--with-sidebar"><div class="node node--type-article node--view-mode-full" id="node-{n}"><h1 class="page-header">{title}</h1>
<div class="field field--name-body">{body}</div></div></main><div class="region-sidebar-first"><p>Blocks {n}</p></div><div class="cookie-consent"><p>We use {n} cookies</p></div></div></body></html>"""
DOCS = """<html><body><div class="md-header__inner"><p>Docs {n}</p></div><div class="theme-doc sidebarLeft-layout"><nav class="menu"><a href=/>x</a></nav><div role="main" class="document has-toc"><h1>{title}</h1>{body}<div class="admonition-free"><p>Text of note {n}.</p></div></div>
<div class="tocSidebar"><p>On this page {n}</p></div></div><div class="pagination-nav"><a href=/n>Next</a></div></body></html>"""


def test_usual_class_lists():
    """Markup of blogs, content systems and documentation: layouts, tags and categories in class lists put no article aside."""
    for markup, more in ((BLOG, []), (CMS, []), (DOCS, ["Text of note {n}."])):
        for numbers in (range(1, 7), range(1, 2), range(1, 40)):
            pages, want = [], []
            for n in numbers:
                title, body = article(n)
                pages.append(markup.format(n=n, title=title, body="".join(f"<p>{b}</p>" for b in body)))
                alone = len(numbers) == 1 and markup is BLOG
                want.append("\n".join([title, *body, *(["This post may hold affiliate links, see our terms.", f"Read story {n} next", f"Or story {n} b"] if alone else []), *(m.format(n=n) for m in more)]))
            assert group_texts(pages) == want, markup[:60]


def test_what_a_class_says():
    for name, says in {
        "tag-python": "", "category-news": "", "post-header": "", "entry-title": "", "article__header": "", "has-sidebar": "", "siteHeader": "out", "site-header": "out", "sidebar-left": "out", "share-buttons": "out", "post-tags": "out", "related-posts": "out",
        "contact-form": "out", "form-text": "", "comment-list": "comments", "postComments": "comments", "no-comments": "", "post": "in", "entry-content": "in", "postBody": "in", "hentry": "in", "": "", "--": "", "main-navigation": "out", "ads": "out", "adsorption": "", "headline": "", "navlinks": "out", "navy": "", "advertbox": "out", "sponsoring-note": "out",
    }.items():
        assert class_says(name) == says, name


def test_copies_of_a_story_make_no_template():
    """Three near copies of one article among five pages: what they share is theirs; what five stories share is the template's."""
    story = "".join(f"<p>Shared paragraph {k}.</p>" for k in range(6))
    pages = [f"<body><nav>n</nav><article><h1>Copy {i}</h1>{story}<p>All pages say this.</p></article></body>" for i in range(3)]
    pages += [f"<body><nav>n</nav><article><h1>Other {i}</h1>{''.join(f'<p>Text {i} {k}.</p>' for k in range(5))}<p>All pages say this.</p></article></body>" for i in range(3)]
    got = group_texts(pages)
    assert got[0] == "\n".join(["Copy 0", *(f"Shared paragraph {k}." for k in range(6))])
    assert got[4] == "\n".join(["Other 1", *(f"Text 1 {k}." for k in range(5))])
    assert "All pages say this." in group_texts(pages[:3])[0] and "Shared paragraph 5." in group_texts(pages[:3])[0]
