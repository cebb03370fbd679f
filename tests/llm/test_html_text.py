import json
import time

import pandas as pd
import pytest

from tidemark.llm import html_text


def wrapper(pages):
    rows = pd.DataFrame({"host": "h", "wrapper": [json.dumps(html_text.of_page(p)) for p in pages]})
    return html_text.load(html_text._aligned(rows).wrapper[0])


def text(page):
    return html_text.Extractor(wrapper([page])).text(page)


ARTICLE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>x";</script></head>
<body><nav><ul><li><a href=x>Home</a></li><li><a>News</a></li></ul></nav><!-- ad --><div class="ad">Buy</div>
<article><h1>Head &amp; tail</h1><p><b>one  two<br><p>thr<i>ee</i></p><p>f&ouml;ur&nbsp;x</p>
<div class="comments"><p>first!</p></div></article><footer>&copy; z</footer></body></html>"""


def test_article_without_the_rest():
    assert text(ARTICLE) == "Head & tail one two three föur x"


@pytest.mark.parametrize(
    "part",
    [
        "<nav>x</nav>", "<header>x</header>", "<footer>x</footer>", "<aside>x</aside>", "<form><p>x</p></form>",
        "<script>x</script>", "<style>x</style>", '<div class="sidebar">x</div>', '<div id="cookie-notice">x</div>',
        '<div class="advert box">x</div>', '<section class="comments"><article class="comment">x</article></section>',
        '<div role="navigation">x</div>', "<p hidden>x</p>", "<noscript>x</noscript>", "<!-- x -->", "<button>x</button>",
    ],
)
def test_boilerplate_goes(part):
    assert text(f"<body>{part}<main><p>kept</p></main>{part}</body>") == "kept"


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "<p></p>", "<script>x", "<!-- x", "&nbsp;"])
def test_pages_without_text(page):
    assert text(page or "") in ("", "<", "<p")


def test_broken_markup_is_read_as_far_as_it_goes():
    assert text("<article><p>a<p>b<div>c</article>d") == "a b c"
    assert text("<article><p>a < b &lt; c &#x41;&#66; &unknown;") == "a < b < c AB &unknown;"


def test_a_wrapper_folds_groups_and_marks_optional_ones():
    pages = [f"<div><h1>Head {k}</h1><p>Text {k}</p>{'<p>more</p>' * (k % 3)}{'<hr>' * (k % 2)}</div>" for k in range(6)]
    found = wrapper(pages)
    assert [node for node, _, _ in found] == ["div:0", "h1:0", "#0", "/h1", ("+", "p:0", "#0", "/p"), "hr:0", "/div"]
    assert [may for _, may, _ in found] == [False, False, False, False, False, True, False]


def test_without_an_article_what_all_pages_share_goes():
    page = "<div class=top><a href=1>Home</a> <a href=2>News</a></div><div><h1>Head {0}</h1><p>Body {0}.</p>{1}</div><div>All rights reserved</div>"
    pages = [page.format(k, f"<p>more {k}</p>" * (k % 3)) for k in range(8)]
    reader = html_text.Extractor(wrapper(pages))
    assert [reader.text(p) for p in pages[:3]] == ["Head 0 Body 0.", "Head 1 Body 1. more 1", "Head 2 Body 2. more 2 more 2"]


@pytest.mark.parametrize(
    "page",
    [
        '<div class="content with-sidebar"><p>kept</p></div>',
        '<div class="post no-comments"><p>kept</p></div>',
        '<article><h2 id="comment-faire">kept</h2></article>',
        '<article><h2 id="search-menu">kept</h2></article>',
        '<div><h2 id="search-menu">kept</h2></div>',
        '<article><section id="related-work"><p>kept</p></section></article>',
        '<article><section id="search"><p class="notice">kept</p></section></article>',
        '<div class="has-header"><p>kept</p></div>',
        '<div class="sidebar">x</div><div class="entry-content">kept</div><div id="cookie-notice">x</div>',
    ],
)
def test_a_name_drops_nothing_of_the_article(page):
    assert text(f"<body>{page}</body>") == "kept"


def test_text_decides_between_slots_not_the_name_alone():
    meta = '<div class="entry-meta">by x</div><div class="body">A long text of the article.</div>'
    assert text(meta) == "by x A long text of the article."
    pages = [f'<div class="entry">by {k}</div><div><p>A long text of article {k}.</p></div>' for k in range(5)]
    reader = html_text.Extractor(wrapper(pages))
    assert [reader.text(p) for p in pages[:2]] == ["by 0 A long text of article 0.", "by 1 A long text of article 1."]
    pages = [f'<div class="content"><h2>Same line</h2><p>A long text of article {k}.</p></div><div>by {k}</div>' for k in range(5)]
    assert html_text.Extractor(wrapper(pages)).text(pages[1]) == "Same line A long text of article 1."


def test_the_wrapper_does_not_depend_on_the_order_of_pages():
    pages = [f"<article><h1>{k}</h1>{'<p>x</p>' * k}{'<ul><li>y</li></ul>' * (k % 2)}</article>" for k in range(7)]
    assert wrapper(pages) == wrapper(pages[::-1])


def test_pages(spark):
    rows = [(k, f"http://a.b/{k}", ARTICLE, "w") for k in range(4)] + [(9, None, ARTICLE, "w"), (10, "nonsense", None, "w"), (None, "http://A.b", "", "w")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, wrapper string")
    found = html_text.extract(pages)
    assert found.columns == ["page_id", "url", "html", "wrapper", "text"] and found.count() == len(rows)
    by_id = {r.page_id: r for r in html_text.report(pages).collect()}
    assert by_id[9].text == by_id[0].text == "Head & tail one two three föur x" and by_id[0].n_chars == 32
    assert by_id[10].text == "" and by_id[None].n_chars == 0
    assert html_text.report(pages.where("1 = 0")).count() == 0


def test_a_hot_host_is_aligned_in_parts_that_do_not_grow(spark, monkeypatch):
    aligned = html_text._aligned
    monkeypatch.setattr(html_text, "FAN", 4)
    body = lambda k: "".join(f"<{t}>{t}{k}</{t}>" for j, t in enumerate(["h1", "p", "pre", "h2", "ul", "h3", "ol"]) if k >> j & 1)
    rows = [(f"http://hot/{k}", f"<div>{body(k)}</div>") for k in range(1, 128)] + [("http://cold/1", "<p>x</p>"), (None, None)]
    pages = spark.createDataFrame(rows, "url string, html string")
    calls, large = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def counted(group):
        calls.add(1)
        if len(group) > 12:
            large.add(1)
        return aligned(group)

    monkeypatch.setattr(html_text, "_aligned", counted)
    found = {r.host: r.wrapper for r in html_text.wrappers(pages).collect()}
    assert sorted(found) == ["", "cold", "hot"] and calls.value > 40 and large.value == 0
    assert sum(f[0] for node, _, slots in html_text.load(found["hot"]) for f in slots) > 0


def test_a_page_without_marks_beside_marked_ones(spark):
    marked = [(k, f"http://a/{k}", f"<div>Same</div><article><p>Text {k}</p></article>") for k in range(4)]
    plain = [(k, f"http://a/{k}", f"<div>Same</div><div><p>Plain {k}</p></div>") for k in range(10, 13)]
    pages = spark.createDataFrame(marked + plain, "page_id long, url string, html string")
    found = {r.page_id: r.text for r in html_text.report(pages).collect()}
    assert [found[k] for k in (0, 3, 10, 12)] == ["Text 0", "Text 3", "Plain 10", "Plain 12"]


def test_given_pages_against_the_article_element(spark):
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    found = {r.page_id: r.text for r in html_text.report(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        plain = re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", inner))
        assert found[r.page_id] == " ".join(html.unescape(plain).split())


@pytest.mark.parametrize(
    "piece",
    ['<a "', '<a ">" ', "<a '", "<a<", "<!", "<!-", "<textarea>", "</textarea ", "<div></p>", "<div>", "</x>", '<p title="', "<p a='b\"c>x", "&", "<"],
)
@pytest.mark.parametrize("tail", ["", ">", '">', "'>x</a>"])
def test_any_markup_is_read_in_linear_time(piece, tail):
    page = piece * (500_000 // len(piece)) + tail
    start = time.process_time()
    html_text.read(page)
    assert time.process_time() - start < 8


@pytest.mark.parametrize(
    "page, texts",
    [
        ('<p title="a > b">one</p><p>two</p>', ["one", "two"]),
        ("<p title='a > b' class=\"x>\">one</p>", ["one"]),
        ('<p title="open>one</p><p>two</p>', ["one", "two"]),
        ("<p>it's<p title=' >one</p>", ["it's", "one"]),
        ("<p>3 < 4 <5</p>", ["3 < 4 <5"]),
        ("<p>one</p><!-- > never closed <p>two", ["one"]),
        ("<p>one <b", ["one <b"]),
        ("<textarea>gone</textarea><p>one</p><textarea>kept", ["one", "kept"]),
        ("<div><p>one</div></p></div>two", ["one", "two"]),
    ],
)
def test_quotes_and_open_ends(page, texts):
    assert [text for text, _ in html_text.read(page)[1]] == texts


def test_cards_inside_the_main_element_are_not_the_story():
    page = "<main><h1>Head {0}</h1><p>" + "A long story {0}. " * 20 + "</p><section><article><h3>card {0}</h3><p>Short</p></article></section></main>"
    found = html_text.Extractor(wrapper([page.format(k) for k in range(5)])).text(page.format(3))
    assert found == "Head 3 " + " ".join(["A long story 3."] * 20)


def test_the_host_decides_between_main_and_article():
    """The same page with two wrappers: a stub of an article, on a host of articles and on one of main elements."""
    stub = "<main><p>Some words beside it that are longer</p><article><p>Stub</p></article></main>"
    stories = [f"<main><p>by {k}</p><article><p>{f'Long story {k}. ' * 30}</p></article></main>" for k in range(5)]
    plain = [f"<main><p>{f'Long story {k}. ' * 30}</p><article><p>Card {k}</p></article></main>" for k in range(5)]
    assert html_text.Extractor(wrapper([*stories, stub])).text(stub) == "Stub"
    assert html_text.Extractor(wrapper([*plain, stub])).text(stub) == "Some words beside it that are longer"
    # a page whose article outweighs the rest of its main element keeps it on any host
    assert html_text.Extractor(wrapper([*plain, stories[0]])).text(stories[0]) == " ".join(["Long story 0."] * 30)


@pytest.mark.parametrize(
    "beside",
    [
        '<article><a href="/7">teaser 7</a></article>',
        '<article><h3><a href="/7">teaser 7</a></h3><p>What it says in some more words.</p></article>',
        '<article class="reply-item"><p>I disagree</p></article>',
        '<section id="responses"><article class="comment-card"><p>I disagree</p></article></section>',
        '<div class="comment-list"><p>I disagree</p></div>',
    ],
)
def test_articles_beside_the_story_that_are_none_of_it(beside):
    story = "<h1>Head</h1><p>A story, longer than its teaser, that <a href=x>links</a> a little.</p>"
    for page in (f"<article>{story}</article>{beside}", f"{beside}<article>{story}</article>", f"<article>{story}{beside}</article>"):
        assert text(f"<body>{page}</body>") == "Head A story, longer than its teaser, that links a little."


def test_parts_of_a_story_in_articles_of_their_own_stay():
    page = "<article><h1>One</h1><p>First part.</p></article><article><h2>Two</h2><p>Second <a href=x>part</a>.</p></article>"
    assert text(page) == "One First part. Two Second part."
    assert text('<article><h2><a href="/1">Linked head</a></h2><p>The only article.</p></article>') == "Linked head The only article."
    assert text('<article class="post no-comments"><p>kept</p></article>') == "kept"
    assert text('<article class="comment"><p>The only text.</p></article>') == "The only text."
