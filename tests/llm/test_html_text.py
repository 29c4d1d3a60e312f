import html
import re

from llm_helpers import SF, read
from threadloom.llm import html_text
from threadloom.llm.html_text import main_text
from threadloom.llm.queries import QUERIES


def article(page):
    """Blocks of the one article that a page of the data set holds, by plain cutting."""
    inner = page[page.index("<article>") + 9 : page.rindex("</article>")]
    blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"<(?:/?p|/?h1)>", inner))
    return "\n\n".join(b for b in blocks if b)


def test_query(spark):
    pages = {p: (u, h) for p, u, h in read(f"select page_id, url, html from '{SF}/pages.parquet'")}
    got = QUERIES["op5_ratio_regions"](spark, SF).collect()
    assert {r.page_id: (r.url, r.text, r.n_chars) for r in got} == {p: (u, article(h), len(article(h))) for p, (u, h) in pages.items()}


def test_named_parts_go():
    page = """<html><head><title>T</title></head><body class="has-sidebar"><div id="top-menu"><a href=x>Home</a></div><div class="notice">We use cookies</div>
    <main><article class="post comments-open"><header><h1>Head</h1></header><p>One <a href=z>link</a> &amp; co&nbsp;x.<br>Next</p><p>Short.
    <ul><li>a<li>b</ul><form>Name <input></form><aside>side</aside><p hidden>no</p><div style="display: none">no</div><script>if (a<b) "</p>"</script>
    <section class="comments"><p>nice!</p></section><p>Last</article></main><div class=sidebar>foo</div><footer>c</footer>"""
    assert main_text(page) == "One link & co x. Next\n\nShort.\n\na\n\nb\n\nLast"


def test_names_that_belong_to_the_article():
    kept = (
        '<h2 id="search-algorithms">A</h2>', '<h2 id="comments-on-method">B</h2>', '<p id="notice-period">C</p>', '<section id="related-work"><p>D</p></section>',
        '<div class="side-by-side">E</div>', '<div class="section-header">F</div>', '<figure class="share-price">G</figure>',
    )
    gone = (
        '<div class="share-buttons">x</div>', '<section id="comments">x</section>', '<div class="relatedPosts">x</div>', '<div class="ad-slot-2">x</div>',
        '<div class="cookie-notice">x</div>', '<p class="notice">x</p>',
    )
    for tag in ("article", "main"):
        page = f"<body><{tag}><p>Start of it all.</p>" + "".join(kept) + "".join(gone) + f"<p>End.</p></{tag}></body>"
        assert main_text(page) == "\n\n".join(["Start of it all.", *"ABCDEFG", "End."])


def test_regions_without_an_article():
    page = (
        "<body><div><a href=1>aaa</a> <a href=2>bbb</a> <a>ccc</a></div><div><h2>A head</h2><p>" + "Long text of the page. " * 5
        + "</p><p>Tiny.</p><p>" + "More text of the page. " * 5 + "</p></div><div>Copyright <a>us</a> <a>them</a> <a>and others</a></div>"
    )
    got = main_text(page).split("\n\n")
    assert got[0] == "A head" and got[2] == "Tiny." and len(got) == 4


def test_link_lists_in_an_article():
    text = "Long text of the article, a whole line. " * 3
    page = f"<article><p>{text}</p><p>{text}</p><p>{text}</p><p>{text}</p><ul><li><a>one</a><li><a>two</a><li><a>three</a></ul></article>"
    assert "one" not in main_text(page) and main_text(page).count("\n\n") == 3


def test_link_lists_that_belong_to_the_article():
    """In the text, under a heading or after a colon; a menu before the text goes."""
    text = "Long text of the article, a whole line. " * 3
    links = "<ul><li><a>one</a><li><a>two</a><li><a>three</a></ul>"
    t, listed = text.strip(), "one\n\ntwo\n\nthree"
    assert main_text(f"<article><p>{text}</p>{links}<p>{text}</p></article>") == f"{t}\n\n{listed}\n\n{t}"
    assert main_text(f"<article><p>{text}</p><p>{text}</p><h2>Sources</h2>{links}</article>") == f"{t}\n\n{t}\n\nSources\n\n{listed}"
    assert main_text(f"<article><p>{text}</p><p>Read for this:</p>{links}</article>") == f"{t}\n\nRead for this:\n\n{listed}"
    assert main_text(f"<article>{links}<p>{text}</p><p>{text}</p></article>") == f"{t}\n\n{t}"


def test_teaser_articles_beside_the_main_text():
    """The text stands in a <div>; <article> holds cards, also when the page has a <main>."""
    text = [f"Paragraph {i} of the main text, which says what there is to be said. " * 4 for i in range(6)]
    body = "".join(f"<p>{x}</p>" for x in text)
    want = "\n\n".join(x.strip() for x in text)
    cards = "".join(f"<article><h3><a href=/{i}>Card number {i}</a></h3><p>Short teaser.</p></article>" for i in range(8))
    for page in (f"<div>{body}</div><div>{cards}</div>", f"<div>{cards}</div><div>{body}</div>", f"<main><div>{body}</div><div>{cards}</div></main>"):
        got = main_text(page)
        assert got.count("main text") == 24 and want in got and "Card number 4" not in got and got.count("teaser") <= 2
    # Cards as long as a paragraph are not told apart, but they must not cost the text.
    dense = "".join(f"<article><p>{'Teaser ' * 40}</p></article>" for i in range(8))
    assert want in main_text(f"<div>{dense}</div><div>{body}</div>")


def test_article_with_the_page_s_text():
    """A page's own article stays whole, short lines and cells included; short unmarked text outside goes."""
    text = "Long text of the article, a whole line of it. " * 4
    page = f"<div>Unmarked words of the site.</div><div>And more.</div><main><h1>Head</h1><article><p>{text}<p>{text}<div>Tiny.</div><table><tr><td>1<td>2</table><p>{text}</article></main>"
    t = text.strip()
    assert main_text(page) == "\n\n".join(["Head", t, t, "Tiny.", "1", "2", t])
    short = "".join(f"<p>Line {i} of a poem" for i in range(60))
    assert main_text(f"<div>{text}</div><article>{short}</article>").count("of a poem") == 60


def test_dropped_elements_without_an_end_tag():
    """Text after a dropped element whose end tag is optional or missing."""
    for before in (
        "<select><option>A<option>B</select>", "<select><optgroup label=x><option>A<optgroup label=y><option>B</select>", "<datalist><option>A<option>B</datalist>",
        "<form><select><option>A</form>", "<ul><li class='social'>x</ul>", "<ul><li>y<ul><li class='social'>x</ul></ul>", "<table><tr><td>y<td class='sidebar'>x</table>",
        "<table><tr class='menu'><td>x</table>", "<div><nav>x</div>", "<div><aside>x<ul><li>y</div>", "<div><p>y<aside>x</div>", "<svg/>", "<svg><path/><g/></svg>", "<svg><g></svg>",
        "<math/>", "<div><svg><path></div>", "<p>y<span class='share'>x</p>", "<dl><dt class='menu'>x<dd>y</dl>", "<p class='ad'>x<nav>x</nav>", "<h2 class='promo'>x</h3>",
        "<div><h2 class='promo'>x<h2>y</h2></div>", "<b>y<span class='ad'>x</b>", "<div><button>x</div>", "<svg><path>",
    ):
        got = main_text(f"<body><article><div>{before}<p>The text.</p></div><p>And more.</p></article></body>").split("\n\n")
        assert got[-2:] == ["The text.", "And more."] and set(got[:-2]) <= {"y"}, (before, got)
        assert ("y" in got) == (">y" in before and "aside>x<ul>" not in before), (before, got)


def test_stray_end_tags_in_dropped_parts():
    for inner in ("<b>x</a></span>x", "<table><tr><td>x</div>x</td></tr></table>", "<ul></li><li>x</ul>x", "<button></p>x</button>", "<select><option>x</option></b>x</select>x"):
        assert main_text(f"<a>t</a><div>a <b><li><span><nav>{inner}</nav>text</span></b></div>c").replace("\n\n", " ") == "t a text c", inner


def test_broken_markup():
    assert main_text(None) == main_text("") == main_text("<p></p>") == main_text("<!-- x") == ""
    assert main_text("just text") == "just text" and main_text("<article>a</nav></p>b<p>c") != ""
    assert main_text("<p>a</b></i></div>b") == "ab" and main_text("a < b & c &lt; d") == "a < b & c < d"
    assert len(main_text("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000)) == 4
    assert main_text("<article>" + "<p>line of words</p>" * 20_000).count("line") == 20_000


def test_odd_rows(spark):
    rows = [(None, None, None, "t", 5), (1, "u", "", "t", 5), (1, "u", "", "t", 5), (2, None, "<article><p>x</p></article>", "t", 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in html_text.extract(pages).collect()) == [("1", "", 0), ("1", "", 0), ("2", "x", 1), ("None", "", 0)]
    assert html_text.extract(pages.limit(0)).count() == 0
