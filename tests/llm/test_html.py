import random

from lamina.llm.html import best_region, extract_main_text, fit, fit_weights, main_text
from lamina.llm.queries import op7_html

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";x(1<2)</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav><!-- ad <p>no</p> -->
<div class="ad">Buy this now please</div><div id="cookie-notice">We use cookies here</div>%s
<aside class="sidebar"><p>More to read about all of this in the side column</p></aside>
<section class="comments"><article class="comment"><p>I liked it a lot, thanks for writing</p></article></section>
<form><label>Your mail</label><input name=x><button>Send</button></form><footer>&copy; Somebody</footer></body></html>"""
ARTICLE = "<article><h1>A &amp; B</h1><p><b>First  line<br>goes\n on.<p>Second <a href=x title='a>b'>linked</a>&nbsp;words &lt;i&gt;.</p><div class='ad'>not this</div><ul><li>item one<li>item two</ul></article>"
WANT = "A & B\n\nFirst line goes on.\n\nSecond linked words <i>.\n\nitem one\n\nitem two"


def test_article():
    weights = fit([PAGE % ARTICLE])
    assert main_text(PAGE % ARTICLE, weights) == WANT
    assert main_text(PAGE % ARTICLE.replace("article>", "div>"), weights) == WANT
    assert main_text("<article><h1>X</h1><p>one two three four five six", weights) == "X\n\none two three four five six"


def test_defined_cases():
    weights = fit([PAGE % ARTICLE])
    for page in (None, "", "<", "<<<>>>", "<nav>only a menu here</nav>", "<!-- never closed", "<script>never closed"):
        assert main_text(page, weights) in ("", "<", "<<<>>>", "<<>>", "<<<>>")
    assert main_text("plain words without any markup at all", weights) == "plain words without any markup at all"
    assert len(main_text("<article><p>" + "word " * 200_000, weights)) == 999_999
    assert main_text("<div class='ad'>unclosed ad <article><p>the text of it all is here</p></article>", weights) == "the text of it all is here"


def test_article_keeps_all_but_surroundings():
    weights = fit([PAGE % ARTICLE])
    kept = [
        ("formula <math><mi>x</mi></math> end", "formula x end"), ("see <object>the object's words</object> and <video>the film's words</video> here", "see the object's words and the film's words here"),
        ("<canvas>drawn</canvas> <audio>heard</audio> <iframe>framed</iframe> <svg><text>label</text></svg> words", "drawn heard framed label words"),
    ]
    for inner, text in kept:
        assert main_text(PAGE % f"<article><h1>Head line</h1><p>{inner}</p></article>", weights) == f"Head line\n\n{text}"
    for names in ("class='search-tips'", "class='notices-of-birth'", "id='comment-on-the-law'"):
        page = PAGE % f"<div><h1>Head line</h1><p>Some words to begin with.</p><div {names}>Look here for all that you may want to know about it.</div><p>And some to end it.</p></div>"
        assert "Look here for all" in main_text(page, weights) and main_text(page, weights).endswith("And some to end it.")
    for names in ("class='ad-box'", "class='sidebar-left'", "id='cookieNotice'", "class='x comments-section y'", "role=navigation", "aria-hidden=true"):
        page = PAGE % f"<div><h1>Head line</h1><p>Some words to begin with.</p><div {names}>Look here for all that you may want.</div><p>And some to end it.</p></div>"
        assert main_text(page, weights) == "Head line\n\nSome words to begin with.\n\nAnd some to end it."
    # A long insertion doesn't cost the part before it.
    page = PAGE % ("<p>Some words to begin with, of which there are not that many.</p><aside>" + "side words " * 500 + "</aside><p>And very many to end with. " + "word " * 300 + "</p>")
    assert main_text(page, weights).startswith("Some words to begin with") and "side words" not in main_text(page, weights)
    # Names of the body don't leave the page out, nor keep what is in it.
    assert main_text((PAGE % ARTICLE).replace("<body>", "<body class='no-sidebar search-on'>"), weights) == WANT


def test_linear_in_length():
    import time

    weights = fit([PAGE % ARTICLE])
    for page in ("<div>" * 100_000 + "</b>" * 100_000, "<a " * 300_000, "<p>" + "<span>" * 50_000 + "<h1>x</h1>" * 50_000, "<!--" * 300_000, "<script>" * 100_000, "<b>" * 100_000 + "x" + "</b>" * 100_000, "<li>" * 100_000, "<div class='ad'>" * 50_000 + "x"):
        start = time.time()
        main_text(page, weights)
        assert time.time() - start < 20


def test_best_region_against_brute_force():
    rng = random.Random(0)
    for _ in range(300):
        s = [rng.choice([-3, -1, -0.5, 0, 1, 2]) for _ in range(rng.randint(0, 14))]
        a, b = best_region(s)
        assert sum(s[a:b]) == max([0, *(sum(s[i:j]) for i in range(len(s)) for j in range(i, len(s) + 1))])


def test_frame(spark):
    df = spark.createDataFrame([(1, "u", PAGE % ARTICLE, "x"), (2, None, None, "y"), (2, None, None, "y")], "page_id long, url string, html string, text string")
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in extract_main_text(df, fit_weights(df)).collect()), key=str)
    assert got == sorted([(1, "u", WANT, len(WANT)), (2, None, "", 0), (2, None, "", 0)], key=str)
    assert extract_main_text(df.limit(0), fit_weights(df.limit(0))).count() == 0


def test_held_out_pages_without_marks(spark):
    """Weights of half of the labelled pages find the articles of the other half, whose marks are taken away."""
    import html
    import re

    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id").collect()]
    weights, right = fit(pages[::2]), 0
    for page in pages[1::2]:
        inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split("</?(?:p|h1)>", inner)]
        right += main_text(page.replace("article>", "div>"), weights) == "\n\n".join(b for b in blocks if b)
    assert right >= 0.95 * len(pages[1::2])


def test_pages_have_their_whole_articles(spark):
    """On the small table the text is that between the article's marks."""
    import html
    import re

    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in op7_html(spark, sf).collect():
        inner = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split("</?(?:p|h1)>", inner)]
        assert r.text == "\n\n".join(b for b in blocks if b)
