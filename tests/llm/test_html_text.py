import pytest

from proofline.llm.html_text import extract, main_text

PAGES = [
    (None, ""), ("", ""), ("<div><br></div>", ""), ("plain &amp; simple", "plain & simple"),
    ("<p>one<p>two <b>bold</b>,\n three<br>four</p>", "one\ntwo bold, three four"),
    ("<body><nav><a href=x>Menu</a></nav><article><h1>T</h1><p>Body, of text.</p></article><footer>f</footer>", "T\nBody, of text."),
    ("<body><div class='site-header'>h</div><main><p>A.</p><div id=comments><p>Long comment, long. Longer, still.</p></div></main>", "A."),
    ("<script>var a='<p>no</p>';</script><style>p{}</style><p>x &lt; y &#233; &nbsp; z</p>", "x < y é z"),
    ("<article><p>Open <i>never closed<p>Next</article><aside>side</aside>", "Open never closed\nNext"),
    ("<article><form><label>Name</label><input></form><p>Kept</p><!-- <p>no</p> --></article>", "Kept"),
    ("<article></b></div><p>stray ends</p>", "stray ends"), ("<article><p>a <", "a <"),
    ('<article><p title="a > b">quoted</p></article>', "quoted"),
    ("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>", "deep"),
]


@pytest.mark.parametrize(("page", "text"), PAGES)
def test_main_text(page, text):
    assert main_text(page) == text


def test_short_article_beside_a_longer_advert():
    page = "<body><div class=ad>Buy this, it is good. Buy it, now, at once.</div><article><p>Hm.</p></article></body>"
    assert main_text(page) == "Hm."


def test_links_without_a_name_are_left_out():
    links = "".join(f"<div><a href=/{i}>Go to page {i}</a></div>" for i in range(20))
    body = "".join(f"<p>Sentence {i}, which goes on, and on, until it ends.</p>" for i in range(5))
    assert main_text(f"<body>{links}<section><h2>Head</h2>{body}</section></body>").split("\n")[0] == "Head"


def test_extract_keeps_other_columns(spark):
    rows = [(1, "u", "<p>é</p>", 5), (1, "u", "<p>é</p>", 5), (None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    got = sorted(map(tuple, extract(df).collect()), key=str)
    assert got == [(1, "u", "é", 1), (1, "u", "é", 1), (None, None, "", 0)]
    assert extract(df.limit(0)).count() == 0


def test_every_page_of_the_test_table(spark):
    import html
    import os
    import re

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("test tables are not here")
    for r in spark.read.parquet(f"{folder}/pages.parquet").collect():
        body = re.search("<article>(.*)</article>", r.html, re.S)[1]
        lines = re.sub("</?(?:b|br)>", " ", re.sub("</?(?:p|h1)>", "\n", body)).split("\n")
        assert main_text(r.html) == "\n".join(x for x in (" ".join(html.unescape(line).split()) for line in lines) if x)


ARTICLE = "<h1>T</h1>" + "".join(f"<p>Sentence {i}, which goes on, and on, until it ends.</p>" for i in range(5))
TEXT = "T\n" + "\n".join(f"Sentence {i}, which goes on, and on, until it ends." for i in range(5))
LINKS = "<ul class=x>" + "".join(f"<li><a href=/{i}>Go to {i}</a></li>" for i in range(20)) + "</ul>"


@pytest.mark.parametrize("wrapper", ["div class='has-sidebar'", "div class='with-header'", "div id='page-widget-area'", "form action=x"])
@pytest.mark.parametrize("inner", ["<article>{}</article>", "<main>{}</main>", "{}"])
def test_a_wrapper_with_hint_words_keeps_the_article(wrapper, inner):
    tag = wrapper.split()[0]
    other = "<nav>Menu</nav><div class=comments><p>A comment, from a reader. It is short.</p></div>"
    assert main_text(f"<body><{wrapper}>{other}{inner.format(ARTICLE)}</{tag}></body>") == TEXT


def test_comments_are_no_wrapper():
    page = "<body><p>Short, but all there is.</p><div class='comments widget'>" + ARTICLE.replace("Sentence", "Reader") + "</div></body>"
    assert main_text(page) == "Short, but all there is."
    assert main_text("<body><div class=comments><article>" + ARTICLE + "</article></div></body>") == ""


@pytest.mark.parametrize("menu", [LINKS, "<div>" + LINKS + "</div>", "<div>" + "".join(f"<a href=/{i}>Go to {i}</a> | " for i in range(20)) + "</div>"])
@pytest.mark.parametrize("page", ["<article>{m}{a}</article>", "<div>{m}<article>{a}</article></div>", "<div class=c>{a}{m}</div>", "<div class=rail>{m}{a}</div>"])
def test_a_menu_with_a_neutral_name_goes(menu, page):
    assert main_text("<body>" + page.format(m=menu, a=ARTICLE) + "</body>") == TEXT


def test_the_share_decides(monkeypatch):
    from proofline.llm import html_text

    monkeypatch.setattr(html_text, "SHARE", 0)
    assert "Go to 3" in main_text(f"<article>{ARTICLE}{LINKS}</article>")


def test_lists_and_single_links_of_the_article_stay():
    page = f"<article>{ARTICLE}<ul><li>short</li><li>an <a href=x>item</a></li></ul><p><a href=y>Source</a></p></article>"
    assert main_text(page) == TEXT + "\nshort\nan item\nSource"
