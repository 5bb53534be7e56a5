import pytest

from neumes.llm.html_text import html_text, main_text

S = [f"Sentence number {k} says something, and then {'goes on about it' if k % 2 else 'stops short of more'}; that is all." for k in range(40)]
ARTICLE = ["A title of the page", S[0] + " " + S[1], "Short, but part of it.", S[2] + " " + S[3] + " " + S[4], "First point.", "Second point", S[5]]
BODY = (
    f"<h1>A title of the page</h1><p>{S[0]} {S[1]}</p>\n<p>Short, <b>but</b> part\n of it.</p><p>{S[2]} <a href='/x'>{S[3]}</a> {S[4]}</p>"
    f"<ul><li>First point.<li>Second point</ul><p>{S[5]}</p>"
)
LINKS = "".join(f"<li><a href='/{k}'>Link {k}</a></li>" for k in range(8))
COMMENTS = "".join(f"<div class='comment'><p><b>Reader {k}</b></p><p>{S[20 + k]} {S[30 + k]}</p></div>" for k in range(3))
TEASERS = "".join(f"<li><a href='/t{k}'>{S[10 + k]}</a></li>" for k in range(5))

LAYOUTS = {
    "semantic": f"""<!doctype html><html><head><title>T</title><script>if (a < b) document.write("<p>x, y. z.</p>")</script></head><body>
        <header><h2>Site, the best.</h2><nav><ul>{LINKS}</ul></nav></header><div class="cookie-notice"><p>We use cookies, as all do. Please agree.</p></div>
        <main><article>{BODY}<aside><p>{S[7]}</p></aside></article><section id="comments">{COMMENTS}</section></main>
        <aside><ul>{TEASERS}</ul></aside><form><p>Send us, please, a line.</p><textarea>a, b, c.</textarea></form><footer><p>All rights, all of them, reserved. {S[8]}</p></footer></body></html>""",
    "classes": f"""<body class="has-sidebar"><div id="header"><p>Site. The best, ever.</p></div><div class="main-menu"><ul>{LINKS}</ul></div><div id="content"><div class="post">{BODY}
        <div class="advert"><p>{S[9]}</p></div></div><div class="commentList">{COMMENTS}</div></div><div class="sidebar"><p>{S[7]}</p><ul>{TEASERS}</ul></div><div id="footer"><p>{S[8]}</p></div>""",
    "no names": f"""<body><div><ul>{LINKS}</ul></div><div><div>{BODY}</div></div><div><a href=/a>Home</a> | <a href=/b>About</a> | <a href=/c>More</a></div>""",
    "table": f"""<table><tr><td><ul>{LINKS}</ul></td><td class=text>{BODY}</td></tr></table>""",
    "open tags": f"""<html><body><nav><ul>{LINKS}</ul></nav><article>{BODY.replace('</p>', '').replace('</li>', '')}""",
    "many comments": f"""<body><div class="story">{BODY}</div><div id="comments">{COMMENTS * 12}</div>""",
    "hidden": f"""<body><div style="display: none"><p>{S[11]} {S[12]}</p></div><article>{BODY}<p hidden>{S[13]}</p><template><p>{S[14]}</p></template></article>""",
    "telling classes by numbers": f"""<div class=x1><a href=/>a</a> <a href=/b>b</a></div><div class=x2>{BODY}</div><div class=x3><p>{S[7]}</p></div><div class=x4>{COMMENTS.split("</div>")[0].replace("class='comment'", "class=x5")}</div></div>""",
    "roles": f"""<div role=banner><p>{S[8]}</p></div><div role=navigation><ul>{LINKS}</ul></div><div role=main>{BODY}<form><p>{S[9]}</p></form></div><div role=contentinfo><p>{S[7]}</p></div>""",
    "header of the article": f"""<header><p>{S[8]}</p></header><article><header>{BODY[: BODY.index('<p>')]}</header>{BODY[BODY.index('<p>') :]}<section class=reader-comments>{COMMENTS}</section><div class=related-posts><ul>{TEASERS}</ul></div></article>""",
    "quotes": f"""<body><div title="a > b" class='story'>{BODY}</div><!-- <p>{S[15]}</p> --><div class=share><p>Share, please.</p></div>""",
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_only_the_article(name):
    assert main_text(LAYOUTS[name]).split("\n") == ARTICLE


def test_blocks_white_space_and_references():
    page = "<article><p>a&amp;b&nbsp;&lt;c&gt; &#233;&#x41;\n\t d</p><p>one<br>two<br><br>three</p><div>x<span> y</span>z</div>&am</article>"
    assert main_text(page) == "a&b <c> éA d\none two\nthree\nx yz\n&am"


def test_odd_pages():
    assert [main_text(x) for x in (None, "", " ", "<", "<p", "<!--", "<script>a", "</p>", "<html></html>")] == ["", "", "", "<", "", "", "", "", ""]
    assert main_text("no markup at all") == "no markup at all"
    assert main_text("<p title=\"never closed>text") == main_text("<p title=\"never closed>text")
    assert main_text("<article><h1>One</h1></article>") == "One"
    long = "<article>" + "".join(f"<p>{s}</p>" for s in S * 500) + "</article>"
    assert main_text(long).split("\n") == S * 500
    deep = "<div>" * 3000 + S[0] + "</div>" * 3000
    assert main_text(deep) == S[0]


def test_table(spark):
    rows = [(1, "u", LAYOUTS["semantic"]), (1, "u", LAYOUTS["semantic"]), (2, None, None), (3, "v", "")]
    df = spark.createDataFrame([(*r, "clash", 0) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    out = sorted((r.page_id, r.url or "", r.text, r.n_chars) for r in html_text(df).collect())
    text = "\n".join(ARTICLE)
    assert out == [(1, "u", text, len(text)), (1, "u", text, len(text)), (2, "", "", 0), (3, "v", "", 0)]
    assert html_text(df.limit(0)).count() == 0


def test_whole_table(spark):
    """All pages against a plain reading of what stands in their article element."""
    import html
    import re

    from neumes.llm.queries import QUERIES

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    want = {}
    for r in pages:
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in re.split(r"</?(?:h1|p)>|<br>", inner))
        want[r.page_id] = (r.url, "\n".join(p for p in parts if p))
    got = QUERIES["op11_html_text"](spark, "/root/testdata/sf0.01").collect()
    assert {r.page_id: (r.url, r.text) for r in got} == want and len(got) == len(pages)
    assert all(r.n_chars == len(r.text) for r in got)
