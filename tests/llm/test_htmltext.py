from __future__ import annotations

import time

import pytest

from glyphloom.llm.htmltext import extract_text, page_texts

PARA = "A first paragraph, with commas, and long enough to score some points for its container."
MORE = "A second paragraph, which follows the first, and adds a few words more to the text."


def page(body: str) -> str:
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body class='has-sidebar'>{body}</body></html>"


CUTS = [
    "<nav><ul><li><a href=/a>Home</a></ul></nav>", "<header><h1>Site</h1></header>", "<footer>&copy; somebody, 2024</footer>",
    "<aside><p>Side text, long enough, yes, to score a point or two of its own.</p></aside>",
    "<div class='sidebar'><p>Side text, long enough, yes, to score a point or two of its own.</p></div>",
    "<div id=cookie-notice>We use cookies, as all do, and ask you to accept them all now.</div>", "<div class='ad'>Buy, buy, buy, and buy some more of it today.</div>",
    "<form><p>Your name, your mail, and what you want to tell us, please.</p><input></form>", "<script>var t = '</p><p>x';</script>", "<style>p{}</style>",
    "<section id=comments><article class=comment><p>I think, as a reader, that this, all of it, is fine.</p></article></section>",
    "<div role=navigation><p>Menu, with, many, commas, in, it, and more</p></div>", "<div style='display: none'><p>Hidden, text, of some length, is not shown</p></div>", "<!-- a comment -->", "<div hidden>not seen</div>",
]


@pytest.mark.parametrize("cut", CUTS)
@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main><div>{}</div></main>", "<div class=content>{}</div>"])
def test_only_the_article_stays(cut, wrap):
    text = f"Title\n\n{PARA}\n\n{MORE}"
    inner = f"<h1>Title</h1><p>{PARA}</p><p>{MORE}</p>"
    assert extract_text(page(cut + wrap.format(inner))) == text
    assert extract_text(page(wrap.format(inner) + cut)) == text
    assert extract_text(page(wrap.format(inner + cut))) == text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""), ("", ""), ("   ", ""), ("no tags &amp; all", "no tags & all"), ("<p>a<b>b</b>c  d\n e", "abc d e"), ("<p>one<p>two", "one\n\ntwo"),
        ("<p>one<br>two</p>", "one two"), ("<p>x &lt;b&gt; &eacute; &#65;&#x42; &nope;</p>", "x <b> é AB &nope;"), ("<p>cut off <a href='x", "cut off"), ("<p>fish &am", "fish &am"),
        ("<p>&nbsp;a&nbsp;&nbsp;b </p>", "a b"), ("<ul><li>1<li>2</ul>", "1\n\n2"), ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"), ("</div></p>x", "x"), ("<p><b>bold<p>next", "bold\n\nnext"),
    ],
)
def test_blocks(html, text):
    assert extract_text(html) == text


def test_an_article_inside_an_oddly_named_wrapper():
    assert extract_text(page(f"<div class='content-sidebar-wrap'><article><p>{PARA}</p></article></div>")) == PARA


def test_siblings_of_the_best_container_stay():
    parts = "".join(f"<div class=part><p>{PARA}</p><p>{MORE}</p></div>" for _ in range(3))
    links = "<div>" + "".join(f"<a href=/{i}>A link, to somewhere, of some length {i}</a> " for i in range(9)) + "</div>"
    assert extract_text(page(f"<div>{parts}{links}</div>")) == "\n\n".join([PARA, MORE] * 3)


N = 1_000_000
HARD = [
    "<p>some words, and more</p>" * (N // 27), "<a <" * (N // 4), "<a <a " * (N // 6) + ">", "<p " * (N // 3), "<!-- " * (N // 5), "</" * (N // 2), "<b>" * (N // 3),
    "&" * N, "<div>" * (N // 5), "<a>" * (N // 3), "<div>some words, and more of them yes" * (N // 37), "<script>" + "</script " * (N // 9),
    "<p><button>" + "<div>" * (N // 5), "<article>" * (N // 9), "<div>" * (N // 10) + "<body>" * (N // 12), "<div>" * (N // 10) + "</b>" * (N // 8),
    "<li><ul>" * (N // 8), "<td><div>" * (N // 9), "<b>" * (N // 6) + "x<hr>" * (N // 10), "<div><a>abc def</a>" * (N // 19), "<p a=" + " " * N + ">x",
    "<a \"<b '>\" '<c \"> '" * (N // 20), "<form class=notice>" * (N // 19),
]


@pytest.mark.parametrize("bad", HARD, ids=lambda x: x[:22])
def test_a_megabyte_takes_linear_time(bad):
    begun = time.process_time()
    extract_text(bad)
    assert time.process_time() - begun < 10


def test_long_texts_stay_whole():
    assert len(extract_text("<p>some words, and more</p>" * 40_000)) == 40_000 * 22 - 2


def test_frame(spark):
    long = "<div>" * 3_000 + f"<p>{PARA}</p>" * 20_000
    rows = [(3, "v", long, "z"), (1, "u", f"<p>{PARA}</p>", "x"), (2, None, None, "y"), (None, "u", "", None), (1, "u", f"<p>{PARA}</p>", "x")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, main_text string")
    got = sorted((tuple(r) for r in page_texts(frame).collect()), key=str)
    whole = "\n\n".join([PARA] * 20_000)
    assert got == sorted([(3, "v", whole, len(whole)), (1, "u", PARA, len(PARA)), (1, "u", PARA, len(PARA)), (2, None, "", 0), (None, "u", "", 0)], key=str)
    assert page_texts(frame.limit(0)).collect() == []


@pytest.mark.parametrize("section", ["<div>{}</div>", "<div><div class=inner>{}</div></div>", "<section><div><div>{}</div></div></section>"])
def test_a_short_section_beside_a_long_one_stays(section):
    last = "One more section, of one paragraph alone, which is as much of the article as the rest of it. " * 3
    body = section.format(f"<h2>Long</h2>{f'<p>{PARA * 4}</p>' * 10}") + section.format(f"<h2>Short</h2><p>{last}</p>")
    want = "\n\n".join(["Long", *[PARA * 4] * 10, "Short", last.strip()])
    assert extract_text(page(body)) == want
    assert extract_text(page(f"<div id=wrap>{body}</div>")) == want


LINKED = ["A book of some length", "Another book", "A third one, by somebody"]


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main><div>{}</div></main>", "<div class=content>{}</div>"])
@pytest.mark.parametrize(
    "links",
    [
        "<ul>" + "".join(f"<li><a href=/>{x}</a></li>" for x in LINKED) + "</ul>",
        "<table>" + "".join(f"<tr><td><a href=/>{x}</a></td></tr>" for x in LINKED) + "</table>",
        "<div><ol>" + "".join(f"<li><a href=/>{x}</a></li>" for x in LINKED) + "</ol></div>",
        "<dl>" + "".join(f"<dd><a href=/>{x}</a></dd>" for x in LINKED) + "</dl>",
    ],
)
def test_lists_of_sources_stay_in_the_article(wrap, links):
    body = wrap.format(f"<p>{PARA}</p><p>{MORE}</p><h2>Sources</h2>{links}")
    assert extract_text(page(body)) == "\n\n".join([PARA, MORE, "Sources", *LINKED])
    menu = f"<div class=menu>{links}</div>"
    assert extract_text(page(wrap.format(f"{menu}<p>{PARA}</p><p>{MORE}</p>"))) == f"{PARA}\n\n{MORE}"


#: Article bodies with the text that they hold, as it was written down by hand.
TWO = f"<p>{PARA}</p><p>{MORE}</p>"
BODIES = [
    (f"<div>{TWO}</div>", [PARA, MORE]),
    (f"<div>{TWO}</div><div><p>He said no.</p></div>", [PARA, MORE, "He said no."]),
    (f"<div>{TWO}</div><ul><li>Salt<li>Flour</ul>", [PARA, MORE, "Salt", "Flour"]),
    (f"<div>{TWO}</div><table><tr><td>1<td>two</table>", [PARA, MORE, "1", "two"]),
    (f"<h1>Title</h1><div>{TWO}</div>Loose text at the end.", ["Title", PARA, MORE, "Loose text at the end."]),
    (f"<h2>One</h2><section>{TWO}</section><h2>Two</h2><section><p>{MORE}</p><p>Yes.</p></section>", ["One", PARA, MORE, "Two", MORE, "Yes."]),
]
#: What surrounds them.
LAYOUTS = [
    "{}", "<div id=page>{}</div>", "<form action=/><input type=hidden name=state>{}</form>", "<div class='sidebar-layout'><div class=inner>{}</div></div>",
    "<nav><a href=/>Home</a></nav><div class=content>{}</div><footer>Somebody, 2024</footer>",
    "<div class=menu><a href=/>Home</a> <a href=/b>More</a></div>{}<div class='cookie-notice'>We use cookies, as all do, and ask you to accept them.</div>",
    "<ul><li><a href=/>Home</a><li><a href=/b>News</a><li><a href=/c>About</a></ul><div>{}</div><form><p>Your mail, please, so that we can write to you.</p><input></form>",
]


@pytest.mark.parametrize("layout", LAYOUTS)
@pytest.mark.parametrize(("body", "text"), BODIES)
def test_pages_without_an_article(layout, body, text):
    assert extract_text(page(layout.format(body))) == "\n\n".join(text)


@pytest.mark.parametrize("name", ["share-price", "legal-analysis", "notice", "header", "form", "widget-sizes", "sidebar"])
def test_names_do_not_overrule_the_text(name):
    long = "<p>" + f"{PARA} " * 2 + "</p>"
    body = f"<article><div class='{name}'>{long * 10}</div><p>End of it.</p></article>"
    assert extract_text(page(body)) == "\n\n".join([f"{PARA} {PARA}"] * 10 + ["End of it."])
    some = f"<article>{long * 10}<div class='{name}'>{long * 3}</div></article>"
    assert extract_text(page(some)) == "\n\n".join([f"{PARA} {PARA}"] * (10 if name == "sidebar" else 13))
    short = f"<article>{long * 3}<div class='{name}'><p>{PARA}</p></div></article>"
    assert extract_text(page(short)) == "\n\n".join([f"{PARA} {PARA}"] * 3)


def test_articles_side_by_side_stay_and_teasers_go():
    two = f"<article>{TWO}</article><article><p>{MORE}</p></article>"
    teasers = f"<div class=related><article><p><a href=/x>{PARA}</a></p></article><article><p>{MORE}</p></article></div>"
    assert extract_text(page(f"<div>{two}</div>")) == "\n\n".join([PARA, MORE, MORE])
    assert extract_text(page(f"<article>{TWO * 3}</article>{teasers}")) == "\n\n".join([PARA, MORE] * 3)


def test_a_legal_notice_longer_than_the_article_goes():
    assert extract_text(page(f"<article>{TWO}</article><div class=legal>{f'<p>{PARA} {PARA}</p>' * 9}</div>")) == f"{PARA}\n\n{MORE}"
