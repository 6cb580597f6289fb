"""Main text of pages of many builds, broken ones, and time that grows with the page."""

import random
import time

import pytest

from loomdex.llm.htmltext import content_paths, extract, main_text, parse

P = [
    "The river rose in the night, and by dawn the lower fields were under water; nobody had seen it coming.",
    "Farmers moved their herds to the hills, where the grass was thin. It would have to do, they said.",
    "Short.",
    "By the weekend, the council had promised help: sandbags, pumps, and two engineers from the coast.",
    "“We have seen worse,” said the oldest of them, “but not in spring, and not twice in one year.”",
]
PARAGRAPHS = "".join(f"<p>{p}</p>\n" for p in P)
TEXT = " ".join(P)
MENU = "<ul>" + "".join(f'<li><a href="/{w}">{w}</a></li>' for w in ("Home", "News, weather", "Sport", "About us.")) + "</ul>"
NOISE = "Buy two, get one free; this week only, at every store. Offers end soon, so hurry, hurry!"
COMMENT = "<div class='comment'><p>I was there, and it was worse than they say: the bridge shook, the road was gone.</p></div>"

PAGES = {
    "article": (f"<html><head><title>T</title></head><body><header><h1>Daily</h1></header><nav>{MENU}</nav><article><h1>Flood</h1>{PARAGRAPHS}</article><aside><p>{NOISE}</p></aside><footer>(c) Daily, all rights reserved.</footer></body></html>", f"Flood {TEXT}"),
    "main and divs": (f"<body><div id='nav'>{MENU}</div><main><h1>Flood</h1><div class='ad'>{NOISE}</div>{PARAGRAPHS}<section class='comments'><h2>Comments</h2>{COMMENT * 5}</section></main></body>", f"Flood {TEXT}"),
    "divs with names": (f"<body class='has-sidebar'><div class='page'><div class='site-header'>Daily</div><div class='content'><h1>Flood</h1>{PARAGRAPHS}</div><div class='sidebar'><p>{NOISE}</p></div><div id='cookie-notice'><p>We use cookies, as all do; read how, and why.</p><button>OK</button></div><div class='footer-links'>{MENU}</div></div></body>", f"Flood {TEXT}"),
    "divs without names": (f"<body><div>{MENU}</div><div><h1>Flood</h1>{PARAGRAPHS}</div><div>{MENU}</div></body>", f"Flood {TEXT}"),
    "body apart from the title": (f"<body><div class='post'><h1>Flood</h1><div class='meta'>By Ann</div><div class='entry-content'>{PARAGRAPHS}</div></div><form><p>{NOISE}</p><input></form></body>", f"Flood {TEXT}"),
    "lists, tables, quotes and code": (f"<article><h1>Flood</h1>{PARAGRAPHS}<h2>Levels</h2><ul><li>North: 3 m</li><li>South</li></ul><table><tr><th>Day</th><th>cm</th></tr><tr><td>1</td><td>30</td></tr></table><blockquote>Never again</blockquote><pre>a  =\n 1</pre><p><a href='/x'>More on this</a></p></article>", f"Flood {TEXT} Levels North: 3 m South Day cm 1 30 Never again a = 1 More on this"),
    "inline parts": (f"<article><p>{P[0]} A<b>B</b><i>C</i> d&amp;e &lt;f&gt; &#8212; g<br>h<span class='ad'>{NOISE}</span>i<a href='/'>j</a>.</p><p>{P[1]}</p></article>", f"{P[0]} ABC d&e <f> — g hij. {P[1]}"),
    "hidden parts": (f"<article>{PARAGRAPHS}<div hidden><p>{NOISE}</p></div><div style='display: none'><p>{NOISE}</p></div><div aria-hidden='true'>{NOISE}</div><div role='alert'>{NOISE}</div></article>", TEXT),
    "never closed": (f"<html><body><nav><ul><li><a href=/a>a<li><a href=/b>b</ul></nav><article><h1>Flood</h1>{PARAGRAPHS.replace('</p>', '')}<p>An end without a tag, for once", f"Flood {TEXT} An end without a tag, for once"),
    "capitals and quotes": (f"<BODY><ARTICLE data-x=\"a > b\" title='it''s'><P CLASS=lead>{P[0]}</P><P title=it's>{P[1]}</P></ARTICLE></BODY>", f"{P[0]} {P[1]}"),
    "scripts": (f"<article><script>if (a < b) document.write('<p>{NOISE}</p>')</script><p>{P[0]}<script>x</script> On.</p><!-- <p>{NOISE}</p> --><style>p > a {{ }}</style><noscript>{NOISE}</noscript><template>{NOISE}</template></article>", f"{P[0]} On."),
    "article header and footer": (f"<article><header><h1>Flood</h1></header>{PARAGRAPHS}<footer>Filed under news.</footer></article>", f"Flood {TEXT}"),
    "comments as articles": (f"<main><article><h1>Flood</h1>{PARAGRAPHS}</article><article class='comment'><p>{P[4]}</p></article></main>", f"Flood {TEXT}"),
    "only a menu": (f"<body><nav>{MENU}</nav></body>", ""),
    "no markup": ("just words, and a mark. a < b & c", "just words, and a mark. a < b & c"),
    "one word": ("<p>word</p>", "word"),
    "only names": (f"<body><div class='sidebar'>{PARAGRAPHS}</div></body>", TEXT),
    "no-break spaces": (f"<article><p>&nbsp;{P[0]}&nbsp;&nbsp;x</p></article>", f"{P[0]} x"),
    "null": (None, ""),
    "empty": ("", ""),
    "odd ends": (f"<article><p>{P[0]}</p></article><", f"{P[0]}"),
}


@pytest.mark.parametrize("name", PAGES)
def test_builds(name):
    page, text = PAGES[name]
    assert main_text(page) == text


def test_paths_share_their_figures():
    page = parse(PAGES["divs without names"][0])
    paths = content_paths(page.blocks)
    chosen = {b.text for b in page.blocks if b.path in paths}
    assert set(P) <= chosen and not chosen & {"Home", "Sport"}


def test_a_quote_that_never_ends_loses_no_text():
    assert main_text(f'<article><p>{P[0]}</p><a href="/x>link</a><p>{P[1]}</p></article>').startswith(P[0])
    assert P[1] in main_text(f'<article><p>{P[0]}</p><a href="/x>link</a><p>{P[1]}</p></article>')


@pytest.mark.parametrize("unit", ["<div>", "<div class=ad>", '<a href="', "<a b='", "<", "<!--", "</div>", "<p>", "<li>", "<td>", "<b>", "&amp", "<span class=ad>", "<ul><li>", "<p><button><x-a>", "<script>", "<a =", '<a b="c"', "x. <p>y, "])
def test_linear_time(unit):
    began = time.perf_counter()
    main_text(unit * 100_000)
    assert time.perf_counter() - began < 20


def test_random_markup_never_fails():
    r = random.Random(5)
    units = ["<div>", "</div>", "<p>", "</p>", "text, more. ", "<a href='x'>", "</a>", "<li>", "<ul>", "</ul>", "<article>", "</article>", "<td>", "</td>", "<table>", "<tr>", '"', "'", "<", ">", "&lt", "<!--", "-->", "<script>", "</script>", "<span class=ad>", "</span>", "<header>", "<br>", "<svg/>", "</", "<h1>", "\x00", "é"]
    for _ in range(2000):
        assert isinstance(main_text("".join(r.choice(units) for _ in range(r.randint(0, 60)))), str)


def test_columns(spark):
    rows = [(k, "u", page, "own", 1) for k, (page, _) in enumerate(PAGES.values())] * 2
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string, n_chars int")
    got = extract(df).collect()
    want = [t for _, t in PAGES.values()] * 2
    assert sorted((r["page_id"], r["text"], r["n_chars"]) for r in got) == sorted((k % len(PAGES), t, len(t)) for k, t in enumerate(want))
    assert extract(df.limit(0)).collect() == []
    assert extract(df, html="html", text="html").columns == ["page_id", "url", "text", "html", "n_chars"]
