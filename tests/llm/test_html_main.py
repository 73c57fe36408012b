import numpy as np

from chainweave.llm import html_main as h

LONG = "A paragraph that is long enough to be a paragraph of the article, with more words than any link. "
SCHEMA = "page_id long, url string, html string, text string"


def test_article_without_its_surroundings():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
    <header><a href=/>Site</a></header><nav><ul><li><a>Home</a><li><a>News</a></ul></nav><div class="cookie-notice">We use cookies, and we say so at some length here.</div>
    <article><header><h1>Head&eacute;line &amp; more</h1><span>by someone</span></header><p>{LONG}<b>bold</b>ly<br>next&nbsp;line</p><p>Short.<p>a &lt; b
    <form><label>Name</label><input></form><aside>Side</aside><section id="comments"><p>{LONG}</p></section></article>
    <div class="sidebar">{LONG}</div><div class="ad">{LONG}</div><footer>&copy; {LONG}</footer></body></html>"""
    assert h.main_text(page) == f"Headéline & more {LONG}boldly next line Short. a < b"


def test_without_article_the_dense_region_is_chosen():
    links = "".join(f"<li><a href=/{i}>link {i}</a></li>" for i in range(12))
    page = f"<body><div><ul>{links}</ul></div><div id=content><h1>Title</h1><p>{LONG}</p><p>Tiny.</p><p>{LONG * 3}</p></div><div><a>one</a> <a>two</a> <a>three</a></div>"
    assert h.main_text(page) == f"Title {LONG}Tiny. {' '.join((LONG * 3).split())}"


def test_what_is_left_open():
    assert h.main_text(f"<body><nav><a>x</a><article><p><b>{LONG}<br><p>Second.") == f"{LONG}Second."
    assert h.main_text("<article>a<script>never closed <p>b") == "a"
    assert h.main_text("<p>a<!-- <p>b</p> --><p>c & d</p></span></div>") == "a c & d"
    assert h.main_text("just text") == "just text" and h.main_text("") == "" and h.main_text("<html></html>") == ""
    assert h.main_text(f'<div class="has-sidebar"><main><p>{LONG}</main></div>') == LONG.strip()


def test_long_page_is_whole():
    words = [f"w{i}" for i in range(200_000)]
    assert h.main_text("<article><p>" + " \n ".join(words)) == " ".join(words)


def test_smoothing_and_threshold():
    assert np.allclose(h.smoothed(np.ones(7)), 1) and h.smoothed(np.array([0, 0, 9.0, 0, 0]))[1] > 0
    assert 1 < h.threshold(np.array([0.5, 1, 9, 10])) < 9 and h.threshold(np.array([2.0, 2.0])) < 2


def test_rows_of_a_table(spark):
    rows = [(1, "u", f"<article><p>{LONG}</p></article>", "x"), (1, "u", f"<article><p>{LONG}</p></article>", "x"), (None, None, None, None), (3, "v", "", "y"), (4, None, "<nav>a</nav>", None)]
    got = sorted(map(tuple, h.extract(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    want = [(i, u, LONG.strip() if i == 1 else "", len(LONG.strip()) if i == 1 else 0) for i, u, *_ in rows]
    assert got == sorted(want, key=str)
    assert h.extract(spark.createDataFrame([], SCHEMA)).collect() == []
