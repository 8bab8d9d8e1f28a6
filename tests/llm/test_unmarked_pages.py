"""What content_paths decides on pages without an article, frames or telling class names."""

from __future__ import annotations

import re
import time

import pytest

from portrisk.llm import html_text

PROSE = "<h1>Title</h1><p>A long sentence, with <a href=z>a link</a> and marks. Then one more.</p>"
MENU = "<div><ul><li><a href=x>Home</a><li><a href=y>About us</a></ul></div>"
TEXT = "Title\n\nA long sentence, with a link and marks. Then one more."


def test_link_shares_decide_on_unmarked_pages(monkeypatch):
    page = f"<body>{MENU}<div>{PROSE}</div>{MENU}</body>"
    assert html_text.main_text(page) == TEXT
    monkeypatch.setattr(html_text, "LINKS", 1.0)
    assert html_text.main_text(page) == f"Home\n\nAbout us\n\n{TEXT}\n\nHome\n\nAbout us"


PAGE = " ".join(["Long ago, in a far town, there was a mill; nobody knew who had built it."] * 4)
LINE = "Buy the new lamp today, it is cheap."
OWNED = "(c) 2020 The Mill, Inc."


@pytest.mark.parametrize("page, text", [
    (f"<body><div>{LINE}</div><div><h1>Title</h1><p>{PAGE}<p>{PAGE}<ul><li>Eggs<li>1</ul></div><div>{OWNED}</div>", f"Title\n\n{PAGE}\n\n{PAGE}\n\nEggs\n\n1"),
    (f"<div><div><span>{LINE}</span></div><div><div><h2>Title</h2><i>By me.</i></div><div><p>{PAGE}</p><p>Short.</div></div></div>", f"Title\n\nBy me.\n\n{PAGE}\n\nShort."),
    (f"<table><tr><td><b>{LINE}</b><td>{PAGE}<br>{PAGE}<br>{PAGE}<div>End.</div><tr><td><i>{OWNED}</i></table>", f"{PAGE} {PAGE} {PAGE}\n\nEnd."),
    (f"<div><section><h2>One</h2><p>{PAGE}</section><section><h2>Two</h2><p>No.</section></div><div>&copy; Mill</div>", f"One\n\n{PAGE}\n\nTwo\n\nNo."),  # equal paths
    (f"<body><div><x-note>{OWNED}</x-note></div><div><p>{PAGE}<p>{PAGE}<x-a>Odd tag.</x-a></div>", f"{PAGE}\n\n{PAGE}\n\nOdd tag."),
    (f"<div><h2>Title</h2><p>Short, too.</div><div>{OWNED}</div>", f"Title\n\nShort, too.\n\n{OWNED}"),  # the ratios tell nothing
])
def test_ratios_choose_the_box_of_the_text(monkeypatch, page, text):
    assert html_text.main_text(page) == text
    monkeypatch.setattr(html_text, "SHARE", 0.0)
    assert (html_text.main_text(page) == text) == (OWNED in text)


def test_the_text_does_not_depend_on_the_marks(spark):
    menu = "<nav><ul><li><a href=x>Home</a><li><a href=y>About us</a></ul></nav>"
    marked = f"<html><body>{menu}<div class=ad>{LINE}</div><article><h1>Title</h1><p>{PAGE}<br>More.</p><p>Short.</p></article><footer>{OWNED}</footer></body></html>"
    unmarked = re.sub(r"(</?)(nav|article|footer)", r"\1div", marked).replace(" class=ad", "")
    rows = spark.createDataFrame([(1, "u", marked), (2, "v", unmarked), (2, "v", unmarked), (3, None, None)], "page_id long, url string, html string")
    text = f"Title\n\n{PAGE} More.\n\nShort."
    got = sorted((r.page_id, r.url, r.text, r.n_chars) for r in html_text.extract(rows).collect())
    assert got == [(1, "u", text, len(text)), (2, "v", text, len(text)), (2, "v", text, len(text)), (3, None, "", 0)]


@pytest.mark.parametrize("part", ["<div>a", "<div><h2>a</h2>b", "<section>a, b.</section>"])
def test_a_megabyte_of_boxes(part):
    start = time.process_time()
    assert html_text.main_text(part * ((1 << 20) // len(part)))
    assert time.process_time() - start < 30
