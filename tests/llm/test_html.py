"""Main text: no text is lost to names of layout; awkward rows in Spark."""

from __future__ import annotations

import pytest

from colocus.llm import html_main

LINES = [f"{w} runs over the hill and back again" for w in ("alpha", "beta", "gamma", "delta")]
TEXT = "".join(f"<p>{x}</p>" for x in LINES)


@pytest.mark.parametrize("word", html_main.PLACE_WORDS)
@pytest.mark.parametrize("parts", [1, 2, 8])
def test_names_of_place_keep_their_text(word, parts):
    """Inside an article and without one, around little and much of the text, by class and by id."""
    held = [f"part{k} of the story goes on from there" for k in range(parts)]
    inner = "".join(f"<p>{x}</p>" for x in held)
    for name in (f'class="{word}"', f'id="{word}"', f'class="{word}-{word}"', f'class="x9 {word}"'):
        block = f"<div {name}>{inner}</div>"
        want = "\n".join(["Title", *LINES[:2], *held, *LINES[2:]])
        body = "<h1>Title</h1>" + "".join(f"<p>{x}</p>" for x in LINES[:2]) + block + "".join(f"<p>{x}</p>" for x in LINES[2:])
        for page in (f"<body><nav><a href='/'>a</a></nav><article>{body}</article><footer>c</footer></body>", f"<body><nav><a href='/'>a</a></nav><div>{body}</div><footer>c</footer></body>"):
            assert html_main.main_text(page) == want, (name, page)


@pytest.mark.parametrize("word", html_main.FURNITURE_WORDS)
def test_furniture_goes_wherever_it_stands(word):
    for place in ("", " left", " column", "-box"):
        block = f"<div class='{word}{place}'><p>buy this now</p></div>"
        assert html_main.main_text(f"<body>{block}<article>{TEXT}{block}</article>{block}</body>") == "\n".join(LINES), place
        assert html_main.main_text(f"<body><div>{TEXT}{block}</div></body>") == "\n".join(LINES), place


def test_awkward_rows(spark):
    page = f"<article>{TEXT}</article>"
    rows = [(1, "u", None, "x", 0), (2, None, "", "x", 0), (None, "u", page, "x", 0), (4, "v", page, "x", 0), (4, "v", page, "x", 0), (5, "w", "<p>" + "a b " * 60_000 + "</p>", "x", 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = sorted((tuple(r) for r in html_main.extract(df).collect()), key=str)
    whole, long = "\n".join(LINES), ("a b " * 60_000).strip()
    want = [(1, "u", "", 0), (2, None, "", 0), (None, "u", whole, len(whole)), (4, "v", whole, len(whole)), (4, "v", whole, len(whole)), (5, "w", long, len(long))]
    assert got == sorted(want, key=str)
    assert html_main.extract(df.limit(0)).count() == 0


def test_layout_pages_give_their_text():
    for page, main in html_main.layout_pages():
        assert html_main.main_text(page) == main
