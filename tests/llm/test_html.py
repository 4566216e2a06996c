"""Pages made from known articles, odd pages, and pages that nest deeply."""

import random
import time
from html import escape

import pytest

from barloom.llm import html

WORDS = "river stone light garden window quiet morning paper table green café & <b> 中文 \"said\"".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + ("," if rng.random() < 0.15 else "") for _ in range(n)) + "."


def made(seed):
    """(page, its article): an article within one of several wrappers, among parts that aren't article."""
    rng = random.Random(seed)
    blocks, body = [], []
    for _ in range(rng.randint(2, 8)):
        kind = rng.choice(["p", "p", "p", "h2", "blockquote", "li", "pre"])
        text = prose(rng, rng.randint(3, 5) if kind == "h2" else rng.randint(12, 60))
        blocks.append(" ".join(text.split()))
        inner = escape(text, quote=False).replace(" ", rng.choice([" ", "\n ", "  "]))
        if rng.random() < 0.3 and kind == "p":
            cut = inner.index(" ")
            inner = f"<a href='/x'>{inner[:cut]}</a>{inner[cut:]}"
        body.append({"li": f"<ul><li>{inner}</ul>", "p": f"<p>{inner}" + rng.choice(["", "</p>"])}.get(kind, f"<{kind}>{inner}</{kind}>"))
    article = "\n".join(body)
    wrap = rng.choice(["<article>%s</article>", "<main>%s</main>", '<div class="post-content">%s</div>', '<div class="post related-content">%s</div>', '<div id="c1">%s</div>', '<form action="/"><div>%s</div><input name=q></form>'])
    side = f'<div class="sidebar"><p>{prose(rng, 30)}</p></div>'
    links = "".join(f"<li><a href=/{k}>Link {k}</a></li>" for k in range(6))
    parts = [
        f"<nav><ul>{links}</ul></nav>",
        f'<div class="menu"><ul>{links}</ul></div>',
        '<div id="cookie-banner"><p>We use cookies, all kinds, to make it work.</p></div>',
        '<header><h1>The site</h1></header>',
        "<script>var a = '<p>no</p>';</script><style>p{color:red}</style>",
    ]
    after = [side, '<div class="ad-box">Buy, buy, buy now</div>', f'<section id="comments"><p>{prose(rng, 25)}</p></section>', "<footer>&copy; 2020 The site</footer>"]
    rng.shuffle(parts)
    rng.shuffle(after)
    page = f"<!doctype html><html><head><title>T</title></head><body>{''.join(parts[: rng.randint(0, 5)])}<div class=wrap>{wrap % article}</div>{''.join(after[: rng.randint(0, 4)])}</body></html>"
    return page, "\n".join(blocks)


@pytest.mark.parametrize("seed", range(300))
def test_known_articles(seed):
    page, want = made(seed)
    assert html.main_text(page) == want


def test_no_text_is_lost_to_a_form_or_a_word():
    p = "<p>" + "This is a sentence, with commas, and words that go on. " * 5 + "</p>"
    for page in (f"<form><div>{p}{p}</div></form>", f"<body><div class='social-policy'>{p}</div></body>", f"<div class='cookie-box'>{p}</div>", f"<aside>{p}</aside>"):
        assert len(html.main_text(page)) > 200
    assert html.main_text(f"<div class=comments>{p}</div>") == ""
    assert html.main_text(f"<div><p>Art, text, ok.</p></div><div class=comments>{p}</div>") == "Art, text, ok."


def test_equal_sections_both_stay():
    p = "<p>" + "x" * 290 + ",,,</p>"
    assert html.main_text(f"<div><section>{p}</section><section>{p}</section></div>").count("\n") == 1


@pytest.mark.parametrize(
    "page",
    ["<div>x" * 100_000, "<b>" * 100_000 + "</i>" * 100_000, "<div>" * 50_000 + "<li>x" * 50_000, "<b>" * 50_000 + "<p>x</p>" * 50_000, "<article>x" * 50_000, "<div><b>" * 30_000 + "</b></div>" * 30_000, "<table><tr><td>" * 30_000],
)
def test_deep_pages_take_seconds(page):
    began = time.process_time()
    html.main_text(page)
    assert time.process_time() - began < 8


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "u", "<p>a b", "t", 7)], "page_id long, url string, html string, text string, n_chars int")
    assert html.extracted(df).collect()[0].asDict() == {"page_id": 1, "url": "u", "text": "a b", "n_chars": 3}
    assert html.extracted(df.limit(0)).count() == 0
