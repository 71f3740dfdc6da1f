"""Main text of pages: made pages whose article is known, misleading names, broken and deep markup."""

import html
import random
import time

import pytest

from shelfcast.llm.html_content import extract, is_around, main_text

LONG = "A long sentence, with commas and words, that makes a paragraph. " * 5
L = LONG.strip()


@pytest.mark.parametrize(
    "page, want",
    [
        (f'<body><div class="layout with-sidebar"><article><p>{L}</p></article></div>', [L]),
        (f'<div class="has-header"><main><p>{L}</p></main></div>', [L]),
        (f'<div class="sidebar-layout"><article><p>{L}</p></article></div>', [L]),
        (f'<article><h1 class="entry-header">Head</h1><p>{L}</p></article>', ["Head", L]),
        (f'<article><header><h1>Head</h1></header><p>{L}</p></article>', ["Head", L]),
        (f'<div class="article-header"><h1>Head</h1></div><div><p>{L}</p><p>{L}</p></div>', ["Head", L, L]),
        (f"<article><p>Let <math>x</math> be <button>so</button> <label>it</label> {L}</p></article>", [f"Let x be so it {L}"]),
        (f'<article><p>{L}</p><div class="comments"><p>{L}</p></div></article>', [L]),
        (f'<div class="widget"><p>{L}</p><p>{L}</p></div>', [L, L]),
        (f"<form><article><p>{L}</p></article><label>name</label></form>", [L]),
        (f"<nav><a href=x>menu</a></nav><article><p>{L}</p><p hidden>note</p></article><footer>foot</footer>", [L]),
        (f'<div class="a b c sidebar"><p>{L}</p></div><div class="a b c text"><p>{L} 1</p><p>{L} 2</p></div>', [f"{L} 1", f"{L} 2"]),
        (f"<div><p><a href=x>Spark</a> is an engine, {L}</p></div>", [f"Spark is an engine, {L}"]),
        (f"<p>a < b and c > d, {L}</p>", [f"a < b and c > d, {L}"]),
        (f"<article><p title='a > b'>{L}</p><p title='open>{L}</p></article>", [L, L]),
        ("<article><table>" + "".join(f"<tr><td>{i}</td></tr>" for i in range(3)) + f"</table><p>{L}</p></article>", ["0", "1", "2", L]),
        (None, []), ("", []), ("<div></div>", []), ("<script>x</script>", []), ("<p", []),
    ],
)
def test_pages(page, want):
    assert extract(page or "") == "\n".join(want)


def test_names():
    assert all(is_around(n) for n in ("sidebar", "sidebar-left", "main_nav", "cookie-banner", "header"))
    assert not any(is_around(n) for n in ("with-sidebar", "has_header", "entry-header", "text", "-", "advertised"))
    assert not is_around("header", "h1") and not is_around("header", inside=True)


def made_page(rng):
    """A page and the blocks of its article."""

    def sentence(n):
        return " ".join(rng.choices(["word", "größe", "café", "a&b", "x<y", "text", "more"], k=n)).capitalize() + rng.choice([".", "!", ", so."])

    def inline(text):
        cut = rng.randrange(len(text))
        kind = rng.choice(["{}", "<b>{}</b>", "<a href='/x?a=1&b=\">\"'>{}</a>", "<em class=k>{}</em>"])
        return html.escape(text[:cut]) + kind.format(html.escape(text[cut:]))

    blocks = [" ".join(sentence(rng.randrange(8, 20)) for _ in range(rng.randrange(2, 6))) for _ in range(rng.randrange(3, 9))]
    body = "".join(rng.choice(["<p>{}</p>", "<p>{}\n", "<p class='t p1'>{}</p>", "<blockquote>{}</blockquote>"]).format(inline(b)) for b in blocks)
    links = "".join(f"<li><a href='/{i}'>{sentence(2)}</a>" for i in range(rng.randrange(2, 9)))
    before = [f"<nav><ul>{links}</ul></nav>", f"<header><h2>{sentence(3)}</h2></header>", f"<div class='cookie-notice'>{sentence(9)}</div>",
              "<!-- <p>not here</p> -->", "<style>p { x: '</p>' }</style>", f"<form><label>{sentence(2)}</label><input></form>"]
    after = [f"<aside><p>{sentence(12)}</p></aside>", f"<div class='sidebar-right'><ul>{links}</ul></div>", f"<footer>{sentence(9)}</footer>",
             f"<div id='comments'><p>{sentence(14)}</p></div>", f"<script>'<p>{sentence(9)}</p>'</script>", f"<p style='display:none'>{sentence(30)}</p>"]
    rng.shuffle(before)
    rng.shuffle(after)
    shell = rng.choice(["<article>{}</article>", "<main><div>{}</div></main>", "<div class='has-sidebar'><article class=post>{}</article></div>", "<div class=wrap><div role=main>{}</div></div>"])
    page = f"<html><head><title>{sentence(4)}</title></head><body>" + "".join(before[: rng.randrange(7)]) + shell.format(body) + "".join(after[: rng.randrange(7)])
    return page, "\n".join(" ".join(b.split()) for b in blocks)


def test_made_pages():
    rng = random.Random(11)
    for _ in range(300):
        page, want = made_page(rng)
        assert extract(page) == want, page


@pytest.mark.parametrize(
    "page",
    ["<a " * 1_700_000, '<a href="' * 500_000, "<a \"'>x" * 300_000, "<div>x" * 100_000, "<p><div>x" * 100_000,
     "<ul>" + "<div>" * 20_000 + "<li>y</li>" * 20_000, "<script>" * 300_000, "<!--" * 500_000, "<b>" * 100_000 + LONG],
    ids=["open", "quotes", "mixed", "deep", "paragraphs", "lists", "scripts", "comments", "inline"],
)
def test_time_grows_with_the_length_alone(page):
    begin = time.time()
    extract(page)
    assert time.time() - begin < 30


def test_rows(spark):
    page = f"<article><p>{L}</p></article>"
    rows = [(1, page, "mine", 5), (1, page, "mine", 5), (2, None, "x", 6), (None, "<p>" + "w " * 600_000 + "</p>", "y", 7)]
    df = spark.createDataFrame(rows, "page_id long, html string, c0 string, n_chars int")
    got = main_text(df)
    assert got.columns == ["page_id", "c0", "text", "n_chars"]
    assert sorted((r["page_id"] or 9, r["c0"], r["n_chars"]) for r in got.collect()) == [
        (1, "mine", len(L)), (1, "mine", len(L)), (2, "x", 0), (9, "y", 1_199_999)
    ]
    assert main_text(df.limit(0)).count() == 0
