"""Pages put together from parts whose main text is known."""

import html
import random

import pytest

from marlstone.llm.htmltext import main_text

LONG = "A long paragraph of ordinary words that goes on for a while, so that it stands out among what is around it."


def article(inner):
    return f"<html><body><nav><a href=/>Home</a></nav><article><p>{LONG}</p>{inner}</article><footer>f</footer></body></html>"


@pytest.mark.parametrize(
    ("inner", "text"),
    [
        ("<script>var x=1;</script><p>b</p>", "b"),
        ("<style>p{}</style><p>b</p>", "b"),
        ("<p>a <script>x()</script>b</p>", "a b"),
        ("<button>Subscribe</button><p>b</p>", "b"),
        ("<svg><title>t</title><text>g</text></svg><p>b</p>", "b"),
        ("<iframe>fallback</iframe><p>b</p>", "b"),
        ("<p>one <span class='ad'>Buy now</span>two</p>", "one two"),
        ("<p>one <a class=share href=x>Share</a>two</p>", "one two"),
        ("<select><option>x<option>y</select><p>b</p>", "b"),
        ("<h2 id='search'>Search trees</h2><p>b</p>", "Search trees\nb"),
        ("<h2 id='related-work'>Related work</h2>", "Related work"),
        ("<section id='related-work'><p>b</p></section>", "b"),
        ("<div class='entry-header'><h1>Title</h1></div>", "Title"),
        ("<header class='entry-header'><h1>Title</h1></header>", "Title"),
        ("<header><h1>Title</h1><div class='share-buttons'>tweet</div></header>", "Title"),
        ("<p><a href=x>A paragraph that is one link</a></p>", "A paragraph that is one link"),
        ("<p><a href=x><b>Bold</b> link</a></p>", "Bold link"),
        ("<ul><li><a>one</a></li><li><a>two</a></li></ul>", "one\ntwo"),
        ("<table><tr><td>1<td>2</table>", "1\n2"),
        ("<blockquote>q</blockquote><pre>a\n  b</pre>", "q\na b"),
        ("<p hidden>no</p><p style='display: none'>no</p><p aria-hidden=true>no</p><p>b</p>", "b"),
        ("<div role='navigation'>no</div><div role='note'>b</div>", "b"),
        ("<div class='cookieNotice'>no</div><div id='comments'>no</div><div class='comment-list'>no</div><div id=comment-17>no</div>", ""),
        ("<aside>no</aside><form>no</form><footer>no</footer><nav>no</nav><menu>no</menu><dialog>no</dialog>", ""),
        ("<p>x &amp; y &lt;b&gt; &#x41;&#66; &nbsp; z</p>", "x & y <b> AB z"),
        ("<p>a<br>b<p>c", "a b\nc"),
        ("<math><mi>x</mi></math>", "x"),
        ("<div class='post-comments'>no</div><div class='shared-memory'>b</div>", "b"),
        ("<section class='with-sidebar'><p>b</p></section>", "b"),
        ("</div><p>b</p></span>", "b"),
    ],
)
def test_inside_an_article(inner, text):
    assert main_text(article(inner)) == "\n".join(x for x in (LONG, text) if x)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<body><div><p>{LONG}</p><div><p>Short.</p></div><p><a>a link</a></p></div><ul><li><a>Home</a><li><a>News</a></ul>", f"{LONG}\nShort.\na link"),
        (f"<body><p>{LONG}</p><p><a>a</a> <a>b</a></p><p>Short.</p>", f"{LONG}\nShort."),
        (f"<nav><ul><li>Home<article><p>{LONG}</p></article>", LONG),
        (f"<aside><article><p>Teaser.</p></article></aside><article><p>{LONG}</p></article>", LONG),
        (f"<div class='page sidebar'><main><p>{LONG}</p></main></div>", LONG),
        (f"<body class='has-menu search'><main id='search'><p>{LONG}</p></main>", LONG),
        (f"<head><title>t</title><p>{LONG}", LONG),
        (f"<article><p>{LONG}</p></div><p>b</p></article>", f"{LONG}\nb"),
        ("one line", "one line"),
        ("<header class=site-header><h1>Site</h1></header><p>text</p>", "text"),
        ("<script>never closed", ""),
        ("<nav>only a menu</nav>", ""),
        ("  ", ""),
    ],
)
def test_pages(page, text):
    assert main_text(page) == text


WORDS = "river stone quiet lamp window seven after slowly green & under < market letter".split()
JUNK = [
    "<nav><ul><li><a href=/a>{}</a></li><li><a>{}</a></li></ul></nav>", "<div class='ad'>{}</div>", "<aside><h3>{}</h3><p>{}</p></aside>", "<script>var a = '{}';</script>", "<form><label>{}</label><button>{}</button></form>", "<div id='cookie-banner'><p>{}</p></div>",
    "<!-- {} -->", "<style>.x {{ content: '{}' }}</style>", "<div class='sponsored widget'>{}</div>", "<section class='comments'><p>{}</p><p>{}</p></section>", "<noscript>{}</noscript>", "<ul class='breadcrumbs'><li>{}</li></ul>",
]


@pytest.mark.parametrize("seed", range(150))
def test_composed_pages(seed):
    """Blocks of a known text in an article, a main or a plain element, with junk in and around it."""
    rng = random.Random(seed)
    words = lambda a, z: " ".join(rng.choice(WORDS) for _ in range(rng.randint(a, z)))
    junk = lambda: rng.choice(JUNK).format(words(2, 30).replace("<", "x").replace("&", "x"), words(2, 9).replace("<", "x").replace("&", "x"))
    blocks, expected = [], []
    for i in range(rng.randint(3, 9)):
        text = words(12, 60) if i == 0 or rng.random() < 0.7 else words(1, 3)
        tag = rng.choice(["p", "p", "p", "h2", "blockquote", "li", "div", "section"])
        if i == 0:
            tag = "p"
        cells = text.split(" ")
        if len(cells) > 3:
            at = rng.randrange(1, len(cells) - 1)
            inline = rng.choice(["b", "em", "a href='/x'", "code", "span class='name'"])
            shown = html.escape(" ".join(cells[:at])) + f" <{inline}>{html.escape(cells[at])}</{inline.split()[0]}>\n\t " + html.escape(" ".join(cells[at + 1 :]))
        else:
            shown = html.escape(text)
        inner = f"<{tag}>{shown}</{tag}>"
        blocks.append(f"<ul>{inner}</ul>" if tag == "li" else inner)
        expected.append(text)
        if rng.random() < 0.3:
            blocks.append(junk())
    around = rng.choice(["article", "main", "div class='story'", "article class='post related'"])
    body = f"<{around}>{''.join(blocks)}</{around.split()[0]}>"
    page = f"<!DOCTYPE html><html><head><title>t</title></head><body>{junk()}<header>{words(1, 3)}</header>{junk()}{body}{junk()}<footer>{words(3, 9)}</footer></body></html>"
    assert main_text(page) == "\n".join(expected)
