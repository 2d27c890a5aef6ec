"""URL filters, chat formatting, HTML text, top-k and word BPE."""

import hashlib
import html
import math
import os
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.llm import bpe, chat, htmltext, topk, urlfilter

# URL filters

URLS = ["http://A.Example.net/en/x?y#z", "https://example.net/en", "http://b.example.com/de/1", "http://x.org/fr/", "http://x.org#a/fr/", "ftp://net/", "http://net", "http://notnet/", "nothing", "", None, "x://y://z.net/q", "http://u:p@HOST.net:80/p?q", "http://casino-win.com/", "http://docs.python.org/3/", "http://a.org\n/fr/"]


def plain_host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    path = rest[cut:]
    end = min([path.find(c) for c in "?#" if c in path] or [len(path)])
    return rest[:cut].translate(str.maketrans(urlfilter.UPPER, urlfilter.LOWER)), path[:end]


def test_urls(spark):
    df = spark.createDataFrame([(i, u, "r") for i, u in enumerate(URLS)], "page_id long, url string, rule string")
    intercept, weights = urlfilter.trained()
    for r in urlfilter.judge(df).collect():
        host, path = plain_host_path(r["url"])
        fits = [x for x in urlfilter.RULES if (host == x.pattern.split("/")[0] or host.endswith("." + x.pattern.split("/")[0])) and path.startswith("/" + x.pattern.split("/", 1)[1])]
        rule = max(fits, key=lambda x: len(x.pattern), default=None)
        text = f"^{host}{path}$"
        score = intercept + sum(weights[urlfilter.bucket(text[j : j + n])] for n in urlfilter.GRAMS for j in range(len(text) - n + 1))
        assert (r["host"], r["path"], r["rule"], r["model_score"]) == (host, path, rule.pattern if rule else None, score)
        assert r["verdict"] == (rule.verdict if rule else "block" if score > 0 else "allow")


def test_url_model_separates_its_table():
    intercept, weights = urlfilter.trained()
    right = 0
    rows = urlfilter.labelled_urls()
    for host, path, label in rows:
        text = f"^{host}{path}$"
        right += (intercept + sum(weights[urlfilter.bucket(text[j : j + n])] for n in urlfilter.GRAMS for j in range(len(text) - n + 1)) > 0) == label
    assert right / len(rows) > 0.98


def test_url_model_on_held_out_urls():
    """Each fifth of the table judged by a model of the other four; an empty url is allowed."""
    rows, right = urlfilter.labelled_urls(), 0
    for fold in range(5):
        intercept, weights = urlfilter.fitted([r for i, r in enumerate(rows) if i % 5 != fold])
        assert intercept < 0
        for host, path, label in rows[fold::5]:
            text = f"^{host}{path}$"
            right += (intercept + sum(weights[urlfilter.bucket(text[j : j + n])] for n in urlfilter.GRAMS for j in range(len(text) - n + 1)) > 0) == label
    assert right / len(rows) > 0.9


def test_odd_urls(spark):
    """Very long urls, repeated rows, and columns with the names that the filter uses itself."""
    long = "http://a.example.net/en/" + "x" * 50000
    df = spark.createDataFrame([(1, long, "c", "r"), (1, long, "c", "r"), (2, "http://a.org/fr/", "d", "s")], "page_id long, url string, _codes string, _rule string")
    got = sorted((r["page_id"], r["_codes"], r["_rule"], r["rule"], len(r["path"])) for r in urlfilter.judge(df).collect())
    assert got == [(1, "c", "r", "example.net/en/", 50004)] * 2 + [(2, "d", "s", "org/fr/", 4)]


def test_urls_of_nothing(spark):
    assert urlfilter.judge(spark.createDataFrame([], "page_id long, url string, __url_codes string")).collect() == []


# Chat formatting


@given(st.text(), st.text())
@settings(max_examples=300, deadline=None, derandomize=True)
def test_segments_read_back(role, text):
    assert chat.read_segment(chat.segment(role, text)[0]) == (role, text)


@given(st.lists(st.sampled_from([*chat.CONTROL, "\\", "a", "\n", "[", "INST]", "<|im", "_end|>"]), max_size=12))
@settings(max_examples=300, deadline=None, derandomize=True)
def test_no_control_string_is_left(parts):
    out = chat.escape("".join(parts))
    assert not any(c in out for c in chat.CONTROL) and chat.unescape(out) == "".join(parts)


def test_conversations(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "</s> ok \\ [INST]"), (2, 1, "assistant", None), (2, 0, None, "q\nr"), (2, None, "system", "s"), (3, 0, "user", ""), (3, 0, "user", ""), (None, 5, "assistant", "x" * 70000)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, position string")
    formatted = chat.format_turns(chat.canonical_turns(df))
    got = {r["conv_id"]: r for r in chat.digests(formatted).collect()}
    for conv in (1, 2, 3, None):
        own = sorted([((t is not None, t), r or "", x or "") for c, t, r, x in rows if c == conv])
        learned = "".join(x for _, r, x in own if r == "assistant")
        r = got[conv]
        assert r["n_turns"] == len(own) and r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in own).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
        assert r["formatted_chars"] == sum(len(chat.segment(a, b)[0]) for _, a, b in own)
    assert chat.digests(chat.format_turns(df.limit(0))).collect() == []


@pytest.mark.parametrize(
    ("record", "turns"),
    [
        ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}], "id": 3}, [("user", "a"), ("assistant", "b")]),
        ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": None}]}, [("user", "a"), ("assistant", "")]),
        ({"prompt": "p", "completion": "c"}, [("user", "p"), ("assistant", "c")]),
        ({"instruction": "i", "input": "x", "output": "o"}, [("user", "i\n\nx"), ("assistant", "o")]),
        ({"instruction": "i", "output": "o", "system": "s"}, [("system", "s"), ("user", "i"), ("assistant", "o")]),
        ({"question": "q", "answer": {"a": 1}, "meta": 5}, None),
    ],
)
def test_layouts(record, turns):
    if turns is None:
        with pytest.raises(ValueError):
            chat.record_turns(record)
    else:
        assert chat.record_turns(record) == turns


def test_layouts_of_dataframes(spark):
    df = spark.createDataFrame([(7, [("human", "a"), ("gpt", "b")])], "id long, conversations array<struct<from:string,value:string>>")
    assert [tuple(r) for r in chat.canonical_turns(df, "id").orderBy("turn").collect()] == [(7, 0, "user", "a"), (7, 1, "assistant", "b")]
    df = spark.createDataFrame([(7, "p", "c")], "conv_id long, prompt string, completion string")
    assert [tuple(r) for r in chat.canonical_turns(df).orderBy("turn").collect()] == [(7, 0, "user", "p"), (7, 1, "assistant", "c")]
    assert chat.fingerprint(["b", "a"]) == chat.fingerprint(["a", "b"]) != chat.fingerprint(["a"])


# HTML text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>x</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav><div class="cookie-notice">We use cookies, please accept them all now</div>
<article><h1>Title &amp; more</h1><p>First   paragraph of the <b>text</b> with&nbsp;words.<br>Same block.</p><!-- no --><p>Short.</p>
<div class="ad">Buy now</div><ul><li>item one</li><li>item two</li></ul><p>Last &lt;one&gt; is a long paragraph of ordinary words again.</p>
<section class="comments"><p>First! I am a reader with an opinion about this text.</p></section></article>
<aside>Related things to read</aside><form><label>Mail</label><input></form><footer>&copy; all rights</footer></body></html>"""
TEXT = "Title & more\nFirst paragraph of the text with words. Same block.\nShort.\nitem one\nitem two\nLast <one> is a long paragraph of ordinary words again."


def test_page():
    assert htmltext.main_text(PAGE) == TEXT
    assert htmltext.main_text(PAGE.replace("article>", "main>").replace("<article", "<main")) == TEXT


def test_page_without_regions():
    page = PAGE.replace("<article>", '<div class="content">').replace("</article>", "</div>")
    assert "Last <one> is" in htmltext.main_text(page) and "cookies" not in htmltext.main_text(page) and "Home" not in htmltext.main_text(page)


@pytest.mark.parametrize("cut", range(0, len(PAGE), 37))
def test_cut_pages_do_not_fail(cut):
    assert isinstance(htmltext.main_text(PAGE[:cut]), str)


@given(st.text(alphabet="<>/!-&;#abp \n\"='"))
@settings(max_examples=200, deadline=None, derandomize=True)
def test_any_markup(page):
    assert isinstance(htmltext.main_text(page), str)


def test_smoothing_keeps_constants():
    assert np.allclose(htmltext.smoothed(np.full(9, 3.0)), 3) and len(htmltext.smoothed(np.ones(1))) == 1


def test_pages(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "t", 5), (2, "v", None, "t", 6), (3, None, "", "t", 7), (3, None, "<p>" + "x " * 100000, "t", 7)], "page_id long, url string, html string, text string, n_chars long")
    got = sorted((r["page_id"], r["n_chars"], r["text"][:20]) for r in htmltext.extract(df).collect())
    assert got == [(1, len(TEXT), TEXT[:20]), (2, 0, ""), (3, 0, ""), (3, 199999, "x " * 10)]
    assert htmltext.extract(df.limit(0)).collect() == []


# Top-k


def brute(rows, asks, k=5, scale=256):
    """Row by row: each row is a query of its own, and all other rows are its candidates."""
    good = [(i, [math.floor(Fraction(float(np.float32(x))) * scale) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (q, asked) in enumerate(good):
        if asks(q):
            scored = [(sum(a * b for a, b in zip(asked, v, strict=False)), c) for i, (c, v) in enumerate(good) if i != at]
            out += [(q, r, c, max(topk.FIRST, min(topk.LAST, s))) for r, (s, c) in enumerate(sorted(scored, key=lambda x: (-x[0], x[1]))[:k], 1)]
    return sorted(out)


SMALL = [(i, np.random.default_rng(i).normal(0, 0.3, 6).round(2).tolist()) for i in range(90)]
SMALL += [(200 + i, [0.5, 0.5, 0.0, 0.0, 0.1, 0.0]) for i in range(30)]
SMALL += [(300, None), (305, [0.1, None]), (310, [float("nan"), 1.0]), (315, [float("inf")]), (320, []), (325, [0.25, -0.25]), (None, [1.0])]
#: Ids that repeat: with other vectors, with the same, and many times.
REPEATED = [(10, SMALL[3][1]), (12, SMALL[12][1]), (15, SMALL[15][1]), (15, SMALL[15][1]), *[(25, [2.0, 2.0])] * 7, *[(7, [0.1 * i, 0.1]) for i in range(9)]]
#: Components beyond 2^26, 2^53 and 2^63 when scaled.
LARGE = [(400, [1e7, 3e5]), (401, [1e7, 0.0]), (405, [3e5, 3e5]), (406, [262144.0, 262143.0]), (410, [1e16, 1.0]), (415, [1e30, -1e30]), (416, [-1e30, 1e30]), (417, [1e30, 1.0]), (418, [3e38, -3e38])]


@pytest.mark.parametrize("blocks", [(4096, 1024), (7, 3)])
@pytest.mark.parametrize("extra", [[], REPEATED, LARGE, REPEATED + LARGE])
def test_top_k(spark, monkeypatch, blocks, extra):
    monkeypatch.setattr(topk, "CANDIDATES", blocks[0])
    monkeypatch.setattr(topk, "QUERIES", blocks[1])
    rows = SMALL + extra
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    got = sorted(tuple(r) for r in topk.top_k(df, df.where("vec_id % 5 = 0")).collect())
    assert got == brute(rows, lambda q: q % 5 == 0)


def test_top_k_against_sql_with_repeated_ids(spark):
    import duckdb
    import pandas as pd

    rows = [(i, v) for i, v in [*SMALL, *((50, v) for _, v in SMALL[:9]), *((50, SMALL[50][1]) for _ in range(3)), (100, [1e7, 3e5])] if i is not None and v and len(v) == 6]
    con = duckdb.connect()
    con.register("embeddings", pd.DataFrame(rows, columns=["vec_id", "embedding"]))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in topk.top_k(df, df.where("vec_id % 50 = 0")).collect()) == sorted(con.execute(topk.ORACLE).fetchall())


@given(st.lists(st.integers(-(10**60), 10**60), min_size=2, max_size=9))
@settings(max_examples=200, deadline=None, derandomize=True)
def test_sortable(numbers):
    assert sorted(numbers) == sorted(numbers, key=topk.sortable)


def test_top_k_of_blocks_with_the_same_ids(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 4)
    rows = [(7, [0.1, 0.1])] * 4 + [(7, [0.5, 0.5])] * 4 + [(7, [2.0, 2.0])] * 4
    candidates = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)
    queries = spark.createDataFrame([(5, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in topk.top_k(candidates, queries).collect()) == [(5, 1 + i, 7, 2 * 512 * 256 if i < 4 else 2 * 128 * 256) for i in range(5)]


def test_top_k_of_nothing(spark):
    df = spark.createDataFrame([(5, [1.0])], "vec_id long, embedding array<float>")
    assert topk.top_k(df, df).collect() == [] and topk.top_k(df.limit(0), df).collect() == [] and topk.top_k(df, df.limit(0)).collect() == []


# Word BPE

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


def same(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    model = bpe.loaded(PATH)
    assert model.encode(text) == ids and model.decode(ids) == library.decode(ids, skip_special_tokens=False)


@given(st.text())
@settings(max_examples=400, deadline=None, derandomize=True)
def test_any_text(text):
    same(tokenizers_file(), text)


@given(st.text(alphabet="abcdefghinorstu'  .!1é"))
@settings(max_examples=400, deadline=None, derandomize=True)
def test_likely_texts(text):
    same(tokenizers_file(), text)


def tokenizers_file(_cache=[]):  # noqa: B006
    if not _cache:
        _cache.append(tokenizers.Tokenizer.from_file(PATH))
    return _cache[0]


@pytest.mark.parametrize("text", ["", "Hello World!!!", "<|endoftext|>", "a<|startoftext|> b <|endoftext|>", "don't I'll we've", "ΟΔΟΣ ΣΑΣ", "e\u0301 é", "123 4.5", "😀😀 नमस्ते", "a\x1cb\u0085c\u3000d", "antidisestablishmentarianism" * 3, "İ I ı", "ﬁ ½ ²"])
def test_texts(library, text):
    same(library, text)


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "WORDS", 3)
    monkeypatch.setattr(bpe, "PAIRS", 5)
    same(library, "the quick brown foxes jumped over lazy dogs again and again " * 5)


def test_tokens_of_odd_rows(spark, odd, nothing, library):
    from .conftest import ROWS

    got = bpe.tokenize(odd, PATH).collect()
    expected = [library.encode(t or "", add_special_tokens=False).ids for _, t in ROWS]
    assert sorted(r["token_ids"] for r in got) == sorted(expected) and all(r["n_tokens"] == len(r["token_ids"]) for r in got)
    digests = sorted((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.tokenize(odd, PATH, digest=True).collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert digests == sorted((len(i), sha(" ".join(map(str, i))), sha(library.decode(i, skip_special_tokens=False))) for i in expected)
    assert bpe.tokenize(nothing, PATH).collect() == []


# The registered queries


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
@pytest.mark.parametrize("name", ["op2_substring_dedup", "op3_url_filter", "op4_chat_format", "op6_jaccard_join", "op9_top_k"])
def test_against_sql(spark, name):
    import duckdb

    from marlstone.llm import queries

    con = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    cursor = con.execute(queries.oracles()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(repr([r[c] for c in sorted(names)]) for r in df.collect()) == sorted(repr([r[names.index(c)] for c in sorted(names)]) for r in cursor.fetchall())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_pages_against_a_pattern(spark):
    """In these tables the article element holds the main text and nothing else."""
    import re

    import duckdb

    from marlstone.llm import queries

    block = re.compile(r"</?(?:p|h1|div|article|ul|li)\b[^>]*>")
    rows = {i: h for i, h in duckdb.sql("select page_id, html from '/root/testdata/sf0.001/pages.parquet'").fetchall()}
    for r in queries.QUERIES["op8_html_text"](spark, "/root/testdata/sf0.001").collect():
        inner = re.search(r"<article>(.*?)(?:</article>|$)", rows[r["page_id"]], re.DOTALL)[1]
        lines = [" ".join(html.unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split()) for x in block.split(inner)]
        assert r["text"] == "\n".join(x for x in lines if x) and r["n_chars"] == len(r["text"])
