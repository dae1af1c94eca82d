import html
import re
import time

import numpy as np
import pytest

from pixelweave.llm import html_blocks, queries


def article(page):
    """Text of the article element of the made tables' pages, whose blocks are h1 and p."""
    inner = re.search(r"<article>(.*?)(?:</article>|$)", page, re.S)[1]
    blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner))
    return "\n\n".join(b for b in blocks if b)


@pytest.fixture(scope="module")
def network(spark):
    return html_blocks.train(html_blocks.sample(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")))


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.page_id: r for r in queries.op5_main_text(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.page_id].text == article(r.html) and got[r.page_id].n_chars == len(article(r.html)) and got[r.page_id].url == r.url


def test_unseen_made_pages(network):
    rng = np.random.default_rng(77)
    sentences = ["The river rose in the night, and the old bridge was closed.", "Prices fell again.", "Nobody could say who had written the letter to the mayor."]
    pages = [html_blocks.made_page(rng, sentences) for _ in range(200)]
    got = html_blocks.extract(network, [p for p, _ in pages])
    assert sum(g == "\n\n".join(c) for g, (_, c) in zip(got, pages, strict=True)) >= 186


def test_leaves():
    page = "x<!-- <p>no</p> --><p>a <b>b</b>&amp;\n c<br>d<p>e<script>var t='</p>';</script><ul><li>f<li>g</ul><div class='Ad-Box x' id=\"m\">h<style>p{}</style></div>tail &lt;p&gt; <a href='>'>l</a><unknown>y</unknown></p><p"
    got = html_blocks.leaves(page)
    assert [x.text for x in got] == ["x", "a b& c d", "e", "f", "g", "h", "tail <p> ly", "<p"]
    assert got[5].path == ("div", "div.ad", "div.box", "div.x", "div.m") and got[3].path == ("ul", "li")
    assert html_blocks.leaves("") == [] and html_blocks.leaves("<script>never closed <p>x") == []


def test_gradients():
    net = html_blocks.BiLstm(3, dims=5, hidden=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    x, mask = html_blocks.pad([rng.standard_normal((4, 5)), rng.standard_normal((2, 5))])
    x = x.astype(np.float64)
    target = rng.integers(0, 2, mask.shape).astype(float)
    g, _ = net.gradients(x, mask, target)
    for name, v in net.p.items():
        flat = v.reshape(-1)
        for k in range(0, len(flat), max(1, len(flat) // 5)):
            old, step = flat[k], 1e-4
            flat[k] = old + step
            up = net.gradients(x, mask, target)[1]
            flat[k] = old - step
            down = net.gradients(x, mask, target)[1]
            flat[k] = old
            assert (up - down) / (2 * step) == pytest.approx(g[name].reshape(-1)[k], abs=2e-3)


def test_odd_rows(spark, network):
    rows = [(1, "u", None), (2, None, ""), (2, None, ""), (3, "u", "no tags at all"), (4, "u", "<article><p>" + "long words here. " * 20_000 + "</p></article>"), (None, "u", "<article><h1>T</h1></article>"), (5, "u", "&#0;&#xD800;<p>&nbsp;</p><<>><p")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, text string, n_chars string")
    got = html_blocks.main_text(df, network).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert {r.page_id: r.text for r in got}[1] == ""
    assert {r.page_id: r.n_chars for r in got}[4] == len("long words here. " * 20_000) - 1
    assert html_blocks.main_text(df.limit(0)).count() == 0


def test_elements_without_text_end_where_they_end():
    texts = lambda page: [x.text for x in html_blocks.leaves(page)]
    article = "<article><p>a</p><p>b</p></article>"
    for icon in ('<svg class="i"/>', "<SVG viewBox='0 0 > 1'\n/>", "<svg/>", "<svg class=i>", "<math/>", "<video src='v'>", "<audio src=v>", "<canvas id=c>", "<object data='o'/>", "<object data='o'>"):
        assert texts(f"<header>h{icon}</header>{article}") == ["h", "a", "b"], icon
        assert texts(f"<header>h{icon}</header>{article}<svg><title>t</title></svg><video>no</video><object>no</object><p>c") == ["h", "a", "b", "c"], icon
    for closed in ("<svg><svg>no</svg>no<style/></svg>", "<svg><style>p{} </svg></style><text>no</text></svg>", "<svg><!-- </svg> --><svg/>no</svg>", "<object>no<object>no</object>no</object>", "<video>no <a href='x'>no</a></VIDEO >", "<canvas>no</canvas>"):
        assert texts(f"x{closed}y<p>z") == ["xy", "z"], closed
    assert texts("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds") == ["so x=2 holds"]
    assert texts("<p>a<iframe src='x'>no<p>no") == ["a"]
    assert len(texts("<p>a<video>" * 20_000)) == 20_000


def slow_tokens(page):
    """A tokenizer of one character at a time, written from the states of the standard: (kind, text) with kind "text" or a tag's name."""
    out, text, i, n = [], "", 0, len(page)

    def tag(j, quotes):
        """(name, attributes, place after the tag) or None."""
        name, attributes, state, key, value, quote = "", [], "name", "", "", ""
        while j < n:
            c = page[j]
            j += 1
            space = c.isspace()
            if state == "name":
                if c == ">":
                    return name.lower(), attributes, j
                if space or c == "/":
                    state = "gap"
                else:
                    name += c
            elif state == "gap":
                if c == ">":
                    return name.lower(), attributes, j
                if not (space or c == "/"):
                    key, value, state = c, "", "key"
            elif state in ("key", "after"):
                if c == "=":
                    state = "value"
                elif c == ">" or c == "/" or (state == "after" and not space):
                    attributes.append((key.lower(), ""))
                    if c == ">":
                        return name.lower(), attributes, j
                    key, state = c, "gap" if c == "/" else "key"
                elif space:
                    state = "after"
                else:
                    key += c
            elif state == "value":
                if c == ">":
                    attributes.append((key.lower(), ""))
                    return name.lower(), attributes, j
                if quotes and c in "\"'":
                    quote, state = c, "quoted"
                elif not space:
                    value, state = c, "unquoted"
            elif state == "quoted":
                if c == quote:
                    attributes.append((key.lower(), value))
                    state = "gap"
                else:
                    value += c
            elif state == "unquoted":
                if c == ">" or space:
                    attributes.append((key.lower(), value))
                    if c == ">":
                        return name.lower(), attributes, j
                    state = "gap"
                else:
                    value += c
        return None

    quotes = True
    while i < n:
        closing = page[i + 1 : i + 2] == "/"
        begin = i + 1 + closing
        if page[i] != "<" or not (page[begin : begin + 1].isascii() and page[begin : begin + 1].isalpha()):
            text += page[i]
            i += 1
            continue
        found = tag(begin, quotes)
        if found is None and quotes:
            quotes = False
            found = tag(begin, False)
        if found is None:
            text += page[i:]
            break
        if text:
            out.append(("text", text))
        text = ""
        out.append((closing, found[0], tuple(found[1])))
        i = found[2]
    return out + ([("text", text)] if text else [])


def test_tokens_against_a_slow_tokenizer():
    rng = np.random.default_rng(12)
    parts = ["<p", "<b ", "</p", "</i >", ">", ">", " ", "\n", "=", "/", '"', "'", "a", "class", "id=x", "title='", 'x="y"', "<", "é", "=>", "/>", "one two", "='a b'", "<1", "</>"]
    for _ in range(4000):
        page = "".join(parts[k] for k in rng.integers(0, len(parts), rng.integers(1, 30)))
        got, at = [], 0
        for t in html_blocks.tokens(page):
            got += [("text", page[at : t.start])] * (t.start > at) + [(t.closing, t.name, t.attributes)]
            at = t.end
        got += [("text", page[at:])] * (at < len(page))
        assert got == slow_tokens(page), page


def test_stray_quotes_and_unclosed_elements():
    texts = lambda page: [x.text for x in html_blocks.leaves(page)]
    assert texts("<p title=it's>one two three</p><p>don't stop</p><p>four</p>") == ["one two three", "don't stop", "four"]
    assert texts('<p class="a"">one</p><p class=a"b>two</p>') == ["one", "two"]
    assert texts("<p>a<noscript>b<p>c") == ["ab", "c"] and texts("<p>a<template>b<p>c") == ["ab", "c"]
    assert texts("a<noscript>no<p>no</noscript>b<template>no<template>no</template>no</template>c") == ["abc"]
    assert texts("<p title='never closed>one</p><p>two</p>") == ["one", "two"]
    assert texts("<script>a</script ><p>b<script>c</script x") == ["b"]


@pytest.mark.parametrize("part", ['<b "', "<a x='", "<a x=\"'", "<a x='b'", "<div>x", "<div>x</section>", "<svg><video>", "</script ", "<script></script ", "<!--", "<![CDATA[", "<!x", "<", "&lt;<p", "<template>x", "<li><td>x"])
def test_a_megabyte_of_anything_takes_linear_time(part):
    page = "<p title='a>x" + part * (1_000_000 // len(part))
    start = time.process_time()
    html_blocks.leaves(page)
    assert time.process_time() - start < 12


def test_sample_of_pages_without_ids(spark):
    rows = spark.range(1000).selectExpr("cast(null as long) page_id", "concat('<p>', id) html")
    assert len(html_blocks.sample(rows, 50)) == 50
    assert len(html_blocks.sample(spark.range(1000).selectExpr("7 page_id", "'<p>same' html"), 50)) == 50
