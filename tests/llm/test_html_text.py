import itertools

import numpy as np
import pytest

from tessella.llm import html_text as H


@pytest.fixture(scope="module")
def model():
    return H.fit(H.labelled_pages())


def text(model, html):
    forest = H.Forest()
    forest.add(html)
    p, _ = H.Tree(forest).marginals(*model)
    return "\n\n".join(t for _, n, t in forest.leaves if p[n] >= 0.5)


def test_messages_match_all_assignments():
    """Marginals of a small tree against the sum over all assignments."""
    forest = H.Forest()
    forest.add("<div class=ad><p>One two.</p>three<ul><li><a>x</a></ul></div><p>four")
    tree, r = H.Tree(forest), np.random.default_rng(1)
    w, pair = r.normal(size=H.N_FEATURES), r.normal(size=(H.N_KINDS, 2, 2))
    n = len(forest.parent)
    assert n == 10
    u = np.bincount(tree.node, w[tree.feature], n)
    total, on, both = 0.0, np.zeros(n), np.zeros((n, 2, 2))
    for y in itertools.product((0, 1), repeat=n):
        e = np.exp(sum(u[i] * y[i] for i in range(n)) + sum(pair[forest.kind[i], y[forest.parent[i]], y[i]] for i in range(1, n)))
        total += e
        on += e * np.array(y)
        for i in range(1, n):
            both[i, y[forest.parent[i]], y[i]] += e
    p, found = tree.marginals(w, pair)
    assert np.allclose(p, on / total)
    assert np.allclose(found[1:], both[1:] / total)


def test_held_out_pages(model):
    right = total = 0
    for html, label in H.labelled_pages(80, seed=99):
        forest = H.Forest()
        forest.add(html)
        p, _ = H.Tree(forest).marginals(*model)
        assert len(forest.leaves) == len(label)
        right += sum((p[n] >= 0.5) == y for (_, n, _), y in zip(forest.leaves, label, strict=True))
        total += len(label)
    assert right / total > 0.99


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>"; a<b;</script></head><body>
<nav><ul><li><a href="/a">Menu one</a></li><li><a href="/b">two</a></ul></nav><!-- ad <p>x</p> -->
<div class="ad">Buy this now.</div><article><h1>Title &amp; more</h1><p><b>First   para&nbsp;graph,\n with breaks.<br><p>Second one &lt;b&gt; caf&eacute;.</p>
<p>Third <a href=x>link</a> one.</article><form><label>Mail</label></form><footer>&copy; site</footer></body></html>"""


def test_page(model):
    assert text(model, PAGE) == "Title & more\n\nFirst para graph, with breaks.\n\nSecond one <b> café.\n\nThird link one."


@pytest.mark.parametrize("html", ["", "   ", "<", "<p", "</p></div>", "<script>never closed", "<!-- open", "<p class='x>y", "&am", "<a \"" * 50, "<div>" * 3000 + "deep"])
def test_broken_pages(model, html):
    assert isinstance(text(model, html), str)


def test_tables(spark):
    df = spark.createDataFrame([(1, "u", PAGE, 5), (2, None, None, 6), (1, "u", PAGE, 5), (3, "v", "", 7)], "page_id long, url string, html string, n_chars int")
    got = H.extract(df)
    assert got.columns == ["page_id", "url", "n_chars", "text"]
    rows = sorted((r.page_id, r.text[:12]) for r in got.collect())
    assert rows == [(1, "Title & more"), (1, "Title & more"), (2, ""), (3, "")]
    assert H.extract(df.limit(0)).count() == 0


def test_every_article_of_the_tables(spark, model):
    """Pages of the given tables against their only <article>, by plain patterns."""
    import re
    from html import unescape

    got = {r.page_id: r.text for r in H.extract(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"), model).collect()}
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        article = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        blocks = [" ".join(unescape(re.sub("<br>", " ", re.sub("</?b>", "", x))).split()) for x in re.split("</?p>|</?h1>", article)]
        assert got[r.page_id] == "\n\n".join(b for b in blocks if b)


ARTICLE = "<p>The first long sentence of the article, with words.</p>{}<p>The second long sentence of it, with more words.</p>"


@pytest.mark.parametrize("odd", ['<svg class="i"/>', "<video src=x>", "<div><canvas></div>", "<svg><svg><path d=x /></svg><text>drawn</text></svg>", "<template><p>not shown</p></template>", "<audio><video></audio>", "<select><option>not shown</select>"])
@pytest.mark.parametrize("page", ["<body>{}<article>" + ARTICLE.format("") + "</article></body>", "<body><article>" + ARTICLE + "</article></body>"])
def test_hidden_elements_take_only_their_own_text(page, odd):
    forest = H.Forest()
    forest.add(page.format(odd))
    assert [t for _, _, t in forest.leaves] == ["The first long sentence of the article, with words.", "The second long sentence of it, with more words."]


def test_formulas_are_text_of_their_sentence():
    forest = H.Forest()
    forest.add("<p>So <math><semantics><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow><annotation>x=2</annotation></semantics></math> holds.</p>")
    assert [t for _, _, t in forest.leaves] == ["So x=2 holds."]


def test_many_unclosed_elements_are_read_once():
    forest = H.Forest()
    forest.add("<svg>" * 20_000 + "<p>All the same.</p>")
    assert [t for _, _, t in forest.leaves] == ["All the same."]


@pytest.mark.parametrize("odd", ["<!-->", "<!--->", "<!-- a > b -->", "<!-- x --!>", "<!doctype x>", "<?php x ?>", "<iframe src=x />", "<iframe src=x>", "<noscript>", "<!---->"])
def test_comments_and_unclosed_elements_lose_no_text(odd):
    forest = H.Forest()
    forest.add(f"<body><article>{ARTICLE.format(odd)}</article></body>")
    assert [t for _, _, t in forest.leaves] == ["The first long sentence of the article, with words.", "The second long sentence of it, with more words."]


def other_pages(n, seed):
    """Pages of another make than the model's own: tables or nested boxes for columns, names that say nothing."""
    import random

    r = random.Random(seed)
    out = []
    for _ in range(n):
        word = lambda: "".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4)))
        sentence = lambda a, b: " ".join([word().title(), *[word() for _ in range(r.randint(a, b))]]) + r.choice([".", ".", "!", "?"])
        box = lambda x: f'<div class="{r.getrandbits(24):x}">{x}</div>'
        leaf = lambda y, x: (f"<p>{x}</p>", [y])

        def join(*parts):
            return "".join(h for h, _ in parts), [y for _, ys in parts for y in ys]

        def menu():
            k = r.randint(3, 9)
            return "".join(f"<li><a href='#'>{word()} {word()}</a>" for _ in range(k)), [0] * k

        html, y = menu()
        nav = (f"<ul>{html}</ul>", y)
        main = join(*[leaf(1, " ".join(sentence(6, 18) for _ in range(r.randint(2, 6)))) for _ in range(r.randint(3, 9))])
        html, y = menu()
        side = (f"<h4>{word()}</h4><ul>{html}</ul>", [0, *y])
        foot = (f"<small>&copy; {word()} {word()}</small>", [0])
        boxed = [(box(h), y) for h, y in (nav, (box(main[0]), main[1]), side, foot)]
        out.append(join(*boxed))
    return out


def test_pages_of_another_make(model):
    """Names say nothing here, so structure and looks must tell."""
    right = total = 0
    for html, label in other_pages(120, 5):
        forest = H.Forest()
        forest.add(f"<html><body>{html}</body></html>")
        assert len(forest.leaves) == len(label)
        p, _ = H.Tree(forest).marginals(*model)
        right += sum((p[n] >= 0.5) == y for (_, n, _), y in zip(forest.leaves, label, strict=True))
        total += len(label)
    print("right:", right / total)
    assert right / total > 0.97


def test_clashing_names_stay(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "own")], "page_id long, url string, html string, text string")
    got = H.extract(df)
    assert got.columns == ["page_id", "url", "text", "text_"] and got.first()["text"] == "own"


def test_a_very_long_page_is_read_whole(model):
    long = "<p>" + "</p><p>".join(f"Sentence number {i} of a long article, which goes on and on." for i in range(60_000)) + "</p>"
    assert text(model, f"<html><body><article>{long}</article></body></html>").count("\n\n") == 59_999
