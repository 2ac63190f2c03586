import html
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest

from topicweir.llm.boosting import boost
from topicweir.llm.html_extract import Page, decode, extract, features, fit, lay_out, main_text


def test_given_pages_give_their_articles(spark, sf):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in extract(pages).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        article = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?p>|</?h1>", article))
        want = "\n".join(b for b in blocks if b)
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (want, len(want), r.url)


def test_unseen_arrangements():
    model = fit([], laid_out=250, seed=1)
    rng = random.Random(77)
    words = [f"lorem{i % 7} ipsum, dolor{i} sit." for i in range(60)]
    scores = []
    for _ in range(60):
        source, want = lay_out(rng, words)
        page = Page(source.replace(' data-component="x"', ""))
        got = main_text(page, decode([page], np.clip(model.margin(features([page])), -6, 6)))
        a, b = Counter(want.split()), Counter(got.split())
        scores.append(2 * sum((a & b).values()) / max(1, sum(a.values()) + sum(b.values())))
    assert np.mean(scores) > 0.9


def test_odd_pages(spark):
    rows = [
        (1, "u", None), (2, None, ""), (3, "u", "plain &amp; text"), (4, "u", "<article><p>a &lt; b<p>c\n\t d&nbsp;e<br>f</article>"),
        (5, "u", "<script>x"), (6, "u", "<!-- never closed <p>x</p>"), (7, "u", "<div><p>cut <foo"), (7, "u", "<a href='x>" * 50), (None, "u", "<p>z</p>"),
        (8, "u", "<div>" * 3000 + "deep"), (9, "u", "<article><p>" + "long word " * 30000 + "</p></article>"),
    ]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = extract(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    out = got.collect()
    assert len(out) == len(rows) and all(r.n_chars == len(r.text) for r in out)
    texts = {r.page_id: r.text for r in out}
    assert texts[1] == texts[2] == texts[5] == texts[6] == ""
    assert texts[9] == ("long word " * 30000).strip()
    assert extract(df.limit(0)).count() == 0


def test_blocks_of_a_page():
    page = Page("<article><p>a &lt; b<p>c\n\t d&nbsp;e<br>f<ul><li>x<li>y <b>z</ul><style>s</style><select><option>o</select></article> tail &am")
    assert [t for _, t, _ in page.blocks] == ["a < b", "c d e f", "x", "y z", "tail &am"]
    assert page.tag == ["#", "article", "p", "p", "ul", "li", "li"] and page.parent == [-1, 0, 1, 1, 1, 4, 4]


@pytest.mark.parametrize("seed", range(3))
def test_decoding_is_the_best_closed_set(seed):
    rng = np.random.default_rng(seed)
    page = Page("")
    for i in range(1, 9):
        page.tag.append("div"), page.parent.append(int(rng.integers(0, i)))
    score = rng.normal(size=9)
    keep = decode([page], score)
    total = lambda k: sum(s if x else -s for s, x in zip(score, k))
    closed = lambda k: k[0] and all(not k[i] or k[page.parent[i]] for i in range(1, 9))
    best = max((k for k in itertools.product([False, True], repeat=9) if closed(k)), key=total)
    assert closed(keep) and total(keep) == pytest.approx(total(best))


def test_boosting_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    model = boost(x[:1500], y[:1500])
    assert ((model.margin(x[1500:]) > 0) == y[1500:]).mean() > 0.93


@pytest.fixture(scope="module")
def given_trees(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    return fit([r.html for r in pages.orderBy("page_id").limit(200).collect()])


def kept(model, source):
    page = Page(source)
    return main_text(page, decode([page], np.clip(model.margin(features([page])), -6, 6)))


def test_all_parts_of_an_article_stay(given_trees):
    """Tables, captions, lists, code and headings, around paragraphs like those of the given pages."""
    text = "The council met on Monday, and it agreed on a plan for the old bridge. Work begins in May, the mayor said."
    parts = [
        ("<h1>{}</h1>", ["A plan for the bridge"]), ("<p>{}</p>", [text]), ("<h2>{}</h2>", ["What it costs"]),
        ("<table><tr><th>{}</th><th>{}</th></tr><tr><td>{}</td><td>{}</td></tr></table>", ["Year", "Cost", "2024", "1.5 million"]),
        ("<p>{}</p>", [text]), ("<figure><img src=b.png><figcaption>{}</figcaption></figure>", ["The bridge in 1950"]),
        ("<ul><li>{}</li><li>{}</li></ul>", ["New rails", "Lights on both sides"]), ("<pre><code>{}</code></pre>", ["length = 120"]),
        ("<p>{}</p>", [text]),
    ]
    body, want = "".join(p.format(*t) for p, t in parts), "\n".join(x for _, t in parts for x in t)
    menu = "<nav><ul><li><a href='/'>Home</a></li><li><a href='/a'>News</a></li></ul></nav>"
    foot = "<footer>&copy; 2024 The Paper</footer>"
    for frame in ("<article>{}</article>", '<div class="post">{}</div>', "<main>{}</main>"):
        assert kept(given_trees, f"<html><body>{menu}{frame.format(body)}{foot}</body></html>") == want


def test_quotes_count_only_after_an_equals_sign(given_trees):
    page = Page("<article><p title=it's>One line.</p><p>That's two.</p><a href=x?a='b>three</a><p data-a='x>y' b=\"c>d\" e>four</p></article>")
    assert [t for _, t, _ in page.blocks] == ["One line.", "That's two.", "three", "four"]
    assert [t for _, t, _ in Page("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p>").blocks] == ["so x=2 holds"]
