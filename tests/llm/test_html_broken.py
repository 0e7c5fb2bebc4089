"""Broken and very deep markup: read as far as it goes, in time that grows with the page."""

import random
import time

import pytest

from fleetcheck.llm import html_text

SF = "/root/testdata/sf0.001"
GOOD = "It was the best of the times that the town had seen, and the river ran by the mill as it had in all the years before. "


@pytest.fixture(scope="module")
def pages(spark):
    return [r[0] for r in spark.read.parquet(f"{SF}/pages.parquet").select("html").collect() if r[0]]


@pytest.mark.parametrize("broken", ["<![foo[bar]]>", "<![1", "<![", "<![CDATA[x]]>", "<![if !IE]>", "<!1>", "<!", "<?", "</", "<!doctype", "<![endif]-->", "<![CDATA["])
def test_declarations_are_no_text_and_no_error(broken):
    assert html_text.main_text(f"<article><p>{GOOD}</p>{broken}<p>{GOOD}</p></article>").startswith(GOOD.strip())
    assert isinstance(html_text.main_text(broken), str) and isinstance(html_text.main_text(broken * 3 + GOOD), str)
    if broken.endswith(">"):
        assert html_text.main_text(f"<article><p>{GOOD}</p>{broken}<p>{GOOD}</p></article>") == f"{GOOD.strip()}\n\n{GOOD.strip()}"


def test_cuts_and_mutations_of_every_page(pages):
    g = random.Random(2)
    bits = ["<", ">", "<!--", "-->", "<![x", "<![", "]]>", "</div>", '"', "'", "<p", "&#x", "&", "</", '<a href="', "<script>", "<!d", "<?x", "\x00"]
    for h in pages:
        for _ in range(12):
            k = g.randint(0, len(h))
            cut = h[:k] if g.random() < 0.4 else h[:k] + g.choice(bits) + h[k + g.randint(0, 40):]
            assert isinstance(html_text.main_text(cut), str)


def test_a_broken_page_is_a_row(spark):
    df = spark.createDataFrame([(1, "u", "<![foo[bar]]>"), (2, None, f"<article><p>{GOOD}<![1</p>"), (None, "u", None)], "page_id long, url string, html string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_text.extract(df).collect()}
    assert got[1] == ("", 0) and got[None] == ("", 0) and got[2][0].startswith(GOOD.strip())


@pytest.mark.parametrize("make", [
    lambda n: "<div>" * n + "x", lambda n: "<li>a<b>" * n, lambda n: "<a" * n, lambda n: "<a" * n + ">x", lambda n: "<p><i>x" * n, lambda n: "<!--" * n,
    lambda n: "<![CDATA[" * n, lambda n: "<![" * n, lambda n: '<a b="' * n, lambda n: "</x>" * n, lambda n: "<a b='x" * n + ">", lambda n: "<script>" + "</" * n,
    lambda n: "<ul>" * n + "<a href=x>" * n + "t", lambda n: "<head>" * n + "<p>" * n])
def test_deep_and_unclosed_markup_is_linear(make):
    t = time.process_time()
    html_text.main_text(make(100_000))
    assert time.process_time() - t < 8


def test_linked_words_of_a_paragraph_stay_without_an_article_mark():
    page = f"<body><div class='nav'><a href=a>Home</a></div><p>{GOOD}</p><p>The town <a href=b>and the mill by the river</a> was there in the years before, as all of us said.</p><p><a href=c>one</a> <a href=d>two</a></p></body>"
    text = html_text.main_text(page)
    assert "and the mill by the river" in text and "Home" not in text and "two" not in text
