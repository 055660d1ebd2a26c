import html
import re

import pytest

from citegraph.llm.html_text import LABELLED, blocks_of, extract_pages, labelled_tree, main_text, tree_says

LINE = "One two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen. "


@pytest.fixture(scope="module")
def tree():
    return labelled_tree()


def test_tree_knows_the_labelled_table(tree):
    for page in LABELLED:
        _, x, y = blocks_of(page)
        assert tree_says(tree, x).tolist() == y


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<nav><a href=/>Home</a></nav><article><h1>T</h1><p>{LINE}</p><p>Hi.</p><ul><li>a b</li></ul></article><section class='comments'>{LINE * 4}</section><footer>{LINE * 2}</footer>", f"T {LINE}Hi. a b"),
        (f"<div class='cookie-banner'>{LINE * 2}</div><main><h1>T</h1><p>{LINE}</p><form><label>Name</label></form><div id=comments>{LINE * 2}</div><aside>{LINE}</aside></main>", f"T {LINE}"),
        ("<article><p>a&amp;b&nbsp;c &eacute; &#38;&#x26; <i>x</i>y<br>z<!-- <p>no</p> --></p><div class=ad>buy</div><p>1 &lt; 2</p></article>", "a&b c é && xy z 1 < 2"),
        ("<article><script>var t='</p>';</script><style>p{}</style><p title='a>b'>in</p><textarea>no</textarea></article>", "in"),
        ("<article><p>never <b>closed<p>two", "never closed two"),
        ("<head><title>no</title><body><article>&amp;amp; \t\n x</article>", "&amp; x"),
        ("plain words only", "plain words only"),
        ("", ""), (None, ""), ("<nav>only menu</nav>", ""), ("<article><script>never closed", ""), ("<!-- never closed <article>x</article>", ""),
    ],
)
def test_main_text(tree, page, text):
    assert main_text(page, tree) == text.strip()


@pytest.mark.parametrize(
    "page, text",
    [
        ('<article><p>One <svg class="i"/> two</p><p>three</p></article>', "One two three"),
        ("<article><p>One <math/>two <svg a='>' />three <svg b=/x/><path/>no</svg>four</p></article>", "One two three four"),
        ("<article><p>One</p><video-player src=x></video-player><p>two</p><select-box><title-bar>t</title-bar><object-view a=b><p>three</p></article>", "One two t three"),
        ("<article><p>One</p><video src=x><p>two</p><svg><p>three</p></article>", "One two three"),
        ("<article><p>One</p><svg><title>no</title><path/></svg><video>no</video><select><option>no</select><p>two</p></article>", "One two"),
        ("<article><p>One</p><style>never closed<p>two</p></article>", "One"),
    ],
)
def test_skipped_elements_end_where_they_do(tree, page, text):
    assert main_text(page, tree) == text


BODY = f"<h1>T</h1><p>{LINE * 2}</p><p>Hi.</p>"


@pytest.mark.parametrize("wrapper", ["div class='has-sidebar'", "div class=no-sidebar", "div class='left-side'", "section class='search-results'", "div id='legal-advice'", "div class=social-policy", "form id=aspnetForm", "div class='with-nav container'"])
@pytest.mark.parametrize("inner", ["article", "main", "div class=post-content", "div"])
def test_wrappers_keep_their_text(tree, wrapper, inner):
    tags = wrapper.split()[0], inner.split()[0]
    page = f"<body><{wrapper}><nav><a href=/>Home</a></nav><{inner}>{BODY}</{tags[1]}><footer>{LINE}</footer></{tags[0]}></body>"
    assert main_text(page, tree) == f"T {LINE * 2}Hi."


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<div class=header><article>{BODY}</article></div>", f"T {LINE * 2}Hi."),
        (f"<div class='content-sidebar-wrap'><main>{BODY}</main><div class=sidebar><article><p>{LINE}</p></article></div></div>", f"T {LINE * 2}Hi."),
        (f"<article>{BODY}</article><div id=comments><article><p>{LINE}</p></article></div>", f"T {LINE * 2}Hi."),
        (f"<article>{BODY}</article><article class='comment-body'><p>{LINE}</p></article>", f"T {LINE * 2}Hi."),
        (f"<article>{BODY}<form class=search><p>{LINE}</p></form></article>", f"T {LINE * 2}Hi."),
        (f"<article>{BODY}<div hidden><p>{LINE}</p></div><p hidden>no</p><div style='color:red; display: none'>no</div><section aria-hidden=true>no</section><p title='a hidden place'>end</p></article>", f"T {LINE * 2}Hi. end"),
    ],
)
def test_marks_and_hidden_elements(tree, page, text):
    assert main_text(page, tree) == text


def test_deep_pages_are_read_in_one_pass(tree):
    assert main_text("<article>" + "<div>a " * 100_000, tree) == " ".join(["a"] * 100_000)


def test_many_unclosed_elements_are_read_in_one_pass(tree):
    assert main_text("<article><p>" + "<svg>a " * 200_000 + "</p></article>", tree) == " ".join(["a"] * 200_000)


def test_long_page_is_read_whole(tree):
    body = " ".join(f"w{i}" for i in range(200_000))
    assert main_text(f"<nav>x</nav><article><p>{body}</p></article>", tree) == body


def test_pages_of_the_tables_equal_their_article(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r for r in extract_pages(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        body = re.search(r"(?s)<article>(.*?)(</article>|\Z)", r.html)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]+>", " ", re.sub(r"</?b>", "", body))).split())
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want) and got[r.page_id].url == r.url


def test_nulls_repeats_and_clashes(frame):
    rows = [(None, None, None, 1), (1, "u", "<article>é𝄞</article>", 2), (1, "u", "<article>é𝄞</article>", 2)]
    out = extract_pages(frame(rows, "page_id long, url string, html string, n_chars int")).collect()
    assert sorted(((r.page_id, r.url, r.text, r.n_chars) for r in out), key=str) == sorted([(None, None, "", 0), (1, "u", "é𝄞", 2), (1, "u", "é𝄞", 2)], key=str)
    assert extract_pages(frame([], "page_id long, url string, html string")).collect() == []
