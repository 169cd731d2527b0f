import html
import re

import pytest

from docproof.llm.html_text import extract_text, host_of, main_text, scan

CASES = {
    "": "",
    "plain text": "plain text",
    "<body><header>Top</header><main><h1>T</h1><p>a<b>b</b> c<br>d<p>x &lt;y&gt;</main><footer>z</footer>": "T\nab c d\nx <y>",
    "<nav>menu</nav><article><header><h1>Title</h1></header><p>Text</p><aside>side</aside><ul><li>one<li>two</ul></article>": "Title\nText\none\ntwo",
    "<article><p>a</p><div class='ad-box'>buy</div><p>b</p><section id=comments><p>first!</p></section></article>": "a\nb",
    "<article><p>kept</p></article><div class=\"cookie-notice\">cookies</div><p>not in the article</p>": "kept",
    "<p>a &amp;amp; &nbsp; b &#169; &copy</p><script>var t='</p><p>no';</script><style>p{}</style><p>c</p>": "a &amp; b © ©\nc",
    "<article><p>cut off in the mid": "cut off in the mid",
    "<article><p>a<!-- no <p>no</p> --> b</p><!-- open": "a b",
    "<article><p title=\"a > b\">quoted</p><p title='x'>y</p></article>": "quoted\ny",
    "<article><table><tr><td>1<td>2<tr><td>3</table><form>f</form><button>g</button></article>": "1\n2\n3",
    "<article>5 < 6 and 7 > 3 <unknown>tag</unknown></article>": "5 < 6 and 7 > 3\ntag",
    "<article><p>a\n\t  b\xa0c</p></article>": "a b c",
    "<div role=navigation>m</div><div role=main>text</div><div hidden>h</div>": "text",
    "</p></div><article></b>x</article></article>": "x",
    "<article><p><b>bold<br><p>next</p></article>": "bold\nnext",
    '<div style="overflow: hidden"><article><p>x</p></article></div>': "x",
    '<article><p title="A hidden gem">x</p><a title=" hidden ">y</a></article>': "x\ny",
    '<article><h2 id="related-work">Related work</h2><section id="social-policy"><p>x</p></section><p class="comment">y</p></article>': "Related work\nx\ny",
    '<div class="page-header"><h1>T</h1></div><div><p>x</p></div><div class="site-header">no</div>': "T\nx",
    '<main><h1>T</h1><p>Whole story.</p><article class="card">Teaser</article></main>': "T\nWhole story.",
    "<main><h1>T</h1><p>Lead</p><article><p>A longer story than its lead.</p></article><div>more of the site</div></main>": "T\nLead\nA longer story than its lead.",
    "<main><p>The whole story stands here.</p><article>a comment</article><article>another</article></main>": "The whole story stands here.",
    "<article><p>A story and its text.</p><article><p>a comment</p></article></article>": "A story and its text.",
    '<div><p>old story</p></div><article class="teaser-box">next</article>': "old story",
    "<article><div class='comment-list'>c</div><div class=\"ad ad-300x250\">buy</div><div class='share buttons'>s</div><p>x</p></article>": "x",
    "<article><p hidden>no</p><p data-x='hidden'>yes</p></article>": "yes",
}


@pytest.mark.parametrize("page, text", CASES.items())
def test_one_page(page, text):
    assert main_text(page) == text


def test_long_and_broken_markup_ends():
    assert main_text("<div>" * 3000 + "deep") == "deep"
    assert main_text("<article><p>" + "word " * 200_000) == ("word " * 200_000).strip()
    assert main_text("<a href=\"" * 2000)[:1] in ("", "<")
    assert len(scan("<p>" * 2000)[0]) == 2001


def test_hosts():
    assert [host_of(u) for u in ("http://A.b/c", "https://u:p@x.y:80?q", "//z/", "no host", None, "")] == ["a.b", "x.y", "z", "", "", ""]


def site(n, host, extra=""):
    template = "<div class=x><span>Our site</span></div><div><ul><li>Start</li><li>About us</li></ul></div>"
    return [
        (f"http://{host}/{i}", f"<html><body>{template}<div><p>Story {host} {i}</p><p>Common words</p></div>{extra}<div>Bottom line</div></body></html>")
        for i in range(n)
    ]


def test_recurring_subtrees_go_where_pages_declare_nothing(spark):
    pages = site(12, "one.example") + site(3, "two.example") + [("http://one.example/a", f"<article><p>Own {i}</p><p>Said often</p></article>") for i in range(30)]
    rows = [(i, u, h, "x") for i, (u, h) in enumerate(pages)] + [(100, None, None, ""), (0, *pages[0], "again")]
    found = extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(found) == len(rows)
    by_id = {r.page_id: r for r in found}
    assert by_id[0].text == "Story one.example 0"
    assert by_id[12].text == "Our site\nStart\nAbout us\nStory two.example 0\nCommon words\nBottom line"
    assert by_id[20].text == "Own 5\nSaid often"
    assert (by_id[100].text, by_id[100].n_chars, by_id[100].url) == ("", 0, None)
    assert all(r.n_chars == len(r.text) for r in found)


def test_copies_of_a_page_are_no_template(spark):
    page = site(1, "copies.example")[0]
    rows = [(i, *page) for i in range(40)]
    found = extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in found} == {"Our site\nStart\nAbout us\nStory copies.example 0\nCommon words\nBottom line"}


def test_given_pages_keep_their_articles(spark, sf_dir):
    for row in extract_text(pages := spark.read.parquet(f"{sf_dir}/pages.parquet")).join(pages, ["page_id", "url"]).collect():
        article = re.search("<article>(.*)</article>", row.html, re.S).group(1)
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", p.replace("<br>", " "))).split()) for p in re.split("</?(?:p|h1)>", article)]
        assert row.text == "\n".join(p for p in parts if p)


def test_empty_table(spark):
    assert extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_template_of_a_section_goes_on_a_large_host(spark):
    box = "<div><div>Team of the section</div><ul><li>Contact</li></ul></div>"
    rows = [(i, f"http://big.example/{i}", f"<body><div><p>Story {i}</p></div>{box if i % 20 == 0 else ''}</body>") for i in range(200)]
    found = extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in found} == {i: f"Story {i}" for i in range(200)}


def pages_of(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")


def test_a_heading_that_few_pages_share_stays(spark):
    rows = [(f"http://wiki.example/{i}", f"<div><h2>{'Introduction' if i % 50 == 0 else f'Part {i}'}</h2><p>Text {i}</p></div>") for i in range(400)]
    found = {r.page_id: r.text for r in extract_text(pages_of(spark, rows)).collect()}
    assert found == {i: f"{'Introduction' if i % 50 == 0 else f'Part {i}'}\nText {i}" for i in range(400)}


def test_lines_of_the_site_inside_articles(spark):
    """What stands on nearly every page goes, prose included; what some pages share stays."""
    def page(i):
        quote = "<p>A quotation that many cite.</p>" if i % 3 else "<p>Another.</p>"
        box = "<div><p>About the author</p></div>"
        return f"<article><h1>Title {i}</h1><p>Story {i}</p>{quote}<p>Subscribe to our letter.</p>{box}</article>"

    rows = [(f"http://news.example/{i}", page(i)) for i in range(60)]
    found = {r.page_id: r.text for r in extract_text(pages_of(spark, rows)).collect()}
    assert found[1] == "Title 1\nStory 1\nA quotation that many cite." and found[3] == "Title 3\nStory 3\nAnother."
    copies = [(f"http://mirror.example/{i}", page(1)) for i in range(60)]
    assert {r.text.count("\n") for r in extract_text(pages_of(spark, copies)).collect()} == {4}


def count_by_hand(rows):
    """Template subtrees counted with dictionaries, page by page."""
    from collections import defaultdict

    from docproof.llm import html_text as H

    contents, addresses, around, kinds = defaultdict(set), defaultdict(set), defaultdict(set), {}
    for url, page in rows:
        elements, pieces = scan(page or "")
        content = "\n".join(H.blocks(pieces, elements, set()))
        for e in H.candidates(elements):
            place = (host_of(url), e.path, tuple(e.children))
            key = (place, (page or "")[e.start : e.end])
            contents[key].add(content)
            addresses[key].add(url)
            around[place].add(content)
            kinds[key] = H.kind_of(e)
    shares, least = {0: H.SHARE, 1: H.PROSE_SHARE, 2: H.SHARE_INSIDE}, {0: H.MANY_PAGES, 1: H.MANY_PAGES, 2: H.MANY_PAGES_INSIDE}
    return {
        k for k, own in contents.items()
        if len(own) >= least[kinds[k]] and len(own) >= shares[kinds[k]] * len(around[k[0]]) and (kinds[k] < 2 or len(addresses[k]) > 1)
    }


def test_counts_of_subtrees_equal_plain_counts(spark, sf_dir):
    from docproof.llm.html_text import template_subtrees

    given = [(r.url, r.html) for r in spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/pages.parquet").collect()]
    rows = given + site(12, "one.example") + site(3, "two.example") + [(f"http://news.example/{i}", f"<article><p>s{i}</p><p>Subscribe</p></article>") for i in range(30)]
    found = template_subtrees(pages_of(spark, rows)).collect()
    assert len(found) == len(count_by_hand(rows)) > 5
