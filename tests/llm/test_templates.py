import html
import re

import pytest

from martlet.llm import queries, templates


def test_articles_of_the_given_pages(spark):
    folder = "/root/testdata/sf0.001"
    got = {r["page_id"]: r for r in queries.op5_site_templates(spark, folder).collect()}
    for page in spark.read.parquet(f"{folder}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)</article>", page["html"], re.S).group(1)
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", " ", b.replace("<b>", "")))).strip() for b in re.split(r"<h1>|</h1>|<p>|</p>", article)]
        text = "\n\n".join(b for b in blocks if b)
        assert got[page["page_id"]]["text"] == text and got[page["page_id"]]["n_chars"] == len(text)


PAGES = [(1, "http://a.b/x", None, ""), (2, None, "<p>x &amp; y<p>z", "x & y\n\nz"), (8, "u", "<div>" * 5000 + "deep", "deep"),
         (9, "x", '<a href="x>broken <p>hi <b>b there', None), (11, "x", "<script>a<b</script><style>p{}</style>t<!-- c --> u", "t u"),
         (12, "x", "<ul><li>one<li>two</ul><table><tr><td>a<td>b</table>", "one\n\ntwo\n\na\n\nb"),
         (13, "x", "<form><p>f</p></form><div class='cookie-notice'>c</div><div id=sidebar>s</div>body", "body"),
         (10, "x", "<body><header><h1>S</h1></header><main><header><h1>T</h1></header><p>a&nbsp; b<br>c</p><div class=\"comments\"><p>c</p></div><aside>q</aside></main>", "T\n\na b c")]


@pytest.mark.parametrize("sent", [1_000_000, 0])
def test_recurring_subtrees_go_whichever_way_they_are_sent(spark, sent):
    site = [(100 + i, f"http://h/{i}", f"<div>menu a</div><div><p>shared</p><p>own {w}</p></div>", f"own {w}") for i, w in enumerate("abcdefg")]
    # Copies of one page count once: four different pages of a host make no template.
    copies = [(200 + i, f"http://k/{i}", f"<div>menu a</div><p>{min(i, 3)}</p>", f"menu a\n\n{min(i, 3)}") for i in range(20)]
    given = PAGES + site + copies
    df = spark.createDataFrame([(i, u, h, "x") for i, u, h, _ in given], "page_id long, url string, html string, host string")
    got = {r["page_id"]: r["text"] for r in templates.main_texts(df, most_sent=sent).collect()}
    assert len(got) == len(given)
    for i, _, _, text in given:
        assert text is None or got[i] == text, (i, got[i])
    assert templates.main_texts(df.limit(0), most_sent=sent).collect() == []


def test_article_text_that_copies_share_stays(spark):
    df = spark.createDataFrame([(i, "http://h/", f"<nav>n</nav><article><p>same in all</p><p>{i}</p></article>") for i in range(12)], "page_id long, url string, html string")
    assert {r["text"] for r in templates.main_texts(df).collect()} == {f"same in all\n\n{i}" for i in range(12)}


def test_a_wrapper_does_not_take_its_article_along(spark):
    wrapped = "<div id=content><div class=inner><{0}><p>the article</p></{0}></div><div>menu</div></div>"
    pages = [(i, f"http://{tag}/", f"<nav>{i}</nav>{wrapped.format(tag)}<p>date {i}</p>") for tag in ("article", "main") for i in range(12)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert {r["text"] for r in templates.main_texts(df).collect()} == {"the article"}


def test_the_pages_a_template_needs_stop_rising_with_the_host(spark):
    given = [(i, "http://h/", ("<div>rare banner</div>" if i < 10 else "") + f"<p>own {i}</p>") for i in range(1000)]
    df = spark.createDataFrame(given, "page_id long, url string, html string")
    assert {r["text"] for r in templates.main_texts(df, enough=10).collect()} == {f"own {i}" for i in range(1000)}
    assert sum("banner" in r["text"] for r in templates.main_texts(df, enough=11).collect()) == 10


ARTICLE = "<h1>T</h1><p>the text</p>"


@pytest.mark.parametrize("html", [
    f"<div class='layout has-sidebar'><article>{ARTICLE}</article></div>",
    f"<body class='single comments-open'><article>{ARTICLE}</article></body>",
    f"<article class='post comments-open'>{ARTICLE}</article>",
    f"<form id=aspnet><nav>n</nav><article>{ARTICLE}</article></form>",
    f"<form id=aspnet><nav>n</nav><div>{ARTICLE}</div><footer>f</footer></form>",
    f"<div class=has-sidebar><article>{ARTICLE}</article><div class=related><article>teaser</article></div><aside><article>a longer teaser than the text</article></aside></div>",
    f"<article>{ARTICLE}</article><div class=related><article>a teaser that is longer than the text itself</article></div>",
    f"<main>{ARTICLE}<section class=reader-responses><p>first!</p></section><div id=x><article class=comment>a comment longer than all of it</article></div></main>",
    f"<script src=https://cdn/x/>var a=1;</script><div>{ARTICLE}</div>",
    f"<noscript><div>{ARTICLE}</div>", f"<svg><article>{ARTICLE}</article>", f"<object><template>{ARTICLE}",
    f"<svg/><style/>p</style><article>{ARTICLE}</article>",
])
def test_words_and_unclosed_elements_take_no_article_along(html):
    assert templates.main_text(templates.parse(html, "h"), lambda h: False) == "T\n\nthe text"


def test_formulas_are_text():
    page = "<article><p>let <math><mi>x</mi><annotation>\\x</annotation></math> be</p></article>"
    assert templates.main_text(templates.parse(page, "h"), lambda h: False) == "let x be"


def test_bars_inside_articles_go_by_counting_and_copied_lists_stay(spark):
    bar, author, copied = "<div>tell a friend</div>", "<section class=bio><p>Ann writes here</p></section>", "<p>see</p><ul><li>one</li></ul><p>end</p>"
    own = [(i, f"<main><h1>{i}</h1>{bar}<p>own {i}</p>{author if i % 2 else ''}</main>", f"{i}\n\nown {i}") for i in range(12)]
    copies = [(100 + i, f"<main><h1>{i}</h1>{copied}<p>{i}</p></main>", f"{i}\n\nsee\n\none\n\nend\n\n{i}") for i in range(12)]
    few = [(200 + i, f"<main><p>few {i}</p><div>on four pages</div></main>", f"few {i}\n\non four pages") for i in range(4)]
    given = own + copies + few
    df = spark.createDataFrame([(i, "http://h/", page) for i, page, _ in given], "page_id long, url string, html string")
    for sent in (1_000_000, 0):
        assert {r["page_id"]: r["text"] for r in templates.main_texts(df, most_sent=sent).collect()} == {i: text for i, _, text in given}


def test_templates_are_those_that_plain_counting_finds(spark):
    pieces = [f"<div>piece {i}</div>" for i in range(9)]
    pages = {(i, f"http://h{i % 2}/"): [p for j, p in enumerate(pieces) if i % (j + 2) == 0] for i in range(40)}
    counts: dict = {}
    for (i, url), parts in pages.items():
        for p in parts:
            counts.setdefault((url, p), set()).add(i)
    df = spark.createDataFrame([(i, url, "".join(parts) + f"<p>{i}</p>") for (i, url), parts in pages.items()], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in templates.main_texts(df, many=5, share=0.2).collect()}
    for (i, url), parts in pages.items():
        left = [p[5:-6] for p in parts if not (len(counts[url, p]) >= 5 and len(counts[url, p]) >= 20 * 0.2)]
        assert got[i] == "\n\n".join([*left, str(i)])
