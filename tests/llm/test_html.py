import html as references
import random
import re

from tessella.llm import html, queries
from tests.llm.conftest import larger

PAGES = "page_id long, url string, html string, text string, n_chars int"


def lines(source):
    return html.Page(source).lines


def plain_article(source):
    """Blocks of the generated pages' article, by pattern."""
    inner = re.search(r"<article>(.*?)</article>", source, re.S)[1]
    blocks = [" ".join(references.unescape(re.sub("</?b>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
    return "\n\n".join(b for b in blocks if b)


def test_query_equals_brute_force(spark, sf):
    sf = larger(sf)
    got = {r.page_id: r for r in queries.op7_html(spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        want = plain_article(p.html)
        assert (got[p.page_id].url, got[p.page_id].text, got[p.page_id].n_chars) == (p.url, want, len(want))


def test_structure():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="page sidebar-right">
      <header><h1>Site</h1></header><nav>Menu</nav><div id="cookie-notice">We use cookies</div>
      <main><article><header><h1>Title &amp; more</h1></header><p>One<b>two</b> three&nbsp;&nbsp;four<br>five
      <p class="ad-slot">Buy!<p>Six &lt;tag&gt; &#233;<ul><li>a<li>b</ul><script>var x = "</p><p>no";</script>
      <form><p>Search</p></form><aside>Related</aside><!-- <p>hidden</p> --><div class="commentList"><p>First!</p></div>
      <pre>  x
      y </pre></article></main><section id="comments"><p>Reader says</p></section><footer>&copy; 2020</footer></body></html>"""
    assert lines(page) == ["Title & more", "Onetwo three four five", "Six <tag> é", "a", "b", "x y"]
    assert lines("just text &amp; <i>more</i>") == ["just text & more"]
    assert lines("<div>a<div>b</div>c</div></p></div>d") == ["a", "b", "c", "d"]
    assert lines("<p title='x>y'>z") == ["z"] and lines("<p>1 < 2 &lt; 3</p>") == ["1 < 2 < 3"]
    assert lines("<article><p>cut off in the mid") == ["cut off in the mid"]
    assert lines("") == lines("<nav>x</nav>") == lines("<script>x") == []


IN_DOUBT = """<article><h1>T {0}</h1><section id="related-work"><p>Body {0}</p><p>Shared</p></section><p class="share-price">Up</p>
  <p id="search">S {0}</p><div class="notice">Read our terms</div><p>Shared</p><p class="menu">Soup</p><p>end</p></article><p>outside</p>"""


def test_single_words_leave_article_blocks_in_doubt(spark):
    """A word of a class or id alone deletes no block of an article; what is shared besides goes."""
    alone = ["T 1", "Body 1", "Shared", "Up", "S 1", "Read our terms", "Shared", "Soup", "end"]
    assert lines(IN_DOUBT.format(1)) == alone
    rows = [(1, "http://a.org/1", IN_DOUBT.format(1)), (2, "http://a.org/2", IN_DOUBT.format(2)), (3, "http://b.org/1", IN_DOUBT.format(1))]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame([(*r, None, 0) for r in rows], PAGES)).collect()}
    assert got[3].split("\n\n") == alone  # without a neighbour nothing is in common
    assert got[1].split("\n\n") == ["T 1", "Body 1", "S 1", "Shared", "end"]  # the plain paragraph stays, though shared
    assert got[2].split("\n\n") == ["T 2", "Body 2", "S 2", "Shared", "end"]
    assert lines("<article></article><p>outside</p>") == []
    assert lines('<article><p>a</p><div class="share-buttons"><p>Tweet</p></div><div role="navigation">n</div><ul id="relatedPosts"><li>x</ul></article>') == ["a"]
    assert lines('<p>a</p><div class="notice">gone</div><p class="share-price">gone too</p>') == ["a"]


def without_article(source):
    return re.sub("</?article>", "", source)


def test_differencing_of_pages_without_article(spark, sf):
    """Structure leaves the article's lines; of these, a brute-force alignment with the nearest
    page of the host takes those in common."""
    pages = [(p.page_id, p.url, without_article(p.html), plain_article(p.html)) for p in spark.read.parquet(f"{larger(sf)}/pages.parquet").collect()]
    place = lambda p: (re.match("[a-z]+://([^/]*)([^?#]*)", p[1]).groups(), p[0])
    hosts = {}
    for p in sorted(pages, key=place):
        hosts.setdefault(place(p)[0][0], []).append(p)
    want, shared = {}, 0
    for held in hosts.values():
        for k, p in enumerate(held):
            near = held[k + 1] if k + 1 < len(held) else held[k - 1] if k else None
            mine, other = p[3].split("\n\n"), near[3].split("\n\n") if near else []
            common = lcs(mine, other)
            shared += common
            want[p[0]] = len(mine) - (common if common < len(mine) else 0)
    got = html.extract(spark.createDataFrame([(p[0], p[1], p[2], None, 0) for p in pages], PAGES)).collect()
    assert shared and {r.page_id: len(r.text.split("\n\n")) for r in got} == want


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_common_is_a_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(500):
        a, b = ([rng.choice("abcdef") for _ in range(rng.randrange(20))] for _ in range(2))
        found = common = html.common(a, b)
        assert len(found) == lcs(a, b) and common == sorted(set(common))
        rest = iter(b)
        assert all(a[i] in rest for i in found)


def page(*parts):
    return "".join(f"<p>{p}</p>" for p in parts)


def test_neighbours_share_their_boilerplate(spark):
    rows = [
        (1, "http://h.org/a", page("Top", "Alpha text", "Bottom")), (2, "http://h.org/b?x=1", page("Top", "Beta text", "Bottom")),
        (3, "http://H.ORG/c#f", page("Top", "Gamma", "text", "Bottom")), (4, "https://alone.org/", page("Top", "Alone", "Bottom")),
        (5, "http://m.org/1", page("Same", "text")), (6, "http://m.org/2", page("Same", "text")),
        (7, "http://box.org/1", "<article>" + page("Top", "One") + "</article>"), (8, "http://box.org/2", "<article>" + page("Top", "Two") + "</article>"),
    ]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame([(*r, None, 0) for r in rows], PAGES)).collect()}
    assert got == {
        1: "Alpha text", 2: "Beta text", 3: "Gamma\n\ntext", 4: "Top\n\nAlone\n\nBottom", 5: "Same\n\ntext", 6: "Same\n\ntext",
        7: "Top\n\nOne", 8: "Top\n\nTwo",
    }


def test_ranges_change_nothing(spark):
    """Every page but a host's last is paired with the next, wherever the ranges fall."""
    rows = [(i, f"http://h{i % 3 if i % 2 else 0}.org/{i:04d}", page("Top", f"Text {i}", f"Pair {i // 2}", "End")) for i in range(400)]
    pages = spark.createDataFrame([(*r, None, 0) for r in rows], PAGES)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    try:
        for n in ("1", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            results.append(sorted(map(str, html.extract(pages).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1] and len(results[0]) == 400 and "Top" not in "".join(results[0])


def test_odd_rows(spark):
    long = "<article>" + "<p>word</p>" * 100_000 + "<div>" * 5000 + "</div>" * 5000 + "</article>"
    rows = [(1, None, None), (2, "", ""), (None, "not a url", "<p>x</p>"), (3, "http://a/", long), (4, "http://a/", "<p>y</p>"), (4, "http://a/", "<p>y</p>"), (-5, "http://a/z", "<p>q</p>")]
    got = html.extract(spark.createDataFrame([(*r, "t", 0) for r in rows], PAGES)).collect()
    assert len(got) == len(rows)
    text = sorted((str(r.page_id), r.url or "", r.n_chars) for r in got)
    assert text == [("-5", "http://a/z", 1), ("1", "", 0), ("2", "", 0), ("3", "http://a/", 599_998), ("4", "http://a/", 1), ("4", "http://a/", 1), ("None", "not a url", 1)]
    assert html.extract(spark.createDataFrame([], PAGES)).collect() == []


OWN_PARTS = """<article class="post comments-open"><h1>T {0}</h1><p>Body {0}</p>
  <div class='comments'><p>Nice post, says reader {0}</p></div><section id="reader-comments"><p>Another of {0}</p></section>
  <article class="comment"><p>Nested {0}</p></article><div id="disqus_thread"><p>Thread {0}</p></div>
  <div class='advert'><p>Buy shoes {0}</p></div><p class="sponsored">From our partner {0}</p><div class="ad-slot">Ad {0}</div>
  <div id='newsletter'><p>Join our letter {0}</p></div><div class="subscribe">Mail {0}</div><p class="cookie">Accept {0}</p>
  <div class="menu-items"><p>Soup {0} EUR</p></div><p class="notice-block">Closed on day {0}</p><p class="search">Search went on {0}</p>
  <ul class="related-posts"><li><a href="/x{0}">Other story {0}</a></ul><p class="share">Shares of <a href="/y">x</a> rose {0}</p>
  <ul class="menu"><li><a href="/">Start {0}</a><li><a href="/b">Second {0}</a></ul><p>End {0} <a href="/z">with a long link to some place</a></p></article>"""


def test_comments_adverts_and_forms_inside_an_article_go_without_a_neighbours_help(spark):
    """Each page's own, so no neighbour shares them; what may be a subject stays, but for links."""
    rows = [(k, f"http://a.org/{k}", OWN_PARTS.format(k), None, 0) for k in (1, 2)] + [(3, "http://b.org/", OWN_PARTS.format(3), None, 0)]
    got = {r.page_id: r.text.split("\n\n") for r in html.extract(spark.createDataFrame(rows, PAGES)).collect()}
    for k in (1, 2, 3):
        assert got[k] == [f"T {k}", f"Body {k}", f"Soup {k} EUR", f"Closed on day {k}", f"Search went on {k}", f"Shares of x rose {k}", f"End {k} with a long link to some place"]


def test_a_page_of_doubtful_links_keeps_them(spark):
    only = [(1, "http://a.org/", '<article><ul class="menu"><li><a href="/">Only</a></ul></article>', None, 0)]
    assert html.extract(spark.createDataFrame(only, PAGES)).first().text == "Only"
