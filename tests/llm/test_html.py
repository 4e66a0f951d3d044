"""Main-text extraction: the pages' articles, template text without semantic tags, broken markup, odd rows."""

import html
import re

import numpy as np

from pyspark.sql import functions as F

from tessera.llm import html_extract as H
from tessera.llm import queries


def plain(page):
    """The article's blocks of the synthetic pages, by their known shape."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>|<br>", " ", inner))
    return "\n".join(t for b in blocks if (t := " ".join(html.unescape(b).split())))


def test_articles_of_all_pages(spark, sf):
    got = {r["page_id"]: r for r in queries.op1_html(spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        r = got[p["page_id"]]
        assert r["text"] == plain(p["html"]) and r["n_chars"] == len(r["text"]) and r["url"] == p["url"]


LAYOUT = (
    '<html><head><title>T</title></head><body><div id=top><div>Site name</div><div><a href=/>Home</a> <a href=/x>News of the day</a></div></div>'
    '<div class="cookie-notice">We use cookies.</div><div class=c1><h2>{title}</h2><div>{one}</div><div>{two}</div></div><div>All about us since 1999</div>'
    '<div class="reader-comments"><p>Nice text, {title}!</p></div><form><label>Search</label></form><script>var a = "<p>no</p>";</script></body></html>'
)


def test_template_text_goes_where_no_article_element_helps(spark):
    rows = [(i, f"https://h.example.com/{i}", LAYOUT.format(title=f"Title {i}", one=f"First block of page {i} &amp; more.", two=f"Second   block\nof {i}")) for i in range(12)]
    got = {r["page_id"]: r["text"] for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Title {i}\nFirst block of page {i} & more.\nSecond block of {i}" for i in range(12)}


def test_both_join_forms_agree(spark):
    rows = [(i, f"https://h.example.com/{i}", LAYOUT.format(title=f"Title {i}", one=f"First {i}", two=f"Second {i}")) for i in range(9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    one = sorted(map(tuple, H.extract(df).collect()))
    old, H.BROADCAST_TOKENS = H.BROADCAST_TOKENS, -1
    try:
        assert sorted(map(tuple, H.extract(df).collect())) == one
    finally:
        H.BROADCAST_TOKENS = old


def text_of(page):
    return H.main_text(H.parse(page), None)


def test_markup_of_many_kinds():
    assert text_of("<article><header><h1>Head</h1></header><p>a<b>b</b>c<p>d &lt;e&gt; &#233;&nbsp;f<aside>no</aside><footer>no</footer></article>") == "Head\nabc\nd <e> é f"
    assert text_of("<main><p>one<br>two</p><ul><li>x<li>y</ul><div class='share-bar'>no</div><table><tr><td>1<td>2</table></main><p>no") == "one two\nx\ny\n1\n2"
    assert text_of("<body><nav>no</nav><p>yes 1 < 2</p><!-- <p>no</p> --><style>p{}</style><div role=navigation>no</div>") == "yes 1 < 2"
    assert text_of("<article><p title=\"a>b\">kept</p><section id=comments><p>no</p></section><p hidden>no</p><p>end</article>") == "kept\nend"
    assert text_of("<article><p>cut off <a href='x") == "cut off"
    assert text_of("<article><p>cut off</p><!-- never closed") == "cut off"
    assert text_of("just text") == "just text" and text_of("") == text_of(None) == ""


def test_broken_markup_takes_linear_time():
    for page in ("<" * 200_000, "<a " * 100_000, '<a b="' * 60_000, "<div>" * 20_000 + "x", "<!--" * 100_000, "</p>" * 100_000, "<p" + " x" * 200_000):
        H.parse(page)


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "not a url", "<p>hello</p>"), (2, "not a url", "<p>hello</p>"), (None, "http://a.example/", "<article>" + "<p>long text</p>" * 30_000 + "</article>"), (5, "http://a.example/", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("text", F.lit("t")).withColumn("id", F.lit(None).cast("string"))
    got = sorted(((r["page_id"] or 0, r["url"], r["text"][:20], r["n_chars"]) for r in H.extract(df).collect()), key=str)
    assert got == sorted([(0, "http://a.example/", "long text\nlong text\n", 30_000 * 10 - 1), (1, None, "", 0), (2, "not a url", "hello", 5), (2, "not a url", "hello", 5), (5, "http://a.example/", "", 0)], key=str)
    assert H.extract(df.limit(0)).count() == 0


def test_marks_around_the_article_are_void():
    words = " ".join(f"w{i}" for i in range(40))
    for open_tag in ('<div class="content has-sidebar">', '<div id="page" class="site no-comments">', '<form id=aspnetForm>', '<div class="sidebar-left">'):
        assert text_of(f"<body><div class=menu>no</div>{open_tag}<article><h1>Head</h1><p>{words}</article></{open_tag[1:].split()[0]}>") == f"Head\n{words}"
    assert text_of("<article><div class='entry-header'><h1>Head</h1></div><p>text</p></article>") == "Head\ntext"
    assert text_of(f"<article><p>{words}</article><div class=related><article>teaser</article></div>") == words
    assert text_of(f"<form><p>{words}</p><div class=footer>no</div></form><p>yes") == f"{words}\nyes"
    assert text_of(f"<p>yes</p><div class=comments><p>{words}</p></div>") == "yes"


def test_template_decides_inside_articles_too(spark):
    page = "<body><article><h1>Title {i}</h1><p>Text of page {i}.</p><p>Share this page with all your friends</p><p>More on {i}.</p></article></body>"
    rows = [(i, f"https://h.example.com/{i}", page.format(i=i)) for i in range(8)]
    got = {r["page_id"]: r["text"] for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Title {i}\nText of page {i}.\nMore on {i}." for i in range(8)}
    body = " ".join(f"w{i}" for i in range(50))
    assert body in text_of(f"<div>{body}</div><article>a teaser</article><article>another</article>")


def test_copies_are_no_template_and_sections_have_their_own(spark):
    copy = "<div><h2>One title</h2><p>First paragraph of it.</p><p>Second paragraph.</p></div>"
    rows = [(i, f"https://copy.example.com/{i}", copy) for i in range(3)]
    rows += [(10 + i, f"https://near.example.com/{i}", copy + f"<p>seen {i}</p>") for i in range(3)]
    rows += [(15 + i, f"https://near.example.com/x{i}", f"<div><h3>Other {i}</h3><p>text {i}</p></div>") for i in range(5)]
    rows += [(100 + i, f"https://hot.example.com/s{i % 12}/{i}", f"<div><p>menu of s{i % 12}</p><p>notice of s{i % 12}</p><p>text {i} that is longer than the menu and the notice are together</p></div>") for i in range(60)]
    got = {r["page_id"]: r["text"] for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == "One title\nFirst paragraph of it.\nSecond paragraph." for i in range(3))
    assert all(got[10 + i].startswith("One title\nFirst paragraph of it.\nSecond paragraph.") for i in range(3))
    assert all(got[100 + i] == f"text {i} that is longer than the menu and the notice are together" for i in range(60))


def test_linked_blocks_of_the_text_stay():
    page = "<div><h2><a href=/a>A linked headline</a></h2><p>Some text.</p><p>See <a href=/x>the other long page on it</a></p><ul><li><a href=/r>First reference</a></ul></div>"
    assert text_of(page) == "A linked headline\nSome text.\nSee the other long page on it\nFirst reference"


def test_article_text_stays_and_empty_comments_end():
    page = '<article><div class="entry-header"><h1>Title</h1></div><p>Body</p><p class="legal-history">Kept?</p><!--><p>after</p><!---><p>end</article>'
    assert text_of(page) == "Title\nBody\nKept?\nafter\nend"


def test_withheld_templates_change_the_result(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert all(H.main_text(H.parse(p["html"]), []) != plain(p["html"]) for p in pages)


def vectors(pages):
    """Occurrence vectors over the different pages, by brute force: token to counts."""
    found, weights = {}, {}
    parsed = {H.content_key(p): p for p in map(H.parse, pages)}
    for n, page in enumerate(parsed.values()):
        t = H.Tokens([page])
        for i, token in enumerate([*t.tags.tolist(), *t.words.tolist()]):
            found.setdefault(token, [0] * len(parsed))[n] += 1
            weights[token] = i >= len(t.tags)
    return found, weights, len(parsed)


def test_classes_are_those_of_literal_vectors(spark, sf):
    by_host = {}
    for p in spark.read.parquet(f"{sf}/pages.parquet").collect():
        by_host.setdefault(re.match(r"\w+://([^/?#]*)", p["url"])[1], []).append(p["html"])
    by_host = dict(sorted(by_host.items(), key=lambda x: -len(x[1]))[:6])
    rows = [(i, f"https://{h}/{i}", x) for h, pages in by_host.items() for i, x in enumerate([*pages, pages[0]])]
    frame = H.extract  # the scans as extract() chains them
    assert frame(spark.createDataFrame(rows, "page_id long, url string, html string")).count() == len(rows)
    df = spark.createDataFrame(rows, "id long, url string, html string").withColumn("host", H.host_column("url")).withColumn("section", F.lit(None).cast("string"))
    shapes = H.templates(H.statistics(H.joined(df, H.candidates(df), 0, "tokens"))).collect()
    assert len(shapes) >= 2
    for shape in shapes:
        pages = by_host[shape["level"]]
        found, is_word, n = vectors(pages)
        on = {t: sum(c > 0 for c in v) for t, v in found.items()}
        copies = [1 + (H.content_key(H.parse(pages[0])) == k) for k in dict.fromkeys(H.content_key(H.parse(p)) for p in pages)]
        share = {t: sum(m for c, m in zip(v, copies, strict=True) if c) for t, v in found.items()}
        classes = {}
        for t, v in found.items():
            if on[t] >= (H.TEXT_PAGES if is_word[t] else H.MIN_PAGES) and share[t] >= (H.TEXT_SHARE if is_word[t] else 0.5) * sum(copies):
                classes.setdefault(tuple(v), set()).add(t)
        expected = sorted(sorted(c) for c in classes.values() if len(c) >= 2)
        got = sorted(sorted(t["token"] & H.ALL for t in c["tokens"]) for c in shape["template"]["classes"])
        assert got == expected and n >= H.MIN_PAGES


def test_words_have_one_hash_in_both_forms():
    page = H.parse("<p>one</p><p>two three ünï 漢字 " + "x" * 500 + "</p><p>one</p><p>a b a b a b</p><p>" + "z" * 64 + " " + "z" * 65 + "</p>")
    t = H.Tokens([page, page])
    start = np.cumsum(t.size) - t.size
    for i, b in enumerate(page.blocks):
        if i != 2:  # the second "one" is a token of its own
            assert H.edge_tokens(b) == (int(t.words[start[i]]), int(t.words[start[i] + t.size[i] - 1]))
    half = len(t.words) // 2
    assert (t.words[:half] == t.words[half:]).all() and len(set(t.words.tolist())) == half
