import html
import re
from collections import defaultdict

import pytest

from loglantern.llm import sitetext


def texts(frame):
    return {r.page_id: r.text for r in sitetext.extract(frame).collect()}


def frame_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, HTML string, host int")


def alone(page):
    return "\n".join(sitetext.read_page(page)[0])


def brute_force(rows, min_settings=4, min_share=0.2):
    """Text of each page, with every host's subtrees counted in dictionaries."""
    seen, every = defaultdict(set), defaultdict(set)
    hosts = {i: re.sub(r"^\w+://([^/:?#]*).*$", r"\1", url or "").lower() for i, url, _ in rows}
    for i, _, page in rows:
        for tree, setting, _, _ in sitetext.read_page(page or "")[1]:
            seen[hosts[i], tree].add(setting)
            every[hosts[i]].add(setting)
    out = {}
    for i, _, page in rows:
        blocks, trees = sitetext.read_page(page or "")
        gone = {
            b
            for tree, _, first, last in trees
            if len(seen[hosts[i], tree]) >= max(min_settings, min_share * len(every[hosts[i]]))
            for b in range(first, last)
        }
        out[i] = "\n".join(b for j, b in enumerate(blocks) if j not in gone)
    return out


def test_small_tables(spark, sf_dir):
    pages = sitetext.table(spark, sf_dir, "pages")
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()]
    got = sitetext.query(spark, sf_dir).collect()
    assert sorted(r.page_id for r in got) == sorted(i for i, _, _ in rows)
    assert {r.page_id: r.text for r in got} == brute_force(rows)
    assert all(r.n_chars == len(r.text) for r in got)
    for i, _, page in rows:  # these pages name their article
        article = re.search("<article>(.*?)</article>", page, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", article))
        assert {r.page_id: r.text for r in got}[i] == "\n".join(b for b in blocks if b)


def plain(i, body):
    """A page that names nothing: all is div and p."""
    return (
        f"<html><head><title>T{i}</title></head><body><div class=c1><p>We keep small files on your machine</p><p>OK</p></div>"
        f"<div class=c2><h1>Title {i}</h1>{body}</div><div class=c3><ul><li>Home<li>About<li>Contact</ul></div>"
        f"<div>Made by hand since 1999</div></body></html>"
    )


def test_templates_of_hosts(spark):
    rows = [(i, f"http://A.example/p{i}", plain(i, f"<p>Text number {i} is long enough to be the longest.</p><p>Shared words</p>" if i % 5 == 0 else f"<p>Text number {i} is long enough to be the longest.</p>")) for i in range(12)]
    rows += [(100 + i, f"http://b.example:80/p{i}", plain(100 + i, f"<p>Other text {i} of a small site, also the longest.</p>")) for i in range(3)]
    got = texts(frame_of(spark, rows))
    assert got == brute_force(rows)
    assert got[1] == "Title 1\nText number 1 is long enough to be the longest."
    assert got[5] == "Title 5\nText number 5 is long enough to be the longest.\nShared words"  # three settings are not many
    assert got[100].startswith("We keep small files")  # too few pages to tell


def test_copies_are_no_template(spark):
    """A hundred copies of one page, exact and near, among a host's pages keep their text."""
    body = "".join(f"<p>Paragraph {k} of an article that was copied many times over.</p>" for k in range(9))
    rows = [(i, "http://a.example/", plain(0, body)) for i in range(60)]
    rows += [(60 + i, "http://a.example/", plain(0, body + f"<p>Short end {i}</p>")) for i in range(40)]
    rows += [(200 + i, "http://a.example/", plain(i, f"<p>Text number {i} of this site, which is its own and the longest.</p>")) for i in range(20)]
    got = texts(frame_of(spark, rows))
    assert got == brute_force(rows)
    want = "Title 0\n" + "\n".join(f"Paragraph {k} of an article that was copied many times over." for k in range(9))
    assert {got[i] for i in range(60)} == {want}
    assert got[207] == "Title 7\nText number 7 of this site, which is its own and the longest."


def test_passages_in_articles_stay(spark):
    rows = [(i, "http://a.example/", f"<main><article><h1>T{i}</h1><p>Own text {i}, by far the longest block here.</p><p>Free to copy.</p><div class=x><p>Read our paper</p></div></article></main>") for i in range(9)]
    got = texts(frame_of(spark, rows))
    assert got[3] == "T3\nOwn text 3, by far the longest block here.\nFree to copy."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p>a<p>b <b>c<br>d</b>e", "a\nb c de"),
        ("<article>x &amp;amp; &lt;p&gt; &eacute;&#x1F642; &nbsp; y\n\t z</article>", "x &amp; <p> é🙂 y z"),
        ('<body class="no-sidebar"><header>H</header><div id="sideBar">S</div><p>t</p><div class="cookie-notice">N</div><footer>F</footer>', "t"),
        ('<article><header><h1>T</h1></header><p>a</p><aside>s</aside><form>f<p>g</form><p>b</p></article><section id="comments"><article class="comment">c</article></section>', "T\na\nb"),
        ('<article><p>a</p><div class="comments"><p>nice</p></div><p hidden>h</p><p style="display: none">i</p></article>', "a"),
        ("<script>if (a</b) '<p>x</p>'</script><style>p{}</style><textarea><p>no</textarea><p>t</p><!-- <p>c</p> --><noscript>n</noscript>", "t"),
        ("<p>shadow</p><div class='shadow badge adequate'>kept</div><div class=ad>gone</div>", "shadow\nkept"),
        ("<ul><li>one<li>two<ul><li>in</ul><li>three</ul><table><tr><td>1<td>2<tr><td>3</table>", "one\ntwo\nin\nthree\n1\n2\n3"),
        ("<div>a<p>b</div>c</p>d</span></div>e", "a\nb\ncde"),
        ("text <a href='>'>link</a> & 3 < 4 <notatag> <3", "text link & 3 < 4 <3"),
        ("<p>open <a title=\"never closed>x<p>y", "open x\ny"),
        ("<!-- never closed <p>x</p>", ""),
        ("<p>a</p><script>never closed <p>x</p>", "a"),
        ("<main><p>m</p></main><div>o</div>", "m"),
        ("<article></article><div>only here</div>", "only here"),
        ("<!DOCTYPE html><?xml?><![CDATA[x]]><p>a</p></p></body></html>b", "a\nb"),
        ("<h2>A<h3>B</h3><p>C<div>D</div>E", "A\nB\nC\nD\nE"),
        ("", ""),
    ],
)
def test_markup(page, want):
    assert alone(page) == want


def test_long_and_deep_pages():
    assert alone("<div>" * 20_000 + "deep") == "deep"
    assert len(alone("<p>word " * 100_000).split("\n")) == 100_000
    assert alone("<a b=\"" * 20_000 + "x") in ("", "x") and alone("<" * 100_000) == "<" * 100_000


def test_odd_rows(spark):
    page = "<article><p>a</p></article>"
    rows = [(1, None, page), (None, "http://h/", page), (None, None, None), (2, "http://h/", None), (3, "h", ""), (4, "http://h/", page), (4, "http://h/", page), (5, "http://h/", "a" * 2_000_000)]
    got = sitetext.extract(frame_of(spark, rows)).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"page_id", "url", "text", "n_chars"}
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 0), (0, 1), (1, 1), (2, 0), (3, 0), (4, 1), (4, 1), (5, 2_000_000)]
    assert sitetext.extract(frame_of(spark, rows).where("false")).count() == 0
