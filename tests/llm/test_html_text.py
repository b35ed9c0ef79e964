import random
import re
from html import unescape

import pytest

from skilltrail.llm.html_text import main_text, page_lines, shared_lines

PAGES = [
    (None, []), ("", []), ("just text", ["just text"]), ("a < b & c &lt; d", ["a < b & c < d"]),
    ("<p>One<br>two</p> three&nbsp;&amp;&#39;&#x41;", ["One", "two", "three &'A"]),
    ("<p>a<p>b<b>c</b>\n d<i>e</p>", ["a", "bc de"]),
    ("<script>if (a<b) '</p>'</script><style>x{}</style><title>t</title>x<!-- <p>no</p> -->y", ["xy"]),
    ("<nav><ul><li>no</ul></nav><div class='side-bar ads'>no<div>no</div></div><main><h1 class=header>T</h1>yes</main>no", ["T", "yes"]),
    ("<header>no</header><article><header><h1>T</h1></header><p>x</p><aside>no</aside><section id=comments><article>no</article></section></article>", ["T", "x"]),
    ("<article><p>a</p><p class=notice>no<p>b</p><form><p>no</form><div hidden>no</div><article class='user-comment'>no</article>c</article>", ["a", "b", "c"]),
    ("<article>kept <a title='x>y'>link</a> text", ["kept link text"]), ("<div role=navigation>no</div><p>yes", ["yes"]),
    ("<body class='has-sidebar'><div id=content>yes<footer>no</footer></div><div class=footer>no", ["yes"]),
    ("<p>x</p><unclosed attr='", ["x"]),
]


@pytest.mark.parametrize(("html", "lines"), PAGES)
def test_lines(html, lines):
    assert page_lines(html)[0] == lines


def lcs_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
        row = new
    return row[-1]


def test_shared_lines_are_a_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(500):
        a, b = ([rng.randint(0, 6) for _ in range(rng.randint(0, 14))] for _ in range(2))
        places = shared_lines(a, b)
        assert places == sorted(set(places)) and len(places) == lcs_length(a, b)
        rest = iter(b)
        assert all(any(a[i] == y for y in rest) for i in places)


def site(n):
    rows = []
    for i in range(n):
        body = f"<div>Site menu</div><div>Story {i}</div><p>body of {i}</p><div>All rights reserved</div>"
        rows.append((i, f"http://hot.org/en/{i:04d}?q=1", f"<html>{body}"))
    rows.append((n, "http://alone.org/", "<div>Site menu</div><p>alone</p>"))
    rows.append((n + 1, None, "<div>Site menu</div>"))
    rows.append((n + 2, "http://hot.org/en/0003/x", "<div>Site menu</div><article><p>Site menu</p><p>x</p></article><p>All rights reserved"))
    return rows


def test_shared_furniture_goes_and_articles_stay(spark):
    rows = site(60)
    pages = spark.createDataFrame([(*r, "old") for r in rows], "page_id long, url string, html string, text string")
    found = {r.page_id: r for r in main_text(pages.repartition(7)).collect()}
    assert len(found) == len(rows)
    for i in range(60):
        assert found[i].text == f"Story {i} body of {i}"
    assert found[60].text == "Site menu alone" and found[61].text == "Site menu" and found[62].text == "Site menu x"
    assert all(r.n_chars == len(r.text) for r in found.values())


def test_odd_tables(spark):
    schema = "page_id long, url string, html string"
    page = (1, "http://a.org/x", "<p>same</p><p>é&eacute;</p>")
    rows = [page, page, page, (None, None, None), (2, "http://a.org/y", ""), (3, "http://a.org/z", "<p>w</p>" * 30000)]
    found = main_text(spark.createDataFrame(rows, schema)).collect()
    assert sorted(r.text[:20] for r in found) == sorted(["same éé"] * 3 + ["", "", "w " * 10])
    assert main_text(spark.createDataFrame([], schema)).collect() == []


def test_whole_table(spark):
    """These pages have one article of h1, p, b and br each."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in main_text(pages).collect():
        article = re.search("<article>(.*?)</article>", r.html, re.S)[1].replace("<b>", "").replace("</b>", "")
        blocks = [" ".join(unescape(x).split()) for x in re.split("</?(?:p|h1|br)>", article)]
        assert r.text == " ".join(b for b in blocks if b)
        assert r.n_chars == len(r.text)


@pytest.mark.parametrize("parts", [1, 40])
def test_runs_of_copies_have_partners(spark, parts):
    """Copies at neighbouring paths lose the furniture as their neighbours do, in one part or many."""
    page = "<div>Site menu</div><div>Story {0}</div><p>body of {0}</p><div>All rights reserved</div>"
    story = ["a", *"b" * 30, "c", *"d" * 3, "a"]
    rows = [(i, f"http://hot.org/en/{i:04d}", page.format(x), x) for i, x in enumerate(story)]
    rows += [(i, f"http://same.org/{i}", page.format("e"), None) for i in range(100, 105)]
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.enabled", False)
        pages = spark.createDataFrame(rows, "page_id long, url string, html string, x string")
        found = main_text(pages).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.enabled", before[1])
    assert len(found) == len(rows)
    for r in found:
        whole = "Site menu Story e body of e All rights reserved"
        assert r.text == (f"Story {r.x} body of {r.x}" if r.x else whole), r.page_id


def test_differences_decide_in_pages_with_an_article(spark):
    """A teaser article does not stand for the page; without partner the article is all there is to go by."""
    page = "<div>Site menu</div><div>Story {0}</div><article><p>teaser</p></article><div>All rights reserved</div>"
    rows = [(i, f"http://hot.org/en/{i}", page.format(i)) for i in range(5)] + [(9, "http://alone.org/", page.format(9))]
    found = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {**{i: f"Story {i} teaser" for i in range(5)}, 9: "teaser"}
