import html
import time

import pytest

import registry
from skilltrail.functions import charts, text as X
from pyspark.sql import functions as F


def test_normalise_folds_in_order(one):
    text = "Co-Operation, R&D, Non-Profit re-use software-based"
    assert one(X.normalise, text) == "cooperation randd nonprofit reuse softwarebased"


@pytest.mark.parametrize("text", ["software-x", "Data - Entry", "a-b,c&d", "NON-re-CO-x"])
def test_normalise_is_plain_replacement(one, text):
    want = text.lower()
    for old, new in X.SPELLING_FOLDS:
        want = want.replace(old, new)
    assert one(X.normalise, text) == want.replace("-", " ")


def test_format_skill_and_career(one):
    assert one(X.format_skill, "  Co-Op \t") == "coop"
    assert one(X.format_career, "Data Scientist") == "data+scientist"


def test_display(one):
    assert one(X.career_display, "import/export+r&d+clerk") == "Import/Export R&D Clerk"
    assert one(X.career_display, "o'neil's+3d+artist") == "o'neil's 3d artist".title()


def test_location(one):
    assert one(X.clean_location, "Austin, TX 78701 (Downtown area)") == "Austin, TX"
    assert one(X.clean_location, "Remote") == "Remote"


def test_urls(one):
    assert one(X.url_key, "http://jobs.example.com/rc/clk?jk=1") == "/rc/clk?jk=1"
    assert one(lambda c: X.listing_link("http://a.example/", c), "/rc/1") == "http://a.example/rc/1"


@pytest.mark.parametrize("path,allowed", [("a.b.PDF", True), ("pdf", False), ("x.doc", False)])
def test_extension(one, path, allowed):
    assert one(X.has_allowed_extension, path) is allowed


def test_visible_text(one):
    html = (
        "<html><head><title>T</title><style>p{}</style></head><body><script>var t='</p>';</script>"
        "<nav>Menu</nav>\n\n  <p>R&amp;D &lt;lead&gt;<br> role &#233;t&#xE9; &amp;lt;</p> \n <!-- x\n y -->end"
        "<header>!</header></body></html>"
    )
    assert one(X.visible_text, html) == "Menu R&D <lead> role été &lt; end!"


def test_unescape_resolves_every_reference_once(one):
    given = (
        "caf&eacute; &copy 2015 &#x10FFFD; &#1114109; &#0000065; &#38;lt; &amp;lt; &#65 &#x41x &notit; &ampx; "
        "&nope; & &; &#; &#0; &#xD800; &#9999999999; &#128; &#x9F; &NotEqualTilde; &am &CounterClockwiseContourIntegral;"
    )
    assert one(X.unescape, given) == html.unescape(given)
    assert one(X.unescape, None) is None and one(X.unescape, "") == ""


def test_unescape_of_a_text_of_references_alone(one):
    text = "aé😀"
    start = time.time()
    assert one(X.unescape, "".join(f"&#{ord(c)};&#x{ord(c):X};" for c in text) * 150_000) == "aaéé😀😀" * 150_000
    assert time.time() - start < 8


def test_decoded_references_give_the_texts(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, "a\x01&amp;\né😀\x00" * 3), (4, "x"), (4, "x")]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    found = [tuple(r) for r in registry.decoded_references(spark, str(tmp_path)).collect()]
    # The standard reads no character in the number 0.
    want = [(i, x and x.replace("\x00", "\ufffd")) for i, x in rows]
    assert sorted(found, key=str) == sorted(want, key=str)


def test_titles(one):
    assert one(X.title_career, "Director, Design and Product Development") == (
        "director+design+and+product+development"
    )
    assert one(X.title_career, "Applications Specialist​ ") == "applications+specialist"


def test_chart_numbers(spark):
    frame = spark.createDataFrame([(0.3,), (0.2,)], "s double")
    widths = [
        r.w for r in frame.select(
            charts.edge_width(F.col("s"), F.lit(0.2), F.lit(0.3)).alias("w")
        ).collect()
    ]
    assert widths == pytest.approx([4.0, 16 / 9])
    score = spark.range(1).select(charts.bar_score(F.lit(0.5), F.lit(2)).alias("v")).first()["v"]
    assert score == pytest.approx(2.0)
    tiers = spark.createDataFrame([(0.9,), (1.0,), (2.5,), (3.0,), (9.0,)], "s double").select(
        charts.strength_tier(F.col("s")).alias("t")
    )
    assert [r.t for r in tiers.collect()] == ["", "Weak", "Medium", "Strong", "Very Strong"]
