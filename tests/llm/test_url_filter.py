import math
import random
from collections import Counter
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa

from skilltrail.llm.quality_model import text_bytes
from skilltrail.llm.url_filter import ORDER, SMOOTHING, filtered, fitted, op9_url_filter, scored, with_rules

URLS = [
    (None, "", "", None), ("", "", "", None), ("no scheme.com/", "", "", None), ("://", "", "", None),
    ("http://A.Example.COM/en/x", "a.example.com", "/en/x", "block"),
    ("http://www.example.com/en/", "www.example.com", "/en/", "allow"),
    ("http://x.www.example.com/en/1?u=/es/", "x.www.example.com", "/en/1", "allow"),
    ("http://example.com/EN/", "example.com", "/EN/", "allow"), ("http://notexample.com/en/", "notexample.com", "/en/", "allow"),
    ("http://com/", "com", "/", "allow"), ("http://com", "com", "", None), ("http://telecom/", "telecom", "/", None),
    ("ftp://b.net/es/?a#b", "b.net", "/es/", "block"), ("ftp://b.net/fr/a/b#c", "b.net", "/fr/a/b", "block"),
    ("x://b.net?/es/", "b.net", "", None), ("x://b.net#/fr/", "b.net", "", None), ("a://b://c.com/", "b:", "//c.com/", None),
    ("http://b.com/\nline", "b.com", "/\nline", "allow"), ("http://É.com/é", "É.com", "/é", "allow"),
]


def test_parts_and_rules(spark):
    rows = [(i, url, "old") for i, (url, *_) in enumerate(URLS)]
    got = with_rules(spark.createDataFrame(rows, "page_id long, url string, host string")).collect()
    for r in got:
        _, host, path, verdict = URLS[r.page_id]
        assert (r.host, r.path, r.verdict) == (host, path, verdict), r.url
    by = {r.url: r.rule for r in got}
    assert by["http://A.Example.COM/en/x"] == "example.com/en/"
    assert by["http://www.example.com/en/"] == "www.example.com/en/"
    assert by["http://com/"] == "com/"


def brute(accepted, rejected, url):
    """The score by plain counts of contexts."""
    logs = []
    for some in (accepted, rejected):
        seen, both = Counter(), Counter()
        for u in some:
            data = [0] * ORDER + [b + 1 for b in u.encode()] + [0]
            for i in range(ORDER, len(data)):
                for n in range(ORDER + 1):
                    seen[tuple(data[i - n : i])] += 1
                    both[tuple(data[i - n : i]), data[i]] += 1
        data = [0] * ORDER + [b + 1 for b in url.encode()] + [0]
        total = 0.0
        for i in range(ORDER, len(data)):
            p = 1 / 257
            for n in range(ORDER + 1):
                c = tuple(data[i - n : i])
                p = (both[c, data[i]] + SMOOTHING * p) / (seen[c] + SMOOTHING)
            total += math.log(p)
        logs.append(total / (len(url.encode()) + 1))
    return logs[0] - logs[1]


def test_scores_equal_plain_counts(spark):
    rng = random.Random(1)
    good = [f"http://news{rng.randint(1, 30)}.org/en/{rng.randint(1, 99)}" for _ in range(40)]
    bad = [f"http://pills-{rng.randint(1, 30)}.org/buy?ref={rng.randint(1, 99)}" for _ in range(40)]
    rows = [(u, True) for u in good] + [(u, False) for u in bad] + [(None, True), (good[0], True), ("x", None)]
    model = fitted(spark.createDataFrame(rows, "url string, accepted boolean").repartition(3))
    tried = [good[0], bad[0], "", "http://news1.org/en/7", "http://pills-2.org/buy"]
    found = model.scores(*text_bytes(pa.array(tried)))
    for url, score in zip(tried, found, strict=True):
        assert abs(score - brute(set(good), set(bad), url)) < 0.05  # hashed cells meet now and then
    verdicts = [s >= model.threshold for s in model.scores(*text_bytes(pa.array(good + bad)))]
    assert np.mean(np.array(verdicts) == np.array([True] * 40 + [False] * 40)) > 0.95


def test_odd_tables(spark):
    schema = "page_id long, url string, verdict string"
    rows = [(i, url, "x") for i, (url, *_) in enumerate(URLS)] * 2
    got = filtered(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == len(rows) and all(r.verdict in ("allow", "block") for r in got)
    assert filtered(spark.createDataFrame([], schema)).collect() == []
    one = filtered(spark.createDataFrame([(1, "http://a.org/", "x"), (None, None, None)], schema)).collect()
    assert [r.verdict for r in one] == ["allow", "allow"]


def test_whole_table(spark):
    sf_dir = "/root/testdata/sf0.01"
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = op9_url_filter(spark, sf_dir).collect()
    assert len(got) == len(pages)
    for r in got:
        parts = urlsplit(pages[r.page_id])
        assert (r.host, r.path) == (parts.netloc.lower(), parts.path)


def test_counts_stay_exact_for_many_contexts(spark):
    """About 190,000 distinct contexts of five characters: scores equal plain counts."""
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789-_~"
    rows = [("http://" + "".join(rng.choices(letters, k=40)), i % 2 == 0) for i in range(5000)]
    model = fitted(spark.createDataFrame(rows, "url string, accepted boolean"))
    tried = [rows[0][0], rows[1][0], "http://abc-def"]
    found = model.scores(*text_bytes(pa.array(tried)))
    sides = [{u for u, accepted in rows if accepted is side} for side in (True, False)]
    frame = spark.createDataFrame([(u,) for u in [*tried, tried[0], None]], "url string")
    whole = {r.url: r.score for r in scored(frame, model).collect()}
    for url, score in zip(tried, found, strict=True):
        assert abs(score - brute(*sides, url)) < 1e-9
        assert abs(whole[url] - score) < 1e-12
    assert abs(whole[None] - brute(*sides, "")) < 1e-9
