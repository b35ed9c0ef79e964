import random
import re
from collections import Counter

from skilltrail.llm.quality_rules import host_rates, judged, measured

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed


def texts():
    rng = random.Random(5)
    odd = [None, "", "   ", "\n\n", "a", "x y \x00 z\x0bq", "one two " * 400, "é😀 #*$%&|<>\n" * 9, "w" * 9000]
    few = ["a", "b", "c\n", "d\t", "#", "é", ""]
    return odd + ["\n".join(" ".join(rng.choices(few, k=rng.randint(0, 40))) for _ in range(3)) for _ in range(300)]


def test_measures_equal_brute_force(spark):
    rows = [(i, t, "old") for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    for r in measured(docs).collect():
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert got == brute(r.text), repr(r.text)


def test_hosts_are_shrunk_and_joined_back(spark):
    rows = []
    for host, n, bad in [("good", 200, 10), ("bad", 200, 190), ("tiny", 1, 1), (None, 4, 2)]:
        rows += [(len(rows) + i, host, i < bad) for i in range(n)]
    table = spark.createDataFrame(rows, "doc_id long, source string, base_failed boolean")
    rates = {r._host: r.host_rate for r in host_rates(table).collect()}
    assert set(rates) == {"good", "bad", "tiny"}
    assert rates["good"] < 0.1 and rates["bad"] > 0.9 and rates["tiny"] < 1.0
    found = judged(table).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.kept == (not r.base_failed and r.source != "bad")


def test_no_failures_and_no_rows(spark):
    schema = "doc_id long, source string, base_failed boolean"
    table = spark.createDataFrame([(1, "a", False), (1, "a", False), (2, None, False)], schema)
    assert [r.kept for r in judged(table).collect()] == [True] * 3
    assert judged(spark.createDataFrame([], schema)).collect() == []
    assert measured(spark.createDataFrame([], "doc_id long, text string")).collect() == []
