import random

import pytest

from skilltrail.llm.decontamination import all_least_edits, benchmark_hits, decontaminated, edits_within, may_be_within


def brute(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_edits_equal_brute_force():
    rng = random.Random(6)
    for _ in range(300):
        item, text = ("".join(rng.choices("abc é", k=rng.randint(0, 12))) for _ in range(2))
        want = brute(item, text)
        for most in (0, 2, 20):
            assert edits_within(item, text, most) == (want if want <= most else None)
            assert want > most or may_be_within(item, text, most)


def invented(rng, n):
    return [("".join(rng.choices("abcdefgh", k=rng.randint(1, 8)))) for _ in range(n)]


@pytest.fixture(scope="module")
def planted():
    """Items, and texts with an item of a known number of edits, or none."""
    rng = random.Random(8)
    items = [(i, " ".join(invented(rng, n))) for i, n in enumerate([3, 8, 15, 16, 30, 70] * 5)]
    rows, edited = [], {}
    for number in range(600):
        item, text = items[number % len(items)]
        chars = list(text)
        for _ in range(rng.randint(0, len(chars) // 25)):
            at = rng.randrange(len(chars))
            chars[at : at + 1] = rng.choice([[], [rng.choice("xyz")], [chars[at], "q"]])
        words = invented(rng, rng.randint(0, 200))
        at = rng.randint(0, len(words))
        body = "".join(chars) if number % 3 else ""
        rows.append((number, " ".join([*words[:at], body.upper() if number % 2 else body, *words[at:]]), item))
        if body:
            edited[number] = item
    return items, rows, edited


def test_recall_and_precision_against_planted(spark, planted):
    items, rows, edited = planted
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id long")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.edits for r in benchmark_hits(docs, bench).collect()}
    texts = dict(items)
    lower = {n: " ".join(t.lower().split()) for n, t, _ in rows}
    truth = {
        (n, i) for n, i in edited.items() if brute(texts[i], lower[n]) <= int(len(texts[i]) * 0.2)
    }
    for n, i in found:
        assert brute(texts[i], lower[n]) <= int(len(texts[i]) * 0.2)
    exact = {(n, i) for n, i in truth if texts[i] in lower[n]}
    assert exact <= set(found)
    assert len(truth & set(found)) >= 0.9 * len(truth)
    # In blocks of one item each nothing changes, and dropping follows the hits.
    blocks = benchmark_hits(docs, bench.limit(4), 1).collect()
    assert {(r.doc_id, r.item_id) for r in blocks} == {x for x in found if x[1] < 4}
    kept = decontaminated(docs, bench)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {n for n, _, _ in rows} - {n for n, _ in found}


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, None), (None, ""), (2, "Some  WORDS\nhere now"), (2, "Some  WORDS\nhere now"), (3, "x" * 200000)],
        "doc_id long, text string",
    )
    bench = spark.createDataFrame([(None, "some words here"), (7, None), (8, ""), (9, "here")], "item_id long, text string")
    found = sorted((r.doc_id, r.item_id or 0, r.edits, r.begin_word) for r in benchmark_hits(docs, bench).collect())
    assert found == [(2, 0, 0, 0), (2, 0, 0, 0), (2, 9, 0, 2), (2, 9, 0, 2)]
    assert decontaminated(docs, bench).count() == 3
    assert benchmark_hits(docs.limit(0), bench).collect() == []
    assert benchmark_hits(docs, bench.limit(0)).collect() == []
    assert decontaminated(docs, bench.limit(0)).count() == 5


def test_distances_in_step_equal_brute_force():
    rng = random.Random(16)
    texts = ["".join(rng.choices("abc é", k=rng.randint(1, 300))) for _ in range(80)]
    items = ["".join(rng.choices("abc é", k=rng.choice([1, 5, 63, 64, 65, 128, 150]))) for _ in range(80)]
    found, ends = all_least_edits(items, texts)
    for item, text, edits, end in zip(items, texts, found.tolist(), ends.tolist(), strict=True):
        assert edits == brute(item, text) == brute(item[::-1], text[:end][::-1])


@pytest.mark.parametrize("share", [0.05, 0.1, 0.2])
def test_every_edited_copy_is_found(spark, share):
    """Random edits, and one at equal steps, so that few words and no long run of letters stay whole."""
    rng = random.Random(int(share * 100))
    items = [(i, " ".join(invented(rng, n))) for i, n in enumerate([1, 2, 3, 8, 15, 16, 30, 70] * 3)]
    rows = []
    for number in range(240):
        chars = list(items[number % len(items)][1])
        count = int(len(chars) * share)
        places = [int((i + 0.5) / share) for i in range(count)] if number % 2 else rng.choices(range(len(chars)), k=count)
        for at in sorted(places, reverse=True):
            at = min(at, len(chars) - 1)
            chars[at : at + 1] = rng.choice([[], [rng.choice("xyzé")], [chars[at], "q"]])
        around = [" ".join(invented(rng, rng.randint(0, 60))) for _ in range(2)]
        rows.append((number, f"{around[0]} {''.join(chars)} {around[1]}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.edits for r in benchmark_hits(docs, bench, exact=True).collect()}
    for number, text in rows:
        text, (item_id, item) = " ".join(text.lower().split()), items[number % len(items)]
        edits = brute(item, text)
        assert found.get((number, item_id)) == (edits if edits <= int(len(item) * 0.2) else None)


@pytest.mark.parametrize("share", [0.03, 0.05, 0.1, 0.15, 0.2])
def test_walks_find_nine_of_ten_edited_copies(spark, share):
    """Recall against brute force over random edits of items as long as a benchmark's."""
    rng = random.Random(int(share * 1000))
    items = [(i, " ".join(invented(rng, n))) for i, n in enumerate([18, 25, 33, 40, 70] * 6)]
    rows = []
    for number in range(300):
        chars = list(items[number % len(items)][1])
        for at in sorted(rng.sample(range(len(chars)), int(len(chars) * share)), reverse=True):
            chars[at : at + 1] = rng.choice([[], [rng.choice("xyzé")], [chars[at], "q"]])
        around = [" ".join(invented(rng, rng.randint(0, 60))) for _ in range(2)]
        rows.append((number, f"{around[0]} {''.join(chars)} {around[1]}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    truth = {(r.doc_id, r.item_id): (r.edits, r.begin_word) for r in benchmark_hits(docs, bench, exact=True).collect()}
    found = {(r.doc_id, r.item_id): (r.edits, r.begin_word) for r in benchmark_hits(docs, bench).collect()}
    assert len(truth) >= 300 * 0.95
    assert len(found) >= 0.9 * len(truth) and found.keys() <= truth.keys()
    assert all(found[key] == truth[key] for key in found)


def test_long_items(spark):
    """Items longer than what is searched at a time, at all places of a text."""
    rng = random.Random(5)
    items = [(i, " ".join(invented(rng, 4500))) for i in range(2)]
    rows = [(i, " ".join([*invented(rng, 2500 * i), items[i % 2][1], "end"])) for i in range(4)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id): (r.edits, r.begin_word) for r in benchmark_hits(docs, bench).collect()}
    assert found == {(i, i % 2): (0, 2500 * i) for i in range(4)}
