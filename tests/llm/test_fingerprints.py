import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skilltrail.llm import fingerprints as fp

MASK = (1 << 64) - 1
FACTOR, STEP = 0xD6E8FEB86659FD93, 0x9E3779B97F4A7C15


def mixed(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
    return x ^ (x >> 31)


def kmer(text, power=FACTOR):
    value = 0
    for c in text:
        value = (value * power + ord(c) + 1) & MASK
    return mixed((value + len(text) * STEP) & MASK)


def plain(text, k=fp.KMER, size=fp.TUPLE, slots=fp.SLOTS):
    """The same by plain loops over a text's k-mers."""
    n = len(text)
    if not n:
        return "0000" * slots
    sizes = [k] if n >= 4 * k else range(min(n, max(1, n // 4)), min(n, k) + 1)
    listed = [kmer(text[i : i + s]) for i in range(n) for s in sizes if i + s <= n]
    seen, ring = {}, []
    for at, h in enumerate(listed):
        seen[h] = seen.get(h, 0) + 1
        ring.append((mixed((h + seen[h] * STEP) & MASK) >> 24, at))
    ring.sort()
    out = []
    for j in range(slots):
        point = (j << 40) // slots
        begin = sum(h < point for h, _ in ring)
        chosen = sorted(ring[(begin + i) % len(ring)][1] for i in range(min(size, len(ring))))
        value = len(chosen)
        for at in chosen:
            value = mixed((value * FACTOR + listed[at]) & MASK)
        out.append(f"{value >> 48:04x}")
    return "".join(out)


def some_text(rng, n, alphabet="abcdefgh é日\U0001f600"):
    return "".join(rng.choices(alphabet, k=n))


@pytest.mark.parametrize(("k", "size", "slots"), [(5, 2, 64), (1, 1, 3), (7, 3, 16), (12, 2, 64), (2, 4, 5)])
def test_equals_plain_loops(k, size, slots):
    rng = random.Random(5)
    texts = ["", "a", "ab", "a" * 500, "ab" * 40, *(some_text(rng, n) for n in range(2, 120, 5))]
    for text in texts:
        assert fp.fingerprint(text, k, size, slots) == plain(text, k, size, slots)
    assert fp.fingerprint(None, k, size, slots) == fp.fingerprint("", k, size, slots)


def test_texts_beyond_one_word_sort_alike():
    keys = np.random.default_rng(6).integers(0, 1 << 63, 20000, dtype=np.uint64)
    keys[5000:9000] = keys[:4000]
    for a, b in zip(fp._sorted_places(keys), fp._sorted_places(keys, most=0), strict=True):
        assert a.tolist() == b.tolist()


def test_follows_order_and_edits():
    rng = random.Random(7)
    text = some_text(rng, 4000, "abcdefghijklmnopqrstuvwxyz ")
    slots = lambda x: fp.slots_of(fp.code_points(x), slots=512)
    one_edit = text[:2000] + "#" + text[2001:]
    swapped = text[2000:] + text[:2000]
    quarter = text[:3000] + some_text(rng, 1000, "abcdefghijklmnopqrstuvwxyz ")
    other = some_text(rng, 4000, "abcdefghijklmnopqrstuvwxyz ")
    near = [fp.share_equal(slots(text), slots(x)) for x in (text, one_edit, quarter, other)]
    assert near[0] == 1 and near[1] > 0.97
    # 0.6 of the k-mers of either text are shared, so about 0.36 of the pairs are.
    assert abs(near[2] - 0.36) < 0.08 and near[3] < 0.02
    # The same k-mers, but half of the pairs in the other order.
    assert 0.35 < fp.share_equal(slots(text), slots(swapped)) < 0.65


def plain_rows(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out = set()
    for (doc_id, text), (_, following) in zip(order, order[1:] + order[:1], strict=True):
        text, following = text or "", following or ""
        cut = len(text) // 4
        new = text[: len(text) - cut] + following[:cut]
        mine, theirs, changed = plain(text), plain(following), plain(new)
        same = lambda a, b: sum(a[i : i + 4] == b[i : i + 4] for i in range(0, len(a), 4)) / fp.SLOTS
        out.add((
            doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), mine, changed,
            same(mine, changed), same(mine, theirs),
        ))
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_neighbours_equal_plain_loops(spark, parts):
    rng = random.Random(8)
    rows = [(i * 37 % 101 - 50, some_text(rng, rng.randint(0, 90))) for i in range(60)]
    rows += [(200 + i, "copy of one text, copy of one text") for i in range(30)]
    rows += [(None, "no number"), (300, None), (301, ""), (302, "x"), (303, "long " * 3000)]
    docs = spark.createDataFrame(
        [(*r, "p", True) for r in rows], "doc_id long, text string, part string, opens boolean"
    ).repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = [tuple(r) for r in fp.neighbours(docs).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(found) == len(rows) and set(found) == plain_rows(rows)


def test_one_row_equal_rows_and_none(spark):
    one = spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")
    (row,) = fp.neighbours(one).collect()
    assert row.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and row.near_next == 1
    equal = spark.createDataFrame([(1, "abcd")] * 9 + [(None, None)] * 2, "doc_id long, text string")
    found = fp.neighbours(equal).collect()
    assert sorted(r.n_chars for r in found) == [0, 0] + [4] * 9
    assert fp.neighbours(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_column_and_likeness(spark):
    rows = [(1, "some text of words", "x"), (2, "some text of wards", "y"), (3, None, None), (4, "", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    marked = fp.fingerprinted(docs)
    assert marked.columns == ["doc_id", "text", "fingerprint"]
    got = {r.doc_id: r.fingerprint for r in marked.collect()}
    assert got == {i: plain(t or "") for i, t, _ in rows}
    pairs = marked.alias("a").join(marked.alias("b"), F.col("a.doc_id") <= F.col("b.doc_id"))
    for r in pairs.select("a.doc_id", F.col("b.doc_id").alias("e"), fp.likeness("a.fingerprint", "b.fingerprint").alias("s")).collect():
        a, b = got[r.doc_id], got[r.e]
        assert r.s == sum(a[i : i + 4] == b[i : i + 4] for i in range(0, 256, 4)) / 64
