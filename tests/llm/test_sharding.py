import zlib
from collections import defaultdict

import pytest

from skilltrail.llm.sharding import shard_documents


def check(rows, found, shards, slack):
    assert len(found) == len(rows)
    held, sizes = defaultdict(list), defaultdict(int)
    for r in found:
        text = r.text or ""
        assert r["size"] == len(text.encode()) + 8
        assert r.text_crc32 == zlib.crc32(text.encode())
        assert (r.law, r.grown_shard) == ("bytes", None)
        assert 0 <= r.shard < shards
        held[r.shard].append(r.slot)
        sizes[r.shard] += r["size"]
    for slots in held.values():
        assert sorted(slots) == list(range(len(slots)))
    fair = sum(sizes.values()) / shards
    for s in range(shards):
        assert abs(sizes[s] - fair) <= slack + 0.002 * fair


@pytest.mark.parametrize("part_bytes", [32 << 20, 2000])
def test_a_third_of_rows_in_one_text(spark, part_bytes):
    rows = [(i * 7919 % 3001 - 1500, "hot" if i % 3 == 0 else f"text {i} é" * (i % 5), "x") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string").repartition(5)
    found = shard_documents(docs, 8, part_bytes=part_bytes).collect()
    check(rows, found, 8, 120)
    homes = defaultdict(set)
    for r in found:
        homes[r.text].add(r.shard)
    assert len(homes["hot"]) >= 2
    assert sum(len(x) > 1 for text, x in homes.items() if text not in ("hot", "")) == 0


def test_odd_rows(spark):
    rows = [(None, None), (None, "a"), (5, ""), (5, "b"), (5, "b"), (-(1 << 63), "b"), ((1 << 63) - 1, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(rows, shard_documents(docs, 3).collect(), 3, 30)


def test_one_long_text_and_more_shards_than_rows(spark):
    rows = [(1, "x" * 100000), (2, "y"), (3, "z")]
    found = shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 24).collect()
    assert len(found) == 3 and all(r.slot >= 0 for r in found)


def test_empty(spark):
    found = shard_documents(spark.createDataFrame([], "doc_id long, text string"))
    assert found.collect() == []
    assert {"doc_id", "size", "shard", "slot"} <= set(found.columns)
