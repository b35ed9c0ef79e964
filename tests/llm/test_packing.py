import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from skilltrail.llm.packing import bins_of, crossover, evolve, pack, pack_documents, pieces, sequences
from skilltrail.llm.tokens import public_path


def check(found, capacity):
    held = defaultdict(list)
    for r in found:
        held[r.sequence_id].append((r.offset, r.length))
    for members in held.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


def test_crossover_keeps_each_piece_once():
    rng = random.Random(1)
    lengths = [rng.randint(1, 100) for _ in range(300)]
    one = bins_of(evolve(lengths, 100, [], 1, 0, 1), lengths, 100)
    other = bins_of(evolve(lengths, 100, [], 2, 0, 3), lengths, 100)
    for _ in range(20):
        one = crossover(one, other, rng)
        assert sorted(i for m in one.members for i in m) == list(range(300))
        assert all(f >= 0 for f in one.free)
        assert one.free == [100 - sum(lengths[i] for i in m) for m in one.members]


@pytest.mark.parametrize("block", [50, 5000])
def test_pack_near_the_lower_bound(spark, block):
    rng = random.Random(2)
    rows = [(i // 2, rng.choice([rng.randint(1, 100), 100, 3])) for i in range(1500)]
    table = spark.createDataFrame(rows, "offset long, length long").withColumnRenamed("offset", "other")
    found = pack(table, 100, block_pieces=block).collect()
    assert sorted((r.other, r.length) for r in found) == sorted(rows)
    assert check(found, 100) <= 1.03 * sum(n for _, n in rows) / 100 + 1


def test_documents(spark):
    rows = [(1, None), (2, ""), (None, "a b"), (4, "word " * 9000), (5, "same"), (5, "same"), (6, "x" * 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = pack_documents(docs).collect()
    check(found, 4096)
    library = Tokenizer.from_file(public_path("word_bpe_49k.json"))
    want = []
    for number, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        for piece, start in enumerate(range(0, len(ids), 4096)):
            some = np.array(ids[start : start + 4096], dtype="<u4")
            want.append((number, piece, start, len(some), zlib.crc32(some.tobytes())))
    got = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_sequences_hold_the_ids(spark):
    docs = spark.createDataFrame([(i, "some words " * (i % 7)) for i in range(60)], "doc_id long, text string")
    table = pieces(docs, 40)
    packed = pack(table.select("doc_id", "piece", "start", "length"), 40)
    whole = {r.sequence_id: bytes(r.ids) for r in sequences(table, packed).collect()}
    ids = {(r.doc_id, r.piece): bytes(r.ids) for r in table.collect()}
    for r in packed.collect():
        at = 4 * r.offset
        assert whole[r.sequence_id][at : at + 4 * r.length] == ids[r.doc_id, r.piece]


def test_empty(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
