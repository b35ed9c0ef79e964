import random

import numpy as np
import pyarrow as pa
import pytest

from skilltrail.llm.token_files import checksums, read_tokens, write_tokens
from tokenizers import Tokenizer

from skilltrail.llm import tokens
from skilltrail.llm.tokens import Encoder, WordTable, encoder, public_path, with_end

ODD = ["", "  a  b ", "don't  stop\n\n x\t y", "é à b  c", "x" * 5000, "日本語 テスト　x", " lead", "trail "]
ALPHABET = " \n\tab,.'sé1日_½²́ΣİA"


@pytest.mark.parametrize(("name", "joined"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_cached_ids_equal_the_library(name, joined):
    random.seed(3)
    texts = ODD + ["".join(random.choices(ALPHABET, k=random.randint(0, 60))) for _ in range(3000)]
    words = encoder(public_path(name), joined)
    library = Tokenizer.from_file(public_path(name))
    for _ in range(2):
        flat, bounds = words.ids_of(pa.array(texts))
        for text, ids in zip(texts, np.split(flat, bounds[1:-1]), strict=True):
            assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
    part, _ = words.ids_of(pa.array(texts).slice(5, 90))
    assert part.tolist() == flat[bounds[5] : bounds[95]].tolist()
    assert words.ids_of(pa.array([None, ""], pa.string()))[1].tolist() == [0, 0, 0]


MARKS = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endof", "text|>"]


@pytest.mark.parametrize(("name", "joined"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_written_out_marks_are_what_the_library_makes_of_them(name, joined):
    random.seed(4)
    texts = ["hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|>b  <|startoftext|> c", *MARKS]
    texts += [" ".join(random.choices([*MARKS, "word", "", "x y", "\n"], k=9)) for _ in range(300)]
    flat, bounds = Encoder(public_path(name), joined).ids_of(pa.array(texts))
    library = Tokenizer.from_file(public_path(name))
    for text, ids in zip(texts, np.split(flat, bounds[1:-1]), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize(("name", "joined"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_full_caches_and_equal_hashes_change_no_id(name, joined, monkeypatch):
    """Generations that turn over, and hashes of which many are equal."""
    random.seed(5)
    monkeypatch.setattr(tokens, "CACHED_WORDS", 50)
    hashes = tokens.word_hashes
    monkeypatch.setattr(tokens, "word_hashes", lambda words: hashes(words) % np.uint64(40))
    library, words = Tokenizer.from_file(public_path(name)), Encoder(public_path(name), joined)
    for _ in range(6):
        texts = [" ".join(f"w{random.randint(0, 150)}é"[: random.randint(1, 6)] for _ in range(20)) for _ in range(30)]
        flat, bounds = words.ids_of(pa.array(texts))
        for text, ids in zip(texts, np.split(flat, bounds[1:-1]), strict=True):
            assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_words_with_signs_equal_the_library():
    random.seed(6)
    ends = tokens._ENDS + "'\\\"1é\u00a0­"
    made = ["".join(random.choices("abzÀÿ×÷éßA", k=random.randint(1, 8))) + "".join(random.choices(ends, k=random.randint(0, 3))) for _ in range(5000)]
    texts = [" ".join(made[i : i + 50]) for i in range(0, 5000, 50)]
    library = Tokenizer.from_file(public_path("byte_bpe_50k.json"))
    flat, bounds = Encoder(public_path("byte_bpe_50k.json"), True).ids_of(pa.array(texts))
    for text, ids in zip(texts, np.split(flat, bounds[1:-1]), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_word_table():
    table = WordTable()
    data = np.frombuffer(b"abcdabce", dtype=np.uint8)
    starts, lengths = np.array([0, 4]), np.array([4, 4])
    one, two = np.array([5, 9], dtype=np.uint64), np.array([5, 5], dtype=np.uint64)
    assert table.find(one, data, starts, lengths).tolist() == [-1, -1]
    table.add(one, data, starts, lengths, np.array([1, 2, 3], dtype="<u4"), np.array([1, 2]))
    assert table.find(one, data, starts, lengths).tolist() == [0, 1]
    assert table.find(two, data, starts, lengths).tolist() == [0, -1]


def test_with_end():
    flat, bounds = with_end(np.array([5, 6, 7], dtype="<u4"), np.array([0, 0, 2, 3]), 0)
    assert flat.tolist() == [0, 5, 6, 0, 7, 0]
    assert bounds.tolist() == [0, 1, 4, 6]


def test_round_trip(spark, tmp_path):
    import zlib

    texts = [*ODD, None, "same", "same", "b"]
    rows = [(i % 9 if i else None, t, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(3)
    path = str(tmp_path / "tokens")
    write_tokens(docs, path)
    got = checksums(read_tokens(spark, path)).orderBy("start").collect()
    assert len(got) == len(texts)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x))
    library = Tokenizer.from_file(public_path("byte_bpe_50k.json"))
    start, want = 0, set()
    for number, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        want.add((number, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
    assert {(r.doc_id, r.n_tokens, r.ids_crc32) for r in got} == want
    for row in got:
        assert row.start == start
        start += row.n_tokens


def test_empty(spark, tmp_path):
    path = str(tmp_path / "tokens")
    write_tokens(spark.createDataFrame([], "doc_id long, text string"), path)
    assert checksums(read_tokens(spark, path)).collect() == []
