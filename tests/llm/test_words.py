import random
import re

import pyarrow as pa

from skilltrail.llm.words import split_words, word_hashes


def test_words_and_hashes():
    rng = random.Random(4)
    texts = [None, "", " ", "A\x0bB\x0c c\td\re\nÄ", "x" * 5000, "x" * 5001]
    texts += ["".join(rng.choices("aBÉ \n\x00\x1c ", k=rng.randint(0, 40))) for _ in range(500)]
    words, bounds = split_words(pa.array(texts))
    hashes, listed = word_hashes(words), words.to_pylist()
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for text, a, b in zip(texts, bounds, bounds[1:], strict=False):
        assert listed[a:b] == re.findall("[^\x20\x09-\x0d]+", (text or "").translate(lower))
    assert len({w: h for w, h in zip(listed, hashes.tolist(), strict=True)}) == len(set(hashes.tolist()))
    part, part_bounds = split_words(pa.array(texts).slice(3, 50))
    assert part.to_pylist() == listed[bounds[3] : bounds[53]]
    assert part_bounds.tolist() == (bounds[3:54] - bounds[3]).tolist()
    assert len(word_hashes(words.slice(0, 0))) == 0
    assert word_hashes(words.slice(7, 3)).tolist() == hashes[7:10].tolist()
