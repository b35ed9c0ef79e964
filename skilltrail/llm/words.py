"""Hashes of the words of whole texts, many texts at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalised 64-bit hashes: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _salts(n: int, seed: int) -> np.ndarray:
    step = np.uint64(0x9E3779B97F4A7C15)
    return mixed(np.arange(seed, seed + n, dtype=np.uint64) * step) | np.uint64(1)


_BYTE = _salts(256, 1 << 20)
_PLACE = _salts(4096, 1 << 30)


def plain_texts(texts: pa.Array) -> pa.Array:
    """Texts as an array of its own, not a slice of another; null becomes empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    return pa.concat_arrays([texts, pa.array([], pa.large_string())])


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words `[^\\x20\\x09-\\x0D]+` of each text with A-Z lower-cased, and each text's bounds."""
    texts = pc.ascii_lower(plain_texts(texts))
    lists = pc.ascii_split_whitespace(texts)
    words, bounds = lists.flatten(), lists.offsets.to_numpy()
    full = pc.greater(pc.binary_length(words), 0)
    keep = full.to_numpy(zero_copy_only=False)
    if not keep.all():
        bounds = np.concatenate([[0], np.cumsum(keep)])[bounds]
        words = words.filter(full)
    return words, bounds.astype(np.int64)


def spelled(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all words end to end, and where each begins and how long it is."""
    words = plain_texts(words)
    offsets = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset : words.offset + len(words) + 1]
    if not len(words) or offsets[-1] == offsets[0]:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
    data = np.frombuffer(words.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets[:-1] - offsets[0], np.diff(offsets)


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of non-empty words, the same in every process."""
    if not len(words):
        return np.zeros(0, dtype=np.uint64)
    data, starts, lengths = spelled(words)
    place = np.arange(len(data)) - np.repeat(starts, lengths)
    salts = _PLACE if lengths.max() <= len(_PLACE) else _salts(int(lengths.max()), 1 << 30)
    sums = np.add.reduceat(_BYTE[data] * salts[place], starts)
    return mixed(sums + lengths.astype(np.uint64))
