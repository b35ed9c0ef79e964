"""Token ids of whole texts from a public vocabulary file, cached word by word.

A text is cut at spaces where no token of the vocabulary can cross, and the ids of its words
are looked up in a table sorted by hash; only unseen words become strings and go through the
`tokenizers` library. The ids equal those of one call over the whole text: texts that hold an
added token (such as an end mark written out), which is found before words are, take that call.
"""

from __future__ import annotations

import ctypes
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

from skilltrail.llm.words import plain_texts, spelled, word_hashes

#: Words in each of the two generations of a worker's cache; longer words are not kept.
CACHED_WORDS = 1 << 19
CACHED_LENGTH = 48
#: Rows that Spark hands to a task's Python at once; whole texts are large rows.
BATCH_ROWS = 512
#: Bytes of text that are encoded together.
BATCH_BYTES = 2 << 20

_INNER_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: Words of these characters may be encoded in one call, as they contain no mark.
_PLAIN_WORD = "^[!-{}~À-ÿ]+$"
#: Words of letters, with or without signs behind them: byte-level vocabularies cut them there
#: and nowhere else before their merges.
_ENDS = "!\"#$%&()*+,-./:;<=>?@[]^_`{|}~"
_LETTERS = "^[A-Za-zÀ-ÖØ-öø-ÿ]+[" + re.escape(_ENDS) + "]*$"
#: Byte-level vocabularies write a space as the first of these and bytes without a sign of their
#: own as the others (fixed values of the format).
_SPACE = "Ġ"
_SIGNS = {b: 256 + i for i, b in enumerate([*range(0x21), *range(0x7F, 0xA1), 0xAD])}


def _runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of runs laid end to end."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


class _Pool:
    """An array that grows at its end."""

    def __init__(self, dtype: str):
        self.held, self.size = np.zeros(1024, dtype=dtype), 0

    def add(self, values: np.ndarray) -> int:
        """Append values; returns where they begin."""
        start, self.size = self.size, self.size + len(values)
        if self.size > len(self.held):
            grown = np.zeros(max(self.size, len(self.held) * 3 // 2), dtype=self.held.dtype)
            grown[:start] = self.held[:start]
            self.held = grown
        self.held[start : self.size] = values
        return start


class WordTable:
    """Ids of words, sorted by hash. A hit is compared letter by letter, so that it is exact."""

    def __init__(self):
        self.keys = np.zeros(0, dtype=np.uint64)
        #: By word: start and length of its ids, start and length of its letters.
        self.spans = np.zeros((4, 0), dtype=np.int64)
        self.ids, self.letters = _Pool("<u4"), _Pool("u1")

    def find(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The row of each word, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        rows = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        same = (self.keys[rows] == keys) & (self.spans[3, rows] == lengths)
        hit = np.flatnonzero(same)
        own = data[_runs(starts[hit], lengths[hit])]
        held = self.letters.held[_runs(self.spans[2, rows[hit]], lengths[hit])]
        if not np.array_equal(own, held):
            ends = np.cumsum(lengths[hit])
            wrong = np.searchsorted(ends, np.flatnonzero(own != held), side="right")
            same[hit[wrong]] = False
        return np.where(same, rows, -1)

    def add(
        self,
        keys: np.ndarray,
        data: np.ndarray,
        starts: np.ndarray,
        lengths: np.ndarray,
        ids: np.ndarray,
        counts: np.ndarray,
    ) -> None:
        """Words in the order of their keys, with their ids end to end; a key that is held stays."""
        at = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), dtype=bool)
        inside = at < len(self.keys)
        new[inside] = self.keys[at[inside]] != keys[inside]
        new[1:] &= keys[1:] != keys[:-1]
        first = self.ids.add(ids)
        letters = self.letters.add(data[_runs(starts, lengths)])
        spans = np.stack(
            [first + np.cumsum(counts) - counts, counts, letters + np.cumsum(lengths) - lengths, lengths]
        )
        self.keys = np.insert(self.keys, at[new], keys[new])
        self.spans = np.insert(self.spans, at[new], spans[:, new], axis=1)


class _Cache:
    """Two generations of words as they stand after `lead`: the older one goes when the younger is full."""

    def __init__(self, lead: str):
        self.lead = lead
        self.young, self.old = WordTable(), WordTable()


class Encoder:
    """Ids of whole texts as little-endian 32-bit numbers.

    `joined` says that a space belongs to the word after it and that case counts
    (byte-level vocabularies); otherwise white space only separates and case does not count.
    """

    def __init__(self, path: str, joined: bool):
        # One thread per task: Spark has the cores.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.joined = joined
        # Set between words that are encoded in one call; no plain word contains it.
        self.mark = "\n" if joined else " | "
        (self.mark_id,) = self.tokenizer.encode(self.mark, add_special_tokens=False).ids
        self.words = _Cache(" " if joined else "")
        self.openers = _Cache("")
        self.signs: dict[str, list[int]] = {}

    def _direct(self, pieces: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4") for x in found]

    def _marked(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain words, encoded as one text with marks between them, and their counts."""
        joined = self.mark.join(parts) + self.mark
        ids = np.array(
            self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype="<u4"
        )
        marks = ids == self.mark_id
        ends = np.flatnonzero(marks)
        return ids[~marks], np.diff(ends, prepend=-1) - 1

    def _merged(self, words: list[str], lead: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters and signs behind them by the vocabulary's merges, and their counts."""
        tokenize, lead = self.tokenizer.model.tokenize, _SPACE if lead else ""
        ids: list[int] = []
        ends = []
        for word in words:
            core = word.rstrip(_ENDS)
            signs = word[len(core) :]
            if not core.isascii():
                core = core.encode().decode("latin-1").translate(_SIGNS)
            for token in tokenize(lead + core):
                ids.append(token.id)
            if signs:
                if signs not in self.signs:
                    self.signs[signs] = [token.id for token in tokenize(signs)]
                ids += self.signs[signs]
                if len(self.signs) > 10_000:
                    self.signs.clear()
            ends.append(len(ids))
        return np.array(ids, dtype="<u4"), np.diff(ends, prepend=0)

    def _learn(self, words: pa.Array, lead: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words as they stand after `lead`, end to end, and their counts."""
        plain = pc.match_substring_regex(words, _PLAIN_WORD).to_numpy(zero_copy_only=False)
        letters = np.zeros(len(words), dtype=bool)
        if self.joined:
            letters = pc.match_substring_regex(words, _LETTERS).to_numpy(zero_copy_only=False)
        listed = words.to_pylist()
        parts, counts = [], np.zeros(len(listed), dtype=np.int64)
        groups = [np.flatnonzero(x) for x in (letters, plain & ~letters, ~plain & ~letters)]
        order = np.concatenate(groups)
        if len(groups[0]):
            ids, counts[groups[0]] = self._merged([listed[i] for i in groups[0].tolist()], lead)
            parts.append(ids)
        for start in range(0, len(groups[1]), 4096):
            some = groups[1][start : start + 4096]
            ids, counts[some] = self._marked([lead + listed[i] for i in some])
            parts.append(ids)
        if len(groups[2]):
            rest = self._direct([lead + listed[i] for i in groups[2]])
            counts[groups[2]] = [len(x) for x in rest]
            parts += rest
        flat = np.concatenate(parts) if parts else np.zeros(0, dtype="<u4")
        # Back from the groups' order to the order given.
        starts = np.empty(len(order), dtype=np.int64)
        starts[order] = np.cumsum(counts[order]) - counts[order]
        return flat[_runs(starts, counts)], counts

    @staticmethod
    def _blank_ends(words: pa.Array, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Which words have white space at an end, by their first and last bytes if these can tell."""
        maybe = np.flatnonzero((first <= 32) | (first >= 128) | (last <= 32) | (last >= 128))
        blank = np.zeros(len(words), dtype=bool)
        some = words.take(pa.array(maybe)).to_pylist()
        blank[maybe] = [x[0].isspace() or x[-1].isspace() for x in some]
        return blank

    def _look_up(self, words: pa.Array, cache: _Cache) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct words end to end, their counts, and which words are odd.

        Odd ones are empty or have white space at an end; they have no ids here.
        """
        counts, odd = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=bool)
        data, starts, lengths = spelled(words)
        full = np.flatnonzero(lengths)
        odd[lengths == 0] = self.joined
        if not len(full):
            return np.zeros(0, dtype="<u4"), counts, odd
        keys = word_hashes(words.take(pa.array(full)))
        order = full[np.argsort(keys, kind="stable")]
        keys = np.sort(keys)
        sources = np.empty(len(words), dtype=np.int64)
        pools, offset = [], 0
        lacking = np.arange(len(order))
        for table in (cache.young, cache.old):
            rows = table.find(keys[lacking], data, starts[order[lacking]], lengths[order[lacking]])
            hit = rows >= 0
            at, spans = order[lacking[hit]], table.spans[:, rows[hit]]
            found = table.ids.held[_runs(spans[0], spans[1])]
            counts[at] = spans[1]
            sources[at] = offset + np.cumsum(spans[1]) - spans[1]
            pools.append(found)
            offset += len(found)
            if table is cache.old and len(at):
                cache.young.add(keys[lacking[hit]], data, starts[at], lengths[at], found, spans[1])
            lacking = lacking[~hit]
        if len(lacking):
            at = order[lacking]
            fresh = words.take(pa.array(at))
            if self.joined:
                blank = self._blank_ends(fresh, data[starts[at]], data[starts[at] + lengths[at] - 1])
                odd[at[blank]] = True
                counts[at[blank]], sources[at[blank]] = 0, 0
                lacking, at = lacking[~blank], at[~blank]
                fresh = words.take(pa.array(at))
            found, some = self._learn(fresh, cache.lead)
            counts[at] = some
            sources[at] = offset + np.cumsum(some) - some
            pools.append(found)
            kept = lengths[at] <= CACHED_LENGTH
            held = found if kept.all() else found[_runs((np.cumsum(some) - some)[kept], some[kept])]
            at = at[kept]
            cache.young.add(keys[lacking[kept]], data, starts[at], lengths[at], held, some[kept])
        if len(cache.young.keys) > CACHED_WORDS:
            cache.old, cache.young = cache.young, WordTable()
        sources[lengths == 0] = 0
        return np.concatenate(pools)[_runs(sources, counts)], counts, odd

    def ids_of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of an Arrow array of texts, end to end, and the bounds of each text's ids.

        Null and empty texts have none.
        """
        texts = plain_texts(texts)
        marked = np.zeros(len(texts), dtype=bool)
        for content in self.added:
            marked |= pc.match_substring(texts, content).to_numpy(zero_copy_only=False)
        whole: dict[int, np.ndarray] = {}
        if marked.any():
            at = np.flatnonzero(marked)
            whole = dict(zip(at.tolist(), self._direct(texts.take(pa.array(at)).to_pylist()), strict=True))
            texts = pc.if_else(pa.array(~marked), texts, "")
        if not self.joined:
            texts = pc.replace_substring(texts, "\n", " ")
        lists = pc.split_pattern(texts, " ")
        bounds = lists.offsets.to_numpy()
        coded = lists.flatten().dictionary_encode()
        index, words = coded.indices.to_numpy(), coded.dictionary
        pool, sizes, odd = self._look_up(words, self.words)
        if self.joined and len(texts):
            # A text's first word stands after no space; odd texts are cut with more care.
            firsts = bounds[:-1]
            opening = words.take(pa.array(index[firsts])).dictionary_encode()
            first_pool, first_sizes, _ = self._look_up(opening.dictionary, self.openers)
            if odd.any():
                at = np.flatnonzero(odd[index])
                for doc in np.unique(np.searchsorted(bounds, at, side="right") - 1).tolist():
                    if doc not in whole:
                        whole[doc] = self._odd_text(texts[doc].as_py())
            index = index.copy()
            index[firsts] = opening.indices.to_numpy() + len(sizes)
            pool, sizes = np.concatenate([pool, first_pool]), np.concatenate([sizes, first_sizes])
        if whole:
            # These texts' words count nothing, and their ids stand at the place of the first one.
            index = index.copy()
            docs = sorted(whole)
            base = len(sizes)
            pool = np.concatenate([pool, *(whole[d] for d in docs)])
            sizes = np.concatenate([sizes, [len(whole[d]) for d in docs], [0]])
            for i, doc in enumerate(docs):
                index[bounds[doc] : bounds[doc + 1]] = len(sizes) - 1
                index[bounds[doc]] = base + i
        starts = np.cumsum(sizes) - sizes
        counts = sizes[index]
        ends = np.concatenate([[0], np.cumsum(counts)])
        return pool[_runs(starts[index], counts)], ends[bounds]

    def _odd_text(self, text: str) -> np.ndarray:
        """Ids of a text with runs of white space: cut only at single inner spaces."""
        words = _INNER_SPACE.split(text)
        rest, _ = self._learn(pa.array(words[1:], pa.large_string()), " ")
        return np.concatenate([self._direct(words[:1])[0], rest])


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, joined: bool) -> Encoder:
    """The worker's encoder for a vocabulary file, loaded once per process."""
    key = (path, joined)
    if key not in _encoders:
        _encoders[key] = Encoder(path, joined)
    return _encoders[key]


def public_path(name: str) -> str:
    """Place of a public vocabulary file, looked up where the task runs."""
    import public_tokenizers

    return public_tokenizers.path(name)


def small_batches(spark: SparkSession) -> SparkSession:
    """The session, set to hand rows over in small batches: both sides hold one at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def give_back() -> None:
    """Return freed memory to the system: a worker is reused by later stages and other operators."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_slices(batch: pa.RecordBatch, column: int, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in slices with about `limit` bytes of text each, at least one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy()
    ends, start, held = np.cumsum(sizes), 0, 0
    while start < len(sizes):
        end = max(start + 1, int(np.searchsorted(ends, held + limit, side="right")))
        yield batch.slice(start, end - start)
        start, held = end, int(ends[end - 1])
    give_back()


def as_binary(flat: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Rows of 32-bit ids as little-endian bytes."""
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(),
        len(bounds) - 1,
        [None, pa.py_buffer((bounds * 4).astype(np.int64).tobytes()), pa.py_buffer(flat.tobytes())],
    )


def with_end(flat: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row of ids closed by `end_id`."""
    grown = bounds + np.arange(len(bounds))
    out = np.full(int(grown[-1]), end_id, dtype="<u4")
    keep = np.ones(len(out), dtype=bool)
    keep[grown[1:] - 1] = False
    out[keep] = flat
    return out, grown
