"""Benchmark decontamination: CGK walks, bit-sampling LSH and exact edit distances.

A CGK walk turns a sequence into one in which small edit distance shows as small Hamming
distance: step by step the current symbol is written, and a random bit of step and symbol says
whether to move on. Symbols are letters. Every word of a document starts a window of the items'
size, all windows walk at once, and tables of sampled steps are looked up in those of the items'
windows. What they find is verified by edit distance in characters.

The exact mode takes another search, which misses nothing and costs far more: an edit breaks at
most n of an item's letter n-grams, and the text places of those that are left lie on diagonals
(place in the text less place in the item) no further apart than there are edits, so that all
stretches within reach of an item have a known number of shared n-grams in a narrow band.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skilltrail.llm.tokens import give_back, text_slices
from skilltrail.llm.words import mixed, split_words

#: Edits allowed, as a share of the item's characters.
MAX_EDITS = 0.2
#: Window sizes in characters; an item has windows of the largest that fits, at every word.
SIZES = (1, 2, 4, 8, 24)
#: Steps of a walk per character, independent walks, tables of each, and steps that a table samples.
STEPS, WALKS, TABLES, SAMPLED = 1.5, 2, 5, 13
#: Windows that walk at once.
_WINDOWS = 1 << 14
#: Exact mode: least characters of an item whose n-grams have 4, 3 and 2 letters.
GRAMS = ((60, 4), (10, 3), (2, 2), (0, 1))
#: Text of benchmark items that one pass over the documents looks for.
BLOCK_BYTES = 4 << 20
#: Items whose bands are counted together, characters of text at a time, and bits of a band's width.
_GROUP, _CHUNK, _BAND = 256, 1 << 15, 3
_HASH_BITS = 18
_SLAB_BYTES = 2 << 20
#: Pairs of item and stretch whose distances are worked out in step, if they are so many at least,
#: of items up to so many characters.
_TOGETHER, _FEW, _SHORT = 2048, 128, 1024


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _grams(codes: np.ndarray, n: int) -> np.ndarray:
    """Buckets of all n-grams of the characters."""
    keys = np.zeros(max(0, len(codes) - n + 1), dtype=np.uint64)
    for i in range(n):
        keys = (keys << np.uint64(16)) ^ codes[i : i + len(keys)]
    return (mixed(keys) >> np.uint64(64 - _HASH_BITS)).astype(np.int64)


class Group:
    """Items with n-grams of one length: where each n-gram stands in them."""

    def __init__(self, n: int, members: list[int], texts: list[str]):
        self.n, self.members = n, np.array(members)
        self.sizes = np.array([len(t) for t in texts])
        self.most = (self.sizes * MAX_EDITS).astype(np.int64)
        self.least = self.sizes - n + 1 - n * self.most
        self.longest = int(self.sizes.max())
        #: Bands of a row: diagonals of a chunk, those before it, and an empty band between rows.
        self.bands = ((_CHUNK + 2 * self.longest + int(self.most.max()) + n) >> _BAND) + 2
        found = [_grams(_codes(t), n) for t in texts]
        order = np.argsort(np.concatenate(found), kind="stable")
        self.counts = np.bincount(np.concatenate(found), minlength=1 << _HASH_BITS).astype(np.int32)
        self.starts = np.cumsum(self.counts, dtype=np.int64) - self.counts
        base = [(row * self.bands << _BAND) - np.arange(len(f)) for row, f in enumerate(found)]
        self.base = np.concatenate(base)[order]
        #: Neighbouring bands that hold any diagonals as far apart as the edits allow.
        self.reach = (self.most + (1 << _BAND) - 1 >> _BAND) + 1

    def regions(self, grams: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, first and last diagonal) of all runs of bands with enough shared n-grams."""
        # A stretch lies whole in the chunk in which it begins, as chunks overlap by more than its length.
        beyond = self.longest + int(self.most.max()) + self.n
        for start in range(0, len(grams), _CHUNK - beyond if _CHUNK > 2 * beyond else _CHUNK):
            some = grams[start : start + (_CHUNK if _CHUNK > 2 * beyond else _CHUNK + beyond)]
            counts = self.counts[some]
            full = np.flatnonzero(counts)
            counts = counts[full]
            ends = np.cumsum(counts, dtype=np.int64)
            if not len(ends):
                continue
            shift = self.starts[some[full]] - (ends - counts)
            listed = np.arange(ends[-1]) + np.repeat(shift, counts)
            keys = self.base[listed]
            keys += np.repeat(full + self.longest, counts)
            keys >>= _BAND
            tally = np.bincount(keys, minlength=len(self.members) * self.bands)
            tally = tally.reshape(len(self.members), self.bands)
            sums = np.zeros((len(tally), self.bands + 1), dtype=np.int64)
            np.cumsum(tally, axis=1, out=sums[:, 1:])
            for reach in np.unique(self.reach).tolist():
                rows = np.flatnonzero(self.reach == reach)
                width = min(reach, self.bands)
                held = sums[rows, width:] - sums[rows, :-width]
                for at, band in zip(*np.nonzero(held >= self.least[rows, None]), strict=True):
                    first = start + (int(band) << _BAND) - self.longest
                    yield int(self.members[rows[at]]), first, first + (width << _BAND) - 1


def _items(rows: list[tuple[int, str | None]]) -> list[tuple[int, str]]:
    """Items with any word, as words in lower case with one space between them."""
    words, bounds = split_words(pa.array([text for _, text in rows], pa.string()))
    listed = words.to_pylist()
    return [
        (number, " ".join(listed[a:b]))
        for (number, _), a, b in zip(rows, bounds, bounds[1:], strict=False)
        if b > a
    ]


def _merged(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Parts of a text (item, first place, place behind the last), those of an item that overlap in one."""
    merged: list[tuple[int, int, int]] = []
    for item, first, last in sorted(found):
        if merged and merged[-1][0] == item and first <= merged[-1][2]:
            merged[-1] = (item, merged[-1][1], max(last, merged[-1][2]))
        else:
            merged.append((item, first, last))
    return merged


class Index:
    """Exact mode: the items' texts and the places of their n-grams."""

    def __init__(self, rows: list[tuple[int, str | None]]):
        self.items = _items(rows)
        self.most = np.array([int(len(text) * MAX_EDITS) for _, text in self.items])
        by_n: dict[int, list[int]] = {}
        for i in sorted(range(len(self.items)), key=lambda i: len(self.items[i][1])):
            size = len(self.items[i][1])
            by_n.setdefault(next(n for least, n in GRAMS if size >= least), []).append(i)
        self.groups = [
            Group(n, some[at : at + _GROUP], [self.items[i][1] for i in some[at : at + _GROUP]])
            for n, some in by_n.items()
            for at in range(0, len(some), _GROUP)
        ]

    def regions(self, codes: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, first place, place behind the last) of all parts of a text that may hold an item."""
        out = []
        grams = {n: _grams(codes, n) for n in {g.n for g in self.groups}}
        for group in self.groups:
            for item, first, last in group.regions(grams[group.n]):
                size = len(self.items[item][1])
                most = int(size * MAX_EDITS)
                out.append((item, first - most, last + size + most + 1))
        return _merged(out)


class Walks:
    """The walks over windows of one size and the steps their tables sample; alike in every process."""

    def __init__(self, size: int):
        rng = np.random.default_rng(20240611 + size)
        self.size, steps = size, max(1, int(size * STEPS))
        # A walk reads another bit of a letter's hash at every step.
        self.shifts = np.stack([rng.permutation(64)[np.arange(steps) % 64] for _ in range(WALKS)]).astype(np.uint64)
        self.plan: list[list[list[tuple[int, np.uint64]]]] = []
        for walk in range(WALKS):
            plan: list[list[tuple[int, np.uint64]]] = [[] for _ in range(steps)]
            for table in range(TABLES):
                # One sample in each part of the walk, so that no key rests on its start alone.
                for part in np.array_split(np.arange(steps), min(SAMPLED, steps)):
                    factor = np.uint64(rng.integers(1, 1 << 63)) * np.uint64(2) + np.uint64(1)
                    plan[int(rng.choice(part))].append((walk * TABLES + table, factor))
            while not plan[-1]:
                plan.pop()
            self.plan.append(plan)

    def keys(self, symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Keys of all tables, one row each, for windows from `starts`; behind the text are zeros."""
        found = np.zeros((WALKS * TABLES, len(starts)), dtype=np.uint64)
        one = np.uint64(1)
        for walk, plan in enumerate(self.plan):
            at = starts.copy()
            for step, sampled in enumerate(plan):
                now = symbols[at]
                if step >= self.size:
                    # Beyond the window's end there is nothing.
                    now[at - starts >= self.size] = 0
                for row, factor in sampled:
                    found[row] += now * factor
                at += (now >> self.shifts[walk, step] & one).view(np.int64)
        return found


#: Hashes of the letters of the basic plane; 0 for the sign between texts.
_LETTER = np.where(np.arange(1 << 16) > 0, mixed(np.arange(1, (1 << 16) + 1, dtype=np.uint64)), np.uint64(0))


def _symbols(codes: np.ndarray) -> np.ndarray:
    """Hashes of letters, 0 between texts and, for the largest window, behind them."""
    found = np.zeros(len(codes) + int(SIZES[-1] * STEPS) + 1, dtype=np.uint64)
    np.take(_LETTER, codes, mode="clip", out=found[: len(codes)])
    beyond = np.flatnonzero(codes >= 1 << 16)
    found[beyond] = mixed(codes[beyond].astype(np.uint64) + np.uint64(1))
    return found


def _word_starts(codes: np.ndarray) -> np.ndarray:
    edge = (codes == 32) | (codes == 0)
    begins = ~edge
    begins[1:] &= edge[:-1]
    return np.flatnonzero(begins)


class WalkIndex:
    """The items' texts, and the tables of the walks over their windows."""

    def __init__(self, rows: list[tuple[int, str | None]]):
        self.items = _items(rows)
        windows: dict[int, list[tuple[int, int]]] = {}
        for i, (_, text) in enumerate(self.items):
            size = max(s for s in SIZES if s <= len(text))
            starts = _word_starts(_codes(text))
            for at in sorted({*starts[starts <= len(text) - size].tolist(), 0}):
                windows.setdefault(size, []).append((i, at))
        self.sizes = sizes = np.array([len(text) for _, text in self.items], dtype=np.int64)
        self.most = np.array([int(n * MAX_EDITS) for n in sizes.tolist()], dtype=np.int64)
        # Items lie end to end, a zero between them.
        ends = np.cumsum(sizes + 1)
        symbols = _symbols(_codes("\0".join(text for _, text in self.items)))
        self.tables = []
        for size, some in sorted(windows.items()):
            walks = Walks(size)
            item, offset = np.array(some).T
            keys = walks.keys(symbols, (ends - sizes - 1)[item] + offset)
            bits = min(24, max(16, int(16 * len(item)).bit_length()))
            found = []
            for row in keys:
                order = np.argsort(row, kind="stable")
                flags = np.zeros(1 << bits, dtype=bool)
                flags[(row >> np.uint64(64 - bits)).astype(np.int64)] = True
                found.append((row[order], order, flags))
            self.tables.append((walks, item, offset, np.uint64(64 - bits), found))

    def regions(self, codes: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, first place, place behind the last) of all parts of a text that share a key with an item."""
        symbols, starts = _symbols(codes), _word_starts(codes)
        hits: list[np.ndarray] = []
        for walks, item, offset, shift, tables in self.tables:
            for start in range(0, len(starts), _WINDOWS):
                some = starts[start : start + _WINDOWS]
                for keys, (values, order, flags) in zip(walks.keys(symbols, some), tables, strict=True):
                    maybe = np.flatnonzero(flags[(keys >> shift).astype(np.int64)])
                    asked = keys[maybe]
                    low = np.searchsorted(values, asked, side="left")
                    counts = np.searchsorted(values, asked, side="right") - low
                    full = counts > 0
                    if full.any():
                        low, counts = low[full], counts[full]
                        ends = np.cumsum(counts)
                        listed = order[np.arange(ends[-1]) + np.repeat(low - (ends - counts), counts)]
                        at = np.repeat(some[maybe[full]], counts) - offset[listed]
                        hits.append(np.unique(np.stack([item[listed], at]), axis=1))
        if not hits:
            return []
        item, begin = np.unique(np.concatenate(hits, axis=1), axis=1)
        # Edits before the window shift the item's begin, those behind it its end.
        most, size = self.most[item], self.sizes[item]
        return _merged(
            list(zip(item.tolist(), (begin - most).tolist(), (begin + size + most + 1).tolist(), strict=True))
        )


def least_edits(item: str, text: str) -> tuple[int, int]:
    """Least edit distance between the item and any stretch of the text, and its first end.

    Bit-parallel: a whole column of the distances is one number.
    """
    size = len(item)
    if not size:
        return 0, 0
    peq: dict[str, int] = {}
    for i, c in enumerate(item):
        peq[c] = peq.get(c, 0) | 1 << i
    mask, top = (1 << size) - 1, 1 << size - 1
    plus, minus, score, best, end = mask, 0, size, size, 0
    for j, c in enumerate(text, 1):
        eq = peq.get(c, 0)
        vertical = eq | minus
        across = (((eq & plus) + plus) ^ plus) | eq
        up = minus | ~(across | plus) & mask
        down = plus & across
        if up & top:
            score += 1
        elif down & top:
            score -= 1
            if score < best:
                best, end = score, j
        up, down = up << 1 & mask, down << 1 & mask
        plus, minus = down | ~(vertical | up) & mask, up & vertical
    return best, end


def all_least_edits(items: list[str], texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """`least_edits` of each pair, for many pairs in step: columns in words of 64 bits."""
    sizes = np.array([len(x) for x in items])
    blocks = int(sizes.max() + 63) // 64
    own = {x: i for i, x in enumerate(dict.fromkeys(items))}
    row = np.array([own[x] for x in items])
    alphabet = np.unique(_codes("".join(own)))
    equal = np.zeros((len(own), blocks, len(alphabet) + 1), dtype=np.uint64)
    for x, i in own.items():
        at = np.arange(len(x))
        symbols = np.searchsorted(alphabet, _codes(x)) + 1
        np.bitwise_or.at(equal, (i, at // 64, symbols), np.uint64(1) << (at % 64).astype(np.uint64))
    # Columns of symbols; 0, which no item has, behind the end of a text can improve nothing.
    symbols = np.zeros((max(len(x) for x in texts), len(texts)), dtype=np.int64)
    for i, x in enumerate(texts):
        codes = _codes(x)
        place = np.minimum(np.searchsorted(alphabet, codes), len(alphabet) - 1)
        symbols[: len(codes), i] = np.where(alphabet[place] == codes, place + 1, 0)
    one, top = np.uint64(1), np.uint64(63)
    plus = np.full((blocks, len(texts)), ~np.uint64(0))
    minus = np.zeros_like(plus)
    last, bit = (sizes - 1) // 64, ((sizes - 1) % 64).astype(np.uint64)
    ends_in = [last == b for b in range(blocks)]
    score, best = sizes.copy(), sizes.copy()
    end = np.zeros(len(texts), dtype=np.int64)
    nothing = np.zeros(len(texts), dtype=np.uint64)
    for j, now in enumerate(symbols, 1):
        more = less = nothing
        for b in range(blocks):
            eq, pv, mv = equal[row, b, now], plus[b], minus[b]
            vertical = eq | mv
            eq |= less
            across = (((eq & pv) + pv) ^ pv) | eq
            up = mv | ~(across | pv)
            down = pv & across
            if ends_in[b].any():
                step = (up >> bit & one).astype(np.int64) - (down >> bit & one).astype(np.int64)
                score += np.where(ends_in[b], step, 0)
            up, more = up << one | more, up >> top
            down, less = down << one | less, down >> top
            plus[b] = down | ~(vertical | up)
            minus[b] = up & vertical
        better = score < best
        best[better] = score[better]
        end[better] = j
    return best, end


def may_be_within(item: str, text: str, most: int) -> bool:
    """False only if no stretch of the text is within `most` edits: an edit breaks three 3-grams."""
    seen = {text[i : i + 3] for i in range(len(text) - 2)}
    return sum(item[i : i + 3] in seen for i in range(len(item) - 2)) >= len(item) - 2 - 3 * most


def edits_within(item: str, text: str, most: int) -> int | None:
    """Least edit distance between the item and any stretch of the text, or None beyond `most`."""
    edits, _ = least_edits(item, text)
    return edits if edits <= most else None


def _hits(index: Index | WalkIndex, texts: pa.Array) -> dict[tuple[int, int], tuple[int, int]]:
    """(text, item) to (edits, first word of the stretch) of all items within reach of a text.

    Of stretches with equally few edits it is the one that ends first, and of these the shortest.
    """
    words, bounds = split_words(texts)
    lines = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), words), pa.scalar(" ", pa.large_string())).to_pylist()
    # Texts stand behind each other; what reaches over an end is tried in both.
    starts = np.concatenate([[0], np.cumsum([len(x) + 1 for x in lines])])
    best: dict[tuple[int, int], tuple[int, int]] = {}
    tried = []  # size, item, text, place of the stretch, stretch
    for item, first, last in index.regions(_codes("\0".join(lines))):
        doc = max(0, int(np.searchsorted(starts, first, side="right")) - 1)
        while doc < len(lines) and starts[doc] < last:
            at = max(0, first - int(starts[doc]))
            stretch = lines[doc][at : last - int(starts[doc])]
            if stretch and len(index.items[item][1]) > _SHORT:
                edits, end = least_edits(index.items[item][1], stretch)
                if edits <= int(len(index.items[item][1]) * MAX_EDITS):
                    best[doc, item] = min(best.get((doc, item), (edits, at + end)), (edits, at + end))
            elif stretch and may_be_within(index.items[item][1], stretch, int(index.most[item])):
                tried.append((len(stretch), item, doc, at, stretch))
            doc += 1
    tried.sort()
    for start in range(0, len(tried), _TOGETHER):
        some = tried[start : start + _TOGETHER]
        texts_of = [index.items[item][1] for _, item, *_ in some], [x[-1] for x in some]
        if len(some) < _FEW:
            found = [least_edits(*pair) for pair in zip(*texts_of, strict=True)]
        else:
            found = zip(*(x.tolist() for x in all_least_edits(*texts_of)), strict=True)
        for (_, item, doc, at, _), (edits, end) in zip(some, found, strict=True):
            if edits <= int(len(index.items[item][1]) * MAX_EDITS):
                best[doc, item] = min(best.get((doc, item), (edits, at + end)), (edits, at + end))
    out = {}
    for (doc, item), (edits, end) in sorted(best.items()):
        text = index.items[item][1]
        before = lines[doc][max(0, end - len(text) - edits) : end]
        _, size = least_edits(text[::-1], before[::-1])
        out[doc, item] = (edits, lines[doc].count(" ", 0, end - size + 1))
    return out


def _slabs(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Rows in slabs of about `_SLAB_BYTES` of text: pairs of a slab are verified together."""
    held, size = [], 0
    for whole in batches:
        for batch in text_slices(whole, column, _SLAB_BYTES):
            held.append(batch)
            size += batch.column(column).nbytes
            if size >= _SLAB_BYTES:
                yield pa.concat_batches(held)
                held, size = [], 0
                give_back()
    if held:
        yield pa.concat_batches(held)


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's items in lists of at most `block_bytes` of text (or one item)."""
    held, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("long"), "text").where(F.col("text").isNotNull())
    for number, text in rows.toLocalIterator():
        bytes_ = len(text.encode())
        if held and size + bytes_ > block_bytes:
            yield held
            held, size = [], 0
        held.append((number, text))
        size += bytes_
    if held:
        yield held


def benchmark_hits(
    docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, exact: bool = False
) -> DataFrame:
    """doc_id, item_id, edits and begin_word for every item found in a document.

    Texts and items are compared as words in lower case with one space between them. An
    item counts as found if some stretch of the document is within 20 % of the item's
    characters in edits. Null and empty texts and items have none; equal rows each report
    theirs; rows of an empty table are none. Items of any number are looked for block by
    block, each block (4 MB) being sent to the tasks once.

    Exact copies that begin at a word are always found, edited ones with a probability that
    the README lists by share of edits (0.9 and more up to 20 %); with `exact`, nothing within
    reach is missed, inside words neither, at many times the cost.
    """
    parts, kind = [], Index if exact else WalkIndex
    for items in item_blocks(benchmark, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = kind(shared.value)
            for batch in _slabs(batches, 1):
                hits = _hits(index, batch.column(1))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array([doc for doc, _ in hits], pa.int64())),
                        pa.array([index.items[item][0] for _, item in hits], pa.int64()),
                        pa.array([edits for edits, _ in hits.values()], pa.int32()),
                        pa.array([begin for _, begin in hits.values()], pa.int32()),
                    ],
                    names=["doc_id", "item_id", "edits", "begin_word"],
                )

        rows = docs.select(F.col("doc_id").cast("long"), "text")
        parts.append(rows.mapInArrow(find, "doc_id long, item_id long, edits int, begin_word int"))
    if not parts:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, edits int, begin_word int")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def decontaminated(
    docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, exact: bool = False
) -> DataFrame:
    """The rows of `docs`, with all their columns, in whose text no benchmark item is found."""
    at, kind = docs.columns.index("text"), Index if exact else WalkIndex
    for items in item_blocks(benchmark, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = kind(shared.value)
            for batch in _slabs(batches, at):
                keep = np.ones(len(batch), dtype=bool)
                keep[[doc for doc, _ in _hits(index, batch.column(at))]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item in every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return benchmark_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
