"""Longest-phrase-first extraction of dictionary skills from whole texts.

A text is cut into pieces (runs of word characters, single other characters), piece
n-grams are looked up in the dictionary by equi-joins, and the overlaps among the hits
of one text are settled longest phrase first, for many texts at once. With a dictionary that can be broadcast
only texts are shuffled, once, by their key, and hits are settled in the task that finds them.

Boundaries are those of the given text: settling a phrase does not move the word
boundaries of its neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import RESUME_HEADINGS, WORD_CLASS, format_skill, normalise
from ..session import cut
from ..sizes import BROADCAST_BYTES, measured_bytes

_PIECE = f"([{WORD_CLASS}]+|[^{WORD_CLASS}])"

#: Set around every character that is no word character, to cut there.
_CUT = "\0"

_HIT = ["n", "length", "ord", "skill", "symbol_first", "symbol_last"]

#: What settling reads of a hit, after the key.
_SETTLED_BY = ["start", "n", "rank", "ord", "skill"]

_FOUND = T.StructField(
    "found", T.ArrayType(T.StructType().add("skill", T.StringType()).add("n", T.LongType(), False))
)


def _pieces(text: Column) -> Column:
    """Pieces of a text, by a plain split, which costs far less than a match for each piece."""
    marked = F.regexp_replace(text, f"[^{WORD_CLASS}]", f"{_CUT}$0{_CUT}")
    return F.when(F.contains(text, F.lit(_CUT)), F.regexp_extract_all(text, F.lit(_PIECE), 1)).otherwise(
        F.array_remove(F.split(marked, _CUT), "")
    )


def build_lexicon(skills: DataFrame, skill: str = "skill", ord: str = "ord") -> DataFrame:
    """Dictionary rows `(skill, formatted, ord)` from display names and their order."""
    named = skills.select(F.col(skill).alias("skill"), F.col(ord).cast("long").alias("ord"))
    return named.select("skill", format_skill(F.col("skill")).alias("formatted"), "ord")


def display_names(lexicon: DataFrame) -> DataFrame:
    """One display name per formatted skill: the last of several wins."""
    return (
        lexicon.where("formatted != ''")
        .groupBy("formatted")
        .agg(
            F.max_by("skill", F.struct("ord", "skill")).alias("skill"), F.min("ord").alias("ord")
        )
    )


def _phrases(lexicon: DataFrame, ignore) -> DataFrame:
    known = display_names(lexicon)
    if ignore:
        known = known.where(~F.col("formatted").isin(*ignore))
    parts = _pieces(F.col("formatted"))
    return known.select(
        F.col("formatted").alias("phrase"),
        "skill",
        "ord",
        F.length("formatted").alias("length"),
        F.size(parts).alias("n"),
        parts[0].alias("head"),
        (~F.col("formatted").rlike(f"^[{WORD_CLASS}]")).alias("symbol_first"),
        (~F.col("formatted").rlike(f"[{WORD_CLASS}]$")).alias("symbol_last"),
    )


def _hits_in_place(texts: DataFrame, key: list[str], phrases: DataFrame) -> DataFrame:
    """Dictionary hits with a dictionary small enough to broadcast.

    A piece is looked up first; only where phrases begin with it, and only in their
    lengths, are n-grams built. Both joins and both explodes run in one generated loop
    over a text, so its pieces are never copied.
    """
    heads = phrases.groupBy("head").agg(F.collect_set("n").alias("lengths"))
    # The outer form keeps the optimizer from cutting every text twice for a size filter.
    at = texts.select(*key, "p", F.posexplode_outer("p").alias("i", "head")).where("head != ' '")
    sized = at.join(F.broadcast(heads), "head").select(
        *key, "p", "i", "head", F.explode("lengths").alias("n_pieces")
    )
    gram = F.when(F.col("n_pieces") == 1, F.col("head")).otherwise(
        F.array_join(F.slice("p", F.col("i") + 1, F.col("n_pieces")), "")
    )
    return (
        sized.withColumn("phrase", F.coalesce(gram, F.lit("")))
        .join(F.broadcast(phrases.drop("head")), "phrase")
        .where(F.col("n") == F.col("n_pieces"))
        .select(
            *key,
            (F.col("i") + 1).alias("start"),
            F.get("p", F.col("i") - 1).alias("before"),
            F.get("p", F.col("i") + F.col("n")).alias("after"),
            *_HIT,
        )
    )


def _hits_shuffled(texts: DataFrame, key: list[str], phrases: DataFrame) -> DataFrame:
    """The same for any dictionary size: n-grams and phrases are shuffled together."""
    lengths = phrases.agg(F.collect_set("n").alias("lengths")).scalar()
    sized = texts.select(*key, "p", F.explode(lengths).alias("n_pieces")).where(
        F.size("p") >= F.col("n_pieces")
    )
    starts = F.sequence(F.lit(1), F.size("p") - F.col("n_pieces") + 1)
    grams = F.transform(
        starts,
        lambda i: F.struct(
            i.alias("start"),
            F.array_join(F.slice(F.col("p"), i, F.col("n_pieces")), "").alias("phrase"),
            F.get(F.col("p"), i - 2).alias("before"),
            F.get(F.col("p"), i - 1 + F.col("n_pieces")).alias("after"),
        ),
    )
    return (
        sized.select(*key, F.inline_outer(grams))
        .where(~F.col("phrase").startswith(" "))
        .join(phrases.drop("head"), "phrase")
        .select(*key, "start", "before", "after", *_HIT)
    )


#: Runs of more overlapping hits than this are settled by `_settle_long`.
LONG_RUN = 16

#: Hits settled at once, but for a text that has more.
HITS_AT_ONCE = 1 << 18


def _settle_short(order: np.ndarray, run: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Hits kept of short runs, given in the order of their runs and best first in each.

    Every round keeps the best hit left of each run and drops those that share a piece with it.
    """
    kept = []
    while len(order):
        first = np.r_[True, run[order[1:]] != run[order[:-1]]]
        kept.append(order[first])
        best = order[first][np.cumsum(first) - 1]
        order = order[(start[order] >= end[best]) | (end[order] <= start[best])]
    return kept


def _settle_long(order: np.ndarray, run: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[int]:
    """The same for long runs, which rounds would settle in quadratic time.

    A piece is marked once, so a run of any length costs a sort and one pass.
    """
    kept = []
    for hits in np.split(order, np.flatnonzero(np.diff(run[order])) + 1) if len(order) else []:
        first = start[hits].min()
        taken = bytearray(int(end[hits].max() - first))
        for hit, a, b in zip(hits.tolist(), (start[hits] - first).tolist(), (end[hits] - first).tolist(), strict=True):
            if not any(taken[a:b]):
                taken[a:b] = b"\x01" * (b - a)
                kept.append(hit)
    return kept


def _settled(hits: pa.RecordBatch, starts: np.ndarray) -> pa.ListArray:
    """Skills of each text in ascending order with their counts, from the texts' hits one after the other.

    `starts` are the first hits of the texts. Longest phrases come first, none share a piece.
    """
    text = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(hits)))
    start, n, rank = (hits.column(c).to_numpy().astype(np.int64) for c in ("start", "n", "rank"))
    ord = hits.column("ord").fill_null(np.iinfo(np.int64).min).to_numpy()
    names = hits.column("skill").dictionary_encode("encode")
    by_name = pc.sort_indices(names.dictionary, null_placement="at_start").to_numpy()
    place = np.empty(len(by_name), dtype=np.int64)
    place[by_name] = np.arange(len(by_name))
    skill = place[names.indices.to_numpy()]
    # One text after the other, none in reach of the next.
    start = start + text * (int((start + n).max()) + 1)
    end = start + n
    in_place = np.lexsort((n, start))
    reach = np.maximum.accumulate(end[in_place])
    run = np.empty(len(hits), dtype=np.int64)
    run[in_place] = np.cumsum(np.r_[True, start[in_place][1:] >= reach[:-1]]) - 1
    size = np.bincount(run)[run]
    shared = np.flatnonzero(size > 1)
    order = shared[np.lexsort(tuple(c[shared] for c in (skill, n, start, ord, rank, run)))]
    long = size[order] > LONG_RUN
    kept = np.concatenate(
        [
            np.flatnonzero(size == 1),
            *_settle_short(order[~long], run, start, end),
            np.array(_settle_long(order[long], run, start, end), dtype=np.int64),
        ]
    )
    found, counts = np.unique(text[kept] * len(by_name) + skill[kept], return_counts=True)
    owner, skill = np.divmod(found, len(by_name))
    return pa.ListArray.from_arrays(
        pa.array(np.searchsorted(owner, np.arange(len(starts) + 1)).astype(np.int32)),
        pa.StructArray.from_arrays(
            [names.dictionary.take(pa.array(by_name[skill])), pa.array(counts.astype(np.int64))], names=["skill", "n"]
        ),
    )


def _starts(keys: list[pa.Array]) -> np.ndarray:
    """Rows at which another text begins than in the row before."""
    first = np.zeros(len(keys[0]), dtype=bool)
    first[0] = True
    for key in keys:
        code = key.dictionary_encode("encode").indices.to_numpy()
        first[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(first)


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a key and `found`, from rows of a key and a hit in which the hits of a key follow each other."""

    def settled(hits: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        keys = hits.select(hits.schema.names[: -len(_SETTLED_BY)]).take(pa.array(starts))
        return pa.RecordBatch.from_arrays(
            [*keys.columns, _settled(hits, starts)], names=[*keys.schema.names, "found"]
        )

    waiting, rows, enough = [], 0, HITS_AT_ONCE
    for batch in batches:
        waiting.append(batch)
        rows += len(batch)
        if rows < enough:
            continue
        hits = pa.concat_batches(waiting)
        starts = _starts(hits.columns[: -len(_SETTLED_BY)])
        # The last text may go on in the next batch.
        last = int(starts[-1])
        if last:
            yield settled(hits.slice(0, last), starts[:-1])
        waiting, rows = [hits.slice(last)], len(hits) - last
        enough = max(HITS_AT_ONCE, 2 * rows)
    if rows:
        hits = pa.concat_batches(waiting)
        yield settled(hits, _starts(hits.columns[: -len(_SETTLED_BY)]))


def _found(texts: DataFrame, lexicon: DataFrame, key: list[str], text: str, ignore) -> DataFrame:
    """Rows `(*key, found)`: the `(skill, n)` of each text that has any, ascending by skill."""
    phrases = cut(_phrases(lexicon, list(ignore)))
    small = measured_bytes(phrases) <= BROADCAST_BYTES
    word = f"[{WORD_CLASS}]$"
    texts = texts.select(*key, F.col(text).alias("_text"))
    if small:
        # Neither explodes nor broadcast joins change the order, so the hits of a key follow each other.
        texts = texts.repartition(*key).sortWithinPartitions(*key)
    pieces = texts.select(*key, normalise(F.col("_text")).alias("_text")).select(
        *key, _pieces(F.col("_text")).alias("p")
    )
    hits = (
        (_hits_in_place if small else _hits_shuffled)(pieces, key, phrases)
        .where(~F.col("symbol_first") | F.coalesce(F.col("before").rlike(word), F.lit(False)))
        .where(~F.col("symbol_last") | F.coalesce(F.col("after").rlike(word), F.lit(False)))
        .withColumn("rank", -F.col("length"))
        .select(*key, *_SETTLED_BY)
    )
    if not small:
        hits = hits.repartition(*key).sortWithinPartitions(*key)
    return hits.mapInArrow(_settle, T.StructType([*hits.schema.fields[: len(key)], _FOUND]))


def match_skills(
    texts: DataFrame, lexicon: DataFrame, key: list[str], text: str = "text", ignore=()
) -> DataFrame:
    """Rows `(*key, skill, n)`: how often each skill is mentioned in each text.

    `key` must identify a text. Texts without any skill have no row.
    """
    return _found(texts, lexicon, key, text, ignore).select(*key, F.inline("found"))


def resume_skills(
    resumes: DataFrame, lexicon: DataFrame, key: list[str], text: str = "text"
) -> DataFrame:
    """Distinct skills of each resume; section headings do not count as skills."""
    return match_skills(resumes, lexicon, key, text, RESUME_HEADINGS).select(*key, "skill")


def with_skills(
    texts: DataFrame, lexicon: DataFrame, key: list[str], text: str = "text", ignore=()
) -> DataFrame:
    """Texts in which at least one skill was found, with their skill array."""
    repeated = F.transform("found", lambda f: F.array_repeat(f["skill"], f["n"].cast("int")))
    bags = _found(texts, lexicon, key, text, ignore).select(*key, F.flatten(repeated).alias("skills"))
    return texts.join(bags, key)
