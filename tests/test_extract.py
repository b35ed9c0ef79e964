import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import skilltrail.operators.extract as E


def lexicon_of(spark, names):
    rows = [(n, i) for i, n in enumerate(names)]
    return E.build_lexicon(spark.createDataFrame(rows, "skill string, ord long"))


def extract(spark, names, texts, **kw):
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = E.match_skills(frame, lexicon_of(spark, names), ["id"], **kw).collect()
    return {i: {r.skill: r.n for r in got if r.id == i} for i in range(len(texts))}


@pytest.fixture(params=["broadcast", "shuffled"])
def both_joins(request, monkeypatch):
    if request.param == "shuffled":
        monkeypatch.setattr(E, "BROADCAST_BYTES", -1)


def test_longest_first_and_boundaries(spark, both_joins):
    got = extract(
        spark,
        ["machine learning", "learning", "SQL", "C++"],
        [
            "Machine-learning and SQL; learning, sql",
            "nosql sqlite",
            "c++ and c++11",
            "ésql",
            "",
        ],
    )
    assert got[0] == {"machine learning": 1, "learning": 1, "SQL": 2}
    assert got[1] == {}
    assert got[2] == {"C++": 1}
    assert got[3] == {} and got[4] == {}


def test_last_display_name_wins_and_counts_once(spark):
    got = extract(spark, ["Node-JS", "node js"], ["node js, Node-JS node"])
    assert got[0] == {"node js": 2}


def test_resume_headings_are_not_skills(spark):
    frame = spark.createDataFrame([(1, "Education: Python, python")], "id long, text string")
    got = E.resume_skills(frame, lexicon_of(spark, ["Education", "Python"]), ["id"]).collect()
    assert [(r.id, r.skill) for r in got] == [(1, "Python")]


def test_with_skills_repeats_and_drops(spark):
    frame = spark.createDataFrame([(1, "sql, SQL r"), (2, "none")], "id long, text string")
    got = E.with_skills(frame, lexicon_of(spark, ["SQL", "R"]), ["id"]).collect()
    assert [(r.id, r.skills) for r in got] == [(1, ["R", "SQL", "SQL"])]


def restated(phrases, text):
    """The rule in plain words: longest first, count, remove, go on."""
    counts = {}
    for phrase in sorted(phrases, key=len, reverse=True):
        pattern = re.compile(r"\b%s\b" % re.escape(phrase))
        # A mark that is no word keeps what stood around the phrase apart.
        text, n = pattern.subn("\0", text)
        if n:
            counts[phrase] = n
    return counts


def test_random_texts_agree_with_the_rule(spark, both_joins):
    rng = random.Random(7)
    words = ["a", "b", "c", "é", "ab", "a1"]
    phrases = sorted({" ".join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(25)})
    glue = [" ", " ", " ", "  ", ", ", "; ", "\n", "/"]
    texts = [
        "".join(rng.choice(words) + rng.choice(glue) for _ in range(rng.randint(0, 40)))
        for _ in range(300)
    ]
    got = extract(spark, phrases, texts)
    # Commas vanish in the normal form, so the plain rule must see that form too.
    for i, text in enumerate(texts):
        assert got[i] == restated(phrases, text.lower().replace(",", "")), text


def test_long_runs_of_overlaps(spark):
    got = extract(spark, ["a b", "b a", "a"], ["a b " * 500, "a b " * 20000])
    assert got[0] == {"a b": 500} and got[1] == {"a b": 20000}


def test_long_and_short_runs_settle_alike(spark, monkeypatch):
    rng = random.Random(3)
    lex = lexicon_of(spark, ["a b", "b a", "a", "b c d", "c d a b", "d", "a a"])
    rows = [(i, " ".join(rng.choices("abcd", k=rng.randint(1, 80)))) for i in range(60)]
    frame = spark.createDataFrame(rows, "id long, text string")
    found = []
    for limit in (0, 1000):
        monkeypatch.setattr(E, "LONG_RUN", limit)
        found.append(sorted(map(tuple, E.match_skills(frame, lex, ["id"]).collect())))
    assert found[0] == found[1] and found[0]


def test_partitioning_does_not_matter(spark):
    rows = [(i, "data entry and data science " * (i % 3 + 1)) for i in range(40)]
    lex = lexicon_of(spark, ["data", "data science", "entry and data"])
    frame = spark.createDataFrame(rows, "id long, text string")
    a = E.match_skills(frame.repartition(1), lex, ["id"])
    b = E.match_skills(frame.repartition(7).orderBy(F.desc("id")), lex, ["id"])
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_hits_are_neither_windowed_nor_folded(spark):
    """Hits of a text are settled together, without a sort of all hits by place."""
    frame = spark.createDataFrame([(1, "sql and sql server and java")], "id int, text string")
    found = E.match_skills(frame, lexicon_of(spark, ["SQL", "SQL Server", "Java"]), ["id"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "aggregate(" not in plan


def test_hits_stay_in_the_task_that_finds_them(spark):
    """Only texts are dealt out by key; hits are neither gathered as lists nor sorted nor sent."""
    frame = spark.createDataFrame([(1, "sql and sql server and java")], "id int, text string")
    found = E.match_skills(frame, lexicon_of(spark, ["SQL", "SQL Server", "Java"]), ["id"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan
    above = plan[: plan.index("BroadcastHashJoin")]
    assert "Exchange" not in above and "Sort" not in above


def test_pieces_are_runs_of_word_characters_and_single_others(spark):
    odd = ["", " ", "a", ".", "a.b  c", "..a", "a..", "c++\0x", "\0", "é-ß", "𠀀𠀁 😀😀a", "$1\\0 \\E[x]", "a\nb\r\n\tc", "a_1,", None]
    frame = spark.createDataFrame([(t,) for t in odd], "t string")
    rows = frame.select(
        F.col("t"), E._pieces(F.col("t")).alias("p"), F.regexp_extract_all("t", F.lit(E._PIECE), 1).alias("want")
    ).collect()
    # An empty text may be one empty piece.
    assert [r.p for r in rows if r.t != ""] == [r.want for r in rows if r.t != ""]


def test_rows_of_one_key_are_one_text(spark, both_joins):
    lex = lexicon_of(spark, ["a b", "b", "c"])
    rows = [(i % 3, "a b c " * (i % 3 + 1)) for i in range(12)] + [(None, "b"), (None, "b c")]
    frame = spark.createDataFrame(rows, "id long, text string").repartition(7)
    got = {(r.id, r.skill): r.n for r in E.match_skills(frame, lex, ["id"]).collect()}
    want = {(i, s): i + 1 for i in range(3) for s in ("a b", "c")}
    assert got == want | {(None, "b"): 1, (None, "c"): 1}
    assert E.with_skills(frame, lex, ["id"]).count() == 12


def test_texts_are_settled_alike_however_batches_fall(monkeypatch):
    rng = random.Random(5)
    hits = []
    for key in [*range(40), None]:
        for start in range(rng.randint(1, 30)):
            for n in rng.sample([1, 2, 3], rng.randint(1, 2)):
                hits.append((key, start, n, -n, rng.choice([None, 1, 2]), f"s{start % 4}{n}"))
    names = ["id", *E._SETTLED_BY]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string()]
    whole = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*hits), kinds)], names=names)
    want = pa.Table.from_batches(E._settle([whole])).to_pylist()
    assert [r["id"] for r in want] == [*range(40), None]
    for at_once, size in ((1, 1), (5, 3), (64, 7), (1000, 50)):
        monkeypatch.setattr(E, "HITS_AT_ONCE", at_once)
        parts = [whole.slice(i, size) for i in range(0, len(whole), size)]
        assert pa.Table.from_batches(E._settle([parts[0].slice(0, 0), *parts])).to_pylist() == want
