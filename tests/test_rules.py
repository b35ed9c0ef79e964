import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import functions as F

from skilltrail.operators import rules, suggest
from skilltrail.sources import tables


def frame(spark, rows):
    return spark.createDataFrame(rows, "career string, skills array<string>")


def brute_force(rows, enough, min_listings):
    out = {}
    for career in {c for c, _ in rows}:
        sets = [set(s.lower() for s in skills) for c, skills in rows if c == career]
        n = len(sets)
        if n <= min_listings:
            continue
        counts = Counter(
            c for s in sets for k in range(1, len(s) + 1) for c in itertools.combinations(sorted(s), k)
        )
        halvings = 1
        while True:
            floor = math.ceil(n / 2**halvings)
            kept = {i: f for i, f in counts.items() if f >= floor}
            if len(kept) >= enough or floor == 1:
                break
            halvings += 1
        for items, freq in kept.items():
            out[career, items] = freq
    return out


@pytest.mark.parametrize("seed,enough", [(1, 300), (2, 40), (3, 15), (4, 5000)])
def test_adaptive_support_equals_the_loop(spark, seed, enough):
    rng = random.Random(seed)
    skills = [f"s{i:02d}" for i in range(14)]
    rows = []
    for career, size in (("big", 90), ("mid", 33), ("edge", 21), ("small", 20)):
        for _ in range(size):
            weights = [1 / (i + 1) for i in range(len(skills))]
            rows.append((career, rng.choices(skills, weights, k=rng.randint(1, 7))))
    rows += [("big", ["s00", "S01", "s02"])] * 30 + [("big", [])] * 3
    got = rules.frequent_itemsets(frame(spark, rows), enough=enough).collect()
    assert {(r.career, tuple(r.itemset)): r.freq for r in got} == brute_force(rows, enough, 20)


def test_itemsets_agree_with_fpgrowth(spark):
    rng = random.Random(5)
    rows = [("c", rng.sample([f"s{i}" for i in range(12)], rng.randint(1, 6))) for _ in range(80)]
    got = rules.frequent_itemsets(frame(spark, rows), enough=60).collect()
    support = 1 / 2 ** got[0].halvings
    model = FPGrowth(itemsCol="skills", minSupport=support, minConfidence=0.1).fit(frame(spark, rows))
    want = {(tuple(sorted(r["items"])), r.freq) for r in model.freqItemsets.collect()}
    assert {(tuple(r.itemset), r.freq) for r in got} == want
    mined = rules.association_rules(
        spark.createDataFrame(got)
    ).collect()
    theirs = {
        (tuple(sorted(r.antecedent)), r.consequent[0]): r.confidence
        for r in model.associationRules.collect()
    }
    ours = {(tuple(r.antecedent), r.suggested): r.confidence for r in mined}
    assert ours == pytest.approx(theirs)


def test_copies_are_counted_by_binary_digits(spark):
    """Multiplicities of many digits, and more distinct sets than one word holds."""
    rng = random.Random(6)
    skills = [f"s{i}" for i in range(9)]
    rows = [("c", rng.sample(skills, rng.randint(2, 5))) for _ in range(150)]
    rows += [("c", ["s0", "s1", "s2"])] * 1000 + [("c", ["s0", "S1"])] * 77 + [("c", [])] * 9
    got = rules.frequent_itemsets(frame(spark, rows), enough=150).collect()
    assert {(r.career, tuple(r.itemset)): r.freq for r in got} == brute_force(rows, 150, 20)
    assert max(len(r.itemset) for r in got) >= 3


def test_each_size_is_grown_from_the_one_before(spark, monkeypatch):
    rows = [("c", [f"s{j}" for j in range(6)])] * 30 + [("c", ["s0", f"t{i}"]) for i in range(40)]
    sizes, extend = [], rules._extended

    def seen(found, frequent):
        sizes.append({len(r.itemset) for r in found.select("itemset").distinct().collect()})
        return extend(found, frequent)

    monkeypatch.setattr(rules, "_extended", seen)
    got = rules.frequent_itemsets(frame(spark, rows), enough=40).collect()
    assert {(r.career, tuple(r.itemset)): r.freq for r in got} == brute_force(rows, 40, 20)
    assert sizes == [{2}, {3}, {4}, {5}, {6}]


def test_lexicon_drops_other_items_but_not_listings(spark):
    rows = [("c", ["a", "x"])] * 12 + [("c", ["y"])] * 10
    known = spark.createDataFrame([("A",)], "skill string")
    got = rules.frequent_itemsets(frame(spark, rows), known, enough=1).collect()
    assert [(r.itemset, r.freq, r.n) for r in got] == [(["a"], 12, 22)]


def test_too_few_listings(spark):
    assert rules.frequent_itemsets(frame(spark, [("c", ["a"])] * 20)).count() == 0


def test_confidence_and_its_minimum(spark):
    sets = spark.createDataFrame(
        [("c", ["a"], 10), ("c", ["b"], 4), ("c", ["a", "b"], 4), ("d", ["a"], 1000),
         ("d", ["b"], 1000), ("d", ["a", "b"], 99)],
        "career string, itemset array<string>, freq long",
    )
    got = {(r.career, *r.antecedent, r.suggested): r.confidence
           for r in rules.association_rules(sets).collect()}
    assert got == {("c", "a", "b"): 0.4, ("c", "b", "a"): 1.0}


def rule_table(spark, rows):
    frame = spark.createDataFrame(
        rows, "career string, antecedent array<string>, suggested string, confidence double"
    )
    return frame.withColumn("complexity", F.size("antecedent")).withColumn(
        "rule_id", rules.rule_id(F.col("career"), F.col("suggested"), F.col("antecedent"))
    )


def test_ordered_rules(spark):
    table = rule_table(
        spark, [("c", ["a"], "x", 0.9), ("c", ["a", "b"], "x", 0.2), ("c", ["a"], "y", 0.95)]
    )
    assert [r.confidence for r in rules.ordered_rules(table).collect()] == [0.2, 0.95, 0.9]


def test_upsert(spark):
    old = rule_table(spark, [("c", ["a"], "x", 0.5), ("c", ["b"], "x", 0.6)])
    new = rule_table(spark, [("c", ["a"], "x", 0.7)])
    merged = tables.upsert_rules(new, old)
    assert sorted(r.confidence for r in merged.collect()) == [0.6, 0.7]
    assert [r.confidence for r in tables.upsert_rules(new, old, overwrite=True).collect()] == [0.7]


def suggested(spark, skills, table, names, **kw):
    got = suggest.suggest_skills(
        spark.createDataFrame([(1, "Data Scientist")], "user_id long, career string"),
        spark.createDataFrame([(1, s) for s in skills], "user_id long, skill string"),
        table,
        spark.createDataFrame([(n,) for n in names], "skill string"),
        **kw,
    )
    return got


def test_suggestions(spark):
    table = rule_table(
        spark,
        [
            ("data+scientist", ["python"], "sql", 0.5),
            ("data+scientist", ["python", "r"], "spark", 0.7),
            ("data+scientist", ["python", "sas"], "spark", 0.9),
            ("data+scientist", ["python"], "r", 0.8),
            ("data+scientist", ["python"], "secret", 0.8),
            ("data+scientist", ["a", "b", "python", "r"], "sql", 0.8),
            ("nurse", ["python"], "sql", 0.1),
        ],
    )
    names = ["Python", "R", "SQL", "Spark", "A", "B", "SAS"]
    first = suggested(spark, ["R", "Python", "a", "b", "nonsense"], table, names)
    rows = {(r.suggested, r.confidence, tuple(r.used)) for r in first.collect()}
    assert rows == {("sql", 0.5, ("python",)), ("spark", 0.7, ("python", "r"))}
    other = suggested(spark, ["nonsense", "b", "a", "PYTHON", "r"], table, names)
    assert {(r.suggested, r.confidence, tuple(r.used)) for r in other.collect()} == rows
    assert suggested(spark, ["nonsense"], table, names).count() == 0


def test_suggestion_order(spark):
    frame = spark.createDataFrame(
        [(1, "c", "a", 0.5, 1, ["x"]), (1, "c", "b", 0.5, 1, ["x"]), (1, "c", "c", 0.1, 2, ["x", "y"])],
        "user_id long, career string, suggested string, confidence double, complexity int, used array<string>",
    )
    got = suggest.ordered_suggestions(frame).orderBy("rank").collect()
    assert [r.suggested for r in got] == ["c", "b", "a"]
    assert suggest.ordered_suggestions(frame, 2).count() == 2


def test_plan(spark):
    tips = spark.createDataFrame(
        [(1, "c", "s", 0.3, 1, ["x"]), (1, "c", "s", 0.2, 2, ["x", "y"]), (1, "c", "t", 0.39, 1, ["z"])],
        "user_id long, career string, suggested string, confidence double, complexity int, used array<string>",
    )
    edges = suggest.plan_edges(tips)
    got = {(r.skill, r.suggested): (r.strength, r.width) for r in edges.collect()}
    assert got.keys() == {("x", "s"), ("y", "s")}
    assert got["x", "s"] == pytest.approx((0.3, 4.0))
    assert got["y", "s"] == pytest.approx((0.2, 16 / 9))
    plan = suggest.learning_plan(edges).collect()
    assert [(r.suggested, r.n_used, r.tier, r["rank"]) for r in plan] == [("s", 2, "Medium", 1)]
    assert plan[0].score == pytest.approx(2.0)


def test_subsets(spark):
    users = spark.createDataFrame([(1, s) for s in "dbca"], "user_id long, skill string")
    for size, n in ((3, 4), (2, 6), (1, 4)):
        got = [tuple(r.subset) for r in suggest.skill_subsets(users, size).collect()]
        assert len(got) == n and set(got) == set(itertools.combinations("abcd", size))


def test_mining_writes_small_tables_in_short_plans(spark, monkeypatch):
    """A chain of steps in one task holds pages of memory for each of them."""
    steps = []

    def counting(write):
        def written(df):
            plan = df._jdf.queryExecution().executedPlan().toString()
            steps.append(sum(plan.count(f"{name}(") + plan.count(f"{name} [") for name in ("HashAggregate", "Sort", "Window")))
            return write(df)

        return written

    monkeypatch.setattr(rules, "cut", counting(rules.cut))
    monkeypatch.setattr(rules, "cut_counted", counting(rules.cut_counted))
    rows = [("c", [f"s{(i * k) % 7}" for k in (1, 2, 3)]) for i in range(60)]
    rules.frequent_itemsets(frame(spark, rows), enough=20).collect()
    assert max(steps) <= 12
