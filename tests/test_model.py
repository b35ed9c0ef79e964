import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from skilltrail.operators import careers, listings


def fit(spark, docs):
    return careers.fit_career_model(
        spark.createDataFrame(docs, "career string, skills array<string>")
    )


def users_of(spark, rows):
    return spark.createDataFrame(rows, "user_id long, skill string")


def test_idf_and_cosine(spark):
    model = fit(spark, [("d1", ["a", "A", "b"]), ("d2", ["b"]), ("d2", ["c"])])
    assert {(r.skill, r.df, r.idf) for r in model.idf.collect()} == {("a", 1, 1.0), ("c", 1, 1.0)}
    got = careers.suggest_careers(users_of(spark, [(1, "A"), (2, "zzz")]), model).collect()
    assert sorted((r.user_id, r["rank"], r.career, r.sim) for r in got) == [
        (1, 1, "d1", 1.0), (1, 2, "d2", 0.0), (2, 1, "d1", 0.0), (2, 2, "d2", 0.0)
    ]


def test_users_without_skills_get_the_first_careers(spark):
    model = fit(spark, [("d", ["a", "b"]), ("c", ["b"])])
    owners = spark.createDataFrame([(1,), (2,)], "user_id long")
    got = careers.suggest_careers(users_of(spark, [(1, "a")]), model, owners=owners).collect()
    assert sorted((r.user_id, r["rank"], r.career) for r in got) == [
        (1, 1, "d"), (1, 2, "c"), (2, 1, "c"), (2, 2, "d")
    ]


def test_single_document_has_no_similarity(spark):
    got = careers.suggest_careers(users_of(spark, [(1, "a")]), fit(spark, [("d", ["a", "b"])]))
    assert [(r.career, r.sim) for r in got.collect()] == [("d", 0.0)]


def test_zeros_fill_up_by_name(spark):
    docs = [(f"c{i}", [f"s{i}", "x"]) for i in range(7)] + [("c8", ["q"])]
    got = careers.suggest_careers(users_of(spark, [(1, "s5"), (1, "s3")]), fit(spark, docs)).collect()
    assert [r.career for r in sorted(got, key=lambda r: r["rank"])] == ["c3", "c5", "c0", "c1", "c2"]


def test_save_and_load(spark, tmp_path):
    model = fit(spark, [("d1", ["a"]), ("d2", ["b"])])
    model.save(str(tmp_path / "m"))
    again = careers.CareerModel.load(spark, str(tmp_path / "m"))
    assert sorted(again.vectors.collect()) == sorted(model.vectors.collect())


def brute_force(stored, wanted, owned, k):
    out = {}
    for user, career in wanted:
        docs = {u: Counter(s.lower() for s in skills) for c, u, skills in stored if c == career}
        df = Counter(s for bag in docs.values() for s in bag)
        idf = {s: math.log2(len(docs) / n) for s, n in df.items() if n < len(docs)}

        def unit(bag):
            w = {s: n * idf[s] for s, n in bag.items() if s in idf}
            norm = math.sqrt(sum(x * x for x in w.values()))
            return {s: x / norm for s, x in w.items()} if norm else {}

        q = unit(Counter(s.lower() for u, s in owned if u == user))
        sims = {
            url: round(sum(q.get(s, 0) * x for s, x in unit(bag).items()), 6)
            for url, bag in docs.items()
        }
        out[user, career] = sorted(sims.items(), key=lambda kv: (-kv[1], kv[0]))[:k]
    return out


@pytest.mark.parametrize("seed,vocabulary,hot", [(1, 12, False), (2, 60, True), (3, 4, True)])
def test_listing_ranking_equals_full_scan(spark, seed, vocabulary, hot):
    """The search that skips weak skills must give what scoring every listing gives."""
    rng = random.Random(seed)
    skills = [f"S{i}" for i in range(vocabulary)]
    stored = []
    for i in range(150):
        bag = rng.choices(skills, k=rng.randint(1, 6))
        if hot and rng.random() < 0.7:
            bag += ["common", "Common", "usual"][: rng.randint(1, 3)]
        stored.append((rng.choice(["c1", "c1", "c2"]), f"/{i}", bag))
    stored += [("c1", f"/copy{i}", ["S1", "common"]) for i in range(20)]
    owned = [
        (u, s)
        for u in range(25)
        for s in rng.choices(skills, k=rng.randint(0, 4)) + (["common", "usual"] if hot else [])
    ]
    owned += [(u + 100, s) for u, s in owned[:30]]
    wanted = sorted({(u, c) for u, _ in owned for c in ("c1", "c2")})
    got = listings.rank_listings(
        spark.createDataFrame(wanted, "user_id long, career string"),
        users_of(spark, owned),
        spark.createDataFrame(stored, "career string, unique_url string, skills array<string>"),
    ).collect()
    want = brute_force(stored, wanted, owned, 5)
    seen = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        seen.setdefault((r.user_id, r.career), []).append((r.unique_url, r.sim))
    assert seen.keys() == want.keys()
    for key in want:
        assert [u for u, _ in seen[key]] == [u for u, _ in want[key]], key
        assert [s for _, s in seen[key]] == pytest.approx([s for _, s in want[key]], abs=2e-6)


@pytest.mark.parametrize("seed,vocabulary", [(4, 8), (5, 40)])
def test_jaccard_equals_full_scan(spark, seed, vocabulary):
    rng = random.Random(seed)
    skills = [f"s{i}" for i in range(vocabulary)]
    stored = [
        ("c", f"/{i}", rng.choices(skills, k=rng.randint(1, 7)) + ["usual"] * rng.randint(0, 1))
        for i in range(150)
    ]
    owned = [(u, s) for u in range(30) for s in rng.choices(skills, k=rng.randint(1, 6)) + ["usual"]]
    got = listings.rank_listings_jaccard(
        spark.createDataFrame([(u, "c") for u in range(30)], "user_id long, career string"),
        users_of(spark, owned),
        spark.createDataFrame(stored, "career string, unique_url string, skills array<string>"),
    ).collect()
    for user in range(30):
        mine = {s for u, s in owned if u == user}
        sims = {
            url: round(len(mine & set(bag)) / len(mine | set(bag)), 6) for _, url, bag in stored
        }
        want = sorted(sims.items(), key=lambda kv: (-kv[1], kv[0]))[:5]
        mine_got = sorted((r for r in got if r.user_id == user), key=lambda r: r["rank"])
        assert [(r.unique_url, pytest.approx(r.sim)) for r in mine_got] == want


@pytest.mark.parametrize("seed,block", [(6, 8), (7, 30)])
def test_long_lists_in_levels_and_parts_equal_full_scan(spark, monkeypatch, seed, block):
    """Blocks far smaller than the lists: levels, parts and both rounds are in use."""
    build = listings.Index.build
    monkeypatch.setattr(listings.Index, "build", staticmethod(lambda p, level: build(p, level, block)))
    rng = random.Random(seed)
    skills = [f"s{i}" for i in range(14)]
    stored = [
        ("c", f"/{i:03}", rng.choices(skills, [2.0**-j for j in range(14)], k=rng.randint(1, 25)))
        for i in range(300)
    ]
    owned = [(u, s) for u in range(40) for s in rng.choices(skills, k=rng.choice([1, 1, 3, 8]))]
    frames = (
        spark.createDataFrame([(u, "c") for u in range(40)], "user_id long, career string"),
        users_of(spark, owned),
        spark.createDataFrame(stored, "career string, unique_url string, skills array<string>"),
    )
    want = brute_force(stored, [(u, "c") for u in range(40)], owned, 5)
    for user, rows in by_user(listings.rank_listings(*frames)).items():
        expected = want[user, "c"]
        assert [s for _, s in rows] == pytest.approx([s for _, s in expected], abs=2e-6)
        assert [u for u, _ in rows] == [u for u, _ in expected]
    for user, rows in by_user(listings.rank_listings_jaccard(*frames)).items():
        mine = {s for u, s in owned if u == user}
        sims = {u: round(len(mine & set(b)) / len(mine | set(b)), 6) for _, u, b in stored}
        assert rows == sorted(sims.items(), key=lambda kv: (-kv[1], kv[0]))[:5]


def by_user(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: r["rank"]):
        out.setdefault(r.user_id, []).append((r.unique_url, round(r.sim, 6)))
    return out


def test_few_postings_of_a_hot_skill_are_read(spark, monkeypatch):
    """A skill of nearly all listings, asked for alone and with others."""
    n = 8000
    rng = random.Random(8)
    stored = [("c", f"/{i:05}", ["hot"] * (1 + i % 9) + [f"w{rng.randrange(2000)}" for _ in range(12)]) for i in range(n)]
    stored += [("c", f"/x{i}", ["other"]) for i in range(400)]
    owned = [(0, "hot"), *[(u, s) for u in range(1, 9) for s in ("hot", f"w{u}", f"w{u + 9}")]]
    frames = (
        spark.createDataFrame([(u, "c") for u in range(9)], "user_id long, career string"),
        users_of(spark, owned),
        spark.createDataFrame(stored, "career string, unique_url string, skills array<string>"),
    )
    count, read = [], listings.Index.read

    def counted(self, wanted, on):
        rows = read(self, wanted, on)
        count.append(rows.count())
        return rows

    monkeypatch.setattr(listings.Index, "read", counted)
    want = brute_force(stored, [(u, "c") for u in range(9)], owned, 5)
    found = by_user(listings.rank_listings(*frames))
    assert {u: [x for x, _ in rows] for u, rows in found.items()} == {u: [x for x, _ in want[u, "c"]] for u in range(9)}
    # Read whole, the hot list alone would be 9 * 8000 postings.
    assert sum(count) < 9 * n / 5, count
    count.clear()
    by_user(listings.rank_listings_jaccard(*frames))
    assert sum(count) < 9 * n / 3, count


def test_jaccard(spark):
    stored = spark.createDataFrame(
        [("c", "/1", ["a", "b", "b"]), ("c", "/2", ["a"]), ("c", "/3", ["A"]), ("c", "/4", ["z"])],
        "career string, unique_url string, skills array<string>",
    )
    got = listings.rank_listings_jaccard(
        spark.createDataFrame([(1, "c"), (2, "c")], "user_id long, career string"),
        users_of(spark, [(1, "a"), (1, "b"), (1, "c")]),
        stored,
        k=3,
    ).collect()
    assert sorted((r.user_id, r["rank"], r.unique_url, r.sim) for r in got) == [
        (1, 1, "/1", pytest.approx(2 / 3, abs=1e-6)),
        (1, 2, "/2", pytest.approx(1 / 3, abs=1e-6)),
        (1, 3, "/3", pytest.approx(1 / 3, abs=1e-6)),
        (2, 1, "/1", 0.0),
        (2, 2, "/2", 0.0),
        (2, 3, "/3", 0.0),
    ]
    described = listings.describe_listings(
        spark.createDataFrame([("/1",)], "unique_url string"),
        stored.withColumn("title", F.lit("T")).withColumn("location", F.lit("L")),
    )
    assert described.first().title == "T"


def test_sets_of_skills_are_not_counted_again(spark, monkeypatch):
    """A bag of the Jaccard search is a set, so its skills need no grouping by profile."""
    monkeypatch.setattr(listings, "_profile_terms", None)
    stored = spark.createDataFrame(
        [("c", "a", ["x", "y", "X"]), ("c", "b", ["z"])], "career string, unique_url string, skills array<string>"
    )
    requests = spark.createDataFrame([(1, "c")], "user_id int, career string")
    skills = spark.createDataFrame([(1, "x")], "user_id int, skill string")
    got = listings.rank_listings_jaccard(requests, skills, stored).orderBy("rank").collect()
    assert [(r["unique_url"], r["sim"]) for r in got] == [("a", 0.5), ("b", 0.0)]
