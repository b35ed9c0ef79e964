import datetime as dt

import pytest
from pyspark.sql import functions as F

import standins
from skilltrail import schemas
from skilltrail.operators import extract, feedback, lookup
from skilltrail.plans import jobs
from skilltrail.sources import pages, tables
from skilltrail.streaming import flows


def at(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=n)


def listing(url, minute, title="t", skills=("sql",)):
    return ("c", at(minute), title, "l", list(skills), "text", url)


def test_insert_if_absent(spark, tmp_path):
    path = str(tmp_path / "listings")
    first = spark.createDataFrame([listing("/a", 0, "old")], schemas.LISTINGS)
    assert tables.insert_listings(first, path) == 1
    batch = spark.createDataFrame(
        [listing("/a", 1, "new"), listing("/b", 3, "late"), listing("/b", 2, "early"),
         listing("/d", 1, "bare", ()), listing("/d", 5, "full"), listing("/e", 1, "none", ())],
        schemas.LISTINGS,
    )
    assert tables.insert_listings(batch, path) == 2
    assert tables.insert_listings(batch, path) == 0
    got = {r.unique_url: r.title for r in tables.read_listings(spark, path).collect()}
    assert got == {"/a": "old", "/b": "early", "/d": "full"}
    assert tables.read_listings(spark, path, "C").count() == 3
    assert tables.read_listings(spark, path, "other").count() == 0
    plan = tables.read_listings(spark, path, "c")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(career" in plan


def test_title_lists(spark, tmp_path):
    (tmp_path / "Nature.txt").write_text(
        "Trail Crew \nDirector, Design\nTrail Crew\nSpecialist​\n\nLast", encoding="utf8"
    )
    (tmp_path / "Law.txt").write_text("Clerk\n", encoding="utf8")
    got = {tuple(r) for r in tables.read_titles(spark, str(tmp_path)).collect()}
    assert got == {
        ("Nature", "Trail Crew", "trail+crew"),
        ("Nature", "Director, Design", "director+design"),
        ("Nature", "Specialist", "specialist"),
        ("Nature", "Last", "last"),
        ("Law", "Clerk", "clerk"),
    }


def test_lexicon_sources(spark, tmp_path):
    (tmp_path / "skills.csv").write_text("Skill\nCo-Op\nSQL\n")
    got = tables.read_lexicon_csv(spark, str(tmp_path / "skills.csv"))
    assert {(r.skill, r.formatted) for r in got.collect()} == {("co-op", "coop"), ("sql", "sql")}
    got.write.parquet(str(tmp_path / "lexicon"))
    assert tables.read_lexicon(spark, str(tmp_path / "lexicon")).count() == 2


@pytest.mark.parametrize("quoted", ['id="resultsCol"', "id='resultsCol'", "class=x id = resultsCol"])
def test_results_page(spark, quoted):
    html = """<body><h2><a href="/no">outside</a></h2><td id="resultsCol">
      <h2 class="t"><a class="x" href="http://www.example.com/rc/1?a=1&amp;b=2" title="R&amp;D Lead">R</a></h2>
      <span><span class="location"><span>Austin, TX 78701 (Downtown)</span></span></span>
      <h2><a href="/rc/2"><b>Data</b>
      Clerk</a></h2><p>no place</p>
      <table><tr><td>inner</td></tr></table><h2>no link</h2></td><td><h2><a href="/no">after</a></h2></td></body>"""
    html = html.replace('id="resultsCol"', quoted)
    frame = spark.createDataFrame([(1, html)], "page_id long, html string")
    got = [tuple(r)[1:] for r in pages.listing_fields(frame, ["page_id"]).orderBy("pos").collect()]
    assert got == [
        (0, "R&D Lead", "http://www.example.com/rc/1?a=1&b=2", "/rc/1?a=1&b=2", "Austin, TX"),
        (1, "Data Clerk", "/rc/2", "/rc/2", ""),
    ]


ACTIONS = "user_id long, skill string, action string, ts timestamp"


def test_user_skills(spark):
    log = spark.createDataFrame(
        [(1, "a", "add", at(0)), (1, "a", "add", at(1)), (1, "a", "remove", at(2)),
         (1, "a", "add", at(3)), (1, "b", "add", at(0)), (1, "b", "remove", at(1))],
        ACTIONS,
    )
    now = feedback.current_skills(log)
    assert [tuple(r) for r in now.collect()] == [(1, "a")]
    more = spark.createDataFrame([(1, "a"), (1, "c")], "user_id long, skill string")
    assert {tuple(r) for r in feedback.add_skills(now, more).collect()} == {(1, "a"), (1, "c")}


def suggestions(spark, rows):
    return spark.createDataFrame(rows, schemas.FEEDBACK)


ROWS = [
    ("add_skill", "Co-Op", at(0)), ("add_skill", "Co-Op", at(1)), ("add_skill", "co-op", at(2)),
    ("remove_skill", "SQL", at(0)), ("add_career", "Data Scientist", at(0)),
    ("add_career", "data scientist", at(5)),
]


def test_counters(spark):
    got = {r.action: r for r in feedback.skill_feedback(suggestions(spark, ROWS)).collect()}
    assert got["add_skill"].formatted == "coop" and got["add_skill"].n == 3
    assert got["add_skill"].spellings == {"Co-Op": 2, "co-op": 1}
    assert got["add_skill"].skill == "co-op" and got["remove_skill"].n == 1
    careers = feedback.career_feedback(suggestions(spark, ROWS))
    assert [tuple(r) for r in careers.collect()] == [("data+scientist", 2)]
    known = spark.createDataFrame([("nurse",)], "career string")
    assert feedback.promote_careers(careers, known, 2).count() == 1
    assert feedback.promote_careers(careers, known, 3).count() == 0
    assert feedback.promote_careers(careers, careers, 2).count() == 0


@pytest.mark.parametrize("split", [0, 1, 3, 5])
def test_folding_in_parts_equals_one_batch(spark, split):
    whole = jobs.fold_feedback(suggestions(spark, ROWS))
    first = jobs.fold_feedback(suggestions(spark, ROWS[:split]))
    both = jobs.fold_feedback(suggestions(spark, ROWS[split:]), *first)
    for a, b in zip(whole, both):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_lookups(spark):
    terms = spark.createDataFrame([("a",), ("SC",), ("ta",), ("zz",)], "term string")
    entries = spark.createDataFrame([("Data Scientist",), ("Nurse",), ("A",)], "entry string")
    got = {tuple(r) for r in lookup.typeahead(terms, entries).collect()}
    assert got == {("SC", "Data Scientist"), ("ta", "Data Scientist")}
    plan = lookup.typeahead(terms, entries)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    asked = spark.createDataFrame([(1, "nurse"), (2, "pilot")], "id long, career string")
    known = spark.createDataFrame([("nurse",), ("nurse",)], "career string")
    assert [r.id for r in lookup.known_requests(asked, known).collect()] == [1]
    assert [r.id for r in lookup.unknown_requests(asked, known).collect()] == [2]


CRAWL = (
    "page_id long, career string, searched_at timestamp, title string, location string, "
    "unique_url string, html string"
)


def crawl(spark, n, careers=("Data Clerk", "nurse")):
    skills = ["sql", "r", "excel", "care", "triage"]
    rows = []
    for i in range(n):
        words = " and ".join(s for j, s in enumerate(skills) if (i >> j) & 1 or j == i % 5)
        rows.append((i, careers[i % 2], at(i), f"T{i}", "X", f"/{i % (n - 4)}", f"<p>{words}</p>"))
    rows.append((n, "nurse", at(0), "none", "X", "/none", "<p>nothing</p>"))
    return spark.createDataFrame(rows, CRAWL)


def skills_lexicon(spark):
    names = [("SQL", 1), ("R", 2), ("Excel", 3), ("Care", 4), ("Triage", 5)]
    return extract.build_lexicon(spark.createDataFrame(names, "skill string, ord long"))


def test_refresh_and_pages(spark, tmp_path):
    store = jobs.Store(str(tmp_path / "store"))
    lex = skills_lexicon(spark)
    titles = spark.createDataFrame([("data+clerk",), ("nurse",)], "career string")
    batch = crawl(spark, 64)
    n = jobs.refresh(batch, lex, store, "one", titles=titles, enough=20)
    assert n == 60
    again = jobs.refresh(batch, lex, store, "two", previous="one", enough=20)
    assert again == 0
    stored = tables.read_listings(spark, store.listings)
    from skilltrail.operators.careers import CareerModel

    model = CareerModel.load(spark, store.model("two"))
    rule_table = spark.read.schema(schemas.RULES).parquet(store.rules("two"))
    assert rule_table.count() == spark.read.parquet(store.rules("one")).count() > 0
    users = spark.createDataFrame([(1, "SQL"), (1, "r"), (2, "care")], "user_id long, skill string")
    wanted = spark.createDataFrame(
        [(1, "Data Clerk"), (2, "Nurse"), (2, "Pilot")], "user_id long, career string"
    )
    result = jobs.career_pages(wanted, users, stored, model, rule_table, lex)
    result.save(str(tmp_path / "pages"))
    read = lambda name: spark.read.parquet(str(tmp_path / "pages" / name))
    assert {r.title for r in read("careers").collect()} == {"Data Clerk", "Nurse"}
    assert read("listings").groupBy("user_id").count().collect() and read("listings").count() == 10
    assert [tuple(r) for r in read("unknown").select("user_id", "career").collect()] == [(2, "pilot")]
    assert read("suggestions").where("suggested in ('sql')").where("user_id = 1").count() == 0
    assert read("plan").count() > 0 and read("edges").count() >= read("plan").count()


def test_reextract(spark):
    stored = spark.createDataFrame(
        [("c", at(0), "t", "l", ["old"], "sql and care", "/1"), ("c", at(0), "t", "l", ["old"], "-", "/2")],
        schemas.LISTINGS,
    )
    got = jobs.reextract(stored, skills_lexicon(spark)).collect()
    assert [(r.unique_url, r.skills) for r in got] == [("/1", ["Care", "SQL"])]


def test_ingest_stream_equals_batch(spark, tmp_path):
    lex = skills_lexicon(spark)
    whole = crawl(spark, 30)
    for i in range(3):
        whole.where(F.col("page_id") % 3 == i).coalesce(1).write.mode("append").parquet(
            str(tmp_path / "in")
        )
    jobs.ingest_pages(whole, lex, str(tmp_path / "batch"))

    def run():
        source = (
            spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1)
            .parquet(str(tmp_path / "in"))
        )
        flows.ingest_stream(source, lex, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()

    run()
    run()
    keys = lambda p: sorted(r.unique_url for r in tables.read_listings(spark, str(tmp_path / p)).collect())
    assert keys("out") == keys("batch")


def test_feedback_stream_equals_batch(spark, tmp_path):
    for i in range(0, 6, 2):
        suggestions(spark, ROWS[i : i + 2]).coalesce(1).write.mode("append").parquet(
            str(tmp_path / "in")
        )
    source = (
        spark.readStream.schema(schemas.FEEDBACK).option("maxFilesPerTrigger", 1)
        .parquet(str(tmp_path / "in"))
    )
    path = str(tmp_path / "out")
    flows.feedback_stream(source, path, {"availableNow": True}).awaitTermination()
    got = flows.read_feedback(spark, path)
    want = feedback.skill_feedback(suggestions(spark, ROWS))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    # Several batches ran, and two versions of a bucket at most are left.
    buckets = list((tmp_path / "out" / "counts").glob("bucket=*"))
    assert buckets and max(len(list(b.glob("batch=*"))) for b in buckets) <= 2
    flows.career_stream(source, str(tmp_path / "careers")).awaitTermination()
    got = flows.read_careers(spark, str(tmp_path / "careers"))
    want = feedback.career_feedback(suggestions(spark, ROWS))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def snapshot_files(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in path.rglob("part-*.parquet")}


def test_a_batch_rewrites_only_the_counts_it_touches(spark, tmp_path):
    def arrive(rows):
        suggestions(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        source = spark.readStream.schema(schemas.FEEDBACK).parquet(str(tmp_path / "in"))
        flows.feedback_stream(source, str(tmp_path / "out")).awaitTermination()

    many = [("add_skill", f"skill {i}", at(i)) for i in range(500)]
    arrive(many)
    run()
    before = snapshot_files(tmp_path / "out" / "counts")
    assert len(before) > 25
    arrive([("add_skill", "skill 3", at(900)), ("remove_skill", "x y", at(901))])
    run()
    after = snapshot_files(tmp_path / "out" / "counts")
    written = [f for f in after if f not in before]
    assert all(after[f] == t for f, t in before.items() if f in after)
    assert 1 <= len(written) <= 2 and all("/batch=1/" in f for f in written)
    rows = [*many, ("add_skill", "skill 3", at(900)), ("remove_skill", "x y", at(901))]
    want = sorted(map(str, feedback.skill_feedback(suggestions(spark, rows)).collect()))
    assert sorted(map(str, flows.read_feedback(spark, str(tmp_path / "out")).collect())) == want
    # The batch is run again, as after a failure before its commit.
    commit = tmp_path / "out" / "state" / "commits" / "1"
    commit.unlink()
    (commit.parent / ".1.crc").unlink(missing_ok=True)
    run()
    assert sorted(map(str, flows.read_feedback(spark, str(tmp_path / "out")).collect())) == want
    assert set(snapshot_files(tmp_path / "out" / "counts")) >= set(after) - set(written)


def test_stream_drops_copies_inside_and_beyond_the_watermark(spark, tmp_path):
    import time

    lex = skills_lexicon(spark)
    whole = crawl(spark, 30).cache()
    # A page again as it was, one with another text earlier in time, one of a known URL only.
    again = whole.where("page_id < 9")
    other = whole.where("page_id between 5 and 7").withColumn("html", F.lit("<p>Care</p>")).withColumn(
        "searched_at", F.col("searched_at") - F.expr("interval 1 day")
    )
    batches = [whole.where("page_id < 12"), again.union(other), whole, again]
    seen = []
    insert = flows.ingest_pages

    def counted(batch, *args):
        seen.append(batch.count())
        return insert(batch, *args)

    def run(within):
        source = spark.readStream.schema(whole.schema).parquet(str(tmp_path / "in"))
        flows.ingest_stream(
            source, lex, str(tmp_path / "out"), str(tmp_path / "cp"), copies_within=within
        ).awaitTermination()

    flows.ingest_pages = counted
    try:
        for i, batch in enumerate(batches):
            batch.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            if i == 3:
                time.sleep(3)
            run("1 hour" if i < 2 else "1 second")
    finally:
        flows.ingest_pages = insert
    # In the second run only the other copies pass; the last one lies beyond the watermark.
    assert [n for n in seen if n][:2] == [12, 3] and seen[-1] in (0, 9)
    for batch in batches:
        jobs.ingest_pages(batch, lex, str(tmp_path / "batch"))
    rows = lambda p: sorted(map(str, tables.read_listings(spark, str(tmp_path / p)).collect()))
    assert rows("out") == rows("batch") and len(rows("out")) == len({r.split("unique_url=")[1] for r in rows("out")})


def listing_rows(spark, urls):
    rows = [(f"c{i % 3}+a%b", at(i), "t", "l", ["sql"], "x", u) for i, u in enumerate(urls)]
    return spark.createDataFrame(rows, schemas.LISTINGS)


def read_files(frame):
    """Files and rows that the scan of a frame's plan has read."""
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan
    scan = plan
    while scan.children().size():
        scan = scan.children().head()
    metric = lambda name: scan.metrics().apply(name).value()
    return metric("numFiles"), metric("numOutputRows")


def test_insert_reads_only_touched_keys(spark, tmp_path):
    from skilltrail.sources import keys

    path = str(tmp_path / "listings")
    urls = [f"/old/{i}" for i in range(4000)]
    assert tables.insert_listings(listing_rows(spark, urls), path) == 4000
    assert not (tmp_path / "listings" / "_keys").exists()
    batch = ["/old/7", "/new/1", "/new/1", "/new/2", "/old/3999"]
    assert tables.insert_listings(listing_rows(spark, batch), path) == 2
    asked = spark.createDataFrame([("/old/7",), ("/new/3",)], "unique_url string")
    found = keys.stored_keys(spark, path, asked)
    files, rows = read_files(found)
    buckets = {r.b for r in asked.select(keys.bucket_of(F.xxhash64("unique_url")).alias("b")).collect()}
    have = [f for b in buckets for f in (tmp_path / "listings" / "_keys" / "urls").glob(f"bucket={b}/*.parquet")]
    # Only the two buckets, and of these only the row group whose filter has the hash.
    assert files == len(have) and 1 <= rows < 100
    assert [r.unique_url for r in found.collect()] == ["/old/7"]
    none = keys.stored_keys(spark, path, spark.createDataFrame([("/new/77",)], "unique_url string"))
    assert read_files(none)[1] == 0
    assert len(none.inputFiles()) <= 1
    # More keys than are looked up one by one.
    many = [f"/old/{i}" for i in range(300)] + [f"/late/{i}" for i in range(300)]
    assert tables.insert_listings(listing_rows(spark, many), path) == 300
    assert tables.read_listings(spark, path).count() == 4302


def test_index_takes_up_what_it_lacks(spark, tmp_path):
    from skilltrail.sources import keys

    path = str(tmp_path / "listings")
    # Files of a writer without an index, then one that broke off before naming its files.
    listing_rows(spark, ["/a", "/b"]).write.partitionBy("career").parquet(path)
    assert tables.insert_listings(listing_rows(spark, ["/b", "/c"]), path) == 1
    assert keys.index_new_files(tables.stored_listings(spark, path), path) == 1
    for f in (tmp_path / "listings" / "_keys" / "files").glob("*.parquet"):
        f.unlink()
    assert tables.insert_listings(listing_rows(spark, ["/a", "/c", "/d", None, None]), path) == 2
    assert tables.insert_listings(listing_rows(spark, ["/a", "/c", "/d"]), path) == 0
    assert keys.index_new_files(tables.stored_listings(spark, path), path) == 0
    urls = [r.unique_url for r in tables.read_listings(spark, path).collect()]
    assert sorted(map(str, urls)) == ["/a", "/b", "/c", "/d", "None"]


def test_copies_of_one_moment_are_chosen_alike(spark):
    rows = [("/a", "t%d" % i, 1) for i in range(20)]
    for parts in (1, 7):
        batch = spark.createDataFrame(rows, "unique_url string, title string, searched_at int").repartition(parts)
        stored = batch.where("false")
        chosen = [r.title for r in tables.new_listings(batch, stored).collect()]
        assert len(chosen) == 1
        rows = rows[::-1]
        first = chosen if parts == 1 else first
        assert chosen == first
    assert tables.new_listings(batch, batch.limit(1)).collect() == []


def test_scopes_remove_their_tables(spark):
    import os

    from skilltrail import session

    outer = session.cut(spark.range(3))
    with session.scratch_scope(spark):
        with session.scratch_scope(spark):
            assert session.cut(spark.range(5)).count() == 5
        inside = session.cut(spark.range(4)).inputFiles()
        assert inside
    assert not any(os.path.exists(f.removeprefix("file://")) for f in inside)
    assert outer.count() == 3


def test_stream_of_a_table_in_a_folder_or_a_file(spark, tmp_path):
    """A table of several files in a folder streams as one in a single file does."""
    pages = spark.range(30).selectExpr("id AS page_id", "concat('http://a.org/', id) AS url")
    pages.repartition(3).write.parquet(f"{tmp_path}/many/pages.parquet")
    pages.coalesce(1).write.parquet(f"{tmp_path}/written")
    (tmp_path / "one").mkdir()
    next((tmp_path / "written").glob("part-*")).rename(tmp_path / "one" / "pages.parquet")
    for kind in ("many", "one"):
        stream = standins.stream_of(spark, f"{tmp_path}/{kind}", "pages")
        query = stream.writeStream.format("memory").queryName(f"of_{kind}").trigger(availableNow=True).start()
        query.awaitTermination()
        assert sorted(r.page_id for r in spark.table(f"of_{kind}").collect()) == [*range(30)]
